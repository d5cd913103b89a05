"""Queries over the driver tables, and the same as DuckDB SQL."""
