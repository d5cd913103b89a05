"""Structured Streaming forms of repeated collection."""
