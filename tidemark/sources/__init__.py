"""Scans of landed files, and sinks."""
