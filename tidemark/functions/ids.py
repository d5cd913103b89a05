"""Stable ids."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import blank_to_null


def event_id(timestamp: Column, country: Column, name: Column) -> Column:
    """16 hex digits over timestamp|country|name; a missing timestamp counts as the text None."""
    key = F.concat(F.coalesce(timestamp, F.lit("None")), F.lit("|"), F.coalesce(country, F.lit("")), F.lit("|"), F.coalesce(name, F.lit("")))
    return F.substring(F.sha2(key, 256), 1, 16)


def article_id(url: Column, source: Column, title: Column, timestamp: Column) -> Column:
    """16 hex digits over the URL, else over source|title|timestamp."""
    key = F.concat(F.coalesce(source, F.lit("")), F.lit("|"), F.coalesce(title, F.lit("")), F.lit("|"), F.coalesce(timestamp, F.lit("")))
    return F.substring(F.sha2(F.coalesce(blank_to_null(url), key), 256), 1, 16)


def url_hash(url: Column) -> Column:
    return F.sha2(url, 256)
