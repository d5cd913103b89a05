"""Number normalisers and tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_NUMBER = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)[%KkMmBbTt]?$"
_SCALES = {"K": 1e3, "M": 1e6, "B": 1e9, "T": 1e12}


def parse_number(c: Column) -> Column:
    """'4.50%' to 4.5, '150K' to 150000.0, the first part of '4.75|2.7'; NULL where there is no number."""
    first = F.trim(F.split_part(F.trim(c), F.lit("|"), F.lit(1)))
    plain = F.replace(first, F.lit(","), F.lit(""))
    scale = F.element_at(F.create_map(*(F.lit(x) for pair in _SCALES.items() for x in pair)), F.upper(F.right(plain, F.lit(1))))
    return F.regexp_extract(plain, _NUMBER, 1).try_cast("double") * F.coalesce(scale, F.lit(1.0))


def to_number(c: Column) -> Column:
    """A finite or infinite double; text that is none, and NaN, become NULL."""
    value = c.try_cast("double")
    return F.when(~F.isnan(value), value)


def signed_score(label: Column, confidence: Column, text: Column | None = None) -> Column:
    """+confidence, -confidence or 0 by label, to 4 places; 0 for empty text."""
    low = F.lower(label)
    score = F.when(low == "positive", confidence).when(low == "negative", -confidence).otherwise(0.0)
    if text is not None:
        score = F.when(F.coalesce(F.trim(text), F.lit("")) == "", 0.0).otherwise(score)
    return F.round(score, 4)


def ohlc_consistent(o: str = "open", h: str = "high", lo: str = "low", c: str = "close") -> Column:
    return (F.col(h) >= F.greatest(o, c, lo)) & (F.col(lo) <= F.least(o, c, h))


def surprise(actual: Column, forecast: Column) -> Column:
    return actual - forecast


def surprise_percent(actual: Column, forecast: Column) -> Column:
    return (actual - forecast) / F.nullif(F.abs(forecast), F.lit(0.0)) * 100
