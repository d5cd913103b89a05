"""Table contracts: columns in order, keys, and what must hold."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Contract:
    """A table's columns with their types, the key, the columns that may not be null, and the text columns that may not be blank."""

    columns: dict[str, str]
    key: tuple[str, ...]
    required: tuple[str, ...] = ()
    domains: dict[str, tuple[str, ...]] = field(default_factory=dict)
    ranges: dict[str, tuple[float, float]] = field(default_factory=dict)
    widths: dict[str, int] = field(default_factory=dict)
    filled: tuple[str, ...] = ()


OHLCV = Contract(
    {"timestamp_utc": "timestamp", "pair": "string", "timeframe": "string", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "source": "string"},
    ("timestamp_utc", "pair", "timeframe"),
    ("timestamp_utc", "pair", "timeframe", "open", "high", "low", "close"),
)
MACRO = Contract(
    {"timestamp_utc": "timestamp", "series_id": "string", "value": "double", "source": "string", "frequency": "string", "units": "string"},
    ("timestamp_utc", "series_id"),
    ("timestamp_utc", "series_id", "value", "source", "frequency", "units"),
    filled=("series_id", "source", "frequency", "units"),
)
EVENTS = Contract(
    {"timestamp_utc": "timestamp", "event_id": "string", "country": "string", "event_name": "string", "impact": "string", "actual": "double", "forecast": "double", "previous": "double", "source": "string"},
    ("event_id",),
    ("timestamp_utc", "event_id", "country", "event_name", "impact", "source"),
    {"impact": ("high", "medium", "low", "unknown")},
)
NEWS = Contract(
    {"timestamp_utc": "timestamp", "article_id": "string", "currency": "string", "headline": "string", "sentiment_score": "double", "sentiment_label": "string", "document_type": "string", "speaker": "string", "source": "string", "url": "string"},
    ("article_id",),
    ("timestamp_utc", "article_id", "currency", "headline", "sentiment_score", "sentiment_label", "document_type", "source"),
    {"sentiment_label": ("positive", "negative", "neutral")},
    {"sentiment_score": (-1.0, 1.0)},
)
#: The five stored tables: columns, keys, what may not be null, and widths of text columns.
STORED = {
    "fx_prices": Contract({"timestamp_utc": "timestamp", "pair": "string", "timeframe": "string", "open": "double", "high": "double", "low": "double", "close": "double", "volume": "double", "source": "string"}, ("timestamp_utc", "pair", "timeframe"), ("timestamp_utc", "pair"), widths={"pair": 10, "timeframe": 10, "source": 50}),
    "economic_events": Contract({"timestamp_utc": "timestamp", "country": "string", "event_name": "string", "impact": "string", "actual": "double", "forecast": "double", "previous": "double", "source": "string"}, ("timestamp_utc", "event_name"), ("timestamp_utc",), widths={"country": 50, "event_name": 100, "impact": 20, "source": 50}),
    "ecb_policy_rates": Contract({"timestamp_utc": "timestamp", "rate_type": "string", "rate": "double", "frequency": "string", "unit": "string", "source": "string"}, ("timestamp_utc", "rate_type"), ("timestamp_utc",), widths={"rate_type": 50, "frequency": 20, "unit": 20, "source": 50}),
    "ecb_exchange_rates": Contract({"timestamp_utc": "timestamp", "currency_pair": "string", "rate": "double", "frequency": "string", "source": "string"}, ("timestamp_utc", "currency_pair"), ("timestamp_utc",), widths={"currency_pair": 20, "frequency": 20, "source": 50}),
    "macro_indicators": Contract({"timestamp_utc": "timestamp", "series_id": "string", "value": "double", "source": "string"}, ("timestamp_utc", "series_id"), ("timestamp_utc",), widths={"series_id": 100, "source": 50}),
}


def completed(df: DataFrame, contract: Contract) -> DataFrame:
    """The contract's columns in order; those that are missing are NULL."""
    have = set(df.columns)
    return df.select(*((F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in contract.columns.items()))
