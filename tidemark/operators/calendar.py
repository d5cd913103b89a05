"""Economic calendar events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import EVENTS, completed
from tidemark.functions.ids import event_id
from tidemark.functions.numbers import parse_number
from tidemark.functions.text import blank_to_null, country_code, country_from_name
from tidemark.functions.times import clock_timestamp, iso
from tidemark.operators.dedup import deduplicated


def events(raw: DataFrame, order: list[str]) -> DataFrame:
    """Scraped rows (date, time, currency, country, event, impact, actual, forecast, previous, source, all text) -> events."""
    have = set(raw.columns)
    text = lambda c: blank_to_null(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")
    out = raw.withColumn("timestamp_utc", clock_timestamp(text("date"), text("time"))).withColumn("event_name", F.coalesce(text("event"), F.lit("")))
    out = out.withColumn("_country", F.coalesce(country_from_name(F.col("event_name")), country_code(F.coalesce(text("currency"), text("country")))))
    out = out.withColumns({
        "country": F.col("_country"),
        "event_id": event_id(iso(F.col("timestamp_utc")), F.col("_country"), F.col("event_name")),
        "impact": F.lower(F.coalesce(text("impact"), F.lit("unknown"))),
        **{c: parse_number(text(c)) for c in ("actual", "forecast", "previous")},
        "source": F.coalesce(text("source"), F.lit("unknown")),
    })
    return completed(deduplicated(out.select(*EVENTS.columns, *order), ["event_id"], order), EVENTS)  # no raw text goes along


def row_errors(raw: DataFrame, row: str) -> DataFrame:
    """A row per fault: row, message."""
    fields = ("date", "currency", "event", "impact")
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) == ""
    empty = F.lit(True)
    for c in raw.columns:
        if c != row:
            empty = empty & blank(c)
    own = [F.when(blank(c), F.lit(f"Missing required field '{c}'")) for c in fields]
    bad_date = ~blank("date") & F.try_to_date(F.col("date"), "yyyy-MM-dd").isNull()
    own.append(F.when(bad_date, F.concat(F.lit("Invalid date format '"), F.col("date"), F.lit("'"))))
    found = F.when(empty, F.array(F.lit("Empty event data"))).otherwise(F.array_compact(F.array(*own)))
    return raw.select(F.col(row), F.explode(found).alias("message"))


def table(raw: DataFrame) -> DataFrame:
    """Scraped rows with ``date`` as a date; what is none becomes NULL."""
    return raw.withColumn("date", F.try_to_date(F.col("date").cast("string")))
