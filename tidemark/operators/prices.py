"""Price bars: exchange bars from terminals, and daily bars made of single rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import OHLCV, completed
from tidemark.functions.numbers import to_number
from tidemark.operators.dedup import deduplicated

#: Quoted currency -> pair.
PAIRS = {"USD": "EURUSD", "GBP": "EURGBP", "JPY": "EURJPY", "CHF": "EURCHF"}


def mapped(df: DataFrame, column: str, values: dict[str, str], name: str) -> DataFrame:
    """Inner join with a constant map, one pass for all codes; codes without an entry go."""
    dim = df.sparkSession.createDataFrame(list(values.items()), f"_code string, {name} string")
    return df.join(F.broadcast(dim), F.col(column) == F.col("_code")).drop("_code")


def epoch_bars(df: DataFrame, order: list[str]) -> DataFrame:
    """Bars with epoch seconds -> the contract's columns, first of equal (time, pair, timeframe)."""
    out = df.withColumn("timestamp_utc", F.timestamp_seconds("time")).withColumnRenamed("tick_volume", "volume")
    return completed(deduplicated(out.select(*OHLCV.columns, *order), list(OHLCV.key), order), OHLCV)


def synthetic_bars(rates: DataFrame, order: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """One rate a day -> a bar with equal prices at 15:00; the last of equal keys stays.

    ``rates`` has code, day (date), rate (text), source and the order columns.
    The day is filtered before the shift to 15:00.
    """
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is not None:
            rates = rates.where(f"day {op} date'{bound}'")
    value = to_number(F.col("rate").cast("string"))
    out = mapped(rates, "code", PAIRS, "pair").withColumn("close", value).where("close is not null and day is not null")
    out = out.select((F.col("day").cast("timestamp") + F.expr("interval 15 hours")).alias("timestamp_utc"), "pair", F.lit("D1").alias("timeframe"), *(F.col("close").alias(c) for c in ("open", "high", "low", "close")), F.lit(0.0).alias("volume"), "source", *order)
    return completed(deduplicated(out, list(OHLCV.key), order, keep="last"), OHLCV)
