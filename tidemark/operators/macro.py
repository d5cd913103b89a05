"""Macro series and policy rates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.contracts import MACRO, completed
from tidemark.functions.numbers import to_number
from tidemark.operators.dedup import deduplicated
from tidemark.operators.prices import mapped

#: Rate code -> series.
RATES = {"DFR": "ECB_DFR", "MRR_FR": "ECB_MRR", "MRR_MBR": "ECB_MLF"}
#: Series and dataset dimensions (id, frequency, units).
SERIES = [("DFF", "D", "Percent"), ("CPIAUCSL", "M", "Index"), ("UNRATE", "M", "Percent"), ("STLFSI4", "W", "Index")]


def series(df: DataFrame, order: list[str]) -> DataFrame:
    """date and value as text -> the contract's columns; rows without a number go, the first of equal keys stays."""
    out = df.withColumns({"timestamp_utc": F.try_to_timestamp(F.col("date").cast("string")), "value": to_number(F.col("value").cast("string"))})
    for c in ("series_id", "source", "frequency", "units"):
        out = out.withColumn(c, F.col(c).cast("string"))
    out = out.where("value is not null and timestamp_utc is not null")
    return completed(deduplicated(out.select(*MACRO.columns, *order), list(MACRO.key), order), MACRO)


def policy_rates(df: DataFrame, order: list[str]) -> DataFrame:
    """code, date, value -> series rows; the first row's frequency (default B) holds for its code, the last of equal keys stays."""
    out = mapped(df, "code", RATES, "series_id")
    first = F.lit("B")
    if "frequency" in df.columns:
        each = out.groupBy(F.col("code").alias("_code")).agg(F.min_by(F.struct("frequency"), F.struct(*order)).alias("_first"))
        out = out.join(F.broadcast(each), F.col("code") == F.col("_code"))  # a row per code of a fixed list
        first = F.col("_first.frequency")
    out = out.withColumns({"frequency": first, "units": F.lit("Percent"), "timestamp_utc": F.try_to_timestamp(F.col("date").cast("string")), "value": to_number(F.col("value").cast("string"))})
    out = out.where("value is not null and timestamp_utc is not null").select(*MACRO.columns, *order)
    return completed(deduplicated(out, list(MACRO.key), order, keep="last"), MACRO)


def with_metadata(observations: DataFrame, metadata: DataFrame) -> DataFrame:
    """Frequency and units from the series' metadata, N/A where there is none."""
    meta = metadata.select(F.col("series_id").alias("_id"), "frequency_short", "units")  # small or not: the planner sees its size
    out = observations.join(meta, F.col("series_id") == F.col("_id"), "left").drop("_id")
    return out.withColumns({"frequency_short": F.coalesce("frequency_short", F.lit("N/A")), "units": F.coalesce("units", F.lit("N/A"))})


def latest_revisions(pulls: DataFrame, keys: list[str], ingested: str, tie: list[str]) -> DataFrame:
    """The newest revision of each observation over all pulls."""
    return deduplicated(pulls, keys, [ingested, *tie], keep="last")
