"""Sinks: CSV, JSON Lines and Parquet in one write for all groups."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from datetime import datetime

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.operators.merge import file_system
from tidemark.operators.scan import joined
from tidemark.sources.files import CALENDAR_COLUMNS


def _some(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("nothing to export")
    return df


def bronze_csv(df: DataFrame, root: str, source: str, dataset: str, day: str) -> str:
    path = f"{root}/{source}_{dataset}_{day}.csv"
    _some(df).write.mode("overwrite").option("header", True).csv(path)
    return path


@dataclass(frozen=True)
class Written:
    """Where an export lies, how many rows it has and from when to when (None: no rows)."""

    path: str
    n_rows: int
    first: datetime | None
    last: datetime | None


def silver_written(df: DataFrame, root: str, category: str, ts: str, name: str = "", kind: str = "parquet") -> Written:
    """``category[_name]_start_end.kind``, the range taken from the rows; files and their rows are in order of time.

    The input is computed once: it is written aside while its rows are counted and its ends are found, and the ordered
    files, whose name needs the ends and whose ranges need a sample, are made from what was written.
    """
    if kind not in ("csv", "parquet"):
        raise ValueError(f"unknown format {kind!r}")
    spark, aside, seen = df.sparkSession, f"{root}/_aside_{uuid.uuid4().hex}", Observation()
    try:
        df.observe(seen, F.count(F.lit(1)).alias("n"), F.min(ts).alias("first"), F.max(ts).alias("last"), F.date_format(F.min(ts), "yyyyMMdd").alias("a"), F.date_format(F.max(ts), "yyyyMMdd").alias("b")).write.parquet(aside)
        ends = seen.get
        if not ends["n"]:
            raise ValueError("nothing to export")
        path = f"{root}/{'_'.join(x for x in (category, name, ends['a'], ends['b']) if x)}.{kind}"
        writer = spark.read.schema(df.schema).parquet(aside).orderBy(ts).write.mode("overwrite")  # ranges are dealt out, so no task sorts all
        writer.option("header", True).csv(path) if kind == "csv" else writer.parquet(path)
    finally:
        fs, where = file_system(spark, aside)
        fs.delete(where, True)
    return Written(path, ends["n"], ends["first"], ends["last"])


def silver(df: DataFrame, root: str, category: str, ts: str, name: str = "", kind: str = "parquet") -> str:
    return silver_written(df, root, category, ts, name, kind).path


def json_lines(df: DataFrame, path: str, kind: str | None = None, kinds: tuple[str, ...] | None = None) -> str:
    """UTF-8 lines with nulls kept; a kind outside ``kinds`` raises."""
    if kinds is not None and kind not in kinds:
        raise ValueError(f"unknown document type {kind!r}")
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)
    return path


def graph_json_lines(df: DataFrame, root: str, day: str, order: list[str | Column]) -> str:
    """``aggregated_YYYYMMDD.jsonl`` in the given order, over its part files by name; no rows raise."""
    return json_lines(_some(df).orderBy(*order), f"{root}/aggregated_{day}.jsonl")


def by_group(df: DataFrame, path: str, group: str, kind: str = "parquet") -> str:
    """All groups in one write; groups without rows leave nothing."""
    df.write.mode("overwrite").partitionBy(group).option("header", True).format(kind).save(path)
    return path


PARTS = ["part_source", "year", "month"]


def with_parts(df: DataFrame, source: str, ts: str) -> DataFrame:
    return df.withColumns({"part_source": F.col(source), "year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM")})


def partitioned(df: DataFrame, path: str, source: str = "source", ts: str = "timestamp_utc") -> DataFrame:
    """Hive partitions by source, year and zero-padded month; a re-run replaces only what it writes.  Returns rows per partition.

    Rows are dealt out by partition and to the size that adaptive execution aims at, so the number of files goes by
    partitions and bytes, not by tasks.  The partitions written are noted while they are written (one entry each), and
    their rows are counted from the footers of their files.
    """
    spark, seen = df.sparkSession, Observation()
    keyed = with_parts(df, source, ts).observe(seen, F.collect_set(F.concat_ws("\n", *(F.coalesce(c, F.lit("")) for c in PARTS))).alias("parts"))
    keyed.hint("rebalance", *PARTS).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(path)
    touched = spark.createDataFrame([tuple(x or None for x in p.split("\n")) for p in sorted(seen.get["parts"])], ", ".join(f"{c} string" for c in PARTS))
    schema = T.StructType([*df.schema, *(T.StructField(c, T.StringType()) for c in PARTS)])
    there = spark.read.schema(schema).parquet(path).groupBy(*PARTS).agg(F.count("*").alias("n_rows"))
    counted = joined(there, touched, PARTS, "left_semi").collect()  # a row a partition, now: a later run may replace the files
    return spark.createDataFrame([tuple(r) for r in counted], there.schema)


def calendar_csv(df: DataFrame, path: str) -> str:
    """Twelve columns in fixed order, missing ones and NULLs as ''."""
    have = set(df.columns)
    df.select(*(F.coalesce(F.col(c).cast("string") if c in have else F.lit(None), F.lit("")).alias(c) for c in CALENDAR_COLUMNS)).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)
    return path
