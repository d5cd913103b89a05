"""Upserts into a table of monthly partitions: a pull reads and rewrites only the months it touches.

One writer at a time holds the table: a lock file that only one can create.
Pulls have numbers; a number that the table's log has is not applied again, and
a pull that broke off before its number was logged can be, since its keys give
the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.dedup import deduplicated

MONTH = "month"


def file_system(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """The file system that holds ``path``, and the path as it knows it."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


@contextmanager
def locked(spark: SparkSession, path: str) -> Iterator[None]:
    """Hold ``path`` alone; RuntimeError if another writer does.  A writer that died leaves its lock, ``path/_lock``, to be deleted by hand."""
    fs, lock = file_system(spark, f"{path}/_lock")
    if not fs.createNewFile(lock):
        raise RuntimeError(f"{path} is being written by another run")
    try:
        yield
    finally:
        fs.delete(lock, False)


def applied(spark: SparkSession, path: str, number: int) -> bool:
    fs, mark = file_system(spark, f"{path}/_applied/{number}")
    return fs.exists(mark)


def stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table; an empty one where nothing has been stored.  ``schema`` is that of the pulls."""
    fs, where = file_system(spark, path)
    if not fs.exists(where) or not any(s.getPath().getName().startswith(f"{MONTH}=") for s in fs.listStatus(where)):
        return spark.createDataFrame([], f"{schema}, {MONTH} string")
    return spark.read.schema(f"{schema}, {MONTH} string").parquet(path)


def upserted(spark: SparkSession, path: str, pull: DataFrame, keys: list[str], ts: str, number: int, order: list[str | Column] | None = None) -> dict[str, int]:
    """Merge a pull into the table at ``path``; its rows replace stored ones of equal keys, of equal keys in the pull the last in ``order`` stays.

    The key must tell the month, so ``ts`` has to be one of ``keys``.  Rows with a null in the key are not stored.
    Returns how many rows the pull had, inserted and replaced, and how many months it touched; nothing is done, and all
    are zero, if the number was applied before.
    """
    if ts not in keys:
        raise ValueError(f"{ts} must be one of the keys")
    with locked(spark, path):
        if applied(spark, path, number):
            return dict.fromkeys(("rows", "inserted", "replaced", "months"), 0)
        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pull.schema)
        whole = F.lit(True)
        for k in keys:
            whole = whole & F.col(k).isNotNull()
        fresh = deduplicated(pull.where(whole), keys, order or pull.columns, keep="last").withColumn(MONTH, F.date_format(ts, "yyyy-MM"))
        touched = [r[0] for r in fresh.select(MONTH).distinct().collect()]  # a row a month
        # only the touched months are listed and read
        before = stored(spark, path, schema).where(F.col(MONTH).isin(*touched)) if touched else stored(spark, path, schema).limit(0)
        both = before.withColumn("_new", F.lit(0)).unionByName(fresh.withColumn("_new", F.lit(1)))
        rest = [c for c in fresh.columns if c not in keys]
        one = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), "_new").alias("_row"), F.max("_new").alias("_new"), F.count("*").alias("_n"))
        seen, ours = Observation(), F.col("_new") == 1
        counted = one.observe(seen, F.count_if(ours).alias("rows"), F.count_if(ours & (F.col("_n") == 1)).alias("inserted"), F.count_if(ours & (F.col("_n") > 1)).alias("replaced"))
        rows = counted.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in fresh.columns))
        if touched:
            rows.hint("rebalance", MONTH).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(MONTH).parquet(path)
        fs, mark = file_system(spark, f"{path}/_applied/{number}")
        fs.createNewFile(mark)
        return {**(seen.get if touched else dict.fromkeys(("rows", "inserted", "replaced"), 0)), "months": len(touched)}
