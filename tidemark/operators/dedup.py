"""Order-dependent operators with the order made explicit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F


def deduplicated(df: DataFrame, keys: list[str], order: list[str | Column], keep: str = "first") -> DataFrame:
    """One row per key: the first or last in ``order``.

    A grouped min or max of a struct keeps map-side combining, so a key that
    holds a large share of the rows costs one row per task; a window would
    sort all of them in one.
    """
    order_cols = [F.col(o) if isinstance(o, str) else o for o in order]
    rank = F.struct(*(c.alias(f"_o{n}") for n, c in enumerate(order_cols)))
    pick = F.min_by if keep == "first" else F.max_by
    rest = [c for c in df.columns if c not in keys]
    chosen = df.groupBy(*keys).agg(pick(F.struct(*rest), rank).alias("_row"))
    return chosen.select(*(F.col(c) if c in keys else F.col("_row")[c].alias(c) for c in df.columns))


class Counts:
    """Rows that went into and came out of a deduplication, known once the result has been written or otherwise used whole."""

    def __init__(self) -> None:
        self.before, self.after = Observation(), Observation()

    def get(self) -> dict[str, int]:
        n_rows, n_keys = self.before.get["n"], self.after.get["n"]
        return {"n_rows": n_rows, "n_keys": n_keys, "n_removed": n_rows - n_keys}


def deduplicated_counted(df: DataFrame, keys: list[str], order: list[str | Column], keep: str = "first") -> tuple[DataFrame, Counts]:
    """As ``deduplicated``, with counts taken in the same pass."""
    counts, n = Counts(), F.count(F.lit(1)).alias("n")
    return deduplicated(df.observe(counts.before, n), keys, order, keep).observe(counts.after, n), counts


def forward_filled(df: DataFrame, column: str, group: list[str], order: list[str]) -> DataFrame:
    """Blank or NULL values take the last value before them within the group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    value = F.when(F.col(column).cast("string") != "", F.col(column))
    return df.withColumn(column, F.last(value, ignorenulls=True).over(w))


def duplicate_counts(df: DataFrame, keys: list[str]) -> DataFrame:
    """n_rows, n_keys and n_removed, in two grouped steps without gathering keys in one task."""
    per = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.count("*").alias("n_keys")).withColumn("n_removed", F.col("n_rows") - F.col("n_keys"))


def first_per(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    return deduplicated(df, [key], order)


def latest(df: DataFrame, order: str, n: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(order), F.asc(tie)).limit(n)


def between(column: Column, start: str | None = None, end: str | None = None, missing: bool = False) -> Column:
    """Inclusive range; either side may be open; ``missing`` lets NULL pass."""
    test = F.lit(True)
    if start is not None:
        test = test & (column >= F.lit(start).cast("timestamp"))
    if end is not None:
        test = test & (column <= F.lit(end).cast("timestamp"))
    return (column.isNull() | test) if missing else (column.isNotNull() & test if start is not None or end is not None else test)


def present(*columns: str) -> Column:
    """All columns are neither NULL nor ''."""
    test = F.lit(True)
    for c in columns:
        test = test & F.coalesce(F.col(c).cast("string") != "", F.lit(False))
    return test


def missing_rows(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.exceptAll(actual)


def missing_columns(df: DataFrame, expected: list[str]) -> tuple[list[str], list[str]]:
    """(missing, extra) column names."""
    return sorted(set(expected) - set(df.columns)), sorted(set(df.columns) - set(expected))
