"""Running values over a total order, computed by segments so that no task sorts a whole group.

A segment is a piece of the order that one task holds: a split of a file, or a
range of sort keys dealt out by a range exchange.  Each segment is summed up in
one row per group, a running value is carried over these few rows, and every
row then needs only its own segment and what was carried into it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of ``monotonically_increasing_id`` that count rows within a task.
ROW_BITS = 33

Store = Callable[[DataFrame], DataFrame]


def joined(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join on ``keys``, null with null; the side's keys are dropped."""
    renamed = side.withColumnsRenamed({k: f"_side_{k}" for k in keys})
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).eqNullSafe(F.col(f"_side_{k}"))
    return rows.join(renamed, test, how).drop(*(() if how in ("left_semi", "left_anti") else (f"_side_{k}" for k in keys)))


def ranked(df: DataFrame, group: list[str], order: list[Column], store: Store, nth: str = "nth", total: str | None = None) -> DataFrame:
    """``df`` with the place of each row in its group's order, from 0, and the size of the group as ``total`` if named.

    One range exchange on group and order; a group of any size is dealt over many tasks.  Rows equal in group and order
    stay in one task, so the order should tell rows apart as far as they differ.  ``store`` writes the dealt rows to
    the shared folder and reads them back: places must not be dealt out twice.
    """
    keys = [*(F.asc_nulls_first(g) for g in group), *order]
    dealt = df.repartitionByRange(*keys).sortWithinPartitions(*keys) if keys else df
    rows = store(dealt.withColumn("_at", F.monotonically_increasing_id()))
    segment = F.shiftright("_at", ROW_BITS)
    each = rows.groupBy(*group, segment.alias("_segment")).agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*group).orderBy("_segment")) - F.col("_n")
    carried = each.withColumn("_shift", before - F.col("_first"))
    if total:
        carried = carried.withColumn(total, F.sum("_n").over(Window.partitionBy(*group)))
    found = joined(rows.withColumn("_segment", segment), carried.drop("_first", "_n"), [*group, "_segment"])
    return found.withColumn(nth, F.col("_at") + F.col("_shift")).drop("_at", "_segment", "_shift")


def forward_filled(df: DataFrame, column: str, group: list[str], segment: list[str], order: list[str | Column]) -> DataFrame:
    """Blank or NULL values take the last value before them within the group.

    ``segment`` are the columns that come first in the group's order (a split's start in its file); ``order`` sorts the
    rows within one segment.  Each segment's last value is carried over the segments after it (one row each), and rows
    before a segment's first value take what was carried in.
    """
    value = F.when(F.col(column).cast("string") != "", F.col(column))
    place = F.struct(*((F.col(o) if isinstance(o, str) else o).alias(f"_o{k}") for k, o in enumerate(order)))
    ends = df.groupBy(*group, *segment).agg(F.max_by(value, F.when(value.isNotNull(), place)).alias("_last"))
    over = Window.partitionBy(*group).orderBy(*segment).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_carried", F.last("_last", ignorenulls=True).over(over)).drop("_last")
    inside = Window.partitionBy(*group, *segment).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    own = df.withColumn("_own", F.last(value, ignorenulls=True).over(inside))
    filled = joined(own, carried, [*group, *segment], "left")
    return filled.withColumn(column, F.coalesce("_own", "_carried")).select(*df.columns)
