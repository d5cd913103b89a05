"""Connected components by alternating stars, for graphs that grow with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def _large_star(edges: DataFrame) -> DataFrame:
    """Hang each node's larger neighbours on its smallest one (itself included)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = stored(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")))
    return both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Hang each node and its smaller neighbours on the smallest of those."""
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    low = stored(down.groupBy("a").agg(F.min("b").alias("m")))
    moved = down.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(low.select("a", F.col("m").alias("b")))


def components(edges: DataFrame) -> DataFrame:
    """Edges (a, b) -> (a, b) with b the smallest node that a reaches, for each node a that is not its own b.

    Joins and counts only; no group is gathered.  Each step is written to the
    shared folder, so a join's sides are plain exchanges and adaptive execution
    may split what a hub brings to one.  Rounds grow with the logarithm of the
    longest path.
    """
    now = stored(edges.select("a", "b").where("a <> b").distinct())
    mark = None
    while True:
        now = stored(_small_star(stored(_large_star(now))).distinct())
        row = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if mark == row:
            return now
        mark = row
