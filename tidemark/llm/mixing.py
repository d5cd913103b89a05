"""Mixing sources to target weights by hash-threshold histograms; DataFrame functions only.

Each source has a target in words.  Whole copies come first (target divided by
the source's size, rounded down); the rest is a budget within the source.
Documents have a 60-bit hash; words are summed by source and hash bucket, the
bucket where the running sum passes the budget is found, and only that bucket
is summed again by the hash's next bits, three times.  Documents below the
threshold get one more copy: a filter, no sort of documents.  What then lacks
is less than the boundary holds; of all groups of equal hash not taken yet, the
one whose size comes nearest to the gap is added if that brings the source
closer to its target.

Defined results: null text has size 0; the null source is a source, last in
order; a null id takes part; rows with the same id and size share a hash and
are taken together; sources of size 0 have target 0; extra columns pass through
``mixed`` and are ignored by ``plan``; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table

WEIGHTS = (3, 1, 2)
#: Bits of the hash, and of one histogram level; three levels are resolved.
HASH_BITS, LEVEL_BITS, LEVELS = 60, 12, 3
#: One row per source is broadcast up to so many sources; beyond that sources are joined by a shuffle.
BROADCAST_SOURCES = 200_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_of(doc_id: Column, size: Column) -> Column:
    key = F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), size.cast("string"))
    return F.conv(F.substring(F.md5(key), 1, 15), 16, 10).cast("long")


def with_sources(rows: DataFrame, sources: DataFrame, few: bool, how: str = "inner") -> DataFrame:
    """Join on ``source``, null with null; ``sources`` has a row per source and columns of other names, and is broadcast if these are ``few``."""
    side = sources.withColumnRenamed("source", "_source")
    side = F.broadcast(side) if few else side
    return rows.join(side, F.col("source").eqNullSafe(F.col("_source")), how).drop("_source")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, target: ``share`` of all words by weight, none above ``most`` times its source.

    A source is full if its cap is at most its share of what sources with a
    smaller cap per weight leave over; so one pass in that order settles all.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1
    weight = F.array([F.lit(w) for w in weights])[F.col("k") % len(weights)]
    per = per.withColumn("k", order).withColumn("weight", weight.cast("long")).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    every = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), "k").rowsBetween(Window.unboundedPreceding, -1)
    budget = F.lit(float(share)) * F.sum("source_size").over(every)
    left = budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    weights_left = F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    per = per.withColumn("rate", left / weights_left)
    target = F.least(F.col("cap"), F.col("weight") * F.max("rate").over(every))
    return per.select("source", "source_size", target.alias("target"))


def thresholds(sized: DataFrame, goals: DataFrame, few: bool) -> DataFrame:
    """Per source: copies (of each document), below (hashes under it get one more) and extra (a single hash more)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    state = goals.withColumn("copies", whole).withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    state = state.withColumns({"prefix": F.lit(0).cast("long"), "under": F.lit(0).cast("long"), "open": F.col("rest") > 0})
    for level in range(1, LEVELS + 1):
        shift = HASH_BITS - level * LEVEL_BITS
        inside = with_sources(sized, state.where("open").select("source", "prefix"), few)
        inside = inside.where(F.shiftright("hash", shift + LEVEL_BITS) == F.col("prefix"))
        counts = inside.groupBy("source", F.shiftright("hash", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket"))
        counts = with_sources(counts.withColumn("upto", upto), state.where("open").select("source", "rest", "under"), few)
        passed = counts.where(F.col("under") + F.col("upto") > F.col("rest"))
        edge = passed.groupBy("source").agg(F.min(F.struct("bucket", (F.col("under") + F.col("upto") - F.col("words")).alias("sum"))).alias("edge"))
        state = with_sources(state, edge, few, "left")
        state = state.withColumns({"open": F.col("edge").isNotNull(), "prefix": F.coalesce(F.col("edge.bucket"), F.col("prefix")), "under": F.coalesce(F.col("edge.sum"), F.col("under"))}).drop("edge")
        state = stored(state)
    below = F.when(F.col("open"), F.shiftleft("prefix", HASH_BITS - LEVELS * LEVEL_BITS)).otherwise(F.when(F.col("rest") > 0, F.lit(1 << HASH_BITS)).otherwise(0))
    state = state.withColumn("below", below.cast("long")).withColumn("gap", F.col("rest") - F.col("under"))
    above = with_sources(sized, state.where("open and gap > 0").select("source", "below", "gap"), few).where("hash >= below and size > 0")
    groups = above.groupBy("source", "hash").agg(F.sum("size").alias("words"), F.first("gap").alias("gap"))
    miss = F.abs(F.col("words") - F.col("gap"))
    best = groups.where(miss < F.col("gap")).groupBy("source").agg(F.min(F.struct(miss.alias("miss"), "hash")).alias("best"))
    return stored(with_sources(state, best.select("source", F.col("best.hash").alias("extra")), few, "left").select("source", "source_size", "target", "copies", "below", "extra"))


def planned(docs: DataFrame) -> DataFrame:
    """``docs`` with size, source_size, target and n_copies (how often the mix takes the row)."""
    sized = stored(docs.select(F.col("source").cast("string"), size_of(F.col("text")).alias("size"), F.col("doc_id")).select("source", "size", hash_of(F.col("doc_id"), F.col("size")).alias("hash")))
    goals = stored(targets(sized))
    few = goals.count() <= BROADCAST_SOURCES
    marks = thresholds(sized, goals, few)
    names = {c: f"_mix_{c}" for c in ("source_size", "target", "copies", "below", "extra")}
    rows = docs.withColumn("_mix_size", size_of(F.col("text")))
    rows = with_sources(rows.withColumn("_mix_hash", hash_of(F.col("doc_id"), F.col("_mix_size"))), marks.withColumnsRenamed(names), few)
    more = (F.col("_mix_hash") < F.col("_mix_below")) | F.coalesce(F.col("_mix_hash") == F.col("_mix_extra"), F.lit(False))
    return rows.withColumn("_mix_n", F.col("_mix_copies") + more.cast("long"))


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each row as often as it is taken, columns as before."""
    rows = planned(docs).withColumn("_mix_n", F.explode(F.array_repeat(F.lit(True), F.col("_mix_n").cast("int"))))
    return rows.select(docs.columns)


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = planned(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.col("_mix_size").alias("size"), F.col("_mix_source_size").alias("source_size"), F.col("_mix_target").alias("target"), (F.col("_mix_n") * F.col("_mix_size")).alias("taken"))


OP3_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, size, ('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || '|' || CAST(size AS VARCHAR)), 1, 15))::BIGINT AS hash
  FROM (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents)),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS k FROM per),
weighed AS (SELECT *, CASE k % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END::BIGINT AS weight, source_size * 2.0::DOUBLE AS cap FROM ranked),
rated AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER w, 0.0::DOUBLE))
          / ((sum(weight) OVER ()) - coalesce(sum(weight) OVER w, 0))::DOUBLE AS rate
  FROM weighed WINDOW w AS (ORDER BY cap / weight::DOUBLE, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
goals AS (SELECT source, source_size, least(cap, weight::DOUBLE * max(rate) OVER ()) AS target FROM rated),
state AS (
  SELECT *, target - copies::DOUBLE * source_size::DOUBLE AS rest
  FROM (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size::DOUBLE)::BIGINT ELSE 0 END AS copies FROM goals)),
buckets AS (SELECT source, hash >> 24 AS bucket, sum(size) AS words FROM sized GROUP BY 1, 2),
run AS (SELECT *, sum(words) OVER (PARTITION BY source ORDER BY bucket) AS upto FROM buckets),
edge AS (
  SELECT s.source, min(bucket) AS bucket, min(upto - words) AS under
  FROM run r JOIN state s ON r.source IS NOT DISTINCT FROM s.source WHERE rest > 0 AND upto > rest GROUP BY s.source),
marks AS (
  SELECT s.*, CASE WHEN e.bucket IS NOT NULL THEN e.bucket << 24 WHEN rest > 0 THEN 1152921504606846976 ELSE 0 END AS below,
         CASE WHEN e.bucket IS NOT NULL THEN rest - e.under::DOUBLE END AS gap
  FROM state s LEFT JOIN edge e ON s.source IS NOT DISTINCT FROM e.source),
missed AS (
  SELECT m.source, hash, abs(sum(size)::DOUBLE - any_value(gap)) AS miss, any_value(gap) AS gap
  FROM sized d JOIN marks m ON d.source IS NOT DISTINCT FROM m.source WHERE gap > 0 AND hash >= below AND size > 0 GROUP BY m.source, hash),
best AS (SELECT source, arg_min(hash, (miss, hash)) AS extra FROM missed WHERE miss < gap GROUP BY source)
SELECT d.doc_id, d.size, m.source_size, m.target,
       ((m.copies + CASE WHEN d.hash < m.below OR coalesce(d.hash = b.extra, false) THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM sized d JOIN marks m ON d.source IS NOT DISTINCT FROM m.source LEFT JOIN best b ON d.source IS NOT DISTINCT FROM b.source
"""
