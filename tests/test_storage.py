"""Key filters, upserts under a lock, exports counted while they are written."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from tidemark.operators import bloom, dedup, merge, store
from tidemark.sources import sinks


def keys_of(spark, low, high):
    return spark.range(low, high).select(F.col("id").alias("k"), F.concat(F.lit("s"), F.col("id") % 7).alias("s"))


def test_a_filter_knows_its_keys_and_few_others(spark):
    n = bloom.blocks_for(30_000)
    one, other = bloom.built(keys_of(spark, 0, 15_000), ["k", "s"], n), bloom.built(keys_of(spark, 15_000, 30_000), ["k", "s"], n)
    both = bloom.merged(one, other)
    assert bloom.tested(keys_of(spark, 0, 30_000), both, ["k", "s"], n).where("not maybe").isEmpty()
    assert both.exceptAll(bloom.built(keys_of(spark, 0, 30_000), ["k", "s"], n)).isEmpty()
    wrong = bloom.tested(keys_of(spark, 30_000, 130_000), both, ["k", "s"], n).where("maybe").count() / 100_000
    assert wrong < 0.02
    assert bloom.tested(keys_of(spark, 0, 5), spark.createDataFrame([], "block long, bitmap binary"), ["k", "s"], 1).where("maybe").isEmpty()
    with pytest.raises(ValueError, match="too large"):
        bloom.tested(keys_of(spark, 0, 5), both, ["k", "s"], bloom.MOST_BLOCKS + 1)


def test_filtered_rows_are_the_unfiltered_ones(spark):
    target = keys_of(spark, 0, 3_000).withColumn("v", F.lit(0))
    batch = keys_of(spark, 2_000, 6_000).withColumn("v", F.lit(1)).unionByName(keys_of(spark, 5_000, 6_500).withColumn("v", F.lit(2)))
    batch = batch.unionByName(spark.createDataFrame([(None, "x", 3), (None, "x", 3)], "k long, s string, v int"))
    known = bloom.built(target, ["k", "s"], 1)
    found = store.new_rows_filtered(target, batch, ["k", "s"], ["v"], known, 1)
    want = store.new_rows(target, batch, ["k", "s"], ["v"])
    assert found.count() == want.count() == 3_502 and found.exceptAll(want).isEmpty()
    # surely new rows meet neither side of the look-up: the stored keys are probed with what the filter lets pass
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    semi = plan[plan.index("LeftSemi") :]
    assert "_maybe" in plan or "getbit" in semi


def test_inserts_keep_their_filter(spark, tmp_path):
    path = f"{tmp_path}/t"
    keys_of(spark, 0, 100).write.parquet(path)
    assert store.insert_ignore(spark, path, keys_of(spark, 50, 250), ["k"], ["s"], filtered=True) == 150
    assert store.insert_ignore(spark, path, keys_of(spark, 50, 260), ["k"], ["s"], filtered=True) == 10
    (name,) = os.listdir(f"{path}/_keys")
    version, n_blocks, n_keys = map(int, name.split("-"))
    assert (version, n_keys) == (3, 260) and spark.read.parquet(path).count() == 260
    assert store.insert_ignore(spark, path, keys_of(spark, 0, 9_000), ["k"], ["s"], filtered=True) == 8_740  # beyond the filter's room: made anew
    assert int(os.listdir(f"{path}/_keys")[0].split("-")[1]) > n_blocks
    assert store.insert_ignore(spark, path, keys_of(spark, 0, 9_000), ["k"], ["s"], filtered=True) == 0 == store.insert_ignore(spark, path, keys_of(spark, 0, 9_000), ["k"], ["s"])


def test_one_writer_at_a_time(spark, tmp_path):
    path = f"{tmp_path}/t"
    keys_of(spark, 0, 5).write.parquet(path)
    with merge.locked(spark, path):
        with pytest.raises(RuntimeError, match="another run"):
            store.insert_ignore(spark, path, keys_of(spark, 0, 9), ["k"], ["s"])
        with pytest.raises(RuntimeError, match="another run"), merge.locked(spark, path):
            pass
    assert store.insert_ignore(spark, path, keys_of(spark, 0, 9), ["k"], ["s"]) == 4 and not os.path.exists(f"{path}/_lock")


SERIES = "ts timestamp, id string, value double"


def series(spark, days, value):
    return spark.createDataFrame([(datetime.datetime(2024, 1, 1) + datetime.timedelta(days=d), "S", float(value)) for d in days], SERIES)


def files_of(path):
    return {m: sorted(x for x in os.listdir(f"{path}/{m}") if x.endswith(".parquet")) for m in os.listdir(path) if m.startswith("month=")}


def test_an_upsert_rewrites_the_months_it_touches(spark, tmp_path):
    path, keys = f"{tmp_path}/series", ["ts", "id"]
    assert merge.stored(spark, path, SERIES).count() == 0
    assert merge.upserted(spark, path, series(spark, range(100), 1), keys, "ts", 1) == {"rows": 100, "inserted": 100, "replaced": 0, "months": 4}
    before = files_of(path)
    pull = series(spark, [*range(80, 130)], 2).unionByName(spark.createDataFrame([(None, "S", 9.0)], SERIES))
    assert merge.upserted(spark, path, pull, keys, "ts", 2) == {"rows": 50, "inserted": 30, "replaced": 20, "months": 3}
    after = files_of(path)
    assert {m for m in after if after[m] == before.get(m)} == {"month=2024-01", "month=2024-02"}
    assert merge.upserted(spark, path, pull, keys, "ts", 2) == {"rows": 0, "inserted": 0, "replaced": 0, "months": 0} and files_of(path) == after
    os.remove(f"{path}/_applied/2")  # as if the run had broken off before its number was noted
    assert merge.upserted(spark, path, pull, keys, "ts", 2)["inserted"] == 0
    rows = merge.stored(spark, path, SERIES)
    assert rows.count() == 130 and rows.agg(F.sum("value")).first()[0] == 80 + 100
    assert merge.upserted(spark, path, pull.limit(0), keys, "ts", 3)["months"] == 0 and files_of(path).keys() == after.keys()
    with pytest.raises(ValueError, match="one of the keys"):
        merge.upserted(spark, path, pull, ["id"], "ts", 4)


def test_files_go_by_partitions_and_not_by_tasks(spark, tmp_path):
    rows = spark.range(0, 40_000, 1, 40).select(F.concat(F.lit("s"), F.col("id") % 3).alias("source"), F.timestamp_seconds(F.lit(1704067200) + F.col("id") * 600).alias("timestamp_utc"), F.col("id").alias("v"))
    counts = sinks.partitioned(rows, f"{tmp_path}/t")
    written = [f for _, _, names in os.walk(f"{tmp_path}/t") for f in names if f.endswith(".parquet")]
    n_parts = counts.count()
    assert n_parts == 3 * 10 and len(written) == n_parts and counts.agg(F.sum("n_rows")).first()[0] == 40_000
    again = sinks.partitioned(rows.where("source = 's1'").limit(5), f"{tmp_path}/t")
    assert [(r.part_source, r.n_rows) for r in again.collect()] == [("s1", 5)] and spark.read.parquet(f"{tmp_path}/t").where("source <> 's1'").count() == 26_667


def test_an_export_computes_its_input_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.range(1_000).select(F.timestamp_seconds(F.lit(1704067200) + F.pmod(F.col("id") * 7, F.lit(1_000)) * 3600).alias("ts"), F.col("id")).mapInArrow(passed, "ts timestamp, id long")
    done = sinks.silver_written(df, str(tmp_path), "x", "ts", "y")
    assert seen.value == 1_000 and done.n_rows == 1_000 and done.path.endswith("x_y_20240101_20240211.parquet") and os.listdir(tmp_path) == ["x_y_20240101_20240211.parquet"]
    with pytest.raises(ValueError, match="nothing"):
        sinks.silver(df.limit(0), str(tmp_path), "x", "ts")
    assert len(os.listdir(tmp_path)) == 1
    rows, counts = dedup.deduplicated_counted(df.withColumn("k", F.col("id") % 10), ["k"], ["id"])
    rows.write.parquet(f"{tmp_path}/d")
    assert counts.get() == {"n_rows": 1_000, "n_keys": 10, "n_removed": 990}
