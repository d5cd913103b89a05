"""The data source of landed documents, and documents never seen over runs."""

from __future__ import annotations

import json
import os

from pyspark.sql import functions as F

from tidemark.sources import datasource, files
from tidemark.streaming import documents, seen


def land(path, rows, mode="w"):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as f:
        f.writelines(x if isinstance(x, str) else json.dumps(x) + "\n" for x in rows)


def document(k, **more):
    return {"source": "fed", "title": f"Title {k} é", "url": f"https://x/{k}", "timestamp_published": "2024-01-01T00:00:00Z", "metadata": {"author": None}} | more


ODD = ["\n", "{broken\n", "[1]\n", '{"title":"x","metadata":7}\n', '{"title":5,"content":{"a":1},"metadata":null}\n']


def test_batch_rows_are_those_of_the_file_scan(spark, tmp_path):
    datasource.register(spark)
    land(tmp_path / "fed" / "a.jsonl", [document(k) for k in range(300)] + ODD)
    land(tmp_path / "ecb" / "2024" / "b.jsonl", [document(k, source="ecb") for k in range(40)])
    land(tmp_path / "ecb" / "_hidden.jsonl", [document(0)])
    land(tmp_path / "ecb" / "note.txt", ["x\n"])
    columns = [c for c in files.json_lines(spark, f"{tmp_path}/fed").columns if c[0] != "_"]
    want = files.json_lines(spark, f"{tmp_path}/fed").select(*columns).unionByName(files.json_lines(spark, f"{tmp_path}/ecb").select(*columns))
    for split in (64 << 20, 1777):
        found = spark.read.format("tidemark").option("path", str(tmp_path)).option("split_bytes", split).load()
        assert found.count() == want.count() == 341 and sorted(map(str, found.select(*columns).collect())) == sorted(map(str, want.collect()))
    assert found.rdd.getNumPartitions() > 20 and found.select("_file", "_pos").distinct().count() == 341
    one = spark.read.format("tidemark").options(path=str(tmp_path), names="ecb").load()
    assert {r.collector for r in one.collect()} == {"ecb"} and one.count() == 40
    assert spark.read.format("tidemark").options(path=str(tmp_path), names="boe").load().count() == 0


def test_a_stream_takes_each_file_once(spark, tmp_path):
    datasource.register(spark)
    land(tmp_path / "in" / "fed" / "a.jsonl", [document(k) for k in range(10)])

    def run():
        stream = spark.readStream.format("tidemark").option("path", f"{tmp_path}/in").load()
        q = stream.select("url", "_file").writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/mark").format("parquet").start(f"{tmp_path}/out")
        q.awaitTermination()
        return spark.read.schema("url string, _file string").parquet(f"{tmp_path}/out").count()

    assert run() == 10
    land(tmp_path / "in" / "boe" / "b.jsonl", [document(k) for k in range(5)])
    os.utime(tmp_path / "in" / "boe" / "b.jsonl", (4_000_000_000, 4_000_000_000))
    assert run() == 15 and run() == 15


def test_documents_of_earlier_runs_are_not_new(spark, tmp_path):
    schema = "url string, source string, title string, ts timestamp, n long"
    rows = spark.range(30).select(F.concat(F.lit("u"), F.col("id") % 12).alias("url"), F.lit("fed").alias("source"), F.lit("t").alias("title"), F.timestamp_seconds(F.lit(1704067200) + F.col("id")).alias("ts"), F.col("id").alias("n"))
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    # ids 0 to 3 were stored by a run whose checkpoint is gone
    seen.with_ids(rows.where("n < 4"), "ts").select("article_id").write.parquet(f"{tmp_path}/stored")

    def run(mark):
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        fresh = seen.never_seen(stream, spark.read.parquet(f"{tmp_path}/stored"), "ts", ["ts", "n"])
        fresh.writeStream.outputMode("append").trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/{mark}").format("parquet").start(f"{tmp_path}/out-{mark}").awaitTermination()
        return sorted((r.url, r.n) for r in spark.read.schema(schema).parquet(f"{tmp_path}/out-{mark}").collect())

    want = sorted((f"u{k}", k) for k in range(4, 12))
    assert run("a") == want
    more = spark.createDataFrame([("u0", "fed", "t", 90), ("u5", "fed", "t", 91), ("u77", "fed", "t", 92), ("u77", "fed", "t", 93)], "url string, source string, title string, n long")
    more.select("url", "source", "title", F.timestamp_seconds(F.lit(1704070000) + F.col("n")).alias("ts"), "n").write.mode("append").parquet(f"{tmp_path}/in")
    assert run("a") == sorted([*want, ("u77", 92)])
    # with a watermark alone what a lost checkpoint had seen comes again
    again = documents.new_documents(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"), "ts")
    again.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{tmp_path}/w").format("parquet").start(f"{tmp_path}/out-w").awaitTermination()
    assert spark.read.schema(schema).parquet(f"{tmp_path}/out-w").count() == 13
