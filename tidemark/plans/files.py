"""Queries: landed files, sinks, streams.  Each writes rows of the given tables to the shared folder and reads them back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import times
from tidemark.functions.times import iso
from tidemark.operators import dedup, news, prices
from tidemark.plans import tables
from tidemark.plans.base import query
from tidemark.plans.common import scratch, stored, table
from tidemark.sources import datasource, files, plugins, sinks
from tidemark.streaming import documents as streams


@query("csv_roundtrip", """
SELECT pair, timeframe, count(*) AS n, sum(volume) AS volume, min(timestamp_utc) AS first_ts FROM (
  SELECT strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, 'EUR' || upper(substr(event_type, 1, 3)) AS pair, 'M1' AS timeframe, CAST(user_id AS DOUBLE) AS volume
  FROM events QUALIFY row_number() OVER (PARTITION BY date_trunc('minute', ts), event_type ORDER BY event_id) = 1) GROUP BY 1, 2""")
def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    rows = tables._epoch(spark, sf_dir)
    for pair in ("EURSIG", "EURERR", "EURCLI", "EURVIE", "EURPUR"):
        own = rows.where(F.col("pair") == pair).orderBy("event_id").drop("pair", "timeframe", "event_id")
        own.write.option("header", True).csv(f"{root}/mt5_{pair}_M1_20240130.csv")
    bars = prices.epoch_bars(files.routed(spark, {"mt5": root, "unknown": root}), files.POSITION)
    return bars.groupBy("pair", "timeframe").agg(F.count("*").alias("n"), F.sum("volume").alias("volume"), iso(F.min("timestamp_utc")).alias("first_ts"))


@query("jsonl_roundtrip", "SELECT doc_id, lang AS source, sha256(coalesce(text, '')) AS text_hash FROM documents")
def jsonl_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.coalesce("text", F.lit("")).alias("content"), F.col("doc_id").cast("string").alias("title"), F.lit("article").alias("document_type"))
    sinks.json_lines(d, f"{path}/a", "article", ("article", "speech"))
    spark.createDataFrame([("",), ("{broken",)], "value string").write.text(f"{path}/b.jsonl")
    back = files.json_lines(spark, path)
    return back.where("title is not null").select(F.col("title").cast("long").alias("doc_id"), "source", F.sha2("content", 256).alias("text_hash"))


@query("export_by_group", "SELECT lang, count(*) AS n FROM documents GROUP BY 1")
def export_by_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.by_group(table(spark, sf_dir, "documents").select("doc_id", "lang"), path, "lang")
    return spark.read.parquet(path).groupBy("lang").agg(F.count("*").alias("n"))


@query("silver_export", f"SELECT pair, count(*) AS n, sum(\"close\") AS total FROM (SELECT timestamp_utc, pair, round(\"close\") AS \"close\" FROM ({tables.SYNTHETIC})) GROUP BY 1")
def silver_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = tables.synthetic_bars(spark, sf_dir).withColumn("timestamp_utc", F.to_timestamp("timestamp_utc"))
    path = sinks.silver(bars, scratch(spark), "ohlcv", "timestamp_utc", "EUR_D1")
    return spark.read.parquet(path).groupBy("pair").agg(F.count("*").alias("n"), F.sum(F.round("close")).alias("total"))


@query("partition_counts", "SELECT 'ecb' || CAST(o_orderkey % 3 AS VARCHAR) AS part_source, strftime(o_orderdate, '%Y') AS \"year\", strftime(o_orderdate, '%m') AS \"month\", count(*) AS n_rows FROM orders GROUP BY 1, 2, 3")
def partition_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("ecb"), (F.col("o_orderkey") % 3).cast("string")).alias("source"), F.col("o_orderdate").cast("timestamp").alias("timestamp_utc"))
    path = scratch(spark)
    counts = sinks.partitioned(o, path)
    again = sinks.partitioned(o.where("source = 'ecb1'"), path)  # a re-run replaces what it writes and leaves the rest
    return counts.where("part_source <> 'ecb1'").unionByName(again)


@query("partition_scan", "SELECT event_id, value FROM events WHERE CAST(ts AS DATE) >= DATE '2024-01-05' AND CAST(ts AS DATE) < DATE '2024-01-08'")
def partition_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    table(spark, sf_dir, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")).write.partitionBy("day").parquet(path)
    return files.day_partitions(spark, path, "2024-01-05", "2024-01-08", ["event_id", "value"])


@query("feed_items", "SELECT page_id, url, strftime(TIMESTAMP '2024-01-01' + page_id * INTERVAL 1 HOUR, '%Y-%m-%dT%H:%M:%SZ') AS published FROM pages")
def feed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("page_id") * 3600), "EEE, dd MMM yyyy HH:mm:ss")
    rows = table(spark, sf_dir, "pages").select(F.col("page_id").cast("string").alias("title"), F.col("url").alias("link"), F.concat(stamp, F.lit(" GMT")).alias("pubDate"))
    rows.write.format("xml").option("rootTag", "channel").option("rowTag", "item").save(path)
    items = files.feed_items(spark, path)
    return items.select(F.col("title").cast("long").alias("page_id"), F.col("link").alias("url"), iso(times.feed_date(F.col("pubDate"))).alias("published"))


@query("sitemap_urls", "SELECT url FROM pages WHERE page_id % 3 = 0 OR DATE '2024-01-01' + CAST(page_id % 300 AS INTEGER) BETWEEN DATE '2024-02-01' AND DATE '2024-05-31'")
def sitemap_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") % 300).cast("int")), "yyyy-MM-dd")
    table(spark, sf_dir, "pages").select(F.col("url").alias("loc"), F.when(F.col("page_id") % 3 > 0, day).alias("lastmod")).write.format("xml").option("rootTag", "urlset").option("rowTag", "url").save(path)
    return files.sitemap(spark, path).where(dedup.between(times.iso_parse(F.col("lastmod")), "2024-02-01", "2024-05-31", missing=True)).select(F.col("loc").alias("url"))


def _landed(spark: SparkSession, sf_dir: str) -> tuple[str, str]:
    """Documents as landed files with a time and a URL that four of them share."""
    path, schema = scratch(spark), "doc_id long, source string, url string, title string, ts timestamp"
    d = table(spark, sf_dir, "documents")
    d.select("doc_id", F.col("lang").alias("source"), F.concat(F.lit("https://x/"), F.floor(F.col("doc_id") / 4).cast("string")).alias("url"), F.lit("t").alias("title"), F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") % 2000000).alias("ts")).write.parquet(path)
    return path, schema


@query("stream_new_documents", "SELECT count(DISTINCT doc_id // 4) AS n_new, count(DISTINCT doc_id // 4) AS n_urls FROM documents")
def stream_new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = _landed(spark, sf_dir)
    out = scratch(spark)
    streams.drained(streams.new_documents(streams.landed(spark, path, schema), "ts"), out, scratch(spark), "ts")
    return spark.read.parquet(out).agg(F.count("*").alias("n_new"), F.countDistinct("url").alias("n_urls"))


@query("stream_partition_sink", "SELECT lang AS part_source, strftime(TIMESTAMP '2024-01-01' + (doc_id % 2000000) * INTERVAL 1 SECOND, '%m') AS \"month\", count(*) AS n FROM documents GROUP BY 1, 2")
def stream_partition_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, schema = _landed(spark, sf_dir)
    out, mark = scratch(spark), scratch(spark)
    for _ in range(2):  # the second run finds nothing new
        streams.drained(streams.landed(spark, path, schema), out, mark, "ts")
    back = spark.read.schema(f"{schema}, part_source string, year string, month string, batch string").parquet(out)
    return back.groupBy("part_source", "month").agg(F.count("*").alias("n"))


@query("known_urls", "SELECT DISTINCT url FROM pages WHERE url <> ''")
def known_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    sinks.json_lines(table(spark, sf_dir, "pages").select("url"), path)
    return files.known_urls(spark, path)


@query("calendar_csv", "SELECT count(*) AS n, count(*) FILTER (o_orderkey % 4 = 3) AS n_blank_impact, 12 AS n_columns FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey")
def calendar_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    sinks.calendar_csv(tables._calendar(spark, sf_dir), f"{root}/forexfactory_calendar_20240101.csv")
    back = files.REGISTRY["calendar"](spark, root).drop(*files.POSITION)
    return back.agg(F.count("*").alias("n"), F.count_if(F.coalesce("impact", F.lit("")) == "").alias("n_blank_impact")).withColumn("n_columns", F.lit(len(back.columns)))


@query("bronze_files", "SELECT event_type AS code, count(*) AS n, sum(user_id)::BIGINT AS total FROM events GROUP BY 1")
def bronze_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    path = sinks.bronze_csv(table(spark, sf_dir, "events").select("event_id", "event_type", "user_id"), root, "mt5", "EVENTS", "20240130")
    return files.csv(spark, path).groupBy(F.col("event_type").alias("code")).agg(F.count("*").alias("n"), F.sum(F.col("user_id").cast("long")).alias("total"))


@query("exchange_rate_files", f"SELECT pair, count(*) AS n, sum(round(\"close\")) AS total FROM ({tables.SYNTHETIC}) WHERE timestamp_utc BETWEEN '2024-01-05' AND '2024-01-20T23:59:59Z' GROUP BY 1")
def exchange_rate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two landed files of daily rates, the last row of equal keys as the files hold them."""
    root = scratch(spark)
    rates = tables._rates(spark, sf_dir).orderBy("ts", "event_id").select(F.date_format("day", "yyyy-MM-dd").alias("TIME_PERIOD"), F.col("code").alias("CURRENCY"), F.col("rate").alias("OBS_VALUE"), "source")
    for name, part in (("a", "TIME_PERIOD < '2024-01-16'"), ("b", "TIME_PERIOD >= '2024-01-16'")):
        rates.where(part).write.option("header", True).csv(f"{root}/ecb_exchange_rates_{name}.csv")
    bars = plugins.SOURCES["ecb_exchange_rates"].preprocess(spark, root, "2024-01-05", "2024-01-20 23:59:59")
    return bars.groupBy("pair").agg(F.count("*").alias("n"), F.sum(F.round("close")).alias("total"))


@query("policy_rate_files", """
WITH m AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'ECB_DFR' WHEN '2-HIGH' THEN 'ECB_MRR' WHEN '3-MEDIUM' THEN 'ECB_MLF' END AS series_id, * FROM orders),
k AS (SELECT * FROM m WHERE series_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, o_orderdate ORDER BY o_orderkey DESC) = 1)
SELECT series_id, count(*) AS n, sum(round(o_totalprice)) AS total FROM k GROUP BY 1""")
def policy_rate_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    o = prices.mapped(table(spark, sf_dir, "orders"), "o_orderpriority", tables.RATE_CODES, "code").orderBy("o_orderkey")
    o.select(F.col("o_orderdate").cast("string").alias("TIME_PERIOD"), F.col("o_totalprice").cast("string").alias("OBS_VALUE"), F.col("code").alias("PROVIDER_FM_ID"), F.lit("D").alias("FREQ"), F.lit("ecb").alias("source")).write.option("header", True).csv(f"{root}/ecb_policy_rates_all.csv")
    rows = plugins.SOURCES["ecb_policy_rates"].preprocess(spark, root)
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), F.sum(F.round("value")).alias("total"))


@query("series_files", """
WITH k AS (SELECT user_id % 50 AS s, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS v FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id % 50 ORDER BY event_id) = 1)
SELECT 'S' || CAST(s AS VARCHAR) AS series_id, count(*) AS n, sum(v) AS total FROM k GROUP BY 1""")
def series_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    e = table(spark, sf_dir, "events").orderBy("event_id")
    e.select(F.to_date("ts").cast("string").alias("date"), F.get_json_object("props", "$.k").alias("value"), F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string")).alias("series_id"), F.lit("D").alias("frequency"), F.lit("N/A").alias("units"), F.lit("fred").alias("source")).write.option("header", True).csv(f"{root}/fred_all.csv")
    source = plugins.SOURCES["fred"]
    rows = source.preprocess(spark, root)
    source.validate(rows)
    return rows.groupBy("series_id").agg(F.count("*").alias("n"), F.sum("value").alias("total"))


#: Times are blank for every third order and take that of the order before them in their file.
FILLED = tables.CALENDAR.replace("raw AS (", "landed AS (", 1).replace("ev AS (", """raw AS (
  SELECT * REPLACE (last_value(CASE WHEN o_orderkey % 3 <> 1 THEN h END IGNORE NULLS) OVER (PARTITION BY o_orderkey % 2 ORDER BY o_orderkey) AS h) FROM landed),
ev AS (""", 1)


@query("calendar_source", f"WITH {FILLED} SELECT substr(timestamp_utc, 12, 2) AS \"hour\", country, impact, count(*) AS n FROM silver GROUP BY 1, 2, 3")
def calendar_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = scratch(spark)
    # each file's sort takes the rows twice
    raw = stored(tables._calendar(spark, sf_dir).withColumn("time", F.when(F.col("o_orderkey") % 3 == 1, "").otherwise(F.col("time"))))
    for k in (0, 1):
        raw.where(F.col("o_orderkey") % 2 == k).orderBy("o_orderkey").drop("o_orderkey").write.option("header", True).csv(f"{root}/forexfactory_{k}.csv")
    source = plugins.SOURCES["calendar"]
    rows = stored(source.preprocess(spark, root))  # checked, then counted
    source.validate(rows)
    return rows.groupBy(F.date_format("timestamp_utc", "HH").alias("hour"), "country", "impact").agg(F.count("*").alias("n"))


@query("quarantine", """
WITH l AS (SELECT event_id, CASE WHEN event_id % 10 = 3 THEN 'not 6 fields' WHEN event_id % 10 = 7 THEN 'not 6 fields' END AS fault FROM events)
SELECT 'fred' AS source, coalesce(fault, 'read') AS reason, count(*) AS n FROM l GROUP BY 2
UNION ALL SELECT 'documents', CASE doc_id % 5 WHEN 2 THEN 'no JSON of the schema' ELSE 'read' END, count(*) FROM documents GROUP BY 2
UNION ALL SELECT 'fred', 'missing columns', 1 UNION ALL SELECT 'mt5', 'no such folder', 1 UNION ALL SELECT 'ecb_policy_rates', 'no file of the source', 1""")
def quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What scans read and what they set aside: short and long lines, lines that are no JSON, a file of another header, folders that are not there."""
    root = scratch(spark)
    e = table(spark, sf_dir, "events")
    fields = [F.to_date("ts").cast("string"), F.col("event_id").cast("string"), F.lit("S"), F.lit("D"), F.lit("N/A"), F.lit("fred")]
    line = F.when(F.col("event_id") % 10 == 3, F.concat_ws(",", *fields[:4])).when(F.col("event_id") % 10 == 7, F.concat_ws(",", *fields, F.lit("x"))).otherwise(F.concat_ws(",", *fields))
    e.select(line.alias("date,value,series_id,frequency,units,source")).write.option("header", True).option("quote", "").option("escapeQuotes", False).option("sep", "\t").csv(f"{root}/series/fred_all.csv")
    spark.createDataFrame([("2024-01-01", "1")], "day string, value string").coalesce(1).write.option("header", True).csv(f"{root}/series/fred_other.csv")
    text = F.to_json(F.struct(F.col("lang").alias("source"), F.col("doc_id").cast("string").alias("title"), F.col("text").alias("content")))
    table(spark, sf_dir, "documents").select(F.when(F.col("doc_id") % 5 == 2, F.substring(text, 1, 9)).otherwise(text)).write.text(f"{root}/documents/all.jsonl")
    roots = {"fred": f"{root}/series", "documents": f"{root}/documents", "mt5": f"{root}/nowhere", "ecb_policy_rates": f"{root}/series"}
    aside = files.quarantine(spark, roots).groupBy("source", F.regexp_extract("reason", "^[^:,]+", 0).alias("reason")).agg(F.count("*").alias("n"))
    read = [files.REGISTRY[name](spark, roots[name]).agg(F.count("*").alias("n")).select(F.lit(name).alias("source"), F.lit("read").alias("reason"), "n") for name in ("fred", "documents")]
    return aside.unionByName(read[0]).unionByName(read[1])


DOCUMENT_SOURCE = """
WITH d AS (SELECT ['fed', 'ecb', 'boe'][doc_id % 3 + 1] AS source, substr(sha256('https://x/' || CAST(doc_id // 2 AS VARCHAR)), 1, 16) AS article_id, regexp_extract_all(lower(text), '[\\p{L}]+') AS words
           FROM documents WHERE trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) <> '' QUALIFY row_number() OVER (PARTITION BY doc_id // 2 ORDER BY doc_id) = 1),
c AS (SELECT *, len(list_filter(words, lambda x: x IN ('growth', 'gain', 'gains', 'strong', 'improve', 'improved', 'rise', 'rises', 'optimistic', 'recovery', 'boost', 'stable'))) AS good,
             len(list_filter(words, lambda x: x IN ('loss', 'losses', 'weak', 'decline', 'fall', 'falls', 'crisis', 'recession', 'worthless', 'risk', 'risks', 'fear', 'default'))) AS bad FROM d)
SELECT article_id, source, CASE source WHEN 'fed' THEN 'USD' WHEN 'ecb' THEN 'EUR' ELSE 'GBP' END AS currency, CASE WHEN good > bad THEN 'positive' WHEN bad > good THEN 'negative' ELSE 'neutral' END AS sentiment_label,
       CASE WHEN good > bad THEN round(good / (good + bad)::DOUBLE, 4) WHEN bad > good THEN -round(bad / (good + bad)::DOUBLE, 4) ELSE 0.0 END AS sentiment_score FROM c"""


def _collected(spark: SparkSession, sf_dir: str) -> tuple[str, tuple[str, ...]]:
    """Documents landed by three collectors in a folder each; pairs of them share a URL."""
    root, names = scratch(spark), ("fed", "ecb", "boe")
    d = table(spark, sf_dir, "documents").withColumn("_k", F.col("doc_id") % 3)
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    for k, name in enumerate(names):
        rows = d.where(F.col("_k") == k).select(F.lit(name).alias("source"), stamp.alias("timestamp_collected"), F.concat(F.lit("https://x/"), F.floor(F.col("doc_id") / 2).cast("string")).alias("url"), F.col("text").alias("title"), F.col("doc_id").cast("string").alias("content"))
        sinks.json_lines(rows, f"{root}/{name}/all.jsonl")
    return root, names


def _articles_of(landed: DataFrame) -> DataFrame:
    source = plugins.SOURCES["documents"]
    rows = source.clean(landed.withColumns({"_file": F.lit(""), "_block": F.lit(0), "_pos": F.col("content").cast("long")}))
    source.validate(rows)
    return rows.select("article_id", "source", "currency", "sentiment_label", "sentiment_score")


@query("document_source", DOCUMENT_SOURCE)
def document_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What three collectors landed, read through each one's source and cleaned as one table."""
    root, names = _collected(spark, sf_dir)
    return _articles_of(files.routed(spark, {f"{name}_documents": root for name in names}))


@query("document_data_source", DOCUMENT_SOURCE)
def document_data_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same through the library's own data source."""
    root, _ = _collected(spark, sf_dir)
    datasource.register(spark)
    return _articles_of(spark.read.format("tidemark").option("path", root).load())


@query("graph_jsonl", """
WITH g AS (SELECT 'https://n/' || CAST(p_partkey // 2 AS VARCHAR) AS url, CASE p_partkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 1 ELSE 3 END AS tier FROM part WHERE p_partkey % 4 < 2 QUALIFY row_number() OVER (PARTITION BY p_partkey // 2 ORDER BY p_partkey) = 1)
SELECT tier, count(*) AS n, 0 AS n_out_of_order FROM g GROUP BY 1""")
def graph_jsonl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents exported in order of priority; read back, no row of a part file stands before one of a lower tier."""
    from tidemark.plans.documents import _graph

    rows = news.graph_documents(_graph(spark, sf_dir).where(news.wanted_themes()), ["p_partkey"])
    path = sinks.graph_json_lines(rows, scratch(spark), "20240130", news.PRIORITY)
    back = files.positioned(spark.read.schema("url string, metadata struct<credibility_tier:int>").json(path)).withColumn("tier", F.col("metadata.credibility_tier"))
    ends = back.groupBy("_file").agg(F.min("tier").alias("low"), F.max("tier").alias("high"))  # a row per file
    w = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    wrong = ends.withColumn("before", F.max("high").over(w)).where("low < before").agg(F.count("*").cast("int"))
    return back.groupBy("tier").agg(F.count("*").alias("n")).withColumn("n_out_of_order", wrong.scalar())


@query("sorted_output", f"SELECT count(*) AS n_rows, 0 AS n_out_of_order FROM ({tables.EPOCH})")
def sorted_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A silver file of bars read back: rows that come later in their part file, or in a later one, are never earlier in time."""
    bars = prices.epoch_bars(tables._epoch(spark, sf_dir), ["event_id"])
    path = sinks.silver(bars, scratch(spark), "ohlcv", "timestamp_utc")
    back = spark.read.parquet(path).select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "timestamp_utc")
    inner = back.withColumn("before", F.lag("timestamp_utc").over(Window.partitionBy("file").orderBy("row")))
    each = inner.groupBy("file").agg(F.count("*").alias("n"), F.count_if(F.col("timestamp_utc") < F.col("before")).alias("wrong"), F.min("timestamp_utc").alias("low"), F.max("timestamp_utc").alias("high"))  # a row per file
    each = each.withColumn("upto", F.max("high").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)))
    return each.agg(F.sum("n").alias("n_rows"), (F.sum("wrong") + F.count_if(F.col("low") < F.col("upto"))).cast("int").alias("n_out_of_order"))
