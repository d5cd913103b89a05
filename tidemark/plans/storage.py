"""Queries: keyed storage, coverage, quality of tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import EVENTS, MACRO, OHLCV
from tidemark.functions import times
from tidemark.functions.numbers import ohlc_consistent
from tidemark.functions.times import iso
from tidemark.operators import bloom, dedup, merge, news, quality, store
from tidemark.plans import tables
from tidemark.plans.base import query
from tidemark.plans.common import scratch, table
from tidemark.sources import files, sinks


@query("new_urls", "SELECT url, min(page_id) AS page_id FROM pages WHERE page_id % 3 > 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) GROUP BY url")
def new_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("url", "page_id")
    return news.fresh(p.where("page_id % 3 > 0"), p.where("page_id % 3 = 0"), "url", ["page_id"])


@query("latest_n", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 100")
def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest 100 orders: a top-k report."""
    return dedup.latest(table(spark, sf_dir, "orders"), "o_orderdate", 100, "o_orderkey").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("pair_coverage", "SELECT event_type, count(*) AS n_rows, strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') AS first_ts, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS last_ts FROM events GROUP BY 1")
def pair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = store.coverage(table(spark, sf_dir, "events"), "event_type", "ts")
    return c.select("event_type", "n_rows", iso(F.col("first_ts").cast("timestamp")).alias("first_ts"), iso(F.col("last_ts").cast("timestamp")).alias("last_ts"))


@query("row_counts", "SELECT 'orders' AS table_name, count(*) AS n_rows FROM orders UNION ALL SELECT 'events', count(*) FROM events UNION ALL SELECT 'documents', count(*) FROM documents")
def row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.row_counts({n: table(spark, sf_dir, n) for n in ("orders", "events", "documents")})


@query("coverage_gaps", """
WITH seen AS (SELECT DISTINCT o_custkey, date_trunc('month', o_orderdate)::DATE AS m FROM orders), span AS (SELECT o_custkey, min(m) AS a, max(m) AS b FROM seen GROUP BY 1),
every AS (SELECT o_custkey, unnest(generate_series(a, b, INTERVAL 1 MONTH))::DATE AS m FROM span)
SELECT o_custkey, strftime(m, '%Y-%m') AS "month" FROM every e WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.o_custkey = e.o_custkey AND s.m = e.m)""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", F.to_date("o_orderdate").alias("day"))
    return store.missing_months(o, "o_custkey", "day").select("o_custkey", F.date_format("month", "yyyy-MM").alias("month"))


@query("coverage_requests", """
WITH s AS (SELECT o_custkey, min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS b FROM orders GROUP BY 1)
SELECT c_custkey AS series_id FROM customer LEFT JOIN s ON o_custkey = c_custkey WHERE a IS NULL OR a > DATE '1996-01-01' OR b < DATE '2000-01-01'""")
def coverage_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    have = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("series_id"), F.to_date("o_orderdate").alias("ts"))
    want = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("series_id"), F.lit("1996-01-01").cast("date").alias("start"), F.lit("2000-01-01").cast("date").alias("end"))
    return store.uncovered(have, want).select("series_id")


@query("column_and_row_difference", "SELECT o_orderstatus, o_orderpriority FROM orders EXCEPT ALL SELECT o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey % 5 > 0")
def column_and_row_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority", "o_orderkey")
    return dedup.missing_rows(o.drop("o_orderkey"), o.where("o_orderkey % 5 > 0").drop("o_orderkey"))


@query("distinct_values", "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders")
def distinct_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderpriority").distinct()


@query("table_filters", "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 365 DAY")
def table_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    newest = table(spark, sf_dir, "orders").agg(F.max("o_orderdate")).scalar()
    return o.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & (F.col("o_orderdate") >= newest - F.expr("interval 365 days"))).select("o_orderkey")


@query("calendar_range", "SELECT o_orderkey FROM orders WHERE o_orderkey % 9 > 0 AND o_orderdate BETWEEN TIMESTAMP '1997-01-01' AND TIMESTAMP '1997-12-31'")
def calendar_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.when(F.col("o_orderkey") % 9 == 0, "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return table(spark, sf_dir, "orders").where(F.try_to_date(day, "yyyy-MM-dd").between("1997-01-01", "1997-12-31")).select("o_orderkey")


@query("quality_ohlcv", f"""WITH b AS (SELECT * FROM ({tables.EPOCH}))
SELECT 'ohlc_consistent' AS rule, count(*) FILTER (open >= 40 AND pair <> 'EURERR') + 2 * count(*) FILTER (open >= 40 AND pair = 'EURERR') AS violations FROM b
UNION ALL SELECT 'null_close', count(*) FILTER (pair = 'EURCLI') FROM b UNION ALL SELECT 'unique_key', 2 * count(*) FILTER (pair = 'EURERR') FROM b""")
def quality_ohlcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = tables.epoch_bars_silver(spark, sf_dir).withColumn("high", F.when(F.col("open") >= 40, F.col("low") - 1).otherwise(F.col("high"))).withColumn("close", F.when(F.col("pair") != "EURCLI", F.col("close")))
    return quality.checked(b.unionByName(b.where("pair = 'EURERR'")), OHLCV, {"ohlc_consistent": ~ohlc_consistent()}).where("violations > 0")


@query("quality_macro", """
SELECT 'unique_key' AS rule, sum(n - 1)::BIGINT AS violations FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey, strftime(o_orderdate, '%Y-%m')) HAVING sum(n - 1) > 0
UNION ALL SELECT 'null_value', count(*) FROM orders WHERE o_orderkey % 17 = 0""")
def quality_macro(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    m = o.select(F.trunc("o_orderdate", "month").cast("timestamp").alias("timestamp_utc"), F.col("o_custkey").cast("string").alias("series_id"), F.when(F.col("o_orderkey") % 17 > 0, F.col("o_totalprice")).alias("value"), F.lit("fred").alias("source"), F.lit("M").alias("frequency"), F.lit("N/A").alias("units"))
    return quality.checked(m, MACRO, count_all=False, exact=True).where("violations > 0")


@query("quality_events", f"""WITH {tables.CALENDAR}
SELECT 'domain_impact' AS rule, count(*) FILTER (impact = 'low') AS violations FROM silver UNION ALL SELECT 'country_length', count(*) FILTER (country = 'DE') FROM silver""")
def quality_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = tables.events_silver(spark, sf_dir)
    e = e.withColumn("impact", F.when(F.col("impact") == "low", "lo").otherwise(F.col("impact"))).withColumn("country", F.when(F.col("country") == "DE", "GER").otherwise(F.col("country")))
    return quality.checked(e, EVENTS, {"country_length": F.length("country") != 2}).where("violations > 0")


@query("insert_ignore", """
WITH target AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS "month" FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS "month", min(o_orderkey) AS o_orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.o_custkey = o.o_custkey AND t."month" = strftime(o.o_orderdate, '%Y-%m')) GROUP BY 1, 2""")
def insert_ignore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders into a table that holds the urgent ones, one a customer and month."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_orderpriority")
    return store.new_rows(o.where("o_orderpriority = '1-URGENT'"), o, ["o_custkey", "month"], ["o_orderkey"]).drop("o_orderpriority")


@query("insert_ignore_filtered", """
WITH target AS (SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS "month" FROM orders WHERE o_orderpriority = '1-URGENT')
SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS "month", min(o_orderkey) AS o_orderkey FROM orders o
WHERE NOT EXISTS (SELECT 1 FROM target t WHERE t.o_custkey = o.o_custkey AND t."month" = strftime(o.o_orderdate, '%Y-%m')) GROUP BY 1, 2""")
def insert_ignore_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``insert_ignore``, with a Bloom filter of the stored keys that is merged from those of two halves."""
    o = table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_orderpriority")
    target, keys = o.where("o_orderpriority = '1-URGENT'"), ["o_custkey", "month"]
    n_blocks = bloom.blocks_for(target.count())
    half = F.col("o_orderkey") % 2 == 0
    known = bloom.merged(bloom.built(target.where(half), keys, n_blocks), bloom.built(target.where(~half), keys, n_blocks))
    return store.new_rows_filtered(target, o, keys, ["o_orderkey"], known, n_blocks).drop("o_orderpriority")


@query("monthly_upsert", """
WITH p AS (SELECT 1 AS pull, o_orderdate::DATE AS day, o_custkey % 7 AS series, o_totalprice AS v, o_orderkey FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01'
           UNION ALL SELECT 2, o_orderdate::DATE, o_custkey % 7, o_totalprice + 1, o_orderkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-07-01'),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY day, series ORDER BY pull DESC, o_orderkey DESC) = 1)
SELECT series, strftime(day, '%Y-%m') AS "month", count(*) AS n, sum(round(v)) AS total, sum(pull - 1)::BIGINT AS n_new FROM k GROUP BY 1, 2""")
def monthly_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two pulls that overlap by half a year, the second one twice under its number."""
    o = table(spark, sf_dir, "orders")
    pull = lambda k, part: o.where(part).select(F.col("o_orderdate").cast("date").alias("day"), (F.col("o_custkey") % 7).alias("series"), (F.col("o_totalprice") + (k - 1)).alias("v"), "o_orderkey", F.lit(k).cast("long").alias("pull"))
    path, keys = scratch(spark), ["day", "series"]
    for k, part in ((1, "o_orderdate < timestamp'1999-01-01'"), (2, "o_orderdate >= timestamp'1998-07-01'"), (2, "o_orderdate >= timestamp'1998-07-01'")):
        merge.upserted(spark, path, pull(k, part), keys, "day", k, ["o_orderkey"])
    rows = merge.stored(spark, path, "day date, series long, v double, o_orderkey long, pull long")
    return rows.groupBy("series", "month").agg(F.count("*").alias("n"), F.sum(F.round("v")).alias("total"), F.sum(F.col("pull") - 1).alias("n_new"))


@query("export_counts", """
WITH e AS (SELECT date_trunc('minute', ts) AS t, event_type FROM events)
SELECT count(*) AS n_rows, count(DISTINCT (t, event_type)) AS n_keys, count(*) - count(DISTINCT (t, event_type)) AS n_removed, count(DISTINCT (t, event_type)) AS n_written,
       strftime(min(t), '%Y-%m-%dT%H:%M:%SZ') AS first_ts, strftime(max(t), '%Y-%m-%dT%H:%M:%SZ') AS last_ts FROM e""")
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an export read, dropped and wrote, counted while it was written."""
    e = table(spark, sf_dir, "events").select(F.date_trunc("minute", F.col("ts").cast("timestamp")).alias("timestamp_utc"), "event_type", "event_id", "value")
    rows, counts = dedup.deduplicated_counted(e, ["timestamp_utc", "event_type"], ["event_id"])
    done = sinks.silver_written(rows, scratch(spark), "events", "timestamp_utc")
    found = counts.get()
    out = spark.createDataFrame([(found["n_rows"], found["n_keys"], found["n_removed"], done.n_rows, done.first, done.last)], "n_rows long, n_keys long, n_removed long, n_written long, first timestamp, last timestamp")
    return out.select("n_rows", "n_keys", "n_removed", "n_written", iso(F.col("first")).alias("first_ts"), iso(F.col("last")).alias("last_ts"))


@query("insert_ignore_count", """
SELECT (SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS n_before, (SELECT count(DISTINCT o_custkey) FROM orders WHERE o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')) AS n_inserted, 0 AS n_again""")
def insert_ignore_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, path = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderpriority"), scratch(spark)
    o.where("o_orderpriority = '1-URGENT'").write.parquet(path)
    before = spark.read.parquet(path).count()
    first = store.insert_ignore(spark, path, o, ["o_custkey"], ["o_orderkey"])
    again = store.insert_ignore(spark, path, o, ["o_custkey"], ["o_orderkey"])
    return spark.createDataFrame([(before, first, again)], "n_before long, n_inserted long, n_again long")


def _stored_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as rows of the exchange-rate table: some without a time, some pairs too long."""
    o = table(spark, sf_dir, "orders")
    pair = F.when(F.col("o_orderkey") % 20 == 0, F.repeat(F.lit("EURUSD"), 4)).otherwise(F.concat(F.lit("EUR"), F.col("o_custkey").cast("string")))
    return o.select(F.when(F.col("o_orderkey") % 30 > 0, F.col("o_orderdate").cast("timestamp")).alias("timestamp_utc"), pair.alias("currency_pair"), F.col("o_totalprice").alias("rate"), F.lit("D").alias("frequency"), F.lit("ecb").alias("source"), "o_orderkey")


@query("constraint_faults", """
SELECT 'null_timestamp_utc' AS fault, count(*) AS n FROM orders WHERE o_orderkey % 30 = 0 HAVING count(*) > 0 UNION ALL SELECT 'width_currency_pair', count(*) FROM orders WHERE o_orderkey % 20 = 0 HAVING count(*) > 0""")
def constraint_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.faults(_stored_rates(spark, sf_dir), "ecb_exchange_rates")
    return found.select(F.explode("faults").alias("fault")).groupBy("fault").agg(F.count("*").alias("n"))


RATES_TABLE = """
SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, 'EUR' || CAST(o_custkey AS VARCHAR) AS currency_pair, o_totalprice AS rate, 'D' AS frequency, 'ecb' AS source
FROM orders WHERE o_orderkey % 20 > 0 AND o_orderkey % 30 > 0 QUALIFY row_number() OVER (PARTITION BY o_orderdate, o_custkey ORDER BY o_totalprice) = 1"""


def _rates_table(spark: SparkSession, sf_dir: str) -> str:
    """The root of a store whose exchange-rate table got the sound rows of ``_stored_rates``."""
    root = scratch(spark)
    judged = store.faults(_stored_rates(spark, sf_dir), "ecb_exchange_rates")
    judged.drop("faults").limit(0).write.parquet(f"{root}/ecb_exchange_rates")
    store.insert(spark, root, "ecb_exchange_rates", judged.where(F.size("faults") == 0).drop("faults"))
    return root


@query("table_scan", RATES_TABLE)
def table_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = store.table(spark, _rates_table(spark, sf_dir), "ecb_exchange_rates")
    return found.withColumn("timestamp_utc", iso(F.col("timestamp_utc")))


@query("table_export", RATES_TABLE)
def table_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = store.export_csv(spark, _rates_table(spark, sf_dir), "ecb_exchange_rates", f"{scratch(spark)}/rates.csv")
    back = files.csv(spark, path)
    return back.select(iso(F.to_timestamp("timestamp_utc")).alias("timestamp_utc"), "currency_pair", F.col("rate").cast("double").alias("rate"), "frequency", "source")


@query("calendar_views", """
WITH r AS (SELECT c_custkey, DATE '2023-12-28' + CAST(c_custkey % 40 AS INTEGER) AS a, DATE '2023-12-28' + CAST(c_custkey % 40 + [0, 2, 5, 20, 70, 400][c_custkey % 6 + 1] AS INTEGER) AS b FROM customer),
v AS (SELECT *, CASE WHEN a = b THEN 'day' WHEN b - a < 7 AND date_trunc('week', a) = date_trunc('week', b) THEN 'week' ELSE 'month' END AS view FROM r)
SELECT c_custkey, view, strftime(a, '%Y-%m-%d') AS first_day, strftime(a, '%G-W%V') AS week FROM v WHERE view <> 'month' OR date_trunc('month', a) = date_trunc('month', b)
UNION ALL SELECT c_custkey, view, strftime(m, '%Y-%m-%d'), strftime(m, '%G-W%V') FROM (SELECT c_custkey, view, unnest(generate_series(date_trunc('month', a)::TIMESTAMP, date_trunc('month', b)::TIMESTAMP, INTERVAL 1 MONTH)) AS m FROM v WHERE view = 'month' AND date_trunc('month', a) <> date_trunc('month', b))""")
def calendar_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_add(F.lit("2023-12-28").cast("date"), (F.col("c_custkey") % 40).cast("int"))
    more = F.element_at(F.array(*(F.lit(n) for n in (0, 2, 5, 20, 70, 400))), (F.col("c_custkey") % 6 + 1).cast("int"))
    requests = table(spark, sf_dir, "customer").select("c_custkey", start.alias("start"), F.date_add(start, more).alias("end"))
    found = store.calendar_views(requests, "start", "end")
    return found.select("c_custkey", "view", F.date_format("first_day", "yyyy-MM-dd").alias("first_day"), times.week_key(F.col("first_day")).alias("week"))


@query("quality_macro_text", """
SELECT 'iso_timestamp_utc' AS rule, count(*) AS violations FROM orders WHERE o_orderkey % 13 = 0 HAVING count(*) > 0 UNION ALL SELECT 'blank_units', count(*) FROM orders WHERE o_orderkey % 7 = 0 HAVING count(*) > 0
UNION ALL SELECT 'unique_key', sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM orders GROUP BY CASE WHEN o_orderkey % 13 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') END, o_custkey) HAVING sum(n - 1) > 0""")
def quality_macro_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    stamp = F.when(F.col("o_orderkey") % 13 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(iso(F.col("o_orderdate").cast("timestamp")))
    m = o.select(stamp.alias("timestamp_utc"), F.col("o_custkey").cast("string").alias("series_id"), F.col("o_totalprice").alias("value"), F.lit("fred").alias("source"), F.lit("M").alias("frequency"), F.when(F.col("o_orderkey") % 7 == 0, " ").otherwise("N/A").alias("units"))
    return quality.checked(m, MACRO, count_all=False, exact=True).where("violations > 0")
