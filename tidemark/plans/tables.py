"""Queries: prices, macro series, calendar events, deduplication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.numbers import surprise, surprise_percent
from tidemark.functions.times import iso
from tidemark.operators import calendar, dedup, macro, prices
from tidemark.plans.base import query
from tidemark.plans.common import table
from tidemark.session import spread

BAR = ["pair", "timeframe", "open", "high", "low", "close", "volume", "source"]
CODES = {"signup": "USD", "error": "GBP", "click": "JPY", "view": "CHF"}
RATE_CODES = {"1-URGENT": "DFR", "2-HIGH": "MRR_FR", "3-MEDIUM": "MRR_MBR"}


def _rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return prices.mapped(e, "event_type", CODES, "code").select("code", F.to_date("ts").alias("day"), F.col("value").cast("string").alias("rate"), F.lit("ecb").alias("source"), "ts", "event_id")


def _epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    pair = F.concat(F.lit("EUR"), F.upper(F.substring("event_type", 1, 3)))
    return e.select(F.unix_seconds(F.date_trunc("minute", F.col("ts").cast("timestamp"))).alias("time"), pair.alias("pair"), F.lit("M1").alias("timeframe"), F.col("value").alias("open"), (F.col("value") + 2).alias("high"), (F.col("value") - 1).alias("low"), (F.col("value") + 1).alias("close"), F.col("user_id").alias("tick_volume"), F.lit(2).alias("spread"), F.lit(0).alias("real_volume"), F.lit("mt5").alias("source"), "event_id")


def _bars(df: DataFrame) -> DataFrame:
    return df.select(iso(F.col("timestamp_utc")).alias("timestamp_utc"), *BAR)


SYNTHETIC = """
WITH r AS (SELECT CASE event_type WHEN 'signup' THEN 'EURUSD' WHEN 'error' THEN 'EURGBP' WHEN 'click' THEN 'EURJPY' WHEN 'view' THEN 'EURCHF' END AS pair,
                  CAST(ts AS DATE) AS day, value, ts, event_id FROM events),
k AS (SELECT * FROM r WHERE pair IS NOT NULL AND value IS NOT NULL QUALIFY row_number() OVER (PARTITION BY pair, day ORDER BY ts DESC, event_id DESC) = 1)
SELECT strftime(day, '%Y-%m-%dT15:00:00Z') AS timestamp_utc, pair, 'D1' AS timeframe, value AS open, value AS high, value AS low, value AS "close", 0.0::DOUBLE AS volume, 'ecb' AS source FROM k
"""


@query("synthetic_bars", SYNTHETIC)
def synthetic_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(prices.synthetic_bars(_rates(spark, sf_dir), ["ts", "event_id"]))


@query("synthetic_bars_range", f"SELECT * FROM ({SYNTHETIC}) WHERE timestamp_utc BETWEEN '2024-01-05' AND '2024-01-20T23:59:59Z'")
def synthetic_bars_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(prices.synthetic_bars(_rates(spark, sf_dir), ["ts", "event_id"], "2024-01-05", "2024-01-20"))


EPOCH = """
SELECT strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, 'EUR' || upper(substr(event_type, 1, 3)) AS pair, 'M1' AS timeframe,
       value AS open, value + 2 AS high, value - 1 AS low, value + 1 AS "close", CAST(user_id AS DOUBLE) AS volume, 'mt5' AS source
FROM events QUALIFY row_number() OVER (PARTITION BY date_trunc('minute', ts), event_type ORDER BY event_id) = 1
"""


@query("epoch_bars_silver", EPOCH)
def epoch_bars_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bars(prices.epoch_bars(_epoch(spark, sf_dir), ["event_id"]))


@query("macro_silver", """
SELECT strftime(CAST(ts AS DATE), '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, 'S' || CAST(user_id % 50 AS VARCHAR) AS series_id,
       CAST(json_extract_string(props, '$.k') AS DOUBLE) AS value, 'fred' AS source, 'D' AS frequency, 'N/A' AS units
FROM events WHERE json_extract_string(props, '$.k') IS NOT NULL AND ts >= TIMESTAMP '2024-01-03' AND ts < TIMESTAMP '2024-01-26'
QUALIFY row_number() OVER (PARTITION BY CAST(ts AS DATE), user_id % 50 ORDER BY event_id) = 1""")
def macro_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    raw = e.select(F.to_date("ts").cast("string").alias("date"), F.get_json_object("props", "$.k").alias("value"), F.concat(F.lit("S"), (F.col("user_id") % 50).cast("string")).alias("series_id"), F.lit("D").alias("frequency"), F.lit("N/A").alias("units"), F.lit("fred").alias("source"), "event_id")
    out = macro.series(raw, ["event_id"]).where(dedup.between(F.col("timestamp_utc"), "2024-01-03", "2024-01-25"))
    return out.withColumn("timestamp_utc", iso(F.col("timestamp_utc")))


@query("rate_code_map", """
WITH m AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'ECB_DFR' WHEN '2-HIGH' THEN 'ECB_MRR' WHEN '3-MEDIUM' THEN 'ECB_MLF' END AS series_id, * FROM orders)
SELECT strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, series_id, o_totalprice AS value, 'ecb' AS source,
       first_value(o_orderstatus) OVER (PARTITION BY series_id ORDER BY o_orderkey) AS frequency, 'Percent' AS units
FROM m WHERE series_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY series_id, o_orderdate ORDER BY o_orderkey DESC) = 1""")
def rate_code_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = prices.mapped(table(spark, sf_dir, "orders"), "o_orderpriority", RATE_CODES, "code")
    raw = o.select("code", F.col("o_orderdate").cast("string").alias("date"), F.col("o_totalprice").cast("string").alias("value"), F.col("o_orderstatus").alias("frequency"), F.lit("ecb").alias("source"), "o_orderkey")
    return macro.policy_rates(raw, ["o_orderkey"]).withColumn("timestamp_utc", iso(F.col("timestamp_utc")))


@query("date_range_filter", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS timestamp_utc, o_totalprice FROM orders WHERE o_orderdate BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1997-06-30'""")
def date_range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").where(dedup.between(F.col("o_orderdate"), "1996-02-01", "1997-06-30"))
    return o.select("o_orderkey", iso(F.col("o_orderdate").cast("timestamp")).alias("timestamp_utc"), "o_totalprice")


def _monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_custkey", F.date_format("o_orderdate", "yyyy-MM").alias("month"), "o_orderkey", "o_totalprice")


MONTHLY = "SELECT o_custkey, strftime(o_orderdate, '%Y-%m') AS \"month\", o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderkey {}) = 1"


@query("dedup_first", MONTHLY.format("ASC"))
def dedup_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(_monthly(spark, sf_dir), ["o_custkey", "month"], ["o_orderkey"])


@query("dedup_last", MONTHLY.format("DESC"))
def dedup_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.deduplicated(_monthly(spark, sf_dir), ["o_custkey", "month"], ["o_orderkey"], keep="last")


@query("duplicate_counts", """
SELECT count(*) AS n_rows, count(DISTINCT (o_custkey, strftime(o_orderdate, '%Y-%m'))) AS n_keys, count(*) - count(DISTINCT (o_custkey, strftime(o_orderdate, '%Y-%m'))) AS n_removed FROM orders""")
def duplicate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.duplicate_counts(_monthly(spark, sf_dir), ["o_custkey", "month"])


@query("ffill_time", """
SELECT event_id, user_id, last_value(CASE WHEN value >= 50 THEN strftime(ts, '%H:%M') END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS clock FROM events""")
def ffill_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.when(F.col("value") >= 50, F.date_format("ts", "HH:mm")).otherwise("").alias("clock"))
    return dedup.forward_filled(e, "clock", ["user_id"], ["event_id"])


def _calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spread(table(spark, sf_dir, "orders")).join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    word = F.element_at(F.array(*(F.lit(w) for w in ("German CPI m/m", "UK GDP q/q", "Trade Balance", "French PMI", "US Retail Sales"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    impact = F.element_at(F.array(*(F.lit(w) for w in ("High", "Medium", "Low", ""))), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return o.select(
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("date"),
        F.concat((F.col("o_custkey") % 12 + 1).cast("string"), F.lit(":30"), F.when(F.col("o_orderkey") % 2 == 0, "am").otherwise("pm")).alias("time"),
        F.initcap("n_name").alias("currency"),
        F.concat(word, F.lit(" "), F.col("o_orderpriority")).alias("event"),
        impact.alias("impact"),
        F.concat(F.floor("o_totalprice").cast("string"), F.lit("K")).alias("actual"),
        F.when(F.col("o_orderkey") % 7 == 0, "-").otherwise(F.concat((F.col("o_custkey") + 1).cast("string"), F.lit("M"))).alias("forecast"),
        F.concat((F.col("o_orderkey") % 100).cast("string"), F.lit(".5%")).alias("previous"),
        F.lit("forexfactory").alias("source"),
        "o_orderkey",
    )


CALENDAR = """
raw AS (
  SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS d, (o_custkey % 12 + 1) % 12 + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 12 END AS h,
         lower(n_name) AS nation, ['German CPI m/m', 'UK GDP q/q', 'Trade Balance', 'French PMI', 'US Retail Sales'][o_orderkey % 5 + 1] || ' ' || o_orderpriority AS event_name,
         ['DE', 'GB', NULL, 'FR', 'US'][o_orderkey % 5 + 1] AS named, ['high', 'medium', 'low', 'unknown'][o_orderkey % 4 + 1] AS impact,
         floor(o_totalprice) * 1000 AS actual, CASE WHEN o_orderkey % 7 <> 0 THEN (o_custkey + 1)::DOUBLE * 1000000 END AS forecast, (o_orderkey % 100)::DOUBLE + 0.5 AS previous
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey),
ev AS (
  SELECT *, d || coalesce('T' || lpad(CAST(h AS VARCHAR), 2, '0') || ':30:00Z', 'T00:00:00Z') AS timestamp_utc,
         coalesce(named, CASE nation WHEN 'united states' THEN 'US' WHEN 'united kingdom' THEN 'GB' WHEN 'japan' THEN 'JP' WHEN 'canada' THEN 'CA' WHEN 'china' THEN 'CN'
           WHEN 'germany' THEN 'DE' WHEN 'france' THEN 'FR' WHEN 'brazil' THEN 'BR' WHEN 'india' THEN 'IN' WHEN 'indonesia' THEN 'ID' WHEN 'russia' THEN 'RU' ELSE upper(substr(nation, 1, 2)) END) AS country FROM raw),
silver AS (
  SELECT timestamp_utc, substr(sha256(timestamp_utc || '|' || country || '|' || event_name), 1, 16) AS event_id, country, event_name, impact, actual, forecast, previous, 'forexfactory' AS source
  FROM ev QUALIFY row_number() OVER (PARTITION BY timestamp_utc, country, event_name ORDER BY o_orderkey) = 1)
"""


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = calendar.events(_calendar(spark, sf_dir), ["o_orderkey"])
    return out.withColumn("timestamp_utc", iso(F.col("timestamp_utc")))


@query("events_silver", f"WITH {CALENDAR} SELECT * FROM silver")
def events_silver(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _events(spark, sf_dir)


@query("event_surprise", f"""WITH {CALENDAR}
SELECT event_id, country, actual - forecast AS surprise, (actual - forecast) / nullif(abs(forecast), 0) * 100 AS surprise_pct
FROM silver WHERE impact IN ('high', 'medium') AND abs((actual - forecast) / nullif(abs(forecast), 0) * 100) > 10""")
def event_surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _events(spark, sf_dir).where(F.col("impact").isin("high", "medium"))
    pct = surprise_percent(F.col("actual"), F.col("forecast"))
    return e.select("event_id", "country", surprise(F.col("actual"), F.col("forecast")).alias("surprise"), pct.alias("surprise_pct")).where("abs(surprise_pct) > 10")


@query("row_errors", """
WITH c AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN '31.12.1999' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS d,
                  CASE WHEN o_orderkey % 4 = 3 THEN '' ELSE 'x' END AS impact FROM orders)
SELECT o_orderkey, 'Missing required field ''date''' AS message FROM c WHERE d = ''
UNION ALL SELECT o_orderkey, 'Missing required field ''impact''' FROM c WHERE impact = ''
UNION ALL SELECT o_orderkey, 'Invalid date format ''' || d || '''' FROM c WHERE d = '31.12.1999'""")
def row_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = _calendar(spark, sf_dir).withColumn("date", F.when(F.col("o_orderkey") % 11 == 0, "").when(F.col("o_orderkey") % 13 == 0, "31.12.1999").otherwise(F.col("date")))
    return calendar.row_errors(raw, "o_orderkey")


@query("series_metadata_join", """
SELECT event_id, event_type AS series_id, value, coalesce(CASE event_type WHEN 'click' THEN 'D' WHEN 'view' THEN 'W' WHEN 'purchase' THEN 'M' END, 'N/A') AS frequency_short,
       coalesce(CASE event_type WHEN 'click' THEN 'Percent' WHEN 'view' THEN 'Index' END, 'N/A') AS units FROM events""")
def series_metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = spark.createDataFrame([("click", "D", "Percent"), ("view", "W", "Index"), ("purchase", "M", None)], "series_id string, frequency_short string, units string")
    e = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("series_id"), "value")
    return macro.with_metadata(e, meta)


@query("incremental_latest", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS value, CASE WHEN o_orderkey % 3 = 0 THEN 2 ELSE 1 END AS pull FROM orders")
def incremental_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    first = o.select("o_orderkey", F.col("o_totalprice").alias("value"), F.lit(1).alias("pull"))
    second = o.where("o_orderkey % 3 = 0").select("o_orderkey", (F.col("o_totalprice") + 1).alias("value"), F.lit(2).alias("pull"))
    return macro.latest_revisions(first.unionByName(second), ["o_orderkey"], "pull", ["value"])
