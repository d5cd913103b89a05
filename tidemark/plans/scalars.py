"""Queries: column functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import ids, numbers, text, times
from tidemark.functions.times import iso
from tidemark.plans.base import query
from tidemark.plans.common import table, text_time
from tidemark.session import spread


def _pick(key: str, *values: str | None):
    return F.element_at(F.array(*(F.lit(v) for v in values)), (F.col(key) % len(values) + 1).cast("int"))


@query("parse_numbers", """
SELECT l_orderkey, l_linenumber, CASE l_linenumber % 8 WHEN 0 THEN l_quantity * 1000 WHEN 1 THEN l_quantity * 1000000 WHEN 2 THEN l_quantity * 1000000000 WHEN 3 THEN l_quantity * 1000000000000
       WHEN 4 THEN l_quantity WHEN 5 THEN l_quantity WHEN 6 THEN NULL ELSE -(1000 + l_quantity) END AS number FROM lineitem""")
def parse_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, k = F.col("l_quantity").cast("int").cast("string"), F.col("l_linenumber") % 8
    shown = F.when(k == 0, F.concat(q, F.lit("K"))).when(k == 1, F.concat(F.lit(" "), q, F.lit("m"))).when(k == 2, F.concat(q, F.lit(".0B"))).when(k == 3, F.concat(q, F.lit("T"))).when(k == 4, F.concat(q, F.lit("%"))).when(k == 5, F.concat(q, F.lit("|2.7"))).when(k == 6, F.lit("N/A")).otherwise(F.concat(F.lit("-1,"), F.lpad(q, 3, "0")))
    return spread(table(spark, sf_dir, "lineitem")).select("l_orderkey", "l_linenumber", numbers.parse_number(shown).alias("number"))


@query("parse_clock", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(date_trunc('minute', ts), '%Y-%m-%dT%H:%M:00Z') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:00Z')
       WHEN 2 THEN strftime(ts, '%Y-%m-%dT00:00:00Z') END AS timestamp_utc FROM events""")
def parse_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    clock = F.when(k == 0, F.date_format("ts", "h:mma")).when(k == 1, F.date_format("ts", "HH:mm")).when(k == 2, F.lit("All Day")).otherwise(F.lit("25:00"))
    return table(spark, sf_dir, "events").select("event_id", iso(times.clock_timestamp(F.date_format("ts", "yyyy-MM-dd"), clock)).alias("timestamp_utc"))


@query("country_codes", """
SELECT c_custkey, CASE n_name WHEN 'UNITED STATES' THEN 'US' WHEN 'UNITED KINGDOM' THEN 'GB' WHEN 'JAPAN' THEN 'JP' WHEN 'CANADA' THEN 'CA' WHEN 'CHINA' THEN 'CN' WHEN 'GERMANY' THEN 'DE'
       WHEN 'FRANCE' THEN 'FR' WHEN 'BRAZIL' THEN 'BR' WHEN 'INDIA' THEN 'IN' WHEN 'INDONESIA' THEN 'ID' WHEN 'RUSSIA' THEN 'RU' ELSE substr(n_name, 1, 2) END AS country
FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def country_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    shown = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit(" "), F.col("n_name"))).otherwise(F.replace(F.initcap("n_name"), F.lit(" "), F.lit("")))
    return c.select("c_custkey", text.country_code(shown).alias("country"))


@query("event_ids", "SELECT event_id AS row_id, substr(sha256(coalesce(CASE WHEN event_id % 9 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END, 'None') || '|' || upper(substr(event_type, 1, 2)) || '|' || event_type), 1, 16) AS event_id FROM events")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    stamp = F.when(F.col("event_id") % 9 > 0, text_time(F.col("ts")))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("row_id"), ids.event_id(stamp, F.upper(F.substring("event_type", 1, 2)), F.col("event_type")).alias("event_id"))


@query("url_hash", "SELECT page_id, sha256(url) AS url_hash FROM pages")
def url_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", ids.url_hash(F.col("url")).alias("url_hash"))


@query("clean_text", r"""
SELECT doc_id, sha256(trim(regexp_replace(replace(chr(160) || coalesce(text, '') || chr(8203) || '  x', chr(8203), ''), '[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+', ' ', 'g'))) AS text_hash FROM documents""")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit("\xa0"), F.coalesce("text", F.lit("")), F.lit("\u200b  x"))
    return spread(table(spark, sf_dir, "documents")).select("doc_id", F.sha2(text.clean_text(shown), 256).alias("text_hash"))


@query("sentiment_sign", """
SELECT doc_id, CASE WHEN toxic = 1 THEN -round(0.5 + quality * 0.25 + (doc_id % 100) / 1000.0::DOUBLE, 4) WHEN quality = 1 THEN round(0.5 + quality * 0.25 + (doc_id % 100) / 1000.0::DOUBLE, 4) ELSE 0.0 END AS score,
       CASE WHEN toxic = 1 THEN 'negative' WHEN quality = 1 THEN 'positive' ELSE 'neutral' END AS label FROM labels""")
def sentiment_sign(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("toxic") == 1, "Negative").when(F.col("quality") == 1, "POSITIVE").otherwise("neutral")
    sure = F.lit(0.5) + F.col("quality") * 0.25 + (F.col("doc_id") % 100) / F.lit(1000.0)
    return table(spark, sf_dir, "labels").select("doc_id", numbers.signed_score(label, sure).alias("score"), F.lower(label).alias("label"))


@query("trading_hours", """
SELECT event_id, CASE dayofweek(ts) WHEN 6 THEN false WHEN 5 THEN hour(ts) < 22 WHEN 0 THEN hour(ts) >= 22 ELSE true END AS open FROM events""")
def trading_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", times.is_trading_time(F.col("ts").cast("timestamp")).alias("open"))


@query("multi_format_dates", """
SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN strftime(o_orderdate, '%Y-%m-%d') END AS long_date, strftime(o_orderdate, '%Y-%m-%d') AS us_date, strftime(o_orderdate, '%Y-%m-%d') AS header_date FROM orders""")
def multi_format_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("o_orderkey") % 6, F.col("o_orderdate")
    shown = F.when(k == 0, F.date_format(d, "dd MMMM yyyy")).when(k == 1, F.date_format(d, "d MMM yyyy")).when(k == 2, F.date_format(d, "MMMM dd, yyyy")).when(k == 3, F.date_format(d, "yyyy-MM-dd")).when(k == 4, F.upper(F.date_format(d, "d MMMM yyyy"))).otherwise("soon")
    head = F.concat(F.date_format(d, "EEEE"), F.lit(", "), F.date_format(d, "MMMM d, yyyy"))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(times.long_date(shown), "yyyy-MM-dd").alias("long_date"), F.date_format(times.us_date(F.date_format(d, "MM/dd/yyyy")), "yyyy-MM-dd").alias("us_date"), F.date_format(times.header_date(head, 2000), "yyyy-MM-dd").alias("header_date"))


@query("feed_dates", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM events")
def feed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, d = F.col("event_id") % 3, F.date_format("ts", "EEE, dd MMM yyyy HH:mm:ss")
    shown, updated = F.when(k == 0, F.concat(d, F.lit(" +0200"))).when(k == 1, ""), F.when(k == 1, F.concat(d, F.lit(" GMT"))).otherwise("never")
    return table(spark, sf_dir, "events").select("event_id", iso(times.feed_date(shown, updated)).alias("utc"))


@query("iso_times", """
SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts - INTERVAL 2 HOUR, '%Y-%m-%dT%H:%M:%SZ') WHEN 2 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS parsed,
       CASE WHEN event_id % 4 = 3 THEN 'n.d.' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS compact,
       strftime(CASE event_id % 4 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('second', ts) ELSE TIMESTAMP '2020-02-02' END, '%Y-%m-%dT%H:%M:%SZ') AS published FROM events""")
def iso_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id") % 4
    plain = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")
    shown = F.when(k == 0, F.concat(plain, F.lit("Z"))).when(k == 1, F.concat(plain, F.lit("+02:00"))).when(k == 2, plain).otherwise("yesterday")
    compact = F.when(k == 3, "n.d.").otherwise(F.date_format("ts", "yyyyMMddHHmmss"))
    published = times.published_date(F.when(k == 0, F.concat(F.lit("Published on "), F.date_format("ts", "dd MMMM yyyy"))).otherwise("today"), F.when(k == 1, F.concat(plain, F.lit("Z"))), F.lit("2020-02-02T00:00:00Z"))
    return table(spark, sf_dir, "events").select("event_id", iso(times.iso_parse(shown)).alias("parsed"), times.compact_timestamp(compact).alias("compact"), iso(published).alias("published"))


_EDGE = "[^\\p{L}\\p{N}_]"


@query("country_from_name", f"""
WITH t AS (SELECT doc_id, lower(['German WPI of ', 'Index, FRANCE ', 'Germanic ', 'UK and US ', 'The US ', 'U.S. CPI ', '(Italian) '][doc_id % 7 + 1] || coalesce(text, '')) AS t FROM documents)
SELECT doc_id, CASE {' '.join(f"WHEN regexp_matches(t, '(?:^|{_EDGE})(?:{w})(?:$|{_EDGE})') THEN '{c}'" for w, c in text.COUNTRY_WORDS[:-2])}
       WHEN regexp_matches(t, '(?:^|{_EDGE})(?:british|uk)(?:$|{_EDGE})') OR regexp_matches(t, '(?:^|{_EDGE})u\\.k\\.[\\p{{L}}\\p{{N}}_]') THEN 'GB'
       WHEN regexp_matches(t, '(?:^|{_EDGE})us(?:$|{_EDGE})') OR regexp_matches(t, '(?:^|{_EDGE})u\\.s\\.[\\p{{L}}\\p{{N}}_]') THEN 'US' END AS country FROM t""")
def country_from_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(_pick("doc_id", "German WPI of ", "Index, FRANCE ", "Germanic ", "UK and US ", "The US ", "U.S. CPI ", "(Italian) "), F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", text.country_from_name(name).alias("country"))


@query("article_ids", "SELECT doc_id, substr(sha256(CASE WHEN doc_id % 2 = 0 THEN 'https://x/' || CAST(doc_id AS VARCHAR) ELSE source || '|' || coalesce(text, '') || '|2024' END), 1, 16) AS article_id FROM documents")
def article_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("https://x/"), F.col("doc_id").cast("string"))).otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", ids.article_id(url, F.col("source"), F.col("text"), F.lit("2024")).alias("article_id"))


@query("clean_values", """
WITH v AS (SELECT conv_id, turn, CASE turn % 6 WHEN 0 THEN '-' WHEN 1 THEN ' N/A ' WHEN 2 THEN '—' WHEN 3 THEN '' ELSE '  ' || text || ' ' END AS v FROM conversations)
SELECT conv_id, turn, CASE WHEN lower(trim(v)) NOT IN ('-', 'n/a', 'na', '', '—', '–') THEN trim(v) END AS shown FROM v""")
def clean_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 6
    raw = F.when(k == 0, "-").when(k == 1, " N/A ").when(k == 2, "—").when(k == 3, "").otherwise(F.concat(F.lit("  "), F.col("text"), F.lit(" ")))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.clean_value(raw).alias("shown"))


@query("impact_levels", """
WITH v AS (SELECT doc_id, lower(['icon high-impact', 'icon', 'icon', source][doc_id % 4 + 1]) AS a, lower(['low', 'Moderate impact', '', lang][doc_id % 4 + 1]) AS b, lower(coalesce(text, '')) AS c FROM documents),
l AS (SELECT doc_id, CASE WHEN contains(a, 'high') THEN 'High' WHEN contains(a, 'medium') OR contains(a, 'moderate') THEN 'Medium' WHEN contains(a, 'low') THEN 'Low' END AS a,
             CASE WHEN contains(b, 'high') THEN 'High' WHEN contains(b, 'medium') OR contains(b, 'moderate') THEN 'Medium' WHEN contains(b, 'low') THEN 'Low' END AS b,
             CASE WHEN contains(c, 'high') THEN 'High' WHEN contains(c, 'medium') OR contains(c, 'moderate') THEN 'Medium' WHEN contains(c, 'low') THEN 'Low' END AS c FROM v)
SELECT doc_id, coalesce(a, b, c, 'Unknown') AS level FROM l""")
def impact_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes = F.coalesce(_pick("doc_id", "icon high-impact", "icon", "icon", None), F.col("source"))
    title = F.coalesce(_pick("doc_id", "low", "Moderate impact", "", None), F.col("lang"))
    return table(spark, sf_dir, "documents").select("doc_id", text.impact_level(classes, title, F.coalesce("text", F.lit(""))).alias("level"))


@query("to_utc", """
WITH t AS (SELECT o_orderkey, o_orderdate + (o_orderkey % 24) * INTERVAL 1 HOUR AS t FROM orders),
y AS (SELECT *, make_date(year(t)::BIGINT, 4, 1) AS april, make_date(year(t)::BIGINT, 10, 31) AS october FROM t),
d AS (SELECT *, april::TIMESTAMP + ((7 - dayofweek(april)) % 7) * INTERVAL 1 DAY + INTERVAL 2 HOUR AS summer, october::TIMESTAMP - dayofweek(october) * INTERVAL 1 DAY + INTERVAL 2 HOUR AS winter FROM y)
SELECT o_orderkey, strftime(t + CASE WHEN t >= summer + INTERVAL 1 HOUR AND t < winter - INTERVAL 1 HOUR THEN INTERVAL 4 HOUR ELSE INTERVAL 5 HOUR END, '%Y-%m-%dT%H:%M:%SZ') AS utc FROM d""")
def to_utc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order times of all seasons, 1995 to 2001, as New York time; in the hours that clocks skip or repeat standard time holds."""
    o = table(spark, sf_dir, "orders").withColumn("t", F.col("o_orderdate").cast("timestamp") + F.make_interval(hours=(F.col("o_orderkey") % 24).cast("int")))
    return o.select("o_orderkey", iso(times.to_utc(F.col("t"))).alias("utc"))


@query("url_dates", r"""
WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN '/press/key/date/2000/html/ecb.sp' || strftime(DATE '1995-01-01' + CAST(page_id * 13 % 12000 AS INTEGER), '%y%m%d') || '~ab' || url WHEN 1 THEN '/date/2026/ecb.x261399~' || url WHEN 2 THEN '/x/ecb.pr98' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '05~z' || url ELSE url END AS u FROM pages),
s AS (SELECT page_id, regexp_extract(u, 'ecb\.\w+([0-9]{6})~', 1) AS six, regexp_extract(u, '/date/([0-9]{4})/', 1) AS y FROM u)
SELECT page_id, strftime(coalesce(try_strptime(CASE WHEN six = '' THEN NULL WHEN six[1:2] < '50' THEN '20' ELSE '19' END || six, '%Y%m%d'), try_strptime(nullif(y, '') || '0101', '%Y%m%d')), '%Y-%m-%d') AS day FROM s""")
def url_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    six = F.date_format(F.date_add(F.lit("1995-01-01").cast("date"), (F.col("page_id") * 13 % 12000).cast("int")), "yyMMdd")
    k = F.col("page_id") % 4
    url = F.when(k == 0, F.concat(F.lit("/press/key/date/2000/html/ecb.sp"), six, F.lit("~ab"), F.col("url"))).when(k == 1, F.concat(F.lit("/date/2026/ecb.x261399~"), F.col("url"))).when(k == 2, F.concat(F.lit("/x/ecb.pr98"), F.lpad((F.col("page_id") % 100).cast("string"), 2, "0"), F.lit("05~z"), F.col("url"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", F.date_format(times.url_date(url), "yyyy-MM-dd").alias("day"))


@query("domain_tiers", """
WITH h AS (SELECT page_id, lower(['', 'www.reuters.com', 'news.FT.com', 'notft.com', 'cnbc.com', 'wsj.com.example'][page_id % 6 + 1]) AS pick, lower(regexp_extract(coalesce(url, ''), '^https?://([^/?#]+)', 1)) AS host FROM pages),
d AS (SELECT page_id, CASE WHEN pick = '' THEN host ELSE pick END AS d FROM h)
SELECT page_id, CASE WHEN regexp_matches(d, '(^|\\.)(reuters|bloomberg|ft)\\.com$') THEN 1 WHEN regexp_matches(d, '(^|\\.)(wsj|cnbc)\\.com$') THEN 2 ELSE 3 END AS tier FROM d""")
def domain_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    host = F.regexp_extract(F.coalesce("url", F.lit("")), r"^https?://([^/?#]+)", 1)
    domain = F.coalesce(_pick("page_id", None, "www.reuters.com", "news.FT.com", "notft.com", "cnbc.com", "wsj.com.example"), host)
    return table(spark, sf_dir, "pages").select("page_id", text.credibility_tier(domain, "domain").alias("tier"))


@query("theme_lists", """
SELECT doc_id, CASE WHEN t = '' THEN [] ELSE list_transform(string_split(t, ';'), lambda x: trim(x)) END AS items FROM (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE replace(coalesce(text, ''), ' ', ' ;') END AS t FROM documents)""")
def theme_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = F.when(F.col("doc_id") % 9 == 0, "").otherwise(F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit(" ;")))
    return table(spark, sf_dir, "documents").select("doc_id", text.split_list(joined).alias("items"))


@query("short_header_dates", "SELECT o_orderkey, strftime(make_date(2024, month(o_orderdate), day(o_orderdate)), '%Y-%m-%d') AS day FROM orders")
def short_header_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = F.concat(F.lit(" "), F.date_format("o_orderdate", "MMM d"), F.lit(" "))
    return table(spark, sf_dir, "orders").select("o_orderkey", F.date_format(times.header_date(shown, 2024), "yyyy-MM-dd").alias("day"))
