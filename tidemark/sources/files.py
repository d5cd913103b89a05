"""Scans of landed files: CSV by naming convention, JSON Lines, XML feeds and sitemaps, day partitions."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import blank_to_null
from tidemark.operators import scan as running
from tidemark.sources import scans
from tidemark.sources.scans import POSITION, Scan, positioned

PRICE_COLUMNS = "time long, open double, high double, low double, close double, tick_volume long, spread long, real_volume long, source string"
BARS = ["time", "open", "high", "low", "close", "tick_volume", "source"]
SERIES_COLUMNS = "date string, value string, series_id string, frequency string, units string, source string"
CALENDAR_COLUMNS = ("date", "time", "currency", "event", "impact", "actual", "forecast", "previous", "event_url", "source_url", "scraped_at", "source")
DOCUMENT_COLUMNS = "source string, timestamp_collected string, timestamp_published string, url string, title string, content string, document_type string, speaker string, metadata struct<author:string>"
FEED_COLUMNS = "title string, link string, description string, pubDate string, guid string, category array<string>"


def csv(spark: SparkSession, path: str, schema: str | T.StructType | None = None, glob: str = "*.csv", header: bool = True) -> DataFrame:
    """All matching CSV files as one frame; all columns text unless a schema is given; broken rows are dropped."""
    reader = spark.read.option("header", header).option("recursiveFileLookup", True).option("pathGlobFilter", glob).option("mode", "DROPMALFORMED")
    reader = reader if schema else reader.option("enforceSchema", False)  # a file with another header is an error, not shifted columns
    return (reader.schema(schema) if schema else reader).csv(path)


def price_bars_scan(spark: SparkSession, path: str, prefix: str = "mt5") -> Scan:
    """Bars with pair and timeframe taken from names like ``mt5_EURUSD_H1_20210101.csv`` (files or folders of parts); shorter names are skipped.

    A line whose number is none is set aside.
    """
    found = scans.csv(spark, f"{path}/{prefix}_*.csv", BARS, ["spread", "real_volume"])
    if found.rows is None:
        return found
    kinds = T.StructType.fromDDL(PRICE_COLUMNS)
    have = set(found.rows.columns)
    typed = {f.name: (F.col(f.name) if f.name in have else F.lit(None)).try_cast(f.dataType) for f in kinds}
    numbers = [f.name for f in kinds if f.name in have and not isinstance(f.dataType, T.StringType)]
    odd = F.array_compact(F.array(*(F.when(typed[c].isNull() & blank_to_null(F.col(c)).isNotNull(), F.lit(c)) for c in numbers)))
    judged = found.rows.withColumn("_odd", odd)
    named = F.element_at(F.filter(F.split("_file", "/"), lambda x: x.startswith(f"{prefix}_")), -1)
    parts = F.split(F.regexp_replace(named, r"\.csv$", ""), "_")
    rows = judged.where(F.size("_odd") == 0).select(*(c.alias(n) for n, c in typed.items()), *POSITION)
    rows = rows.where(F.size(parts) >= 3).withColumns({"pair": F.get(parts, F.lit(1)), "timeframe": F.get(parts, F.lit(2))})
    wrong = judged.where(F.size("_odd") > 0).select(F.col("_file").alias("file"), F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in numbers)).alias("line"), F.concat(F.lit("no number: "), F.array_join("_odd", ", ")).alias("reason"))
    return Scan(rows, found.faults.unionByName(wrong))


def price_bars(spark: SparkSession, path: str, prefix: str = "mt5") -> DataFrame:
    return readable(price_bars_scan(spark, path, prefix))


def required(df: DataFrame, columns: list[str]) -> DataFrame:
    lack = sorted(set(columns) - set(df.columns))
    if lack:
        raise ValueError(f"missing columns: {lack}")
    return df


def readable(found: Scan) -> DataFrame:
    """The rows; ValueError with the first reasons where no file could be read."""
    if found.rows is None:
        raise ValueError("; ".join(sorted({r["reason"] for r in found.faults.limit(5).collect()})) or "no file")
    return found.rows


def json_lines_scan(spark: SparkSession, path: str, schema: str = DOCUMENT_COLUMNS) -> Scan:
    """All ``*.jsonl`` below ``path``."""
    return scans.json_lines(spark, path, schema)


def json_lines(spark: SparkSession, path: str, schema: str = DOCUMENT_COLUMNS) -> DataFrame:
    """All ``*.jsonl`` below ``path``; blank lines are skipped and lines that are no JSON are left to the scan's faults."""
    return readable(json_lines_scan(spark, path, schema))


def known_urls(spark: SparkSession, path: str) -> DataFrame:
    return json_lines(spark, path).select("url").where("url <> ''").distinct()


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "url").schema("loc string, lastmod string").load(path)


def feed_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", "item").schema(FEED_COLUMNS).load(path)


def day_partitions(spark: SparkSession, path: str, first: str, after: str, columns: list[str]) -> DataFrame:
    """Named columns of the days in [first, after): the other days' files are not listed, other columns not read."""
    return spark.read.parquet(path).where((F.col("day") >= first) & (F.col("day") < after)).select(*columns)


Builder = Callable[[SparkSession, str], DataFrame]
Scanner = Callable[[SparkSession, str], Scan]
#: name -> builder of landed rows; ``register`` adds one.  name -> scan with what it sets aside, where there is one.
REGISTRY: dict[str, Builder] = {}
SCANNERS: dict[str, Scanner] = {}


def register(name: str, builder: Builder, scanner: Scanner | None = None) -> None:
    REGISTRY[name] = builder
    if scanner is not None:
        SCANNERS[name] = scanner


def routed(spark: SparkSession, roots: dict[str, str], strict: bool = True) -> DataFrame | None:
    """The union of all known sources in ``roots`` (name -> path).

    Unknown names, folders that are not there and sources of which no file can be read are skipped; if nothing is left
    that is an error if ``strict``.
    """
    parts = []
    for name, path in roots.items():
        if name in REGISTRY:
            try:
                parts.append(REGISTRY[name](spark, path))
            except (ValueError, AnalysisException) as e:
                if isinstance(e, AnalysisException) and e.getCondition() != "PATH_NOT_FOUND":
                    raise
    if not parts:
        if strict:
            raise ValueError(f"no known source among {sorted(roots)}")
        return None
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def quarantine(spark: SparkSession, roots: dict[str, str]) -> DataFrame:
    """source, file, line and reason of all that the scans of ``roots`` (name -> path) set aside."""
    found = scans.none(spark).select(F.lit(None).cast("string").alias("source"), "*")
    for name, path in roots.items():
        if name not in REGISTRY:
            faults = scans.fault(spark, path, "unknown source")
        elif name in SCANNERS and not scans.is_there(spark, path):
            faults = scans.fault(spark, path, "no such folder")
        elif name in SCANNERS:
            try:
                faults = SCANNERS[name](spark, path).faults
            except AnalysisException as e:
                if e.getCondition() != "PATH_NOT_FOUND":
                    raise
                faults = scans.fault(spark, path, "no file of the source")
        else:
            continue
        found = found.unionByName(faults.withColumn("source", F.lit(name)))
    return found


RATES, POLICY = ["TIME_PERIOD", "CURRENCY", "OBS_VALUE", "source"], ["TIME_PERIOD", "OBS_VALUE", "PROVIDER_FM_ID", "source"]
EVENT_COLUMNS = ["date", "time", "event", "impact", "actual", "forecast", "previous"]


def exchange_rates_scan(spark: SparkSession, path: str) -> Scan:
    return scans.csv(spark, f"{path}/ecb_exchange_rates_*.csv", RATES, [])


def exchange_rates(spark: SparkSession, path: str) -> DataFrame:
    """``ecb_exchange_rates_*.csv``: code, day, rate (text), source and positions."""
    df = readable(exchange_rates_scan(spark, path))
    return df.select(F.col("CURRENCY").alias("code"), F.try_to_date("TIME_PERIOD").alias("day"), F.col("OBS_VALUE").alias("rate"), "source", *POSITION)


def policy_rates_scan(spark: SparkSession, path: str) -> Scan:
    return scans.csv(spark, f"{path}/ecb_policy_rates_*.csv", POLICY, ["FREQ"])


def policy_rates(spark: SparkSession, path: str) -> DataFrame:
    """``ecb_policy_rates_*.csv``: code, date, value (text), frequency where there is one, source and positions."""
    df = readable(policy_rates_scan(spark, path))
    frequency = [F.col("FREQ").alias("frequency")] if "FREQ" in df.columns else []
    return df.select(F.col("PROVIDER_FM_ID").alias("code"), F.col("TIME_PERIOD").alias("date"), F.col("OBS_VALUE").alias("value"), *frequency, "source", *POSITION)


def series_scan(spark: SparkSession, path: str) -> Scan:
    return scans.csv(spark, f"{path}/fred_*.csv", T.StructType.fromDDL(SERIES_COLUMNS).names)


def series(spark: SparkSession, path: str) -> DataFrame:
    """``fred_*.csv`` as text; raises if no header has the six columns."""
    return readable(series_scan(spark, path))


def calendar_scan(spark: SparkSession, path: str) -> Scan:
    return scans.csv(spark, f"{path}/forexfactory_*.csv", EVENT_COLUMNS)


def calendar(spark: SparkSession, path: str) -> DataFrame:
    """``forexfactory_*.csv`` (files or folders of parts) as text, a blank time being that of the event before it; raises if no header has what events need."""
    rows = readable(calendar_scan(spark, path)).withColumn("_landed", F.regexp_extract("_file", "^.*/forexfactory_[^/]*", 0))
    return running.forward_filled(rows, "time", ["_landed"], ["_file", "_block"], ["_pos"]).drop("_landed")


def landed_documents(name: str) -> Builder:
    """Documents that one collector landed in a folder of its own name."""

    def read(spark: SparkSession, path: str) -> DataFrame:
        return json_lines(spark, f"{path}/{name}")

    return read


def landed_documents_scan(name: str) -> Scanner:
    return lambda spark, path: json_lines_scan(spark, f"{path}/{name}")


register("mt5", price_bars, price_bars_scan)
register("fred", series, series_scan)
register("ecb_exchange_rates", exchange_rates, exchange_rates_scan)
register("ecb_policy_rates", policy_rates, policy_rates_scan)
register("calendar", calendar, calendar_scan)
register("documents", json_lines, json_lines_scan)
for _name in ("ecb", "fed", "boe", "gdelt"):
    register(f"{_name}_documents", landed_documents(_name), landed_documents_scan(_name))
