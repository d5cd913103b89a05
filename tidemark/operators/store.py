"""Keyed storage: appends that ignore rows whose key is there already."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import STORED, Contract, completed
from tidemark.functions.times import months_between, week_number
from tidemark.operators import bloom
from tidemark.operators.dedup import deduplicated
from tidemark.operators.merge import file_system, locked
from tidemark.operators.quality import contract_rules


def whole_key(keys: list[str]) -> Column:
    test = F.lit(True)
    for k in keys:
        test = test & F.col(k).isNotNull()
    return test


def new_rows(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str | Column]) -> DataFrame:
    """Rows of the batch to be inserted: first of equal keys, key not in the target; a key with NULL never collides."""
    whole = whole_key(keys)
    first = deduplicated(batch.where(whole), keys, order).unionByName(batch.where(~whole))
    return first.join(target.select(*keys), keys, "left_anti").select(batch.columns)


def new_rows_filtered(target: DataFrame, batch: DataFrame, keys: list[str], order: list[str | Column], filtered: DataFrame, n_blocks: int) -> DataFrame:
    """As ``new_rows``, with a Bloom filter of the target's keys: rows that it does not know are new and meet the target no more.

    Only the keys that it may know are looked up in the target, which is scanned for them and, while these are few
    enough for a broadcast, not shuffled.
    """
    whole = whole_key(keys)
    judged = bloom.tested(deduplicated(batch.where(whole), keys, order), filtered, keys, n_blocks, "_maybe")
    possible = judged.where("_maybe").drop("_maybe")
    there = target.select(*keys).join(possible.select(*keys), keys, "left_semi").distinct()
    fresh = judged.where("not _maybe").drop("_maybe").unionByName(possible.join(there, keys, "left_anti"))
    return fresh.unionByName(batch.where(~whole)).select(batch.columns)


class KeyFilter:
    """The Bloom filter stored in a table's folder, in versions: the last one holds the keys of all rows inserted so far."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str]):
        self.spark, self.keys, self.root = spark, keys, f"{path}/_keys"
        fs, where = file_system(spark, self.root)
        found = sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []
        self.version, self.n_blocks, self.n_keys = map(int, found[-1].split("-")) if found else (0, 0, 0)
        self.name = found[-1] if found else None

    def read(self) -> DataFrame:
        return self.spark.read.schema("block long, bitmap binary").parquet(f"{self.root}/{self.name}")

    def save(self, filtered: DataFrame, n_blocks: int, n_keys: int) -> None:
        name, old = f"{self.version + 1:09d}-{n_blocks}-{n_keys}", self.name
        filtered.coalesce(1).write.parquet(f"{self.root}/{name}")
        if old:
            fs, where = file_system(self.spark, f"{self.root}/{old}")
            fs.delete(where, True)
        self.version, self.n_blocks, self.n_keys, self.name = self.version + 1, n_blocks, n_keys, name

    def ready(self, target: DataFrame, coming: int) -> bool:
        """Whether there is a filter with room for what is coming; made anew, twice as large, where there is none."""
        if self.name is None or (self.n_keys + coming) > self.n_blocks * bloom.KEYS_A_BLOCK:
            n_keys = target.count()
            n_blocks = bloom.blocks_for(2 * (n_keys + coming))
            if n_blocks > bloom.MOST_BLOCKS:
                return False
            self.save(bloom.built(target.where(whole_key(self.keys)), self.keys, n_blocks), n_blocks, n_keys)
        return True


def insert_ignore(spark: SparkSession, path: str, batch: DataFrame, keys: list[str], order: list[str | Column], filtered: bool = False) -> int:
    """Append to the Parquet table at ``path`` and return how many rows went in.

    One writer at a time; rows are counted while they are written.  ``filtered`` keeps a Bloom filter beside the table,
    so that new rows are told without a look at all of it; a table too large for the filter is looked up whole.
    """
    with locked(spark, path):
        target = spark.read.schema(batch.schema).parquet(path)
        known = KeyFilter(spark, path, keys) if filtered else None
        if known and known.ready(target, batch.count()):
            fresh = new_rows_filtered(target, batch, keys, order, known.read(), known.n_blocks)
        else:
            known, fresh = None, new_rows(target, batch, keys, order)
        seen = Observation()
        fresh.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("append").parquet(path)
        n = seen.get["n"]
        if known and n:
            known.save(bloom.merged(known.read(), bloom.built(batch.where(whole_key(keys)), keys, known.n_blocks)), known.n_blocks, known.n_keys + n)
    return n


def _known(name: str) -> Contract:
    if name not in STORED:
        raise ValueError(f"unknown table {name!r}; known: {sorted(STORED)}")
    return STORED[name]


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """One of the stored tables; another name raises ValueError."""
    _known(name)
    return spark.read.parquet(f"{root}/{name}")


def export_csv(spark: SparkSession, root: str, name: str, path: str) -> str:
    """A stored table as CSV with a header; an empty table gives empty files."""
    df = table(spark, root, name)
    df.write.mode("overwrite").option("header", not df.isEmpty()).csv(path)
    return path


def faults(batch: DataFrame, name: str) -> DataFrame:
    """``batch`` with the table's columns and ``faults``: what keeps a row from being stored (null or too long), as an array."""
    rules = contract_rules(_known(name))
    own = F.array_compact(F.array(*(F.when(F.coalesce(bad, F.lit(False)), F.lit(rule)) for rule, bad in rules.items())))
    return completed(batch, STORED[name]).withColumn("faults", own)


def insert(spark: SparkSession, root: str, name: str, batch: DataFrame, order: list[str | Column] | None = None) -> int:
    """Append what is new to a stored table; rows that break its constraints raise ValueError and nothing is stored."""
    judged = faults(batch, name)
    bad = judged.select(F.explode("faults").alias("fault")).groupBy("fault").count().collect()  # a row per constraint
    if bad:
        raise ValueError(f"{name}: {sorted((r['fault'], r['count']) for r in bad)}")
    rows = judged.drop("faults")
    return insert_ignore(spark, f"{root}/{name}", rows, list(STORED[name].key), order or rows.columns)


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def coverage(df: DataFrame, key: str, ts: str) -> DataFrame:
    return df.groupBy(key).agg(F.count("*").alias("n_rows"), F.min(ts).alias("first_ts"), F.max(ts).alias("last_ts"))


def uncovered(stored: DataFrame, wanted: DataFrame) -> DataFrame:
    """Requests (series_id, start, end) that the stored series (series_id, ts) does not span."""
    span = stored.groupBy("series_id").agg(F.min("ts").alias("_low"), F.max("ts").alias("_high"))
    out = wanted.join(span, "series_id", "left").where("_low is null or _low > start or _high < end")
    return out.select(*wanted.columns)


def missing_months(stored: DataFrame, key: str, day: str) -> DataFrame:
    """(key, month) between a key's first and last month of which nothing is stored."""
    seen = stored.select(key, F.trunc(day, "month").alias("month")).distinct()
    span = seen.groupBy(key).agg(F.min("month").alias("low"), F.max("month").alias("high"))
    every = span.select(key, F.explode(F.sequence("low", "high", F.expr("interval 1 month"))).alias("month"))
    return every.join(seen, [key, "month"], "left_anti")


def calendar_views(requests: DataFrame, start: str, end: str) -> DataFrame:
    """``requests`` with view and first_day: the calendar pages that cover each range of days.

    One day is a day view, days of one ISO week a week view, days of one month a month view, and anything longer
    one month view for each month that it touches.
    """
    days = F.datediff(end, start) + 1
    one_week = (days <= 7) & (week_number(F.col(start)) == week_number(F.col(end)))
    one_month = (days <= 31) & (F.trunc(start, "month") == F.trunc(end, "month"))
    view = F.when(days == 1, "day").when(one_week, "week").otherwise("month")
    first = F.when((days == 1) | one_week | one_month, F.array(F.col(start))).otherwise(months_between(F.col(start), F.col(end)))
    return requests.where(days >= 1).select("*", view.alias("view"), F.explode(first).alias("first_day"))
