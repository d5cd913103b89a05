"""Sources as plug-ins: how landed rows become silver rows, and the contract that these keep."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.contracts import EVENTS, MACRO, NEWS, OHLCV, Contract
from tidemark.functions.numbers import ohlc_consistent
from tidemark.operators import calendar, dedup, macro, news, prices, quality, scoring
from tidemark.sources import files


@dataclass(frozen=True)
class Source:
    """``read`` scans what a collector landed, ``clean`` makes silver rows of it, ``contract`` says what must hold of them."""

    read: files.Builder
    clean: Callable[[DataFrame], DataFrame]
    contract: Contract
    rules: Callable[[], dict] = dict
    #: The time of a landed row, where rows of one key differ in it: they are filtered before one of them is chosen.
    when: Callable[[], Column] | None = None

    def preprocess(self, spark: SparkSession, path: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Silver rows of the inclusive time range."""
        rows = self.read(spark, path)
        if start is None and end is None:
            return self.clean(rows)
        if self.when is not None:
            return self.clean(rows.where(dedup.between(self.when(), start, end)))
        return self.clean(rows).where(dedup.between(F.col("timestamp_utc"), start, end))

    def validate(self, df: DataFrame) -> bool:
        """True, or ValueError with the rules that are violated."""
        return quality.enforce(quality.checked(df, self.contract, self.rules()))


Score = Callable[[DataFrame, str], DataFrame]


def documents(score: Score = scoring.scored) -> Source:
    """Central-bank and graph news, one row an article, its headline scored by ``score`` (frame and text column -> frame with score and label).

    The default counts words; ``sentiment.fitted(...).score`` is one that has learned.
    """

    def clean(df: DataFrame) -> DataFrame:
        good, _ = news.articles(df.withColumn("author", F.col("metadata.author")))
        return score(news.deduplicated_articles(good, files.POSITION), "headline").select(*NEWS.columns)

    return Source(files.json_lines, clean, NEWS, when=news.published)


SOURCES: dict[str, Source] = {}


def add(name: str, source: Source) -> None:
    """A source of the given name; its scan is registered as well."""
    SOURCES[name] = source
    files.register(name, source.read, files.SCANNERS.get(name))


add("mt5", Source(files.price_bars, lambda df: prices.epoch_bars(df, files.POSITION), OHLCV, lambda: {"ohlc_consistent": ~ohlc_consistent()}))
add("ecb_exchange_rates", Source(files.exchange_rates, lambda df: prices.synthetic_bars(df, files.POSITION), OHLCV, lambda: {"ohlc_consistent": ~ohlc_consistent()}))
add("fred", Source(files.series, lambda df: macro.series(df, files.POSITION), MACRO))
add("ecb_policy_rates", Source(files.policy_rates, lambda df: macro.policy_rates(df, files.POSITION), MACRO))
add("calendar", Source(files.calendar, lambda df: calendar.events(df, files.POSITION), EVENTS))
add("documents", documents())
