"""Central-bank and graph news."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.classify import source_currency
from tidemark.functions.ids import article_id, url_hash
from tidemark.functions.text import blank_to_null, clean_text, credibility_tier, split_list
from tidemark.functions.times import compact_timestamp, iso
from tidemark.operators.dedup import deduplicated

#: What a theme list must hold.
ECONOMY, CURRENCIES = ("ECON_CURRENCY", "ECON_CENTRAL_BANK"), ("EUR", "USD", "GBP", "JPY")


def shown_time() -> Column:
    """The time that a landed document gives: when it was published, else when it was collected."""
    return F.coalesce(*(blank_to_null(F.col(c).cast("string")) for c in ("timestamp_published", "timestamp_collected")))


def published() -> Column:
    return F.try_to_timestamp(shown_time())


def articles(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(articles, rejected rows): documents with title, source and a time -> article rows, before scoring."""
    text = lambda c: blank_to_null(F.col(c).cast("string"))
    good = text("title").isNotNull() & text("source").isNotNull() & shown_time().isNotNull()
    stamp = published()
    source = F.lower(text("source"))
    out = docs.where(good).select(
        stamp.alias("timestamp_utc"),
        article_id(F.col("url"), source, F.col("title"), iso(stamp)).alias("article_id"),
        source_currency(source).alias("currency"),
        clean_text(F.col("title")).alias("headline"),
        F.coalesce(text("document_type"), F.lit("article")).alias("document_type"),
        F.coalesce(text("speaker"), text("author")).alias("speaker"),
        source.alias("source"),
        text("url").alias("url"),
        *[c for c in docs.columns if c.startswith("_")],
    )
    return out, docs.where(~good)


def deduplicated_articles(found: DataFrame, order: list[str]) -> DataFrame:
    return deduplicated(found, ["article_id"], order)


def wanted_themes(themes: str = "themes") -> Column:
    any_of = lambda words: F.array_contains(F.array(*(F.col(themes).contains(w) for w in words)), True)
    return any_of(ECONOMY) & any_of(CURRENCIES)


def graph_documents(rows: DataFrame, order: list[str]) -> DataFrame:
    """Knowledge-graph rows -> nested documents, first of equal URLs."""
    out = rows.where(F.coalesce(F.col("url"), F.lit("")) != "").select(
        F.lit("gdelt").alias("source"),
        compact_timestamp(F.col("date")).alias("timestamp_published"),
        "url",
        "source_domain",
        "tone",
        *(split_list(F.col(c)).alias(c) for c in ("themes", "locations", "organizations")),
        F.struct(credibility_tier(F.col("source_domain")).alias("credibility_tier"), url_hash(F.col("url")).alias("url_hash")).alias("metadata"),
        *order,
    )
    return deduplicated(out, ["url"], order).drop(*order)


#: The order of graph documents: tier, time, hash.
PRIORITY = ["metadata.credibility_tier", "timestamp_published", "metadata.url_hash"]


def by_priority(docs: DataFrame) -> DataFrame:
    return docs.orderBy(*PRIORITY)


def fresh(found: DataFrame, known: DataFrame, key: str, order: list[str]) -> DataFrame:
    """What is not known yet, first discovery only."""
    return deduplicated(found.join(known.select(key).where(F.col(key) != "").distinct(), key, "left_anti"), [key], order)


def tagged(df: DataFrame, source: str) -> DataFrame:
    """Column names in lower case, and the source's name as a column."""
    return df.toDF(*(c.lower() for c in df.columns)).withColumn("source", F.lit(source))


DOCUMENT = ("source", "timestamp_collected", "timestamp_published", "url", "title", "content", "document_type", "speaker", "metadata")


def document_rows(found: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Collected items -> landed documents: the summary stands in for missing content, Untitled for a missing title, en for a missing language.

    Columns that ``found`` lacks are NULL; ``metadata`` has language, author and summary; ``keep`` names columns that stay beside.
    """
    have = set(found.columns)
    text = lambda c: blank_to_null(F.col(c).cast("string")) if c in have else F.lit(None).cast("string")
    own = {c: text(c) for c in DOCUMENT if c != "metadata"}
    own |= {"title": F.coalesce(text("title"), F.lit("Untitled")), "content": F.coalesce(text("content"), text("summary"), F.lit(""))}
    own["metadata"] = F.struct(F.coalesce(text("language"), F.lit("en")).alias("language"), text("author").alias("author"), text("summary").alias("summary"))
    return found.select(*keep, *(own[c].alias(c) for c in DOCUMENT))


def by_speaker(docs: DataFrame, name: str) -> DataFrame:
    """Documents whose speaker's name contains ``name``."""
    return docs.where(F.col("speaker").contains(name))
