"""Documents never seen before, over all runs: a state per URL hash that outlives the stream's checkpoint.

Each article id has one state with a time to live.  A new stream starts from the
ids of a stored table, so a document of a run before its checkpoint counts as
seen.  State lies in RocksDB, changes only are checkpointed.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.functions.ids import article_id

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: How long an id is remembered after it was first seen.
DAYS = 400


class FirstOnly(StatefulProcessor):
    """Of the rows of an id the first in order, and that once; nothing if the id came with the stored ones."""

    def __init__(self, columns: list[str], order: list[str], days: int):
        self.columns, self.order, self.ttl = columns, order, days * 86_400_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "at boolean", ttlDurationMs=self.ttl)

    def handleInitialState(self, key: tuple, initialState: Row, timerValues) -> None:  # noqa: ANN001
        self.seen.update((True,))

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: ANN001
        if self.seen.exists():
            for _ in rows:
                pass
            return
        best = min(rows, key=lambda r: [(r[c] is not None, r[c]) for c in self.order])
        self.seen.update((True,))
        yield Row(**{c: best[c] for c in self.columns})

    def close(self) -> None:
        pass


def with_ids(df: DataFrame, ts: str) -> DataFrame:
    return df.withColumn("article_id", article_id(F.col("url"), F.col("source"), F.col("title"), F.col(ts).cast("string")))


def configured(spark: SparkSession) -> None:
    """State in RocksDB; expired state goes with the next batch of data, or a run over what is available would never end."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")


def never_seen(stream: DataFrame, stored: DataFrame | None, ts: str, order: list[str], days: int = DAYS) -> DataFrame:
    """Rows of the stream whose article id neither it nor ``stored`` (with article_id) has had; of several in a batch the first in ``order``.

    ``stored`` is read when the stream starts for the first time; a restart goes on with its checkpoint.  A batch's rows
    of one id are passed by one at a time, so an id may have any number.
    """
    configured(stream.sparkSession)
    keyed = with_ids(stream, ts)
    known = None if stored is None else stored.select("article_id").where("article_id is not null").distinct().groupBy("article_id")
    schema = T.StructType(list(keyed.schema))
    return keyed.groupBy("article_id").transformWithState(FirstOnly(keyed.columns, order, days), schema, "Append", "ProcessingTime" if days else "None", known)
