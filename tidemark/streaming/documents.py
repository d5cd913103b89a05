"""Repeated collection as streams: documents never seen before, and partition sinks that may run again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.ids import article_id


def landed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def new_documents(stream: DataFrame, ts: str, delay: str = "40 days") -> DataFrame:
    """First row of each article id; ids are forgotten once the watermark has passed them."""
    keyed = stream.withColumn("article_id", article_id(F.col("url"), F.col("source"), F.col("title"), F.col(ts).cast("string")))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["article_id"])


def drained(stream: DataFrame, path: str, checkpoint: str, ts: str, source: str = "source") -> None:
    """Write all that is available to Hive partitions and stop.

    Each batch goes to partitions of its own number, so a batch that runs again
    replaces what it had written.
    """

    def put(batch: DataFrame, number: int) -> None:
        keyed = batch.withColumns({"year": F.date_format(ts, "yyyy"), "month": F.date_format(ts, "MM"), "part_source": F.col(source), "batch": F.lit(number)})
        keyed.hint("rebalance", "part_source", "year", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part_source", "year", "month", "batch").parquet(path)

    stream.writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint).foreachBatch(put).start().awaitTermination()
