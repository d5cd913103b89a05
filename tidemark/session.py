"""Session settings that the library expects."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: UTC everywhere, re-runs replace only the partitions they write, partition values stay text, plans adapt at run time.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.sources.partitionColumnTypeInference.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def configured(builder: SparkSession.Builder) -> SparkSession:
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores where its scan has fewer tasks than there are cores, as a small file of one row group has.

    For work that costs much a row.  A scan of many files has more tasks than cores and stays as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
