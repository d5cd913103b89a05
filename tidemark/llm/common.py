"""What the operators of this subpackage share: tables, scratch space, Arrow batches."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from tidemark.session import spread

#: Text bytes that a Python worker works on at once; bounds its memory.
SLICE_BYTES = 4 << 20


#: What a task hands its Python worker at once, unless the session says otherwise: several copies of it live on both sides.
HANDED = ("spark.sql.execution.arrow.maxBytesPerBatch", "64m", "8m")


def bounded(spark: SparkSession) -> None:
    """Smaller Arrow batches, where the session has Spark's own size."""
    name, given, ours = HANDED
    if spark.conf.get(name, given).rstrip("b") in (given, str(64 << 20)):
        spark.conf.set(name, ours)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded(spark)
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def scratch(spark: SparkSession) -> str:
    """A new path in the folder that the cluster shares (``spark.checkpoint.dir``).

    Only where the setting is absent and all runs on this machine, as in local tests, a temporary folder is set.
    """
    bounded(spark)
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the whole cluster shares")
        root = tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read back.

    Cuts the lineage: a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = path or scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def slices(batches: Iterator[pa.RecordBatch], column: int = 1, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the strings of ``column`` take about ``most`` bytes; a longer row stands alone.

    At the end freed memory goes back to the system.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = batch.column(column)
        lengths = pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False)
        part = np.cumsum(lengths.astype(np.int64)) // most
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for low, high in zip(cuts, cuts[1:], strict=False):
            if high > low:
                yield batch.slice(low, high - low)
    give_back()


def give_back() -> None:
    """Return freed memory to the system: workers live on, and the next task may be another operator's."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of Linux has it
    if trim is not None:
        trim(0)
