"""Token counts of every prefix of a text, by dynamic programming over byte prefixes.

``token_prefixes`` stores, per document, what each code point adds to the token
count.  Summing the first k steps gives the exact number of tokens of the first
k code points as the tokenizer would encode that prefix alone, so truncation
and budget questions need no second encoding (``tokens_at``, ``longest_within``).

Defined results: null text counts as empty (0 bytes, 0 tokens, empty steps);
null ids and repeated rows pass through as they are; other columns of the input
are ignored, so their names cannot clash; an empty table gives an empty table.
Whole texts only; special strings inside a text count as the library's default
has them (one token).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import bpe
from tidemark.llm.common import slices, table

SCHEMA = "doc_id long, n_bytes long, n_tokens long, cut_chars long, steps binary"


def cut(steps: bytes, budget: int) -> int:
    """Code points in the longest prefix of at most ``budget`` tokens (counts may fall as a prefix grows)."""
    counts = np.cumsum(np.frombuffer(steps, "<i2"), dtype=np.int64)
    within = np.flatnonzero(counts <= budget)
    return int(within[-1]) + 1 if len(within) else 0


def token_prefixes(docs: DataFrame, path: str | None = None, budget: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, cut_chars (longest prefix within ``budget``) and the stored steps of each text."""
    path = path or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = bpe.unit_counts(path)
        for batch in slices(batches, most=bpe.SLICE_BYTES):
            steps, cuts = counts.of(batch.column(1))
            upto = np.append(0, np.cumsum(steps, dtype=np.int64))
            size = np.diff(cuts)
            nth = np.arange(len(steps)) - np.repeat(cuts[:-1], size) + 1
            within = np.where(upto[1:] - np.repeat(upto[cuts[:-1]], size) <= budget, nth, 0)
            fits = np.zeros(batch.num_rows, np.int64)
            fits[size > 0] = np.maximum.reduceat(within, cuts[:-1][size > 0]) if len(within) else 0
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pc.fill_null(pc.binary_length(batch.column(1)), 0).cast(pa.int64()),
                    pa.array(upto[cuts[1:]] - upto[cuts[:-1]]),
                    pa.array(fits),
                    pa.Array.from_buffers(pa.large_binary(), batch.num_rows, [None, pa.py_buffer(cuts * 2), pa.py_buffer(steps)]).cast(pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "cut_chars", "steps"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


@F.pandas_udf(T.LongType())
def _at(steps: pd.Series, chars: pd.Series) -> pd.Series:
    return pd.Series([None if s is None or k is None or k < 0 else int(np.frombuffer(s, "<i2")[: int(k)].sum(dtype=np.int64)) for s, k in zip(steps, chars, strict=True)], dtype="Int64")


@F.pandas_udf(T.LongType())
def _within(steps: pd.Series, budget: pd.Series) -> pd.Series:
    return pd.Series([None if s is None else cut(s, int(b)) for s, b in zip(steps, budget, strict=True)], dtype="Int64")


def tokens_at(steps: Column | str, chars: Column | int) -> Column:
    """Tokens of the first ``chars`` code points (all, where the text is shorter)."""
    return _at(steps, chars if isinstance(chars, Column) else F.lit(chars))


def longest_within(steps: Column | str, budget: Column | int) -> Column:
    """Code points of the longest prefix of at most ``budget`` tokens."""
    return _within(steps, budget if isinstance(budget, Column) else F.lit(budget))


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = token_prefixes(table(spark, sf_dir, "documents"), budget=512)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"), "cut_chars")
