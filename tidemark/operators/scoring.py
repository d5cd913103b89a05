"""Sentiment scores by a scorer that is plugged in.

A scorer is a picklable factory without arguments; what it returns maps a list
of texts to (label, confidence) pairs.  It is made once per Python worker.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.numbers import signed_score

Scorer = Callable[[list[str]], list[tuple[str, float]]]
BATCH = 32
GOOD = frozenset("growth gain gains strong improve improved rise rises optimistic recovery boost stable".split())
BAD = frozenset("loss losses weak decline fall falls crisis recession worthless risk risks fear default".split())


def lexicon(longest: int | None = None) -> Scorer:
    """Counts of good and bad words; the share of the larger count is the confidence.  All words count unless ``longest`` is given."""

    def score(texts: list[str]) -> list[tuple[str, float]]:
        out = []
        for text in texts:
            words = re.findall(r"[^\W\d_]+", text.lower())[:longest]
            good, bad = sum(w in GOOD for w in words), sum(w in BAD for w in words)
            label = "positive" if good > bad else "negative" if bad > good else "neutral"
            out.append((label, max(good, bad) / (good + bad) if label != "neutral" else 1.0))
        return out

    return score


def scored(df: DataFrame, text: str, factory: Callable[[], Scorer] = lexicon) -> DataFrame:
    """``df`` with sentiment_score and sentiment_label; empty texts are neutral without being shown to the scorer."""
    kind = T.StructType([T.StructField("label", T.StringType()), T.StructField("confidence", T.DoubleType())])

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = factory()
        for batch in batches:
            label, confidence = ["neutral"] * len(batch), [0.0] * len(batch)
            full = [k for k, t in enumerate(batch) if t and t.strip()]
            for low in range(0, len(full), BATCH):
                part = full[low : low + BATCH]
                for k, (name, sure) in zip(part, scorer([batch.iloc[k] for k in part]), strict=True):
                    label[k], confidence[k] = name.lower(), float(sure)
            yield pd.DataFrame({"label": label, "confidence": confidence})

    out = df.withColumn("_s", run(F.col(text)))
    return out.withColumns({"sentiment_score": signed_score(F.col("_s.label"), F.col("_s.confidence")), "sentiment_label": F.col("_s.label")}).drop("_s")
