"""A linear scorer that learns: multinomial logistic regression over hashed words, fitted by Spark and applied as an expression.

Texts are scored in chunks of at most ``CHUNK`` words, so a long text weighs no
more in one place than in another: its probabilities are the means of those of
its chunks, weighted by their words.  A chunk's features are the shares of its
words in each bucket.  Learning takes the chunks of labelled texts as rows, all
of a text together weighing one.

Nothing but the weights comes to the driver (labels times ``BUCKETS`` numbers),
and no Python runs where texts are scored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizer, Normalizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.numbers import signed_score

Store = Callable[[DataFrame], DataFrame]

LABELS = ("negative", "neutral", "positive")
#: Buckets of words, words of a chunk, chunks that a bucket must stand in to be learned, rounds of the solver, its penalty and
#: the share of that on absolute weights, which leaves most buckets at zero.
BUCKETS, CHUNK, LEAST, ROUNDS, PENALTY, SPARSE = 1 << 14, 256, 5, 60, 2e-3, 0.9


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text.cast("string"), F.lit(""))), F.lit(r"(\p{L}+)"), F.lit(1))


def buckets(text: Column) -> Column:
    return F.transform(words(text), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(BUCKETS)).cast("int"))


def chunks(found: Column, most: int = CHUNK) -> Column:
    """An array cut into arrays of at most ``most``; an empty one has none."""

    def cut(whole: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(whole), F.lit(1)), F.lit(most))
        return F.when(F.size(whole) > 0, F.transform(starts, lambda s: F.slice(whole, s, most))).otherwise(F.array().cast("array<array<int>>"))

    # the array is bound first: named in the inner function it would be made again for each of its pieces
    return F.get(F.transform(F.array(found), cut), 0)


@dataclass(frozen=True)
class Linear:
    """Weights by label and bucket, and what each label has without any word."""

    weights: np.ndarray
    base: np.ndarray

    def odds(self, chunk: Column) -> Column:
        """By label, of a chunk's buckets: the exponent of base and mean weight."""

        def of(weights: np.ndarray, base: float) -> Column:
            known = F.lit(np.ascontiguousarray(weights))
            raw = F.aggregate(chunk, F.lit(0.0), lambda s, b: s + F.get(known, b)) / F.size(chunk) + F.lit(float(base))
            return F.exp(F.least(F.greatest(raw, F.lit(-50.0)), F.lit(50.0)))

        return F.array(*(of(w, b) for w, b in zip(self.weights, self.base, strict=True)))

    def score(self, df: DataFrame, text: str) -> DataFrame:
        """``df`` with sentiment_score and sentiment_label; texts without a word are neutral with 0."""

        def mean(k: int) -> Column:
            share = lambda c: c["odds"][k] / (c["odds"][0] + c["odds"][1] + c["odds"][2])
            return F.aggregate("_each", F.lit(0.0), lambda s, c: s + c["n"] * share(c)) / F.size("_found")

        cut = df.withColumn("_found", buckets(F.col(text)))
        cut = cut.withColumn("_each", F.transform(chunks(F.col("_found")), lambda c: F.struct(F.size(c).alias("n"), self.odds(c).alias("odds"))))
        cut = cut.withColumn("_mean", F.when(F.size("_found") > 0, F.array(*map(mean, range(len(LABELS)))))).drop("_each", "_found")
        best = F.array_position("_mean", F.array_max("_mean"))
        label = F.coalesce(F.get(F.array(*map(F.lit, LABELS)), (best - 1).cast("int")), F.lit("neutral"))
        score = F.coalesce(signed_score(label, F.array_max("_mean")), F.lit(0.0))
        return cut.withColumns({"sentiment_score": score, "sentiment_label": label}).drop("_mean")


def fitted(df: DataFrame, text: str, label: str, penalty: float = PENALTY, store: Store = lambda rows: rows) -> Linear:
    """Learn from texts with a label of ``LABELS``; rows with another one, or without a word, are left out.

    ``store`` writes the chunks to the shared folder and reads them back: the words are counted, summed up and learned from
    in passes of their own, and texts must not be taken apart for each.
    """
    number = F.array_position(F.array(*map(F.lit, LABELS)), F.col(label)) - 1
    cut = df.select(number.cast("double").alias("label"), chunks(buckets(F.col(text))).alias("chunks")).where("label >= 0")
    rows = store(cut.select("label", (F.lit(1.0) / F.size("chunks")).alias("weight"), F.explode_outer("chunks").alias("chunk")).where("chunk is not null"))
    rows = rows.select("label", "weight", F.col("chunk").cast("array<string>").alias("words"))
    counter = CountVectorizer(inputCol="words", outputCol="counts", vocabSize=BUCKETS, minDF=LEAST).fit(rows)
    shares = Normalizer(p=1.0, inputCol="counts", outputCol="features").transform(counter.transform(rows)).select("label", "weight", "features")
    model = LogisticRegression(family="multinomial", weightCol="weight", maxIter=ROUNDS, regParam=penalty, elasticNetParam=SPARSE).fit(shares)
    weights, base = np.zeros((len(LABELS), BUCKETS)), np.full(len(LABELS), -50.0)
    place = np.array([int(w) for w in counter.vocabulary])
    found = model.coefficientMatrix.toArray()
    weights[: len(found), place] = found
    base[: len(found)] = model.interceptVector.toArray()
    return Linear(weights, base)
