"""Toxicity by a factorization machine over hashed terms.

Terms of a text are its words (white space apart, marks at the ends cut,
lower case), the words' beginnings of four to six characters, and each such
beginning that several different words share, hashed to ``BUCKETS``.  The score is logistic in b + sum w_i + sum over pairs <v_i, v_j>,
so a pair of terms, such as an insult and the mention of a group, counts beyond
what each of them adds.

Learning: a bounded sample of labelled ids (``SAMPLE_ROWS``, by hash of the id),
one text each, is turned into hashed terms; one task, whose memory the bound
keeps small, fits the machine, and only the machine comes to the driver.
Buckets stay if enough sampled texts have them and they tell toxic texts from
others, among all sampled texts or among those that hold a bucket which does:
so a term that tells nothing by itself may still count in pairs.  Scoring covers
all texts whole.

Defined results: null or empty text has no terms and scores the model's base
rate; without any label of either kind every text scores the share of toxic
rows (0 without labels); a label of null is no label; of several labels of a
document the largest holds, of several texts of a labelled id the first in
order; rows without an id are in no fold (``held_out`` false) and never learned
from; repeated rows score alike; other columns are ignored by ``scored`` and
pass through ``without_toxic``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table

BUCKETS = 1 << 20
#: Labelled rows that the model is fitted on at most.
SAMPLE_ROWS = 6_000
#: Sampled texts that must have a bucket, and how far from chance its share of toxic texts must be.
LEAST_TEXTS, LEAST_Z = 3, 4.0
FACTORS, STEPS, RATE = 4, 200, 0.05
#: L2 penalties of a weight and of a factor, in texts.
PENALTY, FACTOR_PENALTY = 1.0, 20.0
MARKS = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def twice(term: np.ndarray) -> np.ndarray:
    """The term that says that two words of a text share ``term``."""
    return (term * 2654435761 + 40503) & (BUCKETS - 1)


class Terms:
    """Word -> its hashed terms; keeps words it has met."""

    def __init__(self) -> None:
        self.known: dict[str, tuple[int, int, int, int]] = {}

    def of(self, word: str) -> tuple[int, int, int, int]:
        out = self.known.get(word)
        if out is None:
            if len(self.known) > 100_000:
                self.known.clear()
            w = word.strip(MARKS).lower()
            n = len(w)
            whole = zlib.crc32(b"w" + w.encode()) & (BUCKETS - 1) if n else -1
            out = (whole, *(zlib.crc32(b"%d" % k + w[:k].encode()) & (BUCKETS - 1) if n >= k else -1 for k in (4, 5, 6)))
            self.known[word] = out
        return out

    def pairs(self, texts: pa.Array, place: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(text, term) without repeats; terms numbered by ``place`` if given, those it has not (-1) left out."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.string()), ""))
        flat = pc.list_flatten(words)
        owner = np.asarray(pc.list_parent_indices(words)).astype(np.int64)
        coded = flat.dictionary_encode()
        if not len(coded.dictionary):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        terms = np.array([self.of(w) for w in coded.dictionary.to_pylist()], np.int64)
        useful = terms >= 0
        if place is not None:
            useful &= (place[terms] >= 0) | (place[twice(terms)] >= 0)
        at = np.asarray(coded.indices).astype(np.int64)
        has = useful.any(axis=1)[at]
        word = np.unique(owner[has] << 32 | at[has])  # a word of a text counts once
        owner, at = word >> 32, word & 0xFFFFFFFF
        pair, count = np.unique((owner[:, None] << 32 | terms[at])[useful[at]], return_counts=True)
        more = pair[count > 1]
        pair = np.unique(np.append(pair, more >> 32 << 32 | twice(more & 0xFFFFFFFF)))
        text, term = pair >> 32, pair & 0xFFFFFFFF
        if place is not None:
            term = place[term].astype(np.int64)
            text, term = text[term >= 0], term[term >= 0]
        return text, term


class Machine:
    """A fitted model: the buckets it knows, their weights and factors."""

    def __init__(self, base: float, buckets: np.ndarray, weights: np.ndarray, factors: np.ndarray):
        self.base, self.buckets, self.weights, self.factors = base, buckets, weights, factors

    def place(self) -> np.ndarray:
        out = np.full(BUCKETS, -1, np.int32)
        out[self.buckets] = np.arange(len(self.buckets))
        return out

    def score(self, n: int, text: np.ndarray, term: np.ndarray) -> np.ndarray:
        total = np.bincount(text, weights=self.weights[term], minlength=n) if len(text) else np.zeros(n)
        for f in range(self.factors.shape[1]):
            v = self.factors[term, f]
            if len(text):
                total = total + 0.5 * (np.bincount(text, weights=v, minlength=n) ** 2 - np.bincount(text, weights=v * v, minlength=n))
        return 1 / (1 + np.exp(-np.clip(self.base + total, -30, 30)))


def is_training(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 != 0


def samples(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """toxic and hashed terms (int32 bytes) of at most ``rows`` labelled documents of the training folds."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & is_training(F.col("doc_id")))
    known = known.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)  # bounded by rows, so it is broadcast

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms()
        for batch in slices(batches):
            text, term = terms.pairs(batch.column(1))
            cuts = np.searchsorted(text, np.arange(batch.num_rows + 1))
            data = term.astype("<i4")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([data[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())], ["doc_id", "toxic", "terms"])

    each = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string")).join(F.broadcast(chosen), "doc_id")
    one = each.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic"))
    return one.mapInArrow(run, "doc_id long, toxic int, terms binary")


def tells(terms: list[bytes], toxic: np.ndarray, least_z: float) -> np.ndarray:
    """By bucket: whether enough of the texts have it and toxic ones more or less often than chance would."""
    have, bad = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for low in range(0, len(terms), 500):  # the sample's terms are never all unpacked at once
        part = slice(low, low + 500)
        one = np.frombuffer(b"".join(terms[part]), "<i4")
        guilty = np.repeat(toxic[part] > 0, [len(t) // 4 for t in terms[part]])
        have += np.bincount(one, minlength=BUCKETS)
        bad += np.bincount(one[guilty], minlength=BUCKETS)
    rate = float(toxic.mean()) if len(toxic) else 0.0
    z = (bad - have * rate) / np.sqrt(np.maximum(have * rate * (1 - rate), 1e-9))
    return (have >= LEAST_TEXTS) & (np.abs(z) >= least_z)


def fitted(terms: list[bytes], toxic: np.ndarray, seed: int = 7, least_z: float = LEAST_Z) -> Machine:
    """Fit by Adam on the whole sample at each step; the same sample gives the same machine."""
    n = len(toxic)
    rate = float(toxic.mean()) if n else 0.0
    none = Machine(float(np.log((rate + 1e-6) / (1 - rate + 1e-6))), np.zeros(0, np.int64), np.zeros(0), np.zeros((0, FACTORS)))
    if not n or rate in (0.0, 1.0):
        return none
    telling = tells(terms, toxic, least_z)
    near = np.array([telling[np.frombuffer(t, "<i4")].any() for t in terms])
    telling |= tells([t for t, ok in zip(terms, near, strict=True) if ok], toxic[near], least_z)
    buckets = np.flatnonzero(telling)
    if not len(buckets):
        return none
    place = np.full(BUCKETS, -1, np.int32)
    place[buckets] = np.arange(len(buckets))
    own = [(x := place[np.frombuffer(t, "<i4")])[x >= 0] for t in terms]
    text, term = np.repeat(np.arange(n), [len(x) for x in own]), np.concatenate(own)
    rng = np.random.default_rng(seed)
    base = none.base
    params = [np.zeros(len(buckets)), rng.normal(0, 0.01, (len(buckets), FACTORS)), np.array([base])]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, STEPS + 1):
        w, v, b = params
        sums = np.stack([np.bincount(text, weights=v[term, f], minlength=n) for f in range(FACTORS)], axis=1)
        squares = np.bincount(text, weights=(v * v).sum(axis=1)[term], minlength=n)
        raw = b[0] + np.bincount(text, weights=w[term], minlength=n) + 0.5 * ((sums * sums).sum(axis=1) - squares)
        off = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - toxic) / n
        grad_w = np.bincount(term, weights=off[text], minlength=len(buckets))
        grad_v = np.stack([np.bincount(term, weights=off[text] * sums[text, f], minlength=len(buckets)) for f in range(FACTORS)], axis=1) - v * grad_w[:, None]
        grads = [grad_w + PENALTY / n * w, grad_v + FACTOR_PENALTY / n * v, np.array([off.sum()])]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            params[k] = params[k] - RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Machine(float(params[2][0]), buckets, params[0], params[1])


MODEL = "base double, buckets binary, weights binary, factors binary"


def learned(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Machine:
    """The machine fitted on the sample, by one task that holds the terms of at most ``rows`` documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = sorted((x for b in batches for x in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda x: x[0])
        m = fitted([x[2] for x in seen], np.array([x[1] for x in seen], float))
        parts = [m.buckets.astype("<i8"), m.weights.astype("<f8"), m.factors.astype("<f8")]
        yield pa.RecordBatch.from_arrays([pa.array([m.base]), *(pa.array([p.tobytes()], pa.binary()) for p in parts)], ["base", "buckets", "weights", "factors"])

    found = samples(docs, labels, rows).repartition(1).mapInArrow(run, MODEL).first()
    if found is None:  # without a single sampled row no task may run
        return fitted([], np.zeros(0))
    return Machine(found["base"], np.frombuffer(found["buckets"], "<i8"), np.frombuffer(found["weights"], "<f8"), np.frombuffer(found["factors"], "<f8").reshape(-1, FACTORS))


def scored(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id and score of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, place = Terms(), machine.place()
        for batch in slices(batches):
            score = machine.score(batch.num_rows, *terms.pairs(batch.column(1), place))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score)], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, score double")


def without_toxic(docs: DataFrame, machine: Machine, at: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``at`` or more."""
    column = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, place = Terms(), machine.place()
        for batch in slices(batches, column):
            score = machine.score(batch.num_rows, *terms.pairs(batch.column(column), place))
            yield batch.filter(pa.array(score < at))

    return docs.mapInArrow(run, docs.schema)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = scored(docs, learned(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", F.coalesce(~is_training(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
