"""Language-model scores by deleted interpolation.

The probability of a word after its history (the word before it, or the end of
the text before) is a mixture of three estimates: the pair's share of the
history's count, the word's share of all tokens, and an even share of the
vocabulary.  The weights depend on how often the history was seen: one set for
each power of two.  They are learned by expectation-maximisation on the tokens
of a part of the learning documents that is kept out of the counts
(``deleted``); afterwards the counts of all learning documents are used.

Texts are turned into shards of about ``SHARD_TOKENS`` tokens, each with its
own list of distinct words (as 64-bit hashes) and a place in it per token.
A shard asks for the counts of its distinct words and pairs; the keys are dealt
out by ranges of their hash, packed, so a key that every text holds costs one
entry per shard.  Each range sums what the shards counted and answers them, and
the answers meet the shard again.  There are as many ranges as keep one at
about ``RANGE_KEYS`` entries, so nothing grows with the data but their number.

Hashes stand for words and pairs; that one of a shard's keys meets another of
the corpus by chance has odds of about (distinct keys) / 2**63 a key.  The
tokens on which weights are learned are summed into cells of
(frequency class, pair estimate, word estimate) with ``STEPS`` steps an octave,
of which there are at most some 64 * 320 * 320, with the means of each cell.

Defined results: null text is empty and has its end as only token; rows without
an id learn and are not held out; repeated rows count each time; where nothing
is learned all weights are even and the score is 0; other columns are
ignored; an empty table gives an empty table.  Whole texts only.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import give_back, slices, stored, table

#: Tokens of a shard (a longer text is a shard of its own), and keys that a range of hashes holds, about.
SHARD_TOKENS, RANGE_KEYS = 1 << 21, 1 << 21
#: Frequency classes of a history: the bits of its count. Steps an octave in which estimates are summed for the weights.
CLASSES, STEPS = 64, 8
#: Rounds of expectation-maximisation, and the events that each weight is given beforehand, so that none becomes zero.
ROUNDS, PRIOR = 60, 1.0

SHARDS = "shard long, deleted boolean, n_docs long, n_tokens long, doc_ids binary, learns binary, sizes binary, words binary, places binary"
ASKS = "bucket long, shard long, deleted boolean, keys binary, counts binary"
ANSWERS = "shard long, bucket long, deleted boolean, counts binary, kept binary, n_words long, n_learned long, n_kept long"
CELLS = "class long, pair long, word long, n double, pair_sum double, word_sum double"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"

#: Key of the end of a text: no word holds a space.
END = xxhash.xxh64_intdigest(b" ") & ~1


def packed(x: np.ndarray) -> bytes:
    """Numbers by planes of bytes, of which the high ones are nearly constant."""
    return zstandard.ZstdCompressor(level=1).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()) if len(x) else b""


def unpacked(data: bytes, kind: str) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def words_of(text: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hashes of distinct words, end included, a place in them per token, tokens per text)."""
    n = len(text)
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(text.cast(pa.string()), "")))
    flat, owner = pc.list_flatten(parts), np.asarray(pc.list_parent_indices(parts)).astype(np.int64)
    real = np.asarray(pc.not_equal(flat, ""))
    coded = flat.filter(pa.array(real)).dictionary_encode()
    owner = owner[real]
    digest = xxhash.xxh64_intdigest
    words = np.array([END, *(digest(w) & ~1 for w in coded.dictionary.to_pylist())], np.uint64)
    sizes = np.bincount(owner, minlength=n) + 1
    places = np.insert(np.asarray(coded.indices).astype(np.uint32) + np.uint32(1), np.cumsum(sizes - 1), 0)
    return words, places, sizes.astype(np.int64)


def shards(docs: DataFrame, learns: Column, deleted: Column) -> DataFrame:
    """``docs`` as tokens: shards of the deleted documents, and shards of all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        held: dict[bool, list[tuple]] = {False: [], True: []}

        def close(kind: bool) -> pa.RecordBatch:
            nonlocal made
            parts, held[kind] = held[kind], []
            every = np.concatenate([p[2] for p in parts])
            words, place = np.unique(every, return_inverse=True)
            shift = np.cumsum([0, *(len(p[2]) for p in parts[:-1])])
            places = np.concatenate([place[s + p[3]] for s, p in zip(shift, parts, strict=True)])
            order = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")  # frequent words first: small numbers pack well
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words))
            used = np.bincount(places, minlength=len(words)) > 0
            sizes = np.concatenate([p[4] for p in parts])
            row = [task << 24 | made, kind, len(sizes), len(places), packed(np.concatenate([p[0] for p in parts])), packed(np.concatenate([p[1] for p in parts])), packed(sizes), packed(words[order][: used.sum()]), packed(rank[places])]
            made += 1
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), *[pa.binary()] * 5]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], [c.split()[0] for c in SHARDS.split(", ")])

        for batch in slices(batches):
            words, places, sizes = words_of(batch.column(1))
            ids, none = batch.column(0), np.asarray(pc.is_null(batch.column(0)))
            ids = np.asarray(pc.fill_null(ids, 0)).astype(np.int64)
            learn, drop = (np.asarray(batch.column(c)).astype(bool) for c in (2, 3))
            flags = (learn | none * 2).astype(np.uint8)
            of = np.repeat(np.arange(len(sizes)), sizes)
            for kind in (False, True):
                docs_in = drop == kind
                if docs_in.any():
                    held[kind].append((ids[docs_in], flags[docs_in], words, places[docs_in[of]], sizes[docs_in]))
                    if sum(len(p[3]) for p in held[kind]) >= SHARD_TOKENS:
                        yield close(kind)
        for kind in held:
            if held[kind]:
                yield close(kind)
        give_back()

    no = F.lit(False)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(learns, no).alias("learns"), F.coalesce(learns & deleted, no).alias("deleted"))
    return stored(rows.mapInArrow(run, SHARDS))


class Shard:
    """A shard's tokens, opened."""

    def __init__(self, row: dict):
        self.words, self.places = unpacked(row["words"], "<u8"), unpacked(row["places"], "<u4").astype(np.int64)
        self.doc_ids, self.flags, self.sizes = unpacked(row["doc_ids"], "<i8"), unpacked(row["learns"], "u1"), unpacked(row["sizes"], "<i8")
        self.first = np.cumsum(self.sizes) - self.sizes
        self.before = np.empty_like(self.places)
        self.before[1:] = self.places[:-1]
        self.before[self.first] = int(np.flatnonzero(self.words == END)[0])
        key = self.words[self.before] * np.uint64(0x9E3779B97F4A7C15) + self.words[self.places]
        key ^= key >> np.uint64(32)
        key *= np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(29)
        self.pairs, self.pair = np.unique(key | np.uint64(1), return_inverse=True)

    @property
    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        """Distinct words and pairs in ascending order, and where each of (words, pairs) stands in it."""
        both = np.concatenate([self.words, self.pairs])
        order = np.argsort(both, kind="stable")
        place = np.empty(len(both), np.int64)
        place[order] = np.arange(len(both))
        return both[order], place

    def learned(self) -> np.ndarray:
        """How often words and pairs stand in learning texts."""
        on = np.repeat(self.flags & 1, self.sizes).astype(bool)
        return np.concatenate([np.bincount(self.places[on], minlength=len(self.words)), np.bincount(self.pair[on], minlength=len(self.pairs))])


def _rows(table: pa.Table | pa.RecordBatch) -> Iterator[dict]:
    for k in range(table.num_rows):
        yield {c: table.column(c)[k].as_py() for c in table.schema.names}


def asks(tokens: DataFrame, bits: int) -> DataFrame:
    """Each shard's distinct keys with their learned counts, by range of the key's first ``bits`` bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                shard = Shard(row)
                keys, place = shard.keys
                counts = np.empty(len(keys), np.uint32)
                counts[place] = shard.learned()
                ranges = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
                edge = np.flatnonzero(np.diff(ranges, prepend=-1)).tolist()
                ends = [*edge[1:], len(keys)]
                n = len(edge)
                data = [pa.array(ranges[edge]), pa.array([row["shard"]] * n, pa.int64()), pa.array([row["deleted"]] * n), pa.array([packed(keys[a:b]) for a, b in zip(edge, ends, strict=True)], pa.binary()), pa.array([packed(counts[a:b]) for a, b in zip(edge, ends, strict=True)], pa.binary())]
                yield pa.RecordBatch.from_arrays(data, ["bucket", "shard", "deleted", "keys", "counts"])
        give_back()

    return tokens.mapInArrow(run, ASKS)


def answered(asked: pa.Table) -> pa.Table:
    """One range's answers to all shards: counts over all learning texts, and over those not deleted."""
    keys = [unpacked(k, "<u8") for k in asked["keys"].to_pylist()]
    own = [unpacked(c, "<u4").astype(np.float64) for c in asked["counts"].to_pylist()]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    n = np.bincount(at, weights=np.concatenate(own), minlength=len(every)).astype(np.int64)
    kept = np.concatenate([np.zeros_like(x) if d else x for x, d in zip(own, asked["deleted"].to_pylist(), strict=True)])
    kept = np.bincount(at, weights=kept, minlength=len(every)).astype(np.int64)
    word = (every & np.uint64(1)) == 0
    cuts = np.cumsum([0, *map(len, keys)])
    rows = len(keys)
    once = [[int(x)] + [0] * (rows - 1) for x in (((n > 0) & word).sum(), n[word].sum(), kept[word].sum())]
    each = [[packed(x[at[a:b]]) for a, b in zip(cuts, cuts[1:], strict=False)] for x in (n, kept)]
    arrays = [asked["shard"].combine_chunks(), asked["bucket"].combine_chunks(), asked["deleted"].combine_chunks(), *(pa.array(x, pa.binary()) for x in each), *(pa.array(x, pa.int64()) for x in once)]
    give_back()
    return pa.Table.from_arrays(arrays, ["shard", "bucket", "deleted", "counts", "kept", "n_words", "n_learned", "n_kept"])


def answers(tokens: DataFrame) -> DataFrame:
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    bits = (total // RANGE_KEYS).bit_length()
    return stored(asks(tokens, bits).groupBy("bucket").applyInArrow(answered, ANSWERS))


@dataclass(frozen=True)
class Mixture:
    """Weights of the pair, word and even estimates by the history's frequency class; tokens and distinct words learned."""

    weights: np.ndarray
    n_learned: int
    n_words: int

    def __call__(self, history: np.ndarray, pair: np.ndarray, word: np.ndarray) -> np.ndarray:
        """Probability of a token from the counts of its history, its pair and itself."""
        w = self.weights[classes(history)]
        return w[:, 0] * pair / np.maximum(history, 1) + w[:, 1] * word / max(self.n_learned, 1) + w[:, 2] / (self.n_words + 1)


def classes(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1] * (counts > 0)


def _met(tokens: DataFrame, replies: DataFrame, each, schema: str) -> DataFrame:  # noqa: ANN001
    """``each(shard, counts of words and pairs, those not deleted)`` for every shard with its answers."""

    def run(shard_row: pa.Table, found: pa.Table) -> pa.Table:
        shard = Shard(next(_rows(shard_row)))
        order = np.argsort(found["bucket"].to_numpy())
        place = shard.keys[1]
        n, kept = (np.concatenate([unpacked(x[k].as_py(), "<i8") for k in order.tolist()])[place] for x in (found["counts"], found["kept"]))
        out = each(shard, n, kept)
        give_back()
        return out

    mine, theirs = tokens.drop("deleted", "n_docs", "n_tokens"), replies.select("shard", "bucket", "counts", "kept")
    return mine.groupBy("shard").cogroup(theirs.groupBy("shard")).applyInArrow(run, schema)


def cells(tokens: DataFrame, replies: DataFrame, n_kept: int) -> DataFrame:
    """The tokens of deleted documents, summed by frequency class and steps of the two estimates from what is not deleted."""

    def step(p: np.ndarray) -> np.ndarray:
        return np.where(p > 0, np.floor(-STEPS * np.log2(np.where(p > 0, p, 1.0))), -1).astype(np.int64)

    def each(shard: Shard, _: np.ndarray, kept: np.ndarray) -> pa.Table:
        n_words = len(shard.words)
        history = kept[shard.before]
        pair = kept[n_words + shard.pair] / np.maximum(history, 1)
        word = kept[shard.places] / max(n_kept, 1)
        key = (classes(history).astype(np.int64) << 40) | (step(pair) + 1 << 20) | (step(word) + 1)
        every, at = np.unique(key, return_inverse=True)
        sums = [np.bincount(at, weights=x, minlength=len(every)) for x in (None, pair, word)]
        return pa.table({"class": every >> 40, "pair": (every >> 20 & 0xFFFFF) - 1, "word": (every & 0xFFFFF) - 1, "n": sums[0].astype(float), "pair_sum": sums[1], "word_sum": sums[2]})

    found = _met(tokens.where("deleted"), replies.where("deleted"), each, CELLS)
    return found.groupBy("class", "pair", "word").agg(*(F.sum(c).alias(c) for c in ("n", "pair_sum", "word_sum")))


def mixture_weights(rows: np.ndarray, even: float) -> np.ndarray:
    """Weights by class from (class, n, mean pair estimate, mean word estimate); a class without events takes the next lower one's, else the next higher's."""
    out, seen = np.full((CLASSES + 1, 3), 1 / 3), []
    for c in range(CLASSES + 1):
        _, n, pair, word = rows[rows[:, 0] == c].T
        if not len(n):
            continue
        seen.append(c)
        p = np.stack([pair, word, np.full(len(n), even)])
        prior = np.array([PRIOR if c else 0.0, PRIOR, PRIOR])  # what was never seen has no pairs
        w = prior / prior.sum()
        for _ in range(ROUNDS):
            share = w[:, None] * p
            w = prior + (n * share / share.sum(axis=0)).sum(axis=1)
            w = w / w.sum()
        out[c] = w
    for c in range(CLASSES + 1):
        if c not in seen:
            near = [s for s in seen if 0 < s < c][-1:] or [s for s in seen if s > c][:1]
            out[c] = out[near[0]] if near and c else [0, 0.5, 0.5] if not c else out[c]
    return out


def mixture(tokens: DataFrame, replies: DataFrame) -> Mixture:
    sums = replies.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n_words", "n_learned", "n_kept"))).first()
    found = cells(tokens, replies, sums["n_kept"]).collect()  # at most a row a cell, see above
    rows = np.array([(r["class"], r["n"], r["pair_sum"] / r["n"], r["word_sum"] / r["n"]) for r in sorted(found)], float).reshape(-1, 4)
    return Mixture(mixture_weights(rows, 1 / (sums["n_words"] + 1)), sums["n_learned"], sums["n_words"])


def scored(tokens: DataFrame, replies: DataFrame, model: Mixture) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score and score of each document."""

    def each(shard: Shard, n: np.ndarray, _: np.ndarray) -> pa.Table:
        word = n[shard.places]
        base = np.log10((word + 1) / (model.n_learned + model.n_words + 1))
        score = np.log10(model(n[shard.before], n[len(shard.words) + shard.pair], word))
        sums = [np.add.reduceat(x, shard.first) for x in ((word > 0).astype(np.int64), base, score)]
        return pa.Table.from_arrays([pa.array(shard.doc_ids, mask=shard.flags > 1), pa.array(shard.sizes), *map(pa.array, sums)], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return _met(tokens, replies, each, SCORES)


def op12_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all ``documents``; those whose crc32(doc_id) mod 7 is 2 are held out, those where it is 3 only weigh the mixture until it is learned."""
    docs = table(spark, sf_dir, "documents")
    rest = lambda: F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7
    held = F.coalesce(rest() == 2, F.lit(False))
    tokens = shards(docs, ~held, rest() == 3)
    replies = answers(tokens)
    model = mixture(tokens, replies)
    out = scored(tokens, replies, model)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n_learned).cast("long").alias("train_tokens"), "base_score", "score")
