"""Benchmark decontamination with SimHash of item-sized windows.

A window of a document has as many words as the benchmark item it is compared
with.  Its 128-bit SimHash is looked up in a multi-index: the fingerprint is cut
into 8 blocks of 16 bits; two fingerprints within 31 bits differ by at most 3
bits in some block, so a window looks in each block's table under its own
16-bit value and all values within 3 bits of it.  So every item within the
radius is a candidate.
Candidates are verified by the exact similarity of the two bags of five-word
shingles (sum of the smaller counts over sum of the larger ones), at least 0.8.

Windows that cannot reach 0.8 are not hashed: a window must have the benchmark's
shingles in 2t / (1 + t) of its places.  Moving a window's start to the next
such shingle never lowers the similarity, so windows start there only; at a
document's end a window may be shorter.

Words are runs of letters, digits and bytes beyond ASCII, A-Z in lower case.
Items of fewer than five words are one shingle.  Equal texts are one item in the
index and get their ids back by a join.  An index takes ``ITEM_BYTES`` of item
texts (some 100,000 questions); only a larger benchmark costs another scan of the
documents for each so many bytes, so memory does not grow with it.

Defined results: null or empty text or item never matches; repeated documents
match alike and repeated items each; other columns are ignored by ``leaks`` and
pass through ``without_leaks``; an empty table on either side gives no matches.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import slices, table
from tidemark.llm.licenses import WORD_BYTES

SIZE, LEAST, RADIUS = 5, 0.8, 31
BLOCKS, BITS = 8, 16
#: Bytes of item texts in one index; more take more passes.
ITEM_BYTES = 16 << 20
#: Windows whose candidates are looked up at once.
TOGETHER = 1024
ODD = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0xD6E8FEB86659FD93)

SCHEMA = "doc_id long, text_key string, start_word long, n_words long, similarity double"


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * ODD
    return h ^ (h >> np.uint64(29))


def shingles(word: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of ``size`` words."""
    n = max(0, len(word) - size + 1)
    out = np.zeros(n, np.uint64)
    for k in range(size):
        out = out * BASE + word[k : k + n]
    return mixed(out)


def words_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word of all texts in order, number of words of each text)."""
    parts = [(t or "").encode().translate(WORD_BYTES).split() for t in texts]
    coded = pa.array([w for p in parts for w in p], pa.binary()).dictionary_encode()
    value = np.array([xxh64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    sizes = np.array([len(p) for p in parts], np.int64)
    return (value[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.uint64)), sizes


def simhash(shingle: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """128-bit fingerprints, as 16 bytes a row, of the runs of shingles that begin at ``starts``."""
    both = np.stack([shingle, mixed(shingle + ODD)], axis=1).view(np.uint8)
    n = np.diff(np.append(starts, len(shingle)))
    out = np.zeros((len(starts), 16), np.uint8)
    for low in range(0, len(starts), 4096):  # bounds the table of single bits
        high = min(len(starts), low + 4096)
        a, b = starts[low], starts[high] if high < len(starts) else len(shingle)
        bits = np.add.reduceat(np.unpackbits(both[a:b], axis=1), starts[low:high] - a, axis=0, dtype=np.int32)
        out[low:high] = np.packbits(2 * bits > n[low:high, None], axis=1)
    return out


#: All differences of a block that the radius leaves to the closest one.
FLIPS = np.array([sum(1 << i for i in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(BITS), r)])


class Index:
    """Some distinct benchmark texts, ready to be searched for."""

    def __init__(self, keys: list[str], texts: list[str | None]):
        word, sizes = words_of(texts)
        ends = np.cumsum(sizes)
        full = np.flatnonzero(sizes)
        self.keys = [keys[k] for k in full.tolist()]
        self.size = sizes[full]
        bags, counts, prints, pairs = [], [], [], {}
        for size, end in zip(self.size.tolist(), ends[full].tolist(), strict=True):
            k = min(SIZE, size)
            own = shingles(word[end - size : end], k)
            bag, count = np.unique(own, return_counts=True)
            bags.append(bag)
            counts.append(count)
            prints.append(simhash(own, np.array([0])))
            pairs.setdefault(k, []).append((bag, size))
        self.bag, self.count = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (bags, counts))
        self.cut = np.append(0, np.cumsum([len(b) for b in bags])).astype(np.int64)
        self.prints = np.concatenate(prints) if prints else np.zeros((0, 16), np.uint8)
        #: by shingle size: known shingles, a small table that rules most others out, and the items' lengths for each
        self.known: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, own in sorted(pairs.items()):
            both = np.stack([np.concatenate([b for b, _ in own]), np.repeat(np.array([n for _, n in own], np.uint64), [len(b) for b, _ in own])])
            both = both[:, np.lexsort(both[::-1])]
            both = both[:, np.append(True, (np.diff(both) != 0).any(axis=0))]
            known, first = np.unique(both[0], return_index=True)
            maybe = np.zeros(1 << 20, bool)
            maybe[(known & np.uint64(0xFFFFF)).astype(np.int64)] = True
            self.known[k] = known, maybe, np.append(first, both.shape[1]), both[1].astype(np.int64)
        self.tables = []  # by block: where each 16-bit value's items begin, and the items
        for value in self.blocks(self.prints):
            self.tables.append((np.append(0, np.cumsum(np.bincount(value, minlength=1 << BITS))), np.argsort(value, kind="stable").astype(np.int32)))

    @staticmethod
    def blocks(prints: np.ndarray) -> list[np.ndarray]:
        return [prints[:, 2 * b].astype(np.int64) << 8 | prints[:, 2 * b + 1] for b in range(BLOCKS)]

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) for all items within RADIUS bits of the window's fingerprint."""
        pairs = []
        for value, (starts, own) in zip(self.blocks(prints), self.tables, strict=True):
            near = (value[:, None] ^ FLIPS[None, :]).ravel()
            low, n = starts[near], starts[near + 1] - starts[near]
            hit = np.flatnonzero(n)
            low, n, window = low[hit], n[hit], hit // len(FLIPS)
            ends = np.cumsum(n)
            pairs.append(np.repeat(window, n) << 32 | own[np.repeat(low - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)])
        pair = np.unique(np.concatenate(pairs))
        window, item = pair >> 32, pair & 0xFFFFFFFF
        off = np.bitwise_count(prints[window].view(np.uint64) ^ self.prints[item].view(np.uint64)).sum(axis=1)
        return window[off <= RADIUS], item[off <= RADIUS]

    def similarity(self, window: np.ndarray, item: int) -> float:
        """Of the bags of a window's shingles and of an item's: the smaller counts' sum over the larger ones'."""
        bag, count = self.bag[self.cut[item] : self.cut[item + 1]], self.count[self.cut[item] : self.cut[item + 1]]
        seen, n = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(bag, seen), len(bag) - 1)
        both = int(np.minimum(n, np.where(bag[at] == seen, count[at], 0)).sum())
        return both / (len(window) + int(count.sum()) - both)

    def search(self, texts: list[str | None]) -> list[tuple[int, int, int, int, float]]:
        """(text, item, first word, words, similarity): the best window for each text and item that match."""
        word, sizes = words_of(texts)
        cuts = np.append(0, np.cumsum(sizes))
        best: dict[tuple[int, int], tuple[float, int, int]] = {}
        for k, (keys, maybe, first, lengths) in self.known.items():
            shingle = shingles(word, k)
            if not len(shingle):
                continue
            at = np.flatnonzero(maybe[(shingle & np.uint64(0xFFFFF)).astype(np.int64)])
            text = np.searchsorted(cuts, at, side="right") - 1
            inside = at + k <= cuts[text + 1]
            at, text = at[inside], text[inside]
            key = np.minimum(np.searchsorted(keys, shingle[at]), len(keys) - 1)
            known = keys[key] == shingle[at]
            at, text, key = at[known], text[known], key[known]
            if not len(at):
                continue
            n = first[key + 1] - first[key]
            ends = np.cumsum(n)
            size = lengths[np.repeat(first[key] - (ends - n), n) + np.arange(ends[-1])]
            start, owner = np.repeat(at, n), np.repeat(text, n)
            whole = size - k + 1
            stop = np.minimum(start + whole, cuts[owner + 1] - k + 1)
            have = np.searchsorted(at, stop) - np.searchsorted(at, start)
            enough = have * (1 + LEAST) >= LEAST * (whole + stop - start) - 1e-9
            start, stop, owner, size = start[enough], stop[enough], owner[enough], size[enough]
            for low in range(0, len(start), TOGETHER):
                s, e, o, z = (x[low : low + TOGETHER] for x in (start, stop, owner, size))
                n = e - s
                ends = np.cumsum(n)
                flat = shingle[np.repeat(s - (ends - n), n) + np.arange(ends[-1])]
                window, item = self.candidates(simhash(flat, ends - n))
                fits = self.size[item] == z[window]
                for w, i in zip(window[fits].tolist(), item[fits].tolist(), strict=True):
                    alike = self.similarity(shingle[s[w] : e[w]], i)
                    where = (alike, -int(s[w] - cuts[o[w]]), int(n[w]) + k - 1)
                    if alike >= LEAST and where > best.get((int(o[w]), i), (0.0, 0, 0)):
                        best[int(o[w]), i] = where
        return [(t, i, -minus, words, alike) for (t, i), (alike, minus, words) in sorted(best.items())]


def with_keys(benchmark: DataFrame) -> DataFrame:
    """item_id, text and a key of the text; an item without text has none."""
    text = F.col("text").cast("string")
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), text.alias("text"), F.md5(text.cast("binary")).alias("text_key"))


def passes(benchmark: DataFrame) -> Iterator[Index]:
    """Indexes of about ``ITEM_BYTES`` of distinct texts each; a single longer text makes a longer one."""
    texts = with_keys(benchmark).where("text is not null").groupBy("text_key").agg(F.min("text").alias("text"))
    parts = max(1, -(-(texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // ITEM_BYTES))
    for part in range(parts):
        own = texts.where(F.pmod(F.xxhash64("text_key"), F.lit(parts)) == part) if parts > 1 else texts
        rows = sorted((r["text_key"], r["text"]) for r in own.collect())  # about ITEM_BYTES
        yield Index([r[0] for r in rows], [r[1] for r in rows])


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, and the best window (first word, words, similarity) of each match."""
    out = None
    for index in passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches):
                rows = index.search(batch.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array([r[0] for r in rows], pa.int64())), pa.array([index.keys[r[1]] for r in rows], pa.string()), *(pa.array([r[c] for r in rows], t) for c, t in ((2, pa.int64()), (3, pa.int64()), (4, pa.float64())))],
                    ["doc_id", "text_key", "start_word", "n_words", "similarity"],
                )

        found = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)
        out = found if out is None else out.unionByName(found)
    ids = with_keys(benchmark).select("item_id", "text_key")
    return out.join(ids, "text_key").select("doc_id", "item_id", "start_word", "n_words", "similarity")


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that match an item."""
    column = docs.columns.index("text")
    for index in passes(benchmark):

        def run(batches: Iterator[pa.RecordBatch], index: Index = index) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, column):
                keep = np.ones(batch.num_rows, bool)
                keep[[r[0] for r in index.search(batch.column(column).to_pylist())]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
