"""Token ids in a binary file format with Re-Pair grammars.

A file holds blocks of consecutive documents.  In each block frequent
neighbouring pairs of symbols are replaced by new symbols, round after round,
until no pair occurs ``LEAST`` times; the block stores the rules, the number of
ids each rule expands to, and the shortened sequence with every document's share
of it, so that any document, or any range of its ids, is decoded without the
rest.  No rule crosses a document's end.

The payload (little-endian): magic ``TMRP2``, byte width of a symbol, then
counts (documents, distinct ids, rules, symbols, ids) as int64, then doc_id int64
and a null byte per document, ids per document and symbols per document uint32,
the distinct ids uint32 (a symbol is a place among these or, behind them, among
the rules), left and right symbol of each rule, expansion length of each rule
uint32, and the symbols.  Payloads are the binary column of a Parquet
table (shard, block, n_docs, n_ids, payload): Spark's committer keeps rewritten
or lost tasks from leaving partial files.

Defined results: null text is empty and gives the end id alone; rows of equal
id, or without one, keep a stable order by a hash of their text; null ids come
first; other columns are ignored; an empty table gives no blocks and reads back
empty.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm import bpe
from tidemark.llm.common import scratch, slices, table

MAGIC = b"TMRP2"
#: A block closes after so many ids; a longer document is a block of its own.
BLOCK_IDS = 1 << 20
#: A pair becomes a rule while a block has so many of it; a rule that fewer than half as many places can take is not made.
LEAST = 16


def repair(ids: np.ndarray, sizes: np.ndarray, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(distinct ids, symbols, symbols per document, rules) of documents' ids, no pair of symbols occurring ``least`` times.

    A symbol is a place among the distinct ids or, behind these, among the
    rules.  Each round counts the pairs exactly and replaces all that are
    frequent; where two of them overlap the more frequent one goes first.
    Replacing never adds to the count of a pair of older symbols, so a place
    whose pair is rare is looked at again only when one of its symbols changes.
    """
    there = np.zeros(int(ids.max()) + 1 if len(ids) else 1, bool)
    there[ids] = True
    alphabet = np.flatnonzero(there)
    seq = (np.cumsum(there, dtype=np.uint32) - np.uint32(1))[ids]
    size = len(seq)
    after, before = np.arange(1, size + 1, dtype=np.int32), np.arange(-1, size, dtype=np.int32)  # places of the symbols that are left
    last = np.zeros(size + 1, bool)
    last[np.cumsum(sizes) - 1] = True
    gone, marked = np.zeros(size, bool), np.zeros(size, bool)
    where, rules = np.flatnonzero(~last[:-1]), np.zeros(0, np.uint64)
    place_bits = np.uint64(size.bit_length())
    while len(where):
        bits = np.uint64((len(alphabet) + len(rules)).bit_length())
        pair = seq[where].astype(np.uint64) << bits | seq[after[where]]
        if place_bits + 2 * bits <= 64:  # pair and place in one number
            key = pair << place_bits | where.astype(np.uint64)
            key.sort()
            pair, where = key >> place_bits, (key & ((np.uint64(1) << place_bits) - np.uint64(1))).astype(np.int64)
        else:
            order = np.argsort(pair, kind="stable")
            where, pair = where[order], pair[order]
        edge = np.flatnonzero(np.append(True, pair[1:] != pair[:-1]))
        count = np.diff(np.append(edge, len(pair)))
        often = np.flatnonzero(count >= least)
        if not len(often):
            break
        often = often[np.argsort(-count[often], kind="stable")]
        n = count[often]
        ends = np.cumsum(n)
        at = where[np.repeat(edge[often] - (ends - n), n) + np.arange(ends[-1])]
        both = at << 23 | np.repeat(np.arange(len(often)), n)  # place and rank; fewer than 2^23 pairs can be frequent in a block
        both.sort()
        at, own = both >> 23, both & ((1 << 23) - 1)
        near = after[at[:-1]] == at[1:]
        first = np.ones(len(at), bool)
        first[:-1] &= ~near | (own[:-1] <= own[1:])
        first[1:] &= ~near | (own[1:] <= own[:-1])
        take, own = at[first], own[first]
        run = np.append(True, after[take[:-1]] != take[1:])  # of equal neighbours every other one
        nth = np.arange(len(take))
        even = (nth - np.maximum.accumulate(np.where(run, nth, 0))) % 2 == 0
        take, own = take[even], own[even]
        useful = np.bincount(own, minlength=len(often)) >= least // 2
        useful[0] = True  # so each round shortens
        take, own = take[useful[own]], own[useful[own]]
        code = pair[edge[often]]
        code = code >> bits << np.uint64(32) | code & ((np.uint64(1) << bits) - np.uint64(1))
        number, known = np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        if len(rules):
            order = np.argsort(rules)
            close = order[np.minimum(np.searchsorted(rules, code, sorter=order), len(rules) - 1)]
            known = rules[close] == code
            number[known] = close[known]
        new = useful & ~known
        number[new] = len(rules) + np.arange(new.sum())
        rules = np.append(rules, code[new])
        other = after[take]
        seq[take] = len(alphabet) + number[own]
        last[take], gone[other] = last[other], True
        after[take] = after[other]
        before[after[other]] = take
        changed = before[take]
        marked[at] = marked[changed[changed >= 0]] = True
        marked[other] = False
        where = np.flatnonzero(marked)
        marked[where] = False
        where = where[~last[where]]
    seq, last = seq[~gone], last[:-1][~gone]
    return alphabet, seq, np.diff(np.flatnonzero(last) + 1, prepend=0), np.stack([rules >> np.uint64(32), rules & np.uint64(0xFFFFFFFF)], axis=1).astype(np.int64)


def expanded_sizes(rules: np.ndarray, first: int) -> np.ndarray:
    size = [1] * first
    for a, b in rules.tolist():
        size.append(size[a] + size[b])
    return np.array(size[first:], np.int64)


def pack(doc_ids: list[int | None], ids: np.ndarray, sizes: np.ndarray) -> bytes:
    alphabet, symbols, share, rules = repair(ids, sizes)
    width = 2 if len(alphabet) + len(rules) <= 1 << 16 else 4
    head = MAGIC + struct.pack("<B5q", width, len(doc_ids), len(alphabet), len(rules), len(symbols), len(ids))
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    null = np.array([d is None for d in doc_ids], np.uint8)
    parts = [known, null, sizes.astype("<u4"), share.astype("<u4"), alphabet.astype("<u4"), rules.astype(f"<u{width}"), expanded_sizes(rules, len(alphabet)).astype("<u4"), symbols.astype(f"<u{width}")]
    return head + b"".join(p.tobytes() for p in parts)


class Block:
    """A payload opened for reading."""

    def __init__(self, data: bytes):
        if data[:5] != MAGIC:
            raise ValueError("not a block of token ids")
        width, docs, plain, rules, symbols, self.n_ids = struct.unpack_from("<B5q", data, 5)
        at = 5 + struct.calcsize("<B5q")

        def take(kind: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(data, kind, count, at)
            at += out.nbytes
            return out

        known, null = take("<i8", docs), take("u1", docs)
        self.doc_ids = [None if n else int(d) for d, n in zip(known, null, strict=True)]
        self.sizes, self.share = take("<u4", docs).astype(np.int64), take("<u4", docs).astype(np.int64)
        self.alphabet = take("<u4", plain)
        self.rules, self.lengths = take(f"<u{width}", 2 * rules).reshape(-1, 2), take("<u4", rules).astype(np.int64)
        self.symbols = take(f"<u{width}", symbols)
        self.cuts = np.append(0, np.cumsum(self.share))
        self.words: np.ndarray | None = None

    def dictionary(self) -> None:
        """All expansions in one array: first the plain ids, then the rules."""
        self.length = np.append(np.ones(len(self.alphabet), np.int64), self.lengths)
        self.start = np.cumsum(self.length) - self.length
        data = self.alphabet.tobytes()
        words = [data[k : k + 4] for k in range(0, len(data), 4)]
        for a, b in self.rules.tolist():
            words.append(words[a] + words[b])
        self.words = np.frombuffer(b"".join(words), "<u4")

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        if self.words is None:
            self.dictionary()
        size = self.length[symbols]
        total = np.cumsum(size)
        if not len(total):
            return np.zeros(0, np.uint32)
        return self.words[np.repeat(self.start[symbols] - (total - size), size) + np.arange(total[-1])]

    def document(self, k: int, low: int = 0, high: int | None = None) -> np.ndarray:
        """Ids ``low`` to ``high`` of the k-th document; only the symbols that reach into the range are expanded."""
        symbols = self.symbols[self.cuts[k] : self.cuts[k + 1]]
        if self.words is None:
            self.dictionary()
        ends = np.cumsum(self.length[symbols])
        high = int(self.sizes[k]) if high is None else min(high, int(self.sizes[k]))
        a, b = np.searchsorted(ends, low, side="right"), np.searchsorted(ends, high, side="left") + 1
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b])[low - before : max(low, high) - before]


BLOCKS = "shard long, block long, n_docs long, n_ids long, payload binary"


def write_ids(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int = 0) -> None:
    """Encode whole texts, append ``end_id`` to each, and write the blocks in ascending order of doc_id."""
    tokenizer = tokenizer or bpe.default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units = bpe.unit_ids(tokenizer)
        shard, block = TaskContext.get().partitionId(), 0
        doc_ids: list[int | None] = []
        held: list[np.ndarray] = []
        size = 0

        def close() -> pa.RecordBatch:
            data, sizes = np.concatenate(held), np.array([len(h) for h in held])
            row = [(shard, pa.int64()), (block, pa.int64()), (len(held), pa.int64()), (len(data), pa.int64()), (pack(doc_ids, data, sizes), pa.binary())]
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in row], ["shard", "block", "n_docs", "n_ids", "payload"])

        for batch in slices(batches, most=bpe.SLICE_BYTES):
            ids, cuts = units.of(batch.column(1))
            ids = np.insert(ids.astype(np.uint32), cuts[1:], end_id)
            cuts = cuts + np.arange(len(cuts))
            for doc_id, low, high in zip(batch.column(0).to_pylist(), cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if held and size + high - low > BLOCK_IDS:
                    yield close()
                    block += 1
                    doc_ids, held, size = [], [], 0
                doc_ids.append(doc_id)
                held.append(ids[low:high])
                size += high - low
        if held:
            yield close()

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    # rows of one id, or without one, are dealt out by their text, so they need not lie in one task
    order = [F.asc_nulls_first("doc_id"), F.asc_nulls_first(F.when(F.col("text").isNotNull(), F.xxhash64("text"))), F.asc_nulls_first("text")]
    rows = rows.repartitionByRange(*order[:2]).sortWithinPartitions(*order)
    rows.mapInArrow(run, BLOCKS).write.parquet(path)


def starts(blocks: DataFrame) -> DataFrame:
    """shard, block and the ids before each block, from sums by shard and then within a shard."""
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    before = shards.select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before"))
    inner = F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")
    return blocks.select("shard", "block", inner.alias("inner")).join(before, "shard").select("shard", "block", (F.col("before") + F.col("inner")).alias("first"))


def read_ids(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before), n_tokens, ids_crc32 and, if asked for, ids of each document."""
    schema = "shard long, block long, doc_id long, inner long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, block, payload in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                own = Block(payload)
                ids = own.expand(own.symbols).astype("<u4")
                cuts = np.append(0, np.cumsum(own.sizes))
                each = [ids[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                cols = [pa.array([shard] * len(each), pa.int64()), pa.array([block] * len(each), pa.int64()), pa.array(own.doc_ids, pa.int64()), pa.array(cuts[:-1]), pa.array(own.sizes), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                names = ["shard", "block", "doc_id", "inner", "n_tokens", "ids_crc32"]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int64))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names)

    stored_blocks = spark.read.schema(BLOCKS).parquet(path)
    rows = stored_blocks.select("shard", "block", "payload").mapInArrow(run, schema)
    out = rows.join(starts(stored_blocks.select("shard", "block", "n_ids")), ["shard", "block"])
    return out.select("doc_id", (F.col("first") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32", *(["ids"] if with_ids else []))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark)
    write_ids(table(spark, sf_dir, "documents"), path)
    return read_ids(spark, path, with_ids=False)
