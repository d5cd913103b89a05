"""SimHash near-duplicates with covering locality-sensitive hashing.

Every position of a 64-bit fingerprint has a vector of r + 1 bits, r the
radius.  For each nonzero vector v a mask keeps the positions whose vector has
an odd product with v.  The positions where two fingerprints differ, r at most,
span a space of r dimensions at most, so some v is orthogonal to all of them:
that mask drops every differing position and the pair meets in its table.  The
guarantee holds for each pair, not on average.

Defined results: null text is empty; a text without words has fingerprint zero
and links like any other; rows with the same text have one fingerprint and one
class; a class is named by its smallest id, null where all its ids are null;
other input columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from tidemark.llm.common import slices, stored, table
from tidemark.llm.graph import components

#: A bucket of more fingerprints is dealt again by more bits.
LARGE_BUCKET = 8192
#: Blocks whole in common at each dealing.  After the last one the numbers of a bucket differ in 25 bits at most, a
#: space in which few can stand apart by more than the radius: what is taken up first clears most of the rest away.
LEVELS = (0, 1, 2, 3)
#: byte -> its 8 bits, one in each byte of a 64-bit number.
SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64).ravel()


def hashes(text: str | None, size: int) -> np.ndarray:
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= size:
        return np.array([xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.append(0, ends[:-size] + 1).tolist()
    cut = map(joined.__getitem__, map(slice, starts, ends[size - 1 :].tolist()))
    return np.fromiter(map(xxh64_intdigest, cut, repeat(42)), np.uint64, len(starts))


def majority(each: list[np.ndarray]) -> np.ndarray:
    """Of each array of hashes the number whose bits are set in over half of them; zero for none."""
    sizes = np.array([len(h) for h in each])
    out = np.zeros(len(each), np.uint64)
    full = np.flatnonzero(sizes)
    if not len(full):
        return out
    flat = np.concatenate(each).astype("<u8").view(np.uint8).reshape(-1, 8)
    n = sizes[full]
    starts = np.cumsum(n) - n
    parts = -(-n // 255)  # a byte holds sums of up to 255
    first = np.cumsum(parts) - parts
    inner = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    for k in range(8):
        sums = np.add.reduceat(SPREAD[flat[:, k]], inner).view(np.uint8).reshape(-1, 8).astype(np.int64)
        bits = 2 * np.add.reduceat(sums, first, axis=0) > n[:, None]
        out[full] |= np.packbits(bits, axis=1, bitorder="little").ravel().astype(np.uint64) << np.uint64(8 * k)
    return out


def fingerprints(docs: DataFrame, size: int = 4, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, its fingerprint as a signed long, and the columns ``carry`` as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            value = majority([hashes(t, size) for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(value.view(np.int64)), *batch.columns[2:]], ["doc_id", "fp", *carry])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), *carry)
    kinds = "".join(f", {c} {docs.schema[c].dataType.simpleString()}" for c in carry)
    return rows.mapInArrow(run, "doc_id long, fp long" + kinds)


def masks(radius: int) -> list[int]:
    """2^(radius + 1) - 1 covering masks of 64 bits; position i has vector i mod (2^(radius + 1) - 1) + 1."""
    top = (1 << (radius + 1)) - 1
    vector = [i % top + 1 for i in range(64)]
    return [sum(1 << i for i in range(64) if (vector[i] & v).bit_count() & 1) for v in range(1, top + 1)]


def finer(radius: int, level: int) -> list[int]:
    """Masks of ``level`` of ``radius + level`` blocks: within the radius two numbers agree on one of these whole."""
    if not level:
        return [0]
    blocks = radius + level
    part = [sum(1 << i for i in range(64) if i % blocks == b) for b in range(blocks)]
    return [sum(c) for c in combinations(part, level)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def spanning(members: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Links that join what is connected within the radius among distinct numbers: one fewer than members at most."""
    left, right, rest = [], [], members
    while len(rest) > 1:
        front, rest = [rest[:1]], rest[1:]
        while front and len(rest):
            group = front.pop()
            for k in range(len(group)):
                near = np.bitwise_count(rest ^ group[k]) <= radius
                if near.any():
                    found = rest[near]
                    left.append(np.repeat(group[k], len(found)))
                    right.append(found)
                    front.append(found)
                    rest = rest[~near]
                if not len(rest):
                    break
    return left, right


def linked(radius: int, last: bool, large: int):
    """Rows (t, k, fp) sorted by table and key -> links (t = -1, k, fp), and the rows of large buckets as they came."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the bucket that the last batch ended in: rows of (t, k, fp)
        passing = None  # (t, k) of a large bucket of which rows went out already

        def work(rows: np.ndarray, whole: bool):
            """Links and deferred rows of complete buckets in ``rows``; the last one is complete if ``whole``."""
            nonlocal held, passing
            new = np.append(True, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0))
            starts = np.append(np.flatnonzero(new), rows.shape[1])
            sizes = np.diff(starts)
            out: list[np.ndarray] = []
            tail = None
            if not whole:
                tail = rows[:, starts[-2] :]
                starts, sizes = starts[:-1], sizes[:-1]
            if passing is not None and len(sizes):
                if (rows[0, 0], rows[1, 0]) == passing:
                    out.append(rows[:, : sizes[0]])
                    starts, sizes = starts[1:], sizes[1:]
                passing = None
            two = starts[:-1][sizes == 2]
            a, b = rows[2, two], rows[2, two + 1]
            near = np.bitwise_count((a ^ b).view(np.uint64)) <= radius
            out.append(np.stack([np.full(near.sum(), -1), a[near], b[near]]))
            for k in np.flatnonzero(sizes > 2):
                bucket = rows[:, starts[k] : starts[k] + sizes[k]]
                if sizes[k] > large and not last:
                    out.append(bucket)
                    continue
                one, other = spanning(bucket[2].view(np.uint64), radius)
                if one:
                    x, y = np.concatenate(one).view(np.int64), np.concatenate(other).view(np.int64)
                    out.append(np.stack([np.full(len(x), -1), x, y]))
            held = []
            if tail is not None and tail.shape[1]:
                at = (tail[0, 0], tail[1, 0])
                if passing == at or tail.shape[1] > large and not last:
                    passing = at
                    out.append(tail)
                else:
                    held = [tail]
            return np.concatenate(out, axis=1)

        for batch in batches:
            if not batch.num_rows:
                continue
            rows = np.stack([np.asarray(batch.column(c)).astype(np.int64) for c in range(3)])
            if held:
                rows = np.concatenate([*held, rows], axis=1)
            at = passing
            if at is not None and (rows[0] == at[0]).all() and (rows[1] == at[1]).all():
                done = rows  # one large bucket through and through
            else:
                done = work(rows, False)
            yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1]), pa.array(done[2])], ["t", "k", "fp"])
        if held:
            done = work(held[0], True)
            yield pa.RecordBatch.from_arrays([pa.array(done[0]), pa.array(done[1]), pa.array(done[2])], ["t", "k", "fp"])

    return run


def links(fps: DataFrame, radius: int = 4, large: int = LARGE_BUCKET) -> DataFrame:
    """Distinct ``fp`` -> links (a, b) that connect all that lies within the radius.

    Each table's bucket yields a spanning set of links, never all pairs.  Large
    buckets are dealt again by the same mask and more bits, so that no pair
    within the radius is lost.
    """
    base = masks(radius)
    found, rest = None, fps.select("fp", F.explode(F.array([F.lit(k) for k in range(len(base))])).alias("v"))
    for level in LEVELS:
        more = finer(radius, level)
        mask = F.array([F.lit(signed(m)) for m in base])[F.col("v")]
        extra = [F.struct((F.col("v") * len(more) + j).cast("long").alias("t"), F.col("fp").bitwiseAND(mask.bitwiseOR(F.lit(signed(m)))).alias("k")) for j, m in enumerate(more)]
        dealt = rest.select("fp", F.explode(F.array(extra)).alias("x")).select("x.t", "x.k", "fp")
        out = stored(dealt.repartition("t", "k").sortWithinPartitions("t", "k").mapInArrow(linked(radius, level == LEVELS[-1], large), "t long, k long, fp long"))
        own = out.where("t = -1").select(F.col("k").alias("a"), F.col("fp").alias("b"))
        found = own if found is None else found.unionByName(own)
        rest = out.where("t >= 0")
        if level == LEVELS[-1] or rest.isEmpty():
            return found
        rest = rest.select("fp", F.expr(f"cast(t div {len(more)} as int)").alias("v")).distinct()


def classes(prints: DataFrame, radius: int = 4, large: int = LARGE_BUCKET) -> DataFrame:
    """fp, root and component_id: each fingerprint's class, named by a fingerprint and by the smallest id in it."""
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first_id"))
    joined = components(links(first, radius, large)).withColumnRenamed("a", "fp")
    member = stored(first.join(joined, "fp", "left").select("fp", "first_id", F.coalesce("b", "fp").alias("root")))
    name = stored(member.groupBy("root").agg(F.min("first_id").alias("component_id")))
    return stored(member.join(name, "root").select("fp", "root", "component_id"))


def near_duplicates(docs: DataFrame, radius: int = 4, size: int = 4, large: int = LARGE_BUCKET) -> DataFrame:
    """doc_id, fp and component_id of each row of ``docs``."""
    prints = stored(fingerprints(docs, size))
    return prints.join(classes(prints, radius, large), "fp", "left").select("doc_id", "fp", "component_id")


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicated(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each class: that of the smallest id, of equal ids (or where all are null) that of the smallest hash of its text.

    Rows go by a number of their own, so neither repeated nor missing ids take others with them.
    """
    numbered = stored(docs.withColumn("_row", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_hash", F.xxhash64("text"))
    prints = stored(fingerprints(numbered, carry=("_row", "_hash")))
    found = stored(prints.join(classes(prints), "fp").select("root", "_row", F.struct(F.col("doc_id").isNull().alias("lacks"), "doc_id", "_hash", "_row").alias("order")))
    best = stored(found.groupBy("root").agg(F.min("order").alias("best")))
    gone = found.join(best, "root").where("_row <> best._row").select("_row")
    return numbered.join(gone, "_row", "left_anti").select(docs.columns)
