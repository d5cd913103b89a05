"""A trie of conversation prefixes, built from vertical bitmaps shard by shard.

A shard holds the conversations of a range of ids.  Its index maps (position,
turn) to a bitset of the conversations that have this turn there; a node's
children are its own bitset intersected with the postings one position deeper,
depth first, and popcounts, lowest bits and the bits of conversations that end
there are what a node adds to the whole.  Nodes of all shards meet by a key of
128 bits: sums of hashes of (turn, position), so that a prefix's key is the sum
over its turns.  A long conversation is cut into stretches of ``STRETCH``
positions, each of which starts from the sum of what came before; so a unit of
work, a shard's stretch, is bounded however the turns are spread, and a prefix
that a third of all conversations share costs one row per shard.

Sums over subtrees add up likewise: of a node's members each but the smallest
saves its last turn, and each node counts as a leaf only with its smallest
member; every shard sums what its own members bring, bottom up.  What a stretch
brings is carried to the node before it.

Defined results: rows without a conv_id belong to no conversation and are left
out; a null turn comes first, rows of equal turn stand in the order of the md5
of role and text; null role or text is empty; repeated rows are turns of their
own; the base of c is c - c % 100 with the sign of c in the remainder; other
columns are ignored; an empty table has no conversations and no nodes.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.llm.merkle import CRC32_SQL
from tidemark.operators.scan import ranked

#: Ids of a base and those rebuilt on it, bases in a shard, most turns taken from a base (and one more), positions in a stretch.
FAMILY, SHARD_FAMILIES, TURNS_FROM_BASE, STRETCH = 100, 10, 6, 1 << 10
MASK = (1 << 64) - 1

UNIT = ["shard", "stretch"]
KEY = ["depth", "a", "b"]
NODES = "shard long, stretch long, depth long, a long, b long, up_a long, up_b long, low long, members long, chars long, ends string"
SUMS = "shard long, stretch long, depth long, a long, b long, n_children long, n_leaves long, saved long"


def placed(conversations: DataFrame) -> DataFrame:
    """conv_id, nth, n_turns, turn (16 bytes) and chars of each turn; texts stay where they are read."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turn = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("at"), turn.alias("turn"), F.char_length(text).cast("long").alias("chars"))
    return ranked(rows, ["conv_id"], [F.asc_nulls_first("at"), F.asc("turn")], stored, total="n_turns").drop("at")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(turns of the rebuilt conversations: conv_id, depth from 1, turn, chars; their conv_id and length).

    A conversation takes fewer than ``TURNS_FROM_BASE`` turns from its base, so the join meets at most as many for each.
    """
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % TURNS_FROM_BASE
    own = turns.groupBy("conv_id").agg(F.first("n_turns").alias("n_own")).withColumn("head", head).withColumn("base", F.col("conv_id") - F.col("conv_id") % FAMILY)
    bases = turns.where(F.col("conv_id") % FAMILY == 0)
    sizes = bases.where("nth = 0").select(F.col("conv_id").alias("base"), F.col("n_turns").alias("n_base"))
    own = stored(own.join(sizes, "base", "left").withColumn("taken", F.least("head", F.coalesce("n_base", F.lit(0)))))
    first = bases.where(F.col("nth") < TURNS_FROM_BASE).select(F.col("conv_id").alias("base"), "nth", "turn", "chars")
    taken = own.join(first, "base").where("nth < head").select("conv_id", (F.col("nth") + 1).alias("depth"), "turn", "chars")
    rest = turns.join(own.select("conv_id", "head", "taken"), "conv_id").where("nth >= head").select("conv_id", (F.col("nth") - F.col("head") + F.col("taken") + 1).alias("depth"), "turn", "chars")
    lengths = own.select("conv_id", (F.col("taken") + F.greatest(F.lit(0), F.col("n_own") - F.col("head"))).cast("long").alias("length"))
    return taken.unionByName(rest), lengths


def with_shard(df: DataFrame) -> DataFrame:
    """Shards are ranges of ids, so ids ascend over shards."""
    family = F.col("conv_id") / FAMILY
    family = F.when(family < 0, F.ceil(family)).otherwise(F.floor(family))
    return df.withColumn("shard", F.floor(family / SHARD_FAMILIES).cast("long"))


def units(conversations: DataFrame, width: int = STRETCH) -> tuple[DataFrame, DataFrame]:
    """(rows of all stretches, starts of the stretches behind the first): shard, stretch, conv_id, depth, a, b, chars.

    A conversation's row of the depth at which a stretch starts holds the sums up to there and, as chars, its length.
    """
    turns, lengths = rebuilt(placed(conversations))
    lane = lambda k: F.xxhash64("turn", "depth", F.lit(k))
    rows = turns.select("conv_id", F.floor((F.col("depth") - 1) / width).alias("stretch"), "depth", lane(1).alias("a"), lane(2).alias("b"), "chars")
    rows = stored(with_shard(rows).select(*UNIT, "conv_id", *KEY, "chars"))
    zero = F.lit(0).cast("long")
    roots = with_shard(lengths).select("shard", zero.alias("stretch"), "conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), F.col("length").alias("chars"))
    long = lengths.where(F.col("length") > width)
    sums = rows.join(long, "conv_id").groupBy("shard", "conv_id", "stretch", "length").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in "ab"))
    upto = Window.partitionBy("conv_id").orderBy("stretch")
    whole, half = (F.lit(str(x)).cast("decimal(20,0)") for x in (1 << 64, 1 << 63))
    wrapped = lambda c: F.sum(c).over(upto) % whole
    signed = lambda c: F.when(c >= half, c - whole).when(c < -half, c + whole).otherwise(c).cast("long")
    starts = sums.select("shard", (F.col("stretch") + 1).alias("stretch"), "conv_id", ((F.col("stretch") + 1) * width).alias("depth"), wrapped("a").alias("a"), wrapped("b").alias("b"), F.col("length").alias("chars"))
    starts = stored(starts.where("depth < chars").withColumns({"a": signed(F.col("a")), "b": signed(F.col("b"))}))
    return rows.unionByName(roots).unionByName(starts), starts


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def grown(unit: pa.Table, width: int = STRETCH) -> Iterator[tuple]:
    """The nodes of one unit: its stretch's start is left out but for the root."""
    shard, stretch = unit["shard"][0].as_py(), unit["stretch"][0].as_py()
    conv, depth, chars = (unit[c].to_numpy() for c in ("conv_id", "depth", "chars"))
    a, b = (unit[c].to_numpy().view(np.uint64) for c in "ab")
    ids, bit = np.unique(conv, return_inverse=True)
    start = stretch * width
    postings: dict[tuple[int, int, int], int] = defaultdict(int)  # (position, turn) -> conversations
    turn_of: dict[tuple[int, int], tuple[int, int, int]] = {}
    size: dict[tuple[int, int, int], int] = {}
    classes: dict[tuple[int, int], int] = defaultdict(int)
    there, ended = defaultdict(int), defaultdict(int)  # position -> conversations that reach it, or end at it
    for k, d, x, y, n in zip(bit.tolist(), depth.tolist(), a.tolist(), b.tolist(), chars.tolist(), strict=True):
        one = 1 << k
        if d == start:
            classes[x, y] |= one
            ended[n] |= one
        else:
            turn = (d, x, y)
            postings[turn] |= one
            turn_of[k, d] = turn
            size[turn] = n
            there[d] |= one
    lowest = lambda bits: (bits & -bits).bit_length() - 1

    def members(bits: int) -> Iterator[int]:
        while bits:
            yield int(ids[lowest(bits)])
            bits &= bits - 1

    def node(d: int, x: int, y: int, px: int, py: int, bits: int, n: int) -> tuple:
        ends = bits & ended[d]
        return (shard, stretch, d, _signed(x), _signed(y), _signed(px), _signed(py), int(ids[lowest(bits)]), bits.bit_count(), n, ",".join(map(str, members(ends))) if ends else None)

    stack = [(start, x, y, bits) for (x, y), bits in classes.items()]
    if not stretch:
        for d, x, y, bits in stack:
            yield node(d, x, y, 0, 0, bits, 0)
    while stack:
        d, x, y, bits = stack.pop()
        rest = bits & there[d + 1]
        while rest:
            turn = turn_of[lowest(rest), d + 1]
            child = rest & postings[turn]
            rest ^= child
            u, v = (x + turn[1]) & MASK, (y + turn[2]) & MASK
            yield node(d + 1, u, v, x, y, child, size[turn])
            stack.append((d + 1, u, v, child))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.Table:
    return pa.Table.from_pydict({f.name: [r[k] for r in rows] for k, f in enumerate(schema)}, schema=schema)


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(c.split()[0], pa.string() if c.split()[1] == "string" else pa.int64()) for c in ddl.split(", ")])


def local_nodes(rows: DataFrame, width: int = STRETCH) -> DataFrame:
    return rows.groupBy(*UNIT).applyInArrow(lambda unit: _table(list(grown(unit, width)), _schema(NODES)), NODES)


def summed(unit: pa.Table) -> Iterator[tuple]:
    """Children, leaves and saved characters below each key of one unit, and below its start."""
    shard, stretch = unit["shard"][0].as_py(), unit["stretch"][0].as_py()
    below: dict[tuple[int, int, int], list[int]] = defaultdict(lambda: [0, 0, 0])
    above: dict[tuple[int, int, int], tuple[int, int, int]] = {}
    own_children: dict[tuple[int, int, int], int] = defaultdict(int)
    for d, a, b, up_a, up_b, own, leaves, saved in zip(*(unit[c].to_pylist() for c in (*KEY, "up_a", "up_b", "own", "leaves", "saved")), strict=True):
        here = below[d, a, b]
        here[1] += leaves
        here[2] += saved
        if own is not None and d:
            above[d, a, b] = (d - 1, up_a, up_b)
            own_children[d - 1, up_a, up_b] += own
    for key in sorted(above, reverse=True):
        up, here = below[above[key]], below[key]
        up[1] += here[1]
        up[2] += here[2]
    for key in below:
        yield (shard, stretch, *key, own_children[key], *below[key][1:])


def subtree_sums(parts: DataFrame) -> DataFrame:
    return parts.groupBy(*UNIT).applyInArrow(lambda unit: _table(list(summed(unit)), _schema(SUMS)), SUMS)


def carried(parts: DataFrame, starts: DataFrame, width: int = STRETCH) -> DataFrame:
    """What later stretches bring to the nodes at which they start, as further parts.

    A start's sums go to its smallest conversation of the shard, and along this one to all stretches before.
    """
    each = subtree_sums(parts.where("stretch > 0")).where(F.col("depth") == F.col("stretch") * width)
    first = starts.groupBy(*UNIT, *KEY).agg(F.min("conv_id").alias("conv_id"))
    found = each.join(first, [*UNIT, *KEY]).select("shard", "conv_id", "stretch", "n_leaves", "saved")
    after = Window.partitionBy("conv_id").orderBy(F.desc("stretch"))
    # a start that goes to another conversation still passes on what this one's later stretches bring
    rows = starts.join(found, ["shard", "conv_id", "stretch"], "left").withColumns({c: F.sum(F.coalesce(c, F.lit(0))).over(after) for c in ("n_leaves", "saved")})
    none = F.lit(None).cast("long")
    return rows.select("shard", (F.col("stretch") - 1).alias("stretch"), *KEY, none.alias("up_a"), none.alias("up_b"), none.alias("own"), F.col("n_leaves").alias("leaves"), "saved")


def end_hashes(nodes: DataFrame) -> DataFrame:
    """sha256 of each node's end list; shards follow each other, and a task keeps no more than a hash of what went by."""
    schema = pa.schema([("depth", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("ends_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for batch in batches:
            done = []
            for d, a, b, ends in zip(*(batch.column(c).to_pylist() for c in range(4)), strict=True):
                if (d, a, b) == key:
                    state.update(b",")
                else:
                    if key:
                        done.append((*key, state.hexdigest()))
                    key, state = (d, a, b), hashlib.sha256()
                state.update(ends.encode())
            if done:
                yield from _table(done, schema).to_batches()
        if key:
            yield from _table([(*key, state.hexdigest())], schema).to_batches()

    lists = nodes.where("ends is not null").repartition(*KEY).sortWithinPartitions(*KEY, "shard").select(*KEY, "ends")
    return lists.mapInArrow(run, "depth long, a long, b long, ends_sha256 string")


def trie(conversations: DataFrame, width: int = STRETCH) -> DataFrame:
    """One row per node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    rows, starts = units(conversations, width)
    local = stored(local_nodes(rows, width))
    whole = stored(local.groupBy(*KEY).agg(F.min("low").alias("conv_id"), F.sum("members").alias("n_convs"), F.first("up_a").alias("up_a"), F.first("up_b").alias("up_b")))
    inner = whole.where("depth > 0").select((F.col("depth") - 1).alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b")).distinct().withColumn("inner", F.lit(True))
    whole = stored(whole.join(inner, KEY, "left"))
    flags = whole.select(*KEY, "conv_id", "inner")
    own = (F.col("low") == F.col("conv_id")).cast("long")
    parts = local.join(flags, KEY).select(*UNIT, *KEY, "up_a", "up_b", own.alias("own"), (own * F.col("inner").isNull().cast("long")).alias("leaves"), (F.col("chars") * (F.col("members") - own)).alias("saved"))
    if not starts.isEmpty():
        parts = stored(parts)
        parts = parts.unionByName(carried(parts, starts, width))
    inside = (F.col("stretch") == 0) | (F.col("depth") > F.col("stretch") * width)  # sums below a later stretch's start have been carried
    sums = subtree_sums(parts).withColumns({c: F.when(inside, F.col(c)).otherwise(0) for c in ("n_leaves", "saved")})
    sums = sums.groupBy(*KEY).agg(*(F.sum(c).alias(c) for c in ("n_children", "n_leaves", "saved")))
    parents = whole.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"))
    out = whole.join(sums, KEY).join(end_hashes(local), KEY, "left").join(parents, ["depth", "up_a", "up_b"], "left")
    hashed: Column = F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest()))
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"), hashed.alias("ends_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


OP11_SQL = (
    r"""
WITH """
    + CRC32_SQL.format(id="conv_id", table="conversations").lstrip()
    + r""",
turns AS (
  SELECT conv_id, coalesce(text, '') AS text, md5(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS turn, turn AS place
  FROM conversations WHERE conv_id IS NOT NULL),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY place NULLS FIRST, turn) - 1 AS nth, count(*) OVER (PARTITION BY conv_id) AS n FROM turns),
convs AS (
  SELECT c.conv_id, n_own, head, c.base, least(head, coalesce(b.n_base, 0)) AS taken
  FROM (SELECT conv_id, any_value(n) AS n_own, any_value(crc) % 6 AS head, conv_id - conv_id % 100 AS base FROM placed JOIN crc_of ON conv_id = id GROUP BY conv_id) c
  LEFT JOIN (SELECT conv_id, count(*) AS n_base FROM placed GROUP BY conv_id) b ON b.conv_id = c.base),
rebuilt AS (
  SELECT c.conv_id, nth + 1 AS depth, turn, text FROM convs c JOIN placed p ON p.conv_id = c.base WHERE nth < head
  UNION ALL
  SELECT c.conv_id, nth - head + taken + 1, turn, text FROM convs c JOIN placed p ON p.conv_id = c.conv_id WHERE nth >= head),
paths AS (
  SELECT conv_id, depth, md5(string_agg(turn, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth)) AS node, length(text) AS chars, count(*) OVER (PARTITION BY conv_id) AS n
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, '', 0, taken + greatest(n_own - head, 0) FROM convs),
nodes AS (
  SELECT depth, node, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (n = depth), '')) AS ends_sha256
  FROM paths GROUP BY depth, node),
parents AS (
  SELECT v.depth, v.node, u.conv_id AS parent_conv_id, u.node AS parent
  FROM nodes v JOIN paths p ON p.conv_id = v.conv_id AND p.depth = v.depth - 1 JOIN nodes u ON u.depth = p.depth AND u.node = p.node),
kids AS (SELECT depth - 1 AS depth, parent AS node, count(*) AS n_children FROM parents GROUP BY 1, 2),
sums AS (
  SELECT p.depth, p.node, sum((v.n_convs - 1) * v.chars) AS saved, count(*) FILTER (k.n_children IS NULL) AS n_leaves
  FROM nodes v LEFT JOIN kids k ON k.depth = v.depth AND k.node = v.node JOIN paths p ON p.conv_id = v.conv_id AND p.depth <= v.depth GROUP BY 1, 2)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, CAST(saved AS BIGINT) AS saved_tokens, ends_sha256
FROM nodes n LEFT JOIN parents p ON p.depth = n.depth AND p.node = n.node LEFT JOIN kids k ON k.depth = n.depth AND k.node = n.node JOIN sums s ON s.depth = n.depth AND s.node = n.node
"""
)
