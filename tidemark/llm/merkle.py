"""A Merkle manifest of a dataset, kept as concatenated levels.

Every row is hashed into a leaf; per language the leaves stand in ascending
order of doc_id.  An aligned block of ``BLOCK`` consecutive nodes keeps each of
its levels as one string of hex digests: a parent is the hash of a substring of
fixed width, and a node's siblings are the substrings at its flanks.  What a
block leaves over, one digest, is a node of the next tier, which is cut into
blocks in the same way, until each language has one subroot; the subroots in
the order of their languages are nodes of such tiers themselves and give the
root.  A row's proof is the list of its flanks, from its own block upward.

Places within a language come from a range exchange and a carry over its tasks
(``scan.ranked``), so a language of any size is dealt over all of them; a block
gathers at most ``BLOCK`` rows and a join down the tiers meets at most as many.
DataFrame functions only.

Defined results: a null value is hashed as ``-``; rows of a null language are a
language of their own, the first; rows without an id come first in their
language and are never tampered with; rows of one id stand in the order of
their leaves, equal rows in any (each has a place and a proof of its own);
other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import stored, table
from tidemark.operators.scan import joined, ranked

#: Nodes that are hashed into one parent, and levels in a block; a full block has FAN ** LEVELS nodes.
FAN, LEVELS = 2, 8
BLOCK = FAN**LEVELS
#: Characters of a digest.
WIDTH = 64


def digest(c: Column) -> Column:
    return F.sha2(c.cast("binary"), 256)


def field(c: Column) -> Column:
    text = c.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(n_chars: Column) -> Column:
    return digest(F.concat(*(field(c) for c in (F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")))))


def levels(nodes: Column, steps: Column) -> Column:
    """The block's levels as strings of digests (binary, so that a substring is found by its offset), ``steps`` above the first."""

    def parents(level: Column) -> Column:
        last = F.floor((F.length(level) - 1) / (FAN * WIDTH))
        each = F.transform(F.sequence(F.lit(0), last.cast("int")), lambda k: F.sha2(F.substring(level, k * (FAN * WIDTH) + 1, F.lit(FAN * WIDTH)), 256))
        return F.array_join(each, "").cast("binary")

    first = F.array(F.array_join(nodes, "").cast("binary"))
    return F.aggregate(F.slice(F.sequence(F.lit(1), steps + 1), F.lit(1), steps), first, lambda done, _: F.concat(done, F.array(parents(F.element_at(done, -1)))))


def flanks(level: Column, node: Column) -> Column:
    """What stands left and right of a node in its run."""
    start = node - node % FAN
    left = F.substring(level, start * WIDTH + 1, (node - start) * WIDTH)
    right = F.substring(level, (node + 1) * WIDTH + 1, (start + FAN - 1 - node) * WIDTH)
    return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))


def blocks(nodes: DataFrame) -> DataFrame:
    """(g, nth, n, hash, own) -> (g, block, n_blocks, rows, levels): ``n`` is the number of nodes of the group ``g``.

    A group of one block is hashed until one node is left; other blocks, the last one too, are hashed all ``LEVELS``.
    """
    row = F.struct((F.col("nth") % BLOCK).cast("int").alias("at"), "hash", "own").alias("_row")
    each = nodes.select("g", F.floor(F.col("nth") / BLOCK).alias("block"), "n", row).groupBy("g", "block").agg(F.array_sort(F.collect_list("_row")).alias("rows"), F.first("n").alias("n"))
    depth = F.lit(0)
    for k in range(LEVELS):
        depth = F.when(F.col("n") > FAN**k, k + 1).otherwise(depth)
    each = each.withColumn("steps", depth.cast("int"))
    return each.select("g", "block", F.ceil(F.col("n") / BLOCK).alias("n_blocks"), "rows", levels(F.transform("rows", lambda r: r["hash"]), F.col("steps")).alias("levels"))


def climbed(nodes: DataFrame) -> DataFrame:
    """(g, nth, hash, own, path, top): the flanks of each node up to the one digest that its group ends in, and that digest."""
    found = stored(blocks(nodes))
    root = F.element_at("levels", -1).cast("string")
    if found.where("n_blocks > 1").isEmpty():
        found = found.withColumns({"upper": F.array().cast("array<struct<left:string,right:string>>"), "top": root})
    else:
        heads = found.select("g", F.col("block").alias("nth"), F.col("n_blocks").alias("n"), root.alias("hash"), F.lit(None).cast("boolean").alias("own"))
        above = climbed(heads).select("g", F.col("nth").alias("block"), F.col("path").alias("upper"), "top")
        found = joined(found, above, ["g", "block"])
    steps = F.size("levels") - 1
    every = F.slice(F.sequence(F.lit(0), steps), F.lit(1), steps)
    path = lambda r: F.transform(every, lambda k: flanks(F.element_at("levels", k + 1), F.floor(r["at"] / F.pow(F.lit(FAN), k)).cast("int")))
    each = found.select("g", "block", "upper", "top", F.explode(F.transform("rows", lambda r: F.struct(r["at"].alias("at"), r["hash"].alias("hash"), r["own"].alias("own"), path(r).alias("path")))).alias("r"))
    return each.select("g", (F.col("block") * BLOCK + F.col("r.at")).alias("nth"), "r.hash", "r.own", F.concat("r.path", "upper").alias("path"), "top")


def folded(start: Column, path: Column) -> Column:
    """The root that a leaf and the flanks of its path lead to."""
    return F.aggregate(path, start, lambda done, f: digest(F.concat(f["left"], done, f["right"])))


def manifest(docs: DataFrame, tampered: Column | None = None) -> DataFrame:
    """doc_id, lang, leaf, tampered, subroot, root and path of each row; ``tampered`` is an expression of a second leaf."""
    second = tampered if tampered is not None else F.lit(None).cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("g"), leaf(F.col("n_chars")).alias("hash"), second.alias("tampered"))
    placed = ranked(rows, ["g"], [F.asc_nulls_first("doc_id"), F.asc("hash")], stored, total="n")
    low = stored(climbed(placed.select("g", "nth", "n", "hash", F.struct("doc_id", "tampered").alias("own"))))
    subroots = low.where("nth = 0").select("g", F.col("top").alias("hash"))  # a row a language
    langs = ranked(subroots, [], [F.asc_nulls_first("g")], stored, total="n")
    high = climbed(langs.select(F.lit(0).alias("g"), "nth", "n", "hash", F.struct(F.col("g").alias("lang")).alias("own")))
    high = stored(high.select(F.col("own.lang").alias("g"), F.col("path").alias("upper"), F.col("top").alias("root")))
    both = joined(low, high, ["g"])
    return both.select("own.doc_id", F.col("g").alias("lang"), F.col("hash").alias("leaf"), "own.tampered", F.col("top").alias("subroot"), "root", F.concat("path", "upper").alias("path"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves, roots and proofs of ``documents``, and what a verifier finds where n_chars was raised by 1 (7 divides crc32 of the id)."""
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 0
    raised = F.col("n_chars").cast("decimal(20,0)") + 1
    rows = manifest(docs, F.when(hit, leaf(raised.cast("decimal(20,0)"))))
    rows = rows.withColumn("folded_root", folded(F.coalesce("tampered", "leaf"), F.col("path")))
    proof = digest(F.array_join(F.transform("path", lambda f: F.concat(f["left"], f["right"])), ""))
    return rows.select("doc_id", "leaf", "subroot", "root", proof.alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: crc32 of a decimal number as SQL: a table of 256 steps made by rule, and a fold over the digits.
CRC32_SQL = r"""
crc_steps AS (
  SELECT list_transform(range(256), lambda n: list_reduce(list_concat([n], range(8)), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS steps),
crc_of AS (
  SELECT id, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len(text) + 1), lambda k: ascii(substr(text, k, 1))::BIGINT)),
                                         lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS crc
  FROM (SELECT DISTINCT {id} AS id, CAST({id} AS VARCHAR) AS text FROM {table} WHERE {id} IS NOT NULL), crc_steps)"""

OP13_SQL = (
    r"""
WITH RECURSIVE """
    + CRC32_SQL.format(id="doc_id", table="documents").lstrip()
    + r""",
fields AS (
  SELECT doc_id, lang, n_chars, crc % 7 = 0 AS hit,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail
  FROM documents LEFT JOIN crc_of ON doc_id = id),
hashed AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN hit THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS tampered
  FROM fields),
leaves AS (
  SELECT *, row_number() OVER () AS k, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM hashed),
nodes AS (
  SELECT lang, 0 AS level, i, n, leaf AS h FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM nodes WHERE n > 1 GROUP BY lang, level, i // 2, n),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM nodes WHERE n = 1),
tops AS (
  SELECT 0 AS level, i, n, subroot AS h FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM tops WHERE n > 1 GROUP BY level, i // 2, n),
steps AS (
  SELECT l.k, v.level, coalesce(s.h, '') AS h, (l.i >> v.level) % 2 = 1 AS before
  FROM leaves l JOIN (SELECT DISTINCT lang, level FROM nodes WHERE n > 1) v ON l.lang IS NOT DISTINCT FROM v.lang
  LEFT JOIN nodes s ON s.lang IS NOT DISTINCT FROM l.lang AND s.level = v.level AND s.i = xor(l.i >> v.level, 1)
  UNION ALL
  SELECT l.k, 1000 + v.level, coalesce(s.h, ''), (r.i >> v.level) % 2 = 1
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang JOIN (SELECT DISTINCT level FROM tops WHERE n > 1) v ON true
  LEFT JOIN tops s ON s.level = v.level AND s.i = xor(r.i >> v.level, 1)),
paths AS (SELECT k, string_agg(h, '' ORDER BY level) AS proof, list(CASE WHEN before THEN 'L' ELSE 'R' END || h ORDER BY level) AS path FROM steps GROUP BY k),
ends AS (
  SELECT doc_id, leaf, r.subroot, (SELECT h FROM tops WHERE n = 1) AS root, sha256(coalesce(proof, '')) AS proof_sha256,
         list_reduce(list_concat([coalesce(tampered, leaf)], coalesce(path, [])), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN s[2:] || a ELSE a || s[2:] END)) AS folded_root
  FROM leaves l JOIN subroots r ON l.lang IS NOT DISTINCT FROM r.lang LEFT JOIN paths p ON l.k = p.k)
SELECT *, folded_root = root AS verified FROM ends
"""
)
