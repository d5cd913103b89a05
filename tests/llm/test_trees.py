"""Prefix trie and Merkle manifest against their SQL and plain versions, on odd rows and hot groups."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import merkle, prefix_trie

CONVERSATIONS = "conv_id long, turn long, role string, text string, depth long, shard long, a string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain_trie(rows):
    """Node by node from the definition."""
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            mark = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            turns[conv].append(((turn is not None, turn or 0, mark), role, text))
    turns = {c: [(r, t) for _, r, t in sorted(x)] for c, x in turns.items()}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = turns.get(base, [])[:h] + own[h:]
    members = defaultdict(list)
    for c, path in built.items():
        for d in range(len(path) + 1):
            members[tuple(path[:d])].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)

    out = []
    for p in members:
        tree = [p]
        for q in tree:
            tree += kids[q]
        saved = sum((len(members[q]) - 1) * len(q[-1][1]) for q in tree if q)
        ends = ",".join(map(str, sorted(c for c in members[p] if len(built[c]) == len(p))))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids[p]), sum(not kids[q] for q in tree), saved, sha(ends)))
    return sorted(map(str, out))


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def found_trie(df):
    return sorted(str(tuple(r[c] for c in TRIE)) for r in df.collect())


@pytest.fixture(scope="module")
def talks():
    rows = [(None, 0, "user", "nobody"), (5, None, "user", "first"), (5, 0, None, None), (5, 0, "user", "tie"), (5, 0, "user", "tie"), (-3, 1, "user", "below zero"), (-103, 0, "a", "b"), (100, 3, "", ""), (7, 0, "user", "é日本😀")]
    rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"shared {t}") for c in range(1000, 1090) for t in range(c % 4 + 1)]  # many copies
    rows += [(c, t, "user", f"own {t}" if t < 9 or c % 3 else f"late {t}") for c in (1100, 1150, 1203, 2301, 2302) for t in range(14)]  # long ones that part late
    rows += [(c, 0, "user", "hi") for c in range(5000, 5400, 7)]  # some have no turn left
    return rows


@pytest.mark.parametrize("width", [prefix_trie.STRETCH, 3, 1])
def test_trie_is_the_plain_one(spark, talks, width):
    df = spark.createDataFrame([(*r, 1, 1, "clash") for r in talks], CONVERSATIONS).repartition(3)
    assert found_trie(prefix_trie.trie(df, width)) == plain_trie(talks)


def test_trie_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert prefix_trie.trie(empty).count() == 0 and prefix_trie.trie(spark.createDataFrame([(None, 1, "a", "b", 1, 1, "x")], CONVERSATIONS)).count() == 0


def test_trie_against_sql(spark, sf, talks):
    arrow = pa.table({c: pa.array([r[k] for r in talks], pa.int64() if k < 2 else pa.string()) for k, c in enumerate(("conv_id", "turn", "role", "text"))})
    con = duckdb.connect()
    con.register("conversations", arrow)
    rel = con.sql(prefix_trie.OP11_SQL)
    assert sorted(str(tuple(r[rel.columns.index(c)] for c in TRIE)) for r in rel.fetchall()) == plain_trie(talks)
    con = duckdb.connect()
    con.sql(f"create view conversations as select * from '{sf}/conversations.parquet'")
    rel = con.sql(prefix_trie.OP11_SQL)
    assert found_trie(prefix_trie.op11_prefix_trie(spark, sf)) == sorted(str(tuple(r[rel.columns.index(c)] for c in TRIE)) for r in rel.fetchall())


def test_one_conversation_of_a_third_of_all_turns_is_cut(spark):
    """No unit of work holds more than its conversations times a stretch, and ranks are dealt over tasks."""
    rows = [(0, t, "user", f"turn {t % 50}", 1, 1, "x") for t in range(4_000)] + [(c, t, "user", f"turn {t}", 1, 1, "x") for c in range(1, 800) for t in range(5)]
    units, starts = prefix_trie.units(spark.createDataFrame(rows, CONVERSATIONS), 100)
    assert units.groupBy("shard", "stretch").count().agg(F.max("count")).first()[0] <= 5 * 800 + 900
    assert starts.count() == 39


def plain_manifest(rows):
    def field(x):
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def climb(nodes):
        """Subroot and each node's siblings as (left, right)."""
        paths, at = [[] for _ in nodes], list(range(len(nodes)))
        while len(nodes) > 1:
            for k, p in enumerate(paths):
                run, i = at[k] // 2 * 2, at[k]
                p.append(("".join(nodes[run:i]), "".join(nodes[i + 1 : run + 2])))
                at[k] //= 2
            nodes = [sha("".join(nodes[k : k + 2])) for k in range(0, len(nodes), 2)]
        return nodes[0], paths

    langs = defaultdict(list)
    for doc_id, text, lang, source, n in rows:
        leaf = sha("".join(map(field, (doc_id, source, lang, n, text))))
        other = sha("".join(map(field, (doc_id, source, lang, None if n is None else n + 1, text)))) if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0 else leaf
        langs[lang].append(((doc_id is not None, doc_id or 0, leaf), doc_id, leaf, other))
    names = sorted(langs, key=lambda x: (x is not None, (x or "").encode()))
    lows = {x: climb([r[2] for r in sorted(langs[x])]) for x in names}
    root, tops = climb([lows[x][0] for x in names]) if names else (None, [])
    out = []
    for k, x in enumerate(names):
        for (_, doc_id, leaf, other), path in zip(sorted(langs[x]), lows[x][1], strict=True):
            done = other
            for a, b in path + tops[k]:
                done = sha(a + done + b)
            out.append((doc_id, leaf, lows[x][0], root, sha("".join(a + b for a, b in path + tops[k])), done, done == root))
    return sorted(map(str, out))


PROOF = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


@pytest.fixture
def manifest_of(spark, tmp_path):
    def run(df):
        df.coalesce(3).write.parquet(f"{tmp_path}/documents.parquet")
        return sorted(str(tuple(r[c] for c in PROOF)) for r in merkle.op13_merkle_manifest(spark, str(tmp_path)).collect())

    return run


def test_manifest_of_odd_rows(odd, odd_rows, manifest_of):
    assert manifest_of(odd) == plain_manifest(odd_rows)


def test_manifest_of_nothing(nothing, manifest_of):
    assert manifest_of(nothing) == []


@pytest.mark.parametrize("n", [1, 2, 3, 255, 256, 257, 513, 65_537])
def test_manifest_at_the_edges_of_blocks_and_tiers(spark, manifest_of, n):
    rows = [(k, f"text {k % 5}", "en", "s", k) for k in range(n)] + [(n + k, "x", f"lang{k}", None, None) for k in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert manifest_of(df) == plain_manifest(rows)


def test_manifest_against_sql_with_nulls(spark, odd, odd_rows, manifest_of):
    arrow = pa.table({c: pa.array([r[k] for r in odd_rows], pa.int64() if c in ("doc_id", "n_chars") else pa.string()) for k, c in enumerate(("doc_id", "text", "lang", "source", "n_chars"))})
    con = duckdb.connect()
    con.register("documents", arrow)
    rel = con.sql(merkle.OP13_SQL)
    assert sorted(str(tuple(r[rel.columns.index(c)] for c in PROOF)) for r in rel.fetchall()) == manifest_of(odd)


def test_manifest_has_no_python_and_no_group_above_a_block(spark, sf):
    df = merkle.op13_merkle_manifest(spark, sf)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
