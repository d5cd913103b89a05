"""SimHash near-duplicates and components."""

from __future__ import annotations

import numpy as np
import pytest
import xxhash

from tidemark.llm import simhash
from tidemark.llm.graph import components


def fingerprint(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[k : k + 4]) for k in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] * bool(words)
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(values, radius=4):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = list(values)
    for k, a in enumerate(values):
        for b in values[k + 1 :]:
            if (a ^ b).bit_count() <= radius:
                parent[find(a)] = find(b)
    return {v: find(v) for v in values}


def want(rows):
    prints = [fingerprint(t) for _, t in rows]
    root = classes(set(prints))
    name = {}
    for (d, _), p in zip(rows, prints, strict=True):
        if d is not None:
            name[root[p]] = min(d, name.get(root[p], d))
    return sorted((str(d), f"{p:016x}", name.get(root[p])) for (d, _), p in zip(rows, prints, strict=True))


def test_odd_rows(odd, odd_rows, nothing):
    found = simhash.near_duplicates(odd).collect()
    assert sorted((str(r.doc_id), f"{r.fp & (1 << 64) - 1:016x}", r.component_id) for r in found) == want([r[:2] for r in odd_rows])
    assert simhash.near_duplicates(nothing).count() == 0


def test_query_over_the_whole_table(spark, sf):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.op9_simhash_near_dedup(spark, sf).collect()) == want(docs)


def test_masks_cover_every_pair_within_the_radius():
    rng = np.random.default_rng(0)
    masks = simhash.masks(4)
    assert len(masks) == 31
    for _ in range(3000):
        off = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False))
        assert any(not m & off for m in masks)
        assert all(any(not m & off for m in simhash.finer(4, level)) for level in (1, 2, 3))


@pytest.mark.parametrize("large", [8192, 25])
def test_links_connect_all_and_stay_few(spark, large):
    rng = np.random.default_rng(1)
    centres, values = rng.integers(0, 1 << 62, 3), set()
    for k in range(700):
        v = int(centres[k % 3])
        for b in rng.integers(0, 64, rng.integers(0, 8)):
            v ^= 1 << int(b)
        values.add(v)
    signed = {simhash.signed(v): v for v in values}
    links = simhash.links(spark.createDataFrame([(s,) for s in signed], "fp long").repartition(4), 4, large)
    parent = {s: s for s in signed}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    rows = links.collect()
    for r in rows:
        assert (signed[r.a] ^ signed[r.b]).bit_count() <= 4
        parent[find(r.a)] = find(r.b)
    root = classes(values)
    groups, own = {}, {}
    for s, v in signed.items():
        groups.setdefault(root[v], set()).add(v)
        own.setdefault(find(s), set()).add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))
    if large > 1000:
        assert len(rows) < 31 * len(values)
    found = {r.a: r.b for r in components(links).collect()}
    assert {s: found.get(s, s) for s in signed} == {s: min(simhash.signed(v) for v in groups[root[signed[s]]]) for s in signed}


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(900, 901), (5, 5)], "a long, b long")
    assert {r.a: r.b for r in components(edges).collect()} == {k: 0 for k in range(1, 301)} | {901: 900}


def test_one_document_of_each_class_stays(odd, odd_rows):
    kept = simhash.deduplicated(odd).collect()
    assert kept and set(kept[0].asDict()) == set(odd.columns)
    rows = want([r[:2] for r in odd_rows])
    assert sorted(str(r.doc_id) for r in kept if r.doc_id is not None) == sorted({str(c) for d, _, c in rows if d != "None"})
    # of the rows without an id one is empty, as others are, and the other one is the only one of its class
    assert [r.text[:5] for r in kept if r.doc_id is None] == ["no id"]


PROSE = "the quick brown fox jumps over a lazy dog while seven wizards quietly watch from beyond the old stone bridge near town"
OTHER = "an entirely different text about ships that sail at dawn with grain and salt for cities on the far coast of the sea"


@pytest.mark.parametrize(
    ("rows", "stay"),
    [
        ([(3, PROSE), (7, PROSE), (7, OTHER)], [(3, PROSE), (7, OTHER)]),
        ([(None, PROSE), (None, PROSE), (None, OTHER)], [(None, OTHER), (None, PROSE)]),
        ([(None, PROSE), (5, PROSE), (5, PROSE), (5, PROSE)], [(5, PROSE)]),
        ([(1, OTHER), (1, PROSE), (2, OTHER), (2, PROSE)], [(1, OTHER), (1, PROSE)]),
        ([], []),
    ],
)
def test_rows_are_told_apart_by_more_than_their_id(spark, rows, stay):
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(stay, key=str)


def test_the_last_dealing_leaves_few_free_bits():
    assert max(64 - (m | f).bit_count() for m in simhash.masks(4) for f in simhash.finer(4, simhash.LEVELS[-1])) == 25


def test_a_dense_bucket_is_spanned_quickly():
    members = np.random.default_rng(5).choice(1 << 20, 60_000, replace=False).astype(np.uint64)
    left, right = simhash.spanning(members, 4)
    assert sum(map(len, left)) == sum(map(len, right)) == len(members) - 1
