"""Decontamination, mixing, WARC audit and the pipeline."""

from __future__ import annotations

import collections
import glob
import gzip
import hashlib
import os
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidemark.llm import decontaminate, mixing, simhash, token_files, toxicity, warc

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def similarities(docs, items, whole=False):
    """Best similarity of each text and item over the windows of the item's length, where it is at least 0.8.

    ``whole``: windows start at every word, else only where one of the item's shingles stands.
    """
    out = {}
    for item_id, item in items:
        own = words(item)
        size = min(5, len(own))
        bag = collections.Counter(tuple(own[k : k + size]) for k in range(len(own) - size + 1)) if own else {}
        n = len(own) - size + 1
        for doc_id, text in docs if own else []:
            w = words(text)
            grams = [tuple(w[k : k + size]) for k in range(len(w) - size + 1)]
            best = 0
            for start in range(len(grams)) if whole else [k for k, g in enumerate(grams) if g in bag]:
                window = collections.Counter(grams[start : start + n])
                both = sum(min(c, bag[g]) for g, c in window.items() if g in bag)
                best = max(best, both / (sum(window.values()) + n - both))
            if best >= 0.8:
                out[doc_id, item_id] = round(best, 9)
    return out


def table(spark, sf, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/{name}.parquet").select(*columns).collect()]


def test_leaks_query(spark, sf):
    found = decontaminate.op5_decontamination(spark, sf).collect()
    want = similarities(table(spark, sf, "documents", "doc_id", "text"), table(spark, sf, "benchmark", "item_id", "text"))
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in found} == want and len(found) == len(want) > 0


def test_leaks_with_edits():
    rng = random.Random(4)
    known = [f"w{k}" for k in range(60)]
    items = [(k, " ".join(rng.choice(known) for _ in range(rng.randint(1, 60)))) for k in range(40)]
    docs = []
    for k in range(300):
        own = words(items[rng.randrange(40)][1])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            own[rng.randrange(len(own))] = rng.choice(known)
        own = own[rng.randint(0, 3) :]
        docs.append((k, " ".join([rng.choice(known) for _ in range(rng.randint(0, 30))] + own + [rng.choice(known) for _ in range(rng.randint(0, 30))])))
    index = decontaminate.Index([str(k) for k, _ in items], [t for _, t in items])
    found = {(docs[t][0], int(index.keys[i])): round(s, 9) for t, i, _, _, s in index.search([t for _, t in docs])}
    assert found == similarities(docs, items) == similarities(docs, items, whole=True)


def test_most_windows_at_the_least_similarity_lie_within_the_radius():
    rng = np.random.default_rng(1)
    near = []
    for n in (27, 45, 90, 180):  # shingles of an item; a ninth of them changed gives 8 / 10
        for _ in range(500):
            own = rng.integers(0, 1 << 63, n, np.uint64)
            other = own.copy()
            other[: n // 9] = rng.integers(0, 1 << 63, n // 9, np.uint64)
            a, b = (decontaminate.simhash(x, np.array([0])).view(np.uint64) for x in (own, other))
            near.append(int(np.bitwise_count(a ^ b).sum()) <= decontaminate.RADIUS)
    assert np.mean(near) > 0.99


def test_leaks_in_odd_rows(spark, odd, odd_rows, nothing, monkeypatch):
    prose = next(t for d, t, *_ in odd_rows if d == 4)
    items = spark.createDataFrame([(1, prose), (2, None), (None, prose), (3, ""), (4, "Word"), (1, prose)], "item_id long, text string")
    want = collections.Counter()
    for d, t, *_ in odd_rows:
        for item_id, item in ((1, prose), (None, prose), (4, "word"), (1, prose)):
            want[d, item_id] += bool(similarities([(0, t)], [(0, item)]))
    found = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect())
    assert found == +want
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 40)  # more passes, same result
    assert collections.Counter((r.doc_id, r.item_id) for r in decontaminate.leaks(odd, items).collect()) == found
    kept = decontaminate.without_leaks(odd, items)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()}.isdisjoint({d for d, _ in found if d is not None})
    assert decontaminate.leaks(nothing, items).count() == decontaminate.leaks(odd, items.limit(0)).count() == 0


def test_mix_meets_its_targets(spark, odd, odd_rows, nothing):
    rows = mixing.planned(odd).collect()
    size = collections.Counter()
    for _, t, _, s, _ in odd_rows:
        size[s] += len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    left, free, target = 1.5 * sum(size.values()), set(order), {}
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = [s for s in free if share[s] >= 2 * size[s]]
        if not full:
            break
        for s in full:
            target[s] = 2.0 * size[s]
            left -= target[s]
            free.discard(s)
        if not free:
            break
    target |= share if free else {}
    taken = collections.Counter()
    for r in rows:
        assert r._mix_target == pytest.approx(target[r.source]) and r._mix_source_size == size[r.source] and 0 <= r._mix_n <= 2
        taken[r.source] += r._mix_n * r._mix_size
    assert len(rows) == len(odd_rows)
    assert taken["hot"] == pytest.approx(target["hot"], abs=30)
    mix = mixing.mixed(odd)
    assert mix.columns == odd.columns and mix.count() == sum(r._mix_n for r in rows)
    assert mixing.planned(nothing).count() == mixing.mixed(nothing).count() == 0


def test_mix_is_near_its_targets_and_repeats(spark):
    sf = "/root/testdata/sf0.01"
    rows = mixing.op3_source_mixing(spark, sf)
    source = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "source")
    off = rows.join(source, "doc_id").groupBy("source").agg((F.abs(F.sum("taken") - F.max("target")) / F.max("target")).alias("off"))
    assert off.agg(F.max("off")).first()[0] < 0.03
    assert rows.exceptAll(mixing.op3_source_mixing(spark, sf)).count() == 0


PAGES = [(k, f"http://p/{k}", f"<html>\r\n\r\nWARC/1.0\r\nContent-Length: {k} é😀</html>" * (k % 3)) for k in range(600)] + [(None, None, None), (None, "u", "x"), (5, "again", ""), (5, "again", "")]


def test_archives_round_trip(spark, tmp_path):
    pages = spark.createDataFrame([(*p, "clash") for p in PAGES], "page_id long, url string, html string, place string")
    found = warc.records(pages)
    catalogue = warc.catalogued(found)
    warc.write_archives(found, f"{tmp_path}/a")
    back = warc.read_archives(spark, f"{tmp_path}/a")
    assert back.count() == len(PAGES)
    assert back.exceptAll(catalogue.select(back.columns)).count() == 0
    assert warc.audit(warc.tree(catalogue), warc.tree(back)).count() == 0


def test_audit_finds_damage_loss_and_foreign_records(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    good = warc.catalogued(warc.records(pages))
    bad = good.where("page_id is null or page_id <> 17").withColumn("sha256", F.when(F.col("page_id").isin(300, 301), "broken").otherwise(F.col("sha256")))
    bad = bad.unionByName(good.where("page_id = 599").withColumn("place", F.col("place") + 1))
    trees = warc.tree(good), warc.tree(bad)
    assert [t[-1].count() for t in trees] == [2, 2]  # one above place zero and one below
    assert warc.tree(good.where("page_id is not null"))[-1].count() == 1
    places = {(r.archive, r.place): r.page_id for r in good.collect()}
    assert sorted(str(places.get((r.archive, r.node))) for r in warc.audit(*trees).collect()) == ["17", "300", "301", "None"]
    none = warc.tree(good.limit(0))
    assert warc.audit(none, none).count() == 0


def test_extreme_ids_and_urls_with_line_breaks(spark, tmp_path):
    rows = [((1 << 63) - 1, "u", "x"), (-(1 << 63), "u", "y"), (1 << 55, "a\r\n\r\nb", "z"), (3, "\r\n", None), (4, "v", "w")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = warc.records(pages)
    catalogue = warc.catalogued(found)
    warc.write_archives(found, f"{tmp_path}/a")
    back = warc.read_archives(spark, f"{tmp_path}/a")
    assert back.exceptAll(catalogue.select(back.columns)).count() == 0 and back.count() == len(rows)
    bad = back.where("page_id <> 4")
    assert [(r.archive, r.node) for r in warc.audit(warc.tree(catalogue), warc.tree(bad)).collect()] == [(0, 4)]
    con = duckdb.connect()
    con.sql("CREATE TABLE pages (page_id BIGINT, url VARCHAR, html VARCHAR)")
    con.executemany("INSERT INTO pages VALUES (?, ?, ?)", rows)
    want = {r[0]: r[2:5] for r in con.sql(f"SELECT page_id, archive, \"offset\", length, sha256 FROM ({warc.OP7_SQL})").fetchall()}
    assert {r.page_id: (r.offset, r.length, r.sha256) for r in catalogue.collect()} == want


def test_more_repeats_than_places(spark):
    n = warc.REPEATS + 3
    pages = spark.range(n).select(F.lit(7).cast("long").alias("page_id"), F.col("id").cast("string").alias("url"), F.lit("x").alias("html"))
    good = warc.catalogued(warc.records(pages.unionByName(spark.createDataFrame([(300, "u", "x")], "page_id long, url string, html string")))).cache()
    assert good.where("archive = 0").agg(F.max("place")).first()[0] < 1 << warc.PLACE_BITS
    lost = good.where("page_id = 300 or offset > 0")
    found = warc.unlike(good, lost, warc.audit(warc.tree(good), warc.tree(lost))).collect()
    assert [(r.archive, r.offset) for r in found] == [(0, 0)]


def test_a_truncated_archive_ends_in_one_odd_record():
    data = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:1>\r\nContent-Length: 2\r\n\r\nab\r\n\r\nWARC/1.0\r\nContent-Length: 9\r\n\r\nab"
    assert [(r[0], r[1]) for r in warc.parsed(data)] == [(1, 0), (None, 67)]


def test_audit_of_archives_changed_on_disk(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://p/{k}", f"<html>{hashlib.sha256(str(k).encode()).hexdigest() * 9}</html>") for k in range(1280)] + [(700, "again", "a"), (700, "again", "b")], "page_id long, url string, html string")
    found = warc.records(pages)
    catalogue = warc.catalogued(found).cache()
    warc.write_archives(found, f"{tmp_path}/a")
    files = {k: glob.glob(f"{tmp_path}/a/archive={k}/*.gz")[0] for k in range(5)}
    raw = {k: open(f, "rb").read() for k, f in files.items()}
    rows = {(r.archive, r.offset): r for r in catalogue.collect()}
    at = {k: sorted((r.offset, r.length) for r in rows.values() if r.page_id == k) for k in (10, 520, 700)}

    def put(k, content):
        os.remove(files[k])
        with open(f"{os.path.dirname(files[k])}/part-again.gz", "wb") as f:
            f.write(content)

    (low, size), text = at[10][0], gzip.decompress(raw[0])
    put(0, gzip.compress(text[:low] + text[low + size :]))  # one record lost
    put(1, raw[1][: len(raw[1]) // 2] + bytes([raw[1][len(raw[1]) // 2] ^ 255]) + raw[1][len(raw[1]) // 2 + 1 :])  # a byte flipped
    text = gzip.decompress(raw[2])
    (low, size), (low2, size2) = at[520][0], at[700][0]
    foreign = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:9999>\r\nContent-Length: 1\r\n\r\nx\r\n\r\n"
    put(2, gzip.compress(foreign + text[: low + size - 1] + b"?" + text[low + size : low2] + text[low2 + size2 :]))  # foreign, a separator, one of three repeats
    put(3, raw[3][: len(raw[3]) // 3])  # cut off
    put(4, raw[4][:-8] + bytes([raw[4][-8] ^ 1]) + raw[4][-7:])  # only the check sum is wrong
    replica = warc.read_archives(spark, f"{tmp_path}/a")
    bad = warc.audit(warc.tree(catalogue), warc.tree(replica))
    gone = [rows[r.archive, r.offset] for r in warc.unlike(catalogue, replica, bad).collect()]
    by = {k: sorted(r.page_id for r in gone if r.archive == k) for k in range(5)}
    assert by[0] == [10] and by[2] == [520, 700] and by[4] == []
    assert [r.offset for r in gone if r.page_id == 700] == [low2]
    assert 0 < len(by[1]) < 256 and by[3] == list(range(by[3][0], 1024)) and 768 < by[3][0]
    assert {r.archive for r in bad.collect()} == {0, 1, 2, 3, 4}


def test_fixity_query_against_its_sql(spark, sf):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{sf}/pages.parquet'")
    want = con.sql(warc.OP7_SQL)
    found = warc.op7_warc_fixity(spark, sf)
    assert sorted(map(repr, map(tuple, found.select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_rows_without_an_id_against_the_sql(spark, tmp_path):
    spark.createDataFrame([(None, "u", "x"), (None, None, None), (5, "v", "y")], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = con.sql(warc.OP7_SQL)
    assert sorted(map(repr, map(tuple, warc.op7_warc_fixity(spark, str(tmp_path)).select(want.columns).collect()))) == sorted(map(repr, want.fetchall()))


def test_a_separator_is_part_of_the_audit():
    data = b"WARC/1.0\r\nContent-Length: 2\r\n\r\nab\r\n\r\n"
    other = data[:-1] + b"x"
    assert [r[3] for r in warc.parsed(data)] != [r[3] for r in warc.parsed(other)]


def test_stages_do_what_their_operators_say(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    now = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        new = stage(spark, now, sf).cache()
        assert new.columns == docs.columns
        if name == "toxicity":
            scores = toxicity.scored(now, toxicity.learned(now, spark.read.parquet(f"{sf}/labels.parquet")))
            assert {r.doc_id for r in new.collect()} == {r.doc_id for r in scores.where("score < 0.5").collect()}
        if name == "simhash_near_dedup":
            assert {r.doc_id for r in new.collect()} == {r.component_id for r in simhash.near_duplicates(now).collect()}
        if name == "benchmark_decontamination":
            leaked = {d for d, _ in similarities(table_of(now), table(spark, sf, "benchmark", "item_id", "text"))}
            assert {r.doc_id for r in new.collect()} == {r.doc_id for r in now.collect()} - leaked
        if name == "source_mixing":
            plan = {r.doc_id: r._mix_n for r in mixing.planned(now).collect()}
            assert collections.Counter(r.doc_id for r in new.collect()) == +collections.Counter(plan)
        now = new
    last = corpus_pipeline.STAGES[-1][1](spark, now, sf)
    texts = collections.Counter(r.doc_id for r in now.collect())
    assert collections.Counter(r.doc_id for r in last.collect()) == texts
    run = corpus_pipeline.run(spark, sf)
    assert run.columns == last.columns and run.exceptAll(last).count() == last.exceptAll(run).count() == 0


def table_of(df):
    return [(r.doc_id, r.text) for r in df.collect()]


def test_pipeline_takes_odd_rows(spark, odd, sf):
    now = odd
    for _, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf)
    assert now.count() > 0
    assert token_files.BLOCK_IDS > 0
