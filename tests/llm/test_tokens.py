"""Token counts of prefixes, and token files."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.llm import bpe, token_counts, token_files

PIECES = ["a", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "ll", "l", "é", "\u2003", "\u2028\u3000", "\u1680", "日本", "12", "3", "!", "!!", "<|endoftext|>", "<|endof", "\xa0", "½", "😀", "\x1c", "\x85", "Ab", "_", "\u200b", "́", " Thesting", ".\nAnd"]


@pytest.fixture(scope="module")
def library():
    return bpe.vocabulary(bpe.default_path()).tokenizer


def ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_every_prefix_has_the_librarys_count(library):
    rng, counts = random.Random(1), bpe.UnitCounts(bpe.default_path())
    texts = ["".join(rng.choice(PIECES) for _ in range(rng.randint(1, 9))) for _ in range(400)]
    steps, cuts = counts.of(pa.array(texts))
    for text, low, high in zip(texts, cuts, cuts[1:], strict=False):
        assert np.cumsum(steps[low:high]).tolist() == [len(ids(library, text[:k])) for k in range(1, len(text) + 1)]


def test_many_special_strings_in_a_row(library):
    text = "<|endoftext|>" * 2000 + "x"
    steps, _ = bpe.UnitCounts(bpe.default_path()).of(pa.array([text]))
    counts = np.cumsum(steps)
    assert counts[-1] == len(ids(library, text)) == 2001
    assert [counts[k] for k in (12, 13, 20)] == [len(ids(library, text[: k + 1])) for k in (12, 13, 20)]


def test_unit_ids_are_the_librarys(library, monkeypatch):
    rng, units = random.Random(2), bpe.UnitIds(bpe.default_path())
    monkeypatch.setattr(bpe, "KEPT_BYTES", 3000)  # so that kept units are given up on the way
    for _ in range(40):
        texts = [None if rng.random() < 0.05 else "".join(rng.choice(PIECES) for _ in range(rng.randint(0, 12))) for _ in range(30)]
        found, cuts = units.of(pa.array(texts, pa.string()))
        assert [found[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)] == [ids(library, t or "") for t in texts]


def test_white_space_is_the_librarys(library):
    split = library.pre_tokenizer.pre_tokenize_str
    for code in [*range(1, 0x3100), 0xFEFF]:
        if chr(code) in bpe.WHITE:
            assert bpe.UNIT.findall(f"a{chr(code)}b") == ["a", f"{chr(code)}b"]
        elif not 0xD800 <= code < 0xE000:
            # what is no white space never parts units, so the library must not take it for white space either
            assert len(split(f"{chr(code)}{chr(code)}!")) < 4


def test_counts_of_odd_rows(odd, odd_rows, nothing, library):
    found = token_counts.token_prefixes(odd, budget=10).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in found) == sorted((str(d), len((t or "").encode()), len(ids(library, t or ""))) for d, t, *_ in odd_rows)
    for r in found:
        counts = np.cumsum(np.frombuffer(r.steps, "<i2"))
        assert r.cut_chars == max([k + 1 for k, n in enumerate(counts) if n <= 10], default=0)
    assert token_counts.token_prefixes(nothing).count() == 0


def test_questions_to_stored_steps(odd, odd_rows, library):
    at = token_counts.token_prefixes(odd).where("doc_id = 5").select(token_counts.tokens_at("steps", F.lit(12)).alias("n"), token_counts.longest_within("steps", F.lit(3)).alias("k")).first()
    text = next(t for d, t, *_ in odd_rows if d == 5)
    assert at.n == len(ids(library, text[:12]))
    assert len(ids(library, text[: at.k])) <= 3 < len(ids(library, text[: at.k + 1]))


def test_token_files_round_trip(spark, odd, odd_rows, nothing, library, tmp_path):
    token_files.write_ids(odd, f"{tmp_path}/ids")
    found = token_files.read_ids(spark, f"{tmp_path}/ids").orderBy("start").collect()
    rows = sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for r, (doc_id, text, *_) in zip(found, rows, strict=True):
        want = [*ids(library, text or ""), 0]
        assert (r.doc_id, r.start, r.n_tokens, r.ids) == (doc_id, start, len(want), want)
        assert r.ids_crc32 == zlib.crc32(np.array(want, "<u4").tobytes())
        start += len(want)
    token_files.write_ids(nothing, f"{tmp_path}/none")
    assert token_files.read_ids(spark, f"{tmp_path}/none").count() == 0


def test_grammar_shortens_and_gives_random_access():
    rng = np.random.default_rng(3)
    phrase = rng.integers(0, 50_000, (20, 12))
    docs = [np.append(phrase[rng.integers(0, 20, n)].ravel(), 0) for n in rng.integers(0, 60, 80)]
    sizes = np.array([len(d) for d in docs])
    data = token_files.pack(list(range(80)), np.concatenate(docs), sizes)
    block = token_files.Block(data)
    assert len(block.symbols) < sizes.sum() / 3 and len(block.rules)
    for k, doc in enumerate(docs):
        assert block.document(k).tolist() == doc.tolist()
        assert block.document(k, 3, 17).tolist() == doc[3:17].tolist()
    with pytest.raises(ValueError):
        token_files.Block(b"other" + data[5:])


@pytest.mark.parametrize("letters", [1, 3, 40, 70_000])
def test_no_pair_is_left_that_occurs_often(letters):
    rng = np.random.default_rng(letters)
    docs = [np.append(rng.integers(0, letters, n), 0) for n in [0, 1, 2, 3, 500, 3000, 90_000]]
    docs += docs[4:6] * 20
    sizes = np.array([len(d) for d in docs])
    alphabet, symbols, share, rules = token_files.repair(np.concatenate(docs), sizes)
    inner = np.ones(len(symbols), bool)
    inner[np.cumsum(share) - 1] = False
    pairs = np.stack([symbols[:-1], symbols[1:]])[:, inner[:-1]]
    assert not pairs.size or np.unique(pairs, axis=1, return_counts=True)[1].max() < token_files.LEAST
    assert len({tuple(r) for r in rules.tolist()}) == len(rules)
    block = token_files.Block(token_files.pack(list(range(len(docs))), np.concatenate(docs), sizes))
    assert all(block.document(k).tolist() == d.tolist() for k, d in enumerate(docs))


def test_a_repeated_id_is_spread_over_tasks(spark, tmp_path):
    rows = [(7, f"text {k} " * 50) for k in range(4000)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        token_files.write_ids(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), f"{tmp_path}/ids")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{tmp_path}/ids").select("shard").distinct().count() > 1


def test_query_over_the_whole_table(spark, sf, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in token_counts.op1_token_counts(spark, sf).collect():
        n = len(ids(library, docs[r.doc_id]))
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)
    start = 0
    for r in token_files.op6_token_files(spark, sf).orderBy("doc_id").collect():
        assert (r.start, r.n_tokens) == (start, len(ids(library, docs[r.doc_id])) + 1)
        start += r.n_tokens
