"""Deleted interpolation against dictionaries, exact expectation-maximisation, and the law that probabilities sum to one."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import lm_scores as lm

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER)), " "]


def rest(doc_id):
    return None if doc_id is None else zlib.crc32(str(doc_id).encode()) % 7


def counted(rows, choose):
    words, pairs = Counter(), Counter()
    for doc_id, text, *_ in rows:
        if choose(rest(doc_id)):
            own = tokens_of(text)
            words.update(own)
            pairs.update(zip([" ", *own], own, strict=False))
    return words, pairs


def exact_weights(rows):
    """Expectation-maximisation over the deleted tokens themselves, without cells."""
    words, pairs = counted(rows, lambda r: r not in (2, 3))
    vocabulary = len(counted(rows, lambda r: r != 2)[0])
    total = sum(words.values())
    events = [(words[h], pairs[h, w] / max(words[h], 1), words[w] / max(total, 1)) for doc_id, text, *_ in rows if rest(doc_id) == 3 for own in [tokens_of(text)] for h, w in zip([" ", *own], own, strict=False)]
    table = np.array([(c.bit_length(), 1.0, p, q) for c, p, q in events], float).reshape(-1, 4)
    return lm.mixture_weights(table, 1 / (vocabulary + 1))


def learned(docs):
    r = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7
    tokens = lm.shards(docs, ~F.coalesce(r == 2, F.lit(False)), r == 3)
    replies = lm.answers(tokens)
    return tokens, replies, lm.mixture(tokens, replies)


@pytest.fixture
def op12(spark, tmp_path):
    def run(df):
        df.write.parquet(f"{tmp_path}/documents.parquet")
        return lm.op12_lm_scores(spark, str(tmp_path)).collect()

    return run


def plain(rows, weights):
    words, pairs = counted(rows, lambda r: r != 2)
    total, vocabulary = sum(words.values()), len(words)
    out = []
    for doc_id, text, *_ in rows:
        own, base, score = tokens_of(text), 0.0, 0.0
        for h, w in zip([" ", *own], own, strict=False):
            base += math.log10((words[w] + 1) / (total + 1 * (vocabulary + 1)))
            a, b, c = weights[words[h].bit_length()]
            score += math.log10(a * pairs[h, w] / max(words[h], 1) + b * words[w] / max(total, 1) + c / (vocabulary + 1))
        out.append((str(doc_id), rest(doc_id) == 2, len(own), sum(words[w] > 0 for w in own), total, round(base, 6), round(score, 6)))
    return sorted(out)


def test_scores_are_the_plain_ones(spark, odd, odd_rows, op12):
    weights = learned(odd)[2].weights
    found = sorted((str(r["doc_id"]), r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in op12(odd))
    assert found == plain(odd_rows, weights)


def test_many_ranges_answer_as_one_does(spark, odd, odd_rows, monkeypatch):
    tokens, replies, model = learned(odd)
    monkeypatch.setattr(lm, "RANGE_KEYS", 1000)
    many = lm.answers(tokens)
    assert many.select("bucket").distinct().count() == 32 and replies.select("bucket").distinct().count() == 1
    assert sorted(lm.scored(tokens, many, model).collect(), key=str) == sorted(lm.scored(tokens, replies, model).collect(), key=str)


def test_weights_are_those_of_exact_expectation_maximisation(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    tokens, replies, model = learned(docs)
    assert np.abs(model.weights - exact_weights(rows)).max() < 0.02
    # more of the held-out text is foretold than by words alone
    held = lm.scored(tokens, replies, model).where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2)
    sums = held.agg(F.sum("base_score"), F.sum("score")).first()
    assert sums[1] > sums[0]
    # all words and the unknown one share 1
    words, pairs = counted(rows, lambda r: r != 2)
    names = list(words)
    for h in (" ", names[0], names[len(names) // 2], "never seen"):
        p = model(np.full(len(names) + 1, words[h]), np.array([*(pairs[h, w] for w in names), 0]), np.array([*(words[w] for w in names), 0]))
        assert math.isclose(p.sum(), 1, rel_tol=1e-9)


def test_nothing_and_nothing_learned(spark, nothing, op12):
    assert op12(nothing) == []
    assert lm.mixture_weights(np.zeros((0, 4)), 1.0)[5].tolist() == [1 / 3] * 3
    held = [k for k in range(100) if rest(k) == 2][:3]
    df = spark.createDataFrame([(k, "some words here") for k in held], "doc_id long, text string")
    tokens, replies, model = learned(df)
    assert [(r["n_known"], r["base_score"], round(r["score"], 9)) for r in lm.scored(tokens, replies, model).collect()] == [(0, 0.0, round(4 * math.log10(0.5), 9))] * 3 and model.n_learned == 0


def test_a_word_that_all_texts_hold_costs_one_entry_a_shard(spark, monkeypatch):
    docs = spark.range(0, 3_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("same words same words "), F.col("id").cast("string")).alias("text")).repartition(4)
    tokens = lm.shards(docs, F.lit(True), F.lit(False))
    asked = lm.asks(tokens, 4)
    sizes = [len(lm.unpacked(r["keys"], "<u8")) for r in asked.collect()]
    distinct = 3 + 3_000 + 4 + 6_000  # words with the end, and pairs
    assert sum(sizes) <= distinct + 4 * 10
