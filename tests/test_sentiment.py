"""The scorer that learns: against plain sums, by held-out rows, and in the document source."""

from __future__ import annotations

import math
import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemark.operators import sentiment
from tidemark.plans.documents import linear_sentiment
from tidemark.sources import plugins


def plain(model, text):
    words = re.findall(r"[^\W\d_]+", (text or "").lower())
    if not words:
        return "neutral", 0.0
    mean = np.zeros(3)
    for low in range(0, len(words), sentiment.CHUNK):
        chunk = words[low : low + sentiment.CHUNK]
        raw = np.array([sum(w[zlib.crc32(x.encode()) % sentiment.BUCKETS] for x in chunk) / len(chunk) + b for w, b in zip(model.weights, model.base, strict=True)])
        odds = np.exp(np.clip(raw, -50, 50))
        mean += odds / odds.sum() * len(chunk)
    mean /= len(words)
    label = sentiment.LABELS[int(mean.argmax())]
    return label, round(mean.max() * {"negative": -1, "neutral": 0, "positive": 1}[label], 4) + 0.0


def test_scores_are_plain_sums_over_chunks(spark):
    rng = np.random.default_rng(1)
    model = sentiment.Linear(rng.normal(0, 40, (3, sentiment.BUCKETS)), np.array([0.1, 0.0, -0.1]))
    texts = [None, "", " 12 -- ", "one", "Été à Köln", " ".join(f"w{chr(97 + k % 26)}{chr(97 + k % 7)}" for k in range(3_000)), "same " * 257]
    df = spark.createDataFrame([(k, t, "kept") for k, t in enumerate(texts)], "id long, t string, label string")
    rows = {r.id: r for r in model.score(df, "t").collect()}
    for k, t in enumerate(texts):
        label, score = plain(model, t)
        assert rows[k].sentiment_label == label and math.isclose(rows[k].sentiment_score, score, abs_tol=1.1e-4) and rows[k].label == "kept"
    assert "Python" not in model.score(df, "t")._jdf.queryExecution().executedPlan().toString()


def test_texts_are_taken_apart_once_to_be_learned(spark):
    """Not once for each chunk of a text, and not once for each pass of the fit."""
    df = spark.createDataFrame([("one two " * 300, "negative"), *[("three " * 10, "positive")] * 5, ("", "positive"), ("three", None)], "t string, label string")
    plan = df.select(sentiment.chunks(sentiment.buckets(F.col("t"))).alias("c"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    given = []

    def store(rows):
        given.append(rows)
        return spark.createDataFrame(rows.collect(), rows.schema)

    sentiment.fitted(df, "t", "label", store=store)
    assert len(given) == 1 and given[0]._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all") == 1
    assert sorted((r.label, round(r.weight, 3), len(r.chunk)) for r in given[0].collect()) == [(0.0, 0.333, 88), (0.0, 0.333, 256), (0.0, 0.333, 256), *[(2.0, 1.0, 10)] * 5]


def test_what_it_learns_holds_for_other_texts(spark):
    words = {"negative": "crash slump default", "positive": "growth gain boom", "neutral": "meeting agenda minutes"}
    rows = [(f"the {w} of day {k} and some more words about it {w} {chr(97 + k % 26)}", label) for label, ws in words.items() for w in ws.split() for k in range(30)]
    df = spark.createDataFrame([*rows, ("unlabelled", None), ("odd", "other"), (None, "positive")], "t string, label string")
    model = sentiment.fitted(df, "t", "label")
    seen = spark.createDataFrame([("a new slump and default elsewhere", "negative"), ("boom and growth ahead", "positive"), ("agenda for the meeting", "neutral")], "t string, want string")
    assert all(r.sentiment_label == r.want and (r.sentiment_score < 0) == (r.want == "negative") for r in model.score(seen, "t").collect())
    source = plugins.documents(model.score)
    landed = spark.createDataFrame([("fed", "2024-01-01T00:00:00Z", None, "u", "Slump and default", None, None, None, ("x",), "f", 0, 0)], "source string, timestamp_collected string, timestamp_published string, url string, title string, content string, document_type string, speaker string, metadata struct<author:string>, _file string, _block long, _pos long")
    row = source.clean(landed).first()
    assert row.sentiment_label == "negative" and row.sentiment_score < -0.5 and source.validate(source.clean(landed))
    assert plugins.documents().clean(landed).first().sentiment_label == "negative"  # "default" is in the list of words


def test_labels_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    found = linear_sentiment(spark, sf)
    assert found.count() == spark.read.parquet(f"{sf}/documents.parquet").count() == found.where("sentiment_label is not null and abs(sentiment_score) <= 1").count()
    toxic = spark.read.parquet(f"{sf}/labels.parquet").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    rows = found.join(toxic, "doc_id").groupBy("held_out", "toxic").agg(F.avg((F.col("sentiment_label") == "negative").cast("int")).alias("share")).collect()
    share = {(r.held_out, r.toxic): r.share for r in rows}
    assert share[True, 0] < 0.1 and share[False, 1] > 0.8
