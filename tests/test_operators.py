"""Operators on small tables: order, NULLs, contracts, files, storage."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.contracts import EVENTS, MACRO, OHLCV
from tidemark.operators import calendar, dedup, macro, news, pages, prices, quality, scoring, store
from tidemark.sources import files, sinks


@pytest.mark.parametrize("parts", [1, 8])
def test_first_and_last_do_not_depend_on_partitions(spark, parts):
    rows = [(k % 3, k, f"v{k}" if k else None) for k in range(60)]
    df = spark.createDataFrame(rows, "key long, pos long, v string").repartition(parts)
    assert sorted((r.key, r.v) for r in dedup.deduplicated(df, ["key"], ["pos"]).collect())[0] == (0, None)
    assert {r.v for r in dedup.deduplicated(df, ["key"], ["pos"], keep="last").collect()} == {"v57", "v58", "v59"}
    filled = dedup.forward_filled(df.withColumn("v", F.when(F.col("pos") % 4 == 0, F.col("v")).otherwise("")), "v", ["key"], ["pos"])
    assert {r.pos: r.v for r in filled.collect()}[7] == "v4" and {r.pos: r.v for r in filled.collect()}[1] is None
    assert tuple(dedup.duplicate_counts(df, ["key"]).first()) == (60, 3, 57)


def test_bars(spark):
    raw = spark.createDataFrame([(1609459200, 1.0, 2.0, 0.5, 1.5, 7, 1, 0, "mt5", 1), (1609459200, 9.0, 9.0, 9.0, 9.0, 9, 1, 0, "mt5", 2)], "time long, open double, high double, low double, close double, tick_volume long, spread long, real_volume long, source string, pos long")
    out = prices.epoch_bars(raw.withColumns({"pair": F.lit("EURUSD"), "timeframe": F.lit("H1")}), ["pos"])
    assert out.columns == list(OHLCV.columns) and out.count() == 1 and out.first().open == 1.0
    rates = spark.createDataFrame([("USD", "2024-01-02", "1.1", "ecb", 1), ("USD", "2024-01-02", "1.2", "ecb", 2), ("USD", "2024-01-03", "bad", "ecb", 3), ("XXX", "2024-01-02", "1", "ecb", 4)], "code string, day string, rate string, source string, pos long").withColumn("day", F.to_date("day"))
    bar = prices.synthetic_bars(rates, ["pos"]).collect()
    assert [(str(b.timestamp_utc), b.pair, b.open, b.close, b.volume) for b in bar] == [("2024-01-02 15:00:00", "EURUSD", 1.2, 1.2, 0.0)]
    assert prices.synthetic_bars(rates, ["pos"], start="2024-01-03").count() == 0


def test_macro(spark):
    raw = spark.createDataFrame([("2024-01-01", "1.5", "S", "D", "Percent", "fred", 1), ("2024-01-01", "2.5", "S", "D", "Percent", "fred", 2), ("2024-01-02", ".", "S", "D", "Percent", "fred", 3), ("2024-01-03", "NaN", "S", "D", "Percent", "fred", 4)], files.SERIES_COLUMNS + ", pos long")
    assert [(r.value, r.series_id) for r in macro.series(raw, ["pos"]).collect()] == [(1.5, "S")]
    meta = spark.createDataFrame([("S", "W", None)], "series_id string, frequency_short string, units string")
    joined = macro.with_metadata(spark.createDataFrame([("S",), ("T",)], "series_id string"), meta)
    assert sorted((r.series_id, r.frequency_short, r.units) for r in joined.collect()) == [("S", "W", "N/A"), ("T", "N/A", "N/A")]


def test_calendar(spark):
    rows = [("2024-02-08", "8:30am", "USD", "German CPI", "High", "150K", "4.5%", None, "x", 1), ("2024-02-08", "8:30am", "USD", "German CPI", "Low", "1", "1", "1", "x", 2), (None, None, None, None, "", "", "", "", "", 3)]
    raw = spark.createDataFrame(rows, "date string, time string, currency string, event string, impact string, actual string, forecast string, previous string, source string, pos long")
    out = {r.event_name: r for r in calendar.events(raw, ["pos"]).collect()}
    assert (out["German CPI"].country, out["German CPI"].impact, out["German CPI"].actual, out["German CPI"].previous) == ("DE", "high", 150000.0, None)
    assert out[""].impact == "unknown" and out[""].timestamp_utc is None
    assert {(r.pos, r.message) for r in calendar.row_errors(raw, "pos").collect()} == {(3, "Empty event data")}


def test_articles_and_known_urls(spark):
    schema = "source string, timestamp_collected string, timestamp_published string, url string, title string, document_type string, speaker string, author string"
    docs = spark.createDataFrame([("Fed", "2024-01-01T00:00:00Z", "", "http://a", "T", None, "", "Ann"), ("ecb", None, None, None, "T", None, None, None), ("boe", "2024-01-01T00:00:00Z", None, "", "", None, None, None)], schema)
    good, bad = news.articles(docs)
    row = good.first()
    assert good.count() == 1 and bad.count() == 2 and (row.currency, row.document_type, row.speaker, row.source) == ("USD", "article", "Ann", "fed")
    found = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "url string, pos long")
    assert [(r.url, r.pos) for r in news.fresh(found, spark.createDataFrame([("a",), ("",)], "url string"), "url", ["pos"]).collect()] == [("b", 2)]


def test_insert_ignore(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, v long"
    spark.createDataFrame([(1, 1)], schema).write.parquet(path)
    batch = spark.createDataFrame([(1, 2), (2, 3), (2, 4), (None, 5), (None, 6)], schema)
    assert store.insert_ignore(spark, path, batch, ["k"], ["v"]) == 3  # a NULL key never collides
    assert store.insert_ignore(spark, path, batch.where("k is not null"), ["k"], ["v"]) == 0
    assert store.insert_ignore(spark, path, batch.limit(0), ["k"], ["v"]) == 0
    with pytest.raises(ValueError):
        store.table(spark, path, "users")


def test_quality(spark):
    m = spark.createDataFrame([(None, "S", 1.0, "f", "D", "u"), ("2024-01-01", "S", None, "f", "D", "u"), ("2024-01-01", "S", 1.0, "f", "D", "u")], "timestamp_utc string, series_id string, value double, source string, frequency string, units string").withColumn("timestamp_utc", F.to_timestamp("timestamp_utc"))
    found = {r.rule: r.violations for r in quality.checked(m, MACRO, count_all=False, exact=True).collect()}
    assert (found["null_timestamp_utc"], found["null_value"], found["unique_key"], found["empty"]) == (1, 1, 1, 0)
    with pytest.raises(ValueError):
        quality.enforce(quality.checked(m, MACRO))
    with pytest.raises(ValueError):
        quality.checked(m, EVENTS)
    assert quality.enforce(quality.checked(m.limit(0), MACRO), warnings=("empty",))


def test_pages(spark):
    html = '<html><head><title>T</title><style>x{}</style></head><body><nav>menu</nav><main><h1>Head</h1><p>' + "long text " * 20 + '</p><script>no()</script></main><a href="/p/1.en.html">one <b>link</b></a><footer>foot</footer></body></html>'
    df = spark.createDataFrame([(1, html), (2, None), (3, "<p>only</p>")], "page_id long, html string")
    texts = {r.page_id: r.text for r in pages.main_text(df, "page_id", "html").collect()}
    assert texts[1].startswith("Head\nlong text") and "menu" not in texts[1] and texts[2] == "" and texts[3] == "only"
    assert [(r.url, r.anchor) for r in pages.links(df, "page_id", "html", "https://b").collect()] == [("https://b/p/1.en.html", "one link")]


def test_scorer_never_sees_empty_texts(spark):
    def factory():
        def score(texts):
            assert all(t.strip() for t in texts) and len(texts) <= scoring.BATCH
            return [("Positive", 0.91239)] * len(texts)

        return score

    rows = scoring.scored(spark.createDataFrame([("x",), ("",), (None,)], "t string"), "t", factory).collect()
    assert [(r.sentiment_score, r.sentiment_label) for r in rows] == [(0.9124, "positive"), (0.0, "neutral"), (0.0, "neutral")]


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/mt5_EURUSD_H1_20210101.csv").write_text("time,open,high,low,close,tick_volume,spread,real_volume,source\n1609459200,1,2,0.5,1.5,7,1,0,mt5\n")
    (tmp_path / "in/mt5_short.csv").write_text("time,open,high,low,close,tick_volume,spread,real_volume,source\n1,1,2,0.5,1.5,7,1,0,mt5\n")
    bars = files.routed(spark, {"mt5": str(tmp_path / "in"), "unknown": "x"})
    assert [(r.pair, r.timeframe, r.tick_volume) for r in bars.collect()] == [("EURUSD", "H1", 7)]
    with pytest.raises(ValueError):
        files.routed(spark, {"unknown": "x"})
    assert files.routed(spark, {"unknown": "x"}, strict=False) is None
    (tmp_path / "docs/ecb").mkdir(parents=True)
    (tmp_path / "docs/ecb/a.jsonl").write_text('{"url": "u", "title": "t"}\n\n{broken\n{"url": "", "title": "s"}\n')
    assert files.json_lines(spark, str(tmp_path / "docs")).count() == len(files.json_lines(spark, str(tmp_path / "docs")).collect()) == 2
    assert [r.url for r in files.known_urls(spark, str(tmp_path / "docs")).collect()] == ["u"]
    with pytest.raises(ValueError):
        files.required(bars, ["nothing"])


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", "2024-01-05"), (None, "2024-02-05")], "source string, timestamp_utc string").withColumn("timestamp_utc", F.to_timestamp("timestamp_utc"))
    assert sinks.silver(df, str(tmp_path), "events", "timestamp_utc").endswith("/events_20240105_20240205.parquet")
    counts = {(r.part_source, r.year, r.month): r.n_rows for r in sinks.partitioned(df, str(tmp_path / "p")).collect()}
    assert counts == {("a", "2024", "01"): 1, (None, "2024", "02"): 1}
    with pytest.raises(ValueError):
        sinks.silver(df, str(tmp_path), "events", "timestamp_utc", kind="xls")
    with pytest.raises(ValueError):
        sinks.bronze_csv(df.limit(0), str(tmp_path), "s", "d", "20240101")
    with pytest.raises(ValueError):
        sinks.json_lines(df, str(tmp_path / "j"), "poem", ("article",))
    path = sinks.calendar_csv(df, str(tmp_path / "c"))
    assert len(files.csv(spark, path).columns) == 12


def test_lexicon_counts_all_words():
    late = "word " * 600 + "strong growth " * 3 + "risk"
    assert scoring.lexicon()([late]) == [("positive", 6 / 7)]
    assert scoring.lexicon(512)([late]) == [("neutral", 1.0)]


def test_policy_rates_take_the_first_frequency_without_a_window(spark):
    rows = [("DFR", "2024-01-02", "1", "D", 2), ("DFR", "2024-01-01", "2", None, 1), ("MRR_FR", "2024-01-01", "3", "M", 4), ("MRR_FR", "2024-01-02", "x", "W", 3), ("other", "2024-01-01", "3", "M", 5)]
    out = macro.policy_rates(spark.createDataFrame(rows, "code string, date string, value string, frequency string, pos long").withColumn("source", F.lit("ecb")), ["pos"])
    assert sorted((r.series_id, r.value, str(r.frequency)) for r in out.collect()) == [("ECB_DFR", 1.0, "None"), ("ECB_DFR", 2.0, "None"), ("ECB_MRR", 3.0, "W")]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_a_busy_customer_has_several_bounded_calendar_pages(spark):
    from tidemark.plans.pages import PAGE_KEYS, _calendar_pages

    o = spark.range(3 * PAGE_KEYS).select(F.lit(1).alias("o_custkey"), F.col("id").alias("o_orderkey"), F.lit(2.0).alias("o_totalprice"), F.lit("p").alias("o_orderpriority"), F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 9).cast("int")).alias("o_orderdate"))
    rows = _calendar_pages(o).select(F.regexp_count("html", F.lit("calendar_row\"")).alias("n"), F.col("html").contains("Monday, January 01, 2024").alias("first")).collect()
    assert [(r.n, r.first) for r in rows] == [(PAGE_KEYS, True)] * 3
