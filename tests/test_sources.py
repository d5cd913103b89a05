"""Page layouts of the sources, landed files with header checks, plug-ins, stored tables and their constraints."""

from __future__ import annotations

import datetime
import subprocess
import sys

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.contracts import MACRO
from tidemark.functions import text, times
from tidemark.operators import calendar, elements, macro, news, pages, store
from tidemark.plans.registry import ORACLES, QUERIES
from tidemark.sources import files, plugins, sinks


def page(spark, html):
    return spark.createDataFrame([(1, html)], "page_id long, html string")


LISTING = """<div class="row outer"><h3>Releases</h3>
<div class="row"><div class="col-xs-3 eventlist__time"><time>12/30/2025</time></div>
 <div class="col-xs-9 eventlist__event"><p><a href="/news/a.htm"><em>Minutes of the &amp; Board</em></a></p><p class='eventlist__press'><em><strong>Monetary Policy</strong></em></p></div></div>
<div class="row"><div class="eventlist__time"><time>12/15/2025</time></div>
 <div class="eventlist__event"><p><a href="/news/b.htm"><em>The  Outlook</em></a></p><p class="news__speaker">Governor Jane Q. Roe</p><p>At the School</p></div></div>
<div class="row"><div class="eventlist__time"><time>soon</time></div><div class="eventlist__event"><a href="/c.htm">C</a></div></div>
<div class="row"><div class="eventlist__time"><time>1/2/2025</time></div><div class="eventlist__event">no link</div></div></div>"""


def test_listing_pages(spark):
    rows = pages.listing_rows(page(spark, LISTING), "page_id", "html", "https://f").orderBy("position").collect()
    assert [(str(r.date), r.url, r.title, r.category, r.speaker, r.location) for r in rows] == [
        ("2025-12-30", "https://f/news/a.htm", "Minutes of the & Board", "Monetary Policy", None, None),
        ("2025-12-15", "https://f/news/b.htm", "The  Outlook", "other", "Jane Q. Roe", "At the School"),
    ]


def cells(*values):
    return "".join(f"<td>{v}</td>" for v in values)


def test_calendar_pages_of_both_layouts(spark):
    rows = [
        f'<tr class="calendar__row">{cells("8:00am", "EUR", "", "Before any day", "", "", "1", "2", "3", "")}</tr>',
        '<tr class="calendar__row calendar__row--day-breaker"><td><span class="date">Monday, February 12, 2024</span></td></tr>',
        f'<tr class="calendar__row">{cells("Mon Feb 12", "8:30am", "USD")}<td class="calendar__impact icon--high"></td>{cells("CPI <b>m/m</b>", "", "<a href=/x data=1>d</a>".replace("/x", chr(34) + "/calendar?detail=7" + chr(34)), "0.3%", "-", "—", "")}</tr>',
        f'<tr class="calendar__row">{cells("", "GBP", "<i title=" + chr(34) + "Medium Impact" + chr(34) + "></i>", "GDP", "", "", "150K", "n/a", "140K", "")}</tr>',
        f'<tr class="calendar__row calendar__header">{cells(*"12345678")}</tr>',
        f'<tr class="calendar__row">{cells("9:00am", "JPY", "low", "", "", "", "1", "1", "1", "")}</tr>',
        f'<tr class="calendar__row">{cells("9:00am", "JPY", "low")}</tr>',
        '<tr class="day-breaker"><td><span>Feb 13</span></td></tr>',
        f'<tr class="calendar__row">{cells("All Day", "CHF", "holiday", "Bank Holiday", "", "", "", "", "", "")}</tr>',
    ]
    other = f'<table class="menu"><tr class="calendar__row">{cells(*"123456789")}</tr></table>'
    found = pages.calendar_rows(page(spark, other + '<table class="calendar__table">' + "".join(rows) + "</table>"), "page_id", "html", "https://c", 2024).orderBy("position").collect()
    assert [(str(r.day), r.time, r.currency, r.impact, r.event, r.event_url, r.actual, r.forecast, r.previous) for r in found] == [
        ("2024-02-12", "8:30am", "USD", "High", "CPIm/m", "https://c/calendar?detail=7", "0.3%", None, None),
        ("2024-02-12", None, "GBP", "Medium", "GDP", None, "150K", None, "140K"),
        ("2024-02-13", "All Day", "CHF", "Unknown", "Bank Holiday", None, None, None, None),
    ]


NESTED = "<table class=inner><tr class=calendar__row><td>a</td><td>b</td></tr></table>"


@pytest.mark.parametrize(
    ("row", "event", "actual"),
    [
        (f'<tr class="calendar__row">{cells("8:30am", "USD", "low", "CPI", "", "", "1%", "2%", "3%", NESTED)}</tr>', "CPI", "1%"),
        (f'<tr class="calendar__row">{cells("8:30am", "USD", "low", f"CPI {NESTED}", "", "", "1%", "2%", "3%", "")}</tr>', "CPIab", "1%"),
        ('<tr class="calendar__row"><td>8:30am<td>USD<td>low<td><b>CPI</b> &amp; more<td><td><td>1%<td>2%<td>3%<td>', "CPI& more", "1%"),
        (f'<tr class="calendar__row">{cells("8:30am", "USD", "low", "CPI</div></span>", "", "", "1%", "2%", "3%")}', "CPI", "1%"),
        ('<TR CLASS=calendar__row><TD>8:30am</TD><TD>USD<!-- <td> --></TD><TD>low<script>"</td>"</script></TD><TD title="a>b">CPI</TD><TD></TD><TD></TD><TD>1%</TD><TD>2%</TD><TD>3%</TD></TR>', "CPI", "1%"),
    ],
)
def test_calendar_cells_hold_tables_and_end_by_themselves(spark, row, event, actual):
    head = '<table class="calendar__table"><tr class="day-breaker"><td><span class="date">Monday, February 12, 2024</span></td></tr>'
    after = f'<tr class="calendar__row">{cells("9:00am", "EUR", "high", "next", "", "", "", "", "")}</tr></table>'
    found = pages.calendar_rows(page(spark, head + row + after), "page_id", "html", "https://c", 2024).orderBy("position").collect()
    assert [(r.event, r.time, r.currency, r.impact, r.actual, str(r.day)) for r in found] == [(event, "8:30am", "USD", "Low", actual, "2024-02-12"), ("next", "9:00am", "EUR", "High", None, "2024-02-12")]


def test_all_outputs_come_from_one_parse(spark):
    html = f"<title>T &amp; U</title><body><h1>Head <i>line</i></h1><main>A {LONG}</main><div class='published-date'>May 3</div></body>"
    parsed = page(spark, html).select(elements.parsed("html").alias("p"))
    found = {**pages.page_metadata(F.col("p")), "text": pages.shown_text(F.col("p"))}
    row = parsed.select(*(c.alias(n) for n, c in found.items()))
    assert row._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert (row.first().title, row.first().h1, row.first().shown_date) == ("T & U", "Headline", "May 3") and row.first().text.startswith("A words")


@pytest.mark.parametrize("html", [None, "", "no tags", "<", "<a", "<a href='x", "</p>", "<!-- open", "<td></table></td>" * 3, "<p>" * 2000, "<" * 5000, "<a title=\"x>" * 300])
def test_any_text_can_be_parsed(spark, html):
    row = page(spark, html).select(elements.parsed("html").alias("p")).first().p
    assert all(e.at == k and e.last >= k and e.up < k and 0 <= e.t0 <= e.t1 <= len(row.texts) for k, e in enumerate(row.elements))


def test_tags_are_taken_apart_once_and_only_where_they_end_the_same_way(monkeypatch):
    calls, plain = [], elements._start_tag
    monkeypatch.setattr(elements, "_start_tag", lambda *a: calls.append(a) or plain(*a))
    pages_ = elements._Pages()
    pages_.add('<table><tr class="calendar__row"><td>1</td><td title="a>b">2</td></tr>' * 500 + "<td title=\"x>y\">z</td><td title='x>w'>v</td>")
    # what stands up to the first > does not tell how a tag with an open quote ends, so such a tag is not remembered
    assert [len(calls), len({c for c in calls if ">" not in c[1]})] == [505, 3]
    (page,) = pages_.arrays().to_pylist()
    assert [e["label"] for e in page["elements"][-2:]] == ["x>y", "x>w"] and page["texts"][-2:] == ["z", "v"] and len(page["elements"]) == 2002


LONG = "words that fill the place " * 12


@pytest.mark.parametrize(
    ("source", "html", "first"),
    [
        ("ecb", f'<body><div class="x subcontent-y"><p>A {LONG}</p></div><main>B {LONG}</main></body>', "A"),
        ("ecb", f'<body><div class="content">short</div><main>B {LONG}</main></body>', "B"),
        ("ecb", f'<body><div id="my-article">C {LONG}</div><p>rest</p></body>', "C"),
        ("fed", f'<head><title>t</title></head><div class="row col-xs-12">D {LONG}</div><div class="col-xs-12">E {LONG}</div>', "D"),
        ("fed_feed", f'<body>Skip to main content<aside>no</aside><div class="a col-md-8 col-xs-12 col-sm-8">F {LONG}\n \n\n Last Update: May 3, 2024</div></body>', "F"),
        ("boe", f'<body><form>no</form><div class="page-content"><div class="cookie-notice"><b>no</b></div>G {LONG}</div></body>', "G"),
        ("boe_sitemap", f'<body><div class="content-block">H {LONG}</div><div class="page-content">I {LONG}</div></body>', "H"),
        ("boe", "<body><p>J little</p></body>", "J"),
    ],
)
def test_main_text_by_source(spark, source, html, first):
    found = pages.main_text(page(spark, html), "page_id", "html", pages.PROFILES[source]).first().text
    assert found.startswith(first) and "no" not in found.split() and "Last Update" not in found and "rest" not in found


@pytest.fixture(scope="module")
def cut_pages(spark, tmp_path_factory):
    """Pages whose escaped text is broken off inside a reference, and SQL over them."""
    root = str(tmp_path_factory.mktemp("cut"))
    rows = [(k, f"<html><head><title>a &amp;{end}</title></head><body><article><h1>b &amp;lt; &quot;{end}</h1><p>{LONG}{end}</p></article></body></html>") for k, end in enumerate(("&amp", "&am", "&", "&lt", "&quot", "&copy", "&amp;amp"))]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{root}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW pages AS SELECT * FROM '{root}/pages.parquet/*.parquet'")
    return root, lambda name, columns: sorted(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())


def test_references_broken_off_are_text(spark, cut_pages):
    df = QUERIES["page_main_text"](spark, cut_pages[0])
    assert sorted(map(tuple, df.collect())) == cut_pages[1]("page_main_text", df.columns)


def test_references_broken_off_are_text_for_all_sources(spark, cut_pages):
    df = QUERIES["page_main_text_sources"](spark, cut_pages[0])
    assert sorted(map(tuple, df.collect())) == cut_pages[1]("page_main_text_sources", df.columns)


def test_references_broken_off_are_text_in_metadata(spark, cut_pages):
    df = QUERIES["page_meta"](spark, cut_pages[0])
    assert sorted(map(tuple, df.collect())) == cut_pages[1]("page_meta", df.columns)


def test_article_links_of_sections(spark):
    html = (
        '<div>Top <a href="/press/key/date/2024/html/ecb.sp240105~aa.en.html">A <b>speech</b></a></div><li>Around <a href=\'https://e/press/pr/date/2023/html/ecb.pr230301~b.en.html\'><img></a> it</li>'
        '<a href="/press/accounts/2022/html/x.en.html">No date</a><a href="/press/key/date/2024/html/ecb.sp240105~aa.de.html">Rede</a><a href="/about.en.html">About</a><a href="/press/key/date/1999/html/ecb.sp990105~aa.en.html">Old</a>'
    )
    found = pages.article_links(page(spark, html), "page_id", "html", "https://e", start="2020-01-01", end="2024-12-31").orderBy("position").collect()
    assert [(r.section, r.title, str(r.date_hint), r.category) for r in found] == [("speeches", "Aspeech", "2024-01-05", "speeches"), ("press_releases", "Aroundit", "2023-03-01", "pressreleases"), ("monetary_policy_accounts", "No date", "None", "policy")]
    assert found[1].url == "https://e/press/pr/date/2023/html/ecb.pr230301~b.en.html"


@pytest.mark.parametrize(("href", "url"), [("http://x/y", "http://x/y"), ("mailto:a@b", "mailto:a@b"), ("//cdn/x", "https://cdn/x"), ("/a", "https://h/a"), ("?q=1", "https://h?q=1"), ("#t", "https://h#t"), ("a/b", "https://h/a/b")])
def test_urls(spark, href, url):
    assert spark.createDataFrame([(href,)], "h string").select(text.absolute_url(F.col("h"), "https://h")).first()[0] == url


def test_calendar_source_is_made_once(spark):
    """Its rows are checked and counted from what was written."""
    plan = QUERIES["calendar_source"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" in plan and "csv" not in plan and "Window" not in plan


def test_meta_tags_in_any_order(spark):
    html = "<meta content='Ann &amp; Co' property=x name='author'><meta property=\"datePublished\" content=\"2024-03-01\"/><div class='a published-date b'>Published on <i>08 February 2026</i></div>"
    found = page(spark, html).select(*(c.alias(n) for n, c in pages.metadata(F.col("html")).items())).first()
    assert (found.author, found.published, found.shown_date) == ("Ann & Co", "2024-03-01", "Published on08 February 2026")


def write(path, lines):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("\n".join(lines) + "\n")


def test_rate_files(spark, tmp_path):
    write(tmp_path / "ecb_exchange_rates_1.csv", ["TIME_PERIOD,CURRENCY,OBS_VALUE,source", "2024-01-02,USD,1.1,ecb", "2024-01-02,XXX,9,ecb", "2024-01-03,USD,bad,ecb"])
    write(tmp_path / "ecb_exchange_rates_2.csv", ["TIME_PERIOD,CURRENCY,OBS_VALUE,source", "2024-01-04,GBP,0.8,ecb"])
    source = plugins.SOURCES["ecb_exchange_rates"]
    rows = source.preprocess(spark, str(tmp_path))
    assert sorted((r.pair, r.close, str(r.timestamp_utc)) for r in rows.collect()) == [("EURGBP", 0.8, "2024-01-04 15:00:00"), ("EURUSD", 1.1, "2024-01-02 15:00:00")] and source.validate(rows)
    assert source.preprocess(spark, str(tmp_path), start="2024-01-03").count() == 1
    write(tmp_path / "ecb_policy_rates_1.csv", ["TIME_PERIOD,OBS_VALUE,PROVIDER_FM_ID,FREQ,source", "2024-01-02,4.5,DFR,D,ecb", "2024-01-02,4.6,DFR,D,ecb"])
    assert [(r.series_id, r.value, r.frequency) for r in plugins.SOURCES["ecb_policy_rates"].preprocess(spark, str(tmp_path)).collect()] == [("ECB_DFR", 4.6, "D")]


@pytest.mark.parametrize(("name", "scan"), [("fred_DFF.csv", files.series), ("ecb_exchange_rates_1.csv", files.exchange_rates), ("ecb_policy_rates_1.csv", files.policy_rates), ("forexfactory_1.csv", files.calendar)])
def test_headers_are_checked(spark, tmp_path, name, scan):
    write(tmp_path / name, ["date,value", "2024-01-01,1"])
    with pytest.raises(ValueError, match="missing columns"):
        scan(spark, str(tmp_path))


def test_files_are_read_by_their_own_headers(spark, tmp_path):
    head = ["date", "value", "series_id", "frequency", "units", "source"]
    write(tmp_path / "fred_a.csv", [",".join(head), "2024-01-01,1,S,D,P,fred", "2024-01-02,2,S,D", "2024-01-03,3,S,D,P,fred,more"])
    write(tmp_path / "fred_b.csv", [",".join([*head[::-1], "note"]), "fred,P,D,S,2,2024-01-04,n"])
    write(tmp_path / "fred_c.csv", ["date,other", "2024-01-05,1"])
    (tmp_path / "fred_d.csv").write_text("")
    found = files.series_scan(spark, str(tmp_path))
    assert sorted((r.date, r.value, r.source) for r in files.series(spark, str(tmp_path)).collect()) == [("2024-01-01", "1", "fred"), ("2024-01-04", "2", "fred")]
    assert found.rows.count() == 2 and found.rows.select("note").where("note is not null").count() == 1
    faults = sorted((r.file.rsplit("/", 1)[1], r.line, r.reason) for r in found.faults.collect())
    assert faults == [("fred_a.csv", "2024-01-02,2,S,D", "not 6 fields, the first is 2024-01-02"), ("fred_a.csv", "2024-01-03,3,S,D,P,fred,more", "not 6 fields, the first is 2024-01-03"), ("fred_c.csv", None, "missing columns: frequency, series_id, source, units, value")]


def test_what_no_scan_can_read_is_set_aside(spark, tmp_path):
    write(tmp_path / "news" / "fed" / "a.jsonl", ['{"source":"fed","title":"T","url":"u"}', "", "{broken", '{"title":"x","metadata":7}', "[]"])
    write(tmp_path / "bars" / "mt5_EURUSD_H1_1.csv", ["time,open,high,low,close,tick_volume,spread,real_volume,source", "1609459200,1,2,0.5,1.5,10,1,0,mt5", "soon,1,2,0.5,1.5,10,1,0,mt5"])
    (tmp_path / "bars" / "mt5_EURUSD_H4_1.csv").write_bytes(b"")
    write(tmp_path / "bars" / "mt5_GBPUSD_H1_1.csv", ["time,open,source", "1609459200,1,mt5"])
    write(tmp_path / "rates" / "other.csv", ["a", "1"])
    roots = {"fed_documents": f"{tmp_path}/news", "mt5": f"{tmp_path}/bars", "fred": f"{tmp_path}/none", "ecb_exchange_rates": f"{tmp_path}/rates", "unknown": "x"}
    rows = files.routed(spark, roots)
    assert sorted((r.source, r.title, r.close) for r in rows.select("source", "title", "close").collect()) == [("fed", "T", None), ("mt5", None, 1.5)]
    aside = sorted((r.source, r.file.rsplit("/", 1)[-1], r.line, r.reason) for r in files.quarantine(spark, roots).collect())
    assert aside == [
        ("ecb_exchange_rates", "rates", None, "no file of the source"),
        ("fed_documents", "a.jsonl", "[]", "no JSON of the schema"),
        ("fed_documents", "a.jsonl", '{"title":"x","metadata":7}', "JSON with a value of another kind"),
        ("fed_documents", "a.jsonl", "{broken", "no JSON of the schema"),
        ("fred", "none", None, "no such folder"),
        ("mt5", "mt5_EURUSD_H1_1.csv", "soon,1,2,0.5,1.5,10,1,0", "no number: time"),
        ("mt5", "mt5_GBPUSD_H1_1.csv", None, "missing columns: close, high, low, tick_volume"),
        ("unknown", "x", None, "unknown source"),
    ]
    with pytest.raises(ValueError, match="no known source"):
        files.routed(spark, {"fred": f"{tmp_path}/none"})
    assert files.routed(spark, {"fred": f"{tmp_path}/none"}, strict=False) is None


def test_blank_times_are_filled_over_the_splits_of_a_file(spark, tmp_path):
    """One file in many splits: nothing is sorted as a whole, and fills reach over splits without any time."""
    times_ = ["" if k < 3 or k % 7 or 400 < k < 900 else f"{k % 12 + 1}:{k % 60:02d}am" for k in range(2_000)]
    write(tmp_path / "forexfactory_1.csv", ["date,time,currency,event,impact,actual,forecast,previous", *(f"2024-01-02,{t},USD,event {k},High,1,2,3" for k, t in enumerate(times_))])
    write(tmp_path / "forexfactory_2.csv", ["date,time,currency,event,impact,actual,forecast,previous", "2024-01-02,,USD,event 0,High,1,2,3"])
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096"), spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = files.calendar(spark, str(tmp_path))
        assert rows.select("_file", "_block").distinct().count() > 15
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" in plan and all("_block" in line for line in plan.splitlines() if "Window [last(" in line)
        found = {(r._file.endswith("1.csv"), int(r.event.split()[1])): r.time for r in rows.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    last, want = None, {(False, 0): None}
    for k, t in enumerate(times_):
        last = t or last
        want[True, k] = last
    assert found == want
    events = plugins.SOURCES["calendar"].preprocess(spark, str(tmp_path))
    assert {str(r.timestamp_utc) for r in events.where("event_name = 'event 899'").collect()} == {"2024-01-02 04:39:00"}


def test_documents_are_filtered_before_one_of_a_url_is_chosen(spark, tmp_path):
    line = '{{"source":"fed","title":"T{0}","url":"u","timestamp_published":"2024-01-0{0}T00:00:00Z"}}'
    write(tmp_path / "a.jsonl", [line.format(k) for k in (1, 2, 3)])
    rows = plugins.SOURCES["documents"].preprocess(spark, str(tmp_path), "2024-01-02", "2024-01-03")
    assert [r.headline for r in rows.collect()] == ["T2"]


def test_a_source_of_ones_own(spark, tmp_path):
    def read(spark, path):
        return spark.createDataFrame([("2024-01-01", "1.5", "X", "D", "P", "own", 1), ("2024-01-01", None, "Y", "D", "P", "own", 2)], files.SERIES_COLUMNS + ", pos long")

    plugins.add("own", plugins.Source(read, lambda df: macro.series(df, ["pos"]), MACRO))
    try:
        rows = plugins.SOURCES["own"].preprocess(spark, "")
        assert [(r.series_id, r.value) for r in rows.collect()] == [("X", 1.5)] and plugins.SOURCES["own"].validate(rows)
        assert files.routed(spark, {"own": "x"}).count() == 2
        with pytest.raises(ValueError, match="null_value"):
            plugins.SOURCES["own"].validate(rows.withColumn("value", F.lit(None).cast("double")))
    finally:
        plugins.SOURCES.pop("own"), files.REGISTRY.pop("own")


def test_stored_tables(spark, tmp_path):
    when = datetime.datetime(2024, 1, 1)
    rows = spark.createDataFrame([(when, "EURUSD", 1.1), (when, "EURUSD", 1.2), (when, "EURGBP", 0.8)], "timestamp_utc timestamp, currency_pair string, rate double")
    store.faults(rows, "ecb_exchange_rates").drop("faults").limit(0).write.parquet(f"{tmp_path}/ecb_exchange_rates")
    assert store.export_csv(spark, str(tmp_path), "ecb_exchange_rates", f"{tmp_path}/none.csv") and spark.read.text(f"{tmp_path}/none.csv").count() == 0
    assert store.insert(spark, str(tmp_path), "ecb_exchange_rates", rows) == 2 and store.insert(spark, str(tmp_path), "ecb_exchange_rates", rows) == 0
    back = files.csv(spark, store.export_csv(spark, str(tmp_path), "ecb_exchange_rates", f"{tmp_path}/rates.csv"))
    assert back.columns == ["timestamp_utc", "currency_pair", "rate", "frequency", "source"] and sorted(r.rate for r in back.collect()) == ["0.8", "1.1"]
    bad = spark.createDataFrame([(None, "EURUSD"), (when, "E" * 21)], "timestamp_utc timestamp, currency_pair string")
    with pytest.raises(ValueError, match="null_timestamp_utc.*width_currency_pair"):
        store.insert(spark, str(tmp_path), "ecb_exchange_rates", bad)
    with pytest.raises(ValueError, match="unknown table"):
        store.export_csv(spark, str(tmp_path), "users", "x")


@pytest.mark.parametrize(("start", "end", "views"), [("2024-01-05", "2024-01-05", [("day", "2024-01-05")]), ("2024-01-01", "2024-01-07", [("week", "2024-01-01")]), ("2024-01-05", "2024-01-09", [("month", "2024-01-05")]), ("2024-01-30", "2024-03-02", [("month", "2024-01-01"), ("month", "2024-02-01"), ("month", "2024-03-01")]), ("2024-01-05", "2024-01-04", [])])
def test_calendar_views(spark, start, end, views):
    asked = spark.createDataFrame([(start, end)], "a string, b string").select(F.to_date("a").alias("a"), F.to_date("b").alias("b"))
    assert sorted((r.view, str(r.first_day)) for r in store.calendar_views(asked, "a", "b").collect()) == views


def test_week_keys_and_clock_changes(spark):
    days = spark.createDataFrame([("2024-12-30",), ("2021-01-03",)], "d string").select(times.week_key(F.to_date("d")).alias("w"))
    assert [r.w for r in days.collect()] == ["2025-W01", "2020-W53"]
    local = spark.createDataFrame([("2024-03-10 02:30:00",), ("2024-07-01 12:00:00",), ("2024-11-03 01:30:00",)], "t string").select(times.iso(times.to_utc(F.to_timestamp("t"))).alias("u"))
    assert [r.u for r in local.collect()] == ["2024-03-10T07:30:00Z", "2024-07-01T16:00:00Z", "2024-11-03T06:30:00Z"]


def test_documents_and_exports(spark, tmp_path):
    found = news.tagged(spark.createDataFrame([("", "", "sum", None), ("T", "body", None, "de")], "Title string, CONTENT string, Summary string, language string"), "ECB")
    assert [(r.source, r.title, r.content, r.metadata.language, r.url) for r in news.document_rows(found).collect()] == [("ECB", "Untitled", "sum", "en", None), ("ECB", "T", "body", "de", None)]
    assert [str(r.date) for r in calendar.table(spark.createDataFrame([("2024-02-30",), ("2024-02-03",)], "date string")).collect()] == ["None", "2024-02-03"]
    rows = spark.range(500).select(F.pmod(F.col("id") * 7, F.lit(500)).alias("k"), F.lit("é").alias("v"), F.lit(None).cast("string").alias("n")).repartition(6)
    path = sinks.graph_json_lines(rows, str(tmp_path), "20240131", ["k"])
    lines = [x for f in sorted((tmp_path / "aggregated_20240131.jsonl").glob("part-*")) for x in f.read_text().splitlines()]
    assert path.endswith("/aggregated_20240131.jsonl") and [int(x.split(":")[1].split(",")[0]) for x in lines] == list(range(500)) and '"n":null' in lines[0] and "é" in lines[0]
    with pytest.raises(ValueError):
        sinks.graph_json_lines(rows.limit(0), str(tmp_path), "20240131", ["k"])


@pytest.mark.parametrize("module", ["tables", "files", "pages", "storage", "scalars", "documents", "registry"])
def test_plans_import_in_any_order(module):
    out = subprocess.run([sys.executable, "-c", f"import tidemark.plans.{module}"], capture_output=True, text=True)
    assert out.returncode == 0, out.stderr
