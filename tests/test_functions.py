"""Column functions on small vectors."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidemark.functions import classify, ids, numbers, text, times


def value(spark, column, **given):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for k, v in given.items())
    return spark.createDataFrame([tuple(given.values())], schema).select(column).first()[0]


@pytest.mark.parametrize(("shown", "number"), [("4.50%", 4.5), ("-0.3%", -0.3), ("150K", 150000.0), ("1.060T", 1.06e12), ("2m", 2e6), ("1,234.5", 1234.5), ("4.75|2.7", 4.75), ("-", None), ("N/A", None), ("", None), (None, None), ("1d", None), ("1_000", None), ("1e3", 1000.0)])
def test_numbers(spark, shown, number):
    assert value(spark, numbers.parse_number(F.col("x")), x=shown) == number


@pytest.mark.parametrize(("day", "clock", "stamp"), [("2024-02-08", "13:30", "2024-02-08T13:30:00Z"), ("2024-02-08", "8:30am", "2024-02-08T08:30:00Z"), ("2024-02-08", "12:05 pm", "2024-02-08T12:05:00Z"), ("2024-02-08", "12:05am", "2024-02-08T00:05:00Z"), ("2024-02-08", "All Day", "2024-02-08T00:00:00Z"), ("2024-02-08", None, "2024-02-08T00:00:00Z"), (None, "13:30", None), ("2024-02-30", "13:30", None), ("2024-02-08", "25:00", None)])
def test_clock(spark, day, clock, stamp):
    assert value(spark, times.iso(times.clock_timestamp(F.col("d"), F.col("t"))), d=day, t=clock) == stamp


@pytest.mark.parametrize(("raw", "code"), [("USD", "US"), ("united kingdom", "GB"), (" Germany ", "DE"), ("UnitedStates", "US"), ("NewZealand", "NZ"), ("Peru", "PE"), (None, ""), ("", "")])
def test_countries(spark, raw, code):
    assert value(spark, text.country_code(F.col("x")), x=raw) == code


@pytest.mark.parametrize(("name", "code"), [("German WPI m/m", "DE"), ("FRENCH GDP", "FR"), ("UK and US trade", "GB"), ("U.S. CPI", None), ("Business", None), (None, None)])
def test_country_in_name(spark, name, code):
    assert value(spark, text.country_from_name(F.col("x")), x=name) == code


def test_text(spark):
    assert value(spark, text.clean_text(F.col("x")), x=" a \xa0 b​\n　c\x1c ") == "a b c"
    assert value(spark, text.clean_text(F.col("x")), x=None) == ""
    assert value(spark, text.split_list(F.col("x")), x="A; B;C;") == ["A", "B", "C", ""]
    assert value(spark, text.split_list(F.col("x")), x=None) == []
    assert value(spark, text.without_noise(F.col("x")), x="Skip to main content\nA\n \n\nB Last update: May 3, 2024") == "A\n\nB"
    for domain, tier, strict in (("www.Reuters.com", 1, 1), ("wsj.com", 2, 2), ("microsoft.com", 1, 3), (None, 3, 3)):
        assert value(spark, text.credibility_tier(F.col("x")), x=domain) == tier
        assert value(spark, text.credibility_tier(F.col("x"), "domain"), x=domain) == strict


@pytest.mark.parametrize(("stamp", "is_open"), [("2024-01-10 12:00:00", True), ("2024-01-07 20:00:00", False), ("2024-01-07 23:00:00", True), ("2024-01-12 21:00:00", True), ("2024-01-12 22:00:00", False), ("2024-01-13 12:00:00", False)])
def test_trading_time(spark, stamp, is_open):
    assert value(spark, times.is_trading_time(F.col("x").cast("timestamp")), x=stamp) == is_open


@pytest.mark.parametrize(("url", "day"), [("/x/ecb.sp260115~ab.en.html", "2026-01-15"), ("/press/key/date/2026/html/ecb.sp261399~ab.en.html", "2026-01-01"), ("/x/ecb.pr980305~z", "1998-03-05"), ("/nothing", None)])
def test_url_dates(spark, url, day):
    assert value(spark, times.url_date(F.col("x")).cast("string"), x=url) == day


def test_dates(spark):
    for shown in ("08 February 2026", "8 Feb 2026", "February 08, 2026", "2026-02-08"):
        assert value(spark, times.iso(times.long_date(F.col("x"))), x=shown) == "2026-02-08T00:00:00Z"
    assert value(spark, times.iso(times.feed_date(F.col("x"))), x="Mon, 05 Feb 2024 10:00:00 +0200") == "2024-02-05T08:00:00Z"
    assert value(spark, times.header_date(F.col("x"), 2024).cast("string"), x="Feb 12") == "2024-02-12"
    assert value(spark, times.compact_timestamp(F.col("x")), x="20240205100000") == "2024-02-05T10:00:00Z"
    assert value(spark, times.compact_timestamp(F.col("x")), x="soon") == "soon"
    assert value(spark, times.iso(times.us_date(F.col("x"))), x="12/30/2025") == "2025-12-30T00:00:00Z"
    assert value(spark, F.size(times.months_between(F.to_date("a"), F.to_date("b"))), a="2023-11-30", b="2024-02-01") == 4


def test_ids(spark):
    one = value(spark, ids.article_id(F.col("u"), F.col("s"), F.col("t"), F.col("w")), u="http://a", s="x", t="y", w="z")
    assert one == value(spark, ids.article_id(F.col("u"), F.col("s"), F.col("t"), F.col("w")), u="http://a", s="other", t=None, w=None) and len(one) == 16
    assert value(spark, ids.event_id(F.col("w"), F.col("c"), F.col("e")), w=None, c="DE", e="x") == value(spark, F.substring(F.sha2(F.lit("None|DE|x"), 256), 1, 16), z="")


def test_classes_and_speakers(spark):
    assert value(spark, classify.ecb_type(F.col("t"), F.col("s")), t="Keynote", s="on interest rates") == "policy"
    assert value(spark, classify.fed_type(F.col("t"), F.col("s")), t="Testimony by Chair A", s=None) == "speech"
    assert value(spark, classify.boe_type(F.col("u"))["type"], u="/a/monetary-policy-summary/b") == "monetary_policy_summary"
    assert value(spark, classify.ecb_speaker(F.col("t"), F.col("c")), t="A B", c="Jane Smith, President of the bank") == "Jane Smith"
    assert value(spark, classify.ecb_speaker(F.col("t"), F.col("c")), t="nothing", c=None) is None
    assert value(spark, classify.fed_speaker(F.col("t")), t="Governor Stephen I. Miran") == "Stephen I. Miran"
    assert value(spark, classify.fed_title_speaker(F.col("t")), t="Vice  Chair Jefferson speaks") == "Vice  Chair Jefferson"


def test_scores(spark):
    for label, score in (("positive", 0.95), ("Negative", -0.95), ("neutral", 0.0)):
        assert value(spark, numbers.signed_score(F.col("l"), F.col("c"), F.col("t")), l=label, c=0.95, t="x") == score
    assert value(spark, numbers.signed_score(F.col("l"), F.col("c"), F.col("t")), l="positive", c=0.95, t=" ") == 0.0
