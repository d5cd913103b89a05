"""Documents with every odd case, and plain versions of what the operators compute."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, component_id long, fp string"


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in any column, empty and long texts, ties, repeated rows, one hot source; ids apart from null are unique but for the repeats."""
    prose = "the quick brown fox jumps over a lazy dog while seven wizards quietly watch from beyond the old stone bridge near town"
    rows = [
        (1, None, "en", "a", 0), (2, "", "en", "a", 0), (3, " \n\t ", None, None, None), (None, "no id " + prose, "en", "b", 1), (None, None, None, None, None),
        (4, prose, "en", "a", 1), (4, prose, "en", "a", 1), (5, prose + " today", "en", "b", 1), (6, prose.upper(), "en", "c", 1),
        (7, "word " * 20_000, "en", "a", 1), (8, "x" * 50_000, "en", "a", 1), (9, "é日本😀\u200b\x1c \x85\xa0 <|endoftext|> it's we'll", "fr", "b", 1),
        (10, "mail a.b@c.org or +1 (651) 555-8500, 4111 1111 1111 1111, 10.1.2.3", "en", "a", 1), (11, "Released under the MIT License. All rights resrved.", "en", "a", 1),
    ]
    rows += [(100 + k, f"{prose} number {k % 7}", "en", "hot", 1) for k in range(40)]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    """The rows as a table whose extra columns clash with the operators' own names."""
    return spark.createDataFrame([(*r, -1, -1.0, -1, "clash") for r in odd_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def sf():
    return "/root/testdata/sf0.001"
