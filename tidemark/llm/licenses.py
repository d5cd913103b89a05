"""Fuzzy search for short license notices.

A notice of n letters may differ in k = n // 10 places.  Its text is split into
k + 1 parts; k edits leave at least one part untouched and move it by k letters at
most, so an automaton over all parts finds every candidate place.  The runs of
whole words about it whose length is within k of the notice's are matched by the
``regex`` library with at most k errors.  Texts are compared as lower-case words
joined by single spaces.  Of matches of a notice that overlap the one with the
fewest errors stays, then the first, then the shorter one.

Defined results: null text is empty (no words, no places, score 0, empty
labels); repeated rows are treated alike; other columns are ignored; an empty
table gives an empty table.  Whole texts only.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from ahocorasick import Automaton
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table

#: The base phrases with their labels, then those that the fuzzy search adds.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
NOTICES = BASE | {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "redistribution and use in source and binary forms": "bsd",
    "permission is hereby granted free of charge to any person": "mit",
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "released into the public domain": "public-domain",
    "all rights reserved": "all-rights-reserved",
}
#: Letters of a notice for each error that is allowed.
LETTERS_PER_ERROR = 10
#: Bytes of words stay (letters in lower case), all others become spaces.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,first_word:long,n_words:long,errors:long,exact_base:boolean>>"
SPANS = pa.list_(pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("errors", pa.int64()), ("exact_base", pa.bool_())]))


def errors_for(phrase: str) -> int:
    return len(phrase) // LETTERS_PER_ERROR


def seeds(phrase: str) -> list[tuple[int, str]]:
    """(offset, part): the phrase in errors + 1 parts of nearly equal length."""
    parts = errors_for(phrase) + 1
    cuts = [len(phrase) * k // parts for k in range(parts + 1)]
    return [(a, phrase[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Search:
    def __init__(self, notices: dict[str, str] | None = None):
        self.notices = notices or NOTICES
        self.fuzzy = {p: regex.compile(rf"(?b)(?:{regex.escape(p, literal_spaces=True)}){{e<={errors_for(p)}}}") for p in self.notices}
        places: dict[str, list[tuple[str, int]]] = {}
        for phrase in self.notices:
            for offset, part in seeds(phrase):
                places.setdefault(part, []).append((phrase, offset))
        self.automaton = Automaton()
        for part, where in places.items():
            self.automaton.add_word(part, (len(part), where))
        self.automaton.make_automaton()

    def find(self, text: str | None) -> tuple[int, list[tuple[str, int, int, int, bool]]]:
        """(words, [(label, first word, words, errors, exact place of a base phrase)])."""
        norm = b" ".join((text or "").encode().translate(WORD_BYTES).split()).decode()
        self.best = 0.0
        if not norm:
            return 0, []
        tried: set[tuple[str, int]] = set()
        found: dict[str, dict[tuple[int, int], int | None]] = {}
        starts = ends = None
        for end, (size, where) in self.automaton.iter(norm):
            for phrase, offset in where:
                start = end + 1 - size - offset
                if (phrase, start) in tried:
                    continue
                tried.add((phrase, start))
                if starts is None:
                    spaces = [k for k, c in enumerate(norm) if c == " "]
                    starts, ends = [0, *(k + 1 for k in spaces)], [*spaces, len(norm)]
                k, n = errors_for(phrase), len(phrase)
                own = found.setdefault(phrase, {})
                for low in starts[bisect_left(starts, start - k) : bisect_right(starts, start + k)]:
                    for high in ends[bisect_left(ends, max(low + 1, low + n - k)) : bisect_right(ends, low + n + k)]:
                        if (low, high) not in own:
                            match = self.fuzzy[phrase].fullmatch(norm, low, high)
                            own[low, high] = sum(match.fuzzy_counts) if match else None
        spans = []
        for phrase, own in found.items():
            for wrong, low, high in apart((e, low, high) for (low, high), e in own.items() if e is not None):
                first = bisect_left(starts, low)
                spans.append((self.notices[phrase], first, bisect_right(starts, high) - first, wrong, not wrong and phrase in BASE))
                self.best = max(self.best, 1 - wrong / len(phrase))
        spans.sort()
        return norm.count(" ") + 1, spans


def apart(matches: Iterable[tuple[int, int, int]]) -> Iterator[tuple[int, int, int]]:
    """Of (errors, start, end) in ascending order those that overlap none before them."""
    taken: list[tuple[int, int]] = []
    for wrong, low, high in sorted(matches):
        at = bisect_left(taken, (low, high))
        if (at and taken[at - 1][1] > low) or (at < len(taken) and taken[at][0] < high):
            continue
        taken.insert(at, (low, high))
        yield wrong, low, high


def scan(docs: DataFrame, notices: dict[str, str] | None = None) -> DataFrame:
    """Words, base places, labels, score and spans of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Search(notices)
        for batch in slices(batches):
            rows = []
            for text in batch.column(1).to_pylist():
                words, spans = search.find(text)
                starts = [s[1] for s in spans if s[4]]
                rows.append((words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({s[0] for s in spans if s[4]})), ",".join(sorted({s[0] for s in spans})), search.best, [dict(zip(("label", "first_word", "n_words", "errors", "exact_base"), s, strict=True)) for s in spans]))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.string(), pa.float64(), SPANS]
            names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds))], names)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("spans")
