"""Quality rules as a short-circuit cascade.

Every rule has a cost and a rejection rate, both measured on a sample of about
``SAMPLE_ROWS`` documents from all parts of the table.  Rules run in descending
order of rejections per second; each works on the documents that all earlier
ones let pass and on no other.  Words are split once, and rules about what the
base columns count anyway take those counts.  The order changes the work, never
the verdict: a document is kept if no rule rejects it.

Defined results: null text has no words and fails the base rules; repeated rows
are judged alike; other columns are ignored by ``judge``; an empty table gives
an empty table.  Whole texts only.
"""

from __future__ import annotations

import time
import zlib
from collections.abc import Callable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, table

#: Documents, about, on which cost and selectivity of the rules are measured.
SAMPLE_ROWS = 1_000
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words of a window in which distinct words are counted; a longer text is judged by the mean over all its windows.
WINDOW = 5_000

SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, rejected_by string"


class Texts:
    """Some documents with their words, split once, and the counts of the base columns."""

    def __init__(self, column: pa.Array):
        text = pc.fill_null(column.cast(pa.string()), "")
        self.text = text
        self.n = len(text)
        words = pc.ascii_split_whitespace(text)
        flat = pc.list_flatten(words)
        owner = np.asarray(pc.list_parent_indices(words)).astype(np.int64)
        real = np.asarray(pc.not_equal(flat, ""))
        self.owner = owner[real]
        self.words = flat.filter(pa.array(real)).dictionary_encode() if not real.all() else flat.dictionary_encode()
        self.ids = np.asarray(self.words.indices).astype(np.int64)
        self.n_words = np.bincount(self.owner, minlength=self.n)
        whole = text.cast(pa.large_string())
        self.cuts = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset : whole.offset + self.n + 1]
        self.bytes = np.frombuffer(whole.buffers()[2] or b"", np.uint8)

    def marked(self, of: np.ndarray, chosen: np.ndarray) -> np.ndarray:
        """Bytes of each of the texts ``of`` for which ``chosen`` (by byte value) holds."""
        parts = [self.bytes[a:b] for a, b in zip(self.cuts[of].tolist(), self.cuts[of + 1].tolist(), strict=True)]
        total = np.append(0, np.cumsum(chosen[np.concatenate(parts)] if parts else np.zeros(0, bool), dtype=np.int64))
        ends = np.append(0, np.cumsum(self.cuts[of + 1] - self.cuts[of]))
        return total[ends[1:]] - total[ends[:-1]]

    @cached_property
    def word_chars(self) -> np.ndarray:
        size = np.asarray(pc.utf8_length(self.words.dictionary)).astype(np.int64)
        return np.bincount(self.owner, weights=size[self.ids], minlength=self.n).astype(np.int64) if len(self.ids) else np.zeros(self.n, np.int64)

    @cached_property
    def n_symbols(self) -> np.ndarray:
        return self.marked(np.arange(self.n), bytes_in(SYMBOLS))

    @cached_property
    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """(lines with a word, such lines equal to an earlier one) of each text."""
        parts = pc.split_pattern(self.text, "\n")
        flat = pc.list_flatten(parts)
        owner = np.asarray(pc.list_parent_indices(parts)).astype(np.int64)
        full = np.asarray(pc.not_equal(pc.ascii_trim_whitespace(flat), ""))
        ids = np.asarray(flat.filter(pa.array(full)).dictionary_encode().indices).astype(np.int64)
        owner = owner[full]
        count = np.bincount(owner, minlength=self.n)
        if not len(ids):
            return count, count
        distinct = np.unique(owner * (int(ids.max()) + 1) + ids)
        return count, count - np.bincount(distinct // (int(ids.max()) + 1), minlength=self.n)

    @cached_property
    def repeat_words(self) -> np.ndarray:
        """Words that stand in a window of three words found more than once in the text."""
        out = np.zeros(self.n, np.int64)
        if len(self.ids) < 3:
            return out
        size = int(self.ids.max()) + 1
        pair = self.ids[:-1] * size + self.ids[1:]
        if size > 2_000_000:  # keeps the next product within 63 bits
            _, pair = np.unique(pair, return_inverse=True)
        key = pair[:-1] * size + self.ids[2:]
        whole = self.owner[:-2] == self.owner[2:]
        at = np.flatnonzero(whole)
        order = at[np.argsort(key[at], kind="stable")]
        same = (key[order[1:]] == key[order[:-1]]) & (self.owner[order[1:]] == self.owner[order[:-1]])
        often = np.zeros(len(order), bool)
        often[1:] |= same
        often[:-1] |= same
        covered = np.zeros(len(self.ids), bool)
        first = order[often]
        for step in range(3):
            covered[first + step] = True
        return np.bincount(self.owner[covered], minlength=self.n)

    @property
    def base_failed(self) -> np.ndarray:
        return (self.n_words < 50) | (100 * self.repeat_words > 50 * self.n_words)

    def distinct_share(self, of: np.ndarray, window: int = WINDOW) -> np.ndarray:
        """Mean share of distinct words over all windows of consecutive words; a text of one window or less is one window."""
        place = np.full(self.n, -1, np.int64)
        place[of] = np.arange(len(of))
        own = place[self.owner]
        own, ids, n_words = own[own >= 0], self.ids[own >= 0], self.n_words[of]
        size = int(ids.max()) + 1 if len(ids) else 1
        key = own * size + ids
        order = np.argsort(key, kind="stable")
        again = key[order[1:]] == key[order[:-1]]
        first = np.zeros(len(of) + 1, np.int64)
        first[1:] = np.cumsum(n_words)
        at = np.arange(len(key)) - first[own]
        before = np.full(len(key), -1, np.int64)
        before[order[1:][again]] = at[order[:-1][again]]
        wide = np.minimum(n_words, window)
        last = n_words - wide
        # a word is new in the windows that start after its previous place and hold it
        new = np.minimum(at, last[own]) - np.maximum(before, at - wide[own])
        return np.bincount(own, weights=np.maximum(0, new), minlength=len(of)) / np.maximum(1, (last + 1) * wide)


def bytes_in(characters: str) -> np.ndarray:
    return np.isin(np.arange(256), [ord(c) for c in characters])


def _per(value: np.ndarray, of: np.ndarray) -> np.ndarray:
    return value / np.maximum(1, of)


def _capitals(t: Texts, of: np.ndarray) -> np.ndarray:
    upper, lower = t.marked(of, bytes_in("ABCDEFGHIJKLMNOPQRSTUVWXYZ")), t.marked(of, bytes_in("abcdefghijklmnopqrstuvwxyz"))
    return _per(upper, upper + lower) > 0.5


def _packed(t: Texts, of: np.ndarray) -> np.ndarray:
    out = np.zeros(len(of), bool)
    for k, (a, b) in enumerate(zip(t.cuts[of].tolist(), t.cuts[of + 1].tolist(), strict=True)):
        out[k] = b - a >= 200 and len(zlib.compress(t.bytes[a:b], 1)) < 0.2 * (b - a)
    return out


#: name -> which of the texts ``of`` it rejects.
RULES: dict[str, Callable[[Texts, np.ndarray], np.ndarray]] = {
    "symbols": lambda t, of: _per(t.n_symbols[of], t.n_words[of]) > 0.2,
    "exclamation": lambda t, of: _per(t.marked(of, bytes_in("!")), t.n_words[of]) > 0.5,
    "capitals": _capitals,
    "word_length": lambda t, of: (_per(t.word_chars[of], t.n_words[of]) < 2) | (_per(t.word_chars[of], t.n_words[of]) > 20),
    "repeated_lines": lambda t, of: _per(t.lines[1][of], t.lines[0][of]) > 0.3,
    "repeated_words": lambda t, of: 100 * t.repeat_words[of] > 30 * t.n_words[of],
    "few_distinct_words": lambda t, of: (t.n_words[of] >= 50) & (t.distinct_share(of) < 0.2),
    "compressible": _packed,
}


def columns(t: Texts) -> list[np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    return [x.astype(np.int64) for x in (t.n_words, t.word_chars, t.n_symbols, t.lines[1], t.repeat_words)]


def measured(docs: DataFrame, rules: list[str] | None = None, rows: int = SAMPLE_ROWS) -> DataFrame:
    """rule, seconds, seen, rejected on about ``rows`` documents; only these counts leave the tasks.

    Each task reads its share of them, the first of its part of the table, and stops there.
    """
    names, texts = rules or list(RULES), docs.select(F.col("text").cast("string"))
    share = -(-rows // max(1, texts.rdd.getNumPartitions()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        left = share
        for batch in slices(batches, column=0):
            batch = batch.slice(0, left)
            left -= batch.num_rows
            texts = Texts(batch.column(0))
            columns(texts)
            of = np.flatnonzero(~texts.base_failed)
            for name in names:
                began = time.thread_time()
                bad = RULES[name](texts, of)
                took = time.thread_time() - began
                yield pa.RecordBatch.from_pydict({"rule": [name], "seconds": [took], "seen": [len(of)], "rejected": [int(bad.sum())]})
            if not left:
                return

    each = texts.mapInArrow(run, "rule string, seconds double, seen long, rejected long")
    return each.groupBy("rule").agg(F.sum("seconds").alias("seconds"), F.sum("seen").alias("seen"), F.sum("rejected").alias("rejected"))


def cascade(docs: DataFrame) -> list[str]:
    """The rules, those first that reject most per second; of equal ones the cheaper first."""
    found = {r["rule"]: r for r in measured(docs).collect()}  # a row per rule

    def worth(name: str) -> tuple[float, float, str]:
        if name not in found:
            return (0.0, 0.0, name)
        r = found[name]
        return (-r["rejected"] / max(r["seconds"], 1e-9), r["seconds"], name)

    return sorted(RULES, key=worth)


def judge(docs: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Base counts and the verdict of each text; ``rejected_by`` names the rule that ended the cascade (``base`` for the base rules)."""
    order = order or cascade(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            texts = Texts(batch.column(1))
            counts, base = columns(texts), texts.base_failed
            by = np.where(base, "base", "").astype(object)
            left = np.flatnonzero(~base)
            for name in order:
                if not len(left):
                    break
                bad = RULES[name](texts, left)
                by[left[bad]] = name
                left = left[~bad]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *map(pa.array, counts), pa.array(base), pa.array(by == ""), pa.array([x or None for x in by], pa.string())],
                ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rejected_by"],
            )

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents")).drop("rejected_by")
