"""Licenses, quality rules, personal data and toxicity against plain versions."""

from __future__ import annotations

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import licenses, pii, quality, toxicity

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
BLACK = re.compile(r"[^\x20\x09-\x0D]+")
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


def base_licenses(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(k, label) for phrase, label in PHRASES.items() for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
    starts = [k for k, _ in places]
    return len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({label for _, label in places}))


def base_counts(text):
    text = text or ""
    words = BLACK.findall(text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if BLACK.search(line):
            dup += line in seen
            seen.add(line)
    windows = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    repeat = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(repeat), len(words) < 50 or 100 * len(repeat) > 50 * len(words)


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def base_personal(text):
    text = text or ""
    spans = [
        [m.span() for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)],
        [m.span() for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))],
        [m.span() for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 16 <= len(d := re.sub("[ -]", "", m[0])) <= 19 and luhn(d)],
        [m.span() for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 8 <= len(re.findall("[0-9]", m[0])) <= 15],
    ]
    line = ",".join(f"{k}:{a}:{b}" for k, own in zip(("email", "ip", "card", "phone"), spans, strict=True) for a, b in own)
    return *map(len, spans), hashlib.sha256(line.encode()).hexdigest()


def whole_table(spark, sf):
    return {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}


def test_license_query(spark, sf):
    docs = whole_table(spark, sf)
    found = licenses.op2_license_scan(spark, sf).collect()
    assert len(found) == len(docs)
    for r in found:
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == base_licenses(docs[r.doc_id])
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))


def test_license_bases_on_random_texts():
    rng, search = random.Random(5), licenses.Search()
    parts = ["mit", "license", "MIT License", "mitlicense", "cc", "by", "CC-BY", "apache", " ", " ", "-", "gnu general public license", "é", "\n", "public"]
    for _ in range(1500):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        words, spans = search.find(text)
        starts = [s[1] for s in spans if s[4]]
        assert (words, len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted({s[0] for s in spans if s[4]}))) == base_licenses(text)


@pytest.mark.parametrize(("text", "label", "errors"), [("under the MIT Licence.", "mit", 1), ("the GNU Generl Public Lisense", "gpl", 2), ("All rights resrved", "all-rights-reserved", 1), ("Apache Lcense v2", "apache", 1)])
def test_notices_with_errors_are_found(text, label, errors):
    _, spans = licenses.Search().find("some words before. " + text + " and after")
    assert [(s[0], s[3], s[4]) for s in spans] == [(label, errors, False)]
    assert not licenses.Search().find("the mighty lice sense of a permit licensee")[1]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def plain_notices(text, notices):
    """Spans of the notices, from the distances of all runs of whole words."""
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text))
    spans = []
    for phrase, label in notices.items():
        matches = []
        for a in range(len(words)):
            for b in range(a + 1, len(words) + 1):
                run = " ".join(words[a:b])
                if len(run) > len(phrase) + len(phrase) // 10:
                    break
                if (wrong := distance(phrase, run)) <= len(phrase) // 10:
                    matches.append((wrong, a, b))
        taken = []
        for wrong, a, b in sorted(matches):
            if all(b <= x or y <= a for x, y in taken):
                taken.append((a, b))
                spans.append((label, a, b - a, wrong, not wrong and phrase in PHRASES))
    return sorted(spans)


@pytest.mark.parametrize("text", ["the mit licensezzz", "an apache licenseabc", "the xmit license x", "the zapache license x", "mit licensex", "zzmit license", "mit license mit license", "mi t license and mit lic ense", "gnu lesser general public license mit licens"])
def test_borders_of_fuzzy_matches(text):
    assert licenses.Search().find(text)[1] == plain_notices(text, licenses.NOTICES)


def test_fuzzy_search_finds_all_windows_of_whole_words():
    rng, search = random.Random(9), licenses.Search()
    for _ in range(400):
        text = list(" ".join(rng.choice([*licenses.NOTICES, "foo", "mit", "license", "x"]) for _ in range(rng.randint(1, 4))))
        for _ in range(rng.randint(0, 5)):
            at, kind = rng.randrange(len(text) + 1), rng.random()
            if kind < 0.4:
                text.insert(at, rng.choice("ilae "))
            elif at < len(text):
                text[at : at + 1] = [] if kind < 0.7 else rng.choice("ilae ")
        text = "".join(text)
        assert search.find(text)[1] == plain_notices(text, licenses.NOTICES), text


def test_many_inexact_notices_take_linear_time():
    import time

    began = time.process_time()
    words, spans = licenses.Search().find("mit licence foo " * 8000)
    assert (words, len(spans)) == (24_000, 8000) and time.process_time() - began < 4


def test_seeds_cannot_all_be_hit():
    rng = random.Random(0)
    for phrase in licenses.NOTICES:
        parts = licenses.seeds(phrase)
        assert "".join(p for _, p in parts) == phrase and len(parts) == licenses.errors_for(phrase) + 1
        for _ in range(50):
            text = list(phrase)
            for _ in range(licenses.errors_for(phrase)):
                text[rng.randrange(len(text))] = rng.choice("xyz")
            assert any(p in "".join(text) for _, p in parts)


def test_quality_query_and_cascade(spark, sf):
    docs = whole_table(spark, sf)
    found = quality.op4_quality_rules(spark, sf).collect()
    for r in found:
        assert tuple(r)[1:7] == base_counts(docs[r.doc_id])
        assert not (r.kept and r.base_failed)
    table = spark.read.parquet(f"{sf}/documents.parquet")
    order = quality.cascade(table)
    assert sorted(order) == sorted(quality.RULES)
    # the order changes the work, not the verdict
    other = {(r.doc_id, r.kept) for r in quality.judge(table, order[::-1]).collect()}
    assert other == {(r.doc_id, r.kept) for r in found}


def test_quality_counts_on_random_texts(spark):
    rng = random.Random(3)
    parts = ["a", "b", "é", "\n", " ", "\t", "\x0b", "\x1c", "　", "|", "#", "a b c", "\r\n", ""]
    rows = [(k, "".join(rng.choice(parts) for _ in range(rng.randint(0, 40)))) for k in range(300)]
    found = {r.doc_id: tuple(r)[1:7] for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string"), list(quality.RULES)).collect()}
    assert found == {k: base_counts(t) for k, t in rows}


def rejections(text):
    """The rules that reject a text, written plainly."""
    text = text or ""
    words = BLACK.findall(text)
    n, chars, symbols, dup, repeat, _ = base_counts(text)
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    lines = sum(bool(BLACK.search(line)) for line in text.split("\n"))
    windows = [words[k : k + 5000] for k in range(max(1, n - 4999))]
    data = text.encode()
    found = {
        "symbols": symbols / max(1, n) > 0.2, "exclamation": text.count("!") / max(1, n) > 0.5, "capitals": upper / max(1, upper + lower) > 0.5,
        "word_length": not 2 <= chars / max(1, n) <= 20, "repeated_lines": dup / max(1, lines) > 0.3, "repeated_words": 100 * repeat > 30 * n,
        "few_distinct_words": n >= 50 and sum(len(set(w)) / len(w) for w in windows) / len(windows) < 0.2,
        "compressible": len(data) >= 200 and len(zlib.compress(data, 1)) < 0.2 * len(data),
    }
    return {name for name, bad in found.items() if bad}


def test_verdicts_are_those_of_plain_rules(spark, sf):
    docs = whole_table(spark, sf)
    for order in (list(quality.RULES), list(quality.RULES)[::-1]):
        for r in quality.judge(spark.read.parquet(f"{sf}/documents.parquet"), order).collect():
            bad = rejections(docs[r.doc_id])
            assert r.kept == (not r.base_failed and not bad)
            assert r.rejected_by == ("base" if r.base_failed else next((x for x in order if x in bad), None))


def test_no_text_leaves_the_tasks_that_measure(spark, sf):
    plan = quality.measured(spark.read.parquet(f"{sf}/documents.parquet"), rows=50)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Limit" not in plan


def test_tasks_that_measure_stop_after_their_share(spark):
    docs = spark.range(4_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.sequence(F.lit(1), F.lit(60)).cast("array<string>"), F.col("id").cast("string")).alias("text")).repartition(4)
    assert {r.seen for r in quality.measured(docs, rows=100).collect()} == {100}
    assert {r.seen for r in quality.measured(docs.limit(30), rows=100).collect()} == {30}


def test_clean_documents_are_kept_and_junk_is_not():
    clean = " ".join(f"word{k} and thing{k * 7 % 101}" for k in range(80))
    import pyarrow as pa

    texts = quality.Texts(pa.array([clean, clean.replace(" ", "*** "), clean.replace(" ", "!! "), clean.upper().replace("0", "O"), "same line here\n" * 40]))
    bad = np.any([rule(texts, np.arange(5)) for rule in quality.RULES.values()], axis=0)
    assert bad.tolist() == [False, True, True, True, True]


def test_few_distinct_words_at_every_length():
    import pyarrow as pa

    rng = random.Random(7)
    junk = [f"word{k}" for k in range(100)]
    prose = [f"term{k}" for k in range(6000)]
    texts = [" ".join(rng.choice(junk) for _ in range(n)) for n in (4_999, 5_000, 5_001, 20_000)]
    texts += [" ".join(rng.choice(prose) for _ in range(n)) for n in (4_999, 5_001, 20_000, 60_000)]
    assert quality.RULES["few_distinct_words"](quality.Texts(pa.array(texts)), np.arange(8)).tolist() == [True] * 4 + [False] * 4


def test_distinct_share_is_the_mean_over_all_windows():
    import pyarrow as pa

    rng = random.Random(8)
    texts = [*("".join(rng.choice("abcde") + " " for _ in range(rng.randint(0, 40))) for _ in range(60)), "", None]
    of = np.array(sorted([*range(0, 62, 2), 41, 61]))
    found = quality.Texts(pa.array(texts)).distinct_share(of, window=7)
    for text, share in zip([texts[k] for k in of], found, strict=True):
        words = (text or "").split()
        windows = [words[k : k + 7] for k in range(max(1, len(words) - 6))]
        assert share == pytest.approx(sum(len(set(w)) / max(1, len(w)) for w in windows) / len(windows))


def test_personal_data_query(spark):
    sf = "/root/testdata/sf0.01"
    docs = whole_table(spark, sf)
    found = pii.op10_pii(spark, sf).collect()
    assert len(found) == len(docs)
    for r in found:
        assert tuple(r)[1:6] == base_personal(docs[r.doc_id])
        spans = [s.split(":") for s in filter(None, r.spans.split(","))]
        assert spans == sorted(spans, key=lambda s: (pii.KINDS.index(s[0]), int(s[1])))
    assert any("secret" in r.spans for r in found)


def test_personal_bases_on_random_texts():
    rng = random.Random(5)
    parts = ["a@b.co", "+1 (651) 555-8500", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", ".5.6", "@", "x", "-", " ", "9", "00001.2.3.256", "+", "é", "b.c", "_z@y.com", "\n", "٣"]
    for _ in range(2000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        spans = pii.base_spans(text)
        line = ",".join(f"{pii.KINDS[k]}:{a}:{b}" for k, a, b in spans)
        assert (*(sum(s[0] == k for s in spans) for k in range(4)), hashlib.sha256(line.encode()).hexdigest()) == base_personal(text)


def plain_candidates(text):
    """Base spans and loose ones that overlap none of them, by plain patterns and all pairs."""
    base = sorted(pii.base_spans(text))
    at = re.compile(r"[A-Za-z0-9._%+-]+\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)+")
    secret = re.compile(r"(?i:token|password|passwd|secret|api_?key|access_?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+-]{12,})")
    loose = [(0, *m.span()) for m in at.finditer(text)] + [(4, *m.span(1)) for m in secret.finditer(text)]
    loose += [(2, *m.span()) for m in re.finditer(r"[0-9](?:[\x20-]?[0-9])+", text) if 13 <= len(re.findall("[0-9]", m[0])) <= 19]
    loose += [(3, *m.span()) for m in re.finditer(r"\(?\b[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}\b", text)]
    return [(*s, True) for s in base] + [(*s, False) for s in sorted(loose) if not any(a < s[2] and s[1] < b for _, a, b in base)]


def test_candidates_on_random_texts():
    rng = random.Random(6)
    parts = ["joe.x", " ", "(at)", "[at]", " (at) ", "site", ".", "(dot)", "org", "a@b.co", "password = ", "token:", "abcDEF123456_x", "Zz9" * 40, "4111 1111 1111 111", "4111 1111 1111 1111", "555-123-4567", "1.2.3.4", "\n", "é"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert pii.candidates_of(text) == plain_candidates(text), text


def test_a_long_base_span_is_not_overlooked():
    text = "+1 " + "(1) " * 3 + "2 " + " 1.2.3.4" * 12 + "@" + "a" * 30
    assert pii.candidates_of(text) == plain_candidates(text)
    secret = "password=" + "aB3_" * 75
    assert [(c[0], c[2] - c[1]) for c in pii.candidates_of(secret)] == [(4, 300)]


def test_grouped_votes_give_the_beliefs_of_single_ones():
    rng = np.random.default_rng(4)
    ballots = rng.integers(-1, 2, (60, 5)).astype(float)
    counts = rng.integers(1, 9, 60)
    kinds = rng.integers(0, 3, 60)
    grouped = pii.reliabilities(kinds, ballots, counts.astype(float))
    single = pii.reliabilities(np.repeat(kinds, counts), np.repeat(ballots, counts, axis=0), np.ones(counts.sum()))
    assert np.allclose(np.repeat(grouped, counts), single)


def test_the_classifier_goes_by_the_span_and_its_words():
    rng = random.Random(2)
    good = [f"call the phone line {rng.randint(200, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)} today" for _ in range(200)]
    bad = [f"see the serial part {rng.randint(200, 999)}-{rng.randint(100, 999)}-{rng.randint(1000, 9999)} instead" for _ in range(200)]
    rows = []
    for text in good + bad:
        ((kind, a, b, _),) = pii.candidates_of(text)
        rows.append(pii.features(text, kind, a, b))
    w = pii.classifier(rows, np.array([0.95] * 200 + [0.05] * 200), np.ones(400))
    for text, want in (("or dial our phone line 321-555-0199 now", True), ("it has the serial part 321-555-0199 on it", False)):
        ((kind, a, b, _),) = pii.candidates_of(text)
        own = pii.features(text, kind, a, b)
        assert (1 / (1 + np.exp(-sum(w[k] for k in own))) >= 0.5) == want


def test_accepted_spans_are_those_of_the_weights(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    w = pii.learned(pii.spotted(docs))
    found = {r.doc_id: [tuple(s) for s in r.spans] for r in pii.personal_data(docs).collect()}
    for doc_id, text in whole_table(spark, sf).items():
        chance = {c: 1 / (1 + np.exp(-np.clip(sum(w[k] for k in pii.features(text, *c[:3])), -30, 30))) for c in pii.candidates_of(text or "")}
        want = [c for c in chance if c[3]]
        for c in sorted((c for c in chance if not c[3] and chance[c] >= 0.5), key=lambda c: (-chance[c], c[1], c[2], c[0])):
            if not any(o[1] < c[2] and c[1] < o[2] for o in want if not o[3]):
                want.append(c)
        assert found[doc_id] == sorted(want)


def test_loose_spans_do_not_overlap():
    text = "call 555-123-4567 890 now"
    spans = pii.candidates_of(text)
    assert sorted((text[a:b], k) for k, a, b, _ in spans) == [("555-123-4567", 3), ("555-123-4567 890", 2)]
    each = [{"kind": k, "start": a, "end": b, "base": own} for k, a, b, own in spans]
    for chance, kept in (({2: 0.9, 3: 0.8}, 2), ({2: 0.6, 3: 0.8}, 3), ({2: 0.7, 3: 0.7}, 3), ({2: 0.4, 3: 0.8}, 3)):
        assert [s[0] for s in pii.apart(each, [chance[f["kind"]] for f in each])] == [kept]
    rng = random.Random(5)
    many = [{"kind": rng.randint(0, 4), "start": (a := rng.randint(0, 500)), "end": a + rng.randint(1, 20), "base": rng.random() < 0.1} for _ in range(300)]
    kept = pii.apart(many, [rng.random() for _ in many])
    loose = sorted((a, b) for _, a, b, own in kept if not own)
    assert all(b <= c for (_, b), (c, _) in zip(loose, loose[1:], strict=False)) and sum(own for *_, own in kept) == sum(f["base"] for f in many)


def test_the_padding_of_a_secret_belongs_to_it():
    text = "token = a1a1a1a1a1a1a1== and password: abcdefghijkl3="
    assert [text[a:b] for _, a, b, _ in pii.candidates_of(text)] == ["a1a1a1a1a1a1a1==", "abcdefghijkl3="]


def test_long_runs_take_linear_time():
    for text in ("a" * 200_000 + "(at)", "a(at)" * 40_000, "password=" * 20_000, "555-123-4567 " * 4000 + "a.b@c.de " * 4000):
        assert pii.candidates_of(text) is not None
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 100_000, "a@" * 100_000):
        assert pii.base_spans(text) is not None


def test_reliabilities_find_the_good_labelers():
    rng = np.random.default_rng(0)
    truth = rng.random(4000) < 0.5
    right = np.array([0.95, 0.9, 0.55, 0.9, 0.5])
    ballots = np.where(rng.random((4000, 5)) < right, 1, -1) * np.where(truth, 1, -1)[:, None]
    belief = pii.reliabilities(np.zeros(4000, int), ballots.astype(float), np.ones(4000))
    majority = (ballots.sum(axis=1) > 0) == truth
    assert ((belief > 0.5) == truth).mean() > max(0.95, majority.mean())


def test_odd_rows_have_defined_results(odd, odd_rows, nothing):
    texts = collections.Counter((d, t) for d, t, *_ in odd_rows)
    for run, plain, width in ((licenses.scan, base_licenses, 5), (quality.judge, base_counts, 6)):
        found = collections.Counter((r.doc_id, tuple(r)[1 : 1 + width]) for r in run(odd).collect())
        assert found == collections.Counter({(d, plain(t)): n for (d, t), n in texts.items()} if len({(d, plain(t)) for d, t in texts}) == len(texts) else [(d, plain(t)) for d, t, *_ in odd_rows])
        assert run(nothing).count() == 0
    spans = {r.doc_id: r.spans for r in pii.personal_data(odd).collect()}
    assert [pii.KINDS[s.kind] for s in spans[10]] == ["email", "ip", "card", "phone"] and spans[1] == spans[2] == []
    assert pii.personal_data(nothing).count() == 0


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    toxic = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    found = toxicity.op8_toxicity(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [(r.predicted, toxic[r.doc_id]) for r in found if r.held_out and r.doc_id in toxic]
    assert sum(a == b for a, b in held) >= 0.95 * len(held)
    assert sum(a for a, b in held if not b) <= 0.02 * len(held)
    again = toxicity.op8_toxicity(spark, sf).collect()
    assert {(r.doc_id, r.score) for r in again} == {(r.doc_id, r.score) for r in found}


def test_pairs_count_beyond_single_terms():
    rng = np.random.default_rng(1)
    a, b = rng.random(1500) < 0.5, rng.random(1500) < 0.5
    rows = [np.array(sorted([10] * int(x) + [20] * int(y) + [30]), "<i4").tobytes() for x, y in zip(a, b, strict=True)]
    machine = toxicity.fitted(rows, (a & b).astype(float))
    place = machine.place()

    def score(*terms):
        known = [place[t] for t in terms if place[t] >= 0]
        return machine.score(1, np.zeros(len(known), np.int64), np.array(known, np.int64))[0]

    assert score(10, 20, 30) > 0.9 and max(score(10, 30), score(20, 30), score(30)) < 0.1


def test_toxicity_of_odd_rows(spark, odd, odd_rows, nothing):
    labels = spark.createDataFrame([(d, int(d % 3 == 0)) for d, *_ in odd_rows if d is not None] + [(None, 1), (4, None)], "doc_id long, toxic int")
    machine = toxicity.learned(odd, labels)
    scores = toxicity.scored(odd, machine)
    assert scores.count() == len(odd_rows) and scores.where("score is null or score < 0 or score > 1").count() == 0
    kept = toxicity.without_toxic(odd, machine)
    assert kept.columns == odd.columns and kept.count() == scores.where("score < 0.5").count()
    assert toxicity.scored(nothing, machine).count() == 0
    empty = toxicity.learned(nothing, labels)
    assert {r.score for r in toxicity.scored(odd, empty).collect()} == {toxicity.scored(odd, empty).first().score}


def test_scores_are_those_of_a_plain_factorization_machine(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    machine = toxicity.learned(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    known = {int(b): k for k, b in enumerate(machine.buckets)}

    def plain(text):
        shared, terms = {}, set()
        for word in set((text or "").split()) if (text or "").isascii() else set(re.split("[\x20\x09-\x0d]+", text)) - {""}:
            w = word.strip(toxicity.MARKS).lower()
            own = [zlib.crc32(b"w" + w.encode()) % toxicity.BUCKETS] * bool(w) + [zlib.crc32(b"%d" % k + w[:k].encode()) % toxicity.BUCKETS for k in (4, 5, 6) if len(w) >= k]
            for t in own:
                shared[t] = shared.get(t, 0) + 1
        terms = set(shared) | {(t * 2654435761 + 40503) % toxicity.BUCKETS for t, n in shared.items() if n > 1}
        at = sorted(known[t] for t in terms if t in known)
        raw = machine.base + sum(machine.weights[i] for i in at)
        raw += sum(float(machine.factors[i] @ machine.factors[j]) for n, i in enumerate(at) for j in at[n + 1 :])
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))

    texts = [(d, t) for d, t in sorted(whole_table(spark, sf).items()) if len(t or "") < 4000]
    found = {r.doc_id: r.score for r in toxicity.scored(docs, machine).collect()}
    assert len(known) and texts
    for d, t in texts:
        assert found[d] == pytest.approx(plain(t), abs=1e-9)


def test_the_sample_has_one_row_an_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "other"), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    rows = toxicity.samples(docs, labels, rows=2).collect()
    assert len(rows) <= 2 and len({r.doc_id for r in rows}) == len(rows)
    folds = {r.doc_id: r.held_out for r in docs.select("doc_id", F.coalesce(~toxicity.is_training(F.col("doc_id")), F.lit(False)).alias("held_out")).collect()}
    assert folds[None] is False


def test_a_term_that_tells_nothing_alone_counts_in_pairs():
    # a group's name (20) is toxic beside an insult (10), harmless beside nothing, and beside praise (30) it is the less toxic
    rng = np.random.default_rng(3)
    rows, toxic = [], []
    for _ in range(3000):
        insult, group = rng.random() < 0.2, rng.random() < 0.5
        other = not insult and not group and rng.random() < 0.2  # toxic without either, so that the name is neutral over all texts
        rows.append(np.array(sorted([10] * insult + [20] * group + [40]), "<i4").tobytes())
        toxic.append(float(insult and group or other))
    toxic = np.array(toxic)
    assert not toxicity.tells(rows, toxic, 4.0)[20]
    machine = toxicity.fitted(rows, toxic)
    assert {10, 20} <= set(machine.buckets.tolist())
    place = machine.place()

    def score(*terms):
        known = [place[t] for t in terms if place[t] >= 0]
        return machine.score(1, np.zeros(len(known), np.int64), np.array(known, np.int64))[0]

    assert score(10, 20, 40) > 0.8 and max(score(10, 40), score(20, 40)) < 0.4
