"""Personal data by weak supervision.

Candidate spans come from strict patterns (the base kinds) and looser ones.
Five labelers vote on each (+1, 0, -1): pattern, checksum, gazetteer, context,
borders.  Votes are counted over all documents by kind and pattern of votes;
expectation-maximisation on those counts (kinds x 3^labelers rows at most, at any
input size) estimates each labeler's reliability without labels.  Its beliefs
are the targets of a logistic span classifier, which does not see the votes but
the span: its shape, length, characters and the words about it, hashed.  It is
fitted on about ``SAMPLE_SPANS`` distinct spans a kind, weighted by how often
they occur.  A candidate that it accepts becomes a span; base spans always stay.

Defined results: null text is empty and has no spans (the digest of the empty
string, empty spans); repeated rows are treated alike; other columns are
ignored; an empty table gives an empty table.  Whole texts only; offsets are
code points.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import slices, stored, table

#: Kinds in the order of the results.
KINDS = ["email", "ip", "card", "phone", "secret"]
LABELERS = ["pattern", "checksum", "gazetteer", "context", "borders"]
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
LOOSE_PHONE = re.compile(r"\(?\b[0-9]{3}\)?[\x20.-][0-9]{3}[.-][0-9]{4}\b")
AT_MARK = re.compile(r"\x20?(?:\(at\)|\[at\])\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|\(dot\)|\[dot\])\x20?[A-Za-z0-9-]+)+")
SECRET = re.compile(r"(?:token|password|passwd|secret|api_?key|access_?key)\s{0,3}[=:]\s{0,3}[\"']?([A-Za-z0-9_/+-]{12,}+={0,2})", re.I)
#: Fixed values for the gazetteers: top-level domains beside those of two letters, E.164 country codes (three-digit ones by their
#: first two digits), card issuers' first digits with the lengths of their numbers, and beginnings of access tokens.
TOP_DOMAINS = frozenset("com org net edu gov mil int info biz name pro museum coop aero jobs mobi travel tel cat asia post xxx app dev io ai cloud online site shop store tech blog news email example test local".split())
COUNTRY_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98 21 22 23 24 25 26 29 35 37 38 42 50 59 67 68 69 80 85 87 88 96 97 99".split())
ISSUERS = [(4, 4, (13, 16, 19)), (34, 34, (15,)), (37, 37, (15,)), (51, 55, (16,)), (2221, 2720, (16,)), (6011, 6011, (16, 19)), (644, 659, (16, 19)), (3528, 3589, (16, 19)), (300, 305, (14,)), (36, 36, (14,)), (38, 39, (14,)), (62, 62, (16, 17, 18, 19)), (50, 50, (16, 19)), (56, 58, (16, 19)), (63, 63, (16, 19)), (67, 67, (16, 19))]
TOKEN_STARTS = ("ghp_", "gho_", "github_pat_", "glpat-", "sk-", "sk_live_", "sk_test_", "pk_live_", "rk_live_", "AKIA", "ASIA", "AIza", "xoxb-", "xoxp-", "eyJ", "hf_", "npm_", "pypi-", "SG.", "key-")
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "reply", "send", "correo", "courriel", "kontakt", "escrib", "schreib", "adress"),
    "ip": ("ip", "host", "server", "address", "login", "client", "node", "gateway", "dns", "ping", "ssh"),
    "card": ("card", "visa", "mastercard", "amex", "payment", "credit", "debit", "tarjeta", "karte", "carte", "paid", "pay"),
    "phone": ("phone", "call", "tel", "fax", "mobile", "cell", "dial", "whatsapp", "sms", "llam", "anruf", "appel", "ring"),
    "secret": ("token", "password", "passwd", "secret", "key", "credential", "auth", "bearer", "login", "clave", "passwort"),
}
AGAINST = ("version", "isbn", "issn", "order no", "invoice", "serial", "example of", "section", "page", "figure", "chapter", "release", "doi", "article", "part no", "model")
#: Distinct spans of a kind, about, that the classifier is fitted on, and places that its features are hashed to.
SAMPLE_SPANS, PLACES = 4_000, 1 << 14

CANDIDATE = "struct<kind:int,start:int,end:int,base:boolean,votes:string,features:array<int>>"
SCHEMA = f"doc_id long, found array<{CANDIDATE}>"
ARROW = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("votes", pa.string()), ("features", pa.list_(pa.int32()))]))


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of the e-mail pattern, each @ looked at once."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done
        at = text.find("@", match.end() if match else at + 1)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        n = int(c) << (k & 1)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in IP.finditer(text) if all(int(x[-4:]) <= 255 and not x[:-4].strip("0") for x in m[0].split("."))]
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def written_out(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with (at) or [at], each mark looked at once."""
    done = 0
    for mark in re.finditer(r"\(at\)|\[at\]", text):
        if mark.start() < done:
            continue
        at = mark.start() - (mark.start() > done and text[mark.start() - 1] == " ")
        start = at
        while start > done and text[start - 1] in LOCAL:
            start -= 1
        match = AT_MARK.match(text, at) if start < at else None
        if match:
            done = match.end()
            yield start, done


def loose_spans(text: str) -> Iterator[tuple[int, int, int]]:
    if "(at)" in text or "[at]" in text:
        yield from ((0, *s) for s in written_out(text))
    yield from ((4, *m.span(1)) for m in SECRET.finditer(text)) if "=" in text or ":" in text else ()
    if DIGIT.search(text):
        for m in CARD.finditer(text):
            if 13 <= sum(c.isdigit() for c in m[0]) <= 19:
                yield 2, *m.span()
        yield from ((3, *m.span()) for m in LOOSE_PHONE.finditer(text))


def issued(digits: str) -> bool:
    return any(len(digits) in sizes and low <= int(digits[: len(str(low))]) <= high for low, high, sizes in ISSUERS)


def votes(text: str, kind: int, start: int, end: int, base: bool) -> str:
    """The labelers' votes as a string of + 0 -."""
    span, digits = text[start:end], "".join(c for c in text[start:end] if c in "0123456789")
    before, after = text[max(0, start - 40) : start].lower(), text[end : end + 1]
    if kind == 0:
        top = re.split(r"[^a-z]+", span.lower())[-1]
        checksum, gazetteer = 0, 1 if top in TOP_DOMAINS or len(top) == 2 else -1
    elif kind == 1:
        parts = [int(x) for x in span.split(".")] if base else [999]
        checksum, gazetteer = 1 if max(parts) <= 255 else -1, -1 if parts[0] in (0, 127) or parts[0] >= 224 else 1
    elif kind == 2:
        checksum, gazetteer = 1 if luhn(digits) else -1, 1 if issued(digits) else -1
    elif kind == 3:
        international = span.startswith("+")
        checksum = 1 if 10 <= len(digits) <= 15 else -1
        gazetteer = (1 if digits[:1] in COUNTRY_CODES or digits[:2] in COUNTRY_CODES else -1) if international else 1 if digits[:1] not in "01" else -1
    else:
        mixed = any(c.isdigit() for c in span) and any(c.isalpha() for c in span)
        checksum, gazetteer = 1 if mixed and len(set(span)) >= 6 else -1, 1 if span.startswith(TOKEN_STARTS) or len(span) in (16, 20, 32, 40, 64) else 0
    context = 1 if any(w in before for w in CONTEXT[KINDS[kind]]) else -1 if any(w in before for w in AGAINST) else 0
    borders = -1 if (before and before[-1].isalnum()) or after.isalnum() else 1
    return "".join("-0+"[v + 1] for v in (1 if base or kind == 4 else 0, checksum, gazetteer, context, borders))


def shape(span: str) -> str:
    """Runs of digits, capitals, small letters and each other character, by one sign a run."""
    kinds = ["9" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else c for c in span]
    return "".join(k for n, k in enumerate(kinds) if not n or kinds[n - 1] != k)


def features(text: str, kind: int, start: int, end: int) -> list[int]:
    """Hashed properties of a span and of the words about it."""
    span = text[start:end]
    digits = "".join(c for c in span if c.isdigit())
    before = re.findall(r"[^\W_]+", text[max(0, start - 40) : start].lower())[-3:]
    after = re.findall(r"[^\W_]+", text[end : end + 20].lower())[:1]
    own = [
        "kind", f"shape {shape(span)[:40]}", f"long {min(len(span), 80) // 4}", f"digits {min(len(digits), 24)}", f"kinds {min(len(set(span)), 40) // 3}", f"cases {any(c.isupper() for c in span)} {any(c.islower() for c in span)} {bool(digits)}",
        f"head {span[:4].lower() if kind == 4 else digits[:2]}", f"tail {span.lower().rpartition('.')[2][:12] if kind == 0 else len(set(digits))}",
        f"left {text[start - 1 : start].isalnum()}", f"right {text[end : end + 1].isalnum()}", *(f"before {w}" for w in before), *(f"after {w}" for w in after),
    ]
    return sorted({zlib.crc32(f"{kind} {x}".encode()) % PLACES for x in own})


def candidates_of(text: str) -> list[tuple[int, int, int, bool]]:
    """(kind, start, end, base) of all base spans and of loose spans that overlap none of them."""
    base = sorted(base_spans(text))
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    out = [(*s, True) for s in base]
    for kind, a, b in sorted(loose_spans(text)):
        at = bisect_left(starts, b)  # spans that begin before b; one of them overlaps if any reaches beyond a
        if not at or reach[at - 1] <= a:
            out.append((kind, a, b, False))
    return out


def spotted(docs: DataFrame) -> DataFrame:
    """doc_id and all candidate spans with their votes and features; loose ones only where no base span is."""

    def one(text: str) -> list[dict]:
        return [{"kind": k, "start": a, "end": b, "base": own, "votes": votes(text, k, a, b, own), "features": features(text, k, a, b)} for k, a, b, own in candidates_of(text)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [one(t) if t else [] for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, ARROW)], ["doc_id", "found"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, SCHEMA)


def reliabilities(kinds: np.ndarray, ballots: np.ndarray, counts: np.ndarray, rounds: int = 50) -> np.ndarray:
    """Probability of being personal data for each row of (kind, votes, count), by EM; votes are -1, 0, 1."""
    one_hot = np.stack([ballots == v for v in (-1, 0, 1)], axis=2).astype(float)
    belief = 1 / (1 + np.exp(-ballots.sum(axis=1) + 0.5))
    for _ in range(rounds):
        new = np.empty_like(belief)
        for kind in np.unique(kinds):
            at = kinds == kind
            odds = 0.0
            for weight, sign in ((belief[at] * counts[at], 1), ((1 - belief[at]) * counts[at], -1)):
                prior = weight.sum() + 1
                # a labeler is taken to be right more often than not before any data
                seen = np.einsum("r,rlv->lv", weight, one_hot[at]) + (np.array([0.5, 1, 2]) if sign > 0 else np.array([2, 1, 0.5]))
                like = np.log(seen / seen.sum(axis=1, keepdims=True))
                odds = odds + sign * (np.log(prior) + np.einsum("rlv,lv->r", one_hot[at], like))
            new[at] = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        belief = new
    return belief


def classifier(features: list[list[int]], belief: np.ndarray, weight: np.ndarray, steps: int = 200) -> np.ndarray:
    """Weights by place of a logistic regression with the beliefs as targets, fitted on all rows at each step."""
    row, place = np.repeat(np.arange(len(features)), [len(f) for f in features]), np.array([x for f in features for x in f], np.int64)
    w, first, second = (np.zeros(PLACES) for _ in range(3))
    for step in range(1, steps + 1):
        off = weight * (chances(w, row, place, len(features)) - belief) / weight.sum()
        grad = np.bincount(place, weights=off[row], minlength=PLACES) + 1e-5 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad * grad
        w = w - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    return w


def chances(w: np.ndarray, row: np.ndarray, place: np.ndarray, n: int) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(np.bincount(row, weights=w[place], minlength=n), -30, 30)))


def beliefs(counts: DataFrame) -> dict[tuple[int, str], float]:
    """(kind, votes) -> probability of being personal data; ``counts`` has kind, votes, n."""
    rows = sorted((r["kind"], r["votes"], r["n"]) for r in counts.collect())  # at most kinds x 3^labelers rows
    if not rows:
        return {}
    ballots = np.array([["-0+".index(c) - 1 for c in r[1]] for r in rows], float)
    each = reliabilities(np.array([r[0] for r in rows]), ballots, np.array([r[2] for r in rows], float))
    return {r[:2]: float(p) for r, p in zip(rows, each, strict=True)}


def learned(candidates: DataFrame, sample: int = SAMPLE_SPANS) -> np.ndarray:
    """The classifier's weights, from votes on all candidates and about ``sample`` distinct spans a kind."""
    each = candidates.select(F.explode("found").alias("f")).groupBy("f.kind", "f.votes", "f.features").agg(F.count("*").alias("n"))
    each = stored(each)
    belief = beliefs(each.groupBy("kind", "votes").agg(F.sum("n").alias("n")))
    share = {r["kind"]: min(1.0, sample / r["count"]) for r in each.groupBy("kind").count().collect()}  # a row per kind
    if not share:
        return np.zeros(PLACES)
    part = F.coalesce(*(F.when(F.col("kind") == k, F.lit(int(p * (1 << 20)))) for k, p in share.items()))
    chosen = each.where(F.pmod(F.xxhash64("kind", "votes", "features"), F.lit(1 << 20)) < part)
    rows = sorted((r["kind"], r["votes"], r["features"], r["n"]) for r in chosen.collect())  # about ``sample`` a kind
    return classifier([r[2] for r in rows], np.array([belief[r[0], r[1]] for r in rows]), np.log1p([float(r[3]) for r in rows])) if rows else np.zeros(PLACES)


def apart(found: list[dict], chance: list[float]) -> list[tuple]:
    """Base spans, and of the loose ones that are likely those that overlap no likelier one; of equally likely ones the first stays."""
    out = [(f["kind"], f["start"], f["end"], True) for f in found if f["base"]]
    likely = sorted((-p, f["start"], f["end"], f["kind"]) for f, p in zip(found, chance, strict=True) if p >= 0.5 and not f["base"])
    taken: list[tuple[int, int]] = []
    for _, start, end, kind in likely:
        at = bisect_left(taken, (start, end))
        if (at == len(taken) or taken[at][0] >= end) and (not at or taken[at - 1][1] <= start):
            taken.insert(at, (start, end))
            out.append((kind, start, end, False))
    return sorted(out)


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (kind as a number, start, end, base), sorted by kind and start."""
    candidates = stored(spotted(docs))
    w = learned(candidates)
    kinds = pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(1).to_pylist()
            flat = [f for own in found for f in own]
            row, place = np.repeat(np.arange(len(flat)), [len(f["features"]) for f in flat]), np.array([x for f in flat for x in f["features"]], np.int64)
            chance = iter(chances(w, row, place, len(flat)).tolist())
            spans = [apart(own, [next(chance) for _ in own]) for own in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([[dict(zip(("kind", "start", "end", "base"), x, strict=True)) for x in own] for own in spans], pa.list_(kinds))], ["doc_id", "spans"])

    return candidates.select("doc_id", "found").mapInArrow(run, "doc_id long, spans array<struct<kind:int,start:int,end:int,base:boolean>>")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(table(spark, sf_dir, "documents"))
    names = F.array([F.lit(k) for k in KINDS])
    line = lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["base"])
    of = lambda k: F.size(F.filter(base, lambda s: s["kind"] == k)).cast("long")
    count = [of(k).alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *count, F.sha2(F.array_join(F.transform(base, line), ",").cast("binary"), 256).alias("base_sha256"), F.array_join(F.transform("spans", line), ",").alias("spans"))
