"""A page's elements as an array of small rows, from one parse, and what expressions can ask of them.

``parsed`` turns HTML into ``texts``, the page's text nodes in order, and
``elements``, its start tags in order.  An element knows its place (``at``), the
place of the last element inside it (``last``), the element around it (``up``)
and the range of text nodes inside it (``t0`` to ``t1``, the end excluded), so
the elements inside an element, and its text, are slices of the two arrays.

Cells, rows and list items end where the next one begins, as in browsers, and an
end tag closes nothing outside the cell or table that it stands in; scripts and
style sheets have no text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Elements without an end, elements whose content is no markup, and what ends an open element of the same kind (up to where).
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = {"script": None, "style": None, "textarea": "text", "title": "text"}
ENDS = {"td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "li": ({"li"}, {"ul", "ol", "table"}), "p": ({"p"}, {"div", "td", "li", "table", "body", "article", "section", "main"})}
SCOPE, ROWS = frozenset(("td", "th", "table")), frozenset(("td", "th", "tr", "tbody", "thead"))
_MARK = re.compile(r"<(?:(/?)([a-zA-Z][a-zA-Z0-9:_-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+|[^>]*+)>|!--.*?(?:-->|\Z)|[!?][^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

INTS, STRINGS = ("at", "last", "up", "t0", "t1"), ("tag", "class", "id", "ref", "label")
#: Tags that are remembered by their text, beyond which it begins anew, and the length of such a text; attributes whose quotes are closed.
KNOWN_TAGS, LONGEST = 4096, 200
_QUOTED = re.compile(r"(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+")
_ELEMENT = pa.struct([*((c, pa.int32()) for c in INTS), *((c, pa.string()) for c in STRINGS)])
PAGE = T.StructType([
    T.StructField("texts", T.ArrayType(T.StringType())),
    T.StructField("elements", T.ArrayType(T.StructType([*(T.StructField(c, T.IntegerType()) for c in INTS), *(T.StructField(c, T.StringType()) for c in STRINGS)]))),
])


def _find(stack: list[tuple[str, int]], kinds: set | frozenset, stops: set | frozenset) -> int:
    """Place of the innermost open element of ``kinds`` that no open element of ``stops`` shuts off, else -1."""
    for k in range(len(stack) - 1, -1, -1):
        if stack[k][0] in kinds:
            return k
        if stack[k][0] in stops:
            break
    return -1


def _start_tag(tag: str, attributes: str) -> tuple:
    """tag, class, id, ref, label of a start tag, what it ends, and whether it stays open."""
    strings = (tag, None, None, None, None)
    if attributes:
        given = {n.lower(): a or b or c for n, a, b, c in _ATTRIBUTE.findall(attributes)}
        if "&" in attributes:
            given = {n: unescape(v) for n, v in given.items()}
        get = given.get
        strings = (tag, get("class"), get("id"), get("content"), " ".join(filter(None, (get("name"), get("property"))))) if tag == "meta" else (tag, get("class"), get("id"), get("href"), get("title"))
    return strings, ENDS.get(tag), not (tag in VOID or attributes.endswith("/"))


class _Pages:
    """Texts and elements of the pages of a batch."""

    def __init__(self) -> None:
        self.texts: list[str] = []
        self.text_cuts, self.cuts = [0], [0]
        #: tag, class, id, ref, label of each start tag, one tuple for all that are alike; last and t1 are known when it ends
        self.starts: list[tuple] = []
        self.up: list[int] = []
        self.t0: list[int] = []
        self.last: list[int] = []
        self.t1: list[int] = []
        #: by text: tag, None, None of an end tag, else what _start_tag gives
        self.known: dict[str, tuple] = {}

    def close(self, stack: list[tuple[str, int]], k: int) -> None:
        """End all from the k-th open element on."""
        last, t1 = len(self.starts) - self.cuts[-1] - 1, len(self.texts) - self.text_cuts[-1]
        for _, own in stack[k:]:
            self.last[self.cuts[-1] + own], self.t1[self.cuts[-1] + own] = last, t1
        del stack[k:]

    def text(self, data: str) -> None:
        data = (unescape(data) if "&" in data else data).strip()
        if data:
            self.texts.append(data)

    def add(self, html: str) -> None:
        starts, ups, t0s, lasts, t1s, texts, known = self.starts, self.up, self.t0, self.last, self.t1, self.texts, self.known
        base, first = self.cuts[-1], self.text_cuts[-1]
        stack: list[tuple[str, int]] = []
        # where text begins that is not taken yet, where to look for the next mark, and the next > seen
        pos, at, stop, size = 0, 0, -1, len(html)
        find, match = html.find, _MARK.match
        while (begin := find("<", at)) >= 0:
            if stop < begin and (stop := find(">", begin)) < 0:
                stop = size
            # pages repeat their tags: those are known by what stands up to the next >
            found, after = known.get(html[begin + 1 : stop]) if stop - begin < LONGEST and stop < size else None, stop + 1
            if found is None:
                if not (mark := match(html, begin)):
                    at = begin + 1
                    continue
                after = mark.end()
                end, tag, attributes = mark.groups()
                if tag is not None:
                    found = (tag.lower(), None, None) if end else _start_tag(tag.lower(), attributes)
                    if after == stop + 1 and stop - begin < LONGEST and _QUOTED.fullmatch(attributes):
                        if len(known) >= KNOWN_TAGS:
                            known.clear()
                        known[html[begin + 1 : stop]] = found
            if begin > pos:
                data = html[pos:begin]
                if data := (unescape(data) if "&" in data else data).strip():
                    texts.append(data)
            pos = at = after
            if found is None:
                continue
            strings, ends, opens = found
            if opens is None:
                tag = strings
                if stack and stack[-1][0] == tag:  # the common case of close
                    own = base + stack.pop()[1]
                    lasts[own], t1s[own] = len(starts) - base - 1, len(texts) - first
                elif (k := _find(stack, {tag}, {"table"} if tag in ROWS else SCOPE if tag != "table" else frozenset())) >= 0:
                    self.close(stack, k)
                continue
            tag = strings[0]
            if ends and stack and stack[-1][0] not in ends[1] and (k := _find(stack, *ends)) >= 0:
                self.close(stack, k)
            own, n_texts = len(starts) - base, len(texts) - first
            lasts.append(own)
            t1s.append(n_texts)
            ups.append(stack[-1][1] if stack else -1)
            t0s.append(n_texts)
            starts.append(strings)
            if not opens:
                continue
            stack.append((tag, own))
            if tag in RAW:
                found = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
                stop = found.start() if found else size
                if RAW[tag]:
                    self.text(html[pos:stop])
                pos = at = found.end() if found else size
                self.close(stack, len(stack) - 1)
        self.text(html[pos:])
        self.close(stack, 0)
        self.text_cuts.append(len(self.texts))
        self.cuts.append(len(starts))

    def arrays(self) -> pa.StructArray:
        strings = zip(*self.starts, strict=True) if self.starts else [()] * 5
        cuts = np.array(self.cuts)
        at = np.arange(len(self.starts)) - np.repeat(cuts[:-1], np.diff(cuts))
        ints = [at, self.last, self.up, self.t0, self.t1]
        elements = pa.StructArray.from_arrays([*(pa.array(x, pa.int32()) for x in ints), *(pa.array(x, pa.string()) for x in strings)], fields=list(_ELEMENT))
        lists = [pa.ListArray.from_arrays(pa.array(self.text_cuts, pa.int32()), pa.array(self.texts, pa.string())), pa.ListArray.from_arrays(pa.array(self.cuts, pa.int32()), elements)]
        return pa.StructArray.from_arrays(lists, ["texts", "elements"])


@F.arrow_udf(PAGE)
def parsed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """The page as ``texts`` and ``elements``; a null page has none."""
    for batch in batches:
        out = _Pages()
        for page in batch:
            out.add(page.as_py() or "")
        yield out.arrays()


def classes(e: Column) -> Column:
    return F.split(F.coalesce(e["class"], F.lit("")), r"\s+")


def has_class(e: Column, *names: str) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & F.array_contains(classes(e), n)
    return test


def first(elements: Column, test) -> Column:  # noqa: ANN001
    """The first of ``elements`` for which ``test`` holds, else NULL."""
    return F.get(F.filter(elements, test), 0)


def inside(page: Column, e: Column) -> Column:
    """The elements inside ``e``."""
    return F.coalesce(F.slice(page["elements"], e["at"] + 2, e["last"] - e["at"]), F.slice(page["elements"], 1, 0))


def text(page: Column, e: Column, between: str = "") -> Column:
    """The text nodes inside ``e``, each stripped, strung together; NULL without an element."""
    return F.array_join(F.slice(page["texts"], e["t0"] + 1, e["t1"] - e["t0"]), between)
