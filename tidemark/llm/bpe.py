"""Byte-level BPE as the ``tokenizers`` library applies it, cut into units that no context reaches.

A unit is a run of white space with the run of other characters after it.  The
library's splitting pattern always has a border where white space begins, and
what it does inside a unit depends on that unit alone, so ids and counts of a
text are those of its units in order.  Workers look at the distinct units of
many texts at once, keep those they have met, and learn new ones together.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The characters with Unicode's White_Space property.
WHITE = "".join(map(chr, [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
UNIT = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
LEAD = re.compile(f"[{WHITE}]*")
WHITE_SET = frozenset(WHITE)
ASCII_WHITE = np.isin(np.arange(256), [ord(c) for c in WHITE if c.isascii()])
#: The last byte but one, and the last, of the UTF-8 form of other white space.
LAST_BYTES = [np.array(sorted({c.encode()[k] for c in WHITE if not c.isascii()}), np.uint8) for k in (-2, -1)]
#: Most units: a line break or nothing, a word with at most one space before it, and marks after it: a piece each.
PLAIN = re.compile(r"(\n?)((?:(?<!\n) )?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
#: Bytes of units that a worker keeps; when there are more, it goes on with those of the texts at hand.
KEPT_BYTES = 24 << 20
#: Text bytes whose units are looked up together.
SLICE_BYTES = 4 << 20
#: Words of up to so many bytes have their prefixes counted many at a time.
SHORT = 40


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_of_char() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies write for the 256 bytes."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabulary:
    """The library's tokenizer, its tokens as bytes, and its merges."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.special = {t.content: n for n, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1

    @cached_property
    def spec(self) -> tuple[dict[bytes, int], dict[tuple[int, int], tuple[int, int]]]:
        """Ids by token bytes, and (left, right) -> (rank, merged); read when prefixes are counted."""
        with open(self.path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        back, vocab = byte_of_char(), model["vocab"]
        pairs = (m.split(" ") if isinstance(m, str) else m for m in model["merges"])
        return {bytes(back[c] for c in token): n for token, n in vocab.items()}, {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(pairs)}

    @property
    def ids(self) -> dict[bytes, int]:
        return self.spec[0]

    @property
    def merges(self) -> dict[tuple[int, int], tuple[int, int]]:
        return self.spec[1]

    @cached_property
    def bytes(self) -> dict[int, bytes]:
        return {n: b for b, n in self.ids.items()}

    def widths(self) -> np.ndarray:
        """Bytes of text behind each id."""
        out = np.zeros(self.size, np.int64)
        for token, n in self.tokenizer.get_vocab(with_added_tokens=False).items():
            out[n] = len(token)  # one stand-in a byte
        for n, token in self.tokenizer.get_added_tokens_decoder().items():
            if token.lstrip or token.rstrip or token.single_word or not WHITE_SET.isdisjoint(token.content):
                raise ValueError(f"{token.content!r} reaches beyond its own bytes")
            out[n] = len(token.content.encode())
        return out

    @cached_property
    def longest(self) -> int:
        return max(map(len, self.ids))

    def merged(self, data: bytes) -> list[int]:
        """Ids of a short byte string by the merges alone."""
        ids = [self.ids[data[k : k + 1]] for k in range(len(data))]
        while len(ids) > 1:
            found = [(m[0], k, m[1]) for k in range(len(ids) - 1) if (m := self.merges.get((ids[k], ids[k + 1])))]
            if not found:
                break
            _, k, new = min(found)
            ids[k : k + 2] = [new]
        return ids


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """One per worker process, for all its tasks."""
    return Vocabulary(path)


def ends_white(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space."""
    out = ASCII_WHITE[data[ends - 1]]
    wide = np.flatnonzero(data[ends - 1] >= 0x80)
    maybe = np.isin(data[ends[wide] - 2], LAST_BYTES[0]) & np.isin(data[ends[wide] - 1], LAST_BYTES[1])
    for k in wide[maybe].tolist():
        out[k] = data[max(0, ends[k] - 3) : ends[k]].tobytes().decode("utf-8", "ignore")[-1:] in WHITE_SET
    return out


def unit_starts(data: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Where texts (``cuts`` has their ends too) begin, and ASCII white space after a character that is none."""
    white = ASCII_WHITE[data]
    start = white.copy()
    start[1:] &= ~white[:-1]
    start[:1] = True
    at = np.flatnonzero(start)
    odd = at[1:][data[at[1:] - 1] >= 0x80]
    start[odd] = ~ends_white(data, odd)
    start[cuts[:-1][np.diff(cuts) > 0]] = True
    return np.flatnonzero(start)


class Units:
    """A run of numbers for each unit, kept for those met before; units and numbers lie in flat arrays.

    ``learn`` gives the numbers of new units: (how many for each, all in order).
    A unit here begins with ASCII white space or a text, so it may hold several of ``UNIT``.
    """

    kind: np.dtype

    def __init__(self) -> None:
        self.known, self.cuts = pa.array([], pa.binary()), np.zeros(1, np.int64)
        self.flat = np.zeros(0, self.kind)

    def learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raise NotImplementedError

    def gathered(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(how many numbers for each place, all in order) of the units kept at these places."""
        n = self.cuts[at + 1] - self.cuts[at]
        ends = np.cumsum(n)
        return n, self.flat[np.repeat(self.cuts[at] - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(numbers of all texts in order, where each text's begin and the last one's end); a null text has none."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        cuts = offsets - offsets[0]
        if not cuts[-1]:
            return np.zeros(0, self.kind), np.zeros(len(texts) + 1, np.int64)
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
        starts = unit_starts(data, cuts)
        edges = np.append(starts, len(data))
        coded = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(data)]).dictionary_encode()
        units = coded.dictionary
        found = pc.index_in(units, self.known)
        lacking = np.asarray(pc.is_null(found))
        place = np.asarray(pc.fill_null(found, 0)).astype(np.int64)
        if lacking.any():
            if self.known.nbytes > KEPT_BYTES:  # go on with the units of these texts alone
                n, self.flat = self.gathered(place[~lacking])
                self.known, self.cuts = units.filter(pa.array(~lacking)), np.append(0, np.cumsum(n))
                place[~lacking] = np.arange(len(n))
            new = units.filter(pa.array(lacking))
            place[lacking] = len(self.known) + np.arange(len(new))
            n, flat = self.learn(new)
            self.known = pa.concat_arrays([self.known, new])
            self.cuts, self.flat = np.append(self.cuts, self.cuts[-1] + np.cumsum(n)), np.append(self.flat, flat)
        n, flat = self.gathered(place[np.asarray(coded.indices)])
        return flat, np.append(0, np.cumsum(n))[np.searchsorted(starts, cuts)]


class UnitIds(Units):
    """Ids by the library: new units are strung together by the few hundred, so many strings to a call, and told apart by their bytes."""

    TOGETHER, CALLS = 300, 50

    def __init__(self, path: str):
        self.vocabulary = vocabulary(path)
        self.kind = np.dtype("<u2") if self.vocabulary.size <= 1 << 16 else np.dtype("<u4")
        self.width = self.vocabulary.widths()
        super().__init__()

    def learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        edges = np.frombuffer(units.buffers()[1], np.int32)[units.offset : units.offset + len(units) + 1].astype(np.int64)
        data = np.frombuffer(units.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        edges = edges - edges[0]
        # a unit can stand behind another if white space begins there, as it does in a text
        alone = ~ASCII_WHITE[data[edges[:-1]]]
        alone[1:] |= ends_white(data, edges[1:-1])
        alone[:: self.TOGETHER] = True
        cuts = np.append(edges[:-1][alone], edges[-1]).tolist()
        parts, raw = [], data.tobytes()
        for low in range(0, len(cuts) - 1, self.CALLS):  # what the library holds for each token is freed on the way
            own = cuts[low : low + self.CALLS + 1]
            found = self.vocabulary.tokenizer.encode_batch_fast([raw[a:b].decode() for a, b in zip(own, own[1:], strict=False)], add_special_tokens=False)
            parts += [np.array(f.ids, self.kind) for f in found]
        ids = np.concatenate(parts)
        ends = np.cumsum(self.width[ids])
        last = np.searchsorted(ends, edges[1:])
        if last[-1] != len(ids) - 1 or (ends[last] != edges[1:]).any():
            raise ValueError("ids do not spell the units they came from")
        return np.diff(last, prepend=-1), ids


class Slots:
    """A numpy hash table: 64-bit key -> int32, -1 where absent."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - max(10, int(len(keys) * 8).bit_length()))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.zeros(size, np.uint64), np.full(size, -1, np.int32)
        self.probes, at, left = 0, self.slot(keys), np.arange(len(keys))
        while len(left):
            self.probes += 1
            free = left[self.values[at[left]] < 0]
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self.keys[at[put]], self.values[at[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            at[left] = (at[left] + 1) % size

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        at = self.slot(keys)
        out = np.where(self.keys[at] == keys, self.values[at], np.int32(-1))
        left = np.flatnonzero((out < 0) & (self.values[at] >= 0))
        for _ in range(self.probes - 1):
            if not len(left):
                break
            at[left] = (at[left] + 1) % len(self.keys)
            hit = self.keys[at[left]] == keys[left]
            out[left[hit]] = self.values[at[left[hit]]]
            left = left[~hit & (self.values[at[left]] >= 0)]
        return out


class PrefixTable:
    """Token counts of all byte prefixes of many short words at once.

    The encoding of a prefix is that of a shorter prefix and one token that may
    stand right after that one's last token; just one token qualifies, so the
    table fills from left to right with one look at each possible last token.
    """

    BASE = np.uint64(0x100000001B3)

    def __init__(self, vocabulary: Vocabulary):
        v, size = vocabulary, vocabulary.size
        self.never = np.int32(1 << 30)
        self.rank, self.left, self.right = np.full(size, -1, np.int32), np.zeros(size, np.int32), np.zeros(size, np.int32)
        made = np.array([(a, b, rank, new) for (a, b), (rank, new) in v.merges.items()], np.int64)
        self.rank[made[:, 3]], self.left[made[:, 3]], self.right[made[:, 3]] = made[:, 2], made[:, 0], made[:, 1]
        self.pairs = Slots(self.pair(made[:, 0], made[:, 1]), made[:, 2].astype(np.int32))
        short = [(b, n) for b, n in v.ids.items() if len(b) <= SHORT]
        self.longest = max(len(b) for b, _ in short)
        ids = np.array([n for _, n in short], np.int32)
        keys = self.hashes([b for b, _ in short])
        ends = np.array([len(b) for b, _ in short])
        self.tokens = Slots(keys[np.arange(len(short)), ends], ids)
        own = self.rank[made[:, 3]]
        self.usable = self.rank < 0  # a merge that never completes on its token's own bytes makes the token unusable
        self.usable[made[:, 3]] = self.apart(made[:, 0].astype(np.int32), made[:, 1].astype(np.int32), own)

    @staticmethod
    def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a.astype(np.uint64) << np.uint64(24)) | b.astype(np.uint64) + np.uint64(1)

    def hashes(self, words: list[bytes]) -> np.ndarray:
        """Polynomial hashes of each word's prefixes; column k is for k bytes."""
        lengths = np.array([len(w) for w in words])
        most = int(lengths.max())
        flat = np.frombuffer(b"".join(w.ljust(most, b"\0") for w in words), np.uint8).reshape(len(words), most)
        out = np.zeros((len(words), most + 1), np.uint64)
        for k in range(most):
            out[:, k + 1] = out[:, k] * self.BASE + flat[:, k] + np.uint64(1)
        return out

    def apart(self, a: np.ndarray, b: np.ndarray, until: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge (before rank ``until``) joins bytes of a with bytes of b when both stand side by side.

        Goes back in time: of the two symbols at the border the one that was
        made last is taken apart, and a merge of the two symbols counts if it
        comes before either is used up by its own token.
        """
        good = np.ones(len(a), bool)
        at = np.arange(len(a))
        x, y = a.astype(np.int32), b.astype(np.int32)
        used_x = np.full(len(a), self.never) if until is None else until.astype(np.int32)
        used_y = used_x - 1 if until is not None else used_x
        while len(at):
            rank = self.pairs.get(self.pair(x, y))
            joins = (rank >= 0) & (rank < used_x) & (rank <= used_y)
            good[at[joins]] = False
            rx, ry = self.rank[x], self.rank[y]
            on = ~joins & ((rx >= 0) | (ry >= 0))
            at, x, y, used_x, used_y, rx, ry = at[on], x[on], y[on], used_x[on], used_y[on], rx[on], ry[on]
            take = rx > ry
            used_x, used_y = np.where(take, rx, used_x), np.where(take, used_y, ry)
            x, y = np.where(take, self.right[x], x), np.where(take, y, self.left[y])
        return good

    def counts(self, words: list[bytes]) -> np.ndarray:
        """Row per word, longest first; column k: tokens of its first k + 1 bytes (beyond the word: junk)."""
        lengths = np.array([len(w) for w in words])
        hashed = np.ascontiguousarray(self.hashes(words).T)
        most = len(hashed) - 1
        last, count = np.full((most + 1, len(words)), -1, np.int32), np.zeros((most + 1, len(words)), np.int16)
        power = np.cumprod(np.full(self.longest + 1, self.BASE))
        active = np.searchsorted(-lengths, -np.arange(most + 1), side="right")
        for end in range(1, most + 1):
            rows = np.arange(active[end])
            for size in range(min(end, self.longest), 0, -1):
                if not len(rows):
                    break
                start = end - size
                token = self.tokens.get(hashed[end][rows] - hashed[start][rows] * power[size - 1])
                maybe = np.flatnonzero(token >= 0)
                maybe = maybe[self.usable[token[maybe]]]
                if start:
                    maybe = maybe[self.apart(last[start][rows[maybe]], token[maybe])]
                last[end, rows[maybe]], count[end, rows[maybe]] = token[maybe], count[start, rows[maybe]] + 1
                rows = np.delete(rows, maybe)
        return count[1:].T


class UnitCounts(Units):
    """What each code point of a unit adds to the token count."""

    kind = np.dtype("<i2")

    def __init__(self, path: str):
        super().__init__()
        self.vocabulary = vocabulary(path)
        self.split = self.vocabulary.tokenizer.pre_tokenizer.pre_tokenize_str
        self.table = PrefixTable(self.vocabulary)
        self.marks: dict[str, bytes] = {"": b""}
        self.fits: dict[tuple[int, int], bool] = {}
        if any((m := PLAIN.search(s)) and m[0] == s for s in self.vocabulary.special):
            raise ValueError("a special token that looks like a word")

    def follows(self, before: int, token: int) -> bool:
        data = self.vocabulary.bytes
        want, text = ([token], data[token]) if before < 0 else ([before, token], data[before] + data[token])
        return self.vocabulary.merged(text) == want

    def prefixes(self, data: bytes) -> list[int]:
        """Token counts of data[:1], data[:2], ..., as PrefixTable has them, for one string of any length."""
        ids, longest, fits = self.vocabulary.ids, self.vocabulary.longest, self.fits
        last, count = [-1], [0]
        for end in range(1, len(data) + 1):
            for start in range(end - longest if end > longest else 0, end):
                token = ids.get(data[start:end])
                if token is None:
                    continue
                good = fits.get(key := (last[start], token))
                if good is None:
                    if len(fits) > 200_000:
                        fits.clear()
                    good = fits[key] = self.follows(*key)
                if good:
                    last.append(token)
                    count.append(count[start] + 1)
                    break
        return count[1:]

    def per_char(self, piece: str) -> list[int]:
        if piece in ("'re", "'ve", "'ll"):  # cut after two characters, the splitting pattern sees two pieces
            return [1, 2, self.prefixes(piece.encode())[-1]]
        count = self.prefixes(piece.encode())
        if len(count) == len(piece):
            return count
        ends = np.cumsum([len(c.encode()) for c in piece]) - 1
        return [count[k] for k in ends]

    def counts(self, unit: str) -> list[int]:
        out, base = [], 0
        while found := min(((unit.find(s), s) for s in self.vocabulary.special if s in unit), default=None):
            head, special = found
            own = self.plain_counts(unit[:head] + special[:-1])
            out += [base + n for n in own]
            base += (own[head - 1] if head else 0) + 1
            out.append(base)
            unit = unit[head + len(special) :]
        return out + [base + n for n in self.plain_counts(unit)] if unit else out

    def plain_counts(self, unit: str) -> list[int]:
        """Counts of a unit's prefixes without special strings."""
        white = LEAD.match(unit).end()
        pieces = [span for _, span in self.split(unit)]
        if white < 2:
            out, base = [], 0
            for low, high in pieces:
                out += [base + n for n in self.per_char(unit[low:high])]
                base = out[-1]
            return out
        out, base = self.per_char(unit[:white]), 0  # a prefix that ends in white space has it as one piece
        for low, high in pieces:
            own = self.per_char(unit[low:high])
            if high > white:
                out += [base + n for n in own[max(0, white - low) :]]
            base += own[-1]
        return out

    def alone(self, unit: str) -> bytes:
        return np.diff(np.array(self.counts(unit), np.int32), prepend=0).astype("<i2").tobytes()

    #: Units taken apart at once; bounds what Python holds.
    TOGETHER = 50_000

    def learn(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        each = [self.learn_some(units.slice(low, self.TOGETHER)) for low in range(0, len(units), self.TOGETHER)]
        return np.concatenate([n for n, _ in each]), np.concatenate([flat for _, flat in each])

    def learn_some(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        parts = [UNIT.findall(u) for u in units.cast(pa.string()).to_pylist()]
        known: dict[str, bytes] = {}
        plain, words = {}, set()
        for unit in set().union(*parts):
            found = PLAIN.fullmatch(unit)
            if found and len(found[2]) * 2 <= SHORT:
                plain[unit] = found
                words.add(found[2])
            else:
                known[unit] = self.alone(unit)
        steps = self.steps_of([w.encode() for w in words]) if words else {}
        for unit, found in plain.items():
            known[unit] = self.mark(found[1]) + steps[found[2].encode()] + self.mark(found[3])
        each = [b"".join(map(known.__getitem__, p)) for p in parts]
        return np.array([len(x) // 2 for x in each], np.int64), np.frombuffer(b"".join(each), self.kind)

    def mark(self, text: str) -> bytes:
        if text not in self.marks:
            if len(self.marks) > 10_000:
                self.marks = {"": b""}
            self.marks[text] = self.alone(text)
        return self.marks[text]

    def steps_of(self, words: list[bytes]) -> dict[bytes, bytes]:
        words = sorted(words, key=len, reverse=True)
        lengths = np.array([len(w) for w in words])
        counts = self.table.counts(words)
        flat = np.frombuffer(b"".join(words), np.uint8)
        # a code point ends where the next byte is no continuation byte
        ends = np.append((flat[1:] & 0xC0) != 0x80, True)
        value = counts[np.arange(counts.shape[1])[None, :] < lengths[:, None]][ends].astype(np.int32)
        last = np.cumsum(lengths) - 1
        place = np.cumsum(ends)[last]  # code points up to each word's end
        step = np.diff(value, prepend=0)
        step[np.append(0, place[:-1])] = value[np.append(0, place[:-1])]
        data = step.astype("<i2").tobytes()
        cuts = np.append(0, place * 2).tolist()
        return {w: data[a:b] for w, a, b in zip(words, cuts, cuts[1:], strict=False)}


@lru_cache(maxsize=2)
def unit_ids(path: str) -> UnitIds:
    """One per worker process, for all its tasks."""
    return UnitIds(path)


@lru_cache(maxsize=2)
def unit_counts(path: str) -> UnitCounts:
    return UnitCounts(path)
