"""Scores of all pairs of queries and chunks, made again in each pass over a table of one small row a chunk.

No pair is written. A pass keeps bounded sums of its scores (counts by query
and score, maxima), from which the next ones know between which ranks a pair
lies; only pairs that may be among the best are named, and their ranks counted.
All scores come of whole numbers or of sums in a fixed order, so that they are
the same in each pass.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from vellichor.functions import text as X
from vellichor.functions import vectors as V
from vellichor.operators.lexical import K1, B

#: Pairs that are scored at once. Fixed value.
PAIRS = 262_144
#: Scores are counted in 32 steps a power of two, from 2^-40 to 2^20.
STEP, LOWEST, BINS = 47, (1023 - 40) << 5, 60 * 32
#: All weights of features are multiples of it.
HASHED = 5
#: Rounding of the last scores can't make up for more.
MARGIN = 2e-4
SETS = ("lexical", "vector", "graph")
FIGURE_WORDS = ("figure", "fig", "image", "chart", "plot", "graph")
TABLE_WORDS = ("table", "data", "unit", "value", "mpa", "mj")
LISTS = ("tf", "low", "heading", "title", "label", "word", "near")
FEATURES = "key string, doc_id string, length int, times array<int>, " + ", ".join(f"{x} array<int>" for x in LISTS) + ", flagged boolean, defects int, figures boolean, tables boolean, vector binary"

_STOP = frozenset(X.STOP_WORDS)
_WORD = re.compile(X.WORD)


class Finder:
    """Which of many strings occur in texts, inside words too: by their first four bytes, then byte by byte."""

    def __init__(self, strings: list[str]):
        raw = [s.encode() for s in strings]
        self.short = [(k, np.frombuffer(b, np.uint8)) for k, b in enumerate(raw) if 0 < len(b) < 4]
        self.empty = [k for k, b in enumerate(raw) if not b]
        rest = [k for k, b in enumerate(raw) if len(b) >= 4]
        self.width = max((len(raw[k]) for k in rest), default=4)
        code = np.array([int.from_bytes(raw[k][:4], "little") for k in rest], np.uint32)
        order = np.argsort(code, kind="stable")
        self.of = np.array(rest, np.int64)[order]
        self.codes, self.first = np.unique(code[order], return_index=True)
        self.ends = np.append(self.first[1:], len(rest)).astype(np.int64)
        self.sizes = np.array([len(raw[k]) for k in self.of], np.int64)
        self.bytes = np.zeros((len(rest), self.width), np.uint8)
        for r, k in enumerate(self.of):
            self.bytes[r, : len(raw[k])] = np.frombuffer(raw[k], np.uint8)
        # the eight bytes after the first four are compared at once
        padded = np.zeros((len(rest), 12), np.uint8)
        padded[:, : min(12, self.width)] = self.bytes[:, :12]
        self.next = np.ascontiguousarray(padded[:, 4:]).view("<u8").ravel()
        inside = np.arange(4, 12)[None, :] < self.sizes[:, None]
        self.mask = np.ascontiguousarray(np.where(inside, 255, 0).astype(np.uint8)).view("<u8").ravel()
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self._slot(self.codes)] = True
        self.total = len(strings)

    @staticmethod
    def _slot(code: np.ndarray) -> np.ndarray:
        return (code * np.uint32(2654435761)) >> np.uint32(12)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row, string) of what each text holds, once each, ascending."""
        texts = texts.cast(pa.large_string())
        n = len(texts)
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + n + 1]
        data = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
        ends = offsets[1:] - offsets[0]
        found = [np.add.outer(np.arange(n) * self.total, np.array(self.empty, np.int64)).ravel()]

        def add(at: np.ndarray, string: np.ndarray | int, size: np.ndarray | int) -> None:
            row = np.searchsorted(ends, at, side="right")
            ok = at + size <= ends[np.minimum(row, n - 1)] if n else np.zeros(0, bool)
            found.append((row * self.total + string)[ok])

        for k, b in self.short:
            hit = data[: len(data) - len(b) + 1] == b[0]
            for j in range(1, len(b)):
                hit = hit & (data[j : len(data) - len(b) + 1 + j] == b[j])
            add(np.flatnonzero(hit), k, len(b))
        if len(self.codes) and len(data) >= 4:
            held = data.tobytes() + bytes(16)
            code = np.ndarray(len(data) - 3, "<u4", held, strides=(1,))
            after = np.ndarray(len(data) + 1, "<u8", held, strides=(1,), offset=4)
            at = np.flatnonzero(self.maybe[self._slot(code)])
            group = np.minimum(np.searchsorted(self.codes, code[at]), len(self.codes) - 1)
            same = self.codes[group] == code[at]
            at, group = at[same], group[same]
            many = self.ends[group] - self.first[group]
            start = np.repeat(self.first[group] - (np.cumsum(many) - many), many)
            string, at = start + np.arange(len(start)), np.repeat(at, many)
            ok = (after[at] & self.mask[string]) == self.next[string]
            string, at = string[ok], at[ok]
            ok = at + self.sizes[string] <= len(data)
            string, at = string[ok], at[ok]
            for j in range(12, self.width):
                longer = self.sizes[string] > j
                if not longer.any():
                    break
                keep = ~longer
                keep[longer] = data[at[longer] + j] == self.bytes[string[longer], j]
                string, at = string[keep], at[keep]
            add(at, self.of[string], self.sizes[string])
        u = np.unique(np.concatenate(found))
        return u // max(self.total, 1), u % max(self.total, 1)


class Hits:
    """Queries that a label answers: it shares a word with them, holds one of their longer words or lies within one."""

    #: Parts of longer words are not listed.
    LISTED = 48
    MOST = 100_000
    SPACE = re.compile("[\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+")
    ODD = re.compile(f"{X.HEX_RUN}|[a-z]{{5,}}of[a-z]{{5,}}")

    def __init__(self, seeds: list[tuple[int, str]]):
        """``seeds``: number of a query and a word of it."""
        self.words: dict[str, set[int]] = {}
        for q, w in seeds:
            self.words.setdefault(w, set()).add(q)
        self.long = sorted(w for w in self.words if len(w) > 3)
        self.find = Finder(self.long)
        self.parts: dict[str, set[int]] = {}
        for w in self.long:
            if len(w) <= self.LISTED:
                for k in range(len(w)):
                    for end in range(k + 3, len(w) + 1):
                        self.parts.setdefault(w[k:end], set()).update(self.words[w])
        self.rest = [w for w in self.long if len(w) > self.LISTED]
        self.known: dict[str, np.ndarray] = {}

    @classmethod
    def useful(cls, t: str) -> bool:
        """As ``text.expansion_term_is_useful`` of a label in lower case without blanks at its ends."""
        if len(t) < 3 or t in X.SECTION_WORDS or "pymupdf4llm" in t or t.endswith(" auto") or cls.ODD.search(t) or (" " not in t and len(t) > 18):
            return False
        letters = sum("a" <= c <= "z" or "A" <= c <= "Z" for c in t)
        if letters < 28:
            return True
        words = [w for w in cls.SPACE.split(t) if w]
        return not ((len(words) <= 2 and letters > 35) or (max(map(len, words), default=0) > 34 and len(words) <= 4))

    def __call__(self, labels: list[str]) -> list[np.ndarray]:
        """The queries of each label, ascending. Labels are in lower case without blanks at their ends, each once."""
        new = [t for t in labels if t not in self.known]
        if new:
            if len(self.known) + len(new) > self.MOST:
                self.known, new = {}, labels
            held: dict[int, set[int]] = {}
            for row, k in zip(*(x.tolist() for x in self.find(pa.array(new, pa.string()))), strict=True):
                held.setdefault(row, set()).update(self.words[self.long[k]])
            for row, t in enumerate(new):
                got = set()
                if self.useful(t):
                    got |= held.get(row, set()) | self.parts.get(t, set())
                    for w in _WORD.findall(t):
                        if w.lower() not in _STOP:
                            got |= self.words.get(w.lower().strip("_+-"), set())
                    for w in self.rest:
                        if t in w:
                            got |= self.words[w]
                self.known[t] = np.array(sorted(got), np.int64)
        return [self.known[t] for t in labels]


#: What ``near_labels`` returns.
NEAR_LABELS = "q int, label string, s long"


def near_labels(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of rows (label, names): how many names answer a query, by query and label. ``shared``: seeds of ``Hits``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits = Hits(shared.value)
        queries = 1 + max((q for q, _ in shared.value), default=0)
        for p in batches:
            names = p["names"].flatten().dictionary_encode()
            of = hits(names.dictionary.to_pylist())
            size = np.array([len(x) for x in of], np.int64)
            code = names.indices.to_numpy(zero_copy_only=False)
            # null labels are one group, after the others
            label = p["label"].dictionary_encode()
            own = label.indices.fill_null(len(label.dictionary)).to_numpy(zero_copy_only=False).astype(np.int64)
            own = np.repeat(own, pc.list_value_length(p["names"]).fill_null(0).to_numpy(zero_copy_only=False))
            many = size[code] if len(code) else np.zeros(0, np.int64)
            if not many.sum():
                continue
            flat = np.concatenate(of)
            first = np.cumsum(size) - size
            at = np.arange(many.sum()) + np.repeat(first[code] - (np.cumsum(many) - many), many)
            u, n = np.unique(np.repeat(own, many) * queries + flat[at], return_counts=True)
            which = u // queries
            which = pa.array(which, mask=which == len(label.dictionary))
            yield pa.RecordBatch.from_arrays([pa.array(u % queries, pa.int32()), label.dictionary.take(which), pa.array(n, pa.int64())], names=["q", "label", "s"])

    return run


def _lowered(a: pa.Array) -> pa.Array:
    if pc.all(pc.string_is_ascii(a)).as_py():
        return pc.ascii_lower(a)
    return pa.array([x.lower() for x in a.to_pylist()], pa.string())


def near_strings(shared) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of edges (source, target): (node, t), which of the strings occur within the id of the other end, once each a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, strings = Finder(shared.value), pa.array(shared.value, pa.string())
        for p in batches:
            for node, other in ((p["source"], p["target"]), (p["target"], p["source"])):
                known = pc.and_(node.is_valid(), other.is_valid())
                node, other = node.filter(known), other.filter(known).dictionary_encode()
                row, k = find(_lowered(other.dictionary))
                if not len(row):
                    continue
                many = np.bincount(row, minlength=len(other.dictionary))
                code = other.indices.to_numpy(zero_copy_only=False)
                n = many[code]
                first = np.cumsum(many) - many
                at = np.arange(n.sum()) + np.repeat(first[code] - (np.cumsum(n) - n), n)
                node = node.dictionary_encode()
                own = np.repeat(node.indices.to_numpy(zero_copy_only=False).astype(np.int64), n)
                u = np.unique(own * len(strings) + k[at])
                yield pa.RecordBatch.from_arrays([node.dictionary.take(pa.array(u // len(strings))), strings.take(pa.array(u % len(strings)))], names=["node", "t"])

    return run


@dataclass
class Batch:
    """A block of queries: what they want, as numbers of the strings in ``strings``."""

    qids: list
    own: list[list[int]]
    times: list[list[int]]
    more: list[list[int]]
    phrase: list[int]
    strings: list[str]
    vectors: np.ndarray | None
    wide: np.ndarray | None

    @staticmethod
    def of(rows: list, vectors: bool) -> Batch:
        """``rows`` has qid, phrase, tokens, expanded and, with ``vectors``, v and x."""
        at: dict[str, int] = {}
        number = lambda s: at.setdefault(s, len(at))
        for w in (*FIGURE_WORDS, *TABLE_WORDS):
            number(w)
        b = Batch([], [], [], [], [], [], None, None)
        for r in rows:
            own = Counter(r["tokens"])
            b.qids.append(r["qid"])
            b.own.append([number(t) for t in own])
            b.times.append(list(own.values()))
            b.more.append([number(t) for t in dict.fromkeys(r["expanded"] or ()) if t not in own])
            b.phrase.append(number(r["phrase"]))
        b.strings = list(at)
        if vectors:
            m = np.zeros((2, len(rows), V.DIMENSIONS))
            for k, r in enumerate(rows):
                for part, v in zip(m, (r["v"], r["x"]), strict=True):
                    for bucket, w in (v or {}).items():
                        part[k, bucket] = w
            # whole millionths: their products add up exactly
            b.vectors, b.wide = np.rint(m * 1e6)
        return b


def _lists(rows: np.ndarray, values: np.ndarray, n: int) -> pa.Array:
    """Lists of values of ascending rows."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(n + 1)), pa.int32()), pa.array(values, pa.int32()))


def words_of(text: str) -> list[str]:
    return [w.strip("_+-") for w in map(str.lower, _WORD.findall(text)) if w not in _STOP]


def _digest(feature: str) -> bytes:
    return hashlib.blake2b(feature.encode("utf-8", "ignore"), digest_size=8).digest()


class _Phrases(dict):
    """Bucket, doubled, plus the bit of the sign, of phrases by the numbers of their words."""

    def __init__(self, names: list[str], size: int):
        self.names, self.shifts = names, [Hasher.BITS * k for k in range(size - 1, -1, -1)]

    def __missing__(self, code: int) -> int:
        d = _digest("phrase:" + " ".join([self.names[code >> k & Hasher.MASK] for k in self.shifts]))
        self[code] = place = int.from_bytes(d[:4], "little") % V.DIMENSIONS * 2 + (d[4] & 1)
        return place


class Hasher:
    """Feature vectors of texts before they get unit length, in hundredths, see ``vectors.features``.

    Words and phrases are hashed when they first occur, and again when too many were kept.
    """

    WEIGHTS = np.array([100, 35])
    PHRASES = ((2, 140), (3, 180))
    #: Words and phrases of a size that are kept, and the bits of a word's number. Fixed values.
    MOST, BITS = 250_000, 20
    MASK = (1 << BITS) - 1

    def __init__(self):
        self._clear()

    def _clear(self) -> None:
        self.number: dict[str, int] = {}
        self.names: list[str] = []
        self.stop = np.zeros(0, bool)
        #: Features of each word: where they begin, how many, and their buckets and weights.
        self.first, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.bucket, self.weight = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.phrases = [_Phrases(self.names, size) for size, _ in self.PHRASES]

    def _add(self, new: list[str]) -> None:
        tri = [[f"tri:{w[k : k + 3]}" for k in range(len(w) - 2)] if len(w) >= 6 else [] for w in new]
        d = np.frombuffer(b"".join(_digest(f) for w, e in zip(new, tri, strict=True) for f in (f"tok:{w}", *e)), np.uint8).reshape(-1, 8)
        size = np.array([1 + len(e) for e in tri], np.int64)
        first = np.cumsum(size) - size
        weight = np.full(len(d), self.WEIGHTS[1])
        weight[first] = self.WEIGHTS[0]
        self.first, self.size = np.append(self.first, first + len(self.bucket)), np.append(self.size, size)
        self.bucket = np.append(self.bucket, (np.ascontiguousarray(d[:, :4]).view("<u4").ravel() % V.DIMENSIONS).astype(np.int64))
        self.weight = np.append(self.weight, weight * np.where(d[:, 4] & 1, 1, -1))
        self.stop = np.append(self.stop, [w in _STOP for w in new])
        for w in new:
            self.number[w] = len(self.names)
            self.names.append(w)

    def __call__(self, texts: list[str]) -> np.ndarray:
        return self.of([words_of(t) for t in texts])

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """``texts`` as words in lower case without stop words; those of one letter don't count."""
        n = len(texts) * V.DIMENSIONS
        words, row = [], []
        for t in texts:
            t = [w for w in t if len(w) >= 2]
            words += t
            row.append(len(t))
        row = np.repeat(np.arange(len(texts)), row)
        if len(self.names) > self.MOST:
            self._clear()
        new = sorted({*words} - self.number.keys())
        if len(self.names) + len(new) > self.MASK:
            # more than can be numbered beside each other
            half = len(texts) // 2
            if not half:
                raise ValueError(f"a text has more than {self.MASK} different words")
            return np.concatenate([self.of(texts[:half]), self.of(texts[half:])])
        if new:
            self._add(new)
        w = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        many = self.size[w]
        at = np.arange(many.sum()) + np.repeat(self.first[w] - (np.cumsum(many) - many), many)
        out = np.bincount(np.repeat(row, many) * V.DIMENSIONS + self.bucket[at], self.weight[at], n)
        stop = self.stop[w]
        for (size, weight), known in zip(self.PHRASES, self.phrases, strict=True):
            k = len(w) - size + 1
            if k < 1:
                continue
            ok, code = row[:k] == row[size - 1 :], np.zeros(k, np.int64)
            for j in range(size):
                ok &= ~stop[j : j + k]
                code = code << self.BITS | w[j : j + k]
            if len(known) > self.MOST:
                known.clear()
            code = code[ok].tolist()
            c = np.fromiter(map(known.__getitem__, code), np.int64, len(code))
            out += np.bincount(row[:k][ok] * V.DIMENSIONS + (c >> 1), np.where(c & 1, weight, -weight), n)
        return out.astype(np.int64).reshape(-1, V.DIMENSIONS)


def packed(v: np.ndarray, unit: int) -> pa.Array:
    """Rows of whole multiples of ``unit`` as bytes, each in as few a number as hold it."""
    v = v // unit
    most = np.abs(v).max(axis=1, initial=0)
    return pa.array([x.astype("<i1" if m < 128 else "<i2" if m < 32768 else "<i4").tobytes() for x, m in zip(v, most, strict=True)], pa.binary())


def unpacked(a: pa.Array, unit: int) -> np.ndarray:
    offsets = np.frombuffer(a.buffers()[1], np.int32)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data, out, size = np.frombuffer(a.buffers()[2], np.uint8), np.zeros((len(a), V.DIMENSIONS)), np.diff(offsets)
    for kind in ("<i1", "<i2", "<i4"):
        width = np.dtype(kind).itemsize * V.DIMENSIONS
        rows = np.flatnonzero(size == width)
        if len(rows):
            out[rows] = data[offsets[rows][:, None] + np.arange(width)].view(kind)
    out *= unit
    return out


def describe(b: Batch, hashed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Makes ``FEATURES`` of key, doc_id, searched, low, heading_low, title, terms, embedded, near, flagged, defects, figures, tables, vector.

    ``embedded`` is null where it has the words of ``searched``.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, hasher = Finder(b.strings), Hasher()
        at = {s: k for k, s in enumerate(b.strings)}

        def numbered(each: list) -> pa.Array:
            return pa.array([[at[x] for x in e if x in at] for e in each], pa.list_(pa.int32()))

        for whole in batches:
            for start in range(0, whole.num_rows, 1024):
                p = whole.slice(start, 1024)
                n = p.num_rows
                tokens = [words_of(t) for t in p["searched"].to_pylist()]
                tf = [sorted((at[t], c) for t, c in Counter(e).items() if t in at) for e in tokens]
                terms = p["terms"].to_pylist()
                words = [dict.fromkeys(words_of(" ".join(e))) for e in terms]
                lists = {x: _lists(*find(p[c]), n) for x, c in (("low", "low"), ("heading", "heading_low"), ("title", "title"))}
                lists |= {"tf": pa.array([[k for k, _ in e] for e in tf], pa.list_(pa.int32())), "label": numbered([dict.fromkeys(e) for e in terms]), "word": numbered(words), "near": numbered([dict.fromkeys(e or ()) for e in p["near"].to_pylist()])}
                if hashed:
                    vector = packed(hasher.of([e if t is None else words_of(t) for e, t in zip(tokens, p["embedded"].to_pylist(), strict=True)]), HASHED)
                elif b.vectors is not None:
                    m = np.zeros((n, V.DIMENSIONS))
                    for k, e in enumerate(p["vector"].to_pylist()):
                        for bucket, w in e or ():
                            m[k, bucket] = w
                    vector = packed(np.rint(m * 1e6).astype(np.int64), 1)
                else:
                    vector = pa.nulls(n, pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [p["key"], p["doc_id"], pa.array([len(e) for e in tokens], pa.int32()), pa.array([[c for _, c in e] for e in tf], pa.list_(pa.int32())), *[lists[x] for x in LISTS], p["flagged"], p["defects"], p["figures"], p["tables"], vector],
                    names=["key", "doc_id", "length", "times", *LISTS, "flagged", "defects", "figures", "tables", "vector"],
                )

    return run


class Inverse:
    """Which queries want a string."""

    def __init__(self, wanted: list[list[int]], strings: int, weights: list[list[float]] | None = None):
        s = np.array([x for e in wanted for x in e], np.int64)
        q = np.repeat(np.arange(len(wanted)), [len(e) for e in wanted])
        order = np.argsort(s, kind="stable")
        self.q, self.ends = q[order], np.cumsum(np.bincount(s, minlength=strings))
        self.first = self.ends - np.bincount(s, minlength=strings)
        self.weights = None if weights is None else np.array([x for e in weights for x in e], float)[order]
        self.n = len(wanted)

    def spread(self, row: np.ndarray, string: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
        """(place in rows x queries, which of the entries, weights)"""
        many = self.ends[string] - self.first[string]
        entry = np.repeat(np.arange(len(string)), many)
        at = np.arange(len(entry)) + np.repeat(self.first[string] - (np.cumsum(many) - many), many)
        return row[entry] * self.n + self.q[at], entry, None if self.weights is None else self.weights[at]

    def count(self, row: np.ndarray, string: np.ndarray, rows: int) -> np.ndarray:
        return np.bincount(self.spread(row, string)[0], minlength=rows * self.n).reshape(rows, self.n)


class Scorer:
    """All scores of a batch of chunks: arrays of chunks x queries."""

    def __init__(self, b: Batch, idf: np.ndarray, average: float, hashed: bool):
        n = len(b.strings)
        self.b, self.idf, self.average, self.hashed = b, idf, average, hashed
        every = [o + m for o, m in zip(b.own, b.more, strict=True)]
        self.wanted, self.own, self.more = Inverse(every, n), Inverse(b.own, n, b.times), Inverse(b.more, n)
        self.single = Inverse([[k for k in m if " " not in b.strings[k]] for m in b.more], n)
        self.phrase = Inverse([[k] for k in b.phrase], n)
        self.size = np.array([len(e) for e in every])
        self.fig, self.tab = (np.isin(np.arange(n), [b.strings.index(w) for w in ws]) for ws in (FIGURE_WORDS, TABLE_WORDS))

    def __call__(self, p: pa.RecordBatch, around: dict[str, list[int]] | None = None) -> dict[str, np.ndarray]:
        """lexical, vector, graph (with ``around``: documents and the queries they are near), rerank, lead (-1 where no score brought a pair up)."""
        n, q = p.num_rows, len(self.b.qids)
        of = {}
        for x in LISTS:
            of[x] = np.repeat(np.arange(n), pc.list_value_length(p[x]).to_numpy(zero_copy_only=False)), p[x].flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        row, term = of["tf"]
        tf, length = p["times"].flatten().to_numpy(zero_copy_only=False).astype(float), p["length"].to_numpy().astype(float)[row]
        bm = self.idf[term] * (tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(self.average, 1.0))))
        a, e, w = self.own.spread(row, term)
        a2, e2, _ = self.single.spread(row, term)
        place = np.concatenate([a, a2])
        lex = np.bincount(place, np.concatenate([bm[e] * w, 0.22 * (1 + np.log(tf[e2]))]), n * q).reshape(n, q)
        labels, words = self.wanted.count(*of["label"], n), self.wanted.count(*of["word"], n)
        by_graph = 0.7 * labels + 0.25 * words
        found = (np.bincount(place, minlength=n * q).reshape(n, q) > 0) | (by_graph > 0)
        whole, inside = self.phrase.count(*of["low"], n) > 0, self.wanted.count(*of["low"], n)
        part = np.where(whole, 2.2, 0.0) + 0.9 * self.own.count(*of["heading"], n) + 0.7 * self.own.count(*of["title"], n) + 0.08 * self.more.count(*of["low"], n)
        lex = np.where(found, lex + part, 0.0)
        out = {"lexical": lex, "lead": np.where(found, lex, -1.0)}
        if self.b.vectors is not None:
            m = unpacked(p["vector"], HASHED if self.hashed else 1)
            if self.hashed:
                norm = np.sqrt((m * m).sum(axis=1, keepdims=True))
                m = np.rint(np.divide(m, norm, out=np.zeros_like(m), where=norm > 0) * 1e6)
            c = np.maximum(m @ self.b.vectors.T, 0.92 * (m @ self.b.wide.T)) / 1e12
            out["vector"] = np.maximum(c, 0.0)
            out["lead"] = np.where(c > 0, lex + out["vector"], out["lead"])
        if around is not None:
            near = self.wanted.count(*of["near"], n) if len(of["near"][1]) else 0
            place = [k * q + np.array(around[d]) for k, d in enumerate(p["doc_id"].to_pylist()) if d in around]
            top = np.zeros(n * q, bool)
            if place:
                top[np.concatenate(place)] = True
            led = out["lead"] > 0
            out["graph"] = by_graph + np.where(led & top.reshape(n, q), 0.35, 0.0) + np.where(led | (by_graph > 0), np.minimum(0.4, 0.04 * near), 0.0)
            low_row, low = of["low"]
            some = inside > 0
            fig, tab = (np.bincount(low_row[t[low]], minlength=n)[:, None] > 0 for t in (self.fig, self.tab))
            bit = lambda c: p[c].to_numpy(zero_copy_only=False).astype(bool)[:, None]
            r = inside / np.maximum(self.size, 1) * 2.2 + np.where(whole, 1.4, 0.0) + self.wanted.count(*of["heading"], n) * 0.35
            r = r + np.where(bit("figures") & (fig | some), 0.25, 0.0) + np.where(bit("tables") & (tab | some), 0.25, 0.0) - np.where(bit("flagged"), 0.9, 0.0) - p["defects"].to_numpy()[:, None] * 0.25
            scored = reduce_any([out[s] > 0 for s in SETS if s in out])
            out["rerank"] = np.where(scored, np.maximum(r, 0.0), 0.0)
            out["scored"] = scored
        return out


def reduce_any(masks: list[np.ndarray]) -> np.ndarray:
    out = masks[0]
    for m in masks[1:]:
        out = out | m
    return out


def bins(scores: np.ndarray) -> np.ndarray:
    """The step of each score, in the order of the scores."""
    return np.clip((np.ascontiguousarray(scores).view(np.int64) >> STEP) - LOWEST, 0, BINS - 1)


def smallest(order: list[np.ndarray], same: list[np.ndarray], keep: int) -> np.ndarray:
    """Places of the first ``keep`` by ``order`` (last key first, as in lexsort) among those that agree in ``same``."""
    o = np.lexsort([*order, *same])
    if not len(o):
        return o
    new = np.zeros(len(o), bool)
    new[0] = True
    for s in same:
        new[1:] |= s[o][1:] != s[o][:-1]
    start = np.maximum.accumulate(np.where(new, np.arange(len(o)), 0))
    return o[np.arange(len(o)) - start < keep]


def _pieces(batches: Iterator[pa.RecordBatch], queries: int) -> Iterator[pa.RecordBatch]:
    size = max(1, PAIRS // max(queries, 1))
    for whole in batches:
        for at in range(0, whole.num_rows, size):
            yield whole.slice(at, size)


#: What passes return: kind, query, bin or place, number, score, key, document.
PASS = "kind int, q int, bin int, n long, score double, key string, doc_id string"
_NAMES = ["kind", "q", "bin", "n", "score", "key", "doc_id"]
COUNTED, GREATEST, LEAD = 0, 1, 2
RERANK, LEAST, MOST = 3, 4, 5


def _rows(kind: int, q, bin, n=None, score=None, key=None, doc=None) -> pa.RecordBatch:
    q = np.asarray(q)
    some = lambda x, t: pa.nulls(len(q), t) if x is None else pa.array(x, t)
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), kind), pa.int32()), pa.array(q, pa.int32()), pa.array(np.broadcast_to(bin, len(q)), pa.int32()), some(n, pa.int64()), some(score, pa.float64()), some(key, pa.string()), some(doc, pa.string())], names=_NAMES)


def survey(shared, sets: list[int], around: bool, lead: int = 5):
    """First (lexical, vector) and second pass (graph, rerank): counts by step, maxima, and of the first the best by both scores together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, near = shared.value
        q = len(score.b.qids)
        counts, best = {s: np.zeros(q * BINS, np.int64) for s in sets}, {}
        top, held = np.full((lead, q), -1.0), []
        for p in _pieces(batches, q):
            got = score(p, near if around else None)
            names = {s: got[SETS[s]] for s in sets} | ({RERANK: got["rerank"]} if around else {})
            for s, x in names.items():
                best[s] = np.maximum(best.get(s, 0.0), x.max(axis=0))
                if s in counts:
                    i, j = np.nonzero(x > 0)
                    counts[s] += np.bincount(j * BINS + bins(x[i, j]), minlength=q * BINS)
            if not around:
                x = got["lead"]
                both = np.concatenate([top, x])
                top = np.partition(both, len(both) - lead, axis=0)[-lead:]
                i, j = np.nonzero((x >= top[0]) & (x >= 0))
                held.append((j, x[i, j], p["key"].take(pa.array(i)).to_numpy(zero_copy_only=False).astype(str), p["doc_id"].take(pa.array(i)).to_numpy(zero_copy_only=False)))
                if sum(len(h[0]) for h in held) > 16 * lead * q:
                    held = [_leading(held, lead)]
        for s, c in counts.items():
            at = np.flatnonzero(c)
            yield _rows(COUNTED, at // BINS, at % BINS + s * BINS, c[at])
        for s, x in best.items():
            yield _rows(GREATEST, np.arange(q), s, None, x)
        if held:
            j, x, key, doc = _leading(held, lead)
            yield _rows(LEAD, j, 0, None, x, key, doc)

    return run


def _leading(held: list, lead: int) -> tuple:
    j, x, key, doc = (np.concatenate([h[k] for h in held]) for k in range(4))
    o = smallest([key, -x], [j], lead)
    return j[o], x[o], key[o], doc[o]


def _shares(score: Scorer, got: dict, steps: dict[int, tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """At least and at most what the ranks of each pair give."""
    least, most = 0.0, 0.0
    q = np.arange(len(score.b.qids)) * BINS
    for s, (lo, hi) in steps.items():
        x = got[SETS[s]]
        at = bins(x) + q
        least = least + np.where(x > 0, lo[at], 0.0)
        most = most + np.where(x > 0, hi[at], 0.0)
    return least, most


def extremes(shared, ranked):
    """Third pass: of each query the greatest sum of shares that a pair has at least, and may have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (score, near), (steps, _) = shared.value, ranked.value
        q = len(score.b.qids)
        low, high = np.zeros(q), np.zeros(q)
        for p in _pieces(batches, q):
            a, b = _shares(score, score(p, near), steps)
            low, high = np.maximum(low, a.max(axis=0)), np.maximum(high, b.max(axis=0))
        yield _rows(GREATEST, np.arange(q), LEAST, None, low)
        yield _rows(GREATEST, np.arange(q), MOST, None, high)

    return run


#: What the fourth pass returns.
CANDIDATES = "q int, key string, lexical double, vector double, graph double, rerank double, least double, most double, shares double"


def candidates(shared, ranked, limit: int, weights: tuple[float, float, float]):
    """Fourth pass: pairs that may be among the ``limit`` best or have the greatest sum of shares.

    Of pairs with the same scores the first by key are the best.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (score, near), (steps, top) = shared.value, ranked.value
        q = len(score.b.qids)
        over = lambda x, s: np.divide(x, top[s], out=np.zeros_like(x), where=top[s] > 0)
        bound, held = np.full((limit, q), -1.0), []

        def settled() -> list[np.ndarray]:
            part = [np.concatenate([h[k] for h in held]) for k in range(9)]
            j, key, (lex, vec, gra, rer), most, share = part[0], part[1], part[2:6], part[7], part[8]
            ok = (most + MARGIN >= bound[0][j]) | (share >= top[LEAST][j])
            part = [x[ok] for x in part]
            o = smallest([part[1]], [part[0], *part[2:6]], limit)
            return [x[o] for x in part]

        for p in _pieces(batches, q):
            got = score(p, near)
            a, b = _shares(score, got, steps)
            vec = got.get("vector", np.zeros_like(a))
            fixed = 0.25 * (weights[0] * over(got["lexical"], 0) + weights[1] * (over(vec, 1) if 1 in steps else 0.0) + weights[2] * over(got["graph"], 2)) + 0.13 * over(got["rerank"], RERANK)
            low = np.where(got["scored"], 0.62 * a / top[MOST].clip(1e-300) + fixed, -1.0)
            high = np.where(got["scored"], 0.62 * np.minimum(1.0, b / top[LEAST].clip(1e-300)) + fixed, -2.0)
            both = np.concatenate([bound, low])
            bound = np.partition(both, len(both) - limit, axis=0)[-limit:]
            i, j = np.nonzero(got["scored"] & ((high + MARGIN >= bound[0]) | (b >= top[LEAST])))
            held.append([j, p["key"].take(pa.array(i)).to_numpy(zero_copy_only=False).astype(str), got["lexical"][i, j], vec[i, j], got["graph"][i, j], got["rerank"][i, j], low[i, j], high[i, j], b[i, j]])
            if sum(len(h[0]) for h in held) > 65_536:
                held = [settled()]
        if held:
            j, key, *rest = settled()
            yield pa.RecordBatch.from_arrays([pa.array(j, pa.int32()), pa.array(key, pa.string()), *map(pa.array, rest)], names=["q", "key", "lexical", "vector", "graph", "rerank", "least", "most", "shares"])

    return run


def places(shared, named, sets: list[int]):
    """Fifth pass: how many pairs come before each candidate, by score, then key. ``named``: (q, key, scores by set) of the candidates."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (score, near), (cq, ckey, scores) = shared.value, named.value
        q = len(score.b.qids)
        keys, place = np.unique(ckey, return_inverse=True)
        span = len(keys) + 1
        plan, before = [], {s: np.zeros(len(cq), np.int64) for s in sets}
        for s in sets:
            order = np.lexsort((-place, scores[s], cq))
            cut = np.searchsorted(cq[order], np.arange(q + 1))
            for k in range(q):
                mine = order[cut[k] : cut[k + 1]]
                if len(mine):
                    values, u = np.unique(scores[s][mine], return_inverse=True)
                    plan.append((s, k, mine, values, (2 * u + 1) * span + (span - 1 - place[mine])))
        for p in _pieces(batches, q):
            got = score(p, near)
            after = np.searchsorted(keys, p["key"].to_numpy(zero_copy_only=False).astype(str), side="right")
            columns = {s: np.ascontiguousarray(got[SETS[s]].T) for s in sets}
            for s, k, mine, values, codes in plan:
                x = columns[s][k]
                at = np.flatnonzero((x >= values[0]) & (x > 0))
                if not len(at):
                    continue
                x = x[at]
                u = np.searchsorted(values, x)
                equal = values[np.minimum(u, len(values) - 1)] == x
                code = np.where(equal, (2 * u + 1) * span + span - after[at], 2 * u * span)
                beats = np.bincount(np.searchsorted(codes, code), minlength=len(codes) + 1)
                before[s][mine] += beats[::-1].cumsum()[::-1][1:]
        for s in sets:
            yield _rows(COUNTED, np.arange(len(cq)), s, before[s])

    return run
