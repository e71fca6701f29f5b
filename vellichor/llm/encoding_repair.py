"""Texts damaged by a wrong decoding: finding and restoring them.

1. Every token with non-ASCII characters gives a near-twin key: the token with
   its neighbours, digits folded, all non-ASCII characters stripped. Tokens
   with the same key but other non-ASCII characters are twins; the frequent
   one counts as clean.
2. Clean and damaged twins have the same ASCII characters, which aligns what
   stands between them; each aligned pair votes for the transformations
   (encode with one code page, decode with another, once or twice) that turn
   the clean character into the damaged ones.
3. Transformations with enough votes are the learned mappings. They are
   applied to all rows: sequences that only a wrong decoding makes are damage
   outright, single characters are weighed by how usual the observed and the
   restored character are between their neighbours in the whole collection.

Twins, votes and neighbour counts are aggregated over all rows, map-side
first. What reaches the driver is bounded by the list of transformations and,
for neighbour counts, by a least share (shares sum to 1).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.plans.lineage import materialize

#: Code pages that text is commonly mistaken for. Fixed values.
PAGES = ("cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1250", "cp1251", "iso8859-2", "iso8859-15")
#: Characters that may have been damaged: letters, punctuation, super- and subscripts, signs. Ranges of code points, fixed values.
ALPHABET = [(0xA0, 0x17F), (0x370, 0x3FF), (0x2010, 0x2027), (0x2030, 0x203A), (0x2070, 0x209C), (0x20AC, 0x20AC), (0x2122, 0x2126), (0x2190, 0x2193), (0x2202, 0x2265), (0xFB00, 0xFB04)]
MIN_CHARACTERS = 2
MIN_VOTES = 3
LEAST_SHARE = 1e-6
RATIO = 30.0

_RUN = re.compile(r"[^\x00-\x7f]+")
_DIGITS = re.compile(r"\d+(?:[.,]\d+)*")
_HARD = re.compile("[�\x80-\x84\x86-\x9f]")
_ASCII_SPLIT = re.compile(r"[\x00-\x7f]")
_LONE = re.compile("(?:(?<=[\\s’'a-z])|^)Ã (?=[a-zà-ÿ0-9])")


def _decode(data: bytes, page: str, lost: str) -> str | None:
    """Decodes; bytes the page leaves undefined are kept as control characters, dropped, or replaced."""
    out = []
    for b in data:
        try:
            out.append(bytes([b]).decode(page))
        except UnicodeDecodeError:
            out.append({"keep": chr(b), "drop": "", "mark": "�"}[lost])
    return "".join(out)


@lru_cache(maxsize=None)
def transformations() -> dict[str, tuple[str, str, str, int]]:
    """All (written page, read page, undefined bytes, times) by name."""
    t = {}
    for read in PAGES:
        for lost in ("keep", "drop", "mark"):
            t[f"utf-8>{read}/{lost}"] = ("utf-8", read, lost, 1)
            t[f"utf-8>{read}/{lost}x2"] = ("utf-8", read, lost, 2)
        for written in ("cp1252", "mac_roman", "cp850"):
            if written != read:
                t[f"{written}>{read}"] = (written, read, "keep", 1)
    return t


@lru_cache(maxsize=200_000)
def damage(clean: str, name: str) -> str | None:
    """What a transformation makes of a clean character; None where it can't be written, or nothing changes."""
    written, read, lost, times = transformations()[name]
    s = clean
    for _ in range(times):
        try:
            s = _decode(s.encode(written), read, lost)
        except UnicodeEncodeError:
            return None
    return s if s and s != clean else None


def _twin_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (key, variant) and of (neighbours, character), summed within the task as far as memory goes."""
    twins: Counter[tuple[str, str]] = Counter()
    near: Counter[tuple[str, str]] = Counter()
    tokens: dict[str, tuple[str, str]] = {}

    def flush():
        keys = [*twins, *near]
        out = pa.RecordBatch.from_arrays(
            [pa.array(["t"] * len(twins) + ["n"] * len(near)), pa.array([k for k, _ in keys], pa.string()), pa.array([v for _, v in keys], pa.string()), pa.array([*twins.values(), *near.values()], pa.int64())],
            names=["kind", "key", "variant", "n"],
        )
        twins.clear()
        near.clear()
        return out

    for b in batches:
        for text in b.column(0).to_pylist():
            if text is None or text.isascii():
                continue
            words = text.split()
            last = len(words) - 1
            for k, token in enumerate(words):
                if token.isascii() or len(token) > 120:
                    continue
                piece = f"{words[k - 1][-12:] if k else ''}\x1f{token}\x1f{words[k + 1][:12] if k < last else ''}"
                got = tokens.get(piece)
                if got is None:
                    folded = _DIGITS.sub("0", piece)
                    # neighbours that are damaged themselves match by what is stripped from them
                    key = "".join(c for c in folded if c < "\x80").lower()
                    if len(tokens) > 100_000:
                        tokens.clear()
                    got = tokens[piece] = (key, folded.split("\x1f")[1])
                twins[got] += 1
            for m in _RUN.finditer(text):
                s, e = m.span()
                if e - s == 1:
                    near[neighbours(text, s, e), m.group()] += 1
                else:
                    for k in range(s, e):
                        near[neighbours(text, k, k + 1), text[k]] += 1
            if len(twins) > 150_000:
                yield flush()
    yield flush()


def neighbours(text: str, s: int, e: int) -> str:
    """The characters around a position, case and digits folded."""
    a, b = (text[s - 1] if s else " "), (text[e] if e < len(text) else " ")
    fold = lambda c: "0" if c.isdigit() else " " if c.isspace() else c.lower() if c < "\x80" else "\x7f"
    return fold(a) + fold(b)


def aligned(clean: str, damaged: str) -> list[tuple[str, str]]:
    """Runs between the same ASCII characters of two twins that differ."""
    if [c for c in clean if c < "\x80"] != [c for c in damaged if c < "\x80"]:
        return []
    return [(a, b) for a, b in zip(_ASCII_SPLIT.split(clean), _ASCII_SPLIT.split(damaged), strict=True) if a != b]


def _votes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    votes: Counter[tuple[str, str]] = Counter()
    for b in batches:
        for clean, damaged in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            for c, d in aligned(clean, damaged):
                if len(c) == 1:
                    for name in transformations():
                        if damage(c, name) == d:
                            votes[name, c] += 1
    yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in votes], pa.string()), pa.array([c for _, c in votes], pa.string()), pa.array(list(votes.values()), pa.int64())], names=["name", "character", "votes"])


class Mappings:
    """Learned transformations and neighbour counts, ready to apply."""

    def __init__(self, names: list[str], near: dict[tuple[str, str], int]):
        self.names, self.near = names, near
        alphabet = [chr(c) for a, z in ALPHABET for c in range(a, z + 1)]
        self.sequences: dict[str, str] = {}
        self.single: dict[str, dict[str, str]] = {}
        for name in names:
            for c in alphabet:
                d = damage(c, name)
                if d is None or (d == "�"):
                    continue
                if len(d) > 1 and not d.isascii():
                    self.sequences.setdefault(d, c)
                elif len(d) == 1 and d > "\x7f":
                    self.single.setdefault(name, {})[d] = c
        order = sorted(self.sequences, key=lambda s: (-len(s), s))
        self.pattern = re.compile("|".join(map(re.escape, order))) if order else None
        self._seen: dict[str, bool] = {}

    def _sequence(self, run: str) -> bool:
        got = self._seen.get(run)
        if got is None:
            if len(self._seen) > 50_000:
                self._seen.clear()
            got = self._seen[run] = bool(self.pattern and self.pattern.search(run))
        return got

    def _singles(self, text: str) -> str | None:
        """The one-to-one transformation whose reversal makes the text far more usual, if any."""
        best, best_gain = None, math.log(RATIO)
        spots = [(m.start(), m.group()) for m in _RUN.finditer(text)]
        for name, table in self.single.items():
            gain, worst = 0.0, 0.0
            for s, run in spots:
                for k, c in enumerate(run):
                    to = table.get(c)
                    if to is None:
                        continue
                    ctx = neighbours(text, s + k, s + k + 1)
                    r = math.log((self.near.get((ctx, to), 0) + 0.5) / (self.near.get((ctx, c), 0) + 0.5))
                    gain = max(gain, r)
                    worst = min(worst, r)
            if gain > best_gain:
                best, best_gain = name, gain
        return best

    def is_damaged(self, text: str | None) -> bool:
        if not text or text.isascii():
            return False
        if _HARD.search(text) or _LONE.search(text):
            return True
        runs = _RUN.findall(text)
        if any(len(r) > 1 and self._sequence(r) for r in runs):
            return True
        return self._singles(text) is not None

    def restore(self, text: str) -> tuple[str, str | None]:
        """The text with all learned mappings undone, and how: ``sequences``, a transformation, or None."""
        how, s = None, _LONE.sub("à ", text)
        if self.pattern:
            for _ in range(3):
                t = self.pattern.sub(lambda m: self.sequences[m.group()], s)
                if t == s:
                    break
                s, how = t, "sequences"
        if (name := self._singles(s)) is not None:
            table = self.single[name]

            def undo(m: re.Match) -> str:
                out = []
                for k, c in enumerate(m.group()):
                    to = table.get(c)
                    ctx = neighbours(s, m.start() + k, m.start() + k + 1)
                    out.append(to if to is not None and self.near.get((ctx, to), 0) >= self.near.get((ctx, c), 0) else c)
                return "".join(out)

            s, how = _RUN.sub(undo, s), name
        return s, how if s != text else None


def learn(texts: DataFrame, column: str = "text") -> Mappings:
    """Learns the mappings from all texts of a table (nulls are passed over)."""
    src = texts.select(F.col(column).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7F]"))
    counted = materialize(src.mapInArrow(_twin_counts, "kind string, key string, variant string, n long").groupBy("kind", "key", "variant").agg(F.sum("n").alias("n")), "twins")
    twins = counted.filter("kind = 't'").select("key", "variant", "n")
    usual = twins.groupBy("key").agg(F.max(F.struct("n", "variant")).alias("m"), F.count(F.lit(1)).alias("variants")).filter("variants > 1").select("key", F.col("m.variant").alias("clean"), F.col("m.n").alias("clean_n"))
    pairs = twins.join(usual, "key").filter("variant <> clean and n < clean_n").select("clean", "variant")
    votes = pairs.mapInArrow(_votes, "name string, character string, votes long").groupBy("name", "character").agg(F.sum("votes").alias("votes"))
    # at most one row per transformation of the fixed list
    names = [r["name"] for r in votes.groupBy("name").agg(F.count(F.lit(1)).alias("characters"), F.sum("votes").alias("votes")).filter((F.col("characters") >= MIN_CHARACTERS) & (F.col("votes") >= MIN_VOTES)).orderBy(F.desc("votes"), "name").collect()]
    near = counted.filter("kind = 'n'")
    total = near.agg(F.sum("n")).first()[0] or 0
    rows = near.filter(F.col("n") >= max(1.0, total * LEAST_SHARE)).select("key", "variant", "n").collect()
    return Mappings(names, {(r["key"], r["variant"]): r["n"] for r in rows})


def damaged_rows(df: DataFrame, mappings: Mappings, row_key: str, text: str, restored: bool = False) -> DataFrame:
    """The damaged rows: row_key, and with ``restored`` the restored text and how it was restored.

    Null, empty and pure ASCII texts are never damaged. Repeated rows are
    judged each on its own, alike.
    """
    shared = df.sparkSession.sparkContext.broadcast((mappings.names, mappings.near))
    rows = df.select(F.col(row_key).cast("long").alias("row_key"), F.col(text).alias("t")).filter(F.col("t").rlike(r"[^\x00-\x7F]"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Mappings(*shared.value)
        for b in batches:
            hit, texts = [], b.column(1).to_pylist()
            hit = [k for k, t in enumerate(texts) if m.is_damaged(t)]
            columns, names = [b.column(0).take(pa.array(hit, pa.int64()))], ["row_key"]
            if restored:
                fixed = [m.restore(texts[k]) for k in hit]
                columns += [pa.array([x for x, _ in fixed], pa.string()), pa.array([h for _, h in fixed], pa.string())]
                names += ["restored", "how"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(run, "row_key long, restored string, how string" if restored else "row_key long")
