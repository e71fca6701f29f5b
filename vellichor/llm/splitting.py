"""Cutting oversized texts at natural boundaries by pointer doubling.

Every unit end of a text is a node. Its successor is the farthest end that a
next piece may reach: the piece starts a fixed overlap before the node and has
to stay within the token and the character limit. Squaring the successor
table again and again (``s = s[s]``) while the set of reached nodes is joined
with it gives all cuts of all texts of a batch in logarithmically many steps,
none of which looks at one text or one cut at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_TOKENS = 850
MAX_CHARS = 4250
OVERLAP_TOKENS = 60

_WORD = re.compile(r"\S+")
_CLOSERS = "\"'”’»)]}*_"
_PIECE_SCHEMA = T.StructType(
    [
        T.StructField("row_id", T.LongType()),
        T.StructField("piece_no", T.IntegerType()),
        T.StructField("pieces", T.IntegerType()),
        T.StructField("start", T.IntegerType()),
        T.StructField("stop", T.IntegerType()),
        T.StructField("fresh_from", T.IntegerType()),
        T.StructField("piece", T.StringType()),
    ]
)


def rough_tokens(words: int) -> int:
    return max(1, words * 4 // 3)


def max_words(max_tokens: int) -> int:
    """The most words that stay within ``max_tokens`` rough tokens."""
    return (3 * (max_tokens + 1) - 1) // 4


def oversized(text: Column, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS) -> Column:
    """Whether a text exceeds either limit; false for null.

    A text of n words has at least 2n - 1 characters, so short texts are
    settled by their length and never scanned.
    """
    words = max_words(max_tokens)
    n = F.length(text)
    # the space class of Unicode plus the four separators that Python counts as white space
    many = F.regexp_count(text, F.lit(r"(?U)[^\s\x1c-\x1f]+")) > words
    return F.coalesce((n > max_chars) | ((n > 2 * words) & many), F.lit(False))


def _units(text: str, part: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, words so far and boundary rank (3 paragraph, 2 sentence or line, 1 word, 0 inside a word)."""
    starts, ends, ranks, words = [], [], [], []
    n = 0
    prev = None
    for m in _WORD.finditer(text):
        s, e = m.span()
        if prev is not None:
            gap = text.count("\n", prev, s)
            if gap >= 2:
                ranks[-1] = 3
            elif gap or text[prev - 1] in ".!?;:。" or (text[prev - 1] in _CLOSERS and prev > 1 and text[prev - 2] in ".!?"):
                ranks[-1] = 2
        n += 1
        while e - s > part:
            starts.append(s)
            ends.append(s + part)
            ranks.append(0)
            words.append(n)
            s += part
        starts.append(s)
        ends.append(e)
        ranks.append(1)
        words.append(n)
        prev = e
    if ranks:
        ranks[-1] = 3
    return np.array(starts, np.int64), np.array(ends, np.int64), np.array(words, np.int64), np.array(ranks, np.int8)


def _farthest(starts, ends, words, ranks, begin, wmax: int, cmax: int, overlap_words: int):
    """For piece starts ``begin`` (unit indexes): the unit index of the best end."""
    base = words[begin] - 1
    by_words = np.searchsorted(words, base + wmax, "right") - 1
    by_chars = np.searchsorted(ends, starts[begin] + cmax, "right") - 1
    far = np.minimum(by_words, by_chars)
    # the last boundary of each rank at or before the farthest end
    index = np.arange(len(ends))
    best = far.copy()
    half = starts[begin] + (ends[far] - starts[begin]) // 2
    for rank in (1, 2, 3):
        last = np.maximum.accumulate(np.where(ranks >= rank, index, -1))[far]
        ok = (last >= 0) & (ends[np.maximum(last, 0)] >= half)
        best = np.where(ok, last, best)
    return best


def split_offsets(texts: list[str], max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap_tokens: int = OVERLAP_TOKENS) -> list[list[tuple[int, int, int]]]:
    """(start, stop, first new character) of every piece of every text.

    A text without words gives no piece. All pieces keep both limits; they
    cover the text but for white space between them.
    """
    wmax = max_words(max_tokens)
    overlap_words = max(0, overlap_tokens * 3 // 4)
    part = max(1, max_chars // 16)
    overlap_chars = max_chars // 4
    succ, begins, spans, offset, parts = [], [], [], 0, []
    for text in texts:
        starts, ends, words, ranks = _units(text, part)
        n = len(starts)
        parts.append((starts, ends))
        spans.append((offset, n))
        if n:
            # node i (0: the start of the text, i: the end of unit i - 1); the next piece starts up to the overlap before it
            k = np.arange(n + 1)
            last = np.maximum(k - 1, 0)
            first = np.searchsorted(words, words[last] - overlap_words + 1, "left")
            first = np.maximum(first, np.searchsorted(starts, ends[last] - overlap_chars, "left"))
            first = np.minimum(first, np.minimum(k, n - 1))
            # a sentence start within the overlap and a third more is preferred
            if overlap_words:
                index = np.arange(n)
                opener = np.concatenate([[True], ranks[:-1] >= 2])
                prev_open = np.maximum.accumulate(np.where(opener, index, -1))[first]
                near = (prev_open >= 0) & (words[np.maximum(prev_open, 0)] >= words[first] - overlap_words // 3) & (starts[first] - starts[np.maximum(prev_open, 0)] <= overlap_chars // 3)
                first = np.where(near, np.maximum(prev_open, 0), first)
            first[0] = 0
            ahead = _farthest(starts, ends, words, ranks, first, wmax, max_chars, overlap_words) + 1
            ahead = np.maximum(ahead, np.minimum(k + 1, n))
            ahead[n] = n
            succ.append(ahead + offset)
            begins.append(first)
            offset += n + 1
        else:
            begins.append(np.zeros(0, np.int64))
    if not succ:
        return [[] for _ in texts]
    s = np.concatenate(succ)
    reached = np.zeros(len(s), bool)
    reached[[o for o, n in spans if n]] = True
    while True:
        more = reached.copy()
        more[s[reached]] = True
        if (more == reached).all():
            break
        reached = more
        s = s[s]
    out = []
    for (o, n), first, (starts, ends) in zip(spans, begins, parts, strict=True):
        if not n:
            out.append([])
            continue
        cuts = np.flatnonzero(reached[o : o + n + 1])
        out.append([(int(starts[first[a]]), int(ends[b - 1]), int(starts[min(a, n - 1)])) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
    return out


def _splitter(max_tokens: int, max_chars: int, overlap_tokens: int):
    names = [f.name for f in _PIECE_SCHEMA]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                rows = []
                for i, text, pieces in zip(ids, texts, split_offsets(texts, max_tokens, max_chars, overlap_tokens), strict=True):
                    rows += [(i, k, len(pieces), s, e, f, text[s:e]) for k, (s, e, f) in enumerate(pieces)]
                columns = list(zip(*rows, strict=True)) or [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.string()), strict=True)], names=names)

    return run


def split_oversized(df: DataFrame, row_id: str = "seq", text: str = "text", keep: tuple[str, ...] = ("heading",), max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS, overlap_tokens: int = OVERLAP_TOKENS) -> DataFrame:
    """Pieces of the rows whose text exceeds a limit; smaller rows give none.

    Columns: the row id, the ``keep`` columns, piece_no (from 0), pieces,
    start and stop (code points in the text), fresh_from (where the piece
    stops repeating the one before), piece. Null and blank texts give no
    rows. Row ids need not be unique: repeated rows are split each on its own,
    their pieces carry the same id.
    """
    big = df.filter(oversized(F.col(text), max_tokens, max_chars))
    rows = big.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("body"), *[F.col(c).alias(f"k_{c}") for c in keep])
    if not keep:
        return rows.select("row_id", "body").mapInArrow(_splitter(max_tokens, max_chars, overlap_tokens), _PIECE_SCHEMA).withColumnRenamed("row_id", row_id)
    # what is kept travels with the text, so no join is needed afterwards
    schema = T.StructType([*_PIECE_SCHEMA.fields, *[rows.schema[f"k_{c}"] for c in keep]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = _splitter(max_tokens, max_chars, overlap_tokens)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                b = batch.slice(at, 256)
                position = pa.array(range(b.num_rows), pa.int64())
                for got in split(iter([pa.RecordBatch.from_arrays([position, b.column(1)], names=["row_id", "body"])])):
                    took = got.column(0)
                    yield pa.RecordBatch.from_arrays([b.column(0).take(took), *[got.column(k) for k in range(1, got.num_columns)], *[b.column(2 + k).take(took) for k in range(len(keep))]], names=[f.name for f in schema])

    out = rows.mapInArrow(run, schema)
    return out.select(F.col("row_id").alias(row_id), *[F.col(f"k_{c}").alias(c) for c in keep], *[f.name for f in _PIECE_SCHEMA.fields[1:]])
