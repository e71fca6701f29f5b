"""Passages of evaluation items that leaked into a collection.

The items are cut into overlapping segments, so that every 15 of their words
lie within one. The segments form a sparse BM25 inverted index: for every term
its segments with their weights, and its blocks of segments with their
greatest weights. Every
document is cut into overlapping windows of words, each window is a query
answered by block-max WAND: the words of a segment are ordered by weight,
those that together stay below its threshold can't bring it up by themselves
and are skipped, the postings of the others, its pivots, lead to blocks. A
block is scored only if the sum of its maxima reaches the
least threshold of its segments, and every segment that reaches its own
threshold is a candidate. The threshold of a segment is the least score that 15 of its
words can have with two of them lost, so that no qualifying window is missed.
Candidates are verified by aligning words.

The index is broadcast; its bytes grow with the words of the items only and
are checked against a bound, beyond which it is split. The documents are read
once for each index and never shuffled.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STRETCH = 15
CHANGED = 2
INSERTED = 8
WINDOW = 48
#: Words from one segment of an item to the next; a segment has as many more than a stretch, less one.
SEGMENT_STEP = 8
BLOCK = 8
K1, B = 1.2, 0.75
#: The most bytes that are broadcast as one index (some 40,000 items of 64 words); more items are split into several.
MAX_INDEX_BYTES = 256_000_000
#: Bytes of a word of an item in the index: its number, a posting and a block posting.
WORD_BYTES = 100

_TAG = re.compile(r"</?[A-Za-z][^<>\n]{0,80}>|<!--.{0,200}?-->")
_LINK = re.compile(r"!?\[([^\]\[]{0,200})\]\([^()\s]{0,300}\)")
_MARK = re.compile(r"\[\^?[\d,;–\-\s]{1,24}\]|\[\^\w{1,20}\]|\\(?=\W)")
_NOTE = re.compile(r"(?<=[^\W\d_]{4})[¹²³⁰⁴-⁹]+")
_ENDS = re.compile(r"[-‐\xad¬](?<=[^\W\d_].)[ \t]*\r?\n\s*(?=[^\W\d_])")
_INNER = re.compile(r"[-‐‑\xad*_`](?<=[^\W\d_].)[-‐‑\xad*_`]*(?=[^\W\d_])")
_COMBINING = re.compile(r"[̀-ͯ]+")
_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Words without case, accents, markup, reference marks, ligatures and line-end hyphens; decimals are words of their own."""
    if "<" in text:
        text = _TAG.sub("", text)
    if "](" in text:
        text = _LINK.sub(r"\1", text)
    if "[" in text or "\\" in text:
        text = _MARK.sub(" ", text)
    if not text.isascii():
        text = _NOTE.sub("", text)
    if "\n" in text:
        text = _ENDS.sub("", text)
    text = _INNER.sub("", text)
    if not text.isascii():
        text = _COMBINING.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text.lower())


def _distinct(x: np.ndarray) -> np.ndarray:
    """Sorted distinct values; several times faster than a hash of them at these sizes."""
    x = np.sort(x)
    return x[np.concatenate([[True], x[1:] != x[:-1]])] if len(x) else x


class Index:
    """BM25 postings of segments of items by term, block maxima and thresholds; ``ids`` has the item of each segment."""

    def __init__(self, items: list[tuple[int, str]]):
        cut = lambda w: [w[a : a + STRETCH + SEGMENT_STEP - 1] for a in range(0, max(1, len(w) - STRETCH + 1), SEGMENT_STEP)]
        items = sorted((i, part) for i, t in items if t for w in [words_of(t)] if len(w) >= STRETCH for part in cut(w))
        df = Counter(t for _, w in items for t in set(w))
        self.terms = {t: k for k, t in enumerate(sorted(df))}
        n = len(items)
        mean = sum(len(w) for _, w in items) / n if n else 1.0
        rows = []
        for i, w in items:
            norm = K1 * (1 - B + B * len(w) / mean)
            score = {t: math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * tf * (K1 + 1) / (tf + norm) for t, tf in Counter(w).items()}
            least = math.inf
            for a in range(len(w) - STRETCH + 1):
                s = sorted(score[t] for t in set(w[a : a + STRETCH]))
                least = min(least, sum(s[: max(0, len(s) - CHANGED)]))
            numbers = np.array([self.terms[t] for t in w], np.int32)
            at = np.array([self.terms[t] for t in score], np.int64)
            weight = np.array(list(score.values()))
            lightest = np.argsort(weight, kind="stable")
            pivot = np.zeros(len(weight), bool)
            pivot[lightest[np.cumsum(weight[lightest]) >= least * 0.999]] = True
            rows.append((least * 0.999, i, numbers, at, weight, pivot))
        # blocks of items with like thresholds have tight bounds
        rows.sort(key=lambda r: (r[0], r[1]))
        self.threshold = np.array([r[0] for r in rows])
        self.ids = np.array([r[1] for r in rows], np.int64)
        self.words = [r[2] for r in rows]
        term = np.concatenate([r[3] for r in rows]) if rows else np.zeros(0, np.int64)
        item = np.repeat(np.arange(n), [len(r[3]) for r in rows]) if rows else np.zeros(0, np.int64)
        weight = np.concatenate([r[4] for r in rows]) if rows else np.zeros(0)
        order = np.lexsort((item, term))
        blocks = max(1, -(-n // BLOCK))
        self.n, self.blocks = n, blocks
        key = term[order] * blocks + item[order] // BLOCK
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        # block postings, block by block: its terms, and their weights in each of its segments; row 0 is for all other terms
        own, entry = key[first] % blocks, np.cumsum(np.concatenate([[True], key[1:] != key[:-1]])) - 1 if len(key) else np.zeros(0, np.int64)
        by = np.argsort(own, kind="stable")
        spot = np.empty(len(by), np.int64)
        spot[by] = np.arange(len(by))
        self.block_start = np.searchsorted(own[by], np.arange(blocks + 1))
        self.block_term = (key[first] // blocks)[by].astype(np.int32)
        self.weights = np.zeros((len(by), BLOCK), np.float32)
        self.weights[spot[entry], item[order] % BLOCK] = weight[order]
        self.block_max = self.weights.max(1) if len(by) else np.zeros(0, np.float32)
        pivots = np.concatenate([r[5] for r in rows])[order] if rows else np.zeros(0, bool)
        lead = np.unique(key[pivots])
        #: Blocks in which a term is a pivot, and where those of each term start.
        self.lead_block = (lead % blocks).astype(np.int32)
        self.lead_start = np.searchsorted(lead, np.arange(len(self.terms) + 1) * blocks)
        low = np.full(blocks * BLOCK, np.inf)
        low[:n] = self.threshold
        self.low = low.reshape(blocks, BLOCK)
        self.block_low = self.low.min(1)

    @property
    def nbytes(self) -> int:
        return sum(a.nbytes for a in (self.block_start, self.block_term, self.weights, self.block_max, self.lead_block, self.lead_start, self.low)) + sum(w.nbytes for w in self.words)

    def candidates(self, docs: list[list[int]]) -> list[tuple[int, int, int]]:
        """(document, first word, segment) of each window that reaches a segment's threshold; words are term numbers, -1 unknown."""
        if not len(self.ids) or not docs:
            return []
        step = WINDOW // 2
        lengths = np.array([len(d) for d in docs], np.int64)
        count = np.maximum(1, -(-np.maximum(lengths - step, 0) // step))
        first = np.concatenate([[0], np.cumsum(count)])
        tokens = np.concatenate([np.asarray(d, np.int64) for d in docs])
        doc = np.repeat(np.arange(len(docs)), lengths)
        pos = np.arange(len(tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        known = tokens >= 0
        tokens, doc, pos = tokens[known], doc[known], pos[known]
        late = np.minimum(pos // step, count[doc] - 1)
        early = late - 1
        both = (early >= 0) & (pos < early * step + WINDOW)
        window = np.concatenate([first[doc] + late, (first[doc] + early)[both]])
        pair = _distinct(window * len(self.terms) + np.concatenate([tokens, tokens[both]]))
        if not len(pair):
            return []
        window, term = pair // len(self.terms), pair % len(self.terms)
        starts = np.flatnonzero(np.concatenate([[True], window[1:] != window[:-1]]))
        sizes = np.diff(np.append(starts, len(window)))
        n = self.lead_start[term + 1] - self.lead_start[term]
        leads = np.flatnonzero(n)
        n = n[leads]
        out: list[tuple[int, int]] = []
        local = np.zeros(len(self.terms), np.int32)
        place = np.repeat(np.arange(len(starts)), sizes)
        ends = np.cumsum(n)
        at = 0
        while at < len(leads):
            end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 2_000_000)))
            # all leads of a window stay together
            while end < len(leads) and place[leads[end]] == place[leads[end - 1]]:
                end += 1
            part, m = leads[at:end], n[at:end]
            offset = np.concatenate([[0], np.cumsum(m)[:-1]])
            spot = np.repeat(self.lead_start[term[part]] - offset, m) + np.arange(m.sum())
            pivot = _distinct(np.repeat(place[part], m) * self.blocks + self.lead_block[spot])
            out += [(int(window[starts[w]]), k) for w, k in self._score(pivot % self.blocks, pivot // self.blocks, starts, sizes, term, local)]
            at = end
        place_of = np.searchsorted(first, [g for g, _ in out], "right") - 1 if out else []
        return [(int(d), (g - int(first[d])) * step, k) for d, (g, k) in zip(place_of, out, strict=True)]

    def _score(self, block, w, starts, sizes, term, local) -> Iterator[tuple[int, int]]:
        """(window, segment) of the pivots that reach a segment's threshold; a block whose maxima stay below its least one is left."""
        order = np.argsort(block, kind="stable")
        block, w = block[order], w[order]
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
        for a, z in zip(cuts, [*cuts[1:], len(block)], strict=True):
            b, mine = int(block[a]), w[a:z]
            lo, hi = self.block_start[b], self.block_start[b + 1]
            local[self.block_term[lo:hi]] = np.arange(1, hi - lo + 1)
            n = sizes[mine]
            offset = np.concatenate([[0], np.cumsum(n)[:-1]])
            at = local[term[np.repeat(starts[mine] - offset, n) + np.arange(n.sum())]]
            local[self.block_term[lo:hi]] = 0
            bound = np.add.reduceat(np.concatenate([[0.0], self.block_max[lo:hi]])[at], offset)
            keep = np.flatnonzero(bound >= self.block_low[b])
            if not len(keep):
                continue
            inside = np.repeat(bound >= self.block_low[b], n)
            score = np.add.reduceat(np.vstack([np.zeros((1, BLOCK)), self.weights[lo:hi]])[at[inside]], np.concatenate([[0], np.cumsum(n[keep])[:-1]]), axis=0)
            for x, k in zip(*np.nonzero(score >= self.low[b]), strict=True):
                yield int(mine[keep[x]]), b * BLOCK + int(k)


def holds_stretch(doc: list, item: list) -> bool:
    """Whether 15 consecutive words of the item stand in the words, in order, at most two changed or missing and few put in between."""
    where: dict[object, list[int]] = {}
    for k, w in enumerate(doc):
        where.setdefault(w, []).append(k)
    n = len(item)
    present = np.array([w in where for w in item], np.int64)
    if n < STRETCH:
        return False
    sums = np.convolve(present, np.ones(STRETCH, np.int64), "valid")
    for a in np.flatnonzero(sums >= STRETCH - CHANGED):
        part = item[a : a + STRETCH]
        # each start is an occurrence of one of the first three words, as at most two are lost
        for lead in range(CHANGED + 1):
            for d in where.get(part[lead], ()):
                rest = doc[d : d + STRETCH + INSERTED - lead]
                if _common(part[lead:], rest) >= STRETCH - CHANGED:
                    return True
    return False


def _common(a: list, b: list) -> int:
    """Length of the longest common subsequence."""
    known = set(b)
    a = [w for w in a if w in known]
    if len(a) < STRETCH - CHANGED:
        return len(a)
    row = [0] * (len(b) + 1)
    for w in a:
        prev = 0
        for k, v in enumerate(b, 1):
            keep = row[k]
            row[k] = prev + 1 if v == w else (row[k] if row[k] >= row[k - 1] else row[k - 1])
            prev = keep
    return row[-1]


def _finder(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index: Index = shared.value
        get = index.terms.get
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                ids, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
                docs = [[get(w, -1) for w in words_of(t)] for t in texts]
                found: dict[tuple[int, int], bool] = {}
                for d, first, k in index.candidates(docs):
                    i = int(index.ids[k])
                    if not found.get((d, i)):
                        found[d, i] = holds_stretch(docs[d][first : first + WINDOW], index.words[k].tolist())
                hits = [(ids[d], i) for (d, i), ok in found.items() if ok]
                yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hits], pa.int64()), pa.array([h[1] for h in hits], pa.int64())], names=["doc_id", "item_id"])

    return run


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", passage: str = "passage") -> DataFrame:
    """(doc_id, item_id) of every document that holds a stretch of an item.

    Null and empty texts hold nothing; items of fewer than 15 words can't be
    found. Repeated documents and repeated items count on their own.
    """
    spark = documents.sparkSession
    rows = items.select(F.col(item_id).cast("long").alias("i"), F.col(passage).alias("p")).filter("i is not null and p is not null").orderBy("i", "p").toLocalIterator()
    parts: list[list[tuple[int, str]]] = [[]]
    size = 0
    for i, p in rows:
        size += WORD_BYTES * len(p.split())
        if parts[-1] and size > MAX_INDEX_BYTES:
            parts.append([])
            size = WORD_BYTES * len(p.split())
        parts[-1].append((i, p))
    docs = documents.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).filter(F.length("t") >= 2 * (STRETCH - CHANGED) - 1)
    out = None
    for rows in parts:
        part = docs.mapInArrow(_finder(spark.sparkContext.broadcast(Index(rows))), "doc_id long, item_id long")
        out = part if out is None else out.unionAll(part)
    return out.select(F.col("doc_id").alias(doc_id), F.col("item_id").alias(item_id))
