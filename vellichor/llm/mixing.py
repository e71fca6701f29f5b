"""Mixing sources to target weights by Sainte-Laguë apportionment.

Texts are sized in tokens of a public tokenizer. Each source is hashed into
as many shards as its size asks for; within a shard its texts stand in a seeded order and are cut into
blocks of equal tokens. For each mix, blocks are allotted to sources by the
highest quotients weight / (2k + 1), a source at its cap of repeated blocks
stands aside; then to the shards of a source by the same rule over their
tokens. A shard's quota takes all its blocks as often as they go in whole,
and a seeded run of blocks for the rest.

Sizes are computed once and kept; the texts themselves are never shuffled.
The driver apportions one number per (mix, source, shard), whose count is
bounded by the targets and MAX_SHARDS.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellichor.llm.truncation import source_key
from vellichor.plans.lineage import materialize

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How byte-level BPE splits a text before merging. Fixed value.
SPLIT_PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
BLOCK_TOKENS = 512
SHARD_TOKENS = 5_000_000
#: The most shards of all sources of the targets. Beyond MAX_SHARDS x SHARD_TOKENS tokens (41 billion) shards grow instead;
#: a shard is one window partition of (id, tokens) rows, without texts.
MAX_SHARDS = 8192
SEED = 17


@lru_cache(maxsize=2)
def tokenizer(path: str):
    """The tokenizer of a .tiktoken file, with its strings of special tokens as ordinary text."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("public", pat_str=SPLIT_PATTERN, mergeable_ranks=ranks, special_tokens={})


def _sizer(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(path).encode_ordinary
        for b in batches:
            n = [len(encode(t)) if len(t) < 100_000 else _long(encode, t) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64())], names=["row_id", "source_name", "tokens"])

    return run


def _long(encode, text: str) -> int:
    """Tokens of a very long text, summed over what its pattern splits: merges never cross these pieces."""
    return sum(len(encode(m.group())) for m in _pieces().finditer(text))


@lru_cache(maxsize=1)
def _pieces():
    import regex

    return regex.compile(SPLIT_PATTERN)


def sainte_lague(weights: np.ndarray, total: int, caps: np.ndarray) -> np.ndarray:
    """Seats by highest quotients weight / (2 seats + 1), none above its cap.

    Ties go to the earlier entry, quotients compared as computed. Fewer than ``total`` seats are given only
    where all caps are reached; entries without weight get none.
    """
    weights = np.asarray(weights, float)
    caps = np.where(weights > 0, np.asarray(caps, np.int64), 0)
    total = int(min(total, caps.sum()))
    if total <= 0:
        return np.zeros(len(weights), np.int64)

    def given(q: float) -> np.ndarray:
        """Seats whose quotients exceed ``q``."""
        return np.minimum(caps, np.maximum(0, np.ceil((weights / q - 1) / 2)).astype(np.int64))

    low, high = weights[weights > 0].min() / (2.0 * caps.max() + 3), weights.max()
    for _ in range(200):
        q = (low + high) / 2
        if given(q).sum() > total:
            low = q
        else:
            high = q
    seats = given(high)
    # ties at the last quotient
    for _ in range(total - int(seats.sum())):
        seats[int(np.where(seats < caps, weights / (2 * seats + 1), -1.0).argmax())] += 1
    return seats


def token_sizes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer_path: str = TOKENIZER) -> DataFrame:
    """(row_id, source_name, tokens) of every row with a source and a text that is not empty."""
    rows = docs.select(F.col(doc_id).cast("long").alias("row_id"), source_key(F.col(source)).alias("source_name"), F.col(text).alias("t")).filter("source_name is not null and length(t) > 0")
    return rows.mapInArrow(_sizer(tokenizer_path), "row_id long, source_name string, tokens long")


def quotas(sizes: list[tuple[str, int, int]], targets: list[tuple[str, str, float, int]], block_tokens: int, total_tokens: int | None) -> tuple[list[tuple], list[tuple]]:
    """Quotas per (mix, source, shard) and targets per (mix, source).

    ``sizes`` has (source, shard, tokens), ``targets`` (mix, source, weight,
    repeats). Without ``total_tokens`` a mix is as large as its targets can be
    met without a source going over its cap. A source whose repeats do not
    fill one block cannot be met in blocks: it does not size the mix and gives
    what it has, at most as often as it may be repeated.
    """
    by: dict[str, list[tuple[int, int]]] = {}
    for s, shard, tokens in sorted(sizes):
        by.setdefault(s, []).append((shard, tokens))
    blocks = {s: [max(1, round(t / block_tokens)) for _, t in rows] for s, rows in by.items()}
    rows, report = [], []
    for mix in sorted({m for m, *_ in targets}):
        mine = sorted((s, w, r) for m, s, w, r in targets if m == mix)
        whole = sum(w for _, w, _ in mine) or 1.0
        weights = np.array([w if s in by and r > 0 else 0.0 for s, w, r in mine])
        have = np.array([sum(t for _, t in by.get(s, [])) for s, _, _ in mine], float)
        caps = np.array([int(h * r // block_tokens) if w else 0 for h, (_, _, r), w in zip(have, mine, weights, strict=True)], np.int64)
        small = (weights > 0) & (caps == 0)
        ok = (weights > 0) & ~small
        caps = np.where(small, [r for _, _, r in mine], caps)
        if total_tokens is not None:
            total = total_tokens // block_tokens
        elif ok.any():
            each = (caps[ok] / weights[ok]).min()
            total = int(np.floor(each * weights[ok].sum())) + int(np.minimum(caps, np.floor(each * weights))[small].sum())
        else:
            total = int(caps.sum())
        seats = sainte_lague(weights, total, caps) if weights.sum() else np.zeros(len(mine), np.int64)
        for (s, w, r), q, h in zip(mine, seats, have, strict=True):
            report.append((mix, s, float(w), float(w) / whole, int(r), int(h), int(q)))
            if not q:
                continue
            size = np.array([t for _, t in by[s]], float)
            n = np.array(blocks[s], np.int64)
            part = sainte_lague(size, int(q), n * r)
            rows += [(mix, s, shard, int(x), int(k), int(t)) for (shard, t), x, k in zip(by[s], part, n, strict=True) if x]
    return rows, report


_QUOTA = T.StructType([T.StructField("mix_name", T.StringType()), T.StructField("source_name", T.StringType()), T.StructField("shard", T.IntegerType()), T.StructField("quota", T.LongType()), T.StructField("blocks", T.LongType()), T.StructField("shard_tokens", T.LongType())])
_REPORT = T.StructType([T.StructField("mix_name", T.StringType()), T.StructField("source_name", T.StringType()), T.StructField("target_weight", T.DoubleType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType()), T.StructField("available_tokens", T.LongType()), T.StructField("quota_blocks", T.LongType())])


class Mixture:
    """The mixed records of every mix, and what share each source really has."""

    def __init__(self, records: DataFrame, report: DataFrame):
        self.records, self._report = records, report

    def shares(self) -> DataFrame:
        """Target and actual share of each source of each mix, in tokens."""
        got = self.records.groupBy("mix_name", "source_name").agg(F.sum("tokens").alias("mixed_tokens"), F.countDistinct("row_id").alias("documents"), F.max("repeat_no").alias("most_repeats"))
        got = self._report.join(got, ["mix_name", "source_name"], "left").fillna(0, ["mixed_tokens", "documents", "most_repeats"])
        all_ = got.groupBy("mix_name").agg(F.sum("mixed_tokens").alias("mix_tokens"))
        return got.join(F.broadcast(all_), "mix_name").withColumn("actual_share", F.when(F.col("mix_tokens") > 0, F.col("mixed_tokens") / F.col("mix_tokens")).otherwise(0.0))


def mix(docs: DataFrame, targets: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", tokenizer_path: str = TOKENIZER, block_tokens: int = BLOCK_TOKENS, total_tokens: int | None = None, seed: int = SEED) -> Mixture:
    """Combines the rows of each mix in ``targets`` (mix_name, source_name, target_weight, max_repeats).

    records: mix_name, source_name, row_id, repeat_no (1 is the first), tokens.
    Rows without a source or text take no part; spellings of a source that
    differ in case, blanks, ``_`` or ``-`` are one. Targets with a null name,
    without positive weight or repeats get nothing, of repeated targets the
    weights add up and the most repeats hold. Rows with the same id are rows
    of their own, in one shard.
    """
    spark = docs.sparkSession
    sized = materialize(token_sizes(docs, doc_id, text, source, tokenizer_path).filter("tokens > 0"), "token-sizes")
    order = F.xxhash64(F.lit(seed), "row_id")
    t = targets.select(F.col("mix_name").cast("string"), source_key(F.col("source_name")).alias("source_name"), F.col("target_weight").cast("double").alias("w"), F.col("max_repeats").cast("int").alias("r")).filter("mix_name is not null and source_name is not null")
    wanted = [(r[0], r[1], r[2], r[3]) for r in t.groupBy("mix_name", "source_name").agg(F.coalesce(F.sum(F.greatest("w", F.lit(0.0))), F.lit(0.0)), F.coalesce(F.max("r"), F.lit(1))).collect()]
    # named sources only: as many as there are targets
    named = F.broadcast(spark.createDataFrame([(s,) for s in sorted({s for _, s, _, _ in wanted})] or [("",)], "source_name string"))
    large = {r[0]: r[1] for r in sized.join(named, "source_name", "left_semi").groupBy("source_name").agg(F.sum("tokens")).collect()}
    each = max(SHARD_TOKENS, sum(large.values()) // MAX_SHARDS + 1)
    shards = F.broadcast(spark.createDataFrame([(s, int(-(-n // each))) for s, n in large.items()] or [("", 1)], "source_name string, shards int"))
    placed = sized.join(shards, "source_name").withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "row_id"), F.col("shards")).cast("int")).drop("shards")
    sizes = [(r[0], r[1], r[2]) for r in placed.groupBy("source_name", "shard").agg(F.sum("tokens")).collect()]
    rows, report = quotas(sizes, wanted, block_tokens, total_tokens)
    quota = spark.createDataFrame(rows, _QUOTA)
    # tokens before each row within its shard, in seeded order
    w = Window.partitionBy("source_name", "shard").orderBy(order, "row_id").rowsBetween(Window.unboundedPreceding, -1)
    ordered = placed.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    picked = ordered.join(F.broadcast(quota), ["source_name", "shard"])
    # a row belongs to the block in which its middle lies
    middle = F.col("before") + F.col("tokens") / 2
    block = F.least(F.floor(middle * F.col("blocks") / F.col("shard_tokens")), F.col("blocks") - 1)
    offset = F.pmod(F.xxhash64(F.lit(seed + 2), "mix_name", "source_name", "shard"), F.col("blocks"))
    whole = F.floor(F.col("quota") / F.col("blocks"))
    extra = F.when(F.pmod(block + offset, F.col("blocks")) < F.col("quota") % F.col("blocks"), 1).otherwise(0)
    records = picked.withColumn("copies", (whole + extra).cast("int")).filter("copies > 0").withColumn("repeat_no", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("mix_name", "source_name", "row_id", "repeat_no", "tokens")
    return Mixture(records, spark.createDataFrame(report, _REPORT))
