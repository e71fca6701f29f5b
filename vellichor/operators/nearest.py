"""Exact nearest neighbours by cosine: a stated set of queries against all rows, in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 4096


def nearest(vectors: DataFrame, queries: DataFrame, key: str = "vec_id", vector: str = "embedding", top: int = 5, decimals: int = 6) -> DataFrame:
    """(query, key, cosine, rank): the ``top`` rows most like each query, the query's own row left out.

    Queries are broadcast in blocks of 4096 vectors; every task keeps only the
    best of each query among its rows before anything is shuffled. Ties by
    key, on rounded cosines. Vectors without length are like nothing; all
    vectors need the dimension of the queries.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and k is not null")
    asked = queries.select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and k is not null")
    out = None
    it = asked.orderBy("k").toLocalIterator(prefetchPartitions=False)
    blocks: list[tuple[np.ndarray, np.ndarray]] = []
    ids, vs = [], []
    for r in it:
        ids.append(r["k"])
        vs.append(r["v"])
        if len(ids) == BLOCK:
            blocks.append((np.array(ids), np.array(vs)))
            ids, vs = [], []
    if ids:
        blocks.append((np.array(ids), np.array(vs)))
    for q, m in blocks:
        n = np.linalg.norm(m, axis=1)
        unit = np.divide(m, n[:, None], out=np.zeros_like(m), where=n[:, None] > 0)
        shared = spark.sparkContext.broadcast((q, unit))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            q, unit = shared.value
            best: dict[str, np.ndarray] | None = None
            for b in batches:
                if not b.num_rows:
                    continue
                k = b.column(0).to_numpy()
                v = b.column(1).flatten().to_numpy().reshape(len(k), -1)
                n = np.linalg.norm(v, axis=1)
                v = np.divide(v, n[:, None], out=np.zeros_like(v), where=n[:, None] > 0)
                c = np.round(unit @ v.T, decimals)
                c[q[:, None] == k[None, :]] = -np.inf
                c[:, n == 0] = -np.inf
                keys = np.broadcast_to(k, c.shape)
                if best is not None:
                    c, keys = np.hstack([best["c"], c]), np.hstack([best["k"], keys])
                order = np.lexsort((keys, -c), axis=1)[:, :top]
                best = {"c": np.take_along_axis(c, order, 1), "k": np.take_along_axis(keys, order, 1)}
            if best is not None:
                ok = np.isfinite(best["c"])
                yield pa.RecordBatch.from_arrays([pa.array(np.broadcast_to(q[:, None], ok.shape)[ok]), pa.array(best["k"][ok]), pa.array(best["c"][ok])], names=["query", "key", "cosine"])

        part = rows.mapInArrow(run, "query long, key long, cosine double")
        out = part if out is None else out.unionAll(part)
    if out is None:
        out = spark.createDataFrame([], "query long, key long, cosine double")
    w = Window.partitionBy("query").orderBy(F.desc("cosine"), "key")
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
