"""Artifacts of an index on disk, and sidecars of converted files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.operators import quality, structure

VERSION = 1
REQUIRED = ("id", "doc_id", "path", "heading", "ordinal", "text", "tokens")


def write_index(index, folder: str) -> None:
    """Writes chunks, nodes, edges, sparse tables and vectors; the manifest last, so that a broken write is no index."""
    index.chunks.write.mode("overwrite").parquet(f"{folder}/chunks")
    index.documents.write.mode("overwrite").parquet(f"{folder}/documents")
    index.nodes.write.mode("overwrite").parquet(f"{folder}/nodes")
    index.edges.write.mode("overwrite").partitionBy("type").parquet(f"{folder}/edges")
    index.sparse.write(f"{folder}/sparse")
    if index.embeddings is not None:
        index.embeddings.write.mode("overwrite").parquet(f"{folder}/embeddings")
    spark = index.chunks.sparkSession
    spark.createDataFrame([(VERSION, index.embeddings is not None)], "version int, embeddings boolean").coalesce(1).write.mode("overwrite").json(f"{folder}/manifest")


def read_index(spark: SparkSession, folder: str):
    """An index written before; another version or missing columns are errors."""
    from vellichor.operators.lexical import SparseIndex
    from vellichor.operators.retrieval import ChunkIndex

    m = spark.read.schema("version int, embeddings boolean").json(f"{folder}/manifest").first()
    if m is None or m["version"] != VERSION:
        raise ValueError("unsupported index version")
    r = spark.read
    chunks = r.parquet(f"{folder}/chunks")
    if missing := [c for c in REQUIRED if c not in chunks.columns]:
        raise ValueError(f"chunks lack {missing}")
    return ChunkIndex(chunks, r.parquet(f"{folder}/documents"), SparseIndex.read(spark, f"{folder}/sparse"), r.parquet(f"{folder}/nodes"), r.parquet(f"{folder}/edges"), r.parquet(f"{folder}/embeddings") if m["embeddings"] else None)


def sidecars(df: DataFrame, path: str = "path", body: str = "body") -> DataFrame:
    """(path, structure, quality): JSON of what each text is made of and what the rules found in it."""
    parts = structure.elements(df, path, body).groupBy(path).agg(F.to_json(F.array_sort(F.collect_list(F.struct("line", "kind", "value")))).alias("structure"))
    found = quality.scan(df, path, body).groupBy(path).agg(F.to_json(F.array_sort(F.collect_list(F.struct("line", "rule", "excerpt")))).alias("quality"))
    none = F.lit("[]")
    return df.select(path).join(parts, path, "left").join(found, path, "left").select(path, F.coalesce("structure", none).alias("structure"), F.coalesce("quality", none).alias("quality"))


def multimodal_records(chunks: DataFrame) -> DataFrame:
    """(chunk_id, kind, place, label, retrieval_text) of the figures, then the tables of every chunk."""
    from vellichor.functions import text as X

    def of(column: str, kind: str, limit: int) -> DataFrame:
        return chunks.select(F.col("id").alias("chunk_id"), "heading", F.posexplode(column).alias("place", "label")).select("chunk_id", F.lit(kind).alias("kind"), "place", "label", X.compact(F.concat_ws("\n", "heading", "label"), limit).alias("retrieval_text"))

    return of("figures", "figure", 1600).unionByName(of("table_records", "table", 1200))
