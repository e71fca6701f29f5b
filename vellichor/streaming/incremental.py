"""Streams of Markdown files: keeping an index and quality counts up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vellichor.operators import chunking, lexical, quality


def markdown_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """(path, body, seen): new Markdown files of a folder, once each."""
    s = spark.readStream.format("text").option("wholetext", "true").option("pathGlobFilter", "*.md").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch).load(folder)
    return s.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"), F.col("_metadata.file_modification_time").alias("seen"))


def findings_per_window(stream: DataFrame, window: str = "1 hour", late: str = "1 day") -> DataFrame:
    """(window_start, rule, n): findings of line rules by time, late files taken in up to the watermark."""
    lines = stream.withWatermark("seen", late).select("seen", F.posexplode(F.split("body", "\n")).alias("k", "content"))
    found = lines.select("seen", F.explode(quality.line_findings(F.col("content"), F.col("k") + 1)).alias("rule"))
    return found.groupBy(F.window("seen", window).alias("w"), "rule").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), "rule", "n")


def index_batches(stream: DataFrame, folder: str, checkpoint: str, then: Callable[[DataFrame, int], None] | None = None, **trigger) -> StreamingQuery:
    """Chunks every batch and writes chunks and postings under its number; a batch that is tried again replaces itself."""

    def each(batch: DataFrame, number: int) -> None:
        chunks = chunking.chunk_markdown(batch.select("path", F.col("path").alias("key"), "body"), "key", "path", "body")
        chunks.write.mode("overwrite").parquet(f"{folder}/chunks/batch={number}")
        done = batch.sparkSession.read.parquet(f"{folder}/chunks/batch={number}")
        lexical.SparseIndex.build(done, "id", "text").postings.write.mode("overwrite").parquet(f"{folder}/postings/batch={number}")
        if then is not None:
            then(done, number)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
