"""The sparse index: postings, document frequencies, lengths; BM25 over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions import text as X

K1, B = 1.5, 0.75


def exploded_tokens(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, term) for every token; the stop test is a hashed set after the explode, inside generated code."""
    words = df.select(F.col(key).alias("key"), F.explode(X.raw_words(text)).alias("w")).select("key", F.lower("w").alias("w"))
    return words.filter(~F.col("w").isin(*X.STOP_WORDS)).select("key", F.btrim("w", F.lit("_+-")).alias("term"))


@dataclass
class SparseIndex:
    """postings (key, term, tf), lengths (key, length), frequencies (term, df)."""

    postings: DataFrame
    lengths: DataFrame
    frequencies: DataFrame

    @staticmethod
    def build(df: DataFrame, key: str, text: str) -> SparseIndex:
        tf = exploded_tokens(df, key, text).groupBy("key", "term").agg(F.count(F.lit(1)).alias("tf"))
        some = tf.groupBy("key").agg(F.sum("tf").alias("length"))
        lengths = df.select(F.col(key).alias("key")).distinct().join(some, "key", "left").fillna(0, ["length"])
        return SparseIndex(tf, lengths, tf.groupBy("term").agg(F.count(F.lit(1)).alias("df")))

    def write(self, path: str, buckets: int = 16) -> None:
        """Persists the tables, postings partitioned by a hash of the term so that a query reads few files."""
        self.postings.withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int")).repartition("bucket").sortWithinPartitions("term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
        self.lengths.write.mode("overwrite").parquet(f"{path}/lengths")
        self.frequencies.write.mode("overwrite").parquet(f"{path}/frequencies")

    @staticmethod
    def read(spark, path: str) -> SparseIndex:
        r = spark.read
        return SparseIndex(r.parquet(f"{path}/postings"), r.parquet(f"{path}/lengths"), r.parquet(f"{path}/frequencies"))

    def stats(self) -> DataFrame:
        """One row: documents, total and average length."""
        return self.lengths.agg(F.count(F.lit(1)).alias("documents"), F.coalesce(F.sum("length"), F.lit(0)).alias("total_length")).withColumn("average_length", F.col("total_length") / F.greatest("documents", F.lit(1)))

    def top_terms(self, per_key: int = 200) -> DataFrame:
        """The most frequent terms of each document; ties by the term."""
        w = Window.partitionBy("key").orderBy(F.desc("tf"), "term")
        return self.postings.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_key)


def query_terms(queries: DataFrame, qid: str = "qid", query: str = "query") -> DataFrame:
    """(qid, term, times): the tokens of each query, repeated ones counted."""
    return exploded_tokens(queries, qid, query).groupBy(F.col("key").alias("qid"), "term").agg(F.count(F.lit(1)).alias("times"))


def bm25(index: SparseIndex, queries: DataFrame, qid: str = "qid", query: str = "query") -> DataFrame:
    """(qid, key, score): BM25 of every document that shares a term with a query.

    Only postings of query terms are read; query terms are as few as the
    queries that were asked, so they may be broadcast by their measured size.
    """
    q = query_terms(queries, qid, query)
    n = index.stats()
    tf = index.postings.join(q, "term").join(index.frequencies, "term").join(index.lengths, "key")
    idf = F.log(1 + (F.col("documents") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.greatest("average_length", F.lit(1.0))))
    # the statistics are one row
    return tf.join(F.broadcast(n)).select("qid", "key", (F.col("times") * idf * part).alias("s")).groupBy("qid", "key").agg(F.sum("s").alias("score"))


def top_hits(scores: DataFrame, limit: int, key: str = "key", score: str = "score", decimals: int = 4) -> DataFrame:
    """The best of each query by rounded score, ties by key; with ``rank``."""
    rounded = scores.withColumn(score, F.round(score, decimals)).filter(F.col(score) > 0)
    w = Window.partitionBy("qid").orderBy(F.desc(score), key)
    return rounded.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= limit)
