"""How well retrieval finds what questions expect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellichor.functions import text as X
from vellichor.operators.quality import ratio


def judge(hits: DataFrame, questions: DataFrame) -> DataFrame:
    """(qid, hits, found_terms, wanted_terms, found_files, wanted_files, term_hit, file_hit, precision): per question.

    ``questions`` has qid, expected_terms, expected_files (either may be null
    or empty). A file is found where a hit's path is it or ends with it; a
    term where it is part of the heading, path, text or terms of any hit. What
    nothing is expected of is null.
    """
    low = F.lower(F.concat_ws("\n", "heading", "path", "text", F.array_join("terms", " ")))
    h = hits.groupBy("qid").agg(F.count(F.lit(1)).alias("hits"), F.concat_ws("\n", F.collect_list(low)).alias("all_text"), F.collect_list(X.posix_path("path")).alias("paths"))
    empty = F.array().cast("array<string>")
    q = questions.select("qid", F.coalesce("expected_terms", empty).alias("et"), F.transform(F.coalesce("expected_files", empty), X.posix_path).alias("ef"))
    j = q.join(h, "qid", "left").withColumn("paths", F.coalesce("paths", empty)).withColumn("all_text", F.coalesce("all_text", F.lit("")))
    is_file = lambda p, f: (p == f) | F.endswith(p, F.concat(F.lit("/"), f))
    terms = F.size(F.filter("et", lambda t: F.contains(F.col("all_text"), F.lower(t))))
    files = F.size(F.filter("ef", lambda f: F.exists("paths", lambda p: is_file(p, f))))
    good = F.size(F.filter("paths", lambda p: F.exists("ef", lambda f: is_file(p, f))))
    return j.select(
        "qid", F.coalesce("hits", F.lit(0)).alias("hits"), terms.alias("found_terms"), F.size("et").alias("wanted_terms"), files.alias("found_files"), F.size("ef").alias("wanted_files"),
        F.when(F.size("et") > 0, terms > 0).alias("term_hit"), F.when(F.size("ef") > 0, files > 0).alias("file_hit"), F.when((F.size("ef") > 0) & (F.size("paths") > 0), ratio(good, F.size("paths"))).alias("precision"),
    )


def summarize(judged: DataFrame) -> DataFrame:
    """One row: rates over the questions that expect something, nulls left out."""
    return judged.agg(
        F.count(F.lit(1)).alias("questions"), F.round(F.avg(F.col("term_hit").cast("int")), 4).alias("term_hit_rate"), F.round(F.avg(F.col("file_hit").cast("int")), 4).alias("file_hit_rate"),
        ratio(F.sum("found_terms"), F.sum("wanted_terms")).alias("term_recall"), ratio(F.sum("found_files"), F.sum("wanted_files")).alias("file_recall"), F.round(F.avg("precision"), 4).alias("precision"),
    )
