"""Queries of the corpus-preparation operators, and SQL for those SQL can state.

Every query takes (spark, folder) and reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.llm import encoding_repair, leakage, mixing, scan_repair, splitting, term_counts, text_shape, truncation

Query = Callable[[SparkSession, str], DataFrame]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    marks = term_counts.term_marks(_t(spark, sf, "kg_chunks"))
    return marks.filter("mark is not null").select("field_name", "term_value", "mark")


def p1_counts(spark: SparkSession, sf: str) -> DataFrame:
    return term_counts.term_marks(_t(spark, sf, "kg_chunks"))


def _scanned(spark: SparkSession, sf: str, repair: bool) -> DataFrame:
    chunks = _t(spark, sf, "kg_chunks")
    # the type of a block is as dirty as the rest: its text tells whether it is laid out
    blocks = _t(spark, sf, "extraction_blocks")
    # a chunk and a block of the same page are not a recurrence
    chunk_of, block_of = F.concat(F.lit("kg_chunks:"), "doc_id"), F.concat(F.lit("extraction_blocks:"), "path")
    placed = chunks.select("text", chunk_of.alias("document"), F.col("id").cast("string").alias("part")).unionAll(blocks.select("text", block_of, F.col("block_id").cast("string")))
    lexicon = scan_repair.learn(placed, "text", "document", "part")
    a = scan_repair.scan_noise(chunks, lexicon, "seq", "text", repair, chunk_of).withColumn("table_name", F.lit("kg_chunks"))
    b = scan_repair.scan_noise(blocks, lexicon, "block_id", "text", repair, block_of).withColumn("table_name", F.lit("extraction_blocks"))
    return a.unionByName(b)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(spark, sf, False).select("table_name", "row_key", "noise")


def p2_repaired(spark: SparkSession, sf: str) -> DataFrame:
    return _scanned(spark, sf, True).select("table_name", "row_key", "noises", "repaired")


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return text_shape.shapes(_t(spark, sf, "kg_chunks")).filter("shape <> 'prose'").select("seq", "shape")


def p3_statistics(spark: SparkSession, sf: str) -> DataFrame:
    return text_shape.shapes(_t(spark, sf, "kg_chunks"))


def _damageable(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, encoding_repair.Mappings]:
    chunks, findings = _t(spark, sf, "kg_chunks"), _t(spark, sf, "audit_findings")
    texts = chunks.select("text").unionAll(findings.select(F.col("excerpt").alias("text")))
    return chunks, findings, encoding_repair.learn(texts)


def _damaged(spark: SparkSession, sf: str, restored: bool) -> DataFrame:
    chunks, findings, m = _damageable(spark, sf)
    a = encoding_repair.damaged_rows(chunks, m, "seq", "text", restored).withColumn("table_name", F.lit("kg_chunks"))
    b = encoding_repair.damaged_rows(findings, m, "finding_id", "excerpt", restored).withColumn("table_name", F.lit("audit_findings"))
    return a.unionByName(b)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return _damaged(spark, sf, False).select("table_name", "row_key")


def p4_restored(spark: SparkSession, sf: str) -> DataFrame:
    return _damaged(spark, sf, True).select("table_name", "row_key", "restored", "how")


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(_t(spark, sf, "kg_chunks")).filter("piece_no = 0").select("seq")


def p5_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(_t(spark, sf, "kg_chunks"))


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return leakage.leaks(_t(spark, sf, "documents"), _t(spark, sf, "eval_items"))


def _mixture(spark: SparkSession, sf: str) -> mixing.Mixture:
    return mixing.mix(_t(spark, sf, "documents"), _t(spark, sf, "mix_targets"))


def p7_mixture(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).records.withColumnRenamed("row_id", "doc_id")


def p7_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixture(spark, sf).shares()


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncated(_t(spark, sf, "documents")).filter("is_cut").select("doc_id")


def p8_sources(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.truncation_by_source(truncation.truncated(_t(spark, sf, "documents")))


_SPACE = r"[\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"
_NOT_SPACE = r"[^\s\x{000B}\x{001C}-\x{001F}\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"

_COUNTS = f"""
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM kg_chunks) WHERE rn = 1),
raw AS (
  SELECT id, 'terms' AS field_name, unnest(terms) AS v FROM latest UNION ALL
  SELECT id, 'citations', unnest(citations) FROM latest),
clean AS (
  SELECT id, field_name, nfc_normalize(lower(nfc_normalize(trim(regexp_replace(v, '{_SPACE}', ' ', 'g'))))) AS term_value FROM raw WHERE v IS NOT NULL),
counted AS (
  SELECT field_name, term_value, count(*) AS occurrences, count(DISTINCT id) AS records FROM clean WHERE term_value <> '' GROUP BY ALL),
marked AS (
  SELECT *, CASE WHEN records <= 2 THEN 'rare' WHEN records > 0.05 * (SELECT count(*) FROM latest) THEN 'common' END AS mark FROM counted)
"""


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_counts": p1_counts, "p2_found": p2_found, "p2_repaired": p2_repaired, "p3_found": p3_found, "p3_statistics": p3_statistics, "p4_found": p4_found, "p4_restored": p4_restored, "p5_found": p5_found, "p5_pieces": p5_pieces, "p6_found": p6_found, "p7_mixture": p7_mixture, "p7_shares": p7_shares, "p8_found": p8_found, "p8_sources": p8_sources}


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _COUNTS + "SELECT field_name, term_value, mark FROM marked WHERE mark IS NOT NULL",
        "p1_counts": _COUNTS + "SELECT field_name, term_value, occurrences, records, mark FROM marked",
        "p5_found": f"SELECT seq FROM kg_chunks WHERE length(text) > 4250 OR greatest(1, len(regexp_extract_all(text, '{_NOT_SPACE}')) * 4 // 3) > 850",
    }
