"""Boxes on pages: areas, overlaps, reading order, captions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions import text as X


def area(b: Column) -> Column:
    return F.greatest(F.lit(0.0), b["x1"] - b["x0"]) * F.greatest(F.lit(0.0), b["y1"] - b["y0"])


def intersection(a: Column, b: Column) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    return w * F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))


def overlap_share(a: Column, b: Column) -> Column:
    """Intersection over the smaller area; 0 for empty boxes."""
    return F.coalesce(F.try_divide(intersection(a, b), F.least(area(a), area(b))), F.lit(0.0))


def axis_gap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.greatest(a0, b0) - F.least(a1, b1))


def matching_tables(blocks: DataFrame, least: float = 0.35) -> DataFrame:
    """(path, page_number, block_id, table_id, overlap): for each text block the table that covers it best, each table once.

    Blocks meet tables of their own page only; ties by id.
    """
    b = blocks.filter("bbox is not null and page_number is not null").withColumn("kind", F.lower(F.trim("block_type")))
    text = b.filter("kind = 'text'").select("path", "page_number", "block_id", F.col("bbox").alias("a"))
    table = b.filter("kind = 'table'").select("path", "page_number", F.col("block_id").alias("table_id"), F.col("bbox").alias("t"))
    both = text.join(table, ["path", "page_number"]).withColumn("overlap", overlap_share(F.col("a"), F.col("t"))).filter(F.col("overlap") >= least)
    w1 = Window.partitionBy("block_id").orderBy(F.desc("overlap"), "table_id")
    w2 = Window.partitionBy("table_id").orderBy(F.desc("overlap"), "block_id")
    return both.withColumn("r1", F.row_number().over(w1)).filter("r1 = 1").withColumn("r2", F.row_number().over(w2)).filter("r2 = 1").select("path", "page_number", "block_id", "table_id", F.round("overlap", 4).alias("overlap"))


def figure_captions(blocks: DataFrame) -> DataFrame:
    """(path, page_number, figure_id, caption_id, distance): the text block nearest to each figure that starts like a caption.

    Blocks below a figure are preferred: one above has a hundred points added.
    """
    b = blocks.filter("bbox is not null and page_number is not null").withColumn("kind", F.lower(F.trim("block_type")))
    fig = b.filter("kind = 'figure'").select("path", "page_number", F.col("block_id").alias("figure_id"), F.col("bbox").alias("f"))
    cap = b.filter(F.col("text").rlike(r"(?i)^\s*(?:supplementary\s+)?fig(?:ure)?\.?\s*S?\d")).select("path", "page_number", F.col("block_id").alias("caption_id"), F.col("bbox").alias("c"))
    gap = axis_gap(F.col("f.y0"), F.col("f.y1"), F.col("c.y0"), F.col("c.y1"))
    both = fig.join(cap, ["path", "page_number"]).withColumn("distance", gap + F.when(F.col("c.y0") < F.col("f.y0"), 100.0).otherwise(0.0))
    w = Window.partitionBy("figure_id").orderBy("distance", "caption_id")
    return both.withColumn("r", F.row_number().over(w)).filter("r = 1").select("path", "page_number", "figure_id", "caption_id", F.round("distance", 4).alias("distance"))


def page_traits(blocks: DataFrame, pages: int = 6) -> DataFrame:
    """(path, text_chars, figure_share, scanned_like): what the first pages of a file are made of."""
    b = blocks.filter(F.col("page_number") <= pages).withColumn("kind", F.lower(F.trim("block_type")))
    g = b.groupBy("path").agg(F.coalesce(F.sum(F.regexp_count("text", F.lit("[A-Za-z0-9]"))), F.lit(0)).alias("text_chars"), F.sum((F.col("kind") == "figure").cast("int")).alias("figures"), F.count(F.lit(1)).alias("blocks"))
    return g.select("path", "text_chars", F.round(F.col("figures") / F.col("blocks"), 4).alias("figure_share"), ((F.col("text_chars") < 100) & (F.col("figures") > 0)).alias("scanned_like"))


def render_blocks(blocks: DataFrame) -> DataFrame:
    """(path, body): the blocks of each file as Markdown, in page and block order; repeated deliveries once, by text and place."""
    kind = F.lower(F.trim("block_type"))
    t = F.when(kind == "table", F.coalesce(F.col("text"), F.lit(""))).when(kind == "formula", F.concat(F.lit("$$\n"), F.coalesce("latex", "text"), F.lit("\n$$"))).when(kind == "figure", F.concat(F.lit("!["), F.coalesce("caption", F.lit("Figure")), F.lit("]("), F.coalesce("image_path", F.lit("")), F.lit(")"))).otherwise(X.strip("text"))
    b = blocks.select("path", "block_id", "page_number", "bbox", t.alias("t")).filter("t is not null and t <> ''")
    once = b.groupBy("path", "page_number", "bbox", "t").agg(F.min("block_id").alias("block_id"))
    return once.groupBy("path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("page_number", F.lit(0)).alias("p"), "block_id", "t"))), lambda x: x["t"]), "\n\n").alias("body"))
