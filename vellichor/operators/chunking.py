"""Markdown into sections, paragraphs and chunks."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions import text as X
from vellichor.operators.terms import terms_column
from vellichor.plans.lineage import materialize


def numbered_lines(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line, content): the lines of each text, numbered from 1."""
    return df.select(F.col(key), F.posexplode(X.lines(body)).alias("__n", "content")).select(key, (F.col("__n") + 1).alias("line"), "content")


def sections(df: DataFrame, key: str, body: str, first: str = "Overview") -> DataFrame:
    """(key, section, line, heading, content): each line below its nearest heading.

    Heading lines themselves are left out; lines before any heading belong to
    ``first``.
    """
    ln = numbered_lines(df, key, body).withColumn("content", F.regexp_replace("content", r"(?U)\s+\z", ""))
    ln = ln.withColumn("is_heading", F.col("content").rlike(X.HEADING))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    label = F.when(F.col("is_heading"), X.clean_label(F.regexp_extract("content", X.HEADING, 2)))
    ln = ln.withColumn("heading", F.coalesce(F.last(label, ignorenulls=True).over(w), F.lit(first))).withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    return ln.filter("not is_heading").select(key, "section", "line", "heading", "content")


def section_paragraphs(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, section, heading, paragraphs): the paragraphs of every section that has some."""
    ln = sections(df, key, body)
    blank = X.strip("content") == ""
    w = Window.partitionBy(key, "section").orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    ln = ln.withColumn("paragraph", F.sum(blank.cast("int")).over(w)).filter(~blank)
    one = ln.groupBy(key, "section", "heading", "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", "content"))).alias("c"))
    one = one.select(key, "section", "heading", "paragraph", X.strip(F.array_join(F.transform("c", lambda x: x["content"]), "\n")).alias("t"))
    return one.groupBy(key, "section", "heading").agg(F.array_sort(F.collect_list(F.struct("paragraph", "t"))).alias("p")).select(key, "section", "heading", F.transform("p", lambda x: x["t"]).alias("paragraphs"))


def pack(parts: Column, max_tokens: int = 850) -> Column:
    """Parts joined by blank lines as long as tokens and characters (five a token) allow.

    A part that is too large by itself stays whole.
    """
    flushed = F.aggregate(
        parts,
        F.struct(F.array().cast("array<string>").alias("out"), F.lit(None).cast("string").alias("buf")),
        lambda acc, p: F.when(acc["buf"].isNull(), F.struct(acc["out"].alias("out"), p.alias("buf")))
        .when(
            (X.rough_tokens(F.concat_ws("\n\n", acc["buf"], p)) > max_tokens) | (F.length(F.concat_ws("\n\n", acc["buf"], p)) > 5 * max_tokens),
            F.struct(F.concat(acc["out"], F.array(acc["buf"])).alias("out"), p.alias("buf")),
        )
        .otherwise(F.struct(acc["out"].alias("out"), F.concat_ws("\n\n", acc["buf"], p).alias("buf"))),
        lambda acc: F.when(acc["buf"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["buf"]))),
    )
    return flushed


def chunk_markdown(df: DataFrame, key: str, path: str, body: str, max_tokens: int = 850, top_terms: int = 14) -> DataFrame:
    """Chunks of Markdown texts with everything extracted from them.

    Front matter is left out. Columns: id, doc_id, path, heading, ordinal,
    text, tokens, terms, citations, links, figures, table_records, modalities.
    Null and empty texts give no chunks.
    """
    src = df.select(F.col(key).alias("k"), F.col(path).alias("path"), X.without_front_matter(F.col(body)).alias("b")).filter("b is not null")
    packed = section_paragraphs(src.select("k", "b"), "k", "b").select("k", "section", "heading", F.posexplode(pack(F.col("paragraphs"), max_tokens)).alias("part", "raw"))
    w = Window.partitionBy("k").orderBy("section", "part")
    raw = packed.withColumn("ordinal", F.row_number().over(w)).join(src.select("k", "path"), "k")
    c = raw.select(
        "k",
        X.stable_id("doc", "path").alias("doc_id"),
        "path",
        "heading",
        "ordinal",
        X.clean_chunk_text("raw").alias("text"),
        X.figure_records("raw").alias("figures"),
        X.table_records("raw").alias("table_records"),
    )
    # the cleaned text is read by every column below
    c = materialize(c, "chunk-texts")
    c = c.withColumn("id", X.stable_id("chunk", F.concat_ws(":", "path", "ordinal", F.substring(F.sha1(F.substring("text", 1, 500).cast("binary")), 1, 12))))
    c = c.withColumn("citations", F.array_sort(F.array_distinct(X.citations("text")))).withColumn("links", F.array_sort(F.array_distinct(X.links("text"))))
    c = c.withColumn("modalities", F.array_compact(F.array(F.lit("text"), F.when(F.size("figures") > 0, "figure"), F.when(F.size("table_records") > 0, "table")))).withColumn("tokens", X.rough_tokens("text"))
    return c.withColumn("terms", terms_column("text", top_terms)).select("id", "doc_id", "path", "heading", "ordinal", "text", "tokens", "terms", "citations", "links", "figures", "table_records", "modalities")


# chunks of a size for conversion: blocks stay whole where they can


def _count(text: str) -> int:
    return len(text.split()) * 4 // 3


def markdown_blocks(body: str) -> list[str]:
    """Fenced code whole; headings, table rows, quotes and list items each on their own; else paragraphs."""
    import re

    single = re.compile(r"\s*(?:#{1,6}\s|\||>|[-*+]\s|\d+[.)]\s)")
    blocks: list[str] = []
    current: list[str] = []
    fence: str | None = None

    def close() -> None:
        if current and (t := "\n".join(current).strip()):
            blocks.append(t)
        current.clear()

    for line in body.split("\n"):
        mark = line.strip()[:3]
        if fence is not None:
            current.append(line)
            if mark == fence:
                fence = None
                close()
        elif mark in ("```", "~~~"):
            close()
            fence = mark
            current.append(line)
        elif not line.strip():
            close()
        elif single.match(line):
            close()
            current.append(line)
            if line.lstrip().startswith("#"):
                close()
        else:
            current.append(line)
    close()
    return blocks


def split_block(block: str, limit: int) -> list[str]:
    """Pieces of a block within the limit: by lines, else sentences, else commas, else words."""
    import re

    if _count(block) <= limit:
        return [block]
    for pattern, glue in ((r"\n", "\n"), (r"(?<=[.!?])\s+", " "), (r"(?<=,)\s+", " "), (r"\s+", " ")):
        parts = [p for p in re.split(pattern, block) if p.strip()]
        if len(parts) < 2:
            continue
        out: list[str] = []
        buffer: list[str] = []
        size = 0
        for p in parts:
            n = _count(p)
            if buffer and size + n > limit:
                out.append(glue.join(buffer))
                buffer, size = [], 0
            buffer.append(p)
            size += n
        if buffer:
            out.append(glue.join(buffer))
        if len(out) > 1:
            return [q for o in out for q in (split_block(o, limit) if _count(o) > limit else [o])]
    return [block]


def conversion_chunks(text: str, limit: int = 2000) -> list[str]:
    """A converted text in parts within the limit, each with the front matter on top."""
    if limit <= 0:
        return [text]
    front, body = "", text
    if text.startswith("---\n") and (at := text.find("\n---", 4)) > 0:
        end = text.find("\n", at + 1)
        front, body = (text[: end if end > 0 else len(text)], text[end:] if end > 0 else "")
    room = max(1, limit - _count(front))
    parts: list[str] = []
    buffer: list[str] = []
    size = 0
    for block in (q for b in markdown_blocks(body) for q in split_block(b, room)):
        n = _count(block)
        if buffer and size + n > room:
            parts.append("\n\n".join(buffer))
            buffer, size = [], 0
        buffer.append(block)
        size += n
    if buffer:
        parts.append("\n\n".join(buffer))
    return [f"{front}\n\n{p}" if front else p for p in parts] or [text]


def split_converted(df: DataFrame, key: str, body: str, limit: int = 2000) -> DataFrame:
    """(key, part, content): converted texts in parts, numbered from 1; null texts give none."""

    @F.pandas_udf("array<string>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: conversion_chunks(t, limit))

    return df.filter(F.col(body).isNotNull()).select(F.col(key), F.posexplode(cut(F.col(body))).alias("__n", "content")).select(key, (F.col("__n") + 1).alias("part"), "content")
