"""The typed property graph over documents and chunks.

Nodes: document, chunk, heading, term, citation, external_link, figure,
table, community. Edges: contains, under_heading, mentions, cites, links_to,
has_figure, has_table, related_to, member_of. ``chunk_nodes`` and
``chunk_edges`` give what single documents and chunks hold, ``topic_nodes`` and
``topic_edges`` what comes of comparing documents, ``nodes`` and ``edges`` all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions import text as X
from vellichor.operators.overlap import closest
from vellichor.plans.lineage import materialize

TOP_TERMS = 25
LEAST_SIMILARITY = 0.08
LEAST_OVERLAP = 3


def latest_chunks(chunks: DataFrame, key: str = "id", order: str = "seq") -> DataFrame:
    """One row per chunk: of repeated deliveries the last."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return chunks.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")


def _items(chunks: DataFrame, column: str) -> DataFrame:
    return chunks.select("id", "doc_id", "path", "seq", F.explode(F.filter(F.col(column), lambda x: x.isNotNull() & (F.trim(x) != ""))).alias("item"))


def chunk_nodes(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(id, type, label): every node of documents and chunks once, the first label by chunk order.

    ``documents`` has doc_id, title; ``chunks`` id, doc_id, path, heading,
    seq and the arrays terms, citations, links, figures, table_records.
    """
    doc = documents.select(F.col("doc_id").alias("id"), F.lit("document").alias("type"), F.col("title").alias("label"), F.lit(0).cast("long").alias("seq"))
    titles = documents.select("doc_id", "title")
    chunk = chunks.join(titles, "doc_id", "left").select("id", F.lit("chunk").alias("type"), F.coalesce(F.nullif(F.col("heading"), F.lit("")), "title").alias("label"), "seq")
    heading = chunks.filter("heading is not null and heading <> ''").select(X.stable_id("heading", F.concat_ws(":", "path", "heading")).alias("id"), F.lit("heading").alias("type"), F.col("heading").alias("label"), "seq")

    def of(column: str, kind: str, key: Column) -> DataFrame:
        return _items(chunks, column).select(X.stable_id(kind, key).alias("id"), F.lit(kind).alias("type"), F.col("item").alias("label"), "seq")

    own = F.concat_ws(":", "id", "item")
    parts = [of("terms", "term", F.col("item")), of("citations", "citation", F.lower("item")), of("links", "external_link", F.lower("item")), of("figures", "figure", own), of("table_records", "table", own)]
    all_ = doc.unionByName(chunk).unionByName(heading)
    for p in parts:
        all_ = all_.unionByName(p)
    return all_.groupBy("id", "type").agg(F.min(F.struct("seq", "label")).alias("m")).select("id", "type", F.col("m.label").alias("label"))


def document_items(chunks: DataFrame) -> DataFrame:
    """(doc_id, term, times, n): how often chunks of a document name a term, and how many of them. ``chunks`` has each id once."""
    named = F.filter("terms", lambda x: x.isNotNull() & (F.trim(x) != ""))
    # the first of a term in its chunk counts the chunk
    first = F.transform(named, lambda x, k: F.struct(x.alias("term"), (F.array_position(named, x) == k + 1).cast("int").alias("first")))
    once = F.size(F.array_distinct(named)) == F.size(named)
    rows = chunks.withColumn("__once", once)
    t = rows.filter("__once").select("doc_id", F.explode(named).alias("term"), F.lit(1).alias("first"))
    t = t.unionByName(rows.filter("not __once").select("doc_id", F.explode(first).alias("t")).select("doc_id", "t.term", "t.first"))
    return t.groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("times"), F.sum("first").alias("n"))


def apart(chunks: DataFrame) -> bool:
    """Whether no chunk has the id of a document."""
    return chunks.select("id").join(chunks.select(F.col("doc_id").alias("id")).distinct(), "id", "left_semi").isEmpty()


def chunk_edges(chunks: DataFrame, items: DataFrame | None = None, are_apart: bool | None = None) -> DataFrame:
    """(source, target, type, weight) of all edges that chunks give, weights added up.

    ``chunks`` has each id once, so edges of a chunk are added up within its
    row unless it repeats an item; ``items`` are ``document_items`` of them,
    ``are_apart`` is what ``apart`` says of them.
    """
    items = document_items(chunks) if items is None else items

    def summed(df: DataFrame, name: str, weight: Column) -> DataFrame:
        return df.groupBy("source", "target").agg(F.sum(weight).alias("weight")).select("source", "target", F.lit(name).alias("type"), "weight")

    def of(column: str, kind: str, name: str, key=lambda x: x) -> DataFrame:
        keys = F.transform(F.filter(F.col(column), lambda x: x.isNotNull() & (F.trim(x) != "")), key)
        rows = chunks.select(F.col("id").alias("source"), keys.alias("keys"))
        once = F.size(F.array_distinct("keys")) == F.size("keys")
        exploded = lambda some: rows.filter(some).select("source", F.explode("keys").alias("k"))
        target = X.stable_id(kind, "k" if column not in ("figures", "table_records") else F.concat_ws(":", "source", "k")).alias("target")
        return exploded(once).select("source", target, F.lit(name).alias("type"), F.lit(1.0).alias("weight")).unionByName(summed(exploded(~once).select("source", target), name, F.lit(1.0)))

    one = F.lit(1.0).alias("weight")
    contains = chunks.select(F.col("doc_id").alias("source"), F.col("id").alias("target"), F.lit("contains").alias("type"), one)
    under = chunks.filter("heading is not null and heading <> ''").select(F.col("id").alias("source"), X.stable_id("heading", F.concat_ws(":", "path", "heading")).alias("target"), F.lit("under_heading").alias("type"), one)
    by_doc = items.select(F.col("doc_id").alias("source"), X.stable_id("term", "term").alias("target"), F.lit("mentions").alias("type"), F.col("times").cast("double").alias("weight"))
    mentions = of("terms", "term", "mentions").unionByName(by_doc)
    if not (apart(chunks) if are_apart is None else are_apart):
        # a chunk has the id of a document; its mentions are one with those of the document
        mentions = summed(mentions, "mentions", F.col("weight"))
    all_ = contains.unionByName(under).unionByName(mentions)
    for p in (of("citations", "citation", "cites", F.lower), of("links", "external_link", "links_to", F.lower), of("figures", "figure", "has_figure"), of("table_records", "table", "has_table")):
        all_ = all_.unionByName(p)
    return all_


def document_terms(chunks: DataFrame, limit: int | None = None, items: DataFrame | None = None) -> DataFrame:
    """(doc_id, term, n, rank): in how many chunks of a document a term is; ranked by n, then the term."""
    t = (document_items(chunks) if items is None else items).select("doc_id", "term", "n")
    w = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    ranked = t.withColumn("rank", F.row_number().over(w))
    return ranked if limit is None else ranked.filter(F.col("rank") <= limit)


def similar_documents(chunks: DataFrame, top: int = TOP_TERMS, keep: int = 5, items: DataFrame | None = None) -> DataFrame:
    """(source, target, shared, jaccard): documents whose best terms overlap.

    Every pair with at least three shared terms is looked at, but none is
    written, see ``overlap.closest``. Per document the ``keep`` most similar
    of the later ones (by id) remain; ties by id.
    """
    t = document_terms(chunks, top, items).select("doc_id", "term")
    sets = materialize(t.groupBy("doc_id").agg(F.collect_list("term").alias("terms")), "document-terms")
    return closest(sets, "doc_id", "terms", keep, LEAST_OVERLAP, LEAST_SIMILARITY).withColumn("jaccard", F.round("jaccard", 4))


def communities(chunks: DataFrame, per_document: int = 8, count: int = 24, items: DataFrame | None = None) -> DataFrame:
    """(rank, label, documents, weight, cohesion): groups of documents around a shared top term.

    Ranked by documents, then the chunks that hold the term, then the label.
    """
    t = document_terms(chunks, per_document, items).filter((F.length("term") >= 4) & ~F.col("term").isin(*X.STOP_WORDS))
    total = chunks.select("doc_id").distinct().agg(F.count(F.lit(1)).alias("total"))
    g = t.groupBy(F.col("term").alias("label")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n").alias("weight")).filter("documents >= 2")
    # the best few only: a global limit, not a window over everything
    best = g.orderBy(F.desc("documents"), F.desc("weight"), "label").limit(count)
    w = Window.orderBy(F.desc("documents"), F.desc("weight"), "label")
    return best.withColumn("rank", F.row_number().over(w)).join(F.broadcast(total)).select("rank", "label", "documents", "weight", F.round(F.col("documents") / F.greatest("total", F.lit(1)), 4).alias("cohesion"))


def community_members(chunks: DataFrame, per_document: int = 8, count: int = 24, most: int = 4, items: DataFrame | None = None) -> DataFrame:
    """(doc_id, label, rank, weight): each document joins its best communities, at most ``most``."""
    t = document_terms(chunks, per_document, items).select("doc_id", F.col("term").alias("label"), F.col("n").alias("weight"))
    c = communities(chunks, per_document, count, items).select("label", "rank")
    w = Window.partitionBy("doc_id").orderBy("rank")
    return t.join(F.broadcast(c), "label").withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= most).select("doc_id", "label", "rank", "weight")


def topic_nodes(chunks: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(id, type, label) of the communities, which documents and chunks alone don't give."""
    return communities(chunks, items=items).select(X.stable_id("community", "label").alias("id"), F.lit("community").alias("type"), "label")


def topic_edges(chunks: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(source, target, type, weight): related_to by the share of common terms, member_of by the chunks that hold the term."""
    related = similar_documents(chunks, items=items).select("source", "target", F.lit("related_to").alias("type"), F.col("jaccard").alias("weight"))
    member = community_members(chunks, items=items).select(F.col("doc_id").alias("source"), X.stable_id("community", "label").alias("target"), F.lit("member_of").alias("type"), F.col("weight").cast("double").alias("weight"))
    return related.unionByName(member)


def nodes(documents: DataFrame, chunks: DataFrame, items: DataFrame | None = None) -> DataFrame:
    """(id, type, label): every node of the graph once. ``items`` are ``document_items`` of the chunks."""
    return chunk_nodes(documents, chunks).unionByName(topic_nodes(chunks, items))


def edges(chunks: DataFrame, items: DataFrame | None = None, are_apart: bool | None = None) -> DataFrame:
    """(source, target, type, weight) of all edges of the graph. ``chunks`` has each id once and is read several times."""
    items = materialize(document_items(chunks), "document-items") if items is None else items
    return chunk_edges(chunks, items, are_apart).unionByName(topic_edges(chunks, items))


def community_terms(chunks: DataFrame, chunks_per_document: int = 3, terms_per_chunk: int = 8, top: int = 12) -> DataFrame:
    """(label, term, n, place): what the first chunks of the members of a community mention most."""
    w = Window.partitionBy("doc_id").orderBy("ordinal", "id")
    head = chunks.withColumn("__k", F.row_number().over(w)).filter(F.col("__k") <= chunks_per_document)
    terms = head.select("doc_id", F.explode(F.slice(F.filter("terms", lambda x: x.isNotNull() & (F.trim(x) != "")), 1, terms_per_chunk)).alias("term"))
    n = community_members(chunks).select("doc_id", "label").join(terms, "doc_id").groupBy("label", "term").agg(F.count(F.lit(1)).alias("n"))
    best = Window.partitionBy("label").orderBy(F.desc("n"), "term")
    return n.withColumn("place", F.row_number().over(best)).filter(F.col("place") <= top)


def community_summaries(chunks: DataFrame) -> DataFrame:
    """(label, documents, top_terms, summary): one sentence on each community."""
    t = community_terms(chunks).groupBy("label").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("t")).select("label", F.transform("t", lambda x: x["term"]).alias("top_terms"))
    members = community_members(chunks).groupBy("label").agg(F.count(F.lit(1)).alias("documents"))
    named = F.array_join(F.filter(F.slice("top_terms", 1, 5), lambda x: x != F.col("label")), ", ")
    text = F.concat(F.lit("Community around `"), F.col("label"), F.lit("` spans "), F.col("documents"), F.lit(" document(s)"), F.when(named != "", F.concat(F.lit(" and is associated with "), named)).otherwise(F.lit("")), F.lit("."))
    return members.join(t, "label").select("label", "documents", "top_terms", text.alias("summary"))


#: Edge types along which neighbours are counted. Fixed values.
NEIGHBOUR_TYPES = ("related_to", "mentions", "under_heading", "contains", "member_of", "has_figure", "has_table")


def neighbours(e: DataFrame) -> DataFrame:
    """(node, neighbour): both directions, once each."""
    e = e.filter(F.col("type").isin(*NEIGHBOUR_TYPES))
    return e.select(F.col("source").alias("node"), F.col("target").alias("neighbour")).union(e.select("target", "source")).distinct()


#: What the ids of targets begin with, by edge types whose targets are no chunks or documents.
PREFIXES = {"mentions": "term", "under_heading": "heading", "has_figure": "figure", "has_table": "table", "member_of": "community"}


def plain_ids(chunks: DataFrame, more: tuple[str, ...] = ()) -> bool:
    """Whether no id of a chunk or document looks like that of another node."""
    odd = "^(" + "|".join((*PREFIXES.values(), *more)) + "):"
    return chunks.filter(F.col("id").rlike(odd) | F.col("doc_id").rlike(odd)).isEmpty()


def degrees(e: DataFrame, plain: bool = False) -> DataFrame:
    """(node, degree): how many neighbours a node has.

    ``plain``: ``e`` has each edge once and its chunks have ``plain_ids``. Then
    nothing but chunks and documents can be linked twice, all others are
    counted in the tasks.
    """
    if not plain:
        return neighbours(e).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    e = e.filter(F.col("type").isin(*NEIGHBOUR_TYPES))
    items = e.filter(F.col("type").isin(*PREFIXES))
    ends = items.select(F.explode(F.array("source", "target")).alias("node"))
    return ends.unionByName(neighbours(e.filter(~F.col("type").isin(*PREFIXES))).select("node")).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))


def source_hash(chunks: DataFrame, key: str = "id", text: str = "text", length: int = 24) -> DataFrame:
    """One row: a hash of all chunks that any change alters, in whatever order they lie.

    Hashes of chunks are added up in four parts of 60 bits; sums combine within
    the tasks, so nothing is collected.
    """
    one = chunks.select(F.sha2(F.concat(F.col(key), F.lit("\u0000"), F.coalesce(text, F.lit("")), F.lit("\u0000")).cast("binary"), 256).alias("h"))
    parts = [F.coalesce(F.sum(F.conv(F.substring("h", 1 + 15 * k, 15), 16, 10).cast("decimal(20,0)")), F.lit(0).cast("decimal(30,0)")).alias(f"p{k}") for k in range(4)]
    sums = one.agg(F.count(F.lit(1)).alias("n"), *parts)
    return sums.select(F.substring(F.sha2(F.concat_ws(":", "n", *[f"p{k}" for k in range(4)]).cast("binary"), 256), 1, length).alias("source_hash"))
