"""Answering batches of free-text queries over chunks.

Lexical (BM25 and field boosts), vector (hashed features) and graph scores,
each divided by its greatest, fused by reciprocal ranks and weights, reranked,
graded. A batch of queries is one DataFrame (qid, query). Nearly every chunk
is brought up by some word, label or vector, so pairs of queries and chunks
are scored in the tasks, a block of queries against each batch of chunks, and
none is written: ``ranking`` counts them and names the best.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellichor.functions import text as X
from vellichor.functions import vectors as V
from vellichor.operators import graph as G
from vellichor.operators import ranking
from vellichor.plans.lineage import materialize
from vellichor.operators.lexical import SparseIndex, exploded_tokens

RRF_K = 60
#: lexical, vector, graph by mode. Fixed values.
WEIGHTS = {"lexical": (0.82, 0.0, 0.18), "vector": (0.18, 0.70, 0.12), "hybrid": (0.40, 0.45, 0.15)}


def normalize_scores(df: DataFrame, score: str, by: str = "qid") -> DataFrame:
    """Scores above zero divided by the greatest of their query; others dropped."""
    positive = df.filter(F.col(score) > 0)
    return positive.withColumn(score, F.col(score) / F.max(score).over(Window.partitionBy(by)))


def rrf(score_sets: list[DataFrame], k: int = RRF_K) -> DataFrame:
    """(qid, key, rrf) from sets of (qid, key, score): sums of 1 / (k + rank), then normalised. Ties rank by key."""
    w = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    ranked = [s.filter("score > 0").select("qid", "key", (1 / (k + F.row_number().over(w))).alias("r")) for s in score_sets]
    fused = reduce(DataFrame.unionByName, ranked).groupBy("qid", "key").agg(F.sum("r").alias("rrf"))
    return normalize_scores(fused, "rrf")


def _linked_labels(index: ChunkIndex, seeds: DataFrame) -> DataFrame:
    """(qid, label, s): the labels that edges of ``expand_queries`` lead to, from the terms that chunks and documents name.

    Labels of terms are looked at where they are named, so neither edges nor
    nodes are joined. Only for an index with ``items``.
    """
    spark = seeds.sparkSession
    rows = seeds.collect()
    qids = sorted({r["qid"] for r in rows})
    at = {q: k for k, q in enumerate(qids)}
    shared = spark.sparkContext.broadcast([(at[r["qid"]], r["seed"]) for r in rows])
    plain = lambda c: F.lower(F.trim(c))
    # as in the nodes, a repeated document has its least title, null first
    titles = _few(index.documents.filter("doc_id is not null").groupBy("doc_id").agg(F.min(F.struct("title"))["title"].alias("title")))
    chunks = index.chunks.filter("id is not null").select("doc_id", "heading", F.transform(F.array_distinct("terms"), plain).alias("names"))
    headed = chunks.filter("heading <> ''").select(F.lower("heading").alias("label"), "names")
    untitled = chunks.filter("heading = ''").join(titles, "doc_id", "left").select(F.lower("title").alias("label"), "names")
    named = index.items.join(titles, "doc_id").select(F.lower("title").alias("label"), F.array(plain(F.col("term"))).alias("names"))
    groups = index.nodes.filter("type = 'community'").select(F.col("id").alias("target"), F.array(plain(F.col("label"))).alias("names"))
    members = index.edges.filter("type = 'member_of'").join(_few(groups), "target").join(titles, F.col("source") == F.col("doc_id")).select(F.lower("title").alias("label"), "names")
    linked = headed.unionByName(untitled).unionByName(named).unionByName(members).mapInArrow(ranking.near_labels(shared), ranking.NEAR_LABELS)
    kind = seeds.schema["qid"].dataType.simpleString()
    names = spark.createDataFrame(list(enumerate(qids)), f"q int, qid {kind}")
    return linked.groupBy("q", "label").agg(F.sum("s").alias("s")).join(F.broadcast(names), "q").select("qid", "label", "s")


def expand_queries(queries: DataFrame, nodes: DataFrame, edges: DataFrame, limit: int = 18, index: ChunkIndex | None = None) -> DataFrame:
    """(qid, expanded): labels near the terms of each query in the graph.

    A term or community label scores 3 for each word it shares with the query
    and 2 if one contains the other (query words of more than three letters);
    labels at the other end of their edges score 1 an edge. The best twice
    ``limit`` are considered; ties by label. With an ``index`` that has items
    no edges are joined.
    """
    seeds = exploded_tokens(queries, "qid", "query").select(F.col("key").alias("qid"), F.col("term").alias("seed")).distinct()
    labels = nodes.filter("type in ('term', 'community')").select("id", F.lower(F.trim("label")).alias("label")).filter(X.expansion_term_is_useful("label"))
    words = labels.select("id", "label", F.explode(F.array_distinct(X.tokens("label"))).alias("word"))
    # the queries of a batch are few; labels are streamed past them
    share = words.join(F.broadcast(seeds), F.col("word") == F.col("seed")).groupBy("qid", "label").agg(F.countDistinct("seed").alias("ov"))
    long_seeds = seeds.filter(F.length("seed") > 3)
    inside = labels.select("label").distinct().join(F.broadcast(long_seeds), F.contains(F.col("label"), F.col("seed")) | F.contains(F.col("seed"), F.col("label"))).select("qid", "label").distinct().withColumn("cs", F.lit(1))
    direct = share.join(inside, ["qid", "label"], "full").select("qid", "label", (F.coalesce("ov", F.lit(0)) * 3 + F.coalesce("cs", F.lit(0)) * 2).alias("s"))
    if index is not None and index.items is not None:
        near = _linked_labels(index, seeds)
    else:
        hit = labels.join(direct.select("qid", "label"), "label").select("qid", "id")
        e = edges.filter("type in ('mentions', 'member_of', 'under_heading', 'related_to')").select("source", "target")
        # these labels are targets: only where an id looks like theirs are sources joined
        e_from = e.filter(F.col("source").rlike("^(term|community):"))
        e = e.filter(F.col("target").rlike("^(term|community):"))
        other = e_from.join(hit, e_from["source"] == hit["id"]).select("qid", F.col("target").alias("n")).unionAll(e.join(hit, e["target"] == hit["id"]).select("qid", F.col("source").alias("n")))
        near = other.join(nodes.select(F.col("id").alias("n"), F.lower("label").alias("label")), "n").groupBy("qid", "label").agg(F.count(F.lit(1)).alias("s"))
    score = direct.unionByName(near.withColumn("s", F.col("s").cast("int"))).groupBy("qid", "label").agg(F.sum("s").alias("s"))
    w = Window.partitionBy("qid").orderBy(F.desc("s"), "label")
    best = score.withColumn("k", F.row_number().over(w)).filter(F.col("k") <= 2 * limit)
    kept = best.filter(X.expansion_term_is_useful("label") & (F.size(F.split("label", r"\s+")) <= 5)).join(F.broadcast(seeds.withColumnRenamed("seed", "label")), ["qid", "label"], "left_anti")
    again = Window.partitionBy("qid").orderBy("k")
    kept = kept.withColumn("r", F.row_number().over(again)).filter(F.col("r") <= limit)
    return kept.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "label"))), lambda x: x["label"]).alias("expanded"))


def matches(terms: Column, text: Column) -> Column:
    """How many of the terms occur in the text, inside words too."""
    return F.size(F.filter(terms, lambda t: F.contains(text, t)))


def rerank_score(query: Column, terms: Column, low: Column, heading_low: Column, flags: Column, defects: Column, figures: Column, tables: Column) -> Column:
    """From lower-case texts: coverage, the whole phrase, heading, figures and tables, less injection and defects; at least 0."""
    n = F.greatest(F.size(terms), F.lit(1))
    fig = F.array(*map(F.lit, ("figure", "fig", "image", "chart", "plot", "graph")))
    tab = F.array(*map(F.lit, ("table", "data", "unit", "value", "mpa", "mj")))
    some = lambda extra: (matches(extra, low) > 0) | (matches(terms, low) > 0)
    score = (
        matches(terms, low) / n * 2.2
        + F.when(F.contains(low, F.lower(query)), 1.4).otherwise(0.0)
        + matches(terms, heading_low) * 0.35
        + F.when((F.size(figures) > 0) & some(fig), 0.25).otherwise(0.0)
        + F.when((F.size(tables) > 0) & some(tab), 0.25).otherwise(0.0)
        - F.when(F.size(flags) > 0, 0.9).otherwise(0.0)
        - F.size(defects) * 0.25
    )
    return F.when(F.size(terms) == 0, 0.0).otherwise(F.greatest(F.lit(0.0), score))


def evidence_grade(score: Column, coverage: Column, rerank: Column, vector: Column, graph: Column, flags: Column, warnings: Column) -> Column:
    """strong, usable, weak or insufficient; any warning makes strong usable."""
    strong = (score >= 0.55) & (coverage >= 0.25) & (rerank >= 0.35) & (F.size(flags) == 0)
    usable = (score >= 0.28) & ((coverage >= 0.15) | (vector >= 0.35) | (graph >= 0.35))
    return F.when(strong & (F.size(warnings) == 0), "strong").when(strong | usable, "usable").when(score > 0, "weak").otherwise("insufficient")


def answerability(hits: DataFrame, queries: DataFrame) -> DataFrame:
    """(qid, answerability, strong, usable) over the hits returned; queries without hits are insufficient."""
    n = hits.groupBy("qid").agg(F.sum((F.col("evidence_grade") == "strong").cast("int")).alias("strong"), F.sum(F.col("evidence_grade").isin("strong", "usable").cast("int")).alias("usable"))
    a = queries.select("qid").join(n, "qid", "left")
    level = F.when(F.col("strong").isNull(), "insufficient").when((F.col("strong") >= 2) | ((F.col("strong") >= 1) & (F.col("usable") >= 3)), "high").when(F.col("usable") >= 1, "partial").otherwise("low")
    return a.select("qid", level.alias("answerability"), F.coalesce("strong", F.lit(0)).alias("strong"), F.coalesce("usable", F.lit(0)).alias("usable"))


def embedded_text() -> Column:
    return F.concat_ws("\n", "heading", F.array_join("terms", " "), "text")


#: What any of ``text.INJECTION`` holds.
FLAG_PARTS = ("instruction", "system prompt", "developer message", "exfiltrat", "reveal secrets")


def _searched(chunks: DataFrame) -> DataFrame:
    """With the text that a chunk is searched by, also in lower case as its heading, and with its flags and defects."""
    c = chunks.withColumn("searched", X.retrieval_text()).withColumns({"low": F.lower("searched"), "heading_low": F.lower("heading")})
    # few texts hold a part of a flag: the others are not matched
    some = reduce(Column.__or__, [F.contains("low", F.lit(x)) for x in FLAG_PARTS])
    return c.withColumns({"flags": F.when(some, X.injection_flags("text")).otherwise(F.array().cast("array<string>")), "defects": X.extraction_warnings("text")})


#: Ids of repeated chunks that may go to all tasks.
MOST_REPEATED = 1_048_576


def latest(chunks: DataFrame) -> DataFrame:
    """As ``graph.latest_chunks``, but moves the ids and not the texts unless an id repeats within a delivery or too many do."""
    n = chunks.groupBy("id", "seq").agg(F.count(F.lit(1)).alias("n")).groupBy("id").agg(F.max("seq").alias("last"), F.sum("n").alias("rows"), F.max(F.struct("seq", "n"))["n"].alias("n"))
    repeated = materialize(n.filter("rows > 1").select(F.col("id").alias("again"), "last", "n"), "index-repeated")
    r = repeated.agg(F.count(F.lit(1)).alias("ids"), F.coalesce(F.max("n"), F.lit(1)).alias("n"), F.coalesce(F.bool_or(F.col("last").isNull()), F.lit(False)).alias("odd")).first()
    if r["n"] > 1 or r["odd"] or r["ids"] > MOST_REPEATED:
        return materialize(G.latest_chunks(chunks), "index-chunks")
    if not r["ids"]:
        return chunks
    return chunks.join(F.broadcast(repeated.select("again", "last")), F.col("id").eqNullSafe(F.col("again")), "left").filter("last is null or seq = last").drop("again", "last")


@dataclass
class ChunkIndex:
    """Everything queries need: chunks, sparse index, nodes and edges, embeddings (optional)."""

    chunks: DataFrame
    documents: DataFrame
    sparse: SparseIndex
    nodes: DataFrame
    edges: DataFrame
    embeddings: DataFrame | None
    #: Whether the embeddings are the hashed features of ``embedded_text``, which search then makes itself.
    hashed: bool = False
    #: The ``graph.document_items`` that nodes and edges come of, unless ids of different nodes may be the same.
    items: DataFrame | None = None

    @staticmethod
    def build(documents: DataFrame, chunks: DataFrame, embedding: str = "hash") -> ChunkIndex:
        """``chunks`` has id, doc_id, path, heading, ordinal, text, seq and the extracted arrays; repeated deliveries count once."""
        if embedding not in ("hash", "none"):
            raise ValueError(f"unknown embedding: {embedding}")
        c = latest(chunks)
        empty = F.array().cast("array<string>")
        for a in ("terms", "citations", "links", "figures", "table_records"):
            c = c.withColumn(a, F.filter(F.coalesce(F.col(a), empty), lambda x: x.isNotNull() & (F.trim(x) != "")))
        if "modalities" not in c.columns:
            c = c.withColumn("modalities", F.array(F.lit("text")))
        c = c.withColumn("heading", F.coalesce("heading", F.lit(""))).withColumn("text", F.coalesce("text", F.lit("")))
        # texts, postings and vectors take more room than what is asked of them: search makes them again in the tasks
        vectors = None if embedding == "none" else c.select(F.col("id").alias("key"), V.hash_embedding(embedded_text()).alias("embedding"))
        sparse = SparseIndex.build(_searched(c), "id", "searched")
        items = materialize(G.document_items(c), "document-items")
        apart = G.apart(c)
        plain = apart and G.plain_ids(c, ("citation", "external_link"))
        nodes, edges = materialize(G.nodes(documents, c, items), "index-nodes"), materialize(G.edges(c, items, apart), "index-edges")
        return ChunkIndex(c, documents.select("doc_id", "path", "title"), sparse, nodes, edges, vectors, vectors is not None, items if plain else None)


def neighbour_terms(index: ChunkIndex, wanted: list[str]) -> DataFrame:
    """(node, near): which of the words and labels occur within the ids of a node's neighbours."""
    shared = index.edges.sparkSession.sparkContext.broadcast(sorted(set(wanted)))
    e = index.edges.filter(F.col("type").isin(*G.NEIGHBOUR_TYPES)).select("source", "target")
    # ids are looked into where they lie, those of a batch once each; few hold a word
    return e.mapInArrow(ranking.near_strings(shared), "node string, t string").distinct().groupBy("node").agg(F.collect_list("t").alias("near"))


#: Queries that are compared with the chunks at once.
QUERY_BLOCK = 1024
#: Rows of a table by document or chunk that may go to all tasks.
MOST_SENT = 262_144


def _few(df: DataFrame) -> DataFrame:
    """Marked for broadcast if it has few rows."""
    return F.broadcast(df) if df.count() <= MOST_SENT else df


def described(index: ChunkIndex, b: ranking.Batch, hashed: bool) -> DataFrame:
    """What scores of a block of queries need of each chunk, see ``ranking.FEATURES``: numbers of words, no texts."""
    near = materialize(neighbour_terms(index, [b.strings[k] for k in sorted({k for e in (*b.own, *b.more) for k in e})]), "query-neighbours")
    none = F.array().cast("array<string>")
    titles = index.documents.groupBy("doc_id").agg(F.lower(F.coalesce(F.min("title"), F.lit(""))).alias("title"))
    c = _searched(index.chunks).join(_few(titles), "doc_id", "left").withColumn("title", F.coalesce("title", F.lit("")))
    if near.isEmpty():
        c = c.withColumn("near", none)
    else:
        near = _few(near)
        c = c.join(near.select(F.col("node").alias("id"), F.col("near").alias("n1")), "id", "left").join(near.select(F.col("node").alias("doc_id"), F.col("near").alias("n2")), "doc_id", "left")
        c = c.withColumn("near", F.array_union(F.coalesce("n1", none), F.coalesce("n2", none)))
    if b.vectors is not None and not hashed:
        c = c.join(index.embeddings.select(F.col("key").alias("id"), F.col("embedding").alias("vector")), "id", "left")
    else:
        c = c.withColumn("vector", F.lit(None).cast("map<int,double>"))
    c = c.select(
        F.col("id").alias("key"), "doc_id", "searched", "low", "heading_low", "title", "terms", (F.when((F.size("figures") > 0) | (F.size("table_records") > 0), embedded_text()) if hashed else F.lit("")).alias("embedded"), "near",
        (F.size("flags") > 0).alias("flagged"), F.size("defects").alias("defects"), (F.size("figures") > 0).alias("figures"), (F.size("table_records") > 0).alias("tables"), "vector",
    )
    return materialize(c.mapInArrow(ranking.describe(b, hashed), ranking.FEATURES), "query-chunks")


def _related(index: ChunkIndex, top: DataFrame) -> DataFrame:
    """(q, doc_id): the documents in ``top`` and those related to them."""
    linked = index.edges.filter("type = 'related_to'").select(F.col("source").alias("a"), F.col("target").alias("b"))
    linked = linked.unionAll(linked.select("b", "a"))
    return top.unionAll(linked.join(F.broadcast(top), F.col("doc_id") == F.col("a")).select("q", "b")).distinct()


def best_pairs(index: ChunkIndex, rows: list, mode: str, limit: int) -> list[tuple]:
    """(qid, key, lexical, vector, graph, rrf, rerank, raw) of a block of queries, scores divided by their greatest.

    The best ``limit`` of each are among them. ``rows``: qid, phrase, tokens,
    expanded and vectors. All pairs count for ranks and greatest scores; they
    are scored again in each pass (see ``ranking``), none is written.
    """
    spark = index.chunks.sparkSession
    vectors = mode != "lexical"
    hashed = vectors and index.hashed
    b = ranking.Batch.of(rows, vectors)
    n = len(b.qids)
    chunks = described(index, b, hashed)
    total = chunks.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("length")).first()
    df = np.zeros(len(b.strings))
    for r in chunks.select(F.explode("tf").alias("k")).groupBy("k").count().toLocalIterator():
        df[r["k"]] = r["count"]
    score = ranking.Scorer(b, np.log(1 + (total["n"] - df + 0.5) / (df + 0.5)), total["length"] / max(total["n"], 1), hashed)

    def run(task, kind: str = ranking.PASS) -> DataFrame:
        return materialize(chunks.mapInArrow(task, kind), "query-pass")

    greatest = {k: np.zeros(n) for k in range(6)}
    steps: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def read(found: DataFrame) -> None:
        t = found.filter(F.col("kind") == ranking.GREATEST).groupBy("bin", "q").agg(F.max("score")).toArrow()
        for k, q, x in zip(*(c.to_pylist() for c in t.columns), strict=True):
            greatest[k][q] = x
        t = found.filter(F.col("kind") == ranking.COUNTED).groupBy("bin", "q").agg(F.sum("n")).toArrow()
        at, q, m = (c.to_numpy() for c in t.columns)
        for s in np.unique(at // ranking.BINS):
            mine = at // ranking.BINS == s
            count = np.zeros((n, ranking.BINS), np.int64)
            count[q[mine], at[mine] % ranking.BINS] = m[mine]
            down = count[:, ::-1].cumsum(axis=1)[:, ::-1]
            steps[int(s)] = (1 / (RRF_K + np.maximum(down, 1))).ravel(), (1 / (RRF_K + down - count + 1)).ravel()

    share = lambda x: spark.sparkContext.broadcast(x)
    first = run(ranking.survey(share((score, None)), [0, 1] if vectors else [0], False))
    read(first)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "key")
    # at most five documents a query, and those related to them
    top = materialize(first.filter(F.col("kind") == ranking.LEAD).withColumn("r", F.row_number().over(w)).filter("r <= 5").select("q", "doc_id").distinct(), "query-top")
    around: dict[str, list[int]] = {}
    for r in _related(index, top).toLocalIterator():
        around.setdefault(r["doc_id"], []).append(r["q"])
    scored = share((score, around))
    read(run(ranking.survey(scored, [2], True)))
    read(run(ranking.extremes(scored, share((steps, greatest)))))
    named = run(ranking.candidates(scored, share((steps, greatest)), limit, WEIGHTS[mode]), ranking.CANDIDATES)
    # what no task could leave out by its own pairs, by those of all
    bound = named.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("least")))).filter(F.col("r") == limit).select("q", F.col("least").alias("bound"))
    fewest = spark.createDataFrame([(k, float(x)) for k, x in enumerate(greatest[ranking.LEAST])], "q int, fewest double")
    same = Window.partitionBy("q", "lexical", "vector", "graph", "rerank").orderBy("key")
    kept = named.join(F.broadcast(bound), "q", "left").join(F.broadcast(fewest), "q").filter((F.col("most") + ranking.MARGIN >= F.coalesce("bound", F.lit(-1.0))) | (F.col("shares") >= F.col("fewest")))
    kept = kept.withColumn("r", F.row_number().over(same)).filter(F.col("r") <= limit).select("q", "key", "lexical", "vector", "graph", "rerank").toArrow()
    q, key, lex, vec, gra, rer = (c.to_numpy() for c in kept.columns)
    if not len(q):
        return []
    values = {0: lex, 1: vec, 2: gra}
    sets = sorted(steps)
    count = run(ranking.places(scored, share((q, key.astype(str), values)), sets)).groupBy("bin", "q").agg(F.sum("n")).toArrow()
    s, at, m = (c.to_numpy() for c in count.columns)
    rrf_sum = np.zeros(len(q))
    for k in sets:
        before = np.zeros(len(q), np.int64)
        before[at[s == k]] = m[s == k]
        rrf_sum += np.where(values[k] > 0, 1 / (RRF_K + 1 + before), 0.0)
    most = np.zeros(n)
    np.maximum.at(most, q, rrf_sum)
    over = lambda x, t: np.divide(x, t[q], out=np.zeros_like(x), where=t[q] > 0)
    lex, vec, gra, rer, fused = over(lex, greatest[0]), over(vec, greatest[1]), over(gra, greatest[2]), over(rer, greatest[ranking.RERANK]), over(rrf_sum, most)
    wl, wv, wg = WEIGHTS[mode]
    raw = 0.62 * fused + 0.25 * (wl * lex + wv * vec + wg * gra) + 0.13 * rer
    return [(b.qids[k], *r) for k, *r in zip(q.tolist(), key.tolist(), lex.tolist(), vec.tolist(), gra.tolist(), fused.tolist(), rer.tolist(), raw.tolist(), strict=True)]


def search(index: ChunkIndex, queries: DataFrame, mode: str = "hybrid", limit: int = 8, expand: int = 18) -> DataFrame:
    """The best chunks of each query with all scores, grade, warnings and flags.

    hybrid without embeddings is lexical; vector without them is an error.
    Queries without words give no hits. Grades are worked out after the
    limit: they depend on nothing but their own row.
    """
    if mode not in WEIGHTS:
        raise ValueError(f"mode must be one of {sorted(WEIGHTS)}")
    if limit < 1:
        raise ValueError("limit must be at least 1")
    if index.embeddings is None:
        if mode == "vector":
            raise ValueError("the index has no embeddings")
        mode = "lexical" if mode == "hybrid" else mode
    spark = queries.sparkSession
    kind = queries.schema["qid"].dataType.simpleString()
    queries = queries.select("qid", F.trim("query").alias("query")).filter("query <> ''")
    # each stage is read several times below
    expanded = materialize(expand_queries(queries, index.nodes, index.edges, expand, index), "query-expanded")
    tokens = exploded_tokens(queries, "qid", "query").groupBy(F.col("key").alias("qid")).agg(F.sort_array(F.collect_list("term")).alias("tokens"))
    asked = queries.join(tokens, "qid").join(expanded, "qid", "left").select("qid", "query", F.lower("query").alias("phrase"), "tokens", "expanded")
    if mode != "lexical":
        asked = asked.withColumns({"v": V.hash_embedding("query"), "x": V.hash_embedding(F.array_join(F.coalesce("expanded", F.array().cast("array<string>")), " "))})
    asked = materialize(asked, "query-asked")
    rows, found = [], []
    for r in asked.orderBy("qid").toLocalIterator():
        rows.append(r)
        if len(rows) == QUERY_BLOCK:
            found, rows = found + best_pairs(index, rows, mode, limit), []
    if rows:
        found += best_pairs(index, rows, mode, limit)
    all_ = spark.createDataFrame(found, f"qid {kind}, key string, lexical double, vector double, graph double, rrf double, rerank double, raw double")
    best = Window.partitionBy("qid").orderBy(F.desc("score"), "key")
    hits = all_.filter("raw > 0").withColumn("score", F.round("raw", 4)).withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= limit)
    hits = hits.join(F.broadcast(asked.select("qid", F.array_union("tokens", F.coalesce("expanded", F.array().cast("array<string>"))).alias("wanted"))), "qid")
    # a few hits a query
    hits = _searched(index.chunks.withColumnRenamed("id", "key").join(F.broadcast(hits), "key"))
    coverage = matches(F.col("wanted"), F.col("low")) / F.greatest(F.size("wanted"), F.lit(1))
    flags, defects = F.col("flags"), F.col("defects")
    warnings = F.array_compact(F.concat(defects, F.array(F.when(F.size(flags) > 0, "prompt_injection_flag"))))
    grade = evidence_grade(F.col("raw"), coverage, F.col("rerank"), F.col("vector"), F.col("graph"), flags, warnings)
    only = F.array_compact(F.array(F.when((F.col("lexical") == 0) & (F.col("vector") == 0) & (F.col("graph") > 0), "graph_only_match")))
    return hits.select(
        "qid", "rank", F.col("key").alias("chunk_id"), "doc_id", "path", "heading", "score",
        *[F.round(s, 4).alias(s) for s in ("lexical", "vector", "graph", "rrf", "rerank")],
        grade.alias("evidence_grade"), F.array_distinct(F.concat(warnings, only)).alias("evidence_warnings"), F.col("flags").alias("prompt_flags"), "terms", "modalities",
        X.compact("text", 1400).alias("text"), X.text_hash("text").alias("source_hash"),
    )


def evidence_paths(hits: DataFrame, index: ChunkIndex, queries: DataFrame, most: int = 6) -> DataFrame:
    """(qid, chunk_id, paths): how each hit is linked to the words of its query, at most six ways.

    Terms first, then the first three citations, then edges of the chunk and
    its document to labels that hold a word; by kind, then label.
    """
    q = exploded_tokens(queries, "qid", "query").select(F.col("key").alias("qid"), F.col("term").alias("w")).distinct()
    h = hits.select("qid", "chunk_id", "doc_id").join(index.chunks.select(F.col("id").alias("chunk_id"), F.col("terms").alias("ts"), F.slice("citations", 1, 3).alias("cs")), "chunk_id").join(q, "qid")
    t = h.select("qid", "chunk_id", "w", F.posexplode("ts").alias("k", "x")).filter((F.col("x") == F.col("w")) | ((F.length("w") > 3) & (F.contains("x", F.col("w")) | F.contains("w", F.col("x"))))).select("qid", "chunk_id", F.lit(1).alias("o"), "k", F.concat(F.lit("query -> term:"), "x", F.lit(" -> chunk")).alias("p"))
    c = h.select("qid", "chunk_id", "w", F.posexplode("cs").alias("k", "x")).filter(F.contains(F.lower("x"), F.col("w"))).select("qid", "chunk_id", F.lit(2).alias("o"), "k", F.concat(F.lit("query -> citation:"), "x", F.lit(" -> chunk")).alias("p"))
    ends = hits.select("qid", "chunk_id", F.explode(F.array("chunk_id", "doc_id")).alias("node"))
    e = index.edges.select(F.col("source").alias("node"), F.col("target").alias("other"), "type").unionByName(index.edges.select(F.col("target").alias("node"), F.col("source").alias("other"), "type"))
    near = e.join(F.broadcast(ends), "node").join(index.nodes.select(F.col("id").alias("other"), "label"), "other").join(q, "qid").filter(F.contains(F.lower("label"), F.col("w")))
    g = near.select("qid", "chunk_id", F.lit(3).alias("o"), F.lit(0).alias("k"), F.concat(F.lit("query -> "), "type", F.lit(":"), "label", F.lit(" -> chunk")).alias("p"))
    one = t.unionByName(c).unionByName(g).groupBy("qid", "chunk_id", "p").agg(F.min(F.struct("o", "k")).alias("o"))
    w = Window.partitionBy("qid", "chunk_id").orderBy("o", "p")
    return one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= most).groupBy("qid", "chunk_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("r", "p"))), lambda x: x["p"]).alias("paths"))
