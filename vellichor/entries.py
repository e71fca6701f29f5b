"""The queries of the core, by the operator they exercise, and SQL for those SQL can state.

Every query takes (spark, folder) and reads its whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellichor.functions import text as X
from vellichor.functions import vectors as V
from vellichor.operators import benchmark, chunking, cleanup, graph, layout, lexical, manifest, quality, retrieval, structure, tables, terms
from vellichor.operators.nearest import nearest
from vellichor.plans.lineage import materialize
from vellichor.plans.session import steady
from vellichor.sources import files
from vellichor.sources import tables as artifacts

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[f.__name__] = lambda spark, sf: f(steady(spark), sf)
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = graph.latest_chunks(_t(spark, sf, "kg_chunks"))
    empty = F.array().cast("array<string>")
    return c.withColumns({a: F.filter(F.coalesce(F.col(a), empty), lambda x: x.isNotNull() & (F.trim(x) != "")) for a in ("terms", "citations", "links", "figures", "table_records")})


def _slim(spark: SparkSession, sf: str) -> DataFrame:
    """What edges need of the chunks, written once: every type of edge reads it."""
    return materialize(_chunks(spark, sf).select("id", "doc_id", "path", "heading", "seq", "terms", "citations", "links", "figures", "table_records"), "edge-chunks")


_STOP = ", ".join(f"'{w}'" for w in X.STOP_WORDS)
_TOKENS = f"""
words AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{X.WORD}'))) AS w FROM documents),
tokens AS (SELECT doc_id, trim(w, '_+-') AS term FROM words WHERE w NOT IN ({_STOP}))"""
_LATEST = "latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY seq DESC) AS rn FROM kg_chunks) WHERE rn = 1)"


def _items(column: str) -> str:
    return f"SELECT id, doc_id, path, seq, ordinal, heading, item FROM (SELECT id, doc_id, path, seq, ordinal, heading, unnest({column}) AS item FROM latest) WHERE item IS NOT NULL AND trim(item) <> ''"


_LINES = r"""
parts AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|[\n\r\x{0b}\x{0c}\x{1c}-\x{1e}\x{85}\x{2028}\x{2029}]') AS p FROM documents),
trimmed AS (SELECT doc_id, CASE WHEN p[len(p)] = '' THEN p[1:len(p) - 1] ELSE p END AS p FROM parts),
lines AS (SELECT doc_id, unnest(p) AS content, generate_subscripts(p, 1) AS line FROM trimmed)"""
_SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^{_SP}+', ''), '{_SP}+$', '')"


def _collapse(c: str) -> str:
    return f"trim(regexp_replace({c}, '{_SP}+', ' ', 'g'))"


# terms and the sparse index


@_query(f"WITH {_TOKENS} SELECT term, count(*) AS n FROM tokens GROUP BY term")
def tokenize_counts(spark, sf):
    return lexical.exploded_tokens(_t(spark, sf, "documents"), "doc_id", "text").groupBy("term").agg(F.count(F.lit(1)).alias("n"))


@_query(f"WITH {_TOKENS} SELECT term, count(DISTINCT doc_id) AS df FROM tokens GROUP BY term")
def document_frequency(spark, sf):
    return lexical.SparseIndex.build(_t(spark, sf, "documents"), "doc_id", "text").frequencies


@_query(f"WITH {_TOKENS} SELECT (SELECT count(*) FROM documents) AS documents, count(*) AS total_length, count(*) / (SELECT count(*) FROM documents) AS average_length FROM tokens")
def corpus_stats(spark, sf):
    return lexical.SparseIndex.build(_t(spark, sf, "documents"), "doc_id", "text").stats()


_BM25 = f"""
WITH {_TOKENS},
tf AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
len AS (SELECT d.doc_id, coalesce(sum(tf), 0) AS length FROM documents d LEFT JOIN tf USING (doc_id) GROUP BY 1),
st AS (SELECT count(*) AS n, sum(length) / count(*) AS avgdl FROM len),
qw AS (SELECT item_id AS qid, lower(unnest(regexp_extract_all(question, '{X.WORD}'))) AS w FROM eval_items),
q AS (SELECT qid, trim(w, '_+-') AS term, count(*) AS times FROM qw WHERE w NOT IN ({_STOP}) GROUP BY ALL),
s AS (SELECT qid, doc_id AS key, round(sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * length / greatest(avgdl, 1)))), 4) AS score
      FROM tf JOIN q USING (term) JOIN df USING (term) JOIN len USING (doc_id), st GROUP BY qid, doc_id)
SELECT qid, key, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, key) AS rank FROM s WHERE score > 0) WHERE rank <= 8"""


def _asked(spark, sf):
    return _t(spark, sf, "eval_items").select(F.col("item_id").alias("qid"), F.col("question").alias("query"))


@_query(_BM25)
def bm25_topk(spark, sf):
    index = lexical.SparseIndex.build(_t(spark, sf, "documents"), "doc_id", "text")
    return lexical.top_hits(lexical.bm25(index, _asked(spark, sf)), 8)


@_query(f"""WITH {_TOKENS}, st AS (SELECT doc_id, term, count(*) AS tf FROM tokens GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM st GROUP BY term)
SELECT doc_id AS key, term, round(tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM documents)) / (1 + df)) + 1), 6) AS weight FROM st JOIN df USING (term)""")
def tfidf_weights(spark, sf):
    docs = _t(spark, sf, "documents")
    i = lexical.SparseIndex.build(docs, "doc_id", "text")
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    return i.postings.join(i.frequencies, "term").join(F.broadcast(n)).select("key", "term", F.round(F.col("tf") * V.inverse_frequency(F.col("n"), F.col("df")), 6).alias("weight"))


_TOPIC = f"""{_TOKENS},
topic AS (SELECT doc_id, w, pos FROM (SELECT doc_id, unnest(list_transform(list_filter(list_transform(regexp_extract_all(text, '{X.WORD}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})), lambda x: trim(x, '_+-'))) AS w,
  generate_subscripts(list_filter(list_transform(regexp_extract_all(text, '{X.WORD}'), lambda x: lower(x)), lambda x: x NOT IN ({_STOP})), 1) AS pos FROM documents) WHERE length(w) > 2 AND w NOT IN ({_STOP})),
seqs AS (SELECT doc_id, w AS a, lead(w, 1) OVER o AS b, lead(w, 2) OVER o AS c FROM topic WINDOW o AS (PARTITION BY doc_id ORDER BY pos))"""


@_query(f"""WITH {_TOPIC}, grams AS (
  SELECT doc_id, a || ' ' || b AS phrase FROM seqs WHERE b IS NOT NULL AND a <> b AND (length(a) > 3 OR length(b) > 3) UNION ALL
  SELECT doc_id, a || ' ' || b || ' ' || c FROM seqs WHERE c IS NOT NULL AND a <> b AND b <> c AND a <> c AND (length(a) > 3 OR length(b) > 3 OR length(c) > 3))
SELECT phrase, sum(n)::BIGINT AS n, count(*) AS documents FROM (SELECT doc_id, phrase, count(*) AS n FROM grams GROUP BY ALL) GROUP BY phrase""")
def phrase_counts(spark, sf):
    p = terms.phrase_counts(_t(spark, sf, "documents"), "doc_id", "text")
    return p.groupBy("phrase").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("documents"))


@_query()
def key_terms(spark, sf):
    return terms.key_terms(_t(spark, sf, "documents"), "doc_id", "text")


# what is extracted from Markdown


def _extracted(column, name):
    def run(spark, sf):
        return _t(spark, sf, "documents").select("doc_id", F.explode(column(F.col("text"))).alias(name)).groupBy(name).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("documents"))

    return run


@_query(rf"""WITH raw AS (
  SELECT doc_id, 'doi:' || regexp_replace(unnest(regexp_extract_all(text, '{X.DOI}', 1)), '[.,;]+$', '') AS citation FROM documents UNION ALL
  SELECT doc_id, 'ref:' || replace(unnest(regexp_extract_all(text, '{X.BRACKET_CITATION}', 1)), ' ', '') FROM documents UNION ALL
  SELECT doc_id, unnest(regexp_extract_all(text, '{X.FIGURE_REFERENCE}')) FROM documents)
SELECT citation, count(*) AS n, count(DISTINCT doc_id) AS documents FROM raw GROUP BY citation""")
def citations(spark, sf):
    return _extracted(X.citations, "citation")(spark, sf)


@_query(rf"""WITH raw AS (
  SELECT doc_id, trim(unnest(regexp_extract_all(text, '{X.WIKI_LINK}', 1))) AS target FROM documents UNION ALL
  SELECT doc_id, trim(unnest(regexp_extract_all(text, '{X.MD_LINK}', 2))) FROM documents)
SELECT target, count(*) AS n, count(DISTINCT doc_id) AS documents FROM raw GROUP BY target""")
def links(spark, sf):
    return _extracted(X.links, "target")(spark, sf)


@_query(rf"""WITH raw AS (SELECT DISTINCT doc_id, {_collapse("regexp_replace(a, '[*_`#]', '', 'g')")} AS alt, p FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '{X.MD_IMAGE}', 1)) AS a, unnest(regexp_extract_all(text, '{X.MD_IMAGE}', 2)) AS p FROM documents))
SELECT CASE WHEN alt = '' THEN 'Figure' ELSE alt END || ' (' || p || ')' AS figure, count(*) AS n, count(DISTINCT doc_id) AS documents FROM raw GROUP BY 1""")
def figures(spark, sf):
    return _extracted(lambda c: X.figure_records(c, None), "figure")(spark, sf)


@_query()
def table_records(spark, sf):
    return _extracted(lambda c: X.table_records(c, None), "record")(spark, sf)


@_query(rf"""WITH fm AS (SELECT doc_id, regexp_split_to_array(regexp_extract(text, '{X.FRONT_MATTER}', 1), '\r\n|\n') AS p FROM documents),
l AS (SELECT doc_id, unnest(p) AS x, generate_subscripts(p, 1) AS k FROM fm),
kv AS (SELECT doc_id, k, lower({_strip("regexp_extract(x, '^([^:]*):', 1)")}) AS key, trim({_strip("regexp_replace(x, '^[^:]*:', '')")}, '"') AS value FROM l WHERE contains(x, ':'))
SELECT doc_id, key, arg_max(value, k) AS value FROM kv GROUP BY doc_id, key""")
def front_matter(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.explode(X.front_matter("text")).alias("key", "value"))


@_query()
def document_titles(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.document_title("text", "path").alias("title"))


@_query(rf"""WITH {_LINES} SELECT doc_id, line::BIGINT AS line, length(regexp_extract(content, '{X.HEADING}', 1)) AS level, {_strip(f"regexp_extract(content, '{X.HEADING}', 2)")} AS label FROM lines WHERE regexp_matches(content, '{X.HEADING}')""")
def headings(spark, sf):
    return structure.headings(_t(spark, sf, "documents"), "doc_id", "text").withColumn("line", F.col("line").cast("long")).withColumn("level", F.col("level").cast("long"))


@_query(rf"""WITH {_LINES}, r AS (SELECT doc_id, line, regexp_replace(content, '{_SP}+$', '') AS c FROM lines),
h AS (SELECT *, regexp_matches(c, '{X.HEADING}') AS is_h FROM r),
s AS (SELECT *, sum(is_h::INT) OVER o AS section, coalesce(last_value(CASE WHEN is_h THEN {_collapse(f"regexp_replace(regexp_extract(c, '{X.HEADING}', 2), '[*_`#]', '', 'g')")} END IGNORE NULLS) OVER o, 'Overview') AS heading FROM h WINDOW o AS (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING))
SELECT doc_id, section::BIGINT AS section, heading, count(*) AS lines, sum(length(c))::BIGINT AS characters FROM s WHERE NOT is_h GROUP BY ALL""")
def sections(spark, sf):
    s = chunking.sections(_t(spark, sf, "documents"), "doc_id", "text")
    return s.groupBy("doc_id", "section", "heading").agg(F.count(F.lit(1)).alias("lines"), F.sum(F.length("content")).alias("characters"))


@_query()
def chunks(spark, sf):
    return chunking.chunk_markdown(_t(spark, sf, "documents"), "doc_id", "path", "text")


@_query()
def conversion_chunks(spark, sf):
    return chunking.split_converted(_t(spark, sf, "documents"), "doc_id", "text", 500)


@_query()
def structure_summary(spark, sf):
    return structure.summary(_t(spark, sf, "documents"), "doc_id", "text")


@_query()
def nearby_captions(spark, sf):
    return structure.nearby_captions(_t(spark, sf, "documents"), "doc_id", "text")


@_query(rf"""WITH {_LINES}, h AS (SELECT doc_id, line, {_strip(f"regexp_extract(content, '{X.HEADING}', 2)")} AS label FROM lines WHERE regexp_matches(content, '{X.HEADING}') AND length(regexp_extract(content, '{X.HEADING}', 1)) = 2),
n AS (SELECT *, CASE WHEN lower(trim(label)) IN ('results', 'methods', 'references', 'discussion', 'supplementary') THEN upper(trim(label)[1:1]) || lower(trim(label)[2:]) END AS base FROM h),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, coalesce(base, label) ORDER BY line) AS k, coalesce(bool_or(base = 'Supplementary') OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS sup FROM n),
p AS (SELECT *, coalesce(k > 1 AND sup AND base <> 'Supplementary', false) AS plain FROM k),
q AS (SELECT *, sum(plain::INT) OVER (PARTITION BY doc_id, coalesce(base, label) ORDER BY line) AS nth FROM p)
SELECT doc_id, line::BIGINT AS line, label, CASE WHEN base IS NULL THEN label WHEN k = 1 THEN base WHEN plain AND nth = 1 THEN 'Supplementary ' || base ELSE base || ' (continued ' || (k + plain::INT) || ')' END AS qualified FROM q""")
def qualified_headings(spark, sf):
    return structure.qualified_headings(_t(spark, sf, "documents"), "doc_id", "text").withColumn("line", F.col("line").cast("long"))


@_query("SELECT doc_id, 'doc:' || sha1(path)[1:14] AS stable_id, sha256(text)[1:16] AS text_hash, greatest(1, len(regexp_extract_all(text, '[^" + _SP[1:] + "+')) * 4 // 3)::INT AS tokens FROM documents")
def stable_ids(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", X.stable_id("doc", "path").alias("stable_id"), X.text_hash("text").alias("text_hash"), X.rough_tokens("text").alias("tokens"))


# cleaning


@_query(rf"""WITH a AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(translate(text, chr(13) || chr(12) || chr(160) || chr(8203) || chr(173), chr(10) || chr(10) || ' '), '[ \t]+', ' ', 'g'), '\n[ \t]+', chr(10), 'g'), '\n{{3,}}', chr(10) || chr(10), 'g') AS t FROM documents)
SELECT doc_id, md5({_strip(r"regexp_replace(t, '(?m)^\s*\d+\s*$', '', 'g')")}) AS cleaned FROM a""")
def clean_text(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(X.clean_text("text").cast("binary")).alias("cleaned"))


@_query(rf"""SELECT seq, md5({_strip(r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '!\[[^\]]*\]\([^)]+\)', '', 'g'), '<[^>]+>', ' ', 'g'), '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g')")}) AS cleaned FROM kg_chunks""")
def clean_chunk_text(spark, sf):
    return _t(spark, sf, "kg_chunks").select("seq", F.md5(X.clean_chunk_text("text").cast("binary")).alias("cleaned"))


@_query(f"SELECT seq, CASE WHEN length(t) > 240 THEN rtrim(t[1:237]) || '...' ELSE t END AS short FROM (SELECT seq, {_collapse('text')} AS t FROM kg_chunks)")
def compact_text(spark, sf):
    return _t(spark, sf, "kg_chunks").select("seq", X.compact("text", 240).alias("short"))


@_query()
def cleaned_documents(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.md5(cleanup.clean_document("text").cast("binary")).alias("cleaned"))


@_query(rf"""WITH {_LINES}, s AS (SELECT doc_id, line, {_strip("content")} AS s FROM lines),
p AS (SELECT *, last_value(nullif(s, '') IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM s)
SELECT doc_id, line::BIGINT AS line FROM p WHERE s = p AND length(s) >= 20 AND NOT regexp_matches(s, '^(#|\||!\[)')""")
def adjacent_duplicates(spark, sf):
    return cleanup.adjacent_duplicates(_t(spark, sf, "documents"), "doc_id", "text").withColumn("line", F.col("line").cast("long"))


@_query(f"""WITH k AS (SELECT doc_id, text, lower({_collapse('text')}) AS k FROM documents)
SELECT doc_id FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id) AS rn FROM k) WHERE length(k) <= 120 OR rn = 1""")
def long_section_dedup(spark, sf):
    return cleanup.long_section_duplicates(_t(spark, sf, "documents"), "doc_id", "text").select("doc_id")


@_query(rf"""WITH w AS (SELECT seq, text FROM kg_chunks WHERE text IS NOT NULL)
SELECT warning, count(*) AS n FROM (
  SELECT 'hyphenated_line_break' AS warning FROM w WHERE regexp_matches(text, '(^|[^\pL\pN_])[A-Za-z]+-\s+[a-z]{{2,}}($|[^\pL\pN_])') UNION ALL
  SELECT 'split_unit_or_exponent' FROM w WHERE regexp_matches(text, '{X.SPLIT_UNIT}') UNION ALL
  SELECT 'mojibake' FROM w WHERE len(regexp_extract_all(text, chr(65533))) >= 2 OR regexp_matches(text, 'Ã|Â|ï¬') UNION ALL
  SELECT 'missing_equation' FROM w WHERE regexp_matches(text, '{X.MISSING_EQUATION}')) GROUP BY warning""")
def extraction_warnings(spark, sf):
    return _t(spark, sf, "kg_chunks").filter("text is not null").select(F.explode(X.extraction_warnings("text")).alias("warning")).groupBy("warning").agg(F.count(F.lit(1)).alias("n"))


@_query(rf"SELECT doc_id, length(text) AS n, len(regexp_extract_all(text, '[A-Za-z]')) >= 20 AS meaningful, len(regexp_extract_all(text, '[\x{{00}}-\x{{08}}\x{{0b}}\x{{0c}}\x{{0e}}-\x{{1f}}\x{{fffd}}]')) > greatest(2, length(text) // 50) AS garbled FROM documents")
def text_health(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", F.length("text").cast("long").alias("n"), X.is_meaningful("text").alias("meaningful"), X.looks_garbled("text").alias("garbled"))


# the graph


_DOC_TERMS = f"""{_LATEST}, dt AS (SELECT doc_id, item AS term, count(DISTINCT id) AS n FROM ({_items("terms")}) GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS rank FROM dt)"""


@_query(f"WITH {_DOC_TERMS} SELECT doc_id, term, n, rank FROM ranked WHERE rank <= 25")
def document_terms(spark, sf):
    return graph.document_terms(_chunks(spark, sf), 25)


_SIMILAR = """st AS (SELECT doc_id, term FROM ranked WHERE rank <= 25), sc AS (SELECT doc_id, count(*) AS n FROM st GROUP BY doc_id),
sp AS (SELECT a.doc_id AS source, b.doc_id AS target, count(*) AS shared FROM st a JOIN st b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY ALL),
sj AS (SELECT sp.*, shared / (x.n + y.n - shared) AS jac FROM sp JOIN sc x ON x.doc_id = source JOIN sc y ON y.doc_id = target),
sim AS (SELECT source, target, shared::INT AS shared, round(jac, 4) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY jac DESC, target) AS rk FROM sj WHERE shared >= 3 AND jac >= 0.08) WHERE rk <= 5)"""


@_query(f"WITH {_DOC_TERMS}, {_SIMILAR} SELECT * FROM sim")
def document_similarity(spark, sf):
    return graph.similar_documents(_chunks(spark, sf))


_COMMUNITIES = f"""{_DOC_TERMS}, u AS (SELECT * FROM ranked WHERE rank <= 8 AND length(term) >= 4 AND term NOT IN ({_STOP})),
cm AS (SELECT term AS label, count(*) AS documents, sum(n)::BIGINT AS weight FROM u GROUP BY term HAVING count(*) >= 2),
best AS (SELECT *, row_number() OVER (ORDER BY documents DESC, weight DESC, label) AS rank FROM cm QUALIFY rank <= 24),
mem AS (SELECT r.doc_id, b.label, b.rank, r.n AS weight, row_number() OVER (PARTITION BY r.doc_id ORDER BY b.rank) AS k FROM ranked r JOIN best b ON r.term = b.label WHERE r.rank <= 8),
members AS (SELECT doc_id, label, rank, weight FROM mem WHERE k <= 4)"""


@_query(f"WITH {_COMMUNITIES} SELECT rank, label, documents, weight, round(documents / (SELECT count(DISTINCT doc_id) FROM latest), 4) AS cohesion FROM best")
def communities(spark, sf):
    return graph.communities(_chunks(spark, sf))


@_query(f"WITH {_COMMUNITIES} SELECT doc_id, label, rank, weight FROM members")
def community_members(spark, sf):
    return graph.community_members(_chunks(spark, sf))


def _kinds(of: str) -> str:
    own = "id || ':' || item"
    parts = [("term", "terms", "item"), ("citation", "citations", "lower(item)"), ("external_link", "links", "lower(item)"), ("figure", "figures", own), ("table", "table_records", own)]
    return " UNION ALL ".join(of.format(kind=k, items=_items(c), key=e) for k, c, e in parts)


@_query(f"""WITH {_COMMUNITIES}, n AS (
  SELECT DISTINCT 'community' AS type, label AS k FROM best UNION
  SELECT DISTINCT 'document' AS type, doc_id AS k FROM kg_documents UNION SELECT DISTINCT 'chunk', id FROM latest UNION
  SELECT DISTINCT 'heading', path || ':' || heading FROM latest WHERE heading <> '' UNION SELECT * FROM ({_kinds("SELECT DISTINCT '{kind}' AS type, {key} AS k FROM ({items})")}))
SELECT type, count(*) AS n FROM n GROUP BY type""")
def graph_nodes_by_type(spark, sf):
    return graph.nodes(_t(spark, sf, "kg_documents"), _chunks(spark, sf)).groupBy("type").agg(F.count(F.lit(1)).alias("n"))


_EDGES = f"""{_COMMUNITIES}, {_SIMILAR}, e AS (
  SELECT doc_id AS source, id AS target, 'contains' AS type FROM latest UNION ALL
  SELECT id, 'heading:' || sha1(path || ':' || heading)[1:14], 'under_heading' FROM latest WHERE heading <> '' UNION ALL
  SELECT id, 'term:' || sha1(item)[1:14], 'mentions' FROM ({_items("terms")}) UNION ALL
  SELECT doc_id, 'term:' || sha1(item)[1:14], 'mentions' FROM ({_items("terms")}) UNION ALL
  SELECT id, 'citation:' || sha1(lower(item))[1:14], 'cites' FROM ({_items("citations")}) UNION ALL
  SELECT id, 'external_link:' || sha1(lower(item))[1:14], 'links_to' FROM ({_items("links")}) UNION ALL
  SELECT id, 'figure:' || sha1(id || ':' || item)[1:14], 'has_figure' FROM ({_items("figures")}) UNION ALL
  SELECT id, 'table:' || sha1(id || ':' || item)[1:14], 'has_table' FROM ({_items("table_records")})),
g AS (SELECT source, target, type, count(*)::DOUBLE AS weight FROM e GROUP BY ALL UNION ALL
  SELECT source, target, 'related_to', jaccard FROM sim UNION ALL
  SELECT doc_id, 'community:' || sha1(label)[1:14], 'member_of', weight::DOUBLE FROM members)"""


@_query(f"WITH {_EDGES} SELECT type, count(*) AS n, round(sum(weight), 2) AS weight FROM g GROUP BY type")
def edges_by_type(spark, sf):
    return graph.edges(_slim(spark, sf)).groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("weight"), 2).alias("weight"))


@_query(f"""WITH {_EDGES}, b AS (SELECT DISTINCT * FROM (SELECT source AS node, target AS o FROM g WHERE type NOT IN ('cites', 'links_to') UNION ALL SELECT target, source FROM g WHERE type NOT IN ('cites', 'links_to')))
SELECT node, count(*) AS degree FROM b GROUP BY node""")
def neighbour_degrees(spark, sf):
    c = _slim(spark, sf)
    return graph.degrees(graph.edges(c), graph.plain_ids(c))


@_query(f"""WITH {_COMMUNITIES}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, id) AS fk FROM latest) WHERE fk <= 3),
ft AS (SELECT doc_id, unnest(list_filter(terms, lambda x: x IS NOT NULL AND trim(x) <> '')[1:8]) AS term FROM first),
n AS (SELECT label, term, count(*) AS n FROM members JOIN ft USING (doc_id) GROUP BY ALL)
SELECT label, term, n, place FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS place FROM n) WHERE place <= 12""")
def community_terms(spark, sf):
    return graph.community_terms(_chunks(spark, sf))


@_query(f"""WITH {_COMMUNITIES}, first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ordinal, id) AS fk FROM latest) WHERE fk <= 3),
ft AS (SELECT doc_id, unnest(list_filter(terms, lambda x: x IS NOT NULL AND trim(x) <> '')[1:8]) AS term FROM first),
tn AS (SELECT label, term, count(*) AS n FROM members JOIN ft USING (doc_id) GROUP BY ALL),
tt AS (SELECT label, list(term ORDER BY place) AS top FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY n DESC, term) AS place FROM tn) WHERE place <= 12 GROUP BY label),
md AS (SELECT label, count(*) AS documents FROM members GROUP BY label),
named AS (SELECT label, documents, top, array_to_string(list_filter(top[1:5], lambda x: x <> label), ', ') AS names FROM md JOIN tt USING (label))
SELECT label, documents, array_to_string(top, '|') AS top_terms, 'Community around `' || label || '` spans ' || documents || ' document(s)' || CASE WHEN names <> '' THEN ' and is associated with ' || names ELSE '' END || '.' AS summary FROM named""")
def community_summaries(spark, sf):
    return graph.community_summaries(_chunks(spark, sf)).withColumn("top_terms", F.array_join("top_terms", "|"))


@_query()
def source_hash(spark, sf):
    return graph.source_hash(_chunks(spark, sf))


@_query(f"""WITH {_LATEST}, r AS (
  SELECT id, heading, 'figure' AS kind, item, k, 1600 AS lim FROM (SELECT id, heading, unnest(f) AS item, generate_subscripts(f, 1) AS k FROM (SELECT id, heading, list_filter(figures, lambda x: x IS NOT NULL AND trim(x) <> '') AS f FROM latest)) UNION ALL
  SELECT id, heading, 'table', item, k, 1200 FROM (SELECT id, heading, unnest(f) AS item, generate_subscripts(f, 1) AS k FROM (SELECT id, heading, list_filter(table_records, lambda x: x IS NOT NULL AND trim(x) <> '') AS f FROM latest)))
SELECT id AS chunk_id, kind, (k - 1)::INT AS place, item AS label, CASE WHEN length(t) > lim THEN rtrim(t[1:lim - 3]) || '...' ELSE t END AS retrieval_text FROM (SELECT *, {_collapse("concat_ws(chr(10), heading, item)")} AS t FROM r)""")
def multimodal_records(spark, sf):
    return artifacts.multimodal_records(_chunks(spark, sf))


# retrieval


@_query("""WITH s AS (SELECT source AS qid, doc_id AS key, n_chars::DOUBLE AS a, length(title)::DOUBLE AS b FROM documents WHERE source IS NOT NULL),
r AS (SELECT qid, key, 1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY a DESC, key)) AS r FROM s WHERE a > 0 UNION ALL SELECT qid, key, 1 / (60 + row_number() OVER (PARTITION BY qid ORDER BY b DESC, key)) FROM s WHERE b > 0),
f AS (SELECT qid, key, sum(r) AS rrf FROM r GROUP BY ALL)
SELECT qid, key, round(rrf / max(rrf) OVER (PARTITION BY qid), 6) AS rrf FROM f""")
def rrf_fusion(spark, sf):
    d = _t(spark, sf, "documents").filter("source is not null")
    a = d.select(F.col("source").alias("qid"), F.col("doc_id").alias("key"), F.col("n_chars").cast("double").alias("score"))
    b = d.select(F.col("source").alias("qid"), F.col("doc_id").alias("key"), F.length("title").cast("double").alias("score"))
    return retrieval.rrf([a, b]).withColumn("rrf", F.round("rrf", 6))


@_query("SELECT source AS qid, doc_id AS key, n_chars / max(n_chars) OVER (PARTITION BY source) AS score FROM documents WHERE n_chars > 0")
def normalize_scores(spark, sf):
    d = _t(spark, sf, "documents").select(F.col("source").alias("qid"), F.col("doc_id").alias("key"), F.col("n_chars").cast("double").alias("score"))
    return retrieval.normalize_scores(d, "score")


def _search(spark, sf, mode, embedding):
    index = retrieval.ChunkIndex.build(_t(spark, sf, "kg_documents"), _t(spark, sf, "kg_chunks"), embedding)
    return retrieval.search(index, _asked(spark, sf), mode)


@_query()
def hybrid_search(spark, sf):
    return _search(spark, sf, "hybrid", "hash").drop("text")


@_query()
def lexical_search(spark, sf):
    return _search(spark, sf, "lexical", "none").drop("text")


@_query()
def retrieval_benchmark(spark, sf):
    items = _t(spark, sf, "eval_items")
    hits = _search(spark, sf, "lexical", "none")
    asked = items.select(F.col("item_id").alias("qid"), "expected_terms", F.array().cast("array<string>").alias("expected_files"))
    return benchmark.summarize(benchmark.judge(hits, asked))


@_query("""WITH q AS (SELECT vec_id AS query, embedding AS e FROM embeddings WHERE vec_id % 20 = 0),
c AS (SELECT query, vec_id AS key, round(list_cosine_similarity(e::DOUBLE[], embedding::DOUBLE[]), 6) AS cosine FROM q, embeddings WHERE vec_id <> query)
SELECT query, key, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, key) AS rank FROM c) WHERE rank <= 5""")
def vector_topk(spark, sf):
    v = _t(spark, sf, "embeddings")
    return nearest(v, v.filter("vec_id % 20 = 0"))


@_query("""WITH c AS (SELECT vec_id, embedding[1:32]::DOUBLE[] AS v FROM embeddings), n AS (SELECT vec_id, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS l FROM c),
u AS (SELECT vec_id, unnest(v) AS x, generate_subscripts(v, 1) - 1 AS bucket, l FROM n)
SELECT vec_id, bucket::INT AS bucket, round(x / l, 6) AS weight FROM u WHERE abs(round(x / l, 6)) >= 1e-9""")
def dense_to_sparse(spark, sf):
    return _t(spark, sf, "embeddings").select("vec_id", F.explode(V.dense_to_sparse(F.col("embedding"), 32)).alias("bucket", "weight"))


@_query()
def hash_embeddings(spark, sf):
    e = _t(spark, sf, "documents").select("doc_id", V.hash_embedding("text").alias("e"))
    return e.select("doc_id", F.size("e").alias("buckets"), F.round(V.sparse_cosine(F.col("e"), F.col("e")), 4).alias("norm"))


# quality


def _rules(rules, guard: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, line, '{r}' AS rule, content FROM lines WHERE {guard}regexp_matches(content, '{p}')" for r, p in rules)


_SCAN = f"""{_LINES}, plain AS ({_rules(quality.LINE_RULES, "")} UNION ALL {_rules(quality.TITLE_RULES, "line <= 20 AND starts_with(content, '# ') AND ")}),
st AS (SELECT *, {_strip("content")} AS s FROM lines),
refs AS (SELECT *, last_value(CASE WHEN regexp_matches(s, '{quality.REFERENCES}') THEN 1 WHEN starts_with(s, '## ') THEN 0 END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY line ROWS UNBOUNDED PRECEDING) AS state FROM st),
found AS (SELECT doc_id, line, rule, {_collapse("content")}[1:180] AS excerpt FROM plain UNION ALL
  SELECT doc_id, 1, 'crlf_line_endings', '' FROM documents WHERE contains(text, chr(13)) UNION ALL
  SELECT doc_id, line, 'packed_references', {_collapse("content")}[1:180] FROM refs WHERE state = 1 AND NOT regexp_matches(s, '{quality.REFERENCES}') AND len(regexp_extract_all(content, '{quality.NUMBERED_REFERENCE}')) >= 2)"""


@_query(f"WITH {_SCAN} SELECT doc_id, line::BIGINT AS line, rule, excerpt FROM found")
def assertion_scan(spark, sf):
    return quality.scan(_t(spark, sf, "documents"), "doc_id", "text").withColumn("line", F.col("line").cast("long"))


_RULES = [r for r, _ in (*quality.LINE_RULES, *quality.TITLE_RULES)] + ["crlf_line_endings", "packed_references"]


@_query("SELECT path, " + ", ".join(f"count(*) FILTER (rule = '{r}') AS {r}" for r in _RULES) + " FROM audit_findings GROUP BY path")
def findings_pivot(spark, sf):
    return quality.findings_by_rule(_t(spark, sf, "audit_findings"), _RULES)


@_query("""WITH b AS (SELECT path, count(*) AS before FROM audit_findings GROUP BY path), a AS (SELECT path, count(*) AS after FROM (SELECT DISTINCT run_id, path, line, rule, excerpt FROM audit_findings) GROUP BY path)
SELECT path, coalesce(before, 0) AS before, coalesce(after, 0) AS after, coalesce(after, 0) - coalesce(before, 0) AS delta FROM b FULL JOIN a USING (path)""")
def quality_compare(spark, sf):
    f = _t(spark, sf, "audit_findings")
    return quality.compare_findings(f, f.select("run_id", "path", "line", "rule", "excerpt").distinct())


def _literals() -> str:
    parts = [" + ".join(f"(length(text) - length(replace(text, '{s}', ''))) // {len(s)}" for s in ls) for _, ls in quality.LITERALS]
    rows = " UNION ALL ".join(f"SELECT doc_id, '{n}' AS issue, {p} AS n FROM documents" for (n, _), p in zip(quality.LITERALS, parts, strict=True))
    return rows + " UNION ALL SELECT doc_id, 'generic_page_alt', count(*) FILTER (starts_with(content, '![Page ')) FROM lines GROUP BY doc_id"


@_query(f"WITH {_SCAN}, lit AS ({_literals()}) SELECT doc_id, issue, n::BIGINT AS n FROM lit WHERE n > 0 UNION ALL SELECT doc_id, 'assertion_' || rule, count(*) FROM found GROUP BY ALL")
def issue_counters(spark, sf):
    return quality.issue_counters(_t(spark, sf, "documents"), "doc_id", "text")


@_query("""SELECT backend_requested, count(*) AS runs, sum((status <> 'ok')::INT)::BIGINT AS failed, sum(tokens)::BIGINT AS tokens, sum(asset_count)::BIGINT AS assets, sum(issue_total)::BIGINT AS issues,
round(sum((status <> 'ok')::INT) / count(*), 4) AS failed_share FROM audit_runs GROUP BY backend_requested""")
def audit_matrix(spark, sf):
    return quality.audit_matrix(_t(spark, sf, "audit_runs"))


@_query("SELECT backend_requested, e.key AS issue, sum(e.value)::BIGINT AS n FROM (SELECT backend_requested, unnest(map_entries(issue_counts)) AS e FROM audit_runs) GROUP BY ALL")
def issue_totals(spark, sf):
    return quality.issue_totals(_t(spark, sf, "audit_runs"))


# layout and tables


_BOX = "SELECT *, lower(trim(block_type)) AS kind FROM extraction_blocks WHERE bbox IS NOT NULL AND page_number IS NOT NULL"


@_query(f"""WITH b AS ({_BOX}), p AS (SELECT f.path, f.page_number, f.block_id AS figure_id, c.block_id AS caption_id,
  greatest(0, greatest(f.bbox.y0, c.bbox.y0) - least(f.bbox.y1, c.bbox.y1)) + CASE WHEN c.bbox.y0 < f.bbox.y0 THEN 100 ELSE 0 END AS distance
  FROM b f JOIN b c ON f.path = c.path AND f.page_number = c.page_number WHERE f.kind = 'figure' AND regexp_matches(c.text, '(?i)^\\s*(?:supplementary\\s+)?fig(?:ure)?\\.?\\s*S?\\d'))
SELECT path, page_number, figure_id, caption_id, round(distance, 4) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY figure_id ORDER BY distance, caption_id) AS r FROM p) WHERE r = 1""")
def figure_captions(spark, sf):
    return layout.figure_captions(_t(spark, sf, "extraction_blocks"))


@_query(f"""WITH b AS ({_BOX}), p AS (SELECT x.path, x.page_number, x.block_id, y.block_id AS table_id,
  greatest(0, least(x.bbox.x1, y.bbox.x1) - greatest(x.bbox.x0, y.bbox.x0)) * greatest(0, least(x.bbox.y1, y.bbox.y1) - greatest(x.bbox.y0, y.bbox.y0)) / least((x.bbox.x1 - x.bbox.x0) * (x.bbox.y1 - x.bbox.y0), (y.bbox.x1 - y.bbox.x0) * (y.bbox.y1 - y.bbox.y0)) AS overlap
  FROM b x JOIN b y ON x.path = y.path AND x.page_number = y.page_number WHERE x.kind = 'text' AND y.kind = 'table'),
r1 AS (SELECT *, row_number() OVER (PARTITION BY block_id ORDER BY overlap DESC, table_id) AS a FROM p WHERE overlap >= 0.35),
r2 AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY overlap DESC, block_id) AS c FROM r1 WHERE a = 1)
SELECT path, page_number, block_id, table_id, round(overlap, 4) AS overlap FROM r2 WHERE c = 1""")
def matching_tables(spark, sf):
    return layout.matching_tables(_t(spark, sf, "extraction_blocks"))


@_query("""WITH b AS (SELECT path, coalesce(len(regexp_extract_all(text, '[A-Za-z0-9]')), 0) AS n, lower(trim(block_type)) = 'figure' AS fig FROM extraction_blocks WHERE page_number <= 6)
SELECT path, sum(n)::BIGINT AS text_chars, round(sum(fig::INT) / count(*), 4) AS figure_share, sum(n) < 100 AND sum(fig::INT) > 0 AS scanned_like FROM b GROUP BY path""")
def page_traits(spark, sf):
    return layout.page_traits(_t(spark, sf, "extraction_blocks")).withColumn("text_chars", F.col("text_chars").cast("long"))


@_query()
def rendered_blocks(spark, sf):
    return layout.render_blocks(_t(spark, sf, "extraction_blocks"))


@_query()
def rendered_tables(spark, sf):
    b = _t(spark, sf, "extraction_blocks").filter("cell_rows is not null and size(cell_rows) > 0")
    cleaned = b.select("block_id", tables.clean_cells("cell_rows").alias("c"))
    merged = cleaned.select("block_id", tables.merge_continuations(F.col("c")).alias("m"))
    return merged.select("block_id", tables.render(F.col("m")).alias("markdown"))


# planning


@_query("""WITH n AS (SELECT filename AS relative, regexp_replace(filename, '\\.[^./]+$', '') AS stem, lower(regexp_extract(filename, '\\.([^./]+)$', 1)) AS suffix FROM audit_samples)
SELECT relative, CASE WHEN count(*) OVER (PARTITION BY lower(stem)) > 1 THEN stem || '__' || suffix || '.md' ELSE stem || '.md' END AS target FROM n""")
def batch_targets(spark, sf):
    return files.batch_targets(_t(spark, sf, "audit_samples").select(F.col("filename").alias("relative")))


@_query("""WITH m AS (SELECT min(fetched_at) + (max(fetched_at) - min(fetched_at)) / 2 AS mid FROM documents),
b AS (SELECT doc_id FROM documents, m WHERE fetched_at <= mid)
SELECT change, count(*) AS n FROM (SELECT CASE WHEN b.doc_id IS NULL THEN 'added' ELSE 'same' END AS change FROM documents d LEFT JOIN b USING (doc_id)) GROUP BY change""")
def incremental_manifest(spark, sf):
    d = _t(spark, sf, "documents")
    mid = d.agg((F.unix_micros(F.min("fetched_at")) + (F.unix_micros(F.max("fetched_at")) - F.unix_micros(F.min("fetched_at"))) / 2).alias("mid"))
    after = manifest.fingerprint(d, "doc_id", ["path", "text"], "v1")
    early = d.join(F.broadcast(mid)).filter(F.unix_micros("fetched_at") <= F.col("mid")).drop("mid")
    before = manifest.fingerprint(early, "doc_id", ["path", "text"], "v1")
    return manifest.classify(before, after, "doc_id").groupBy("change").agg(F.count(F.lit(1)).alias("n"))


@_query()
def sidecars(spark, sf):
    return artifacts.sidecars(_t(spark, sf, "documents"), "doc_id", "text")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
