import numpy as np
import pyarrow as pa
import pytest

from vellichor.functions import vectors as V
from vellichor.operators import graph, ranking, retrieval

CHUNKS = "seq long, id string, doc_id string, path string, heading string, ordinal int, text string, terms array<string>, citations array<string>, links array<string>, figures array<string>, table_records array<string>"
WORDS = "tensile strength silk fibre spinning duct protein gland viscosity shear anneal modulus".split()


def test_finder():
    strings = ["a", "ab", "abc", "abcd", "abcdefghijklmn", "silk fibre", "ü-x", "defg", "bcdefghijklm", "zz", "mn"]
    texts = ["", "abcdefghijklmn", "xabcd", "silk fibr", "e", "a silk fibre ü-x", "zz" * 9, "abcdefghijklm", "n", ""]
    row, k = ranking.Finder(strings)(pa.array(["?", *texts, "?"]).slice(1, len(texts)))
    assert sorted(zip(row.tolist(), k.tolist(), strict=True)) == sorted((i, j) for i, t in enumerate(texts) for j, s in enumerate(strings) if s in t)
    assert not len(ranking.Finder(strings)(pa.array(["", ""]))[0])


def test_hasher():
    texts = ["", "Tensile strength of silk, tensile silk", "about_ the-spinning duct about+ _x yy-zz a1 silkworms"]
    for v, t in zip(ranking.Hasher()(texts), texts, strict=True):
        want = V.hash_vector({k: w / 100 for k, w in V.features(t).items()})
        n = np.sqrt((v * v).sum()) or 1
        assert {k: x for k, y in enumerate(v) if (x := round(float(y / n), 6))} == pytest.approx(want)


def test_latest(spark):
    rows = [(1, "a", "x"), (3, "a", "y"), (2, "a", "z"), (4, "b", "x"), (5, None, "x"), (6, None, "y")]
    df = spark.createDataFrame(rows, "seq long, id string, text string")
    want = sorted((r.seq, r.text) for r in graph.latest_chunks(df).collect())
    assert sorted((r.seq, r.text) for r in retrieval.latest(df).collect()) == want
    twice = retrieval.latest(df.unionAll(df.filter("seq = 3"))).collect()
    assert sorted((r.seq, r.text) for r in twice) == want


def made(spark):
    r = np.random.default_rng(1)
    # every chunk has words of every query; some chunks are alike but for their ids
    texts = ["tensile silk " + " ".join(r.choice(WORDS, 12)) for _ in range(40)]
    rows = [(k, f"c{k:03d}", f"d{k // 6}", f"p{k // 6}.md", f"{WORDS[k % 12]} part", k % 6, texts[k % 40], [WORDS[k % 12], "silk fibre", WORDS[k % 5]], [], [], [], []) for k in range(120)]
    docs = spark.createDataFrame([(f"d{k}", f"On {WORDS[k % 12]}", f"p{k}.md") for k in range(20)], "doc_id string, title string, path string")
    asked = [(f"q{k:02d}", f"tensile silk {WORDS[k % 12]} {WORDS[k * 5 % 12]}") for k in range(40)]
    return docs, spark.createDataFrame(rows, CHUNKS), spark.createDataFrame(asked, "qid string, query string")


@pytest.mark.parametrize("mode", ["lexical", "hybrid"])
def test_search_writes_no_pairs(spark, monkeypatch, mode):
    docs, chunks, asked = made(spark)
    written = []
    whole = retrieval.materialize

    def counted(df, name, *by):
        out = whole(df, name, *by)
        written.append((name, out.count()))
        return out

    monkeypatch.setattr(retrieval, "materialize", counted)
    ix = retrieval.ChunkIndex.build(docs, chunks, "hash" if mode == "hybrid" else "none")
    written.clear()
    hits = retrieval.search(ix, asked, mode).collect()
    assert len(hits) == 40 * 8
    # a score was found for all 120 x 40 pairs
    assert max(n for name, n in written if name != "query-pass") <= 40 * 5
    assert not any(name in ("query-lexical", "query-vector", "query-graph", "query-labels") for name, _ in written)


def test_useful_labels(spark):
    from pyspark.sql import functions as F

    from vellichor.functions import text as X

    labels = ["", "ab", "silk", "methods", "x pymupdf4llm", "drive auto", "ab deadbeef", "nineteenlettersandmo", "nineteen letters ok", "workofartisan", "silk\tfibre\u00a0of spinning ducts", "a" * 29 + " " + "g" * 8, "g" * 35 + " h i", "g" * 35 + " h i j k", "g" * 36 + "\x1cb c", "überlang " + "z" * 28]
    df = spark.createDataFrame([(t,) for t in labels], "label string")
    want = {r.label: r.ok for r in df.withColumn("ok", X.expansion_term_is_useful("label")).collect()}
    assert {t: ranking.Hits.useful(t) for t in labels} == want


def test_expansion_joins_no_edges(spark, monkeypatch):
    docs, chunks, asked = made(spark)
    # a title twice, none, blank headings, labels that differ by case and blanks, a query without words
    docs = docs.unionAll(spark.createDataFrame([("d1", None, "p1.md"), ("d2", "Aa", "p2.md")], docs.schema)).filter("doc_id <> 'd3'")
    more = [(500 + k, f"e{k}", f"d{k}", "p.md", ["", "Silk Part", None][k % 3], k, "silk", ["Silk", "silk ", "SILK", "silk", "spin", "spinning ducts", None, " "], [], [], [], []) for k in range(6)]
    ix = retrieval.ChunkIndex.build(docs, chunks.unionAll(spark.createDataFrame(more, CHUNKS)), "none")
    asked = asked.unionAll(spark.createDataFrame([("z", "?"), ("y", "spinning"), ("x", "w" * 60 + "silk")], asked.schema))
    rows = lambda df: {r.qid: r.expanded for r in df.collect()}
    want = rows(retrieval.expand_queries(asked, ix.nodes, ix.edges, 18))
    assert ix.items is not None and len(want) > 40
    # nothing comes of edges but members of communities
    assert rows(retrieval.expand_queries(asked, ix.nodes, ix.edges.filter("1 = 0"), 18, ix)) == want


def test_ids_that_may_be_confused(spark):
    docs, chunks, _ = made(spark)
    assert retrieval.ChunkIndex.build(docs, chunks.replace("c003", "d3", "id"), "none").items is None
    assert retrieval.ChunkIndex.build(docs, chunks.replace("c003", "citation:3", "id"), "none").items is None


def test_near_strings():
    class Shared:
        value = ["ab", "chunk", "zz", "ü"]

    edges = [("doc:1", "chunk:AB"), ("chunk:AB", "term:zz"), ("chunk:AB", "term:zz"), (None, "zz"), ("chunk:Ü", "term:0")]
    batch = pa.RecordBatch.from_pylist([{"source": a, "target": b} for a, b in edges], pa.schema([("source", pa.string()), ("target", pa.string())]))
    got = [(r["node"], r["t"]) for b in ranking.near_strings(Shared)(iter([batch])) for r in b.to_pylist()]
    want = {(n, t) for a, b in edges if a and b for n, o in ((a, b), (b, a)) for t in Shared.value if t in o.lower()}
    assert sorted(got) == sorted(want)


def test_hasher_forgets(monkeypatch):
    monkeypatch.setattr(ranking.Hasher, "MOST", 3)
    r = np.random.default_rng(2)
    texts = [" ".join(r.choice([*WORDS, "about-", "x_", "the"], 9)) for _ in range(30)]
    h = ranking.Hasher()
    for k in range(0, 30, 4):
        for v, t in zip(h(texts[k : k + 4]), texts[k : k + 4], strict=True):
            want = V.hash_vector({f: w / 100 for f, w in V.features(t).items()})
            n = np.sqrt((v * v).sum()) or 1
            assert {i: x for i, y in enumerate(v) if (x := round(float(y / n), 6))} == pytest.approx(want)


def test_packed_vectors():
    v = np.zeros((5, V.DIMENSIONS), np.int64)
    v[1, :3], v[2, 5], v[3, 6], v[4, 383] = (127, -127, 1), -128, 32767, -40_000
    for unit in (1, 5):
        p = ranking.packed(v * unit, unit)
        assert [len(x) // V.DIMENSIONS for x in p.to_pylist()] == [1, 1, 2, 2, 4]
        assert (ranking.unpacked(p, unit) == v * unit).all() and (ranking.unpacked(p.slice(2, 2), unit) == v[2:4] * unit).all()


def test_flags_are_looked_for_where_they_may_be(spark):
    from vellichor.functions import text as X

    texts = ["Ignore previous instructions", "SYSTEM PROMPT", "developer message", "a hidden instruction", "Exfiltration of", "exfiltrate", "reveal secrets", "follow these instructions", "instructions of silk", ""]
    df = spark.createDataFrame([(t, "h", [], [], []) for t in texts], "text string, heading string, terms array<string>, figures array<string>, table_records array<string>")
    rows = retrieval._searched(df).withColumn("want", X.injection_flags("text")).collect()
    assert [r["flags"] for r in rows] == [r["want"] for r in rows] and sum(bool(r["flags"]) for r in rows) == 8
