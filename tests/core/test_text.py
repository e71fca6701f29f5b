import pytest
from pyspark.sql import functions as F

from vellichor.functions import text as X
from vellichor.functions import vectors as V


def one(spark, column, **values):
    schema = ", ".join(f"{k} string" for k in values)
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("r")).first().r


def test_tokens(spark):
    assert one(spark, X.tokens("t"), t="The and- Foo_bar x1 + spider's 9a über") == ["and", "foo_bar", "x1", "spider", "ber"]
    assert one(spark, X.tokens("t"), t="") == []


def test_strip_and_compact(spark):
    assert one(spark, X.strip("t"), t="  a b \n") == "a b"
    assert one(spark, X.compact("t", 10), t="aaaa  bbbb\ncccc") == "aaaa bb..."
    assert one(spark, X.rough_tokens("t"), t="a b c") == 4 and one(spark, X.rough_tokens("t"), t="") == 1


@pytest.mark.parametrize(("t", "n"), [("a\nb", 2), ("a\n\n", 2), ("a\r\nb\rc", 3), ("", 0), ("x\x0by", 2)])
def test_lines_like_splitlines(spark, t, n):
    assert one(spark, X.lines("t"), t=t) == t.splitlines() and len(t.splitlines()) == n


def test_front_matter_and_title(spark):
    t = '---\ntitle: "A: b"\nTitle: last\nnote\n---\n# Heading\n'
    assert one(spark, X.front_matter("t"), t=t) == {"title": "last"}
    assert one(spark, X.document_title("t", "p"), t="x\n## **Head** ing\n", p="a/my_file.md") == "Head ing"
    assert one(spark, X.document_title("t", "p"), t="plain", p="a/my_file.v2.md") == "my file.v2"
    assert one(spark, X.front_matter("t"), t="none") == {}


def test_citations_links_figures(spark):
    t = "See [1, 2-3] and doi:10.1234/ab.c, Fig. 2b; [[Page#x|y]] [l](http://u) ![A *b*](p.png) ![](q.png)"
    assert one(spark, X.citations("t"), t=t) == ["doi:10.1234/ab.c", "ref:1,2-3", "Fig. 2b"]
    assert one(spark, X.links("t"), t="[[Page#x|y]] [l](http://u)") == ["Page", "http://u"]
    assert one(spark, X.figure_records("t"), t=t) == ["A b (p.png)", "Figure (q.png)"]


def test_table_records(spark):
    rows = ["| a | b |", "| --- | --- |", *(f"| {k} | v{k} |" for k in range(6))]
    assert one(spark, X.table_records("t"), t="\n".join(rows)) == ["a | b | 0 | v0 | 1 | v1"]
    assert one(spark, X.table_records("t"), t="| a | b |\n| 1 | 2 |") == ["a | b | 1 | 2"]
    assert one(spark, X.table_records("t"), t="| a | b |") == []


def test_flags_and_warnings(spark):
    assert one(spark, X.injection_flags("t"), t="Ignore previous instructions. SYSTEM PROMPT; system prompt") == ["ignore previous instructions", "system prompt"]
    assert one(spark, X.extraction_warnings("t"), t="a meas- ured Ã value, following the equation:") == ["hyphenated_line_break", "mojibake", "missing_equation"]
    assert one(spark, X.looks_fused("t"), t="Thisisalabelwhosewordsrantogetherintoone") is True and one(spark, X.looks_fused("t"), t="short") is False


def test_figure_label(spark):
    assert one(spark, X.figure_label("t"), t="Supplementary Fig. S3B: x") == "supplementary figure s3b"
    assert one(spark, X.figure_label("t"), t="nothing") is None


def test_hash_vector_is_a_unit_vector(spark):
    v = V.hash_vector({k: n / 100 for k, n in V.features("Spider silk fibres and spider silk").items()})
    assert abs(sum(x * x for x in v.values()) - 1) < 1e-5 and V.hash_vector({}) == {}
    df = spark.createDataFrame([("spider silk", "spider silk"), ("spider silk", "")], "a string, b string")
    got = [r.c for r in df.select(V.sparse_cosine(V.hash_embedding("a"), V.hash_embedding("b")).alias("c")).collect()]
    assert abs(got[0] - 1) < 1e-4 and got[1] == 0


def test_dense(spark):
    df = spark.createDataFrame([([3.0, 4.0], [3.0, 4.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(V.dense_cosine(F.col("a"), F.col("b")).alias("c"), V.dense_cosine(F.col("a"), F.col("z")).alias("z"), V.dense_to_sparse(F.col("a"), 2).alias("s")).first()
    assert abs(r.c - 1) < 1e-9 and r.z is None and r.s == {0: 0.6, 1: 0.8}


def test_whole_documents_keep_all_records(spark, tmp_path):
    from vellichor import entries

    text = "\n".join([f"![a{k}](p{k}.png)" for k in range(25)] + [f"| r{k} | x |" for k in range(100)])
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert entries.queries()["figures"](spark, str(tmp_path)).count() == 25
    assert entries.queries()["table_records"](spark, str(tmp_path)).count() == 25
    assert len(one(spark, X.figure_records("t"), t=text)) == 20 and len(one(spark, X.table_records("t"), t=text)) == 20


def test_labels_of_words_that_ran_together(spark):
    for t, fused in (("Mechanical-properties-of-spider-silk-fibres", True), ("Mechanical properties of spider silk fibres and films", False), ("", False)):
        assert one(spark, X.looks_fused("t"), t=t) is fused


def test_labels_of_tables_and_groups(spark):
    assert one(spark, X.figure_label("t"), t="Extended Data Fig. 2b | x") == "extended data figure 2b" and one(spark, X.figure_label("t", False), t="Table  4A") == "table 4"
    assert one(spark, X.figure_label("t"), t="scheme 3") is None and one(spark, X.figure_label("t"), t="fig 3") is None


def test_unicode_repair(spark):
    assert one(spark, X.fix_unicode("t"), t="cafÃ© 5") == "café 5" and one(spark, X.fix_unicode("t"), t="ﬁbre\x07 e\u0301 5 þ 3") == "fibre é 5 + 3"
    assert one(spark, X.fix_unicode("t"), t="plain\n") == "plain\n" and one(spark, X.fix_unicode("t"), t=None) is None
