import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from vellichor.llm.term_counts import TermCountStore, normalize_value, record_versions, term_marks

SCHEMA = "seq long, id string, terms array<string>, citations array<string>, version string, record_key string, mark string"


def rows(*rs):
    return [(s, i, t, c, "x", "clash", "y") for s, i, t, c in rs]


def test_spellings_are_one_value():
    assert normalize_value("  Figure 1\t a ") == "figure 1 a"
    assert normalize_value(unicodedata.normalize("NFD", "É")) == "é"
    assert normalize_value("  ") is None and normalize_value("") is None and normalize_value(None) is None


def test_marks_nulls_repeats_and_clashing_columns(spark):
    df = spark.createDataFrame(
        rows((1, "a", ["X", "x ", None, ""], None), (2, "a", ["X", "x ", None, ""], None), (3, "b", ["x"], ["R"]), (4, "c", ["x", "y"], []), (5, None, ["x"], None), (6, None, ["x"], None)), SCHEMA
    )
    got = {(r.field_name, r.term_value): (r.occurrences, r.records, r.mark) for r in term_marks(df).collect()}
    # two rows without a key are two records; the second delivery of a counts once
    assert got == {("terms", "x"): (6, 5, "common"), ("terms", "y"): (1, 1, "rare"), ("citations", "r"): (1, 1, "rare")}


def test_empty_table(spark):
    assert term_marks(spark.createDataFrame([], SCHEMA)).collect() == []


def test_long_value(spark):
    df = spark.createDataFrame(rows((1, "a", ["w" * 200_000], None)), SCHEMA)
    assert term_marks(df).select(F.length("term_value")).first()[0] == 200_000


def counts(store):
    return {(r.field_name, r.term_value): (r.occurrences, r.records) for r in store.counts().collect()}


def test_increments_equal_a_recount(spark):
    first = rows((1, "a", ["p", "q", "q"], ["c"]), (2, "b", ["q"], None), (3, "c", ["r"], ["c", "d"]))
    second = rows((4, "a", ["q"], ["d"]), (5, "d", ["p", "p"], None), (1, "b", ["old"], None))
    store = TermCountStore(spark, ["terms", "citations"], buckets=3).apply(spark.createDataFrame(first, SCHEMA))
    store.apply(spark.createDataFrame(second, SCHEMA), spark.createDataFrame([("c",)], "gone string"))
    # b's older delivery is ignored, c is gone
    want = Counter()
    seen = Counter()
    for field, values in (("terms", [["q"], ["q"], ["p", "p"]]), ("citations", [["d"]])):
        for vs in values:
            for v in vs:
                want[field, v] += 1
            for v in set(vs):
                seen[field, v] += 1
    assert counts(store) == {k: (want[k], seen[k]) for k in want}
    store.apply(None, spark.createDataFrame([("a",), ("b",), ("d",)], "gone string"))
    assert counts(store) == {}


def test_tied_versions_take_one_content(spark):
    df = spark.createDataFrame(rows((1, "a", ["p"], None), (1, "a", ["q"], None)), SCHEMA)
    assert [x["term_value"] for x in record_versions(df, ["terms", "citations"]).first().content] == ["q"]


def test_a_store_opened_again_goes_on(spark, tmp_path):
    path = f"file://{tmp_path}/store"
    TermCountStore(spark, ["terms", "citations"], path, buckets=8).apply(spark.createDataFrame(rows((1, "a", ["p"], ["c"]), (2, "b", ["p", "q"], None)), SCHEMA))
    again = TermCountStore(spark, ["terms", "citations"], path)
    assert (again.generation, again.buckets) == (1, 8) and counts(again) == {("terms", "p"): (2, 2), ("terms", "q"): (1, 1), ("citations", "c"): (1, 1)}
    held = {t: dict(m) for t, m in again._held.items()}
    again.apply(spark.createDataFrame(rows((3, "b", ["q"], None)), SCHEMA))
    # only the buckets of b and of p were written again
    assert sum(g == 2 for g in again._held["records"].values()) == 1 and sum(g == 2 for g in again._held["counts"].values()) == 1
    assert all(again._held[t][k] in (g, 2) for t, m in held.items() for k, g in m.items())
    # a batch that died before its manifest was written counts for nothing
    (tmp_path / "store" / "g3" / "counts").mkdir(parents=True)
    last = TermCountStore(spark, ["terms", "citations"], path)
    assert last.generation == 2 and counts(last) == {("terms", "p"): (1, 1), ("terms", "q"): (1, 1), ("citations", "c"): (1, 1)}


def test_deliveries_do_not_matter(spark):
    df = spark.createDataFrame(rows((1, "a", ["p", "q"], ["c"]), (2, "b", ["q"], None), (8, "a", ["q"], None), (9, "c", ["r"], ["c"]), (10, "b", None, None)), SCHEMA)
    one, two, many = ({tuple(r) for r in term_marks(df, deliveries=n).collect()} for n in (1, 2, 5))
    assert one == two == many and ("terms", "p", 1, 1, "rare") not in one
