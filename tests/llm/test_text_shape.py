import numpy as np

from vellichor.llm.text_shape import STATISTICS, ProseModel, chi2_quantile, shapes, statistics

PROSE = ["The sample was kept at {0} °C and then it was measured by the team for the whole of the night. It did not change at all.", "In the second run, the value of the signal was {0} and this is what the authors had expected from it.\nThe rest of the records were not used.", "We found that the rate of the loss is {0} in the first series, which was more than we had thought."]
LIST = ["- alpha curing\n- beta rinsing\n- gamma filtration\n- delta dialysis", "1. First item of it\n2. Second item\n3. Third item\n4. Fourth", "1.1 Results ........ 2\n1.2 Discussion ....... 4\n2 Methods ......... 9", "Alpha, 12, 14\nBeta, 3\nGamma, 77, 80, 91"]
TABLE = ["| a | b |\n| --- | --- |\n| 1 | 2 |\n| 3 | 4 |", "Sample\tx\ty\nA1\t0.3\t1.2\nA2\t2.2\t9.1", "Table 3. Loss of it.\n\nA1;2.0;3.1\nB2;4.0;5.5\nC3;0.1;0.2", "hardness\n1.2\n3.3\nn.d.\n4.2\n5.0"]
JUNK = ["the " * 60, "qx zrtk bvnm lkj wrt ptk nbv zxc vbn mlk wrtz", "(cid:1) (cid:22) (cid:33) (cid:4) (cid:55) (cid:6) (cid:7)", "u i | e m , . a t s r | u u i . o u s e l | n s ."]


def table(spark):
    rows = [(k, PROSE[k % 3].format(k), "no", 1.0) for k in range(300)]
    rows += [(1000 + k, t, "no", 1.0) for k, t in enumerate(LIST)] + [(2000 + k, t, "no", 1.0) for k, t in enumerate(TABLE)] + [(3000 + k, t, "no", 1.0) for k, t in enumerate(JUNK)]
    rows += [(4000, None, "no", 1.0), (4001, "", "no", 1.0), (4002, " \n ", "no", 1.0), (1000, LIST[0], "no", 1.0), (None, PROSE[0].format(1), "no", 1.0)]
    return spark.createDataFrame(rows, "seq long, text string, shape string, language double")


def test_shapes(spark):
    got = shapes(table(spark)).select("seq", "shape", "distance2", "contribution").collect()
    by = {r.seq: r["shape"] for r in got}
    assert {by[k] for k in range(300)} == {"prose"} and by[None] == "prose"
    assert [by[1000 + k] for k in range(4)] == ["list"] * 4
    assert [by[2000 + k] for k in range(4)] == ["table"] * 4
    assert [by[3000 + k] for k in range(4)] == ["junk"] * 4
    assert 4000 not in by and 4001 not in by and 4002 not in by and sum(r.seq == 1000 for r in got) == 2
    for r in got[:20]:
        assert abs(sum(r.contribution.values()) - r.distance2) < 1e-6 * max(1, r.distance2)


def test_empty_table(spark):
    assert shapes(table(spark).limit(0)).collect() == []


def test_contributions_add_up():
    d = len(STATISTICS)
    a = np.random.default_rng(1).normal(size=(d, d))
    m = ProseModel({"none": np.zeros(d)}, {"none": a @ a.T})
    x = np.arange(d) / d
    assert np.isclose(m.contributions("xx", x).sum(), x @ a @ a.T @ x)
    assert abs(chi2_quantile(0.95, 10) - 18.307) < 0.05


def test_long_text():
    assert statistics("a" * 500_000 + "9")[0] == -1


def test_the_fitted_distance_decides(spark, monkeypatch):
    from vellichor.llm import text_shape

    rows = table(spark).filter("seq < 4000")
    fitted = {(r.seq, r["shape"]) for r in shapes(rows).select("seq", "shape").collect()}
    d = len(STATISTICS)
    # nothing fitted: centre 0, every statistic of unit spread
    monkeypatch.setattr(text_shape, "fit_prose", lambda stats, bound: ProseModel({"none": np.zeros(d)}, {"none": np.eye(d)}))
    plain = {(r.seq, r["shape"]) for r in shapes(rows).select("seq", "shape").collect()}
    assert len(fitted - plain) >= 10
    # fitted, but nothing lies outside
    monkeypatch.undo()
    monkeypatch.setattr(text_shape, "chi2_quantile", lambda p, k: 1e12)
    assert {r["shape"] for r in shapes(rows).select("shape").collect()} == {"prose"}


def test_leaders_of_any_length():
    assert text_shape_leaders("Results " + "." * 1000 + " " * 500 + "12") and not text_shape_leaders("It was ... 12345")


def text_shape_leaders(line):
    from vellichor.llm.text_shape import _leaders

    return _leaders(line)
