import math
import random

from vellichor.llm.truncation import _fit, ending, fit_endings, limit_table, truncated, truncation_by_source, word_states

W = ({"rate": (100, 60), "word": (100, 0), "error": (80, 0), "site": (50, 30), "Test": (60, 0), "basin": (40, 20), "The": (300, 0)})
CUT = ["The rate of the", "The rate [truncated]", "It was … Continue reading", "| a | b |\n| --- | --- |\n| 1 | 2", "Text.\n\n```py\nx = 1", "It was kept (Fig.", "Keywords: mass rate, word", "- at Niamar Test", "1. Smith, A. On it. Annals 3, 4 (1999).\n2. Jones, B. On the", "Smith et al.", "Source: https://fil", "a\tb\n1\t2\nB", "It differed by 8."]
WHOLE = ["The rate of it.", "Is it?", "He said “it is so.”", "| a | b |\n| --- | --- |\n| 1 | 2 |", "Text.\n\n```py\nx = 1\n```", "It is in Figure 1.", "Keywords: mass rate, site", "- at Niamar basin", "1. Smith, A. On it. Annals 3, 4 (1999).", "No change was seen according to the usual method of Smith et al.", "Source: https://files.x.example/1/a.pdf", "a\tb\n1\t2\n3\t4", "Last edited 2011-08-14 06:41", "rate\n1.2\n3.4\n5.0", "Text of it. Lot 7863.", "Alpha, 2, 4\nBeta, 3, 5", "It was kept.\n\n12", "", "  \n"]


def test_endings(spark):
    counted = spark.createDataFrame([(w, n, e) for w, (n, e) in W.items()], "word string, n long, ends long")
    asked = {s[1:] for t in CUT + WHOLE for _, s in [ending(t)] if s[0] == "="}
    state = {r.word: r.word_state for r in word_states(spark.createDataFrame([(w,) for w in sorted(asked)], "word string"), counted).collect()}
    odds, _, rate = fit_endings([], {})
    for t, cut in [(t, True) for t in CUT] + [(t, False) for t in WHOLE]:
        s = ending(t)[1]
        assert (odds[state[s[1:]] if s[0] == "=" else s] + rate > 0) == cut, (t, ending(t))


def test_states_of_words(spark):
    counted = spark.createDataFrame([("polymer", 40, 10), ("of", 900, 0), ("said", 500, 9), ("rarely", 300, 30), ("mer", -1, 0)], "word string, n long, ends long")
    asked = spark.createDataFrame([(w,) for w in ("polym", "polymer", "of", "said", "rarely", "mer", "Umberto", "zz", "of")], "word string")
    assert {r.word: r.word_state for r in word_states(asked, counted).collect()} == {"polym": "broken", "polymer": "usual", "of": "never", "said": "seldom", "rarely": "some", "mer": "unseen", "Umberto": "name", "zz": "unseen"}


def test_limits_and_endings_are_weighed_together():
    counts = [("open", "at 80", 30), ("closed", "at 80", 2), ("closed", "at 90", 12), ("open", None, 20), ("closed", None, 900), ("some", None, 40), ("some", "at 80", 1)]
    odds, prior, rate = fit_endings(counts, {"at 80": 0.95, "at 90": 0.95})
    # what is unclear elsewhere is cut at a limit whose texts stop open
    assert odds["some"] + rate < 0 < odds["some"] + prior["at 80"]
    # texts made to a length are no cuts, however many there are
    assert odds["closed"] + prior["at 90"] < 0 and prior["at 90"] < prior["at 80"]
    # without the censored lengths nothing tells such endings
    odds, prior, rate = fit_endings([(s, None, n) for s, _, n in counts], {})
    assert odds["some"] + rate < 0 and not prior


def test_the_censoring_posterior_moves_verdicts(spark, monkeypatch):
    from vellichor.llm import truncation

    full = "The rate of the basin was kept at the site and seen by all of them."
    rows = [(k, (full * 9)[:200], "s") for k in range(40)] + [(50 + k, f"The r{'o' * k}te. " + full * (1 + k % 3), "s") for k in range(300)]
    # an item that stops at a word which now and then ends units; 700 at the limit, 701 not
    unit = " A mark of it is here." * 15 + " This is a mark."
    rows += [(400 + k, full + unit, "s") for k in range(20)]
    item = "- at the old mark"
    rows += [(700, ("It is so. " * 30)[: 200 - len(item) - 2] + ".\n" + item, "s")]
    rows += [(701 + k, "It is so. " * (3 + k) + "\n" + item, "s") for k in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r for r in truncated(df).collect()}
    assert got[700].state == got[701].state == "some" and got[700].n_chars == 200
    assert got[700].is_cut and not any(got[701 + k].is_cut for k in range(10))
    monkeypatch.setattr(truncation, "limit_table", lambda *_: ({}, {"s"}))
    without = {r.doc_id: r for r in truncated(df).collect()}
    assert not without[700].is_cut


def test_censored_fit():
    random.seed(2)
    n: dict[int, int] = {}
    for _ in range(4000):
        x = int(math.exp(random.gauss(6.5, 0.6)))
        if random.random() < 0.3:
            x = min(x, 800)
        n[x] = n.get(x, 0) + 1
    assert _fit(sorted(n.items()), [800])[800] > 0.9
    assert _fit([(5, 2)], [5]) == {}


def test_table_edges(spark):
    full = "The rate of the basin was kept at the site and seen by all of them."
    rows = [(k, full + f" Run {k} of it was like this one.", ["S a", "s_a", None][k % 3], 1, "x") for k in range(60)]
    rows += [(100 + k, (full * 5)[:200], "cutter", 1, "x") for k in range(12)] + [(200 + k, full * (1 + k % 4), "cutter", 1, "x") for k in range(30)]
    rows += [(300, None, "s_a", 1, "x"), (301, "", "s_a", 1, "x"), (100, (full * 5)[:200], "cutter", 1, "x"), (302, full * 3000 + " and then it", None, 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, is_cut int, n_chars string")
    got = truncated(df)
    cut = sorted(r.doc_id for r in got.filter("is_cut").collect())
    assert cut == [100, 100, *range(101, 112), 302]
    assert got.filter("doc_id = 101").first().limit_posterior > 0.5
    share = {r.source_name: (r.documents, r.cut) for r in truncation_by_source(got).collect()}
    assert share["cutter"] == (43, 13) and share["s_a"][1] == 0 and share[None][1] == 1
    assert truncated(df.limit(0)).collect() == []


def test_small_sources_are_fitted_together(spark):
    full = "The rate of the basin was kept at the site and seen by all of them."
    rows = [(k, full * (1 + k % 5), "big", 1, "x") for k in range(200)]
    # five texts a source, one of them dealt at 200 characters
    rows += [(1000 + 5 * s + k, (full * 5)[:200] if k == 0 else full * (1 + (s + k) % 7), f"host {s}", 1, "x") for s in range(40) for k in range(5)]
    got = {r.doc_id: r for r in truncated(spark.createDataFrame(rows, "doc_id long, text string, source string, is_cut int, n_chars string")).collect()}
    assert all(got[1000 + 5 * s].limit_posterior > 0.5 for s in range(40))
    # a limit of the small sources is none of the large one
    df = spark.createDataFrame([(s, 200 if k == 0 else 60 + 7 * s + k) for s in range(40) for k in range(5)], "s long, n int").selectExpr("concat('host_', s) as source_name", "n")
    limits, alone = limit_table(df.unionAll(df.selectExpr("'big'", "n + 1000")))
    assert alone == {"big"} and limits["POOLED", 200] > 0.5 and ("big", 200) not in limits
