import numpy as np
import pytest

from vellichor.llm.mixing import TOKENIZER, mix, quotas, sainte_lague

pytest.importorskip("tiktoken")


def slow(w, total, caps):
    s = [0] * len(w)
    for _ in range(total):
        q = [w[k] / (2 * s[k] + 1) if s[k] < caps[k] and w[k] > 0 else -1 for k in range(len(w))]
        if max(q) <= 0:
            break
        s[int(np.argmax(q))] += 1
    return s


def test_apportionment():
    rng = np.random.default_rng(5)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        w, c, t = rng.random(n) * (rng.random(n) > 0.2), rng.integers(0, 40, n), int(rng.integers(0, 120))
        assert sainte_lague(w, t, c).tolist() == slow(w, t, c)
    assert sainte_lague(np.array([1.0, 1.0]), 10**10, np.array([10**12] * 2)).tolist() == [5 * 10**9] * 2


def test_quotas_keep_caps():
    rows, report = quotas([("a", 0, 10_000), ("b", 0, 100_000), ("b", 1, 100_000)], [("m", "a", 1, 2), ("m", "b", 1, 1), ("m", "none", 1, 3)], 100, None)
    got = {r[1]: r[6] for r in report}
    assert got == {"a": 200, "b": 200, "none": 0} and sum(r[3] for r in rows if r[1] == "b") == 200


def test_source_below_a_block_does_not_empty_a_mix():
    sizes = [("a", 0, 10_000), ("b", 0, 40_000), ("tiny", 0, 30)]
    rows, report = quotas(sizes, [("m", "a", 1, 2), ("m", "b", 1, 1), ("m", "tiny", 1, 3), ("z", "tiny", 1, 2)], 100, None)
    assert {(r[0], r[1]): r[6] for r in report} == {("m", "a"): 200, ("m", "b"): 200, ("m", "tiny"): 3, ("z", "tiny"): 2}
    assert ("m", "tiny", 0, 3, 1, 30) in rows
    _, report = quotas(sizes, [("m", "a", 1, 2), ("m", "tiny", 1, 3)], 100, 1000)
    assert {r[1]: r[6] for r in report} == {"a": 7, "tiny": 3}


def docs(spark):
    rows = []
    for k in range(600):
        rows.append((k, f"word {k} of the text " * (3 + k % 7), ["A b", "a_b", "a-B "][k % 3] if k % 10 else "small", 1, "x"))
    rows += [(700, None, "small", 1, "x"), (701, "", "small", 1, "x"), (702, "text", None, 1, "x"), (703, "text", " ", 1, "x"), (1, "word of it", "A b", 1, "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, tokens int, shard string")


TARGETS = [("m", "a b", 0.5, 2), ("m", "Small", 0.5, 3), ("m", "missing", 0.2, 2), ("n", "a_b", 2.0, 1), (None, "a_b", 1.0, 1), ("m", None, 1.0, 1), ("z", "small", None, None)]


def test_mixture(spark):
    t = spark.createDataFrame(TARGETS, "mix_name string, source_name string, target_weight double, max_repeats int")
    m = mix(docs(spark), t, block_tokens=64)
    share = {(r.mix_name, r.source_name): r for r in m.shares().collect()}
    assert abs(share["m", "a_b"].actual_share - 0.5) < 0.02 and abs(share["m", "small"].actual_share - 0.5) < 0.02
    assert share["m", "small"].most_repeats <= 3 and share["m", "a_b"].most_repeats <= 2 and share["m", "missing"].mixed_tokens == 0
    assert share["z", "small"].mixed_tokens == 0
    again = mix(docs(spark), t, block_tokens=64).records
    key = ["mix_name", "source_name", "row_id", "repeat_no"]
    assert sorted(map(tuple, again.select(key).collect())) == sorted(map(tuple, m.records.select(key).collect()))


def test_empty_tables(spark):
    t = spark.createDataFrame(TARGETS, "mix_name string, source_name string, target_weight double, max_repeats int")
    assert mix(docs(spark).limit(0), t).records.collect() == []
    assert mix(docs(spark), t.limit(0)).records.collect() == []


def test_long_text_counts_like_short():
    from vellichor.llm.mixing import _long, tokenizer

    e = tokenizer(TOKENIZER).encode_ordinary
    t = "some words  with\n\n spaces and 1234 " * 8000
    assert _long(e, t) == len(e(t))
