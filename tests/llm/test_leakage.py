import random

from vellichor.llm.leakage import Index, holds_stretch, leaks, words_of

random.seed(3)
VOCAB = [f"{a}{b}{c}" for a in ("ka", "lo", "mi", "ru", "te", "vo") for b in ("na", "se", "ti", "go", "bu") for c in ("rin", "lax", "dor", "mel", "pas", "quo")]
ITEMS = [(k, " ".join(random.choices(VOCAB, k=40))) for k in range(60)]


def noise(n):
    return random.choices(VOCAB, k=n)


def variants():
    docs, want = [], set()
    for n in range(150):
        i, passage = random.choice(ITEMS)
        w = passage.split()
        kind = n % 5
        a = random.randrange(0, 20)
        part = w[a : a + 18]
        if kind == 1:
            part[5], part[11] = "changed", "again"
        elif kind == 2:
            part = [x for k, x in enumerate(part) if k not in (4, 9)]
        elif kind == 3:
            part = part[:6] + ["extra"] + part[6:]
        elif kind == 4:
            part = w[a : a + 9]
        text = " ".join(noise(70) + part + noise(70))
        if n % 2:
            text = text.replace(" ", "\n", 40).upper()
        docs.append((n, text, 1, "x"))
        if kind != 4:
            want.add((n, i))
    return docs, want


def test_brute_force_agrees(spark):
    docs, want = variants()
    docs += [(900, None, 1, "x"), (901, "", 1, "x"), (902, " ".join(ITEMS[0][1].split()), 1, "x"), (902, ITEMS[0][1], 1, "x"), (None, ITEMS[1][1], 1, "x")]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id int, t string")
    e = spark.createDataFrame([*ITEMS, (99, None), (98, "too short")], "item_id long, passage string")
    got = sorted((r.doc_id, r.item_id) for r in leaks(d, e).filter("doc_id is not null").collect())
    items = {i: words_of(p) for i, p in ITEMS}
    brute = sorted((n, i) for n, t, *_ in docs if t and n is not None for i, w in items.items() if holds_stretch(words_of(t), w))
    assert got == brute and want <= set(got) and got.count((902, 0)) == 2
    assert leaks(d.limit(0), e).collect() == [] and leaks(d, e.limit(0)).collect() == []


def test_words():
    assert words_of("<i>Café</i> [link](http://x) res-\nult [3, 4] 2.5 ﬁn **bold**ed") == ["cafe", "link", "result", "2", "5", "fin", "bolded"]


def test_bounds_and_pivots():
    ix = Index(ITEMS)
    assert (ix.block_low <= ix.low.min(1)).all() and (ix.block_max >= ix.weights.max(1) - 1e-6).all()
    # what is no pivot of a segment stays below its threshold
    for k in range(ix.n):
        lo, hi = ix.block_start[k // 8], ix.block_start[k // 8 + 1]
        own = {int(t): float(w) for t, w in zip(ix.block_term[lo:hi], ix.weights[lo:hi, k % 8], strict=True) if w}
        assert set(own) == set(ix.words[k].tolist())
        leads = {t for t in own if k // 8 in ix.lead_block[ix.lead_start[t] : ix.lead_start[t + 1]]}
        assert sum(w for t, w in own.items() if t not in leads) < ix.threshold[k]


def test_index_grows_with_the_words_only():
    many = [(k, " ".join(random.choices(VOCAB, k=40))) for k in range(600)]
    assert Index(many).nbytes <= 11 * Index(many[:60]).nbytes


def test_more_items_than_one_index_holds(spark, monkeypatch):
    from vellichor.llm import leakage

    docs = spark.createDataFrame([(k, p) for k, p in ITEMS[:9]], "doc_id long, text string")
    e = spark.createDataFrame(ITEMS, "item_id long, passage string")
    one = sorted(map(tuple, leaks(docs, e).collect()))
    monkeypatch.setattr(leakage, "MAX_INDEX_BYTES", 20 * 40 * leakage.WORD_BYTES)
    assert sorted(map(tuple, leaks(docs, e).collect())) == one and len(one) >= 9


def test_long_document(spark):
    t = " ".join(noise(60_000)) + " " + ITEMS[5][1] + " " + " ".join(noise(10))
    d = spark.createDataFrame([(1, t)], "doc_id long, text string")
    e = spark.createDataFrame(ITEMS, "item_id long, passage string")
    assert (1, 5) in {(r.doc_id, r.item_id) for r in leaks(d, e).collect()}
