from vellichor.llm.scan_repair import Chain, Lexicon, analyse, broken, candidates, label_pieces, learn, looks, scan_noise

BODY = "The sample of the wall was kept and the rate of the loss was measured by the team"
CLEAN = [f"{BODY} in run {k}. What masks the resonance frequency here is the toughness of the thin-film stack." for k in range(400)]
NOISY = "The sample of the\nwall was k3pt and thc rate of the res-\nonance frequency was rneasured by\n- 31 -\nthe team. What rnasks the tough-\nness herc is the l0ss."


def table(spark):
    rows = [(k, t, "n", 1) for k, t in enumerate(CLEAN)] + [(1000 + k, NOISY.replace("31", str(k)), "n", 1) for k in range(6)]
    rows += [(2000, None, "n", 1), (2001, "", "n", 1), (2002, "12", "n", 1), (2003, "1\n2\n3.5\n4\n5\n6", "n", 1), (2004, "- a1b\n- b0d\n- c1d\n- d", "n", 1), (0, CLEAN[0], "n", 1)]
    return spark.createDataFrame(rows, "seq long, text string, noise string, row_key int")


def test_noise_and_repair(spark):
    df = table(spark)
    lex = learn(df)
    got = {}
    for r in scan_noise(df, lex, "seq").collect():
        got.setdefault(r.row_key, set()).add(r.noise)
    assert all(got[1000 + k] == {"hyphen", "misread", "furniture"} for k in range(6))
    assert got[2002] == {"furniture"} and set(got) == {2002, *range(1000, 1006)}
    fixed = scan_noise(df, lex, "seq", repair=True).filter("row_key = 1000").first().repaired
    assert fixed == "The sample of the wall was kept and the rate of the resonance frequency was measured by the team. What masks the toughness here is the loss." or "resonance frequency" in fixed and "toughness" in fixed and "\n" not in fixed and "31" not in fixed


def test_empty_table(spark):
    df = table(spark).limit(0)
    assert scan_noise(df, learn(df), "seq").collect() == []


WORDS = {"thin-film": (9, 0, 0), "resonance": (50, 0, 0), "thin": (40, 0, 0), "film": (40, 0, 0), "the": (500, 0, 0), "annals": (30, 0, 20), "structure": (60, 0, 20), "soil": (50, 0, 20), "chapter": (40, 0, 30)}
LEX = Lexicon(WORDS, 5000, 50)


def test_compounds_stay():
    assert not broken("thin", "-", "film", LEX) and broken("reson", "-", "ance", LEX) and broken("thin", "\xad", "film", LEX)


def labels(lines, lexicon=LEX, recurring=None):
    out = [0] * len(lines)
    for k, _, _, state in label_pieces(lines, lexicon, recurring):
        out[k] = state
    return out


def test_headers_and_ordinary_lines():
    lines = ["It was kept at the wall of the", "Chapter Notes and Tables 12", "first room and then it was", "moved to the last of them."]
    assert labels(lines) == [0, 1, 0, 0]
    lines[1] = "Annals of Soil Structure (Ziaburg) 14"
    assert labels(lines) == [0, 1, 0, 0]
    lines[1] = "- 14 -"
    assert labels(lines) == [0, 2, 0, 0]
    assert labels(["A wrapped line of the text and", "a second one of the same"]) == [0, 0]


def test_looks():
    kinds = {"12": "n", "- iv -": "n", "A N N A L S of it": "s", "Smith et al. / On walls": "d", "ANNALS OF SOIL": "u", "Soil and Water": "t", "Soil notes": "f", "It is so.": "o", "E = m c": "o", "sentence goes on": "o", "c": "o", "One, Two": "o"}
    assert {t: looks(t) for t in kinds} == kinds


def test_the_fitted_chain_decides(spark):
    # a page number follows every header; a number below ordinary capitals is none
    body = "It was kept at the wall of the"
    rows = [(k, f"{body}\nNotes of Brimhold\n{k % 90}\nfirst room and then it was moved.") for k in range(60)]
    rows += [(100 + k, f"It was kept at the wall of room {k}.\nThe End\nIt was moved to the last of them then.") for k in range(60)]
    df = spark.createDataFrame(rows, "seq long, text string")
    lex = learn(df)
    assert labels([body, "Notes of Brimhold", "12", "first room."], lex)[1:3] == [1, 2] and labels(["It was kept.", "The End", "It was moved."], lex) == [0, 0, 0]
    assert lex.chain.move[1][2] > 0.5 > Chain.MOVE[1][2]
    # with moves that nothing was learned from, a line that is neither alone is body
    same, lone = Lexicon(lex.words, lex.total, lex.noisy_total, Chain(lex.chain.start, ((1 / 3,) * 3,) * 3, lex.chain.emit)), ["It was kept.", "12", "It was moved."]
    found = {(k, x) for k, t in enumerate([r[1] for r in rows]) for x in [tuple(labels(t.split("\n"), lex))]}
    plain = {(k, x) for k, t in enumerate([r[1] for r in rows]) for x in [tuple(labels(t.split("\n"), same))]}
    assert found != plain or labels(lone, lex) != labels(lone, same)


def test_inline_header():
    found, fixed = analyse("It was the rate of the loss Zustad Annals of Soil Structure 14 that was seen by the team of the lab.", LEX, True)
    assert found == {"furniture"} and fixed == "It was the rate of the loss that was seen by the team of the lab."
    found, _ = analyse("The work is that of Smith, Zustad Annals of Soil Structure 14, 22 (1999), and it was the first of all.", LEX)
    assert found == set()


def test_header_of_one_document_counts_in_any_collection(spark):
    rows = [(k, f"Brimhold Wall Notes {k}\nIt was moved to the first room then.", "a", f"p{k}") for k in range(3)]
    rows += [(k, "Ordinary Capital Line\nIt was moved to the first room then.", "b", "p0") for k in (10, 11)]
    lex = learn(spark.createDataFrame(rows, "seq long, text string, doc string, part string"), "text", "doc", "part")
    again = {r.document: dict(r.lines) for r in lex.recurring.collect()}
    # repeated deliveries of one part are no recurrence
    assert again == {"a": {"brimhold wall notes": 3}}
    # the same line in the same chain, whatever the size of the collection
    for words in (WORDS, {w: (1000 * n, 0, 1000 * h) for w, (n, _, h) in WORDS.items()}):
        lines = ["Brimhold Wall Notes 2", "It was moved to the first room then."]
        assert labels(lines, Lexicon(words, 10**7, 50), again["a"]) == [1, 0] and labels(lines, Lexicon(words, 10**7, 50)) == [0, 0]


def test_candidates_are_bounded():
    assert "the" in set(candidates("thc")) and list(candidates("a" * 1000)) == []
