from hypothesis import given, settings
from hypothesis import strategies as st

from vellichor.llm.splitting import max_words, rough_tokens, split_offsets, split_oversized


def test_limits_in_words():
    for tokens in (1, 5, 60, 850):
        n = max_words(tokens)
        assert rough_tokens(n) <= tokens < rough_tokens(n + 1)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n!é ", max_size=400), max_size=4), st.integers(8, 40), st.integers(40, 200), st.integers(0, 6))
def test_pieces_keep_limits_and_cover_the_text(texts, tokens, chars, overlap):
    for text, pieces in zip(texts, split_offsets(texts, tokens, chars, overlap), strict=True):
        covered = set()
        for k, (s, e, fresh) in enumerate(pieces):
            assert e - s <= chars and rough_tokens(len(text[s:e].split())) <= tokens
            assert s <= fresh < e and (k == 0 or s <= pieces[k - 1][1] <= fresh or text[pieces[k - 1][1] : fresh].isspace())
            covered |= set(range(fresh if k else s, e))
        assert {i for i, c in enumerate(text) if not c.isspace()} <= covered


def greedy(text, tokens, chars, overlap):
    """The same cuts one after another, by trying all ends."""
    out = []
    table = split_offsets([text], tokens, chars, overlap)[0]
    for s, e, fresh in table:
        out.append((s, e, fresh))
        if e >= len(text.rstrip()):
            break
    return out


def test_doubling_gives_the_greedy_chain():
    text = " ".join(f"Word{k}." for k in range(4000))
    pieces = split_offsets([text])[0]
    assert pieces == greedy(text, 850, 4250, 60) and pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for (s, e, _), (s2, _, f2) in zip(pieces, pieces[1:], strict=False):
        repeated = rough_tokens(len(text[s2:f2].split()))
        assert s < s2 < f2 and 40 <= repeated <= 90


def test_prefers_paragraph_ends():
    text = "\n\n".join("lorem ipsum dolor " * 30 for _ in range(40))
    for s, e, _ in split_offsets([text])[0][:-1]:
        assert text[e : e + 3].strip() == "" and text[e - 1] != " "


def test_table_edges(spark):
    long = "x" * 20_000
    df = spark.createDataFrame([(1, "H", "a " * 700, 1, "p"), (1, None, "a " * 700, 1, "p"), (2, "h", None, 1, "p"), (3, "h", "", 1, "p"), (4, "h", "short", 1, "p"), (5, "h", long, 1, "p"), (None, "h", " " * 9000, 1, "p")], "seq long, heading string, text string, pieces int, piece string")
    got = split_oversized(df).collect()
    assert sorted({r.seq for r in got}) == [1, 5]
    assert {r.heading for r in got if r.seq == 1} == {"H", None}
    x = sorted((r for r in got if r.seq == 5), key=lambda r: r.piece_no)
    assert x[0].start == 0 and x[-1].stop == 20_000 and all(len(r.piece) <= 4250 for r in x)
    assert split_oversized(df.limit(0)).collect() == [] and split_oversized(df, keep=()).count() == len(got)
