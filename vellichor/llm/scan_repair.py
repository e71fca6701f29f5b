"""Noise of scanned pages: broken words, misread letters, running headers and
page numbers; repair into continuous paragraphs.

Lines, and what may be a running header within a line, are labelled by a
hidden Markov model with the states body, header and break (page number). Its
symbols are layout features: what a line looks like, whether it stands at an
edge or interrupts a sentence, whether it recurs in its document, and whether
its words are usual in such places. Start, moves and emissions are fitted by
Baum-Welch over all texts; Viterbi decoding gives the labels. Header and break
lines are dropped, broken words joined, lines of a paragraph unwrapped,
misread words replaced.

Lines that neither look like a header nor like a number are body for certain,
so they part a text into short independent runs; the fit works on counted
distinct runs. Words are counted over all texts (how often, how often in texts
with letters read as digits or signs, how often in lines that may be headers),
within the tasks first; those above a least share are sent to the tasks, so
there are at most 1 / share of them at any size. Lines that recur within a
document are counted exactly and joined to its rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellichor.llm.text_shape import _KNOWN, _READABLE, line_kinds
from vellichor.plans.lineage import materialize

LEAST_SHARE = 2e-6
GOOD_SHARE = 2e-5
RATIO = 12.0
ENRICHED = 3.0
#: Share of a word's places that lie in lines that may be headers, from which it counts as usual there: somewhat, surely.
HEADER_SHARES = (0.1, 0.3)
#: Places in running text that every word is given beforehand, so that rare words count little.
HEADER_WEIGHT = 8
#: Characters beyond which a line is no running header.
LONGEST_HEADER = 160
#: Rounds of the Baum-Welch fit, and the weight of its first guess, in lines a state.
ROUNDS = 8
GUESS_WEIGHT = 20.0

#: What optical recognition makes of letters: (written, read). Fixed values.
CONFUSIONS = [
    ("a", "o"), ("e", "c"), ("t", "l"), ("h", "b"), ("m", "rn"), ("rn", "m"), ("d", "cl"), ("cl", "d"), ("u", "ii"), ("w", "vv"), ("n", "ri"), ("in", "m"),
    ("li", "h"), ("i", "!"), ("l", "!"), ("s", "5"), ("o", "0"), ("l", "1"), ("i", "1"), ("i", "l"), ("l", "i"), ("o", "a"), ("c", "e"), ("b", "h"), ("b", "6"), ("g", "9"),
]
_WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
_TOKEN = re.compile(r"(?<![^\s(\[“\"‘'])[A-Za-zÀ-ɏ0-9!]{0,40}[a-zß-ɏ][A-Za-zÀ-ɏ0-9!]{0,40}(?=[-.,;:!?)\]”\"’']*(?:\s|$))")
_MIXED = re.compile(r"(?:[a-zß-ɏ][0156!9]|(?<![A-Za-z0-9])[0156!][a-zß-ɏ])")
_ORDINAL = re.compile(r"\d+(?:st|nd|rd|th|e|er|re|o|a|x|s|mm|nm|min|mol|km|kg|cm|ms|kHz|ml|mg)?$")
_PAGE = re.compile(r"(?:[\[(~–—|*·•-]\s*)?(?:(?:page|pag\.|pág\.|seite|s\.|p\.|pp\.|página|folio)\s*)?(?:\d{1,4}|[ivxlc]{1,8})(?:\s*(?:/|of|von|de|sur)\s*\d{1,4})?(?:\s*[\])~–—|*·•-])?", re.IGNORECASE)
_SPACED = re.compile(r"(?:\d{1,4}\s+)?(?:[A-ZÀ-Þ]\s){3,}")
_DIVIDED = re.compile(r"\set al\.?\s/\s|\s[|·]\s")
_SMALL = frozenset("of and for in the on de des du la le et y e und für der die del da do von & / | · al. vol.".split())
_AUTHORED = re.compile(r"(?<!\S)[A-ZÀ-Þ][^\s,;/]*\set al\.\s/\s[A-ZÀ-Þ]\S*(?:\s[^\W\d_A-ZÀ-Þ]\S*)*?\s(?:of|in)\s\S+")
_FORMULA = frozenset("=\\_^{}<>±")
#: Small words of names of publications, which stand in running text as well.
_JOINING = frozenset("of and in for et de y e und für von".split())
#: A name of a publication joins words; a lone name in capitals does not.
_JOINED = re.compile(r"\s(?:of|OF|for|FOR|für|FÜR|de|DE|di|DI|/)\s")
_SPACED_INSIDE = re.compile(r"[A-ZÀ-Þ]\s[A-ZÀ-Þ]\s[A-ZÀ-Þ](?:\s[A-ZÀ-Þ])+(?!\S)")
_SIGNED_END = re.compile(r"[-‐\xad¬][ \t]*\r?\n")
_MARKED = re.compile(r"^\s*(?:[-*•]|\(?\d{1,3}[.)]|\([a-z]\)|\[\d+\])\s", re.MULTILINE)
_REFERENCE_TAIL = re.compile(r"\s*(?:\([^)]*\)\s*)?\d+,\s*\d+")
_BROKEN = re.compile(r"(?<![^\W\d_])([^\W\d_]+)([-‐\xad¬])[ \t]*\r?\n\s*([a-zß-ɏ][^\W\d_]*)")


def prose_like(text: str) -> bool:
    """Whether a text may have scan noise at all: no list, table or junk."""
    words = text.split()
    if not words:
        return False
    common = sum(map(_KNOWN.__contains__, words)) / len(words)
    if common >= 0.15 and text.count("|") < 4:
        kinds = line_kinds(text) if text.count("\n") >= 2 and len(_MARKED.findall(text)) >= 2 else None
        return not kinds or max(kinds.listed, kinds.tabled) <= 0.5 * kinds.total
    if len(words) <= 14 and text.count("\n") <= 1:
        return max(map(len, words)) <= 40 and len(set(words)) > len(words) / 3
    kinds = line_kinds(text)
    if kinds.total and max(kinds.listed, kinds.tabled) > 0.5 * kinds.total:
        return False
    return len(_READABLE.findall(text)) >= 0.4 * len(words) and len(set(words)) > 0.2 * len(words) and len(text) / len(words) >= 2.6


def signature(line: str) -> str:
    """The key under which a line recurs: its letters in lower case."""
    return " ".join("".join(c for c in line.lower() if c.isalpha() or c.isspace()).split())


def looks(t: str) -> str:
    """What a stripped line looks like: n(umber), s(paced letters), d(ivided), u(pper case), t(itled), f or g (fragments with one or more words in lower case) or o(ther)."""
    if len(t) <= 40 and _PAGE.fullmatch(t):
        # a lone c or l is a misread mark rather than a page
        return "o" if t in ("c", "l", "C", "L") else "n"
    if len(t) > LONGEST_HEADER or t[0].islower() or t[0] in "#*>" or "\t" in t or t[-1] in ".;,:!?-‐¬\xad" and not t.endswith("al.") or ". " in t.replace("al. ", "").replace("Vol. ", ""):
        return "o"
    if not _FORMULA.isdisjoint(t) or sum(map(str.isalpha, t)) < 6:
        return "o"
    if _SPACED.match(t):
        return "s"
    if _DIVIDED.search(t) and t.count("|") <= 2:
        return "d"
    if "," in t or "(F" in t or ": " in t:
        return "o"
    words = [w for w in t.split() if w.lower() not in _SMALL and not w[0].isdigit()]
    if not words or len(words) > 14 or sum(w in _KNOWN and w not in _JOINING for w in t.split()):
        return "o"
    if all(w.isupper() for w in words):
        return "u"
    low = sum(w[0].islower() for w in words)
    return "o" if low > 3 else "g" if low > 1 else "f" if low or any(w.isupper() and len(w) > 3 for w in words) else "t"


def layout(lines: list[str]) -> list[tuple[int, str, str]]:
    """(line, looks, place) of each line that is not blank; place: i(nterrupts a sentence), h(alf so), e(dge) or m(iddle)."""
    filled = [(k, t) for k, s in enumerate(lines) if (t := s.strip())]
    out = []
    for at, (k, t) in enumerate(filled):
        kind = looks(t)
        if kind == "o":
            out.append((k, "o", "m"))
            continue
        before, after = (filled[at - 1][1] if at else None), (filled[at + 1][1] if at + 1 < len(filled) else None)
        opens = before is not None and before[-1] not in ".!?:;”\"" and len(before) > 20
        goes_on = after is not None and (after[0].islower() or after[0] in "([0123456789−")
        out.append((k, kind, "i" if opens and goes_on else "e" if before is None or after is None else "h" if opens or goes_on else "m"))
    return out


def candidates(word: str) -> Iterator[str]:
    """Words that a recogniser may have read as ``word``: up to two confusions undone."""
    if len(word) > 40:
        return
    spots = [(k, len(read), written) for written, read in CONFUSIONS for k in range(len(word)) if word.startswith(read, k)]
    for k, n, w in spots:
        yield word[:k] + w + word[k + n :]
    if len(word) >= 5:
        for (a, n, w), (b, m, v) in combinations(sorted(spots), 2):
            if a + n <= b:
                yield word[:a] + w + word[a + n : b] + v + word[b + m :]


def mixed_tokens(text: str) -> list[str]:
    """Words with letters read as digits or signs."""
    if not _MIXED.search(text):
        return []
    out = []
    for m in _TOKEN.finditer(text):
        t = m.group().strip("!")
        if t.isalpha() or not _MIXED.search(t) or _ORDINAL.fullmatch(t):
            continue
        letters = sum(map(str.isalpha, t))
        odd = len(t) - letters
        lower = sum(map(str.islower, t))
        if letters >= 2 and odd <= max(1, letters // 2) and lower >= letters - 1 and (letters >= 3 or t[0].isalpha()) and not re.search(r"\d\d|[2-47-8]", t):
            out.append(t)
    return out


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words: Counter[str] = Counter()
    noisy: Counter[str] = Counter()
    headed: Counter[str] = Counter()
    placed: set[tuple[str, str, str]] = set()

    def flush() -> pa.RecordBatch:
        none = [None] * len(words)
        out = pa.RecordBatch.from_arrays(
            [
                pa.array(["w"] * len(words) + ["d"] * len(placed), pa.string()), pa.array([*words, *(s for s, _, _ in placed)], pa.string()),
                pa.array([*words.values(), *[1] * len(placed)], pa.int64()), pa.array([*(noisy[w] for w in words), *[0] * len(placed)], pa.int64()), pa.array([*(headed[w] for w in words), *[0] * len(placed)], pa.int64()),
                pa.array([*none, *(d for _, d, _ in placed)], pa.string()), pa.array([*none, *(r for _, _, r in placed)], pa.string()),
            ],
            names=["kind", "key", "n", "noisy", "headed", "document", "part"],
        )
        for c in (words, noisy, headed, placed):
            c.clear()
        return out

    for b in batches:
        for text, document, part in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
            if not prose_like(text):
                continue
            ws = _WORD.findall(text.lower())
            words.update(ws)
            if mixed_tokens(text):
                noisy.update(ws)
            if "\n" in text or len(text) < 120:
                lines = text.split("\n")
                for k, kind, place in layout(lines):
                    if kind in "on":
                        continue
                    if place != "m":
                        headed.update(_WORD.findall(lines[k].lower()))
                    if document is not None and part is not None:
                        placed.add((signature(lines[k]), document, part))
            if len(words) + len(placed) > 300_000:
                yield flush()
    yield flush()


class Lexicon:
    """Frequent words of the collection: how often, in noisy texts, in lines that may be headers.

    ``recurring`` (document, lines) has the lines that recur in each document,
    ``chain`` the fitted model of lines.
    """

    recurring: DataFrame | None = None

    def __init__(self, words: dict[str, tuple[int, int, int]], total: int, noisy_total: int, chain: Chain | None = None):
        self.words, self.total, self.noisy_total, self.chain = words, max(1, total), noisy_total, chain or Chain()
        self._good = GOOD_SHARE * self.total
        self._seen: dict[str, str | None] = {}
        self._known: dict[str, tuple[tuple[str, str, bool], ...]] = {}
        some, sure = HEADER_SHARES
        self.heads = {w: 2 if h >= sure * (n + HEADER_WEIGHT) else 1 for w, (n, _, h) in words.items() if h >= some * (n + HEADER_WEIGHT) and len(w) > 3}
        self._sure = frozenset(f(w) for w, v in self.heads.items() if v == 2 for f in (str.capitalize, str.upper))

    def lexical(self, line: str) -> int:
        """How usual the words of a line are in headers: 0, 1 or 2."""
        return max((self.heads.get(w, 0) for w in _WORD.findall(line.lower())), default=0)

    def segments(self, line: str) -> list[tuple[int, int]]:
        """Spans within a line that may be a running header: runs of capitals around a word usual in headers."""
        if len(line) < 40:
            return []
        at = [m.span() for m in _SPACED_INSIDE.finditer(line) if not m.start() or line[m.start() - 1].isspace()]
        if " et al. / " in line:
            at += [m.span() for m in _AUTHORED.finditer(line)]
        if not self._sure.isdisjoint(line.split()):
            at += [m.span() for m in re.finditer(r"\S+", line) if m.group() in self._sure]
        spans: list[tuple[int, int]] = []
        for s, e in sorted(at):
            if spans and s < spans[-1][1]:
                continue
            s, e = self._widen(line, s, e)
            if e - s < len(line) - 20 and _JOINED.search(line, s, e):
                spans.append((s, e))
        return spans

    def _widen(self, line: str, s: int, e: int) -> tuple[int, int]:
        """A run of capitalised words, small words between them, names before a slash and numbers at its end."""
        while m := re.match(r"\s(?:(?:of|and|for|de|der|für|[|/·]|Vol\.)\s)?(?:\(?[A-ZÀ-Þ][^\s,.;]*|\d{1,4}(?![\d.,]))(?=\s|$)|\s(?:of|for)(?=\s[A-ZÀ-Þ(])|\s[|·]\sVol\.(?=\s\d)", line[e : e + 80]):
            e += m.end()
        named = False
        while m := re.search(r"(?:^|(?<=\s))(?:[A-ZÀ-Þ][^\s,;/]*\set al\.\s/|[A-ZÀ-Þ][^\s,.;]*(?:\s(?:of|and|for))?|\d{1,4})\s$", line[max(0, s - 80) : s]):
            if "et al" not in m.group() and not m.group().strip().isdigit() and not self.lexical(m.group()):
                # one name before the words that are usual
                if named or "et al" in line[s:e]:
                    break
                named = True
            s -= len(m.group())
        return s, e

    def count(self, word: str) -> int:
        return self.words.get(word, (0, 0, 0))[0]

    def suspects(self, word: str) -> tuple[tuple[str, str, bool], ...]:
        """(part, correction, whether it is weak) of the parts of a word that are misread; remembered by word."""
        got = self._known.get(word)
        if got is None:
            if len(self._known) > 200_000:
                self._known.clear()
            parts = [word] if word.isalpha() else re.split(r"[-’']", word)
            parts = [p for p in parts if len(p) >= 3 and not p.isupper()]
            got = self._known[word] = tuple((p, c, self.weak(p.lower())) for p in parts if (c := self.correction(p.lower())) is not None)
        return got

    def correction(self, word: str) -> str | None:
        """The word that a misread word stands for; None for a word that is all right."""
        if len(word) < 3:
            return None
        if word not in self._seen:
            if len(self._seen) > 200_000:
                self._seen.clear()
            self._seen[word] = self._correct(word)
        return self._seen[word]

    def _correct(self, word: str) -> str | None:
        n, noisy, _ = self.words.get(word, (0, 0, 0))
        if n:
            # words typical of texts with other misreadings only
            usual = self.noisy_total / self.total
            if noisy / n < min(0.6, ENRICHED * usual + 0.02):
                return None
        best, most = None, max(self._good, RATIO * n)
        for c in candidates(word):
            k = self.count(c)
            if k > most:
                best, most = c, k
        return best

    def weak(self, word: str) -> bool:
        """Whether a misreading is too short or too usual elsewhere to stand alone."""
        n, noisy, _ = self.words.get(word, (0, 0, 0))
        return noisy < 0.6 * n if n else len(word) <= 4

    def mixed(self, token: str) -> bool:
        """Whether a word with digits or signs among its letters is misread: always inside, at its ends if letters give a known word."""
        t = token.lower()
        if re.search(r"[a-zß-ɏ][015!69]+[a-zß-ɏ]", t):
            return True
        return any(self.count(c) > 0 for c in candidates(t))


class Chain:
    """A hidden Markov model of lines: log probabilities of starts, moves and symbols.

    A symbol has four characters: looks, place, recurrence, words. Its
    probability is that of its place times that of the rest. The first guess
    multiplies shares of each; the fit replaces them by what is found, but for
    the places of body lines: a wrapped line has no place of its own, so that
    interrupting a sentence always speaks against body.
    """

    STATES = (BODY, HEADER, BREAK) = (0, 1, 2)
    #: Shares of the first guess, by state. What is left out is impossible.
    LOOKS = ({"n": 0.002, "s": 0.0005, "d": 0.002, "u": 0.003, "t": 0.015, "f": 0.015, "g": 0.02, "x": 0.0015}, {"s": 0.2, "d": 0.2, "u": 0.2, "t": 0.35, "f": 0.03, "g": 0.01, "x": 0.2}, {"n": 1.0})
    PLACES = ({"i": 0.05, "h": 0.15, "e": 0.3, "m": 0.5}, {"i": 0.45, "h": 0.12, "e": 0.38, "m": 0.05}, {"i": 0.35, "h": 0.1, "e": 0.5, "m": 0.05})
    AGAIN = ({"0": 0.97, "1": 0.03}, {"0": 0.5, "1": 0.5}, {"0": 1.0})
    WORDS = ({"0": 0.9, "1": 0.07, "2": 0.03}, {"0": 0.2, "1": 0.2, "2": 0.6}, {"0": 1.0})
    START = (0.9, 0.05, 0.05)
    MOVE = ((0.94, 0.03, 0.03), (0.85, 0.05, 0.1), (0.85, 0.12, 0.03))

    def __init__(self, start=START, move=MOVE, emit: dict[str, tuple[float, float, float]] | None = None):
        self.start, self.move, self.emit = start, move, emit or {}

    @classmethod
    def guess(cls, symbol: str) -> tuple[float, float, float]:
        looks, place, again, words = symbol
        return tuple(cls.LOOKS[s].get(looks, 0.0) * cls.PLACES[s][place] * cls.AGAIN[s].get(again, 0.0) * cls.WORDS[s].get(words, 0.0) for s in cls.STATES)

    def given(self, symbol: str) -> tuple[float, float, float]:
        return self.emit.get(symbol) or self.guess(symbol)

    def expected(self, run: str) -> tuple[list[float], list[list[float]], list[tuple[str, list[float]]]]:
        """Expected starts, moves and states of the symbols of one run: its left and right ends are ^ or b, $ or b."""
        left, symbols, right = run[0], [run[k : k + 4] for k in range(1, len(run) - 1, 4)], run[-1]
        first = self.start if left == "^" else self.move[0]
        e = [self.given(x) for x in symbols]
        f = [[first[s] * e[0][s] for s in range(3)]]
        for row in e[1:]:
            z = sum(f[-1]) or 1e-300
            f[-1] = [x / z for x in f[-1]]
            f.append([row[s] * sum(f[-1][q] * self.move[q][s] for q in range(3)) for s in range(3)])
        z = sum(f[-1]) or 1e-300
        f[-1] = [x / z for x in f[-1]]
        b = [[self.move[s][0] if right == "b" else 1.0 for s in range(3)]]
        for row in reversed(e[1:]):
            g = [sum(self.move[s][q] * row[q] * b[-1][q] for q in range(3)) for s in range(3)]
            z = sum(g) or 1e-300
            b.append([x / z for x in g])
        b.reverse()
        post = []
        for x, y in zip(f, b, strict=True):
            z = sum(p * q for p, q in zip(x, y, strict=True)) or 1e-300
            post.append([p * q / z for p, q in zip(x, y, strict=True)])
        moves = [[0.0] * 3 for _ in range(3)]
        for k in range(1, len(e)):
            w = [[f[k - 1][p] * self.move[p][q] * e[k][q] * b[k][q] for q in range(3)] for p in range(3)]
            z = sum(map(sum, w)) or 1e-300
            for p in range(3):
                for q in range(3):
                    moves[p][q] += w[p][q] / z
        starts = [0.0] * 3
        if left == "^":
            starts = list(post[0])
        else:
            for q in range(3):
                moves[0][q] += post[0][q]
        if right == "b":
            for p in range(3):
                moves[p][0] += post[-1][p]
        return starts, moves, list(zip(symbols, post, strict=True))

    def decode(self, run: str) -> list[int]:
        """The most likely states of a run by Viterbi's algorithm."""
        log = lambda x: math.log(x) if x > 0 else -1e9
        left, symbols, right = run[0], [run[k : k + 4] for k in range(1, len(run) - 1, 4)], run[-1]
        first = self.start if left == "^" else self.move[0]
        e = [self.given(x) for x in symbols]
        score, back = [log(first[s]) + log(e[0][s]) for s in range(3)], []
        for row in e[1:]:
            step = [max(range(3), key=lambda q: score[q] + log(self.move[q][s])) for s in range(3)]
            score = [score[step[s]] + log(self.move[step[s]][s]) + log(row[s]) for s in range(3)]
            back.append(step)
        if right == "b":
            score = [score[s] + log(self.move[s][0]) for s in range(3)]
        s = max(range(3), key=score.__getitem__)
        path = [s]
        for step in reversed(back):
            s = step[s]
            path.append(s)
        return path[::-1]


def pieces(lines: list[str], lexicon: Lexicon, recurring: dict[str, int] | None = None) -> list[tuple[int, int, int, str]]:
    """(line, from, to, symbol) of the lines and what may be headers within them, in order; symbol ``o`` for sure body."""
    out = []
    for k, kind, place in layout(lines):
        t = lines[k].strip()
        if kind == "n":
            out.append((k, 0, len(lines[k]), f"n{place}00"))
        elif kind != "o":
            again = "1" if recurring and signature(t) in recurring else "0"
            out.append((k, 0, len(lines[k]), f"{kind}{place}{again}{lexicon.lexical(t)}"))
        else:
            at = 0
            for s, e in lexicon.segments(lines[k]):
                if _REFERENCE_TAIL.match(lines[k], e):
                    continue
                if lines[k][at:s].strip():
                    out.append((k, at, s, "o"))
                before, after = lines[k][:s].rstrip(), lines[k][e:].lstrip()
                inside = before and before[-1] not in ".!?:;”\"" and after
                again = "1" if recurring and signature(lines[k][s:e]) in recurring else "0"
                out.append((k, s, e, f"x{'i' if inside else 'm'}{again}{max(1, lexicon.lexical(lines[k][s:e]))}"))
                at = e
            if lines[k][at:].strip() or not at:
                out.append((k, at, len(lines[k]), "o"))
    return out


def runs(symbols: list[str]) -> Iterator[tuple[int, str]]:
    """(first place, run) of the maximal runs between lines that are body for certain."""
    at = 0
    while at < len(symbols):
        if symbols[at] == "o":
            at += 1
            continue
        end = at
        while end < len(symbols) and symbols[end] != "o":
            end += 1
        yield at, ("b" if at else "^") + "".join(symbols[at:end]) + ("$" if end == len(symbols) else "b")
        at = end


def label_pieces(lines: list[str], lexicon: Lexicon, recurring: dict[str, int] | None = None) -> list[tuple[int, int, int, int]]:
    """(line, from, to, state) of what is not body."""
    found = pieces(lines, lexicon, recurring)
    out = []
    for at, run in runs([x for *_, x in found]):
        for k, state in enumerate(lexicon.chain.decode(run)):
            if state:
                out.append((*found[at + k][:3], state))
    return out


def _count_runs(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = Lexicon(*shared.value)
        seen: Counter[str] = Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["run", "n"])
            seen.clear()
            return out

        for b in batches:
            for text, again in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                if not prose_like(text):
                    continue
                symbols = [x for *_, x in pieces(text.split("\n"), lexicon, dict(again) if again else None)]
                if not symbols:
                    continue
                seen["^"] += symbols[0] == "o"
                seen["o"] += symbols.count("o")
                seen["bb"] += sum(a == b == "o" for a, b in zip(symbols, symbols[1:], strict=False))
                seen.update(r for _, r in runs(symbols))
            if len(seen) > 100_000:
                yield flush()
        yield flush()

    return run


def fit_chain(counted: DataFrame, rounds: int = ROUNDS) -> Chain:
    """Baum-Welch over counted runs (run, n): every round is a sum over distinct runs.

    What the driver sees is one row for each start, move and symbol; there are
    at most 8 x 4 x 2 x 3 symbols.
    """
    context = counted.sparkSession.sparkContext
    sure = {r["run"]: r["n"] for r in counted.filter(F.col("run").isin("^", "bb", "o")).collect()}
    counted = counted.filter(F.length("run") > 2)
    chain = Chain()
    for _ in range(rounds):
        shared = context.broadcast(chain)

        def step(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            sums: Counter[tuple[str, int]] = Counter()
            for b in batches:
                for run, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    starts, moves, states = shared.value.expected(run)
                    for s in range(3):
                        sums["start", s] += n * starts[s]
                        for q in range(3):
                            sums[f"move{s}", q] += n * moves[s][q]
                    for x, p in states:
                        for s in range(3):
                            sums[x, s] += n * p[s]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in sums], pa.string()), pa.array([s for _, s in sums], pa.int32()), pa.array(list(sums.values()), pa.float64())], names=["what", "state", "v"])

        got = {(r["what"], r["state"]): r["v"] for r in counted.mapInArrow(step, "what string, state int, v double").groupBy("what", "state").agg(F.sum("v").alias("v")).collect()}
        got["start", 0] = got.get(("start", 0), 0.0) + sure.get("^", 0)
        got["move0", 0] = got.get(("move0", 0), 0.0) + sure.get("bb", 0)
        share = lambda what, guess: tuple((got.get((what, s), 0.0) + GUESS_WEIGHT * guess[s]) / (sum(got.get((what, q), 0.0) for q in range(3)) + GUESS_WEIGHT) for s in range(3))
        symbols = sorted({w for w, _ in got if len(w) == 4})
        guess = {x: Chain.guess(x) for x in symbols}
        rest: dict[str, list[float]] = {}
        place = [{p: GUESS_WEIGHT * v for p, v in Chain.PLACES[s].items()} for s in range(3)]
        for x in symbols:
            own = rest.setdefault(x[0] + x[2:], [GUESS_WEIGHT * guess[x][s] / Chain.PLACES[s][x[1]] for s in range(3)])
            for s in range(3):
                own[s] += got[x, s]
                place[s][x[1]] += got[x, s] if s else 0.0
        of = [sum(v[s] for v in rest.values()) + (0 if s else sure.get("o", 0)) or 1.0 for s in range(3)]
        emit = {x: tuple(rest[x[0] + x[2:]][s] / of[s] * place[s][x[1]] / sum(place[s].values()) for s in range(3)) for x in symbols}
        chain = Chain(share("start", Chain.START), tuple(share(f"move{s}", Chain.MOVE[s]) for s in range(3)), emit)
    return chain


def _placed(texts: DataFrame, column: str, document: str | Column | None, part: str | None, *more: Column) -> DataFrame:
    none = F.lit(None).cast("string")
    of = lambda c: none if c is None else (F.col(c) if isinstance(c, str) else c).cast("string")
    return texts.select(*more, F.col(column).alias("t"), of(document).alias("document"), of(part).alias("part")).filter(F.col("t").rlike(r"\S"))


def _with_recurring(rows: DataFrame, lexicon: Lexicon, key: str) -> DataFrame:
    """(key, t, lines): the texts with what recurs in their document; few documents have such lines, Spark broadcasts them while they are small."""
    if lexicon.recurring is None:
        return rows.select(key, "t", F.lit(None).cast("map<string,bigint>").alias("lines"))
    return rows.join(lexicon.recurring, "document", "left").select(key, "t", "lines")


def learn(texts: DataFrame, column: str = "text", document: str | None = None, part: str | None = None) -> Lexicon:
    """Counts words and fits the chain of lines over all texts; nulls are passed over.

    With ``document`` and ``part`` (a row of it; repeated deliveries share one)
    also which lines stand in several parts of their document.
    """
    src = _placed(texts, column, document, part)
    counted = materialize(src.mapInArrow(_counts, "kind string, key string, n long, noisy long, headed long, document string, part string").groupBy("kind", "key", "document", "part").agg(F.sum("n").alias("n"), F.sum("noisy").alias("noisy"), F.sum("headed").alias("headed")), "scan-counts")
    words = counted.filter("kind = 'w'")
    n, noisy = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("noisy"), F.lit(0))).first()
    rows = words.filter(F.col("n") >= LEAST_SHARE * n).select("key", "n", "noisy", "headed").collect()
    lexicon = Lexicon({r["key"]: (r["n"], r["noisy"], r["headed"]) for r in rows}, n, noisy)
    if document and part:
        again = counted.filter("kind = 'd'").groupBy("document", "key").agg(F.count(F.lit(1)).alias("n")).filter("n >= 2")
        lexicon.recurring = materialize(again.groupBy("document").agg(F.map_from_entries(F.collect_list(F.struct("key", "n"))).alias("lines")), "scan-recurring")
    shared = texts.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.total, lexicon.noisy_total))
    lines = _with_recurring(src, lexicon, "document").mapInArrow(_count_runs(shared), "run string, n long").groupBy("run").agg(F.sum("n").alias("n"))
    lexicon.chain = fit_chain(materialize(lines, "scan-runs"))
    return lexicon


def broken(left: str, sign: str, right: str, lexicon: Lexicon) -> bool:
    """Whether a sign at a line end breaks a word, rather than standing in a compound."""
    if sign in "\xad¬":
        return True
    a, b = left.lower(), right.lower()
    joined, compound = lexicon.count(a + b), max(lexicon.count(f"{a}-{b}"), 0)
    if joined != compound:
        return joined > compound
    if sign == "‐":
        return True
    # both halves common words: a compound that occurs once
    least = GOOD_SHARE * lexicon.total
    return not (lexicon.count(a) >= least and lexicon.count(b) >= least)


def analyse(text: str, lexicon: Lexicon, repair: bool = False, recurring: dict[str, int] | None = None) -> tuple[set[str], str | None]:
    """The kinds of noise in a text, and the repaired text if asked for; ``recurring``: the lines that recur in its document."""
    if not prose_like(text):
        return set(), text if repair else None
    found: set[str] = set()
    lines = text.split("\n")
    labels = label_pieces(lines, lexicon, recurring)
    # many numbers are a column, not pages
    if sum(x == Chain.BREAK for *_, x in labels) > max(3, 0.34 * len(lines)) and len(lines) > 2:
        labels = [x for x in labels if x[3] != Chain.BREAK]
    if labels:
        found.add("furniture")
        for k, a, z, _ in reversed(labels):
            lines[k] = None if not a and z == len(lines[k]) else lines[k][:a].rstrip() + " " + lines[k][z:].lstrip()
    body = "\n".join(s for s in lines if s is not None)

    def join(m: re.Match) -> str:
        if broken(*m.groups(), lexicon):
            found.add("hyphen")
            return m.group(1) + m.group(3)
        return m.group(1) + "-" + m.group(3)

    if _SIGNED_END.search(body):
        body = _BROKEN.sub(join, body)
    wrong: dict[str, str | None] = {}
    for t in mixed_tokens(body):
        if lexicon.mixed(t):
            found.add("misread")
            if repair:
                wrong[t] = next((c for c in sorted(candidates(t.lower()), key=lambda c: -lexicon.count(c)) if lexicon.count(c)), None)
    weak = 0
    for w in set(_WORD.findall(body)):
        for p, c, is_weak in lexicon.suspects(w):
            wrong[p] = c
            weak += is_weak
            if not is_weak or weak > 1:
                found.add("misread")
    if not repair:
        return found, None
    if wrong and "misread" in found:
        def fix(m: re.Match) -> str:
            to = wrong.get(m.group())
            return m.group() if not to else to.capitalize() if m.group()[0].isupper() else to

        body = re.sub(r"[^\W_]*[^\W\d_][^\W_]*(?:![^\W_]+)*|[!015][^\W\d_]+", fix, body)
    paragraphs = [" ".join(s.strip() for s in p.split("\n") if s.strip()) for p in re.split(r"\n\s*\n", body)]
    return found, "\n\n".join(p for p in paragraphs if p)


def scan_noise(df: DataFrame, lexicon: Lexicon, row_key: str, text: str = "text", repair: bool = False, document: str | Column | None = None) -> DataFrame:
    """Noise of each row: row_key, noise (one row per kind), or with ``repair``
    row_key, noises (array), repaired for every row that has noise.

    Null, empty and blank texts, lists, tables and junk have no noise;
    repeated rows are judged each on its own, alike. ``document`` is what
    ``learn`` was given as such.
    """
    shared = df.sparkSession.sparkContext.broadcast((lexicon.words, lexicon.total, lexicon.noisy_total, lexicon.chain))
    rows = _with_recurring(_placed(df, text, document, None, F.col(row_key).cast("long").alias("row_key")), lexicon, "row_key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lex = Lexicon(*shared.value)
        for b in batches:
            keys, noises, texts = [], [], []
            for k, t, again in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True):
                found, fixed = analyse(t, lex, repair, dict(again) if again else None)
                if repair and found:
                    keys.append(k)
                    noises.append(sorted(found))
                    texts.append(fixed)
                elif not repair:
                    for f in sorted(found):
                        keys.append(k)
                        noises.append(f)
            if repair:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(noises, pa.list_(pa.string())), pa.array(texts, pa.string())], names=["row_key", "noises", "repaired"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(noises, pa.string())], names=["row_key", "noise"])

    return rows.mapInArrow(run, "row_key long, noises array<string>, repaired string" if repair else "row_key long, noise string")
