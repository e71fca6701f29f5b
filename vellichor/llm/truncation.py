"""Texts that stop early, by censored lengths and by how they end.

Lengths of each source follow a log-normal law, right-censored at the limits
of that source. A limit is a length that holds far more texts than the law
allows; the law is fitted by maximum likelihood (expectation maximisation,
censored lengths enter by their conditional moments), and the posterior that
a text of that very length was cut is the share of the excess.

An ending is a kind (sentence, table row, item ...) and a state: left open,
closed, or, where only the last word tells, how that word ends units elsewhere
in the collection. How likely each state is for cut and for whole texts is
fitted over all texts by expectation maximisation: texts at a limit come with
its posterior, the others with a common rate of cuts, and both are revised by
the endings found there. A text is cut if the posterior odds of the two
together favour it.

Lengths, words and endings are counted over all texts, pre-aggregated in the
tasks. Words are looked up by joins; the driver sees limits, lengths in bins
and one row for each state and limit.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellichor.llm.text_shape import _leaders
from vellichor.plans.lineage import materialize

LIMIT_SHARE = 0.008
LIMIT_LEAST = 4
#: Weight of a limit's censoring posterior, in texts, against the endings found at it.
LIMIT_WEIGHT = 4.0
#: How likely an excess of texts at one length comes of cutting: copies, and texts made to a length, give one too.
EXCESS_CUT = 0.9
#: Weight of the expected shares below, in texts, against the endings found.
ENDING_WEIGHT = 5.0
#: Expected share of cut texts away from any limit, before they are looked at.
CUT_RATE = 0.05
#: States of an ending with their expected shares among cut and among whole texts; the fit revises them.
STATES = {
    "open": (0.80, 0.005), "closed": (0.002, 0.90), "broken": (0.07, 0.0005), "never": (0.06, 0.0005), "seldom": (0.03, 0.002),
    "unseen": (0.02, 0.02), "name": (0.007, 0.02), "some": (0.01, 0.03), "usual": (0.001, 0.05),
}
#: Occurrences at which a word's own rate of ending units outweighs that of all words.
WORD_WEIGHT = 2.0
#: States of words by the rate at which they end units.
WORD_RATES = ((0.01, "never"), (0.03, "seldom"), (0.12, "some"))
#: The key of sources too small to be fitted alone; no source has it, keys have no upper case.
POOLED = "POOLED"

_WORD = re.compile(r"[^\W\d_]+(?:[-’'][^\W\d_]+)*")
_ENDING = re.compile(r"(?<![^\W\d_])([^\W\d_]+(?:[-’'][^\W\d_]+)*)[.,;:!?)](?![^\W\d_])")
_OMITTED = re.compile(r"(?:…|(?<!\.)\.\.\.|\[(?:\.\.\.|…|truncated|more|cut)\]|\((?:\.\.\.|…|truncated|more|continued|cont\.)\)|(?:Continue reading|Read more|Weiterlesen|Lire la suite|Leer más|Seguir leyendo|Leia mais|Continuar lendo)\W*)\s*$", re.IGNORECASE)
_MARKER = re.compile(r"(?:[-*•+]|\(?\d{1,3}[.)]|\(?[a-z]\)|\[\d{1,3}\])\s+")
_REFERENCE = re.compile(r"(?:\[\d{1,3}\]|\d{1,3}\.)\s+[^\W\d_][^\d\n]{0,60}?,\s[^\W\d_]\.")
_TERMINAL = re.compile(r"[.!?。][\"”’')\]*_»]*$")
_DATED = re.compile(r"\d{4}-\d{2}-\d{2}(?:[ T]\d{2}:\d{2}(?::\d{2})?Z?)?$")
_DATE_LINE = re.compile(r"(?:Last (?:edited|modified|updated|changed)|Updated|Posted|Published|Created|Date|Retrieved|Stand|Zuletzt (?:bearbeitet|geändert))\b", re.IGNORECASE)
_URL = re.compile(r"(?:https?://|www\.)\S+$")
_URL_DONE = re.compile(r"\.(?:pdf|html?|md|txt|png|jpe?g|csv|json|docx?|xml|zip)[)\]>]?$|/[)\]>]?$|/[^/\s]{3,}\)$")
_INDEX = re.compile(r"[^\W\d_][^,;|\t]{1,80}(?:,\s+\d{1,4}(?:[-–]\d{1,4})?)+$")
_KEYWORDS = re.compile(r"(?:Keywords?|Schlagwörter|Mots[- ]clés|Palabras clave|Palavras[- ]chave|Tags|Index terms)\s*:", re.IGNORECASE)
_PAGE = re.compile(r"(?:[\[(~–—-]\s*)?(?:(?:page|seite|p\.|s\.|página|pag\.)\s*)?(?:\d{1,4}|[ivxlc]{1,8})(?:\s*/\s*\d{1,4})?(?:\s*[\])~–—-])?", re.IGNORECASE)
_RUNNING = re.compile(r"(?:\d{1,4}\s+)?(?:(?:[A-ZÀ-Þ]\s){3,}.*|(?:[A-ZÀ-Þ(]\S*\s+){0,3}(?i:Archives?|Annals|Bulletin|Letters|Proceedings|Transactions|Reports|Journal|Handbook)\s(?i:of)\s[^,.;]*|[A-ZÀ-Þ][^\s/]*(?:\sand\s[A-ZÀ-Þ]\S*)?(?:\set al\.)?\s/\s[^.;]*|.*\|\s*Vol\.\s*\d+.*|[A-ZÀ-Þ][^\W\d_]+\sand\s[A-ZÀ-Þ][^\W\d_]+(?:\s+\d{1,4})?)")
_ABBREVIATED = re.compile(r"(?:^|[\s(])(?:Figs?|Supplementary Fig|Supp|vol|no|pp?|e\.g|i\.e|cf|ca|approx|resp|vs|Dr|Prof|bzw|z\.B|Abb|Nr|Tab|Eq|Ref|Sec|St|Ch)\.$")
_ET_AL = re.compile(r"\set\sal\.$")
_NUMBERED = re.compile(r"(?:Figure|Figures|Fig\.|Table|Tab\.|Abb\.|Abbildung|Tabelle|Section|Abschnitt|Chapter|Kapitel|Eq\.|Equation|Nr\.|No\.|Appendix|Version|Step|Part|Teil|Ref\.|figure|figura|Figura|tableau|Tabla|Tabela)\s*\(?[A-Z]?\d+[a-zA-Z]?\)?\.[\"”’)\]]*$")
_VALUE = re.compile(r"[-−–+]?\d[\d.,]*(?: ?[±–] ?\d[\d.,]*)?%?|n\.d\.|n/a|–|-")
_CELL = {"\t": re.compile(r"\t"), ";": re.compile(r";"), "  ": re.compile(r" {2,}")}
_BRACKETS = {"(": ")", "“": "”", "[": "]"}


def source_key(source: Column) -> Column:
    """One spelling of a source: lower case, trimmed, ``_`` between words; null stays null."""
    return F.nullif(F.regexp_replace(F.trim(F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))), r"(?U)[\s_-]+", "_"), F.lit(""))


def _last_word(text: str) -> str | None:
    """The word that a text stops with, if no punctuation stands after it."""
    u = text.rstrip()
    at = len(u)
    while at and (u[at - 1].isalpha() or u[at - 1] in "-’'"):
        at -= 1
    found = _WORD.findall(u, at)
    return found[-1] if found and u.endswith(found[-1]) else None


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of texts and how often they end a unit, but for what a text itself stops with."""
    words: Counter[str] = Counter()
    ends: Counter[str] = Counter()

    def flush() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64()), pa.array([ends[w] for w in words], pa.int64())], names=["word", "n", "ends"])
        words.clear()
        ends.clear()
        return out

    for b in batches:
        for text in b.column(0).to_pylist():
            words.update(_WORD.findall(text))
            if last := _last_word(text):
                words[last] -= 1
            # ends of units: before punctuation, and of marked lines; a wrapped line ends anywhere
            ends.update(_ENDING.findall(text))
            if "\n" in text:
                for line in text.rstrip().split("\n")[:-1]:
                    if line[:2] in ("- ", "* ", "• ") or line[:1].isdigit() and _MARKER.match(line):
                        tail = _last_word(line)
                        if tail:
                            ends[tail] += 1
            if len(words) > 300_000:
                yield flush()
    yield flush()


def _balance(line: str) -> bool:
    """Whether a bracket or quotation is open at the end of a line."""
    return any(line.rfind(a) > line.rfind(z) for a, z in _BRACKETS.items())


def _state(is_open: bool) -> str:
    return "open" if is_open else "closed"


def ending(text: str) -> tuple[str, str]:
    """The kind of a text's ending and its state: ``open``, ``closed``, or ``=`` and the word that tells."""
    u = text.rstrip()
    if not u:
        return "empty", "closed"
    if _OMITTED.search(u[-60:]):
        return "omission", "open"
    if sum(1 for s in u.split("\n") if s.lstrip().startswith("```")) % 2:
        return "open code", "open"
    lines = u.split("\n")
    # page furniture below the text says nothing
    while len(lines) > 1 and (len(lines[-1]) < 40 and _PAGE.fullmatch(lines[-1].strip()) or not lines[-1].strip() or len(lines[-1]) < 110 and _RUNNING.fullmatch(lines[-1].strip())):
        lines.pop()
    t = lines[-1].strip()
    before = lines[-2].strip() if len(lines) > 1 else ""
    ended = u[u.rfind("\n") + 1 :].strip()
    if _VALUE.fullmatch(ended) and "\n" in u and (_VALUE.fullmatch(u.split("\n")[-2].strip()) or re.search(r"\n(?:[-−–]?\d[\d.,]*|n\.d\.|–)\s*\n", u[-80:])):
        return "column", "closed"
    if t.startswith("```"):
        return "code", "closed"
    if t.startswith("|"):
        if not t.endswith("|") or len(t) < 2:
            return "table", "open"
        return "table", _state(before.startswith("|") and before.count("|") != t.count("|"))
    if _DATE_LINE.match(t) and len(t) < 60:
        return "date", _state(not _DATED.search(t))
    if t.startswith("!["):
        return "image", _state(not re.search(r"\]\([^()\s]+\)$", t))
    if m := _URL.search(t):
        done = bool(_URL_DONE.search(m.group())) or bool(_TERMINAL.search(t))
        return "link", _state(not done)
    if re.match(r"(?:Source|Quelle|URL|Link)\s*:?\s*$", t) or re.match(r"(?:Source|Quelle|URL|Link):\s", t):
        return "link", _state(len(t) < 30)
    if _leaders(t):
        return "contents", "closed"
    if t.endswith("...."):
        return "contents", "open"
    for sep, cell in _CELL.items():
        if sep in t and (sep != ";" or re.search(r";\S", t) and ". " not in t):
            here, there = len(cell.split(t)), len(cell.split(before)) if sep in before else 0
            if there > 1:
                return "columns", _state(here != there)
    for sep, cell in _CELL.items():
        # the first cells of a row below rows with more
        if sep in before and (sep != ";" or re.search(r";\S", before) and ". " not in before) and len(cell.split(before)) > 1 and len(t) < 40 and not _TERMINAL.search(t) and len(lines) > 2 and sep in lines[-3]:
            return "columns", "open"
    if _INDEX.fullmatch(t):
        return "index", "closed"
    if re.fullmatch(r"[^\W\d_][^,;|\t.]{1,60}(?:,\s+\d{1,4})*,", t) and re.search(r"\d$", before):
        return "index", "open"
    if _KEYWORDS.match(t):
        last = re.split(r"[:;,]\s*", t)[-1]
        ws = _WORD.findall(last)
        return "keywords", "=" + ws[-1] if ws else "open"
    if _REFERENCE.match(t) or (_REFERENCE.match(before) and len(lines) > 1 and not _TERMINAL.search(before)):
        return "reference", _state(not re.search(r"\(\d{4}[a-z]?\)\.?$", t))
    if t.startswith("#"):
        ws = _WORD.findall(t)
        return "heading", "=" + ws[-1] if ws else "open"
    if (m := _MARKER.match(t)) and not _TERMINAL.search(t):
        ws = _WORD.findall(t[m.end() :])
        if not ws or t[-1] in ",-–(":
            return "item", "open"
        return "item", "closed" if t[-1].isdigit() else "=" + ws[-1]
    if m is not None and t.endswith(";"):
        return "item", "closed"
    first = len(lines)
    while first and lines[first - 1].strip():
        first -= 1
    paragraph = " ".join(s.strip() for s in lines[first:])
    if _TERMINAL.search(t):
        sentence = re.split(r"(?<=[^\s.][^\s.])[.!?][\"”’)\]]*\s+(?=[A-ZÀ-Þ“\"(])", paragraph)[-1]
        if _ABBREVIATED.search(t):
            return "abbreviation", "open"
        if _ET_AL.search(t):
            return "et al", _state(len(sentence.split()) < 9)
        if re.search(r"(?:(?:^|\s)[a-zß-ɏ]+|±|–)\s[-−±]?\d{1,4}\.$", paragraph) and not _NUMBERED.search(paragraph):
            return "number", "open"
        if re.search(r"(?:^|\s)[A-ZÀ-Þ]\.$", t) and _balance(sentence):
            return "initial", "open"
        if _balance(sentence) and not t.endswith((")", "”", "]")):
            return "open bracket", "open"
        return "sentence", "closed"
    if t.endswith(":"):
        return "colon", "open"
    ws = _WORD.findall(t)
    if len(ws) <= 7 and len(lines) >= 3 and all(s.strip() and len(s.strip()) <= 60 and not _TERMINAL.search(s.strip()) for s in lines[-3:]) and not any(". " in s or ", " in s for s in lines[-4:]) and ws:
        return "short lines", "=" + ws[-1]
    if re.search(r"=.*\d$|[=<>≈]\s*\S+$", t):
        return "formula", "open"
    return "prose", "open"


def _fit(counts: list[tuple[int, int]], limits: list[int]) -> dict[int, float]:
    """Posterior of censoring at each limit from (length, texts): log-normal with censored lengths, by expectation maximisation."""
    logs = [(math.log(n), c) for n, c in counts if n > 0]
    total = sum(c for _, c in logs)
    if total < 10:
        return {}
    at = dict(counts)
    mu = sum(x * c for x, c in logs) / total
    sd = max(0.05, math.sqrt(sum((x - mu) ** 2 * c for x, c in logs) / total))
    phi = lambda z: math.exp(-z * z / 2) / math.sqrt(2 * math.pi)
    tail = lambda z: max(1e-12, 0.5 * math.erfc(z / math.sqrt(2)))
    post = {lim: 1.0 for lim in limits}
    for _ in range(30):
        s1 = s2 = n = 0.0
        for x, c in logs:
            s1, s2, n = s1 + x * c, s2 + x * x * c, n + c
        for lim in limits:
            x, c = math.log(lim), at[lim] * post[lim]
            z = (x - mu) / sd
            h = phi(z) / tail(z)
            e1 = mu + sd * h
            e2 = mu * mu + sd * sd + sd * h * (x + mu)
            s1, s2 = s1 + c * (e1 - x), s2 + c * (e2 - x * x)
        mu, sd = s1 / n, math.sqrt(max(0.0025, s2 / n - (s1 / n) ** 2))
        for lim in limits:
            expected = total * phi((math.log(lim) - mu) / sd) / (sd * lim)
            post[lim] = max(0.0, min(0.999, 1 - expected / at[lim]))
    return post


def limit_table(docs: DataFrame, source: str = "source_name", length: str = "n") -> tuple[dict[tuple[str | None, int], float], set[str | None]]:
    """Posterior of censoring by (source, length) for lengths that are limits, and the sources fitted alone.

    A limit holds a least share of its source. There are at most 1 / share
    limits a source; sources below a least share of all texts are fitted
    together under the key ``POOLED``, so what reaches the driver is bounded.
    """
    # lengths are binned for the fit (1/64 of an e-fold), limits are exact
    by = docs.groupBy(source, length).agg(F.count(F.lit(1)).alias("c"))
    by = materialize(by, "length-counts")
    total = by.agg(F.sum("c")).first()[0] or 0
    large = by.groupBy(F.col(source).alias("s")).agg(F.sum("c").alias("size")).filter(F.col("size") >= max(10, 1e-4 * total))
    # at most 10,000 sources have a share of 1e-4
    placed = by.select(F.col(source).alias("s0"), F.col(length).alias("n"), "c").join(F.broadcast(large), F.col("s0").eqNullSafe(F.col("s")), "left")
    placed = placed.groupBy(F.when(F.col("size").isNull(), POOLED).otherwise(F.col("s0")).alias("s"), "n").agg(F.sum("c").alias("c"))
    sizes = placed.groupBy(F.col("s").alias("s1")).agg(F.sum("c").alias("size"))
    kept = placed.join(F.broadcast(sizes), F.col("s").eqNullSafe(F.col("s1"))).select("s", "n", "c", "size")
    limits = kept.filter((F.col("c") >= F.greatest(F.lit(LIMIT_LEAST), F.col("size") * LIMIT_SHARE)) & (F.col("n") > 0)).select("s", "n", "c").collect()
    binned = kept.filter("n > 0").groupBy("s", F.floor(F.log("n") * 64).alias("b")).agg(F.sum("c").alias("c"), F.sum(F.col("n") * F.col("c")).alias("w")).select("s", (F.col("w") / F.col("c")).alias("m"), "c").collect()
    out: dict[tuple[str | None, int], float] = {}
    for s in {r["s"] for r in limits}:
        mine = {int(r["n"]): int(r["c"]) for r in limits if r["s"] == s}
        rest: Counter[int] = Counter()
        for r in binned:
            if r["s"] == s:
                rest[int(round(r["m"]))] += int(r["c"])
        for n, c in mine.items():
            # taken out of their bins, counted exactly
            near = min(rest, key=lambda k: abs(k - n))
            rest[near] -= min(c, rest[near])
            rest[n] += c
        for n, p in _fit(sorted(rest.items()), sorted(mine)).items():
            if p > 0.3:
                out[s, n] = p
    return out, {r["s"] for r in large.collect()}


def word_states(asked: DataFrame, counted: DataFrame) -> DataFrame:
    """(word, word_state) of each distinct word asked for; ``counted`` has word, n, ends of all words.

    A word that only stands where texts stop is ``broken`` if it begins
    another word, else a ``name`` or ``unseen``. All lookups are joins, hot
    words are one row on both sides.
    """
    sums = counted.agg(F.sum("n").alias("all_n"), F.sum("ends").alias("all_ends"))
    known = asked.select("word").distinct().join(counted, "word", "left").select("word", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("ends", F.lit(0)).alias("ends"))
    # one row of sums
    rate = (F.col("ends") + WORD_WEIGHT * F.coalesce(F.try_divide("all_ends", "all_n"), F.lit(0.0))) / (F.col("n") + WORD_WEIGHT)
    state = F.lit("usual")
    for bound, name in reversed(WORD_RATES):
        state = F.when(rate < bound, name).otherwise(state)
    placed = known.join(F.broadcast(sums)).select("word", "n", F.when(F.col("n") > 0, state).alias("word_state"))
    new = placed.filter("n <= 0").select("word")
    begins = counted.filter("n > 0").select(F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.length("word") - 1, F.lit(1))), lambda k: F.substring("word", F.lit(1), k))).alias("word")).join(new, "word", "left_semi").distinct().withColumn("begins", F.lit(True))
    name = (F.length("word") > 4) & (F.substring("word", 1, 1) != F.lower(F.substring("word", 1, 1)))
    return placed.join(begins, "word", "left").select("word", F.coalesce("word_state", F.when(F.col("begins"), "broken").when(name, "name").otherwise("unseen")).alias("word_state"))


def fit_endings(counts: list[tuple[str, object, int]], posterior: dict[object, float], rounds: int = 50) -> tuple[dict[str, float], dict[object, float], float]:
    """Log odds of each state, log prior odds of each limit, and of texts at none.

    ``counts`` has (state, limit or None, texts), ``posterior`` the censoring
    posterior of each limit. Expectation maximisation over cut and whole
    texts. What STATES expects and the posteriors of the lengths count as a
    few texts each, so that small collections stay near them.
    """
    of: Counter[str] = Counter()
    size: Counter[object] = Counter()
    for state, limit, n in counts:
        of[state] += n
        size[limit] += n
    posterior = {k: EXCESS_CUT * p for k, p in posterior.items()}
    given, rate, prior = dict(STATES), CUT_RATE, dict(posterior)
    inside = lambda x: min(1 - 1e-6, max(1e-6, x))
    logit = lambda x: math.log(inside(x) / (1 - inside(x)))
    for _ in range(rounds):
        cut: Counter[str] = Counter()
        at: Counter[object] = Counter()
        for state, limit, n in counts:
            a, b = given[state]
            p = rate if limit is None else prior[limit]
            r = p * a / (p * a + (1 - p) * b)
            cut[state] += n * r
            at[limit] += n * r
        total, all_ = sum(cut.values()) + ENDING_WEIGHT, sum(of.values()) + 2 * ENDING_WEIGHT
        # a text that stops where a unit ends is no case, however likely cutting did it: that share is not learned
        cut["closed"] = (total - ENDING_WEIGHT) * STATES["closed"][0]
        given = {s: ((cut[s] + ENDING_WEIGHT * a) / total, (of[s] - cut[s] + ENDING_WEIGHT * b) / (all_ - total)) for s, (a, b) in STATES.items()}
        prior = {k: inside((at[k] + LIMIT_WEIGHT * p) / (size[k] + LIMIT_WEIGHT)) for k, p in posterior.items()}
        rate = inside((at[None] + ENDING_WEIGHT * CUT_RATE) / (size[None] + ENDING_WEIGHT))
    return {s: math.log(a / b) for s, (a, b) in given.items()}, {k: logit(p) for k, p in prior.items()}, logit(rate)


def truncated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", threshold: float = 0.0) -> DataFrame:
    """Every row with a text: log odds of truncation, and whether it is cut off.

    Columns: the row id, source_name (normalised, null stays null), n_chars,
    ending (kind), state, ending_odds, limit_posterior (of the lengths alone),
    log_odds, is_cut. Null texts give no row, empty ones are never cut.
    Repeated rows are judged each on their own, alike.
    """
    spark = df.sparkSession
    docs = df.select(F.col(doc_id).cast("long").alias("row_id"), source_key(F.col(source)).alias("source_name"), F.col(text).alias("t")).filter("t is not null")
    counted = docs.select("t").mapInArrow(_word_counts, "word string, n long, ends long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    counted = materialize(counted, "word-ends")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist()
            found = [ending(t) for t in texts]
            words = [s[1:] if s[0] == "=" else None for _, s in found]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([len(t) for t in texts], pa.int64()), pa.array([k for k, _ in found], pa.string()), pa.array([None if w else s for (_, s), w in zip(found, words, strict=True)], pa.string()), pa.array(words, pa.string())], names=["row_id", "source_name", "n", "kind", "state", "word"])

    seen = materialize(docs.mapInArrow(look, "row_id long, source_name string, n long, kind string, state string, word string"), "endings")
    limits, alone = limit_table(seen.select("source_name", "n"))
    told = seen.filter("word is not null")
    states = told.join(word_states(told, counted), "word", "left").select("row_id", "source_name", "n", "kind", F.col("word_state").alias("state"))
    placed = seen.filter("word is null").select("row_id", "source_name", "n", "kind", "state").unionAll(states)
    # limits are as few as their shares allow; sources fitted alone at most 10,000
    own = spark.createDataFrame([(s, True) for s in alone], "own string, is_own boolean")
    known = spark.createDataFrame([(s, n, float(p)) for (s, n), p in limits.items()], "limit_source string, limit_n long, limit_posterior double")
    placed = placed.join(F.broadcast(own), F.col("source_name").eqNullSafe(F.col("own")), "left")
    fitted_as = F.when(F.col("is_own"), F.col("source_name")).otherwise(POOLED)
    placed = placed.withColumn("fitted_as", fitted_as).join(F.broadcast(known), F.col("fitted_as").eqNullSafe(F.col("limit_source")) & (F.col("n") == F.col("limit_n")), "left")
    placed = materialize(placed.select("row_id", "source_name", "n", "kind", "state", "limit_source", "limit_n", "limit_posterior"), "placed-endings")
    # a row for each state and limit
    table = placed.filter("kind <> 'empty'").groupBy("state", "limit_source", "limit_n", "limit_posterior").agg(F.count(F.lit(1)).alias("c")).collect()
    key = lambda r: None if r["limit_posterior"] is None else (r["limit_source"], r["limit_n"])
    odds, prior, rate = fit_endings([(r["state"], key(r), r["c"]) for r in table], {key(r): r["limit_posterior"] for r in table if key(r)})
    by_state = spark.createDataFrame(list(odds.items()), "state string, ending_odds double")
    by_limit = spark.createDataFrame([(*k, v) for k, v in prior.items()], "limit_source string, limit_n long, prior double")
    judged = placed.join(F.broadcast(by_state), "state", "left").alias("a").join(F.broadcast(by_limit.alias("b")), F.expr("a.limit_n = b.limit_n and a.limit_source <=> b.limit_source"), "left")
    both = F.when(F.col("kind") == "empty", F.lit(-20.0)).otherwise(F.col("ending_odds") + F.coalesce("prior", F.lit(rate)))
    return judged.select(F.col("row_id").alias(doc_id), "source_name", F.col("n").alias("n_chars"), F.col("kind").alias("ending"), "state", F.coalesce("ending_odds", F.lit(0.0)).alias("ending_odds"), F.coalesce("limit_posterior", F.lit(0.0)).alias("limit_posterior"), both.alias("log_odds"), (both > threshold).alias("is_cut"))


def truncation_by_source(judged: DataFrame) -> DataFrame:
    """How many texts of each source are cut off, and their share."""
    return judged.groupBy("source_name").agg(F.count(F.lit(1)).alias("documents"), F.sum(F.col("is_cut").cast("long")).alias("cut"), F.avg(F.col("is_cut").cast("double")).alias("cut_share"))
