"""Statistics that tell prose from lists, tables and junk, and how far each
text lies from prose.

Each text gets a vector of statistics of its words, symbols and lines. Prose
of each language has a robust centre and covariance: medians and median
deviations first, then means and covariances over the texts that lie within
the chi-square bound, twice (concentration steps). The distance of a text is
its Mahalanobis distance from the prose of its language; the contribution of
a statistic is its term of the squared distance, and the contributions add up
to it. Lists, tables and junk lie along facets of the statistics (listed lines,
values in columns, words that can't be read), each with a pole: what a text
wholly of that shape would have. A text outside the bound takes the shape of
the facet along which its distance from prose is at least half of that of the
pole, in the fitted metric of its language; no statistic has a cut-off of its
own.

All texts take part in the fit; what the driver sees is one row of moments
per language.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellichor.plans.lineage import materialize

STATISTICS = (
    "log_words", "mean_word_length", "log_longest_word", "symbol_ratio", "digit_ratio", "line_end_punctuation",
    "common_words", "log_words_per_line", "distinct_words", "readable_words", "list_share", "table_share", "sentence_rate",
)
#: Common function words by language. Fixed values.
COMMON = {
    "en": "the of and in to a for is was by at with from that not were it as this an which on or be are has had but its their we our each when what than then only also both into these those after before between",
    "de": "der die das und ist wurde für von mit nicht auf den dem ein eine bei sich nach zur im des zu als es wir an aus wie auch nur oder sind war durch über ohne ergab eines einer",
    "fr": "le la les des du et est une dans pour que pas par sur au aux un ne ni ce cette il elle se en avec plus été ont nous dont à de son ses après même",
    "es": "el los las del en un una por con para no se que y de la es al como más según fue ha entre sobre su sus también hasta desde durante ambas",
    "pt": "o os da do das dos uma um não em com é e a que para na no por ao se foi são mais como entre acima até pela pelo ou sua seus as",
}
BOUND = 0.999
FLOOR = 0.03
#: The facets of the shapes: statistics, and their values in a text that is nothing else.
FACETS = {"list": {"list_share": 1.0}, "table": {"table_share": 1.0}, "junk": {"readable_words": 0.0, "common_words": 0.0, "distinct_words": 0.3}}
#: A text is mostly of a shape from this part of the way to its pole on.
MOSTLY = 0.5

_LANGS = tuple(COMMON)
_KNOWN = {w: tuple(k for k, lang in enumerate(_LANGS) if w in COMMON[lang].split()) for lang in _LANGS for w in COMMON[lang].split()}
#: A word with a vowel, an elided article before it.
_READABLE = re.compile(r"(?<!\S)[\"'“‘(\[]?(?:[^\W\d_]{1,3}[’'])?[^\W\d_]{0,40}[aeiouyáéíóúàèìòùâêîôûäöüãõåæøœAEIOUYÁÉÍÓÚÀÈÌÒÙÂÊÎÔÛÄÖÜÃÕÅ�][^\W\d_]{0,40}(?:[-’'][^\W\d_]{1,40}){0,8}[\"'”’)\]]?[.,;:!?]*(?!\S)")
_SENTENCE = re.compile(r"[^\W\d_)\]%°]{2}[.!?][\"”’)]?(?=\s|$)|[.!?][\"”’)]?\s+(?=[A-ZÀ-Þ])")
_PAGE_AT_END = re.compile(r"(?<!\d)\d{1,4}$")
_MARKER = re.compile(r"\s*(?:[-*•◦▪‣]\s+(?!\d+ -$)|\(?(?:\d{1,3}|[ivx]{1,5})[.)]\s+(?=\S)|\(?[a-z]\)\s+|\[\d{1,3}\]\s+(?=\S))")
_INDEX = re.compile(r"[^\W\d_][^,;|\t]{1,80}(?:,\s+\d{1,4}(?:[-–]\d{1,4})?)+\s*$")
_REFERENCE = re.compile(r"(?:^|\s)(?:\[\d{1,3}\]|\d{1,3}\.)\s+[^\W\d_][^\d\n]{1,80}?,\s[^\W\d_]\.")
_NUMBER = re.compile(r"[-−–+]?\d[\d.,]*%?")
_COLUMNS = re.compile(r"\S {2,}\S")
_SPACELESS = re.compile(r"\S{38,}")
_CELLS = re.compile(r";(?=\S)|,(?=[\d–-])(?<!\d,)")
_TITLE = re.compile(r"(?:Table|Tab\.|Tabelle|Tableau|Tabla|Tabela|Quadro)\s+[\dIVX]+[.:]?\s")
_DUMP = re.compile(r"[0-9a-fA-F]{6,}:?(?:\s+[0-9a-fA-F]{2,8}){4,}|(?:\(cid:\d+\)\s*){2,}.*")


@dataclass(frozen=True)
class Lines:
    """Non-blank characters by the kind of line they stand in."""

    total: int
    listed: int
    tabled: int


def _leaders(line: str) -> bool:
    """Whether a line ends in leaders and a page number."""
    if not (".." in line or ". . " in line or "…" in line or "__" in line):
        return False
    m = _PAGE_AT_END.search(line.rstrip())
    if not m:
        return False
    lead = line[: m.start()]
    return lead.rstrip().endswith(("....", "……", "____")) or lead.rstrip(" ").endswith(". . . .") and lead.endswith(" ")


def _columns(line: str) -> bool:
    return "  " in line and bool(_COLUMNS.search(line))


def _cells(line: str) -> bool:
    return (";" in line or "," in line) and bool(_CELLS.search(line))


def _is_value(word: str) -> bool:
    return (word[-1] in "0123456789.,%" and bool(_NUMBER.fullmatch(word))) or word in ("–", "-", "—", "±", "n/a", "n.d.", "NA", "nd")


def line_kinds(text: str) -> Lines:
    """Counts the characters in lines of lists and of tables.

    Lines with column delimiters or mostly of values are table lines. Lines
    with list markers, leaders or page numbers, and runs of short lines
    without sentences, are list lines; a line that continues a marked one
    counts with it.
    """
    lines = [s for s in text.split("\n")]
    total = listed = tabled = title = 0
    short: list[int] = []
    open_item = False
    filled = sum(1 for s in lines if s.strip()) or 1
    most = max(2, 0.5 * filled)
    semis = sum(1 for s in lines if _cells(s)) >= most
    columns = sum(1 for s in lines if _columns(s.strip()) and not _leaders(s)) >= most
    marked = sum(1 for s in lines if _MARKER.match(s))
    if marked < max(2, 0.2 * filled):
        marked = 0
    piped = Counter(s.count("|") for s in lines if " | " in s)
    for s in lines:
        t = s.strip()
        if not t:
            open_item = False
            continue
        n = len(t) - t.count(" ")
        total += n
        if _leaders(t):
            listed += n
            open_item = False
            continue
        if (t[0] in "0123456789abcdefABCDEF(") and _DUMP.fullmatch(t):
            continue
        if (t.count("|") >= 2 and t[0] == t[-1] == "|") or (" | " in t and piped[s.count("|")] >= 2) or "\t" in t or (semis and _cells(t)) or (columns and _columns(t)):
            tabled += n
            open_item = False
            continue
        if t[-1].isdigit() and ", " in t and _INDEX.fullmatch(t):
            listed += n
            open_item = False
            continue
        words = t.split()
        values = sum(map(_is_value, words))
        if values and values >= 0.6 * len(words) and not _MARKER.fullmatch(t + " "):
            tabled += n
            open_item = False
            continue
        if marked and _MARKER.match(t):
            listed += n
            open_item = True
            continue
        if open_item:
            listed += n
            continue
        if _TITLE.match(t) and len(t) <= 100:
            title += n
            continue
        if len(words) <= 7 and len(t) <= 70 and (t[-1] not in ".!?" or t.endswith("et al.")) and not _SPACELESS.search(t) and sum(w.lower() in _KNOWN for w in words) <= 0.2 * len(words):
            short.append(n)
    if tabled and title:
        total -= title
    if len(short) >= 3 and len(short) >= 0.5 * filled and len(_SENTENCE.findall(text)) <= 0.1 * filled and sum(short) >= 0.5 * (total - listed - tabled):
        # names over columns of values belong to the table, other runs of short lines are lists
        if tabled > sum(short):
            tabled += sum(short)
        else:
            listed += sum(short)
    elif len(short) <= 2 and tabled >= 0.5 * (total - sum(short)):
        tabled += sum(short)
    if total and not tabled > 0.5 * total and not listed > 0.5 * total:
        # reference lists run together within paragraphs, keyword lines
        refs = len(_REFERENCE.findall(text))
        if refs >= 2 and refs * 60 >= 0.5 * total:
            listed = max(listed, int(0.9 * total))
        elif re.match(r"\s*(?:Keywords|Schlagwörter|Mots[- ]clés|Palabras clave|Palavras[- ]chave|Index terms)\s*[:—-]", text) and filled <= 3:
            listed = max(listed, int(0.9 * total))
    return Lines(total, min(listed, total), min(tabled, total))


def statistics(text: str) -> tuple[int, list[float]]:
    """The language (index, -1: none found) and the statistics of a text."""
    words = text.split()
    n = len(words)
    if not n:
        return -1, [0.0] * len(STATISTICS)
    compact = sum(map(len, words))
    low = [w for w in text.lower().split() if w in _KNOWN]
    votes = [0] * len(_LANGS)
    for w in low:
        for k in _KNOWN[w]:
            votes[k] += 1
    best = max(range(len(_LANGS)), key=votes.__getitem__)
    kinds = line_kinds(text)
    filled = [s for s in text.split("\n") if s.strip()]
    letters = sum(map(str.isalpha, text))
    digits = len(re.findall(r"\d", text))
    ended = sum(s.rstrip().rstrip("\"”’)]*_")[-1:] in tuple(".!?:;") for s in filled)
    return (best if votes[best] else -1), [
        float(np.log1p(n)),
        compact / n,
        float(np.log1p(max(map(len, words)))),
        (compact - letters - digits) / compact,
        digits / compact,
        ended / len(filled),
        votes[best] / n,
        float(np.log1p(n / len(filled))),
        len(set(words)) / n ** 0.9,
        len(_READABLE.findall(text)) / n,
        kinds.listed / max(1, kinds.total),
        kinds.tabled / max(1, kinds.total),
        len(_SENTENCE.findall(text)) / n,
    ]


_STATS_SCHEMA = T.StructType([T.StructField("row_id", T.LongType()), T.StructField("language", T.StringType()), *[T.StructField(s, T.DoubleType()) for s in STATISTICS]])


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        langs, rows = [], []
        for text in b.column(1).to_pylist():
            lang, row = statistics(text)
            langs.append(_LANGS[lang] if lang >= 0 else "none")
            rows.append(row)
        m = np.array(rows, float).reshape(-1, len(STATISTICS))
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), *[pa.array(m[:, k]) for k in range(m.shape[1])]], names=_STATS_SCHEMA.names)


def document_statistics(df: DataFrame, row_id: str = "seq", text: str = "text") -> DataFrame:
    """One row of statistics for each row with a text that is not blank."""
    rows = df.select(F.col(row_id).cast("long").alias("row_id"), F.col(text).alias("t")).filter(F.col("t").rlike(r"(?U)\S"))
    return rows.mapInArrow(_measure, _STATS_SCHEMA)


def chi2_quantile(p: float, d: int) -> float:
    """Wilson and Hilferty's approximation."""
    from statistics import NormalDist

    z = NormalDist().inv_cdf(p)
    return d * (1 - 2 / (9 * d) + z * (2 / (9 * d)) ** 0.5) ** 3


class ProseModel:
    """Centre and inverse covariance of prose by language; ``none`` is the pooled one."""

    def __init__(self, centres: dict[str, np.ndarray], inverses: dict[str, np.ndarray]):
        self.centres, self.inverses = centres, inverses

    def _key(self, language: str) -> str:
        return language if language in self.centres else "none"

    def contributions(self, language: str, x: np.ndarray) -> np.ndarray:
        key = self._key(language)
        d = x - self.centres[key]
        return d * (d @ self.inverses[key])

    def facets(self, language: str, x: np.ndarray) -> np.ndarray:
        """How far towards the pole of each shape rows lie: their distance from prose over that of the pole, within the facet."""
        key = self._key(language)
        covariance = np.linalg.inv(self.inverses[key])
        out = np.zeros((len(x), len(FACETS)))
        for j, pole in enumerate(FACETS.values()):
            at = [STATISTICS.index(s) for s in pole]
            metric = np.linalg.inv(covariance[np.ix_(at, at)])
            centre = self.centres[key][at]
            d, far = x[:, at] - centre, np.array(list(pole.values())) - centre
            out[:, j] = np.sqrt(np.einsum("ij,jk,ik->i", d, metric, d) / max(1e-9, far @ metric @ far))
        return out


def _moments(stats: DataFrame, model: ProseModel, bound: float) -> dict[str, tuple[float, np.ndarray, np.ndarray]]:
    """Number, mean and covariance of the rows within the bound, by language."""
    d = len(STATISTICS)
    shared = stats.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            x = np.column_stack([b.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS]) if b.num_rows else np.zeros((0, d))
            langs = np.array(b.column("language").to_pylist(), object)
            for lang in set(langs):
                y = x[langs == lang]
                inside = shared.value.contributions(lang, y).sum(1) <= bound
                y = np.column_stack([np.ones(inside.sum()), y[inside]])
                sums[lang] = sums.get(lang, 0) + y.T @ y
        keys = sorted(sums)
        yield pa.RecordBatch.from_arrays([pa.array([k for k in keys for _ in range((d + 1) ** 2)], pa.string()), pa.array(list(range((d + 1) ** 2)) * len(keys), pa.int32()), pa.array(np.concatenate([sums[k].ravel() for k in keys]) if keys else [], pa.float64())], names=["language", "pos", "v"])

    rows = stats.mapInArrow(run, "language string, pos int, v double").groupBy("language", "pos").agg(F.sum("v").alias("v")).collect()
    out: dict[str, np.ndarray] = {}
    for r in rows:
        out.setdefault(r["language"], np.zeros((d + 1) ** 2))[r["pos"]] = r["v"]
    full = {k: v.reshape(d + 1, d + 1) for k, v in out.items()}
    if full:
        full["none"] = sum(full.values())
    result = {}
    for k, m in full.items():
        n = m[0, 0]
        if n >= 5 * d or k == "none":
            mean = m[0, 1:] / max(n, 1)
            result[k] = (n, mean, m[1:, 1:] / max(n, 1) - np.outer(mean, mean))
    return result


def fit_prose(stats: DataFrame, bound: float = BOUND, steps: int = 2) -> ProseModel:
    """Robust centre and covariance of prose by language, over all rows."""
    d = len(STATISTICS)
    med = [F.percentile_approx(s, [0.25, 0.5, 0.75], 1000).alias(s) for s in STATISTICS]
    grouped = [*stats.groupBy("language").agg(F.count(F.lit(1)).alias("n"), *med).collect(), *stats.agg(F.lit("none").alias("language"), F.count(F.lit(1)).alias("n"), *med).collect()]
    centres, inverses = {}, {}
    for r in grouped:
        if r["n"] < 5 * d and r["language"] != "none" or not r["n"] or r[STATISTICS[0]] is None:
            continue
        q = np.array([r[s] for s in STATISTICS])
        spread = np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR * np.maximum(1, np.abs(q[:, 1])))
        if r["language"] == "none" and "none" in centres:
            continue
        centres[r["language"]], inverses[r["language"]] = q[:, 1], np.diag(1 / spread**2)
    if r := [x for x in grouped if x["language"] == "none"][-1:]:
        if r[0][STATISTICS[0]] is not None:
            q = np.array([r[0][s] for s in STATISTICS])
            centres["none"], inverses["none"] = q[:, 1], np.diag(1 / np.maximum((q[:, 2] - q[:, 0]) / 1.349, FLOOR * np.maximum(1, np.abs(q[:, 1]))) ** 2)
    centres.setdefault("none", np.zeros(d))
    inverses.setdefault("none", np.eye(d))
    model = ProseModel(centres, inverses)
    limit = chi2_quantile(bound, d)
    for _ in range(steps):
        fitted = _moments(stats, model, limit)
        centres, inverses = dict(model.centres), dict(model.inverses)
        for k, (n, mean, cov) in fitted.items():
            if n > d:
                floor = (FLOOR * np.maximum(1, np.abs(mean))) ** 2
                centres[k], inverses[k] = mean, np.linalg.inv(cov + np.diag(floor))
        model = ProseModel(centres, inverses)
    return model


def shape_of(outlying: np.ndarray, facets: np.ndarray) -> list[str]:
    """The shape of each row: that of the facet it has gone farthest along, if most of the way.

    Lists and tables come before junk: what their lines hold need not read as words.
    """
    names = list(FACETS)
    laid = facets[:, :2].argmax(1)
    kind = np.where(facets[:, :2].max(1) >= MOSTLY, laid, np.where(facets[:, 2] >= MOSTLY, 2, 3))
    return [names[k] if out and k < 3 else "prose" for out, k in zip(outlying, kind, strict=True)]


def shapes(df: DataFrame, row_id: str = "seq", text: str = "text", bound: float = BOUND) -> DataFrame:
    """Shape, squared distance and contributions of each text that is not blank.

    Columns: the row id, language, shape (prose, list, table, junk), distance2,
    outlier, the statistics, and contribution (map by statistic). Null and
    blank texts give no row; repeated rows give one row each.
    """
    stats = materialize(document_statistics(df, row_id, text), "shape-statistics")
    model = fit_prose(stats, bound)
    limit = chi2_quantile(bound, len(STATISTICS))
    shared = df.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*_STATS_SCHEMA.fields, T.StructField("shape", T.StringType()), T.StructField("distance2", T.DoubleType()), T.StructField("outlier", T.BooleanType()), T.StructField("contribution", T.MapType(T.StringType(), T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(s).to_numpy(zero_copy_only=False) for s in STATISTICS]) if b.num_rows else np.zeros((0, len(STATISTICS)))
            langs = np.array(b.column("language").to_pylist(), object)
            terms, ways = np.zeros_like(x), np.zeros((len(x), len(FACETS)))
            for lang in set(langs):
                mine = langs == lang
                terms[mine], ways[mine] = shared.value.contributions(lang, x[mine]), shared.value.facets(lang, x[mine])
            d2 = terms.sum(1)
            shape = shape_of(d2 > limit, ways)
            maps = pa.MapArray.from_arrays(pa.array(np.arange(len(x) + 1) * len(STATISTICS), pa.int32()), pa.array(list(STATISTICS) * len(x), pa.string()), pa.array(terms.ravel()))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(shape, pa.string()), pa.array(d2), pa.array(d2 > limit), maps], names=schema.names)

    return stats.mapInArrow(run, schema).withColumnRenamed("row_id", row_id)
