"""Key terms of texts: counted words and phrases, ranked, without parts of each other."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellichor.functions import text as X

_WORD = re.compile(X.WORD)
_STOP = frozenset(X.STOP_WORDS)


def topic_words(c: str | Column) -> Column:
    """Tokens of more than two letters that are no stop words even after stripping."""
    stop = F.array(*map(F.lit, X.STOP_WORDS))
    return F.filter(X.tokens(c), lambda x: (F.length(x) > 2) & ~F.array_contains(stop, x))


def ngrams(words: Column, size: int) -> Column:
    """All runs of ``size`` words as arrays."""
    n = F.size(words) - size + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda k: F.slice(words, k, size))).otherwise(F.array().cast("array<array<string>>"))


def phrase_counts(df: DataFrame, key: str, text: str, sizes: tuple[int, ...] = (2, 3)) -> DataFrame:
    """(key, phrase, n): useful phrases of a text, as often as they occur."""
    w = df.select(F.col(key), topic_words(text).alias("w"))
    parts = F.concat(*[F.filter(ngrams(F.col("w"), s), X.phrase_is_useful) for s in sizes])
    return w.select(key, F.explode(parts).alias("p")).groupBy(key, F.array_join("p", " ").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


def best_terms(text: str | None, limit: int) -> list[str]:
    """The key terms of one text, see ``key_terms``."""
    found = (m.lower() for m in _WORD.findall(text or ""))
    words = [w for w in (m.strip("_+-") for m in found if m not in _STOP) if len(w) > 2 and w not in _STOP]
    weight: dict[str, int] = {w: 100 * n for w, n in Counter(words).items()}
    for size in (2, 3):
        runs = Counter(zip(*(words[k:] for k in range(size)), strict=False))
        for run, n in runs.items():
            if n > 1 and len(set(run)) == size and any(len(w) > 3 for w in run):
                weight[" ".join(run)] = 135 * n
    taken: list[str] = []
    # the sort is stable: words come before phrases, each in the order of their first place
    for term in sorted(weight, key=lambda t: (-weight[t], -len(t))):
        if len(taken) == limit:
            break
        if not any(term in t for t in taken):
            taken.append(term)
    return taken


def key_terms(df: DataFrame, key: str, text: str, limit: int = 14) -> DataFrame:
    """(key, terms): the best terms of each text.

    Words weigh their count, phrases of two or three words that occur more
    than once 1.35 times theirs. Order: weight, length, words before phrases,
    first place. A term inside one already taken is passed over. Texts
    without terms have an empty array, a null text counts as empty.

    Each text is settled where it is, in Arrow batches: counting its phrases
    with a shuffle would move more than the text itself.
    """
    return df.select(F.col(key), terms_column(text, limit).alias("terms"))


def terms_column(text: str | Column, limit: int = 14) -> Column:
    """The key terms of a text as an array."""

    @F.pandas_udf("array<string>")
    def best(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(lambda t: best_terms(t, limit))

    return best(F.coalesce(X.col(text), F.lit("")))
