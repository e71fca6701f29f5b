"""Text expressions: everything here is a Column built from Spark's own functions.

Python's white space and word classes are Unicode, Java's are ASCII unless a
pattern starts with ``(?U)``, so patterns over white space do.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that carry no topic. Fixed values.
STOP_WORDS = (
    "about above after again against also among and are because been before being between both can could did does "
    "during each from had has have having here into its may more most not of off onto our over per such than that the "
    "their then there these this those through under using was were when where which while with within without"
).split()
#: Patterns that define the results. Fixed values.
WORD = r"[A-Za-z][A-Za-z0-9_+-]{1,}"
HEADING = r"^(#{1,6})\s+(.+?)\s*$"
WIKI_LINK = r"\[\[([^\]|#]+)(?:#[^\]|]+)?(?:\|[^\]]+)?\]\]"
MD_LINK = r"\[([^\]]{1,120})\]\(([^)\s]+)\)"
DOI = r"(?i)(?:https?://doi\.org/|doi:\s*)(10\.\d{4,9}/[^\s)>\]]+)"
BRACKET_CITATION = r"\[(\d{1,3}(?:\s*[-,]\s*\d{1,3})*)\]"
FIGURE_REFERENCE = r"(?i)\b(?:Fig\.|Figure|Supplementary Fig\.|Supplementary Figure)\s+\d+[A-Za-z]?"
FRONT_MATTER = r"(?s)\A---\s*\n(.*?)\n---\s*\n"
MD_IMAGE = r"!\[([^\]]*)\]\(([^)\s]+)\)"
TABLE_ROW = r"^\s*\|.+\|\s*$"
TABLE_SEPARATOR = r"^\s*\|?\s*:?-{3,}:?\s*(?:\|\s*:?-{3,}:?\s*)+\|?\s*$"
INJECTION = r"(?i)\b(ignore (?:all )?(?:previous|prior|above) instructions|system prompt|developer message|hidden instruction|exfiltrat(?:e|ion)|reveal secrets|follow these instructions)\b"
LINE_BREAK = "\r\n|[\n\r\u000b\u000c\u001c-\u001e\u0085  ]"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: str | Column) -> Column:
    """Removes Unicode white space at both ends."""
    return F.regexp_replace(col(c), r"(?U)\A\s+|\s+\z", "")


def collapse(c: str | Column) -> Column:
    """Runs of white space become one blank, ends are stripped."""
    return F.trim(F.regexp_replace(col(c), r"(?U)\s+", " "))


def raw_words(c: str | Column) -> Column:
    return F.regexp_extract_all(col(c), F.lit(f"({WORD})"), F.lit(1))


def tokens(c: str | Column) -> Column:
    """Lower-case words without stop words, ``_+-`` stripped after the stop test."""
    stop = F.array(*map(F.lit, STOP_WORDS))
    kept = F.filter(F.transform(raw_words(c), F.lower), lambda x: ~F.array_contains(stop, x))
    return F.transform(kept, lambda x: F.btrim(x, F.lit("_+-")))


def rough_tokens(c: str | Column) -> Column:
    """Four thirds of the words, rounded down, at least 1."""
    return F.greatest(F.lit(1), F.floor(F.regexp_count(col(c), F.lit(r"(?U)\S+")) * 4 / 3).cast("int"))


def stable_id(prefix: str, c: str | Column) -> Column:
    return F.concat(F.lit(prefix + ":"), F.substring(F.sha1(col(c).cast("binary")), 1, 14))


def text_hash(c: str | Column, length: int = 16) -> Column:
    return F.substring(F.sha2(col(c).cast("binary"), 256), 1, length)


def clean_label(c: str | Column) -> Column:
    """A label without Markdown emphasis marks."""
    return collapse(F.regexp_replace(col(c), r"[*_`#]", ""))


def compact(c: str | Column, limit: int) -> Column:
    """White space collapsed; longer texts end in three dots at the limit."""
    t = collapse(c)
    return F.when(F.length(t) > limit, F.concat(F.rtrim(F.substring(t, 1, limit - 3)), F.lit("..."))).otherwise(t)


def clean_chunk_text(c: str | Column) -> Column:
    """Without images and tags, blanks and blank lines collapsed."""
    t = F.regexp_replace(col(c), r"!\[[^\]]*\]\([^)]+\)", "")
    t = F.regexp_replace(t, r"<[^>]+>", " ")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    return strip(F.regexp_replace(t, r"\n{3,}", "\n\n"))


def clean_text(c: str | Column) -> Column:
    """Extracted text with plain line ends and blanks, lines of digits blanked out."""
    t = F.translate(col(c), "\r\f ​­", "\n\n ")
    t = F.regexp_replace(t, r"[ \t]+", " ")
    t = F.regexp_replace(t, r"\n[ \t]+", "\n")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(t, r"(?Umd)^\s*\d+\s*$", ""))


def line_feeds(c: str | Column) -> Column:
    return F.regexp_replace(col(c), r"\r\n?", "\n")


def lines(c: str | Column) -> Column:
    """Lines as Python's splitlines has them: no last empty one."""
    parts = F.split(col(c), LINE_BREAK)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def paragraphs(c: str | Column) -> Column:
    """Blocks between blank lines, stripped, without empty ones."""
    return F.filter(F.transform(F.split(col(c), r"(?U)\n\s*\n"), strip), lambda x: x != "")


def compare_key(c: str | Column) -> Column:
    """Lower case, everything but a-z and 0-9 as single blanks."""
    return F.trim(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9]+", " "))


def slug(c: str | Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(col(c)), r"[^a-z0-9._-]+", "-"), r"^-+|-+$", "")


def posix_path(c: str | Column) -> Column:
    return F.lower(F.regexp_replace(F.replace(col(c), F.lit("\\"), F.lit("/")), r"^(\./)+|^/+|/+$", ""))


def front_matter(c: str | Column) -> Column:
    """The map of a leading front-matter block; empty where there is none.

    Keys are lower case, values lose quotation marks at their ends; of a
    repeated key the last holds.
    """
    rows = F.filter(F.split(F.regexp_extract(col(c), FRONT_MATTER, 1), LINE_BREAK), lambda x: F.contains(x, F.lit(":")))
    pairs = F.transform(
        rows,
        lambda x: F.struct(
            F.lower(strip(F.substring_index(x, ":", 1))).alias("key"),
            F.btrim(strip(F.regexp_replace(x, r"(?s)\A[^:]*:", "")), F.lit('"')).alias("value"),
        ),
    )
    # the last of each key, in the order of the keys
    keys = F.array_distinct(F.transform(pairs, lambda p: p["key"]))
    last = F.transform(keys, lambda k: F.struct(k.alias("key"), F.element_at(F.filter(pairs, lambda p: p["key"] == k), -1)["value"].alias("value")))
    return F.map_from_entries(last)


def without_front_matter(c: str | Column) -> Column:
    return F.regexp_replace(col(c), FRONT_MATTER, "")


def looks_fused(c: str | Column) -> Column:
    """Whether the words of a label, between white space, ran together."""
    label = col(c)
    letters = F.length(F.regexp_replace(label, r"[^A-Za-z]", ""))
    words = F.filter(F.split(label, r"(?U)\s+"), lambda x: x != "")
    longest = F.coalesce(F.array_max(F.transform(words, F.length)), F.lit(0))
    return (letters >= 28) & (((F.size(words) <= 2) & (letters > 35)) | ((longest > 34) & (F.size(words) <= 4)))


def first_heading(c: str | Column) -> Column:
    """The text of the first heading line of any level, cleaned; null without one."""
    found = F.filter(F.transform(lines(c), strip), lambda x: x.rlike(HEADING))
    return F.when(F.size(found) > 0, clean_label(F.regexp_extract(F.element_at(found, 1), HEADING, 2)))


def document_title(text: str | Column, path: str | Column) -> Column:
    """Front-matter title, else first heading, else the file name; fused ones don't count."""
    meta = F.element_at(front_matter(text), "title")
    heading = first_heading(without_front_matter(text))
    stem = F.regexp_replace(F.regexp_extract(col(path), r"([^/\\]*)$", 1), r"(?<=.)\.[^.]*$", "")
    fallback = F.trim(F.replace(stem, F.lit("_"), F.lit(" ")))
    usable = lambda t: t.isNotNull() & (t != "") & ~looks_fused(t)
    return F.when(usable(meta), meta).when(heading.isNotNull() & ~looks_fused(heading), heading).otherwise(fallback)


def citations(c: str | Column) -> Column:
    """DOIs, bracket references and figure references, in this order."""
    doi = F.transform(F.regexp_extract_all(col(c), F.lit(DOI), F.lit(1)), lambda x: F.concat(F.lit("doi:"), F.regexp_replace(x, r"[.,;]+$", "")))
    ref = F.transform(F.regexp_extract_all(col(c), F.lit(BRACKET_CITATION), F.lit(1)), lambda x: F.concat(F.lit("ref:"), F.replace(x, F.lit(" "), F.lit(""))))
    return F.concat(doi, ref, F.regexp_extract_all(col(c), F.lit(FIGURE_REFERENCE), F.lit(0)))


def links(c: str | Column) -> Column:
    """Targets of wiki links, then of Markdown links."""
    wiki = F.transform(F.regexp_extract_all(col(c), F.lit(WIKI_LINK), F.lit(1)), strip)
    return F.concat(wiki, F.transform(F.regexp_extract_all(col(c), F.lit(MD_LINK), F.lit(2)), strip))


def figure_records(c: str | Column, limit: int | None = 20) -> Column:
    """``alt (path)`` of each distinct image, ``Figure`` without alt; the limit is for chunks, None is all."""
    alt = F.transform(F.regexp_extract_all(col(c), F.lit(MD_IMAGE), F.lit(1)), clean_label)
    path = F.regexp_extract_all(col(c), F.lit(MD_IMAGE), F.lit(2))
    joined = F.zip_with(alt, path, lambda a, p: F.concat(F.when(a == "", "Figure").otherwise(a), F.lit(" ("), p, F.lit(")")))
    found = F.array_distinct(joined)
    return F.when(F.contains(col(c), F.lit("![")), found if limit is None else F.slice(found, 1, limit)).otherwise(F.array().cast("array<string>"))


def table_records(c: str | Column, limit: int | None = 20) -> Column:
    """Summaries of pipe tables: every four rows give the first ten cells of their first three.

    Separator rows count only as the first of all. A rest of fewer than four
    rows gives a record only where no four were full. The limit is for chunks,
    None is all.
    """
    rows = F.filter(F.transform(lines(c), strip), lambda x: x.rlike(TABLE_ROW))
    kept = F.filter(F.transform(rows, lambda x, k: F.struct(x.alias("row"), k.alias("k"))), lambda r: (r["k"] == 0) | ~r["row"].rlike(TABLE_SEPARATOR))
    kept = F.transform(kept, lambda r: r["row"])
    full = F.floor(F.size(kept) / 4).cast("int")
    groups = F.when(full > 0, full if limit is None else F.least(full, F.lit(limit))).when(F.size(kept) > 0, 1).otherwise(0)

    def record(g: Column) -> Column:
        cells = F.flatten(F.transform(F.slice(kept, g * 4 + 1, 3), lambda r: F.filter(F.transform(F.split(F.regexp_replace(r, r"^\|+|\|+$", ""), r"\|"), strip), lambda x: x != "")))
        return compact(F.array_join(F.slice(cells, 1, 10), " | "), 240)

    made = F.when(groups > 0, F.transform(F.sequence(F.lit(0), groups - 1), record)).otherwise(F.array().cast("array<string>"))
    none = F.array().cast("array<string>")
    # most texts have no table: nothing above is worked out for them
    return F.when(~F.contains(col(c), F.lit("|")), none).when(F.size(rows) < 2, none).otherwise(F.filter(made, lambda x: x != ""))


def phrase_is_useful(words: Column) -> Column:
    return (F.size(words) >= 2) & (F.size(F.array_distinct(words)) == F.size(words)) & F.exists(words, lambda x: F.length(x) > 3)


#: Headings that say nothing about a topic. Fixed values.
SECTION_WORDS = ("overview", "supplementary", "discussion", "methods", "references", "abstract", "results", "min", "max", "fig", "table", "data")


#: A run of hexadecimal digits. Fixed value.
HEX_RUN = r"[a-f0-9]{6,}"


def expansion_term_is_useful(c: str | Column) -> Column:
    """Whether a label may widen a query."""
    t = F.lower(F.trim(col(c)))
    return (
        (F.length(t) >= 3)
        & ~t.isin(*SECTION_WORDS)
        & ~F.contains(t, F.lit("pymupdf4llm"))
        & ~F.endswith(t, F.lit(" auto"))
        & ~looks_fused(t)
        & ~t.rlike(HEX_RUN)
        & ~t.rlike(r"[a-z]{5,}of[a-z]{5,}")
        & (F.contains(t, F.lit(" ")) | (F.length(t) <= 18))
    )


def injection_flags(c: str | Column, limit: int = 6) -> Column:
    """Phrases that try to instruct a reader, lower case, distinct, in order."""
    return F.slice(F.array_distinct(F.transform(F.regexp_extract_all(col(c), F.lit(INJECTION), F.lit(1)), F.lower)), 1, limit)


#: Signs of a poor extraction. Fixed values.
HYPHEN_BREAK = r"\b[A-Za-z]+-\s+[a-z]{2,}\b"
SPLIT_UNIT = r"\b\d+\s+[a-zA-Z]\s*-\s*\d+\b"
MISSING_EQUATION = r"(?i)\b(?:using|given by|following)\s+(?:the\s+)?equation\s*:\s*$"


def extraction_warnings(c: str | Column) -> Column:
    """Names of the extraction defects a text shows, in a fixed order."""
    t = col(c)
    return F.array_compact(
        F.array(
            F.when(t.rlike(HYPHEN_BREAK), "hyphenated_line_break"),
            F.when(t.rlike(SPLIT_UNIT), "split_unit_or_exponent"),
            F.when((F.regexp_count(t, F.lit("�")) >= 2) | t.rlike("Ã|Â|ï¬"), "mojibake"),
            F.when(t.rlike(MISSING_EQUATION), "missing_equation"),
        )
    )


def is_meaningful(c: str | Column, least: int = 20) -> Column:
    return F.regexp_count(col(c), F.lit("[A-Za-z]")) >= least


def looks_garbled(c: str | Column) -> Column:
    """Whether control and replacement characters exceed a fiftieth of a text (two at least)."""
    t = col(c)
    bad = F.regexp_count(t, F.lit("[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f�]"))
    return bad > F.greatest(F.lit(2), F.floor(F.length(t) / 50))


#: Labels of figures and tables: kind, number, panel. Fixed value.
FIGURE_LABEL = r"(?i)\b((?:Extended Data\s+|Supplementary\s+)?(?:Figure|Fig\.|Table))\s+([A-Za-z]?\d+)([A-Za-z]?)\b"


def figure_label(c: str | Column, panel: bool = True) -> Column:
    """``figure 3b`` of a text that names a figure or table, else null; without ``panel`` the label of its group."""
    t = col(c)
    part = lambda k: F.regexp_extract(t, FIGURE_LABEL, k)
    label = F.concat_ws("", part(1), F.lit(" "), part(2), *([part(3)] if panel else []))
    return F.when(t.rlike(FIGURE_LABEL), collapse(F.replace(F.lower(label), F.lit("fig."), F.lit("figure"))))


#: Ligatures written as one character, and signs of a wrong decoding. Fixed values.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
MISDECODED = ("â", "Ã", "Â", "ï¿", "�")
SYMBOLS = {"�": "", "ą": "±", "þ": "+"}


def _damage(text: str) -> int:
    return 4 * sum(map(text.count, MISDECODED)) + 10 * sum(c < " " and c not in "\n\t\r" for c in text)


def _repair(text: str) -> str:
    if any(m in text for m in MISDECODED):
        tries = [text]
        for page in ("cp1252", "latin1"):
            try:
                tries.append(text.encode(page).decode("utf-8"))
            except UnicodeError:
                continue
        text = min(tries, key=_damage)
    for table in (SYMBOLS, LIGATURES):
        for a, b in table.items():
            text = text.replace(a, b)
    return unicodedata.normalize("NFC", "".join(c for c in text if c >= " " or c in "\n\t"))


def fix_unicode(c: str | Column) -> Column:
    """Wrong decodings undone if that leaves fewer signs of them, ligatures spelled out, controls dropped, composed (NFC).

    A text goes through Python only if it holds anything but printable ASCII.
    """

    @F.pandas_udf("string")
    def fix(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(_repair, na_action="ignore")

    t = col(c)
    odd = F.when(t.rlike(r"[^\t\n\x20-\x7E]"), t)
    return F.coalesce(fix(odd), t)


def retrieval_text(heading: str = "heading", terms: str = "terms", figures: str = "figures", tables: str = "table_records", text: str = "text") -> Column:
    """What a chunk is searched by: its parts that are not empty, one a line."""
    part = lambda c: F.nullif(c, F.lit(""))
    return F.concat_ws("\n", part(F.col(heading)), part(F.array_join(terms, " ")), part(F.array_join(figures, " ")), part(F.array_join(tables, " ")), part(F.col(text)))
