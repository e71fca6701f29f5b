"""Rules over generated Markdown, and reports on what they find."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellichor.functions import text as X
from vellichor.operators.chunking import numbered_lines

#: (rule, pattern) tested on every line. Fixed values.
LINE_RULES = (
    ("empty_heading", r"^#{1,6}\s*$"),
    ("metadata_cover_sheet", r"(?i)\b(?:Manuscript title|Number of words)\b"),
    ("placeholder_affiliation", r"\b\d+\s+TBA\b|\bTBA\b"),
    ("running_header", r"(?i)Nature Communications\||Article\s+https?://doi\.org/"),
    ("known_mojibake", r"(?i)\b(?:fbers|specifc)\b"),
    ("known_artifact_phrase", r"(?i)B\[2\]\s*obs|curve\]\[|MJ/m\^3\s+MPa"),
)
#: (rule, pattern) tested on first-level headings of the first 20 lines. Fixed values.
TITLE_RULES = (
    ("slug_h1", r"^#\s+\S*_[^\n]*$"),
    ("bad_sentence_title", r"(?i)^#\s+(?:Herein,|Finally,|Feasibility of|Authors?:)"),
    ("truncated_title", r"(?i)^#\s+(?:Blueprint for a High-Performance Biomaterial:|Composition and Hierarchical Organisation of a|Robust Biological Fibers Based on)\s*$"),
    ("journal_h1", r"(?i)^#\s+(?:Microbial Cell Factories|Nature Communications)\s*$"),
)
REFERENCES = r"(?i)^##\s+References\b"
NUMBERED_REFERENCE = r"(?:^|\s)\d{1,3}\.\s+[A-Z]"
#: (counter, literals counted). Fixed values.
LITERALS = (
    ("duplicate_doi_prefix", ('doi: "doi:',)),
    ("article_heading", ("## Article", "## Feature Article")),
    ("broken_doi_spacing", ("https://doi. org",)),
    ("legacy_ligatures", ("fbers", "specifc")),
    ("saxs_waxd_garble", ("B[2] obs", "curve][")),
    ("unit_duplication", ("MJ/m^3 MPa",)),
    ("replacement_char", ("�",)),
    ("broken_charge_notation", ("[−]", "[þ]")),
)


def excerpt(c: str | Column, limit: int = 180) -> Column:
    return F.substring(X.collapse(c), 1, limit)


def line_findings(content: Column, line: Column) -> Column:
    """Names of the line and title rules that a line breaks."""
    title = [F.when((line <= 20) & F.startswith(content, F.lit("# ")) & content.rlike(p), r) for r, p in TITLE_RULES]
    return F.array_compact(F.array(*title, *[F.when(content.rlike(p), r) for r, p in LINE_RULES]))


def scan(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, line, rule, excerpt) of every finding; null texts have none.

    Carriage returns count once, at line 1. Fused references count within a
    section that starts with ``## References`` and ends at the next second-level
    heading.
    """
    from pyspark.sql import Window

    ln = numbered_lines(df.filter(F.col(body).isNotNull()), key, body)
    plain = ln.select(key, "line", F.explode(line_findings(F.col("content"), F.col("line"))).alias("rule"), excerpt("content").alias("excerpt"))
    crlf = df.filter(F.contains(F.col(body), F.lit("\r"))).select(F.col(key), F.lit(1).alias("line"), F.lit("crlf_line_endings").alias("rule"), F.lit("").alias("excerpt"))
    w = Window.partitionBy(key).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    stripped = X.strip("content")
    state = F.when(stripped.rlike(REFERENCES), 1).when(F.startswith(stripped, F.lit("## ")), 0)
    marked = ln.withColumn("state", F.last(state, ignorenulls=True).over(w)).withColumn("opens", stripped.rlike(REFERENCES))
    packed = marked.filter((F.col("state") == 1) & ~F.col("opens") & (F.regexp_count("content", F.lit(NUMBERED_REFERENCE)) >= 2)).select(key, "line", F.lit("packed_references").alias("rule"), excerpt("content").alias("excerpt"))
    return plain.unionByName(crlf).unionByName(packed)


def count_literal(c: Column, literal: str) -> Column:
    return ((F.length(c) - F.length(F.replace(c, F.lit(literal), F.lit("")))) / len(literal)).cast("long")


def issue_counters(df: DataFrame, key: str, body: str) -> DataFrame:
    """(key, issue, n): literal counters and findings by rule; zeros left out."""
    t = F.col(body)
    counters = [F.struct(F.lit(name).alias("issue"), sum((count_literal(t, s) for s in literals), F.lit(0)).cast("long").alias("n")) for name, literals in LITERALS]
    pages = F.size(F.filter(X.lines(t), lambda x: F.startswith(x, F.lit("![Page ")))).cast("long")
    counters.append(F.struct(F.lit("generic_page_alt").alias("issue"), pages.alias("n")))
    literal = df.filter(t.isNotNull()).select(F.col(key), F.explode(F.array(*counters)).alias("c")).select(key, "c.issue", "c.n")
    rules = scan(df, key, body).groupBy(key, F.concat(F.lit("assertion_"), "rule").alias("issue")).agg(F.count(F.lit(1)).alias("n"))
    return literal.filter("n > 0").unionByName(rules)


def findings_by_rule(findings: DataFrame, rules: list[str], key: str = "path") -> DataFrame:
    """One row per file, one column per rule, 0 where a rule was not broken."""
    return findings.groupBy(key).pivot("rule", rules).count().na.fill(0)


def compare_findings(before: DataFrame, after: DataFrame, key: str = "path") -> DataFrame:
    """(key, before, after, delta) over the files of either side."""
    b = before.groupBy(key).agg(F.count(F.lit(1)).alias("before"))
    a = after.groupBy(key).agg(F.count(F.lit(1)).alias("after"))
    return b.join(a, key, "full").na.fill(0, ["before", "after"]).withColumn("delta", F.col("after") - F.col("before"))


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.round(F.try_divide(a.cast("double"), b.cast("double")), 4), F.lit(0.0))


def audit_matrix(runs: DataFrame) -> DataFrame:
    """Per backend asked for: runs, failures, tokens, assets and issues, and the share of runs that failed."""
    ok = F.col("status") == "ok"
    return runs.groupBy("backend_requested").agg(
        F.count(F.lit(1)).alias("runs"), F.sum((~ok).cast("int")).alias("failed"), F.sum("tokens").alias("tokens"), F.sum("asset_count").alias("assets"), F.sum("issue_total").alias("issues"), ratio(F.sum((~ok).cast("int")), F.count(F.lit(1))).alias("failed_share"),
    )


def issue_totals(runs: DataFrame) -> DataFrame:
    """(backend_requested, issue, n): counts in the maps of all runs, added up."""
    return runs.select("backend_requested", F.explode("issue_counts").alias("issue", "n")).groupBy("backend_requested", "issue").agg(F.sum("n").alias("n"))
