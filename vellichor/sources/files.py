"""Reading folders of documents into (path, body) rows."""

from __future__ import annotations


import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = ("docx", "pptx", "html", "htm", "csv", "txt", "md")
GENERATED = r"(?:^|/)(?:_knowledge_graph|_kg_smoke)(?:/|$)"


def list_files(spark: SparkSession, folder: str, exclude: str | None = None) -> DataFrame:
    """(path, relative, suffix, length, modified) of supported files below a folder, but for those below ``exclude``."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    base = re.sub(r"^file:/*", "/", folder.rstrip("/")) + "/"
    f = f.withColumn("plain", F.regexp_replace("path", r"^file:/*", "/")).withColumn("relative", F.replace("plain", F.lit(base), F.lit("")))
    f = f.withColumn("suffix", F.lower(F.regexp_extract("plain", r"\.([^./]+)$", 1))).filter(F.col("suffix").isin(*SUFFIXES))
    if exclude:
        f = f.filter(~F.startswith("plain", F.lit(re.sub(r"^file:/*", "/", exclude.rstrip("/")) + "/")))
    return f.select("path", "relative", "suffix", "length", "modified")


def batch_targets(files: DataFrame, relative: str = "relative") -> DataFrame:
    """(relative, target): the .md each file becomes; files that would share one carry their suffix in its name."""
    stem = F.regexp_replace(relative, r"\.[^./]+$", "")
    suffix = F.lower(F.regexp_extract(relative, r"\.([^./]+)$", 1))
    t = files.select(F.col(relative).alias("relative"), stem.alias("stem"), suffix.alias("suffix"))
    n = t.groupBy(F.lower("stem").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return t.join(n, F.lower("stem") == F.col("k")).select("relative", F.when(F.col("n") > 1, F.concat("stem", F.lit("__"), "suffix", F.lit(".md"))).otherwise(F.concat("stem", F.lit(".md"))).alias("target"))


def read_markdown(spark: SparkSession, folder: str, most_files: int | None = None) -> DataFrame:
    """(path, body) of the Markdown files below a folder, generated index folders left out; an empty folder is an error."""
    df = spark.read.text(folder, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md").select(F.input_file_name().alias("path"), F.col("value").alias("body"))
    df = df.filter(~F.col("path").rlike(GENERATED))
    n = df.select("path").limit((most_files or 0) + 1).count()
    if not n:
        raise ValueError(f"no Markdown files below {folder}")
    if most_files is not None and n > most_files:
        raise ValueError(f"more than {most_files} Markdown files below {folder}")
    return df


def titled(stem: str | Column, body: Column) -> Column:
    return F.concat(F.lit("# "), F.col(stem) if isinstance(stem, str) else stem, F.lit("\n\n"), body)


class _Html(HTMLParser):
    """Headings, paragraphs, list items and code of a page, in order; navigation and scripts left out."""

    _SKIP = {"script", "style", "nav", "footer", "header", "aside"}
    _BLOCKS = {"h1": "\n# ", "h2": "\n## ", "h3": "\n### ", "h4": "\n#### ", "p": "", "li": "- "}

    _ENDS_PARAGRAPH = {"p", "ul", "ol", "dl", "pre", "table", "div", "article", "section", "blockquote", "hr", "form", "h1", "h2", "h3", "h4", "h5", "h6"}

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.skip = 0
        self.open: list[tuple[str, list[str]]] = []

    def handle_starttag(self, tag, attrs):
        if tag in self._SKIP:
            self.skip += 1
        elif not self.skip and (tag in self._BLOCKS or tag in ("pre", "code")):
            self._close_paragraph(tag)
            self.open.append((tag, []))
        elif not self.skip:
            self._close_paragraph(tag)

    def _close_paragraph(self, tag):
        # a block ends an unclosed paragraph
        if tag in self._ENDS_PARAGRAPH and self.open and self.open[-1][0] == "p":
            self.handle_endtag("p")

    def handle_endtag(self, tag):
        if tag in self._SKIP:
            self.skip = max(0, self.skip - 1)
            return
        if not any(t == tag for t, _ in self.open):
            return
        while self.open:
            name, parts = self.open.pop()
            text = "".join(parts)
            inner = bool(self.open)
            if name in ("pre", "code") and not inner:
                if text.strip():
                    self.out.append(f"```\n{text.strip()}\n```")
            elif inner:
                # text of a nested block belongs to the block around it
                self.open[-1][1].append(" " + text)
            elif flat := " ".join(text.split()):
                self.out.append(self._BLOCKS.get(name, "") + flat)
            if name == tag:
                break

    def handle_data(self, data):
        if not self.skip and self.open:
            self.open[-1][1].append(data)


def html_to_markdown(page: str | None) -> str | None:
    """A page as Markdown; None stays None, broken markup gives what can be read."""
    if page is None:
        return None
    p = _Html()
    p.feed(page)
    while p.open:
        p.handle_endtag(p.open[-1][0])
    return "\n".join(p.out).strip()


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"


def docx_to_markdown(data: bytes) -> str:
    """Paragraphs, headings, lists and tables of a word-processor file, in order."""
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    text = lambda n: "".join(t.text or "" for t in n.iter(f"{_W}t"))
    out = []
    for n in root.find(f"{_W}body") or []:
        if n.tag == f"{_W}p":
            s = n.find(f"{_W}pPr/{_W}pStyle")
            style = s.get(f"{_W}val", "") if s is not None else ""
            t = text(n).strip()
            if not t:
                continue
            m = re.fullmatch(r"Heading ?([1-3])", style)
            out.append("#" * int(m.group(1)) + " " + t if m else "- " + t if style.startswith("List") else t)
        elif n.tag == f"{_W}tbl":
            rows = [[" ".join(text(c).split()) for c in r.iter(f"{_W}tc")] for r in n.iter(f"{_W}tr")]
            if rows:
                out.append("\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join("---" for _ in rows[0]) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])]))
    return "\n\n".join(out)


def pptx_to_markdown(data: bytes) -> str:
    """Slides: their title as a heading (or ``Slide n``), other text as bullets."""
    z = zipfile.ZipFile(io.BytesIO(data))
    slides = sorted((n for n in z.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[0]))
    out = []
    for k, name in enumerate(slides, 1):
        title, bullets = None, []
        for sp in ElementTree.fromstring(z.read(name)).iter(f"{_P}sp"):
            c = sp.find(f"{_P}nvSpPr/{_P}cNvPr")
            lines = [t for p in sp.iter(f"{_A}p") if (t := "".join(x.text or "" for x in p.iter(f"{_A}t")).strip())]
            if title is None and lines and c is not None and c.get("name", "").lower().startswith("title"):
                title = " ".join(lines)
            else:
                bullets += lines
        out.append("\n".join([f"## {title or f'Slide {k}'}", "", *(f"- {b}" for b in bullets)]).strip())
    return "\n\n".join(out)


def csv_to_markdown(data: bytes) -> str:
    """A comma-separated table as a pipe table; empty cells stay empty."""
    import csv

    rows = [r for r in csv.reader(io.StringIO(data.decode("utf-8", "replace"))) if r]
    if not rows:
        return ""
    n = max(map(len, rows))
    rows = [[" ".join(c.split()).replace("|", "\\|") for c in r] + [""] * (n - len(r)) for r in rows]
    return "\n".join(["| " + " | ".join(rows[0]) + " |", "| " + " | ".join(["---"] * n) + " |", *("| " + " | ".join(r) + " |" for r in rows[1:])])


def _convert(relative: str, data: bytes) -> tuple[str | None, str | None]:
    suffix = relative.rsplit(".", 1)[-1].lower()
    stem = relative.rsplit("/", 1)[-1].rsplit(".", 1)[0]
    try:
        if not data:
            raise ValueError("empty file")
        if suffix in ("txt", "md"):
            body = data.decode("utf-8", "replace").strip()
        elif suffix in ("html", "htm"):
            return html_to_markdown(data.decode("utf-8", "replace")), None
        else:
            body = {"docx": docx_to_markdown, "pptx": pptx_to_markdown, "csv": csv_to_markdown}[suffix](data)
        return f"# {stem}\n\n{body}", None
    except Exception as e:  # one bad file must not end the batch
        return None, f"{type(e).__name__}: {e}"[:220]


def convert_folder(spark: SparkSession, folder: str, largest_mb: int = 250) -> DataFrame:
    """(relative, body, status, error) of every supported file, converted to Markdown where it was read.

    A file that can't be converted or is larger than the limit gives
    ``failed`` and why; it doesn't end the others. Empty files give no row:
    Spark doesn't read them.
    """
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    base = re.sub(r"^file:/*", "/", folder.rstrip("/")) + "/"
    f = f.withColumn("relative", F.replace(F.regexp_replace("path", r"^file:/*", "/"), F.lit(base), F.lit(""))).filter(F.lower(F.regexp_extract("relative", r"\.([^./]+)$", 1)).isin(*SUFFIXES))
    f = f.select("relative", F.when(F.col("length") <= largest_mb * 1_000_000, F.col("content")).alias("content"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [_convert(r, bytes(c)) if c is not None else (None, "file is larger than the limit") for r, c in zip(b["relative"], b["content"], strict=True)]
            yield pd.DataFrame({"relative": b["relative"], "body": [x for x, _ in rows], "status": ["failed" if e else "converted" for _, e in rows], "error": [e for _, e in rows]})

    return f.mapInPandas(run, "relative string, body string, status string, error string")


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, expected_terms, expected_files, mode, limit) of a JSON file of retrieval questions."""
    one = "struct<id:string,question:string,expected_terms:array<string>,expected_files:array<string>,mode:string,`limit`:int>"
    raw = spark.read.text(path, wholetext=True)
    q = F.coalesce(F.from_json("value", f"struct<questions:array<{one}>>")["questions"], F.from_json("value", f"array<{one}>"))
    return raw.select(F.posexplode(q).alias("k", "q")).select(F.coalesce("q.id", F.concat(F.lit("q"), F.col("k") + 1)).alias("id"), "q.question", F.coalesce("q.expected_terms", F.array().cast("array<string>")).alias("expected_terms"), F.coalesce("q.expected_files", F.array().cast("array<string>")).alias("expected_files"), F.coalesce("q.mode", F.lit("hybrid")).alias("mode"), F.coalesce("q.limit", F.lit(8)).alias("limit"))
