import zipfile

import pytest

from vellichor.operators.retrieval import ChunkIndex, search
from vellichor.sources import files
from vellichor.sources.tables import read_index, write_index
from vellichor.streaming import incremental


def office(path, parts):
    with zipfile.ZipFile(path, "w") as z:
        for name, data in parts.items():
            z.writestr(name, data)


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
A = 'xmlns:a="http://schemas.openxmlformats.org/drawingml/2006/main" xmlns:p="http://schemas.openxmlformats.org/presentationml/2006/main"'
DOC = f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
SLIDE = f'<p:sld {A}><p:sp><p:nvSpPr><p:cNvPr name="Title 1"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>Deck</a:t></a:r></a:p></p:txBody></p:sp><p:sp><p:nvSpPr><p:cNvPr name="Body"/></p:nvSpPr><p:txBody><a:p><a:r><a:t>Point</a:t></a:r></a:p></p:txBody></p:sp></p:sld>'


def test_html():
    page = "<html><head><script>x</script></head><nav><p>no</p></nav><h1>A  b</h1><p>One <b>two</b><p>three<ul><li>i</li></ul><pre>c\n d</pre><footer><p>no</p></footer>"
    assert files.html_to_markdown(page) == "# A b\nOne two\nthree\n- i\n```\nc\n d\n```"
    assert files.html_to_markdown("") == "" and files.html_to_markdown(None) is None


def test_convert_folder(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "sub/a.md").write_text("# x")
    (tmp_path / "b.csv").write_text("h,i\n1,2\n")
    (tmp_path / "c.html").write_text("<h2>t</h2>")
    (tmp_path / "empty.txt").write_text("")
    (tmp_path / "bad.docx").write_text("no zip")
    office(tmp_path / "d.docx", {"word/document.xml": DOC})
    office(tmp_path / "e.pptx", {"ppt/slides/slide1.xml": SLIDE})
    got = {r.relative: r for r in files.convert_folder(spark, str(tmp_path)).collect()}
    assert got["a.txt"].body == "# a\n\nhello" and got["c.html"].body == "## t" and "| h | i |" in got["b.csv"].body
    assert "# Head\n\nText\n\n| a |" in got["d.docx"].body and "## Deck\n\n- Point" in got["e.pptx"].body
    assert "empty.txt" not in got and got["bad.docx"].status == "failed" and got["sub/a.md"].status == "converted"
    listed = files.list_files(spark, str(tmp_path))
    target = {r.relative: r.target for r in files.batch_targets(listed).collect()}
    assert target["a.txt"] == "a.md" and target["sub/a.md"] == "sub/a.md" and listed.count() == 7


def test_markdown_folder_guards(spark, tmp_path):
    (tmp_path / "x.txt").write_text("no")
    with pytest.raises(ValueError):
        files.read_markdown(spark, str(tmp_path))
    for k in range(3):
        (tmp_path / f"{k}.md").write_text("# t")
    assert files.read_markdown(spark, str(tmp_path)).count() == 3
    with pytest.raises(ValueError):
        files.read_markdown(spark, str(tmp_path), 2)


def test_questions(spark, tmp_path):
    (tmp_path / "q.json").write_text('{"questions": [{"question": "What?", "expected_terms": ["a"]}, {"id": "z", "question": "Why?", "mode": "lexical", "limit": 3}]}')
    a, b = files.read_questions(spark, str(tmp_path / "q.json")).collect()
    assert (a.id, a.mode, a.limit, a.expected_files) == ("q1", "hybrid", 8, []) and (b.id, b.limit) == ("z", 3)


def test_index_round_trip(spark, tmp_path):
    c = spark.createDataFrame([(1, "c1", "d1", "p.md", "H", 1, "spider silk", 2, ["silk"], [], [], [], [], ["text"])], "seq long, id string, doc_id string, path string, heading string, ordinal int, text string, tokens int, terms array<string>, citations array<string>, links array<string>, figures array<string>, table_records array<string>, modalities array<string>")
    d = spark.createDataFrame([("d1", "p.md", "T")], "doc_id string, path string, title string")
    write_index(ChunkIndex.build(d, c), str(tmp_path / "ix"))
    ix = read_index(spark, str(tmp_path / "ix"))
    q = spark.createDataFrame([("q", "silk")], "qid string, query string")
    assert search(ix, q).first().chunk_id == "c1"
    with pytest.raises(ValueError):
        search(ix, q, "other")


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.md").write_text("# One\n\nSpider silk.\n\n## \n")
    q = incremental.index_batches(incremental.markdown_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 1
    (src / "b.md").write_text("# Two\n\nMore silk.")
    incremental.index_batches(incremental.markdown_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/chunks")).count() == 2
    w = incremental.findings_per_window(incremental.markdown_stream(spark, str(src)))
    s = w.writeStream.format("memory").queryName("found").outputMode("complete").trigger(availableNow=True).start()
    s.awaitTermination(120)
    assert [(r.rule, r.n) for r in spark.table("found").collect()] == [("empty_heading", 1)]
