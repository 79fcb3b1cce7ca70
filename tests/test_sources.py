import io
import zipfile

import pytest

from quire.sources import files as S
from quire.streaming.pending import follow


def archive(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


EPUB = {
    "mimetype": "application/epub+zip",
    "META-INF/container.xml": '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/p.opf"/></rootfiles></container>',
    "OEBPS/p.opf": '<package xmlns="http://www.idpf.org/2007/opf"><manifest><item id="nav" href="nav.xhtml" media-type="application/xhtml+xml" properties="nav"/><item id="c2" href="t/c2.xhtml" media-type="application/xhtml+xml"/><item id="c1" href="c1.xhtml" media-type="application/xhtml+xml"/><item id="css" href="a.css" media-type="text/css"/></manifest><spine><itemref idref="c1"/><itemref idref="c2"/></spine></package>',
    "OEBPS/c1.xhtml": "<html><body><p>One</p></body></html>",
    "OEBPS/t/c2.xhtml": "<html><body><p>Two</p></body></html>",
    "OEBPS/nav.xhtml": "<html><body><nav><a>Nav</a></nav></body></html>",
}
W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
DOCX = {
    "word/document.xml": f'<w:document {W}><w:body><w:p><w:pPr><w:pStyle w:val="H1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c1</w:t></w:r></w:p></w:tc><w:tc><w:p/></w:tc></w:tr></w:tbl></w:body></w:document>',
    "word/styles.xml": f'<w:styles {W}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>',
}


def test_zip_formats(spark, tmp_path):
    (tmp_path / "b.epub").write_bytes(archive(EPUB))
    (tmp_path / "d.docx").write_bytes(archive(DOCX))
    books = S.read_books(spark, str(tmp_path / "b.epub")).orderBy("place").collect()
    assert [(r.name, r.is_nav) for r in books] == [("OEBPS/c1.xhtml", False), ("OEBPS/t/c2.xhtml", False), ("OEBPS/nav.xhtml", True)]
    rows = S.read_docx(spark, str(tmp_path / "d.docx")).collect()
    assert [(r.part, r.text, r.style, r.cells) for r in rows] == [("paragraph", "Head", "Heading 1", None), ("paragraph", "a\tb", "Normal", None), ("table", None, None, ["c1", ""])]


def test_text_formats(spark, tmp_path):
    (tmp_path / "a.srt").write_bytes("\ufeffsub".encode())
    (tmp_path / "b.html").write_bytes("<p>中文</p>".encode("gbk"))
    assert [r.text for r in S.read_texts(spark, str(tmp_path / "a.srt")).collect()] == ["sub"]
    assert [r.text for r in S.read_pages(spark, str(tmp_path / "b.html")).collect()] == ["<p>中文</p>"]
    assert [r.name for r in S.listing(spark, str(tmp_path)).collect()] == ["a.srt", "b.html"]


def test_formats(spark):
    rows = spark.createDataFrame([("x/A.MD",), ("b.htm",), ("c.tar.pdf",)], "p string")
    assert [r[0] for r in rows.select(S.format_of(rows.p)).collect()] == ["markdown", "html", "pdf"]
    with pytest.raises(Exception, match="unsupported format"):
        spark.createDataFrame([("x.zip",)], "p string").select(S.format_of(rows.p)).collect()


def test_glossaries(spark, tmp_path):
    (tmp_path / "g.csv").write_text("source_term,target_term,case_sensitive,priority\nAgent,Wirkender,false,5\nTool,Zeug,,x\n,,,\n")
    (tmp_path / "g.json").write_text('{"terms": [{"source_term": "A", "target_term": "B", "locked": "true"}]}')
    (tmp_path / "l.json").write_text('[{"source_term": "A", "target_term": "B", "priority": "7"}]')
    got = [tuple(r) for r in S.read_glossary(spark, str(tmp_path / "g.csv")).orderBy("source_term").collect()]
    assert got == [("Agent", "Wirkender", False, "exact", 5, False, None), ("Tool", "Zeug", True, "exact", 100, False, None)]
    assert [r.locked for r in S.read_glossary(spark, str(tmp_path / "g.json")).collect()] == [True]
    assert [r.priority for r in S.read_glossary(spark, str(tmp_path / "l.json")).collect()] == [7]


def test_settings_and_archives():
    assert S.env_settings("# no\nA=1\nB = 'x y' \nbad\n=z\nC=\"q\"\n") == {"A": "1", "B": "x y", "C": "q"}
    with zipfile.ZipFile(io.BytesIO(S.zipped([("a", b"1"), ("mimetype", b"m")]))) as z:
        assert z.namelist() == ["mimetype", "a"] and z.getinfo("mimetype").compress_type == zipfile.ZIP_STORED


def test_written_texts(spark, tmp_path):
    rows = spark.createDataFrame([("d1", "a\n\nb"), ("d2", "")], "name string, content string")
    S.write_texts(rows, str(tmp_path / "out"), "name", "content")
    assert "".join(p.read_text() for p in (tmp_path / "out" / "name=d1").glob("part-*")) == "a\n\nb\n"
    S.snapshot(rows, str(tmp_path / "snap"))
    assert spark.read.parquet(str(tmp_path / "snap")).count() == 2


def test_stream_of_pending_chunks(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "done")
    make = lambda rows: spark.createDataFrame(rows, "id long, status string, text string").coalesce(1).write.mode("append").parquet(source)
    run = lambda: follow(spark, source, "id long, status string, text string", target, str(tmp_path / "cp"), lambda df: df.selectExpr("id", "'DONE' AS status", "upper(text) AS text")).awaitTermination()
    make([(1, "PENDING", "a"), (2, "DONE", "b")])
    run()
    make([(3, "PENDING", "c")])
    run()
    assert sorted((r.id, r.text) for r in spark.read.parquet(target).collect()) == [(1, "A"), (3, "C")]
