"""Files written from the documents come back: text, HTML and Word, whatever the language of the styles."""

import io
import zipfile
from xml.sax.saxutils import escape

from pyspark.sql import functions as F

from pagequarry.sources import files

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
STYLES = {"berschrift1": "heading 1", "Titre2": "heading 2", "Rubrik3": "heading 3", "Aufzhlungszeichen": "List Bullet", "Listennummer": "List Number", "a": "Normal"}


def run(text):
    parts = []
    for i, line in enumerate(text.split("\n")):
        parts.append("<w:br/>" * (i > 0) + "<w:tab/>".join(f'<w:t xml:space="preserve">{escape(p)}</w:t>' for p in line.split("\t")))
    return f"<w:r>{''.join(parts)}</w:r>"


def paragraph(text, style=None):
    return f"<w:p>{f'<w:pPr><w:pStyle w:val=\"{style}\"/></w:pPr>' if style else ''}{text if text.startswith('<w:') else run(text)}</w:p>"


def word_file(body, styles=True):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}<w:sectPr/></w:body></w:document>")
        if styles:
            archive.writestr("word/styles.xml", f"<w:styles {NS}>" + "".join(
                f'<w:style w:type="paragraph" w:styleId="{k}"><w:name w:val="{v}"/></w:style>' for k, v in STYLES.items()) + "</w:styles>")
    return out.getvalue()


def cell(text, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{''.join(paragraph(t) for t in text.split('|'))}</w:tc>"


def test_word_structure():
    link = '<w:hyperlink><w:r><w:t>linked</w:t></w:r></w:hyperlink><w:r><w:noBreakHyphen/><w:br w:type="page"/><w:t>end</w:t></w:r>'
    table = ("<w:tbl><w:tr>" + cell("a|b") + cell("wide", '<w:gridSpan w:val="2"/>') + "</w:tr><w:tr>" + cell("tall", '<w:vMerge w:val="restart"/>') + cell("x") + cell("y")
             + "</w:tr><w:tr>" + cell("", "<w:vMerge/>") + cell("z") + cell("") + "</w:tr></w:tbl>")
    body = (paragraph("Überblick", "berschrift1") + paragraph(" Zweite ", "Titre2") + paragraph("Dritte", "Rubrik3") + paragraph("  ", "a") + paragraph("one\ttab\nbreak", "a")
            + paragraph("item", "Aufzhlungszeichen") + paragraph("first", "Listennummer") + table + paragraph(link))
    content = word_file(body)
    assert files.word_markdown(content) == ("# Überblick\n\n## Zweite\n\n### Dritte\n\none\ttab\nbreak\n\n- item\n\n1. first\n\n"
                                            "| a\nb | wide | wide |\n| --- | --- | --- |\n| tall | x | y |\n| tall | z |  |\n\nlinked-end")
    assert files.word_plain(content) == "Überblick\n Zweite \nDritte\n  \none\ttab\nbreak\nitem\nfirst\nlinked-end"
    assert files.word_markdown(word_file(paragraph("H", "Heading 1") + paragraph("t"), styles=False)) == "# H\n\nt"


def test_documents_come_back_from_files(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(60).collect()
    for r in docs:
        kind = ("txt", "docx", "html", "md", "bin")[r.doc_id % 5]
        clean = "".join(c for c in r.text if c in "\n\t" or c >= " ")
        content = {"docx": lambda: word_file("".join(paragraph(p) for p in clean.split("\n\n"))),
                   "html": lambda: f"<html><body><p>{escape(clean)}</p></body></html>".encode()}.get(kind, lambda: clean.encode())()
        (tmp_path / f"doc-{r.doc_id}.{kind}").write_bytes(content)
    (tmp_path / "broken.docx").write_bytes(b"PK no archive")
    (tmp_path / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    read = files.extract_text(files.read_files(spark, str(tmp_path), "db"))
    got = {r.source: (r.text, r.error) for r in read.select("source", "text", "error").collect()}
    for r in docs:
        kind = ("txt", "docx", "html", "md", "bin")[r.doc_id % 5]
        clean = "".join(c for c in r.text if c in "\n\t" or c >= " ")
        text, error = got[f"doc-{r.doc_id}.{kind}"]
        assert (text is None and "Unsupported" in error) if kind == "bin" else (text.replace("\n\n", "\n") if kind == "docx" else text) == (
            clean.replace("\n\n", "\n") if kind == "docx" else clean), (kind, r.doc_id)
    assert got["broken.docx"][0] is None and got["broken.docx"][1] and got["latin.txt"] == ("caf�", None)
    assert read.where(F.col("sha256") != F.sha2("content", 256)).count() == 0
