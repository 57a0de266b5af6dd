"""Source files to text: plain text, HTML, Word and, where libraries allow, PDF and images.

Files are read as rows of (path, content) by Spark's ``binaryFile`` source; each format is
a small Arrow helper over the bytes.  A file of an unknown format becomes an error row.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry import fixed_values as fv
from pagequarry.functions import text as tx

TEXT_SUFFIXES = (".md", ".txt")
HTML_SUFFIXES = (".html", ".htm")
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".tiff", ".tif", ".bmp")
CONVERTED_SUFFIXES = (".pdf", ".docx", *IMAGE_SUFFIXES)
PDF_TEXT_CHARS = 40      # a page with less text is treated as an image


def read_files(spark: SparkSession, folder: str, db: str) -> DataFrame:
    """db, source, content, sha256 of every file below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(F.lit(db).alias("db"), F.element_at(F.split("path", "/"), -1).alias("source"),
                        "content", F.sha2("content", 256).alias("sha256"))


def is_convertible(name: Column) -> Column:
    return tx.file_suffix(name).isin(*CONVERTED_SUFFIXES)


# --- HTML ----------------------------------------------------------------------------

@F.pandas_udf(T.StringType())
def html_text(pages: pd.Series) -> pd.Series:
    """Every text node joined by blanks; the text of scripts and styles stays."""
    def text_of(page):
        if page is None:
            return None
        nodes: list[str] = []
        parser = HTMLParser()
        parser.handle_data = nodes.append
        parser.feed(page)
        return " ".join(nodes)
    return pages.map(text_of)


class _Outline(HTMLParser):
    """Headings, paragraphs, list items and links as Markdown."""

    OPENING = {"h1": "\n\n# ", "h2": "\n\n## ", "h3": "\n\n### ", "h4": "\n\n#### ", "h5": "\n\n##### ",
               "h6": "\n\n###### ", "li": "\n* ", "p": "\n\n", "br": "\n", "div": "\n\n", "tr": "\n"}

    def __init__(self):
        super().__init__()
        self.out: list[str] = []
        self.link: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        self.silent += tag in ("script", "style")
        self.out.append(self.OPENING.get(tag, ""))
        if tag == "a":
            self.link.append(dict(attrs).get("href") or "")
            self.out.append("[")

    def handle_endtag(self, tag):
        self.silent -= tag in ("script", "style") and self.silent > 0
        if tag == "a" and self.link:
            self.out.append(f"]({self.link.pop()})")

    def handle_data(self, data):
        if not self.silent:
            self.out.append(" ".join(data.split()) if data.strip() else "")


@F.pandas_udf(T.StringType())
def html_markdown(pages: pd.Series) -> pd.Series:
    def convert(page):
        if page is None:
            return None
        outline = _Outline()
        outline.feed(page)
        return "".join(outline.out).strip()
    return pages.map(convert)


def web_pages(pages: DataFrame) -> DataFrame:
    """url and Markdown of fetched pages (url, html), cut at 4,000 characters as read by the tools."""
    full = pages.select("url", html_markdown("html").alias("_m"))
    cut = F.concat(F.left("_m", F.lit(fv.WEB_PAGE_CHARS)), F.lit("\n...[truncated]"))
    return full.select("url", F.when(F.length("_m") > fv.WEB_PAGE_CHARS, cut).otherwise(F.col("_m")).alias("markdown"))


# --- Word -----------------------------------------------------------------------------

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
_WORD_PREFIX = (("heading 1", "# "), ("heading 2", "## "), ("heading 3", "### "))
_INLINE = {f"{_W}tab": "\t", f"{_W}cr": "\n", f"{_W}noBreakHyphen": "-"}


class WordFile:
    """The body of a Word file and the names of its styles; style ids depend on the language of the program, names do not."""

    def __init__(self, content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            self.body = ElementTree.fromstring(archive.read("word/document.xml")).find(f"{_W}body")
            styles = ElementTree.fromstring(archive.read("word/styles.xml")) if "word/styles.xml" in archive.namelist() else ()
        self.names = {s.get(f"{_W}styleId"): n.get(f"{_W}val", "") for s in styles for n in s.findall(f"{_W}name")}

    def prefix(self, paragraph) -> str:
        style = paragraph.find(f"{_W}pPr/{_W}pStyle")
        key = "" if style is None else style.get(f"{_W}val", "")
        name = self.names.get(key, key)
        return next((p for head, p in _WORD_PREFIX if name.lower().startswith(head)),
                    "- " if "Bullet" in name else "1. " if "Number" in name else "")


def _run_text(run) -> str:
    """Text, tabs and line breaks of a run; page and column breaks are no text."""
    def one(node) -> str:
        if node.tag == f"{_W}t":
            return node.text or ""
        if node.tag == f"{_W}br":
            return "\n" if node.get(f"{_W}type", "textWrapping") == "textWrapping" else ""
        return _INLINE.get(node.tag, "")
    return "".join(one(node) for node in run)


def _paragraph_text(paragraph) -> str:
    """Runs of a paragraph, also those inside links."""
    return "".join(_run_text(run) for child in paragraph for run in (
        [child] if child.tag == f"{_W}r" else child.findall(f"{_W}r") if child.tag == f"{_W}hyperlink" else []))


def _table_rows(table) -> list[list[str]]:
    """Cell texts by row; a merged cell is repeated in every column and row it spans."""
    rows: list[list[str]] = []
    for tr in table.findall(f"{_W}tr"):
        row: list[str] = []
        for tc in tr.findall(f"{_W}tc"):
            span, merge = tc.find(f"{_W}tcPr/{_W}gridSpan"), tc.find(f"{_W}tcPr/{_W}vMerge")
            text = "\n".join(_paragraph_text(p) for p in tc.findall(f"{_W}p")).strip()
            if merge is not None and merge.get(f"{_W}val", "continue") == "continue" and rows and len(row) < len(rows[-1]):
                text = rows[-1][len(row)]
            row += [text] * (1 if span is None else int(span.get(f"{_W}val", "1")))
        rows.append(row)
    return rows


def _table_lines(table) -> list[str]:
    rows = _table_rows(table)
    if rows:
        rows.insert(1, ["---"] * len(rows[0]))
    return ["| " + " | ".join(r) + " |" for r in rows]


def word_markdown(content: bytes) -> str:
    """Headings 1 to 3, bullets, numbers and tables of a Word file in document order."""
    word = WordFile(content)
    blocks = []
    for child in word.body:
        if child.tag == f"{_W}p":
            text = _paragraph_text(child).strip()
            blocks.append(word.prefix(child) + text if text else "")
        elif child.tag == f"{_W}tbl":
            blocks.append("\n".join(_table_lines(child)))
    return "\n\n".join(b for b in blocks if b)


def word_plain(content: bytes) -> str:
    """Paragraph texts only, one per line."""
    return "\n".join(_paragraph_text(p) for p in WordFile(content).body.findall(f"{_W}p"))


# --- PDF and images --------------------------------------------------------------------

def pdf_pages(content: bytes) -> list[str]:
    """Page texts; needs the optional ``pypdf`` package."""
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise RuntimeError("reading PDF needs the optional package pypdf") from error
    return [page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages]


def page_by_page(content: bytes, rewrite: Callable[[str], str], ocr: Callable[[bytes, int], str]) -> str:
    """Text pages go to the rewriting model, pages with nearly no text to the image model."""
    texts = pdf_pages(content)
    return "\n\n".join(rewrite(t.strip()) if len(t.strip()) >= PDF_TEXT_CHARS else ocr(content, i)
                       for i, t in enumerate(texts))


_EXTRACTED = T.StructType([T.StructField("text", T.StringType()), T.StructField("error", T.StringType())])


def extract_text(files: DataFrame, markdown: bool = False, rewrite: Callable[[str], str] = str,
                 ocr: Callable[[bytes, int], str] | None = None) -> DataFrame:
    """Files with ``text`` and ``error``; undecodable bytes become replacement characters.

    ``markdown`` keeps the structure of Word files and sends PDF pages and images through
    the given models; without it the plain text is taken.
    """
    def no_model(content: bytes, page: int) -> str:
        raise RuntimeError("no image model given")

    read_image = ocr or no_model

    @F.pandas_udf(_EXTRACTED)
    def convert(contents: pd.Series, suffixes: pd.Series) -> pd.DataFrame:
        rows = []
        for content, suffix in zip(contents, suffixes, strict=True):
            try:
                if suffix == ".docx":
                    rows.append((word_markdown(content) if markdown else word_plain(content), None))
                elif suffix == ".pdf":
                    rows.append((page_by_page(content, rewrite, read_image) if markdown
                                 else "\n".join(pdf_pages(content)), None))
                elif suffix in IMAGE_SUFFIXES and markdown:
                    rows.append((read_image(content, 0), None))
                elif suffix in TEXT_SUFFIXES + HTML_SUFFIXES:
                    rows.append((content.decode("utf-8", errors="replace"), None))
                else:
                    rows.append((None, f"Unsupported file type: {suffix}"))
            except Exception as error:  # one broken file must not fail the batch
                rows.append((None, str(error)))
        return pd.DataFrame(rows, columns=["text", "error"])

    suffix = tx.file_suffix(F.col("source"))
    read = files.withColumn("_x", convert("content", suffix)).select("*", "_x.text", "_x.error").drop("_x")
    stripped = html_text(F.when(suffix.isin(*HTML_SUFFIXES), F.col("text")))
    return read.withColumn("_html", stripped).withColumn("text", F.coalesce("_html", "text")).drop("_html")
