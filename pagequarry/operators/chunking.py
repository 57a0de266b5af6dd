"""Cut documents into content-addressed sections.

The work is done inside the row: no shuffle, whatever the number or the size of the
documents.  Headings are marked by one regex replacement and the text is split at the
marks; offsets and heading paths come from one fold over the sections.  A short Arrow helper
then sizes the sections of each document.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry import fixed_values as fv
from pagequarry.functions import text as tx
from pagequarry.functions.text import RIGHT_EDGE, SPACE
from pagequarry.functions.unicode_forms import nfc_where_needed

# Fixed patterns: headings are recognised at line starts only ((?md): \n ends a line).
MARKDOWN_HEADING = rf"(?md)^(#{{1,6}})[{SPACE}]+(.+?)[{SPACE}]*$"
LEGAL_HEADING = rf"(?md)^(#{{1,4}})[{SPACE}]*§[{SPACE}]*(\p{{Nd}}+[a-z]?){RIGHT_EDGE}(.*)$"
BLANK_LINES = rf"\n[{SPACE}]*\n"

# A Unicode non-character, which no text interchange may contain.
_MARK = "\ufdd0"

_SECTION = "struct<text:string,start:int,anchor:string,path:array<string>>"


def is_legal(text: Column) -> Column:
    return F.regexp_count(text, F.lit(LEGAL_HEADING)) >= fv.LEGAL_HEADINGS_NEEDED


def _markdown_pieces(text: Column) -> Column:
    marked = F.regexp_replace(text, MARKDOWN_HEADING, _MARK + "$0")
    levels_2_to_4 = F.regexp_replace(marked, _MARK + "(?=#(?!#)|#{5})", "")
    return F.split(levels_2_to_4, _MARK, -1)


def _legal_pieces(text: Column) -> Column:
    return F.split(F.regexp_replace(text, LEGAL_HEADING, _MARK + "$0"), _MARK, -1)


def _sections(pieces: Column, legal: bool) -> Column:
    """Fold over the split text: running offset, the open level 2 and 3 titles, rows so far."""
    state = "struct<at:int,two:string,three:string,rows:array<" + _SECTION + ">>"
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("string").alias("two"),
                     F.lit(None).cast("string").alias("three"),
                     F.array().cast(f"array<{_SECTION}>").alias("rows")).cast(state)

    def one_row(piece: Column, at: Column, anchor: Column, path: Column) -> Column:
        return F.array(F.struct(piece.alias("text"), at.alias("start"), anchor.alias("anchor"),
                                path.alias("path")))

    def step(acc: Column, piece: Column) -> Column:
        at, two, three = acc["at"], acc["two"], acc["three"]
        if legal:
            number = F.regexp_extract(piece, LEGAL_HEADING, 2)
            title = tx.strip(F.regexp_extract(piece, LEGAL_HEADING, 3))
            anchor = F.concat(F.lit("§ "), number)
            path = F.array(F.when(title != "", F.concat(anchor, F.lit(" "), title)).otherwise(anchor))
            two_next, three_next = two, three
        else:
            level = F.length(F.regexp_extract(piece, r"\A(#+)", 1))
            title = tx.strip(F.regexp_extract(piece, MARKDOWN_HEADING, 2))
            anchor = title
            path = F.filter(F.array(F.when(level > 2, two), F.when(level > 3, three), title),
                            lambda t: t.isNotNull())
            two_next = F.when(level == 2, title).otherwise(two)
            three_next = F.when(level == 3, title).when(level > 3, three)
        rows = F.concat(acc["rows"], one_row(piece, at, anchor, path))
        return F.struct((at + F.length(piece)).alias("at"), two_next.alias("two"),
                        three_next.alias("three"), rows.alias("rows")).cast(state)

    lead = F.get(pieces, F.lit(0))
    begin = start.withField("at", F.length(lead)).cast(state)
    headed = F.aggregate(F.slice(pieces, F.lit(2), F.size(pieces)), begin, step)["rows"]
    no_path = F.array().cast("array<string>")
    plain = one_row(lead, F.lit(0), F.lit(""), no_path)
    preamble = F.when(F.length(tx.strip(lead)) >= fv.MIN_CHUNK_CHARS,
                      one_row(lead, F.lit(0), F.lit("Präambel" if legal else "Preamble"), no_path)) \
        .otherwise(F.array().cast(f"array<{_SECTION}>"))
    return F.when(F.size(pieces) == 1, plain.cast(f"array<{_SECTION}>")) \
        .otherwise(F.concat(preamble.cast(f"array<{_SECTION}>"), headed))


# --- packing of long sections ---------------------------------------------------------

def pack_paragraphs(section: str) -> list[dict]:
    """Windows of whole paragraphs of at most 4,000 characters.

    A window after the first starts with the fewest closing paragraphs of the window
    before that reach 300 characters.  Sizes count two characters per paragraph gap.
    """
    paragraphs = re.split(r"\n\s*\n", section)
    ends = np.cumsum([len(p) + 2 for p in paragraphs])
    begins = ends - np.array([len(p) + 2 for p in paragraphs])
    out, first, fresh, offset = [], 0, 0, 0
    while True:
        # the window always takes `fresh`; it then grows while it fits
        fits = int(np.searchsorted(ends, begins[first] + fv.MAX_CHUNK_CHARS, side="right"))
        stop = max(fits, fresh + 1)
        out.append({"text": "\n\n".join(paragraphs[first:stop]), "offset": int(offset)})
        if stop >= len(paragraphs):
            return out
        # latest start whose tail still covers the overlap
        tail = int(np.searchsorted(begins[:stop], ends[stop - 1] - fv.OVERLAP_CHARS, side="right")) - 1
        tail = max(tail, first)
        offset += (ends[stop - 1] - begins[first] - 2) - (ends[stop - 1] - begins[tail])
        first, fresh = tail, stop


def _part_name(anchor: str, n: int, n_parts: int) -> str:
    if n_parts == 1 or (not anchor and n == n_parts - 1):
        return anchor
    return f"{anchor} (Teil {n + 1})" if anchor else f"part {n + 1}"


def size_sections(sections: list) -> list[dict]:
    """Chunks of one document: long sections in parts, short pieces joined to the one before."""
    chunks: list[dict] = []
    for section in sections:
        whole = section["text"]
        parts = pack_paragraphs(whole) if len(whole) > fv.MAX_CHUNK_CHARS else [{"text": whole, "offset": 0}]
        for n, part in enumerate(parts):
            text, start = part["text"].strip(), section["start"] + part["offset"]
            if chunks and len(text) < fv.MIN_CHUNK_CHARS:
                chunks[-1]["text"] += "\n\n" + text
                chunks[-1]["char_end"] = start + len(text)
            else:
                chunks.append({"anchor": _part_name(section["anchor"], n, len(parts)), "char_start": start,
                               "heading_path": list(section["path"]), "char_end": start + len(text), "text": text})
    return chunks


_CHUNK = T.StructType([
    T.StructField("anchor", T.StringType()), T.StructField("heading_path", T.ArrayType(T.StringType())),
    T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()),
    T.StructField("text", T.StringType())])


@F.pandas_udf(T.ArrayType(_CHUNK))
def _sized(sections: pd.Series) -> pd.Series:
    return sections.map(lambda row: None if row is None else size_sections(row))


def section_rows(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` plus the array column ``sections`` (blank texts give no sections).

    Each array is a column of its own before a lambda looks into it, so that no lambda
    computes it again for every element.
    """
    body, pieces = F.col(text), F.col("_pieces")
    return (docs.where(~tx.is_blank(body))
            .withColumn("_legal", is_legal(body))
            .withColumn("_pieces", F.when(F.col("_legal"), _legal_pieces(body)).otherwise(_markdown_pieces(body)))
            .withColumn("sections", F.when(F.col("_legal"), _sections(pieces, legal=True))
                        .otherwise(_sections(pieces, legal=False)))
            .drop("_legal", "_pieces"))


def split_documents(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per chunk: the kept columns, ``seq`` and the chunk columns."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    cut = (section_rows(docs.select(*keep, F.col(text).alias("_doc")), "_doc")
           .withColumn("lang", tx.chunk_language(F.col("_doc"))).drop("_doc")
           .withColumn("_chunks", _sized("sections")).drop("sections"))
    # outer: of a plain explode Spark infers "not empty" and computes all sections once more to filter by it
    rows = (cut.select(*keep, "lang", F.posexplode_outer("_chunks").alias("seq", "_c")).where(F.col("seq").isNotNull())
            .select(*keep, "lang", "seq", "_c.*"))
    return (rows.withColumn("_nfc", nfc_where_needed(F.col("text")))
            .select(*keep, "seq", tx.content_key(F.col("text"), F.col("_nfc")).alias("chunk_id"), "anchor",
                    "heading_path", "char_start", "char_end", "text", "lang"))


def page_chunks(pages: DataFrame) -> DataFrame:
    """Searchable chunks of pages: title and file stem lead the text, system pages give none."""
    name = F.element_at(F.split("filename", "/"), -1)
    indexable = tx.strip(F.concat(F.coalesce(F.col("title"), tx.file_stem(name)), F.lit(" "),
                                  tx.file_stem(name), F.lit("\n\n"), F.coalesce(F.col("body"), F.lit(""))))
    docs = (pages.where(~name.isin(*fv.SYSTEM_PAGES))
            .select("db", name.alias("source"), indexable.alias("text")))
    return (split_documents(docs).withColumn("scope", F.lit("wiki"))
            .withColumn("chunk_id", F.concat(F.lit("wiki:"), "source", F.lit(":"), "chunk_id")))


def first_per_chunk(chunks: DataFrame, order: list[str], keys: tuple[str, ...] = ("db", "chunk_id")) -> DataFrame:
    """Keep the first row of every chunk id.

    A minimum over a struct is pre-aggregated on the map side, so a text copied a
    billion times reaches the shuffle once per task, not once per copy.
    """
    rest = [c for c in chunks.columns if c not in keys and c not in order]
    picked = F.min(F.struct(*order, *rest)).alias("_row") if not _has_map(chunks, rest) else \
        F.min_by(F.struct(*order, *rest), F.struct(*order)).alias("_row")
    return chunks.groupBy(*keys).agg(picked).select(*keys, "_row.*").select(*chunks.columns)


def _has_map(df: DataFrame, columns: list[str]) -> bool:
    return any("map<" in df.schema[c].dataType.simpleString() for c in columns)


# --- pieces for page synthesis ----------------------------------------------------------

def cut_points(text: str, size: int = fv.PIECE_CHARS) -> list[str]:
    """Pieces of at most ``size`` characters, cut after the last blank line that fits."""
    breaks = np.array([m.start() + 2 for m in re.finditer(r"(?=\n\n)", text)], dtype=np.int64)
    pieces, at = [], 0
    while at < len(text):
        stop = min(at + size, len(text))
        if stop < len(text) and len(breaks):
            usable = int(np.searchsorted(breaks, stop, side="right")) - 1
            if usable >= 0 and breaks[usable] > at + 2:
                stop = int(breaks[usable])
        pieces.append(text[at:stop])
        at = stop
    return pieces


@F.pandas_udf(T.ArrayType(T.StringType()))
def _long_pieces(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else cut_points(t))


def synthesis_pieces(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` by piece of at most 40,000 characters: ``piece``, ``n_pieces``, ``piece_text``."""
    cut = docs.withColumn("_long", _long_pieces(F.when(F.length(text) > fv.PIECE_CHARS, F.col(text))))
    parts = F.coalesce(F.col("_long"), F.array(F.col(text)))
    return (cut.withColumn("_parts", parts).drop(text, "_long")
            .select("*", F.size("_parts").alias("n_pieces"), F.posexplode("_parts").alias("piece", "piece_text"))
            .drop("_parts"))
