"""Page markup as column expressions: front matter, key facts, citations, sections, facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions import text as tx
from pagequarry.functions.text import SPACE, WORD, find_all, strip
from pagequarry.functions.words import key_terms, term_key

_MARK, _OTHER_MARK = "\ufdd0", "\ufdd1"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
KEY_FACTS = "## key facts"
H2 = rf"(?md)^##[{SPACE}]+(.+?)[{SPACE}]*$"
# What stands under a heading, without the white space around it, in one pass from the end.
_UNDER_H2 = rf"(?s)\A(?>(?md-s:{H2.removeprefix('(?md)^').replace('(.+?)', '.+?')}))?+[{SPACE}]*+(.*[^{SPACE}])"
ANY_HEADING = rf"\A#{{1,6}}[{SPACE}]"


def _strings() -> Column:
    return F.array().cast("array<string>")


def split_lines(text: Column) -> Column:
    """Lines without their ends; no empty line after a final line end."""
    return F.split(F.regexp_replace(text, rf"(?:{LINE_END})\z", ""), LINE_END, -1)


# --- front matter ----------------------------------------------------------------------

_HEADER = r"(?s)\A\s*---[ \t]*\n(.*?)\n---[ \t]*(?:\n|\z)"


def header(page: Column) -> Column:
    return F.regexp_extract(page, _HEADER, 1)


def body(page: Column) -> Column:
    return strip(F.regexp_replace(page, _HEADER, ""))


def _unquote(value: Column) -> Column:
    return F.regexp_replace(F.trim(value), r"""\A(["'])(.*)\1\z""", "$2")


def header_value(page: Column, key: str) -> Column:
    """Scalar value of one header key, NULL where absent or empty."""
    value = _unquote(F.regexp_extract(header(page), rf"(?m)^{key}:[ \t]*(.*)$", 1))
    return F.when(value != "", value)


def header_list(page: Column, key: str) -> Column:
    """List value of one header key: ``[a, b]``, ``- a`` lines, or a single scalar."""
    head = header(page)
    block = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*- .*(?:\n|\z))+)", 1)
    inline = F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\[(.*)\][ \t]*$", 1)
    scalar = header_value(page, key)
    dashed = F.transform(F.split(F.regexp_replace(block, r"\n\z", ""), "\n"),
                         lambda x: _unquote(F.regexp_replace(x, r"\A[ \t]*- ", "")))
    items = (F.when(block != "", dashed)
             .when(inline != "", F.transform(F.split(inline, ","), _unquote))
             .when(scalar.isNotNull() & (scalar != "[]"), F.array(scalar))
             .otherwise(_strings()))
    return F.filter(items, lambda x: x != "")


def header_extras(page: Column, known: list[str]) -> Column:
    """Scalar keys outside ``known``, as a map."""
    pairs = F.filter(F.transform(F.split(header(page), "\n"), lambda line: F.struct(
        F.regexp_extract(line, r"\A([^\s:#-][^:]*):", 1).alias("key"),
        _unquote(F.regexp_extract(line, r"\A[^:]+:[ \t]*(.*)\z", 1)).alias("value"))),
        lambda kv: (kv["key"] != "") & ~kv["key"].isin(known))
    return F.map_from_entries(pairs)


# --- key facts -------------------------------------------------------------------------

def key_fact_lines(page_body: Column, bullets: tuple[str, ...] = ("- ",)) -> Column:
    """Bullets under the first ``## Key facts`` heading, up to the next other ``## ``."""
    lines = F.transform(split_lines(page_body), strip)
    opens = F.transform(lines, lambda s: F.lower(s).startswith(KEY_FACTS))
    at = F.array_position(opens, True)
    after = F.slice(lines, at + 1, F.size(lines))
    ends = F.transform(after, lambda s: s.startswith("## ") & ~F.lower(s).startswith(KEY_FACTS))
    stop = F.array_position(ends, True)
    block = F.when(stop > 0, F.slice(after, 1, stop - 1)).otherwise(after)
    kept = F.filter(block, lambda s: F.left(s, F.lit(2)).isin(*bullets))
    return F.when(at > 0, F.transform(kept, lambda s: strip(F.substring(s, F.lit(3), F.length(s))))) \
        .otherwise(_strings())


def page_key_terms(title: Column, page_body: Column) -> Column:
    facts = F.array_join(key_fact_lines(page_body), "\n")
    return key_terms(F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), facts))


def readable_facts(title: Column, page_body: Column) -> Column:
    """Title and level 2 or 3 headings, at most five, for pages without key facts."""
    heads = F.filter(F.transform(split_lines(page_body), strip), lambda s: s.rlike(rf"\A#{{2,3}}[{SPACE}]"))
    names = F.transform(heads, lambda s: strip(F.regexp_replace(s, r"\A#+", "")))
    names = F.filter(names, lambda n: (n != "") & (F.lower(n) != "key facts"))
    lead = F.when(F.coalesce(title, F.lit("")) != "", F.array(title)).otherwise(_strings())
    return F.slice(F.array_distinct(F.concat(lead, names)), 1, fv.MAX_READABLE_FACTS)


def ensure_key_facts(title: Column, page_body: Column) -> Column:
    """Body that begins with key facts where it has none."""
    facts = readable_facts(title, page_body)
    block = F.concat(F.lit("## Key facts\n"), F.array_join(F.transform(facts, lambda f: F.concat(F.lit("- "), f)), "\n"),
                     F.lit("\n\n"), F.regexp_replace(page_body, rf"\A[{SPACE}]+", ""))
    return F.when((F.size(key_fact_lines(page_body)) > 0) | (F.size(facts) == 0), page_body).otherwise(block)


# --- derived header fields ----------------------------------------------------------------

def description(page_body: Column) -> Column:
    """First key fact, else first prose sentence; no inline citations; 160 characters at a word."""
    facts = key_fact_lines(page_body, ("- ", "* "))
    prose = F.filter(F.transform(split_lines(page_body), strip),
                     lambda s: (s != "") & ~s.rlike(r"\A[#\-*|>]"))
    sentence = F.get(F.split(F.get(prose, F.lit(0)), rf"(?<=[.!?])[{SPACE}]", 2), F.lit(0))
    raw = F.coalesce(F.get(facts, F.lit(0)), sentence, F.lit(""))
    clean = F.regexp_replace(tx.squeeze(F.regexp_replace(raw, r"\[[^\]]*\]", "")), r"\A[ .;,]+|[ .;,]+\z", "")
    cut = F.left(clean, F.lit(fv.DESCRIPTION_CHARS))
    at_word = F.regexp_replace(F.regexp_replace(cut, r"(?s) [^ ]*\z", ""), rf"[{SPACE}]+\z", "")
    return F.when(F.length(clean) > fv.DESCRIPTION_CHARS, F.concat(at_word, F.lit("…"))).otherwise(clean)


def page_type(stated: Column, filename: Column | None = None) -> Column:
    t = F.lower(F.trim(F.coalesce(stated, F.lit(""))))
    if filename is None:
        return F.when(t == "", "concept").otherwise(t)
    return F.when(t != "", t).when(filename.startswith("summary-"), "source-summary").otherwise("concept")


def tags(db: Column, kind: Column, part_of: Column) -> Column:
    raw = F.array(tx.slug(db), kind, F.coalesce(tx.slug(part_of), F.lit("")))
    return F.array_distinct(F.filter(raw, lambda t: t != ""))


def resource(kind: Column, sources: Column) -> Column:
    """Address of the asset behind a source summary or a report."""
    first = F.get(F.filter(F.transform(sources, strip), lambda s: s != ""), F.lit(0))
    return F.when(kind.isin("source-summary", "report"),
                  F.when(first.rlike(r"(?i)\Ahttps?://"), first).otherwise(F.concat(F.lit("raw/"), first)))


# --- citations -----------------------------------------------------------------------------

def citation_block(sources: Column) -> Column:
    items = F.filter(F.transform(sources, strip), lambda s: s != "")
    lines = F.transform(items, lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), s))
    return F.when(F.size(items) > 0, F.concat(F.lit("## Citations\n\n"), F.array_join(lines, "\n"), F.lit("\n"))) \
        .otherwise("")


def without_citations(page_body: Column) -> Column:
    """Body without its citation sections (each runs up to the next ``## `` line)."""
    lines = split_lines(page_body)
    is_cite = F.transform(lines, lambda s: F.lower(strip(s)) == "## citations")
    state = F.struct(F.lit(False).alias("skip"), _strings().alias("kept"))

    def step(acc: Column, row: Column) -> Column:
        skip = F.when(row["cite"], True).when(acc["skip"] & row["line"].startswith("## "), False).otherwise(acc["skip"])
        return F.struct(skip.alias("skip"), F.when(skip, acc["kept"]).otherwise(
            F.concat(acc["kept"], F.array(row["line"]))).alias("kept"))

    rows = F.zip_with(lines, is_cite, lambda a, b: F.struct(a.alias("line"), b.alias("cite")))
    kept = F.aggregate(rows, state, step)["kept"]
    text = F.when(F.exists(is_cite, lambda c: c), F.array_join(kept, "\n")).otherwise(F.array_join(lines, "\n"))
    return F.regexp_replace(text, rf"[{SPACE}]+\z", "")


def with_citations(page_body: Column, sources: Column) -> Column:
    """Body that ends with one numbered citation section; applying it twice changes nothing."""
    bare, block = without_citations(page_body), citation_block(sources)
    return F.when(block != "", F.concat(bare, F.lit("\n\n"), block)).otherwise(F.concat(bare, F.lit("\n")))


# --- sections --------------------------------------------------------------------------------

def collapse_sections(page_body: Column) -> Column:
    """struct(body, removed): of adjacent equal ``## `` sections the longest stays, ties the first."""
    def cut(pieces: Column) -> Column:
        return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), lambda s, i: F.struct(
            F.lower(strip(F.regexp_extract(s, H2, 1))).alias("name"),
            F.length(F.regexp_extract(s, _UNDER_H2, 1)).alias("size"),
            (-i).alias("minus_i"), s.alias("text")))

    def run_starts(sections: Column) -> Column:
        return F.filter(F.sequence(F.lit(0), F.size(sections) - 1), lambda i: (i == 0) | (
            F.get(sections, i)["name"] != F.get(sections, i - 1)["name"]))

    def best_of_run(run: Column) -> Column:
        return F.array_max(F.transform(run, lambda s: F.struct(s["size"], s["minus_i"], s["text"])))["text"]

    def collapsed(pieces: Column, sections: Column, starts: Column) -> Column:
        runs = F.transform(starts, lambda at, n: F.slice(
            sections, at + 1, F.coalesce(F.get(starts, n + 1), F.size(sections)) - at))
        kept = F.transform(runs, best_of_run)
        text = F.concat(F.get(pieces, F.lit(0)), F.array_join(kept, ""))
        enough = F.size(sections) >= 2
        return F.struct(F.when(enough, text).otherwise(page_body).alias("body"),
                        F.when(enough, F.size(sections) - F.size(starts)).otherwise(0).alias("removed"))

    marked = F.split(F.regexp_replace(page_body, H2, _MARK + "$0"), _MARK, -1)
    return tx.let(marked, lambda pieces: tx.let(cut(pieces), lambda sections: tx.let(
        run_starts(sections), lambda starts: collapsed(pieces, sections, starts))))


# --- part markers, model output ------------------------------------------------------------------

PART_SUFFIX = rf"[{SPACE}]*\[Teil[{SPACE}]+\d+/\d+\][{SPACE}]*(?:\.md)?[{SPACE}]*\z"
FILE_PART = r"-teil-\d+-\d+(?=\.md\z|\z)"


def clean_parts(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, rf"[{SPACE}]*\[Teil[{SPACE}]+\d+/\d+\]", ""), r"(\.md){2,}", ".md")


def clean_sources(sources: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(sources, lambda s: strip(F.regexp_replace(s, PART_SUFFIX, ""))),
                                     lambda s: s != ""))


def needs_cleanup(filename: Column, page: Column) -> Column:
    return filename.rlike(FILE_PART) | page.contains("[Teil ") | page.contains(".md.md")


def summary_base(filename: Column) -> Column:
    """Document key of a summary page: no suffix, no part marker, no prefixes."""
    bare = F.regexp_replace(F.regexp_replace(filename, r"\.md\z", ""), r"-teil-\d+-\d+\z", "")
    bare = F.regexp_replace(F.regexp_replace(bare, r"\Asummary-", ""), r"\A(?:source-summary-|concept-|entity-)+", "")
    return tx.slug(F.regexp_replace(bare, r"-md\z", ""))


def page_blocks(response: Column) -> Column:
    """array<struct(filename, content)> of the ``=== name.md ===`` blocks of a model answer."""
    pattern = rf"(?s)===[{SPACE}]*([{WORD}\-.]+\.md)[{SPACE}]*===[{SPACE}]*(.*?)(?====|\z)"
    pairs = F.zip_with(find_all(response, pattern, 1), find_all(response, pattern, 2),
                       lambda n, c: F.struct(strip(n).alias("filename"), strip(c).alias("content")))
    return F.filter(pairs, lambda p: p["content"] != "")


def json_rows(answer: Column, schema: str) -> Column:
    """A JSON array in a model answer, with or without a code fence around it."""
    bare = F.regexp_replace(F.regexp_replace(strip(answer), r"\A```(?:json)?\s*", ""), r"\s*```\s*\z", "")
    return F.from_json(F.when(bare.startswith("["), bare).otherwise(F.regexp_extract(bare, r"(?s)(\[.*\])", 1)), schema)


def answer_list(answer: Column) -> Column:
    """struct(entries: array<variant>, error): the JSON array in a model answer, with or without fence and words around it."""
    trimmed = strip(F.coalesce(answer, F.lit("")))
    opened = F.regexp_replace(trimmed, rf"\A```(?:json)?[{SPACE}]*", "")
    bare = F.when(trimmed.startswith("```"), F.regexp_replace(opened, rf"[{SPACE}]*```[{SPACE}]*\z", "")).otherwise(trimmed)
    cut = F.regexp_extract(bare, r"(?s)(\[.*\])", 1)
    text = F.when(bare.startswith("[") | (cut == ""), bare).otherwise(cut)
    value = F.try_parse_json(text)
    entries = F.try_variant_get(value, "$", "array<variant>")
    is_list = F.schema_of_variant(value).startswith("ARRAY")
    return F.when(value.isNull(), F.struct(F.lit(None).cast("array<variant>").alias("entries"), F.lit("no JSON").alias("error"))) \
        .when(~is_list, F.struct(F.lit(None).cast("array<variant>").alias("entries"), F.lit("no list").alias("error"))) \
        .otherwise(F.struct(entries.alias("entries"), F.lit(None).cast("string").alias("error")))


# --- numeric facts ----------------------------------------------------------------------------------

_UNITS = "|".join(u for u in fv.FACT_UNITS if u != "%")
_NUMBER = r"\d+(?:[.,]\d+)?"
_FACT = rf"(?iu){_NUMBER}[{SPACE}]*(?:%(?=[{WORD}])|(?:{_UNITS})(?![{WORD}]))"


def with_numeric_facts(df: DataFrame, text: str, name: str) -> DataFrame:
    """Adds array<struct(key, value)>: ``last word before|unit`` and ``number unit`` of every measure.

    The last word is looked for in the 40 characters before a number: the text since the
    measure before it, and that measure.
    """
    # A split by a pattern compiles it for every row, a split by a character does not; the text's own marks are put aside.
    t = F.replace(F.col(text), F.lit(_MARK), F.lit(_OTHER_MARK))
    staged = (df.withColumn("_all", find_all(t, _FACT, 0)).withColumn("_between", F.split(F.regexp_replace(t, _FACT, _MARK), _MARK, -1))
              .withColumn("_number", F.transform("_all", lambda m: F.regexp_extract(m, rf"\A{_NUMBER}", 0)))
              .withColumn("_unit", F.transform("_all", lambda m: F.regexp_replace(m, rf"\A{_NUMBER}[{SPACE}]*", ""))))
    before = F.transform("_number", lambda n, i: F.right(
        F.concat(F.coalesce(F.get(F.col("_all"), i - 1), F.lit("")), F.get(F.col("_between"), i)), F.lit(fv.FACT_CONTEXT_CHARS)))
    last_word = F.transform(before, lambda c: F.element_at(F.concat(F.array(F.lit("")), find_all(
        c, rf"[A-Za-zÄÖÜäöüß][{WORD}\-]+")), -1))
    keyed = staged.withColumn("_word", last_word).withColumn("_key", F.transform("_word", term_key))
    facts = F.transform("_key", lambda k, i: F.struct(
        F.concat(k, F.lit("|"), F.lower(F.get(F.col("_unit"), i))).alias("key"),
        F.concat(F.replace(F.get(F.col("_number"), i), F.lit(","), F.lit(".")), F.lit(" "),
                 F.lower(F.get(F.col("_unit"), i))).alias("value")))
    return keyed.withColumn(name, facts).drop("_all", "_between", "_number", "_unit", "_word", "_key")


def values_by_key(facts: Column) -> Column:
    """array<struct(key, values)>: the distinct values of every key, both in order."""
    def distinct(ordered: Column) -> Column:
        return F.filter(ordered, lambda f, i: (i == 0) | ~f.eqNullSafe(F.get(ordered, i - 1)))

    def run_starts(ordered: Column) -> Column:
        return F.filter(F.transform(ordered, lambda f, i: i), lambda i: (i == 0) | ~F.get(ordered, i)["key"].eqNullSafe(
            F.get(ordered, i - 1)["key"]))

    def runs(ordered: Column, starts: Column) -> Column:
        return F.transform(starts, lambda at, n: F.struct(F.get(ordered, at)["key"].alias("key"), F.transform(F.slice(
            ordered, at + 1, F.coalesce(F.get(starts, n + 1), F.size(ordered)) - at), lambda f: f["value"]).alias("values")))

    return tx.let(F.sort_array(facts), lambda facts: tx.let(distinct(facts), lambda ordered: tx.let(
        run_starts(ordered), lambda starts: runs(ordered, starts))))


def contradictions(old_facts: Column, new_facts: Column) -> Column:
    """array<struct(key, old, new)>: keys where the new text has a value the old one lacks."""
    def values(facts: Column, key: Column) -> Column:
        return F.array_sort(F.array_distinct(F.transform(F.filter(facts, lambda f: f["key"] == key), lambda f: f["value"])))

    keys = F.array_distinct(F.transform(new_facts, lambda f: f["key"]))
    rows = F.transform(keys, lambda k: F.struct(k.alias("key"), values(old_facts, k).alias("old"),
                                                values(new_facts, k).alias("new")))
    return F.filter(rows, lambda r: (F.size(r["old"]) > 0) & (F.size(F.array_except(r["new"], r["old"])) > 0))


def conflict_sentence(conflict: Column, newer: Column) -> Column:
    term = F.substring_index(conflict["key"], "|", 1)
    old, new = F.array_join(conflict["old"], ", "), F.array_join(conflict["new"], ", ")
    return F.when(newer, F.concat(term, F.lit(": now "), new, F.lit(" per the newer source; previously "), old)) \
        .otherwise(F.concat(term, F.lit(": sources disagree — "), old, F.lit(" vs "), new, F.lit(" (unresolved)")))
