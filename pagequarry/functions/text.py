"""Column expressions over text.  Everything here stays on the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv

# Bodies of character classes.  Java's \s and \w are ASCII only, so the Unicode
# white-space characters and the letter/number classes are written out.
SPACE = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORD = r"\p{L}\p{N}_"
LEFT_EDGE = rf"(?<![{WORD}])"
RIGHT_EDGE = rf"(?![{WORD}])"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value computed once per row.

    An expression that is named twice is computed twice, and inside a lambda once per element.
    """
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find_all(text: Column, pattern: str, group: int = 0) -> Column:
    """Every non-overlapping match of ``pattern``, as an array of one group."""
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(group))


def first_match(text: Column, pattern: str, group: int = 1) -> Column:
    """One group of the first match, NULL where nothing matches."""
    return F.when(text.rlike(pattern), F.regexp_extract(text, pattern, group))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def squeeze(text: Column) -> Column:
    """Every run of white space becomes one blank."""
    return F.regexp_replace(text, rf"[{SPACE}]+", " ")


def is_blank(text: Column) -> Column:
    return ~text.rlike(rf"[^{SPACE}]")


def lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def count_of(text: Column, needle: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(needle), F.lit(""))))
            / F.lit(len(needle))).cast("int")


def words(text: Column) -> Column:
    """Surface tokens in order, lower-cased one by one."""
    return F.transform(find_all(text, rf"[{WORD}]+"), F.lower)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(rf"[{WORD}]+"))


def slug(text: Column, fallback: str = "") -> Column:
    made = F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), r"^-|-$", "")
    return F.when(made == "", F.lit(fallback)).otherwise(made) if fallback else made


def file_stem(name: Column) -> Column:
    """File name without its last suffix (a leading dot starts no suffix)."""
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def file_suffix(name: Column) -> Column:
    return F.lower(F.regexp_extract(name, r"(?<=.)(\.[^.]+)$", 1))


def preview(text: Column, limit: int = fv.PREVIEW_CHARS) -> Column:
    flat = strip(F.replace(text, F.lit("\n"), F.lit(" ")))
    return F.when(F.length(flat) > limit, F.concat(F.left(flat, F.lit(limit)), F.lit("…"))).otherwise(flat)


def content_key(text: Column, composed: Column | None = None) -> Column:
    """First 16 hex digits of SHA-256 over white-space-squeezed lower-cased text.

    ``composed`` is the NFC form where it differs from ``text`` (see
    :func:`pagequarry.functions.unicode_forms.nfc_where_needed`).
    """
    source = text if composed is None else F.coalesce(composed, text)
    return F.left(F.sha2(F.lower(strip(squeeze(source))).cast("binary"), 256), F.lit(16))


def chunk_language(text: Column) -> Column:
    """German only with strictly more markers than English."""
    sample = F.lower(F.left(text, F.lit(fv.LANG_SAMPLE_CHARS)))
    votes = {lang: sum((count_of(sample, m) for m in marks), F.lit(0))
             for lang, marks in fv.CHUNK_LANG_MARKERS.items()}
    return F.when(votes["de"] > votes["en"], "de").otherwise("en")


def vote_language(text: Column, default: str = "de") -> Column:
    """Function-word vote; an umlaut or sharp s counts two; a tie takes the default."""
    sample = F.lower(F.left(F.coalesce(text, F.lit("")), F.lit(fv.LANG_SAMPLE_CHARS)))
    found = find_all(sample, "[a-zäöüß]+")
    german = (F.size(F.filter(found, lambda t: t.isin(fv.VOTE_WORDS["de"])))
              + F.when(sample.rlike("[äöüß]"), fv.UMLAUT_VOTES).otherwise(0))
    english = F.size(F.filter(found, lambda t: t.isin(fv.VOTE_WORDS["en"])))
    return (F.when(german == english, default)
            .when(german > english, "de").otherwise("en"))


RESPONSE_DIRECTIVES = {
    "de": "Antworte vollständig auf Deutsch; Zitate, Abschnittsmarken und Zahlen bleiben unverändert.",
    "en": "Answer in English throughout; keep citations, section marks and numbers unchanged.",
}
INGEST_DIRECTIVES = {
    "de": "Schreibe die Seite auf Deutsch; '## Key facts', Zahlen und Zitate bleiben unverändert.",
    "en": "Write the page in English; keep '## Key facts', numbers and citations unchanged.",
}


def directive(text: Column, texts: dict[str, str] = RESPONSE_DIRECTIVES, default: str = "de") -> Column:
    """Language directive that goes with the voted language of ``text``."""
    return F.when(vote_language(text, default) == "de", texts["de"]).otherwise(texts["en"])


# --- citations and gates ---------------------------------------------------------

WIKI_CITATION = rf"\[Wiki:[{SPACE}]*([^\]\n]+?\.md)[{SPACE}]*\]"
RAW_CITATION = rf"\[Source:[{SPACE}]*([^\]\n]+?\.(?:md|txt|html)(?:[{SPACE}]*[§#][^\]\n]+?)?)[{SPACE}]*\]"
PLAIN_RAW_CITATION = rf"\[Source:[{SPACE}]*([^\]]+\.(?:md|txt|html))[{SPACE}]*\]"
URL = r"https?://[^\s\)\]]+"


def wiki_citations(text: Column) -> Column:
    return F.array_distinct(find_all(text, WIKI_CITATION, 1))


def raw_citations(text: Column, with_sections: bool = True) -> Column:
    return F.array_distinct(find_all(text, RAW_CITATION if with_sections else PLAIN_RAW_CITATION, 1))


def urls(text: Column) -> Column:
    return F.array_distinct(find_all(text, URL))


def chat_counts(answer: Column, extra_sources: Column | None = None) -> list[Column]:
    """n_words, n_originals and n_sources, the numbers that :func:`chat_gate` judges."""
    answer = F.coalesce(answer, F.lit(""))
    originals = raw_citations(answer)
    if extra_sources is not None:
        originals = F.array_union(originals, F.coalesce(extra_sources, F.array().cast("array<string>")))
    n_originals = F.size(originals)
    return [word_count(answer).alias("n_words"), n_originals.alias("n_originals"),
            (n_originals + F.size(wiki_citations(answer))).alias("n_sources")]


def chat_gate(answer: Column, extra_sources: Column | None = None) -> Column:
    """Verdict on a chat answer: enough words, two sources, one of them an original."""
    n_words, n_originals, n_sources = chat_counts(answer, extra_sources)
    return (F.when(n_words < fv.CHAT_MIN_WORDS, "REJECTED: words")
            .when((n_sources < fv.CHAT_MIN_SOURCES) | (n_originals == 0), "REJECTED: sources")
            .otherwise(F.format_string("ACCEPTED: %d words, %d sources cited.", n_words, n_sources)))


def report_citations(answer: Column) -> Column:
    """Distinct citations of a report; an original given by URL counts once."""
    originals = F.filter(raw_citations(answer), lambda r: ~r.contains("://"))
    return F.concat(F.array_sort(urls(answer)),
                    F.array_sort(F.transform(wiki_citations(answer), lambda w: F.concat(F.lit("wiki:"), w))),
                    F.array_sort(F.transform(originals, lambda r: F.concat(F.lit("src:"), r))))


def report_gate(title: Column, answer: Column) -> Column:
    answer = F.coalesce(answer, F.lit(""))
    n_words = word_count(answer)
    n_sources = F.size(report_citations(answer))
    return (F.when(n_words < fv.REPORT_MIN_WORDS, "REJECTED: words")
            .when(n_sources < fv.REPORT_MIN_SOURCES, "REJECTED: sources")
            .otherwise(F.format_string("ACCEPTED: comparisons/report-%s.md (%d words, %d sources)",
                                       slug(title, "report"), n_words, n_sources)))


# --- names and references ---------------------------------------------------------

DB_SEPARATOR = "::"
DB_NAME = r"^[A-Za-z0-9][A-Za-z0-9_\- ]{0,40}$"


def valid_db_name(name: Column) -> Column:
    return F.coalesce(name.rlike(DB_NAME), F.lit(False))


def qualify(name: Column, db: Column, n_dbs: Column) -> Column:
    """``DB::name`` when the search spans several databases."""
    return F.when((n_dbs > 1) & (name != ""), F.concat(db, F.lit(DB_SEPARATOR), name)).otherwise(name)


def split_reference(ref: Column, active: Column, scope: Column) -> Column:
    """struct(db, name); a prefix outside ``scope`` falls back to the active database."""
    ref = strip(F.coalesce(ref, F.lit("")))
    head = strip(F.substring_index(ref, DB_SEPARATOR, 1))
    tail = strip(F.substring(ref, F.locate(DB_SEPARATOR, ref) + 2, F.length(ref)))
    known = ref.contains(DB_SEPARATOR) & (tail != "") & F.array_contains(scope, head)
    return F.struct(F.when(known, head).otherwise(active).alias("db"),
                    F.when(known, tail).otherwise(ref).alias("name"))


def split_section(ref: Column) -> Column:
    """struct(base, section) of ``file §sec``, ``file #sec`` or ``file.ext Heading title``."""
    ref = strip(ref)
    marked = ref.rlike("[§#]")
    base = F.regexp_extract(ref, rf"(?s)\A(.*?)[{SPACE}]*[§#]", 1)
    titled = ref.rlike(rf"\A[^{SPACE}]+\.[{WORD}]{{1,5}}[{SPACE}]+.")
    return (F.when(marked, F.struct(strip(base).alias("base"),
                                    strip(F.regexp_extract(ref, r"(?s)([§#].*)\z", 1)).alias("section")))
            .when(titled, F.struct(
                F.regexp_extract(ref, rf"\A([^{SPACE}]+\.[{WORD}]{{1,5}})", 1).alias("base"),
                strip(F.regexp_extract(ref, rf"(?s)\A[^{SPACE}]+\.[{WORD}]{{1,5}}[{SPACE}]+(.+)\z", 1)).alias("section")))
            .otherwise(F.struct(ref.alias("base"), F.lit("").alias("section"))))


def anchor_key(anchor: Column) -> Column:
    """Anchor without leading #, § and blanks, squeezed and folded for comparison."""
    return F.lower(strip(squeeze(F.regexp_replace(anchor, rf"\A[#§{SPACE}]+", ""))))


def title_question(source: Column) -> Column:
    stem = F.trim(F.replace(F.replace(F.regexp_replace(source, r"\.[^.]*$", ""), F.lit("_"), F.lit(" ")),
                            F.lit("-"), F.lit(" ")))
    return F.when(stem != "", F.format_string("Worum geht es in %s?", stem)) \
        .otherwise("Worum geht es in diesem Dokument?")


def cap_overview(text: Column, limit: int = fv.OVERVIEW_CHARS) -> Column:
    """Cut at the last paragraph, sentence or word break beyond the middle."""
    text = strip(text)
    cut = F.left(text, F.lit(limit))

    def at_last(sep: str) -> Column:
        pos = F.lit(limit) - F.locate(sep[::-1], F.reverse(cut)) - len(sep) + 1
        return F.when(cut.contains(sep) & (pos > limit // 2), strip(F.left(cut, pos)))

    return F.when(F.length(text) <= limit, text).otherwise(
        F.coalesce(at_last("\n\n"), at_last(". "), at_last(" "), strip(cut)))


def shorten_label(name: Column, n_words: int = 5) -> Column:
    """The first five words of a node label, hyphens read as blanks."""
    parts = F.filter(F.split(squeeze(F.replace(name, F.lit("-"), F.lit(" "))), " "), lambda w: w != "")
    return F.array_join(F.slice(parts, 1, n_words), " ")
