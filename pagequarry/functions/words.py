"""Word forms: folds, stems and the up to four index terms of a token."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry import fixed_values as fv
from pagequarry.functions.text import WORD, find_all
from pagequarry.functions.unicode_forms import PAIR_MARK, has_other_folds, strip_marks, words_with_folds


def spell_digraphs(token: Column) -> Column:
    """ä, ö, ü, ß spelled ae, oe, ue, ss."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), fv.GERMAN_DIGRAPHS, token)


# Read backwards a suffix is a prefix, so one anchored alternation in list order finds it.
_SUFFIX_BACKWARDS = (r"\A(?:" + "|".join(s[::-1] for s in fv.GERMAN_SUFFIXES + fv.ENGLISH_SUFFIXES)
                     + rf")(?=.{{{fv.MIN_STEM_CHARS}}})")


def stem(folded: Column) -> Column:
    """Drop the first listed suffix that leaves at least four characters."""
    return F.reverse(F.regexp_replace(F.reverse(folded), _SUFFIX_BACKWARDS, ""))


def is_index_word(token: Column) -> Column:
    """Long enough and no stop word."""
    return (F.length(token) >= fv.MIN_TOKEN_CHARS) & ~token.isin(fv.STOP_WORDS)


def word_forms(token: Column, folded: Column, stemmed: Column) -> Column:
    """Surface, mark-free, digraph and stem form; distinct, in this order."""
    return (F.when((folded == token) & (stemmed == token) & ~token.rlike("[äöüß]"), F.array(token))
            .when(F.length(token) == F.octet_length(token), F.array(token, stemmed))
            .otherwise(F.array_distinct(F.array(token, folded, spell_digraphs(token), stemmed))))


def explode_words(df: DataFrame, text: Column, keep: list[str],
                  deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """One row per index word of ``text`` (repeats stay): ``token``, ``folded`` and ``stemmed``.

    ``deal`` may spread the texts over tasks.  It comes after the Python step, behind which Spark
    would no longer know how they lie, and before they become words.
    """
    paired = df.select(*keep, text.alias("_text")) \
        .withColumn("_paired", words_with_folds(F.when(has_other_folds(F.col("_text")), F.col("_text"))))
    words = deal(paired).select(*keep, F.explode(F.coalesce(
        F.col("_paired"), find_all(F.col("_text"), rf"[{WORD}]+"))).alias("_word"))
    is_pair = F.col("_word").contains(PAIR_MARK)
    return (words.withColumn("token", F.lower(F.substring_index("_word", PAIR_MARK, 1)))
            .where(is_index_word(F.col("token")))
            .withColumn("folded", F.when(is_pair, F.substring_index("_word", PAIR_MARK, -1))
                        .otherwise(strip_marks(F.col("token"))))
            .drop("_word")
            .withColumn("stemmed", stem(F.col("folded"))))


def _forms() -> Column:
    return word_forms(F.col("token"), F.col("folded"), F.col("stemmed"))


def is_counted(term: Column) -> Column:
    """Compounds are extra rows that do not add to the length of a text."""
    return ~(term.contains("_") | term.contains("⁄"))


def explode_terms(df: DataFrame, text: Column, keep: list[str],
                  deal: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """One row per index term of ``text``: every form of every index word.

    A word with ``_`` is counted part by part; the compound itself is an uncounted extra row
    (see :func:`is_counted`), so that the compound can be looked up as a unit.
    """
    whole_and_parts = F.flatten(F.transform(_forms(), lambda f: F.concat(
        F.filter(F.split(f, "[_⁄]"), lambda p: p != ""), F.when(is_counted(f), F.array().cast("array<string>"))
        .otherwise(F.array(f)))))
    simple = is_counted(F.col("token")) & is_counted(F.col("folded"))
    return (explode_words(df, text, keep, deal)
            .select(*keep, F.explode(F.when(simple, _forms()).otherwise(whole_and_parts)).alias("term"))
            .where("term <> ''"))


def query_terms(queries: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """Distinct forms of the words of every query."""
    return (explode_words(queries, text, keys).select(*keys, F.explode(_forms()).alias("term"))
            .where("term <> ''").distinct())


# --- topic keys ---------------------------------------------------------------------

# An English plural (at least three letters stay), where no listed suffix fits.
_KEY_BACKWARDS = (r"\A(?:(?:" + "|".join(s[::-1] for s in fv.GERMAN_SUFFIXES + fv.ENGLISH_SUFFIXES)
                  + rf")(?=.{{{fv.MIN_STEM_CHARS}}})|se(?=.{{3}})|s(?!s)(?=.{{3}}))")


def term_key(token: Column) -> Column:
    """Comparison key of a word: its stem, or without plural where no suffix fits."""
    return F.reverse(F.regexp_replace(F.reverse(strip_marks(F.lower(token))), _KEY_BACKWARDS, ""))


def topic_tokens(name: Column) -> Column:
    """Sorted distinct keys of the words of a page name or title."""
    bare = F.regexp_replace(F.lower(name), r"\.md\z", "")
    bare = F.regexp_replace(bare, rf"\A(?:{'|'.join(fv.PAGE_PREFIXES)})-", "")
    found = F.filter(find_all(bare, "[a-z0-9]+"), lambda t: ~t.isin(fv.SLUG_STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(found, term_key)))


def key_terms(text: Column) -> Column:
    """The first twelve distinct keys of the words of ``text``."""
    found = F.filter(find_all(text, "[A-Za-z0-9]{2,}"), lambda t: ~F.lower(t).isin(fv.SLUG_STOP_WORDS))
    return F.slice(F.array_distinct(F.transform(found, term_key)), 1, fv.MAX_KEY_TERMS)


def overlap(a: Column, b: Column) -> Column:
    """Shared members over the smaller size; 0 where a side is empty."""
    smaller = F.least(F.size(a), F.size(b))
    return F.when(smaller > 0, F.size(F.array_intersect(a, b)) / smaller).otherwise(F.lit(0.0))
