"""Unicode folding and composition as column expressions.

Spark has no normalisation function.  Precomposed letters of the alphabetic scripts fold
to one base letter each; that table is derived from the Unicode database on the driver and
applied with ``translate`` on the JVM.  The few texts with other compatibility characters
(ligatures, fractions, Hangul, full-width forms) go through an Arrow UDF, and so do the
texts that NFC may change.  All other texts never leave the JVM.
"""

from __future__ import annotations

import functools
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Latin, Greek, Cyrillic and their extensions, where one letter folds to one letter.
_ALPHABETS = ((0x80, 0x52F), (0x1E00, 0x1FFF))


def fold(text: str) -> str:
    """NFKD form without combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c))


@functools.cache
def _fold_table() -> dict[str, str]:
    """{letter: base letter} of the lower-case letters and numbers of the alphabets."""
    chars = [chr(code) for a, b in _ALPHABETS for code in range(a, b + 1)]
    return {c: fold(c) for c in chars if unicodedata.category(c)[0] in "LN" and c == c.lower()
            and fold(c) != c and len(fold(c)) == 1}


# Blocks where nearly every letter and number folds one to one, by the table or to itself.
_PLAIN_BLOCKS = ((0x0, 0x2AF), (0x370, 0x52F), (0x5D0, 0x621), (0x627, 0x674), (0x1E00, 0x1FFF),
                 (0x2010, 0x206F), (0x20A0, 0x20BF), (0x2190, 0x23FF), (0x4E00, 0x9FFF))


@functools.cache
def _plain_class() -> str:
    """Body of the class of all characters of those blocks that do fold one to one."""
    table, ranges = _fold_table(), []
    for first, last in _PLAIN_BLOCKS:
        for code in range(first, last + 1):
            low = chr(code).lower()
            if all(unicodedata.category(c)[0] not in "LN" or fold(c) == table.get(c, c) for c in low):
                if ranges and ranges[-1][1] == code - 1:
                    ranges[-1][1] = code
                else:
                    ranges.append([code, code])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in ranges)


def has_other_folds(text: Column) -> Column:
    """Whether a text may hold letters that do not fold one to one; only characters beyond ASCII are looked up."""
    return (F.length(text) < F.octet_length(text)) & text.rlike(rf"[^\x00-\x7f](?<![{_plain_class()}])")


def strip_marks(token: Column) -> Column:
    """ü becomes u, é becomes e; exact unless :func:`has_other_folds`."""
    table = _fold_table()
    return F.when(F.length(token) == F.octet_length(token), token) \
        .otherwise(F.translate(token, "".join(table), "".join(table.values())))


PAIR_MARK = "\t"


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_with_folds(texts: pd.Series) -> pd.Series:
    """Lower-cased words of a text, each followed by a tab and its fold."""
    def pairs(text):
        return None if text is None else [w + "\t" + fold(w) for w in map(str.lower, re.findall(r"\w+", text))]
    return texts.map(pairs)


# A text made only of these characters is its own NFC form.
_ALREADY_COMPOSED = r"\A[\x00-˿Ѐ-҂Ҋ-ԯ‐-‧‰-⁞₠-₿一-鿿가-힣]*\z"


@F.pandas_udf(T.StringType())
def _compose(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))


def nfc_where_needed(text: Column) -> Column:
    """NFC form of the texts that may need composing, NULL for all others."""
    return _compose(F.when(~text.rlike(_ALREADY_COMPOSED), text))
