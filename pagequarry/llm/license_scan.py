"""License scans: pigeonhole seeds find places where a short notice may stand, bounded-error matching verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagequarry.llm.common import without
from pagequarry.session import spread

# Fixed values of the contract: phrases and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

# Short notices of public licenses, as words, and the label of each.
NOTICES = (
    ("gnu general public license", "gpl"),
    ("you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("gnu lesser general public license", "lgpl"),
    ("gnu affero general public license", "agpl"),
    ("apache license", "apache"),
    ("licensed under the apache license version 2 0", "apache"),
    ("mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("permission to use copy modify and or distribute this software for any purpose", "isc"),
    ("mozilla public license", "mpl"),
    ("eclipse public license", "epl"),
    ("boost software license", "bsl"),
    ("creative commons attribution", "cc-by"),
    ("creative commons zero", "cc0"),
    ("this is free and unencumbered software released into the public domain", "unlicense"),
    ("all rights reserved", "reserved"),
)
# One error for so many characters of a notice: (mis)spellings and a changed word, not another sentence.
CHARS_PER_ERROR = 11

_WORD_BYTES = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b in _WORD_BYTES else 0x20 for b in range(256))

HIT = "label: string, notice: string, start: int, end: int, errors: int, exact: boolean"
ADDED = f"n_words bigint, licenses array<struct<{HIT}>>"


def words_of(text: str) -> list[bytes]:
    """Words of the lower-cased text: ASCII letters and digits and everything beyond ASCII."""
    return text.encode().translate(_TABLE).split()


def pieces(notice: str, errors: int) -> list[tuple[int, str]]:
    """The notice cut into errors + 1 parts of nearly equal length: one of them is in any match of at most so many errors."""
    cuts = [len(notice) * i // (errors + 1) for i in range(errors + 2)]
    return [(a, notice[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Seeds of all notices in one automaton, and a pattern with an error bound for each notice."""

    def __init__(self, notices: tuple[tuple[str, str], ...], chars_per_error: int):
        self.notices = notices
        self.errors = [len(n) // chars_per_error for n, _ in notices]
        self.patterns = [regex.compile(rf"(?e)(?<=\ )(?:{regex.escape(n)}){{e<={k}}}(?=\ )") for (n, _), k in zip(notices, self.errors, strict=True)]
        seeds: dict[str, list[tuple[int, int]]] = {}
        for i, (n, _) in enumerate(notices):
            for at, seed in pieces(n, self.errors[i]):
                seeds.setdefault(seed, []).append((i, at))
        self.seeds = ahocorasick.Automaton()
        for seed, uses in seeds.items():
            self.seeds.add_word(seed, (len(seed), uses))
        self.seeds.make_automaton()

    def windows(self, line: str) -> dict[int, list[tuple[int, int]]]:
        """Per notice the stretches of ``line`` around its seeds, merged where they overlap."""
        spans: dict[int, list[tuple[int, int]]] = {}
        for last, (size, uses) in self.seeds.iter(line):
            for i, at in uses:
                begin = last + 1 - size - at - self.errors[i]
                stop = begin + len(self.notices[i][0]) + 2 * self.errors[i]
                mine = spans.setdefault(i, [])
                # One character more on each side for the blanks around the notice.
                begin, stop = max(0, begin - 1), stop + 1
                if mine and begin <= mine[-1][1]:
                    mine[-1] = (min(mine[-1][0], begin), max(mine[-1][1], stop))
                else:
                    mine.append((begin, stop))
        return spans

    def scan(self, line: str) -> list[tuple[int, int, int, int]]:
        """(notice, start, end, errors) of verified matches in a line that begins and ends with a blank."""
        found = []
        for i, spans in self.windows(line).items():
            reach = len(self.notices[i][0]) + self.errors[i] + 2
            for begin, stop in spans:
                # A long stretch of seeds goes in steps that overlap by one whole match, so a match costs its own length.
                known = -1
                for at in range(begin, max(begin + 1, stop - reach), reach):
                    for m in self.patterns[i].finditer(line, at, min(stop, at + 2 * reach)):
                        if m.start() > known:
                            found.append((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                            known = m.start()
        return found


@lru_cache(maxsize=4)
def scanner(notices: tuple[tuple[str, str], ...], chars_per_error: int) -> Scanner:
    return Scanner(notices, chars_per_error)


def base_places(line: bytes) -> list[tuple[str, int, int]]:
    """(phrase, start, end) in bytes of every place of the contract's phrases, as whole words."""
    found = []
    for phrase in BASE:
        look, at = f" {phrase} ".encode(), -1
        while (at := line.find(look, at + 1)) >= 0:
            found.append((phrase, at + 1, at + 1 + len(phrase)))
    return found


def scan_text(text: str | None, machine: Scanner) -> tuple[int, list[dict]]:
    """(number of words, hits): first the exact phrases, then what the notices add; places are word numbers, end exclusive."""
    words = words_of(text or "")
    raw = b" " + b" ".join(words) + b" "
    place = lambda at: raw.count(b" ", 0, at) - 1
    hits = []
    for phrase, start, end in base_places(raw):
        hits.append({"label": BASE[phrase], "notice": phrase, "start": place(start), "end": place(end) + 1, "errors": 0, "exact": True})
    line = raw.decode(errors="replace")
    wide = len(line) != len(raw)
    for i, start, end, errors in machine.scan(line):
        notice, label = machine.notices[i]
        if errors == 0 and notice in BASE:
            continue   # told above
        first, last = (len(line[:start].encode()), len(line[:end].encode())) if wide else (start, end)
        hits.append({"label": label, "notice": notice, "start": place(first), "end": place(last) + 1, "errors": errors, "exact": False})
    return len(words), sorted(hits, key=lambda h: (not h["exact"], h["start"], h["end"], h["notice"]))


_HITS = pa.list_(pa.struct([("label", pa.string()), ("notice", pa.string()), ("start", pa.int32()), ("end", pa.int32()),
                            ("errors", pa.int32()), ("exact", pa.bool_())]))


def _scanned(notices: tuple[tuple[str, str], ...], chars_per_error: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = scanner(notices, chars_per_error)
        for batch in batches:
            told = [scan_text(t.as_py(), machine) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[1:], pa.array([n for n, _ in told], pa.int64()), pa.array([h for _, h in told], _HITS)],
                [*batch.schema.names[1:], "n_words", "licenses"])
    return run


def scan_licenses(docs: DataFrame, notices: tuple[tuple[str, str], ...] = NOTICES, chars_per_error: int = CHARS_PER_ERROR) -> DataFrame:
    """``docs`` with n_words and ``licenses``: label, notice, start, end (word numbers, end exclusive), errors, exact.

    Texts are lower-cased words.  The contract's phrases are found exactly.  A notice of m characters
    may have m // ``chars_per_error`` = k errors: it is cut into k + 1 seeds, one of which
    any such match holds unchanged; one automaton finds all seeds, and bounded-error matching
    verifies the windows around them and counts the edits.  Matches are whole words, from left to right, and
    do not overlap within a notice.

    Defined cases: a null or empty text has no words and no hits; rows are independent, so repeated
    rows, ties and empty tables need no rule; very long texts are scanned whole, in windows; other
    columns except ``text`` pass unchanged, but columns named like the added ones are replaced.
    """
    rows = without(docs, ("n_words", "licenses"))
    others = [f for f in rows.schema.fields if f.name != "text"]
    rows = spread(rows.select("text", *[F.col(f"`{f.name}`") for f in others]))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in others)
    return rows.mapInArrow(_scanned(notices, chars_per_error), kept + ADDED)


def label_list(hits: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["label"]))), ",")


def score(hits: Column) -> Column:
    """1 for an exact phrase, else the best share of a notice's characters without error, 0 without any hit."""
    rated = F.transform(hits, lambda h: F.when(h["exact"], F.lit(1.0)).otherwise(1 - h["errors"] / F.char_length(h["notice"])))
    return F.coalesce(F.array_max(rated), F.lit(0.0))


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns."""
    base = F.filter("licenses", lambda h: h["exact"])
    starts = F.transform(base, lambda h: h["start"].cast("long"))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
                        F.array_max(starts).alias("last_word"), label_list(base).alias("base_labels"),
                        label_list(F.col("licenses")).alias("labels"), score(F.col("licenses")).alias("score"))
