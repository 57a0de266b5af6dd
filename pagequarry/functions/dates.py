"""Dates found in text, freshness of pages."""

from __future__ import annotations

import re
from datetime import date

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry import fixed_values as fv
from pagequarry.functions.text import LEFT_EDGE, RIGHT_EDGE, SPACE, find_all

DAY_MONTH_YEAR = rf"([0-9]{{1,2}})\.[{SPACE}]*([0-9]{{1,2}})\.[{SPACE}]*([0-9]{{4}})"
DAY_NAME_YEAR = rf"([0-9]{{1,2}})\.[{SPACE}]*([A-Za-zÄÖÜäöü]+)[{SPACE}]+([0-9]{{4}})"
YEAR_MONTH_DAY = r"([0-9]{4})-([0-9]{2})-([0-9]{2})"


def read_date(segment: str) -> date | None:
    """First date of a text segment; an impossible date in the form found first is final."""
    if found := re.search(DAY_MONTH_YEAR, segment):
        day, month, year = map(int, found.groups())
    elif (found := re.search(DAY_NAME_YEAR, segment)) and found[2].lower() in fv.MONTH_NUMBERS:
        day, month, year = int(found[1]), fv.MONTH_NUMBERS[found[2].lower()], int(found[3])
    elif found := re.search(YEAR_MONTH_DAY, segment):
        year, month, day = map(int, found.groups())
    else:
        return None
    try:
        return date(year, month, day)
    except ValueError:
        return None


@F.pandas_udf(T.DateType())
def _first_date(tried: pd.Series) -> pd.Series:
    return tried.map(lambda segments: next((d for s in segments for d in [read_date(s)] if d), None)
                     if segments is not None else None)


def effective_date(text: Column) -> Column:
    """Date that follows the strongest cue in the document head, else the first bare date.

    The texts after every cue, from the strongest cue down, and then the head itself are cut
    out on the JVM and tried in order; the first that holds a date decides.  Texts whose
    head has no digit never reach Python.
    """
    head = F.left(text, F.lit(fv.DATE_HEAD_CHARS))

    def after(cue: str) -> Column:
        cue = cue.replace(r"\s", f"[{SPACE}]")
        if cue.startswith(r"\b"):
            cue = LEFT_EDGE + cue.removeprefix(r"\b").removesuffix(r"\b") + RIGHT_EDGE
        return find_all(head, rf"(?iu){cue}(?=([\s\S]{{0,{fv.DATE_REACH_CHARS}}}))", 1)

    tried = F.concat(*[after(cue) for cue in fv.DATE_CUES], F.array(head))
    return _first_date(F.when(head.rlike("[0-9]{4}"), tried))


def iso_day(value: Column) -> Column:
    """Date of the first ten characters, NULL where they are no ISO date."""
    ten = F.left(value.cast("string"), F.lit(10))
    return F.when(ten.rlike(r"\A[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\z"), ten.try_cast("date"))


def iso_timestamp(value: Column) -> Column:
    ten = F.left(value.cast("string"), F.lit(10))
    return F.when(ten.rlike(r"\A[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), F.concat(ten, F.lit("T00:00:00Z")))


def is_stale(updated: Column, ttl_days: Column, today: Column) -> Column:
    """Older than its own time to live, 365 days by default; 0 or less means never."""
    ttl = F.coalesce(ttl_days.try_cast("int"), F.lit(fv.DEFAULT_TTL_DAYS))
    return F.coalesce((ttl > 0) & (F.datediff(today, updated) > ttl), F.lit(False))


def page_date(effective: Column, updated: Column, created: Column) -> Column:
    return F.coalesce(effective, updated, created)


def is_newer(new_date: Column, old_date: Column) -> Column:
    return F.coalesce(new_date > old_date, F.lit(False))
