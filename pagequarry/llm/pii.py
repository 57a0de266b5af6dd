"""Personal data: patterns propose spans, checksums confirm, nearby words move the score."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagequarry.llm.common import without

# Base kinds come first and in this order wherever spans are listed.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "local_phone", "ssn")
KINDS = BASE_KINDS + MORE_KINDS

# A local part is the run of allowed characters before each @; looking it up from there keeps
# the search linear in texts of any shape.
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
# Characters of an account number by country; a code that is not listed takes the longest run.
_IBAN_LENGTHS = {c: n for n, codes in {
    15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
    22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK SA SE SK TN VG RO", 25: "LY PT ST",
    26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
    30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU"}.items() for c in codes.split()}
_IBAN_REST = {n: re.compile(r"(?: ?[A-Z0-9]){%s}(?![A-Za-z0-9])" % size)
              for n, size in [(None, "11,30"), *((n, n - 4) for n in set(_IBAN_LENGTHS.values()))]}
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])0[0-9]{2,4}[ /-][0-9]{3,4}(?:[ -]?[0-9]{2,4}){1,2}(?![0-9])")

# Start score of a confirmed span and what a context word within WINDOW characters adds.
WINDOW, BONUS, REPORT = 48, 0.35, 0.75
START = {"email": 0.95, "ip": 0.8, "card": 0.9, "phone": 0.8, "iban": 0.9, "local_phone": 0.45, "ssn": 0.45}
CONTEXT = {"email": ("mail", "contact"), "ip": ("ip", "host", "server", "address"),
           "card": ("card", "visa", "credit", "karte", "carte", "tarjeta"),
           "phone": ("phone", "call", "tel", "mobile", "fax"), "iban": ("iban", "account", "konto", "compte", "cuenta"),
           "local_phone": ("phone", "call", "tel", "mobile", "fax", "telefon", "téléphone", "teléfono"),
           "ssn": ("ssn", "social security", "tax id")}
_NEAR = {kind: re.compile(r"\b(?:" + "|".join(map(re.escape, words)) + r")\b", re.I) for kind, words in CONTEXT.items()}


def luhn(digits: str) -> bool:
    """Every second digit from the right doubled, its digits summed: a multiple of ten."""
    values = [ord(c) - 48 for c in reversed(digits)]
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(values)) % 10 == 0


def mod97(account: str) -> bool:
    """ISO 7064: country and check digits moved to the end, letters as 10 to 35, remainder one."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def emails(text: str):
    taken, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > taken and _LOCAL.fullmatch(text, first - 1, first):
            first -= 1
        found = _DOMAIN.match(text, at + 1) if first < at else None
        taken = found.end() if found else at + 1
        if found:
            yield first, taken
        at = text.find("@", taken)


def ibans(text: str):
    """Account numbers of their country's length; what fails leaves the numbers that start inside it."""
    head = _IBAN.search(text)
    while head:
        rest = _IBAN_REST[_IBAN_LENGTHS.get(head[1])].match(text, head.end())
        found = rest and mod97(text[head.start():rest.end()].replace(" ", ""))
        if found:
            yield head.start(), rest.end()
        head = _IBAN.search(text, rest.end() if found else head.end())


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def propose(text: str):
    """kind, start, end of every span that its validator confirms; base kinds as contracted."""
    for start, end in emails(text):
        yield "email", start, end
    if "." in text:
        for m in _IP.finditer(text):
            # at most 255: leading zeros count as the number they write
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0")[:3] or 0) <= 255 for p in m[0].split(".")):
                yield "ip", m.start(), m.end()
    for m in _CARD.finditer(text):
        if 13 <= m.end() - m.start() and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            yield "card", m.start(), m.end()
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_digits(m[0])) <= 15:
                yield "phone", m.start(), m.end()
    for start, end in ibans(text):
        yield "iban", start, end
    if "-" in text:
        for m in _SSN.finditer(text):
            if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
                yield "ssn", m.start(), m.end()
    for m in _LOCAL_PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 12:
            yield "local_phone", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = text[max(0, start - WINDOW):start] + " " + text[end:end + WINDOW]
    return min(1.0, START[kind] + BONUS * bool(_NEAR[kind].search(near)))


def find_all(text: str) -> list[tuple[str, int, int, float]]:
    """All reported spans by kind, then start: base kinds always, the others from REPORT on."""
    rated = [(k, a, b, score(text, k, a, b)) for k, a, b in propose(text)]
    return sorted((r for r in rated if r[0] in BASE_KINDS or r[3] >= REPORT), key=lambda r: (KINDS.index(r[0]), r[1]))


_SPANS = T.StructType([T.StructField("spans", T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("score", T.DoubleType())])))])


@F.pandas_udf(_SPANS)
def _found(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame({"spans": [[{"kind": k, "start": a, "end": b, "score": s} for k, a, b, s in find_all(t or "")] for t in texts]})


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``spans``: an array of kind, start, end (code points, end exclusive), score.

    Each kind is matched leftmost and without overlap in the whole text; a failed check drops the
    match without another try.  Base kinds are always reported; IBANs are cut at the length of
    their country, confirmed by mod-97 and tried again from inside a failed one, and social-security and local phone numbers need a context word to reach the report score.

    Defined cases: null and empty texts have no spans; rows are independent, so repeated rows,
    ties and empty tables need no rule; a column named ``spans`` is replaced, others pass.
    """
    return without(docs, ("spans",)).withColumn("spans", _found(F.col(text))["spans"])


def span_list(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
