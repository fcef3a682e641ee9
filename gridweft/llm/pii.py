"""Personal data: patterns propose spans, validators confirm them, nearby words move their score."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Kinds in the order of results. The first four are always reported, the others from THRESHOLD on.
KINDS = ("email", "ip", "card", "phone", "iban", "card_short", "national_id")
BASE = KINDS[:4]
#: Score of a confirmed span before its context, and the words that speak for a kind.
PRIOR = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "card_short": 0.4, "national_id": 0.4}
WORDS = {
    "email": ("mail", "contact"),
    "ip": ("ip", "host", "server", "address"),
    "card": ("card", "visa", "mastercard", "credit", "payment"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "bank", "account", "transfer"),
    "card_short": ("card", "visa", "amex", "credit"),
    "national_id": ("ssn", "social security", "national id", "passport"),
}
AGAINST = ("version", "isbn", "order", "invoice", "build", "serial")
THRESHOLD, STEP, NEAR = 0.6, 0.2, 48

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"\b[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}\b", re.ASCII)
_NATIONAL = re.compile(r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b", re.ASCII)
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    """Whether the last digit is the check digit."""
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])) % 10 == 0


def mod97(iban: str) -> bool:
    """Whether an IBAN without spaces leaves 1."""
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def _emails(text: str):
    free = 0  # the end of the last match: local parts don't reach back over it
    for m in _DOMAIN.finditer(text):
        at = i = m.start()
        while i > free and text[i - 1] in _LOCAL:
            i -= 1
        if i < at:
            free = m.end()
            yield i, free


def proposals(text: str):
    """(kind, start, end) of every confirmed span, by kind, then start."""
    for a, b in _emails(text):
        yield "email", a, b
    for m in _IP.finditer(text):
        if all(len(p := x.lstrip("0")) <= 3 and int(p or 0) <= 255 for x in m[0].split(".")):
            yield "ip", m.start(), m.end()
    runs = [(m.start(), m.end(), _digits(m[0])) for m in _CARD.finditer(text)]
    for a, b, d in runs:
        if 16 <= len(d) <= 19 and luhn(d):
            yield "card", a, b
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            yield "phone", m.start(), m.end()
    for m in _IBAN.finditer(text):
        if mod97(m[0].replace(" ", "")):
            yield "iban", m.start(), m.end()
    for a, b, d in runs:
        if 13 <= len(d) <= 15 and luhn(d):
            yield "card_short", a, b
    for m in _NATIONAL.finditer(text):
        if m[0][:3] not in ("000", "666") and m[0][0] != "9" and m[0][4:6] != "00" and m[0][7:] != "0000":
            yield "national_id", m.start(), m.end()


def score(text: str, kind: str, start: int, end: int) -> float:
    near = (text[max(0, start - NEAR) : start] + " " + text[end : end + NEAR // 2]).lower()
    s = PRIOR[kind] + STEP * any(w in near for w in WORDS[kind]) - STEP * any(w in near for w in AGAINST)
    return round(min(1.0, max(0.0, s)), 3)


def spans(text: str) -> list[dict]:
    out = []
    for kind, a, b in proposals(text):
        s = score(text, kind, a, b)
        if kind in BASE or s >= THRESHOLD:
            out.append({"kind": kind, "start": a, "end": b, "score": s})
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, spans): per row of docs array<struct<kind, start, end, score>> by kind as in KINDS, then start.

    Positions are code points, ends exclusive. Null and empty texts have no span. Rows are
    independent: repeated rows, ties and null ids give a row each; texts of any length are read whole,
    an empty table gives no rows; other columns, whatever they are called, are not read.
    """
    common.ship(docs.sparkSession)
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
    schema = pa.schema([("id", pa.int64()), ("spans", pa.list_(span))])

    def run(batches):
        for whole in batches:
            for b in common.slices(whole, "text"):
                yield common.batch({"id": b.column(0), "spans": [spans(t.as_py() or "") for t in b.column(1)]}, schema)

    out = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(common.lean(run), "id long, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>")
    return out.withColumnRenamed("id", id_col)
