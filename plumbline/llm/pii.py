"""Personal data: regular expressions propose spans, checksums confirm them, nearby context words adjust their score.

Four kinds always stand once they pass their checks: email, ip, card (Luhn) and phone. Three more are added where their score
reaches ``KEEP``: iban (mod 97), national_id and local_phone, whose pattern alone is too weak without a context word. Added
spans that overlap any other are left out. Scans take time linear in the text, and a span is compared with its neighbours only.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import accumulate
from typing import NamedTuple

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import give_back

BASE = ("email", "ip", "card", "phone")
ADDED = ("iban", "national_id", "local_phone")
KINDS = BASE + ADDED
KEEP = 0.5
#: Code points before a span and after it where context words count.
NEAR = 48

#: What a kind's pattern, a passed checksum and a context word are worth, and the words.
SCORES = {"email": 0.8, "ip": 0.5, "card": 0.4, "phone": 0.6, "iban": 0.3, "national_id": 0.3, "local_phone": 0.35}
CHECKSUM = 0.4
CONTEXT = 0.25
WORDS = {
    "email": ("mail", "email", "contact", "correo"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "tarjeta", "karte", "carte"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "national_id": ("ssn", "social security", "identity", "passport"),
    "local_phone": ("phone", "tel", "call", "mobile", "fax"),
}

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
#: A part that fails at its first digit fails at its later ones, so that only first digits are tried.
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_IBAN = re.compile(r"\b([A-Z]{2})[0-9]{2}(?= ?[A-Z0-9])")
#: How many letters and digits a country's IBAN has.
IBAN_LENGTHS = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BR": 29, "BY": 28, "CH": 21, "CR": 22, "CY": 28, "CZ": 24,
    "DE": 22, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FO": 18, "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28,
    "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23, "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20,
    "LV": 21, "LY": 25, "MC": 27, "MD": 24, "ME": 22, "MK": 19, "MR": 27, "MT": 31, "MU": 30, "NL": 18, "NO": 15, "PK": 24, "PL": 28, "PS": 29, "PT": 25,
    "QA": 29, "RO": 24, "RS": 22, "SA": 24, "SC": 31, "SE": 24, "SI": 19, "SK": 24, "SM": 27, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29,
    "VA": 22, "VG": 24, "XK": 20,
}
_NATIONAL = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_LOCAL_PHONE = re.compile(r"(?<![0-9+])(?:\([0-9]{3}\) |[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4}(?![0-9])")


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        if i % 2:
            n = 2 * n - 9 * (n > 4)
        total += n
    return total % 10 == 0


def mod97(iban: str) -> bool:
    rest = 0
    for c in iban[4:] + iban[:4]:
        rest = int(f"{rest}{int(c, 36)}") % 97
    return rest == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def _emails(text: str):
    """For each @ the longest local part before it, not into the last span, and the longest domain after it."""
    at, last = text.find("@"), 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            yield start, last
        at = text.find("@", max(at + 1, last))


def _ips(text: str):
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip("0") or "0" for x in m[0].split("."))):
            yield m.span()


def _cards(text: str):
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            digits = _digits(m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                yield m.span()


def _phones(text: str):
    for m in _PHONE.finditer(text):
        if 9 <= len(_digits(m[0])) <= 15:
            yield m.span()


def _ibans(text: str):
    """As many letters and digits, single spaces between them, as the country's have, with no letter or digit right after."""
    for m in _IBAN.finditer(text):
        left, at, n = IBAN_LENGTHS.get(m[1], 0) - 4, m.end(), len(text)
        while left > 0:
            if at < n and text[at] == " ":
                at += 1
            if at >= n or not ("0" <= text[at] <= "9" or "A" <= text[at] <= "Z"):
                break
            at, left = at + 1, left - 1
        if left == 0 and not (at < n and (text[at].isalnum() or text[at] == "_")):
            yield m.start(), at


def _context(kind: str, text: str, start: int, end: int) -> float:
    near = f"{text[max(0, start - NEAR) : start]} {text[end : end + NEAR]}".lower()
    return CONTEXT if any(re.search(rf"\b{w}\b", near) for w in WORDS[kind]) else 0.0


def spans(text: str | None) -> list[Span]:
    """By kind, then start, in code points. None for a null or empty text."""
    if not text:
        return []
    out = [Span("email", a, b, 0) for a, b in _emails(text)] if "@" in text else []
    digits = _DIGIT.search(text) is not None
    if digits:
        out += [Span("ip", a, b, 0) for a, b in _ips(text)]
        out += [Span("card", a, b, CHECKSUM) for a, b in _cards(text)]
        if "+" in text:
            out += [Span("phone", a, b, 0) for a, b in _phones(text)]
    out = [s._replace(score=min(1.0, s.score + SCORES[s.kind] + _context(s.kind, text, s.start, s.end))) for s in out]
    if digits:
        base = sorted((s.start, s.end) for s in out)
        starts, reach = [a for a, _ in base], list(accumulate((b for _, b in base), max))
        taken: list[tuple[int, int]] = []  # added spans, none over another
        for kind, found in zip(ADDED, (_ibans(text), (m.span() for m in _NATIONAL.finditer(text)), (m.span() for m in _LOCAL_PHONE.finditer(text)))):
            for a, b in found:
                score = SCORES[kind] + _context(kind, text, a, b)
                if kind == "iban":
                    score += CHECKSUM if mod97(text[a:b].replace(" ", "")) else -CHECKSUM
                k, i = bisect_left(starts, b), bisect_left(taken, (b, 0))
                if score >= KEEP and not (k and reach[k - 1] > a) and not (i and taken[i - 1][1] > a):
                    insort(taken, (a, b))
                    out.append(Span(kind, a, b, min(1.0, score)))
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(out, key=lambda s: (order[s.kind], s.start))


SPANS = "doc_id long, spans array<struct<kind:string,start:int,end:int,score:double>>"
_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))


def found(docs: DataFrame) -> DataFrame:
    """doc_id and its spans for every row of docs (doc_id, text); null ids and repeated rows keep their rows, null and empty texts
    have no spans, an empty table no rows; other columns are not read, whatever their names."""

    def task(batches):
        for batch in batches:
            each = [[s._asdict() for s in spans(t.as_py())] for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(each, _TYPE)], names=["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, SPANS)


def digest(docs: DataFrame) -> DataFrame:
    """Counts of the four base kinds, a hash of their spans, and all spans, as text."""
    place = lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found(docs).select(
        "doc_id", *map(count, BASE),
        F.sha2(F.array_join(F.transform(base, place), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", place), ",").alias("spans"),
    )


def masked(text: str | None) -> str | None:
    """Each stretch of overlapping spans is replaced by the kind of its first, in capitals and brackets."""
    if not text:
        return text
    all_ = sorted(spans(text), key=lambda s: (s.start, -s.end))
    if not all_:
        return text
    reach = list(accumulate((s.end for s in all_), max))
    out, at = [], 0
    for k, s in enumerate(all_):
        if k and s.start < reach[k - 1]:
            at = max(at, s.end)
            continue
        out += [text[at : s.start], f"[{s.kind.upper()}]"]
        at = s.end
    return "".join([*out, text[at:]])


@F.pandas_udf(StringType())
def _masked(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for text in texts:
        yield pd.Series([masked(t) for t in text], dtype=object)
    give_back()


def redacted(docs: DataFrame) -> DataFrame:
    """docs with masked texts; n_chars, where docs has it, follows."""
    out = docs.withColumn("text", _masked("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
