"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust the score.

Base kinds are ``email``, ``ip``, ``card`` (Luhn) and ``phone``; each proposal that fails its
check is dropped and not tried again. The method adds ``iban`` (mod-97) and ``ssn`` (three
number groups in their valid ranges, which only nearby words confirm). A score starts from
the kind's own weight, gains from a passed checksum and from context words within
``WINDOW`` code points; added spans stay from ``KEEP`` on, base spans always.

All scans are linear in the text. Positions are code points, ends exclusive. Defined
results: a null text counts as empty and has no spans; texts and matches may be of any length;
repeated rows and null ids are rows like others; spans that begin together are in the order of
``KINDS``; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE = KINDS[:4]
WINDOW, KEEP = 40, 0.6

# A match may begin only where a run of digits begins: within the run a leftmost match would have begun before.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")
_DIGIT = re.compile("[0-9]")

#: Words near a span that speak for its kind, and the weight of a bare match.
CONTEXT = {
    "email": ("email", "e-mail", "mail", "contact", "correo", "courriel"),
    "ip": ("ip", "host", "server", "address", "serveur", "servidor"),
    "card": ("card", "visa", "mastercard", "credit", "carte", "tarjeta", "karte"),
    "phone": ("phone", "tel", "call", "mobile", "fax", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "compte", "cuenta"),
    "ssn": ("ssn", "social security", "taxpayer"),
}
WEIGHT = {"email": 0.6, "ip": 0.5, "card": 0.4, "phone": 0.5, "iban": 0.3, "ssn": 0.4}
CONFIRMED, NEARBY = 0.4, 0.3

_NEAR = {k: re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, w)) + r")(?!\w)") for k, w in CONTEXT.items()}


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    moved = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches: a local part as far left as the last match allows, then a dotted domain."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            end = m.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def _base(text: str) -> Iterator[tuple[str, int, int, bool]]:
    """kind, start, end and whether a checksum confirmed it."""
    if "@" in text:
        for a, b in _emails(text):
            yield "email", a, b, False
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(d := p.lstrip("0")) <= 3 and int(d or 0) <= 255 for p in m[0].split(".")):
                yield "ip", *m.span(), False
        for m in _CARD.finditer(text):
            if m.end() - m.start() < 38 and 14 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
                yield "card", *m.span(), True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_DIGIT.findall(m[0])) <= 15:
                yield "phone", *m.span(), False


def _added(text: str) -> Iterator[tuple[str, int, int, bool]]:
    if not _DIGIT.search(text):
        return
    for m in _IBAN.finditer(text):
        if 15 <= len(c := m[0].replace(" ", "")) <= 34 and mod97(c):
            yield "iban", *m.span(), True
    if "-" in text:
        for m in _SSN.finditer(text):
            if m[1] not in ("000", "666") and m[1] < "900" and m[2] != "00" and m[3] != "0000":
                yield "ssn", *m.span(), False


def _score(text: str, kind: str, start: int, end: int, confirmed: bool) -> float:
    around = text[max(0, start - WINDOW) : start] + " \n " + text[end : end + WINDOW]
    near = _NEAR[kind].search(around.lower()) is not None
    return min(1.0, WEIGHT[kind] + CONFIRMED * confirmed + NEARBY * near)


def find_spans(text: str | None) -> list[tuple[str, int, int, float]]:
    """kind, start, end and score, by start, then kind in the order of ``KINDS``."""
    text = text or ""
    found = [(k, a, b, _score(text, k, a, b, c)) for k, a, b, c in _base(text)]
    found += [s for k, a, b, c in _added(text) if (s := (k, a, b, _score(text, k, a, b, c)))[3] >= KEEP]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _mask(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """The text with each span, or union of spans that overlap, replaced by its first kind."""
    out, end = [], 0
    for kind, a, b, _ in spans:
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def spans(text: Column) -> Column:
    """Array of struct(kind, start, end, score) of each text."""

    @F.pandas_udf("array<struct<kind:string,start:long,end:long,score:double>>")
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([[dict(zip(("kind", "start", "end", "score"), s)) for s in find_spans(t)] for t in texts], dtype=object)

    return found(text)


def masked(text: Column) -> Column:
    """Each text with its spans replaced by ``[kind]``; a null text stays null."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([None if t is None else _mask(t, find_spans(t)) for t in texts], dtype=object)

    return clean(text)


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, a count for each base kind, ``base_sha256``, ``spans``, ``best_score`` of every row."""
    listed = docs.select(F.col(id_col).alias("doc_id"), spans(F.col(text_col)).alias("s"))

    def joined(s: Column) -> Column:
        return F.array_join(F.transform(s, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")

    def counted(kind: str) -> Column:
        return F.size(F.filter("s", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("s", lambda x: x["kind"].isin(*BASE))
    return listed.select(
        "doc_id",
        *map(counted, BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("s")).alias("spans"),
        F.array_max(F.transform("s", lambda x: x["score"])).alias("best_score"),
    )
