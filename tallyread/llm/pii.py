"""Personal data: patterns propose spans, checksums confirm them, context adjusts.

Base kinds and their rules (leftmost non-overlapping matches of each kind; matches that
fail their check are dropped without another try):

* email  ``[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+``
* ip     four groups of digits with points, each at most 255
* card   digits with single blanks or hyphens between, 14 to 19 digits, Luhn
* phone  a plus sign, digits, blanks and ``().-``, 10 to 15 digits

Added kinds: ``iban`` (country code, check digits, mod-97 = 1) and ``ssn`` (three-two-four
digits with hyphens), which is reported only where a nearby context word lifts its score.
A span's score is its kind's base score plus a bonus for a context word within
``CONTEXT_CHARS`` code points before it; spans below ``MINIMUM_SCORE`` are dropped.  Base
kinds never fall below it.

Positions are code points, end exclusive.  Null text is the empty text; repeated rows
give repeated results; other columns are ignored; texts are never cut.  All patterns run
in time proportional to the text (possessive groups).
"""

from __future__ import annotations

import copy
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType

from .common import begin, in_arrow, slices, whole_text

#: Kinds in their order, and the base ones among them.
KINDS = ("email", "ip", "card", "phone", "iban", "ssn")
BASE_KINDS = KINDS[:4]
BASE_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.4}
CONTEXT_WORDS = {
    "email": ("email", "mail", "contact"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "mastercard", "credit", "debit"),
    "phone": ("phone", "tel", "call", "mobile", "fax"),
    "iban": ("iban", "account", "bank"),
    "ssn": ("ssn", "social security"),
}
CONTEXT_BONUS = 0.35
CONTEXT_CHARS = 40
MINIMUM_SCORE = 0.5

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}(?![A-Za-z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_ODD = str.maketrans("", "", " -")
_PHONE_MARKS = str.maketrans("", "", "+ ().-")


def luhn(digits: str) -> bool:
    """Whether a string of digits passes the Luhn check."""
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = ord(digit) - 48
        if place % 2:
            value *= 2
            if value > 9:
                value -= 9
        total += value
    return total % 10 == 0


def mod_97(account: str) -> bool:
    """Whether an account number passes the mod-97 check (letters are 10 to 35)."""
    moved = account[4:] + account[:4]
    number = "".join(c if c.isdigit() else str(ord(c) - 55) for c in moved)
    return int(number) % 97 == 1


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern, found from their @ signs outwards."""
    floor, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (domain := _DOMAIN.match(text, at + 1)):
            yield start, domain.end()
            floor = domain.end()
        else:
            floor = at + 1
        at = text.find("@", max(floor, at + 1))


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for match in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in match[0].split(".")):
            yield match.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for match in _CARD.finditer(text):
        if match.end() - match.start() >= 14:
            digits = match[0].translate(_ODD)
            if 14 <= len(digits) <= 19 and luhn(digits):
                yield match.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for match in _PHONE.finditer(text):
        if 10 <= len(match[0].translate(_PHONE_MARKS)) <= 15:
            yield match.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for match in _IBAN.finditer(text):
        account = match[0].replace(" ", "")
        if 15 <= len(account) <= 34 and mod_97(account):
            yield match.span()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for match in _SSN.finditer(text):
        area, group, serial = match[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield match.span()


_FINDERS = {"email": emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}
_DIGIT = re.compile(r"[0-9]")


def score_of(text: str, kind: str, start: int) -> float:
    """A span's score: its kind's base score, more after a context word."""
    near = text[max(0, start - CONTEXT_CHARS) : start].lower()
    bonus = CONTEXT_BONUS if any(word in near for word in CONTEXT_WORDS[kind]) else 0.0
    return min(1.0, BASE_SCORE[kind] + bonus)


def find_spans(text: str) -> list[tuple[int, int, str, float]]:
    """(start, end, kind, score) of all spans, by start, then by the order of KINDS."""
    found = [(s, KINDS.index("email"), e) for s, e in emails(text)] if "@" in text else []
    if first := _DIGIT.search(text):
        skip = max(0, first.start() - 4)
        part = text[skip:]  # nothing but an email begins more than four places before a digit
        for kind in KINDS[1:]:
            found += [(s + skip, KINDS.index(kind), e + skip) for s, e in _FINDERS[kind](part)]
    found.sort()
    out = []
    for start, kind, end in found:
        score = score_of(text, KINDS[kind], start)
        if score >= MINIMUM_SCORE:
            out.append((start, end, KINDS[kind], score))
    return out


def mask(text: str, spans: list[tuple[int, int, str, float]]) -> str:
    """The text with each span replaced by its kind in brackets; of overlapping spans
    the union is replaced under the kind that begins first."""
    out, at = [], 0
    for start, end, kind, _ in spans:
        if end <= at:
            continue
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


def find_personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, counts of the base kinds, base_sha256, spans,
    best_score (highest score of a span, 0 if none)."""
    names = ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "best_score"]
    types = [pa.int64()] * 5 + [pa.string()] * 2 + [pa.float64()]
    out = pa.schema(list(zip(names, types)))

    def row(doc_id, text):
        spans = find_spans(text)
        base = [f"{k}:{s}:{e}" for s, e, k, _ in spans if k in BASE_KINDS]
        counts = [sum(k == kind for _, _, k, _ in spans) for kind in BASE_KINDS]
        digest = hashlib.sha256(",".join(base).encode()).hexdigest()
        listed = ",".join(f"{k}:{s}:{e}" for s, e, k, _ in spans)
        return (doc_id, *counts, digest, listed, max((x for *_, x in spans), default=0.0))

    def run(batches):
        begin("pii")
        for batch in batches:
            rows = []
            for part in slices(batch):
                rows += map(row, part.column(0).to_pylist(), part.column(1).to_pylist())
            columns = zip(*rows) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], schema=out
            )

    columns = docs.select(docs["doc_id"].cast("long").alias("doc_id"), whole_text().alias("text"))
    return in_arrow(
        columns,
        run,
        "doc_id long, n_email long, n_ip long, n_card long, n_phone long, "
        "base_sha256 string, spans string, best_score double",
    )


def mask_personal_data(docs: DataFrame) -> DataFrame:
    """The documents with their personal data masked and n_chars counted anew.

    Columns and rows stay, repeated rows too; a null text stays null with its n_chars, an
    empty one stays empty; an empty table gives none."""

    names = [name.lower() for name in docs.columns]
    at = names.index("text")
    counted = names.index("n_chars") if "n_chars" in names else None
    schema = copy.deepcopy(docs.schema)
    schema.fields[at].dataType = StringType()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("pii")
        for batch in batches:
            for part in slices(batch):
                texts = part.column(at).cast(pa.string()).to_pylist()
                masked = [None if t is None else mask(t, find_spans(t)) for t in texts]
                columns = part.columns
                columns[at] = pa.array(masked, pa.string())
                if counted is not None:
                    lengths = pa.array([None if t is None else len(t) for t in masked], pa.int64())
                    columns[counted] = pc.coalesce(lengths.cast(columns[counted].type), columns[counted])
                yield pa.RecordBatch.from_arrays(columns, names=docs_names)

    docs_names = docs.columns
    return in_arrow(docs, run, schema)
