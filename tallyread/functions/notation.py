"""Numbers and dates as documents write them.

All of it is Column expressions.  Null means that the text is not read, never a guess.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import indices, let
from .text import WS, trim, trim_left

#: Blanks and marks inside a number, marks that are no part of one.
IN_NUMBER = r"\x20\t\xA0\x{202F}\x{2009}'"
NOT_IN_NUMBER = rf"[€$£¥{WS}']"
#: The shapes of dates.
DELIMITED = r"(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"
LEADING_ISO = r"^(\d{4})-(\d{2})-(\d{2})"
LEADING_DELIMITED = r"^(\d{1,2})[/\-.](\d{1,2})[/\-.](\d{2,4})"
LEADING_DAY_MONTH = r"^(\d{1,2})[/\-.](\d{1,2})(?!\d)"
#: A plain amount, with blanks between thousands and a decimal comma.
PLAIN_AMOUNT = r"\A-?\d{1,3}(?:\x20\d{3}){0,5},\d{2}\z"
LEADING_NAMED = rf"^(\d{{1,2}})[{WS}]{{1,4}}([\p{{L}}.]{{3,12}})\.?[{WS}]{{1,4}}(\d{{4}})"


@dataclass(frozen=True)
class Notation:
    """Order of day and month, and month names (lower case, no accents) as 1 to 12."""

    date_order: str = "DMY"
    months: Mapping[str, int] | None = None


def number_token(decimals: int | None = None) -> str:
    """Pattern of a number in a line; ``decimals`` asks for exactly so many."""
    fraction = r"(?:[.,]\d+)?" if decimals is None else rf"[.,]\d{{{decimals}}}(?!\d)"
    whole = rf"(?:\d{{1,3}}(?:[{IN_NUMBER}.]\d{{3}})+|\d+)"
    return rf"(?<![\d.,/])[-+]?\(?[{IN_NUMBER}]{{0,12}}{whole}{fraction}\)?-?"


def _without(text: Column, marks: str) -> Column:
    return F.regexp_replace(text, marks, "")


def _decimal_point(digits: Column) -> Column:
    """Digits whose decimal mark, if any, is a point."""

    def rule(d: Column) -> Column:
        size = F.length(d)
        comma = size - F.instr(F.reverse(d), ",")  # of the last one, from 0
        point = size - F.instr(F.reverse(d), ".")
        has_comma, has_point = F.contains(d, F.lit(",")), F.contains(d, F.lit("."))
        last = F.when(has_comma, comma).otherwise(point)
        behind = size - last - 1
        parted = F.concat(
            _without(F.substr(d, F.lit(1), last), "[.,]"), F.lit("."), F.substr(d, last + 2)
        )
        return (
            F.when(
                has_comma & has_point,
                F.when(comma > point, F.regexp_replace(_without(d, r"\."), "^([^,]*),", "$1.")).otherwise(
                    _without(d, ",")
                ),
            )
            .when(~has_comma & ~has_point, d)
            .when((behind >= 1) & (behind <= 2), parted)
            .otherwise(_without(d, "[.,]"))
        )

    return let(digits, rule)


def read_number(raw: Column, strict: bool = False) -> Column:
    """The number that a text holds (double), null if none.

    ``strict`` also refuses a text that is not one number and nothing else.
    """

    def rule(t: Column) -> Column:
        bracketed = F.rlike(t, F.lit(r"\A\([^\n\r\x{2028}\x{2029}]*\)\z"))
        inner = F.when(bracketed, F.substr(t, F.lit(2), F.length(t) - 2)).otherwise(t)
        minus = bracketed | F.rlike(inner, F.lit(r"-\z")) | F.rlike(inner, F.lit(r"\A-"))
        body = F.regexp_replace(inner, r"-\z", "")
        body = F.regexp_replace(F.regexp_replace(body, r"\A-", ""), r"\A\+", "")
        digits = _without(body, NOT_IN_NUMBER)

        def value(d: Column) -> Column:
            prefix = F.regexp_extract(_decimal_point(d), r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?", 0)
            number = let(prefix, lambda digits: F.when(digits != "", digits).cast("double"))
            return F.when(
                F.rlike(d, F.lit(r"\d")), let(number, lambda x: F.when(F.abs(x) < float("inf"), x))
            )

        found = let(digits, value)
        # Most amounts need none of the rules.
        plain = F.translate(t, ", ", ".").cast("double")
        return F.when(F.rlike(t, F.lit(PLAIN_AMOUNT)), plain).when(minus, -found).otherwise(found)

    out = let(trim(raw), rule)
    return F.when(is_only_number(raw), out) if strict else out


def find_numbers(text: Column, decimals: int | None = None) -> Column:
    """Numbers in a line, in order: array of (value, raw, index from 0)."""
    token = number_token(decimals)

    def found(raws: Column, gaps: Column) -> Column:
        return F.transform(
            indices(F.size(raws)),
            lambda i: F.struct(
                read_number(F.get(raws, i)).alias("value"),
                F.get(raws, i).alias("raw"),
                (
                    F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), ""))
                    + F.length(F.array_join(F.slice(raws, F.lit(1), i), ""))
                ).alias("index"),
            ),
        )

    every = let(
        F.split(text, token, -1),
        lambda gaps: let(F.regexp_extract_all(text, F.lit(token), F.lit(0)), lambda raws: found(raws, gaps)),
    )
    return F.filter(every, lambda n: n["value"].isNotNull())


def is_only_number(text: Column, decimals: int | None = None) -> Column:
    """Whether the whole text is one number."""
    # A match behind the start is no whole text, so only the start is tried.
    token = rf"\A{number_token(decimals)}"
    return let(trim(text), lambda t: (t != "") & (F.length(F.regexp_extract(t, token, 0)) == F.length(t)))


def make_date(year: Column, month: Column, day: Column) -> Column:
    """A calendar date, null if there is no such day; years below 100 are of this century."""
    nought = F.lit(0).cast("decimal(8,6)")
    full = let(year, lambda y: F.when(y < 100, y + 2000).otherwise(y))
    return F.try_make_timestamp_ntz(full, month, day, F.lit(0), F.lit(0), nought).cast("date")


def _part(text: Column, pattern: str, group: int) -> Column:
    found = F.regexp_extract(text, pattern, group)
    return let(found, lambda digits: F.when(digits != "", digits).cast("int"))


def _day_first(first: Column, second: Column, notation: Notation) -> tuple[Column, Column]:
    return (second, first) if notation.date_order == "MDY" else (first, second)


def _numeric_date(text: Column, pattern: str, notation: Notation, year: Column | None = None) -> Column:
    day, month = _day_first(_part(text, pattern, 1), _part(text, pattern, 2), notation)
    return make_date(_part(text, pattern, 3) if year is None else year, month, day)


def read_date(text: Column, notation: Notation) -> Column:
    """The first delimited date of a text, null if that is no day."""
    return _numeric_date(text, DELIMITED, notation)


def _accents() -> tuple[str, str]:
    """Accented Latin letters and the letters below them, by their decomposition."""
    accented, plain = [], []
    for point in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        base = unicodedata.normalize("NFD", chr(point))[0]
        if base != chr(point):
            accented.append(chr(point))
            plain.append(base)
    return "".join(accented), "".join(plain)


def accent_free(text: Column) -> Column:
    """Lower case without accents."""
    accented, plain = _accents()
    return _without(F.translate(F.lower(text), accented, plain), r"\p{M}")


def read_leading_date(text: Column, notation: Notation, year: Column | int | None = None) -> Column:
    """The date that a text begins with: (date, length), length with skipped blanks.

    ``year`` serves dates without one; without it they are not read.
    """
    missing = F.lit(year) if isinstance(year, int) else year

    def rule(t: Column) -> Column:
        skipped = F.length(text) - F.length(t)

        def shape(date_of: Callable[[Column], Column], pattern: str) -> Column:
            def matched(m: Column) -> Column:
                length = skipped + F.length(m)
                found = lambda d: F.when(d.isNotNull(), F.struct(d.alias("date"), length.cast("int").alias("length")))
                return F.when(m != "", let(date_of(m), found))

            return let(F.regexp_extract(t, pattern, 0), matched)

        def numbers(m: Column, of: Callable[[Callable[[int], Column]], Column]) -> Column:
            return let(F.split(m, r"[/\-.]", -1), lambda parts: of(lambda i: F.get(parts, F.lit(i)).cast("int")))

        def iso(m: Column) -> Column:
            return numbers(m, lambda n: make_date(n(0), n(1), n(2)))

        def numeric(m: Column, given: Column | None = None) -> Column:
            def date(n: Callable[[int], Column]) -> Column:
                day, month = _day_first(n(0), n(1), notation)
                return make_date(n(2) if given is None else given, month, day)

            return numbers(m, date)

        # One character rules most texts out before their pattern is tried.
        iso_like = F.substr(t, F.lit(5), F.lit(1)) == "-"
        parted = F.substr(t, F.lit(2), F.lit(1)).isin("/", "-", ".") | F.substr(t, F.lit(3), F.lit(1)).isin("/", "-", ".")
        shapes = [F.when(iso_like, shape(iso, LEADING_ISO)), F.when(parted, shape(numeric, LEADING_DELIMITED))]
        if missing is not None:
            shapes.append(shape(lambda m: numeric(m, missing), LEADING_DAY_MONTH))
        if notation.months:
            table = F.create_map(*[F.lit(x) for pair in notation.months.items() for x in pair])
            name = F.regexp_replace(accent_free(F.regexp_extract(t, LEADING_NAMED, 2)), r"^([^.]*)\.", "$1")
            named = make_date(_part(t, LEADING_NAMED, 3), F.try_element_at(table, name), _part(t, LEADING_NAMED, 1))
            shapes.append(shape(lambda m: named, LEADING_NAMED))
        # All shapes begin with a digit: "0" to "9", before ":".
        return F.when((t >= "0") & (t < ":"), F.coalesce(*shapes))

    return let(trim_left(text), rule)
