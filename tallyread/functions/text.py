"""White space as documents have it: wider than Spark's trim, wider than Java's ``\\s``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import let

#: Fixed value: the white-space characters, for use inside a character class.
WS = r"\t\n\x0B\f\r\x20\xA0\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}"

#: A text of visible ASCII and blanks, none at its ends.
PLAIN = r"\A[!-~](?:[\x20-~]*[!-~])?\z"
#: The same characters, for functions that take a set of characters.
WS_SET = "".join(map(chr, [*range(9, 14), 0x20, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000, 0xFEFF]))


def trim_left(text: Column) -> Column:
    return F.ltrim(text, F.lit(WS_SET))


def trim(text: Column) -> Column:
    return F.btrim(text, F.lit(WS_SET))


def collapse(text: Column) -> Column:
    """Trimmed, with each run of white space as one blank."""

    def rule(t: Column) -> Column:
        plain = F.rlike(t, F.lit(PLAIN)) & ~F.contains(t, F.lit("  "))
        return F.when(plain, t).otherwise(
            trim(F.regexp_replace(t, rf"[{WS}]{{2,}}|[\t\n\x0B\f\r\xA0\x{{1680}}-\x{{FEFF}}&&[{WS}]]", " "))
        )

    return let(text, rule)


def is_blank(text: Column) -> Column:
    return ~F.rlike(text, F.lit(rf"[^{WS}]"))


def quoted(text: str) -> str:
    """A pattern for exactly this text."""
    return rf"\Q{text}\E"
