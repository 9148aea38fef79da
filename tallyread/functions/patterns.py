"""Patterns that travel as data, and classification by ordered rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .text import WS

#: The longest source, and the shape of a quantified group in a group.
LONGEST_SOURCE = 1000
NESTED_QUANTIFIER = re.compile(r"\([^()+*]*[+*][^()]*\)\s*[+*]")
#: Shapes refused with ``strict`` besides: counted repeats, doubled groups, alternations.
STRICT_SHAPES = (
    re.compile(r"\([^()]*[+*}][^()]*\)\s*\{"),
    re.compile(r"\(\([^()]*[+*][^()]*\)\)\s*[+*]"),
    re.compile(r"\(([^()|]+)\|\1\)\s*[+*]"),
)
_WORD = "[A-Za-z0-9_]"
_BOUNDARY = rf"(?:(?<={_WORD})(?!{_WORD})|(?<!{_WORD})(?={_WORD}))"
_NO_BOUNDARY = rf"(?:(?<={_WORD})(?={_WORD})|(?<!{_WORD})(?!{_WORD}))"


@dataclass(frozen=True)
class RawPattern:
    """A pattern as JSON carries it."""

    source: str
    flags: str = ""

    def to_dict(self) -> dict[str, str]:
        return asdict(self)


@dataclass(frozen=True)
class Pattern:
    """A compiled pattern: the raw one and its form for the JVM."""

    raw: RawPattern
    java: str


#: What a refused pattern becomes: it matches nothing.
NEVER_MATCHES = Pattern(RawPattern("$^"), "(?!)")


def to_java(source: str, flags: str) -> str:
    """A pattern in the JVM's dialect: ASCII word boundaries, the wide white space, an end
    that is the end."""
    out, at, inside = [], 0, False
    while at < len(source):
        c = source[at]
        pair = source[at : at + 2]
        if c == "\\" and len(pair) == 2:
            if pair == r"\s":
                out.append(WS if inside else f"[{WS}]")
            elif pair == r"\S" and not inside:
                out.append(f"[^{WS}]")
            elif pair == r"\b" and not inside:
                out.append(_BOUNDARY)
            elif pair == r"\B" and not inside:
                out.append(_NO_BOUNDARY)
            elif pair == r"\/":
                out.append("/")
            else:
                out.append(pair)
            at += 2
            continue
        if c == "[":
            out.append(r"\[" if inside else "[")
            inside = True
        elif c == "]":
            out.append("]")
            inside = False
        elif c == "$" and not inside and "m" not in flags:
            out.append(r"\z")
        elif c == "&" and inside:
            out.append(r"\&")
        else:
            out.append(c)
        at += 1
    marks = ("iu" if "i" in flags else "") + ("m" if "m" in flags else "") + ("s" if "s" in flags else "")
    return (f"(?{marks})" if marks else "") + "".join(out)


def _compiles(java: str) -> bool:
    """Whether the JVM takes a pattern; where no JVM is at hand, whether Python does."""
    session = SparkSession.getActiveSession()
    jvm = getattr(session, "_jvm", None) if session else None
    if jvm is not None:
        try:
            jvm.java.util.regex.Pattern.compile(java)
            return True
        except Exception:  # noqa: BLE001  the gateway's own error type varies
            return False
    try:
        re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: "\\u" + m[1].zfill(4), java.replace(r"\z", r"\Z")))
        return True
    except re.error:
        return False


def compile_pattern(raw: RawPattern, case_insensitive: bool = False, strict: bool = False) -> Pattern:
    """A pattern to use, or one that never matches where it cannot be trusted."""
    if len(raw.source) > LONGEST_SOURCE or NESTED_QUANTIFIER.search(raw.source):
        return NEVER_MATCHES
    if strict and any(shape.search(raw.source) for shape in STRICT_SHAPES):
        return NEVER_MATCHES
    flags = raw.flags + ("i" if case_insensitive and "i" not in raw.flags else "")
    if not set(flags) <= set("dgimsuvy") or len(set(flags)) != len(flags):
        return NEVER_MATCHES
    java = to_java(raw.source, flags)
    return Pattern(RawPattern(raw.source, flags), java) if _compiles(java) else NEVER_MATCHES


def compile_patterns(raw: Sequence[RawPattern], **options) -> list[Pattern]:
    return [compile_pattern(one, **options) for one in raw]


def to_raw_pattern(pattern: Pattern) -> RawPattern:
    return pattern.raw


def to_raw_patterns(patterns: Sequence[Pattern]) -> list[RawPattern]:
    return [p.raw for p in patterns]


def count_matches(text: Column, pattern: Pattern) -> Column:
    """How often a pattern matches in a text."""
    return F.regexp_count(text, F.lit(pattern.java))


@dataclass(frozen=True)
class PatternSet:
    """Patterns that must all match, each so many times."""

    all: Sequence[Pattern]
    occurrences: int = 1


@dataclass(frozen=True)
class Requirement:
    """One of the sets holds; with ``absent``, none does."""

    any_of: Sequence[PatternSet]
    absent: bool = False


@dataclass(frozen=True)
class DocumentKind:
    name: str
    requires: Sequence[Requirement] = field(default_factory=tuple)


def _matches(text: Column, pattern: Pattern, times: int) -> Column:
    if times <= 0:
        return F.lit(True)
    return F.rlike(text, F.lit(pattern.java)) if times == 1 else count_matches(text, pattern) >= times


def requirement_holds(text: Column, requirement: Requirement) -> Column:
    """Whether a text meets a requirement."""
    holds = F.lit(False)
    for one in requirement.any_of:
        every = F.lit(True)
        for pattern in one.all:
            every = every & _matches(text, pattern, one.occurrences)
        holds = holds | every
    return ~holds if requirement.absent else holds


def classify_document(text: Column, kinds: Sequence[DocumentKind]) -> Column:
    """Name of the first kind whose requirements all hold, null if none."""
    out = F.lit(None).cast("string")
    for kind in reversed(kinds):
        holds = F.lit(True)
        for requirement in kind.requires:
            holds = holds & requirement_holds(text, requirement)
        out = F.when(holds, F.lit(kind.name)).otherwise(out)
    return out
