"""Plain text as rows of placed fields: delimited, aligned by blanks, or whole lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at, count_where, indices, let
from ..functions.text import is_blank, quoted, trim, trim_left

#: Delimiters in the order in which they are tried; what parts aligned fields.
DELIMITERS = ("\t", ";", "|", ",")
ALIGNED_SEPARATOR = r" {2,}|\t+"
LEAST_SHARE = 0.8
ITEM = "struct<text:string,x:double,y:double,width:double>"
ROW = f"struct<y:double,text:string,items:array<{ITEM}>>"


def lines_of(text: Column) -> Column:
    """The lines of a text that are not blank."""
    return F.filter(F.split(text, r"\r?\n", -1), lambda line: ~is_blank(line))


def _usual_count(counts: Column) -> Column:
    """(n, -place, count): the commonest count, the first seen among equals."""
    distinct = F.array_distinct(counts)
    return F.array_max(
        F.transform(
            distinct,
            lambda c, i: F.struct(count_where(counts, lambda x: x == c).alias("n"), (-i).alias("place"), c.alias("count")),
        )
    )


def delimiter_of(lines: Column) -> Column:
    """The delimiter that lines are written with, null if none recurs."""

    def accepted(l: Column, mark: str) -> Column:
        counts = F.transform(l, lambda line: F.size(F.split(line, quoted(mark), -1)) - 1)
        return let(
            let(counts, _usual_count),
            lambda usual: (usual["count"] >= 1) & (usual["n"] >= F.size(l) * F.lit(LEAST_SHARE)),
        )

    def has(l: Column, mark: str) -> Column:
        return F.exists(l, lambda line: F.contains(line, F.lit(mark)))

    def rule(l: Column) -> Column:
        # Conditions stand outside of lambdas, so that they are not computed for each line; a mark that
        # no line has is not counted.
        aligned = count_where(l, lambda line: F.contains(line, F.lit("  "))) >= F.size(l) / F.lit(2.0)
        refused = (F.size(l) < 2) | has(l, '"')
        out = F.lit(None).cast("string")
        for mark in reversed(DELIMITERS):
            open_to = has(l, mark) & accepted(l, mark) if mark == "\t" else has(l, mark) & ~aligned & accepted(l, mark)
            out = F.when(open_to, F.lit(mark)).otherwise(out)
        return F.when(~refused, out)

    return let(lines, rule)


def aligned_fields(line: Column, y: Column) -> Column:
    """Fields parted by two blanks or tabs, each at the character where it starts."""

    def placed(parts: Column, marks: Column) -> Column:
        def field(part: Column, i: Column) -> Column:
            before = F.length(F.array_join(F.slice(parts, F.lit(1), i), "")) + F.length(
                F.array_join(F.slice(marks, F.lit(1), i), "")
            )

            def trimmed(text: Column) -> Column:
                blanks = F.when(text == part, F.lit(0)).otherwise(F.length(part) - F.length(trim_left(part)))
                return F.struct(
                    text.alias("text"),
                    (before + blanks).cast("double").alias("x"),
                    y.alias("y"),
                    F.length(text).cast("double").alias("width"),
                )

            return let(trim(part), trimmed)

        return F.filter(F.transform(parts, field), lambda f: f["text"] != "")

    marks = F.regexp_extract_all(line, F.lit(ALIGNED_SEPARATOR), F.lit(0))
    return let(marks, lambda m: let(F.split(line, ALIGNED_SEPARATOR, -1), lambda parts: placed(parts, m)))


def delimited_fields(line: Column, delimiter: Column, y: Column) -> Column:
    """Fields between delimiters, each at its index; empty ones give none."""
    parts = F.split(line, F.concat(F.lit(r"\Q"), delimiter, F.lit(r"\E")), F.lit(-1))
    every = F.transform(
        parts,
        lambda part, i: F.struct(
            trim(part).alias("text"), i.cast("double").alias("x"), y.alias("y"), F.lit(1.0).alias("width")
        ),
    )
    return F.filter(every, lambda f: f["text"] != "")


def page_from_text(text: Column) -> Column:
    """(unit, rows): a text as one page; null text has no rows."""

    def page(l: Column) -> Column:
        def with_mark(mark: Column) -> Column:
            def row(line: Column, i: Column) -> Column:
                y = -i.cast("double")
                items = F.when(mark.isNull(), aligned_fields(line, y)).otherwise(delimited_fields(line, mark, y))
                return F.struct(y.alias("y"), line.alias("text"), items.alias("items"))

            return F.struct(
                F.when(mark.isNull(), F.lit("characters")).otherwise(F.lit("index")).alias("unit"),
                F.transform(l, row).alias("rows"),
            )

        return let(delimiter_of(l), with_mark)

    return let(lines_of(F.coalesce(text, F.lit(""))), page)


def pages_from_texts(texts: DataFrame) -> DataFrame:
    """(doc_id, name, text) as pages (doc_id, name, origin, page, width, height, unit,
    rows), one per text; the text itself stays behind."""
    made = texts.select("doc_id", "name", page_from_text(F.col("text")).alias("made"))
    return made.select(
        "doc_id",
        "name",
        F.lit("text").alias("origin"),
        F.lit(1).alias("page"),
        F.lit(0.0).alias("width"),
        F.lit(0.0).alias("height"),
        F.col("made.unit").alias("unit"),
        F.col("made.rows").alias("rows"),
    )


def rows_without_items(lines: Column) -> Column:
    """Lines as rows that carry text alone."""
    none = F.array().cast(f"array<{ITEM}>")
    return F.transform(lines, lambda line, i: F.struct((-i).cast("double").alias("y"), line.alias("text"), none.alias("items")))


def numbered(array: Column) -> Column:
    """(index, value) pairs, for explode without losing order."""
    return F.transform(indices(F.size(array)), lambda i: F.struct(i.alias("index"), at(array, i).alias("value")))
