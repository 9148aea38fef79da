"""Where a page is cut: columns from left edges, rows from baselines, cells from both.

Items are (text, x, y, width) and rows (y, text, items).  A page is one row of a
DataFrame, so that cutting shuffles nothing; a page's items are bounded by the reader's
size cap.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import at, half_up, indices, let, midpoints
from ..functions.text import collapse, is_blank, trim
from ..sources.text import ITEM

#: The gap between columns by the ruler of x, and the height of a row.
GAPS = {"points": 18.0, "characters": 2.0, "index": 0.0}
SAME_ROW = 3.0
LEAST_SUPPORT = 0.15
LEAST_ROWS = 2


def gap_for(unit: Column | str | None = "points") -> Column:
    """The gap that a page is cut by; a page without a unit is measured in points."""
    if unit is None or isinstance(unit, str):
        return F.lit(GAPS[unit or "points"])
    out = F.lit(GAPS["points"])
    for name, gap in GAPS.items():
        out = F.when(unit == name, F.lit(gap)).otherwise(out)
    return out


def _as_gap(gap: Column | float) -> Column:
    return gap if isinstance(gap, Column) else F.lit(float(gap))


def column_boundaries(items: Column, gap: Column | float = GAPS["points"]) -> Column:
    """Cuts wherever neighbouring left edges of the page are further apart than the gap."""
    edges = F.array_sort(F.transform(F.filter(items, lambda i: ~is_blank(i["text"])), lambda i: i["x"]))

    def cut(xs: Column, wide: Column) -> Column:
        return F.transform(
            F.filter(indices(F.size(xs)), lambda i: (i > 0) & (at(xs, i) - at(xs, i - 1) > wide)),
            lambda i: (at(xs, i - 1) + at(xs, i)) / F.lit(2.0),
        )

    return let(edges, lambda xs: let(_as_gap(gap), lambda wide: cut(xs, wide)))


def boundaries_from_anchors(anchors: Column) -> Column:
    """Cuts halfway between anchors, in any order."""
    return let(F.array_sort(anchors), midpoints)


def _bands(edges: Column, gap: Column) -> Column:
    """Runs of (x, row) in order of x without a step over the gap: (low, high, support)."""

    def runs(e: Column) -> Column:
        starts = F.filter(
            indices(F.size(e)), lambda i: (i == 0) | (at(e, i)["x"] - at(e, i - 1)["x"] > gap)
        )

        def band(s: Column) -> Column:
            def one(start: Column, k: Column) -> Column:
                stop = F.coalesce(at(s, k + 1), F.size(e))
                members = F.slice(e, start + 1, stop - start)
                return F.struct(
                    at(e, start)["x"].alias("low"),
                    at(e, stop - 1)["x"].alias("high"),
                    F.size(F.array_distinct(F.transform(members, lambda m: m["row"]))).alias("support"),
                )

            return F.transform(s, one)

        return let(starts, band)

    return let(edges, runs)


def boundaries_from_recurrence(
    rows: Column, minimum_support: float = LEAST_SUPPORT, gap: Column | float = GAPS["points"]
) -> Column:
    """Cuts between the bands of left edges that come back row after row.

    A band that does not come back counts only where no band that does lies before it, or
    none behind it.
    """
    wide = _as_gap(gap)
    edges = F.sort_array(
        F.flatten(
            F.transform(
                rows,
                lambda r, i: F.transform(r["items"], lambda item: F.struct(item["x"].alias("x"), i.alias("row"))),
            )
        )
    )
    filled = F.size(F.filter(rows, lambda r: F.size(r["items"]) > 0))
    least = F.greatest(F.lit(LEAST_ROWS), half_up(filled * F.lit(float(minimum_support))))

    def cut(bands: Column, needed: Column) -> Column:
        strong = F.transform(
            F.filter(indices(F.size(bands)), lambda i: at(bands, i)["support"] >= needed), lambda i: i
        )

        def keep(s: Column) -> Column:
            first = F.coalesce(F.array_min(s), F.size(bands))
            last = F.coalesce(F.array_max(s), F.lit(-1))
            kept = F.filter(
                bands,
                lambda b, i: (b["support"] >= needed) | (i <= first) | (i >= last),
            )
            return let(
                kept,
                lambda k: F.transform(
                    F.filter(indices(F.size(k)), lambda i: i > 0),
                    lambda i: (at(k, i - 1)["high"] + at(k, i)["low"]) / F.lit(2.0),
                ),
            )

        return let(strong, keep)

    return let(least, lambda needed: let(_bands(edges, wide), lambda bands: cut(bands, needed)))


def dropped_bands(rows: Column, minimum_support: float = LEAST_SUPPORT, gap: Column | float = GAPS["points"]) -> Column:
    """How many bands the recurrence cut merged into a neighbour."""
    wide = _as_gap(gap)
    edges = F.array_sort(
        F.flatten(F.transform(rows, lambda r, i: F.transform(r["items"], lambda t: F.struct(t["x"].alias("x"), i.alias("row")))))
    )
    kept = F.size(boundaries_from_recurrence(rows, minimum_support, gap))
    return F.greatest(F.size(_bands(edges, wide)) - 1 - kept, F.lit(0))


def column_at(x: Column, boundaries: Column) -> Column:
    """The column of a left edge; an edge on a cut belongs to its right."""
    return F.size(F.filter(boundaries, lambda b: x >= b))


def _join_row(items: Column, boundaries: Column) -> Column:
    """Texts of a row: a tab between columns, nothing inside one."""
    parts = F.transform(
        items,
        lambda item, i: F.concat(
            F.when(i == 0, F.lit(""))
            .when(column_at(at(items, i - 1)["x"], boundaries) == column_at(item["x"], boundaries), F.lit(""))
            .otherwise(F.lit("\t")),
            item["text"],
        ),
    )
    return trim(F.array_join(parts, ""))


def rows_from(items: Column, boundaries: Column) -> Column:
    """Items as rows: a row holds what lies within ``SAME_ROW`` of its first baseline."""
    ordered = F.array_sort(
        F.transform(
            F.filter(items, lambda i: ~is_blank(i["text"])),
            lambda item, i: F.struct((-item["y"]).alias("down"), item["x"].alias("x"), i.alias("place"), item.alias("item")),
        )
    )

    def grouped(o: Column) -> Column:
        begin = F.struct(F.lit(None).cast("double").alias("anchor"), F.array().cast("array<int>").alias("starts"), F.lit(0).alias("seen"))

        def step(state: Column, one: Column) -> Column:
            y = one["item"]["y"]
            new = state["anchor"].isNull() | (F.abs(state["anchor"] - y) > SAME_ROW)
            return F.struct(
                F.when(new, y).otherwise(state["anchor"]).alias("anchor"),
                F.when(new, F.concat(state["starts"], F.array(state["seen"]))).otherwise(state["starts"]).alias("starts"),
                (state["seen"] + 1).alias("seen"),
            )

        def rows(starts: Column) -> Column:
            def row(start: Column, k: Column) -> Column:
                stop = F.coalesce(at(starts, k + 1), F.size(o))
                left_first = F.array_sort(
                    F.transform(
                        F.slice(o, start + 1, stop - start),
                        lambda one, j: F.struct(one["x"].alias("x"), j.alias("place"), one["item"].alias("item")),
                    )
                )
                return let(
                    F.transform(left_first, lambda one: one["item"]),
                    lambda inside: F.struct(
                        at(inside, 0)["y"].alias("y"),
                        _join_row(inside, boundaries).alias("text"),
                        inside.alias("items"),
                    ),
                )

            return F.transform(starts, row)

        return let(F.aggregate(o, begin, step, lambda state: state["starts"]), rows)

    return let(ordered, grouped)


def page_from(items: Column) -> Column:
    """(rows, column_boundaries) of a page of items, cut over the whole page."""
    return let(
        column_boundaries(items),
        lambda cuts: F.struct(rows_from(items, cuts).alias("rows"), cuts.alias("column_boundaries")),
    )


def document_text(rows: Column) -> Column:
    """The texts of rows, one line each."""
    return F.array_join(F.transform(rows, lambda r: r["text"]), "\n")


def _by_column(row: Column, boundaries: Column, make) -> Column:
    def placed(columns: Column) -> Column:
        return F.transform(
            indices(F.size(boundaries) + 1),
            lambda c: make(F.filter(row["items"], lambda item, i: at(columns, i) == c)),
        )

    return let(F.transform(row["items"], lambda item: column_at(item["x"], boundaries)), placed)


def row_to_cells(row: Column, boundaries: Column) -> Column:
    """A row's cells; a row without items has its text in the first."""
    text_of = lambda items: collapse(F.array_join(F.transform(items, lambda i: i["text"]), " "))
    whole = F.transform(
        indices(F.size(boundaries) + 1), lambda c: F.when(c == 0, collapse(row["text"])).otherwise(F.lit(""))
    )
    return F.when(F.size(row["items"]) == 0, whole).otherwise(_by_column(row, boundaries, text_of))


def cells_of(rows: Column, boundaries: Column) -> Column:
    """All rows' cells."""
    return let(boundaries, lambda cuts: F.transform(rows, lambda row: row_to_cells(row, cuts)))


def place_of(items: Column, page: Column) -> Column:
    """Where items lie: (page, x, y, width), null for none."""
    left = F.array_min(F.transform(items, lambda i: i["x"]))
    right = F.array_max(F.transform(items, lambda i: i["x"] + i["width"]))
    return F.when(
        F.size(items) > 0,
        F.struct(page.alias("page"), left.alias("x"), at(items, 0)["y"].alias("y"), (right - left).alias("width")),
    )


def places_of(rows: Column, boundaries: Column, page: Column) -> Column:
    """Where the cells of all rows lie, laid out as the cells are."""
    return let(
        boundaries,
        lambda cuts: F.transform(rows, lambda row: _by_column(row, cuts, lambda items: place_of(items, page))),
    )


def items_array(texts: Column, xs: Column, ys: Column, widths: Column) -> Column:
    """Parallel arrays as an array of items."""
    return F.transform(
        F.arrays_zip(texts.alias("a"), xs.alias("b"), ys.alias("c"), widths.alias("d")),
        lambda z: F.struct(
            z["a"].alias("text"), z["b"].cast("double").alias("x"), z["c"].cast("double").alias("y"), z["d"].cast("double").alias("width")
        ),
    ).cast(f"array<{ITEM}>")
