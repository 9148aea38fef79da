"""Array expressions that stay inside one row: no shuffle, whatever their size."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def indices(size: Column) -> Column:
    """0 to size - 1; empty for size 0 (a plain sequence would count down)."""
    return F.when(size > 0, F.sequence(F.lit(0), F.greatest(size, F.lit(1)) - 1)).otherwise(
        F.array().cast("array<int>")
    )


def at(array: Column, index: Column | int) -> Column:
    """The element at an index from 0, null outside of the array."""
    return F.get(array, F.lit(index) if isinstance(index, int) else index)


def count_where(array: Column, holds: Callable[[Column], Column]) -> Column:
    return F.size(F.filter(array, holds))


def total(array: Column) -> Column:
    """Sum of an array of whole numbers."""
    return F.aggregate(array, F.lit(0), lambda s, x: s + x.cast("int"))


def half_up(x: Column) -> Column:
    """Rounded to whole, halves up."""
    return F.floor(x + F.lit(0.5)).cast("int")


def midpoints(sorted_values: Column) -> Column:
    """The middle of each two neighbours."""
    return F.transform(
        F.filter(indices(F.size(sorted_values)), lambda i: i > 0),
        lambda i: (at(sorted_values, i - 1) + at(sorted_values, i)) / F.lit(2.0),
    )
