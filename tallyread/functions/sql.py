"""Scalars under SQL names: temporary SQL functions, which the optimizer inlines.

Only what SQL text can state is registered; all else is used through Columns.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from .text import WS


def register(spark: SparkSession, prefix: str = "doc_") -> list[str]:
    """Registers the functions and returns their names."""
    ws = WS.replace("\\", "\\\\")
    bodies = {
        "trim": ("s STRING", "STRING", f"regexp_replace(s, '^[{ws}]+|[{ws}]+\\\\z', '')"),
        "collapse": (
            "s STRING",
            "STRING",
            f"regexp_replace(regexp_replace(s, '[{ws}]+', ' '), '^ | \\\\z', '')",
        ),
        "column_at": ("x DOUBLE, cuts ARRAY<DOUBLE>", "INT", "size(filter(cuts, b -> x >= b))"),
        "midpoints": (
            "xs ARRAY<DOUBLE>",
            "ARRAY<DOUBLE>",
            "zip_with(slice(array_sort(xs), 1, greatest(size(xs) - 1, 0)), "
            "slice(array_sort(xs), 2, greatest(size(xs) - 1, 0)), (a, b) -> (a + b) / 2.0D)",
        ),
        "make_date": (
            "y INT, m INT, d INT",
            "DATE",
            "cast(try_make_timestamp_ntz(if(y < 100, y + 2000, y), m, d, 0, 0, cast(0 as decimal(8,6))) as date)",
        ),
        "smallest_gap": (
            "declared ARRAY<DECIMAL(38,2)>, seen DECIMAL(38,2)",
            "DECIMAL(38,2)",
            "cast(array_min(transform(declared, (d, i) -> struct(abs(seen - d) as size, i as place, seen - d as gap))).gap as decimal(38,2))",
        ),
    }
    names = []
    for name, (arguments, returns, body) in bodies.items():
        full = prefix + name
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {full}({arguments}) RETURNS {returns} RETURN {body}")
        names.append(full)
    return names
