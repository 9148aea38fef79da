"""What columns hold, what part they play, and which rows break their table's signature.

A table is an array of rows of cells inside one DataFrame row.  A kind is named by a
function from a cell's Column to a Column (null for no kind); it stays inside Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.arrays import at, count_where, indices, let
from ..functions.text import trim

SAMPLE_LIMIT = 200
MINIMUM_ROWS = 5
FILLED_THRESHOLD = 0.9
KindOf = Callable[[Column], Column]


def no_kind(cell: Column) -> Column:
    return F.lit(None).cast("string")


def cell_at(row: Column, column: Column | int) -> Column:
    """A trimmed cell, empty where the row is too short."""
    return trim(F.coalesce(at(row, column), F.lit("")))


def column_count(rows: Column) -> Column:
    """Cells of the widest row, 0 without rows."""
    return F.coalesce(F.array_max(F.transform(rows, F.size)), F.lit(0))


def kinds_by_column(rows: Column, kind_of: KindOf, width: Column) -> Column:
    """Of each column, of all rows: (filled, kind) of the cell, the kind null where it is empty."""

    def one(column: Column) -> Column:
        return F.transform(
            rows,
            lambda row: let(
                cell_at(row, column),
                lambda cell: F.struct((cell != "").alias("filled"), F.when(cell != "", kind_of(cell)).alias("kind")),
            ),
        )

    return F.transform(indices(width), one)


def profiles_of(kinds: Column, sample_limit: int = SAMPLE_LIMIT) -> Column:
    """Profiles of columns by ``kinds_by_column``, of the first rows."""

    def one(column: Column) -> Column:
        def counted(sampled: Column) -> Column:
            n = F.size(sampled).cast("double")
            named = F.transform(F.filter(sampled, lambda c: c["kind"].isNotNull()), lambda c: c["kind"])
            return F.struct(
                let(
                    named,
                    lambda ks: F.transform(
                        F.array_distinct(ks),
                        lambda k: F.struct(k.alias("kind"), (count_where(ks, lambda x: x == k) / n).alias("share")),
                    ),
                ).alias("shares"),
                (count_where(sampled, lambda c: c["filled"]) / n).alias("share_filled"),
            )

        return let(F.slice(column, 1, sample_limit), counted)

    return F.transform(kinds, one)


def profile_columns(rows: Column, kind_of: KindOf = no_kind, sample_limit: int = SAMPLE_LIMIT) -> Column:
    """Of each column of the first rows: (shares: array of (kind, share) in the order in
    which kinds appear, share_filled), both out of all sampled rows."""
    return let(
        F.slice(rows, 1, sample_limit),
        lambda sampled: profiles_of(kinds_by_column(sampled, kind_of, column_count(sampled)), sample_limit),
    )


def share_of(profile: Column, kind: str) -> Column:
    """A kind's share in a profile, 0 if it does not appear."""
    found = F.filter(profile["shares"], lambda s: s["kind"] == kind)
    return F.coalesce(at(found, 0)["share"], F.lit(0.0))


def dominant_kind(profile: Column, thresholds: Mapping[str, float]) -> Column:
    """The kind with the greatest share among those that reach their threshold; the first
    that appears among equals."""
    if not thresholds:
        return F.when(F.size(profile["shares"]) < 0, F.lit(""))
    least = F.create_map(*[F.lit(x) for k, v in thresholds.items() for x in (k, float(v))])
    reached = F.transform(
        profile["shares"],
        lambda s, i: F.when(
            (s["share"] >= F.try_element_at(least, s["kind"])) & (s["share"] > 0),
            F.struct(s["share"].alias("share"), (-i).alias("place"), s["kind"].alias("kind")),
        ),
    )
    return F.array_max(F.filter(reached, lambda r: r.isNotNull()))["kind"]


def dominant_kinds(profiles: Column, thresholds: Mapping[str, float]) -> Column:
    return F.transform(profiles, lambda p: dominant_kind(p, thresholds))


@dataclass(frozen=True)
class RoleRule:
    """``take``: 'best' for the strongest column, 'each' for all that qualify.  ``among``:
    the share is out of all 'rows' or of the 'filled' cells."""

    role: str
    kind: str
    minimum: float
    take: str = "best"
    among: str = "rows"


def _share_for(profile: Column, rule: RoleRule) -> Column:
    share = share_of(profile, rule.kind)
    if rule.among != "filled":
        return share
    return F.when(profile["share_filled"] == 0, F.lit(0.0)).otherwise(F.try_divide(share, profile["share_filled"]))


def assign_roles(profiles: Column, rules: Sequence[RoleRule]) -> Column:
    """A role per column, null where none is earned; rules in order, taken columns leave."""

    def apply(own: Column, roles: Column, rule: RoleRule) -> Column:
        def open_shares(held: Column) -> Column:
            return F.transform(
                own,
                lambda p, i: F.when(
                    at(held, i).isNull(), let(_share_for(p, rule), lambda s: F.when(s >= rule.minimum, s))
                ),
            )

        def taken(held: Column) -> Column:
            def give(shares: Column) -> Column:
                if rule.take == "each":
                    mine = lambda i: at(shares, i).isNotNull()
                else:
                    best = F.array_position(shares, F.array_max(shares)) - 1
                    mine = lambda i: F.coalesce(i == best, F.lit(False))
                return F.transform(held, lambda role, i: F.when(mine(i), F.lit(rule.role)).otherwise(role))

            return let(open_shares(held), give)

        return let(roles, taken)

    def assigned(own: Column) -> Column:
        roles = F.transform(own, lambda p: F.lit(None).cast("string"))
        for rule in rules:
            roles = apply(own, roles, rule)
        return roles

    return let(profiles, assigned)


@dataclass(frozen=True)
class KindThreshold:
    """The share that makes a column one of a kind; the share of filled cells from which
    an empty cell of such a column is an anomaly (never, if None)."""

    share: float
    empty_is_anomaly_above: float | None = None


@dataclass(frozen=True)
class SignatureOptions:
    kind_of: KindOf
    thresholds: Mapping[str, KindThreshold]
    sample_limit: int = SAMPLE_LIMIT
    filled_threshold: float = FILLED_THRESHOLD
    minimum_rows: int = MINIMUM_ROWS
    judged: Collection[int] | Callable[[Column], Column] | None = field(default=None)


def thresholds_for(kinds: Sequence[str], share: float) -> dict[str, KindThreshold]:
    return {kind: KindThreshold(share) for kind in kinds}


def shares_by_kind(options: SignatureOptions) -> dict[str, float]:
    return {kind: t.share for kind, t in options.thresholds.items()}


_ANOMALY = "struct<cause:string,column:int,expected:string,kind:string>"


def _anomaly(cause: str, column: Column, expected: Column | None = None, kind: Column | None = None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        F.lit(cause).alias("cause"),
        column.alias("column"),
        (none if expected is None else expected).alias("expected"),
        (none if kind is None else kind).alias("kind"),
    ).cast(_ANOMALY)


def _anomaly_in_cell(cell: Column, profile: Column, kind: Column, column: Column, options: SignatureOptions) -> Column:
    """``cell``: (filled, kind), as in ``kinds_by_column``."""
    empty_above = F.lit(None).cast("double")
    for name, threshold in options.thresholds.items():
        if threshold.empty_is_anomaly_above is not None:
            empty_above = F.when(kind == name, F.lit(float(threshold.empty_is_anomaly_above))).otherwise(empty_above)
    filled = profile["share_filled"]
    other = ~F.coalesce(cell["kind"] == kind, F.lit(False))
    return F.when(
        cell["filled"], F.when(kind.isNotNull() & other, _anomaly("wrong-kind", column, expected=kind))
    ).otherwise(
        F.when(kind.isNotNull() & (filled >= empty_above), _anomaly("empty", column, kind=kind)).when(
            filled >= options.filled_threshold, _anomaly("empty", column)
        )
    )


def find_row_anomalies(rows: Column, options: SignatureOptions) -> Column:
    """Each row's first departure from the table's signature (null where it holds); null
    for a table with too few rows.  Columns that the sampled rows lack judge nobody."""

    def learned(own: Column) -> Column:
        width = column_count(F.slice(own, 1, options.sample_limit))
        found = let(
            kinds_by_column(own, options.kind_of, width),
            lambda kinds: let(profiles_of(kinds, options.sample_limit), lambda p: anomalies_of(own, kinds, p, options)),
        )
        return F.when(F.size(own) >= options.minimum_rows, found)

    return let(rows, learned)


def anomalies_of(rows: Column, cell_kinds: Column, profiles: Column, options: SignatureOptions) -> Column:
    """``find_row_anomalies`` of rows whose ``kinds_by_column`` and profiles are known."""
    judged = options.judged
    if judged is None:
        is_judged = lambda c: F.lit(True)
    elif callable(judged):
        is_judged = judged
    else:
        is_judged = lambda c: c.isin(*judged) if judged else F.lit(False)

    def with_kinds(kinds: Column) -> Column:
        judged_columns = F.filter(indices(F.size(profiles)), is_judged)
        return let(judged_columns, lambda columns: with_columns(kinds, columns))

    def with_columns(kinds: Column, columns: Column) -> Column:
        def row_anomaly(row: Column, i: Column) -> Column:
            each = F.transform(
                columns,
                lambda c: _anomaly_in_cell(at(at(cell_kinds, c), i), at(profiles, c), at(kinds, c), c, options),
            )
            return at(F.filter(each, lambda a: a.isNotNull()), 0)

        return F.transform(rows, row_anomaly)

    return let(dominant_kinds(profiles, shares_by_kind(options)), with_kinds)


def describe_anomaly(anomaly: Column) -> Column:
    """An anomaly in words."""
    where = F.when(anomaly["kind"].isNull(), F.lit("")).otherwise(F.concat(F.lit(" ("), anomaly["kind"], F.lit(")")))
    number = anomaly["column"].cast("string")
    return F.when(
        anomaly["cause"] == "wrong-kind", F.concat(F.lit("column "), number, F.lit(" is not "), anomaly["expected"])
    ).when(anomaly["cause"] == "empty", F.concat(F.lit("column "), number, where, F.lit(" is empty")))
