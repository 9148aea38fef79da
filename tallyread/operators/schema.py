"""Declared schemas of records: formats, bounds, required fields, a least count."""

from __future__ import annotations

import inspect
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Field:
    """``format``: 'year' and 'integer' are whole numbers, 'number' any; bounds count."""

    format: str
    required: bool = False
    minimum: float | None = None
    maximum: float | None = None


@dataclass(frozen=True)
class Schema:
    """``key``: its distinct values are counted instead of the records."""

    name: str
    fields: Mapping[str, Field]
    minimum_records: int
    key: str | None = None

    def to_dict(self) -> dict:
        return asdict(self)

    @staticmethod
    def from_dict(data: Mapping) -> Schema:
        fields = {name: Field(**one) for name, one in data["fields"].items()}
        return Schema(data["name"], fields, data["minimum_records"], data.get("key"))

    def to_struct_type(self) -> T.StructType:
        return T.StructType(
            [T.StructField(name, T.DoubleType(), not one.required) for name, one in self.fields.items()]
        )


def schema_of(name: str, minimum_records: int, key: str | None = None, **fields: Field) -> Schema:
    return Schema(name, fields, minimum_records, key)


def value_in(records: DataFrame, name: str) -> Column:
    """A record's number in a field; null where it has none or holds no number."""
    if name in records.columns and isinstance(records.schema[name].dataType, T.NumericType):
        return records[name].cast("double")
    return F.lit(None).cast("double")


def out_of_format(value: Column, rule: Field) -> Column:
    """Whether a number breaks a field's format; null for no number."""
    wrong = F.isnan(value) | (F.abs(value) == float("inf"))
    if rule.format != "number":
        wrong = wrong | (value != F.floor(value))
    if rule.minimum is not None:
        wrong = wrong | (value < rule.minimum)
    if rule.maximum is not None:
        wrong = wrong | (value > rule.maximum)
    return F.when(value.isNotNull(), wrong)


def conforms(records: DataFrame, schema: Schema) -> Column:
    """Whether a record carries what is required, all of it in format."""
    out = F.lit(True)
    for name, rule in schema.fields.items():
        value = value_in(records, name)
        out = out & ~F.coalesce(out_of_format(value, rule), F.lit(bool(rule.required)))
    return out


VIOLATION = "struct<cause:string,field:string,value:double,record_idx:bigint,conforming:bigint,expected:bigint>"


def _violation(cause: str, **parts: Column) -> Column:
    none = {"field": "string", "value": "double", "record_idx": "long", "conforming": "long", "expected": "long"}
    return F.struct(
        F.lit(cause).alias("cause"),
        *[parts.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in none.items()],
    ).cast(VIOLATION)


def _conforming(good: Column, key: Column | None) -> Column:
    """Records that count, or distinct keys of them, where no key at all is one more."""
    if key is None:
        return F.count_if(good)
    return F.count_distinct(F.when(good, key)) + F.coalesce(F.max((good & key.isNull()).cast("int")), F.lit(0))


def _too_few(conforming: Column, minimum: int) -> Column:
    return F.when(
        conforming < minimum, _violation("too-few-records", conforming=conforming, expected=F.lit(minimum))
    )


def validate(records: DataFrame, schema: Schema, by: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Each document's first broken rule (null if none): the first number out of format by
    record and field, else too few conforming records.

    ``records`` has the columns of ``by``, record_idx and the fields.
    """
    broken = F.array(
        *[
            F.when(
                out_of_format(value_in(records, name), rule),
                F.struct(
                    records["record_idx"].cast("long").alias("record_idx"),
                    F.lit(i).alias("place"),
                    F.lit(name).alias("field"),
                    value_in(records, name).alias("value"),
                ),
            )
            for i, (name, rule) in enumerate(schema.fields.items())
        ]
    )
    key = value_in(records, schema.key) if schema.key else None
    judged = records.select(
        *by,
        F.array_min(F.array_compact(broken)).alias("broken"),
        conforms(records, schema).alias("good"),
        (F.lit(None).cast("double") if key is None else key).alias("key"),
    )
    out = judged.groupBy(*by).agg(
        F.min("broken").alias("broken"),
        _conforming(F.col("good"), F.col("key") if schema.key else None).alias("conforming"),
    )
    first = _violation(
        "out-of-format", field=F.col("broken.field"), value=F.col("broken.value"), record_idx=F.col("broken.record_idx")
    )
    violation = F.when(F.col("broken").isNotNull(), first).otherwise(_too_few(F.col("conforming"), schema.minimum_records))
    return out.select(*by, violation.alias("violation"))


def validate_with(
    records: DataFrame,
    accepts: Column | Callable[[dict], list],
    minimum_records: int,
    key: str | None = None,
    by: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The counting rule over another validator: a boolean Column, or a function from a
    record to its list of issues (run in batches; it may not be asynchronous)."""
    if isinstance(accepts, Column):
        good = F.coalesce(accepts, F.lit(False))
    else:
        if inspect.iscoroutinefunction(accepts):
            raise TypeError("validate_with cannot use a schema that validates asynchronously")

        @F.pandas_udf("boolean")
        def judged(rows):
            return rows.apply(lambda row: not accepts(row.to_dict()), axis=1).astype(bool)

        good = judged(F.struct(*[records[c] for c in records.columns]))
    own = value_in(records, key) if key else F.lit(None).cast("double")
    rows = records.select(*by, good.alias("good"), own.alias("key"))
    counted = rows.groupBy(*by).agg(_conforming(F.col("good"), F.col("key") if key else None).alias("conforming"))
    return counted.select(*by, _too_few(F.col("conforming"), minimum_records).alias("violation"))


@dataclass(frozen=True)
class Rule:
    """The counting rule by itself."""

    minimum_records: int
    key: str | None = field(default=None)
