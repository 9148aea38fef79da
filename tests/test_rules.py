import pytest
from pyspark.sql import functions as F

from tallyread.functions.patterns import (
    NEVER_MATCHES,
    DocumentKind,
    PatternSet,
    RawPattern,
    Requirement,
    classify_document,
    compile_pattern,
    compile_patterns,
    count_matches,
    to_raw_pattern,
    to_raw_patterns,
)
from tallyread.operators import schema as S


def p(source, flags="i"):
    return compile_pattern(RawPattern(source, flags))


def test_guard(spark):
    for bad in ("(a+)+", r"(\d*)*", "a" * 1001, "(", "[z-a]"):
        assert compile_pattern(RawPattern(bad)) == NEVER_MATCHES
    assert compile_pattern(RawPattern("a", "q")) == NEVER_MATCHES
    assert compile_pattern(RawPattern("(a+){2,}")) != NEVER_MATCHES
    assert compile_pattern(RawPattern("(a+){2,}"), strict=True) == NEVER_MATCHES
    assert compile_pattern(RawPattern("a"), case_insensitive=True).raw.flags == "i"
    assert to_raw_pattern(p("x", "g")) == RawPattern("x", "g")
    assert to_raw_patterns(compile_patterns([RawPattern("x")]))[0].to_dict() == {"source": "x", "flags": ""}


def count(spark, text, pattern):
    return spark.createDataFrame([(text,)], "t string").select(count_matches(F.col("t"), pattern)).first()[0]


def test_counts(spark):
    assert count(spark, "café cafe caf", p(r"\bcaf\b", "")) == 2
    assert count(spark, "Été été", p("été")) == 2
    assert count(spark, "a\n", p("a$", "")) == 0 and count(spark, "a", p("a$", "")) == 1
    assert count(spark, "a b", p(r"a\sb", "")) == 1
    assert count(spark, "aaa", NEVER_MATCHES) == 0


def test_classify(spark):
    iban = PatternSet([p(r"\bFR\d{2}", "")])
    kinds = [
        DocumentKind("loan", [Requirement([PatternSet([p("loan"), p("rate")])])]),
        DocumentKind("account", [Requirement([iban, PatternSet([p("balance")], 2)])]),
        DocumentKind("invoice", [Requirement([PatternSet([p("invoice")])]), Requirement([PatternSet([p("quote")])], absent=True)]),
        DocumentKind("nothing", [Requirement([])]),
    ]
    texts = {"Loan at a RATE": "loan", "loan only": None, "FR76 x": "account", "balance": None, "balance, balance": "account", "invoice": "invoice", "invoice, quote": None, "": None}
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert {r["t"]: r["k"] for r in rows.select("t", classify_document(F.col("t"), kinds).alias("k")).collect()} == texts
    assert spark.range(1).select(classify_document(F.lit("x"), [DocumentKind("any", [])])).first()[0] == "any"


YEARS = S.schema_of(
    "career", 2, "year",
    year=S.Field("year", True, 1930, 2030), quarters=S.Field("integer", False, 0, 4), pay=S.Field("number", False, 0),
)
RECORD = "doc_id string, record_idx long, year double, quarters double, pay double"


def violations(spark, rows, schema=YEARS):
    got = S.validate(spark.createDataFrame(rows, RECORD), schema).collect()
    return {r["doc_id"]: r["violation"] and tuple(x for x in r["violation"] if x is not None) for r in got}


def test_validate(spark):
    nan = float("nan")
    got = violations(
        spark,
        [
            ("ok", 0, 1990.0, 4.0, 10.0), ("ok", 1, 1991.0, None, None),
            ("few", 0, 1990.0, 1.0, 1.0), ("few", 1, 1990.0, 2.0, 1.0),
            ("null-key", 0, 1990.0, 1.0, 1.0), ("null-key", 1, None, 2.0, 1.0),
            ("range", 0, 1990.0, 1.0, 1.0), ("range", 1, 1991.0, 9.0, -1.0),
            ("fraction", 0, 1990.5, 1.0, 1.0), ("nan", 0, 1990.0, 1.0, nan),
            ("late", 7, 2031.0, 1.0, 1.0), ("late", 3, 1990.0, 5.0, 1.0),
        ],
    )
    assert got["ok"] is None
    assert got["few"] == ("too-few-records", 1, 2) and got["null-key"] == ("too-few-records", 1, 2)
    assert got["range"] == ("out-of-format", "quarters", 9.0, 1)
    assert got["fraction"][:3] == ("out-of-format", "year", 1990.5)
    assert got["nan"][1] == "pay" and got["late"] == ("out-of-format", "quarters", 5.0, 3)


def test_null_key_counts_as_a_value(spark):
    loose = S.schema_of("loose", 2, "quarters", year=S.Field("year", True), quarters=S.Field("integer"))
    assert violations(spark, [("d", 0, 1990.0, 1.0, 0.0), ("d", 1, 1991.0, None, 0.0)], loose) == {"d": None}


def test_strings_are_absent(spark):
    rows = spark.createDataFrame([("2019",)], "year string")
    assert rows.select(S.conforms(rows, YEARS)).first()[0] is False


def test_foreign_validators(spark):
    rows = spark.createDataFrame([("d", 0, 1990.0, 1.0, 1.0), ("d", 1, 1991.0, 2.0, 1.0)], RECORD)
    issues = lambda record: [] if record["quarters"] == 1 else ["no"]
    assert S.validate_with(rows, issues, 1).first()["violation"] is None
    assert S.validate_with(rows, issues, 2).first()["violation"]["conforming"] == 1

    async def later(record):
        return []

    with pytest.raises(TypeError):
        S.validate_with(rows, later, 1)


def test_schema_as_data():
    assert S.Schema.from_dict(YEARS.to_dict()) == YEARS
    assert [f.nullable for f in YEARS.to_struct_type()] == [False, True, True]
