from pyspark.sql import functions as F

from tallyread.operators import columns as C
from tallyread.plans.statements import kind_of

TABLE = [
    ["01/01/2026", "RENT", "500,00", ""],
    ["02/01/2026", "CARD", "12,00", ""],
    ["03/01/2026", "WAGE", "", "900,00"],
    ["04/01/2026", "CARD", "7,50", ""],
    ["05/01/2026", "CARD", "3,20", ""],
]
OPTIONS = C.SignatureOptions(
    kind_of, {"date": C.KindThreshold(0.5, 0.7), "amount": C.KindThreshold(0.7), "text": C.KindThreshold(0.9)}
)


def run(spark, rows, column):
    return spark.createDataFrame([(rows,)], "rows array<array<string>>").select(column.alias("v")).first()["v"]


def profiles(kind=kind_of, **options):
    return C.profile_columns(F.col("rows"), kind, **options)


def test_profiles(spark):
    got = run(spark, TABLE, profiles())
    assert [p["share_filled"] for p in got] == [1.0, 1.0, 0.8, 0.2]
    assert [(s["kind"], s["share"]) for s in got[2]["shares"]] == [("amount", 0.8)]
    assert run(spark, [], profiles()) == []
    assert [p["share_filled"] for p in run(spark, [["a"], ["", "b"]], profiles(C.no_kind))] == [0.5, 0.5]
    assert [p["share_filled"] for p in run(spark, [["a"]] * 3 + [["", "b"]], profiles(C.no_kind, sample_limit=3))] == [1.0]


def test_dominant_kind(spark):
    shares = {"date": 0.5, "amount": 0.8, "text": 0.9}
    assert run(spark, TABLE, C.dominant_kinds(profiles(), shares)) == ["date", "text", "amount", None]
    tie = [["1,00"], ["word"]]
    assert run(spark, tie, C.dominant_kinds(profiles(), {"text": 0.5, "amount": 0.5})) == ["amount"]
    assert run(spark, tie, C.dominant_kinds(profiles(), {})) == [None]


def test_roles(spark):
    rules = [
        C.RoleRule("date", "date", 0.5), C.RoleRule("money", "amount", 0.2, "each"), C.RoleRule("description", "text", 0.4)
    ]
    assert run(spark, TABLE, C.assign_roles(profiles(), rules)) == ["date", "description", "money", "money"]
    wrapped = [["01/01/2026", "a"], ["", "b"], ["02/01/2026", "c"], ["", "d"]]
    assert run(spark, wrapped, C.assign_roles(profiles(), [C.RoleRule("date", "date", 0.9)])) == [None, None]
    filled = [C.RoleRule("date", "date", 0.9, "best", "filled")]
    assert run(spark, wrapped, C.assign_roles(profiles(), filled)) == ["date", None]
    twins = [["1,00", "2,00"]]
    assert run(spark, twins, C.assign_roles(profiles(), [C.RoleRule("m", "amount", 0.1)])) == ["m", None]


def anomalies(spark, rows, options=OPTIONS):
    got = run(spark, rows, C.find_row_anomalies(F.col("rows"), options))
    return None if got is None else [a and (a["cause"], a["column"], a["expected"], a["kind"]) for a in got]


def three(rows):
    return [[r[0], r[1], r[2] or r[3]] for r in rows]


def test_anomalies(spark):
    rows = three(TABLE)
    assert anomalies(spark, rows) == [None] * 5
    assert anomalies(spark, rows[:3]) is None
    assert anomalies(spark, rows + [["TOTAL", "", "1 422,70"]])[5] == ("wrong-kind", 0, "date", None)
    assert anomalies(spark, rows + [["", "BALANCE", "5,00"]])[5] == ("empty", 0, None, "date")
    assert anomalies(spark, rows + [["06/01/2026", "", "5,00"]])[5] is None  # 5 of 6 filled is below 0.9
    many = rows + rows + [["06/01/2026", "", "5,00"]]
    assert anomalies(spark, many)[10] == ("empty", 1, None, None)
    only = C.SignatureOptions(kind_of, OPTIONS.thresholds, judged={2})
    assert anomalies(spark, rows + [["TOTAL", "", "1,00"]], only)[5] is None
    wide = [["a"]] * 5 + [["a", "late"]]
    late = C.SignatureOptions(C.no_kind, {}, sample_limit=5)
    assert anomalies(spark, wide, late)[5] is None


def test_words(spark):
    said = F.transform(C.find_row_anomalies(F.col("rows"), OPTIONS), C.describe_anomaly)
    rows = three(TABLE) + [["", "BALANCE", "5,00"]]
    assert run(spark, rows, said)[5] == "column 0 (date) is empty"


def test_shorthands():
    assert C.thresholds_for(["a", "b"], 0.6) == {"a": C.KindThreshold(0.6), "b": C.KindThreshold(0.6)}
    assert C.shares_by_kind(OPTIONS) == {"date": 0.5, "amount": 0.7, "text": 0.9}
