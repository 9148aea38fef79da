"""Every text is read once in a query's plan, and the short ways give what the long ones do."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyread.functions import notation as N
from tallyread.functions import text as T
from tallyread.plans.queries import QUERIES

#: What stands in a plan for each reading of texts.
READING = r"\r?\n"


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("once")
    lines = [(k, n, 1, n, 10.0 * n + 0.5, datetime(2026, 5, n)) for k in (1, 7, 40) for n in range(1, 3 + k % 5)]
    spark.createDataFrame(
        lines, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_extendedprice double, l_shipdate timestamp"
    ).write.parquet(str(path / "lineitem.parquet"))
    spark.createDataFrame([(0, 0, "user", "a line of prose")], "conv_id long, turn long, role string, text string").write.parquet(
        str(path / "conversations.parquet")
    )
    return str(path)


def readings(query) -> int:
    return query._jdf.queryExecution().optimizedPlan().toString().count(READING)


def test_judged_anomalies_read_once(spark, folder):
    query = QUERIES["row_anomalies_judged"](spark, folder)
    assert readings(query) == 1
    assert sorted((r["doc_id"], r["n_flagged"]) for r in query.collect()) == [(7, 0)]


def test_contract_reads_each_group_once(spark, folder):
    """Orders and turns are two readings; joins of the results with documents and failures made more."""
    assert readings(QUERIES["contract_kit"](spark, folder)) == 2


def test_plain_text_collapses_as_any_other(spark):
    texts = ["a b", " a b", "a  b", "a b ", "a\tb", "a b", "a", "", " ", "é b", "~!", "a b\n", "a　"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in rows.select(T.collapse(F.col("t"))).collect()]
    assert got == ["a b", "a b", "a b", "a b", "a b", "a b", "a", "", "", "é b", "~!", "a b", "a"]


def test_plain_amounts_and_dates(spark):
    texts = ["1 234,50", "-0,00", "-12,34", "1234,50", "1/2/2026", "01.02.26 x", "1-2-26", "2026-02-01", "2026-0201", "31/02/2026", "a1/2/2026", "1 2/2026"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    got = rows.select(N.read_number(F.col("t")).alias("n"), N.read_leading_date(F.col("t"), N.Notation("DMY"))["date"].cast("string").alias("d")).collect()
    assert [str(r["n"]) for r in got[:4]] == ["1234.5", "-0.0", "-12.34", "1234.5"]
    assert [r["d"] for r in got[4:]] == ["2026-02-01"] * 4 + [None] * 4
