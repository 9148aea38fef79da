"""Relational rows rendered as the documents that this library reads, and their reader."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import at, let
from ..functions.notation import Notation, is_only_number, read_leading_date, read_number
from ..operators.columns import KindThreshold, SignatureOptions, cell_at, find_row_anomalies
from ..operators.contract import MONEY, REVIEW_ROWS
from ..operators.table import read_table
from ..sources.documents import documents_from_texts

FRENCH = Notation("DMY")
#: Where the fields of a statement's lines begin.
LABEL_AT, AMOUNT_AT = 13, 40
#: An order in so many declares a wrong total in ``wrong_totals``.
WRONG_EVERY = 7
LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")


def french(amount: Column) -> Column:
    """An amount with blanks between thousands and a decimal comma."""
    return F.translate(F.format_number(amount, 2), ",.", " ,")


def _line(date: Column, label: Column, amount: Column) -> Column:
    return F.concat(F.rpad(date, LABEL_AT, " "), F.rpad(label, AMOUNT_AT - LABEL_AT, " "), amount)


def statement_lines(lineitem: DataFrame) -> DataFrame:
    """(doc_id, lines): per order its lines as (date, label, amount) strings, in order."""
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    entry = F.struct(
        *LINE_ORDER,
        F.date_format("l_shipdate", "dd/MM/yyyy").alias("date"),
        F.concat(F.lit("PART "), F.col("l_partkey").cast("string")).alias("label"),
        price.alias("price"),
    )
    return lineitem.groupBy(F.col("l_orderkey").alias("doc_id")).agg(
        F.sort_array(F.collect_list(entry)).alias("entries"), F.sum(price).alias("total")
    )


def statements(lineitem: DataFrame, wrong_totals: bool = False) -> DataFrame:
    """(doc_id, name, text): a statement of each order's lines and their total."""
    rows = statement_lines(lineitem)
    total = F.col("total")
    if wrong_totals:
        total = total + F.when(F.col("doc_id") % WRONG_EVERY == 0, F.lit(1)).otherwise(F.lit(0)).cast("decimal(18,2)")
    lines = F.transform("entries", lambda e: _line(e["date"], e["label"], french(e["price"])))
    last = _line(F.lit(""), F.lit("TOTAL"), french(total))
    text = F.array_join(F.concat(lines, F.array(last)), "\n")
    return rows.select("doc_id", F.concat(F.lit("order-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), text.alias("text"))


def order_exports(orders: DataFrame) -> DataFrame:
    """(doc_id, name, text): each customer's orders as semicolon-delimited text."""
    line = F.concat_ws(
        ";",
        F.col("o_orderkey").cast("string"),
        F.date_format("o_orderdate", "yyyy-MM-dd"),
        F.col("o_orderpriority"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"),
    )
    gathered = orders.groupBy(F.col("o_custkey").alias("doc_id")).agg(
        F.array_sort(F.collect_list(F.struct("o_orderkey", line.alias("line")))).alias("entries")
    )
    return gathered.select(
        "doc_id",
        F.concat(F.lit("customer-"), F.col("doc_id").cast("string"), F.lit(".csv")).alias("name"),
        F.array_join(F.transform("entries", lambda e: e["line"]), "\n").alias("text"),
    )


def statement_items(lineitem: DataFrame) -> DataFrame:
    """(doc_id, items): the same statements as positioned items, three to a row."""
    rows = statement_lines(lineitem)

    def items(e: Column, i: Column) -> Column:
        y = F.lit(700.0) - i * F.lit(20.0)

        def one(text: Column, x: float, drift: float) -> Column:
            return F.struct(
                text.alias("text"), F.lit(x).alias("x"), (y + drift).alias("y"), (F.length(text) * 5.0).alias("width")
            )

        return F.array(one(e["date"], 50.0, 0.0), one(e["label"], 150.0, 1.4), one(french(e["price"]), 430.0, -1.4))

    return rows.select("doc_id", F.flatten(F.transform("entries", items)).alias("items"))


def kind_of(cell: Column) -> Column:
    """date, amount (two decimals) or text."""
    date = read_leading_date(cell, FRENCH)
    return (
        F.when(F.coalesce(date["length"] == F.length(cell), F.lit(False)), "date")
        .when(is_only_number(cell, 2), "amount")
        .otherwise("text")
    )


SIGNATURE = SignatureOptions(
    kind_of,
    {"date": KindThreshold(0.6, 0.7), "amount": KindThreshold(0.6), "text": KindThreshold(0.6)},
)


class StatementReader:
    """Reads tables of (date, label, amount) whose last row declares the total."""

    in_row = True

    def __init__(self, mends_last_sign: bool = False):
        if mends_last_sign:
            self.repair = self._turn_last

    def read(self, documents: DataFrame) -> Column:
        none = F.array().cast("array<struct<cause:string,column:int,expected:string,kind:string>>")

        def entries(rows: Column) -> Column:
            def with_flags(flags: Column) -> Column:
                def entry(r: Column, i: Column) -> Column:
                    amount = let(cell_at(r, 2), lambda c: F.when(is_only_number(c, 2), read_number(c).cast(MONEY)))
                    return F.struct(
                        read_leading_date(cell_at(r, 0), FRENCH)["date"].alias("date"),
                        cell_at(r, 1).alias("label"),
                        amount.alias("amount"),
                        at(flags, i).isNotNull().alias("odd"),
                    )

                return F.transform(rows, entry)

            return let(F.coalesce(documents["anomalies"], none), with_flags)

        def reading(every: Column) -> Column:
            records = F.filter(every, lambda z: ~z["odd"] & z["date"].isNotNull() & z["amount"].isNotNull())
            declared = F.filter(every, lambda z: z["odd"] & z["amount"].isNotNull())
            return F.struct(
                F.transform(
                    records,
                    lambda z: F.struct(z["date"].alias("date"), z["label"].alias("label"), z["amount"].alias("amount")),
                ).alias("records"),
                F.struct(F.transform(declared, lambda z: z["amount"]).alias("declared"), F.size(every).alias("n_rows")).alias(
                    "header"
                ),
            )

        return let(let(documents["rows"], entries), reading)

    def self_check(self, reading: Column) -> Column:
        seen = F.aggregate(reading["records"], F.lit(0).cast(MONEY), lambda s, r: (s + r["amount"]).cast(MONEY))
        declared = reading["header"]["declared"]
        return F.struct(
            declared.alias("declared"),
            seen.alias("read"),
            F.lit("EUR").alias("unit"),
            F.when(F.size(declared) == 0, F.lit("no row declares a total")).alias("nothing"),
        )

    def rows_to_review(self, documents: DataFrame, reading: Column) -> Column:
        nowhere = F.lit(None)
        return F.transform(
            reading["records"],
            lambda r: F.struct(
                F.concat_ws(" ", r["date"].cast("string"), r["label"], r["amount"].cast("string")).alias("raw"),
                F.create_map(F.lit("amount"), r["amount"].cast("string")).alias("fields"),
                nowhere.cast("string").alias("dropped_because"),
                nowhere.cast("int").alias("page"),
                nowhere.cast("double").alias("x"),
                nowhere.cast("double").alias("y"),
                nowhere.cast("double").alias("width"),
            ),
        ).cast(REVIEW_ROWS)

    def _turn_last(self, reading: Column, discrepancy: Column) -> Column:
        """The last record's sign turned, if that closes the gap."""
        last = at(reading["records"], F.size(reading["records"]) - 1)
        turned = F.transform(
            reading["records"],
            lambda r, i: F.struct(
                r["date"].alias("date"),
                r["label"].alias("label"),
                F.when(i == F.size(reading["records"]) - 1, -r["amount"]).otherwise(r["amount"]).cast(MONEY).alias("amount"),
            ),
        )
        return F.when(
            (last["amount"] * 2).cast(MONEY) == discrepancy["amount"],
            F.struct(turned.alias("records"), reading["header"].alias("header")),
        )


def read_statements(texts: DataFrame) -> DataFrame:
    """Statements as tables with the anomalies of their rows."""
    tables = read_table(documents_from_texts(texts, page_cut=False))
    return tables.withColumn("anomalies", find_row_anomalies(F.col("rows"), SIGNATURE))
