"""Queries over the driver's tables, one for each operator or group of them, and their SQL.

Relational rows are rendered as documents and read back, so that the SQL can compute from
the rows what the reading has to find.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import notation as N
from ..functions.patterns import (
    NEVER_MATCHES,
    DocumentKind,
    PatternSet,
    RawPattern,
    Requirement,
    classify_document,
    compile_pattern,
    count_matches,
    requirement_holds,
)
from ..operators import columns as C
from ..operators import layout as L
from ..operators import schema as S
from ..operators import table as TB
from ..operators.contract import MONEY, discrepancy_of, read_documents
from ..operators.kit import check_contract
from ..sources import pdf, text
from ..sources.documents import documents_from_items, documents_from_texts, open_documents
from . import statements as ST
from .explain import ExplainOptions, describe_cut, explanations, fit, recurring_cut

#: Places of a conversation's turns in the contract.
TURN_PLACES = 1_000_000

QUERIES = {}
ORACLE_SQL = {}


def query(sql: str | None = None):
    """Registers a function as a query under its own name, with its SQL."""

    def keep(function):
        QUERIES[function.__name__] = function
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return keep


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str) -> str:
    return f"cast({column} as date)"


# --- numbers -------------------------------------------------------------------------


def _number_query(name: str, render):
    def run(spark, sf_dir):
        rows = _table(spark, sf_dir, "customer")
        raw = render(F.col("c_acctbal").cast("decimal(18,2)"))
        return rows.select("c_custkey", N.read_number(raw).alias("value"))

    run.__name__ = name
    return query("select c_custkey, cast(cast(c_acctbal as decimal(18,2)) as double) as value from customer")(run)


def _signed(render):
    return lambda x: F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")), render(F.abs(x)))


_number_query("read_number_fr", _signed(lambda x: F.concat(ST.french(x), F.lit(" €"))))
_number_query("read_number_us", _signed(lambda x: F.concat(F.lit("$"), F.format_number(x, 2))))
_number_query("read_number_swiss", _signed(lambda x: F.translate(F.format_number(x, 2), ",", "'")))
_number_query(
    "read_number_paren",
    lambda x: F.when(x < 0, F.concat(F.lit("("), F.format_number(F.abs(x), 2), F.lit(")"))).otherwise(F.format_number(x, 2)),
)
_number_query(
    "read_number_trailing_minus",
    lambda x: F.concat(F.translate(F.format_number(F.abs(x), 2), ",.", ".,"), F.when(x < 0, F.lit("-")).otherwise(F.lit(""))),
)


@query("select p_partkey, true as whole, false as with_words, true as decimals, false as other_decimals from part")
def is_only_number(spark, sf_dir):
    shown = ST.french(F.col("p_retailprice").cast("decimal(18,2)"))
    return _table(spark, sf_dir, "part").select(
        "p_partkey",
        N.is_only_number(shown).alias("whole"),
        N.is_only_number(F.concat(F.col("p_brand"), F.lit(" "), shown)).alias("with_words"),
        N.is_only_number(shown, 2).alias("decimals"),
        N.is_only_number(shown, 3).alias("other_decimals"),
    )


@query(
    "select o_orderkey, 1 as n, cast(cast(o_totalprice as decimal(18,2)) as double) as value, "
    "cast(4 + length(cast(o_orderkey as varchar)) + 5 as integer) as at from orders"
)
def find_numbers_2dec(spark, sf_dir):
    line = F.concat(
        F.lit("REF "), F.col("o_orderkey").cast("string"), F.lit(" PAID"),
        F.lit(" "), ST.french(F.col("o_totalprice").cast("decimal(18,2)")),
        F.lit(" ON "), F.date_format("o_orderdate", "dd/MM/yyyy"),
    )
    found = _table(spark, sf_dir, "orders").select("o_orderkey", N.find_numbers(line, 2).alias("found"))
    return found.select(
        "o_orderkey", F.size("found").alias("n"), F.get("found", F.lit(0))["value"].alias("value"), F.get("found", F.lit(0))["index"].cast("int").alias("at")
    )


# --- dates ---------------------------------------------------------------------------

MONTHS = {
    "janvier": 1, "fevrier": 2, "mars": 3, "avril": 4, "mai": 5, "juin": 6,
    "juillet": 7, "aout": 8, "septembre": 9, "octobre": 10, "novembre": 11, "decembre": 12,
}
SPELLED = ("janvier", "Février", "mars", "AVRIL", "mai", "juin", "juil.", "août", "sept.", "octobre", "novembre", "Décembre")
MONTHS_WITH_SHORT = MONTHS | {"juil": 7, "sept": 9}
_DATE_SQL = f"select o_orderkey, {_day('o_orderdate')} as date from orders"


@query(_DATE_SQL)
def read_date_dmy(spark, sf_dir):
    shown = F.concat(F.lit("paid on "), F.date_format("o_orderdate", "d/M/yyyy"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.read_date(shown, N.Notation("DMY")).alias("date"))


@query(_DATE_SQL)
def read_date_mdy(spark, sf_dir):
    shown = F.date_format("o_orderdate", "MM-dd-yyyy")
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.read_date(shown, N.Notation("MDY")).alias("date"))


def _leading(spark, sf_dir, shown, notation, year=None):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", N.read_leading_date(shown, notation, year).alias("d"))
    return rows.select("o_orderkey", F.col("d.date").alias("date"), F.col("d.length").alias("length"))


@query(f"select o_orderkey, {_day('o_orderdate')} as date, 13 as length from orders")
def leading_date_iso(spark, sf_dir):
    shown = F.concat(F.lit("   "), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit(" TRANSFER"))
    return _leading(spark, sf_dir, shown, N.Notation())


@query(
    f"select o_orderkey, {_day('o_orderdate')} as date, cast(length(cast(day(o_orderdate) as varchar)) + 1 + "
    "length(['janvier','Février','mars','AVRIL','mai','juin','juil.','août','sept.','octobre','novembre','Décembre'][month(o_orderdate)]) "
    "+ 5 as integer) as length from orders"
)
def leading_date_named(spark, sf_dir):
    name = F.element_at(F.array(*[F.lit(m) for m in SPELLED]), F.month("o_orderdate"))
    shown = F.concat(F.dayofmonth("o_orderdate").cast("string"), F.lit(" "), name, F.lit(" "), F.year("o_orderdate").cast("string"), F.lit(" suite"))
    return _leading(spark, sf_dir, shown, N.Notation("DMY", MONTHS_WITH_SHORT))


@query(f"select o_orderkey, {_day('o_orderdate')} as date, 5 as length from orders")
def leading_date_yearless(spark, sf_dir):
    shown = F.concat(F.date_format("o_orderdate", "dd.MM"), F.lit(" CARD"))
    return _leading(spark, sf_dir, shown, N.Notation(), F.year("o_orderdate"))


@query(
    "select o_orderkey, try_cast(printf('%04d-%02d-%02d', cast(1990 + o_orderkey % 40 as integer), "
    "cast(o_custkey % 14 as integer), cast(o_orderkey % 33 as integer)) as date) as date from orders"
)
def date_rollover(spark, sf_dir):
    shown = F.concat_ws(
        "/",
        (F.col("o_orderkey") % 33).cast("string"),
        (F.col("o_custkey") % 14).cast("string"),
        (F.lit(1990) + F.col("o_orderkey") % 40).cast("string"),
    )
    return _table(spark, sf_dir, "orders").select("o_orderkey", N.read_date(shown, N.Notation()).alias("date"))


# --- plain text ----------------------------------------------------------------------


@query(
    "select o_custkey as doc_id, case when count(*) >= 2 then ';' end as delimiter, "
    "cast(count(*) as integer) as n_lines from orders group by o_custkey"
)
def delimiter_of(spark, sf_dir):
    docs = ST.order_exports(_table(spark, sf_dir, "orders"))
    lines = docs.select("doc_id", text.lines_of(F.col("text")).alias("lines"))
    return lines.select("doc_id", text.delimiter_of(F.col("lines")).alias("delimiter"), F.size("lines").alias("n_lines"))


@query(
    "with c as (select o_custkey from orders group by o_custkey having count(*) >= 2), "
    "r as (select o_custkey as doc_id, cast(row_number() over (partition by o_custkey order by o_orderkey) - 1 as integer) as row, "
    "[cast(o_orderkey as varchar), strftime(o_orderdate, '%Y-%m-%d'), o_orderpriority, cast(cast(o_totalprice as decimal(18,2)) as varchar)] as f "
    "from orders join c using (o_custkey)) "
    "select doc_id, row, cast(i as integer) as x, f[cast(i as integer) + 1] as text from r, range(4) t(i) where f[cast(i as integer) + 1] <> ''"
)
def delimited_fields(spark, sf_dir):
    pages = text.pages_from_texts(ST.order_exports(_table(spark, sf_dir, "orders"))).where("unit = 'index'")
    rows = pages.select("doc_id", F.posexplode("rows").alias("row", "r"))
    return rows.select("doc_id", "row", F.explode("r.items").alias("i")).select(
        "doc_id", "row", F.col("i.x").cast("int").alias("x"), F.col("i.text").alias("text")
    )


def _french_sql(value: str) -> str:
    return f"translate(format('{{:,.2f}}', {value}), ',.', ' ,')"


_LINES_SQL = (
    "lines as (select l_orderkey as doc_id, cast(row_number() over (partition by l_orderkey order by "
    "l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 as integer) as seq, "
    "strftime(l_shipdate, '%d/%m/%Y') as date, 'PART ' || l_partkey as label, "
    "cast(l_extendedprice as decimal(18,2)) as price, "
    f"{_french_sql('cast(l_extendedprice as decimal(18,2))')} as amount from lineitem), "
    "totals as (select doc_id, cast(count(*) as integer) as n, sum(price) as total, "
    f"{_french_sql('sum(price)')} as shown from lines group by doc_id)"
)
_FIELDS_SQL = (
    f"with {_LINES_SQL}, every as ("
    "select doc_id, seq, 0 as col, 0 as x, date as text from lines union all "
    "select doc_id, seq, 1, 13, label from lines union all select doc_id, seq, 2, 40, amount from lines union all "
    "select doc_id, n, 1, 13, 'TOTAL' from totals union all select doc_id, n, 2, 40, shown from totals) "
)


@query(f"{_FIELDS_SQL} select doc_id, seq as row, cast(x as integer) as x, text from every")
def aligned_fields(spark, sf_dir):
    pages = text.pages_from_texts(ST.statements(_table(spark, sf_dir, "lineitem")))
    rows = pages.select("doc_id", F.posexplode("rows").alias("row", "r"))
    return rows.select("doc_id", "row", F.explode("r.items").alias("i")).select(
        "doc_id", "row", F.col("i.x").cast("int").alias("x"), F.col("i.text").alias("text")
    )


# --- geometry ------------------------------------------------------------------------


def _item(x, body, y=None):
    return F.struct(
        body.alias("text"), x.cast("double").alias("x"), (F.lit(0.0) if y is None else y).alias("y"), F.lit(10.0).alias("width")
    )


def _exploded(rows: DataFrame, key: str) -> DataFrame:
    return rows.select(key, F.posexplode("cuts").alias("place", "cut"))


@query(
    "with s as (select user_id, value * 10 as x, lag(value * 10) over (partition by user_id order by value) as p from events), "
    "b as (select user_id, (p + x) / 2 as cut from s where x - p > 18) "
    "select user_id, cast(row_number() over (partition by user_id order by cut) - 1 as integer) as place, cut from b"
)
def column_boundaries(spark, sf_dir):
    pages = _table(spark, sf_dir, "events").groupBy("user_id").agg(
        F.collect_list(_item(F.col("value") * 10, F.lit("w"))).alias("items")
    )
    return _exploded(pages.select("user_id", L.column_boundaries(F.col("items")).alias("cuts")), "user_id")


@query(
    "with s as (select s_nationkey, s_acctbal as x, lag(s_acctbal) over (partition by s_nationkey order by s_acctbal) as p from supplier), "
    "b as (select s_nationkey, (p + x) / 2 as cut from s where p is not null) "
    "select s_nationkey, cast(row_number() over (partition by s_nationkey order by cut) - 1 as integer) as place, cut from b"
)
def anchors_cut(spark, sf_dir):
    rows = _table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(F.collect_list("s_acctbal").alias("anchors"))
    return _exploded(rows.select("s_nationkey", L.boundaries_from_anchors(F.col("anchors")).alias("cuts")), "s_nationkey")


@query(
    "with r as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as row, * from lineitem), "
    "e as (select doc_id, row, l_quantity * 8 as x from r union all select doc_id, row, 500 + l_tax * 2000 from r union all select doc_id, row, 900.0 from r), "
    "n as (select doc_id, max(row) as n from r group by doc_id), "
    "s as (select *, case when x - lag(x) over (partition by doc_id order by x, row) > 18 then 1 else 0 end as step from e), "
    "g as (select *, sum(step) over (partition by doc_id order by x, row rows unbounded preceding) as band from s), "
    "b as (select doc_id, band, min(x) as low, max(x) as high, count(distinct row) as support from g group by doc_id, band), "
    "k as (select b.*, support >= greatest(2, floor(n * 0.15 + 0.5)) as strong from b join n using (doc_id)), "
    "f as (select *, coalesce(bool_or(strong) over (partition by doc_id order by band rows between unbounded preceding and 1 preceding), false) as before, "
    "coalesce(bool_or(strong) over (partition by doc_id order by band rows between 1 following and unbounded following), false) as after from k), "
    "c as (select doc_id, low, high, lag(high) over (partition by doc_id order by band) as prev from f where strong or not before or not after) "
    "select doc_id, cast(row_number() over (partition by doc_id order by low) - 1 as integer) as place, (prev + low) / 2 as cut from c where prev is not null"
)
def recurrence_cut(spark, sf_dir):
    row = F.struct(
        *ST.LINE_ORDER,
        F.struct(
            F.lit(0.0).alias("y"),
            F.lit("").alias("text"),
            F.array(
                _item(F.col("l_quantity") * 8, F.lit("q")),
                _item(F.col("l_tax") * 2000 + 500, F.lit("t")),
                _item(F.lit(900.0), F.lit("p")),
            ).alias("items"),
        ).alias("row"),
    )
    pages = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.array_sort(F.collect_list(row)).alias("all"))
    rows = F.transform("all", lambda r: r["row"])
    return _exploded(pages.select("doc_id", L.boundaries_from_recurrence(rows).alias("cuts")), "doc_id")


@query("select c_custkey, cast(case when c_acctbal >= 5000 then 3 when c_acctbal >= 1000 then 2 when c_acctbal >= 0 then 1 else 0 end as integer) as col from customer")
def column_at(spark, sf_dir):
    cuts = F.array(F.lit(0.0), F.lit(1000.0), F.lit(5000.0))
    return _table(spark, sf_dir, "customer").select("c_custkey", L.column_at(F.col("c_acctbal"), cuts).alias("col"))


_THREE_CUTS = (100.0, 290.0)


def _three_rows(spark, sf_dir):
    pages = ST.statement_items(_table(spark, sf_dir, "lineitem"))
    cuts = F.array(*[F.lit(c) for c in _THREE_CUTS])
    return pages.select("doc_id", L.rows_from(F.col("items"), cuts).alias("rows")), cuts


@query(
    f"with {_LINES_SQL} select doc_id, seq as row, date || chr(9) || label || chr(9) || amount as text, "
    "cast(700 - 20 * seq as double) as y, 3 as n_items from lines"
)
def rows_from_items(spark, sf_dir):
    pages, _ = _three_rows(spark, sf_dir)
    rows = pages.select("doc_id", F.posexplode("rows").alias("row", "r"))
    return rows.select("doc_id", "row", F.col("r.text").alias("text"), F.col("r.y").alias("y"), F.size("r.items").alias("n_items"))


_CELLS_SQL = (
    f"with {_LINES_SQL}, every as (select doc_id, seq, 0 as col, date as cell from lines union all "
    "select doc_id, seq, 1, label from lines union all select doc_id, seq, 2, amount from lines) "
)


@query(f"{_CELLS_SQL} select doc_id, seq, cast(col as integer) as col, cell from every")
def row_to_cells(spark, sf_dir):
    pages, cuts = _three_rows(spark, sf_dir)
    return TB.long_cells(pages.select("doc_id", L.cells_of(F.col("rows"), cuts).alias("rows")))


@query(
    f"{_CELLS_SQL} select doc_id, seq, cast(col as integer) as col, 1 as page, cast([50, 150, 430][col + 1] as double) as x, "
    "cast(700 - 20 * seq + [0.0, 1.4, -1.4][col + 1] as double) as y, cast(5 * length(cell) as double) as width from every"
)
def places_of(spark, sf_dir):
    pages, cuts = _three_rows(spark, sf_dir)
    placed = pages.select("doc_id", F.posexplode(L.places_of(F.col("rows"), cuts, F.lit(1))).alias("seq", "places"))
    return placed.select("doc_id", "seq", F.posexplode("places").alias("col", "p")).select(
        "doc_id", "seq", "col", F.col("p.page").alias("page"), F.col("p.x").alias("x"), F.round("p.y", 6).alias("y"), F.col("p.width").alias("width")
    )


@query(
    f"with {_LINES_SQL} select doc_id, string_agg(date || chr(9) || label || chr(9) || amount, chr(10) order by seq) as text, "
    "1 as n_pages, cast(count(*) as integer) as n_rows from lines group by doc_id"
)
def documents_from_positions(spark, sf_dir):
    pages = ST.statement_items(_table(spark, sf_dir, "lineitem")).select(
        "doc_id", F.lit("x").alias("name"), F.lit(1).alias("page"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), "items"
    )
    docs = documents_from_items(pages)
    return docs.select("doc_id", "text", "n_pages", F.size(F.get("pages", F.lit(0))["rows"]).alias("n_rows"))


# --- tables --------------------------------------------------------------------------


@query(
    f"{_FIELDS_SQL} select doc_id, seq, cast(col as integer) as col, text as cell from every union all "
    "select doc_id, n, 0, '' from totals"
)
def read_table_cells(spark, sf_dir):
    docs = documents_from_texts(ST.statements(_table(spark, sf_dir, "lineitem")))
    return TB.long_cells(TB.read_table(docs))


def _prose(rows, doc_id):
    """Conversations' turns as plain text: prose without columns."""
    return rows.select(doc_id.alias("doc_id"), F.lit("turn").alias("name"), F.regexp_replace("text", "[\"\\t;|,]| {2,}", " ").alias("text"))


def _page_warnings(prose):
    tables = TB.read_table(documents_from_texts(prose.withColumn("text", F.regexp_replace("text", " +", " "))))
    return tables.select("doc_id", F.size("warnings").alias("n"), F.get("warnings", F.lit(0)).alias("warning"))


@query(
    "select conv_id as doc_id, 1 as n, 'page 1 shows no column at all - every row came back whole' as warning "
    "from conversations where turn = 0"
)
def read_table_warnings(spark, sf_dir):
    first = _table(spark, sf_dir, "conversations").where("turn = 0")
    return _page_warnings(_prose(first, F.col("conv_id")))


@query(
    "select conv_id || '-' || turn as doc_id, 1 as n, "
    "'page 1 shows no column at all - every row came back whole' as warning from conversations"
)
def read_table_warnings_turns(spark, sf_dir):
    turns = _table(spark, sf_dir, "conversations")
    return _page_warnings(_prose(turns, F.concat_ws("-", "conv_id", "turn")))


@query(
    "with l as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) as i from lineitem), "
    "n as (select doc_id, max(i) as n from l group by doc_id having max(i) >= 6) "
    "select doc_id, 'column 2 of page 1 is filled on only ' || cast(floor(100.0 / n + 0.5) as integer) || "
    "'% of its rows - the cut may have invented it' as warning from n"
)
def thin_columns(spark, sf_dir):
    rows = ST.statement_lines(_table(spark, sf_dir, "lineitem"))
    cells = F.transform(
        "entries", lambda e, i: F.array(e["date"], e["label"], F.when(i == 0, F.lit("once")).otherwise(F.lit("")))
    )
    warned = rows.select("doc_id", TB.thin_columns(cells, F.lit(1)).alias("w"))
    return warned.select("doc_id", F.explode("w").alias("warning"))


@query(
    "with p as (select o_custkey, o_orderkey, cast(o_orderkey % 3 as integer) + 1 as c, "
    "row_number() over (partition by o_custkey order by o_orderkey) as i from orders), "
    "k as (select o_custkey, c, count(*) as n, min(i) as first from p group by o_custkey, c), "
    "d as (select o_custkey, string_agg(c || ' on ' || n, ', ' order by n desc, first) as s, count(*) as kinds from k group by o_custkey) "
    "select o_custkey as doc_id, case when kinds > 1 then 'the pages disagree on how many columns there are (' || s || ')' end as warning from d"
)
def pages_out_of_step(spark, sf_dir):
    page = F.struct("o_orderkey", ((F.col("o_orderkey") % 3).cast("int") + 1).alias("c"))
    docs = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("doc_id")).agg(F.array_sort(F.collect_list(page)).alias("pages"))
    counts = F.transform("pages", lambda p: p["c"])
    return docs.select("doc_id", F.get(TB.pages_out_of_step(counts), F.lit(0)).alias("warning"))


# --- profiles, roles, signature --------------------------------------------------------


def _line_tables(spark, sf_dir):
    """Orders' lines as tables of (date, flag or empty, amount)."""
    rows = ST.statement_lines(_table(spark, sf_dir, "lineitem"))
    cells = F.transform(
        "entries",
        lambda e: F.array(
            e["date"], F.when(e["l_linenumber"] % 3 == 0, F.lit("")).otherwise(e["label"]), ST.french(e["price"])
        ),
    )
    return rows.select("doc_id", cells.alias("rows"))


_PROFILE_SQL = (
    "with r as (select l_orderkey as doc_id, l_linenumber % 3 <> 0 as filled from lineitem), "
    "a as (select doc_id, count(*) as n, count(*) filter (filled) as f from r group by doc_id) "
)


@query(
    f"{_PROFILE_SQL}, c as (select doc_id, 0 as col, 'date' as kind, 1.0 as share, 1.0 as share_filled from a union all "
    "select doc_id, 1, case when f > 0 then 'text' end, case when f > 0 then f / n end, f / n from a union all select doc_id, 2, 'amount', 1.0, 1.0 from a) "
    "select doc_id, cast(col as integer) as col, kind, cast(share as double) as share, cast(share_filled as double) as share_filled from c"
)
def profile_columns(spark, sf_dir):
    profiles = _line_tables(spark, sf_dir).select("doc_id", C.profile_columns(F.col("rows"), ST.kind_of).alias("p"))
    rows = profiles.select("doc_id", F.posexplode("p").alias("col", "p"))
    return rows.select(
        "doc_id", "col", F.get("p.shares", F.lit(0))["kind"].alias("kind"), F.get("p.shares", F.lit(0))["share"].alias("share"), F.col("p.share_filled").alias("share_filled")
    )


@query(f"{_PROFILE_SQL} select doc_id, 'date' as c0, case when f / n >= 0.6 then 'text' end as c1, 'amount' as c2 from a")
def dominant_kind(spark, sf_dir):
    profiles = _line_tables(spark, sf_dir).select("doc_id", C.profile_columns(F.col("rows"), ST.kind_of).alias("p"))
    kinds = profiles.select("doc_id", C.dominant_kinds(F.col("p"), {"date": 0.5, "text": 0.6, "amount": 0.5}).alias("k"))
    return kinds.select("doc_id", *[F.get("k", F.lit(i)).alias(f"c{i}") for i in range(3)])


def _roles(spark, sf_dir, rules):
    profiles = _line_tables(spark, sf_dir).select("doc_id", C.profile_columns(F.col("rows"), ST.kind_of).alias("p"))
    roles = profiles.select("doc_id", C.assign_roles(F.col("p"), rules).alias("r"))
    return roles.select("doc_id", *[F.get("r", F.lit(i)).alias(f"c{i}") for i in range(3)])


@query(f"{_PROFILE_SQL} select doc_id, 'when' as c0, case when f / n >= 0.5 then 'what' end as c1, 'money' as c2 from a")
def assign_roles_best(spark, sf_dir):
    rules = [C.RoleRule("when", "date", 0.5), C.RoleRule("money", "amount", 0.3), C.RoleRule("what", "text", 0.5)]
    return _roles(spark, sf_dir, rules)


@query("select distinct l_orderkey as doc_id, 'any' as c0, 'any' as c1, 'money' as c2 from lineitem")
def assign_roles_each(spark, sf_dir):
    rules = [C.RoleRule("money", "amount", 0.3, "each"), C.RoleRule("any", "date", 0.0, "each")]
    return _roles(spark, sf_dir, rules)


@query(f"{_PROFILE_SQL} select doc_id, cast(null as varchar) as c0, case when f > 0 then 'what' end as c1, cast(null as varchar) as c2 from a")
def assign_roles_filled(spark, sf_dir):
    return _roles(spark, sf_dir, [C.RoleRule("what", "text", 0.9, "best", "filled")])


def _flagged(spark, sf_dir, options):
    tables = TB.read_table(documents_from_texts(ST.statements(_table(spark, sf_dir, "lineitem")), page_cut=False))
    return tables.select("doc_id", C.find_row_anomalies(F.col("rows"), options).alias("a"))


@query(
    f"with {_LINES_SQL} select doc_id, n as seq, 'empty' as cause, 0 as col, 'date' as kind, "
    "'column 0 (date) is empty' as described from totals where n >= 4"
)
def row_anomalies(spark, sf_dir):
    rows = _flagged(spark, sf_dir, ST.SIGNATURE).select("doc_id", F.posexplode("a").alias("seq", "a")).where("a is not null")
    return rows.select(
        "doc_id", "seq", F.col("a.cause").alias("cause"), F.col("a.column").alias("col"), F.col("a.kind").alias("kind"), C.describe_anomaly(F.col("a")).alias("described")
    )


@query(f"with {_LINES_SQL} select doc_id, cast(0 as bigint) as n_flagged from totals where n >= 4")
def row_anomalies_judged(spark, sf_dir):
    options = C.SignatureOptions(ST.kind_of, ST.SIGNATURE.thresholds, judged={1, 2})
    # A filter on the reading would go below it, and everything would be read twice.
    flagged = F.transform(
        F.filter(F.array("a"), lambda a: a.isNotNull()),
        lambda a: F.size(F.filter(a, lambda x: x.isNotNull())).cast("long"),
    )
    rows = _flagged(spark, sf_dir, options).select("doc_id", flagged.alias("flagged"))
    return rows.select("doc_id", F.explode("flagged").alias("n_flagged"))


@query("select l_orderkey as doc_id, count(*) < 4 as unlearned from lineitem group by l_orderkey")
def anomaly_too_few_rows(spark, sf_dir):
    return _flagged(spark, sf_dir, ST.SIGNATURE).select("doc_id", F.col("a").isNull().alias("unlearned"))


# --- classification --------------------------------------------------------------------


def _pattern(source, flags="i"):
    return compile_pattern(RawPattern(source, flags))


def _kinds():
    return [
        DocumentKind("contact", [Requirement([PatternSet([_pattern(r"[a-z0-9.]+@[a-z0-9]+\.[a-z]+")])])]),
        DocumentKind("licence", [Requirement([PatternSet([_pattern("licen[cs]ed under")])])]),
        DocumentKind(
            "english",
            [Requirement([PatternSet([_pattern(r"\bthe\b")], occurrences=5)]), Requirement([PatternSet([_pattern(r"\bder\b")])], absent=True)],
        ),
        DocumentKind("never", [Requirement([PatternSet([NEVER_MATCHES])])]),
    ]


_WORD_SQL = "len(regexp_extract_all(text, '(?i)(?:^|[^A-Za-z0-9_]){0}(?:$|[^A-Za-z0-9_])'))"


@query(
    "with t as (select doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9_]+'), lambda w: w = 'the' or w = 'der') as w from documents) "
    "select doc_id, case when regexp_matches(text, '(?i)[a-z0-9.]+@[a-z0-9]+\\.[a-z]+') then 'contact' "
    "when regexp_matches(text, '(?i)licen[cs]ed under') then 'licence' "
    "when len(list_filter(w, lambda x: x = 'the')) >= 5 and len(list_filter(w, lambda x: x = 'der')) = 0 then 'english' end as kind from t"
)
def classify_documents(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", classify_document(F.col("text"), _kinds()).alias("kind"))


@query(
    "select doc_id, cast(len(list_filter(regexp_split_to_array(text, '[^A-Za-z0-9_]+'), lambda w: w = 'the')) as integer) as n_the, "
    "cast(len(regexp_extract_all(text, '[0-9]+')) as integer) as n_digits, 0 as n_never from documents"
)
def count_pattern_matches(spark, sf_dir):
    body = F.col("text")
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        count_matches(body, _pattern(r"\bthe\b", "g")).alias("n_the"),
        count_matches(body, _pattern(r"\d+", "")).alias("n_digits"),
        count_matches(body, compile_pattern(RawPattern("(a+)+"))).alias("n_never"),
    )


@query("select doc_id, not regexp_matches(text, '@') as without, regexp_matches(text, '@') or regexp_matches(text, 'http') as either from documents")
def requirement_absent(spark, sf_dir):
    sign, link = PatternSet([_pattern("@", "")]), PatternSet([_pattern("http", "")])
    return _table(spark, sf_dir, "documents").select(
        "doc_id",
        requirement_holds(F.col("text"), Requirement([sign], absent=True)).alias("without"),
        requirement_holds(F.col("text"), Requirement([sign, link])).alias("either"),
    )


# --- schemas ---------------------------------------------------------------------------

PART_SCHEMA = S.schema_of(
    "part", 3, "p_size", p_size=S.Field("integer", True, 1, 45), p_retailprice=S.Field("number", True, 0, 2000)
)


@query("select p_partkey, p_size between 1 and 45 and p_retailprice between 0 and 2000 as good from part")
def schema_conforms(spark, sf_dir):
    rows = _table(spark, sf_dir, "part")
    return rows.select("p_partkey", S.conforms(rows, PART_SCHEMA).alias("good"))


def _parts(spark, sf_dir):
    return _table(spark, sf_dir, "part").withColumnRenamed("p_brand", "doc_id").withColumnRenamed("p_partkey", "record_idx")


@query(
    "with b as (select p_brand as doc_id, p_partkey, case when p_size not between 1 and 45 then 'p_size' else 'p_retailprice' end as field, "
    "case when p_size not between 1 and 45 then p_size else p_retailprice end as value from part "
    "where p_size not between 1 and 45 or p_retailprice not between 0 and 2000), "
    "f as (select doc_id, min(p_partkey) as p_partkey from b group by doc_id) "
    "select d.doc_id, case when f.p_partkey is not null then 'out-of-format' end as cause, b.field, cast(b.value as double) as value, b.p_partkey as record_idx "
    "from (select distinct p_brand as doc_id from part) d left join f using (doc_id) left join b on b.doc_id = f.doc_id and b.p_partkey = f.p_partkey"
)
def validate_first_violation(spark, sf_dir):
    found = S.validate(_parts(spark, sf_dir), PART_SCHEMA)
    return found.select("doc_id", *[F.col(f"violation.{c}").alias(c) for c in ("cause", "field", "value", "record_idx")])


@query(
    "select p_brand as doc_id, case when count(distinct p_size) < 20 then 'too-few-records' end as cause, "
    "case when count(distinct p_size) < 20 then count(distinct p_size) end as conforming from part group by p_brand"
)
def validate_key_distinct(spark, sf_dir):
    schema = S.schema_of("sizes", 20, "p_size", p_size=S.Field("integer", True))
    found = S.validate(_parts(spark, sf_dir), schema)
    return found.select("doc_id", F.col("violation.cause").alias("cause"), F.col("violation.conforming").alias("conforming"))


@query(
    "select p_brand as doc_id, case when count(*) filter (p_size % 2 = 0) < 30 then count(*) filter (p_size % 2 = 0) end as conforming from part group by p_brand"
)
def validate_with(spark, sf_dir):
    rows = _parts(spark, sf_dir)
    found = S.validate_with(rows, rows["p_size"] % 2 == 0, 30)
    return found.select("doc_id", F.col("violation.conforming").alias("conforming"))


# --- contract --------------------------------------------------------------------------


@query(
    "select o_orderkey, cast(case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then 0 else 0.5 end as double) as amount, "
    "cast(case when o_orderkey % 3 = 0 then null when o_orderkey % 3 = 1 then cast(o_totalprice as decimal(18,2)) else cast(o_totalprice as decimal(18,2)) - 0.5 end as double) as declared from orders"
)
def discrepancy(spark, sf_dir):
    seen = F.col("o_totalprice").cast(MONEY)
    none = F.array().cast(f"array<{MONEY}>")
    declared = (
        F.when(F.col("o_orderkey") % 3 == 0, none)
        .when(F.col("o_orderkey") % 3 == 1, F.array(seen + 10, seen, seen - 3))
        .otherwise(F.array(seen + 2, seen - F.lit(0.5).cast("decimal(3,2)")))
        .cast(f"array<{MONEY}>")
    )
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", discrepancy_of(declared, seen, F.lit("EUR")).alias("d"))
    return rows.select("o_orderkey", F.col("d.amount").cast("double").alias("amount"), F.col("d.declared").cast("double").alias("declared"))


_VERDICT_SQL = (
    "with l as (select l_orderkey as doc_id, count(*) as n, sum(cast(l_extendedprice as decimal(18,2))) as total from lineitem group by l_orderkey), "
    "d as (select *, case when n >= 4 then total + case when {wrong} then 1 else 0 end end as declared from l) "
    "select doc_id, cast(n + 1 as integer) as n_rows, cast(n as integer) as n_records, cast(declared as double) as declared, cast(total as double) as read, "
    "cast(total - declared as double) as gap, case when coalesce(total - declared, 0) <> 0 then 'needs-review' else 'read' end as verdict from d"
)


def _verdicts(texts: DataFrame) -> DataFrame:
    results = read_documents(ST.read_statements(texts), ST.StatementReader())
    return results.select(
        "doc_id",
        F.col("header.n_rows").alias("n_rows"),
        F.size("records").alias("n_records"),
        F.col("discrepancy.declared").cast("double").alias("declared"),
        F.col("self_check.read").cast("double").alias("read"),
        F.col("discrepancy.amount").cast("double").alias("gap"),
        "verdict",
    )


@query(_VERDICT_SQL.format(wrong="false"))
def statement_verdict(spark, sf_dir):
    """The flagship: every order's statement read back and held against its total."""
    return _verdicts(ST.statements(_table(spark, sf_dir, "lineitem")))


@query(_VERDICT_SQL.format(wrong=f"doc_id % {ST.WRONG_EVERY} = 0"))
def read_document_verdict(spark, sf_dir):
    return _verdicts(ST.statements(_table(spark, sf_dir, "lineitem"), wrong_totals=True))


@query(
    "with l as (select l_orderkey as doc_id, row_number() over (partition by l_orderkey order by l_linenumber desc, l_partkey desc, l_suppkey desc, l_extendedprice desc, l_shipdate desc) as back, "
    "cast(l_extendedprice as decimal(18,2)) as price from lineitem), "
    "t as (select doc_id, count(*) as n, sum(price) as total, max(price) filter (back = 1) as last from l group by doc_id) "
    "select doc_id, n >= 4 as repaired, cast(case when n >= 4 then total - 2 * last else total end as double) as read, 'read' as verdict from t"
)
def repair_sign(spark, sf_dir):
    """Statements whose last amount lost its minus: the total tells, one repair mends."""
    rows = ST.statement_lines(_table(spark, sf_dir, "lineitem"))
    prices = F.transform("entries", lambda e: e["price"])
    total = F.col("total") - F.get(prices, F.size(prices) - 1) * 2
    shown = F.concat(F.when(total < 0, F.lit("-")).otherwise(F.lit("")), ST.french(F.abs(total)))
    lines = F.transform("entries", lambda e: ST._line(e["date"], e["label"], ST.french(e["price"])))
    made = F.array_join(F.concat(lines, F.array(ST._line(F.lit(""), F.lit("TOTAL"), shown))), "\n")
    texts = rows.select("doc_id", F.lit("x").alias("name"), made.alias("text"))
    results = read_documents(ST.read_statements(texts), ST.StatementReader(mends_last_sign=True))
    return results.select("doc_id", "repaired", F.col("self_check.read").cast("double").alias("read"), "verdict")


# --- words -----------------------------------------------------------------------------


@query(
    "select s_suppkey, case when s_suppkey % 3 = 0 then 'no boundary' when s_suppkey % 3 = 1 then 'cut on the delimiter' "
    "else 'cut at ' || cast(floor(s_acctbal + 0.5) as integer) || ', ' || cast(floor(s_acctbal + 100.5) as integer) end as described from supplier"
)
def describe_cuts(spark, sf_dir):
    cut = F.when(F.col("s_suppkey") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array("s_acctbal", F.col("s_acctbal") + 100))
    unit = F.when(F.col("s_suppkey") % 3 == 1, "index").otherwise("points")
    return _table(spark, sf_dir, "supplier").select("s_suppkey", describe_cut(cut, unit).alias("described"))


@query(
    "select p_partkey, case when length(p_name) > 12 then p_name[1:11] || '>' else rpad(p_name, 12, ' ') end as cell from part"
)
def fit_cell(spark, sf_dir):
    return _table(spark, sf_dir, "part").select("p_partkey", fit(F.col("p_name"), 12).alias("cell"))


# --- whole files -------------------------------------------------------------------------


@query(
    "select n_nationkey, cast(3 as integer) as n_rows, 'PDF ' || n_name || chr(9) || 'KEY ' || n_nationkey as first_line, cast(null as varchar) as reason from nation "
    "union all select -1, null, null, 'empty' union all select -2, null, null, 'not-opened'"
)
def open_pdfs(spark, sf_dir):
    """A PDF for each nation, written, opened by an engine and read; two are refused."""
    rows = _table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    schema = "n_nationkey int, content binary"

    def write(parts):
        import pandas as pd

        for part in parts:
            made = []
            for key, name in zip(part["n_nationkey"], part["n_name"]):
                words = [pdf.PlacedWord(f"PDF {name}", 50, 700), pdf.PlacedWord(f"KEY {key}", 300, 700)]
                words += [w for y in (680, 660) for w in (pdf.PlacedWord("a", 50, y), pdf.PlacedWord("b", 300, y))]
                made.append(pdf.pdf_with_text(words).encode("latin-1"))
            yield pd.DataFrame({"n_nationkey": part["n_nationkey"], "content": made})

    broken = spark.createDataFrame([(-1, bytearray()), (-2, bytearray(b"%PDF-1.4 damaged"))], schema)
    written = rows.mapInPandas(write, schema).unionByName(broken)
    files = written.select(F.concat(F.lit("/in/"), F.col("n_nationkey").cast("string"), F.lit(".pdf")).alias("path"), F.length("content").cast("long").alias("length"), "content")
    documents, refusals = open_documents(files, engine=pdf.PlainPdfEngine())
    key = F.regexp_extract("doc_id", r"(-?\d+)\.pdf", 1).cast("int").alias("n_nationkey")
    page = F.get("pages", F.lit(0))
    read = documents.select(key, F.size(page["rows"]).alias("n_rows"), F.get(page["rows"], F.lit(0))["text"].alias("first_line"), F.lit(None).cast("string").alias("reason"))
    return read.unionByName(refusals.select(key, F.lit(None).cast("int").alias("n_rows"), F.lit(None).cast("string").alias("first_line"), "reason"))


@query()
def contract_kit(spark, sf_dir):
    """The six rules over statements, a PDF, an empty document and foreign prose."""
    lineitem = _table(spark, sf_dir, "lineitem")

    def cases(texts, expected):
        return ST.read_statements(texts).withColumns({"case": F.col("name"), "place": F.col("doc_id"), "expected": F.lit(expected)})

    full = lineitem.join(lineitem.groupBy("l_orderkey").count().where("count >= 4"), "l_orderkey", "left_semi")
    corpus = cases(ST.statements(full), "read")
    items = ST.statement_items(full)
    placed = items.select(
        "doc_id", F.lit("reference.pdf").alias("name"), F.lit(1).alias("page"), F.lit(595.0).alias("width"), F.lit(842.0).alias("height"), "items"
    )
    reference = TB.read_table(documents_from_items(placed)).withColumns(
        {"anomalies": C.find_row_anomalies(F.col("rows"), ST.SIGNATURE), "place": F.col("doc_id")}
    )
    # Turns are told apart by conversation, turn and, where that pair repeats, number.
    copies = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    turns = _table(spark, sf_dir, "conversations").withColumn("copy", F.row_number().over(copies))
    keys = [F.coalesce(F.col(c), F.lit(-1)).cast("long") for c in ("conv_id", "turn", "copy")]
    prose = _prose(turns, F.concat_ws("/", *[k.cast("string") for k in keys]))
    key = lambda i: F.get(F.split("doc_id", "/"), F.lit(i)).cast("long")
    foreign = ST.read_statements(prose).withColumns(
        {"case": F.concat(F.col("name"), F.lit(" "), F.col("doc_id")), "place": key(0) * TURN_PLACES + key(1)}
    )
    from ..sources.documents import document_without_substance

    empty = TB.read_table(document_without_substance(spark)).withColumn("anomalies", C.find_row_anomalies(F.col("rows"), ST.SIGNATURE))
    # ``passed`` tells the failures; joining them to the results would change no row and read all again.
    return check_contract(ST.StatementReader(), corpus, reference, empty, foreign)


@query()
def explain_statements(spark, sf_dir):
    """The explanation of every statement, as text."""
    texts = ST.statements(_table(spark, sf_dir, "lineitem"))
    options = ExplainOptions(boundaries_of=recurring_cut, signature=ST.SIGNATURE)
    return explanations(documents_from_texts(texts, page_cut=False), options)
