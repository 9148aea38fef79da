from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tallyread.operators import layout as L
from tallyread.operators import table as TB
from tallyread.sources import text as X
from tallyread.sources.documents import documents_from_items, documents_from_texts

ITEM = "array<struct<text:string,x:double,y:double,width:double>>"


def item(text, x, y=700.0):
    return (text, float(x), float(y), 5.0 * len(text))


def one(spark, items, column):
    return spark.createDataFrame([(items,)], f"items {ITEM}").select(column.alias("v")).first()["v"]


def test_page_wide_cut(spark):
    cut = L.column_boundaries(F.col("items"))
    assert one(spark, [item("a", 50), item("b", 52), item("c", 300)], cut) == [176.0]
    assert one(spark, [], cut) == [] and one(spark, [item(" ", 5), item(" ", 90)], cut) == []
    assert one(spark, [item("a", 0), item("b", 18)], cut) == []  # the gap itself opens nothing


def test_anchors(spark):
    rows = spark.createDataFrame([(1, [300.0, 50.0, 150.0]), (2, [5.0]), (3, [])], "i int, a array<double>")
    got = rows.orderBy("i").select(L.boundaries_from_anchors(F.col("a"))).collect()
    assert [r[0] for r in got] == [[100.0, 225.0], [], []]


def test_column_at(spark):
    cuts = F.array(F.lit(100.0), F.lit(200.0))
    got = spark.range(1).select(*[L.column_at(F.lit(x), cuts) for x in (10.0, 100.0, 150.0, 200.0, 900.0)]).first()
    assert list(got) == [0, 1, 1, 2, 2]


def test_rows(spark):
    page = L.page_from(F.col("items"))
    rows = one(spark, [item("b", 50, 600), item("a", 50, 700)], page)["rows"]
    assert [r["text"] for r in rows] == ["a", "b"]
    rows = one(spark, [item("a", 50, 700), item("b", 300, 701.4), item("c", 50, 697)], page)["rows"]
    assert len(rows) == 2  # 701.4 heads the row; 697 is too far below
    ys = [item(str(i), 50, y) for i, y in enumerate((700, 698, 696, 694, 690))]
    assert [r["text"] for r in one(spark, ys, page)["rows"]] == ["01", "23", "4"]
    rows = one(spark, [item("a", 50), item(" ", 120), item("b", 400)], page)["rows"]
    assert rows[0]["text"] == "a\tb"


def test_split_amount_joins_in_the_row_and_parts_in_the_cell(spark):
    items = [item("x", 50, 700), item("y", 120, 700), item("28", 300, 700), item("500", 311, 700), item("z", 50, 600)]
    made = L.page_from(F.col("items"))
    page = one(spark, items, made)
    assert page["rows"][0]["text"] == "x\ty\t28500"
    cells = one(spark, items, L.cells_of(made["rows"], made["column_boundaries"]))
    assert cells == [["x", "y", "28 500"], ["z", "", ""]]
    places = one(spark, items, L.places_of(made["rows"], made["column_boundaries"], F.lit(1)))
    assert places[0][2]["x"] == 300.0 and places[0][2]["width"] == 26.0
    assert places[1][1] is None


def test_row_without_items_keeps_its_text(spark):
    rows = spark.createDataFrame([(["a  b", "c"],)], "l array<string>").select(X.rows_without_items(F.col("l")).alias("r"))
    cells = rows.select(L.cells_of(F.col("r"), F.array(F.lit(5.0)))).first()[0]
    assert cells == [["a b", ""], ["c", ""]]


def recurrence(spark, xs_by_row, **options):
    rows = [(0.0, "", [item("w", x) for x in xs]) for xs in xs_by_row]
    frame = spark.createDataFrame([(rows,)], f"rows array<struct<y:double,text:string,items:{ITEM}>>")
    return frame.select(L.boundaries_from_recurrence(F.col("rows"), **options)).first()[0]


def test_recurrence(spark):
    clean = [[50, 150, 400]] * 6
    assert recurrence(spark, clean) == [100.0, 275.0]
    assert len(recurrence(spark, [[50, 150, 250, 400]] + clean[1:])) == 2
    assert len(recurrence(spark, [[50, 150, 400, 520]] + clean[1:])) == 3
    assert len(recurrence(spark, [[50, 150, 250, 400]] + clean[1:], minimum_support=2.0)) == 3
    assert recurrence(spark, [[], []]) == [] and recurrence(spark, []) == []


TEXTS = {
    "blank": "a\n\n  \nb",
    "aligned": "02/05/2026   CARTE AMAZON   12,40\n03/05/2026   VIR LOYER      28 500,00",
    "indent": "    a      b\n    c      d",
    "comma": "a,b,c\nd,e,f",
    "semicolon": "a;b\nc;d",
    "pipe": "a|b\r\nc|d",
    "empty-field": "a,b\n,c",
    "tab-wins": "a  x\tb\nc  y\td",
    "quoted": 'a,"b, c"\nd,e',
    "one-line": "a,b",
    "varying": "a,b\na,b,c\na\na,b,c,d",
}


def test_text_sources(spark):
    rows = spark.createDataFrame([(k, k, v) for k, v in TEXTS.items()], "doc_id string, name string, text string")
    pages = {r["doc_id"]: r for r in X.pages_from_texts(rows).collect()}
    items = lambda k: [[(i["text"], i["x"]) for i in row["items"]] for row in pages[k]["rows"]]
    assert [r["text"] for r in pages["blank"]["rows"]] == ["a", "b"]
    assert items("aligned")[0] == [("02/05/2026", 0.0), ("CARTE AMAZON", 13.0), ("12,40", 28.0)]
    assert items("indent")[0] == [("a", 4.0), ("b", 11.0)]
    assert items("comma")[1] == [("d", 0.0), ("e", 1.0), ("f", 2.0)]
    assert items("pipe") == [[("a", 0.0), ("b", 1.0)], [("c", 0.0), ("d", 1.0)]]
    assert items("empty-field")[1] == [("c", 1.0)]
    assert items("tab-wins")[0] == [("a  x", 0.0), ("b", 1.0)]
    assert pages["quoted"]["unit"] == "characters" and len(items("quoted")[0]) == 1
    assert pages["one-line"]["unit"] == "characters" and pages["varying"]["unit"] == "characters"
    tables = {r["doc_id"]: r for r in TB.read_table(documents_from_texts(rows)).collect()}
    assert tables["aligned"]["rows"][1] == ["03/05/2026", "VIR LOYER", "28 500,00"]
    assert tables["empty-field"]["rows"] == [["a", "b"], ["", "c"]]
    assert tables["one-line"]["warnings"] == ["page 1 shows no column at all - every row came back whole"]


def test_warnings_over_pages(spark):
    two = [item("a", 50, 700), item("b", 300, 700), item("c", 50, 600), item("d", 300, 600)]
    three = two + [item("e", 500, 700), item("f", 500, 600)]
    pages = [("d", "n", 1, 595.0, 842.0, two), ("d", "n", 2, 595.0, 842.0, []), ("d", "n", 3, 595.0, 842.0, three)]
    frame = spark.createDataFrame(pages, f"doc_id string, name string, page int, width double, height double, items {ITEM}")
    got = TB.read_table(documents_from_items(frame)).first()
    assert got["warnings"] == [
        "page 2 carries no text at all - a blank page, a scan, or an image",
        "the pages disagree on how many columns there are (2 on 1, 3 on 1)",
    ]
    assert got["text"] == "a\tb\nc\td\na\tb\te\nc\td\tf"


def test_merged_band_is_told_on_demand(spark):
    frame = spark.createDataFrame([("d", "d", "a,b,c\nd,,f\ng,,h")], "doc_id string, name string, text string")
    docs = documents_from_texts(frame)
    assert TB.read_table(docs).first()["rows"][0] == ["a", "b c"]
    assert any("merged" in w for w in TB.read_table(docs, merged_band_warning=True).first()["warnings"])


words = st.lists(st.tuples(st.sampled_from(["a", "bb", "c d"]), st.integers(0, 600), st.integers(0, 40)), max_size=12)


@settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(words, st.randoms())
def test_laws(spark, placed, order):
    items = [item(t, x, 20 * y) for t, x, y in dict.fromkeys(placed)]
    shuffled = items[:]
    order.shuffle(shuffled)
    made = L.page_from(F.col("items"))
    both = F.struct(
        made["column_boundaries"].alias("cuts"),
        L.cells_of(made["rows"], made["column_boundaries"]).alias("cells"),
        L.places_of(made["rows"], made["column_boundaries"], F.lit(1)).alias("places"),
    )
    first, second = one(spark, items, both), one(spark, shuffled, both)
    assert first["cuts"] == second["cuts"] and len(first["cells"]) == len(second["cells"])
    for row, spots in zip(first["cells"], first["places"]):
        assert len(row) == len(spots) == len(first["cuts"]) + 1
        assert [c != "" for c in row] == [s is not None for s in spots]
