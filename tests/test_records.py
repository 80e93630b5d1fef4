"""Records to chunks, pages to tables, reports."""

from pyspark.sql import functions as F

from gleanery.operators import pages, records, report

SCHEMA = "file_name string, pos int, content_type string, section_path array<string>, text string, table_id string, table_type string, shape string, n_cols int, header array<string>, rows array<string>"


def _text(f, p, text, path="A"):
    return (f, p, "section_text", [path], text, None, None, None, None, None, None)


def _table(f, p, tid, rows, path="A", header=("h", "i")):
    return (f, p, "table", [path], None, tid, "data_table", "matrix", 2, list(header), rows)


def test_chunks_of_records(spark):
    rows = [
        _text("f", 0, "A long text about the plan. " * 60), _text("f", 1, "It goes on."), _table("f", 2, "t1", ["r" * 500] * 5), _text("f", 3, "short note"), _table("f", 4, "t2", ["x: 1"]),
        _text("g", 0, "   "), _text("g", 1, "목차", "B"), _text("g", 2, "Other section with some words in it, long enough to stay as a chunk of its own.", "C"),
    ]
    got = records.chunks(spark.createDataFrame(rows, SCHEMA)).orderBy("chunk_id").collect()
    texts = [r for r in got if r["chunk_type"] == "section_text" and r["file_name"] == "f"]
    assert len(texts) > 1 and "[next table: t1, data_table, matrix]" in texts[-1]["text"]
    assert sum(r["table_id"] == "t1" for r in got) == 3
    note = next(r for r in got if r["table_id"] == "t2")
    assert "short note" in note["text"] and not any("short note" in r["text"] for r in texts)
    assert [r["chunk_id"] for r in got] == [f"chunk_{i:08d}" for i in range(1, len(got) + 1)] and sum(r["file_name"] == "g" for r in got) == 1
    assert records.chunks(spark.createDataFrame([], SCHEMA)).count() == 0


def test_table_groups(spark):
    rows = [_table("f", 0, "a", []), _text("f", 1, "x"), _table("f", 2, "b", []), _table("f", 3, "c", [], header=("y", "z")), _text("f", 4, "word " * 30), _table("f", 5, "d", [], header=("y", "z"))]
    got = {r["table_id"]: r["role"] for r in records.table_groups(spark.createDataFrame(rows, SCHEMA)).collect() if r["table_id"]}
    assert got == {"a": "start", "b": "continued", "c": None, "d": None}


def test_pages(spark):
    words = [("d", 1, x, x + 20.0, y + (0.5 if x else 0.0), y + 10, f"w{int(y)}{int(x)}") for y in (0.0, 20.0, 40.0) for x in (0.0, 22.0, 44.0, 200.0)] + [("d", 1, 0.0, 10.0, 100.0, 110.0, "alone")]
    df = spark.createDataFrame(words, "doc string, page int, x0 double, x1 double, y0 double, y1 double, text string")
    cells = pages.row_cells(pages.word_rows(df))
    tables = pages.table_rows(cells)
    assert cells.count() == 7 and tables.count() == 6
    box = spark.createDataFrame([("d", 1, 0.0, 500.0, 0.0, 60.0)], "doc string, page int, x0 double, x1 double, y0 double, y1 double")
    assert [r["text"] for r in pages.outside(df, box).collect()] == ["alone"]
    body = spark.createDataFrame([("t", 1, 0, 1, "v"), ("t", 2, 2, 2, "w")], "table_id string, pos int, first int, last int, text string")
    head = spark.createDataFrame([("t", 0, 0, 0, "A"), ("t", 1, 0, 1, "B"), ("t", 2, 2, 3, "C")], "table_id string, pos int, first int, last int, text string")
    assert {r["text"]: r["header"] for r in pages.headers_of(body, head).collect()} == {"v": "B", "w": "C"}


def test_grids(spark):
    source = "<table><tr><th colspan=2>A</th><th>B</th></tr><tr><td rowspan=2>1</td><td>2<br>x</td><td>3</td></tr><tr><td>4</td></tr></table>"
    assert pages.html_grid(source) == [["A", "A", "B"], ["1", "2 x", "3"], ["1", "4", ""]]
    assert pages.html_grid(None) == [] and pages.html_grid("<td>a<td>b") == [["a", "b"]]
    df = spark.createDataFrame([(1, source), (2, None), (3, "")], "id int, html string").select("id", pages.grid("html").alias("grid"))
    rows = {(r["id"], r["row"], r["name"], r["value"]) for r in pages.grid_records(df).collect()}
    assert rows == {(1, 1, "A", "1"), (1, 1, "A", "2 x"), (1, 1, "B", "3"), (1, 2, "A", "1"), (1, 2, "A", "4")}
    filled = pages.carried_forward(spark.createDataFrame([(1, 1, "x"), (1, 2, None)], "g int, n int, v string"), "v", ["g"], "n")
    assert [r["v_filled"] for r in filled.orderBy("n").collect()] == ["x", "x"]


def test_report(spark, data):
    text = report.page(spark.read.parquet(f"{data}/eval_rows.parquet"), 5)
    assert "Outcomes" in text and text.count("<table>") == 4
    df = spark.createDataFrame([("a  b", 0.12345), (None, None)], "t string, v double")
    assert [tuple(r) for r in df.select(report.preview(F.col("t"), 3), report.percent(F.col("v"))).collect()] == [("a b", "12.3%"), ("", "–")]
