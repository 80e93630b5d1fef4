"""Answers in a batch, judged evaluation, and the export of read pages."""

import pytest
from pyspark.sql import functions as F

from gleanery.operators import answering, ocr_export

UNIT = "id string, doc_key string, image string, fields map<string,array<string>>, lines array<struct<text:string,score:double>>, table_rows array<string>, footnotes array<string>, table_html string, merged_from array<string>"


def test_answers(spark):
    index = spark.createDataFrame([("a", 0, "SFR-005 login screen. It is blue."), ("b", 1, "budget for the year")], "chunk_id string, row_idx int, body string")
    vectors = spark.createDataFrame([("a", 0, [1.0, 0.0]), ("b", 1, [0.0, 1.0])], "chunk_id string, row_idx int, vector array<float>")
    asked = spark.createDataFrame([(1, "SFR-005", [0.9, 0.1]), (2, "nothing", [0.0, 0.0])], "query_id int, query string, vector array<float>")
    hits = answering.retrieve(asked, index, vectors)
    rows = {r["query_id"]: r for r in answering.answers(asked, hits, index.withColumnRenamed("body", "text")).collect()}
    assert rows[1]["sources"][0]["chunk_id"] == "a" and "SFR-005 login screen." in rows[1]["answer"] and rows[2]["sources"] is None and rows[2]["answer"] == ""
    assert answering.retrieve(asked, index, threshold=2.0).count() == 0


def test_only_open_rows_are_judged(spark, data):
    rows = spark.read.parquet(f"{data}/eval_rows.parquet")
    judged = answering.evaluated(rows, lambda triples: [3] * len(triples)).select("correctness_score").collect()
    plain = answering.evaluated(rows).select("correctness_score").collect()
    assert len(judged) == len(plain) and sum(r[0] == 3 for r in judged) > 0 and sum(r[0] in (4, 5) for r in judged) == sum(r[0] in (4, 5) for r in plain)


def test_export(spark):
    raw = [("u1", "d", "i1.png", {"name": ["x", "y"]}, [("line  one", 0.9), ("noise", 0.1), ("line one", None)], ["r1", "r2"], ["note"], "<td>cell</td>", None), ("u2", "d", "i2.png", None, None, None, None, None, None), ("u3", "d", "i3.png", None, [("t", 1.0)], None, None, None, None)]
    curated = [("u1", "d", "i1.png", {"name": ["z"]}, None, ["c1"], None, None, ["u3"])]
    a, b = spark.createDataFrame(curated, UNIT), spark.createDataFrame(raw, UNIT)
    units = ocr_export.preferred(a, b)
    assert {(r["id"], r["source"]) for r in units.collect()} == {("u1", "curated"), ("u2", "raw")}
    made = ocr_export.chunks(b.withColumn("source", F.lit("raw")))
    got = {(r["unit_id"], r["kind"]): r["text"] for r in made.collect()}
    assert got["u1", "ocr_structured"] == "name: x; y" and got["u1", "ocr_raw_text"] == "line one" and len([k for k in got if k[0] == "u1"]) == 6 and ("u2", "ocr_raw_text") not in got
    assert {r["id"]: r["n_chunks"] for r in ocr_export.manifest(b.withColumn("source", F.lit("raw")), made).collect()} == {"u1": 6, "u2": 0, "u3": 1}
    with pytest.raises(Exception, match="not curated"):
        ocr_export.strict(units).collect()
    truth = spark.createDataFrame([("1", "A.png"), ("2", "b.png"), ("3", "none.png")], "id string, image string")
    images = spark.createDataFrame([("x/A.png",), ("x/b.jpg",), ("x/c.png",)], "path string")
    assert {r["id"]: r["path"] for r in ocr_export.one_image_each(truth, images).collect()} == {"1": "x/A.png", "2": "x/b.jpg", "3": None}
    with pytest.raises(Exception, match="several images"):
        ocr_export.one_image_each(truth, images.union(spark.createDataFrame([("y/b.gif",)], "path string"))).collect()
    read = spark.createDataFrame([("1", "ok")], "id string, status string")
    assert {r["id"]: r["status"] for r in ocr_export.predictions(truth, read).collect()} == {"1": "ok", "2": "missing", "3": "missing"}
