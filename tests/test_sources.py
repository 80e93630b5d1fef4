"""Readers, writers, providers, streaming and the command line."""

import json

import pytest
from pyspark.sql import functions as F

from gleanery import cli, providers
from gleanery.sources import files
from gleanery.streaming import ingest


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1, "b": "가"}\n\n{"a": bad}\n{"a": 2}\n', encoding="utf-8")
    rows = files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int, b string").collect()
    assert [r["a"] for r in rows] == [1, None, 2] and rows[0]["b"] == "가"
    assert files.read_json_lines(spark, str(tmp_path / "none.jsonl"), "a int").count() == 0
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|bad"):
        files.read_json_lines(spark, str(tmp_path / "a.jsonl"), "a int", strict=True).collect()
    files.write_json_lines(spark.range(5).select(F.col("id"), F.lit("나").alias("t")), str(tmp_path / "out"), ["id"], 3)
    assert spark.read.json(str(tmp_path / "out")).count() == 3


def test_any_json(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"x": 1}, {"x": 2}]')
    (tmp_path / "b.json").write_text('{"x": 3}\n{"x": 4} {"x": 5}')
    (tmp_path / "c.json").write_text('{"x": 6} {"x": ')
    rows = files.read_any_json(spark, str(tmp_path)).collect()
    assert sorted(json.loads(r["record"])["x"] for r in rows if r["record"]) == [1, 2, 3, 4, 5, 6] and sum(r["record"] is None for r in rows) == 1


def test_lookup_and_lenient(spark):
    df = spark.createDataFrame([(1, '{"a": "b"}'), (2, "nothing"), (3, None)], "id int, j string")
    assert files.point_lookup(df, "id", 2).first()["j"] == "nothing"
    with pytest.raises(Exception, match="no row"):
        files.point_lookup(df, "id", 9).collect()
    assert [r[0] for r in df.orderBy("id").select(files.lenient_object(F.col("j"))).collect()] == [{"a": "b"}, {}, {}]


def test_documents_and_errors(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.txt").write_bytes("가나".encode() + b"\xff")
    (tmp_path / "d" / "two.bad").write_text("x")
    (tmp_path / "d" / "skip.bin").write_text("x")
    meta = spark.createDataFrame([("x/one.txt", "D1", "agency"), ("x/one.txt", "D1", "agency"), (None, "D2", "b")], "file_name string, doc_id string, agency string")
    got = {r["doc_id"]: r for r in files.load_documents(spark, str(tmp_path / "d"), meta, {".bad": lambda _b: 1 / 0}).collect()}
    assert got["D1"]["text"] == "가나" and got["D1"]["metadata"]["agency"] == "agency" and "ZeroDivisionError" in got["two"]["error"] and len(got) == 2
    good, bad = files.split_errors(files.load_documents(spark, str(tmp_path / "d"), None, {".bad": lambda _b: 1 / 0}))
    assert good.count() == 1 and bad.count() == 1
    assert {r["suffix"] for r in files.discover(spark, str(tmp_path / "d"), [".TXT"]).collect()} == {".txt"}


def test_index_and_merge(spark, tmp_path):
    a = spark.createDataFrame([("c1", "x", [1.0, 0.0]), ("c2", "y", [0.0, 1.0])], "chunk_id string, text string, embedding array<float>")
    merged = files.merge_embedded({"b": a.limit(1), "a": a}).collect()
    ids = sorted(r["merged_id"] for r in merged)
    assert len(set(ids)) == 3 and ids[0] == "c1"
    with pytest.raises(ValueError, match="several sizes"):
        files.merge_embedded({"a": a, "b": a.withColumn("embedding", F.array(F.lit(1.0).cast("float")))})
    files.write_index(a.select("chunk_id", "text"), a.select("chunk_id", "embedding"), str(tmp_path / "i"))
    assert [r["row_idx"] for r in spark.read.parquet(str(tmp_path / "i")).orderBy("chunk_id").collect()] == [0, 1]


def test_providers(spark):
    df = spark.createDataFrame([("q", "a b", "a"), (None, None, None)], "q string, e string, a string")
    rows = df.select(providers.embedding(F.col("q")).alias("v"), providers.judged(F.col("q"), F.col("e"), F.col("a")).alias("j"), providers.answer(providers.prompt(F.col("q"), F.lit("One. Two. Three."))).alias("t")).collect()
    assert len(rows[0]["v"]) == 64 and rows[0]["j"]["score"] == 2 and rows[1]["j"]["score"] == 0 and rows[0]["t"] == "One. Two."
    broken = df.select(providers.judged(F.col("q"), F.col("e"), F.col("a"), lambda rows: 1 / 0).alias("j")).first()["j"]
    assert broken["score"] == 0 and "division" in broken["error"]


def test_stream(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    for n in range(2):
        (src / f"{n}.json").write_text(json.dumps({"doc_id": f"d{n}", "text": "A sentence that is long enough. " * 60, "loaded_at": "2025-01-01T00:00:00"}))
        ingest.ingest(ingest.document_stream(spark, str(src)), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert {r["doc_id"] for r in out.collect()} == {"d0", "d1"} and out.groupBy("doc_id", "idx").count().where("count > 1").count() == 0


def test_command_line(spark, tmp_path, data):
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "a.txt").write_text("A sentence that is long enough. " * 100)
    cli.main(["ingest", str(tmp_path / "t"), str(tmp_path / "chunks")])
    assert spark.read.parquet(str(tmp_path / "chunks")).count() > 1
    cli.main(["run", data, str(tmp_path / "r"), "--name", "chunk_summary"])
    assert spark.read.parquet(str(tmp_path / "r")).count() > 5
