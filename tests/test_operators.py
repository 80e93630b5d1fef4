"""Core operators on small fixtures, and every query against its SQL."""

import math
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import __spark_entry__ as entry_point
from gleanery.functions.numbering import positions
from gleanery.operators import metrics, ocr, questions, sampling, search, splitters, structure
from gleanery.plans import oracles, queries


def test_positions_of_a_hot_group(spark):
    rows = [("hot", random.Random(i).random(), i) for i in range(900)] + [("b", 1.0, 1), (None, 2.0, 2), (None, 1.0, 3)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    got = {r["id"]: r["pos"] for r in positions(df.where("g = 'hot'"), ["g"], ["v", "id"]).collect()}
    want = {r[2]: n for n, r in enumerate(sorted((r for r in rows if r[0] == "hot"), key=lambda r: r[1:]), 1)}
    assert got == want
    assert {(r["id"], r["pos"]) for r in positions(df.where("g IS NULL"), ["g"], ["v"], start=0).collect()} == {(3, 0), (2, 1)}
    assert sorted(r["n"] for r in positions(df, [], ["v", "id"], "n").collect()) == list(range(1, 904))
    assert positions(df.limit(0), ["g"], ["v"]).count() == 0


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab .\n", max_size=500))
def test_baseline_splitter_ends_and_covers(text):
    parts = splitters.baseline(text, 60, 20, 5)
    assert all(len(p) <= 60 for p in parts)
    if len(text.strip()) >= 5 and "  " not in text:
        assert not parts or parts[0] in text


def test_splitters():
    text = "This sentence is repeated. " * 200
    parts = splitters.baseline(text, 120, 20, 30)
    assert len(parts) > 1 and all(len(p) >= 30 for p in parts)
    with pytest.raises(ValueError, match="overlap"):
        splitters.baseline(text, 100, 100)
    assert splitters.baseline("x" * 500 + ". " + "y" * 3000)
    assert splitters.oversized("a" * 30, 10, 2)[0] == "a" * 10
    section = splitters.section("para one\n\n" + "word " * 400 + "\n\nend", 300, 50, 20)
    assert len(section) > 3 and all(splitters.paragraphs(text, 200, 50, 20))
    assert splitters.pack_rows(["a" * 50] * 5, 110, 30) == [["a" * 50] * 2, ["a" * 50] * 2, ["a" * 50]]
    assert splitters.pack_rows([]) == []


def test_bm25_ranks_an_id_first(spark):
    index = spark.createDataFrame([("a", 0, "SFR-005 login screen"), ("b", 1, "budget of 157,300,000원 for the login"), ("c", 2, None), ("d", 3, "")], "chunk_id string, row_idx int, body string")
    asked = spark.createDataFrame([(1, "SFR-005 login"), (2, "157,300,000원"), (3, None), (4, "nothing known")], "query_id int, query string")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in search.bm25(asked, index).collect()}
    assert got[1, 1] == "a" and got[2, 1] == "b" and not any(q in (3, 4) for q, _ in got)
    score = next(r["score"] for r in search.bm25(asked, index).collect() if r["query_id"] == 2)
    n, avg = 4, (4 + 7) / 4
    dl, idf = 7, math.log(1 + (n - 1 + 0.5) / 1.5)
    assert abs(score - 2 * idf * 2.5 / (1 + 1.5 * (0.25 + 0.75 * dl / avg))) < 1e-6
    only = spark.createDataFrame([(1, "b")], "query_id int, chunk_id string")
    assert [r["chunk_id"] for r in search.bm25(asked, index, allowed=only).collect()] == ["b"]
    assert search.bm25(asked.limit(0), index).count() == 0


def test_fusion_and_scaling(spark):
    leg = lambda ids: spark.createDataFrame([(1, c, float(9 - i), i + 1) for i, c in enumerate(ids)], "query_id int, chunk_id string, score double, rank int")
    fused = search.fuse({"dense": leg(["a", "b"]), "bm25": leg(["c", "b"])}).collect()
    assert [r["chunk_id"] for r in sorted(fused, key=lambda r: r["rank"])] == ["b", "a", "c"]
    assert max(r["score"] for r in fused) == 1 and min(r["score"] for r in fused) == 0
    assert [r["score"] for r in search.min_max(leg(["a"])).collect()] == [1.0]


def test_refusals_and_scores(spark):
    rows = [
        ("", "full"), (None, "full"), ("제공된 문서에서 확인되지 않습니다.", "full"), ("예산은 5,000만원이며 기간은 6개월입니다.\n연락처는 문서에서 확인되지 않습니다.", "partial"), ("6개월", "none"),
    ]
    df = spark.createDataFrame(rows, "answer string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", metrics.refusal_kind(F.col("answer")).alias("got")).collect())
    pairs = spark.createDataFrame([("6 개월", "기간은 6개월", 5), ("alpha beta gamma", "beta and alpha", 4), ("alpha beta gamma", "beta", None), (None, "x", None), ("x", "", None)], "e string, a string, want int")
    assert all(r["got"] == r["want"] for r in pairs.select("want", metrics.heuristic_score(F.col("e"), F.col("a")).alias("got")).collect())


def test_ocr_matching():
    m = ocr.match_values(["계약 기간", "예산", "예산"], ["계약기간은 6개월", "other"])
    assert (m["matched"], m["gt_total"], m["pred_total"]) == (1, 2, 2) and m["missing"] == ["예산"]
    assert ocr.match_values([], [])["precision"] == 1.0 and ocr.match_values([], ["a"])["recall"] == 1.0 and ocr.match_values(["a"], [])["precision"] == 0.0


def test_ocr_errors(spark):
    df = spark.createDataFrame([("가나", "가다"), ("", ""), (None, "x"), ("a b c", "a c")], "t string, r string")
    got = df.select(ocr.character_errors(F.col("t"), F.col("r")).alias("c"), ocr.word_errors(F.col("t"), F.col("r")).alias("w"), ocr.similarity(F.col("t"), F.col("r")).alias("s")).collect()
    assert got[0]["c"] == 0.5 and got[1]["c"] == 0 and got[1]["s"] == 100 and abs(got[3]["w"] - 1 / 3) < 1e-9 and got[2]["w"] == 1


def test_headings(spark):
    df = spark.createDataFrame([("Ⅰ. 사업 개요", 1), ("1. 추진 배경", 2), ("가. 범위", 3), ("① 목표", 4), ("가. 이름: 값", None), ("plain text", None), ("", None), (None, None), ("2) " + "x" * 60, None)], "line string, want int")
    assert all(r["got"] == r["want"] for r in df.select("want", structure.heading(F.col("line"))["level"].alias("got")).collect())
    marked = spark.createDataFrame([(1, 0, 1, "A"), (1, 1, 2, "B"), (1, 2, None, None), (1, 3, 1, "C"), (1, 4, 3, "D")], "k int, pos int, level int, title string")
    assert [r["path"] for r in structure.heading_path(marked, "k").orderBy("pos").collect()] == [["A"], ["A", "B"], ["A", "B"], ["C"], ["C", "D"]]


def test_question_filters(spark):
    df = spark.createDataFrame([("다음 중 하나를 고르면?", "open_ended_wording"), ("기간은?", None), ("", "empty_question"), (None, "empty_question")], "q string, want string")
    assert all(r["got"] == r["want"] for r in df.select("want", questions.open_ended(F.col("q")).alias("got")).collect())


def test_quotas():
    assert sampling.parse_quotas("overview=3, new=1")["overview"] == 3
    with pytest.raises(ValueError, match="quota"):
        sampling.parse_quotas("x")


def test_outcomes_add_up(spark, data):
    o = queries.task_outcomes(spark, data).first()
    n = spark.read.parquet(f"{data}/eval_rows.parquet").count()
    assert o["passed"] + o["failed"] + o["unknown"] == n
    bad = {r["eval_id"] for r in queries.failures_top(spark, data).collect()}
    assert not bad & {r["eval_id"] for r in queries.successes(spark, data).collect()}


def _plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v if isinstance(v, (bool, int)) else str(v)


def test_every_query_and_its_sql(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con, named = duckdb.connect(), oracles.oracle_sql()
    for t in ("documents", "doc_files", "chunks", "table_rows", "eval_rows", "ranked_chunks", "embeddings", "events"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, query in queries.queries().items():
        df = query(spark, data)
        cols = sorted(df.columns)
        got = sorted((tuple(_plain(v) for v in r) for r in df.select(*cols).collect()), key=repr)
        if name in named:
            rel = con.sql(named[name])
            assert sorted(rel.columns) == cols, name
            order = [rel.columns.index(c) for c in cols]
            want = sorted((tuple(_plain(r[i]) for i in order) for r in rel.fetchall()), key=repr)
            assert len(got) == len(want) and all(repr(a) == repr(b) or _close(a, b) for a, b in zip(got, want, strict=True)), name


def _close(a, b):
    return len(a) == len(b) and all(x == y or (isinstance(x, (int, float)) and isinstance(y, (int, float)) and abs(x - y) < 1e-6) for x, y in zip(a, b, strict=True))


def test_entry_and_names(spark):
    assert entry_point.entry(spark).count() > 0
    assert set(oracles.oracle_sql()) <= set(entry_point.queries())


def test_overlap_covers_every_question(spark, data):
    from gleanery.operators import questions

    texts: dict = {}
    for r in spark.read.parquet(f"{data}/chunks.parquet").select("doc_id", "text").collect():
        texts.setdefault(r["doc_id"], []).append((r["text"] or "").lower())
    want = {}
    for r in spark.read.parquet(f"{data}/eval_rows.parquet").select("eval_id", "question", "doc_id").collect():
        words = [w.lower() for w in re.findall(questions.TOPIC_WORD, r["question"] or "") if w.lower() not in questions.TOPIC_STOP]
        want[r["eval_id"]] = (len(words), sum(any(w in t for t in texts.get(r["doc_id"], [])) for w in words))
    got = {r["query_id"]: (r["n_words"], r["n_known"]) for r in queries.queries()["question_overlap"](spark, data).collect()}
    assert got == want
