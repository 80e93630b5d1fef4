"""Record machines, fields of read pages, batches of evaluations, question generation, jobs and pages."""

import json

import pytest
from pyspark.sql import functions as F

from gleanery import cli, config, providers
from gleanery.operators import blocks, generation, metrics, ocr_eval, ocr_fields, parsing, pipeline, questions, search, viewer
from gleanery.sources import files

PDF = "file_name string, pos long, kind string, text string, page_no int, font_size double, rows array<array<string>>, error string"


def _line(p, text, page=1, size=10.0, f="a.pdf"):
    return (f, p, "line", text, page, size, None, None)


def test_pdf_records(spark):
    events = [
        _line(0, "제안요청서"), _line(1, "1. 개요 ..... 3"), _line(2, "Ⅰ"), _line(3, "사업 개요"), _line(4, "본문 첫 줄이다."), _line(5, "- 3 -", 2), _line(6, "둘째 줄이다.", 2), ("a.pdf", 7, "table", None, 2, None, [["구분", "배점"], ["기술", "90점"], ["가격", "10점"]], None),
        _line(8, "가. 세부 범위", 3), _line(9, "내용", 3), _line(10, "큰 글자 제목", 3, 14.0), _line(11, "Ⅱ", 3), _line(12, "아주 길게 이어지는 문장이라서 제목이 될 수 없는 줄이며 계속해서 다음으로 이어진다", 3), _line(0, "다른 파일", f="b.pdf"), ("b.pdf", 1, "table", None, 1, None, None, None),
    ]
    got = parsing.pdf_records(spark.createDataFrame(events, PDF)).orderBy("file_name", "pos").collect()
    a = [r for r in got if r["file_name"] == "a.pdf"]
    assert [(r["content_type"], r["section_path"]) for r in a] == [("cover_text", []), ("section_text", ["Ⅰ. 사업 개요"]), ("table", ["Ⅰ. 사업 개요"]), ("section_text", ["Ⅰ. 사업 개요", "가. 세부 범위"]), ("section_text", ["Ⅰ. 사업 개요", "큰 글자 제목"]), ("toc", [])]
    assert (a[1]["page_start"], a[1]["page_end"]) == (1, 2) and a[2]["table_type"] == "evaluation_table" and [r["cells"] for r in a[2]["table"]["rows_data"]] == [{"구분": "기술", "배점": "90점"}, {"구분": "가격", "배점": "10점"}]
    assert a[4]["text"].startswith("Ⅱ\n아주 길게") and len([r for r in got if r["file_name"] == "b.pdf"]) == 1
    assert parsing.pdf_records(spark.createDataFrame([], PDF)).count() == 0


HWP = f"file_name string, pos long, kind string, marker string, text string, n_rows int, n_cols int, cells array<{parsing.CELL}>, error string"


def _p(p, text, kind="paragraph", marker=None):
    return ("a.hwp", p, kind, marker, text, None, None, None, None)


def _t(p, grid, span=None):
    cells = [(r, c, 1, span or 1, v, False) for r, row in enumerate(grid) for c, v in enumerate(row) if v is not None]
    return ("a.hwp", p, "table", None, None, len(grid), max(map(len, grid)), cells, None)


def test_hwp_records(spark):
    wide = [["번호", "이름", "내용"]] + [[str(i), f"이름 {i}", f"내용 {i}"] for i in range(1, 6)]
    events = [
        _p(0, "표지 글"), _p(1, "Ⅰ."), _p(2, "사업안내"), _p(3, "본문이다."), _p(4, "가. 품목"), _t(5, wide), _p(6, "1) 표 제목"), _t(7, wide), _p(8, "항목 글", "item", "○"), _p(9, "1) 남는 제목"), _p(10, "글이 이어진다."),
        _t(11, [["Ⅱ", "과업안내"]]), _t(12, [["성명", "대표자"], ["홍", "김"]]), _p(13, "Ⅲ"), _p(14, "제목이 아닌 긴 글"),
    ]
    got = parsing.hwp_records(spark.createDataFrame(events, HWP)).orderBy("pos").collect()
    told = [(r["content_type"], list(r["section_path"]), r["text"] if r["content_type"] != "table" else r["table_type"]) for r in got]
    top = "Ⅰ. 사업안내"
    assert told == [
        ("cover_text", [], "표지 글"), ("section_text", [top], "본문이다."), ("table", [top, "가. 품목"], "data_table"), ("table", [top, "가. 품목", "1) 표 제목"], "data_table"), ("section_text", [top], "○ 항목 글\n1) 남는 제목\n글이 이어진다."),
        ("table", ["Ⅱ. 과업안내"], "form_table"), ("section_text", ["Ⅱ. 과업안내"], "Ⅲ\n제목이 아닌 긴 글"),
    ]
    assert got[2]["table"]["markdown"].startswith("| 번호 | 이름 | 내용 |\n| --- | --- | --- |\n| 1 |") and got[2]["table"]["shape"] == "vertical_key_value"
    assert parsing.hwp_records(spark.createDataFrame([], HWP)).count() == 0


def test_headings_grids_and_types():
    assert [parsing.hwp_heading(x) for x in ("Ⅱ. 과업", "3) " + "가" * 60, "가. 기간: 3개월", "① 보안", "사업개요", "그냥 글", "", "1.2. 절")] == [(1, "Ⅱ. 과업"), None, None, (4, "① 보안"), (2, "사업개요"), None, None, (2, "1.2. 절")]
    assert [parsing.pdf_heading(x) for x in ("1. 사업 기간: 3개월", "- 12 -", "나) 짧은 제목", "나) " + "가" * 40)] == [None, None, (3, "나) 짧은 제목"), None]
    assert parsing.pdf_heading("큰 제목", 13.0, 10.0) == (2, "큰 제목") and parsing.pdf_heading("큰 제목", 11.0, 10.0) is None
    assert parsing.contents_line("1. 개요   ···· 4", 2) and not parsing.contents_line("1. 개요   ···· 4", 11)
    assert parsing.compact_lines([["a", "a", ""], ["a"], ["b"], []]) == ["a", "b"] and parsing.grouped_rows([["h"], ["a"], [""], ["b"]], 1, 1) == [{"row_range": "1-1", "text": "a"}, {"row_range": "3-3", "text": "b"}]
    assert parsing.headed_rows([["k", ""], ["k", "v"], ["", ""]]) == [{"row_index": 1, "text": "col_1: v", "cells": {"col_1": "v"}}]
    assert parsing.type_in_context("data_table", ["추진 체계"]) == "organization_table" and parsing.type_in_context("form_table", ["추진 체계"]) == "form_table"
    assert parsing.hwp_grid({"n_rows": 2, "n_cols": 2, "cells": [{"row": 0, "col": 0, "row_span": 2, "col_span": 3, "text": "x"}]}, True) == [["x", "x"], ["x", "x"]]
    assert parsing.markdown([[" "]]) == "" and parsing.shape([]) == "empty"


REVIEW = "<table><tr><th>검토항목</th><th>검토의견</th><th>추정 사업기간</th></tr><tr><td colspan=3>1. 개요</td></tr><tr><td>① 기능</td><td>7개월 소요</td><td></td></tr><tr><td>② 비용</td><td>적정</td><td></td></tr><tr><td>③ 일정</td><td></td><td>추정 기간</td></tr><tr><td></td><td></td><td>6 개월</td></tr></table>"


def test_fields_of_read_pages(spark):
    items = [f"label: table\ncontent: {REVIEW}", "label: title\ncontent: 검토 결과서", "label: text\ncontent: 담당자: 홍길동", "label: footnote\ncontent: 주1) 참고", "broken"]
    lines = [("7개월 소요", 0.9), ("따로 있는 줄", 0.8), ("label: text", 0.9), ("확신 없는 줄", None)]
    schema = "id int, text string, items array<string>, lines array<struct<text:string,score:double>>"
    df = spark.createDataFrame([(1, None, items, lines), (2, None, None, None), (3, "x " + REVIEW, [], [("label: title", None), ("content: 제목", None)])], schema)
    got = {r["id"]: r["fields"] for r in ocr_fields.predicted(df).collect()}
    assert got[1]["문서명"] == ["검토 결과서"] and got[1]["담당자"] == ["홍길동"] and got[1]["검토항목"][:4] == ["개요", "기능", "비용", "일정"] and "7개월" in got[1]["추정 사업기간"] and got[2] == {} and got[3]["문서명"] == ["제목"]
    tables = ocr_fields.normalised_tables(df)
    t = {r["id"]: r for r in tables.collect()}
    assert t[1]["footnotes"] == ["주1) 참고", "담당자: 홍길동", "따로 있는 줄"] and [r["section"] for r in t[1]["records"]] == ["1. 개요", None, None, None, None]
    rows = t[1]["sections"][0]["rows"]
    assert [(r["item"], r["value"], r["source"]) for r in rows] == [("① 기능", "7개월", "inferred_token"), ("② 비용", "7개월", "carried_forward"), ("③ 일정", "6 개월", "direct_cell")] and t[1]["sections"][0]["section_title"] == "1. 개요"
    assert t[2]["records"] == [] and "1. 개요" in ocr_fields.preview(tables).where("id = 1").first()["html"]


def test_evaluation_of_read_images(spark):
    schema = "id string, doc_key string, type string, status string, latency_ms double, gt_text string, pred_text string, gt_structure string, pred_structure string, required_fields array<string>, table_html boolean, table_rows boolean"
    rows = [
        ("1", "d", "table", "success", 1.0, "가나 다라", "가나 다라", '{"a": {"b": ["x", "y"]}, "c": "z"}', '{"a": {"b": ["x", "q"]}, "c": "z"}', ["a.b", "e"], True, False), ("2", "d", "text", "error", None, None, None, None, "not json", None, None, None),
        ("3", "d", "text", "success", 2.0, "ab", "", '{"k": [{"n": "one"}, {"n": "two"}]}', '{"k": [{"n": "two"}, {"n": "one"}]}', None, None, None),
    ]
    df = spark.createDataFrame(rows, schema)
    done = ocr_eval.evaluated(df)
    got = {r["id"]: r for r in done.collect()}
    assert (got["1"]["matched"], got["1"]["gt_total"], got["1"]["micro_recall"], got["1"]["missing"]) == (2, 3, 0.666667, ["e"]) and got["1"]["review_reasons"] == ["structure_micro_recall<0.8", "required_field_missing", "table_rows_missing"]
    assert got["2"]["review_reasons"] == ["status_not_success"] and got["2"]["micro_recall"] == 1.0 and got["3"]["required"] == ["k.n"] and got["3"]["missing"] == [] and got["3"]["cer"] == 1.0
    s = ocr_eval.batch_summary(done).first()
    assert (s["images"], s["review_required"], s["fail_rate_pct"]) == (3, 2, 33.333333) and ocr_eval.batch_summary(done.limit(0)).first()["avg_similarity"] == 0.0
    old = done.where("id = '1'").withColumn("missing", F.array().cast("array<string>")).withColumn("review_reasons", F.array().cast("array<string>")).withColumn("review_required", F.lit(None).cast("boolean"))
    assert ocr_eval.refreshed(old).first()["missing"] == ["e"] and ocr_eval.refreshed(old).first()["review_required"]
    truth = spark.createDataFrame([("1", "a b", '{"f": ["a", "zz"]}', True), ("2", "x", "{}", False), ("3", "", None, None)], "id string, gt_text string, gt_structure string, use_eval boolean")
    read = spark.createDataFrame([("1", "a c", "success")], "id string, pred_text string, status string")
    e = {r["id"]: r for r in ocr_eval.explored(truth, read).collect()}
    assert e.keys() == {"1", "3"} and e["1"]["wer"] == 0.5 and (e["1"]["n_fields"], e["1"]["n_hits"]) == (2, 1) and e["3"]["status"] == "missing" and e["3"]["similarity"] == 1.0
    assert ocr_eval.explored_summary(ocr_eval.explored(truth, read)).first()["fail_rate"] == 0.5


def test_image_chain_and_paths(spark):
    kind = "struct<lines: array<struct<text:string,score:double>>, items: array<string>, status: string, latency_ms: double>"
    first = lambda c: F.from_json(F.concat(F.lit('{"lines": [{"text": "가 "}, {"text": "나"}], "items": ["'), c, F.lit('"], "status": "success", "latency_ms": 1.5}')), kind)
    again = lambda c: F.from_json(F.lit('{"lines": [{"text": "나", "score": 0.9}, {"text": "다", "score": 0.8}], "status": "success", "latency_ms": 2.0}'), kind)
    images = spark.createDataFrame([("1", "d", "table", "label: table"), ("2", "d", "text", "label: text")], "id string, doc_key string, type string, content string")
    got = {r["id"]: (r["pred_text"], r["latency_ms"]) for r in ocr_eval.image_chain(images, first, again).collect()}
    assert got == {"1": ("가\n나\n다", 3.5), "2": ("가\n나", 1.5)}
    truth = spark.createDataFrame([("1", "가 나 다", "{}", None), ("9", "x", "{}", None)], "id string, gt_text string, gt_structure string, required_fields array<string>")
    assert {r["id"]: r["status"] for r in ocr_eval.image_chain(images, first, again, truth).collect()} == {"1": "success", "9": "missing"}
    where = spark.createDataFrame([("gt/a.json", None, None), ("gt/b.jsonl", None, None), ("gt/b.json", None, None), ("gt/x.json", ["c_x_1"], None), ("gt/y.jsonl", None, ["e"])], "path string, ids array<string>, keys array<string>")
    wanted = spark.createDataFrame([(k,) for k in ("a", "b", "c", "c_x", "e", "z")], "doc_key string")
    assert {r["doc_key"]: r["path"] for r in ocr_eval.truth_file(where, wanted).collect()} == {"a": "gt/a.json", "b": "gt/b.jsonl", "c": "gt/x.json", "c_x": "gt/x.json", "e": "gt/y.jsonl", "z": "z.jsonl"}
    pics = spark.createDataFrame([("d", "r/d/a.png"), ("d", "r/d/b.jpg"), ("d", "r/d/b.PNG"), ("d", "r/d/c.txt")], "doc_key string, path string")
    asked = spark.createDataFrame([("d", "b.PNG"), ("d", "b.gif"), ("d", "none.png")], "doc_key string, image string")
    assert {r["image"]: r["path"] for r in ocr_eval.image_file(pics, asked).collect()} == {"b.PNG": "r/d/b.PNG", "b.gif": "r/d/b.jpg", "none.png": "r/d/a.png"}
    with pytest.raises(Exception, match="no images of e"):
        ocr_eval.image_file(pics, spark.createDataFrame([("e", "x.png")], "doc_key string, image string")).collect()


def test_samples_of_documents(spark):
    rows = [(f"c{i}", i, doc, ocr) for doc, n, k in (("few", 2, 1), ("many", 40, 9), ("images", 12, 12), ("plain", 30, 0)) for i in range(n) for ocr in [i < k]]
    df = spark.createDataFrame(rows, "chunk_id string, row_idx int, doc string, ocr boolean")
    got = {}
    for r in generation.sampled(df, 6).collect():
        got.setdefault(r["doc"], []).append((r["ocr"], r["row_idx"]))
    many = sorted(got["many"])
    assert len(got["few"]) == 2 and [i for o, i in many if o] == [0, 8] and [i for o, i in many if not o] == [9, 19, 29, 39]
    assert len(got["images"]) == 6 and {0, 11} <= {i for _, i in got["images"]} and sorted(i for _, i in got["plain"]) == [0, 6, 12, 17, 23, 29]
    assert generation.sampled(df.limit(0), 6).count() == 0
    again = spark.createDataFrame([("x", 0, "d", False), ("x", 1, "d", False), ("", 2, "d", False), ("", 3, "d", False)], df.schema)
    assert sorted(r["row_idx"] for r in generation.sampled(again, 9).collect()) == [0, 2, 3]


def test_rejected_and_broken_responses(spark):
    schema = "eval_id int, question string, doc string"
    qs = ["", "총 사업비는?", "해당 용역의 목표는?", "SFR-005 명칭은?", "양자암호 통신망 구축비는?", "화성 탐사선 발사일은?", None]
    chunks = spark.createDataFrame([("d", "양자암호 통신망 설명"), ("d", None)], "doc string, text string")
    got = {r["eval_id"]: r["reason"] for r in questions.reject_reasons(spark.createDataFrame([(i, q, "d") for i, q in enumerate(qs)], schema), chunks).collect()}
    assert got == {0: "empty_question", 1: "forbidden_phrase:총 사업비", 2: "doc_scoped_wording", 3: "requirement_id_in_question", 4: "corpus_keyword_overlap", 5: None, 6: "empty_question"}
    with pytest.raises(Exception, match="no array of questions"):
        generation.parsed(spark.createDataFrame([('{"x": 1}',)], "content string")).collect()
    given = spark.createDataFrame([("d", "prompt")], "doc string, prompt string")
    made = generation.generated(given, lambda ps: [json.dumps({"items": [{"question": " q ", "eval_focus": "OCR_IMAGE"}, {"question": ""}]})] * len(ps)).collect()
    assert [(r["question"], r["eval_focus"], r["gold_chunk_ids"]) for r in made] == [("q", "ocr_image", [])] and generation.generated(given).count() == 0


def test_judges(spark, data):
    rows = metrics.answer_metrics(metrics.retrieval_metrics(spark.read.parquet(f"{data}/eval_rows.parquet")))
    off = metrics.generation_scores(rows).agg(F.count("f_score")).first()[0]
    on = metrics.generation_scores(rows, providers.judged_generation(lambda xs: [(7, -1, 3)] * len(xs))).select("f_score", "r_score", "s_score", "faithfulness_given_answer", "refusal_kind").collect()
    assert off == 0 and {tuple(r)[:3] for r in on} == {(5, 0, 3)} and all((r["faithfulness_given_answer"] is None) == (r["refusal_kind"] == "full") for r in on)
    bad = metrics.generation_scores(rows, providers.judged_generation(lambda xs: 1 / 0)).first()
    assert bad["f_score"] == 0 and "division" in bad["judge_error"]
    t = spark.range(1).select(providers.without_thoughts(F.lit("<think>a\nb</think> yes <think>open")), providers.prefixed_embedding(F.lit("x"), True)).first()
    assert t[0] == "yes" and abs(sum(x * x for x in t[1]) - 1) < 1e-5


def test_blocks_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(blocks, "QUERIES", 3)
    rows = [(f"c{i}", i, [float(i % 7), float(i % 5), 1.0] if i % 11 else None, i % 3) for i in range(200)]
    df = spark.createDataFrame(rows, "chunk_id string, row_idx int, vector array<float>, label int").repartition(5)
    asked = spark.createDataFrame([(q, [1.0, float(q % 3), 0.5], q % 3 if q != 4 else None) for q in range(9)] + [(99, [0.0, 0.0, 0.0], 0)], "query_id int, vector array<float>, label int")
    for same in (None, "label"):
        got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in search.dense(asked, df, 4, same).collect()}
        want = {}
        for q, v, label in [tuple(r) for r in asked.collect()]:
            score = lambda x: sum(a * b for a, b in zip(v, x)) / ((sum(a * a for a in v) * sum(b * b for b in x)) ** 0.5)  # noqa: E731, B023
            fit = [(-round(score(x), 9), i, c) for c, i, x, k in rows if x and any(v) and (same is None or k == label and label is not None)]
            want |= {(q, n): c for n, (_, _, c) in enumerate(sorted(fit)[:4], 1)}
        assert got == want
    assert search.dense(asked, df.limit(0)).count() == 0 and search.dense(asked.limit(0), df).count() == 0


def test_jobs(spark, tmp_path):
    events = [("a.hwp", i, "paragraph", None, t, None, None, None, None) for i, t in enumerate(["1. 개요", "본문 문장이 충분히 길게 이어진다. " * 20, "2. 범위", "다른 본문 문장이다. " * 20])] + [("bad.hwp", 0, None, None, None, None, None, None, "ValueError: x")]
    df = spark.createDataFrame(events, HWP)
    done = pipeline.run(df, parsing.hwp_records)
    assert done["counters"].first().asDict() == {"target_files": 2, "error_files": 1, "prechunk_records": 2, "chunks": 2, "table_chunks": 0, "table_raw_rows": 0, "text_chunks": 2}
    assert [r["chunk_id"] for r in done["chunks"].orderBy("chunk_id").collect()] == ["slim_chunk_00000001", "slim_chunk_00000002"] and pipeline.run(df, parsing.hwp_records, 1)["errors"].count() == 0
    df.write.parquet(str(tmp_path / "events"))
    cli.main(["run-pipeline", str(tmp_path / "events"), str(tmp_path / "index")])
    index = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(r["row_idx"] for r in index.collect()) == [0, 1]
    asked = spark.createDataFrame([(1, "개요")], "query_id int, query string")
    asked.write.parquet(str(tmp_path / "q"))
    cli.main(["answer", str(tmp_path / "q"), str(tmp_path / "answers"), "--index", str(tmp_path / "index")])
    assert spark.read.parquet(str(tmp_path / "answers")).first()["sources"]
    more = index.withColumn("chunk_id", F.concat("chunk_id", F.lit("x"))).drop("row_idx")
    assert files.append_index(more, str(tmp_path / "index")) == 4 and spark.read.parquet(str(tmp_path / "index")).agg(F.max("row_idx")).first()[0] == 3
    with pytest.raises(ValueError, match="already"):
        files.append_index(more, str(tmp_path / "index"))
    with pytest.raises(FileNotFoundError):
        files.load_index(spark, str(tmp_path / "none"))
    cli.main(["index-metadata", str(tmp_path / "index"), str(tmp_path / "m.json"), "-k", "2"])
    assert len(json.loads((tmp_path / "m.json").read_text())) == 2
    cards = viewer.cards(spark.read.parquet(str(tmp_path / "index")).withColumn("doc_id", F.lit(1)))
    assert "slim_chunk_00000001" in viewer.page(cards, "t")


def test_settings(tmp_path):
    (tmp_path / "c.yaml").write_text("chunking:\n  chunk_size: 900\nretrieval:\n  hybrid:\n    enabled: false\ngeneration:\n  temperature: 1\n")
    c = config.load(tmp_path / "c.yaml")
    assert (c.chunking.chunk_size, c.chunking.chunk_overlap, c.retrieval.hybrid.enabled, c.generation.temperature) == (900, 200, False, 1.0) and config.load().retrieval.top_k == 10
    for text, match in (("chunks: {}", "unknown"), ("chunking: {chunk_size: big}", "must be int")):
        (tmp_path / "d.yaml").write_text(text)
        with pytest.raises(ValueError, match=match):
            config.load(tmp_path / "d.yaml")


def test_files_with_equal_names(spark, tmp_path):
    for d in ("x", "y"):
        (tmp_path / "in" / d).mkdir(parents=True)
        (tmp_path / "in" / d / "one.txt").write_text(d)
    meta = spark.createDataFrame([("x/one.txt", "DX"), ("y/one.txt", "DY")], "file_path string, doc_id string")
    got = {r["text"]: r["doc_id"] for r in files.load_documents(spark, str(tmp_path / "in"), meta).collect()}
    assert got == {"x": "DX", "y": "DY"}
    by_name = spark.createDataFrame([("one.txt", "D")], "file_path string, doc_id string")
    assert {r["doc_id"] for r in files.load_documents(spark, str(tmp_path / "in"), by_name).collect()} == {"D"}
    files.export_csv(spark.createDataFrame([(1, "가"), (2, None)], "a int, b string").coalesce(1), str(tmp_path / "o.csv"), ["b", "a", "c"])
    assert (tmp_path / "o.csv").read_bytes().startswith(b"\xef\xbb\xbfb,a,c")
    (tmp_path / "j.jsonl").write_text('{"a": 1}\n\n{"a": nope}\n')
    with pytest.raises(Exception, match="malformed line in .*j.jsonl"):
        files.read_json_lines(spark, str(tmp_path / "j.jsonl"), "a int", strict=True).collect()
    assert [r["name"] for r in files.discover(spark, str(tmp_path / "in"), pattern="*.txt").orderBy("pos").collect()] == ["one.txt", "one.txt"]


def test_stored_images_and_long_texts(spark):
    import gzip
    import zlib

    png = b"\x89PNG" + b"x" * 50
    raw = zlib.compressobj(wbits=-zlib.MAX_WBITS)
    packed = [png, zlib.compress(png), raw.compress(png) + raw.flush(), gzip.compress(png), b"no image", zlib.compress(b"no image"), None]
    df = spark.createDataFrame([(str(i), bytearray(c) if c is not None else None) for i, c in enumerate(packed)], "path string, content binary")
    assert {r["path"] for r in files.stored_images(df).collect() if bytes(r["content"]) == png} == {"0", "1", "2", "3"} and files.stored_images(df).count() == 4
    seen = []

    def picky(texts):
        seen.append(max(map(len, texts)))
        if seen[-1] > 2500:
            raise ValueError("too long")
        return [[1.0]] * len(texts)

    assert providers.shortened(picky)(["a" * 9000, "b"]) == [[1.0], [1.0]] and seen == [5000, 4000, 3000, 2000]
    with pytest.raises(ValueError):
        providers.shortened(lambda _t: picky(["a" * 9000]), ladder=[10])(["a"])
    p = spark.range(1).select(providers.prompt(F.lit("q"), F.lit("c"), None, F.lit("fact"), F.lit(True))).first()[0]
    assert providers.HINTS["fact"] in p and providers.COVER_HINT in p
