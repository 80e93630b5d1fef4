"""Islands, cleaned records and table chunks against plain sequential versions."""

import random

from pyspark.sql import functions as F

from gleanery.functions.islands import scan
from gleanery.operators import prechunk, structure, tables
from gleanery.operators.splitters import _clean, oversized


def test_scan_in_groups_of_any_size(spark):
    rng = random.Random(1)
    rows = [(g, i, rng.choice([None, 1, 2, 3])) for g in (None, "a", "hot") for i in range(3 if g == "a" else 400)]
    df = spark.createDataFrame(rows, "g string, i int, v int").repartition(7)
    got = {(r["g"], r["i"]): (r["prev_v"], r["last_v"], r["upto_v"]) for r in scan(df, ["g"], ["i"], lag=["v"], fill=["v"], total=["v"]).collect()}
    before, last, total = {}, {}, {}
    for g, i, v in rows:
        assert got[g, i] == (before.get(g), v if v is not None else last.get(g), total.get(g, 0) + (v or 0)), (g, i)
        before[g], total[g] = v, total.get(g, 0) + (v or 0)
        last[g] = v if v is not None else last.get(g)
    assert scan(df.limit(0), ["g"], ["i"], lag=["v"]).count() == 0


def test_hot_file_spreads_over_tasks(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 10 > 0, "hot").otherwise("cold").alias("f"), F.col("id").alias("pos"), (F.col("id") % 7 == 0).cast("int").alias("v"))
    out = scan(df, ["f"], ["pos"], total=["v"])
    sizes = df.repartitionByRange(8, "f", "pos").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0]
    assert sizes <= 0.2 * 20_000 and out.where("f = 'hot'").agg(F.max("upto_v")).first()[0] == df.where("f = 'hot' AND v = 1").count()


RECORD = "file_name string, pos int, content_type string, section_path array<string>, text string"


def _sequential(rows, strict=True):
    """The rules of cleaning, record by record."""
    noise = lambda h, p, b: any(prechunk._rules(prechunk._Plain, h, p, b))
    nodes, counts = set(), {}
    for f, _, _, path, text in rows:
        for d in range(1, len(path) + 1):
            if (f, tuple(path[:d])) not in nodes:
                nodes.add((f, tuple(path[:d])))
                if not noise(path[d - 1], " > ".join(path[:d]), text or ""):
                    k = counts.setdefault((f, d), {})
                    k[prechunk._Plain.kind(path[d - 1])] = k.get(prechunk._Plain.kind(path[d - 1]), 0) + 1
    allowed = {}
    for (f, d), k in counts.items():
        good = {x for x, n in k.items() if n >= 2 or n / sum(k.values()) >= 0.15}
        allowed.setdefault(f, {})[d] = good or {max(k, key=lambda x: (k[x], x))}
    out, told = [], set()
    for f, pos, kind, path, text in rows:
        if kind != "section_text":
            continue
        text, kept, dropped = _clean(text or ""), [], []
        for d, h in enumerate(path, 1):
            bad = noise(h, " > ".join(path[:d]), text if d == len(path) else "") or (strict and d in allowed.get(f, {}) and prechunk._Plain.kind(h) not in allowed[f][d])
            (dropped if bad else kept).append(h)
        lines = [h for h in dropped if (f, tuple(kept), h) not in told]
        told |= {(f, tuple(kept), h) for h in lines}
        text = _clean("\n".join([*lines, text]))
        if text:
            out += [(f, pos, n, p, t) for n, (p, t) in enumerate(prechunk._split_inline(text, kept, allowed[f]) if allowed.get(f) else [(kept, text)], 1)]
    return out


def test_cleaned_records_against_a_sequential_version(spark):
    rng = random.Random(3)
    heads = ["Ⅰ. 사업 개요", "Ⅱ. 과업 내용", "1. 추진 배경", "2. 추진 방향", "가. 범위", "나. 기간", "담당자: 홍길동", "계약 금액: 3억원", "제출 서류는 다음과 같이 작성하여 기한 안에 제출하여야 한다", "1) 목록"]
    body = ["1. 새로운 절", "본문이 이어진다.", "가. 하위 항목", "1) 첫째", "2) 둘째", "", "마지막 문장이다."]
    rows = [(f, i, "section_text" if rng.random() < 0.9 else "table", [rng.choice(heads[:2]), *rng.sample(heads[2:], rng.randint(0, 2))], "\n".join(rng.sample(body, rng.randint(1, 6)))) for f in ("a", "b") for i in range(60)]
    got = [(r["file_name"], r["pos"], r["part"], list(r["section_path"]), r["text"]) for r in prechunk.clean(spark.createDataFrame(rows, RECORD)).orderBy("file_name", "pos", "part").collect()]
    assert got == _sequential(rows)
    empty = prechunk.clean(spark.createDataFrame([], RECORD))
    assert empty.count() == 0 and prechunk.text_chunks(prechunk.grouped(empty)).count() == 0


def test_continued_texts_take_the_deeper_path(spark):
    rows = [("f", 0, "section_text", ["1. 일반 사항", "가. 적용"], "내용이 있다."), ("f", 1, "section_text", ["1. 일반 사항", "대표자: 홍길동"], "② 다음 내용이다."), ("f", 2, "section_text", None, None), ("f", 3, "cover_text", ["x"], "표지"), ("f", 4, "section_text", ["2. 계약", "나. 조건"], "조건이다.")]
    got = {r["pos"]: list(r["section_path"]) for r in prechunk.clean(spark.createDataFrame(rows, RECORD)).collect()}
    assert got == {0: ["1. 일반 사항", "가. 적용"], 1: ["1. 일반 사항", "가. 적용"], 3: [], 4: ["2. 계약", "나. 조건"]}


def test_groups_of_cleaned_texts(spark):
    rows = [("f", i, "section_text", ["1. 절" if i < 3 else "2. 절"], f"문장 {i}이 여기에 있다.") for i in range(6)] + [("g", 0, "section_text", ["1. 절"], "다른 파일이다.")]
    groups = prechunk.grouped(prechunk.clean(spark.createDataFrame(rows, RECORD))).orderBy("file_name", "pos").collect()
    assert [(r["file_name"], r["n"]) for r in groups] == [("f", 3), ("f", 3), ("g", 1)] and groups[0]["text"].count("\n\n") == 2


ROW = "file_name string, table_id string, row_order long, row_index int, cells map<string,string>, text string, extra string"


def test_table_chunks_against_a_sequential_version(spark):
    rng = random.Random(5)
    rows = []
    for t in range(4):
        for i in range(rng.randint(1, 90)):
            cells = {"이름": f"항목 {rng.randint(0, 30)}", "col_2": rng.choice(["같음", "다름", ""]), "내용": "가 나 다. " * rng.choice([1, 5, 30, 200])} if rng.random() < 0.8 else None
            rows.append(("f", f"t{t}", i, i if rng.random() < 0.9 else None, cells, rng.choice(["글", None, "  "]), "x"))
    df = spark.createDataFrame(rows, ROW)
    kept = df.select("file_name", "table_id", "row_order", "row_index", F.map_keys("cells"), "text", "extra", "cells").collect()
    rows = [(*r[:4], {k: r["cells"][k] for k in r[4]} if r[4] is not None else None, r["text"], r["extra"]) for r in kept]  # cells in the order that Spark keeps
    got = {}
    for r in tables.pack(tables.distinct_rows(df)).collect():
        got.setdefault(r["table_id"], []).append((r["no"], r["body"], r["row_range"]))
    for t in range(4):
        seen, parts = set(), []
        for _, tid, _, index, cells, text, _ in rows:
            if tid != f"t{t}":
                continue
            told = [(k, v.strip()) for k, v in (cells or {}).items() if v.strip() and v.strip() != k]
            lines = [v if k.startswith("col_") else f"{k}: {v}" for n, (k, v) in enumerate(told) if not (k.startswith("col_") and v.replace(" ", "") in [x.replace(" ", "") for _, x in told[:n]])]
            body = "\n".join(lines) if lines else _clean(text or "")
            key = "".join(body.split()).lower()
            if key and key not in seen:
                seen.add(key)
                parts.append((_clean((f"행 {index}\n" if index is not None else "") + body), index))
        want, held = [], []
        for p, index in [*parts, (None, None)]:
            if p is None or held and (sum(len(x) + 2 for x, _ in held) + 2 + len(p) > 1200 or len(held) >= 30) or len(p or "") > 1200:
                if held:
                    ids = [str(i) for _, i in held if i is not None]
                    want.append(("\n\n".join(x for x, _ in held), "" if not ids else ids[0] if len(ids) == 1 else f"{ids[0]}-{ids[-1]}"))
                held = []
            if p and len(p) > 1200:
                want += [(x, "" if index is None else str(index)) for x in oversized(p, 1200, 80)]
            elif p:
                held.append((p, index))
        assert [(b, r) for _, b, r in sorted(got.get(f"t{t}", []))] == want
    assert tables.pack(tables.distinct_rows(df.limit(0))).count() == 0


def test_each_table_by_the_first_of_what_it_has(spark):
    facts = spark.createDataFrame([
        ("f", "rows", 1, ["A", "B"], "data_table", 2, 2, None, None, None, "short note"), ("f", "groups", 2, ["A"], "schedule_table", 9, 3, [("1-8", "x\ny"), ("9-9", "z " * 900)], ["unused"], "unused", None),
        ("f", "lines", 3, ["A"], "form_table", 3, 1, None, ["one", "two", "w" * 1500, "", "three"], "unused", None), ("f", "text", 4, None, None, 1, 1, None, None, "| a |\n| --- |", None), ("f", "none", 5, ["A"], "data_table", 0, 0, None, None, None, None),
    ], "file_name string, table_id string, pos int, section_path array<string>, table_type string, n_rows int, n_cols int, row_groups array<struct<row_range:string,text:string>>, summary_lines array<string>, markdown string, context string")
    rows = spark.createDataFrame([("f", "rows", 1, 1, {"k": "v"}, None, "x"), ("f", "rows", 2, 2, {"k": "w"}, None, "x"), (None, None, 3, 1, {"k": "v"}, None, "x")], ROW)
    got = {}
    for r in tables.chunks(facts, rows).collect():
        got.setdefault(r["table_id"], []).append(r)
    kinds = {t: sorted({r["chunk_type"] for r in rs}) for t, rs in got.items()}
    assert kinds == {"rows": ["table_rows/data_table"], "groups": ["table_group/schedule_table"], "lines": ["table_summary/form_table"], "text": ["table_markdown/table"]}
    one = got["rows"][0]
    assert "직전본문: short note" in one["text"] and "행 1\nk: v\n\n행 2\nk: w" in one["text"] and one["row_range"] == "1-2" and one["metadata"]["deduped_table_rows"] == "2"
    assert [r["part"] for r in sorted(got["groups"], key=lambda r: r["chunk_id"])] == [None, None, 2] and len(got["lines"]) == 4


def test_tables_that_go_on(spark):
    schema = "file_name string, pos int, section_path array<string>, table_type string, n_cols int, header array<string>, table_id string"
    t = lambda f, p, i, kind="data_table", n=2, h=("a", "b"): (f, p, ["S"], kind, n, list(h), i)
    rows = [t("f", 0, "1"), t("f", 2, "2"), t("f", 3, "3", "schedule_table"), t("f", 5, "4"), t("f", 6, "5", h=("x", "y")), t("f", 7, "6", n=0), t("f", 8, "7", n=0), t("g", 0, "8"), t("g", 1, "9", h=())]
    gaps = spark.createDataFrame([("f", 1, "section_text", "짧다"), ("f", 4, "section_text", "길다 " * 40)], "file_name string, pos int, content_type string, text string")
    got = {r["table_id"]: (r["group"], r["role"], r["came_from"], r["goes_to"]) for r in tables.continued(spark.createDataFrame(rows, schema), gaps).collect()}
    one, two = "table_continuation_0001", "table_continuation_0002"
    assert got == {"1": (one, "start", None, "2"), "2": (one, "continued", "1", "3"), "3": (one, "continued", "2", None), "8": (two, "start", None, "9"), "9": (two, "continued", "8", None)} | {i: (None, None, None, None) for i in "4567"}
    line = tables.continuation_line(F.lit(one), F.lit("continued"), F.lit("2"), F.lit("1"), F.lit("3"))
    assert spark.range(1).select(line).first()[0] == f"[TABLE CONTINUATION {one}] Table 2 continues from table 1. Continued to table 3."


def test_scope_deletes_what_it_wrote(spark):
    from gleanery import storage

    with storage.scope(spark):
        df = storage.shared_table(spark.range(5))
        files = df.inputFiles()
        assert df.count() == 5
    import os

    assert files and not any(os.path.exists(f.removeprefix("file://").replace("file:", "")) for f in files)


def test_runs(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 2, "a"), ("k", 3, None), ("k", 4, None), ("k", 5, "a"), (None, 1, "a")], "k string, p int, t string")
    got = sorted((r["k"] or "", r["island"], r["n"], r["t"] or "") for r in structure.runs(df, ["t"], "k", "p").collect())
    assert got == [("", 1, 1, "a"), ("k", 1, 2, "a"), ("k", 2, 2, ""), ("k", 3, 1, "a")]
