"""Packing, defective pairs, scans, ranking and mixing on small fixtures."""

import random
import statistics
from collections import Counter

import pytest
from pyspark.sql import functions as F

from gleanery.llm import mixing, packing, pairs, queries, ranking, scans, sql

ROWS = "row_id long, file_name string, table_id string, row_index int, _rag_row_text string, chunk_id string"


def test_genetic_packing_reaches_the_bound():
    rng = random.Random(3)
    sizes = [s for _ in range(12) for s in (lambda a, b: (a, b, 100 - a - b))(rng.randint(20, 45), rng.randint(20, 45))]
    bound = packing.lower_bound(sizes, 100)
    assert bound == 12
    best = packing.evolve([packing.best_fit(list(range(len(sizes))), sizes, 100)], sizes, 100, bound, 1, 60)[0]
    assert sorted(i for b in best for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 100 for b in best)
    assert len(best) <= len(packing.best_fit(list(range(len(sizes))), sizes, 100))


def test_packing_of_tables(spark):
    rng = random.Random(1)
    rows = [(i, "f", "t", rng.randint(0, 50), "x" * rng.randint(1, 700), "c") for i in range(300)]
    rows += [(1000, "f", "u", None, None, "c"), (1001, "f", "u", 1, "", "c"), (1002, None, None, 1, "word " * 700, "c"), (1003, None, None, 1, "y", "c"), (1004, "f", "u", 2, "z" * 1200, "c"), (1004, "f", "u", 2, "z" * 1200, "c")]
    df = spark.createDataFrame(rows, ROWS)
    for block in (40, 512):
        placed = packing.packed(df, block=block).collect()
        fills: dict = {}
        for r in placed:
            if r["chunk_id"] is None:
                assert r["size"] == 0
            else:
                fills.setdefault((r["file_name"], r["table_id"], r["chunk_id"]), []).append(r["size"])
        assert all(sum(f) + len(f) - 1 <= 1200 for f in fills.values())
        assert sum(r["size"] for r in placed) == sum(len(r[4] or "") for r in rows)
        least = -(-sum(len(r[4]) + 1 for r in rows[:300]) // 1201)
        assert sum(k[1] == "t" for k in fills) <= least * 1.06 + 1
        assert {r["row_id"] for r in placed if r["n_chars"] > 1200} == {1002}
    texts = packing.chunk_texts(df, packing.packed(df)).collect()
    assert max(r["n_chars"] for r in texts) <= 1200
    assert packing.packed(df.limit(0)).count() == 0


QA = "eval_id long, question_type string, question string, answer string"


# refusals recur across unrelated prompts, which is what reveals them
RECURRING = [
    (1000 + 10 * i + j, "fact", q, a)
    for i, a in enumerate(["제공된 문서에서 관련 내용을 찾을 수 없습니다.", "해당 내용은 문서에서 확인할 수 없습니다.", "이 질문에는 답변을 드릴 수 없습니다.", "No relevant document was found.", "No such passage was found."])
    for j, q in enumerate(["공사 기간은 며칠입니까?", "보증금은 얼마인가요?", "Who signs the form?", "When does the trial start?"])
]


def test_defects(spark):
    kinds = ["Where is the {} installed?", "What documents does {} ask for?", "How long is the warranty on {}?", "Who approves changes to {}?"]
    rows, want = [], {}
    for i in range(40):
        q = kinds[i % 4].format(f"unit {i}")
        rows.append((i, "fact", q, ["Server room 7, floor 2", "- signed bid form\n- 6 references", f"{i} months", "Changes are approved in writing by the office."][i % 4]))
    extra = [
        ("fact", "Where is it installed?", None, "empty"), ("fact", "Where is it?", "```\n```", "empty"), (None, "Where is it?", "N/A", "empty"), ("fact", "Where is the pump installed?", "Where is the pump installed?", "copy"),
        ("fact", "지역 제한이 있습니까?", "제공된 문서에서 해당 내용을 찾을 수 없습니다. 다른 질문이 있으시면 알려 주세요.", "refusal"), ("unanswerable", "지역 제한이 있습니까?", "제공된 문서에서 해당 내용을 찾을 수 없습니다.", None),
        (None, "Where is the old pump?", "No relevant passage was found.", "refusal"), ("fact", "Where is the old pump?", "The pump stands in hall 3.\nThe exact date is not given in the documents.", None),
        ("fact", "Where is the pump installed?", "Le titulaire doit remettre le rapport dans un délai de 3 mois.", "wrong_language"), ("fact", "영문 명칭은 무엇인가요? 영어로 답해 주세요.", 'The English title is "plan", phase 7.', None),
        ("fact", "적용할 규격은 무엇입니까?", "SSO, VPN, API Gateway v7.5", None), ("fact", "What is required?", "The office must keep the list and\n| no | name |\n|---|---|\n| 1 | A |\n| 2", "truncated"),
        ("fact", "What is required?", 'The office asked for "the full', "truncated"), (None, None, None, "empty"),
    ]
    for k, (kind, q, a, d) in enumerate(extra, 100):
        rows.append((k, kind, q, a))
        if d:
            want[k] = d
    df = spark.createDataFrame(rows + RECURRING, QA)
    assert {r["eval_id"]: r["defect"] for r in pairs.defects(df).collect()} == want | {r[0]: "refusal" for r in RECURRING}
    assert pairs.defects(df.limit(0)).count() == 0


def test_openings_cluster_by_verified_minhash(spark):
    names = [f"현재 검색된 단락에는 {x} 이야기가 없네요." for x in ("보안 장비", "전산 설비", "교육 교재", "하도급 계획")]
    df = spark.createDataFrame([(n,) for n in [*names, "제안서는 원본 #부와 사본 #부를 제출한다."]], "opening string")
    got = {r["opening"]: r["cluster"] for r in pairs.clusters(df).collect()}
    assert len({got[n] for n in names}) == 1 and len(set(got.values())) == 2


def test_refusals_that_end_a_long_sentence(spark):
    long = "제안요청서의 여러 장과 별지 서식 그리고 첨부된 기술 문서를 차례대로 " * 4
    rows = [(1, "fact", "지역 제한이 있습니까?", long + "살펴보아도 해당 내용을 찾을 수 없습니다."), (2, "fact", "지역 제한이 있습니까?", "해당 내용을 찾을 수 없습니다. " + long + "보았지만 답변을 드릴 수 없습니다.")]
    sound = [(2000 + i, "fact", "무엇을 제출합니까?", f"제출 서류는 {a} {b} {i}부이다.") for i, (a, b) in enumerate((a, b) for a in ("서약서와", "확약서와", "명세서와", "위임장과", "도면과", "각서와", "견적서와") for b in ("사진", "통장 사본", "계획", "원본", "신청서", "등본"))]
    got = pairs.defects(spark.createDataFrame(rows + RECURRING + sound, QA)).where("eval_id < 1000").collect()
    assert {r["eval_id"]: r["defect"] for r in got} == {1: "refusal", 2: "refusal"}


def test_minhash_links_find_what_brute_force_finds(spark, data):
    pool = sorted({u["text"] for r in pairs.features(spark.read.parquet(f"{data}/../sf0.01/eval_rows.parquet")).collect() for u in r["units"] if u["unable"] or u is r["units"][0]})
    shingles = [pairs._shingles(t) for t in pool]
    true = {(pool[i], pool[j]) for i in range(len(pool)) for j in range(i) if len(shingles[i] & shingles[j]) >= 0.5 * len(shingles[i] | shingles[j])}
    own: dict = {}
    for m in pairs.bands(spark.createDataFrame([(t,) for t in pool], "opening string")).collect():
        own.setdefault(m["opening"], set()).add(m["band"])
    met = sum(bool(own[a] & own[b]) for a, b in true)
    assert len(true) > 50 and met >= 0.95 * len(true), (met, len(true))


def test_masked_words_of_the_prompt():
    assert pairs.starred("Where is the archive unit?", "the archive unit is in hall #") == "* in hall #"
    assert pairs.starred("보안 장비의 수량은?", "보안 장비의 수량은 #대이다") == "* #대이다"
    assert pairs.starred("", "no such text") == "no such text"


def test_ends_of_any_length(spark):
    long = "x" * 40
    rows = [(i, "fact", "What is it?", f"It is the {long}") for i in range(12)] + [(50 + i, "fact", "What is it?", f"It is the {long}{i}tail of it.") for i in range(200)]
    got = pairs.unsound_ends(pairs.features(spark.createDataFrame(rows, QA))).where("cut").collect()
    assert {r["eval_id"] for r in got} == set(range(12))


def test_every_pair_of_a_band_is_verified(spark, monkeypatch):
    rng = random.Random(2)
    texts = ["".join(rng.choice("abcdefgh") for _ in range(40)) for _ in range(8)]
    for _ in range(14):  # chains: each is like the one before, not like the first
        texts += ["".join(c if rng.random() < 0.93 else rng.choice("xyz") for c in t) for t in texts[-8:]]
    texts = sorted(set(texts))
    shingles = [pairs._shingles(t) for t in texts]
    alike = [(i, j) for i in range(len(texts)) for j in range(len(texts)) if len(shingles[i] & shingles[j]) >= 0.5 * len(shingles[i] | shingles[j])]
    assert sorted(pairs._alike(shingles, shingles)) == alike
    df = spark.createDataFrame([(t,) for t in texts], "opening string")
    marks = pairs.bands(df).collect()
    own: dict = {}
    for m in marks:
        own.setdefault(m["band"], set()).add(m["opening"])
    near: dict = {t: {t} for t in texts}
    for i, j in alike:
        if any({texts[i], texts[j]} <= b for b in own.values()):
            near[texts[i]].add(texts[j])
    want = {t: t for t in texts}
    while (new := {t: min(want[x] for x in near[t]) for t in texts}) != want:
        want = new
    for block in (256, 5):
        monkeypatch.setattr(pairs, "BLOCK", block)
        assert {r["opening"]: r["cluster"] for r in pairs.clusters(df).collect()} == want


def test_repair_of_scans(spark):
    known = {w: 500 for w in "the contractor shall deliver report every month to project office and keep all records of system maintenance in archive".split()}
    reader = scans.Reader(known)
    page = "PLAN OF WORK\nThe contractor shall deliver the rep-\nort every month to the project off-\nice and keep all rec0rds of the\n- 3 -\n\fPLAN OF W0RK\nsystem maintenance in the archive.\n- 4 -\n\fPLAN OF WORK\nThe contractor shall keep the archive."
    text, traces = scans.repair(page, reader)
    assert "report every month" in text and "office and keep all records of the system maintenance" in text and "- 3 -" not in text and "\f" not in text
    assert traces["page_numbers"] == 2 and traces["broken_words"] >= 2
    for sound in ("The contractor shall deliver the\nreport every month to the\nproject office.", "Points\n6\n15\n23\nThe office shall keep all records.", "1. report ........ 12\n2. archive ....... 13", "A5L5-85\t13\t87,481,000", "the report"):
        assert scans.repair(sound, reader) is None
    df = spark.createDataFrame([("chunk", "a", None), ("chunk", "b", ""), ("chunk", "c", "word " * 3), ("document", "d", page)], "rec_kind string, rec_id string, text string")
    out = {r["rec_id"]: r["text"] for r in scans.repaired(df).collect()}
    assert out["a"] is None and out["b"] == "" and out["c"] == "word " * 3
    assert scans.repaired(df.limit(0)).count() == 0


def test_frequent_misreadings_are_misreadings():
    reader = scans.Reader({"the": 5000, "tlie": 40, "thc": 190, "arc": 201})
    assert reader.word("tlie") == ("the", False) and reader.word("Thc") == ("The", False)
    assert reader.word("the") is None and reader.word("arc") is None


def test_rare_words_keep_their_counts(spark):
    texts = ["the req is here and the req is there", "reg reg reg reg reg reg", "판을 관을 관을 été Été", None, ""]
    df = spark.createDataFrame([("chunk", str(i), t) for i, t in enumerate(texts)], "rec_kind string, rec_id string, text string")
    assert not any(r["scanned"] for r in scans.repaired(df).collect())  # reg is no 25 times as frequent as req
    counts, total = scans.vocabulary(df)
    want = {r["word"]: r["n"] for r in counts.collect()}
    assert want == Counter(w for t in texts if t for w in t.lower().split()) and total == sum(want.values())
    hashes, ns = map(scans.SparkFiles.get, scans._shipped(counts))
    known = scans.Counts(hashes, ns)
    assert {w: known.get(w) for w in [*want, "absent"]} == want | {"absent": 0}


def test_running_lines_are_compared_with_all_lines():
    page = "사업개요\n본 사업은 전산 장비를 새로 들여\n- 1 -\n\f사엄개요\n운영하는 데 필요한 모든 일을\n- 2 -\n\f사업개묘\n기간 안에 끝내는 것이다."
    lines = page.split("\n")
    assert {3, 6} <= scans.running_lines(lines, scans.page_numbers(lines))
    rng = random.Random(4)
    for _ in range(60):
        words = ["".join(rng.choice("abcde가나다라") for _ in range(rng.randint(2, 9))) for _ in range(4)]
        lines = ["".join(c if rng.random() < 0.85 else rng.choice("abc가") for c in " ".join(rng.sample(words, rng.randint(1, 4)))) for _ in range(rng.randint(2, 30))]
        fit = [i for i, x in enumerate(lines) if len(x) > 2]
        groups: list = []
        for i in fit:
            key = scans._plain(lines[i])
            own = next((g for g in groups if scans._alike(key, scans._plain(lines[g[0]]))), None)
            own.append(i) if own else groups.append([i])
        assert scans._groups(lines, fit, set(fit)) == (groups, [scans._plain(lines[g[0]]) for g in groups])
        few = set(fit[:2])
        assert [g for g in scans._groups(lines, fit, few)[0] if len(g) > 1 and few & set(g)] == [g for g in groups if len(g) > 1 and few & set(g)]


HITS = "eval_id long, chunk_id string, scorer string, score double, rank long"


def test_ranking_against_brute_force(spark):
    rng = random.Random(5)
    rows = [(q, f"c{rng.randint(0, 8)}", s, rng.choice([1.0, 2.0, 3.0, 1e300, -5.0, None, float("nan")]), 1) for q in (1, 2) for s in ("a", "b", "c") for _ in range(9)]
    rows += [(3, "only", "a", 7.0, 1), (None, "x", "a", 1.0, 1), (4, None, "a", 1.0, 1)]
    df = spark.createDataFrame(rows, HITS)
    got = sorted((r["eval_id"], r["rank_no"], r["chunk_id"], r["median_rank"], r["mean_rank"]) for r in ranking.median_ranking(df).collect())
    best: dict = {}
    for q, c, s, v, _ in rows:
        if None not in (q, c, v) and v == v:
            best[q, s, c] = max(v, best.get((q, s, c), v))
    want = []
    for q in (1, 2, 3):
        lists = {s: {c: v for (qq, ss, c), v in best.items() if (qq, ss) == (q, s)} for s in "abc"}
        lists = {s: v for s, v in lists.items() if v}
        ranks = {}
        for c in {c for v in lists.values() for c in v}:
            own = []
            for v in lists.values():
                own.append(sum(x > v[c] for x in v.values()) + (sum(x == v[c] for x in v.values()) + 1) / 2 if c in v else len(v) + 1)
            ranks[c] = (round(statistics.median(own), 6), round(sum(own) / len(own), 6), c)
        want += [(q, i, c, *ranks[c][:2]) for i, c in enumerate(sorted(ranks, key=ranks.get), 1)]
    assert got == want
    assert ranking.median_ranking(df.limit(0)).count() == 0


def test_budgets_go_to_siblings_first():
    leaves = [dict(domain="d", lang="ko", source="a", weight=0.4, room=10.0), dict(domain="d", lang="ko", source="b", weight=0.2, room=1000.0), dict(domain="e", lang="en", source="c", weight=0.4, room=1000.0)]
    root = mixing.tree(leaves)
    mixing.spread(root, 100.0)
    got = {x.name: round(x.budget, 6) for x in mixing._leaves(root)}
    assert got == {"a": 10.0, "b": 50.0, "c": 40.0}


def test_mix(spark):
    docs = [(i, "big_x" if i % 3 else "small_x", ["ko", "KO", None][i % 3], "w " * (5 + i % 7)) for i in range(200)] + [(500, None, "ko", "a"), (501, "other_x", "ko", "a b"), (502, "big_x", "ko", None), (503, "big_x", "ko", "")]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string")
    goals = spark.createDataFrame([("big_x", 0.5, 1), ("small_x", 0.4, 3), ("missing_x", 0.1, 2), (None, 0.3, 1)], "source string, target_share double, max_repeats int")
    chosen, shares = mixing.mix(df, goals)
    rows = chosen.collect()
    assert max(r["times"] for r in rows if r["source"] == "big_x") <= 1 and max(r["times"] for r in rows if r["source"] == "small_x") <= 3
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["big_x"]["actual_share"] - 5 / 9) < 0.02 and abs(got["small_x"]["actual_share"] - 4 / 9) < 0.02 and got["missing_x"]["tokens"] == 0
    again = sorted(map(tuple, mixing.mix(df, goals)[0].collect()))
    assert again == sorted(map(tuple, rows))
    empty, none = mixing.mix(df.limit(0), goals)
    assert empty.count() == 0 and none.count() == 3


def test_mix_passes_shortages_to_siblings(spark):
    docs = [(1000 * k + i, s, lang, "w " * 10) for k, (s, lang, n) in enumerate([("a_x", "ko", 10), ("b_x", "ko", 300), ("b_x", "en", 300), ("c_y", "ko", 900)]) for i in range(n)]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string")
    goals = spark.createDataFrame([("a_x", 0.3, 1), ("b_x", 0.2, 2), ("c_y", 0.4, 1), ("gone_y", 0.1, 1)], "source string, target_share double, max_repeats int")
    each = mixing.token_counts(df.limit(1), ["doc_id"]).first()["n_tokens"]
    domains = spark.createDataFrame([(s, s[-1]) for s in ("a_x", "b_x", "c_y", "gone_y", "none_z")], "source string, domain string")
    got = {r["source"]: r for r in mixing.mix(df, goals, total=600 * each, domains=domains)[1].collect()}
    # a_x lacks 170 documents, b_x of its domain gets them; gone_y has none, c_y of its domain gets them
    assert {s: round(r["budget"] / each) for s, r in got.items()} == {"a_x": 10, "b_x": 290, "c_y": 300, "gone_y": 0}
    # within b_x the rest of a_x goes to its Korean documents, not to the English ones
    chosen = mixing.mix(df, goals, total=600 * each, domains=domains)[0].where("source = 'b_x'").join(df.select("doc_id", "lang"), "doc_id")
    assert {r["lang"]: r["n"] for r in chosen.groupBy("lang").agg(F.sum("times").alias("n")).collect()} == {"ko": 230, "en": 60}


def _poured(nodes: list[dict], total: float, levels: tuple[str, ...]) -> dict[str, float]:
    """Budgets of leaves by filling each level in small drops, always where the level stands lowest."""
    if not levels:
        return {nodes[0]["source"] + "/" + nodes[0]["lang"]: total}
    groups: dict[str, list[dict]] = {}
    for n in nodes:
        groups.setdefault(n[levels[0]], []).append(n)
    weight = {g: sum(n["weight"] for n in ns) for g, ns in groups.items()}
    room = {g: sum(n["room"] for n in ns) for g, ns in groups.items()}
    low, high = 0.0, 1e12
    for _ in range(200):  # the level at which all open parts together hold the total
        level = (low + high) / 2
        low, high = (level, high) if sum(min(room[g], level * weight[g]) for g in groups) < min(total, sum(room.values())) else (low, level)
    out: dict[str, float] = {}
    for g, ns in groups.items():
        out |= _poured(ns, min(room[g], high * weight[g]), levels[1:])
    return out


def test_scarce_budgets_against_brute_force():
    rng = random.Random(9)
    for _ in range(30):
        rows = [dict(domain=rng.choice("de"), lang=rng.choice(["ko", "en"]), source=f"s{i}", weight=rng.random(), tokens=t, room=float(t * rng.randint(1, 4))) for i in range(8) if (t := rng.choice([0, 5, 50, 500, 5000])) is not None]
        root = mixing.tree(rows)
        mixing.spread(root, float(mixing.whole_supply(rows)))
        got = {s + "/" + lang: x.budget for (_, lang, s), x in mixing._placed(root).items()}
        want = _poured(rows, float(mixing.whole_supply(rows)), ("domain", "lang", "source"))
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-3 for k in got)


def test_domains_are_the_agencies_of_most_tokens(spark):
    docs = [(i, s, "ko", "w " * n, {"agency": a} if a else None) for i, (s, n, a) in enumerate([("a", 50, "x"), ("a", 10, "y"), ("b", 9, "x"), ("b", 500, None), ("c", 80, "z"), ("c", 5, "x")])]
    df = spark.createDataFrame(docs, "doc_id long, source string, lang string, text string, metadata map<string,string>")
    goals = spark.createDataFrame([("a", 0.3, 1), ("b", 0.3, 1), ("c", 0.3, 1), ("d", 0.1, 1)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r["domain"] for r in mixing.mix(df, goals, total=mixing.whole_supply)[1].collect()}
    assert got == {"a": "x", "b": "x", "c": "z", "d": None}


def test_every_query_runs(spark, data):
    for name, query in queries.queries().items():
        assert query(spark, data).limit(1_000_000).count() >= 0, name


def test_sql_gives_the_same(spark, data):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "chunks", "table_rows", "eval_rows", "ranked_chunks", "mix_targets"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    for name, text in sql.oracle_sql().items():
        df = queries.queries()[name](spark, data)
        cols = sorted(df.columns)
        got = sorted(map(repr, (tuple(r) for r in df.select(*[F.col(c) for c in cols]).collect())))
        rel = con.sql(text)
        order = [rel.columns.index(c) for c in cols]
        want = sorted(repr(tuple(r[i] for i in order)) for r in rel.fetchall())
        assert got == want, name
