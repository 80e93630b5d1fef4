"""Metrics of retrieved contexts and of answers, as expressions on one row, and their summaries.

``sources`` is array<struct<chunk_id, text, score, metadata>>.  Null means that a metric does not apply.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

#: Rank to which recall looks; the column keeps its customary name recall_at_5.
RECALL_K = 10
#: A score of at least this passes; scores of at most HALLUCINATED make an answer suspect.
PASS, LOW, HALLUCINATED = 4, 4, 2
SUBSTANCE, SUBSTANTIVE_LINE = 80, 12
# Labels of question types and foci in a report, in its order.
TYPE_LABELS = {"fact": "사실 확인", "summary": "요약", "comparison": "비교", "follow_up": "후속 질문", "requirement_detail": "요구사항 상세", "unanswerable": "문서 외 질문"}
FOCUS_LABELS = {"text": "본문·표 (HWP)", "ocr_image": "OCR/스캔 이미지"}
UNCLASSIFIED = "미분류"
# Tags of failures.
REASON_LABELS = {"wrong_doc": "잘못된 문서 검색 (Wrong Doc)", "wrong_refusal": "무단 거절 (Wrong Refusal)", "wrong_answer": "오답 (Wrong Answer)", "low_retrieval": "검색 부족 (Low Retrieval)", "should_refuse": "거절 필요·답변함 (Should Refuse)"}
REFUSED_TAG, REFUSAL_TAG, PARTIAL_TAG, SUSPECT_TAG, OTHER_TAG = "무단 거절", "거절 응답", "부분 범위 제한", "환각 의심", "기타 저점수"
RETRIEVAL = ["doc_hit", "retrieval_keyword_hit", "context_precision", "recall_at_5", "mrr"]
SCORES = ["f_score", "r_score", "s_score"]
# Order of failure kinds.
PRIORITY = {"wrong_doc": 0, "wrong_refusal": 1, "hallucination": 2, "wrong_answer": 3, "low_retrieval": 4, "should_refuse": 5, "legacy": 6}


def file_names(sources: Column) -> Column:
    """Distinct file names of the contexts, in order."""
    name = lambda s: T.strip(F.coalesce(F.nullif(s["metadata"]["file_name"], F.lit("")), s["metadata"]["source_file"], F.lit("")))
    return F.array_distinct(F.filter(F.transform(sources, name), lambda n: n != ""))


def chunk_ids(sources: Column) -> Column:
    """Non-empty chunk ids of the contexts, in order."""
    return F.filter(F.transform(sources, lambda s: T.strip(F.coalesce(s["chunk_id"], F.lit("")))), lambda c: c != "")


def gold_ids(gold: Column) -> Column:
    return F.array_distinct(F.filter(gold, lambda g: g.isNotNull() & (T.strip(g) != "")))


def keyword_hit(sources: Column, keywords: Column) -> Column:
    """1 if any keyword occurs in the joined texts."""
    whole = F.array_join(F.transform(sources, lambda s: F.coalesce(s["text"], F.lit(""))), " ")
    hit = F.exists(keywords, lambda k: F.contains(whole, k))
    return F.when(F.size(F.coalesce(keywords, F.array())) == 0, None).otherwise(F.coalesce(hit, F.lit(False)).cast("double"))


def context_precision(sources: Column, keywords: Column) -> Column:
    """Share of the contexts that have a keyword."""
    n = F.size(F.coalesce(sources, F.array()))
    hits = F.size(F.filter(sources, lambda s: F.exists(keywords, lambda k: F.contains(F.coalesce(s["text"], F.lit("")), k))))
    return F.when((n == 0) | (F.size(F.coalesce(keywords, F.array())) == 0), None).otherwise(hits.cast("double") / n)


def recall(sources: Column, gold: Column, k: int = RECALL_K) -> Column:
    wanted = gold_ids(gold)
    got = F.array_intersect(F.array_distinct(F.slice(chunk_ids(sources), 1, k)), wanted)
    return F.when(F.size(F.coalesce(wanted, F.array())) == 0, None).otherwise(F.coalesce(F.size(got), F.lit(0)).cast("double") / F.size(wanted))


def reciprocal_rank(sources: Column, gold: Column) -> Column:
    wanted = gold_ids(gold)
    ids = F.coalesce(chunk_ids(sources), F.array().cast("array<string>"))
    first = F.array_min(F.filter(F.transform(ids, lambda c, i: F.when(F.array_contains(wanted, c), i + 1)), lambda i: i.isNotNull()))
    return F.when(F.size(F.coalesce(wanted, F.array())) == 0, None).otherwise(F.coalesce(1.0 / first, F.lit(0.0)))


def doc_hit(expected: Column, files: Column) -> Column:
    """1 if the expected document's key contains or is contained in a retrieved name's key (names folded without NFKC inside arrays)."""
    key = T.casefold(F.regexp_replace(T.strip(F.coalesce(expected.cast("string"), F.lit(""))), r"(?U)\s+", " "))
    fold = lambda f: T.casefold(F.regexp_replace(T.strip(f), r"(?U)\s+", " "))
    hit = F.exists(files, lambda f: F.contains(fold(f), key) | F.contains(key, fold(f)))
    return F.when(key == "", None).otherwise(F.coalesce(hit, F.lit(False)).cast("double"))


def retrieval_metrics(rows: DataFrame) -> DataFrame:
    """The rows with doc_hit, retrieval_keyword_hit, context_precision, recall_at_5, mrr and retrieved_files, computed anew."""
    s, kw, gold = F.col("sources"), F.col("ground_truth_keywords"), F.col("gold_chunk_ids")
    files = file_names(s)
    more = F.when(F.size(files) > 5, " ...").otherwise("")
    return rows.withColumns({
        "doc_hit": doc_hit(F.col("doc_id"), files), "retrieval_keyword_hit": keyword_hit(s, kw), "context_precision": context_precision(s, kw),
        "recall_at_5": recall(s, gold), "mrr": reciprocal_rank(s, gold), "retrieved_files": F.concat(F.array_join(F.slice(F.coalesce(files, F.array().cast("array<string>")), 1, 5), " | "), more),
    })


def refusal_phrase(t: Column) -> Column:
    """Whether a text says that something is missing from the documents."""
    absent = F.contains(t, F.lit("확인되지 않")) | F.contains(t, F.lit("확인할 수 없")) | F.contains(t, F.lit("존재하지 않"))
    given = F.contains(t, F.lit("제공된 문서")) & (F.contains(t, F.lit("없")) | F.contains(t, F.lit("포함")) | F.contains(t, F.lit("확인")))
    return absent | given


def boilerplate_line(t: Column) -> Column:
    n = F.length(t)
    return (n == 0) | refusal_phrase(t) | (F.startswith(t, F.lit("문서에서 확인")) & (n < 72)) | (F.contains(t, F.lit("추측하지 않")) & (n < 96)) | (F.startswith(t, F.lit("결론")) & F.contains(t, F.lit("확인되지")) & (n < 120))


def refusal_kind(answer: Column) -> Column:
    """full, partial or none; an empty answer is a full refusal."""
    text = T.strip(F.coalesce(answer, F.lit("")))
    lines = F.filter(F.transform(F.split(text, r"\r\n|[\n\r]"), T.strip), lambda x: ~boilerplate_line(x))
    chars = F.aggregate(lines, F.lit(0), lambda a, x: a + F.length(x))
    hint = r"(?iU)관련\s*문서|기재된|명시|다음과\s*같|아래와\s*같|:\s*[^\s]"
    answered = F.exists(lines, lambda x: (F.length(x) >= SUBSTANTIVE_LINE) & (x.rlike(hint) | ~refusal_phrase(x)))
    return F.when(text == "", "full").when(~refusal_phrase(text), "none").when(answered | (chars >= SUBSTANCE), "partial").otherwise("full")


def contains_expected(expected: Column, answer: Column) -> Column:
    e, a = T.answer_key(expected), T.answer_key(answer)
    return (e != "") & (a != "") & F.contains(a, e)


def heuristic_score(expected: Column, answer: Column) -> Column:
    """5: the expected answer is contained; 4: most of its tokens are; null: a judge must decide."""
    e, a = T.strip(F.coalesce(expected, F.lit(""))), T.strip(F.coalesce(answer, F.lit("")))
    tokens = F.regexp_extract_all(e, F.lit("(?i)[가-힣a-z0-9]{2,}"), F.lit(0))
    key = T.answer_key(a)
    hits = F.size(F.filter(tokens, lambda t: F.contains(key, T.answer_key(t))))
    enough = F.greatest(F.lit(2), F.floor(F.size(tokens) * 0.7))
    near = (F.length(T.answer_key(e)) >= 8) & (F.size(tokens) >= 2) & (hits >= enough)
    return F.when((e == "") | (a == ""), None).when(contains_expected(e, a), 5).when(near, 4).cast("int")


def answerable(question_type: Column) -> Column:
    return F.lower(T.strip(F.coalesce(question_type, F.lit("")))) != "unanswerable"


def answer_metrics(rows: DataFrame, judge: Column | None = None) -> DataFrame:
    """The rows with refusal_kind, is_refusal, partial_limitation, correctness_score, correctness_pass, task_success, wrong_refusal, appropriate_refusal, failure_reason.

    ``judge`` gives the score where the heuristic abstains; by default there is none and the
    score stays null.  Needs doc_hit and retrieval_keyword_hit.
    """
    kind = refusal_kind(F.col("answer"))
    heuristic = heuristic_score(F.col("expected_answer"), F.col("answer"))
    score = F.coalesce(heuristic, judge.cast("int")) if judge is not None else heuristic
    base = rows.withColumns({"refusal_kind": kind, "correctness_score": score})
    return _outcome(base.withColumns({"is_refusal": F.col("refusal_kind") == "full", "partial_limitation": F.col("refusal_kind") == "partial", "correctness_pass": F.col("correctness_score") >= PASS}))


def _outcome(base: DataFrame) -> DataFrame:
    can, full, passed = answerable(F.col("question_type")), F.col("is_refusal"), F.col("correctness_pass")
    has_doc = F.length(T.strip(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))) > 0
    reason = (
        F.when(~can & full, None)
        .when(~can, "should_refuse")
        .when(has_doc & (F.coalesce("doc_hit", F.lit(1.0)) == 0) & ~F.coalesce(passed, F.lit(False)), "wrong_doc")
        .when(full, "wrong_refusal")
        .when(~F.coalesce(passed, F.lit(True)), "wrong_answer")
        .when(F.coalesce("retrieval_keyword_hit", F.lit(1.0)) == 0, "low_retrieval")
    )
    success = F.when(can, ~full & F.coalesce(passed, F.lit(True))).otherwise(full)
    return base.withColumns({"task_success": success, "wrong_refusal": can & full, "appropriate_refusal": ~can & full, "failure_reason": reason})


def generation_scores(rows: DataFrame, judge=None) -> DataFrame:
    """Adds f_score, r_score, s_score (0 to 5), faithfulness_given_answer and judge_error.

    ``judge`` is a function of question, contexts (array of texts) and answer that gives
    struct(f_score, r_score, s_score, judge_error); without one all are null.  The
    faithfulness of full refusals is null.
    """
    texts = F.transform(F.coalesce("sources", F.array().cast(rows.schema["sources"].dataType)), lambda s: F.coalesce(s["text"], F.lit("")))
    if judge is None:
        none = F.lit(None).cast("int")
        return rows.withColumns({"f_score": none, "r_score": none, "s_score": none, "faithfulness_given_answer": none, "judge_error": F.lit(None).cast("string")})
    told = rows.withColumn("__j", judge(F.coalesce("question", F.lit("")), texts, F.coalesce("answer", F.lit(""))))
    clamp = lambda c: F.greatest(F.lit(0), F.least(F.lit(5), F.coalesce(F.col(f"__j.{c}").cast("int"), F.lit(0))))
    made = told.withColumns({c: clamp(c) for c in SCORES} | {"judge_error": F.col("__j.judge_error")}).drop("__j")
    return made.withColumn("faithfulness_given_answer", F.when(refusal_kind(F.col("answer")) != "full", F.col("f_score")))


def re_enriched(rows: DataFrame) -> DataFrame:
    """Refusals, success and failure reason computed anew for rows of older runs; stored scores and passes are kept."""
    kind = refusal_kind(F.col("answer"))
    score = F.col("correctness_score")
    passed = F.coalesce("correctness_pass", score >= PASS) if "correctness_pass" in rows.columns else score >= PASS
    base = rows.withColumns({"refusal_kind": kind, "correctness_pass": passed})
    return _outcome(base.withColumns({"is_refusal": F.col("refusal_kind") == "full", "partial_limitation": F.col("refusal_kind") == "partial"}))


def summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n and the means of all metrics, nulls skipped; per group of ``by``, or of all rows."""
    means = [*RETRIEVAL, *SCORES, "correctness_score", "task_success", "wrong_refusal", "appropriate_refusal", "total_latency_ms"]
    have = [m for m in means if m in rows.columns]
    value = lambda m: F.round(F.avg(F.col(m).cast("double") if dict(rows.dtypes)[m] != "boolean" else F.col(m).cast("int").cast("double")), 6).alias(f"mean_{m}")
    return rows.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n"), *[value(m) for m in have])


def label(column: str, names: dict[str, str]) -> Column:
    """What a report calls a type or focus; others keep their own name, missing ones are unclassified."""
    own = T.strip(F.coalesce(F.col(column), F.lit("")))
    known = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.when(own == "", UNCLASSIFIED).otherwise(F.coalesce(known[own], own))


def _place(c: Column, names: dict[str, str]) -> Column:
    order = F.array(*[F.lit(x) for x in [*names.values(), UNCLASSIFIED]])
    return F.when(F.array_position(order, c) > 0, F.array_position(order, c)).otherwise(len(names) + 2)


def report(rows: DataFrame) -> DataFrame:
    """Overall, per question type and per focus in one pass over grouping sets: level, place, question_type, eval_focus, n, ...

    Labels are those of a report; ``place`` orders the rows of a level, unknown labels last by name.
    """
    # the types of one label differ only in its spelling, so answerability goes with the rows
    labelled = rows.withColumns({"__can": answerable(F.col("question_type")), "question_type": label("question_type", TYPE_LABELS), "eval_focus": label("eval_focus", FOCUS_LABELS)})
    can = F.col("__can")
    aggregates = [
        F.count(F.lit(1)).alias("n"),
        F.count_if(can).alias("n_answerable"),
        *[F.round(F.avg(F.col(m)), 6).alias(f"mean_{m}") for m in (*RETRIEVAL, *[c for c in SCORES if c in rows.columns], "correctness_score", "total_latency_ms")],
        F.round(F.avg(F.col("task_success").cast("double")), 6).alias("mean_task_success"),
        F.round(F.avg(F.when(can, F.col("wrong_refusal").cast("double"))), 6).alias("mean_wrong_refusal_answerable"),
    ]
    sets = labelled.groupingSets([[], [F.col("question_type")], [F.col("eval_focus")]], "question_type", "eval_focus").agg(F.grouping_id().alias("g"), *aggregates)
    level = F.when(F.col("g") == 3, "overall").when(F.col("g") == 1, "question_type").otherwise("eval_focus")
    place = F.when(F.col("g") == 3, 0).when(F.col("g") == 1, _place(F.col("question_type"), TYPE_LABELS)).otherwise(_place(F.col("eval_focus"), FOCUS_LABELS))
    return sets.select(level.alias("level"), place.cast("bigint").alias("place"), *[c for c in sets.columns if c != "g"])


def outcomes(rows: DataFrame) -> DataFrame:
    """One row: passed, failed, appropriate_refusal, unknown."""
    s = F.col("task_success")
    return rows.agg(F.count_if(s).alias("passed"), F.count_if(~s).alias("failed"), F.count_if(s & F.col("appropriate_refusal")).alias("appropriate_refusal"), F.count_if(s.isNull()).alias("unknown"))


def hallucinated(rows: DataFrame) -> DataFrame:
    """Adds ``hallucination`` and ``kind``, the primary kind of a failure."""
    low = F.coalesce(F.col("correctness_score") <= HALLUCINATED, F.lit(False))
    if "f_score" in rows.columns:
        low |= F.coalesce(F.col("f_score") < LOW, F.lit(False))
    suspect = ~F.col("is_refusal") & ~F.coalesce("correctness_pass", F.lit(False)) & low
    kind = F.coalesce("failure_reason", F.when(suspect, "hallucination"), F.when(F.col("wrong_refusal"), "wrong_refusal"), F.lit("legacy"))
    return rows.withColumns({"hallucination": suspect, "kind": kind})


def tags(rows: DataFrame) -> DataFrame:
    """Adds ``tags``: every name that a report gives a failure."""
    h = hallucinated(rows)
    reason, wrong = F.col("failure_reason"), F.coalesce("wrong_refusal", F.lit(False)) | F.coalesce(F.col("failure_reason") == "wrong_refusal", F.lit(False))
    named = F.create_map(*[x for k, v in REASON_LABELS.items() for x in (F.lit(k), F.lit(v))])
    own = F.coalesce(named[reason], reason)
    refused = F.when(wrong & ~F.contains(F.coalesce(own, F.lit("")), F.lit(REFUSED_TAG)), REFUSED_TAG).when(~wrong & F.col("is_refusal") & (F.coalesce(reason, F.lit("")) != "should_refuse") & ~F.contains(F.coalesce(own, F.lit("")), F.lit("거절")), REFUSAL_TAG)
    found = F.array_compact(F.array(own, refused, F.when(F.col("partial_limitation"), PARTIAL_TAG), F.when(F.col("hallucination"), SUSPECT_TAG)))
    return h.withColumn("tags", F.when(F.size(found) > 0, found).otherwise(F.array(F.lit(OTHER_TAG))))


def in_failure_pool(rows: DataFrame) -> DataFrame:
    """The rows that call for action: the first rule that applies decides."""
    h = hallucinated(rows)
    done, reason, wrong = F.col("task_success"), F.col("failure_reason").isNotNull(), F.col("wrong_refusal")
    low = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) < LOW, F.lit(False)) for c in ("correctness_score", *SCORES) if c in rows.columns])
    zero = reduce(lambda a, b: a | b, [F.coalesce(F.col(c) == 0, F.lit(False)) for c in RETRIEVAL])
    keep = F.when(F.col("partial_limitation") & ~(reason | wrong | ~done), False).when(F.col("appropriate_refusal") & done, False).when(done, False).when(reason | wrong | F.col("hallucination") | ~done | F.col("is_refusal"), True).otherwise(low | zero)
    return h.where(keep)


def _question_key() -> list[Column]:
    return [F.coalesce("question", F.lit("")).alias("fq"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("fd")]


def _first_of_key(rows: DataFrame, pos: str) -> DataFrame:
    """One row per question and document, the first by ``pos``."""
    first = rows.select(*_question_key(), pos).groupBy("fq", "fd").agg(F.min(pos).alias(pos)).select(pos)
    return rows.join(first, pos, "left_semi")


def failures(rows: DataFrame, n: int, pos: str = "eval_id") -> DataFrame:
    """The ``n`` gravest failures, one per question and document (the first by ``pos``)."""
    rank = F.create_map(*[x for k, v in PRIORITY.items() for x in (F.lit(k), F.lit(v))])
    kept = _first_of_key(in_failure_pool(rows), pos).withColumn("priority", F.coalesce(rank[F.col("kind")], F.lit(99)))
    faith = [F.coalesce("f_score", F.lit(5))] if "f_score" in rows.columns else []
    return kept.orderBy("priority", F.coalesce("doc_hit", F.lit(1.0)), *faith, F.coalesce("correctness_score", F.lit(5)), pos).limit(n)


def _outside(rows: DataFrame, shown: DataFrame, pos: str) -> DataFrame:
    """Rows whose question and document are not among the shown ones, the first of each: a null-safe anti-join."""
    keys = shown.select(*_question_key()).distinct()
    left = rows.join(keys, (F.coalesce("question", F.lit("")) == F.col("fq")) & (F.coalesce(F.col("doc_id").cast("string"), F.lit("")) == F.col("fd")), "left_anti")
    return _first_of_key(left, pos)


def successes(rows: DataFrame, n: int = 50, pos: str = "eval_id") -> DataFrame:
    """The successful rows that are not among the ``n`` shown failures, one per question and document."""
    return _outside(rows.where("task_success"), failures(rows, n, pos), pos)


def failure_table(rows: DataFrame, n: int = 50, pos: str = "eval_id") -> DataFrame:
    """The shown failures with their tags, and answers limited in part that are not among them, with ``outcome``."""
    shown = failures(rows, n, pos)
    a = tags(shown.drop("hallucination", "kind")).withColumn("outcome", F.array_join("tags", " | "))
    b = tags(_outside(rows.where("partial_limitation"), shown, pos)).withColumn("outcome", F.lit(PARTIAL_TAG))
    return a.unionByName(b, allowMissingColumns=True)


def failure_counts(rows: DataFrame) -> DataFrame:
    """(label, n): failure reasons, unlabelled hallucinations included."""
    label = F.coalesce("failure_reason", F.when(F.col("wrong_refusal"), "wrong_refusal"), F.when(F.col("hallucination"), "hallucination_unlabelled"))
    return hallucinated(rows).withColumn("label", label).where("label IS NOT NULL").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
