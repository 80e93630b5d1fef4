"""Registered queries of question generation and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import providers
from gleanery.operators import generation, metrics, questions, report
from gleanery.session import table


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "chunks")
    ocr = generation.is_ocr(F.col("chunk_type"), F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.col("text"))
    return c.select("chunk_id", "row_idx", F.col("doc_id").alias("doc"), "chunk_type", F.coalesce("metadata", F.create_map().cast("map<string,string>")).alias("metadata"), F.coalesce("text", F.lit("")).alias("text"), ocr.alias("ocr"), F.lit("").alias("path"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_rows").withColumn("doc", F.col("doc_id"))


def failure_table(spark, d):
    """The report's failures with their tags, and answers limited in part beside them."""
    rows = metrics.generation_scores(metrics.answer_metrics(metrics.retrieval_metrics(table(spark, d, "eval_rows"))), providers.overlap_scores)
    return metrics.failure_table(rows).select("eval_id", "outcome")


def re_enriched(spark, d):
    """Refusals and outcomes of stored rows computed anew; the stored scores stay."""
    return metrics.re_enriched(table(spark, d, "eval_rows").withColumn("retrieval_keyword_hit", F.lit(None).cast("double")).withColumn("doc_hit", F.col("doc_hit").cast("double"))).select("eval_id", "refusal_kind", "correctness_pass", "task_success", "wrong_refusal", "appropriate_refusal", "failure_reason")


def question_rejects(spark, d):
    """Why each question could not be one without an answer in its document."""
    return questions.reject_reasons(_questions(spark, d), _chunks(spark, d))


def question_verdicts(spark, d):
    """What the filters do with each question, with its gold chunks, focus and category."""
    out = generation.verdicts(_questions(spark, d), _chunks(spark, d))
    return out.select("eval_id", "verdict", F.array_join("gold", ",").alias("gold"), "eval_focus", "category")


_BENT = [("0", "question"), ("1", "question || ' DAR-004 중 하나만 적으세요.'"), ("2", "question || ' COR 번호를 모두 나열하세요.'"), ("3", "question || ' OCR 이미지 ( img_12 ) 예시 세 가지를 적으세요.'"), ("4", "question || ' (이미지 img_7, img_8)'")]
_BENT_SQL = "CASE eval_id % 5 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _BENT) + " END"


def question_rewrites(spark, d):
    """Questions bent into forms without a single answer, and what they are rewritten to."""
    rows = table(spark, d, "eval_rows").withColumn("question", F.expr(_BENT_SQL))
    out = generation.rewritten(rows)
    return out.select("eval_id", "question", "question_type", "expected_answer", F.array_join("ground_truth_keywords", "|").alias("keywords"), F.array_join("gold_chunk_ids", "|").alias("gold"), "difficulty", "category", "open_rewritten", "id_rewritten", "category_rewritten")


def rewrite_counts(spark, d):
    return generation.rewrite_counts(generation.rewritten(table(spark, d, "eval_rows").withColumn("question", F.expr(_BENT_SQL))))


def question_responses(spark, d):
    """Questions read back from responses, arrays and objects in turn."""
    fields = ["question", "category", "question_type", "expected_answer", "ground_truth_keywords", "gold_chunk_ids", "difficulty", "eval_focus"]
    item = F.struct(*fields, F.col("doc_id").cast("string").alias("doc_id"))
    kind = F.pmod("eval_id", F.lit(4))
    whole = lambda name: F.to_json(F.struct(F.array(item).alias(name)))
    content = F.when(kind == 0, F.to_json(F.array(item))).when(kind == 1, whole("questions")).when(kind == 2, whole("items")).otherwise(whole("data"))
    rows = table(spark, d, "eval_rows").select("eval_id", content.alias("content"))
    out = generation.parsed(rows, keep=["eval_id"])
    return out.select("eval_id", "question", "question_type", "doc_id", "expected_answer", F.array_join("ground_truth_keywords", "|").alias("keywords"), "eval_focus")


def generation_inputs(spark, d):
    """The chunks that a generator reads of each document."""
    out = generation.inputs(_chunks(spark, d).where("doc IS NOT NULL"), most=2)
    return out.select("doc", "chunk_count", "sampled_chunk_count", F.array_join(F.transform("chunks", lambda c: F.concat_ws(":", c["chunk_id"], c["source"], F.length(c["text"]).cast("string"))), ",").alias("chunks"))


def doc_names(spark, d):
    """The document name of each chunk by the chain of its fields."""
    c = table(spark, d, "chunks")
    return c.select("row_idx", generation.doc_name(F.lit(None).cast("string"), F.coalesce("metadata", F.create_map().cast("map<string,string>")), F.concat(F.lit("data/set/"), "chunk_id", F.lit("_chunks.jsonl"))).alias("doc"))


def report_formats(spark, d):
    """How a report writes shares and successes, and the scores that tracing tools take."""
    rows = metrics.answer_metrics(metrics.retrieval_metrics(table(spark, d, "eval_rows")))
    return rows.select("eval_id", report.whole_percent(F.col("recall_at_5")).alias("recall"), report.mark(F.col("task_success")).alias("success"))


def feedback(spark, d):
    rows = metrics.answer_metrics(metrics.retrieval_metrics(table(spark, d, "eval_rows")))
    out = report.feedback(rows)
    return out.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean"))


NAMES = [report_formats, feedback, failure_table, re_enriched, question_rejects, question_verdicts, question_rewrites, rewrite_counts, question_responses, generation_inputs, doc_names]


def sql() -> dict[str, str]:
    from gleanery.plans import oracles as O

    strip, fold = O._strip, O._fold
    q = strip("coalesce(question, '')")
    stop = ", ".join(O._q(w) for w in questions.TOPIC_STOP)
    words = f"list_filter(list_transform(regexp_extract_all(coalesce(question, ''), '{questions.TOPIC_WORD}'), lambda w: {fold('w')}), lambda w: w NOT IN ({stop}))"
    overlap = f"""(SELECT e.eval_id, len(e.w) AS n_words, coalesce(h.n, 0) AS n_known FROM (SELECT eval_id, doc_id, {words} AS w FROM eval_rows) e LEFT JOIN
 (SELECT u.eval_id, count(DISTINCT u.i) AS n FROM (SELECT eval_id, doc_id, unnest({words}) AS w, unnest(range(len({words}))) AS i FROM eval_rows) u JOIN chunks c ON c.doc_id = u.doc_id AND contains({fold('c.text')}, u.w) GROUP BY u.eval_id) h USING (eval_id))"""
    low = fold(q)
    ws = O.JWS
    phrases = " ".join(f"WHEN contains({low}, {O._q(p)}) THEN {O._q('forbidden_phrase:' + p)}" for p in questions.FORBIDDEN)
    scoped = questions.SCOPED.replace(r"\s", f"[{ws}]")
    scoped_id = questions.SCOPED_ID.replace(r"\s", f"[{ws}]").replace(r"\b", "(?:^|[^가-힣\\w])")
    reason = f"CASE WHEN {q} = '' THEN 'empty_question' {phrases} WHEN regexp_matches({q}, '(?i){scoped}') THEN 'doc_scoped_wording' WHEN regexp_matches({q}, '(?i){scoped_id}') THEN 'requirement_id_in_question' WHEN n_words >= 2 AND (n_known >= 2 OR (n_words <= 3 AND n_known = n_words)) THEN 'corpus_keyword_overlap' END"
    rejects = f"(SELECT eval_id, {reason} AS reason FROM eval_rows JOIN {overlap} USING (eval_id))"
    any_ = lambda ps: "(?i)" + "|".join(f"(?:{p})" for p in ps).replace("\\s", f"[{ws}]")
    open_ = lambda c: f"regexp_matches({c}, {O._q(any_(questions.OPEN_ENDED))})"
    internal = lambda c: f"regexp_matches({c}, {O._q(any_(questions.INTERNAL_ID))})"
    form = lambda c: f"(contains({c}, '@') OR regexp_matches(lower({c}), {O._q(questions.FORM_TOPIC)}) OR regexp_matches(lower({c}), {O._q(questions.FORM_DATE)}) OR (regexp_matches(lower({c}), {O._q(questions.FORM_PLACE)}) AND regexp_matches(lower({c}), {O._q(questions.FORM_FIELD)})))"
    is_ocr = "(starts_with(lower(coalesce(nullif(chunk_type, ''), metadata['chunk_type'], '')), 'ocr_') OR lower(coalesce(metadata['source'], '')) = 'ocr' OR (contains(coalesce(text, ''), '이미지:') AND contains(coalesce(text, ''), 'OCR ID:')))"
    gold = f"""(SELECT eval_id, list(g ORDER BY i) AS gold, bool_or(o) AS o FROM (SELECT eval_id, doc_id, unnest(gold_chunk_ids) AS g, unnest(range(len(gold_chunk_ids))) AS i FROM eval_rows) x JOIN (SELECT doc_id, chunk_id, bool_or({is_ocr}) AS o FROM chunks GROUP BY ALL) c ON c.doc_id = x.doc_id AND c.chunk_id = x.g GROUP BY eval_id)"""
    blank = f"lower({strip(chr(99) + 'oalesce(question_type, ' + chr(39) * 2 + ')')}) = 'unanswerable'"
    # rewrites
    kws = f"list_filter(coalesce(ground_truth_keywords, []), lambda k: k IS NOT NULL AND {strip('k')} <> '')"
    golds = f"list_filter(coalesce(gold_chunk_ids, []), lambda k: k IS NOT NULL AND {strip('k')} <> '')"
    item = strip("coalesce(expected_answer, '')")
    for sign in (";", " / ", " · ", " 및 ", ",", "，"):
        item = f"split_part({item}, '{sign}', 1)"
    item = f"regexp_replace(regexp_replace({item}, '^[ .)]+', ''), '[ .)]+$', '')"
    req = questions.REQUIREMENT
    own = "list_distinct(list_filter(kw, lambda k: regexp_matches(trim(k), '(?i)^COR-\\d+$')))"
    told = f"list_distinct(list_filter(list_transform(regexp_extract_all(upper(coalesce(expected_answer, '')), '{req}'), lambda x: regexp_replace(x, '\\s+', '', 'g')), lambda x: starts_with(x, 'COR-')))"
    clean = "s"
    for p in generation.IMAGE_NAMES:
        clean = f"regexp_replace({clean}, '(?i){p.replace(chr(92) + 's', '[' + ws + ']')}', '표', 'g')"
    clean = f"regexp_replace(regexp_replace(regexp_replace({clean}, '(?i)img_\\d+', '', 'g'), '\\([{ws}]*\\)', '', 'g'), '[{ws}]+', ' ', 'g')"
    clean = f"regexp_replace(regexp_replace({clean}, '^[ ,·]+', ''), '[ ,·]+$', '')"
    rewrites = f"""(SELECT *, CASE WHEN {internal('s')} AND c <> '' AND NOT {internal('c')} THEN c ELSE q2 END AS q3 FROM (SELECT *, {clean} AS c FROM (SELECT *, {strip("coalesce(q2, '')")} AS s FROM
 (SELECT *, CASE k WHEN 1 THEN '제약사항(COR) 고유번호는 해당 목록에 총 몇 개가 명시되어 있는가?' WHEN 2 THEN rq || ' 산출정보에 ''' || item || '''가 명시되어 있는가?' WHEN 3 THEN '문서 산출정보(예시)에 ''' || sm || '''이 명시되어 있는가?' ELSE question END AS q2 FROM
 (SELECT *, CASE WHEN {open_('q')} AND q <> '' AND (contains({fold('q')}, '모두 나열') OR contains({fold('q')}, '전부 나열')) AND (contains({fold('q')}, 'cor') OR len(list_filter(kw, lambda k: starts_with(upper(k), 'COR-'))) > 0) THEN 1
   WHEN {open_('q')} AND regexp_matches(q, '중[{ws}]*하나') AND item <> '' THEN 2 WHEN {open_('q')} AND regexp_matches(q, '(?:세|3)[{ws}]*가지(?:를)?[{ws}]*적') AND sm <> '' THEN 3 ELSE 0 END AS k FROM
 (SELECT *, q0 AS q, coalesce(kw[1], item) AS sm, CASE WHEN regexp_extract(q0, '(?i){req}') <> '' THEN regexp_extract(q0, '(?i){req}') ELSE '해당 요구사항' END AS rq FROM
 (SELECT * REPLACE ({_BENT_SQL} AS question), {kws} AS kw, {golds} AS gd, {item} AS item, {strip(f"coalesce({_BENT_SQL}, '')")} AS q0 FROM eval_rows)))))))"""
    n = f"coalesce(nullif(CASE WHEN len({own}) > 0 THEN len({own}) ELSE len({told}) END, 0), 4)"
    category = f"CASE WHEN {strip(chr(99) + 'oalesce(q3, ' + chr(39) * 2 + ')')} <> '' AND {form('q3')} THEN '부록·양식' ELSE category END"
    flags = f"k > 0 AS open_rewritten, q3 IS DISTINCT FROM q2 AS id_rewritten, {category} IS DISTINCT FROM category AS category_rewritten"
    # samples: at most two chunks of a document, one of them from an image if there is one
    picked = f"""(WITH c AS (SELECT doc_id, chunk_id, row_idx, coalesce(text, '') AS t, {is_ocr} AS o, coalesce(nullif(metadata['source'], ''), 'hwp') AS src FROM chunks WHERE doc_id IS NOT NULL),
 p AS (SELECT *, row_number() OVER (PARTITION BY doc_id, o ORDER BY row_idx) - 1 AS pos, count(*) OVER (PARTITION BY doc_id) AS al, count(*) FILTER (o) OVER (PARTITION BY doc_id) AS k FROM c),
 s AS (SELECT *, CASE WHEN o THEN k ELSE al - k END AS n, CASE WHEN al <= 2 THEN al WHEN o THEN CASE WHEN al = k THEN 2 ELSE 1 END WHEN k > 0 THEN 1 ELSE least(2, al - k) END AS m FROM p)
 SELECT * FROM s WHERE n <= m OR (m = 1 AND pos = 0) OR (m = 2 AND NOT (o AND al = k) AND pos IN (0, n - 1)) OR (m = 2 AND o AND al = k AND pos IN (0, 1)))"""
    dedup = f"(SELECT * FROM {picked} QUALIFY coalesce(chunk_id, '') = '' OR row_number() OVER (PARTITION BY doc_id, chunk_id ORDER BY row_idx) = 1)"
    passed = "coalesce(correctness_score >= 4, NULL)"
    return {
        "report_formats": f"SELECT eval_id, CASE WHEN recall_at_5 IS NULL THEN '-' ELSE CAST(CAST(round_even(recall_at_5 * 100, 0) AS BIGINT) AS VARCHAR) || '%' END AS recall, CASE WHEN task_success IS NULL THEN '-' WHEN task_success THEN '✓' ELSE '✗' END AS success FROM {O._M}",
        "feedback": f"SELECT name, count(v) AS n, round(avg(v), 6) AS mean FROM (SELECT unnest(['correctness_score', 'doc_hit', 'retrieval_keyword_hit', 'context_precision', 'recall_at_5', 'mrr', 'task_success', 'wrong_refusal', 'appropriate_refusal']) AS name, unnest([correctness_score / 5.0, doc_hit, retrieval_keyword_hit, context_precision, recall_at_5, mrr, CAST(task_success AS INT), CAST(wrong_refusal AS INT), CAST(appropriate_refusal AS INT)]) AS v FROM {O._M}) WHERE v IS NOT NULL GROUP BY name",
        "question_overlap": f"SELECT eval_id AS query_id, n_words, n_known FROM {overlap}",
        "question_rejects": f"SELECT * FROM {rejects}",
        "question_verdicts": f"""SELECT r.eval_id, CASE WHEN {blank} AND gold IS NOT NULL THEN 'unanswerable_with_gold' WHEN {blank} THEN coalesce(reason, 'keep') WHEN gold IS NULL THEN 'answerable_without_gold' WHEN {q} = '' THEN 'empty_question' WHEN {open_(q)} THEN 'open_ended_wording' WHEN {internal(q)} THEN 'ocr_internal_id' ELSE 'keep' END AS verdict,
 coalesce(array_to_string(gold, ','), '') AS gold, CASE WHEN coalesce(eval_focus, '') = '' THEN CASE WHEN {blank} THEN 'text' WHEN coalesce(im.has, false) AND coalesce(g.o, false) THEN 'ocr_image' ELSE 'text' END WHEN eval_focus = 'ocr_image' AND NOT coalesce(im.has, false) THEN 'text' ELSE eval_focus END AS eval_focus,
 CASE WHEN {q} <> '' AND {form('question')} THEN '부록·양식' ELSE category END AS category FROM eval_rows r JOIN {rejects} USING (eval_id) LEFT JOIN {gold} g USING (eval_id) LEFT JOIN (SELECT doc_id, bool_or({is_ocr}) AS has FROM chunks GROUP BY doc_id) im ON im.doc_id = r.doc_id""",
        "question_rewrites": f"""SELECT eval_id, q3 AS question, CASE WHEN k > 0 THEN 'fact' ELSE question_type END AS question_type, CASE k WHEN 1 THEN {n} || '개' WHEN 2 THEN '예 (' || item || ')' WHEN 3 THEN '예 (' || sm || ')' ELSE expected_answer END AS expected_answer,
 CASE k WHEN 1 THEN coalesce(array_to_string(kw[1:5], '|'), '') WHEN 2 THEN replace(rq, ' ', '') || '|' || item WHEN 3 THEN sm ELSE array_to_string(ground_truth_keywords, '|') END AS keywords, CASE WHEN k > 0 THEN coalesce(array_to_string(gd[1:1], '|'), '') ELSE array_to_string(gold_chunk_ids, '|') END AS gold,
 CASE WHEN k > 0 THEN 'easy' ELSE difficulty END AS difficulty, {category} AS category, {flags} FROM {rewrites}""",
        "rewrite_counts": f"SELECT count(*) AS n, count(*) FILTER (open_rewritten) AS open_rewritten, count(*) FILTER (id_rewritten) AS id_rewritten, count(*) FILTER (category_rewritten) AS category_rewritten FROM (SELECT {flags} FROM {rewrites})",
        "question_responses": f"SELECT eval_id, {q} AS question, {strip(chr(99) + 'oalesce(question_type, ' + chr(39) * 2 + ')')} AS question_type, coalesce(CAST(doc_id AS VARCHAR), '') AS doc_id, {strip(chr(99) + 'oalesce(expected_answer, ' + chr(39) * 2 + ')')} AS expected_answer, coalesce(array_to_string(ground_truth_keywords, '|'), '') AS keywords, CASE WHEN lower({strip(chr(99) + 'oalesce(eval_focus, ' + chr(39) * 2 + ')')}) IN ('text', 'ocr_image') THEN lower({strip(chr(99) + 'oalesce(eval_focus, ' + chr(39) * 2 + ')')}) END AS eval_focus FROM eval_rows WHERE {q} <> ''",
        "generation_inputs": f"SELECT doc_id AS doc, (SELECT count(*) FROM chunks c WHERE c.doc_id = p.doc_id) AS chunk_count, count(*) AS sampled_chunk_count, string_agg(coalesce(chunk_id, '') || ':' || CASE WHEN o THEN 'ocr' ELSE src END || ':' || length(left({strip('t')}, 1200)), ',' ORDER BY row_idx) AS chunks FROM {dedup} p GROUP BY doc_id",
        "doc_names": "SELECT row_idx, coalesce(nullif(metadata['doc_id'], ''), nullif(metadata['file_name'], ''), nullif(metadata['source_file'], ''), CASE WHEN coalesce('data/set/' || chunk_id || '_chunks.jsonl', '') = '' THEN 'document' ELSE coalesce(nullif(regexp_extract('data/set/' || chunk_id || '_chunks.jsonl', '([^/]+)/[^/]*$', 1), ''), chunk_id) END) AS doc FROM chunks",
        "re_enriched": f"""WITH m AS (SELECT eval_id, refusal_kind, is_refusal, can, dk FROM {O._M6}), r AS (SELECT e.eval_id, m.*  EXCLUDE (eval_id), CAST(e.doc_hit AS DOUBLE) AS hit, {passed.replace('correctness_score', 'e.correctness_score')} AS pass FROM eval_rows e JOIN m USING (eval_id))
 SELECT eval_id, refusal_kind, pass AS correctness_pass, CASE WHEN can THEN NOT is_refusal AND coalesce(pass, true) ELSE is_refusal END AS task_success, can AND is_refusal AS wrong_refusal, NOT can AND is_refusal AS appropriate_refusal,
 CASE WHEN NOT can AND is_refusal THEN NULL WHEN NOT can THEN 'should_refuse' WHEN dk <> '' AND coalesce(hit, 1) = 0 AND NOT coalesce(pass, false) THEN 'wrong_doc' WHEN is_refusal THEN 'wrong_refusal' WHEN NOT coalesce(pass, true) THEN 'wrong_answer' END AS failure_reason FROM r""",
    }
