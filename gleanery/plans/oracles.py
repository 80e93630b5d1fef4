"""DuckDB SQL with the results of the core queries, over whole tables."""

from __future__ import annotations

import unicodedata

from gleanery.functions.text import TOKEN


def _q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _nfkc(c: str) -> str:
    """NFKC in SQL: single characters by translate, common longer forms by replace, then composition."""
    one, many = {}, {}
    for p in range(0xA0, 0x10000):
        s = chr(p)
        if unicodedata.category(s) in ("Cs", "Cn", "Co"):
            continue
        k = unicodedata.normalize("NFKC", s)
        if k != unicodedata.normalize("NFC", s):
            if len(k) == 1:
                one[s] = k
            elif 0xBC <= p <= 0xBE or 0x2100 <= p <= 0x214F or 0x2150 <= p <= 0x215F or 0xFB00 <= p <= 0xFB06 or p in (0x33A1, 0x33A5, 0x338F, 0x3371, 0x2026):
                many[s] = k
    out = f"translate({c}, {_q(''.join(one))}, {_q(''.join(one.values()))})"
    for s, k in many.items():
        out = f"replace({out}, {_q(s)}, {_q(k)})"
    return f"nfc_normalize({out})"


def _fold(c: str) -> str:
    return f"replace(lower({c}), 'ß', 'ss')"


WS = "\\x{09}-\\x{0d}\\x{1c}-\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"
#: What Java's (?U)\s matches.
JWS = "\\x{09}-\\x{0d}\\x{20}\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}"


def _strip(c: str) -> str:
    return f"regexp_replace(regexp_replace({c}, '^[{JWS}]+', ''), '[{JWS}]+$', '')"


def _tokens(c: str) -> str:
    found = f"regexp_extract_all({_fold(_nfkc(c))}, {_q(TOKEN)})"
    short = "regexp_replace(t, '[-_/,.\\s]+', '', 'g')"
    return f"flatten(list_transform({found}, lambda t: CASE WHEN {short} <> '' AND {short} <> t THEN [t, {short}] ELSE [t] END))"


def _inline(c: str) -> str:
    return _strip(f"regexp_replace(regexp_replace(replace(coalesce({c}, ''), chr(160), ' '), '[\\x{{00}}-\\x{{08}}\\x{{0b}}\\x{{0c}}\\x{{0e}}-\\x{{1f}}]+', ' ', 'g'), '[{JWS}]+', ' ', 'g')")


def _clean(c: str) -> str:
    a = f"regexp_replace(replace({c}, chr(160), ' '), '[\\x{{00}}-\\x{{08}}\\x{{0b}}\\x{{0c}}\\x{{0e}}-\\x{{1f}}]+', ' ', 'g')"
    a = f"regexp_replace(regexp_replace({a}, '[ \\t]+\\n', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return _strip(f"regexp_replace({a}, '[ \\t]{{2,}}', ' ', 'g')")


def _key(c: str) -> str:
    """What is left without white space, non-word characters and underscores, in Java's Unicode sense."""
    folded = _fold(f"coalesce({c}, '')")
    return f"regexp_replace({folded}, '[^\\pL\\pM\\p{{Nd}}\\p{{Nl}}\\x{{200c}}\\x{{200d}}\\x{{24b6}}-\\x{{24e9}}]+', '', 'g')"


_FIELDS = ["file_name", "source_file", "section_path_text", "section_type", "heading", "content_type", "chunk_type", "table_id", "table_type", "row_range"]
_BODY = "array_to_string(list_filter([CAST(doc_id AS VARCHAR), " + ", ".join(f"metadata['{f}']" for f in _FIELDS) + f", text], lambda x: x IS NOT NULL AND length({_strip('x')}) > 0), chr(10))"


def _bm25(extra: str = "") -> str:
    return f"""WITH idx AS (SELECT chunk_id, row_idx, doc_id, {_tokens(f"coalesce({_BODY}, '')")} AS t FROM chunks),
posts AS (SELECT chunk_id, row_idx, doc_id, len(t) AS dl, unnest(t) AS term FROM idx),
tf AS (SELECT term, chunk_id, row_idx, doc_id, dl, count(*) AS tf FROM posts GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
st AS (SELECT count(*) AS n, avg(len(t)) AS a FROM idx),
q AS (SELECT DISTINCT eval_id AS query_id, doc_id, unnest({_tokens("coalesce(question, '')")}) AS term FROM eval_rows WHERE eval_id % 20 = 0),
s AS (SELECT query_id, chunk_id, row_idx, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / a))) AS score
      FROM q JOIN tf USING (term) JOIN df USING (term) CROSS JOIN st {extra} GROUP BY ALL HAVING score > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, row_idx) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


def _dense(extra: str = "") -> str:
    return f"""WITH s AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS score
FROM embeddings a JOIN embeddings b ON a.vec_id % 20 = 0 {extra}),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM s)
SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10"""


def _leg(name: str) -> str:
    return f"""(SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank
FROM (SELECT eval_id AS query_id, chunk_id, max(score) AS score FROM ranked_chunks WHERE scorer = '{name}' AND score IS NOT NULL AND NOT isnan(score) GROUP BY ALL)) WHERE rank <= 40)"""


_EVEN = "abs(max({0}) OVER w - min({0}) OVER w) <= 1e-9 * greatest(abs(max({0}) OVER w), abs(min({0}) OVER w))"
_SCALED = "CASE WHEN " + _EVEN + " THEN 1.0 ELSE ({0} - min({0}) OVER w) / (max({0}) OVER w - min({0}) OVER w) END"
_FUSED = f"""(SELECT *, {_SCALED.format('rrf')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, d NULLS LAST, b NULLS LAST, chunk_id) AS rank FROM
(SELECT query_id, chunk_id, d, b, coalesce(1.0 / (60 + d), 0) + coalesce(1.0 / (60 + b), 0) AS rrf FROM
 (SELECT query_id, chunk_id, max(CASE WHEN leg = 'd' THEN rank END) AS d, max(CASE WHEN leg = 'b' THEN rank END) AS b FROM
  (SELECT 'd' AS leg, * FROM {_leg('dense')} UNION ALL SELECT 'b', * FROM {_leg('bm25')}) GROUP BY query_id, chunk_id)) WINDOW w AS (PARTITION BY query_id))"""

# --- metrics of one row, as a chain of views over eval_rows
_NAME = _strip("coalesce(nullif(s.metadata['file_name'], ''), s.metadata['source_file'], '')")
_FK = _fold(f"regexp_replace({_strip('f')}, '[{JWS}]+', ' ', 'g')")
_RETRIEVAL = f"""(SELECT * EXCLUDE (doc_hit, mrr), coalesce(CAST(doc_id AS VARCHAR), '') AS dk,
 list_filter(list_transform(coalesce(sources, []), lambda s: {_NAME}), lambda n: n <> '') AS names,
 list_filter(list_transform(coalesce(sources, []), lambda s: {_strip("coalesce(s.chunk_id, '')")}), lambda c: c <> '') AS ids,
 list_filter(coalesce(gold_chunk_ids, []), lambda g: g IS NOT NULL AND {_strip('g')} <> '') AS gold FROM eval_rows)"""
_M1 = f"""(SELECT *, list_filter(names, lambda n, i: list_position(names, n) = i) AS files, list_distinct(gold) AS g FROM {_RETRIEVAL})"""
_M2 = f"""(SELECT *,
 CASE WHEN dk = '' THEN NULL ELSE CAST(len(list_filter(files, lambda f: contains({_FK}, dk) OR contains(dk, {_FK}))) > 0 AS DOUBLE) END AS doc_hit,
 CASE WHEN len(coalesce(ground_truth_keywords, [])) = 0 THEN NULL ELSE CAST(len(list_filter(ground_truth_keywords, lambda k: contains(array_to_string(list_transform(coalesce(sources, []), lambda s: coalesce(s.text, '')), ' '), k))) > 0 AS DOUBLE) END AS retrieval_keyword_hit,
 CASE WHEN len(coalesce(sources, [])) = 0 OR len(coalesce(ground_truth_keywords, [])) = 0 THEN NULL ELSE CAST(len(list_filter(sources, lambda s: len(list_filter(ground_truth_keywords, lambda k: contains(coalesce(s.text, ''), k))) > 0)) AS DOUBLE) / len(sources) END AS context_precision,
 CASE WHEN len(g) = 0 THEN NULL ELSE CAST(len(list_intersect(list_distinct(ids[1:10]), g)) AS DOUBLE) / len(g) END AS recall_at_5,
 CASE WHEN len(g) = 0 THEN NULL ELSE coalesce(1.0 / list_min(list_filter(list_transform(ids, lambda c, i: CASE WHEN list_contains(g, c) THEN i END), lambda i: i IS NOT NULL)), 0.0) END AS mrr,
 array_to_string(files[1:5], ' | ') || CASE WHEN len(files) > 5 THEN ' ...' ELSE '' END AS retrieved_files FROM {_M1})"""


def _phrase(t: str) -> str:
    return f"(contains({t}, '확인되지 않') OR contains({t}, '확인할 수 없') OR contains({t}, '존재하지 않') OR (contains({t}, '제공된 문서') AND (contains({t}, '없') OR contains({t}, '포함') OR contains({t}, '확인'))))"


_A = _strip("coalesce(answer, '')")
_E = _strip("coalesce(expected_answer, '')")
_LINES = f"""list_filter(list_transform(regexp_split_to_array(ans, '\\r\\n|[\\n\\r]'), lambda x: {_strip('x')}), lambda x: NOT (length(x) = 0 OR {_phrase('x')} OR (starts_with(x, '문서에서 확인') AND length(x) < 72) OR (contains(x, '추측하지 않') AND length(x) < 96) OR (starts_with(x, '결론') AND contains(x, '확인되지') AND length(x) < 120)))"""
_M3 = f"""(SELECT *, {_A} AS ans, {_E} AS et FROM {_M2})"""
_M4 = f"""(SELECT *, {_LINES} AS ls, {_key('ans')} AS ak, {_key('et')} AS ek, regexp_extract_all(et, '(?i)[가-힣a-z0-9]{{2,}}') AS toks FROM {_M3})"""
_M5 = f"""(SELECT *, CASE WHEN ans = '' THEN 'full' WHEN NOT {_phrase('ans')} THEN 'none'
 WHEN len(list_filter(ls, lambda x: length(x) >= 12 AND (regexp_matches(x, '(?i)관련[{JWS}]*문서|기재된|명시|다음과[{JWS}]*같|아래와[{JWS}]*같|:[{JWS}]*[^{JWS}]') OR NOT {_phrase('x')}))) > 0
   OR coalesce(list_sum(list_transform(ls, lambda x: length(x))), 0) >= 80 THEN 'partial' ELSE 'full' END AS refusal_kind,
 CASE WHEN et = '' OR ans = '' THEN NULL WHEN ek <> '' AND ak <> '' AND contains(ak, ek) THEN 5
 WHEN length(ek) >= 8 AND len(toks) >= 2 AND len(list_filter(toks, lambda t: contains(ak, {_key('t')}))) >= greatest(2, floor(len(toks) * 0.7)) THEN 4 END AS cs,
 lower({_strip("coalesce(question_type, '')")}) <> 'unanswerable' AS can FROM {_M4})"""
_M6 = f"""(SELECT * EXCLUDE (correctness_score), cs AS correctness_score, refusal_kind = 'full' AS is_refusal, refusal_kind = 'partial' AS partial_limitation, cs >= 4 AS correctness_pass FROM {_M5})"""
_M = f"""(SELECT *, CASE WHEN can THEN NOT is_refusal AND coalesce(correctness_pass, true) ELSE is_refusal END AS task_success,
 can AND is_refusal AS wrong_refusal, NOT can AND is_refusal AS appropriate_refusal,
 CASE WHEN NOT can AND is_refusal THEN NULL WHEN NOT can THEN 'should_refuse'
 WHEN dk <> '' AND coalesce(doc_hit, 1) = 0 AND NOT coalesce(correctness_pass, false) THEN 'wrong_doc' WHEN is_refusal THEN 'wrong_refusal'
 WHEN NOT coalesce(correctness_pass, true) THEN 'wrong_answer' WHEN coalesce(retrieval_keyword_hit, 1) = 0 THEN 'low_retrieval' END AS failure_reason FROM {_M6})"""
_W = lambda c: f"list_distinct(regexp_extract_all(lower({c}), '[가-힣a-z0-9]{{2,}}'))"
_PTS = lambda part, whole: f"CAST(CASE WHEN {whole} = 0 THEN 0 ELSE floor(CAST({part} AS DOUBLE) / {whole} * 5 + 0.5) END AS INT)"
_J = f"""(SELECT *, {_PTS('len(list_intersect(aw, cw))', 'len(aw)')} AS f_score, {_PTS('len(list_intersect(qw, aw))', 'len(qw)')} AS r_score, {_PTS('used', 'len(ctx)')} AS s_score FROM
 (SELECT *, {_W("coalesce(answer, '')")} AS aw, {_W("coalesce(question, '')")} AS qw, {_W("coalesce(array_to_string(ctx, ' '), '')")} AS cw,
  len(list_filter(ctx, lambda t: len(list_intersect({_W('t')}, {_W("coalesce(answer, '')")})) > 0)) AS used FROM
  (SELECT *, list_transform(coalesce(sources, []), lambda s: coalesce(s.text, '')) AS ctx FROM {_M})))"""
_H = f"""(SELECT *, NOT is_refusal AND NOT coalesce(correctness_pass, false) AND (coalesce(correctness_score <= 2, false) OR f_score < 4) AS hallucination,
 coalesce(failure_reason, CASE WHEN NOT is_refusal AND NOT coalesce(correctness_pass, false) AND (coalesce(correctness_score <= 2, false) OR f_score < 4) THEN 'hallucination' WHEN wrong_refusal THEN 'wrong_refusal' ELSE 'legacy' END) AS kind FROM {_J})"""
_POOL = f"""(SELECT *, coalesce(question, '') AS fq, dk AS fd FROM {_H} WHERE CASE WHEN partial_limitation AND NOT (failure_reason IS NOT NULL OR wrong_refusal OR NOT task_success) THEN false
 WHEN appropriate_refusal AND task_success THEN false WHEN task_success THEN false WHEN failure_reason IS NOT NULL OR wrong_refusal OR hallucination OR NOT task_success OR is_refusal THEN true
 ELSE coalesce(correctness_score < 4, false) OR f_score < 4 OR r_score < 4 OR s_score < 4 OR coalesce(doc_hit = 0, false) OR coalesce(retrieval_keyword_hit = 0, false) OR coalesce(context_precision = 0, false) OR coalesce(recall_at_5 = 0, false) OR coalesce(mrr = 0, false) END)"""
_SHOWN = f"""(SELECT *, CASE kind WHEN 'wrong_doc' THEN 0 WHEN 'wrong_refusal' THEN 1 WHEN 'hallucination' THEN 2 WHEN 'wrong_answer' THEN 3 WHEN 'low_retrieval' THEN 4 WHEN 'should_refuse' THEN 5 WHEN 'legacy' THEN 6 ELSE 99 END AS p FROM {_POOL}
 QUALIFY row_number() OVER (PARTITION BY fq, fd ORDER BY eval_id) = 1 ORDER BY p, coalesce(doc_hit, 1), f_score, coalesce(correctness_score, 5), eval_id LIMIT 50)"""
_LEFT = lambda cond: f"(SELECT * FROM (SELECT *, coalesce(question, '') AS fq, dk AS fd FROM {_H}) r WHERE {cond} AND NOT EXISTS (SELECT 1 FROM {_SHOWN} p WHERE p.fq = r.fq AND p.fd = r.fd) QUALIFY row_number() OVER (PARTITION BY fq, fd ORDER BY eval_id) = 1)"
_TAGS = """list_filter([CASE failure_reason WHEN 'wrong_doc' THEN '잘못된 문서 검색 (Wrong Doc)' WHEN 'wrong_refusal' THEN '무단 거절 (Wrong Refusal)' WHEN 'wrong_answer' THEN '오답 (Wrong Answer)' WHEN 'low_retrieval' THEN '검색 부족 (Low Retrieval)' WHEN 'should_refuse' THEN '거절 필요·답변함 (Should Refuse)' END,
 CASE WHEN (wrong_refusal OR coalesce(failure_reason, '') = 'wrong_refusal') AND coalesce(failure_reason, '') <> 'wrong_refusal' THEN '무단 거절' WHEN NOT wrong_refusal AND is_refusal AND coalesce(failure_reason, '') NOT IN ('should_refuse', 'wrong_refusal') THEN '거절 응답' END,
 CASE WHEN partial_limitation THEN '부분 범위 제한' END, CASE WHEN hallucination THEN '환각 의심' END], lambda x: x IS NOT NULL)"""
_MEANS = ", ".join(f"round(avg({c}), 6) AS mean_{c}" for c in ("doc_hit", "retrieval_keyword_hit", "context_precision", "recall_at_5", "mrr", "f_score", "r_score", "s_score", "correctness_score", "total_latency_ms"))
_TYPES = ["사실 확인", "요약", "비교", "후속 질문", "요구사항 상세", "문서 외 질문", "미분류"]
_TYPE = "CASE " + _strip("coalesce(question_type, '')") + " WHEN '' THEN '미분류' WHEN 'fact' THEN '사실 확인' WHEN 'summary' THEN '요약' WHEN 'comparison' THEN '비교' WHEN 'follow_up' THEN '후속 질문' WHEN 'requirement_detail' THEN '요구사항 상세' WHEN 'unanswerable' THEN '문서 외 질문' ELSE " + _strip("coalesce(question_type, '')") + " END"
_FOCUS = "CASE " + _strip("coalesce(eval_focus, '')") + " WHEN '' THEN '미분류' WHEN 'text' THEN '본문·표 (HWP)' WHEN 'ocr_image' THEN 'OCR/스캔 이미지' ELSE " + _strip("coalesce(eval_focus, '')") + " END"

# --- headings
_HEAD = """(SELECT doc_id, pos, line, s, CASE WHEN s = '' OR length(s) > 120 THEN NULL
 WHEN regexp_matches(s, '{ro}') AND length(trim(regexp_extract(s, '{ro}', 2))) <= 70 THEN 1
 WHEN regexp_matches(s, '{nu}') THEN CASE WHEN length(trim(regexp_extract(s, '{nu}', 3))) <= CASE WHEN regexp_extract(s, '{nu}', 2) = ')' THEN 55 ELSE 90 END THEN 2 END
 WHEN regexp_matches(s, '{le}') AND NOT (regexp_extract(s, '{le}', 2) = '.' AND regexp_matches(trim(regexp_extract(s, '{le}', 3)), '[:：]')) AND length(trim(regexp_extract(s, '{le}', 3))) <= 70 THEN 3
 WHEN regexp_matches(s, '{le}') THEN NULL
 WHEN regexp_matches(s, '{ci}') AND length(trim(regexp_extract(s, '{ci}', 2))) <= 70 THEN 4 END AS level
 FROM (SELECT doc_id, pos, line, {inl} AS s FROM (SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)) WHERE length({st}) > 0))"""


def _headings() -> str:
    from gleanery.operators.structure import CIRCLED, LETTER, NUMBER, ROMAN

    base = _HEAD.format(ro=ROMAN, nu=NUMBER, le=LETTER, ci=CIRCLED, inl=_inline("line"), st=_strip("line"))
    title = f"""CASE level WHEN 1 THEN regexp_extract(s, '{ROMAN}', 1) || '. ' || trim(regexp_extract(s, '{ROMAN}', 2)) WHEN 2 THEN regexp_extract(s, '{NUMBER}', 1) || regexp_extract(s, '{NUMBER}', 2) || ' ' || trim(regexp_extract(s, '{NUMBER}', 3))
    WHEN 3 THEN regexp_extract(s, '{LETTER}', 1) || regexp_extract(s, '{LETTER}', 2) || ' ' || trim(regexp_extract(s, '{LETTER}', 3)) WHEN 4 THEN regexp_extract(s, '{CIRCLED}', 1) || ' ' || trim(regexp_extract(s, '{CIRCLED}', 2)) END"""
    return f"(SELECT doc_id, pos, line, level, {title} AS title FROM {base})"


def _section(c: str) -> str:
    from gleanery.operators.structure import SECTIONS

    return "CASE " + " ".join(f"WHEN regexp_matches({c}, '{p}') THEN '{n}'" for n, p in SECTIONS) + " ELSE 'body' END"


_CANDS = f"""(SELECT *, CASE WHEN chunk_type = 'section_text' THEN 30 WHEN chunk_type = 'cover_text' THEN -20 ELSE 0 END
 + CASE WHEN n BETWEEN 250 AND 1600 THEN 25 WHEN n BETWEEN 120 AND 249 THEN 12 WHEN n BETWEEN 1601 AND 2800 THEN 8 WHEN n < 120 THEN -35 ELSE -10 END
 + CASE WHEN section_path <> '' THEN 8 ELSE 0 END - 15 AS score FROM
 (SELECT chunk_id, row_idx, chunk_type, coalesce(nullif(metadata['file_name'], ''), nullif(metadata['source_file'], ''), CAST(doc_id AS VARCHAR), 'unknown_document') AS doc,
  coalesce(nullif(metadata['section_type'], ''), 'body') AS section_type, coalesce(metadata['section_path_text'], '') AS section_path, length({_clean("coalesce(text, '')")}) AS n FROM chunks) WHERE n >= 80)"""
_PICKED = f"""(SELECT *, row_number() OVER (PARTITION BY doc, section_type ORDER BY again, score DESC, section_path, row_idx) AS pick FROM
 (SELECT *, CAST(row_number() OVER (PARTITION BY doc, section_type, section_path ORDER BY score DESC, row_idx) > 1 AS INT) AS again FROM {_CANDS}
  WHERE section_type IN ('overview', 'requirements', 'evaluation', 'bid_contract', 'security', 'appendix_form'))
 QUALIFY pick <= CASE section_type WHEN 'requirements' THEN 4 WHEN 'evaluation' THEN 2 WHEN 'bid_contract' THEN 2 ELSE 1 END)"""


_CORE = f"(WITH picked AS MATERIALIZED {_PICKED}, others AS MATERIALIZED (SELECT doc AS cd, count(*) AS n_others FROM picked WHERE section_type <> 'appendix_form' GROUP BY doc) SELECT picked.* FROM picked LEFT JOIN others ON cd = doc WHERE section_type <> 'appendix_form' OR coalesce(n_others, 0) < 4)"
_BODY_PICKS = f"""(SELECT * EXCLUDE (again), row_number() OVER (PARTITION BY doc ORDER BY again, score DESC, section_path, row_idx) AS pick FROM
 (SELECT *, CAST(row_number() OVER (PARTITION BY doc, section_path ORDER BY score DESC, row_idx) > 1 AS INT) AS again FROM {_CANDS} WHERE section_type = 'body'))"""
_BY_DOC = f"""(WITH core AS MATERIALIZED {_CORE}, body AS MATERIALIZED {_BODY_PICKS}, had AS MATERIALIZED (SELECT doc AS hd, count(*) AS had FROM core GROUP BY doc)
 SELECT *, row_number() OVER (PARTITION BY doc ORDER BY list_position(['overview', 'requirements', 'evaluation', 'bid_contract', 'security', 'appendix_form', 'body'], section_type), pick, row_idx) AS rank_in_doc FROM
 (SELECT doc, section_type, chunk_id, row_idx, pick FROM core UNION ALL SELECT doc, section_type, chunk_id, row_idx, pick FROM body LEFT JOIN had ON hd = doc WHERE pick <= 4 - coalesce(had, 0)))"""


def oracle_sql() -> dict[str, str]:
    from gleanery.operators import questions as Q
    from gleanery.plans.chunking import sql as chunking_sql
    from gleanery.plans.evaluation import sql as evaluation_sql
    from gleanery.plans.live import sql as live_sql
    from gleanery.plans.parsing import sql as parsing_sql
    from gleanery.plans.reading import sql as reading_sql

    any_ = lambda ps: "(?i)" + "|".join(f"(?:{p})" for p in ps).replace("\\s", f"[{JWS}]")
    q = _strip("coalesce(question, '')")
    heads = _headings()
    per_type = " UNION ALL ".join(f"SELECT '{m}' AS measure, CAST({e} AS DOUBLE) AS value FROM chunks" for m, e in {
        "total": "count(*)", "files": "count(DISTINCT metadata['file_name'])", "under_200": "count(*) FILTER (length(coalesce(text, '')) < 200)", "over_1500": "count(*) FILTER (length(coalesce(text, '')) > 1500)",
        "max_chars": "max(length(coalesce(text, '')))", "avg_chars": "round(avg(length(coalesce(text, ''))), 1)"}.items())
    report_aggs = f"count(*) AS n, count(*) FILTER (can) AS n_answerable, {_MEANS}, round(avg(CAST(task_success AS INT)), 6) AS mean_task_success, round(avg(CASE WHEN can THEN CAST(wrong_refusal AS INT) END), 6) AS mean_wrong_refusal_answerable"
    norm = f"regexp_replace(regexp_replace(replace(text, chr(0), ' '), '[ \\t]+', ' ', 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    tags = "regexp_replace(regexp_replace(text, '(?i)<br\\s*/?>', chr(10), 'g'), '<[^>]+>', ' ', 'g')"
    for a, b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        tags = f"replace({tags}, {_q(a)}, {_q(b)})"
    plain_text = _strip(f"regexp_replace({tags}, '[ \\t]+', ' ', 'g')")
    question_tokens, body_tokens = _tokens("coalesce(question, '')"), _tokens(f"coalesce({_BODY}, '')")
    kind, section = _strip("coalesce(question_type, '')"), _section("coalesce(metadata['section_path_text'], '')")
    text_key = _key("text")
    doc_key = _fold(f"regexp_replace({_nfkc(_strip('nm'))}, '[{JWS}]+', ' ', 'g')")
    dated = "regexp_matches(answer, '\\d{4}\\s*[.년-]\\s*\\d{1,2}\\s*[.월-]\\s*\\d{1,2}')"
    return {
        "text_normalised": f"SELECT doc_id, {_strip(norm)} AS text FROM documents",
        "text_clean_block": f"SELECT chunk_id, {_clean('text')} AS text FROM chunks",
        "text_keys": f"SELECT chunk_id, regexp_replace(lower(text), '[^0-9a-z가-힣]+', '', 'g') AS relaxed, {text_key} AS answer_key, substr(sha1(text), 1, 10) AS content_hash FROM chunks",
        "search_tokens": f"SELECT eval_id, {question_tokens} AS tokens FROM eval_rows",
        "html_text": f"SELECT chunk_id, {plain_text} AS text FROM chunks",
        "durations": f"SELECT eval_id, list_filter(regexp_extract_all(answer, '\\d+\\s*(?:개월|년|월|주|일)(?:간)?'), lambda t: NOT ({dated} AND contains(t, '일')))[-1] AS duration FROM eval_rows",
        "bm25_corpus_stats": f"SELECT count(*) AS n_chunks, round(avg(len({body_tokens})), 6) AS avg_len FROM chunks",
        "bm25_term_df": f"SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, unnest({body_tokens}) AS term FROM chunks) GROUP BY term",
        "bm25_topk": _bm25(),
        "bm25_doc_filtered": _bm25("WHERE q.doc_id = tf.doc_id"),
        "dense_topk": _dense(),
        "dense_filtered": _dense("AND a.label = b.label"),
        "hybrid_rrf": f"SELECT query_id, chunk_id, round(rrf, 9) AS rrf, round(score, 6) AS score, rank FROM {_FUSED} WHERE rank <= 10",
        "hybrid_threshold": f"SELECT query_id, count(*) AS n FROM {_FUSED} WHERE rank <= 10 AND score >= 0.5 GROUP BY query_id",
        "hybrid_minmax": f"SELECT query_id, chunk_id, round({_SCALED.format('score')}, 6) AS score FROM {_leg('dense')} WINDOW w AS (PARTITION BY query_id)",
        "reranked": f"""WITH f AS (SELECT query_id, chunk_id, rank FROM {_FUSED} WHERE rank <= 20),
 x AS (SELECT query_id, chunk_id, rank, list_distinct({question_tokens}) AS qt, {_tokens("coalesce(text, '')")} AS tt FROM f JOIN eval_rows ON eval_id = query_id JOIN chunks USING (chunk_id)),
 o AS (SELECT query_id, chunk_id, rank, CASE WHEN len(qt) = 0 THEN 0.0 ELSE CAST(len(list_intersect(qt, list_distinct(tt))) AS DOUBLE) / len(qt) END AS o FROM x),
 r AS (SELECT query_id, chunk_id, {_SCALED.format('o')} AS score, row_number() OVER (PARTITION BY query_id ORDER BY o DESC, rank) AS rank FROM o WINDOW w AS (PARTITION BY query_id))
 SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM r WHERE rank <= 10""",
        "context_budget": f"SELECT * FROM (SELECT query_id, chunk_id, CAST(sum(length(coalesce(text, ''))) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS used FROM {_leg('dense')} JOIN chunks USING (chunk_id)) WHERE used <= 3000",
        "last_turns": "SELECT * FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS back FROM events) WHERE back <= 6",
        "documents_of_files": "WITH f AS (SELECT file_name, max(ROW(posted_at, agency, notice_no)) AS x FROM doc_files WHERE file_name IS NOT NULL GROUP BY file_name) SELECT doc_id, d.file_name, x[2] AS agency, x[3] AS notice_no FROM (SELECT doc_id, coalesce(file_name, regexp_extract(path, '([^/]+)$', 1)) AS file_name FROM documents) d LEFT JOIN f USING (file_name)",
        "retrieval_metrics": f"SELECT eval_id, doc_hit, retrieval_keyword_hit, round(context_precision, 6) AS context_precision, round(recall_at_5, 6) AS recall_at_5, round(mrr, 6) AS mrr, retrieved_files FROM {_M2}",
        "answer_bundle": f"SELECT eval_id, refusal_kind, is_refusal, partial_limitation, CAST(correctness_score AS BIGINT) AS correctness_score, correctness_pass, task_success, wrong_refusal, appropriate_refusal, failure_reason FROM {_M}",
        "answer_match": f"SELECT eval_id, ek <> '' AND ak <> '' AND contains(ak, ek) AS hit FROM {_M4}",
        "harness_summary": f"SELECT count(*) AS n, {_MEANS}, round(avg(CAST(task_success AS INT)), 6) AS mean_task_success, round(avg(CAST(wrong_refusal AS INT)), 6) AS mean_wrong_refusal, round(avg(CAST(appropriate_refusal AS INT)), 6) AS mean_appropriate_refusal FROM {_J}",
        "report_levels": f"""SELECT CASE WHEN grouping(t) = 1 AND grouping(f) = 1 THEN 'overall' WHEN grouping(f) = 1 THEN 'question_type' ELSE 'eval_focus' END AS level, CAST(CASE WHEN grouping(t) = 1 AND grouping(f) = 1 THEN 0 WHEN grouping(f) = 1 THEN coalesce(nullif(list_position({_TYPES!r}, t), 0), 8) ELSE coalesce(nullif(list_position(['본문·표 (HWP)', 'OCR/스캔 이미지', '미분류'], f), 0), 4) END AS BIGINT) AS place, t AS question_type, f AS eval_focus, {report_aggs}
 FROM (SELECT *, {_TYPE} AS t, {_FOCUS} AS f FROM {_J}) GROUP BY GROUPING SETS ((), (t), (f))""",
        "task_outcomes": f"SELECT count(*) FILTER (task_success) AS passed, count(*) FILTER (NOT task_success) AS failed, count(*) FILTER (task_success AND appropriate_refusal) AS appropriate_refusal, count(*) FILTER (task_success IS NULL) AS unknown FROM {_M}",
        "failure_counts": f"SELECT label, count(*) AS n FROM (SELECT coalesce(failure_reason, CASE WHEN wrong_refusal THEN 'wrong_refusal' WHEN hallucination THEN 'hallucination_unlabelled' END) AS label FROM {_H}) WHERE label IS NOT NULL GROUP BY label",
        "failures_top": f"SELECT eval_id, kind FROM {_SHOWN}",
        "successes": f"SELECT eval_id FROM {_LEFT('task_success')}",
        "failure_table": f"SELECT eval_id, array_to_string(CASE WHEN len(t) > 0 THEN t ELSE ['기타 저점수'] END, ' | ') AS outcome FROM (SELECT *, {_TAGS} AS t FROM {_SHOWN}) UNION ALL SELECT eval_id, '부분 범위 제한' FROM {_LEFT('partial_limitation')}",
        "chunk_summary": f"{per_type} UNION ALL SELECT 'type:' || coalesce(chunk_type, 'none'), CAST(count(*) AS DOUBLE) FROM chunks GROUP BY 1",
        "slim_projection": "SELECT format('slim_chunk_{:08d}', row_number() OVER (ORDER BY row_idx)) AS slim_id, chunk_id, nullif(metadata['file_name'], '') AS file_name, nullif(metadata['section_type'], '') AS section_type, CAST(len(list_filter(['file_name', 'section_type', 'table_id', 'table_type'], lambda k: coalesce(metadata[k], '') <> '')) AS BIGINT) AS n_keys FROM chunks",
        "merged_ids": "WITH r AS (SELECT DISTINCT chunk_id, scorer || ':' || eval_id AS source FROM ranked_chunks WHERE eval_id IS NOT NULL AND chunk_id IS NOT NULL AND scorer IS NOT NULL) SELECT chunk_id, source, CASE WHEN row_number() OVER (PARTITION BY chunk_id ORDER BY source) = 1 THEN chunk_id ELSE chunk_id || '_' || substr(sha1(source || ':' || chunk_id), 1, 8) END AS merged_id FROM r",
        "mock_embedding": "SELECT chunk_id, round(list_sum(v), 6) AS total, round(v[1], 6) AS first FROM (SELECT chunk_id, list_transform(range(64), lambda i: (instr('0123456789abcdef', h[(i % 32) * 2 + 1]) - 1) * 16 / 255.0 * 2 + (instr('0123456789abcdef', h[(i % 32) * 2 + 2]) - 1) / 255.0 * 2 - 1) AS v FROM (SELECT chunk_id, sha256(coalesce(text, '')) AS h FROM chunks))",
        "quota_sample": f"SELECT doc, section_type, chunk_id, CAST(score AS BIGINT) AS score, pick FROM {_PICKED}",
        "sampling_summary": f"SELECT sum(k) AS n_rows, count(*) AS n_docs, min(k) AS min_per_doc, max(k) AS max_per_doc, round(avg(k), 2) AS avg_per_doc FROM (SELECT doc, count(*) AS k FROM {_PICKED} GROUP BY doc)",
        "document_sample": f"SELECT doc, section_type, chunk_id, rank_in_doc, pick AS rank_in_section FROM {_BY_DOC}",
        "sampling_report": f"""WITH p AS (SELECT * FROM {_BY_DOC}), k AS (SELECT doc, count(*) AS k FROM p GROUP BY doc)
 SELECT 'rows' AS measure, CAST(sum(k) AS DOUBLE) AS value FROM k UNION ALL SELECT 'documents', CAST(count(*) AS DOUBLE) FROM k UNION ALL SELECT 'min_per_doc', CAST(min(k) AS DOUBLE) FROM k UNION ALL SELECT 'max_per_doc', CAST(max(k) AS DOUBLE) FROM k UNION ALL SELECT 'avg_per_doc', round(avg(k), 2) FROM k
 UNION ALL SELECT 'candidates', CAST(count(*) AS DOUBLE) FROM {_CANDS} UNION ALL SELECT 'section:' || section_type, CAST(count(*) AS DOUBLE) FROM p GROUP BY section_type""",
        "stride_sample": "WITH p AS (SELECT row_idx, chunk_id, row_number() OVER (ORDER BY row_idx) - 1 AS pos, count(*) OVER () AS n FROM chunks) SELECT row_idx, chunk_id FROM p WHERE pos IN (SELECT CAST(CASE WHEN n <= 25 THEN i ELSE round_even(i * ((n - 1) / 24.0), 0) END AS BIGINT) FROM (SELECT count(*) AS n FROM chunks), range(25) t(i))",
        "question_filters": f"""SELECT eval_id, CASE WHEN {q} = '' THEN 'empty_question' WHEN regexp_matches({q}, {_q(any_(Q.OPEN_ENDED))}) THEN 'open_ended_wording' END AS open_ended, CASE WHEN {q} = '' THEN 'empty_question' WHEN regexp_matches({q}, {_q(any_(Q.INTERNAL_ID))}) THEN 'ocr_internal_id' END AS internal_id,
 contains({q}, '@') OR regexp_matches(lower({q}), {_q(Q.FORM_TOPIC)}) OR regexp_matches(lower({q}), {_q(Q.FORM_DATE)}) OR (regexp_matches(lower({q}), {_q(Q.FORM_PLACE)}) AND regexp_matches(lower({q}), {_q(Q.FORM_FIELD)})) AS about_form,
 coalesce(array_to_string(list_transform(regexp_extract_all(upper(coalesce(question, '')), {_q(Q.REQUIREMENT)}), lambda x: regexp_replace(x, '\\s+', '', 'g')), ','), '') AS requirement_ids FROM eval_rows""",
        "gold_validity": f"""WITH g AS (SELECT eval_id, unnest(gold_chunk_ids) AS g, unnest(range(len(gold_chunk_ids))) AS i FROM eval_rows),
 v AS (SELECT eval_id, list(g ORDER BY i) AS gold FROM g JOIN (SELECT DISTINCT chunk_id FROM chunks) c ON g.g = c.chunk_id GROUP BY eval_id)
 SELECT r.eval_id, coalesce(gold, []) AS gold, CASE WHEN lower({kind}) = 'unanswerable' AND gold IS NOT NULL THEN 'unanswerable_with_gold' WHEN lower({kind}) <> 'unanswerable' AND gold IS NULL THEN 'answerable_without_gold' ELSE 'keep' END AS verdict FROM eval_rows r LEFT JOIN v USING (eval_id)""",
        "table_shapes": f"""WITH r AS (SELECT file_name, table_id, row_index, row_id, cardinality(cells) AS c, len(list_filter(map_values(cells), lambda v: v IS NOT NULL AND {_strip('v')} <> '')) AS n, coalesce({_strip('map_values(cells)[1]')}, '') <> '' AS f FROM table_rows WHERE cells IS NOT NULL AND cardinality(cells) > 0),
 t AS (SELECT file_name, table_id, count(*) FILTER (n > 0) AS n_rows, CAST(max(c) AS BIGINT) AS n_cols, count(*) FILTER (n > 0 AND f) AS f, arg_min(n, coalesce(row_index, -1) * 1000000000000 + row_id) AS r FROM r GROUP BY ALL)
 SELECT file_name, table_id, n_rows, n_cols, CASE WHEN n_rows = 0 THEN 'empty' WHEN n_rows = 1 OR n_cols = 1 THEN 'freeform' WHEN n_cols <= 3 AND f >= greatest(2, floor(n_rows * 0.6)) THEN 'vertical_key_value' WHEN n_cols >= 5 AND n_rows >= 5 THEN 'matrix' WHEN n_rows <= 4 AND n_cols >= 4 THEN 'horizontal_matrix' WHEN r >= greatest(2, floor(n_cols * 0.5)) THEN 'header_rows' ELSE 'mixed' END AS shape FROM t""",
        "doc_scope": f"""WITH n AS (SELECT doc_id, file_name, coalesce(nullif({_strip("coalesce(file_name, '')")}, ''), CAST(doc_id AS VARCHAR)) AS c FROM documents),
 k AS (SELECT {doc_key} AS key, arg_max(c, doc_id) AS c FROM (SELECT doc_id, c, unnest([CAST(doc_id AS VARCHAR), file_name]) AS nm FROM n) WHERE nm IS NOT NULL AND nm <> '' GROUP BY 1),
 q AS (SELECT DISTINCT notice_no AS query_id, file_name AS query_doc, {_strip("coalesce(file_name, '')")} AS raw FROM doc_files WHERE notice_no IS NOT NULL),
 w AS (SELECT *, {doc_key.replace('nm', 'raw')} AS qk FROM q),
 x AS (SELECT w.qk, count(DISTINCT c) AS m, min(c) AS c FROM (SELECT DISTINCT qk FROM w WHERE raw <> '') w JOIN k ON contains(key, qk) OR contains(qk, key) GROUP BY 1)
 SELECT query_id, query_doc, CASE WHEN raw = '' THEN NULL ELSE coalesce(k.c, CASE WHEN m = 1 THEN x.c END, raw) END AS scope FROM w LEFT JOIN k ON k.key = w.qk LEFT JOIN x ON x.qk = w.qk""",
        "headings": f"SELECT doc_id, pos, CAST(level AS BIGINT) AS level, title FROM {heads} WHERE level IS NOT NULL",
        "heading_paths": f"""WITH h AS (SELECT *, {", ".join(f"last_value(CASE WHEN level = {n} THEN pos END IGNORE NULLS) OVER w AS p{n}, last_value(CASE WHEN level = {n} THEN title END IGNORE NULLS) OVER w AS t{n}" for n in (1, 2, 3, 4))} FROM {heads} WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING)),
 p AS (SELECT doc_id, pos, list_filter([t1, CASE WHEN p2 > coalesce(p1, -1) THEN t2 END, CASE WHEN p3 > greatest(coalesce(p1, -1), coalesce(p2, -1)) THEN t3 END, CASE WHEN p4 > greatest(coalesce(p1, -1), coalesce(p2, -1), coalesce(p3, -1)) THEN t4 END], lambda t: t IS NOT NULL) AS l FROM h)
 SELECT doc_id, pos, coalesce(array_to_string(l, ' > '), '') AS path, {_section("coalesce(array_to_string(l, ' '), '')")} AS section_type FROM p""",
        "section_types": f"SELECT chunk_id, {section} AS section_type FROM chunks",
        "table_row_groups": "WITH r AS (SELECT file_name, table_id, coalesce(_rag_row_text, '') AS t, row_number() OVER (PARTITION BY file_name, table_id ORDER BY row_index NULLS FIRST, row_id) AS rn FROM table_rows) SELECT file_name, table_id, (rn - 1) // 10 AS grp, min(rn) || '-' || max(rn) AS label, count(*) AS n, string_agg(t, chr(10) ORDER BY rn) AS text FROM r GROUP BY file_name, table_id, grp",
        "record_runs": "WITH f AS (SELECT doc_id, row_idx, chunk_type, CASE WHEN row_number() OVER w > 1 AND lag(chunk_type) OVER w IS NOT DISTINCT FROM chunk_type THEN 0 ELSE 1 END AS nw FROM chunks WHERE doc_id IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY row_idx)), i AS (SELECT *, sum(nw) OVER (PARTITION BY doc_id ORDER BY row_idx) AS island FROM f) SELECT doc_id, CAST(island AS BIGINT) AS island, chunk_type, count(*) AS n, min(row_idx) AS first_pos FROM i GROUP BY doc_id, island, chunk_type",
        "page_events_filled": "SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS seen_filled FROM events",
        **evaluation_sql(),
        **chunking_sql(),
        **reading_sql(),
        **parsing_sql(),
        **live_sql(),
        "chat_facets": "SELECT 'type' AS facet, coalesce(chunk_type, 'none') AS value, count(*) AS n FROM chunks GROUP BY ALL UNION ALL SELECT 'section', coalesce(metadata['section_type'], 'none'), count(*) FROM chunks GROUP BY ALL",
    }
