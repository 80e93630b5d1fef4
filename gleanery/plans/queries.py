"""The registered queries of the core: (spark, directory of parquet tables) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.numbering import positions
from gleanery import providers
from gleanery.operators import metrics, ocr, pages, questions, records, sampling, search, splitters, structure
from gleanery.plans import chunking, evaluation, live, parsing, reading
from gleanery.session import spread, table

#: Searches take as queries every row whose id is divisible by this, against all rows.
EVERY = 20


def _index(spark: SparkSession, d: str) -> DataFrame:
    c = spread(table(spark, d, "chunks"))
    return c.select("chunk_id", "row_idx", F.col("metadata")["file_name"].alias("file_name"), "doc_id", search.search_text(F.col("doc_id"), F.col("metadata"), F.col("text")).alias("body"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "eval_rows")
    return e.where(F.col("eval_id") % EVERY == 0).select(F.col("eval_id").alias("query_id"), F.col("question").alias("query"), "doc_id")


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("row_idx"), F.col("embedding").alias("vector"), "label")


def _vector_queries(spark: SparkSession, d: str) -> DataFrame:
    v = _vectors(spark, d)
    return v.where(F.col("chunk_id") % EVERY == 0).select(F.col("chunk_id").alias("query_id"), "vector", "label")


def _measured(spark: SparkSession, d: str) -> DataFrame:
    """All metrics of the answered questions; the judge is the one without a model."""
    rows = table(spark, d, "eval_rows")
    return metrics.generation_scores(metrics.answer_metrics(metrics.retrieval_metrics(rows)), providers.overlap_scores)


def text_normalised(spark, d):
    return table(spark, d, "documents").select("doc_id", T.normalised(F.col("text")).alias("text"))


def text_clean_block(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.clean_block(F.col("text")).alias("text"))


def text_keys(spark, d):
    """Compact, relaxed and answer keys, and content hashes, of all chunks."""
    t = F.col("text")
    return table(spark, d, "chunks").select("chunk_id", T.relaxed(t).alias("relaxed"), T.answer_key(t).alias("answer_key"), T.short_hash(t).alias("content_hash"))


def search_tokens(spark, d):
    return table(spark, d, "eval_rows").select("eval_id", T.tokens(F.coalesce("question", F.lit(""))).alias("tokens"))


def bm25_corpus_stats(spark, d):
    return search.corpus_stats(_index(spark, d)).select("n_chunks", F.round("avg_len", 6).alias("avg_len"))


def bm25_term_df(spark, d):
    return search.document_frequency(search.postings(_index(spark, d)))


def bm25_topk(spark, d):
    return search.bm25(_asked(spark, d), _index(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def bm25_doc_filtered(spark, d):
    return search.bm25(_asked(spark, d), _index(spark, d), same="doc_id").select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def dense_topk(spark, d):
    return search.dense(_vector_queries(spark, d), _vectors(spark, d)).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def dense_filtered(spark, d):
    hits = search.dense(_vector_queries(spark, d), _vectors(spark, d), same="label")
    return hits.select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def _legs(spark, d) -> dict[str, DataFrame]:
    """Ranked lists of two scorers for every question, repeated hits once."""
    hits = table(spark, d, "ranked_chunks").where("score IS NOT NULL AND NOT isnan(score)")
    legs = {}
    for name in ("dense", "bm25"):
        best = hits.where(F.col("scorer") == name).groupBy(F.col("eval_id").alias("query_id"), "chunk_id").agg(F.max("score").alias("score"))
        legs[name] = search.top_k(best.withColumn("row_idx", F.col("chunk_id")), 40)
    return legs


def hybrid_rrf(spark, d):
    fused = search.fuse(_legs(spark, d))
    return fused.select("query_id", "chunk_id", F.round("rrf", 9).alias("rrf"), F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def hybrid_threshold(spark, d):
    return search.above(search.fuse(_legs(spark, d)), 0.5).groupBy("query_id").agg(F.count(F.lit(1)).alias("n"))


def hybrid_minmax(spark, d):
    return search.min_max(_legs(spark, d)["dense"]).select("query_id", "chunk_id", F.round("score", 6).alias("score"))


def reranked(spark, d):
    """Fused hits of every question, scored anew by token overlap with the chunk's text."""
    q = table(spark, d, "eval_rows").select(F.col("eval_id").alias("query_id"), "question")
    hits = search.fuse(_legs(spark, d), 20).join(q, "query_id").join(table(spark, d, "chunks").select("chunk_id", "text"), "chunk_id")
    return search.rerank(hits, search.overlap_score(F.col("question"), F.coalesce("text", F.lit("")))).select("query_id", "chunk_id", F.round("score", 6).alias("score"), F.col("rank").cast("bigint").alias("rank"))


def context_budget(spark, d):
    hits = _legs(spark, d)["dense"].join(table(spark, d, "chunks").select("chunk_id", "text"), "chunk_id")
    return search.context_budget(hits, F.length(F.coalesce("text", F.lit(""))), 3000).select("query_id", "chunk_id", F.col("used").cast("bigint").alias("used"))


def last_turns(spark, d):
    """The last six events of each user stand for the last six turns of a conversation."""
    return search.last_turns(table(spark, d, "events"), "user_id", "event_id").select("user_id", "event_id", F.col("back").cast("bigint").alias("back"))


def doc_scope(spark, d):
    names = table(spark, d, "documents").select("doc_id", "file_name", F.lit(None).cast("string").alias("source_file"), F.col("doc_id").alias("pos"))
    asked = table(spark, d, "doc_files").select(F.col("notice_no").alias("query_id"), F.col("file_name").alias("query_doc")).where("query_id IS NOT NULL").distinct()
    return search.resolve_scope(asked, names).select("query_id", "query_doc", "scope")


def retrieval_metrics(spark, d):
    m = metrics.retrieval_metrics(table(spark, d, "eval_rows"))
    return m.select("eval_id", "doc_hit", "retrieval_keyword_hit", *[F.round(c, 6).alias(c) for c in ("context_precision", "recall_at_5", "mrr")], "retrieved_files")


def answer_bundle(spark, d):
    return _measured(spark, d).select("eval_id", "refusal_kind", "is_refusal", "partial_limitation", F.col("correctness_score").cast("bigint").alias("correctness_score"), "correctness_pass", "task_success", "wrong_refusal", "appropriate_refusal", "failure_reason")


def answer_match(spark, d):
    return table(spark, d, "eval_rows").select("eval_id", metrics.contains_expected(F.col("expected_answer"), F.col("answer")).alias("hit"))


def harness_summary(spark, d):
    return metrics.summary(_measured(spark, d))


def report_levels(spark, d):
    return metrics.report(_measured(spark, d))


def task_outcomes(spark, d):
    return metrics.outcomes(_measured(spark, d))


def failure_counts(spark, d):
    return metrics.failure_counts(_measured(spark, d))


def failures_top(spark, d):
    return metrics.failures(_measured(spark, d), 50).select("eval_id", "kind")


def successes(spark, d):
    return metrics.successes(_measured(spark, d)).select("eval_id")


def split_baseline(spark, d):
    return splitters.split(spread(table(spark, d, "documents")), "doc_id")


def split_oversized(spark, d):
    return splitters.split(spread(table(spark, d, "documents")), "doc_id", method="oversized")


def split_section(spark, d):
    return splitters.split(spread(table(spark, d, "documents")), "doc_id", method="section")


def split_paragraph(spark, d):
    return splitters.split(spread(table(spark, d, "documents")), "doc_id", method="paragraph")


def chunked_documents(spark, d):
    return splitters.chunk_documents(spread(table(spark, d, "documents")))


def chunk_summary(spark, d):
    return splitters.chunk_summary(table(spark, d, "chunks"))


def slim_projection(spark, d):
    """Chunks renumbered in order with a short metadata list."""
    placed = positions(table(spark, d, "chunks"), [], ["row_idx"])
    meta = splitters.allowed(F.coalesce("metadata", F.create_map().cast("map<string,string>")), ["file_name", "section_type", "table_id", "table_type"])
    return placed.select(F.format_string("slim_chunk_%08d", "pos").alias("slim_id"), "chunk_id", meta["file_name"].alias("file_name"), meta["section_type"].alias("section_type"), F.size(meta).cast("bigint").alias("n_keys"))


def merged_ids(spark, d):
    """Hits of all scorers as rows of merged files: ids that occur again get new ones."""
    r = table(spark, d, "ranked_chunks").where("eval_id IS NOT NULL AND chunk_id IS NOT NULL AND scorer IS NOT NULL").select("chunk_id", F.concat_ws(":", "scorer", "eval_id").alias("source")).distinct().withColumn("pos", F.lit(0))
    return splitters.merged_ids(r).select("chunk_id", "source", "merged_id")


def mock_embedding(spark, d):
    v = T.mock_embedding(F.coalesce("text", F.lit("")), 64)
    return table(spark, d, "chunks").select("chunk_id", F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 6).alias("total"), F.round(v[0], 6).alias("first"))


def quota_sample(spark, d):
    picked = sampling.by_quota(sampling.candidates(spread(table(spark, d, "chunks"))))
    return picked.select("doc", "section_type", "chunk_id", F.col("score").cast("bigint").alias("score"), F.col("pick").cast("bigint").alias("pick"))


def sampling_summary(spark, d):
    return sampling.sampling_summary(sampling.by_quota(sampling.candidates(spread(table(spark, d, "chunks")))))


def sampling_report(spark, d):
    """What a sample with appendix forms and body text for sparse documents holds."""
    cands = sampling.candidates(spread(table(spark, d, "chunks")))
    return sampling.sampling_report(cands, sampling.by_document(cands, least=4))


def document_sample(spark, d):
    """The sample itself, ranked in each document."""
    picked = sampling.by_document(sampling.candidates(spread(table(spark, d, "chunks"))), least=4)
    return picked.select("doc", "section_type", "chunk_id", F.col("rank_in_doc").cast("bigint").alias("rank_in_doc"), F.col("rank_in_section").cast("bigint").alias("rank_in_section"))


def stride_sample(spark, d):
    return sampling.stride(table(spark, d, "chunks").select("row_idx", "chunk_id"), ["row_idx"], 25).select("row_idx", "chunk_id")


def question_filters(spark, d):
    q = F.col("question")
    return table(spark, d, "eval_rows").select("eval_id", questions.open_ended(q).alias("open_ended"), questions.internal_id(q).alias("internal_id"), questions.about_form(q).alias("about_form"), F.array_join(questions.requirement_ids(q), ",").alias("requirement_ids"))


def question_overlap(spark, d):
    """How many topic words of each question stand in the chunks of its document."""
    asked = table(spark, d, "eval_rows").select(F.col("eval_id").alias("query_id"), F.col("question").alias("query"), F.col("doc_id").alias("doc"))
    return questions.corpus_overlap(asked, table(spark, d, "chunks").select(F.col("doc_id").alias("doc"), "text"))


def gold_validity(spark, d):
    return questions.valid_gold(table(spark, d, "eval_rows"), table(spark, d, "chunks"))


def _headed(spark, d) -> DataFrame:
    found = structure.lines(spread(table(spark, d, "documents")), "doc_id").withColumn("h", structure.heading(F.col("line")))
    return found.select("doc_id", "pos", "line", F.col("h.level").alias("level"), F.col("h.title").alias("title"))


def headings(spark, d):
    return _headed(spark, d).where("level IS NOT NULL").select("doc_id", F.col("pos").cast("bigint").alias("pos"), F.col("level").cast("bigint").alias("level"), "title")


def heading_paths(spark, d):
    return structure.heading_path(_headed(spark, d), "doc_id").select("doc_id", "pos", F.array_join("path", " > ").alias("path"), structure.section_type(F.array_join("path", " ")).alias("section_type"))


def section_types(spark, d):
    path = F.coalesce(F.col("metadata")["section_path_text"], F.lit(""))
    return table(spark, d, "chunks").select("chunk_id", structure.section_type(path).alias("section_type"))


def table_shapes(spark, d):
    return structure.shapes(table(spark, d, "table_rows"))


def table_row_groups(spark, d):
    return structure.row_groups(table(spark, d, "table_rows"))


def record_runs(spark, d):
    return structure.runs(table(spark, d, "chunks").where("doc_id IS NOT NULL"), ["chunk_type"], "doc_id", "row_idx").select("doc_id", F.col("island").cast("bigint").alias("island"), "chunk_type", "n", "first_pos")


def ocr_errors(spark, d):
    """Expected answers as truth, answers as what was read."""
    e, a = F.coalesce("expected_answer", F.lit("")), F.coalesce("answer", F.lit(""))
    rows = table(spark, d, "eval_rows")
    return rows.select("eval_id", F.round(ocr.character_errors(e, a), 6).alias("cer"), F.round(ocr.similarity(e, a), 6).alias("similarity"), F.round(ocr.word_errors(e, a), 6).alias("wer"))


def _fields(spark, d) -> DataFrame:
    rows = table(spark, d, "table_rows").where("cells IS NOT NULL")
    pair = lambda part: F.map_from_entries(F.transform(F.filter(F.map_entries("cells"), part), lambda e: F.struct(e["key"], F.split(F.coalesce(e["value"], F.lit("")), r"\.\s"))))
    return rows.select(F.col("row_id").alias("id"), pair(lambda e: F.lit(True)).alias("truth"), pair(lambda e: F.pmod(F.xxhash64(e["value"]), F.lit(4)) > 0).alias("read"))


def ocr_fields(spark, d):
    return ocr.field_metrics(_fields(spark, d))


def ocr_summary(spark, d):
    return ocr.structure_summary(ocr.field_metrics(_fields(spark, d)))


def html_text(spark, d):
    return table(spark, d, "chunks").select("chunk_id", T.without_tags(F.col("text")).alias("text"))


def durations(spark, d):
    return table(spark, d, "eval_rows").select("eval_id", T.last_duration(F.col("answer")).alias("duration"))


def documents_of_files(spark, d):
    """Documents with their file's facts: by path's name, each file once (the latest posting)."""
    f = table(spark, d, "doc_files").where("file_name IS NOT NULL").groupBy("file_name").agg(F.max(F.struct("posted_at", "agency", "notice_no")).alias("x"))
    docs = table(spark, d, "documents").select("doc_id", F.coalesce("file_name", F.regexp_extract("path", "([^/]+)$", 1)).alias("file_name"))
    return docs.join(f, "file_name", "left").select("doc_id", "file_name", "x.agency", "x.notice_no")


def chat_facets(spark, d):
    """Counts of chunks by type and section, for a viewer."""
    c = table(spark, d, "chunks")
    a = c.groupBy(F.lit("type").alias("facet"), F.coalesce("chunk_type", F.lit("none")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    b = c.groupBy(F.lit("section").alias("facet"), F.coalesce(F.col("metadata")["section_type"], F.lit("none")).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return a.unionByName(b)


def _records_of(spark, d) -> DataFrame:
    """Chunks read back as parsed records: one per chunk, in order, tables by their type."""
    c = table(spark, d, "chunks")
    is_table = F.col("chunk_type").startswith("table_")
    none = F.lit(None).cast("string")
    return c.select(
        F.coalesce(F.col("metadata")["file_name"], F.lit("")).alias("file_name"), F.col("row_idx").alias("pos"), F.when(is_table, "table").when(F.col("chunk_type") == "cover_text", "cover_text").otherwise("section_text").alias("content_type"),
        F.split(F.coalesce(F.col("metadata")["section_path_text"], F.lit("")), " > ").alias("section_path"), "text", F.when(is_table, F.col("chunk_id")).alias("table_id"), F.when(is_table, F.substring_index("chunk_type", "/", -1)).alias("table_type"),
        none.alias("shape"), F.when(is_table, F.size(F.split("text", "\n"))).alias("n_cols"), F.array().cast("array<string>").alias("header"), F.when(is_table, F.split("text", "\n")).alias("rows"),
    )


def record_chunks(spark, d):
    return records.chunks(_records_of(spark, d))


def page_events_filled(spark, d):
    """The last known value of each user's events of one kind, carried forward."""
    e = table(spark, d, "events").withColumn("seen", F.when(F.col("event_type") == "view", F.col("value")))
    return pages.carried_forward(e, "seen", ["user_id"], "event_id").select("event_id", "seen_filled")


NAMES = [
    text_normalised, text_clean_block, text_keys, search_tokens, html_text, durations, bm25_corpus_stats, bm25_term_df, bm25_topk, bm25_doc_filtered, dense_topk, dense_filtered,
    hybrid_rrf, hybrid_threshold, hybrid_minmax, reranked, context_budget, last_turns, doc_scope, documents_of_files, retrieval_metrics, answer_bundle, answer_match, harness_summary, report_levels,
    task_outcomes, failure_counts, failures_top, successes, split_baseline, split_oversized, split_section, split_paragraph, chunked_documents, chunk_summary, slim_projection, merged_ids,
    mock_embedding, quota_sample, sampling_summary, sampling_report, document_sample, stride_sample, question_filters, question_overlap, gold_validity, headings, heading_paths, section_types, table_shapes,
    table_row_groups, record_runs, ocr_errors, ocr_fields, ocr_summary, chat_facets, record_chunks, page_events_filled,
]


def queries() -> dict:
    return {f.__name__: f for f in [*NAMES, *evaluation.NAMES, *chunking.NAMES, *reading.NAMES, *parsing.NAMES, *live.NAMES]}


def entry(spark: SparkSession) -> DataFrame:
    """The flagship: BM25 over all chunks for a batch of questions."""
    return bm25_topk(spark, "/root/testdata/sf0.001")
