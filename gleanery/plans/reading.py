"""Registered queries of read images and their evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.operators import ocr_eval
from gleanery.session import table


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    """Expected answers and keywords as truth, answers and retrieved ids as what was read."""
    e = table(spark, d, "eval_rows")
    empty = F.array().cast("array<string>")
    ids = F.transform(F.coalesce("sources", F.array().cast(e.schema["sources"].dataType)), lambda s: s["chunk_id"])
    truth = F.to_json(F.struct(F.struct(F.coalesce("ground_truth_keywords", empty).alias("words"), F.col("expected_answer").alias("text")).alias("page"), F.coalesce("gold_chunk_ids", empty).alias("ids")))
    read = F.to_json(F.struct(F.struct(F.split(F.coalesce("answer", F.lit("")), " ").alias("words"), F.col("answer").alias("text")).alias("page"), ids.alias("ids")))
    status = F.when(F.col("eval_id") % 7 == 0, "error").otherwise("success")
    return e.select(
        F.col("eval_id").alias("id"), F.coalesce("category", F.lit("none")).alias("doc_key"), F.when(F.col("eval_id") % 3 == 0, "table").otherwise("text").alias("type"), status.alias("status"), F.col("total_latency_ms").alias("latency_ms"),
        F.col("expected_answer").alias("gt_text"), F.col("answer").alias("pred_text"), truth.alias("gt_structure"), read.alias("pred_structure"), F.when(F.col("eval_id") % 2 == 0, F.array(F.lit("ids"))).alias("required_fields"),
        (F.col("eval_id") % 6 == 0).alias("table_html"), (F.col("eval_id") % 4 == 0).alias("table_rows"),
    )


def ocr_structures(spark, d):
    """Paths and values of nested structures."""
    m = _pairs(spark, d).select("id", F.explode(ocr_eval.flattened("gt_structure")).alias("path", "values"))
    return m.select("id", "path", F.array_join("values", "|").alias("values"))


def ocr_evaluations(spark, d):
    out = ocr_eval.evaluated(_pairs(spark, d))
    return out.select("id", "exact_match", F.round("cer", 6).alias("cer"), "char_similarity_pct", "field_count", F.round("micro_recall", 6).alias("micro_recall"), F.array_join("required", "|").alias("required"), F.array_join("missing", "|").alias("missing"), F.array_join("review_reasons", "|").alias("review_reasons"), "review_required")


def ocr_batch_rows(spark, d):
    return ocr_eval.batch_rows(ocr_eval.evaluated(_pairs(spark, d)))


def ocr_review_queue(spark, d):
    q = ocr_eval.review_queue(ocr_eval.evaluated(_pairs(spark, d)))
    return q.select("id", "doc_key", "type", F.array_join("review_reasons", "|").alias("review_reasons"))


def ocr_batch_summary(spark, d):
    return ocr_eval.batch_summary(ocr_eval.evaluated(_pairs(spark, d)))


def ocr_explored(spark, d):
    """Whole texts against each other, and how many gold words stand in the answer; odd ids were not read."""
    p = _pairs(spark, d).withColumn("use_eval", F.col("id") % 5 != 0)
    truth = p.withColumn("gt_structure", F.to_json(F.struct(F.get_json_object("gt_structure", "$.page.words").alias("raw"))))
    words = table(spark, d, "eval_rows").select(F.col("eval_id").alias("id"), F.to_json(F.struct(F.coalesce("ground_truth_keywords", F.array().cast("array<string>")).alias("words"))).alias("s"))
    truth = truth.join(words, "id").drop("gt_structure").withColumnRenamed("s", "gt_structure")
    out = ocr_eval.explored(truth.select("id", "gt_text", "gt_structure", "use_eval"), p.where("id % 3 <> 0").select("id", "pred_text", "status"))
    return out.select("id", "status", F.round("cer", 6).alias("cer"), "n_fields", "n_hits", F.round("hit_rate", 6).alias("hit_rate"))


def ocr_lines_merged(spark, d):
    """Contexts of two halves of each question as two readings of one page."""
    e = table(spark, d, "eval_rows")
    lines = F.transform(F.coalesce("sources", F.array().cast(e.schema["sources"].dataType)), lambda s: F.struct(s["chunk_id"].alias("text"), s["score"].alias("score")))
    both = ocr_eval.merged_lines(lines, F.reverse(lines))
    return e.select("eval_id", F.array_join(F.transform(both, lambda x: x["text"]), "|").alias("lines"), ocr_eval.shows_table(F.array(F.lit("label: TABLE 3"), "question")).alias("table"))


def ocr_collected(spark, d):
    """All texts of nested readings, usual keys first."""
    e = table(spark, d, "eval_rows")
    result = F.to_json(F.struct(F.col("category").alias("other"), F.struct(F.col("question").alias("content"), F.array(F.struct(F.col("answer").alias("text"))).alias("pages")).alias("result"), F.lit("page 1").alias("prompt")))
    return e.select("eval_id", F.array_join(F.transform(ocr_eval.collected(result), lambda x: x["text"]), "\n").alias("lines"))


def ocr_paths(spark, d):
    """Where images and results of the documents stand."""
    docs = table(spark, d, "doc_files").select(F.coalesce("agency", F.lit("none")).alias("doc_key"), "file_name").where("file_name IS NOT NULL").distinct()
    root = F.concat(F.lit("/data/ocr_images/v2/"), F.col("doc_key"))
    images = docs.where(F.lower("file_name").rlike(r"\.(png|jpe?g|bmp)$")).select("doc_key", F.concat(root, F.lit("/"), F.col("file_name")).alias("path"))
    wanted = docs.join(images.select("doc_key").distinct(), "doc_key", "left_semi").select("doc_key", F.col("file_name").alias("image"))
    found = ocr_eval.image_file(images, wanted)
    return found.select("doc_key", "image", "path", ocr_eval.output_path(F.lit("/out"), F.lit(" VL "), F.col("path"), F.col("doc_key"), F.col("image")).alias("output"))


NAMES = [ocr_structures, ocr_evaluations, ocr_batch_rows, ocr_review_queue, ocr_batch_summary, ocr_explored, ocr_lines_merged, ocr_collected, ocr_paths]


def sql() -> dict[str, str]:
    from gleanery.plans import oracles as O

    e = "coalesce(expected_answer, '')"
    inl, relaxed = O._inline, lambda c: f"regexp_replace(lower({c}), '[^0-9a-z가-힣]+', '', 'g')"
    # DuckDB's levenshtein counts bytes, so each text is spelled in one ASCII letter per rank of its characters only where both are ASCII; others are left to the tests
    image = "['.jpg', '.jpeg', '.png', '.bmp', '.gif', '.webp']"
    docs = "(SELECT DISTINCT coalesce(agency, 'none') AS doc_key, file_name FROM doc_files WHERE file_name IS NOT NULL)"
    imgs = f"(SELECT *, '/data/ocr_images/v2/' || doc_key || '/' || file_name AS path, regexp_replace(file_name, '\\.[^.]*$', '') AS stem, list_position({image}, lower(regexp_extract(file_name, '(\\.[^.]+)$', 1))) AS place FROM {docs} WHERE regexp_matches(lower(file_name), '\\.(png|jpe?g|bmp)$'))"
    values = "list_filter(list_transform(coalesce({0}, []), lambda v: trim(coalesce(v, 'None'))), lambda v: v <> '')"
    return {
        "ocr_structures": f"""SELECT eval_id AS id, path, array_to_string(vs, '|') AS values FROM (SELECT eval_id, unnest(['page.words', 'page.text', 'ids']) AS path, unnest([{values.format('ground_truth_keywords')}, CASE WHEN expected_answer IS NULL OR {O._strip('expected_answer')} = '' THEN [] ELSE [{O._strip('expected_answer')}] END, {values.format('gold_chunk_ids')}]) AS vs FROM eval_rows) WHERE len(vs) > 0""",
        "ocr_lines_merged": "SELECT eval_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), '|'), '') AS lines, true AS \"table\" FROM (SELECT eval_id, list_filter(list_transform(list_concat(coalesce(sources, []), list_reverse(coalesce(sources, []))), lambda s: trim(coalesce(s.chunk_id, ''))), lambda x: x <> '') AS l FROM eval_rows)",
        "ocr_collected": f"""SELECT eval_id, coalesce(array_to_string(list_filter(l, lambda x, i: list_position(l, x) = i), chr(10)), '') AS lines FROM (SELECT eval_id, list_filter(list_transform(flatten([regexp_split_to_array(coalesce(question, ''), '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), regexp_split_to_array(coalesce(answer, ''), '\\r\\n|[\\n\\r\\x{{0b}}\\x{{0c}}\\x{{1c}}-\\x{{1e}}\\x{{85}}\\x{{2028}}\\x{{2029}}]'), regexp_split_to_array(coalesce(category, ''), '\\n')]), lambda x: {O._strip('x')}), lambda x: x <> '') AS l FROM eval_rows)""",
        "ocr_paths": f"""SELECT w.doc_key, w.file_name AS image, p.path, '/out/vl/v2/' || w.doc_key || '/' || regexp_replace(w.file_name, '\\.[^.]*$', '') AS output FROM (SELECT * FROM {docs} d WHERE EXISTS (SELECT 1 FROM {imgs} i WHERE i.doc_key = d.doc_key)) w, LATERAL (SELECT path FROM {imgs} i WHERE i.doc_key = w.doc_key
 ORDER BY i.file_name <> w.file_name, i.stem <> regexp_replace(w.file_name, '\\.[^.]*$', ''), CASE WHEN i.stem = regexp_replace(w.file_name, '\\.[^.]*$', '') THEN place END, i.file_name LIMIT 1) p""",
    }
