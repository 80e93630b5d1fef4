"""Evaluation of read images in batches: structures of any depth, missing fields, reasons for review, summaries."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, MapType, StringType, StructField, StructType

from gleanery.functions import text as T
from gleanery.operators import ocr

LOW_RECALL = 0.8
# Keys whose texts come first, and keys whose values are no read text.
TEXT_KEYS = "text texts rec_texts markdown content result answer output prediction html table_html table_markdown".split()
OTHER_KEYS = {"image", "image_path", "input_path", "query", "prompt"}
# Suffixes of images, in the order in which one replaces another.
IMAGE_SUFFIXES = [".jpg", ".jpeg", ".png", ".bmp", ".gif", ".webp"]


def _flat(value: object) -> dict[str, list[str]]:
    """Dotted path -> texts: lists do not lengthen the path, empty texts are left out."""
    out: dict[str, list[str]] = {}
    stack = [("", value)]
    while stack:
        path, v = stack.pop()
        if isinstance(v, dict):
            stack += [(f"{path}.{k}" if path else str(k), x) for k, x in reversed(v.items())]
        elif isinstance(v, list):
            stack += [(path, x) for x in reversed(v)]
        elif text := str(v).strip():
            out.setdefault(path, []).append(text)
    return out


@F.pandas_udf(MapType(StringType(), ArrayType(StringType())))
def flattened(structures: pd.Series) -> pd.Series:
    """A JSON object of any depth as a map of dotted paths to texts; anything else gives an empty map."""

    def one(text: str | None) -> dict:
        try:
            value = json.loads(text or "{}")
        except ValueError:
            return {}
        return _flat(value) if isinstance(value, dict) else {}

    return structures.map(one)


def _texts(value: object) -> list[str]:
    if isinstance(value, str):
        return [value.strip()] if value.strip() else []
    if isinstance(value, dict):
        first = [k for k in TEXT_KEYS if k in value]
        return [t for k in [*first, *(k for k in value if k not in OTHER_KEYS and k not in first)] for t in _texts(value[k])]
    return [t for x in value for t in _texts(x)] if isinstance(value, list) else []


@F.pandas_udf(ArrayType(StructType([StructField("text", StringType()), StructField("score", DoubleType())])))
def collected(results: pd.Series) -> pd.Series:
    """The lines of all texts in the JSON result of any reader, each once, in order; texts under the usual keys come first."""

    def one(text: str | None) -> list[dict]:
        try:
            value = json.loads(text) if text else []
        except ValueError:
            return []
        lines = [line.strip() for t in _texts(value) for line in t.splitlines()]
        return [{"text": t, "score": None} for t in dict.fromkeys(lines) if t]

    return results.map(one)


def merged_lines(first: Column, second: Column) -> Column:
    """Lines of two readings, each trimmed text once, those of the first reading before."""
    both = F.filter(F.transform(F.concat(first, second), lambda x: F.struct(F.trim(F.coalesce(x["text"], F.lit(""))).alias("text"), x["score"].alias("score"))), lambda x: x["text"] != "")
    texts = F.transform(both, lambda x: x["text"])
    return F.filter(both, lambda x, i: ~F.array_contains(F.slice(texts, F.lit(1), i), x["text"]))


def shows_table(items: Column) -> Column:
    """Whether a layout reading has an item that it calls a table."""
    return F.coalesce(F.exists(items, lambda x: x.rlike(r"(?i)label:\s*table\b")), F.lit(False))


def required_gaps(required: Column, fields: Column) -> Column:
    """struct(required, missing): required fields without a match; without a list, all fields that the truth has are required.

    ``fields``: array<struct<field, matched, gt_total>>.
    """
    named = F.filter(F.transform(F.coalesce(required, F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: F.coalesce(r, F.lit("")) != "")
    own = F.transform(F.filter(fields, lambda f: f["gt_total"] > 0), lambda f: f["field"])
    wanted = F.when(F.size(named) > 0, named).otherwise(own)
    found = F.transform(F.filter(fields, lambda f: f["matched"] > 0), lambda f: f["field"])
    return F.struct(wanted.alias("required"), F.filter(wanted, lambda r: ~F.array_contains(found, r)).alias("missing"))


def review_reasons(status: Column, micro_recall: Column, missing: Column, kind: Column, html: Column, rows: Column) -> Column:
    """Why a read image needs review, in a fixed order; an empty array if it does not."""
    is_table = F.lower(F.coalesce(kind, F.lit(""))) == "table"
    yes = lambda c: F.coalesce(c, F.lit(False))
    return F.array_compact(F.array(
        F.when(F.lower(F.coalesce(status, F.lit(""))) != "success", "status_not_success"), F.when(micro_recall < LOW_RECALL, "structure_micro_recall<0.8"), F.when(F.size(missing) > 0, "required_field_missing"),
        F.when(is_table & ~yes(html), "table_html_missing"), F.when(is_table & ~yes(rows), "table_rows_missing"),
    ))


def evaluated(pairs: DataFrame, threshold: float = ocr.THRESHOLD) -> DataFrame:
    """One row per image: text and structure metrics, required and missing fields, reasons for review.

    pairs: id, doc_key, type, status, latency_ms, gt_text, pred_text, gt_structure and
    pred_structure (JSON), required_fields (array), table_html, table_rows (booleans).
    Null texts are empty, null structures have no fields.
    """
    maps = pairs.select("id", flattened("gt_structure").alias("truth"), flattened("pred_structure").alias("read"))
    metrics = ocr.field_metrics(maps, threshold)
    fields = metrics.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("field", "matched", "gt_total", "pred_total", "f1"))).alias("fields"))  # the fields of one image
    sums = ocr.structure_summary(metrics)
    gt, pred = F.coalesce("gt_text", F.lit("")), F.coalesce("pred_text", F.lit(""))
    rows = pairs.join(fields, "id", "left").join(sums, "id", "left")
    none = F.array().cast(fields.schema["fields"].dataType)
    rows = rows.withColumn("fields", F.coalesce("fields", none)).withColumns({
        "exact_match": T.inline(gt) == T.inline(pred), "cer": ocr.character_errors(gt, pred), "wer": ocr.word_errors(T.inline(gt), T.inline(pred)), "char_similarity_pct": F.round(ocr.similarity(gt, pred), 2),
        "micro_recall": F.coalesce("micro_recall", F.lit(1.0)), "macro_f1": F.coalesce("macro_f1", F.lit(0.0)), "matched": F.coalesce("matched", F.lit(0)), "gt_total": F.coalesce("gt_total", F.lit(0)), "pred_total": F.coalesce("pred_total", F.lit(0)),
    })
    gaps = rows.withColumn("gaps", required_gaps(F.col("required_fields"), F.col("fields")))
    told = gaps.withColumns({"required": F.col("gaps.required"), "missing": F.col("gaps.missing"), "field_count": F.size("fields").cast("bigint")}).drop("gaps", "required_fields")
    out = told.withColumn("review_reasons", review_reasons(F.col("status"), F.col("micro_recall"), F.col("missing"), F.col("type"), F.col("table_html"), F.col("table_rows")))
    keep = ["id", "doc_key", "type", "status", "latency_ms", "exact_match", "cer", "wer", "char_similarity_pct", "field_count", "matched", "gt_total", "pred_total", "micro_recall", "macro_f1", "required", "missing", "table_html", "table_rows", "fields", "review_reasons"]
    return out.select(*keep).withColumn("review_required", F.size("review_reasons") > 0)


def refreshed(stored: DataFrame) -> DataFrame:
    """Stored evaluations with missing fields and reasons computed anew where they have none; a stored decision on review stays."""
    empty = F.array().cast("array<string>")
    gaps = required_gaps(F.col("required"), F.col("fields"))["missing"]
    missing = F.when((F.size(F.coalesce("missing", empty)) == 0) & (F.size(F.coalesce("required", empty)) > 0) & (F.size("fields") > 0), gaps).otherwise(F.coalesce("missing", empty))
    made = stored.withColumn("missing", missing)
    anew = F.array_remove(review_reasons(F.col("status"), F.col("micro_recall"), F.col("missing"), F.col("type"), F.col("table_html"), F.col("table_rows")), "status_not_success")
    made = made.withColumn("review_reasons", F.when(F.size(F.coalesce("review_reasons", empty)) > 0, F.col("review_reasons")).otherwise(anew))
    return made.withColumn("review_required", F.coalesce("review_required", F.size("review_reasons") > 0))


def batch_rows(evaluations: DataFrame) -> DataFrame:
    """The rows of a batch's table: similarity as a share, lists joined by |."""
    return evaluations.select(
        "id", "doc_key", "type", "status", (F.col("char_similarity_pct") / 100).alias("text_similarity"), "cer", "wer", F.col("micro_recall").alias("structure_micro_recall"), F.col("macro_f1").alias("structure_macro_f1"),
        F.col("matched").alias("matched_fields"), F.col("gt_total").alias("total_fields"), F.col("table_html").alias("table_html_exists"), F.col("table_rows").alias("table_rows_exists"), "review_required",
        F.array_join("review_reasons", "|").alias("review_reasons"), F.array_join("missing", "|").alias("missing_required_fields"), "latency_ms",
    )


def review_queue(evaluations: DataFrame) -> DataFrame:
    """The evaluations that need review, with their reasons."""
    return evaluations.where("review_required").select("id", "doc_key", "type", "review_reasons", "missing", "micro_recall", "macro_f1")


def batch_summary(evaluations: DataFrame) -> DataFrame:
    """One row: images, mean similarity, micro recall and macro F1 (0 without values), images for review, percent that failed (0 for none)."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    failed = F.try_divide(F.count_if(F.coalesce("status", F.lit("")) != "success") * 100.0, F.count(F.lit(1)))
    return evaluations.agg(
        F.count(F.lit(1)).alias("images"), F.round(zero(F.avg(F.col("char_similarity_pct") / 100)), 6).alias("avg_similarity"), F.round(zero(F.avg("micro_recall")), 6).alias("avg_structure_micro_recall"),
        F.round(zero(F.avg("macro_f1")), 6).alias("avg_structure_macro_f1"), F.count_if("review_required").alias("review_required"), F.round(zero(failed), 6).alias("fail_rate_pct"),
    )


@F.pandas_udf(DoubleType())
def whole_similarity(truth: pd.Series, read: pd.Series) -> pd.Series:
    """The ratio of matching blocks of two whole texts; two empty texts are alike."""
    from difflib import SequenceMatcher

    return pd.Series([SequenceMatcher(None, a or "", b or "").ratio() for a, b in zip(truth, read, strict=True)], dtype="float64")


def explored(truth: DataFrame, read: DataFrame) -> DataFrame:
    """(id, status, cer, wer, similarity, n_fields, n_hits, hit_rate): whole texts, and how many values stand anywhere in the read text.

    truth: id, gt_text, gt_structure (JSON), use_eval; rows with ``use_eval`` false are left
    out.  What was not read has status 'missing' and an empty text.
    """
    met = truth.where(F.coalesce("use_eval", F.lit(True))).join(read.select("id", "pred_text", "status"), "id", "left")
    met = met.withColumns({"status": F.coalesce("status", F.lit("missing")), "g": T.inline(F.coalesce("gt_text", F.lit(""))), "p": T.inline(F.coalesce("pred_text", F.lit(""))), "f": flattened("gt_structure")})
    values = F.flatten(F.map_values("f"))
    hits = F.size(F.filter(values, lambda v: (T.relaxed(v) != "") & F.contains(T.relaxed(F.col("p")), T.relaxed(v))))
    made = met.withColumns({"cer": ocr.character_errors(F.col("g"), F.col("p")), "wer": ocr.word_errors("g", "p"), "similarity": whole_similarity("g", "p"), "n_fields": F.size(values).cast("bigint"), "n_hits": hits.cast("bigint")})
    return made.select("id", "status", "cer", "wer", "similarity", "n_fields", "n_hits", F.try_divide("n_hits", "n_fields").alias("hit_rate"))


def explored_summary(rows: DataFrame) -> DataFrame:
    """One row of means over :func:`explored`, and the share that failed."""
    mean = lambda c: F.round(F.avg(c), 6).alias(f"mean_{c}")
    return rows.agg(F.count(F.lit(1)).alias("n"), mean("cer"), mean("wer"), mean("similarity"), mean("hit_rate"), F.round(F.avg((F.col("status") != "success").cast("double")), 6).alias("fail_rate"))


def image_chain(images: DataFrame, read: Callable[[Column], Column], second: Callable[[Column], Column] | None = None, truth: DataFrame | None = None, structure: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Images to readings, structures and evaluations, in one plan.

    images: id, doc_key, type, content.  ``read`` gives struct(lines, items, status,
    latency_ms) of a content; where its items show a table and ``second`` is given, the
    lines of both readings are merged and their times added.  ``structure`` turns (id,
    lines) to (id, pred_structure); without ``truth`` the evaluation is left out.
    """
    got = images.withColumn("r", read(F.col("content")))
    if second is not None:
        again = F.when(shows_table(F.col("r.items")), second(F.col("content")))
        got = got.withColumn("r2", again)
        lines = F.when(F.col("r2").isNotNull(), merged_lines(F.col("r.lines"), F.col("r2.lines"))).otherwise(merged_lines(F.col("r.lines"), F.array().cast(got.schema["r"].dataType["lines"].dataType)))
        spent = F.col("r.latency_ms") + F.coalesce("r2.latency_ms", F.lit(0.0))
    else:
        lines, spent = merged_lines(F.col("r.lines"), F.array().cast(got.schema["r"].dataType["lines"].dataType)), F.col("r.latency_ms")
    out = got.select("id", "doc_key", "type", lines.alias("lines"), F.col("r.status").alias("status"), F.round(spent, 2).alias("latency_ms"))
    out = out.withColumn("pred_text", F.array_join(F.transform("lines", lambda x: x["text"]), "\n"))
    if truth is None:
        return out
    made = structure(out.select("id", "lines")) if structure is not None else out.select("id", F.lit("{}").alias("pred_structure"))
    flags = out.join(made, "id", "left").withColumns({"table_html": F.lit(False), "table_rows": F.lit(False)})
    return evaluated(truth.select("id", "gt_text", "gt_structure", "required_fields").join(flags, "id", "left").withColumn("status", F.coalesce("status", F.lit("missing"))))


# --- files of truth and images


def truth_file(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_key, path): where the truth of each document stands.

    files: path, ids (array), keys (array) of the records in it; wanted: doc_key.  First
    <doc>.jsonl, then <doc>.json, then the first file by name (JSON lines before JSON) with a
    record of that document's key or an id that begins with it; else <doc>.jsonl is assumed.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    stem, lines = F.regexp_replace(name, r"\.jsonl?$", ""), name.endswith(".jsonl")
    f = files.select("path", stem.alias("stem"), F.when(lines, 0).otherwise(1).alias("late"), "ids", "keys")
    own = wanted.select("doc_key").distinct()
    named = own.join(f, own.doc_key == f.stem).select("doc_key", "path", "late", F.lit(0).alias("tier"))
    held = f.select("path", "late", F.explode(F.array_union(F.coalesce("keys", F.array().cast("array<string>")), F.flatten(F.transform(F.coalesce("ids", F.array().cast("array<string>")), lambda i: F.transform(F.filter(F.sequence(F.lit(1), F.length(i)), lambda n: F.substring(i, n, F.lit(1)) == "_"), lambda n: F.left(i, n - 1)))))).alias("doc_key"))
    inside = held.join(own, "doc_key", "left_semi").select("doc_key", "path", "late", F.lit(1).alias("tier"))
    best = named.unionByName(inside).groupBy("doc_key").agg(F.min(F.struct("tier", "late", "path")).alias("b"))
    return own.join(best, "doc_key", "left").select("doc_key", F.coalesce("b.path", F.concat("doc_key", F.lit(".jsonl"))).alias("path"), F.col("b").isNotNull().alias("exists"))


def image_file(images: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_key, image, path): the image itself, one of the same stem by suffix, else the folder's first; reading fails for an empty folder.

    images: doc_key, path; wanted: doc_key, image.
    """
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    i = images.select(F.col("doc_key").alias("k"), "path", name.alias("name"), F.regexp_replace(name, r"\.[^.]*$", "").alias("stem"), F.array_position(F.array(*[F.lit(s) for s in IMAGE_SUFFIXES]), suffix).alias("place")).where("place > 0")
    first = i.groupBy("k").agg(F.min("name").alias("first_name"), F.min_by("path", "name").alias("first"))
    asked = wanted.select("doc_key", "image", F.regexp_replace("image", r"\.[^.]*$", "").alias("s"))
    close = asked.join(i, (asked.doc_key == i.k) & (asked.s == i.stem)).groupBy("doc_key", "image").agg(F.min_by("path", F.struct(F.col("name") != F.col("image"), "place")).alias("close"))
    out = asked.join(close, ["doc_key", "image"], "left").join(first, asked.doc_key == first.k, "left")
    none = F.raise_error(F.concat(F.lit("no images of "), F.col("doc_key"))).cast("string")
    return out.select("doc_key", "image", F.coalesce("close", "first", none).alias("path"))


def images_tag(path: Column) -> Column:
    """The folder below ocr_images in a path; empty if there is none."""
    return F.trim(F.regexp_extract(path, r"(?:^|/)ocr_images/([^/]+)", 1))


def output_path(root: Column, engine: Column, images_root: Column, doc_key: Column, image: Column) -> Column:
    """root/engine/tag/document/image, where the tag may be missing."""
    return F.concat_ws("/", root, F.lower(F.trim(engine)), F.nullif(images_tag(images_root), F.lit("")), doc_key, F.regexp_replace(image, r"\.[^.]*$", ""))


def last_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key, by a bounded aggregate."""
    w = [F.max_by(F.struct(*df.columns), order).alias("x")]
    return df.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(*w).select("x.*")


