"""One job per verb: python -m gleanery.cli VERB INPUT OUTPUT [--option value]."""

from __future__ import annotations

import argparse
import json
from collections.abc import Callable
from functools import reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery import config, providers
from gleanery.operators import answering, generation, metrics, ocr_eval, ocr_export, ocr_fields, parsing, pipeline, prechunk, records, report, sampling, search, splitters, viewer
from gleanery.plans.queries import queries
from gleanery.sources import files

CHUNK = "chunk_id string, doc_id string, chunk_type string, text string, metadata map<string,string>"
RECORD = "file_name string, pos bigint, content_type string, section_path array<string>, text string, table_id string, table_type string, shape string, n_cols int, header array<string>, rows array<string>"
PDF_EVENT = "file_name string, pos bigint, kind string, text string, page_no int, font_size double, rows array<array<string>>, error string"
HWP_EVENT = f"file_name string, pos bigint, kind string, marker string, text string, n_rows int, n_cols int, cells array<{parsing.CELL}>, error string"
VERBS: dict[str, Callable] = {}


def verb(f: Callable) -> Callable:
    VERBS[f.__name__.replace("_", "-")] = f
    return f


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table in Parquet, or JSON lines by their suffix, in ``schema``."""
    return files.read_json_lines(spark, path, schema) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)


def _write(df: DataFrame, path: str, **named: DataFrame) -> None:
    df.write.mode("overwrite").parquet(path)
    for name, more in named.items():
        files.write_json_lines(more, f"{path.rstrip('/')}_{name}")


@verb
def ingest(spark, a):
    """A folder of texts to chunks."""
    good, bad = files.split_errors(files.load_documents(spark, a.input, files.read_metadata(spark, a.metadata) if a.metadata else None))
    _write(splitters.chunk_documents(good, size=a.config.chunking.chunk_size, overlap=a.config.chunking.chunk_overlap), a.output, errors=bad)


@verb
def query(spark, a):
    """BM25 answers to a table (query_id, query) over chunks (chunk_id, row_idx, text)."""
    index = spark.read.parquet(a.index).withColumnRenamed("text", "body")
    search.bm25(spark.read.parquet(a.input), index, a.k).write.mode("overwrite").parquet(a.output)


def _hits(spark, a, questions: DataFrame) -> DataFrame:
    index = files.load_index(spark, a.index)
    r = a.config.retrieval
    body = index.select("chunk_id", "row_idx", F.col("text").alias("body"))
    asked = questions.withColumn("vector", providers.embedding(F.col("query")))
    vectors = index.select("chunk_id", "row_idx", F.col("embedding").alias("vector")) if r.hybrid.enabled else None
    return answering.retrieve(asked, body, vectors, r.top_k, r.hybrid.bm25_top_k, r.score_threshold)


@verb
def answer(spark, a):
    """Answers with sources to a table (query_id, query) over an index, fused search by the settings."""
    questions = spark.read.parquet(a.input)
    made = answering.answers(questions, _hits(spark, a, questions), files.load_index(spark, a.index), a.config.generation.max_context_chars)
    made.write.mode("overwrite").parquet(a.output)


@verb
def evaluate(spark, a):
    """Answered questions to metrics, and their summary as JSON lines beside."""
    _write(metrics.answer_metrics(metrics.retrieval_metrics(spark.read.parquet(a.input))), a.output)
    files.write_json_lines(metrics.report(spark.read.parquet(a.output)), a.output.rstrip("/") + "_summary")


@verb
def evaluate_harness(spark, a):
    """Questions (eval_id, question, ...) answered over an index in one batch, with all metrics, the judge's scores and their means."""
    rows = spark.read.parquet(a.input)
    asked = rows.select(F.col("eval_id").alias("query_id"), F.col("question").alias("query"))
    made = answering.answers(asked, _hits(spark, a, asked), files.load_index(spark, a.index), a.config.generation.max_context_chars)
    sources = F.transform("sources", lambda s: F.struct(s["chunk_id"].alias("chunk_id"), s["text"].alias("text"), s["score"].alias("score"), F.create_map().cast("map<string,string>").alias("metadata")))
    met = rows.drop("answer", "sources").join(made.select(F.col("query_id").alias("eval_id"), "answer", sources.alias("sources")), "eval_id", "left")
    _write(metrics.generation_scores(answering.evaluated(met), providers.overlap_scores), a.output)
    files.write_json_lines(metrics.summary(spark.read.parquet(a.output)), a.output.rstrip("/") + "_summary")


@verb
def build_report(spark, a):
    """Evaluated rows to an HTML page, and its failures and successes as CSV files beside."""
    rows = spark.read.parquet(a.input)
    Path(a.output).write_text(report.page(rows), encoding="utf-8")
    measured = metrics.answer_metrics(metrics.retrieval_metrics(rows))
    files.export_csv(metrics.failure_table(measured).select("eval_id", "question", "outcome", "answer"), a.output + ".failures.csv")
    files.export_csv(metrics.successes(measured).select("eval_id", "question", "answer"), a.output + ".successes.csv")


@verb
def embed_jsonl(spark, a):
    """Chunks to chunks with vectors."""
    rows = _read(spark, a.input, CHUNK)
    rows.withColumn("embedding", providers.embedding(F.col("text"))).write.mode("overwrite").parquet(a.output)


@verb
def embed(spark, a):
    """A parquet table of chunks to one with vectors."""
    embed_jsonl(spark, a)


@verb
def build_index(spark, a):
    """Embedded chunks to an index table; --append adds to one that is there."""
    rows = spark.read.parquet(a.input)
    files.append_index(rows, a.output) if a.append else files.write_index(rows.drop("embedding"), rows.select("chunk_id", "embedding"), a.output)


@verb
def merge_embedded(spark, a):
    """The embedded tables below a folder to one with ids of their own, and counters beside."""
    parts = {p: spark.read.parquet(p) for p in sorted(a.input.split(","))}
    merged = files.merge_embedded(parts)
    _write(merged, a.output, counters=pipeline.merge_counters(merged))


@verb
def parse_pdf(spark, a):
    """PDF events to records."""
    parsing.pdf_records(_read(spark, a.input, PDF_EVENT)).write.mode("overwrite").parquet(a.output)


@verb
def parse_hwp(spark, a):
    """HWP events to records."""
    parsing.hwp_records(_read(spark, a.input, HWP_EVENT)).write.mode("overwrite").parquet(a.output)


@verb
def clean_records(spark, a):
    """Records to texts under cleaned headings."""
    prechunk.clean(_read(spark, a.input, RECORD)).write.mode("overwrite").parquet(a.output)


@verb
def chunk_jsonl(spark, a):
    """Records to chunks, and a summary of their sizes beside."""
    made = records.chunks(_read(spark, a.input, RECORD), a.config.chunking.chunk_size, a.config.chunking.chunk_overlap, a.config.chunking.min_chunk_chars)
    told = made.withColumn("metadata", F.create_map(F.lit("file_name"), F.col("file_name")))
    _write(made, a.output, summary=splitters.chunk_summary(told))


def _slim(spark, a, made: list[tuple[DataFrame, Callable]]) -> None:
    done = [pipeline.run(events, machine, a.limit_files) for events, machine in made]
    whole = lambda name: reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), [d[name] for d in done])
    chunks = whole("chunks") if len(done) == 1 else pipeline.slim(whole("chunks").drop("source_id"), ["chunk_id"])
    _write(chunks, a.output, tables=whole("tables"), errors=whole("errors"), counters=whole("counters"))


@verb
def chunk_hwp_slim(spark, a):
    """HWP events of many files to slim chunks, raw tables, errors and counters."""
    _slim(spark, a, [(_read(spark, a.input, HWP_EVENT), parsing.hwp_records)])


@verb
def chunk_hwp_dir(spark, a):
    """HWP events of a directory to chunks, with a manifest of its files."""
    chunk_hwp_slim(spark, a)
    events = _read(spark, a.input, HWP_EVENT)
    files.write_json_lines(events.groupBy("file_name").agg(F.count(F.lit(1)).alias("events"), F.first("error", ignorenulls=True).alias("error"), pipeline.safe_stem(F.first("file_name")).alias("stem")), a.output.rstrip("/") + "_manifest")


@verb
def chunk_mixed_slim(spark, a):
    """HWP events (INPUT) and PDF events (--pdf) to slim chunks."""
    made = [(_read(spark, a.input, HWP_EVENT), parsing.hwp_records)] + ([(_read(spark, a.pdf, PDF_EVENT), parsing.pdf_records)] if a.pdf else [])
    _slim(spark, a, made)


@verb
def convert_embedding_input(spark, a):
    """Chunks, records and tables to one form for embedding."""
    rows = spark.read.parquet(a.input)
    pipeline.embedding_input(rows, [c for c in ("file_name", "pos", "chunk_id", "id") if c in rows.columns], a.doc_id).write.mode("overwrite").parquet(a.output)


@verb
def sample(spark, a):
    """Chunks sampled by quotas."""
    picked = sampling.by_quota(sampling.candidates(spark.read.parquet(a.input)), sampling.parse_quotas(a.quotas))
    picked.write.mode("overwrite").parquet(a.output)


@verb
def sampling_(spark, a):
    """Chunks sampled by quotas with the rules of sparse documents, and a report beside."""
    cands = sampling.candidates(spark.read.parquet(a.input))
    picked = sampling.by_document(cands, sampling.parse_quotas(a.quotas), a.least)
    _write(picked, a.output, summary=sampling.sampling_report(cands, picked))


@verb
def generate_questions(spark, a):
    """Chunks to questions for evaluation: prompts, and what the generator answers."""
    c = spark.read.parquet(a.input)
    m = F.coalesce("metadata", F.create_map().cast("map<string,string>"))
    rows = c.withColumns({"metadata": m, "doc": generation.doc_name(F.col("doc_id").cast("string"), m, F.lit("")), "ocr": generation.is_ocr(F.col("chunk_type"), m, F.col("text")), "path": F.lit("")})
    given = generation.inputs(rows)
    _write(generation.generated(given), a.output, inputs=given)


@verb
def rewrite_questions(spark, a):
    """Questions without a single answer rewritten, and counters beside."""
    made = generation.rewritten(spark.read.parquet(a.input))
    _write(made, a.output, counters=generation.rewrite_counts(made))


@verb
def ocr_export_rag(spark, a):
    """Read pages to chunks with their manifest; --strict fails on pages that were not curated."""
    units = spark.read.parquet(a.input)
    units = ocr_export.strict(units) if a.strict else units
    made = ocr_export.chunks(units)
    _write(made, a.output, manifest=ocr_export.manifest(units, made))


@verb
def extract_ocr_images(spark, a):
    """Images (path, content, width, height) to those large enough, each once, with their kind."""
    kept = files.distinct_images(spark.read.parquet(a.input))
    kept.withColumn("kind", files.image_kind(F.col("content"))).write.mode("overwrite").parquet(a.output)


@verb
def build_pred_structured(spark, a):
    """Read pages (id, text, items, lines) to fields, tables by section and footnotes."""
    pages = spark.read.parquet(a.input)
    ocr_fields.predicted(pages).join(ocr_fields.normalised_tables(pages), "id").write.mode("overwrite").parquet(a.output)


@verb
def eval_pred_structured(spark, a):
    """Truth and readings to evaluations, a batch table, a review queue and a summary."""
    made = ocr_eval.evaluated(spark.read.parquet(a.input), a.config.reading.threshold)
    made.write.mode("overwrite").parquet(a.output)
    kept = spark.read.parquet(a.output)
    files.write_json_lines(ocr_eval.batch_summary(kept), a.output.rstrip("/") + "_summary")
    files.write_json_lines(ocr_eval.review_queue(kept), a.output.rstrip("/") + "_review")
    files.write_csv(ocr_eval.batch_rows(kept), a.output.rstrip("/") + "_rows")


@verb
def view_chunks(spark, a):
    """A page to look through chunks."""
    Path(a.output).write_text(viewer.page(viewer.cards(spark.read.parquet(a.input)), a.name or "Chunks"), encoding="utf-8")


@verb
def index_metadata(spark, a):
    """The metadata of the first rows of an index as JSON."""
    rows = viewer.index_sample(files.load_index(spark, a.input), a.k).toJSON().collect()  # k rows
    Path(a.output).write_text(json.dumps([json.loads(r) for r in rows], ensure_ascii=False, indent=1), encoding="utf-8")


@verb
def run_pipeline(spark, a):
    """HWP events to an index: parse, chunk, embed, number."""
    done = pipeline.run(_read(spark, a.input, HWP_EVENT), parsing.hwp_records, a.limit_files)
    chunks = done["chunks"].withColumn("embedding", providers.embedding(F.col("text")))
    step = a.output.rstrip("/") + "_embedded"
    _write(chunks, step, counters=done["counters"], errors=done["errors"])
    rows = spark.read.parquet(step)
    files.write_index(rows.drop("embedding"), rows.select("chunk_id", "embedding"), a.output)


@verb
def run(spark, a):
    """A registered query over a directory of tables."""
    queries()[a.name](spark, a.input).write.mode("overwrite").parquet(a.output)


VERBS["sampling"] = VERBS.pop("sampling-")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description=__doc__, epilog="; ".join(f"{k}: {f.__doc__}" for k, f in VERBS.items()))
    p.add_argument("verb", choices=VERBS)
    p.add_argument("input")
    p.add_argument("output")
    p.add_argument("--size", type=int)
    p.add_argument("--overlap", type=int)
    p.add_argument("--config", type=config.load, default=config.Config())
    p.add_argument("--limit-files", type=int, default=0)
    p.add_argument("--least", type=int, default=0)
    for name in ("metadata", "quotas", "index", "name", "pdf", "doc-id"):
        p.add_argument(f"--{name}")
    p.add_argument("--append", action="store_true")
    p.add_argument("--strict", action="store_true")
    p.add_argument("-k", type=int, default=10)
    a = p.parse_args(argv)
    a.config.chunking.chunk_size, a.config.chunking.chunk_overlap = a.size or a.config.chunking.chunk_size, a.config.chunking.chunk_overlap if a.overlap is None else a.overlap
    VERBS[a.verb](SparkSession.builder.appName(f"gleanery {a.verb}").getOrCreate(), a)


if __name__ == "__main__":
    main()
