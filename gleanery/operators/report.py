"""HTML pages over small aggregates."""

from __future__ import annotations

import html

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.operators import metrics


def percent(c: Column) -> Column:
    """A share as percent with one digit; null as a dash."""
    return F.when(c.isNull(), "–").otherwise(F.format_string("%.1f%%", F.bround(c * 100, 1)))


def whole_percent(c: Column) -> Column:
    """A share as whole percent, halves to the even one; null as a dash."""
    return F.when(c.isNull(), "-").otherwise(F.format_string("%d%%", F.bround(c * 100).cast("bigint")))


def two_digits(c: Column) -> Column:
    return F.when(c.isNull(), "-").otherwise(F.format_string("%.2f", c.cast("double")))


def seconds(ms: Column) -> Column:
    """Milliseconds as seconds with two digits."""
    return F.when(ms.isNull(), "-").otherwise(F.concat(two_digits(ms / 1000), F.lit("초")))


def mark(c: Column) -> Column:
    """A success as a check mark, a failure as a cross; null as a dash."""
    return F.when(c.isNull(), "-").when(c, "✓").otherwise("✗")


def feedback(rows: DataFrame, key: str = "eval_id") -> DataFrame:
    """(key, name, score): each score of a row between 0 and 1, as tracing tools take them; points of 5 are divided, missing ones left out."""
    points = {c: F.col(c).cast("double") / 5 for c in ("f_score", "r_score", "s_score", "correctness_score") if c in rows.columns}
    shares = {c: F.col(c).cast("double") for c in metrics.RETRIEVAL if c in rows.columns}
    flags = {c: F.col(c).cast("int").cast("double") for c in ("task_success", "wrong_refusal", "appropriate_refusal") if c in rows.columns}
    each = F.array(*[F.struct(F.lit(n).alias("name"), v.alias("score")) for n, v in (points | shares | flags).items()])
    return rows.select(key, F.explode(each).alias("x")).select(key, "x.name", "x.score").where("score IS NOT NULL")


def search_blob(c: list[Column], metadata: Column) -> Column:
    """Lower-case text that a viewer searches."""
    return F.lower(F.concat_ws(" ", *c, F.to_json(metadata)))


def preview(text: Column, n: int = 260) -> Column:
    """The first characters of a text on one line, as a viewer shows them."""
    flat = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(flat) > n, F.concat(F.left(flat, F.lit(n)), F.lit("…"))).otherwise(flat)


def table_html(df: DataFrame, title: str, most: int = 200) -> str:
    """A table of at most ``most`` rows: for aggregates and reports of top rows."""
    rows = df.limit(most).collect()
    head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
    body = "".join("<tr>" + "".join(f"<td>{html.escape('' if v is None else str(v))}</td>" for v in r) + "</tr>" for r in rows)
    return f"<h2>{html.escape(title)}</h2><table><tr>{head}</tr>{body}</table>"


def page(rows: DataFrame, top: int = 50) -> str:
    """The evaluation report: outcomes, means by level, failure kinds and the gravest failures."""
    measured = metrics.answer_metrics(metrics.retrieval_metrics(rows))
    parts = [
        table_html(metrics.outcomes(measured), "Outcomes"), table_html(metrics.report(measured).orderBy("level", "question_type", "eval_focus"), "Means"),
        table_html(metrics.failure_counts(measured).orderBy(F.desc("n"), "label"), "Failure kinds"), table_html(metrics.failures(measured, top).select("eval_id", "kind", "question", preview(F.col("answer")).alias("answer")), "Failures", top),
    ]
    return "<!doctype html><meta charset='utf-8'><title>Evaluation</title>" + "".join(parts)
