"""Seams for models: each has a deterministic stand-in that needs no network.

A provider works on batches inside an Arrow UDF; pass another callable of the same shape.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType, StructField, StructType, IntegerType

Embed = Callable[[list[str]], list[list[float]]]
Generate = Callable[[list[str]], list[str]]
Judge = Callable[[list[tuple[str, str, str]]], list[int]]


def hashed_vectors(dims: int = 64) -> Embed:
    """Vectors from SHA-256 bytes, cycled, scaled to [-1, 1]."""

    def embed(texts: list[str]) -> list[list[float]]:
        return [[d[i % 32] / 255 * 2 - 1 for i in range(dims)] for d in (hashlib.sha256(t.encode()).digest() for t in texts)]

    return embed


def first_sentences(n: int = 2) -> Generate:
    """The first sentences of the context part of a prompt."""

    def generate(prompts: list[str]) -> list[str]:
        return [" ".join(re.split(r"(?<=[.!?])\s+", p.split("\n\n", 1)[-1])[:n]) for p in prompts]

    return generate


def overlap_judge(rows: list[tuple[str, str, str]]) -> list[int]:
    """0 to 5 by the share of the expected answer's words that the answer has."""
    out = []
    for _question, expected, answer in rows:
        want = set(re.findall(r"\w+", (expected or "").lower()))
        out.append(round(5 * len(want & set(re.findall(r"\w+", (answer or "").lower()))) / len(want)) if want else 0)
    return out


def embedding(text: Column, provider: Embed | None = None, batch: int = 64, cap: int = 5000) -> Column:
    """The vector of each text, line breaks as spaces, cut at ``cap`` characters for the model; null texts as empty."""
    run = provider or hashed_vectors()

    @F.pandas_udf(ArrayType(FloatType()))
    def embed(texts: pd.Series) -> pd.Series:
        short = [(t or "").replace("\n", " ")[:cap] for t in texts]
        return pd.Series([v for i in range(0, len(short), batch) for v in run(short[i : i + batch])])

    return embed(text)


#: Characters to which a text is cut when a model says that it is too long, in turn.
LADDER = [5000, 4000, 3000, 2000, 1000]


def shortened(provider: Embed, too_long: type[Exception] = ValueError, ladder: list[int] | None = None) -> Embed:
    """A provider that cuts the texts of a failing batch further and further; a batch that fails at the last step fails."""

    def embed(texts: list[str]) -> list[list[float]]:
        steps = ladder or LADDER
        for n in steps:
            try:
                return provider([t[:n] for t in texts])
            except too_long:
                if n == steps[-1]:
                    raise
        return []

    return embed


def answer(prompt: Column, provider: Generate | None = None) -> Column:
    run = provider or first_sentences()

    @F.pandas_udf(StringType())
    def generate(prompts: pd.Series) -> pd.Series:
        return pd.Series(run([p or "" for p in prompts]))

    return generate(prompt)


def judged(question: Column, expected: Column, given: Column, provider: Judge | None = None) -> Column:
    """struct(score 0..5, error): a failing judge gives 0 and its error for the batch."""
    run = provider or overlap_judge

    @F.pandas_udf(StructType([StructField("score", IntegerType()), StructField("error", StringType())]))
    def judge(q: pd.Series, e: pd.Series, a: pd.Series) -> pd.DataFrame:
        try:
            scores = [min(5, max(0, int(s))) for s in run(list(zip(q, e, a, strict=True)))]
            return pd.DataFrame({"score": scores, "error": [None] * len(scores)})
        except Exception as x:
            return pd.DataFrame({"score": [0] * len(q), "error": [str(x)] * len(q)})

    return judge(question, expected, given)


# What an answer to a type of question should look like, in our own words.
HINTS = {"fact": "Give the one fact that is asked for.", "summary": "Sum up in a few points.", "comparison": "Set both sides against each other.", "follow_up": "Mind the earlier turns.", "requirement_detail": "Name the requirement and its details.", "unanswerable": "Say that the documents do not tell."}
COVER_HINT = "What is asked for stands on a cover page or a form."


def prompt(question: Column, context: Column, history: Column | None = None, question_type: Column | None = None, about_form: Column | None = None) -> Column:
    """Instructions with hints on the type of question and on forms, earlier turns, question, then the context after a blank line."""
    hints = F.create_map(*[x for k, v in HINTS.items() for x in (F.lit(k), F.lit(v))])
    told = [hints[F.coalesce(question_type, F.lit(""))]] if question_type is not None else []
    told += [F.when(about_form, COVER_HINT)] if about_form is not None else []
    head = F.concat_ws(" ", F.lit("Answer from the context only; say so where it has no answer."), *told)
    turns = F.nullif(history, F.lit("")) if history is not None else F.lit(None)
    return F.concat(F.concat_ws("\n", head, turns, F.concat(F.lit("Question: "), F.coalesce(question, F.lit("")))), F.lit("\n\n"), F.coalesce(context, F.lit("")))


def _words(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[가-힣a-z0-9]{2,}"), F.lit(0)))


def overlap_scores(question: Column, contexts: Column, given: Column) -> Column:
    """struct(f_score, r_score, s_score, judge_error): a judge without a model, of built-in expressions.

    Faithfulness is the share of the answer's words that the contexts have, relevance that
    of the question's words that the answer has, synthesis that of the contexts that share
    a word with the answer; shares of nothing are 0.
    """
    a, q, c = _words(given), _words(question), _words(F.array_join(contexts, " "))
    points = lambda part, whole: F.coalesce(F.floor(F.try_divide(part.cast("double"), whole) * 5 + 0.5), F.lit(0)).cast("int")
    used = F.size(F.filter(contexts, lambda t: F.size(F.array_intersect(_words(t), a)) > 0))
    return F.struct(
        points(F.size(F.array_intersect(a, c)), F.size(a)).alias("f_score"), points(F.size(F.array_intersect(q, a)), F.size(q)).alias("r_score"),
        points(used, F.size(contexts)).alias("s_score"), F.lit(None).cast("string").alias("judge_error"),
    )


Scores = Callable[[list[tuple[str, list[str], str]]], list[tuple[int, int, int]]]


def judged_generation(provider: Scores) -> Callable[[Column, Column, Column], Column]:
    """A judge for ``metrics.generation_scores`` from a model that scores batches of (question, contexts, answer); a failing batch has zeros and its error."""
    names = ["f_score", "r_score", "s_score"]

    @F.pandas_udf(StructType([*[StructField(n, IntegerType()) for n in names], StructField("judge_error", StringType())]))
    def judge(q: pd.Series, contexts: pd.Series, a: pd.Series) -> pd.DataFrame:
        try:
            scores = provider([(x, list(c), y) for x, c, y in zip(q, contexts, a, strict=True)])
            return pd.DataFrame(scores, columns=names).assign(judge_error=None)
        except Exception as x:
            return pd.DataFrame({n: [0] * len(q) for n in names}).assign(judge_error=str(x))

    return judge


def without_thoughts(c: Column) -> Column:
    """A generated text without its <think> blocks, an unclosed one included."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, r"(?is)<think>.*?</think>", ""), r"(?is)<think>.*$", ""))


def prefixed_embedding(text: Column, query: bool, provider: Embed | None = None) -> Column:
    """The unit vector of a text with the prefix that models for search expect before queries and passages; a zero vector stays zero."""
    run, prefix = provider or hashed_vectors(), "query: " if query else "passage: "

    def units(texts: list[str]) -> list[list[float]]:
        made = run([prefix + t for t in texts])
        return [[x / norm for x in v] if (norm := sum(x * x for x in v) ** 0.5) else v for v in made]

    return embedding(F.coalesce(text, F.lit("")), units)
