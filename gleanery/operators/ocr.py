"""Comparison of read text and structure with the truth."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from gleanery.functions import text as T

THRESHOLD = 0.65


def character_errors(truth: Column, read: Column) -> Column:
    """Edit distance by the length of the truth (at least 1)."""
    a, b = T.inline(truth), T.inline(read)
    return F.levenshtein(a, b) / F.greatest(F.length(a), F.lit(1))


def similarity(truth: Column, read: Column) -> Column:
    """100 minus the edit distance in percent of the longer text; two empty texts are alike."""
    a, b = T.inline(truth), T.inline(read)
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(100.0)).otherwise(100.0 * (1 - F.levenshtein(a, b) / longest))


def _distance(a: list[str], b: list[str]) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


@F.pandas_udf(DoubleType())
def word_errors(truth: pd.Series, read: pd.Series) -> pd.Series:
    """Edit distance of words by the words of the truth (at least 1); null texts are empty."""
    return pd.Series([_distance(a := (x or "").split(), (y or "").split()) / max(1, len(a)) for x, y in zip(truth, read, strict=True)], dtype="float64")


def value_score(expected: str, read: str) -> float:
    """1 if the read value contains the expected one, else the ratio of matching blocks of both, compacted."""
    import re
    from difflib import SequenceMatcher

    a, b = (re.sub("[^0-9a-z가-힣]+", "", (x or "").lower()) for x in (expected, read))
    return 0.0 if not a else 1.0 if a in b else SequenceMatcher(None, a, b).ratio()


def match_values(truth: list[str], read: list[str], threshold: float = THRESHOLD) -> dict:
    """Greedy one-to-one matching of values, best scores first; repeated values count once."""
    import re

    def once(values):
        kept = {}
        for v in values:
            k = re.sub("[^0-9a-z가-힣]+", "", str(v).lower())
            if k:
                kept.setdefault(k, str(v).strip())
        return list(kept.values())

    t, r = once(truth), once(read)
    pairs = sorted(((s, i, j) for i, x in enumerate(t) for j, y in enumerate(r) if (s := value_score(x, y)) >= threshold), key=lambda p: -p[0])
    left, right = set(), set()
    for _, i, j in pairs:
        if i not in left and j not in right:
            left.add(i)
            right.add(j)
    n = len(left)
    precision = n / len(r) if r else float(not t)
    recall = n / len(t) if t else 1.0
    f1 = 2 * precision * recall / (precision + recall) if precision + recall else 0.0
    return {"matched": n, "gt_total": len(t), "pred_total": len(r), "precision": round(precision, 6), "recall": round(recall, 6), "f1": round(f1, 6), "missing": [x for i, x in enumerate(t) if i not in left], "extra": [y for j, y in enumerate(r) if j not in right]}


def field_metrics(pairs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Per (id, field): matched, totals, precision, recall, f1, missing, extra.

    ``pairs``: id, truth and read as map<string, array<string>>.  Fields of either side count;
    the full outer meeting of the two maps happens within a row.
    """
    fields = pairs.select("id", F.explode(F.array_union(F.map_keys(F.coalesce("truth", F.create_map().cast("map<string,array<string>>"))), F.map_keys(F.coalesce("read", F.create_map().cast("map<string,array<string>>"))))).alias("field"), "truth", "read")
    empty = F.array().cast("array<string>")
    values = fields.select("id", "field", F.coalesce(F.col("truth")[F.col("field")], empty).alias("truth"), F.coalesce(F.col("read")[F.col("field")], empty).alias("read"))
    names = ["matched", "gt_total", "pred_total", "precision", "recall", "f1", "missing", "extra"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [match_values(list(t), list(r), threshold) for t, r in zip(frame["truth"], frame["read"], strict=True)]
            yield pd.concat([frame[["id", "field"]].reset_index(drop=True), pd.DataFrame(out, columns=names)], axis=1)

    kind = pairs.schema["id"].dataType.simpleString()
    return values.mapInPandas(run, f"id {kind}, field string, matched bigint, gt_total bigint, pred_total bigint, precision double, recall double, f1 double, missing array<string>, extra array<string>")


def structure_summary(fields: DataFrame) -> DataFrame:
    """Per id: micro precision, recall and F1 over all values, macro F1 over fields."""
    m, g, p = F.sum("matched"), F.sum("gt_total"), F.sum("pred_total")
    precision = F.when(p > 0, m / p).otherwise(F.when(g == 0, 1.0).otherwise(0.0))
    recall = F.when(g > 0, m / g).otherwise(1.0)
    f1 = F.when(precision + recall > 0, 2 * precision * recall / (precision + recall)).otherwise(0.0)
    r6 = lambda c: F.round(c, 6)
    return fields.groupBy("id").agg(m.alias("matched"), g.alias("gt_total"), p.alias("pred_total"), r6(precision).alias("micro_precision"), r6(recall).alias("micro_recall"), r6(f1).alias("micro_f1"), r6(F.avg("f1")).alias("macro_f1"))


def kept_lines(lines: Column, least: float = 0.5) -> Column:
    """Texts of read lines: those without or with enough confidence, blanks single, each once."""
    sure = F.filter(lines, lambda x: x["score"].isNull() | (x["score"] >= least))
    return F.array_distinct(F.filter(F.transform(sure, lambda x: T.inline(x["text"])), lambda t: t != ""))


def review_reasons(status: Column, recall: Column, missing: Column) -> Column:
    """Why a read page needs review: its status, a low recall, missing required fields."""
    return F.array_compact(F.array(F.when(F.coalesce(status, F.lit("missing")) != "ok", F.concat(F.lit("status:"), F.coalesce(status, F.lit("missing")))), F.when(recall < 0.8, "low_micro_recall"), F.when(F.size(missing) > 0, F.concat(F.lit("missing:"), F.array_join(missing, ",")))))
