"""Records that are the same but for their outer form.

Outer form: the differences of :mod:`gleanery.llm.canonical`, white space, letter case
and punctuation; in lists of ``key: value`` fields also the order of the fields and how
they are separated, quoted or bracketed.  A list's fingerprint is the sum of its fields'
128-bit hashes, so it needs no order; equal fingerprints are then verified by comparing
the fields as multisets, without sorting them.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.llm.canonical import VISIBLE_SQL, canonical_sql, duck, sliced
from gleanery.storage import shared_table

#: Characters and words that the key of a field may have.
KEY_CHARS, KEY_WORDS = 40, 5
FIELD, PART = "\x1e", "\x1f"


def _patterns():
    import regex

    return {
        "drop": regex.compile(r"[\s\p{P}]+"),
        "field": regex.compile(r"[\s\"'“”‘’\-–•*○●▶※·]*([^:\n|;]{1,%d}?)[\"'”’\s]*:(?!//)[\s]*(.*?)[\s,;|]*" % KEY_CHARS, regex.DOTALL),
        "splits": [regex.compile(p) for p in (r"\s*[\n|;]+\s*", r"\s*\n+\s*", r"\s*\|\s*", r"\s*;\s*", r"\s*\t+\s*", r",\s+(?=[\"'])")],
    }


_P: dict = {}


def fields(form: str) -> list[tuple[str, str]] | None:
    """The normalised fields of a list of ``key: value`` fields, in its order; None for any other text."""
    if not _P:
        _P.update(_patterns())
    drop = _P["drop"]
    text = form.strip()
    pairs: list[tuple[str, str]] | None = None
    if len(text) > 1 and text[0] + text[-1] in ("{}", "[]", "()"):
        try:
            made = json.loads(text, object_pairs_hook=list)
            if isinstance(made, list) and len(made) > 1 and all(isinstance(p, tuple) and not isinstance(p[1], list) for p in made):
                pairs = [(k, v if isinstance(v, str) else json.dumps(v)) for k, v in made]
        except ValueError:
            pass
        text = text[1:-1].strip()
    if pairs is None:
        for split in _P["splits"]:
            parts = [p for p in split.split(text) if p.strip()]
            found = [m for p in parts if (m := _P["field"].fullmatch(p)) and len(m[1].split()) <= KEY_WORDS]
            if len(parts) > 1 and len(found) == len(parts):
                pairs = [(m[1], m[2]) for m in found]
                break
    if pairs is None:
        return None
    out = [(drop.sub("", k.lower()), drop.sub("", v.lower())) for k, v in pairs]
    return out if all(k for k, _ in out) else None


def fingerprint(pairs: list[tuple[str, str]]) -> str:
    """A commutative multiset hash: the sum of the fields' hashes, and their number."""
    import xxhash

    total = sum(xxhash.xxh3_128_intdigest(k + PART + v) for k, v in pairs) % (1 << 128)
    return f"f{total:032x}{len(pairs)}"


def marks(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, fp, body) of each record with a visible text; ``body`` is what equal records share."""
    form = canonical_sql("text")
    sql = f"""SELECT id, form, regexp_replace(lower(form), '[\\s\\x{{0b}}\\x{{85}}\\x{{2028}}\\x{{2029}}\\pP]+', '', 'g') AS plain,
              regexp_matches(form, ':[^:]*:') AS listed
              FROM (SELECT id, {form} AS form FROM part WHERE text IS NOT NULL AND id IS NOT NULL) WHERE {VISIBLE_SQL.format('form')}"""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401
        import xxhash

        con = duck()
        for batch in batches:
            for piece in sliced(batch, "text"):
                con.register("part", pa.Table.from_batches([piece]))
                done = con.sql(sql).to_arrow_table()
                con.unregister("part")
                prints, bodies = [], []
                for form_, plain, listed in zip(done["form"].to_pylist(), done["plain"].to_pylist(), done["listed"].to_pylist(), strict=True):
                    pairs = fields(form_) if listed else None
                    prints.append(fingerprint(pairs) if pairs else "t" + xxhash.xxh3_128_hexdigest(plain))
                    bodies.append(FIELD.join(k + PART + v for k, v in pairs) if pairs else plain)
                yield from pa.table({"id": done["id"], "fp": prints, "body": bodies}, pa.schema([("id", pa.string()), ("fp", pa.string()), ("body", pa.string())])).to_batches()
        con.close()

    return df.select(F.col(key).cast("string").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id string, fp string, body string")


def _same(pairs: DataFrame) -> DataFrame:
    """Adds ``same``: whether both bodies hold the same text, or the same fields in any order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps, x, y = (b.column(i).to_pylist() for i in (0, 3, 4))
            same = [p == q or (f[0] == "f" and Counter(p.split(FIELD)) == Counter(q.split(FIELD))) for f, p, q in zip(fps, x, y, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(4), pa.array(same, pa.bool_())], ["fp", "id_a", "id_b", "body", "same"])

    return pairs.select("fp", "id_a", "id_b", "body_a", "body").mapInArrow(run, "fp string, id_a string, id_b string, body string, same boolean")


def copies(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(id_a, id_b): each copy with the smallest id of its group; groups of one are left out.

    Null ids, null texts and texts without a visible character are no copies of anything.
    A group of any size: the smallest id comes from a partially aggregated group-by, and
    the members meet one row per group in a join that adaptive execution splits when one
    group is hot.  Rows of equal fingerprint that fail the verification are grouped anew
    by their exact content.
    """
    return _copies(shared_table(marks(df, key, text)))


def _copies(kept: DataFrame) -> DataFrame:
    groups = kept.groupBy("fp").agg(F.min("id").alias("id_a"), F.count(F.lit(1)).alias("n")).where("n > 1")
    first = groups.join(kept.select(F.col("id").alias("id_a"), F.col("body").alias("body_a")), "id_a").select("fp", "id_a", "body_a")
    pairs = kept.select("fp", F.col("id").alias("id_b"), "body").join(first, "fp").where("id_b <> id_a")
    checked = shared_table(_same(pairs).withColumn("body", F.when(F.col("same"), F.lit(None)).otherwise(F.col("body"))))
    apart = checked.where("NOT same").withColumn("exact", F.when(F.col("fp").startswith("f"), F.array_join(F.array_sort(F.split("body", FIELD)), FIELD)).otherwise(F.col("body")))
    smallest = apart.groupBy("fp", "exact").agg(F.min("id_b").alias("id_a"))
    again = apart.select("fp", "exact", "id_b").join(smallest, ["fp", "exact"]).where("id_a <> id_b").select("id_a", "id_b")
    return checked.where("same").select("id_a", "id_b").unionByName(again)


def collapsed(df: DataFrame, key: str = "chunk_id", text: str = "text") -> DataFrame:
    """(key, n_copies): one row per record with a visible text, under its smallest id, with the number of its copies."""
    kept = shared_table(marks(df, key, text))
    pairs = shared_table(_copies(kept))
    more = pairs.groupBy(F.col("id_a").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    alone = kept.select("id").join(pairs.select(F.col("id_b").alias("id")), "id", "left_anti").join(more, "id", "left")
    return alone.select(F.col("id").alias(key), (F.coalesce("n", F.lit(0)) + 1).alias("n_copies"))
