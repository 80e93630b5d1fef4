"""One consistent form for texts that look the same.

DuckDB runs inside each Arrow partition; the whole mapping is one SQL expression, so the
same expression serves Spark and a plain DuckDB.  Removed or mapped are: invisible
characters, blanks other than the plain space, full- and half-width forms, and letters
of other scripts that are drawn like Latin ones; the result is in NFC.  Everything a
reader can see stays: spaces, tabs, line breaks, case, accents and punctuation.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that are drawn like the Latin letter below them.
GREEK = "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧνο"
GREEK_LATIN = "ABEZHIKMNOPTYXvo"
CYRILLIC = "АВЕКМНОРСТХУЅІЈԚԜаеорсухѕіјһԁԛԝӏ"
CYRILLIC_LATIN = "ABEKMHOPCTXYSIJQWaeopcyxsijhdqwl"
ARMENIAN = "օսհ"
ARMENIAN_LATIN = "ouh"
CHEROKEE = "ᎪᏴᏟᎠᎬᎻᎫᏦᏞᎷᏢᎡᏚᎢᏙᎳᏃ"
CHEROKEE_LATIN = "ABCDEHJKLMPRSTVWZ"
# Characters without a glyph that are not in the category of format characters,
# and format characters that do have one.
NO_GLYPH = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x180E), 0x180F, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
WITH_GLYPH = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD, *range(0x13430, 0x13440)}
# Characters that show as a blank without being in the category of spaces.
BLANK = [0x2800, 0x3164, 0xFFA0]
VISIBLE_CONTROLS = {0x09, 0x0A, 0x0B, 0x0C, 0x0D, 0x85}


@lru_cache(1)
def alike() -> dict[str, str]:
    """What each mapped character becomes."""
    letters = dict(zip(GREEK + CYRILLIC + ARMENIAN + CHEROKEE, GREEK_LATIN + CYRILLIC_LATIN + ARMENIAN_LATIN + CHEROKEE_LATIN, strict=True))
    out = {chr(c): " " for c in BLANK} | letters
    for c in range(0x80, 0x110000):
        s = chr(c)
        kind = unicodedata.category(s)
        if kind == "Zs":
            out[s] = " "
        elif kind not in ("Cn", "Cs", "Co"):
            made = unicodedata.decomposition(s).split()
            if made and made[0] in ("<wide>", "<narrow>") and s not in out:
                plain = chr(int(made[1], 16))
                out[s] = letters.get(plain, " " if plain in out or unicodedata.category(plain) == "Zs" else plain)
            elif made and made[0][0] != "<" and (base := unicodedata.normalize("NFD", s))[0] in letters:
                whole = unicodedata.normalize("NFC", letters[base[0]] + base[1:])
                if len(whole) == 1:
                    out[s] = whole
    return out


@lru_cache(1)
def invisible() -> list[int]:
    """Code points that show nothing and take no room."""
    out = {c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Cf", "Cc")} | set(NO_GLYPH)
    return sorted(out - WITH_GLYPH - VISIBLE_CONTROLS)


def _ranges(points: list[int]) -> str:
    """The inside of a regular expression's character class."""
    runs: list[list[int]] = []
    for p in sorted(points):
        if runs and p == runs[-1][1] + 1:
            runs[-1][1] = p
        else:
            runs.append([p, p])
    return "".join(f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


#: Texts of these characters only are in their final form already: no mapped ones, and none that NFC changes.
_PLAIN = "[^\\x{09}-\\x{0d}\\x{20}-\\x{7e}\\x{a1}-\\x{ac}\\x{ae}-\\x{2ff}\\x{ac00}-\\x{d7a3}]"


@lru_cache(8)
def canonical_sql(column: str) -> str:
    """The DuckDB expression that brings ``column`` to its one form (NULL stays NULL)."""
    table = alike()
    shown = f"regexp_replace({column}, '[{_ranges(invisible())}]', '', 'g')"
    mapped = f"translate({shown}, {_quoted(''.join(table))}, {_quoted(''.join(table.values()))})"
    return f"CASE WHEN regexp_matches({column}, '{_PLAIN}') THEN nfc_normalize({mapped}) ELSE {column} END"


#: True where a text has a character that can be seen.
VISIBLE_SQL = "regexp_matches({0}, '[^\\s\\x{{85}}\\x{{2028}}\\x{{2029}}]')"


def duck():
    """A DuckDB connection for one Arrow partition."""
    import duckdb

    return duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})


def sliced(batch: pa.RecordBatch, column: str, most: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about ``most`` bytes of ``column``; a longer single text is a piece of its own."""
    sizes = pa.compute.binary_length(batch.column(batch.schema.get_field_index(column)).cast(pa.large_string())).fill_null(0).to_numpy(zero_copy_only=False)
    start, room = 0, most
    for i, n in enumerate(sizes.tolist()):
        if n > room and i > start:
            yield batch.slice(start, i - start)
            start, room = i, most
        room -= n
    if start < batch.num_rows:
        yield batch.slice(start)


def in_duck(df: DataFrame, sql: str, schema: str, text: str) -> DataFrame:
    """Run ``sql`` over the view ``part`` in every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute  # noqa: F401  used by sliced()

        con = duck()
        try:
            for batch in batches:
                for piece in sliced(batch, text):
                    con.register("part", pa.Table.from_batches([piece]))
                    yield from con.sql(sql).to_arrow_table().to_batches()
                    con.unregister("part")
        finally:
            con.close()

    return df.mapInArrow(run, schema)


def records(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Documents and chunks as (rec_kind, rec_id, text)."""
    a = documents.select(F.lit("document").alias("rec_kind"), F.col("doc_id").cast("string").alias("rec_id"), "text")
    b = chunks.select(F.lit("chunk").alias("rec_kind"), F.col("chunk_id").cast("string").alias("rec_id"), "text")
    return a.unionByName(b)


def canonical_texts(items: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, text) with ``text`` in its one form; null stays null, a text of invisible characters becomes empty."""
    cols = items.select("rec_kind", "rec_id", "text")
    return in_duck(cols, f"SELECT rec_kind, rec_id, {canonical_sql('text')} AS text FROM part", "rec_kind string, rec_id string, text string", "text")


def _members(items: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, stored, form) of the records whose form occurs in several spellings.

    Only fingerprints (MD5 of the stored and of the one form) leave the partitions.  Forms
    that occur in one spelling only, exact copies in any number included, are dropped by a
    partially aggregated group-by before anything is joined; null texts and texts without
    a visible character are no records.
    """
    sql = f"""SELECT rec_kind, rec_id, md5(text) AS stored, md5(form) AS form
              FROM (SELECT rec_kind, rec_id, text, {canonical_sql('text')} AS form FROM part WHERE text IS NOT NULL)
              WHERE {VISIBLE_SQL.format('form')}"""
    from gleanery.storage import shared_table

    marks = shared_table(in_duck(items.select("rec_kind", "rec_id", "text"), sql, "rec_kind string, rec_id string, stored string, form string", "text"))
    several = marks.groupBy("rec_kind", "form").agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).where("lo <> hi").select("rec_kind", "form")
    return shared_table(marks.join(several, ["rec_kind", "form"]))


def look_alike_groups(items: DataFrame) -> DataFrame:
    """(rec_kind, rec_id, class_id, n_links): each record that looks like another spelling, with the smallest id of its group and the number of records that it looks like.

    One row per record, also where a group has millions of copies: counts of a group and
    of its spellings come from partially aggregated group-bys.
    """
    members = _members(items)
    spellings = members.groupBy("rec_kind", "form", "stored").agg(F.count(F.lit(1)).alias("own"), F.min("rec_id").alias("first"))
    groups = spellings.groupBy("rec_kind", "form").agg(F.sum("own").alias("n"), F.min("first").alias("class_id"))
    told = spellings.join(groups, ["rec_kind", "form"]).select("rec_kind", "stored", "class_id", (F.col("n") - F.col("own")).alias("n_links"))
    return members.select("rec_kind", "rec_id", "stored").join(told, ["rec_kind", "stored"]).select("rec_kind", "rec_id", "class_id", "n_links")


def look_alikes(items: DataFrame) -> DataFrame:
    """All pairs of records of one kind whose texts differ as strings and look the same, as defined; :func:`look_alike_groups` gives the groups."""
    members = _members(items)
    a = members.select("rec_kind", "form", F.col("rec_id").alias("id_a"), F.col("stored").alias("stored_a"))
    b = members.select("rec_kind", "form", F.col("rec_id").alias("id_b"), F.col("stored").alias("stored_b"))
    return a.join(b, ["rec_kind", "form"]).where("id_a < id_b AND stored_a <> stored_b").select("rec_kind", "id_a", "id_b")
