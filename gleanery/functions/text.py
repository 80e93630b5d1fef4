"""Text expressions: Column in, Column out.

All are built-in expressions except :func:`nfkc`, which Spark lacks; it sends only texts
with unusual characters through an Arrow UDF.  Null in, null out, unless said otherwise.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# What a search token may be, tried in this order.
TOKEN = r"[A-Za-z]{2,}[-_/]?\d{1,5}|\d{1,3}(?:,\d{3})+(?:원|천원|만원|억원)?|\d+(?:\.\d+)+(?:년|월|일|%)?|[가-힣A-Za-z0-9]+(?:[-_/][가-힣A-Za-z0-9]+)*"
CONTROLS = r"[\x{00}-\x{08}\x{0b}\x{0c}\x{0e}-\x{1f}]+"


@F.pandas_udf(StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    import unicodedata

    return texts.map(lambda t: t if t is None else unicodedata.normalize("NFKC", t))


def nfkc(c: Column) -> Column:
    """Compatibility composition; texts of ASCII and Hangul syllables only are in that form already."""
    plain = c.rlike("^[\\x{00}-\\x{7f}가-힣]*$")
    return F.coalesce(_nfkc(F.when(~plain, c)), c)


def casefold(c: Column) -> Column:
    """Lower case with ß as ss."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def strip(c: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)^\s+", ""), r"(?U)\s+$", "")


def normalised(c: Column) -> Column:
    """NUL to space, runs of blanks to one, three and more line breaks to two, stripped."""
    c = F.regexp_replace(c, r"\x{00}", " ")
    c = F.regexp_replace(c, r"[ \t]+", " ")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def clean_block(c: Column) -> Column:
    """A text block: no-break spaces, controls, trailing blanks, runs of line breaks and of blanks."""
    c = F.regexp_replace(c, " ", " ")
    c = F.regexp_replace(c, CONTROLS, " ")
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    c = F.regexp_replace(c, r"\n{3,}", "\n\n")
    return strip(F.regexp_replace(c, r"[ \t]{2,}", " "))


def inline(c: Column) -> Column:
    """One line: controls and white space of any kind to single spaces."""
    c = F.regexp_replace(F.coalesce(c, F.lit("")), " ", " ")
    return strip(F.regexp_replace(F.regexp_replace(c, CONTROLS, " "), r"(?U)\s+", " "))


def compact(c: Column) -> Column:
    """Without white space, case-folded."""
    return casefold(F.regexp_replace(c, r"(?U)\s+", ""))


def relaxed(c: Column) -> Column:
    """Lower-case Latin letters, digits and Hangul only."""
    return F.regexp_replace(F.lower(c), "[^0-9a-z가-힣]+", "")


def answer_key(c: Column) -> Column:
    """Case-folded without white space, punctuation and underscores; null becomes empty."""
    return F.regexp_replace(casefold(F.coalesce(c, F.lit(""))), r"(?U)[\s\W_]+", "")


def doc_key(c: Column) -> Column:
    """The key that document names are compared by."""
    return casefold(F.regexp_replace(nfkc(strip(c)), r"(?U)\s+", " "))


def tokens(c: Column) -> Column:
    """Search tokens in order; a token with inner separators is followed by its compact form."""
    found = F.regexp_extract_all(casefold(nfkc(c)), F.lit(TOKEN), F.lit(0))

    def both(t: Column) -> Column:
        short = F.translate(t, "-_/,.", "")  # a token has no white space
        return F.when((short != "") & (short != t), F.array(t, short)).otherwise(F.array(t))

    return F.flatten(F.transform(found, both))


def short_hash(c: Column, n: int = 10) -> Column:
    """The first ``n`` hexadecimal digits of SHA-1."""
    return F.substring(F.sha1(c), 1, n)


def mock_embedding(c: Column, dims: int = 1536) -> Column:
    """A deterministic vector: SHA-256 bytes, cycled, scaled to [-1, 1]."""
    digest = F.sha2(c, 256)
    byte = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
    return F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda i: byte(i) / 255 * 2 - 1)


def without_tags(c: Column) -> Column:
    """HTML to text: line breaks kept, tags dropped, common entities resolved, blanks single."""
    c = F.regexp_replace(c, r"(?i)<br\s*/?>", "\n")
    c = F.regexp_replace(c, r"<[^>]+>", " ")
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(sign))
    return strip(F.regexp_replace(c, r"[ \t]+", " "))


# Durations in Korean notation.
DURATION = r"\d+\s*(?:개월|년|월|주|일)(?:간)?"


def last_duration(c: Column) -> Column:
    """The last duration named in a text; days are skipped where a full date is present."""
    dated = c.rlike(r"\d{4}\s*[.년-]\s*\d{1,2}\s*[.월-]\s*\d{1,2}")
    found = F.regexp_extract_all(c, F.lit(DURATION), F.lit(0))
    kept = F.filter(found, lambda t: ~(dated & t.rlike("일")))
    return F.try_element_at(kept, F.lit(-1))
