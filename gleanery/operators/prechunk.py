"""Cleaning of parsed records before they are chunked: headings that are none, and headings inside texts.

Records: file_name, pos (unique in a file), content_type, section_path (array), text.
"""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gleanery.functions import text as T
from gleanery.functions.islands import scan
from gleanery.functions.numbering import positions
from gleanery.operators.splitters import section
from gleanery.operators.structure import section_type
from gleanery.storage import shared_table

# Kinds of headings by how they begin, in this order.
KINDS = {
    "roman_major": r"^(?:[ⅠⅡⅢⅣⅤⅥⅦⅧⅨⅩ]+|I{1,3}|IV|V|VI{0,3}|IX|X)[.)]?\s+", "number_dot": r"^\d{1,2}(?:\.\d{1,2})*\.\s*", "number_paren": r"^\d{1,2}\)\s*", "korean_dot": r"^[가-힣]\.\s*",
    "korean_paren": r"^[가-힣]\)\s*", "circled_number": r"^[①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]\s*", "bullet_marker": r"^[□○◦ㅇㆍ\-]\s*",
}
# What makes a line a field, a form, an appendix, a sentence or a requirement.
FIELD = r"(발주자명|대표자|대표\s*자|성명|주소|전화|팩스|이메일|사업자등록|주민등록|생년월일|날인|서명|인감|담당자|신청인|업체명|회사명|기관명|소속|직위|연락처|작성자|제출자)"
PLACEHOLDER, APPENDIX, VALUE = r"(○{2,}|OOO|%|점|금\s*원)", "(?i)(붙임|별지|서식|양식|첨부)", r"[:：]\s*\S{2,}"
SENTENCE = r"(다|함|것|경우|여부|있는지|한다|하겠습니다|하여야\s*한다)[.)]?$"
NUMBERED_CUE = "(경우|경우에는|여부|있는지|란에|표기|기재|작성|제출|누설|위반|처벌|제기하지|않겠|않음|하여야|하도록|되도록|따라|의거|위한|대한|관한|발생|제시|명시|포함|기준으로|평가하|활용|첨부)"
SUBITEM_CUE = r"(공개하지|않는다|하여야|작성하여야|기재하여야|포함시켜야|유의하여|거부할 수|요청하지 않는 한|적용할 수|가능하다|필요|있음|없음|누설|위반|비밀|외부에 공개|자료 활용|제출된|발주기관이|발견될|입찰참가 제외|낙찰취소|계약해지|경우에는|법령|고시|지침|법률시행령|제\d+조|품질 확보|사업 완료|지출금액|위약금|기성대금)"
CONTINUED, LEGAL = r"^\s*[②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳]\s*", "(확정|변경|계약금액|계약기간|심의|시행령|법률|조정)"
REQUIREMENT = "(?i)(요구사항|Requirement|SFR|SER|DAR|DIR|SIR|PER|QUR|COR|PSR|PMR|MPR|MHR|ECR|CSR|SDR)"
CODE_COLON = r"\([A-Z]{2,5}\s*:\s*[A-Za-z][A-Za-z\s/.-]{2,}\)|[:：]\s*[A-Z]{2,5}\s*$"
INLINE_FIELD = (
    r"(사업\s*기간|사업\s*금액|사업\s*예산|소요\s*예산|계약\s*방법|입찰\s*방법|입찰\s*보증\s*금액|입찰보증금액|보증\s*금액|보\s*증\s*액|계약방법|입찰방식|입찰방법|제출\s*장소|제출장소|공고\s*및\s*접수기간|접수\s*기간|접수기간|"
    r"제안서\s*접수|제안서\s*심사|계약협상일시|계약협상|발주기관명|발주자명|대\s*표\s*자|주소|계좌|보험|기간|준공일|착수일|계약명|사업명|사\s*업\s*명|용역명|용\s*역\s*명|사업예산|금액|예산|전화|팩스|이메일)\s*[:：]"
)
INLINE_PAYLOAD = r"[:：]\s*[^()]{0,80}(?:\d{2,}|원|개월|일간|은행|계좌|대표자|소재지|착수|계약|제한경쟁|협상)"
COLON_PAYLOAD = r"[:：].{0,140}(?:원|개월|일간|은행|계좌|대표자|소재지|착수|계약|제한경쟁|협상|종합평가|등록|제출|점|%)"
LINKING = "(으로|하며|하여|통해|대한|위한|중심의|따른|되도록|하도록)"
TWO_NUMBERS = r"\d{1,2}\.\s+.+\d{1,2}\.\s+"
#: A kind is dominant at this share of a depth, or with two headings.
SHARE = 0.15


def one_line(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+", " "))


def kind(heading: Column) -> Column:
    """How a heading begins: one of KINDS, bare_title or empty."""
    h = one_line(heading)
    out = F.when(h == "", "empty").otherwise("bare_title")
    for name, pattern in reversed(KINDS.items()):
        out = F.when(h.rlike(pattern), name).otherwise(out)
    return out


class _Expr:
    """The rules over columns: patterns by rlike, lengths by length."""

    has = staticmethod(lambda c, p: c.rlike(p))
    size = staticmethod(F.length)
    one_of = staticmethod(lambda c, names: c.isin(names))
    kind = staticmethod(kind)
    one_line = staticmethod(one_line)


class _Plain:
    """The same rules over texts, for headings met inside a text."""

    @staticmethod
    def has(c, p):
        return bool(re.search(p, c))

    size = staticmethod(len)
    one_of = staticmethod(lambda c, names: c in names)

    @staticmethod
    def one_line(c):
        return re.sub(r"\s+", " ", c).strip()

    @staticmethod
    def kind(c):
        c = _Plain.one_line(c)
        return next((k for k, p in KINDS.items() if re.search(p, c)), "bare_title" if c else "empty")


def _rules(by, heading, path, body) -> list:
    """The conditions under each of which a heading is none; ``by`` gives them meaning over columns or over texts."""
    h, kd = by.one_line(heading), by.kind(heading)
    n, has = by.size(h), lambda p: by.has(h, p)
    both = lambda *xs: reduce(lambda a, b: a & b, xs)
    any_ = lambda *xs: reduce(lambda a, b: a | b, xs)
    not_ = lambda x: x == False  # noqa: E712, E731
    sub_kinds = ["number_paren", "korean_dot", "korean_paren"]
    sentence = any_(has(SENTENCE), has(SUBITEM_CUE))
    required = both(has(REQUIREMENT), not_(both(n > 45, any_(sentence, has(NUMBERED_CUE)))))
    colon, code, appendix = has("[:：]"), has(CODE_COLON), by.has(path, APPENDIX)
    dotted, sub = both(kd == "number_dot", not_(required)), both(by.one_of(kd, sub_kinds), not_(required))
    return [
        n == 0, both(n > 105, not_(required)), both(sub, n > 70),
        both(dotted, any_(both(n > 25, by.has(body, CONTINUED), has(LEGAL)), both(n > 30, sentence), n > 70, both(n > 35, has(NUMBERED_CUE)), has(TWO_NUMBERS))),
        both(by.one_of(kd, ["circled_number", "bullet_marker"]), n > 60, not_(required)),
        has(r"[:：]\s*$"), both(has(FIELD), not_(required)),
        both(colon, not_(required), not_(code), by.one_of(kd, ["number_dot", *sub_kinds, "circled_number"]), n > 25),
        both(has(PLACEHOLDER), any_(colon, appendix)), both(has(INLINE_FIELD), not_(required)),
        both(has(VALUE), kd != "roman_major", not_(code), any_(has(INLINE_FIELD), has(INLINE_PAYLOAD), has(COLON_PAYLOAD), has(PLACEHOLDER), has(FIELD))),
        both(n > 45, has(SENTENCE), not_(required)), both(sub, n > 30, any_(sentence, has(LINKING))),
        both(appendix, not_(required), any_(n > 60, has(FIELD), both(kd == "number_dot", n > 28, has(NUMBERED_CUE)))),
    ]


def is_noise(heading: Column, path: Column, body: Column) -> Column:
    """Whether a heading is none: a field, a value, a form's blank or a sentence.  ``path``: its headings, joined."""
    return reduce(lambda a, b: a | b, _rules(_Expr, heading, F.coalesce(path, F.lit("")), F.coalesce(body, F.lit(""))))


def _plain_noise(heading: str, path: str) -> bool:
    return any(_rules(_Plain, heading, path, ""))


def _items(path: str = "section_path") -> Column:
    empty = F.array().cast("array<string>")
    return F.filter(F.transform(F.coalesce(F.col(path), empty), lambda x: T.strip(F.coalesce(x, F.lit("")))), lambda x: x != "")


def nodes(records: DataFrame) -> DataFrame:
    """(file_name, depth, path, heading, kind, noise): each prefix of the section paths of a file once, judged by its first record."""
    base = records.where("file_name <> ''").select("file_name", "pos", F.coalesce("text", F.lit("")).alias("text"), _items().alias("items")).where("size(items) > 0")
    each = base.select("file_name", "pos", "text", F.explode(F.expr("transform(sequence(1, size(items)), d -> slice(items, 1, d))")).alias("path"))
    first = each.groupBy("file_name", "path").agg(F.min_by("text", "pos").alias("text"))
    heading, joined = F.element_at("path", -1), F.array_join("path", " > ")
    return first.select("file_name", F.size("path").alias("depth"), joined.alias("path"), heading.alias("heading"), kind(heading).alias("kind"), is_noise(heading, joined, F.col("text")).alias("noise"))


def dominant_kinds(nodes: DataFrame) -> DataFrame:
    """(file_name, depth, kinds): the kinds with two headings or SHARE of a depth, else the most frequent one."""
    counts = nodes.where("NOT noise").groupBy("file_name", "depth", "kind").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("file_name", "depth")  # at most nine kinds
    ranked = counts.withColumns({"all": F.sum("n").over(w), "most": F.max(F.struct("n", "kind")).over(w)["kind"]})
    kept = ranked.withColumn("good", (F.col("n") >= 2) | (F.col("n") / F.col("all") >= SHARE))
    lists = kept.groupBy("file_name", "depth").agg(F.array_sort(F.collect_list(F.when(F.col("good"), F.col("kind")))).alias("kinds"), F.first("most").alias("most"))
    return lists.select("file_name", "depth", F.when(F.size("kinds") > 0, F.col("kinds")).otherwise(F.array("most")).alias("kinds"))


def cleaned_paths(records: DataFrame, strict: bool = True) -> DataFrame:
    """(file_name, pos, kept, dropped): the headings of each record's path that are some, and those that are none.

    ``strict`` also drops headings whose kind is not dominant at their depth in the file.
    """
    allowed = dominant_kinds(nodes(records)).groupBy("file_name").agg(F.map_from_entries(F.collect_list(F.struct("depth", "kinds"))).alias("allowed"))  # a row per depth
    base = records.select("file_name", "pos", T.clean_block(F.coalesce("text", F.lit(""))).alias("text"), _items().alias("items")).join(allowed, "file_name", "left")

    def judged(x: Column, i: Column) -> Column:
        body = F.when(i == F.size("items") - 1, F.col("text")).otherwise("")
        bad = is_noise(x, F.array_join(F.slice("items", F.lit(1), i + 1), " > "), body)
        if strict:
            own = F.col("allowed")[i + 1]
            bad |= F.coalesce(~F.array_contains(own, kind(x)), F.lit(False))
        return F.struct(x.alias("heading"), bad.alias("bad"))

    marked = base.withColumn("j", F.transform("items", judged))
    part = lambda bad: F.transform(F.filter("j", lambda x: x["bad"] == bad), lambda x: x["heading"])
    return marked.select("file_name", "pos", part(False).alias("kept"), part(True).alias("dropped"), "allowed")


def _split_inline(text: str, base: list[str], allowed: dict[int, list[str]]) -> list[tuple[list[str], str]]:
    """The parts of a text under the headings inside it, whose kind says how deep they stand."""
    from gleanery.operators.splitters import _clean

    lines, path, held, out = text.splitlines(), list(base), [], []
    kinds = ["" if not (x := _clean(line.strip())) or len(x) > 110 or (k := _Plain.kind(x)) == "bullet_marker" else k for line in lines]
    filled = [i for i, line in enumerate(lines) if line.strip()]
    following = {i: kinds[j] for i, j in zip(filled, filled[1:])}

    def depth_of(k: str) -> int | None:
        d = len(path)
        if d > len(base):
            below, same = allowed.get(d + 1, ()), allowed.get(d, ())
            if k in below and k != _Plain.kind(path[-1]):
                return d + 1
            if k in same or k in below:
                return d if k in same else d + 1
        return next((x for x in range(len(base) + 1, max(allowed, default=len(base)) + 1) if k in allowed.get(x, ())), None)

    def flush() -> None:
        if body := _clean("\n".join(held)):
            out.append((list(path), body))
        held.clear()

    for i, line in enumerate(lines):
        k, title = kinds[i], line.strip()
        listed = k == "number_paren" and following.get(i) == "number_paren"
        at = depth_of(k) if k and not listed and not _plain_noise(title, " > ".join([*path, title])) else None
        if at is None or at <= len(base):
            held.append(line)
            continue
        flush()
        path = [*path[: max(len(base), at - 1)], title]
    flush()
    return out or [(list(base), text)]


def clean(records: DataFrame, strict: bool = True, cover: bool = True, inline: bool = True) -> DataFrame:
    """(file_name, pos, part, content_type, section_path, section_type, heading, text): texts under cleaned paths.

    A dropped heading comes back once per file and path, as a line before the first text
    under it; a text that goes on with ② and the like under a dropped heading takes the path
    last seen in its file if that is deeper; ``inline`` cuts texts at headings inside them.
    Tables and contents are left out, and covers unless ``cover``.  Null and blank texts
    without dropped headings give nothing.  What follows within a run of such continued texts
    takes the path of the last text before the run.
    """
    texts = records.where(F.col("content_type").isin(["section_text", *(["cover_text"] if cover else [])]))
    paths = cleaned_paths(records, strict)
    empty = F.array().cast("array<string>")
    cover_ = F.col("content_type") == "cover_text"
    met = texts.select("file_name", "pos", "content_type", T.clean_block(F.coalesce("text", F.lit(""))).alias("text"), F.element_at(F.concat(F.array(F.lit("")), _items()), -1).alias("own")).join(paths, ["file_name", "pos"])
    met = met.withColumns({"kept": F.when(cover_, empty).otherwise(F.col("kept")), "dropped": F.when(cover_, empty).otherwise(F.col("dropped"))})
    goes_on = ~cover_ & (F.col("text") != "") & F.col("text").rlike(CONTINUED) & F.array_contains("dropped", F.col("own"))

    @F.pandas_udf("array<struct<path: array<string>, text: string>>")
    def cut(texts: pd.Series, paths: pd.Series, allowed: pd.Series) -> pd.Series:
        done = []
        for text, path, kinds in zip(texts, paths, allowed, strict=True):
            kinds = {int(k): set(v) for k, v in (kinds.items() if isinstance(kinds, dict) else kinds or [])}
            got = _split_inline(text, list(path), kinds) if inline and kinds and text.strip() else [(list(path), text)]
            done.append([{"path": p, "text": t} for p, t in got])
        return pd.Series(done)

    met = shared_table(met.withColumn("goes_on", goes_on))
    # the path that a text leaves behind for a continued one
    left = F.when(~F.col("goes_on"), F.try_element_at(F.transform(F.filter(cut("text", "kept", F.coalesce("allowed", F.create_map().cast("map<int,array<string>>"))), lambda s: F.size(s["path"]) > 0), lambda s: s["path"]), F.lit(-1))) if inline else F.when(~F.col("goes_on") & (F.size("kept") > 0), F.col("kept"))
    left = F.when(~cover_, left)
    filled = scan(met.withColumn("leaves", left), ["file_name"], ["pos"], fill=["leaves"])
    deeper = F.col("goes_on") & (F.size("last_leaves") > F.size("kept")) & (F.slice("last_leaves", F.lit(1), F.greatest(F.size("kept"), F.lit(1))) == F.when(F.size("kept") > 0, F.col("kept")).otherwise(F.slice("last_leaves", 1, 1)))
    based = filled.withColumn("base", F.when(F.coalesce(deeper, F.lit(False)), F.col("last_leaves")).otherwise(F.col("kept")))
    based = shared_table(based.select("file_name", "pos", "content_type", "text", "base", "dropped", "allowed"))
    lost = based.select("file_name", "pos", "base", F.posexplode("dropped").alias("i", "heading"))
    once = lost.groupBy("file_name", "base", "heading").agg(F.min(F.struct("pos", "i")).alias("x")).select("file_name", "x.pos", "x.i", "heading")
    again = once.groupBy("file_name", "pos").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "heading"))), lambda x: x["heading"]), "\n").alias("lines"))
    whole = based.join(again, ["file_name", "pos"], "left").withColumn("text", F.when(F.col("lines").isNotNull(), T.clean_block(F.concat_ws("\n", "lines", "text"))).otherwise(F.col("text"))).where("text <> ''")
    plain = F.array(F.struct(F.col("base").alias("path"), F.col("text").alias("text")))
    pieces = F.when(cover_, plain).otherwise(cut("text", "base", F.coalesce("allowed", F.create_map().cast("map<int,array<string>>"))))
    out = whole.select("file_name", "pos", "content_type", F.posexplode(pieces).alias("i", "s")).withColumn("text", T.clean_block(F.col("s.text"))).where("text <> ''")
    path = F.col("s.path")
    return out.select("file_name", "pos", (F.col("i") + 1).alias("part"), "content_type", path.alias("section_path"), F.when(cover_, "cover").otherwise(section_type(F.array_join(path, " "))).alias("section_type"), F.coalesce(F.try_element_at(path, F.lit(-1)), F.lit("")).alias("heading"), "text")


def grouped(cleaned: DataFrame) -> DataFrame:
    """(file_name, pos, content_type, section_path, section_type, heading, n, text): consecutive texts of one path as one."""
    key = F.to_json(F.struct("file_name", "content_type", "section_path"))
    seen = scan(cleaned.withColumn("__k", key), [], ["file_name", "pos", "part"], lag=["__k"])
    islands = scan(seen.withColumn("__new", (~F.col("__k").eqNullSafe(F.col("prev___k"))).cast("int")).drop("prev___k"), [], ["file_name", "pos", "part"], total=["__new"])
    at = F.struct("pos", "part")
    text = T.clean_block(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "part", "text"))), lambda x: x["text"]), "\n\n"))
    first = lambda c: F.min_by(c, at).alias(c)
    return islands.groupBy("file_name", F.col("upto___new").alias("island")).agg(F.min("pos").alias("pos"), *[first(c) for c in ("content_type", "section_path", "section_type", "heading")], F.count(F.lit(1)).alias("n"), text.alias("text")).where("text <> ''").drop("island")


def text_chunks(groups: DataFrame, size: int = 1200, overlap: int = 150, least: int = 80, with_name: bool = True) -> DataFrame:
    """(chunk_id, file_name, chunk_type, part_index, section_path_text, section_type, heading, text): numbered chunks of grouped texts, with their context lines."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: section(t, size, overlap, least) if t else [])

    parts = groups.select("*", F.posexplode(cut("text")).alias("i", "body"))
    path = F.array_join("section_path", " > ")
    lines = [F.when(F.lit(with_name), F.concat(F.lit("문서명: "), F.col("file_name"))), F.when(path != "", F.concat(F.lit("섹션경로: "), path)), F.when(F.col("content_type") == "cover_text", "자료유형: 표지").otherwise("자료유형: 본문")]
    made = parts.withColumn("chunk", T.clean_block(F.concat(F.concat_ws("\n", *lines), F.lit("\n\n"), F.col("body"))))
    placed = positions(made, [], ["file_name", "pos", "i"], "n")
    return placed.select(F.concat(F.format_string("text_chunk_%08d_", "n"), T.short_hash(F.col("chunk"))).alias("chunk_id"), "file_name", F.col("content_type").alias("chunk_type"), (F.col("i") + 1).alias("part_index"), path.alias("section_path_text"), "section_type", "heading", F.col("chunk").alias("text"))
