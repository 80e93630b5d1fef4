"""From chunks to evaluation questions: samples for the generator, its responses, filters and rewrites."""

from __future__ import annotations


from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery import providers
from gleanery.functions import text as T
from gleanery.functions.numbering import positions
from gleanery.operators import questions as Q

# Folder names that name no document.
GENERIC_FOLDERS = ["data", "v2", "raw", "processed", "outputs", "ocr_rag"]
# The category of cover pages and forms.
FORM_CATEGORY = "부록·양식"
# Wordings of rewritten questions; {0} is the item, {1} the requirement id.
COUNT_QUESTION, COUNT_ANSWER = "제약사항(COR) 고유번호는 해당 목록에 총 몇 개가 명시되어 있는가?", "개"
ONE_OF_QUESTION = ("{1} 산출정보에 '{0}'가 명시되어 있는가?", "해당 요구사항")
SOME_QUESTION = "문서 산출정보(예시)에 '{0}'이 명시되어 있는가?"
YES_ANSWER = "예 ({0})"
# Spellings of image ids, in the order in which they are replaced by a table.
IMAGE_NAMES = [r"OCR\s*이미지\s*\(\s*img_\d+\s*\)", r"이미지\s*\(\s*img_\d+\s*\)", r"이미지\s*\(\s*OCR\s*\)", r"이미지\s+img_\d+", r"이미지\s+청크\s*\(\s*img_\d+\s*\)"]
TABLE_WORD = "표"

ITEM = "struct<question: string, category: string, question_type: string, doc_id: string, expected_answer: string, ground_truth_keywords: array<string>, gold_chunk_ids: array<string>, difficulty: string, eval_focus: string>"


def is_ocr(chunk_type: Column, metadata: Column, text: Column) -> Column:
    """Whether a chunk was read from an image: by its type, its source, or the marks in its text."""
    kind = F.lower(F.coalesce(F.nullif(chunk_type, F.lit("")), metadata["chunk_type"], F.lit("")))
    marks = F.contains(F.coalesce(text, F.lit("")), F.lit("이미지:")) & F.contains(F.coalesce(text, F.lit("")), F.lit("OCR ID:"))
    return F.startswith(kind, F.lit("ocr_")) | (F.lower(F.coalesce(metadata["source"], F.lit(""))) == "ocr") | marks


def doc_name(doc_id: Column, metadata: Column, path: Column) -> Column:
    """The document of a chunk: its own id, its metadata, the folder of its file, or the file's name without _chunks."""
    filled = lambda c: F.nullif(c.cast("string"), F.lit(""))
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    stem = F.regexp_replace(F.regexp_replace(F.regexp_extract(path, r"([^/]+)$", 1), r"\.[^.]*$", ""), "_chunks$", "")
    by_path = F.when(F.coalesce(path, F.lit("")) == "", "document").when((folder != "") & ~F.lower(folder).isin(GENERIC_FOLDERS), folder).otherwise(stem)
    return F.coalesce(filled(doc_id), filled(metadata["doc_id"]), filled(metadata["file_name"]), filled(metadata["source_file"]), by_path)


def _strided(rows: DataFrame, wanted: DataFrame, doc: str) -> DataFrame:
    """The rows of each document at even distances; ``wanted``: (doc, slots).  ``rows`` has pos from 0 and n per document."""
    step = F.when(F.col("slots") > 1, (F.col("n") - 1) / (F.col("slots") - 1)).otherwise(F.lit(0.0))
    plan = wanted.where("slots > 0").select(doc, "slots", "n", F.explode(F.expr("sequence(0, least(slots, n) - 1)")).alias("i"))
    at = plan.select(doc, F.when(F.col("n") <= F.col("slots"), F.col("i")).otherwise(F.bround(F.col("i") * step)).cast("bigint").alias("pos")).distinct()
    return rows.join(at, [doc, "pos"], "left_semi")


def sampled(chunks: DataFrame, most: int, doc: str = "doc", order: list[str] | None = None, key: str = "chunk_id") -> DataFrame:
    """At most ``most`` chunks of each document at even distances, a third of them (at least one) read from images if there are any.

    ``chunks`` has ``ocr`` (boolean).  Documents of up to ``most`` chunks come whole.  Chunks
    of one id count once, the first in order.  Positions come from range partitions, so a
    document of any size needs no task of its own.
    """
    order = order or ["row_idx"]
    placed = positions(chunks, [doc, "ocr"], order, "pos", 0)
    sizes = placed.groupBy(doc).agg(F.count(F.lit(1)).alias("all"), F.count_if("ocr").alias("k"))
    slots = sizes.withColumn("ocr_slots", F.when(F.col("all") <= most, F.col("k")).when(F.col("k") == 0, 0).otherwise(F.least("k", F.lit(1 if most == 1 else max(1, most // 3)))))
    others = F.col("all") - F.col("k")
    slots = slots.withColumn("rest", F.when(F.col("all") <= most, others).when(others > 0, F.least(F.lit(most) - F.col("ocr_slots"), others)).otherwise(0))
    from_images = _strided(placed.where("ocr"), slots.select(doc, F.col("ocr_slots").alias("slots"), F.col("k").alias("n")), doc)
    plain = _strided(placed.where("NOT ocr"), slots.select(doc, F.col("rest").alias("slots"), others.alias("n")), doc)
    # a document of image chunks only takes the other slots from those that are left
    left = placed.where("ocr").join(from_images.select(doc, "pos"), [doc, "pos"], "left_anti")
    left = positions(left.drop("pos"), [doc], order, "pos", 0)
    only = slots.where((others == 0) & (F.col("all") > most)).select(doc, (F.lit(most) - F.col("ocr_slots")).alias("slots"), (F.col("k") - F.col("ocr_slots")).alias("n"))
    more = _strided(left, only, doc)
    made = from_images.unionByName(plain).unionByName(more).drop("pos")
    first = made.where(F.coalesce(F.col(key), F.lit("")) != "").groupBy(doc, key).agg(F.min(F.struct(*order)).alias("__first"))
    kept = made.join(first, [doc, key], "left")
    return kept.where(F.col("__first").isNull() | (F.struct(*order) == F.col("__first"))).drop("__first")


def inputs(chunks: DataFrame, most: int = 8, chars: int = 1200, per_doc: int = 3) -> DataFrame:
    """(doc, chunk_count, sampled_chunk_count, source_files, chunks, prompt): what a generator reads of each document.

    ``chunks``: chunk_id, row_idx, doc, chunk_type, metadata, text, ocr, path.  A document
    gives at most ``most`` chunks of ``chars`` characters each, the limit of the prompt.
    """
    counts = chunks.groupBy("doc").agg(F.count(F.lit(1)).alias("chunk_count"))
    one = F.struct(
        "row_idx", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), F.coalesce(F.nullif("chunk_type", F.lit("")), F.col("metadata")["chunk_type"], F.lit("")).alias("chunk_type"),
        F.when(F.col("ocr"), "ocr").otherwise(F.coalesce(F.nullif(F.col("metadata")["source"], F.lit("")), F.lit("hwp"))).alias("source"), F.left(T.strip(F.coalesce("text", F.lit(""))), F.lit(chars)).alias("text"),
    )
    packed = sampled(chunks, most).groupBy("doc").agg(F.array_sort(F.collect_list(one)).alias("chunks"), F.array_sort(F.collect_set(F.nullif("path", F.lit("")))).alias("source_files"), F.count_if("ocr").alias("from_images"))
    made = packed.join(counts, "doc").withColumn("sampled_chunk_count", F.size("chunks").cast("bigint"))
    return made.withColumn("prompt", prompt(F.col("doc"), F.to_json("chunks"), F.col("from_images"), per_doc)).drop("from_images")


def prompt(doc: Column, chunks: Column, from_images: Column, per_doc: int) -> Column:
    """What a generator is asked for one document; one question on images only where there are some and several questions."""
    image = F.when((from_images > 0) & F.lit(per_doc >= 2), "Exactly one question asks for what only an image shows (eval_focus ocr_image); name no internal ids.").otherwise("All questions have eval_focus text.")
    rules = (
        'Write JSON: {"questions": [{question, category, question_type, doc_id, expected_answer, ground_truth_keywords, gold_chunk_ids, difficulty, eval_focus}]}. '
        "One short answer per question, found in the named chunks; unanswerable questions have no gold chunks and a topic outside the document."
    )
    return F.concat_ws("\n\n", F.concat(F.lit(f"Write {per_doc} questions on document "), doc, F.lit(" from its chunks only.")), F.lit(rules), image, F.concat(F.lit("Chunks: "), chunks))


def parsed(responses: DataFrame, content: str = "content", keep: list[str] | None = None) -> DataFrame:
    """One row per question of each response: a JSON array, or an object with one under questions, items or data.

    Reading fails where a response is neither.  Items without a question are left out.
    """
    c = F.col(content)
    either = [F.from_json(c, f"struct<questions: array<{ITEM}>, items: array<{ITEM}>, data: array<{ITEM}>>")[k] for k in ("questions", "items", "data")]
    rows = F.when(F.ltrim(c).startswith("["), F.from_json(c, f"array<{ITEM}>")).otherwise(F.coalesce(*either))
    checked = F.when(rows.isNull(), F.raise_error(F.lit("a response is no array of questions")).cast(f"array<{ITEM}>")).otherwise(rows)
    items = responses.select(*(keep or []), F.posexplode(checked).alias("item_no", "q"))
    text = lambda k: T.strip(F.coalesce(F.col("q")[k], F.lit(""))).alias(k)
    empty = F.array().cast("array<string>")
    focus = F.lower(T.strip(F.coalesce(F.col("q")["eval_focus"], F.lit(""))))
    made = items.select(
        *(keep or []), "item_no", *[text(k) for k in ("question", "category", "question_type", "doc_id", "expected_answer", "difficulty")],
        F.coalesce(F.col("q")["ground_truth_keywords"], empty).alias("ground_truth_keywords"), F.coalesce(F.col("q")["gold_chunk_ids"], empty).alias("gold_chunk_ids"), F.when(focus.isin("text", "ocr_image"), focus).alias("eval_focus"),
    )
    return made.where("question <> ''")


def generated(given: DataFrame, generate: providers.Generate | None = None) -> DataFrame:
    """Parsed questions of each document's prompt; a generator without a model gives none."""
    run = generate or (lambda prompts: ['{"questions": []}'] * len(prompts))
    return parsed(given.select(F.col("doc"), providers.answer(F.col("prompt"), run).alias("content")), keep=["doc"])


def focus(eval_focus: Column, question_type: Column, has_images: Column, gold_from_images: Column) -> Column:
    """The focus of a question: as given, but no image where the context has none; by its gold chunks where none is given."""
    blank = F.coalesce(eval_focus, F.lit("")) == ""
    by_gold = F.when(Q.unanswerable(question_type), "text").when(has_images & gold_from_images, "ocr_image").otherwise("text")
    return F.when(blank, by_gold).when((eval_focus == "ocr_image") & ~has_images, "text").otherwise(eval_focus)


def category(question: Column, given: Column) -> Column:
    """The given category, or that of cover pages and forms if the question asks for what stands there."""
    asked = T.strip(F.coalesce(question, F.lit(""))) != ""
    return F.when(asked & Q.about_form(question), FORM_CATEGORY).otherwise(given)


def verdicts(questions: DataFrame, chunks: DataFrame, key: str = "eval_id") -> DataFrame:
    """(key, verdict, gold, eval_focus, category): what the filters do with each question.

    questions: key, question, question_type, doc, gold_chunk_ids, eval_focus, category;
    chunks: doc, chunk_id, text, ocr.  'keep' or the reason to drop; gold ids that the
    document's chunks lack go.
    """
    known = chunks.where("chunk_id <> ''").select("doc", F.col("chunk_id").alias("g"), "ocr").groupBy("doc", "g").agg(F.bool_or("ocr").alias("ocr"))
    each = questions.select(key, "doc", F.posexplode("gold_chunk_ids").alias("i", "g")).join(known, ["doc", "g"])
    gold = each.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "g"))), lambda x: x["g"]).alias("gold"), F.bool_or("ocr").alias("from_images"))
    images = chunks.groupBy("doc").agg(F.bool_or("ocr").alias("has_images"))
    overlap = Q.reject_reasons(questions.where(Q.unanswerable(F.col("question_type"))), chunks, key)
    rows = questions.join(gold, key, "left").join(images, "doc", "left").join(overlap, key, "left")
    none = F.size(F.coalesce("gold", F.array().cast("array<string>"))) == 0
    verdict = (
        F.when(Q.unanswerable(F.col("question_type")) & ~none, "unanswerable_with_gold").when(Q.unanswerable(F.col("question_type")), F.coalesce("reason", F.lit("keep"))).when(none, "answerable_without_gold")
        .otherwise(F.coalesce(Q.open_ended(F.col("question")), Q.internal_id(F.col("question")), F.lit("keep")))
    )
    own = focus(F.col("eval_focus"), F.col("question_type"), F.coalesce("has_images", F.lit(False)), F.coalesce("from_images", F.lit(False)))
    return rows.select(key, verdict.alias("verdict"), F.coalesce("gold", F.array().cast("array<string>")).alias("gold"), own.alias("eval_focus"), category(F.col("question"), F.col("category")).alias("category"))


# --- rewrites of questions that have no single answer, or that show internal ids


def first_item(expected: Column) -> Column:
    """The first of several expected items."""
    t = T.strip(F.coalesce(expected, F.lit("")))
    for sign in (";", " / ", " · ", " 및 ", ",", "，"):
        t = F.substring_index(t, sign, 1)
    return F.regexp_replace(F.regexp_replace(t, r"^[ .)]+", ""), r"[ .)]+$", "")


def constraint_ids(keywords: Column, expected: Column) -> Column:
    """How many distinct constraint ids the keywords have, or else the expected answer."""
    own = F.array_distinct(F.filter(keywords, lambda k: F.trim(k).rlike(r"(?i)^COR-\d+$")))
    told = F.filter(Q.requirement_ids(expected), lambda x: F.startswith(x, F.lit("COR-")))
    return F.when(F.size(own) > 0, F.size(own)).otherwise(F.size(told))


def without_image_ids(question: Column) -> Column:
    """The question with image ids as tables; as it was where ids are left or nothing is."""
    t = T.strip(F.coalesce(question, F.lit("")))
    made = t
    for p in IMAGE_NAMES:
        made = F.regexp_replace(made, f"(?iU){p}", TABLE_WORD)
    for p, by in ((r"(?i)img_\d+", ""), (r"(?U)\(\s*\)", ""), (r"(?U)\s+", " ")):
        made = F.regexp_replace(made, p, by)
    made = F.regexp_replace(F.regexp_replace(made, "^[ ,·]+", ""), "[ ,·]+$", "")
    usable = (made != "") & Q.internal_id(made).isNull()
    return F.when(Q.internal_id(t).isNotNull() & usable, made).otherwise(question)


def rewritten(rows: DataFrame) -> DataFrame:
    """The rows with single-answer questions instead of open-ended ones, without image ids, and with the form category.

    Adds open_rewritten, id_rewritten and category_rewritten.  Null lists count as empty.
    """
    empty = F.array().cast("array<string>")
    full = lambda c: F.filter(F.coalesce(F.col(c), empty), lambda k: k.isNotNull() & (T.strip(k) != ""))
    q, expected = T.strip(F.coalesce("question", F.lit(""))), T.strip(F.coalesce("expected_answer", F.lit("")))
    keywords, gold = full("ground_truth_keywords"), full("gold_chunk_ids")
    item, low = first_item(expected), T.casefold(q)
    open_ = Q.open_ended(q).isNotNull() & (q != "")
    req = F.element_at(F.concat(F.regexp_extract_all(q, F.lit(f"(?i)({Q.REQUIREMENT})"), F.lit(1)), F.array(F.lit(""))), 1)
    count = open_ & (F.contains(low, F.lit("모두 나열")) | F.contains(low, F.lit("전부 나열"))) & (F.contains(low, F.lit("cor")) | F.exists(keywords, lambda k: F.startswith(F.upper(k), F.lit("COR-"))))
    one = open_ & q.rlike(r"(?U)중\s*하나") & (item != "")
    some_item = F.coalesce(F.try_element_at(keywords, F.lit(1)), item)
    some = open_ & q.rlike(r"(?U)(?:세|3)\s*가지(?:를)?\s*적") & (some_item != "")
    n = F.when(constraint_ids(keywords, expected) > 0, constraint_ids(keywords, expected)).otherwise(4)
    fill = lambda wording, x, r=None: F.replace(F.replace(F.lit(wording), F.lit("{1}"), r if r is not None else F.lit("")), F.lit("{0}"), x)
    req_name = F.when(req != "", req).otherwise(ONE_OF_QUESTION[1])
    case = F.when(count, 1).when(one, 2).when(some, 3).otherwise(0)
    marked = rows.withColumns({"__case": case, "__n": n, "__item": item, "__some": some_item, "__req": req_name, "__kw": keywords, "__gold": gold})
    by = lambda a, b, c, d: F.when(F.col("__case") == 1, a).when(F.col("__case") == 2, b).when(F.col("__case") == 3, c).otherwise(d)
    item, some_item, req_name, keywords = F.col("__item"), F.col("__some"), F.col("__req"), F.col("__kw")
    made = marked.withColumns({
        "question": by(F.lit(COUNT_QUESTION), fill(ONE_OF_QUESTION[0], item, req_name), fill(SOME_QUESTION, some_item), F.col("question")),
        "question_type": F.when(F.col("__case") > 0, "fact").otherwise(F.col("question_type")),
        "expected_answer": by(F.concat(F.col("__n").cast("string"), F.lit(COUNT_ANSWER)), fill(YES_ANSWER, item), fill(YES_ANSWER, some_item), F.col("expected_answer")),
        "ground_truth_keywords": by(F.slice(keywords, 1, 5), F.array(F.replace(req_name, F.lit(" "), F.lit("")), item), F.array(some_item), F.col("ground_truth_keywords")),
        "gold_chunk_ids": F.when(F.col("__case") > 0, F.slice("__gold", 1, 1)).otherwise(F.col("gold_chunk_ids")),
        "difficulty": F.when(F.col("__case") > 0, "easy").otherwise(F.col("difficulty")),
    })
    cleaned = made.withColumn("__q", without_image_ids(F.col("question"))).withColumn("__c", category(F.col("__q"), F.col("category")))
    flags = {"open_rewritten": F.col("__case") > 0, "id_rewritten": ~F.col("__q").eqNullSafe(F.col("question")), "category_rewritten": ~F.col("__c").eqNullSafe(F.col("category"))}
    return cleaned.withColumns(flags).withColumns({"question": F.col("__q"), "category": F.col("__c")}).drop("__case", "__n", "__item", "__some", "__req", "__kw", "__gold", "__q", "__c")


def rewrite_counts(rows: DataFrame) -> DataFrame:
    """One row: n, and how many questions, ids and categories were rewritten."""
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if("open_rewritten").alias("open_rewritten"), F.count_if("id_rewritten").alias("id_rewritten"), F.count_if("category_rewritten").alias("category_rewritten"))


