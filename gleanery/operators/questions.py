"""Filters of generated questions: each gives the reason to reject a question, or null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T

# Wordings that ask for a choice or a list.
OPEN_ENDED = [r"중\s*하나", r"하나(?:를|만)?\s*(?:적|쓰|골라|고르|말)", r"모두\s*나열", r"전부\s*나열", r"(?:세|3)\s*가지(?:를)?\s*적", r"몇\s*가지(?:를)?\s*적", r"(?:예시|항목).{0,12}중\s*(?:하나|일부)"]
# Ids of the pipeline that a question must not show.
INTERNAL_ID = [r"img_\d+", r"image_stem", r"ocr\s*id\s*[:=]", r"ocr_chunk_", r"slim_chunk_"]
# Topics of cover pages and forms.
FORM_TOPIC = "이메일|e-mail|e mail|연락처|전화번호|전화 번호|휴대폰|휴대전화|성명|담당자|사업책임자|작성 연월|작성연월|작성 연도|작성연도|연도 및 월|연월"
FORM_DATE = r"작성\s*(?:연월|연도)|(?:연도|년도)\s*(?:및|/)?\s*월|연월"
FORM_PLACE = r"표지|제안요청서\s*\(?\s*표지|목차|서약서|양식|표\s*상단"
FORM_FIELD = "연락|전화|이메일|성명|담당|연월|연도|작성"
REQUIREMENT = r"(?:SFR|PMR|DAR|ECR|SER|TER|MPR|PER|QMR|COR|SOR)-\s*\d+(?:-\d+)?"


def _any(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?iu)" + "|".join(f"(?:{p})" for p in patterns))


def open_ended(q: Column) -> Column:
    q = T.strip(F.coalesce(q, F.lit("")))
    return F.when(q == "", "empty_question").when(_any(q, OPEN_ENDED), "open_ended_wording")


def internal_id(q: Column) -> Column:
    q = T.strip(F.coalesce(q, F.lit("")))
    return F.when(q == "", "empty_question").when(_any(q, INTERNAL_ID), "ocr_internal_id")


def about_form(q: Column) -> Column:
    """Whether a question asks for what stands on cover pages and forms."""
    q = F.lower(T.strip(F.coalesce(q, F.lit(""))))
    return F.contains(q, F.lit("@")) | q.rlike(FORM_TOPIC) | q.rlike(FORM_DATE) | (q.rlike(FORM_PLACE) & q.rlike(FORM_FIELD))


def requirement_ids(q: Column) -> Column:
    """Requirement ids of a question, upper-case, each once, in order."""
    found = F.regexp_extract_all(F.upper(F.coalesce(q, F.lit(""))), F.lit(REQUIREMENT), F.lit(0))
    return F.array_distinct(F.transform(found, lambda x: F.regexp_replace(x, r"\s+", "")))


# Phrases, wordings and ids that tie a question to the document at hand.
FORBIDDEN = "총 사업비,총 계약,총액,총 사업,사업비,계약금,소요예산,입찰보증,사업기간,개발기간,용역기간,계약 기간,주관기관,발주기관,수요기관,이 사업,본 사업,해당 사업,본 제안,이 문서,본 문서,제안요청서,별지 제,요구사항 명칭,요구사항 번호".split(",")
SCOPED = r"(이|본|해당)\s*(사업|문서|제안|계약|용역|공고|과업|사업의)"
SCOPED_ID = r"\b(?:SFR|PMR|DAR|ECR|SER|TER|MPR|PER|QMR)-\s*\d+"
# Words of a question that are held against the corpus, and those that are not.
TOPIC_WORD = "[가-힣]{3,}|[A-Za-z]{4,}"
TOPIC_STOP = "무엇 어떻게 얼마 있는 있나 있습 되어 대한 관련 문서 확인 기재 명시 제공 해당 경우 여부 내용 항목 질문 답변 가능".split()


def unanswerable(question_type: Column) -> Column:
    return F.lower(T.strip(F.coalesce(question_type, F.lit("")))) == "unanswerable"


def topic_words(q: Column) -> Column:
    """The words of a question that may name a topic of the corpus, in order, with repetitions."""
    found = F.regexp_extract_all(F.coalesce(q, F.lit("")), F.lit(TOPIC_WORD), F.lit(0))
    return F.filter(F.transform(found, T.casefold), lambda w: ~w.isin(TOPIC_STOP))


def corpus_overlap(questions: DataFrame, chunks: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, n_words, n_known): the topic words of each question, and how many stand anywhere in its document's chunks.

    questions: key, query, doc; chunks: doc, text.  Questions meet the chunks of their
    document only; of a chunk just the numbers of the words that it has are shuffled.
    """
    asked = questions.select(key, "doc", topic_words(F.col("query")).alias("w"))
    texts = chunks.where("text <> ''").select("doc", T.casefold(F.col("text")).alias("t"))
    met = asked.where("size(w) > 0").join(texts, "doc").select(key, F.explode(F.expr("filter(sequence(0, size(w) - 1), i -> contains(t, w[i]))")).alias("i"))
    hits = met.groupBy(key, "i").agg(F.first(F.lit(1)).alias("x")).groupBy(key).agg(F.count(F.lit(1)).alias("n_known"))
    return asked.join(hits, key, "left").select(key, F.size("w").cast("bigint").alias("n_words"), F.coalesce("n_known", F.lit(0)).alias("n_known"))


def reject_reasons(questions: DataFrame, chunks: DataFrame, key: str = "eval_id") -> DataFrame:
    """(key, reason): why a question is no unanswerable one for its document; null if it may be.

    The first rule that applies: no question, a forbidden phrase, a wording or an id tied to
    the document, or topic words in its chunks (two, or all of at most three).
    questions: key, question, doc; chunks: doc, text.
    """
    q = T.strip(F.coalesce("question", F.lit("")))
    low = T.casefold(q)
    phrase = F.coalesce(*[F.when(F.contains(low, F.lit(p)), F.lit(f"forbidden_phrase:{p}")) for p in FORBIDDEN])
    plain = F.coalesce(F.when(q == "", "empty_question"), phrase, F.when(q.rlike(f"(?iU){SCOPED}"), "doc_scoped_wording"), F.when(q.rlike(f"(?iU){SCOPED_ID}"), "requirement_id_in_question"))
    first = questions.select(key, "question", "doc", plain.alias("plain"))
    met = corpus_overlap(first.where("plain IS NULL").select(key, F.col("question").alias("query"), "doc"), chunks, key)
    overlap = F.when((F.col("n_words") >= 2) & ((F.col("n_known") >= 2) | ((F.col("n_words") <= 3) & (F.col("n_known") == F.col("n_words")))), "corpus_keyword_overlap")
    return first.join(met, key, "left").select(key, F.coalesce("plain", overlap).alias("reason"))


def valid_gold(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """(eval_id, gold, verdict): gold ids that exist, in order with repetitions; verdicts drop unanswerable questions with gold and others without."""
    ids = questions.select("eval_id", "question_type", F.posexplode_outer("gold_chunk_ids").alias("i", "g"))
    seen = ids.join(chunks.select(F.col("chunk_id").alias("g"), F.lit(True).alias("ok")).distinct(), "g", "left")
    gold = seen.groupBy("eval_id", "question_type").agg(F.array_sort(F.collect_list(F.when(F.col("ok"), F.struct("i", "g")))).alias("x"))
    none = F.size("x") == 0
    blank = F.lower(T.strip(F.coalesce("question_type", F.lit("")))) == "unanswerable"
    return gold.select("eval_id", F.transform("x", lambda s: s["g"]).alias("gold"), F.when(blank & ~none, "unanswerable_with_gold").when(~blank & none, "answerable_without_gold").otherwise("keep").alias("verdict"))
