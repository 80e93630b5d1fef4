"""Defective pairs of prompt and response, with the type of the defect.

Openings of responses, and their sentences with a word of inability, are clustered by
MinHash over their characters, figures and the prompt's own words masked; each link is
verified by the Jaccard similarity of the shingle sets.  A cluster that recurs across
unrelated prompts is a template, and if its members mostly say an inability, it reveals
refusals.  Wordings too rare to recur are held against the templates: their shingles'
odds, learned from template sentences and all other sentences, decide.  Copies, languages
and terminations are checked on the pair itself and on counts over all responses: how
often a response's last words end a response, and how often they stand further inside.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.storage import shared_table

#: MinHash: hashes and rows per band; character shingles and the similarity of one cluster.
HASHES, ROWS, SHINGLE, SIMILAR = 32, 2, 3, 0.5
#: Openings of a band that one task compares with as many others.
BLOCK = 256
#: Prompt kinds over which a template recurs, the most that one kind may hold, rows with a word of inability.
KINDS, MOST, UNABLE = 3, 0.6, 0.5
#: Share of a template's occurrences in responses whose other sentences say an inability too or only surround it.
ALONE = 0.6
#: A cluster has one wording if this part of its sentences is shared by so many of them.
CORE, SHARED = 0.5, 0.8
#: What is added to the shares of a shingle, and the mean log odds beyond which a rare sentence, or its end of so many characters, is worded like a template.
ROUNDED, LIKE, LIKE_END, END = 0.01, -0.5, 0.5, 20
#: Share of its occurrences with which a word pair ends a response, where such an end is sound.
ENDS = 0.15

# Words of inability or absence, by language.
INABILITY = re.compile(
    r"없(?:습|어|네|다|음|는|으)|않|못|불가|어렵|삼가|모르|알지|권한이|미안|죄송|양해"
    r"|\b(?:not|no|nothing|none|unable|cannot|can't|couldn't|don't|doesn't|isn't|sorry|impossible)\b"
    r"|\b(?:ne|n'|pas|aucun|aucune|impossible|désolé|sans)\b|n'|\b(?:nicht|kein|keine|leider)\b|\bno puedo\b|できません|ありません|无法|没有",
    re.I,
)
#: A plain no before a sentence of its own, which says no inability.
NO_THEN = re.compile(r"^(?:No|Non)\s+(?=[A-ZÀ-Ý])")
# Greetings, apologies and offers around a refusal.
GREETING = re.compile(r"^(?:안녕하세요|검토 결과|죄송합니다|죄송하지만|미안합니다|감사합니다|hello|hi|bonjour|sorry|thank you|merci)?\W*$", re.I)
FILLER = re.compile(
    r"다른 질문|문의해 주|다시 확인해|도움이 되지 못해|양해 (?:바랍|부탁)|자료를 (?:올려|보내|공유)|please (?:contact|check|consult|ask|provide|upload)|could you (?:share|provide|upload)|another (?:file|question)|let me know|veuillez|n'hésitez|pourriez-vous",
    re.I,
)
# Responses without content.
PLACEHOLDER = re.compile(r"^(?:n/?a|null|none|nil|nan|undefined|tbd|todo|empty|no answer|없음|해당 ?없음|미정|답변 ?없음|무응답|-+|\.+|…+|sans objet|néant|s\.?o\.?)$", re.I)
LABEL = re.compile(r"^(?:(?:답변?|정답|응답|결과|answer|response|réponse|output|result|a|질문|question)\s*[:：.]\s*)+", re.I)
MARKUP = re.compile(r"<[^<>]{0,200}>|```\w*|&nbsp;|\[\s*\]|\{\s*\}|[\"'“”‘’`*_#>|~\-–—=+•·.…:：,;()\[\]{}!?/\\]")
# Words around a prompt that is only given back.
WRAPPER = {
    *"질문 질문은 질문하신 문의하신 내용은 내용 다음과 같습니다 같은 대한 답변입니다 답변 답변은 답 대해 관해 에 에 대해 답변드립니다 궁금하신 물어보신 사항은 요청하신 물으신 여쭤보신 하셨습니다 문의 것은 것입니다 입니다 라는 라고".split(),
    *"question answer you asked ask asking asks your the is was about following here as follows regarding response to a q this that".split(),
    *"question réponse la votre est voici à vous avez demandé demandez demandiez posée posez concernant suivante demande r".split(),
}
# A prompt that asks for a language.
ASKED = re.compile(r"영어|영문|국문|한국어|한글|프랑스어|불어|독일어|독어|스페인어|일본어|일어|중국어|한자|번역|원문|\b(?:english|french|german|spanish|korean|japanese|chinese|translat\w*|anglais|français|allemand|espagnol|coréen|japonais|chinois|tradui\w*)\b", re.I)
# Common words of languages in Latin script.
COMMON = {
    "en": "the of is are and to in for a an by be on with must at or not shall will may yes no up from after before this that it as than each per all within until their has have its who what when where how which does do people months days years".split(),
    "fr": "le la les des du de et est dans une un pour sur au aux sont par à en il elle ce cette qui que quel quelle où se ne pas plus selon après avant avec sans être a ont devra doit sera jours mois oui non chaque combien".split(),
    "de": "der die das ist und werden wird nicht den dem des von mit ein eine einer muss sind zu für auf im nach bei alle je erst ab tage monate durch als oder spätestens".split(),
    "es": "el los las del se y para por una un con que es son al hasta desde tras como más sus meses días doce años su no sí incluye admiten debe cada entrega dura".split(),
    "it": "il lo gli della di che per con non una sono dal alla entro giorni mesi".split(),
    "pt": "os das dos uma com não para são pelo até dias meses prazo".split(),
}
_COMMON = {k: set(v) for k, v in COMMON.items()}


def language(text: str) -> str:
    """ko, ja, zh, ru, a language in Latin script, 'latin' where that is unsure, or '' for names and figures only."""
    hangul = len(re.findall(r"[가-힣ᄀ-ᇿ]", text))
    kana = len(re.findall(r"[ぁ-ヺー]", text))
    han = len(re.findall(r"[㐀-鿿]", text))
    cyrillic = len(re.findall(r"[Ѐ-ӿ]", text))
    latin = len(re.findall(r"[A-Za-zÀ-ÿ]", text))
    if kana and kana + han > hangul:
        return "ja"
    if han > hangul and han >= 2:
        return "zh"
    if hangul and hangul * 4 >= latin:
        return "ko"
    if cyrillic > latin + hangul:
        return "ru"
    words = re.findall(r"(?<![\w.])[A-Za-zÀ-ÿ]+(?:'[A-Za-zÀ-ÿ]+)?(?![\w])", re.sub(r"\w*\d\w*", " ", text))
    lower = [w.lower() for w in words]
    parts = [p for w in lower for p in w.split("'")]
    scores = {k: sum(p in v for p in parts) for k, v in _COMMON.items()}
    marks = "".join(lower)
    scores["fr"] += 2 * len(re.findall(r"[éèêçàûœ]", marks)) // 3
    scores["de"] += len(re.findall(r"[äöüß]", marks))
    scores["es"] += len(re.findall(r"[ñ¿¡]|[áíóú]", marks))
    best = max(scores, key=lambda k: scores[k])
    if scores[best] > 0 and (scores[best] >= 2 or len(parts) <= 6) and sum(v == scores[best] for v in scores.values()) == 1:
        return best
    plain = [w for w in words if w[0].islower() and len(w) > 1]
    return "latin" if len(plain) >= 2 else ""


def masked(text: str) -> str:
    """Lower case, figures as #, white space single."""
    return re.sub(r"\s+", " ", re.sub(r"\d[\d.,:/]*", "#", text.lower())).strip()


def sentences(text: str) -> list[str]:
    """Sentences and lines."""
    return [s for s in (p.strip() for p in re.split(r"(?<=[.!?。])(?<!\d\.)\s+|\n+", text)) if s]


# Words before what a sentence says.
LEAD = re.compile(r"^(?:검토 결과|죄송하지만|미안하지만|unfortunately|malheureusement|désolé|(?:i'm |i am )?sorry)\W+(?:but )?", re.I)


def starred(question: str, sentence: str) -> str:
    """The sentence with the prompt's words, also with a Korean ending of up to two letters, as *."""
    have = set(_words(question))
    out: list[str] = []
    for token in sentence.split():
        w = "".join(_words(token))
        known = w in have or re.search("[가-힣]", w) and any(w[: len(w) - n] in have for n in (1, 2) if len(w) - n > 1)
        if not w or not known:
            out.append(token)
        elif out[-1:] != ["*"]:
            out.append("*")
    return " ".join(out)


def prompt_kind(question: str) -> str:
    """What a prompt asks, without its subject: its last words in Korean, its first words otherwise."""
    words = masked(re.sub(r"[?？!.]+", " ", question)).split()
    return " ".join(words[-2:] if re.search(r"[가-힣]", question) else words[:2])


_TR: list[dict] = []


def _clean(text: str | None) -> str:
    from gleanery.llm.canonical import alike, invisible

    if not _TR:
        _TR.append({ord(k): v for k, v in alike().items()} | dict.fromkeys(invisible()))
    return (text or "").translate(_TR[0])


def is_empty(answer: str) -> bool:
    """Nothing but blanks, placeholders, labels or bare markup."""
    text = answer.strip()
    for _ in range(3):
        if not text or PLACEHOLDER.match(text):
            return True
        text = LABEL.sub("", re.sub(r"<[^<>]{0,200}>|```\w*", " ", text)).strip()
    return not text or bool(PLACEHOLDER.match(text)) or not re.sub(r"\s", "", MARKUP.sub("", text))


def _words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def copy_parts(question: str, answer: str) -> tuple[float, str]:
    """Share of the prompt's words that the answer has, and the words that the answer has besides."""
    q, a = _words(question), _words(answer)
    have = set(q)
    rest = [w for w in a if w not in have]
    # a Korean word with another ending, or a word cut at its end, is still the prompt's word
    rest = [w for w in rest if not any(len(x) > 1 and (w.startswith(x) and len(w) - len(x) <= 2 and re.search("[가-힣]", w) and not re.search(r"\d", w)) for x in have)]
    got = set(a)
    share = sum(w in got or any(x.startswith(w) or w.startswith(x) and len(x) > 1 for x in got) for w in have) / max(1, len(have))
    return share, " ".join(rest)


def is_copy(question: str, answer: str) -> bool:
    """The answer only gives the prompt back, perhaps more than once, labelled, wrapped or with a few words changed."""
    if not question.strip():
        return False
    share, rest = copy_parts(question, LABEL.sub("", answer.strip()))
    more = [w for w in rest.split() if w not in WRAPPER]
    n = len(set(_words(question)))
    return share >= 0.6 and not any(ch.isdigit() for w in more for ch in w) and len(more) <= max(0, (n - 4) // 6) and n > 1


def broken_form(answer: str) -> bool:
    """Open fences, brackets or quotation marks, a half row of a table, a cut date, or an end that calls for more."""
    text = answer.rstrip()
    last = text.rsplit("\n", 1)[-1].strip()
    if text.count("```") % 2 or text.count('"') % 2 or text.count("“") != text.count("”"):
        return True
    if any(text.count(a) > text.count(b) for a, b in ("()", "[]", "{}", "「」")):
        return True
    if last.startswith("|") and not last.endswith("|"):
        return True
    if re.search(r"[,:;(\[{/&+–—·]$|(?:^|\s)[-*•]$|\.\.\.$|…$", text) and not re.search(r"\betc\.\.\.$", text):
        return True
    if re.fullmatch(r"\(?\d{1,3}[.)]", last) and "\n" in text:  # a list item without its text
        return True
    return bool(re.search(r"(?:^|\s)\d{4}\.(?:\s?\d{1,2}\.)?$|[.!?]\s\d{1,2}\.$", text) and len(text) > 12)


SOUND_END = re.compile(r"[.!?。！？]['\"”’)\]]*$|```$|\|$")


def features(rows: DataFrame) -> DataFrame:
    """What the checks need of each pair; figures are masked in ``units`` and ``words``.

    ``units`` are the response's sentences without greetings: text with the prompt's words
    masked, whether it says an inability, and whether it only surrounds a refusal.
    """
    unit = "array<struct<text: string, unable: boolean, filler: boolean>>"
    schema = f"eval_id bigint, question_type string, kind string, defect string, units {unit}, words array<string>, closed boolean"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for key, kind, q, a in frame.itertuples(index=False):
                q, a = _clean(q), _clean(a)
                defect, units = None, []
                if is_empty(a):
                    defect = "empty"
                elif is_copy(q, a):
                    defect = "copy"
                else:
                    ql, al = language(q), language(a)
                    if al and ql and al != ql and not ASKED.search(q) and not ("latin" in (al, ql) and "ko" not in (al, ql)):
                        defect = "wrong_language"
                    elif broken_form(a):
                        defect = "truncated"
                    for part in sentences(a):
                        text = LEAD.sub("", masked(part))
                        if not GREETING.match(text):
                            units.append({"text": starred(q, text), "unable": bool(INABILITY.search(NO_THEN.sub("", part))), "filler": bool(FILLER.search(text))})
                words = re.sub(r"[\"“”'‘’]", "", masked(a)).split()
                out.append((key, kind, prompt_kind(q), defect, units, words, bool(SOUND_END.search(a.rstrip()))))
            yield pd.DataFrame(out, columns=["eval_id", "question_type", "kind", "defect", "units", "words", "closed"])

    return rows.select("eval_id", "question_type", "question", "answer").mapInPandas(run, schema)


# --- clusters of openings


def _shingles(text: str) -> set[int]:
    import xxhash

    return {xxhash.xxh3_64_intdigest(text[i : i + SHINGLE]) for i in range(max(1, len(text) - SHINGLE + 1))}


def bands(openings: DataFrame) -> DataFrame:
    """(opening, band): one row per MinHash band of each opening."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rng = np.random.default_rng(1)
        a, b = rng.integers(1, 2**63, (2, HASHES, 1), dtype=np.uint64)
        for frame in frames:
            texts, keys = [], []
            for text in frame["opening"]:
                s = np.fromiter(_shingles(text), np.uint64)
                with np.errstate(over="ignore"):
                    low = ((s[None, :] ^ b) * (a | np.uint64(1)) >> np.uint64(16)).min(axis=1)
                for k in range(0, HASHES, ROWS):
                    texts.append(text)
                    keys.append(f"{k}:" + ":".join(map(str, low[k : k + ROWS])))
            yield pd.DataFrame({"opening": texts, "band": keys})

    return openings.select("opening").mapInPandas(run, "opening string, band string")


def _alike(left: list[set[int]], right: list[set[int]]) -> list[tuple[int, int]]:
    """Index pairs whose Jaccard similarity is at least SIMILAR; common shingles are counted by products of 0/1 matrices."""
    if len(left) * len(right) <= 64:
        return [(i, j) for i, s in enumerate(left) for j, t in enumerate(right) if len(s & t) >= SIMILAR * len(s | t)]
    place = {x: k for k, x in enumerate(set().union(*left) & set().union(*right))}
    common = np.zeros((len(left), len(right)), np.float32)
    at = [[(n, place[x]) for n, s in enumerate(side) for x in s if x in place] for side in (left, right)]
    rows, cols = zip(*(np.array(x, np.int64).reshape(-1, 2).T for x in at))
    for start in range(0, len(place), 4096):
        a, b = (np.zeros((len(side), 4096), np.float32) for side in (left, right))
        for m, r, c in zip((a, b), rows, cols):
            here = (c >= start) & (c < start + 4096)
            m[r[here], c[here] - start] = 1
        common += a @ b.T
    sizes = np.array([len(s) for s in left])[:, None] + np.array([len(s) for s in right])[None, :]
    return [tuple(x) for x in np.argwhere(common >= SIMILAR * (sizes - common)).tolist()]


def links(marks: DataFrame) -> DataFrame:
    """(opening, other): verified links that connect what all verified pairs of band members connect.

    Every pair of a band is verified.  A band is dealt into blocks of about BLOCK
    openings, and each pair of blocks is a row of its own, so no task needs a whole band;
    of a row's verified pairs only those that join two of its parts come out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        kept: dict[str, set[int]] = {}
        for frame in frames:
            pairs = []
            for same, low, high in zip(frame["same"], frame["low"], frame["high"], strict=True):
                sides = [list(low), list(low if same else high)]
                for text in {*sides[0], *sides[1]} - kept.keys():
                    kept[text] = _shingles(text)
                parent = {x: x for x in {*sides[0], *sides[1]}}

                def root(x: str) -> str:
                    while parent[x] != x:
                        parent[x] = x = parent[parent[x]]
                    return x

                for i, j in _alike(*([kept[x] for x in side] for side in sides)):
                    x, y = sides[0][i], sides[1][j]
                    if root(x) != root(y):
                        parent[root(x)] = root(y)
                        pairs.append((x, y))
                if len(kept) > 20_000:
                    kept.clear()
            yield pd.DataFrame(pairs, columns=["opening", "other"])

    sizes = marks.groupBy("band").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("band", F.ceil(F.col("n") / BLOCK).cast("int").alias("k"))
    dealt = marks.join(sizes, "band").withColumn("own", F.pmod(F.xxhash64("opening"), F.col("k")).cast("int"))
    dealt = dealt.withColumn("j", F.explode(F.expr("sequence(0, k - 1)"))).select("band", "opening", "own", F.least("own", "j").alias("lo"), F.greatest("own", "j").alias("hi"))
    side = lambda of: F.collect_list(F.when(F.col("own") == F.col(of), F.col("opening")))
    rows = dealt.groupBy("band", "lo", "hi").agg(side("lo").alias("low"), side("hi").alias("high"))
    return rows.select((F.col("lo") == F.col("hi")).alias("same"), "low", "high").mapInPandas(run, "opening string, other string").distinct()


def clusters(openings: DataFrame) -> DataFrame:
    """(opening, cluster): each distinct opening with the smallest opening that verified links lead to.

    Smallest labels travel along the links, and each label takes its own label's label,
    until none changes.
    """
    found = shared_table(links(shared_table(bands(openings))))
    both = shared_table(found.unionByName(found.select(F.col("other").alias("opening"), F.col("opening").alias("other"))))
    labels = openings.select("opening", F.col("opening").alias("cluster"))
    while True:
        near = both.join(labels.withColumnRenamed("opening", "other"), "other").groupBy("opening").agg(F.min("cluster").alias("near"))
        met = shared_table(labels.join(near, "opening", "left").select("opening", "cluster", F.least("cluster", F.coalesce("near", "cluster")).alias("met")))
        further = met.select(F.col("opening").alias("met"), F.col("met").alias("further"))
        moved = shared_table(met.join(further, "met").select("opening", F.least("met", "further").alias("cluster"), (F.least("met", "further") < F.col("cluster")).alias("moved")))
        labels = moved.select("opening", "cluster")
        if moved.where("moved").isEmpty():
            return labels


_CUT = f"array_distinct(transform(sequence(1, greatest(1, length(text) - {SHINGLE - 1})), i -> substring(text, i, {SHINGLE})))"


def refusal_templates(counts: DataFrame) -> DataFrame:
    """(text): sentences that recur across unrelated prompts and mostly say an inability: verbatim, or as clusters with one wording.

    A cluster has one wording if CORE of its sentences' shingles stand in SHARED of them;
    clusters that are chained over the changing parts of sentences on the subject have not.
    They mostly stand where nothing else is said: what limits an answer, and sentences on
    the subject with such a word, stand beside others.
    ``counts``: text, kind, n, unable, opens, alone.  A sentence of one word is an answer, not a
    template.
    """
    asked = counts.where("(opens OR unable) AND text LIKE '%_ _%'")
    labels = shared_table(clusters(asked.select("text").distinct().withColumnRenamed("text", "opening")).withColumnRenamed("opening", "text"))

    def recurring(placed: DataFrame, key: str) -> DataFrame:
        kinds = placed.groupBy(key, "kind").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("unable"), F.col("n")).otherwise(0)).alias("unable"), F.sum("alone").alias("alone"))
        whole = kinds.groupBy(key).agg(F.count(F.lit(1)).alias("kinds"), F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("unable").alias("unable"), F.sum("alone").alias("alone"))
        return whole.where((F.col("kinds") >= KINDS) & (F.col("most") <= MOST * F.col("n")) & (F.col("unable") >= UNABLE * F.col("n")) & (F.col("alone") >= ALONE * F.col("n"))).select(key)

    good = labels.join(recurring(counts.join(labels, "text"), "cluster"), "cluster", "left_semi")
    shingles = shared_table(good.select("cluster", "text", F.explode(F.expr(_CUT)).alias("s")))
    sizes = good.groupBy("cluster").agg(F.count(F.lit(1)).alias("texts"))
    core = shingles.groupBy("cluster", "s").agg(F.count(F.lit(1)).alias("k")).join(sizes, "cluster").where(F.col("k") >= SHARED * F.col("texts")).select("cluster", "s", F.lit(1).alias("core"))
    covered = shingles.join(core, ["cluster", "s"], "left").groupBy("cluster", "text").agg(F.avg(F.coalesce("core", F.lit(0))).alias("c")).groupBy("cluster").agg(F.avg("c").alias("c")).where(F.col("c") >= CORE)
    worded = good.join(covered, "cluster", "left_semi").select("text")
    verbatim = recurring(asked.where("unable"), "text")
    return worded.unionByName(verbatim).distinct()


def refusing(counts: DataFrame) -> DataFrame:
    """(text): sentences of the templates, and rare ones with a word of inability that are worded like them.

    A shingle's odds are the share of template sentences that have it against the share of
    other sentences, ROUNDED added to both, so what is rare on both sides says little at any
    size of the table; a rare sentence is like the templates if the mean log odds of its
    shingles are above LIKE, or above LIKE_END in its last END characters, where Korean
    has the verb.
    """
    templates = shared_table(refusal_templates(counts))
    told = counts.groupBy("text").agg(F.bool_or("unable").alias("unable")).join(templates.withColumn("known", F.lit(1)), "text", "left").withColumn("known", F.coalesce("known", F.lit(0)))
    told = shared_table(told)
    cut = F.expr(_CUT)
    shingles = told.select("known", F.explode(cut).alias("s")).groupBy("s").agg(F.sum("known").alias("r"), F.sum(1 - F.col("known")).alias("m"))
    sizes = told.agg(F.sum("known").alias("rs"), F.sum(1 - F.col("known")).alias("ms"))
    odds = shingles.crossJoin(F.broadcast(sizes)).select("s", F.log((F.try_divide("r", "rs") + ROUNDED) / (F.coalesce(F.try_divide("m", "ms"), F.lit(0.0)) + ROUNDED)).alias("o"))  # one row of sizes
    rare = told.where("unable AND known = 0 AND text LIKE '%_ _%'")
    parts = rare.select(F.lit(LIKE).alias("least"), F.col("text").alias("whole"), "text").unionByName(rare.select(F.lit(LIKE_END).alias("least"), F.col("text").alias("whole"), F.right("text", F.lit(END)).alias("text")))
    like = parts.select("whole", "least", F.explode(cut).alias("s")).join(odds, "s").groupBy("whole", "least").agg(F.avg("o").alias("o")).where("o > least").select(F.col("whole").alias("text")).distinct()
    return templates.unionByName(like)


def unsound_ends(pairs: DataFrame) -> DataFrame:
    """(eval_id, cut): responses without a closing mark whose last words seldom end a response.

    A word pair's ends are held against its occurrences further inside and against longer
    words that begin like its last word, over all responses; where the pair itself is rare
    its last word alone is taken.  An end that no other response has counts as cut only
    after more than seven words.
    """
    words = pairs.where("size(words) > 0").select("eval_id", "closed", F.concat(F.array(F.lit("^")), "words").alias("w"))
    n = F.size("w")
    tails = words.where("NOT closed").select("eval_id", F.element_at("w", -2).alias("p"), F.element_at("w", -1).alias("t"), n.alias("n_words"))
    two = words.select(F.explode(F.expr("transform(sequence(1, size(w) - 1), i -> named_struct('p', w[i - 1], 't', w[i], 'e', int(i = size(w) - 1 and not closed)))")).alias("x")).select("x.*")
    two = shared_table(two.groupBy("p", "t").agg(F.count(F.lit(1)).alias("n"), F.sum("e").alias("e")))

    lengths = two.where("e > 0").agg(F.collect_set(F.length("t")).alias("lengths"))  # one row: the lengths of words that end a response

    def figures(counts: DataFrame, keys: list[str], name: str) -> DataFrame:
        longer = counts.where("length(t) > 1").crossJoin(F.broadcast(lengths)).withColumn("t", F.explode(F.expr("transform(filter(lengths, i -> i < length(t)), i -> left(t, i))")))
        longer = longer.groupBy(*keys).agg(F.sum("n").alias("x"))
        ends = counts.where("e > 0")
        return ends.join(longer, keys, "left").select(*keys, F.struct(F.col("e"), (F.col("n") + F.coalesce("x", F.lit(0))).alias("all")).alias(name))

    one = two.groupBy("t").agg(F.sum("n").alias("n"), F.sum("e").alias("e"))
    both = tails.join(figures(two, ["p", "t"], "pair"), ["p", "t"], "left").join(figures(one, ["t"], "last"), "t", "left")
    rare = F.col("pair.all") < 6
    share = F.when(rare, F.col("last.e") / F.col("last.all")).otherwise(F.col("pair.e") / F.col("pair.all"))
    whole = F.when(rare, F.col("last.all")).otherwise(F.col("pair.all"))
    korean = F.col("t").rlike("(?:니다|어요|아요|여요|한다|된다|있다|없다|이다|함|됨|음|임)$")
    return both.select("eval_id", ((share < ENDS) & ~korean | (whole < 2) & (F.col("n_words") > 8) & ~korean).alias("cut"))


def defects(rows: DataFrame) -> DataFrame:
    """(eval_id, defect) of each defective pair; repeated rows are rows of their own.

    Order of the checks: empty, copy, refusal, wrong_language, truncated.  A null prompt
    counts as an empty text: only 'empty', 'refusal' and 'truncated' are possible then.
    Empty tables give an empty result; null ids stay null.
    """
    pairs = shared_table(features(rows))
    open_ = pairs.where("defect IS NULL OR defect NOT IN ('empty', 'copy')")
    alone = F.forall("units", lambda u: u["unable"] | u["filler"]).alias("alone")
    said = open_.select("eval_id", "question_type", "kind", alone, F.posexplode("units").alias("at", "unit")).select("eval_id", "question_type", "kind", "alone", "at", "unit.*")
    counts = shared_table(said.groupBy("text", "kind").agg(F.count(F.lit(1)).alias("n"), F.bool_or("unable").alias("unable"), F.bool_or(F.col("at") == 0).alias("opens"), F.count_if("alone").alias("alone")))
    declines = said.join(refusing(counts).withColumn("declines", F.lit(True)), "text", "left").withColumn("declines", F.coalesce("declines", F.lit(False)))
    hollow = declines.where("question_type IS NULL OR question_type <> 'unanswerable'").groupBy("eval_id").agg(F.bool_or("declines").alias("some"), F.bool_and(F.col("declines") | F.col("filler")).alias("refused"))
    refused = hollow.where("some AND refused").select("eval_id", "refused")
    cut = unsound_ends(open_).where("cut").select("eval_id", "cut").distinct()
    sure = pairs.join(refused, "eval_id", "left").join(cut, "eval_id", "left")
    found = F.when(F.col("defect").isin("empty", "copy"), F.col("defect")).when(F.col("refused"), F.lit("refusal")).when(F.col("defect").isNotNull(), F.col("defect")).when(F.col("cut"), F.lit("truncated"))
    return sure.select("eval_id", found.alias("defect")).where("defect IS NOT NULL")
