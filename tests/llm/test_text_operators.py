"""Canonical forms, copies, encoding, pieces and repetition on small fixtures and against brute force."""

import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanery.llm import bpe, canonical, copies, encoding, pieces, repetition

TEXTS = ["", "  ", "a'", "'s 's's ''s x'll'llama I've've", "  x \n\n y  ", "it's 5's\t'd", "\x00\x1c a\x85b <|endoftext|>", "🏗👩‍🔧 é é", "가나다 라마 123,456원", "x" * 3000, "한글 " * 2000]


def test_ids_equal_the_public_library():
    tokenizers = pytest.importorskip("tokenizers")
    coder = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    coder.encode_special_tokens = True
    ids, counts = bpe.byte_bpe().encode(TEXTS)
    at = 0
    for text, n in zip(TEXTS, counts, strict=True):
        assert ids[at : at + n].tolist() == coder.encode(text, add_special_tokens=False).ids
        at += n
    assert (bpe.byte_bpe().count(TEXTS) == counts).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=60), max_size=5))
def test_ids_of_any_text(texts):
    tiktoken = pytest.importorskip("tiktoken")
    tokenizers = pytest.importorskip("tokenizers")
    assert tiktoken
    coder = tokenizers.Tokenizer.from_file(f"{bpe.TOKENIZERS}/byte_bpe_50k.json")
    coder.encode_special_tokens = True
    ids, counts = bpe.byte_bpe().encode(texts)
    assert ids.tolist() == [i for t in texts for i in coder.encode(t, add_special_tokens=False).ids]
    assert len(counts) == len(texts)


def test_ids_of_null_and_empty(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "a b", "x"), (3, "a b", "x")], "doc_id long, text string, ids string")
    got = sorted((r["doc_id"], r["ids"]) for r in encoding.token_ids(df).collect())
    assert got[0] == (1, []) and got[1] == (2, []) and got[2] == got[3] and len(got[2][1]) == 2
    assert encoding.token_ids(df.limit(0)).count() == 0


RECORDS = [
    ("document", "1", "The plan A-1"), ("document", "2", "Τhe plan А-1"), ("document", "3", "Ｔhe pl​an A-1"), ("document", "4", "The  plan A-1"), ("document", "5", "the plan A-1"),
    ("document", "6", "The plan A-1"), ("document", "7", None), ("document", "8", ""), ("document", "9", "​"), ("document", "10", " "), ("chunk", "x", "The plan A-1"), ("document", "11", "é" * 50),
    ("document", "12", unicodedata.normalize("NFD", "é") * 50), ("document", "13", "e" * 50), ("document", "14", unicodedata.normalize("NFD", "한글 문서")), ("document", "15", "한글 문서"),
]


def test_look_alikes(spark):
    df = spark.createDataFrame(RECORDS, "rec_kind string, rec_id string, text string")
    got = {(r["rec_kind"], r["id_a"], r["id_b"]) for r in canonical.look_alikes(df).collect()}
    want = {("document", a, b) for a, b in [("1", "2"), ("1", "3"), ("2", "3"), ("2", "6"), ("3", "6"), ("11", "12"), ("14", "15")]}
    assert got == want
    form = {r["rec_id"]: r["text"] for r in canonical.canonical_texts(df).collect()}
    assert form["2"] == form["3"] == "The plan A-1" and form["7"] is None and form["9"] == "" and form["4"] == "The  plan A-1"
    assert canonical.look_alikes(df.limit(0)).count() == 0


CHUNKS = [
    ("a", "Ref: 1\nName: x"), ("b", '{"Name": "x", "Ref": "1"}'), ("c", "Name :  X | Ref : 1"), ("d", "Ref: x\nName: 1"), ("e", "One two. Three"), ("f", "one  TWO three!"), ("g", "three one two"),
    ("h", None), ("i", " "), ("j", "One two. Three"), ("k", "ref: 1; name: ｘ;"), (None, "One two. Three"), ("l", "Ref: 1\nRef: 1\nName: x"), ("m", "x" * 100_000), ("n", "X" * 100_000),
]


def test_copies(spark):
    df = spark.createDataFrame([(*c, "extra") for c in CHUNKS], "chunk_id string, text string, id string")
    got = {tuple(r) for r in copies.copies(df).collect()}
    assert got == {("a", "b"), ("a", "c"), ("a", "k"), ("e", "f"), ("e", "j"), ("m", "n")}
    counts = {r["chunk_id"]: r["n_copies"] for r in copies.collapsed(df).collect()}
    assert counts["a"] == 4 and counts["e"] == 3 and counts["d"] == 1 and "b" not in counts
    assert copies.copies(df.limit(0)).count() == 0


def test_equal_fingerprints_are_verified(spark, monkeypatch):
    monkeypatch.setattr(copies, "fingerprint", lambda pairs: "f0")
    df = spark.createDataFrame([("a", "Ref: 1\nName: x"), ("b", "Name: x\nRef: 1"), ("c", "Ref: 2\nName: x"), ("d", "Name: x\nRef: 2")], "chunk_id string, text string")
    pairs = spark.createDataFrame([("f0", "b", "name\x1fx\x1eref\x1f1", "a", "ref\x1f1\x1ename\x1fx"), ("f0", "c", "ref\x1f2", "a", "ref\x1f1\x1ename\x1fx")], "fp string, id_b string, body string, id_a string, body_a string")
    assert {(r["id_b"], r["same"]) for r in copies._same(pairs).collect()} == {("b", True), ("c", False)}
    assert df.count() == 4


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="ab .\n가é", max_size=4000).map(lambda t: t * 3))
def test_pieces_round_trip(text):
    cut = pieces.spans(text)
    assert "".join(text[m:z] for _, m, z in cut) == text
    assert all(z - a <= 1200 and 0 <= m - a <= 200 for a, m, z in cut)
    assert len(text) > 1200 or len(cut) == 1


def test_an_edit_alters_only_neighbouring_pieces():
    rng = np.random.default_rng(0)
    words = ["plan", "system", "report", "the", "of", "network."]
    text = " ".join(rng.choice(words, 6000))
    edited = text[:9000] + "INSERTED " + text[9000:]
    a, b = ({t[m:z] for _, m, z in pieces.spans(t)} for t in (text, edited))
    assert len(a - b) <= 3 and len(a) > 20


def test_pieces_of_tables(spark):
    df = spark.createDataFrame([("chunk", "a", "w " * 1000), ("chunk", "b", None), ("chunk", "c", ""), ("chunk", "d", "x" * 1200), ("chunk", "e", "x" * 5000)], "rec_kind string, rec_id string, text string")
    rows = pieces.pieces(df).collect()
    assert {r["rec_id"] for r in rows if r["n_chars"] > 1200} == {"a", "e"} and max(len(r["text"]) for r in rows) <= 1200
    assert pieces.pieces(df.limit(0)).count() == 0


def _share(words, stretch=6):
    """Brute force: words in a stretch that stood earlier, or in a group that repeats at once three times."""
    n, hit = len(words), [False] * len(words)
    for i in range(n - stretch + 1):
        if any(words[j : j + stretch] == words[i : i + stretch] for j in range(i)):
            hit[i : i + stretch] = [True] * stretch
    for p in range(1, stretch):
        for i in range(n):
            k = i
            while k + p < n and words[k] == words[k + p]:
                k += 1
            if k - i >= 2 * p and (i == 0 or i < p or words[i - 1] != words[i - 1 + p]):
                for q in range(i + p, k + p):
                    hit[q] = True
    return hit


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=60))
def test_repeated_words_against_brute_force(words):
    got = repetition.repeated(np.array(words, np.int64), np.zeros(len(words), np.int64))
    assert got.tolist() == _share(words)


def test_repetition_of_tables(spark):
    line = "the contractor shall deliver the yearly report on time to the office. "
    fresh = " ".join(f"word{i} thing{i * 7}" for i in range(60))
    df = spark.createDataFrame([(1, line * 5), (2, fresh), (3, None), (4, ""), (5, "go " * 30), (6, fresh + " " + fresh), (7, "1. a b c d e f\n2. A, b c d e f!\n3) a b c d e f"), (8, "x" * 10_000)], "doc_id long, text string")
    assert {r["doc_id"] for r in repetition.repetitive(df).collect()} == {1, 5, 6, 7}
    assert repetition.measured(df.limit(0)).count() == 0


def test_confusions_are_learned_from_the_corpus(spark):
    from gleanery.llm import scans

    stems = ["산업", "전산", "산출물", "생산량", "계산서", "산정표", "예산안", "정산금", "환산율", "연산기"]
    latin = ["having", "machine", "schedule", "technical", "threshold", "shipment", "exchange", "purchase"]
    words = [(w, 900) for w in stems + latin] + [(w.replace("산", "삼"), 4) for w in stems] + [(w.replace("h", "k", 1), 3) for w in latin] + [(w.replace("h", "ln", 1), 2) for w in latin]
    words += [(w + "을", 500) for w in stems] + [(w + "은", 3) for w in stems] + [("계획은", 900), ("계획을", 2)]  # endings go both ways or are those of the language
    words += [(f"목록{c}은", 400) for c in "가나다라마바사아자차카타파하거너더러머버"]
    got = scans.confusions(spark.createDataFrame(words, "word string, n bigint"))
    assert got == [("k", "h"), ("ln", "h"), ("삼", "산")]
    reader = scans.Reader(dict(words), learned=got)
    assert reader.word("생삼량")[0] == "생산량" and reader.word("Exckange")[0] == "Exchange" and reader.word("purclnase")[0] == "purchase" and reader.word("계획을") is None
    assert scans.confusions(spark.createDataFrame([], "word string, n bigint")) == []
