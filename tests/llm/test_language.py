"""Language scores against a sum over every segmentation, words of any length and samples of any size."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granary.llm import language_id as L

PIECES = [bytes([b]) for b in range(256)] + [b" a", b"ab", b"ba", b" ab", b"xx", b"xxx", "日本".encode(), "語".encode(), b" the"]


def brute(word, p):
    """log of the sum over all segmentations of a word (with its space), by plain numbers."""
    text = b" " + word
    at = {x: k for k, x in enumerate(PIECES)}
    log = [0.0] + [-math.inf] * len(text)
    for j in range(1, len(text) + 1):
        terms = [log[i] + math.log(p[at[text[i:j]]]) for i in range(max(0, j - 9), j) if text[i:j] in at]
        top = max(terms)
        log[j] = top + math.log(sum(math.exp(x - top) for x in terms))
    return log[-1]


@pytest.fixture(scope="module")
def model():
    p = np.random.default_rng(2).random((len(PIECES), 3))
    return L.Pieces(PIECES), p / p.sum(axis=0)


@pytest.mark.parametrize("word", ["ab", "abab" * 9, "x" * 39, "x" * 40, "x" * 41, "x" * 700, "日本語" * 30, "日語" * 20 + "x" * 90 + "本", "q" * 200, "the" + "ab" * 60])
def test_words_of_any_length(model, word):
    pieces, p = model
    data = np.frombuffer(word.encode(), dtype=np.uint8)
    got = L.score_words(pieces, p, data, np.array([0]), np.array([len(data)]))[0]
    assert np.allclose(got, [brute(word.encode(), p[:, k]) for k in range(3)], rtol=1e-9)


def test_whole_texts(frame, model):
    """identify() on texts, Chinese without blanks too, against the product of the words' sums."""
    pieces, p = model
    texts = ["the ab, Abba! " * 3, "日本語日本" * 25 + "。ab", "x" * 90 + " 12 xx-the", "語"]
    got = {r.doc_id: r for r in L.identify(frame(list(enumerate(texts))), (["a", "b", "c"], pieces, p)).collect()}
    for i, text in enumerate(texts):
        words, word = [], b""
        for b in text.encode() + b" ":
            if chr(b).isascii() and not chr(b).isalpha():
                words, word = words + [word] * bool(word), b""
            else:
                word += bytes([b]).lower()
        total = np.array([sum(brute(w, p[:, k]) for w in words) for k in range(3)])
        assert got[i].lang_pred == "abc"[int(total.argmax())]
        assert math.isclose(got[i].score, 1 / np.exp(total - total.max()).sum(), rel_tol=1e-6)


def test_fitting_on_long_words(model):
    """One step of expectation maximisation is the same for a long word summed place by place and side by side."""
    pieces, _ = model
    word = [b"x" * 60 + b"abab"]
    before = L.MAX_WORD
    try:
        L.MAX_WORD = 100
        want = L.fit(pieces, word, np.array([3.0]), 2)
    finally:
        L.MAX_WORD = before
    assert np.allclose(L.fit(pieces, word, np.array([3.0]), 2), want, rtol=1e-9)


def test_sample_of_any_count(spark):
    rows = spark.range(200_000)
    for have, least, most in ((200_000, 300, 500), (100, 200_000, 200_000)):
        n = rows.where(L.is_drawn(F.lit(have), 400, F.col("id").cast("string"))).count()
        assert least <= n <= most
    # 5 billion rows: the threshold is 8e-8, not 0; of the 200,000 hashes the least ones lie below it or near it.
    threshold = spark.range(1).select((F.lit(400.0) / F.lit(5_000_000_000)).alias("x")).first().x
    assert threshold == 8e-8
    null_ids = spark.range(2000).select(F.lit(None).cast("string").alias("key"), F.col("id").cast("string").alias("text"))
    assert 150 < null_ids.where(L.is_drawn(F.lit(2000), 400, F.col("key"), F.col("text"))).count() < 700


def test_more_languages_than_are_learnt(spark, monkeypatch):
    monkeypatch.setattr(L, "MOST_LANGUAGES", 2)
    rows = [(k, "hello there my friend", "en") for k in range(3)] + [(9, "guten tag", "de"), (10, "bonjour", "fr"), (11, "guten morgen", "de")]
    languages, _, p = L.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "lang", "text")
    assert languages == ["de", "en"] and p.shape[1] == 2


def test_repeated_rows_neither_hide_nor_fill_a_language(spark):
    """A language of one text many times over is learnt, from that text once, beside one of many texts."""
    one = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("der eine satz den alle kennen").alias("text"), F.lit("de").alias("lang"))
    two = spark.range(3_000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("una frase sola").alias("text"), F.lit("es").alias("lang"))
    many = spark.range(100).select(F.col("id").alias("doc_id"), F.concat(F.lit("the word number "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    languages, pieces, p = L.train(one.unionByName(two).unionByName(many), "lang", "text")
    assert languages == ["de", "en", "es"]
    same = L.train(one.limit(1).unionByName(two.limit(1)).unionByName(many), "lang", "text")[2]
    assert np.allclose(p, same)
