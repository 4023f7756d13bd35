import math
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pairweave.functions.ngrams import ngram_vector, pieces, slot_counts
from pairweave.functions.text import text_key
from pairweave.operators import embed


def brute(text, n=3, dim=64):
    v = [0.0] * dim
    for i in range(len(text) - n + 1):
        number = 0
        for ch in text[i : i + n]:
            number = number * 31 + ord(ch)
        v[number % 8191 % dim] += 1
    length = math.sqrt(sum(x * x for x in v)) or 1.0
    return [x / length for x in v]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=12), max_size=6), st.integers(1, 4))
def test_slot_counts_match_brute_force(texts, n):
    got = slot_counts(texts, n, 16)
    for row, text in zip(got, texts):
        length = math.sqrt((row * row).sum()) or 1.0
        assert list(row / length) == pytest.approx(brute(text, n, 16))


def test_pieces_keep_everything():
    texts = ["a" * 3_000_000, "b" * 3_000_000, "c", "d" * 9_000_000]
    parts = list(pieces(texts))
    assert [t for p in parts for t in p] == texts and len(parts) == 3


def test_ngram_vector_column(spark):
    texts = ["abcd", "", None, "ab", "日本語テキスト😀ab", "x" * 50_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", ngram_vector()("t").alias("v")).collect()}
    assert got[2] is None
    for i, t in enumerate(texts):
        if t is not None:
            assert got[i] == pytest.approx(brute(t))


@pytest.fixture(scope="module")
def words(spark):
    rows = [("a", [2.0, 0.0]), ("b", [0.0, 3.0]), ("zero", [0.0, 0.0])]
    return spark.createDataFrame(rows, "word string, vector array<float>")


@pytest.mark.parametrize("block_bytes", [1 << 20, 200, 1])
def test_word_average(spark, words, block_bytes):
    """In one broadcast block, in two, and joined."""
    rows = [("1", "a  b\tb"), ("2", "unknown zero"), ("3", ""), ("4", "a"), ("5", None)]
    texts = spark.createDataFrame(rows, "text_key string, text string")
    got = {r.text_key: r.vector for r in embed.word_average(texts, words, 2, sample=1.0, block_bytes=block_bytes).collect()}
    assert got["1"] == pytest.approx([1 / 3, 2 / 3])
    assert got["4"] == [1.0, 0.0]
    assert got["2"] == got["3"] == got["5"] == [0.0, 0.0]


def test_joined_words_carry_no_sums(spark, monkeypatch):
    """frequent words are broadcast; a joined row carries its vector as it is, and a text leaves its task once."""
    rng = random.Random(1)
    vectors = [(f"w{i}", [rng.uniform(-1, 1) for _ in range(4)]) for i in range(60)]
    table = spark.createDataFrame(vectors + vectors[:1] + vectors[40:41], "word string, vector array<float>")
    rows = [(str(i), " ".join(rng.choices([f"w{j}" for j in range(70)], [1 / (j + 1) for j in range(70)], k=40))) for i in range(80)]
    texts = spark.createDataFrame(rows, "text_key string, text string")
    carried = []
    join = embed.skew_join
    monkeypatch.setattr(embed, "skew_join", lambda *args, **more: carried.append(join(*args, **more)) or carried[-1])
    monkeypatch.setattr(embed, "WORD_BLOCKS", 0)
    got = {r.text_key: list(r.vector) for r in embed.word_average(texts, table, 4, sample=1.0, block_bytes=1024).collect()}
    units = {}
    for w, v in table.collect():
        units.setdefault(w, []).append(np.array(v, "f8") / np.linalg.norm(np.array(v, "f8")))
    for key, text in rows:
        held = [u for w in text.split() for u in units.get(w, [])]
        assert got[key] == pytest.approx(list(np.mean(held, axis=0)))
    joined = {r.word for r in carried[0].select("word").collect()}
    assert joined and "w1" not in joined and "w0" not in joined
    assert carried[0].count() < sum(len(set(t.split())) for _, t in rows) / 2


def test_pair_similarity_rules_and_reuse(spark):
    rows = [(1, "same text", "same text"), (2, "", "x"), (3, None, "abc"), (4, "abcabc", "zzzqqq"), (5, "abcd", "abce"), (6, "same text", "same text")]
    pairs = spark.createDataFrame(rows, "id long, sentence1 string, sentence2 string")
    direct = {r.id: r.similarity for r in embed.pair_similarity(pairs, ngram_vector()).collect()}
    reused = {r.id: r.similarity for r in embed.pair_similarity_reusing(pairs, embed.hashed_ngrams).collect()}
    assert direct == pytest.approx(reused)
    assert direct[1] == pytest.approx(1.0) and direct[2] == direct[3] == 0.0 and 0 < direct[5] < 1


def test_negative_cosine_is_clamped_and_model_runs_per_batch(spark):
    pairs = spark.createDataFrame([(1, "up", "down"), (2, "up", "up")], "id long, sentence1 string, sentence2 string")

    def load():
        return lambda texts: [[1.0, 0.0] if t == "up" else [-1.0, 0.0] for t in texts]

    scored = embed.pair_similarity_reusing(pairs, lambda texts: embed.model_vectors(texts, load))
    assert {r.id: r.similarity for r in scored.collect()} == {1: 0.0, 2: 1.0}


def test_each_distinct_text_reaches_the_embedder_once(spark):
    df = spark.createDataFrame([(i, "copy" if i % 3 else f"t{i}") for i in range(30)], "id long, text string")
    seen = []

    def counting(texts):
        seen.append(texts.count())
        return embed.hashed_ngrams(texts)

    out = embed.embed_column(df, "text", counting)
    assert seen == [11]
    assert out.count() == 30 and out.columns == ["id", "text", "vector"]
    assert out.select(text_key("text")).distinct().count() == 11
    assert out.where(F.col("vector").isNull()).count() == 0
