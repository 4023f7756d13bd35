"""Trained word vectors beside numpy on the whole matrix."""

import numpy as np
import pytest

from pyspark.sql import functions as F

from pairweave import session
from pairweave.operators import word_training as wt
from pairweave.operators.embed import word_average
from pairweave.plans import bindings as B

TEXTS = ["a b c a b", "b a", None, "", "  ", "d", "c c c", "a d b e f a c e b d " * 6, "é f\tg  h"]


def plain_counts(texts, window, least):
    cut = [(t or "").split() for t in texts]
    seen = {}
    for w in (w for t in cut for w in t):
        seen[w] = seen.get(w, 0) + 1
    out = {}
    for t in cut:
        for i, a in enumerate(t):
            for b in t[i + 1 : i + 1 + window]:
                if min(seen[a], seen[b]) >= least:
                    out[a, b] = out.get((a, b), 0) + 1
                    out[b, a] = out.get((b, a), 0) + 1
    return out


def dense(entries):
    words = sorted({e[0] for e in entries} | {e[1] for e in entries})
    place = {w: i for i, w in enumerate(words)}
    m = np.zeros((len(words), len(words)))
    for (a, b), v in entries.items():
        m[place[a], place[b]] = v
    return words, m


def plain_ppmi(counts):
    words, m = dense(counts)
    with np.errstate(divide="ignore"):
        out = np.log(m * m.sum() / np.outer(m.sum(0), m.sum(1)))
    return words, np.maximum(out, 0)


@pytest.mark.parametrize(("window", "least"), [(1, 1), (2, 1), (3, 4)])
def test_counts_and_information(spark, window, least):
    texts = spark.createDataFrame([(t, 1) for t in TEXTS], "text string, word int").repartition(3)
    counts = wt.cooccurrences(texts, window, least)
    want = plain_counts(TEXTS, window, least)
    assert {(r.word, r.context): r.n for r in counts.collect()} == want
    words, m = plain_ppmi(want)
    got = {(r.word, r.context): r.ppmi for r in wt.positive_information(counts).collect()}
    assert got == pytest.approx({(words[i], words[j]): m[i, j] for i, j in zip(*np.nonzero(m), strict=True)})


@pytest.mark.parametrize(("stripe", "cell"), [(1 << 16, 1 << 18), (7, 20)])
def test_leading_space_equals_numpy(spark, monkeypatch, stripe, cell):
    monkeypatch.setattr(wt, "STRIPE", stripe)
    monkeypatch.setattr(wt, "CELL", cell)
    rng = np.random.default_rng(4)
    topics = [[f"w{t}x{i}" for i in range(8)] for t in range(4)]
    texts = [" ".join(rng.choice(topics[k % 4], 40)) for k in range(24)]
    entries = wt.positive_information(wt.cooccurrences(spark.createDataFrame([(t,) for t in texts], "text string"), 2))
    vocabulary, matrix = wt.numbered(entries)
    vectors, values = wt.leading_vectors(vocabulary, matrix, 4, rounds=6)
    names = {r.i: r.word for r in vocabulary.collect()}
    words, m = plain_ppmi(plain_counts(texts, 2, 1))
    assert sorted(names.values()) == words and sorted(names) == list(range(len(words)))
    q = np.zeros((len(words), 4))
    for r in vectors.collect():
        q[words.index(names[r.i])] = r.x
    assert np.allclose(q.T @ q, np.eye(4), atol=1e-8)
    true = np.linalg.eigvalsh(m)
    assert np.sort(np.abs(values)) == pytest.approx(np.sort(np.abs(true))[-4:], rel=1e-4)
    assert np.abs(m @ q - q * values).max() < 0.02 * abs(values[0])


def test_vectors_feed_the_word_average(spark):
    texts = spark.createDataFrame([("1", "a b a b a b a b"), ("2", "c d c d c d c d"), ("3", "unseen"), ("4", None)], "text_key string, text string")
    vectors = wt.train_word_vectors(texts, dim=2, window=2, least_count=2, rounds=4)
    assert sorted(r.word for r in vectors.collect()) == ["a", "b", "c", "d"]
    got = {r.text_key: np.array(r.vector) for r in word_average(texts, vectors, 2).collect()}
    assert abs(got["1"] @ got["2"]) < 1e-6 and np.linalg.norm(got["1"]) > 0.5 and not got["3"].any() and not got["4"].any()


def test_no_words(spark):
    assert wt.train_word_vectors(spark.createDataFrame([(None,), ("",)], "text string"), dim=2).count() == 0
    with pytest.raises(ValueError):
        wt.cooccurrences(spark.createDataFrame([], "text string"), 0)


def test_pairs_are_counted_once(spark):
    """Joins take their sample from stored counts: each text is cut for the pairs once and for the vocabulary once."""
    seen = spark.sparkContext.accumulator(0)

    def read(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    texts = spark.createDataFrame([("a b c a b",), ("b c d",)], "text string").mapInArrow(read, "text string")
    counts = wt.cooccurrences(texts, least_count=2)
    assert seen.value == 4
    wt.positive_information(counts).collect()
    assert seen.value == 4


def exchanges(frame):
    return frame._jdf.queryExecution().executedPlan().toString().count("Exchange")


def small(monkeypatch):
    for name, value in {"PAIRS_AT_ONCE": 7, "PART_PAIRS": 9, "ROW_PAIRS": 3, "FETCHED": 2, "HASHED_AT_ONCE": 2}.items():
        monkeypatch.setattr(wt, name, value)


@pytest.mark.parametrize("held", [1 << 20, 0])
@pytest.mark.parametrize(("window", "least"), [(1, 1), (2, 3)])
def test_small_runs_and_joined_words_give_the_same(spark, monkeypatch, held, window, least):
    small(monkeypatch)
    monkeypatch.setattr(wt, "HELD_BYTES", held)
    texts = spark.createDataFrame([(t,) for t in TEXTS * 3], "text string").repartition(2)
    counts = wt.cooccurrences(texts, window, least)
    assert counts.dtypes == [("word", "string"), ("context", "string"), ("n", "bigint")]
    want = plain_counts(TEXTS * 3, window, least)
    assert sorted((r.word, r.context, r.n) for r in counts.collect()) == sorted((*pair, n) for pair, n in want.items())
    words, m = plain_ppmi(want)
    entries = {(words[i], words[j]): m[i, j] for i, j in zip(*np.nonzero(m), strict=True)}
    information = wt.positive_information(counts)
    for frame in (information, wt.positive_information(counts.where("n > 0"))):
        assert {(r.word, r.context): r.ppmi for r in frame.collect()} == pytest.approx(entries)
    vocabulary, _ = wt.numbered(information)
    assert sorted(r.word for r in vocabulary.collect()) == sorted({a for a, _ in entries})
    assert sorted(r.i for r in vocabulary.collect()) == list(range(vocabulary.count()))


@pytest.mark.parametrize(("vectors_bytes", "one_pass"), [(1 << 20, 1 << 24), (5 * 8 * 3, 3)])
def test_product_of_held_vectors_equals_numpy(spark, monkeypatch, vectors_bytes, one_pass):
    small(monkeypatch)
    monkeypatch.setattr(wt, "HELD_VECTORS", vectors_bytes)
    monkeypatch.setattr(wt, "ONE_PASS", one_pass)
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    vocabulary, matrix = wt.numbered(wt.positive_information(wt.cooccurrences(texts)))
    words, m = plain_ppmi(plain_counts(TEXTS, 2, 1))
    place = {r.i: words.index(r.word) for r in vocabulary.collect()}
    x = np.random.default_rng(5).normal(size=(len(words), 3))
    block = spark.createDataFrame([(i, x[w].tolist()) for i, w in place.items()], "i long, x array<double>")
    got = wt.product(matrix, block, 3).collect()
    assert sorted(r.i for r in got) == sorted(place)
    for r in got:
        assert np.allclose(r.x, (m @ x)[place[r.i]])


def test_pairs_stay_in_place(spark):
    """Information and words are added where the stored pairs are, and a product shuffles neither matrix nor vectors."""
    texts = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    counts = wt.cooccurrences(texts, least_count=2)
    information = wt.positive_information(counts)
    assert exchanges(counts) == 0 and exchanges(information) == 0
    vocabulary, matrix = wt.numbered(information)
    seen = []
    keep = wt.materialize
    wt.materialize = lambda df, name, **kw: (seen.append((name, exchanges(df))), keep(df, name, **kw))[1]
    try:
        wt.leading_vectors(vocabulary, matrix, 2, rounds=1)
    finally:
        wt.materialize = keep
    assert seen and all(n == 0 for _, n in seen)


def test_words_of_one_digest(spark, monkeypatch):
    """Digests that clash in the vocabulary are taken with another seed."""
    real = wt._digests
    monkeypatch.setattr(wt, "_digests", lambda words_, seed: real(words_, seed) * (seed > 0))
    kept = spark.createDataFrame([("a",), ("b",)], "word string")
    digests, names, seed = wt.held_vocabulary(kept, kept.limit(0))
    assert seed == 1 and sorted(names.value.to_pylist()) == ["a", "b"] and (np.diff(digests.value) > 0).all()


def test_shuffle_files_go_with_their_table(spark):
    before = spark.conf.get(session.NO_SHUFFLE_LEFT)
    stored = session.materialize(spark.range(10).groupBy((F.col("id") % 3).alias("k")).count(), "counts", keep_shuffles=False)
    assert stored.count() == 3 and spark.conf.get(session.NO_SHUFFLE_LEFT) == before


def test_quick_rounding_equals_rounding(spark):
    rng = np.random.default_rng(6)
    ties = [0.0000005, 0.0000015, 1.0000005, 2.5e-6, -0.0000005, -1e-9, 0.0, -0.0, 12.3456785, 1e5 + 5e-7, 1e300, -3e8, float("inf"), float("nan"), None]
    values = ties + rng.uniform(-20, 20, 5000).tolist() + (rng.integers(-(10**7), 10**7, 2000) / 1e6 + 5e-7).tolist()
    df = spark.createDataFrame([(v,) for v in values], "v double").select(B.r6("v").alias("plain"), B.quick_r6("v").alias("quick"))
    assert all(str(r.plain) == str(r.quick) for r in df.collect())


def test_information_is_rounded_without_decimals(spark, tmp_path):
    """Rounding by way of a decimal number was a third of the time in which the rows are written."""
    from pairweave.plans.catalog import QUERIES

    spark.createDataFrame([(1, "a b c a b a b c d a c " * 5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = QUERIES["word_information"](spark, str(tmp_path))
    assert got.count() and "rint" in got._jdf.queryExecution().optimizedPlan().toString().lower()
