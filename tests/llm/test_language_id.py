import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pairweave.llm import language_id as li

STEMS = {"aa": "bado kuri melo sina", "bb": "schrift zwölf über gruß", "cc": "água coração mañana niño"}


def corpus(n):
    rng = random.Random(3)
    rows = []
    for i in range(n):
        lang = sorted(STEMS)[i % 3]
        text = " ".join(rng.choice(STEMS[lang].split()) + rng.choice(["", "a", "en"]) for _ in range(rng.randrange(3, 40)))
        rows.append((i, text, lang))
    return rows


def plain_counts(text):
    letters = [c if ("a" <= c <= "z" or ord(c) >= 0xAA) else "\0" for c in text.lower()]
    return sum(any(x != "\0" for x in (letters[i], letters[i + k - 1])) for k in (1, 2, 3) for i in range(len(letters) - k + 1))


def test_counts_do_not_depend_on_pieces(monkeypatch):
    for text in ("", "a", "Ab, c! ñandú  x", "word " * 100):
        whole = li.counts(text)
        assert whole.sum() == plain_counts(text)
        for piece in (3, 7, 64):
            monkeypatch.setattr(li, "PIECE", piece)
            assert (li.counts(text) == whole).all()
        monkeypatch.undo()
    assert (li.counts("ABC") == li.counts("abc")).all()


def test_ftrl_step_equals_formula():
    model = li.Ftrl(2)
    rows, x = np.array([3, 5]), np.array([0.6, 0.8])
    for label in (0, 1, 0):
        z, n, w = model.z.copy(), model.n.copy(), model.weights(slice(None))
        model.learn(rows, x, label)
        p = np.exp(x @ w[rows]) / np.exp(x @ w[rows]).sum()
        for i, r in enumerate(rows):
            for k in range(2):
                g = x[i] * (p[k] - (k == label))
                sigma = (np.sqrt(n[r, k] + g * g) - np.sqrt(n[r, k])) / li.ALPHA
                assert model.z[r, k] == pytest.approx(z[r, k] + g - sigma * w[r, k])
                assert model.n[r, k] == pytest.approx(n[r, k] + g * g)
    assert (model.weights(slice(None))[[0, 1, 2, 4]] == 0).all()


def test_temperature_minimises_loss():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(400, 3)) * 2
    labels = np.array([rng.choice(3, p=p) for p in li.softmax(logits)])
    assert li.temperature(logits * 4, labels) == pytest.approx(0.25, rel=0.25)
    assert li.temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_held_out_accuracy_and_edge_cases(spark):
    rows = corpus(600) + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !?", "cc"), (1003, "bado kuri", None), (1004, STEMS["cc"] * 20_000, "aa")]
    rows += [(None, STEMS["bb"], "bb"), (7, rows[7][1], rows[7][2])]
    docs = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, id string, score double").repartition(5)
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    learnable = F.col("doc_id").isNotNull() & ~held & (F.col("doc_id") != 1004)
    model = li.fit(docs, learnable)
    got = li.identify(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    out = [(i, lang) for i, _, lang in corpus(600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([by_id[i].lang_pred == lang for i, lang in out]) > 0.98
    assert [by_id[i].lang_pred for i in (1000, 1001, 1002, 1003, 1004, None)] == ["und", "und", "und", "aa", "cc", "bb"]
    # neither lang nor held-out rows reach a prediction
    blind = docs.withColumn("lang", F.when(learnable, F.col("lang")))
    assert li.fit(blind, learnable) == model
    assert li.fit(docs.repartition(2), learnable) == model


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "abc", None)], "doc_id long, text string, lang string")
    assert li.fit(docs, F.lit(True)) is None
    assert [tuple(r) for r in li.identify(docs, None).collect()] == [(1, "und", 0.0)]
    model = li.fit(spark.createDataFrame([(1, "abc", "x")], docs.schema), F.lit(True))
    assert [r.lang_pred for r in li.identify(docs, model).collect()] == ["x"]
    assert li.identify(docs.limit(0), model).collect() == []


def test_repeated_rows_are_learnt_from_once(spark, monkeypatch):
    def trainer(idf, seed):
        def run(batches):
            n = sum(batch.num_rows for batch in batches)
            yield pa.RecordBatch.from_arrays([pa.array([str(n).encode()], pa.binary())], ["model"])

        return run

    monkeypatch.setattr(li, "_trainer", trainer)
    rows = corpus(200)
    often = spark.createDataFrame(rows + [rows[3], rows[3], rows[50]] * 300, "doc_id long, text string, lang string")
    assert li.fit(often.repartition(4), F.lit(True), rows=40) == b"120"
    assert li.fit(often.repartition(4), F.lit(True), rows=1000) == b"200"
