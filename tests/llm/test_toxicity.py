import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pairweave.llm import toxicity as tx


def views(texts):
    return list(tx.text_views(pa.array(texts, pa.string())))


def small():
    rng = random.Random(2)
    clean = ["sun", "tree", "walk", "blue", "seven", "Haus", "río"]
    rows = []
    for i in range(400):
        text = [rng.choice(clean) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(3, 150))]
        if i % 2:
            text[rng.randrange(len(text))] = "vile" + "".join(rng.choice("abdefghnorsx") for _ in range(rng.randrange(1, 5)))
        rows.append((i, " ".join(text), i % 2))
    return rows


def test_windows_cover_every_word_and_overlap():
    for n in (1, 63, 64, 65, 112, 113, 500):
        words = tx.Words(views([" ".join(f"w{i}" for i in range(n))]), tx.toxic_hasher())
        seen = np.zeros(n, int)
        place = {k: i for i, k in enumerate(words.place.tolist())}
        for row in words.index:
            at = [place[k] for k in row.tolist() if k >= 0]
            assert at == list(range(at[0], at[0] + min(n, tx.WINDOW)))
            seen[at] += 1
        assert seen.min() >= 1
    assert (np.diff(sorted(words.index[:, 0])) != 0).all()


def test_gradient_equals_differences():
    rng = np.random.default_rng(0)
    w = {k: v.astype(np.float64) for k, v in tx.first_weights(3).items()}
    words = tx.Words(views(["some words to learn from", "other", " ".join(f"k{i % 9}" for i in range(90))]), tx.toxic_hasher())
    slope = rng.normal(size=len(words.index))

    def loss():
        x = np.zeros((len(words.kinds), tx.WORD_SIZE + tx.CHAR_SIZE))
        x[:, : tx.WORD_SIZE] = w["words"][words.bucket]
        for i in range(len(x)):
            x[i, tx.WORD_SIZE :] = w["chars"][words.gram[words.gram_word == i]].mean(axis=0)
        return float(tx.forward(w, x, words.index).astype(np.float64) @ slope)

    found = tx.gradients(w, words, words.index, slope)
    for name in tx.PARAMETERS:
        flat, grad = w[name].reshape(-1), found[name].reshape(-1)
        for i in np.argsort(-np.abs(grad))[:3]:
            old, step = flat[i], 1e-2
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert grad[i] == pytest.approx((up - down) / (2 * step), rel=0.05, abs=2e-3), name


def test_learns_unseen_forms_and_scores_long_texts_whole(monkeypatch):
    rows = small()
    w = tx.train([t for _, t, _ in rows], np.array([y for _, _, y in rows], np.float32), epochs=40)
    long = "sun tree walk blue " * 3000
    texts = ["walks trees", "sun vilehood walk", long, long + "vileful " + long, "", None, "***", "VILEX"]
    hasher = tx.toxic_hasher()
    score = tx.score_views(w, views(texts), hasher)
    assert (score >= 0.5).tolist() == [False, True, False, True, False, False, False, True]
    assert score[4] == score[5] == score[6] == 0
    monkeypatch.setattr(tx, "PIECE", 1000)  # in parts it is the same
    again = tx._scores(w, pa.array(texts, pa.string()), hasher)
    assert ((again >= 0.5) == (score >= 0.5)).all()
    assert tx.unpack(tx.pack(w))["words"].shape == w["words"].shape


def test_fit_learns_only_from_rows_not_held_out(spark, monkeypatch):
    monkeypatch.setattr(tx, "EPOCHS", 40)
    rows = small() + [(1000, None, 0), (1001, "", 1), (1002, "no label", None)]
    docs = spark.createDataFrame([(i, t, 5) for i, t, _ in rows], "doc_id long, text string, label int").repartition(4)
    labels = spark.createDataFrame([(i, 0, y, "x") for i, _, y in rows], "doc_id long, quality int, toxic int, text string")
    model = tx.fit(docs, labels)
    got = {r.doc_id: r for r in tx.toxicity(docs, model).collect()}
    held = [(i, y) for i, _, y in small() if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.95
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got.values())
    assert got[1000].score == got[1001].score == 0
    # labels of held-out rows change nothing
    turned = labels.selectExpr(
        "doc_id", "case when crc32(cast(cast(doc_id as string) as binary)) % 5 = 0 then 1 - toxic else toxic end as toxic"
    )
    assert tx.fit(docs, turned) == model
    kept = tx.without_toxic(docs, model)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.score < 0.5}


def test_nothing_to_learn_from_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "a"), (None, "b"), (1, "a")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert tx.fit(docs, none) is None
    assert [r.score for r in tx.toxicity(docs, None).collect()] == [0, 0, 0]
    model = tx.pack(tx.first_weights(1))
    assert len(tx.toxicity(docs, model).collect()) == 3
    assert tx.toxicity(docs.limit(0), model).collect() == []
