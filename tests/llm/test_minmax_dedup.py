import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.llm import minmax_dedup as mm
from pairweave.llm.texts import WordHasher, shingles


def plain_set(text, size):
    folded = (text or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))
    w = re.findall(rb"[^\x20\x09-\x0D]+", folded)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def plain(rows, size, percent):
    """Every pair, compared on its sets."""
    sets = defaultdict(list)
    for i, t in rows:
        sets[i].append(plain_set(t, size))
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if any(x and y and 100 * len(x & y) >= percent * len(x | y) for x in sets[a] for y in sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: find(i) for i in ids}


def near_texts(rng, n):
    """Groups whose members differ by more and more words, around the threshold, in chains and stars."""
    out = []
    while len(out) < n:
        base = [f"w{rng.randrange(60)}" for _ in range(rng.choice([3, 4, 8, 40, 90]))]
        for _ in range(rng.choice([1, 2, 5, 30])):
            text = list(base)
            for _ in range(rng.randrange(0, 6)):
                text[rng.randrange(len(text))] = f"x{rng.randrange(9)}"
            out.append(" ".join(text).upper() if rng.random() < 0.2 else "\t ".join(text))
            if rng.random() < 0.3:
                base = text
    return out[:n]


def test_word_hashes_do_not_depend_on_slices(monkeypatch):
    from pairweave.llm import texts

    data = ("ab cdé  " * 50 + "long" * 40 + "\n\tend").encode()
    view = np.frombuffer(data, np.uint8)
    whole = WordHasher().spans(view)
    monkeypatch.setattr(texts, "SLICE", 16)
    cut = WordHasher().spans(view)
    assert all((a == b).all() for a, b in zip(whole, cut, strict=True))
    words = [data[a:b] for a, b in zip(whole[1], whole[2], strict=True)]
    assert words == data.split()
    assert len(set(whole[0].tolist())) == len(set(words))
    assert WordHasher(fold=True).words(np.frombuffer("ÀbC".encode(), np.uint8)) == WordHasher(fold=True).words(np.frombuffer("ÀBc".encode(), np.uint8))


def test_shingle_hashes_follow_words():
    words = np.array([1, 2, 3, 1, 2, 3, 4], np.uint64)
    s = shingles(words, 3)
    assert len(s) == 5 and s[0] == s[3] and len(set(s.tolist())) == 4
    assert len(shingles(words[:2], 3)) == 1 and shingles(words[:2], 3) != shingles(words[1:3], 3)


def test_min_max_estimate_is_near_and_unbiased():
    rng = np.random.default_rng(1)
    a, b = mm._coefficients(64, 1)
    errors = []
    for _ in range(200):
        base = rng.integers(0, 2**64, 300, dtype=np.uint64)
        other = np.concatenate([base[:240], rng.integers(0, 2**64, 60, dtype=np.uint64)])
        errors.append((mm.min_max(base, a, b) == mm.min_max(other, a, b)).mean() - 240 / 360)
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.055


@pytest.mark.parametrize("size,block", [(4, 1024), (5, 8)])
def test_equals_brute_force(spark, monkeypatch, size, block):
    monkeypatch.setattr(mm, "BLOCK", block)
    rng = random.Random(size)
    rows = list(enumerate(near_texts(rng, 260)))
    rng.shuffle(rows)
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "one"), (904, "One"), (905, "one two"), (906, "z " * 5000)]
    docs = spark.createDataFrame([(i, t, "q", 1) for i, t in rows], "doc_id long, text string, id string, n int").repartition(7)
    got = {r.doc_id: r for r in mm.near_duplicates(docs, size=size).collect()}
    want = plain(rows, size, 80)
    assert {i: r.component_id for i, r in got.items()} == want
    assert {i: r.n_shingles for i, r in got.items()} == {i: len(plain_set(t, size)) for i, t in rows}
    assert all(r.kept == (i == want[i]) for i, r in got.items())


def test_repeated_rows_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(4, text), (4, text), (2, text + " more"), (9, None), (None, text), (None, None), (4, "other words here now"), (7, "other words here now")]
    got = sorted(map(tuple, mm.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=repr)
    want = plain([r for r in rows if r[0] is not None], 5, 80)
    assert {r[0]: r[2] for r in got if r[0] is not None} == want == {4: 2, 2: 2, 9: 9, 7: 2}
    assert [r for r in got if r[0] is None] == [(None, 0, None, True), (None, 26, None, True)]
    assert len(got) == len(rows)
    assert mm.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_words_that_a_polynomial_confuses(spark):
    word, other = "a", "b"
    for _ in range(11):
        word, other = word + other, other + word
    docs = spark.createDataFrame([(1, word), (2, other), (3, f"{word} {other}"), (4, f"{other} {word}")], "doc_id long, text string")
    assert all(r.kept for r in mm.near_duplicates(docs, size=4).collect())


def test_rows_of_the_stage_keep_their_columns(spark):
    a, b = (" ".join(f"{x}{i}" for i in range(30)) for x in "ab")
    rows = [(3, a, 1), (7, a + " more", 2), (8, b, 3), (8, b, 4), (9, b.upper(), 5), (5, None, 6), (6, " ", 7), (None, a, 8), (None, None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __id long").withColumn("__row", F.lit("x")).withColumn("id", F.lit(0))
    out = mm.without_near_duplicates(docs)
    assert out.columns == docs.columns
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=repr)
    assert got == sorted([(3, a), (8, b), (5, None), (6, " "), (None, a), (None, None)], key=repr)
    assert mm.without_near_duplicates(docs.limit(0)).count() == 0


def test_long_near_copies_in_small_cells(spark, monkeypatch):
    monkeypatch.setattr(mm, "BLOCK_SHINGLES", 50_000)
    monkeypatch.setattr(mm, "SET_BYTES", 1 << 16)
    rng = random.Random(6)
    base = [f"w{rng.randrange(10**6)}" for _ in range(20_000)]
    rows = []
    for i in range(24):
        words = list(base)
        for _ in range(700):  # two copies share about 0.7 of their runs, a copy and its twin nearly all
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**9)}"
        rows += [(2 * i + 1, " ".join(words)), (2 * i, " ".join(words[:-50]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {r.doc_id: r.component_id for r in mm.near_duplicates(docs).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == plain(rows, 5, 80)
