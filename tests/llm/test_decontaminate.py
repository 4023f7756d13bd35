import re

import numpy as np
import pytest

from pairweave.llm import decontaminate as dc

ITEMS = [
    (0, "alpha beta gamma delta epsilon zeta eta theta iota kappa"),
    (1, "Über die Brücke ging ein alter Mann, ganz allein."),
    (2, "too short"),
    (3, None),
    (4, ""),
    (5, "the of and the of and the of and the of and"),
]
PAD = " ".join(f"w{i}" for i in range(40))


def split(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (text or "").lower())


def plain_score(item, words):
    """Textbook dynamic programming, cell by cell."""
    score, best = [[0] * (len(words) + 1) for _ in range(len(item) + 1)], 0
    for i, a in enumerate(item, 1):
        for j, b in enumerate(words, 1):
            score[i][j] = max(0, score[i - 1][j - 1] + (1 if a == b else -1), score[i - 1][j] - 1, score[i][j - 1] - 1)
            best = max(best, score[i][j])
    return best


def test_align_equals_textbook():
    rng = np.random.default_rng(5)
    for _ in range(300):
        item, words = rng.integers(0, 4, rng.integers(1, 12)), rng.integers(0, 4, rng.integers(1, 30))
        score, a, z = dc.align(item, words)
        assert score == plain_score(item, words)
        if score:
            assert plain_score(item, words[a : z + 1]) == score


def documents():
    whole = ITEMS[0][1]
    edited = whole.replace("delta", "DELTA").replace("zeta", "changed")
    added = whole.replace("epsilon", "epsilon and one more")
    return [
        (0, f"{PAD} {whole} {PAD}"), (1, f"{PAD} {edited}, {PAD}"), (2, f"{added}"), (3, PAD), (4, None), (5, ""),
        (6, "ÜBER DIE BRÜCKE GING EIN ALTER MANN; GANZ ALLEIN"), (7, f"{ITEMS[1][1]} {PAD} {whole}"), (7, f"{whole}"),
        (8, "alpha beta gamma " + PAD), (9, " ".join(whole.split()[::-1])), (10, "the of and " * 3), (None, whole),
        (11, f"{PAD} " * 300 + whole),
    ]


def test_find_leaks_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "x", 0) for i, t in documents()], "doc_id long, text string, item_id string, score int")
    items = spark.createDataFrame([(i, t, t) for i, t in ITEMS], "item_id long, text string, doc_id string")
    want = []
    for doc_id, text in documents():
        for item_id, item in ITEMS:
            words = split(item)
            if words:
                score = plain_score(words, split(text))
                if score >= max(0.5 * len(words), min(len(words), 2)):
                    want.append((doc_id, item_id, round(score / len(words), 9)))
    for blocks in (1 << 20, 10):  # in one block, and in several
        got = dc.find_leaks(docs.repartition(4), items, block_words=blocks).collect()
        found = sorted(((r.doc_id, r.item_id, round(r.score, 9)) for r in got), key=repr)
        assert found == sorted(want, key=repr)


def test_frequent_leak_keeps_its_seeds(spark):
    rows = [(i, f"u{i} v{i} {ITEMS[0][1]} x{i}") for i in range(400)]
    got = dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    assert sorted(r.doc_id for r in got.collect()) == list(range(400))


def test_edited_leak_in_every_document(spark):
    """All shared seeds are frequent, and the item also has seeds that no document holds."""
    edited = ITEMS[0][1].replace("epsilon", "changed")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    for docs, leaks in ((400, 400), (10_000, 200)):
        rows = [(i, f"u{i} v{i} {edited if i < leaks else PAD} x{i}") for i in range(docs)]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        got = dc.find_leaks(df, items).collect()
        assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(i, 0, 0.8) for i in range(leaks)]
        assert sorted(r.doc_id for r in dc.without_leaks(df, items).collect()) == list(range(leaks, docs))


def test_common_seed_beside_the_leak(spark):
    """A seed that stands many times in a long text, far from the edited copy, hides nothing."""
    common, item = "one of the", "one of the alpha beta gamma delta epsilon zeta eta"
    edited = "alpha beta gamma changed epsilon zeta eta"
    rows = [(i, f"{(common + f' {PAD} ') * 50} {edited if i % 2 else 'eta zeta'} {PAD}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dc.find_leaks(docs, spark.createDataFrame([(0, item), (1, common)], "item_id long, text string")).collect()
    want = [(i, 0, 0.5) for i in range(1, 40, 2)] + [(i, 1, 1.0) for i in range(40)]
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == sorted(want)


@pytest.mark.parametrize("which", ["docs", "items"])
def test_empty_tables(spark, which):
    docs = spark.createDataFrame([] if which == "docs" else [(1, "a b c d")], "doc_id long, text string")
    items = spark.createDataFrame([] if which == "items" else ITEMS, "item_id long, text string")
    assert dc.find_leaks(docs, items).collect() == []


def test_words_that_a_polynomial_confuses(spark):
    word, other = "a", "b"
    for _ in range(11):
        word, other = word + other, other + word
    docs = spark.createDataFrame([(1, f"x y {word} z u"), (2, f"x y {other} z u")], "doc_id long, text string")
    items = spark.createDataFrame([(7, f"p q {word} r s")], "item_id long, text string")
    assert dc.find_leaks(docs, items, least=0.2).count() == 0
    same = spark.createDataFrame([(7, f"y {word} z")], "item_id long, text string")
    assert [r.doc_id for r in dc.find_leaks(docs, same, least=1.0).collect()] == [1]


@pytest.mark.parametrize("least", [0.3, 0.5, 0.8])
def test_no_edited_leak_is_lost(least):
    """Random edits of items of 1 to 60 words, beside the textbook score."""
    rng = np.random.default_rng(int(least * 10))
    items = [rng.integers(0, rng.choice([4, 30, 1000]), m) for m in (*range(1, 14), 20, 33, 60)]
    block = dc.Block(list(range(len(items))), [" ".join(f"w{x}" for x in item) for item in items], least)
    for _ in range(700):
        i = int(rng.integers(len(items)))
        text = []
        for x in items[i]:
            edit = rng.random()
            if edit < 0.3:
                text += [] if edit < 0.1 else [5000 + int(rng.integers(9))] if edit < 0.2 else [x, 6000 + int(rng.integers(9))]
            else:
                text.append(x)
        text = [*rng.integers(0, 40, rng.integers(0, 9)), *text, *rng.integers(0, 40, rng.integers(0, 9))]
        words = [f"w{x}" for x in text]
        got = {k: s for k, s, _, _ in dc.leaks_in(block, dc.leak_hasher().words(np.frombuffer(" ".join(words).encode(), np.uint8)))}
        for k, item in enumerate(items):
            m, score = len(item), plain_score([f"w{x}" for x in item], words)
            if score >= max(least * m - 1e-9, min(m, 2)):
                assert round(got.pop(k) * m) == score
        assert not got


def test_short_items_count_whole(spark):
    items = spark.createDataFrame([(1, "Paris France"), (2, "zeitgeist"), (3, "?!"), (4, "Zeitgeist")], "item_id long, text string")
    rows = [(1, "in paris, france."), (2, "paris or france"), (3, "France Paris"), (4, "der Zeitgeist"), (5, "zeitgeistig")]
    got = dc.find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()
    assert sorted((r.doc_id, r.item_id, r.score) for r in got) == [(1, 1, 1.0), (4, 2, 1.0), (4, 4, 1.0)]
