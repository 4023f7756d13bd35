import hashlib
import math
import random

import numpy as np
import pytest

from pairweave.llm import importance as im


def noise(doc_id, seed=8):
    digest = hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    u = (int(digest[:13], 16) + 0.5) / 2**52
    return -math.log(-math.log(u))


def corpus():
    rng = random.Random(5)
    good, bad = [f"g{i}" for i in range(40)], [f"b{i}" for i in range(40)]
    rows = []
    for i in range(500):
        own = good if i % 3 else bad
        rows.append((i, " ".join(rng.choice(own) for _ in range(rng.randrange(1, 80)))))
    return rows


def plain(rows, target, share, length):
    """Counts in dictionaries, then a full sort."""
    hasher = im.WordHasher()

    def grams(text):
        return im.grams(hasher.words(np.frombuffer((text or "").lower().encode(), np.uint8))).tolist()

    raw, aim = np.ones(im.BUCKETS), np.ones(im.BUCKETS)
    for i, text in rows:
        for g in grams(text):
            raw[g] += 1
            aim[g] += i is not None and i in target
    ratio = np.log(aim / aim.sum()) - np.log(raw / raw.sum())
    out = []
    for i, text in rows:
        found = grams(text)
        weight = float(sum(ratio[g] for g in found) * (length / len(found) if length else 1)) if found else None
        out.append((i, len(found), weight, None if weight is None else weight + noise(i)))
    able = sorted((r for r in out if r[3] is not None), key=lambda r: -r[3])
    last = able[: int(len(able) * share)]
    return out, last


@pytest.mark.parametrize("share, length", [(0.0, None), (0.25, None), (0.8, None), (1.0, None), (0.25, 100), (0.8, 100)])
def test_equals_plain_version(spark, share, length):
    rows = corpus() + [(900, None), (901, ""), (902, " \n"), (903, "unseen words"), (None, "g1 g2"), (904, "g3 " * 50_000)]
    target = {i for i in range(200) if i % 3}
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, id string, cut int").repartition(5)
    good = spark.createDataFrame([(i,) for i in target] + [(None,), (1,)], "doc_id long")
    got = {r.doc_id: r for r in im.resample(docs, good, share=share, length=length).collect()}
    want, last = plain(rows, target, share, length)
    assert len(got) == len(rows)
    for i, n, weight, value in want:
        assert got[i].n_grams == n
        if weight is None:
            assert got[i].log_weight is None and got[i].rank_value is None
        else:
            assert (got[i].log_weight, got[i].rank_value) == pytest.approx((weight, value), rel=1e-9)
    assert {i for i, r in got.items() if r.selected} == {r[0] for r in last}


def test_selected_documents_look_like_the_target(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    good = spark.createDataFrame([(i,) for i in range(100) if i % 3], "doc_id long")
    got = im.resample(docs, good, share=0.5).collect()
    assert np.mean([r.doc_id % 3 > 0 for r in got if r.selected]) > 0.99


def test_ties_repeated_rows_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")] * 4 + [(2, "a b")] * 4, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long")
    got = im.resample(docs, none, share=0.5).collect()
    assert sum(r.selected for r in got) == 4 and len({r.doc_id for r in got if r.selected}) == 1
    assert im.resample(docs.limit(0), none).collect() == []
