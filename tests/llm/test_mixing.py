import hashlib
import random

import pytest

from pairweave.llm.mixing import mix_sources, mixed_documents, word_count


def targets(sizes, share=1.5, copies=2, weights=(3, 1, 2)):
    """Give by weight, stop at the limit, reshare the excess, again and again."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, left, open_ = dict.fromkeys(order, 0.0), share * sum(sizes.values()), set(order)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        given = {s: left * weight[s] / total for s in open_}
        left = 0.0
        for s, x in given.items():
            target[s] += x
            if target[s] >= copies * sizes[s]:
                left += target[s] - copies * sizes[s]
                target[s] = copies * sizes[s]
                open_.discard(s)
    return target


def plain(rows, seed=9):
    """Whole copies, then inclusion by bisection and one sorted list per source."""
    size = {i: len((t or "").split()) for i, t, _ in rows}
    source = {i: s for i, _, s in rows}
    totals = {}
    for i, s in source.items():
        totals[s] = totals.get(s, 0) + size[i]
    taken = {}
    for s, target in targets(totals).items():
        own = [i for i in source if source[i] == s]
        whole = int(target / totals[s] + 1e-12) if totals[s] else 0
        left = target - whole * totals[s]
        low, high = 0.0, 1e9
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if sum(min(1, mid * size[i]) * size[i] for i in own) < left else (low, mid)
        copies = {i: whole * (size[i] > 0) for i in own}
        sure = {i for i in own if size[i] and high * size[i] >= 1 - 1e-9 and left > 1e-9}
        rest, at = left - sum(size[i] for i in sure), 0
        ranked = []
        for i in own:
            if size[i] and i not in sure and left > 1e-9:
                u = (int(hashlib.md5(f"{seed}:{i}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                p = high * size[i]
                ranked.append((u * (1 - p) / ((1 - u) * p), i))
        for _, i in sorted(ranked):
            if at + size[i] / 2 <= rest:
                copies[i] += 1
            at += size[i]
        for i in sure:
            copies[i] += 1
        taken.update({i: copies[i] * size[i] for i in own})
    return taken, totals, targets(totals)


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        s = "big" if rng.random() < 0.4 else rng.choice(["a", "b", "é", "zz", None, "tiny"])
        text = " ".join(["w"] * rng.choice([0, 1, 3, 20, 200, 2000 if i % 50 == 0 else 30]))
        rows.append((i, "x" if s == "tiny" else rng.choice([text, text + "\n\t", None if not text else text]), s))
    return rows


@pytest.mark.parametrize("seed,buckets", [(1, 4096), (2, 5), (3, 1)])
def test_equals_plain_version(spark, monkeypatch, seed, buckets):
    monkeypatch.setattr("pairweave.llm.mixing.BUCKET_ROWS", buckets)
    rows = corpus(seed, 400)
    docs = spark.createDataFrame([(i, t, s, 5, "k") for i, t, s in rows], "doc_id long, text string, source string, size int, src string")
    got = {r.doc_id: r for r in mix_sources(docs.repartition(6)).collect()}
    taken, totals, target = plain(rows)
    assert {i: r.taken for i, r in got.items()} == taken
    for i, _, s in rows:
        assert got[i].source_size == totals[s] and got[i].target == pytest.approx(target[s])
        assert got[i].taken <= 2 * got[i].size
    for s, words in totals.items():
        most = max(r.size for i, r in got.items() if rows[i][2] == s)
        assert abs(sum(r.taken for i, r in got.items() if rows[i][2] == s) - target[s]) <= most / 2 + 1e-6
    again = {r.doc_id: r.taken for r in mix_sources(docs.repartition(2)).collect()}
    assert again == {i: r.taken for i, r in got.items()}


def test_word_count(spark):
    rows = [(None,), ("",), (" \t\n\x0b\x0c\r",), ("a b",), (" é x \x1c y\n",), ("a" * 10_000 + " b",)]
    df = spark.createDataFrame(rows, "text string")
    assert [r[0] for r in df.select(word_count("text")).collect()] == [0, 0, 0, 2, 3, 2]


def test_rows_null_ids_repeats_and_empty_tables(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "c", "s"), (None, "c", "s"), (None, None, None), (2, "", "t"), (3, None, "t")]
    docs = spark.createDataFrame([(*r, "q") for r in rows], "doc_id long, text string, source string, size string")
    got = mix_sources(docs).collect()
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    assert all(r.taken == 0 for r in got if not r.size)
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    assert {(r.doc_id, r.text) for r in mixed.collect()} <= {(1, "a b"), (None, "c")}
    assert mix_sources(docs.limit(0)).collect() == [] and mixed_documents(docs.limit(0)).collect() == []
