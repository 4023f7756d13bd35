import math

import numpy as np
import pytest

from pairweave.llm import cap_filters as cf


def plain(rows, cosine=0.9):
    able = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v):
            x = np.array(v, float) / np.abs(v).max()
            able[k] = (i, x / np.linalg.norm(x))
    links, root = dict.fromkeys(able, 0), {k: k for k in able}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (_, x) in able.items():
        for j, (_, y) in able.items():
            if j != k and len(x) == len(y) and float(x @ y) >= cosine:
                links[k] += 1
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in able.items():
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted(((i, links.get(k, 0), least[find(k)] if k in able else i) for k, (i, _) in enumerate(rows)), key=repr)


def clusters(rng, groups, size, d, spread):
    out = []
    for _ in range(groups):
        middle = rng.normal(size=d)
        out += [middle + spread * rng.normal(size=d) * np.linalg.norm(middle) / math.sqrt(d) for _ in range(size)]
    return [[float(np.float32(x)) for x in v] for v in out]


def test_decode_finds_every_exceeding_filter():
    rng = np.random.default_rng(0)
    for size, rows in ((64, 5000), (7, 300), (1, 10), (2, 10)):
        codes = cf.Codes(size, rows, 0.9)
        x = rng.normal(size=(20, size))
        x /= np.linalg.norm(x, axis=1)[:, None]
        sums = [np.add(*(v[:, :, None] if i == 0 else v[:, None, :] for i, v in enumerate(codes.scores(x, t)))) for t in range(cf.TURNS)]
        for k, got in enumerate(codes.decode(x)):
            assert (np.diff(got) > 0).all()
            for t in range(cf.TURNS):
                own = got[got >> 38 == t] & ((1 << 38) - 1)
                assert abs(len(own) - (sums[t][k] >= codes.bound).sum()) <= 1
                assert (sums[t][k].ravel()[own] >= codes.bound - 1e-12).all()


def test_filters_per_vector_stay_few_as_rows_grow():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    for rows in (1000, 50_000, 1_000_000):
        codes = cf.Codes(64, rows, 0.9)
        per_vector = np.mean([len(k) for k in codes.decode(x)])
        assert per_vector < 120
        assert per_vector * rows / codes.words**2 / cf.TURNS < 3 * cf.BUCKET


def test_recall_at_the_least_cosine():
    rng = np.random.default_rng(2)
    codes, met = cf.Codes(64, 50_000, 0.9), []
    for _ in range(400):
        x, y = rng.normal(size=(2, 64))
        x /= np.linalg.norm(x)
        y -= (y @ x) * x
        y = 0.9 * x + math.sqrt(1 - 0.81) * y / np.linalg.norm(y)
        a, b = codes.decode(np.stack([x, y]))
        met.append(bool(np.intersect1d(a, b).size))
    assert np.mean(met) > 0.99


@pytest.mark.parametrize(
    "size,rows",
    [(64, 50_000), (64, 3_000_000), (64, 30_000_000), (16, 50_000), (16, 30_000_000), (12, 1_000_000), (8, 50_000),
     (8, 30_000_000), (5, 1_000_000), (4, 50_000), (3, 30_000_000), (2, 2000), (2, 30_000_000), (1, 50_000)],
)
def test_recall_at_many_rows_and_short_lengths(size, rows):
    rng = np.random.default_rng(size)
    x, y = rng.normal(size=(2, 400, size))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y -= (x * y).sum(axis=1)[:, None] * x
    y = x if size == 1 else 0.9001 * x + math.sqrt(1 - 0.9001**2) * y / np.linalg.norm(y, axis=1)[:, None]
    decoder = cf.Decoder(rows, 0.9, np.float64, 4)
    a, b = (decoder([v.tobytes() for v in vectors]) for vectors in (x, 3 * y))
    met = [bool(np.intersect1d(p, q).size) for p, q in zip(a, b, strict=True)]
    assert np.mean(met) == 1 if size <= cf.SHORT else np.mean(met) > 0.99
    assert all((np.diff(k) > 0).all() for k in (*a, *b))


def test_short_vectors_equal_brute_force(spark):
    rng = np.random.default_rng(9)
    found = [[float(x) for x in rng.normal(size=size)] for size in (1, 2, 3, 4, 8) for _ in range(50)]
    found += [[2.0], [3.0], [-1.0, 0.0], [-2.0, 0.0], [0.0, 0.0, 1e-30]]
    rows = list(enumerate(found))
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = cf.near_vectors(df).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == plain(rows)


@pytest.mark.parametrize("block", [1024, 16])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(cf, "BLOCK", block)
    rng = np.random.default_rng(block)
    found = clusters(rng, 6, 40, 16, 0.2) + clusters(rng, 60, 1, 16, 0) + clusters(rng, 4, 5, 16, 0.35) + clusters(rng, 3, 3, 5, 0.2)
    found += [found[0]] * 30 + [[2 * x for x in found[1]], None, [], [0.0] * 16, [math.nan] + [1.0] * 15, [math.inf] + [1.0] * 15, [None] + [1.0] * 15]
    found += [[1e-30] * 16, [1e30] * 16]
    rows = [(int(i), v) for i, v in zip(rng.permutation(len(found)), found, strict=True)]
    rows += [(None, found[0]), rows[3], rows[3]]
    df = spark.createDataFrame([(i, v, 1, b"") for i, v in rows], "vec_id long, embedding array<float>, id int, raw binary").repartition(6)
    got = cf.near_vectors(df).collect()
    assert sorted([(r.vec_id, r.n_links, r.component_id) for r in got], key=repr) == plain(rows)
    assert all(r.kept == (r.vec_id is None or r.vec_id == r.component_id) for r in got)


def test_double_vectors_and_empty_table(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 1e-9]), (3, [0.0, 1.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id, r.n_links, r.component_id) for r in cf.near_vectors(df).collect()) == [(1, 1, 1), (2, 1, 1), (3, 0, 3)]
    assert cf.near_vectors(df.limit(0)).collect() == []
