import numpy as np
import pytest
from pyspark.sql import functions as F

from pairweave.operators.index import build_index, hit_places, index_topk, load_index, probes_for, recall_against
from pairweave.operators.projections import build_projections, probe_order, projection_probes_for, projection_topk
from pairweave.operators import index, retrieve
from pairweave.operators.retrieve import block_candidates, cut, exact_topk, grid_parts, running_best, similarity_to_vector, with_text
from pairweave.plans import bindings as B


def brute(m, k, metric="cosine", exclude_self=True):
    s = m @ m.T
    if metric == "cosine":
        n = np.linalg.norm(m, axis=1)
        scale = np.outer(n, n)
        s = np.where(scale == 0, 0.0, s / np.where(scale == 0, 1, scale))
    s = np.round(s, 12)
    rows = []
    for q in range(len(m)):
        items = [i for i in range(len(m)) if not (exclude_self and i == q)]
        best = sorted(items, key=lambda i: (-s[q, i], i))[:k]
        rows += [(q, r + 1, i, s[q, i]) for r, i in enumerate(best)]
    return rows


def rows_of(df):
    return sorted((r.query_id, r["rank"], r.item_id, r.similarity) for r in df.collect())


def same(got, want):
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert [g[3] for g in got] == pytest.approx([w[3] for w in want], abs=1e-9)


@pytest.mark.parametrize("metric", ["cosine", "dot"])
@pytest.mark.parametrize("strategy", ["broadcast", "grid"])
@pytest.mark.parametrize("k", [1, 5, 100])
def test_matches_brute_force_with_ties(vectors, metric, strategy, k):
    m, df = vectors
    got = rows_of(exact_topk(df, df, k, metric=metric, strategy=strategy, block_rows=9))
    same(got, sorted(brute(m, k, metric)))


def test_self_is_kept_for_two_tables(vectors):
    m, df = vectors
    got = rows_of(exact_topk(df, df.select("vec_id", "embedding"), 3))
    same(got, sorted(brute(m, 3, exclude_self=False)))


def test_auto_takes_the_grid_beyond_the_size_limit(vectors):
    m, df = vectors
    auto = exact_topk(df, df, 4, broadcast_bytes=100, block_rows=16)
    assert "FlatMapCoGroups" in auto._jdf.queryExecution().toString()
    same(rows_of(auto), sorted(brute(m, 4)))
    with pytest.raises(ValueError):
        exact_topk(df, df, 4, strategy="broadcast", broadcast_bytes=100)


def test_k_zero_negative_and_bad_arguments(vectors):
    _, df = vectors
    assert exact_topk(df, df, 0).count() == 0
    for bad in ({"k": -1}, {"metric": "l1"}, {"strategy": "magic"}):
        with pytest.raises(ValueError):
            exact_topk(df, df, **bad)


def test_null_vectors_are_skipped_and_ragged_ones_refused(spark, vectors):
    m, df = vectors
    extra = spark.createDataFrame([(99, None, 0)], df.schema)
    same(rows_of(exact_topk(df, df.union(extra), 2, exclude_self=True)), sorted(brute(m, 2)))
    ragged = spark.createDataFrame([(99, [1.0], 0)], df.schema)
    with pytest.raises(Exception, match="differ"):
        exact_topk(df, df.union(ragged).coalesce(1), 2).collect()


def test_block_candidates_keep_every_tie():
    queries, items = np.array([[1.0]]), np.ones((50, 1))
    rows, ids, scores = block_candidates(queries, np.array([0]), items, np.arange(50)[::-1], 3, False)
    assert len(ids) == 50
    assert list(cut(rows, ids, scores, 3)[1]) == [0, 1, 2]


def test_index_probing_all_cells_is_exact(spark, vectors, tmp_path):
    m, df = vectors
    index = build_index(df, cells=4, path=str(tmp_path / "index"))
    again = load_index(spark, str(tmp_path / "index"))
    for ix in (index, again):
        got = rows_of(index_topk(df, ix, 5, probes=4, exclude_self=True, block_rows=6))
        same(got, sorted(brute(m, 5)))


def test_index_is_a_subset_with_measured_recall(vectors):
    _, df = vectors
    index = build_index(df, cells=4)
    near = index_topk(df, index, 5, probes=2, exclude_self=True)
    exact = exact_topk(df, df, 5)
    row = recall_against(near, exact).first()
    assert row.exact_hits == 200 and 0.3 < row.recall <= 1.0  # two cells of four: nothing is promised here
    assert near.groupBy("query_id").count().where("count > 5").count() == 0


def test_probes_reach_the_wanted_recall(vectors):
    _, df = vectors
    index, exact = build_index(df, cells=8), exact_topk(df, df, 5)

    def recall(probes):
        return recall_against(index_topk(df, index, 5, probes, exclude_self=True), exact).first().recall

    probes = probes_for(df, index, 5, 0.9, exclude_self=True)
    assert recall(probes) >= 0.9 and (probes == 1 or recall(probes - 1) < 0.9)
    assert probes_for(df.limit(0), index, 5, 0.9) == 1


def test_trained_index_query_finds_most_true_neighbours(spark):
    sf_dir = "/root/testdata/sf0.001"
    row = recall_against(B.trained_index_hits(spark, sf_dir), B.hits(spark, sf_dir)).first()
    assert row.exact_hits == 2500 and row.recall >= 0.9


def test_vector_against_many_and_text(spark, vectors):
    m, df = vectors
    got = {r.vec_id: r.similarity for r in similarity_to_vector(df, [1.0] * 8, metric="dot").collect()}
    assert [got[i] for i in range(40)] == pytest.approx(list(m.sum(1)))
    texts = spark.createDataFrame([(1, "one")], "doc long, text string")
    hits = exact_topk(df, df, 2)
    attached = with_text(hits, texts, "doc")
    assert attached.count() == hits.count()
    assert {r.sentence for r in attached.collect() if r.item_id == 1} <= {"one"}


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_index_walks_until_k_items(spark, vectors, limit):
    """Tiny cells, given centroids, few probes: every query still gets min(k, n - 1) hits, the same in both forms."""
    matrix, df = vectors
    centers = spark.createDataFrame([(i * 3, [float(x) for x in matrix[i]]) for i in range(0, 40, 2) if matrix[i].any()], "cell int, vector array<double>")
    index = build_index(df, centroids=centers, broadcast_bytes=limit)
    for k in (1, 7, 50):
        rows = index_topk(df, index, k, probes=1, exclude_self=True, broadcast_bytes=limit).collect()
        for i in range(40):
            assert sorted(r.rank for r in rows if r.query_id == i) == list(range(1, min(k, 39) + 1))
    everything = index_topk(df, index, 5, probes=40, exclude_self=True, broadcast_bytes=limit)
    assert rows_of(everything) == rows_of(exact_topk(df, df, 5, exclude_self=True))


@pytest.mark.parametrize("sf", ["0.001", "0.01"])
def test_index_queries_find_nine_in_ten(spark, sf):
    sf_dir = f"/root/testdata/sf{sf}"
    exact = B.hits(spark, sf_dir)
    for near in (B.class_index_hits(spark, sf_dir), B.projection_hits(spark, sf_dir)):
        assert recall_against(near, exact).first().recall >= 0.9


def test_places_of_hits_in_parts_and_whole(vectors):
    _, df = vectors
    index, exact = build_index(df, cells=8), exact_topk(df, df, 5)
    asked = df.selectExpr("vec_id as query_id", "embedding as vector")
    whole = sorted(map(tuple, hit_places(exact, asked, index, 6).collect()))
    assert whole == sorted(map(tuple, hit_places(exact, asked, index, 6, broadcast_bytes=200).collect()))
    assert len(whole) == 200 and min(w[2] for w in whole) == 1


@pytest.mark.parametrize("block_rows", [3, 1000])
def test_projections_with_all_buckets_are_exact(vectors, block_rows):
    matrix, df = vectors
    able = df.where("vec_id <> 5")
    index = build_projections(able, tables=2, bits=3)
    got = projection_topk(able, index, 5, probes=99, exclude_self=True, block_rows=block_rows)
    assert rows_of(got) == rows_of(exact_topk(able, able, 5, exclude_self=True))
    assert projection_topk(able.limit(0), index, 5).count() == 0
    assert build_projections(df.limit(0)).n_items == 0


def test_probe_order_is_by_cost():
    away = np.random.default_rng(2).normal(size=(7, 3, 5))
    order = probe_order(away, 5)
    cost = lambda a, m: sum(x * x for i, x in enumerate(a) if m >> i & 1)
    for row, mask in np.ndindex(7, 3):
        assert order[row, mask].tolist() == sorted(range(32), key=lambda m: cost(away[row, mask], m))


def test_projection_probes_reach_the_wanted_recall(spark):
    df = B.busy_table(spark, "/root/testdata/sf0.001", "embeddings", "vec_id", "embedding")
    index, exact = build_projections(df, tables=4), exact_topk(df, df, 5)
    probes = projection_probes_for(df, index, df, 5, 0.9, exclude_self=True)
    recall = lambda p: recall_against(projection_topk(df, index, 5, p, exclude_self=True), exact).first().recall
    assert recall(probes) >= 0.9 and (probes == 1 or recall(probes - 1) < 0.9)


def test_grid_parts_copy_little_and_hold_little():
    assert grid_parts(600_000, 600_000, 65_536, 256, 32) == (10, 10)  # bounded by memory
    a, b = grid_parts(100_000, 100_000, 65_536, 256, 32)
    assert a * b >= 32 and a + b <= 12  # blocks of 256 rows copied either side 391 times
    assert grid_parts(300, 300, 65_536, 256, 32) == (1, 1)


def test_running_best_holds_k_of_many_ties():
    queries, items = np.ones((2, 3)), np.ones((5_000, 3))
    blocks = ((np.arange(5_000)[::-1][i : i + 500], items[i : i + 500]) for i in range(0, 5_000, 500))
    rows, ids, _ = running_best(queries, np.array([7, 8]), blocks, 3, False)
    assert rows.tolist() == [0, 0, 0, 1, 1, 1] and ids.tolist() == [0, 1, 2] * 2


def test_distinct_scores_equal_vectors_once(spark, monkeypatch):
    rng = np.random.default_rng(3)
    few = rng.standard_normal((6, 4)).round(3)
    df = spark.createDataFrame([(i, few[i * i % 6].tolist()) for i in range(60)], "vec_id long, embedding array<double>")
    plain = rows_of(exact_topk(df, df, 12, exclude_self=False))
    sizes = []
    scan = retrieve.scan_topk
    monkeypatch.setattr(retrieve, "scan_topk", lambda q, i, *a: (sizes.append((q.count(), i.count())), scan(q, i, *a))[1])
    assert rows_of(exact_topk(df, df, 12, exclude_self=False, distinct=True)) == plain
    assert sizes == [(4, 4)]
    twice = df.unionByName(df.withColumn("embedding", F.reverse("embedding")))  # ids do not tell vectors apart
    assert rows_of(exact_topk(twice, df, 3, exclude_self=False, distinct=True)) == rows_of(exact_topk(twice, df, 3, exclude_self=False))


def test_candidates_held_at_once_do_not_grow_with_the_queries(monkeypatch):
    held, plain = [], retrieve.cut
    monkeypatch.setattr(retrieve, "cut", lambda rows, *a: (held.append(len(rows)), plain(rows, *a))[1])
    for n in (1_000, 4_000):  # every score a tie: n x 200 candidates
        retrieve.running_best(np.ones((n, 2)), np.arange(n), iter([(np.arange(200), np.ones((200, 2)))]), 3, False)
        assert max(held) <= retrieve.QUERIES_AT_ONCE * 200


def test_small_blocks_do_not_multiply_the_rows_of_cells(spark, monkeypatch):
    m = np.random.default_rng(5).standard_normal((400, 4))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    given = spark.createDataFrame([(0, m[0].tolist()), (1, m[1].tolist())], "cell int, vector array<double>")
    seen, plain = spark.sparkContext.accumulator(0), index.cell_kernel

    def counting(*args):
        kernel = plain(*args)

        def run(left, right):
            seen.add(left.num_rows + right.num_rows)
            return kernel(left, right)

        return run

    monkeypatch.setattr(index, "cell_kernel", counting)
    got = rows_of(index_topk(df, build_index(df, centroids=given), 5, probes=2, exclude_self=True, block_rows=6))
    same(got, brute(m, 5))
    assert 0 < seen.value < 20_000  # 54 000 in blocks of 6
