import pytest
from pyspark.sql import functions as F

from pairweave.operators import eval_retrieval as ev


def table(spark, ranked, approach=None):
    rows = [(q, r + 1, i, 1.0 - r / 10) for q, items in enumerate(ranked) for r, i in enumerate(items)]
    df = spark.createDataFrame(rows, "query_id long, rank int, item_id long, similarity double")
    return df if approach is None else df.withColumn("approach", F.lit(approach))


def global_scores(spark, ranked, labels):
    items = spark.createDataFrame(list(enumerate(labels)), "item_id long, rel int")
    queries = ev.positives_globally(spark.range(len(ranked)).withColumnRenamed("id", "query_id"), items)
    return ev.macro_average(ev.score_queries(queries, ev.judge_globally(table(spark, ranked), items))).first()


LABELS = [1, 0] * 5


@pytest.mark.parametrize(
    "ranked, want",
    [
        ([[0, 2, 4, 6, 8]], (1.0, 1.0, 1.0, 1.0, 1.0)),
        ([[1, 3, 5, 7, 9]], (0.0, 0.0, 0.0, 0.0, 0.0)),
        ([[0, 1, 2, 3, 4]], (0.6, 0.6, 0.6, 1.0, 0.8855)),
        ([[0, 2, 4, 6, 8], [1, 3, 5, 7, 9]], (0.5, 0.5, 0.5, 0.5, 0.5)),
    ],
)
def test_global_labels(spark, ranked, want):
    row = global_scores(spark, ranked, LABELS)
    assert [row[m] for m in ev.METRICS] == pytest.approx(want, abs=1e-4)


def test_two_approaches_with_labels_per_query(spark):
    relevant = {0: [0, 1, 2, 5, 8], 1: [3, 4, 6]}
    qrels = spark.createDataFrame([(q, i, 1) for q, items in relevant.items() for i in items], "query_id long, item_id long, rel int")
    hits = table(spark, [[0, 1, 2, 5, 8]], "first").unionByName(table(spark, [[5, 8, 3, 4, 7]], "second"))
    queries = ev.positives_per_query(spark.range(1).withColumnRenamed("id", "query_id"), qrels)
    queries = ev.with_approaches(queries, ["first", "second"])
    averages = ev.macro_average(ev.score_queries(queries, ev.judge_per_query(hits, qrels), ["approach"]), ["approach"])
    got = {r.approach: r.precision for r in averages.collect()}
    assert got == pytest.approx({"first": 1.0, "second": 0.4})
    compared = {r.metric: r for r in ev.compare_approaches(averages, ["first", "second"]).collect()}
    assert set(compared) == set(ev.METRICS) and compared["precision"].second == pytest.approx(0.4)


def test_query_without_hits_scores_zero(spark):
    items = spark.createDataFrame([(0, 1)], "item_id long, rel int")
    queries = ev.positives_globally(spark.range(2).withColumnRenamed("id", "query_id"), items)
    rows = ev.score_queries(queries, ev.judge_globally(table(spark, [[0]]), items)).orderBy("query_id").collect()
    assert [r.precision for r in rows] == [1.0, 0.0]
    assert all(rows[1][m] == 0.0 for m in ev.METRICS)


def test_no_positives(spark):
    row = global_scores(spark, [[0, 1]], [0, 0, 0])
    assert [row[m] for m in ev.METRICS] == [0.0] * 5


def test_class_relevance_equals_listed_relevance(spark):
    cls = [0, 1, 0, 1, 1, 2]
    q = spark.createDataFrame(list(enumerate(cls)), "query_id long, query_class int")
    i = spark.createDataFrame(list(enumerate(cls)), "item_id long, item_class int")
    hits = table(spark, [[(n + s) % 6 for s in (1, 2, 3)] for n in range(6)])
    pairs = [(a, b, int(cls[a] == cls[b])) for a in range(6) for b in range(6) if a != b]
    qrels = spark.createDataFrame(pairs, "query_id long, item_id long, rel int")
    ids = q.select("query_id")
    by_class = ev.score_queries(ev.positives_by_class(ids, q, i), ev.judge_by_class(hits, q, i))
    listed = ev.score_queries(ev.positives_per_query(ids, qrels), ev.judge_per_query(hits, qrels))
    assert sorted(by_class.collect()) == sorted(listed.select(by_class.columns).collect())


def test_graded_ndcg(spark):
    q = spark.createDataFrame([(0, 5)], "query_id long, query_class int")
    i = spark.createDataFrame([(1, 5), (2, 6), (3, 9), (4, 4)], "item_id long, item_class int")
    judged = ev.judge_by_class(table(spark, [[3, 2, 1]]), q, i, ev.graded_by_distance())
    assert [r.rel for r in judged.orderBy("rank").collect()] == [0, 2, 3]
    row = ev.score_queries(ev.positives_by_class(q.select("query_id"), q, i, 2, False), judged).first()
    dcg, ideal = 2 / 1.584963 + 3 / 2.0, 3 / 1.0 + 2 / 1.584963
    assert row.positives == 3 and row.ndcg == pytest.approx(dcg / ideal, abs=1e-5)


def test_hits_verdicts_and_sweep(spark):
    queries = spark.createDataFrame([(0, 0, 1), (1, 1, 1), (2, 2, 0)], "query_id long, partner_id long, label int")
    hits = table(spark, [[5, 0, 6], [7, 8, 9], [2, 1, 0]])
    rates = ev.hit_rates(ev.hits_at(queries, hits)).first()
    assert rates.top_1_accuracy == 0 and rates.top_3_accuracy == pytest.approx(1 / 3)
    labels = spark.createDataFrame([(0, 1), (9, 0)], "item_id long, rel int")
    verdicts = ev.query_verdicts(queries, ev.judge_globally(hits, labels))
    assert {r.query_id: r.verdict for r in verdicts.collect()} == {0: "success", 1: "error", 2: "success"}
    assert ev.verdict_summary(verdicts).first().recall == pytest.approx(0.5)
    judged = ev.judge_globally(hits, labels)
    sized = queries.withColumn("positives", F.lit(1))
    swept = ev.topk_threshold_sweep(sized, judged, (1, 3), (0.85, 0.95)).collect()
    got = {(r.k, r.threshold): (r.retrieved, r.found) for r in swept}
    assert got == {(1, 0.85): (3, 0), (1, 0.95): (3, 0), (3, 0.85): (6, 1), (3, 0.95): (3, 0)}


def test_timing(spark):
    log = spark.createDataFrame(
        [("a", "index", 2.0), ("a", "retrieve", 0.5), ("a", "retrieve", 1.5), ("b", "retrieve", 3.0)],
        "approach string, phase string, seconds double",
    )
    got = {r.approach: (r.indexing_time, r.avg_retrieval_time, r.queries) for r in ev.approach_timing(log).collect()}
    assert got == {"a": (2.0, 1.0, 2), "b": (0.0, 3.0, 1)}
