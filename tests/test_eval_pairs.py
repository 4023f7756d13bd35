import numpy as np
import pytest
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import functions as F

from pairweave.operators import eval_pairs as ep


@pytest.fixture(scope="module")
def scored(spark):
    rng = np.random.default_rng(5)
    label = rng.integers(0, 2, 300)
    a = np.round(np.clip(0.3 * label + rng.normal(0.3, 0.2, 300), 0, 1), 2)
    b = np.round(rng.uniform(-1, 1, 300), 6)
    rows = [(i, float(a[i]), float(b[i]), int(label[i])) for i in range(300)]
    return a, b, label, spark.createDataFrame(rows, "id long, a double, b double, label int").repartition(4)


@pytest.fixture(scope="module")
def counts(scored):
    return ep.cumulative_counts(ep.long_scores(scored[3], ["a", "b"]))


def curve(score, label):
    ts = np.unique(score)[::-1]
    tp = np.array([(label[score >= t] == 1).sum() for t in ts])
    fp = np.array([(label[score >= t] == 0).sum() for t in ts])
    return ts, tp, fp


def test_curves_match_numpy(scored, counts):
    a, b, label, _ = scored
    for model, score in (("a", a), ("b", b)):
        ts, tp, fp = curve(score, label)
        P, N = (label == 1).sum(), (label == 0).sum()
        roc = ep.roc_curve(counts).where(F.col("model") == model).orderBy(F.desc("threshold")).collect()
        assert (roc[0].threshold, roc[0].fpr, roc[0].tpr) == (float("inf"), 0.0, 0.0)
        assert [r.threshold for r in roc[1:]] == pytest.approx(list(ts))
        assert [r.fpr for r in roc[1:]] == pytest.approx(list(fp / N))
        assert [r.tpr for r in roc[1:]] == pytest.approx(list(tp / P))
        pr = ep.pr_curve(counts).where(F.col("model") == model).orderBy(F.desc_nulls_last("threshold")).collect()
        assert [r.precision for r in pr[:-1]] == pytest.approx(list(tp / (tp + fp)))
        assert (pr[-1].threshold, pr[-1].precision, pr[-1].recall) == (None, 1.0, 0.0)
        s = ep.pair_eval_summary(counts).where(F.col("model") == model).first()
        x, y = np.r_[0, fp / N], np.r_[0, tp / P]
        assert s.auc == pytest.approx(np.trapezoid(y, x))
        assert s.average_precision == pytest.approx((np.diff(y) * tp / (tp + fp)).sum())
        j = np.r_[0, tp * N - fp * P]
        best = int(np.argmax(j))
        assert s.best_threshold == np.r_[np.inf, ts][best]
        tpb, fpb = np.r_[0, tp][best], np.r_[0, fp][best]
        assert s.accuracy == pytest.approx((tpb + N - fpb) / (P + N))
        assert s.specificity == pytest.approx((N - fpb) / N) and s.sensitivity == pytest.approx(tpb / P)
        assert s.f1_score == pytest.approx(2 * tpb / (tpb + fpb + P))
        c = ep.confusion_at_best(counts).where(F.col("model") == model).first()
        assert (c.tn, c.fp, c.fn, c.tp) == (N - fpb, fpb, P - tpb, tpb)


def test_auc_equals_mllib(scored, counts):
    got = {r.model: r.auc for r in ep.curve_summary(counts).collect()}
    for model in ("a", "b"):
        judge = BinaryClassificationEvaluator(rawPredictionCol=model, labelCol="label", numBins=0)
        assert got[model] == pytest.approx(judge.evaluate(scored[3]), abs=1e-9)


def test_unrounded_scores(spark, scored):
    fine = scored[3].withColumn("a", F.col("a") / 3 + F.col("id") * 1e-12)
    exact = ep.cumulative_counts(ep.long_scores(fine, ["a"]), digits=None)
    assert exact.count() == 300
    rows = exact.orderBy(F.desc("threshold")).collect()
    assert [r.tp + r.fp for r in rows] == list(range(1, 301))


def test_one_class_gives_null_rates(spark):
    df = spark.createDataFrame([(0.2, 1), (0.4, 1)], "m double, label int")
    c = ep.cumulative_counts(ep.long_scores(df, ["m"]))
    s = ep.pair_eval_summary(c).first()
    assert s.auc is None and s.specificity is None
    assert {r.fpr for r in ep.roc_curve(c).collect()} == {None}


def test_all_scores_wrong_way_keeps_start_point(spark):
    df = spark.createDataFrame([(0.9, 0), (0.1, 1)], "m double, label int")
    row = ep.youden_threshold(ep.cumulative_counts(ep.long_scores(df, ["m"]))).first()
    assert row.best_threshold == float("inf") and row.youden_j == 0.0


def test_sensitivity_matches_numpy(scored):
    a, _, label, df = scored
    rows = ep.threshold_sensitivity(ep.long_scores(df, ["a"])).orderBy("threshold").collect()
    assert [r.threshold for r in rows] == [(10 + 5 * i) / 100 for i in range(18)]
    for r in rows:
        pred = (a >= r.threshold).astype(int)
        tp, fp = ((pred == 1) & (label == 1)).sum(), ((pred == 1) & (label == 0)).sum()
        tn, fn = ((pred == 0) & (label == 0)).sum(), ((pred == 0) & (label == 1)).sum()
        want = [(tp + tn) / 300, tp / (tp + fp) if tp + fp else 0, tp / (tp + fn), tn / (tn + fp)]
        assert [r.accuracy, r.precision, r.recall, r.specificity] == pytest.approx(want)
        assert r.f1_score == pytest.approx(2 * tp / (2 * tp + fp + fn) if tp else 0)


def test_bands(spark, counts, scored):
    sens = ep.threshold_sensitivity(ep.long_scores(scored[3], ["a", "b"]))
    rows = {(r.model, r.threshold): r for r in sens.collect()}
    for r in ep.threshold_bands(counts, sens, 0.7, 0.8).collect():
        good = [k[1] for k, v in rows.items() if k[0] == r.model and v.precision >= 0.7]
        best = max(rows[r.model, t].recall for t in good) if good else None
        assert r.high_precision == (min(t for t in good if rows[r.model, t].recall == best) if good else None)
        wide = [k[1] for k, v in rows.items() if k[0] == r.model and v.recall >= 0.8]
        top = max(rows[r.model, t].precision for t in wide) if wide else None
        assert r.high_recall == (max(t for t in wide if rows[r.model, t].precision == top) if wide else None)


def test_valid_rows_and_predictions(spark):
    df = spark.createDataFrame(
        [(1, 0.5, 0.4, 1.0), (2, None, 0.4, 0.0), (3, 0.1, 0.2, 2.0), (4, 0.1, 0.2, None), (5, 0.6, 0.7, 0.0)],
        "id long, x double, y double, label double",
    )
    valid = ep.valid_scored_pairs(df, ["x", "y"])
    assert [(r.id, r.label) for r in valid.orderBy("id").collect()] == [(1, 1), (5, 0)]
    assert dict(ep.label_distribution(valid).collect()) == {0: 1, 1: 1}
    assert [r.prediction for r in ep.threshold_predict(valid, "x").orderBy("id").collect()] == [1, 1]


def test_best_threshold_predicts_what_it_says(spark):
    """Raw scores: the confusion counts at the best threshold are those of predicting with it."""
    rows = [(0.8151236, 1), (0.8151234, 0), (0.4, 0), (0.81512365, 1), (12.5, 0), (-3.0, 0)]
    df = spark.createDataFrame(rows, "m double, label int")
    best = ep.confusion_at_best(ep.cumulative_counts(ep.long_scores(df, ["m"]))).first()
    predicted = ep.threshold_predict(df, "m", best.best_threshold)
    assert predicted.where("prediction = 1 and label = 1").count() == best.tp == 2
    assert predicted.where("prediction = 1 and label = 0").count() == best.fp == 1
