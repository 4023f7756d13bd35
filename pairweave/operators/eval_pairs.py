"""Pair classification metrics for any number of score columns in one pass.

Scores go to long form and are counted per (model, score) before anything is
ordered. Scores are taken as they are, so that a threshold found here predicts
what it says; ``digits`` rounds them first, which bounds the number of different
scores. Running counts are cut into ranges of the stored scores, so the windows
stay even whatever scale the scores have.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.operators.ordering import running_totals
from pairweave.session import materialize

# The 18 thresholds 0.10, 0.15 ... 0.95.
SENSITIVITY_THRESHOLDS = tuple((10 + 5 * i) / 100.0 for i in range(18))


def valid_scored_pairs(df: DataFrame, models: Sequence[str], label: str = "label") -> DataFrame:
    """Rows with every score present and a label of 0 or 1, label as int."""
    kept = df.na.drop(subset=list(models)).where(F.col(label).isin(0, 1))
    return kept.withColumn(label, F.col(label).cast("int"))


def label_distribution(df: DataFrame, label: str = "label") -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def threshold_predict(df: DataFrame, score: str, threshold: float = 0.5) -> DataFrame:
    return df.withColumn("prediction", F.when(F.col(score) >= threshold, 1).otherwise(0))


def long_scores(df: DataFrame, models: Sequence[str], label: str = "label") -> DataFrame:
    """``(model, score, label)``; rows stay in place, nothing is shuffled."""
    doubles = df.select(F.col(label).alias("label"), *[F.col(m).cast("double").alias(m) for m in models])
    return doubles.unpivot(["label"], list(models), "model", "score")


def score_units(digits: int) -> Column:
    """The score in units of its last decimal, half away from zero, as a whole number.

    Plain arithmetic: ``round`` goes through a decimal object per row.
    """
    scaled = F.abs(F.col("score")) * float(10**digits) + F.lit(0.5)
    return F.when(F.col("score") < 0, -F.floor(scaled)).otherwise(F.floor(scaled))


def rounded_score(digits: int | None) -> Column:
    """The score at ``digits`` decimals, as it is for None; never minus zero."""
    return F.col("score") + F.lit(0.0) if digits is None else score_units(digits) / float(10**digits)


def score_counts(scores: DataFrame, digits: int | None = None) -> DataFrame:
    """Positives and negatives per (model, score); combined before the shuffle."""
    key = rounded_score(None) if digits is None else score_units(digits)
    counted = scores.groupBy("model", key.alias("key")).agg(
        F.sum(F.col("label").cast("long")).alias("pos"),
        F.sum((1 - F.col("label")).cast("long")).alias("neg"),
    )
    score = F.col("key") if digits is None else F.col("key") / float(10**digits)
    return counted.select("model", score.alias("score"), "pos", "neg")


def cumulative_counts(scores: DataFrame, digits: int | None = None) -> DataFrame:
    """Per threshold (score >= threshold): tp, fp and the class totals P and N.

    The counts are stored in score ranges, one bucket per range, so the pairs
    are read once although running totals take two passes. The result is stored
    as well; every curve and summary below starts from it.
    """
    ranged = score_counts(scores, digits).repartitionByRange("score")
    stored = materialize(ranged.withColumn("bucket", F.spark_partition_id()), "score-counts")
    running = running_totals(
        stored,
        {"tp": "pos", "fp": "neg"},
        [F.desc("score")],
        "bucket",
        ["model"],
        bucket_descending=True,
        grand_totals=True,
    )
    counts = running.select(
        "model", F.col("score").alias("threshold"), "pos", "neg", "tp", "fp",
        F.col("total_tp").alias("P"), F.col("total_fp").alias("N"),
    )
    return materialize(counts, "running-counts")


def rate(a: Column, b: Column) -> Column:
    """a / b, null when b is 0."""
    return F.when(b != 0, a / b)


def roc_curve(counts: DataFrame) -> DataFrame:
    """FPR and TPR per threshold, from the point (inf, 0, 0) on."""
    points = counts.select(
        "model", "threshold",
        rate(F.col("fp"), F.col("N")).alias("fpr"), rate(F.col("tp"), F.col("P")).alias("tpr"),
    )
    start = counts.groupBy("model").agg(F.max("N").alias("N"), F.max("P").alias("P"))
    start = start.select(
        "model", F.lit(float("inf")).alias("threshold"),
        F.when(F.col("N") != 0, 0.0).alias("fpr"), F.when(F.col("P") != 0, 0.0).alias("tpr"),
    )
    return start.unionByName(points)


def pr_curve(counts: DataFrame) -> DataFrame:
    """Precision and recall per threshold, closed by the point (1, 0) without threshold."""
    points = counts.select(
        "model", "threshold",
        rate(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        rate(F.col("tp"), F.col("P")).alias("recall"),
    )
    end = counts.select("model").distinct().select(
        "model", F.lit(None).cast("double").alias("threshold"),
        F.lit(1.0).alias("precision"), F.lit(0.0).alias("recall"),
    )
    return points.unionByName(end)


def wide(c: str | Column) -> Column:
    """Integer wide enough for products of two row counts."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(19,0)")


def curve_summary(counts: DataFrame) -> DataFrame:
    """AUC, average precision and the best threshold of every model.

    The trapezoid area and Youden's J are kept as integers (scaled by P x N), so
    ties and sums do not depend on the order of addition.
    """
    area = F.sum(wide("neg") * wide(2 * F.col("tp") - F.col("pos")))
    youden = wide("tp") * wide("N") - wide("fp") * wide("P")
    best = F.max(F.struct(youden.alias("j"), "threshold", "tp", "fp"))
    summed = counts.groupBy("model").agg(
        F.max("P").alias("P"),
        F.max("N").alias("N"),
        area.alias("area"),
        F.sum(rate(F.col("pos"), F.col("P")) * F.col("tp") / (F.col("tp") + F.col("fp"))).alias("average_precision"),
        best.alias("best"),
    )
    nothing = F.col("best.j") <= 0  # the curve's start beats every threshold
    return summed.select(
        "model", "P", "N",
        rate(F.col("area").cast("double"), 2.0 * F.col("P") * F.col("N")).alias("auc"),
        "average_precision",
        F.when(nothing, F.lit(float("inf"))).otherwise(F.col("best.threshold")).alias("best_threshold"),
        F.when(nothing, F.lit(0)).otherwise(F.col("best.tp")).alias("tp"),
        F.when(nothing, F.lit(0)).otherwise(F.col("best.fp")).alias("fp"),
    )


def youden_threshold(counts: DataFrame) -> DataFrame:
    """Highest threshold with the largest TPR - FPR."""
    s = curve_summary(counts)
    j = rate(F.col("tp"), F.col("P")) - rate(F.col("fp"), F.col("N"))
    return s.select("model", "best_threshold", j.alias("youden_j"))


def confusion_at_best(counts: DataFrame) -> DataFrame:
    """Confusion counts and rates at the best threshold."""
    s = curve_summary(counts)
    tn, fn = F.col("N") - F.col("fp"), F.col("P") - F.col("tp")
    return s.select(
        "model", "best_threshold",
        tn.alias("tn"), "fp", fn.alias("fn"), "tp",
        rate(F.col("tp") + tn, F.col("P") + F.col("N")).alias("accuracy"),
        rate(tn, F.col("N")).alias("specificity"),
        rate(F.col("tp"), F.col("P")).alias("sensitivity"),
        rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn).alias("f1_score"),
    )


def pair_eval_summary(counts: DataFrame) -> DataFrame:
    """One row per model with all headline numbers."""
    s = curve_summary(counts)
    tn, fn = F.col("N") - F.col("fp"), F.col("P") - F.col("tp")
    return s.select(
        "model", "auc", "best_threshold",
        rate(F.col("tp") + tn, F.col("P") + F.col("N")).alias("accuracy"),
        rate(tn, F.col("N")).alias("specificity"),
        rate(F.col("tp"), F.col("P")).alias("sensitivity"),
        rate(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + fn).alias("f1_score"),
        "average_precision",
    )


def threshold_sensitivity(
    scores: DataFrame,
    thresholds: Sequence[float] = SENSITIVITY_THRESHOLDS,
    digits: int | None = None,
) -> DataFrame:
    """Accuracy, precision, recall, specificity and F1 at each threshold.

    One scan: a pair falls in the step given by how many thresholds it reaches,
    and is counted there; only models x (thresholds + 1) rows are shuffled.
    """
    steps = sorted(thresholds)
    score = rounded_score(digits)
    step = sum(((score >= t).cast("int") for t in steps), F.lit(0))
    counted = scores.groupBy("model", step.alias("step")).agg(
        F.sum(F.col("label").cast("long")).alias("pos"),
        F.sum((1 - F.col("label")).cast("long")).alias("neg"),
    )
    grid = F.array(
        *[F.struct(F.lit(t).alias("threshold"), F.lit(i + 1).alias("at_least")) for i, t in enumerate(steps)]
    )
    reached = F.col("step") >= F.col("at_least")
    zero = F.lit(0).cast("long")
    summed = (
        counted.select("*", F.inline(grid))
        .groupBy("model", "threshold")
        .agg(
            F.sum(F.when(reached, F.col("pos")).otherwise(zero)).alias("tp"),
            F.sum(F.when(reached, F.col("neg")).otherwise(zero)).alias("fp"),
            F.sum(F.when(reached, zero).otherwise(F.col("pos"))).alias("fn"),
            F.sum(F.when(reached, zero).otherwise(F.col("neg"))).alias("tn"),
        )
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return summed.select(
        "model", "threshold",
        rate(tp + tn, tp + fp + fn + tn).alias("accuracy"),
        F.coalesce(rate(tp, tp + fp), F.lit(0.0)).alias("precision"),
        rate(tp, tp + fn).alias("recall"),
        rate(tn, tn + fp).alias("specificity"),
        F.coalesce(rate(2 * tp, 2 * tp + fp + fn), F.lit(0.0)).alias("f1_score"),
    )


def threshold_bands(
    counts: DataFrame, sensitivity: DataFrame, min_precision: float, min_recall: float
) -> DataFrame:
    """Suggested thresholds: balanced, high precision and high recall.

    High precision: best recall among thresholds of at least ``min_precision``.
    High recall: best precision among thresholds of at least ``min_recall``.
    Ties take the lower and the higher threshold respectively.
    """
    good_precision = F.when(
        F.col("precision") >= min_precision, F.struct(F.col("recall"), (-F.col("threshold")).alias("t"))
    )
    good_recall = F.when(F.col("recall") >= min_recall, F.struct("precision", F.col("threshold").alias("t")))
    bands = sensitivity.groupBy("model").agg(
        (-F.max(good_precision)["t"]).alias("high_precision"), F.max(good_recall)["t"].alias("high_recall")
    )
    best = youden_threshold(counts).select("model", F.col("best_threshold").alias("balanced"))
    return best.join(bands, "model")
