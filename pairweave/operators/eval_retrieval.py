"""Retrieval metrics as one grouped pass over judged hits.

Long form everywhere: hits ``(approach?, query_id, rank, item_id, similarity)``
get a ``rel`` column, a query table gives the denominators, and a query without
hits scores 0 because the query table is on the outer side of the join. The
arrays built below hold the hits of one query, at most k entries.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = ("precision", "recall", "f1", "mrr", "ndcg")


def judge_per_query(hits: DataFrame, qrels: DataFrame) -> DataFrame:
    """Relevance by (query, item); unjudged hits count 0."""
    judged = hits.join(qrels.select("query_id", "item_id", "rel"), ["query_id", "item_id"], "left")
    return judged.withColumn("rel", F.coalesce("rel", F.lit(0)))


def judge_globally(hits: DataFrame, item_rel: DataFrame) -> DataFrame:
    """Relevance by item, the same for every query."""
    judged = hits.join(item_rel.select("item_id", "rel"), "item_id", "left")
    return judged.withColumn("rel", F.coalesce("rel", F.lit(0)))


def judge_by_class(
    hits: DataFrame, query_class: DataFrame, item_class: DataFrame, rel: Column | None = None
) -> DataFrame:
    """Relevance as a function of the two classes; equal classes give 1.

    No list of relevant pairs is built, which would grow with the square of a class.
    """
    joined = hits.join(query_class.select("query_id", "query_class"), "query_id", "left").join(
        item_class.select("item_id", "item_class"), "item_id", "left"
    )
    rel = F.when(F.col("query_class") == F.col("item_class"), 1).otherwise(0) if rel is None else rel
    return joined.withColumn("rel", rel).drop("query_class", "item_class")


def graded_by_distance() -> Column:
    """Grades 3..0 by the distance of two numeric classes."""
    gap = F.abs(F.col("query_class") - F.col("item_class"))
    return F.greatest(F.lit(0), F.lit(3) - gap)


def positives_per_query(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """Queries with the number of their relevant items."""
    counts = qrels.where(F.col("rel") > 0).groupBy("query_id").agg(F.count(F.lit(1)).alias("positives"))
    return queries.join(counts, "query_id", "left").withColumn("positives", F.coalesce("positives", F.lit(0)))


def positives_globally(queries: DataFrame, item_rel: DataFrame) -> DataFrame:
    counted = item_rel.agg(F.count_if(F.col("rel") > 0).alias("positives"))
    return queries.withColumn("positives", counted.scalar())


def positives_by_class(
    queries: DataFrame, query_class: DataFrame, item_class: DataFrame, reach: int = 0, minus_self: bool = True
) -> DataFrame:
    """Number of items whose class is within ``reach`` of the query's class.

    Class sizes are aggregated first; the join carries one row per class.
    """
    sizes = item_class.groupBy("item_class").agg(F.count(F.lit(1)).alias("n"))
    if reach:
        near = sizes.withColumn(
            "query_class", F.explode(F.sequence(F.col("item_class") - reach, F.col("item_class") + reach))
        )
        sizes = near.groupBy("query_class").agg(F.sum("n").alias("n"))
    else:
        sizes = sizes.withColumnRenamed("item_class", "query_class")
    own = 1 if minus_self else 0
    counted = query_class.select("query_id", "query_class").join(sizes, "query_class", "left")
    counted = counted.select("query_id", (F.coalesce("n", F.lit(own)) - own).alias("positives"))
    return queries.join(counted, "query_id", "left").withColumn("positives", F.coalesce("positives", F.lit(0)))


def ideal_dcg(grades: Column, k: int) -> Column:
    """Largest DCG of k places from an array of ``(rel, n)``: how many items have which grade.

    Items are not listed: n items of a grade fill n places in a row, and what the
    places up to each are worth is a table of k + 1 numbers.
    """
    worth = [0.0]
    for place in range(1, k + 1):
        worth.append(worth[-1] + 1 / math.log2(place + 1))
    up_to = lambda n: F.element_at(F.array(*[F.lit(w) for w in worth]), F.least(n, F.lit(k)).cast("int") + 1)
    start = F.struct(F.lit(0).cast("long").alias("place"), F.lit(0.0).alias("dcg"))

    def fill(acc: Column, g: Column) -> Column:
        end = acc["place"] + g["n"]
        return F.struct(
            end.alias("place"), (acc["dcg"] + g["rel"] * (up_to(end) - up_to(acc["place"]))).alias("dcg")
        )

    return F.aggregate(F.sort_array(grades, asc=False), start, fill, lambda acc: acc["dcg"])


def _graded(counts: DataFrame, key: str, k: int) -> DataFrame:
    grades = F.collect_list(F.struct(F.col("rel").cast("double").alias("rel"), F.col("n").cast("long").alias("n")))
    return counts.where("rel > 0 and n > 0").groupBy(key).agg(ideal_dcg(grades, k).alias("ideal_dcg"))


def ideal_per_query(queries: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Queries with the ``ideal_dcg`` of all their judged items; grades are counted, items never listed."""
    counts = qrels.groupBy("query_id", "rel").agg(F.count(F.lit(1)).alias("n"))
    return queries.join(_graded(counts, "query_id", k), "query_id", "left").fillna(0.0, ["ideal_dcg"])


def ideal_by_class(
    queries: DataFrame,
    query_class: DataFrame,
    item_class: DataFrame,
    rel: Column,
    k: int,
    reach: int = 0,
    minus_self: bool = True,
) -> DataFrame:
    """Queries with the ``ideal_dcg`` of the whole corpus under relevance by class.

    ``rel`` is a function of ``query_class`` and ``item_class`` that is 0 beyond
    ``reach``. Only class sizes are joined, and every query of a class has one ideal.
    """
    sizes = item_class.groupBy("item_class").agg(F.count(F.lit(1)).alias("n"))
    near = F.sequence(F.col("item_class") - reach, F.col("item_class") + reach) if reach else F.array("item_class")
    pairs = sizes.withColumn("query_class", F.explode(near)).withColumn("rel", rel)
    own = F.when(F.col("query_class") == F.col("item_class"), F.lit(int(minus_self))).otherwise(F.lit(0))
    ideals = _graded(pairs.select("query_class", "rel", (F.col("n") - own).alias("n")), "query_class", k)
    known = query_class.select("query_id", "query_class").join(ideals, "query_class").select("query_id", "ideal_dcg")
    return queries.join(known, "query_id", "left").fillna(0.0, ["ideal_dcg"])


def with_approaches(queries: DataFrame, approaches: Sequence[str]) -> DataFrame:
    """One row per query and approach name."""
    return queries.withColumn("approach", F.explode(F.array(*[F.lit(a) for a in approaches])))


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 when b is 0."""
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def discounted(rels: Column) -> Column:
    """Sum of rel / log2(place + 1) over an ordered array."""
    gains = F.transform(rels, lambda r, i: r / F.log2(i + F.lit(2.0)))
    return F.aggregate(gains, F.lit(0.0), lambda acc, g: acc + g)


def score_queries(queries: DataFrame, judged: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Precision, recall, F1, reciprocal rank and NDCG of every query.

    ``queries`` has ``query_id``, ``positives`` and the ``by`` columns. An item
    counts as relevant when ``rel > 0``; NDCG uses the grade itself. Its ideal
    order is that of the retrieved items, or ``ideal_dcg`` of ``queries`` if that
    column is there (``ideal_by_class``, ``ideal_per_query``).
    """
    keys = [*by, "query_id"]
    per_query = judged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("retrieved"),
        F.count_if(F.col("rel") > 0).alias("found"),
        F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("first_found"),
        F.array_sort(F.collect_list(F.struct("rank", "rel"))).alias("hits"),
    )
    joined = queries.join(per_query, keys, "left")
    rels = F.transform(F.coalesce("hits", F.array().cast("array<struct<rank:int,rel:int>>")), lambda h: h["rel"])
    found = F.coalesce("found", F.lit(0))
    scored = joined.withColumn("precision", ratio(found, F.coalesce("retrieved", F.lit(0)))).withColumn(
        "recall", ratio(found, F.col("positives"))
    )
    p, r = F.col("precision"), F.col("recall")
    of_corpus = "ideal_dcg" in queries.columns
    ideal = F.col("ideal_dcg") if of_corpus else discounted(F.sort_array(rels, asc=False))
    return (
        scored.withColumn("f1", ratio(2 * p * r, p + r))
        .withColumn("mrr", F.coalesce(F.lit(1.0) / F.col("first_found"), F.lit(0.0)))
        .withColumn("ndcg", ratio(discounted(rels), ideal))
        .withColumn("retrieved", F.coalesce("retrieved", F.lit(0)))
        .drop("hits", "found", "first_found")
    )


def macro_average(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean of each metric over the queries."""
    return scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("queries"), *[F.avg(m).alias(m) for m in METRICS]
    )


def compare_approaches(averages: DataFrame, approaches: Sequence[str]) -> DataFrame:
    """One row per metric, one column per approach."""
    long = averages.unpivot(["approach"], list(METRICS), "metric", "value")
    return long.groupBy("metric").pivot("approach", list(approaches)).agg(F.first("value"))


def hits_at(queries: DataFrame, hits: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    """Per query: own partner, of a pair labelled 1, among the first k.

    ``queries``: ``(query_id, partner_id, label)``.
    """
    own = hits.select("query_id", F.col("item_id").alias("partner_id"), "rank")
    joined = queries.where(F.col("label") == 1).join(own, ["query_id", "partner_id"])
    best = joined.groupBy("query_id").agg(F.min("rank").alias("best"))
    return queries.join(best, "query_id", "left").select(
        "query_id",
        "label",
        *[F.coalesce((F.col("best") <= k).cast("int"), F.lit(0)).alias(f"hit_{k}") for k in ks],
    )


def hit_rates(per_query: DataFrame, ks: Sequence[int] = (1, 3, 5)) -> DataFrame:
    return per_query.agg(
        F.count(F.lit(1)).alias("queries"), *[F.avg(f"hit_{k}").alias(f"top_{k}_accuracy") for k in ks]
    )


def query_verdicts(queries: DataFrame, judged: DataFrame) -> DataFrame:
    """success / true_negative / error per query.

    Success: a retrieved item is labelled true. True negative: none is and the
    query's own pair is labelled false.
    """
    best = judged.groupBy("query_id").agg(F.max("rel").alias("best"))
    joined = queries.join(best, "query_id", "left")
    verdict = (
        F.when(F.col("best") > 0, "success").when(F.col("label") == 0, "true_negative").otherwise("error")
    )
    return joined.withColumn("verdict", verdict).drop("best")


def verdict_summary(verdicts: DataFrame) -> DataFrame:
    success = F.col("verdict") == "success"
    positive = F.col("label") == 1
    return verdicts.agg(
        F.count(F.lit(1)).alias("queries"),
        F.count_if(success).alias("successes"),
        F.count_if(F.col("verdict") == "true_negative").alias("true_negatives"),
        F.count_if(F.col("verdict") == "error").alias("errors"),
        F.avg((F.col("verdict") != "error").cast("int")).alias("accuracy"),
        ratio(F.count_if(success & positive), F.count_if(positive)).alias("recall"),
    )


def topk_threshold_sweep(
    queries: DataFrame, judged: DataFrame, ks: Sequence[int], thresholds: Sequence[float]
) -> DataFrame:
    """Quality for every (k, similarity threshold) of a small grid, in one aggregation.

    Hits are first reduced to counts per (rank, threshold step); the grid is
    then applied to that table, which has at most max(k) x steps rows.
    """
    steps = sorted(thresholds)
    step = sum(((F.col("similarity") >= t).cast("int") for t in steps), F.lit(0))
    counted = (
        judged.where(F.col("rank") <= max(ks))
        .groupBy("rank", step.alias("step"))
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("rel") > 0).alias("n_found"))
    )
    grid = F.array(
        *[
            F.struct(F.lit(k).alias("k"), F.lit(t).alias("threshold"), F.lit(i + 1).alias("at_least"))
            for k in ks
            for i, t in enumerate(steps)
        ]
    )
    cells = counted.select("*", F.inline(grid))
    inside = (F.col("rank") <= F.col("k")) & (F.col("step") >= F.col("at_least"))
    summed = cells.groupBy("k", "threshold").agg(
        F.coalesce(F.sum(F.when(inside, F.col("n"))), F.lit(0)).alias("retrieved"),
        F.coalesce(F.sum(F.when(inside, F.col("n_found"))), F.lit(0)).alias("found"),
    )
    totals = queries.agg(F.sum("positives").alias("positives"))
    with_total = summed.withColumn("positives", totals.scalar())
    return with_total.select(
        "k",
        "threshold",
        "retrieved",
        "found",
        ratio(F.col("found"), F.col("retrieved")).alias("precision"),
        ratio(F.col("found"), F.col("positives")).alias("recall"),
    )


def approach_timing(run_log: DataFrame) -> DataFrame:
    """Index time and mean retrieval time per approach.

    ``run_log``: ``(approach, phase, seconds)``, phase ``index`` or ``retrieve``.
    """
    return run_log.groupBy("approach").agg(
        F.coalesce(F.sum(F.when(F.col("phase") == "index", F.col("seconds"))), F.lit(0.0)).alias("indexing_time"),
        F.avg(F.when(F.col("phase") == "retrieve", F.col("seconds"))).alias("avg_retrieval_time"),
        F.count_if(F.col("phase") == "retrieve").alias("queries"),
    )
