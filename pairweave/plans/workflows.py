"""The three jobs a user runs end to end: retrieval, pair scoring, pair evaluation.

Each stage that several later stages read is stored in the shared folder; the
driver only sees a few rows of timing.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairweave.operators import eval_pairs
from pairweave.operators import eval_retrieval as ev
from pairweave.operators.embed import Embedder, embed_column
from pairweave.operators.index import build_index, index_topk, probes_for
from pairweave.operators.models import Predict, score_models
from pairweave.operators.quality import sample_rows
from pairweave.operators.rerank import rerank
from pairweave.operators.retrieve import exact_topk, with_text
from pairweave.schemas import SCORE_COLUMNS, require_columns
from pairweave.session import materialize, own, work_path
from pairweave.sources.results import save_summary
from pairweave.streaming.scoring import score_new_files


@dataclass(frozen=True)
class Approach:
    """How one approach retrieves.

    ``embed`` turns texts into vectors. Without ``cells`` every vector is
    compared; with it an index of that many cells is probed, in as many cells as
    a recall of ``recall`` asks for unless ``probes`` fixes their number.
    ``respond`` adds a second stage that reorders the first ``first_k`` hits.
    """

    name: str
    embed: Embedder
    cells: int | None = None
    probes: int | None = None
    recall: float = 0.95
    respond: Callable[[DataFrame], DataFrame] | None = None
    first_k: int = 10


@dataclass(frozen=True)
class Experiment:
    hits: DataFrame
    averages: DataFrame
    comparison: DataFrame
    timing: DataFrame


def retrieve_with(
    approach: Approach, queries: DataFrame, corpus: DataFrame, k: int, vectors: dict[Embedder, tuple[DataFrame, DataFrame]]
) -> tuple[DataFrame, float, float]:
    """Stored hits of one approach, with index and retrieval seconds; approaches share the vectors of an embedder."""
    started = time.perf_counter()
    if approach.embed not in vectors:
        vectors[approach.embed] = (
            materialize(embed_column(corpus, "sentence", approach.embed), "items"),
            materialize(embed_column(queries, "query", approach.embed), "queries"),
        )
    items, asked = vectors[approach.embed]
    index = None
    if approach.cells is not None:
        index = build_index(items, approach.cells, "item_id", "vector", path=own(items.sparkSession, work_path(items.sparkSession, "index")))
    indexed = time.perf_counter()
    first = max(k, approach.first_k) if approach.respond else k
    if index is None:
        hits = exact_topk(asked, items, first, "query_id", "item_id", "vector", exclude_self=False, distinct=True)
    else:
        probes = approach.probes or probes_for(asked, index, first, approach.recall, "query_id", "vector")
        hits = index_topk(asked, index, first, probes, "query_id", "vector")
    if approach.respond is not None:
        candidates = with_text(hits, corpus, "item_id", "sentence")
        hits = rerank(candidates, queries, approach.respond, k).select("query_id", "rank", "item_id", "similarity")
    stored = materialize(hits.withColumn("approach", F.lit(approach.name)), "hits")
    return stored, indexed - started, time.perf_counter() - indexed


def retrieval_experiment(
    pairs: DataFrame, approaches: Sequence[Approach], k: int = 5, sample_size: int | None = None, seed: int = 42
) -> Experiment:
    """Find each ``sentence1`` among all ``sentence2``, per approach, and compare.

    A sentence2 is relevant when its own pair is labelled 1, for every query.
    """
    require_columns(pairs, ("id", "sentence1", "sentence2", "label"))
    asked = pairs if sample_size is None else sample_rows(pairs, sample_size, "id", seed)
    queries = asked.select(F.col("id").alias("query_id"), F.col("sentence1").alias("query"))
    corpus = pairs.select(F.col("id").alias("item_id"), F.col("sentence2").alias("sentence"))
    relevance = pairs.select(F.col("id").alias("item_id"), F.col("label").alias("rel"))
    names = [a.name for a in approaches]
    n, log, parts, vectors = max(1, queries.count()), [], [], {}
    for approach in approaches:  # one Spark job chain per approach, a handful of them
        hits, indexing, retrieving = retrieve_with(approach, queries, corpus, k, vectors)
        parts.append(hits)
        log += [(approach.name, "index", indexing), (approach.name, "retrieve", retrieving / n)]
    hits = parts[0]
    for part in parts[1:]:
        hits = hits.unionByName(part)
    totals = ev.with_approaches(ev.positives_globally(queries.select("query_id"), relevance), names)
    scored = ev.score_queries(totals, ev.judge_globally(hits, relevance), ["approach"])
    averages = materialize(ev.macro_average(scored, ["approach"]), "averages")
    run_log = pairs.sparkSession.createDataFrame(log, "approach string, phase string, seconds double")
    return Experiment(hits, averages, ev.compare_approaches(averages, names), ev.approach_timing(run_log).drop("queries"))


def score_pairs(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    loaders: dict[str, Callable[[], Predict]],
    sink: str,
    checkpoint: str,
    inputs: Sequence[str] = ("sentence1", "sentence2"),
    files_per_batch: int | None = None,
) -> DataFrame:
    """Score all files of a folder with all models; a rerun takes up only new files."""
    score = lambda df: score_models(df, loaders, inputs)
    score_new_files(spark, source, schema, score, sink, checkpoint, files_per_batch)
    return spark.read.parquet(sink)


def evaluate_pairs(scored: DataFrame, path: str, models: Sequence[str] = SCORE_COLUMNS) -> DataFrame:
    """Write summary, threshold sensitivity and curve points below ``path``.

    ``evaluation_results`` (CSV), ``threshold_sensitivity`` (CSV by model),
    ``roc_curves`` and ``pr_curves`` (parquet by model). Returns the summary.
    """
    valid = eval_pairs.valid_scored_pairs(scored, models)
    scores = eval_pairs.long_scores(valid, models)
    counts = eval_pairs.cumulative_counts(scores)
    summary = eval_pairs.pair_eval_summary(counts)
    save_summary(summary, f"{path}/evaluation_results")
    by_model = lambda df: df.write.mode("overwrite").partitionBy("model")
    by_model(eval_pairs.threshold_sensitivity(scores)).option("header", True).csv(f"{path}/threshold_sensitivity")
    by_model(eval_pairs.roc_curve(counts)).parquet(f"{path}/roc_curves")
    by_model(eval_pairs.pr_curve(counts)).parquet(f"{path}/pr_curves")
    return summary
