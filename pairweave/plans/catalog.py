"""Registered queries: one function ``(spark, sf_dir) -> DataFrame`` per operator."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairweave.functions import vectors as V
from pairweave.functions.ngrams import ngram_vector
from pairweave.functions.text import text_key
from pairweave.operators import embed, eval_pairs, incremental, lexical, quality, rerank, word_training
from pairweave.operators import eval_retrieval as ev
from pairweave.operators.index import build_index, index_topk, recall_against
from pairweave.operators.joins import few
from pairweave.operators.models import model_map, score_models
from pairweave.operators.ordering import first_rows
from pairweave.operators.retrieve import exact_topk, similarity_to_vector, with_text
from pairweave.plans import bindings as B
from pairweave.plans.bindings import r6
from pairweave.plans.workflows import Approach
from pairweave.plans.workflows import evaluate_pairs as run_evaluation
from pairweave.plans.workflows import retrieval_experiment as run_experiment
from pairweave.plans.workflows import score_pairs as run_scoring
from pairweave.schemas import SCORE_COLUMNS
from pairweave.session import materialize, own, work_path
from pairweave.sources import pairs as pair_source
from pairweave.sources import results
from pairweave.streaming import scoring

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(fn: Query) -> Query:
    """Register under the function's name; a ``_query`` suffix is dropped."""
    QUERIES[fn.__name__.removesuffix("_query")] = fn
    return fn


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    for c in columns:
        df = df.withColumn(c, r6(c))
    return df


# --- scans, sources, sinks ---------------------------------------------------


@query
def load_pairs(spark, d):
    path = own(spark, work_path(spark, "pairs") + ".csv")
    B.text_pairs(spark, d).write.option("header", True).option("escape", '"').csv(path)
    return pair_source.load_pairs(spark, path, multi_line=True)  # sentences hold line breaks


@query
def project_pairs(spark, d):
    return pair_source.project_pairs(B.text_pairs(spark, d)).select(
        "id", "label", F.md5("sentence1").alias("digest1"), F.md5("sentence2").alias("digest2")
    )


@query
def indexed_scan(spark, d):
    scanned = incremental.indexed_scan(materialize(B.text_pairs(spark, d), "pairs"), "id", SCORE_COLUMNS)
    empty = sum(F.col(c).isNull().cast("int") for c in SCORE_COLUMNS)
    texts = F.md5(F.concat_ws("\x1f", "sentence1", "sentence2")).alias("digest")
    return scanned.select("id", "global_index", empty.alias("empty_results"), texts)


@query
def count_and_chunks(spark, d):
    return incremental.count_and_chunks(B.documents_with_results(spark, d), chunk_rows=100)


@query
def write_results(spark, d):
    updated = incremental.apply_updates(B.documents_with_results(spark, d), B.label_updates(spark, d), SCORE_COLUMNS)
    path = own(spark, work_path(spark, "results"))
    results.write_results(updated, path)
    return results.read_results(spark, path, updated.schema)


@query
def chunked_results(spark, d):
    """Results saved by chunk; the sparse updates replace the chunks they touch."""
    rows = B.documents_with_results(spark, d)
    path = own(spark, work_path(spark, "chunked"))
    results.write_chunks(rows, path, chunk_rows=100)
    results.update_chunks(B.label_updates(spark, d), path, rows.schema, SCORE_COLUMNS, chunk_rows=100)
    return results.read_chunks(spark, path, rows.schema)


@query
def eval_json_roundtrip(spark, d):
    path = own(spark, work_path(spark, "evaluation"))
    close = B.approach_hits(spark, d).where(F.col("similarity") >= 0.3)  # leaves queries without hits
    order = W.partitionBy("approach", "query_id").orderBy("rank")
    hits = materialize(close.withColumn("rank", F.row_number().over(order)), "approach-hits")
    judged = ev.judge_by_class(hits, *B.classes(spark, d))
    queries = B.approach_queries(spark, d)
    averages = ev.macro_average(ev.score_queries(queries, judged, ["approach"]), ["approach"])
    told = with_text(hits, B.table(spark, d, "documents"), "doc_id")
    results.save_evaluation(results.evaluation_records(queries, told, averages), path)
    loaded = results.load_evaluation(spark, path)
    return loaded.select(
        F.col("approach_name").alias("approach"),
        "query_id",
        F.array_join(F.transform("retrieved_indices", lambda x: x.cast("string")), ",").alias("items"),
        B.packed("retrieved_similarities").alias("similarities"),
        F.md5(F.array_join("retrieved_results", "\x1f", "none")).alias("sentences"),
        r6("evaluation.precision").alias("precision"),
        r6("evaluation.ndcg").alias("ndcg"),
    )


@query
def eval_summary_csv(spark, d):
    path = own(spark, work_path(spark, "summary"))
    results.save_summary(pair_eval_summary(spark, d), path)
    return results.load_summary(spark, path)


# --- projections, filters, sampling ------------------------------------------


@query
def valid_scored_pairs(spark, d):
    return eval_pairs.valid_scored_pairs(B.partly_scored_pairs(spark, d), SCORE_COLUMNS)


@query
def label_distribution(spark, d):
    return eval_pairs.label_distribution(eval_pairs.valid_scored_pairs(B.scored_pairs(spark, d), SCORE_COLUMNS))


@query
def row_lookup(spark, d):
    documents = B.table(spark, d, "documents").withColumnRenamed("doc_id", "global_index")
    return incremental.row_lookup(documents, 42).select("global_index", "lang", "source", "n_chars", "text")


@query
def sample_queries(spark, d):
    return quality.sample_rows(B.table(spark, d, "documents"), 100, "doc_id").select("doc_id", "lang", "text")


@query
def limit_rows(spark, d):
    return first_rows(B.text_pairs(spark, d), "id", 50).select("id", "label", "sentence1")


@query
def threshold_predict(spark, d):
    score = SCORE_COLUMNS[2]
    return eval_pairs.threshold_predict(B.scored_pairs(spark, d), score, 0.1).select(
        "id", "label", "prediction", (F.col("prediction") == F.col("label")).cast("int").alias("correct")
    )


@query
def threshold_accuracy(spark, d):
    return threshold_predict(spark, d).agg(
        F.count(F.lit(1)).alias("n"), F.sum("prediction").alias("predicted"), r6(F.avg("correct")).alias("accuracy")
    )


# --- vectors and embeddings --------------------------------------------------


def load_rooted():
    def predict(batch):
        a, b = (np.stack(batch[c].to_numpy()).astype("f8") for c in ("va", "vb"))
        a, b = (np.sign(v) * np.sqrt(np.abs(v)) for v in (a, b))
        return (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))

    return predict


def load_absolute():
    def predict(batch):
        if batch["vl"].isna().any():
            raise ValueError("missing vector")
        a, b = (np.stack(batch[c].to_numpy()).astype("f8") for c in ("va", "vl"))
        return 1 - np.abs(a - b).sum(1) / (np.abs(a).sum(1) + np.abs(b).sum(1))

    return predict


def load_plain():
    def predict(batch):
        a, b = (np.stack(batch[c].to_numpy()).astype("f8") for c in ("va", "vb"))
        return (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))

    return predict


MODEL_LOADERS = dict(zip(SCORE_COLUMNS, (load_rooted, load_absolute, load_plain), strict=True))


@query
def cosine_pairs(spark, d):
    return B.vector_pairs(spark, d).select("id", "b_id", r6(V.cosine("va", "vb")).alias("similarity"))


@query
def dot_pairs(spark, d):
    return B.vector_pairs(spark, d).select("id", "b_id", r6(V.dot("va", "vb")).alias("similarity"))


@query
def similarity_batch(spark, d):
    e = B.table(spark, d, "embeddings")
    mean = e.agg(F.array(*[F.avg(F.col("embedding")[i].cast("double")) for i in range(B.DIM)])).scalar()
    cosines = similarity_to_vector(e, mean).withColumnRenamed("similarity", "cosine")
    both = similarity_to_vector(cosines, mean, metric="dot")
    return both.select("vec_id", r6("cosine").alias("similarity"), r6("similarity").alias("dot"))


@query
def distance_to_similarity(spark, d):
    pairs = B.vector_pairs(spark, d)
    squared = F.aggregate(
        F.zip_with("va", "vb", lambda x, y: F.pow(x.cast("double") - y.cast("double"), F.lit(2.0))),
        F.lit(0.0),
        lambda s, x: s + x,
    )
    return pairs.select(
        "id",
        r6(V.distance_to_similarity(1.0 - V.cosine("va", "vb"))).alias("from_cosine"),
        r6(V.distance_to_similarity(squared, "l2sq")).alias("from_l2sq"),
    )


@query
def pair_similarity(spark, d):
    return embed.pair_similarity(B.answered_turns(spark, d), ngram_vector()).select(
        "id", r6("similarity").alias("similarity")
    )


@query
def pair_similarity_reusing(spark, d):
    scored = embed.pair_similarity_reusing(B.answered_turns(spark, d), embed.hashed_ngrams)
    return scored.select("id", r6("similarity").alias("similarity"))


@query
def multi_model_scores(spark, d):
    """Three Python models in one pass; the second fails on pairs that lack a vector."""
    scored = score_models(B.partly_labelled_pairs(spark, d), MODEL_LOADERS, ["va", "vb", "vl"])
    names = [r6(c).alias(c) for c in SCORE_COLUMNS]
    reasons = [F.coalesce(f"{c}_error", F.lit("")).alias(f"{c}_error") for c in SCORE_COLUMNS]
    return scored.select("id", "label", *names, *reasons)


@query
def embed_word_average(spark, d):
    documents = B.busy_table(spark, d, "documents", F.col("doc_id").cast("string").alias("text_key"), "text")
    vectors = embed.word_average(documents, B.word_vectors(spark, d), B.DIM)
    return vectors.select(F.col("text_key").cast("long").alias("doc_id"), B.packed("vector").alias("vector"))


@query
def word_cooccurrence(spark, d):
    return word_training.cooccurrences(B.busy_table(spark, d, "documents", "text"), least_count=5)


@query
def word_information(spark, d):
    counts = word_training.cooccurrences(B.busy_table(spark, d, "documents", "text"), least_count=5)
    return word_training.positive_information(counts).withColumn("ppmi", B.quick_r6("ppmi"))


@query
def embed_trained_words(spark, d):
    """Which documents get a vector from word vectors trained on all of them."""
    trained = word_training.train_word_vectors(B.busy_table(spark, d, "documents", "text"), dim=16, rounds=2)
    documents = B.busy_table(spark, d, "documents", F.col("doc_id").cast("string").alias("text_key"), "text")
    vectors = embed.word_average(documents, trained, 16)
    return vectors.select(F.col("text_key").cast("long").alias("doc_id"), F.exists("vector", lambda x: x != 0).alias("known"))


@query
def embed_hashed_ngrams(spark, d):
    vectors = embed.hashed_ngrams(embed.distinct_texts(B.busy_table(spark, d, "documents", "text"), "text"))
    return vectors.select("text_key", B.packed("vector").alias("vector"))


@query
def embed_reuse(spark, d):
    embedded = embed.embed_column(B.table(spark, d, "documents").select("doc_id", "text"), "text", embed.hashed_ngrams)
    return embedded.select("doc_id", text_key("text").alias("text_key"), B.packed("vector").alias("vector"))


# --- retrieval ----------------------------------------------------------------


@query
def exact_topk_query(spark, d):
    return rounded(B.hits(spark, d), "similarity")


@query
def exact_topk_blocked(spark, d):
    e = B.busy_table(spark, d, "embeddings", "vec_id", "embedding")
    return rounded(exact_topk(e, e, B.TOP_K, strategy="grid", block_rows=256), "similarity")


@query
def batch_topk(spark, d):
    e = B.busy_table(spark, d, "embeddings", "vec_id", "embedding")
    return rounded(exact_topk(e, e, 7, metric="dot"), "similarity")


@query
def vector_index_topk(spark, d):
    return rounded(B.class_index_hits(spark, d, path=own(spark, work_path(spark, "index"))), "similarity")


@query
def vector_index_all_cells(spark, d):
    e = B.busy_table(spark, d, "embeddings", "vec_id", "embedding")
    index = build_index(e, cells=8)
    return rounded(index_topk(e, index, B.TOP_K, probes=8, exclude_self=True, block_rows=200), "similarity")


@query
def vector_index_recall(spark, d):
    found = recall_against(B.class_index_hits(spark, d), B.hits(spark, d))
    return rounded(found, "recall")


@query
def vector_index_trained(spark, d):
    """How many of the exact hits there are, and whether the trained index finds nine in ten of them."""
    near = materialize(B.trained_index_hits(spark, d), "trained-hits")
    found = recall_against(near, B.hits(spark, d))
    ranked = near.agg(F.count(F.lit(1)).alias("n_hits"))
    return found.select("exact_hits", (F.col("recall") >= 0.9).alias("recall_reached"), F.lit(ranked.first()[0]).cast("long").alias("n_hits"))


@query
def vector_projection_topk(spark, d):
    return rounded(B.projection_hits(spark, d), "similarity")


@query
def vector_projection_recall(spark, d):
    return rounded(recall_against(B.projection_hits(spark, d), B.hits(spark, d)), "recall")


@query
def retrieval_with_text(spark, d):
    attached = with_text(B.hits(spark, d), B.table(spark, d, "documents"), "doc_id")
    return rounded(attached, "similarity").select(
        "query_id", "rank", "item_id", "similarity", F.coalesce("sentence", F.lit("")).alias("sentence")
    )


@query
def rerank_prompt(spark, d):
    documents = B.table(spark, d, "documents")
    candidates = with_text(B.hits(spark, d), documents, "doc_id")
    asked = B.table(spark, d, "embeddings").join(
        documents.select(F.col("doc_id").alias("vec_id"), "text"), "vec_id", "left"
    )
    asked = asked.select(F.col("vec_id").alias("query_id"), F.coalesce("text", F.lit("")).alias("query"))
    prompts = rerank.rerank_prompts(candidates, asked, 3, instruction="Pick {k}.")
    return prompts.select("query_id", "n_candidates", F.length("prompt").alias("length"), F.md5("prompt").alias("digest"))


@query
def rerank_apply(spark, d):
    applied = rerank.rerank_apply(B.hits(spark, d, B.FIRST_K), B.noisy_responses(spark, d), B.TOP_K)
    return rounded(applied, "similarity").select("query_id", "rank", "old_rank", "item_id", "similarity")


@query
def reranked_topk(spark, d):
    return rounded(B.reranked_hits(spark, d), "similarity")


@query
def lexical_topk(spark, d):
    """Every fiftieth document as a query against all others."""
    documents = B.busy_table(spark, d, "documents", "doc_id", "text")
    asked = documents.where("doc_id % 50 = 0").withColumnRenamed("doc_id", "query_id")
    return rounded(lexical.lexical_topk(asked, lexical.build_lexical_index(documents), B.TOP_K, exclude_self=True), "similarity")


@query
def lexical_reranked_topk(spark, d):
    """The ten nearest vectors of each, in the order in which their documents match its document's words."""
    documents = B.busy_table(spark, d, "documents", "doc_id", "text")
    asked = documents.join(few(B.table(spark, d, "embeddings").select(F.col("vec_id").alias("doc_id"))), "doc_id")
    index = lexical.build_lexical_index(documents)
    hits = lexical.lexical_rerank(B.hits(spark, d, B.FIRST_K), asked.withColumnRenamed("doc_id", "query_id"), index, B.TOP_K)
    return rounded(hits, "similarity", "score")


@query
def apply_updates(spark, d):
    return incremental.apply_updates(B.documents_with_results(spark, d), B.label_updates(spark, d), SCORE_COLUMNS)


@query
def unprocessed_rows(spark, d):
    rows = B.documents_with_results(spark, d).select("global_index", "lang")
    return incremental.unprocessed_rows(rows, B.processed_documents(spark, d))


@query
def already_done(spark, d):
    rows = B.documents_with_results(spark, d).select("global_index", "lang")
    return incremental.already_done(rows, B.processed_documents(spark, d))


@query
def merge_results(spark, d):
    rows = apply_updates(spark, d)
    english = F.col("lang") == "en"
    return incremental.merge_results([rows.where(english), rows.where(~english)])


# --- retrieval evaluation -----------------------------------------------------


def class_scores(spark, d) -> DataFrame:
    judged = ev.judge_by_class(B.hits(spark, d), *B.classes(spark, d))
    return ev.score_queries(B.query_table(spark, d), judged)


@query
def eval_precision_recall_f1(spark, d):
    return rounded(class_scores(spark, d).select("query_id", "precision", "recall", "f1"), "precision", "recall", "f1")


@query
def eval_mrr(spark, d):
    return rounded(class_scores(spark, d).select("query_id", "mrr"), "mrr")


@query
def eval_ndcg(spark, d):
    return rounded(class_scores(spark, d).select("query_id", "ndcg"), "ndcg")


@query
def eval_macro(spark, d):
    return rounded(ev.macro_average(class_scores(spark, d)), *ev.METRICS)


@query
def eval_global_relevance(spark, d):
    relevance = B.item_relevance(spark, d)
    queries = ev.positives_globally(B.query_table(spark, d).select("query_id"), relevance)
    scored = ev.score_queries(queries, ev.judge_globally(B.hits(spark, d), relevance))
    return rounded(scored.select("query_id", *ev.METRICS), *ev.METRICS)


@query
def eval_per_query_relevance(spark, d):
    qrels = B.reply_qrels(spark, d)
    asked = B.user_turns(spark, d)[0].select(B.turn_id().alias("query_id"))
    queries = ev.positives_per_query(asked, qrels)
    scored = ev.score_queries(queries, ev.judge_per_query(B.reply_hits(spark, d), qrels))
    return rounded(scored.select("query_id", *ev.METRICS), *ev.METRICS)


def partner_queries(spark, d) -> DataFrame:
    return B.vector_pairs(spark, d).select(
        F.col("id").alias("query_id"), F.col("b_id").alias("partner_id"), "label"
    )


@query
def hits_at_k(spark, d):
    wide = B.hits(spark, d, 50)
    ks = (1, 3, 5, 50)
    return rounded(ev.hit_rates(ev.hits_at(partner_queries(spark, d), wide, ks), ks), *[f"top_{k}_accuracy" for k in ks])


@query
def query_verdict(spark, d):
    own = B.vector_pairs(spark, d).select("id", "label")
    relevance = own.select(F.col("id").alias("item_id"), F.col("label").alias("rel"))
    judged = ev.judge_globally(B.hits(spark, d), relevance)
    verdicts = ev.query_verdicts(own.withColumnRenamed("id", "query_id"), judged)
    return rounded(ev.verdict_summary(verdicts), "accuracy", "recall")


@query
def topk_threshold_sweep(spark, d):
    judged = ev.judge_by_class(B.hits(spark, d, B.FIRST_K), *B.classes(spark, d))
    swept = ev.topk_threshold_sweep(B.query_table(spark, d), judged, (1, 3, 5, 10), (0.2, 0.25, 0.3, 0.35))
    return rounded(swept, "precision", "recall")


@query
def grouped_eval(spark, d):
    groups = B.classes(spark, d)[0].select("query_id", F.concat(F.lit("class"), "query_class").alias("group"))
    judged = ev.judge_by_class(B.hits(spark, d), *B.classes(spark, d))
    scored = ev.score_queries(B.query_table(spark, d).join(groups, "query_id"), judged)
    return rounded(ev.macro_average(scored, ["group"]), *ev.METRICS)


@query
def graded_ndcg(spark, d):
    judged = ev.judge_by_class(B.hits(spark, d), *B.classes(spark, d), rel=ev.graded_by_distance())
    scored = ev.score_queries(B.query_table(spark, d, reach=2), judged)
    return rounded(scored.select("query_id", *ev.METRICS), *ev.METRICS)


@query
def graded_ndcg_corpus(spark, d):
    """NDCG whose ideal is the best order of the whole corpus."""
    rel = ev.graded_by_distance()
    judged = ev.judge_by_class(B.hits(spark, d), *B.classes(spark, d), rel=rel)
    queries = ev.ideal_by_class(B.query_table(spark, d, reach=2), *B.classes(spark, d), rel, B.TOP_K, reach=2)
    return rounded(ev.score_queries(queries, judged).select("query_id", "ndcg"), "ndcg")


def approach_averages(spark, d) -> DataFrame:
    judged = ev.judge_by_class(B.approach_hits(spark, d), *B.classes(spark, d))
    return ev.macro_average(ev.score_queries(B.approach_queries(spark, d), judged, ["approach"]), ["approach"])


@query
def evaluate_approaches(spark, d):
    return rounded(approach_averages(spark, d), *ev.METRICS)


@query
def compare_approaches(spark, d):
    return rounded(ev.compare_approaches(approach_averages(spark, d), B.APPROACHES), *B.APPROACHES)


@query
def retrieval_experiment(spark, d):
    pairs = materialize(B.text_pairs(spark, d), "pairs")
    swapped = lambda prompts: prompts.select("query_id", F.lit("3, 1 and 2").alias("response"))
    approaches = [Approach("direct", embed.hashed_ngrams), Approach("answered", embed.hashed_ngrams, respond=swapped)]
    return rounded(run_experiment(pairs, approaches, k=2).averages, *ev.METRICS)


@query
def approach_timing(spark, d):
    log = B.table(spark, d, "events").select(
        F.col("event_type").alias("approach"),
        F.when(F.col("event_id") % 10 == 0, "index").otherwise("retrieve").alias("phase"),
        F.col("value").alias("seconds"),
    )
    return rounded(ev.approach_timing(log), "indexing_time", "avg_retrieval_time")


# --- pair classification ------------------------------------------------------


def counts(spark, d) -> DataFrame:
    valid = eval_pairs.valid_scored_pairs(B.scored_pairs(spark, d), SCORE_COLUMNS)
    return eval_pairs.cumulative_counts(eval_pairs.long_scores(valid, SCORE_COLUMNS))


@query
def roc_curve(spark, d):
    return rounded(eval_pairs.roc_curve(counts(spark, d)), "fpr", "tpr")


@query
def auc(spark, d):
    return rounded(eval_pairs.curve_summary(counts(spark, d)).select("model", "auc"), "auc")


@query
def youden_threshold(spark, d):
    return rounded(eval_pairs.youden_threshold(counts(spark, d)), "youden_j")


@query
def pr_curve(spark, d):
    points = rounded(eval_pairs.pr_curve(counts(spark, d)), "precision", "recall")
    return points.withColumn("threshold", F.coalesce("threshold", F.lit(float("inf"))))


@query
def average_precision(spark, d):
    return rounded(eval_pairs.curve_summary(counts(spark, d)).select("model", "average_precision"), "average_precision")


@query
def confusion_at_best(spark, d):
    return rounded(
        eval_pairs.confusion_at_best(counts(spark, d)), "accuracy", "specificity", "sensitivity", "f1_score"
    )


@query
def pair_eval_summary(spark, d):
    numbers = ("auc", "accuracy", "specificity", "sensitivity", "f1_score", "average_precision")
    return rounded(eval_pairs.pair_eval_summary(counts(spark, d)), *numbers)


def sensitivity(spark, d) -> DataFrame:
    valid = eval_pairs.valid_scored_pairs(B.scored_pairs(spark, d), SCORE_COLUMNS)
    return eval_pairs.threshold_sensitivity(eval_pairs.long_scores(valid, SCORE_COLUMNS))


@query
def threshold_sensitivity(spark, d):
    return rounded(sensitivity(spark, d), "accuracy", "precision", "recall", "specificity", "f1_score")


@query
def threshold_bands(spark, d):
    return eval_pairs.threshold_bands(counts(spark, d), sensitivity(spark, d), 0.09, 0.2)


# --- data quality and dataset jobs --------------------------------------------


@query
def validate_pairs(spark, d):
    return quality.validate_pairs(B.text_pairs(spark, d))


@query
def stratified_split(spark, d):
    return quality.stratified_split(B.table(spark, d, "documents").select("doc_id", "lang"), "doc_id", "lang")


@query
def dataset_metadata(spark, d):
    return rounded(quality.dataset_metadata(B.text_pairs(spark, d)), "positive_ratio")


@query
def augment_pairs(spark, d):
    return quality.augment_pairs(materialize(B.text_pairs(spark, d), "pairs"), factor=3, suffix="~")


@query
def generate_pairs(spark, d):
    pool = B.table(spark, d, "documents").select(F.col("lang").alias("domain"), F.col("text").alias("sentence"))
    return quality.generate_pairs(pool).select(
        "pair_key", "domain1", "domain2", "label", F.md5("sentence1").alias("digest1"), F.md5("sentence2").alias("digest2")
    )


@query
def progress_report(spark, d):
    report = incremental.progress_report(
        B.documents_with_results(spark, d), B.processed_documents(spark, d), chunk_rows=100
    )
    return rounded(report, "chunk_completion", "dataset_completion")


# --- streaming and models -----------------------------------------------------


def deliveries(spark, d) -> tuple[DataFrame, list[DataFrame]]:
    """The vector pairs arriving in two lots."""
    pairs = B.vector_pairs(spark, d)
    return pairs, [pairs.where(F.col("label") == label) for label in (0, 1)]


@query
def resumable_scoring(spark, d):
    source, sink, log = (own(spark, work_path(spark, n)) for n in ("arriving", "scored", "checkpoint"))
    pairs, lots = deliveries(spark, d)
    score = lambda df: df.select("id", "label", *B.score_columns())
    for lot in lots:
        lot.repartition(4, "id").write.mode("append").parquet(source)
        scoring.score_new_files(spark, source, pairs.schema, score, sink, log, files_per_batch=3)
    return spark.read.parquet(sink)


@query
def resumable_scoring_rows(spark, d):
    """The second delivery repeats every row of the first; each row index is scored once."""
    source, sink, log = (own(spark, work_path(spark, n)) for n in ("arriving", "scored", "checkpoint"))
    pairs, (first, _) = deliveries(spark, d)
    score = lambda df: df.select("id", "label", *B.score_columns())
    for lot in (first, pairs):
        lot.repartition(4, "id").write.mode("append").parquet(source)
        scoring.score_new_rows(spark, source, pairs.schema, "id", score, sink, log, files_per_batch=3)
    return spark.read.parquet(sink)


@query
def score_pairs_job(spark, d):
    """Files of pairs through all models, the second failing on some, in two lots; a rerun adds only the new files."""
    source, sink, log = (own(spark, work_path(spark, n)) for n in ("arriving", "model-scores", "checkpoint"))
    pairs = B.partly_labelled_pairs(spark, d).select("id", "label", "va", "vb", "vl")
    for label in (0, 1):
        pairs.where(F.col("label") == label).repartition(3, "id").write.mode("append").parquet(source)
        scored = run_scoring(spark, source, pairs.schema, MODEL_LOADERS, sink, log, ["va", "vb", "vl"])
    reason = F.coalesce(f"{SCORE_COLUMNS[1]}_error", F.lit("")).alias("reason")
    return scored.select("id", "label", *[r6(c).alias(c) for c in SCORE_COLUMNS], reason)


@query
def evaluate_pairs_files(spark, d):
    """The evaluation job's files, read back: sensitivity of every model beside its summary."""
    path = own(spark, work_path(spark, "pair-evaluation"))
    run_evaluation(B.scored_pairs(spark, d), path)
    columns = "threshold double, accuracy double, precision double, recall double, specificity double, f1_score double"
    curve = spark.read.schema(f"{columns}, model string").option("header", True).csv(f"{path}/threshold_sensitivity")
    summary = results.load_summary(spark, f"{path}/evaluation_results").select("model", "auc", "best_threshold")
    points = spark.read.parquet(f"{path}/roc_curves").groupBy("model").agg(F.count(F.lit(1)).alias("roc_points"))
    joined = curve.join(F.broadcast(summary), "model").join(F.broadcast(points), "model")
    return rounded(joined, "accuracy", "precision", "recall", "specificity", "f1_score", "auc")


@query
def stream_quality_metrics(spark, d):
    source, sink, log = (own(spark, work_path(spark, n)) for n in ("arriving", "partials", "checkpoint"))
    scored = B.partly_scored_pairs(spark, d).select("id", "label", F.col(SCORE_COLUMNS[1]).alias("score"))
    scored.repartition(6, "id").write.parquet(source)
    partials = scoring.chunk_partials("id", 100, "score", "label", 0.1)
    scoring.track_quality(spark, source, scored.schema, partials, sink, log, files_per_batch=2)
    return rounded(scoring.quality_report(spark, sink), "completion", "accuracy")


@query
def stream_quality_totals(spark, d):
    """As ``stream_quality_metrics`` from running totals, over two runs."""
    source, sink, log = (own(spark, work_path(spark, n)) for n in ("arriving", "totals", "checkpoint"))
    scored = B.partly_scored_pairs(spark, d).select("id", "label", F.col(SCORE_COLUMNS[1]).alias("score"))
    totals = scoring.chunk_partials("id", 100, "score", "label", 0.1)
    for label in (0, 1):
        scored.where(F.col("label") == label).repartition(3, "id").write.mode("append").parquet(source)
        scoring.track_totals(spark, source, scored.schema, totals, sink, log, files_per_batch=2)
    return rounded(scoring.latest_totals(spark, sink), "completion", "accuracy")


def load_cosine():
    def predict(batch):
        if batch.isna().any(axis=None):
            raise ValueError("missing vector")
        a, b = (np.stack(batch[c].to_numpy()).astype("f8") for c in ("va", "vb"))
        return (a * b).sum(1) / (np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1))

    return predict


@query
def model_map_query(spark, d):
    scored = model_map(B.vector_pairs(spark, d), load_cosine, ["va", "vb"], "score")
    return scored.select("id", "b_id", r6("score").alias("score"))


@query
def row_error_capture(spark, d):
    e = B.table(spark, d, "embeddings")
    a = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("va"), (F.col("vec_id") * 3 + 1).alias("b_id"))
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("vb"))
    scored = model_map(a.join(b, "b_id", "left"), load_cosine, ["va", "vb"], "score", error="error")
    return scored.select(
        "id", r6(F.coalesce("score", F.lit(-1.0))).alias("score"), F.coalesce("error", F.lit("")).alias("error")
    )
