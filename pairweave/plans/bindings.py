"""Tables the registered queries work on, derived by Spark from the given ones."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pairweave.functions.ngrams import ngram_vector
from pairweave.functions.text import digest_number, words
from pairweave.functions.vectors import absolute_similarity, cosine, rooted
from pairweave.operators.eval_retrieval import positives_by_class, with_approaches
from pairweave.operators.index import build_index, index_topk, probes_for
from pairweave.operators.projections import build_projections, projection_topk
from pairweave.operators.rerank import rerank_apply, responses_from_scores
from pairweave.operators.retrieve import exact_topk
from pairweave.schemas import SCORE_COLUMNS
from pairweave.session import materialize, spread

DIM = 64
TOP_K = 5
FIRST_K = 10
CLASS_PROBES = 8  # of the 10 cells around class means: recall 0.93 at 5
PROJECTION = {"tables": 8, "bits": 4, "seed": 42}
PROJECTION_PROBES = 3
APPROACHES = ("full", "rooted", "reranked")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def busy_table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """A scan whose rows cost much work: on all cores even when it is one file."""
    df = table(spark, sf_dir, name)
    return spread(df.select(*columns) if columns else df)


def r6(c: str | Column) -> Column:
    """6 decimals, never minus zero."""
    return F.round(F.col(c) if isinstance(c, str) else c, 6) + F.lit(0.0)


def quick_r6(c: str | Column) -> Column:
    """``r6`` of a double. A decimal number is made only near a tie: elsewhere the nearest millionth, divided, is the same double."""
    c = F.col(c) if isinstance(c, str) else c
    millionths = c * 1e6
    clear = (F.abs(c) < 1e6) & (F.abs(millionths - F.floor(millionths) - 0.5) > 1e-3)
    return F.when(clear, F.rint(millionths) / 1e6 + F.lit(0.0)).otherwise(r6(c))


def packed(vector: str | Column) -> Column:
    """A vector as text: components in millionths."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return F.array_join(F.transform(vector, lambda x: F.round(x * 1e6).cast("bigint").cast("string")), ",")


def vector_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(id, b_id, va, vb, label)``: each vector with one other, label 1 for one class."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1))).scalar()
    a = e.select(
        F.col("vec_id").alias("id"),
        F.col("embedding").alias("va"),
        F.col("label").alias("la"),
        ((F.col("vec_id") * 7 + 3) % n).alias("b_id"),
    )
    b = e.select(F.col("vec_id").alias("b_id"), F.col("embedding").alias("vb"), F.col("label").alias("lb"))
    return a.join(b, "b_id").select("id", "b_id", "va", "vb", (F.col("la") == F.col("lb")).cast("int").alias("label"))


def score_columns() -> list[Column]:
    """Three models, all over whole vectors: cosine of rooted components, absolute similarity, cosine."""
    scores = (cosine(rooted("va"), rooted("vb")), absolute_similarity("va", "vb"), cosine("va", "vb"))
    return [F.round(score, 6).alias(name) for name, score in zip(SCORE_COLUMNS, scores, strict=True)]


def scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_pairs(spark, sf_dir).select("id", "label", *score_columns())


def partly_labelled_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``vector_pairs`` with ``vl``: the second vector where its item has a label, else null."""
    labelled = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("b_id"), F.lit(True).alias("labelled"))
    joined = vector_pairs(spark, sf_dir).join(labelled, "b_id", "left")
    return joined.withColumn("vl", F.when(F.col("labelled"), F.col("vb"))).drop("labelled")


def partly_scored_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``scored_pairs``, but the second model lacks vectors of unlabelled items."""
    first, _, third = score_columns()
    partial = F.round(absolute_similarity("va", "vl"), 6).alias(SCORE_COLUMNS[1])
    return partly_labelled_pairs(spark, sf_dir).select("id", "label", first, partial, third)


def user_turns(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    c = table(spark, sf_dir, "conversations")
    asked = c.where(F.col("role") == "user").select("conv_id", "turn", F.col("text").alias("sentence1"))
    replies = c.where(F.col("role") == "assistant").select("conv_id", "turn", F.col("text").alias("sentence2"))
    return asked, replies


def turn_id() -> Column:
    return F.col("conv_id") * 1_000_000 + F.col("turn")


def text_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns with their own reply (1) and with one of the next conversation (0)."""
    asked, replies = user_turns(spark, sf_dir)
    parts = []
    for label, shift in ((1, 0), (0, 1)):
        wanted = asked.select(
            (turn_id() * 2 + (1 - label)).alias("id"),
            "sentence1",
            (F.col("conv_id") + shift).alias("conv_id"),
            (F.col("turn") + 1).alias("turn"),
        )
        joined = wanted.join(replies, ["conv_id", "turn"])
        parts.append(joined.select("id", "sentence1", "sentence2", F.lit(label).alias("label")))
    return parts[0].unionByName(parts[1])


def answered_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn with its reply, null where there is none."""
    asked, replies = user_turns(spark, sf_dir)
    wanted = asked.select(turn_id().alias("id"), "sentence1", "conv_id", (F.col("turn") + 1).alias("turn"))
    return wanted.join(replies, ["conv_id", "turn"], "left").select("id", "sentence1", "sentence2")


def word_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(word, vector)``: every word of the documents with one of the vectors."""
    e = table(spark, sf_dir, "embeddings")
    n = e.agg(F.count(F.lit(1))).scalar()
    documents = busy_table(spark, sf_dir, "documents", "text")
    vocabulary = documents.select(F.explode(words("text")).alias("word")).distinct()
    chosen = vocabulary.withColumn("vec_id", digest_number(F.md5("word")) % n)
    return chosen.join(e, "vec_id").select("word", F.col("embedding").alias("vector"))


def class_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(cell, vector)``: the mean vector of each class, to 6 decimals, as given centroids."""
    placed = table(spark, sf_dir, "embeddings").select("label", F.posexplode("embedding").alias("place", "x"))
    means = placed.groupBy("label", "place").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("x"))
    ordered = means.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("place", "x"))).alias("xs"))
    return ordered.select(F.col("label").alias("cell"), F.col("xs.x").alias("vector"))


def class_index_hits(spark: SparkSession, sf_dir: str, probes: int = CLASS_PROBES, path: str | None = None) -> DataFrame:
    """Top-k of all vectors in an index whose cells lie around the class means."""
    e = busy_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    index = build_index(e, centroids=class_means(spark, sf_dir), path=path)
    return index_topk(e, index, TOP_K, probes, exclude_self=True)


def trained_index_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k of all vectors in an index of 16 trained cells, with as many probes as the measured recall asks for."""
    e = busy_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    index = build_index(e, cells=16)
    return index_topk(e, index, TOP_K, probes_for(e, index, TOP_K, exclude_self=True), exclude_self=True)


def projection_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k of all vectors from tables of random projections."""
    e = busy_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return projection_topk(e, build_projections(e, **PROJECTION), TOP_K, PROJECTION_PROBES, exclude_self=True)


def classes(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf_dir, "embeddings")
    return (
        e.select(F.col("vec_id").alias("query_id"), F.col("label").alias("query_class")),
        e.select(F.col("vec_id").alias("item_id"), F.col("label").alias("item_class")),
    )


def query_table(spark: SparkSession, sf_dir: str, reach: int = 0) -> DataFrame:
    """Every vector as a query with the number of other items of its class."""
    query_class, item_class = classes(spark, sf_dir)
    return positives_by_class(query_class.select("query_id"), query_class, item_class, reach)


def hits(spark: SparkSession, sf_dir: str, k: int = TOP_K, shape: Callable[[str], Column] | None = None) -> DataFrame:
    """Top-k of all vectors among all vectors, optionally after reshaping each."""
    queries = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    corpus = busy_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    if shape is not None:
        queries, corpus = (df.withColumn("embedding", shape("embedding")) for df in (queries, corpus))
    return exact_topk(queries, corpus, k, exclude_self=True)


def candidates_with_second_score(spark: SparkSession, sf_dir: str, first: DataFrame | None = None) -> DataFrame:
    """First-stage candidates with the cosine of their rooted vectors."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", rooted("embedding").alias("tail"))
    first = hits(spark, sf_dir, FIRST_K) if first is None else first
    left = first.join(e.select(F.col("vec_id").alias("query_id"), F.col("tail").alias("qt")), "query_id")
    both = left.join(e.select(F.col("vec_id").alias("item_id"), F.col("tail").alias("it")), "item_id")
    return both.select("query_id", "rank", "item_id", "similarity", F.round(cosine("qt", "it"), 12).alias("second"))


def reranked_hits(spark: SparkSession, sf_dir: str, first: DataFrame | None = None) -> DataFrame:
    candidates = candidates_with_second_score(spark, sf_dir, first)
    responses = responses_from_scores(candidates, "second")
    return rerank_apply(candidates.drop("second"), responses, TOP_K).select(
        "query_id", "rank", "item_id", "similarity"
    )


def approach_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of three approaches in one table; the first 10 of the whole vectors are found once."""
    first = materialize(hits(spark, sf_dir, FIRST_K), "first-hits")
    parts = {
        "full": first.where(F.col("rank") <= TOP_K),
        "rooted": hits(spark, sf_dir, shape=rooted),
        "reranked": reranked_hits(spark, sf_dir, first),
    }
    named = [df.withColumn("approach", F.lit(a)) for a, df in parts.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


def approach_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_approaches(query_table(spark, sf_dir), APPROACHES)


def reply_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Top-k replies of every user turn by hashed n-grams; a turn's id is that of its row."""
    asked, replies = user_turns(spark, sf_dir)
    vector = ngram_vector()
    queries = asked.select(turn_id().alias("query_id"), vector(F.col("sentence1")).alias("vector"))
    items = replies.select(turn_id().alias("item_id"), vector(F.col("sentence2")).alias("vector"))
    return exact_topk(queries, spread(items), TOP_K, "query_id", "item_id", "vector", exclude_self=False, distinct=True)


def reply_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(query_id, item_id, rel)``: every judged pair, a turn with its own reply (1) and with a shifted one (0)."""
    asked, replies = user_turns(spark, sf_dir)
    answers = replies.select("conv_id", "turn", turn_id().alias("item_id"))
    parts = []
    for rel, shift in ((1, 0), (0, 1)):
        wanted = asked.select(
            turn_id().alias("query_id"), (F.col("conv_id") + shift).alias("conv_id"), (F.col("turn") + 1).alias("turn")
        )
        parts.append(wanted.join(answers, ["conv_id", "turn"]).select("query_id", "item_id", F.lit(rel).alias("rel")))
    return parts[0].unionByName(parts[1])


def item_relevance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``(item_id, rel)``: quality label of the document with the vector's id."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("item_id"))
    quality = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("item_id"), F.col("quality").alias("rel"))
    return e.join(quality, "item_id", "left").withColumn("rel", F.coalesce("rel", F.lit(0)))


def noisy_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model answers with repeats, numbers out of range, missing numbers and gaps."""
    ids = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("query_id"))
    digest = F.md5(F.col("query_id").cast("string"))
    part = lambda start: (digest_number(digest, start, 2) % 13).cast("string")
    told = F.concat(F.lit("Closest: "), part(1), F.lit(", "), part(3), F.lit(" and "), part(5), F.lit("; then "), part(7))
    kind = digest_number(digest, 9, 2) % 4
    response = F.when(kind == 0, "none of them").when(kind == 1, F.concat(told, F.lit(" of 99999999999"))).otherwise(told)
    return ids.withColumn("response", response).where(digest_number(digest, 11, 2) % 5 != 0)


def documents_with_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as a result table: first column empty, second filled, third empty."""
    d = table(spark, sf_dir, "documents")
    empty = F.lit(None).cast("double")
    values = (empty, F.col("n_chars").cast("double"), empty)
    return d.select(
        F.col("doc_id").alias("global_index"), "lang", *[v.alias(c) for v, c in zip(values, SCORE_COLUMNS)]
    )


def label_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse results; the column ``unknown`` is not a result column."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("global_index"),
        F.col("quality").cast("double").alias(SCORE_COLUMNS[0]),
        F.when(F.col("toxic") == 1, F.lit(0.5)).alias(SCORE_COLUMNS[1]),
        F.lit(1.0).alias("unknown"),
    )


def processed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "labels").select(F.col("doc_id").alias("global_index"))
