"""Writing and reading results: row chunks, evaluation JSON, summary CSV.

Every sink commits atomically through Spark's own writer; a rerun replaces it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairweave.operators.eval_retrieval import METRICS
from pairweave.operators.incremental import CHUNK_ROWS, apply_updates, chunk_number
from pairweave.operators.ordering import range_parts
from pairweave.session import discard, materialize

LISTED_CHUNKS = 1000  # as many touched chunks are named in the scan's partition filter, more are joined

EVALUATION = T.StructType(
    [
        T.StructField("approach_name", T.StringType()),
        T.StructField("evaluation", T.StructType([T.StructField(m, T.DoubleType()) for m in METRICS])),
        T.StructField("query_id", T.LongType()),
        T.StructField("retrieved_indices", T.ArrayType(T.LongType())),
        T.StructField("retrieved_similarities", T.ArrayType(T.DoubleType())),
        T.StructField("retrieved_results", T.ArrayType(T.StringType())),
    ]
)

# Headers of the summary file, one line per model.
SUMMARY_HEADERS = {
    "model": "Model",
    "auc": "AUC",
    "best_threshold": "Best Threshold",
    "accuracy": "Accuracy (at Best Threshold)",
    "specificity": "Specificity",
    "sensitivity": "Sensitivity/Recall",
    "f1_score": "F1 Score",
    "average_precision": "Average Precision",
}


def write_results(
    df: DataFrame,
    path: str,
    index: str = "global_index",
    chunk_rows: int | None = None,
    fmt: str = "csv",
    partitions: int | None = None,
) -> None:
    """Result table in row order, one file per range of the index.

    Ranges have the size in bytes that the session's shuffle partitions have, so
    files grow with the table before their number does; a parquet reader skips
    files by the index. ``chunk_rows`` cuts files at that many rows as well.
    """
    writer = range_parts(df, index, partitions).write.mode("overwrite")
    if chunk_rows is not None:
        writer = writer.option("maxRecordsPerFile", chunk_rows)
    if fmt == "csv":
        writer = writer.option("header", True).option("escape", '"').option("nullValue", "").option("emptyValue", '""')
    writer.format(fmt).save(path)


def read_results(
    spark: SparkSession, path: str, schema: T.StructType, fmt: str = "csv", multi_line: bool = False
) -> DataFrame:
    """All files as one table; ``multi_line`` for CSV values that span lines, then one task per file."""
    reader = spark.read.schema(schema)
    if fmt == "csv":
        reader = (
            reader.option("header", True).option("multiLine", multi_line).option("escape", '"').option("mode", "FAILFAST")
        )
    return reader.format(fmt).load(path)


def write_chunks(df: DataFrame, path: str, index: str = "global_index", chunk_rows: int = CHUNK_ROWS) -> None:
    """Result table as parquet, one folder ``chunk=n`` per ``chunk_rows`` indexes, rows in order inside.

    Chunks that ``df`` has rows of are replaced whole, other chunks at ``path`` stay
    as they are, so a job may save one chunk at a time and repeat it.
    """
    _save_chunks(df.withColumn("chunk", chunk_number(index, chunk_rows)), path, index)


def _save_chunks(df: DataFrame, path: str, index: str) -> None:
    ordered = df.repartition("chunk").sortWithinPartitions("chunk", index)
    ordered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def read_chunks(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """All chunks as one table with its ``chunk``; a filter on ``chunk`` reads those folders only."""
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("chunk", T.LongType())])).parquet(path)


def update_chunks(
    updates: DataFrame,
    path: str,
    schema: T.StructType,
    result_columns: Sequence[str],
    index: str = "global_index",
    chunk_rows: int = CHUNK_ROWS,
    version: str | None = None,
) -> None:
    """Merge sparse results into the stored chunks; only chunks with an update are read and rewritten.

    Semantics are those of ``apply_updates``; updates beyond the stored rows are
    ignored. The new chunks are written to a work table first and replace the old
    ones from there, so a repeated call gives the same table. Without updates
    nothing is written.
    """
    spark = updates.sparkSession
    touched = updates.select(chunk_number(index, chunk_rows).alias("chunk")).where("chunk is not null").distinct()
    listed = [row["chunk"] for row in touched.limit(LISTED_CHUNKS + 1).collect()]
    stored = read_chunks(spark, path, schema)
    if len(listed) <= LISTED_CHUNKS:
        old = stored.where(F.col("chunk").isin(listed))
    else:
        old = stored.join(touched, "chunk", "left_semi")
    fresh = materialize(apply_updates(old, updates, result_columns, index, version), "chunks")
    if not fresh.isEmpty():
        _save_chunks(fresh, path, index)
    discard(fresh)


def evaluation_records(queries: DataFrame, hits: DataFrame, averages: DataFrame) -> DataFrame:
    """Nested records: an approach's averages with the hits and sentences of one query.

    ``queries``: ``(approach, query_id)``; a query without hits has empty lists.
    ``hits`` may carry a ``sentence``. One record per query, so no record grows
    with the table. ``averages`` is one row per approach, named by the caller.
    """
    sentence = F.col("sentence") if "sentence" in hits.columns else F.lit(None).cast("string")
    entry = F.struct("rank", "item_id", "similarity", sentence.alias("sentence"))
    found = hits.groupBy("approach", "query_id").agg(F.array_sort(F.collect_list(entry)).alias("hits"))
    metrics = averages.select("approach", F.struct(*METRICS).alias("evaluation"))
    per_query = queries.select("approach", "query_id").join(found, ["approach", "query_id"], "left")
    listed = lambda name: F.coalesce(F.transform("hits", lambda h: h[name]), F.array())
    return per_query.join(F.broadcast(metrics), "approach", "left").select(
        F.col("approach").alias("approach_name"),
        "evaluation",
        "query_id",
        listed("item_id").cast("array<bigint>").alias("retrieved_indices"),
        listed("similarity").cast("array<double>").alias("retrieved_similarities"),
        listed("sentence").cast("array<string>").alias("retrieved_results"),
    )


def save_evaluation(records: DataFrame, path: str) -> None:
    records.write.mode("overwrite").json(path)


def load_evaluation(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVALUATION).option("mode", "FAILFAST").json(path)


def save_summary(summary: DataFrame, path: str) -> None:
    """One line per model, so one file."""
    named = summary.select(*[F.col(c).alias(h) for c, h in SUMMARY_HEADERS.items()])
    named.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def load_summary(spark: SparkSession, path: str) -> DataFrame:
    fields = [
        T.StructField(h, T.StringType() if c == "model" else T.DoubleType()) for c, h in SUMMARY_HEADERS.items()
    ]
    df = spark.read.schema(T.StructType(fields)).option("header", True).option("mode", "FAILFAST").csv(path)
    return df.select(*[F.col(f"`{h}`").alias(c) for c, h in SUMMARY_HEADERS.items()])
