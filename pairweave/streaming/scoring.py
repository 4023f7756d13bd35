"""Resumable scoring as file streams: new files, or new rows, are scored once, ever.

The checkpoint holds what has been read, the parquet sink commits exactly once,
so a stopped or repeated run continues where the last one ended. Paths belong
in the shared folder of the cluster.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


STATE_CLASS = "spark.sql.streaming.stateStore.providerClass"
ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_on_disk(spark: SparkSession) -> Iterator[None]:
    """Streams started inside keep their state on disk and in the checkpoint, not in the heap."""
    before = spark.conf.get(STATE_CLASS)
    spark.conf.set(STATE_CLASS, ON_DISK)
    try:
        yield
    finally:
        spark.conf.set(STATE_CLASS, before)


def score_new_files(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> None:
    """Score every file of ``source`` that no earlier run has read, then stop."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        score(reader.parquet(source))
        .writeStream.format("parquet")
        .option("path", sink)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def score_new_rows(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    index: str,
    score: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    files_per_batch: int | None = None,
    done: DataFrame | None = None,
) -> None:
    """Score every row index of ``source`` that no earlier batch or run has scored, then stop.

    Files may repeat rows: which indexes are done is keyed state, spread over the
    shuffle partitions and kept with the checkpoint. It holds one key per index
    ever scored, so a row is moved once, by its index, before it is scored. Of
    rows that arrive under one index in one batch any one is scored. ``done``
    lists indexes that were scored elsewhere. A row without an index is an error.
    """
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    missing = F.raise_error(F.lit(f"row without {index}")).cast(schema[index].dataType)
    rows = reader.parquet(source).withColumn(index, F.coalesce(index, missing))
    if done is not None:
        rows = rows.join(done.select(index), index, "left_anti")
    with state_on_disk(spark):
        query = (
            score(rows.dropDuplicates([index]))
            .writeStream.format("parquet")
            .option("path", sink)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def track_quality(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    partials: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> None:
    """Store the partial aggregates of each batch under its batch number.

    A repeated batch overwrites its own folder, so the sum over all folders is
    right after any failure, and no state grows with the number of chunks.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        partials(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    query = (
        reader.parquet(source)
        .writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def track_totals(
    spark: SparkSession,
    source: str,
    schema: T.StructType,
    totals: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    files_per_batch: int | None = None,
) -> None:
    """Running totals as a streaming aggregation in update mode.

    The state holds one row per chunk. A batch stores the new totals of the chunks
    it touched under its number, and a repeated batch overwrites its own folder.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    with state_on_disk(spark):
        query = (
            totals(reader.parquet(source))
            .writeStream.outputMode("update")
            .foreachBatch(store)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )
    query.awaitTermination()


def chunk_partials(index: str, chunk_rows: int, score: str, label: str, threshold: float = 0.5):
    """Counts per chunk that add up over batches."""

    def build(batch: DataFrame) -> DataFrame:
        predicted = (F.col(score) >= threshold).cast("int")
        return batch.groupBy(F.floor(F.col(index) / F.lit(chunk_rows)).alias("chunk")).agg(
            F.count(F.lit(1)).alias("rows"),
            F.count(score).alias("scored"),
            F.count_if(predicted == F.col(label)).alias("correct"),
        )

    return build


def quality_report(spark: SparkSession, sink: str) -> DataFrame:
    """Progress and accuracy per chunk from all stored partials."""
    summed = (
        spark.read.parquet(sink)
        .groupBy("chunk")
        .agg(F.sum("rows").alias("rows"), F.sum("scored").alias("scored"), F.sum("correct").alias("correct"))
    )
    return with_shares(summed)


def latest_totals(spark: SparkSession, sink: str) -> DataFrame:
    """The same report from running totals: of each chunk, what its last batch stored."""
    counts = ("rows", "scored", "correct")
    last = spark.read.parquet(sink).groupBy("chunk").agg(F.max_by(F.struct(*counts), "batch").alias("last"))
    return with_shares(last.select("chunk", *[F.col(f"last.{c}").alias(c) for c in counts]))


def with_shares(counted: DataFrame) -> DataFrame:
    share = lambda a, b: F.when(F.col(b) != 0, F.col(a) / F.col(b))
    return counted.withColumn("completion", share("scored", "rows") * 100).withColumn(
        "accuracy", share("correct", "scored")
    )
