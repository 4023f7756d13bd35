"""Chunks, pending rows, sparse updates and progress of a long scoring run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.operators.ordering import global_index
from pairweave.session import materialize

CHUNK_ROWS = 10_000


def indexed_scan(df: DataFrame, key: str, result_columns: Sequence[str], index: str = "global_index") -> DataFrame:
    """Contiguous row number plus empty result columns that are not there yet."""
    numbered = global_index(df, key, index)
    missing = [c for c in result_columns if c not in df.columns]
    return numbered.select("*", *[F.lit(None).cast("double").alias(c) for c in missing])


def chunk_number(index: str = "global_index", chunk_rows: int = CHUNK_ROWS) -> Column:
    return F.floor(F.col(index) / F.lit(chunk_rows))


def count_and_chunks(df: DataFrame, index: str = "global_index", chunk_rows: int = CHUNK_ROWS) -> DataFrame:
    """Rows per chunk with the table's row and chunk counts."""
    per_chunk = df.groupBy(chunk_number(index, chunk_rows).alias("chunk")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(index).alias("start_index")
    )
    total = df.agg(F.count(F.lit(1))).scalar()
    return per_chunk.select(
        "chunk",
        "start_index",
        "rows",
        total.alias("total_rows"),
        F.ceil(total / F.lit(chunk_rows)).alias("total_chunks"),
    )


def row_lookup(df: DataFrame, position: int, index: str = "global_index") -> DataFrame:
    """The row at a position; the filter reaches the scan of a stored index.

    A position outside the table is an error when the row is read.
    """
    row = df.where(F.col(index) == position)
    found = row.agg(F.count(F.lit(1))).scalar()
    ok = F.when(found >= 1, F.lit(True)).otherwise(
        F.raise_error(F.lit(f"row index {position} out of range")).cast("boolean")
    )
    guard = df.sparkSession.range(1).select(ok.alias("__ok"))
    return guard.join(row, F.col("__ok"), "left").drop("__ok")


def apply_updates(
    df: DataFrame,
    updates: DataFrame,
    result_columns: Sequence[str],
    index: str = "global_index",
    version: str | None = None,
) -> DataFrame:
    """Write sparse results into the result columns; other update columns are ignored.

    ``updates`` has one row per index, or several with a ``version`` column, in
    which case the last value of each column wins.
    """
    known = [c for c in result_columns if c in updates.columns and c in df.columns]
    if version is not None:
        updates = updates.groupBy(index).agg(
            *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col(version))).alias(c) for c in known]
        )
    new = updates.select(index, *[F.col(c).alias(f"__new_{c}") for c in known])
    joined = df.join(new, index, "left")
    return joined.select(
        *[F.coalesce(f"__new_{c}", c).alias(c) if c in known else F.col(c) for c in df.columns]
    )


def unprocessed_rows(df: DataFrame, processed: DataFrame, index: str = "global_index") -> DataFrame:
    return df.join(processed.select(index), index, "left_anti")


def already_done(df: DataFrame, processed: DataFrame, index: str = "global_index") -> DataFrame:
    return df.join(processed.select(index), index, "left_semi")


def merge_results(parts: Sequence[DataFrame], index: str = "global_index") -> DataFrame:
    """All parts as one table in row order."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part, allowMissingColumns=True)
    return merged.orderBy(index)


def progress_report(
    df: DataFrame, processed: DataFrame, index: str = "global_index", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """Done rows per chunk, as shares of the chunk and of the whole table."""
    marked = df.select(index).join(
        processed.select(index).distinct().withColumn("__done", F.lit(1)), index, "left"
    )
    per_chunk = marked.groupBy(chunk_number(index, chunk_rows).alias("chunk")).agg(
        F.count(F.lit(1)).alias("rows"), F.count("__done").alias("done")
    )
    per_chunk = materialize(per_chunk, "chunks")  # one row per chunk, read for the totals and for the report
    rows, done = per_chunk.agg(F.sum("rows")).scalar(), per_chunk.agg(F.sum("done")).scalar()
    return per_chunk.select(
        "chunk",
        "rows",
        "done",
        (F.col("done") * 100.0 / F.col("rows")).alias("chunk_completion"),
        (done * 100.0 / rows).alias("dataset_completion"),
    )
