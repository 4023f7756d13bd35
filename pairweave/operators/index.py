"""Approximate retrieval: cells around centroids, walking the cells nearest to a query.

The index is a table of ``(item_id, vector, cell)`` plus the centroids, trained
by k-means or given. A query walks its nearest cells until it has seen enough of
them and they hold enough items, so it always gets its k hits. Centroids are
broadcast while they fit a checked size; beyond it the nearest cells come from
the block grid of exact retrieval. Cells are uneven, so a cell is cut into
sub-blocks by its measured size on both the item and the query side.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairweave.functions.vectors import check_metric, scaled_to_unit
from pairweave.operators.retrieve import (
    BROADCAST_BYTES,
    CELLS_PER_CORE,
    ITEMS_AT_ONCE,
    PARTIAL_SCHEMA,
    as_items,
    as_queries,
    best_k,
    block_rows_for,
    cell_kernel,
    check_k,
    exact_topk,
    grid_topk,
    matrix_of,
    measured,
    part_rows_for,
    unit_rows,
)
from pairweave.session import discard, materialize

CENTROID_SCHEMA = "cell int, vector array<double>"


@dataclass(frozen=True)
class VectorIndex:
    items: DataFrame
    centroids: DataFrame
    cells: int


def nearest_broadcast(df: DataFrame, id_name: str, numbers: np.ndarray, centers: np.ndarray, sizes, least: int, items: int):
    """One row per vector and walked cell, in one pass over ``df``."""
    shared = df.sparkSession.sparkContext.broadcast((numbers, centers, sizes))
    schema = f"{id_name} long, vector array<double>, cell int"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, held = shared.value
        half = 0.5 * np.einsum("ij,ij->i", c, c)
        for batch in batches:
            if batch.num_rows == 0:
                continue
            vectors = unit_rows(matrix_of(batch.column(1)))
            order = np.argsort(half[None, :] - vectors @ c.T, axis=1, kind="stable")
            before = np.cumsum(held[order], axis=1) - held[order]
            walked = (np.arange(len(names))[None, :] < least) | (before < items)
            rows = np.repeat(np.arange(batch.num_rows), walked.sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows)),
                    batch.column(1).cast(pa.list_(pa.float64())).take(pa.array(rows)),
                    pa.array(names[order[walked]].astype("i4")),
                ],
                names=[id_name, "vector", "cell"],
            )

    return df.mapInArrow(run, schema)


def nearest_grid(df: DataFrame, id_name: str, centroids: DataFrame, sizes: DataFrame | None, least: int, items: int):
    """The same for any number of centroids.

    The nearest centroid has the largest ``v.c - |c|^2 / 2``: a dot product once
    both sides have one component more. Every counted cell holds an item, so no
    walk is longer than ``max(least, items)`` cells.
    """
    longest = max(least, items)
    unit = scaled_to_unit("vector")
    half = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x) / -2
    asked = df.select(F.col(id_name).alias("query_id"), F.concat(unit, F.array(F.lit(1.0))).alias("vector"))
    cells = centroids.select(F.col("cell").cast("long").alias("item_id"), F.concat("vector", F.array(half)).alias("vector"))
    n, width = measured(asked)
    near = grid_topk(asked, cells, longest, "dot", False, n, block_rows_for(width), width)
    near = near.select(F.col("query_id").alias(id_name), "rank", F.col("item_id").cast("int").alias("cell"))
    if sizes is not None:
        order = W.partitionBy(id_name).orderBy("rank").rowsBetween(W.unboundedPreceding, -1)
        counted = near.join(sizes, "cell").withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
        near = counted.where((F.col("rank") <= least) | (F.col("before") < items))
    return df.join(near.select(id_name, "cell"), id_name).select(id_name, F.col("vector").cast("array<double>").alias("vector"), "cell")


def nearest_cells(
    df: DataFrame,
    id_name: str,
    centroids: DataFrame,
    sizes: DataFrame | None = None,
    least: int = 1,
    items: int = 0,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Cells that each vector walks: ``least`` of them, and more until they hold ``items`` items.

    Without ``sizes`` that is the nearest cells only. What is broadcast is
    checked, whether the centroids were trained, loaded or handed in.
    """
    if sizes is not None:
        centroids = centroids.join(sizes, "cell")
    n, width = measured(centroids)
    if n * (width + 2) * 8 > broadcast_bytes:
        return nearest_grid(df, id_name, centroids.select("cell", "vector"), sizes, least, items)
    rows = centroids.orderBy("cell").toArrow()
    held = rows["n"].to_numpy() if sizes is not None else np.zeros(n, "i8")
    return nearest_broadcast(df, id_name, rows["cell"].to_numpy(), matrix_of(rows["vector"]), held, least, items)


def trained_centroids(items: DataFrame, cells: int, seed: int, share: float = 1.0) -> DataFrame:
    """k-means over all items, or over a ``share`` of them that the caller chooses."""
    rows = items if share >= 1.0 else items.where(F.pmod(F.xxhash64("item_id", F.lit(seed)), F.lit(1 << 30)) < share * (1 << 30))
    training = materialize(rows.select(array_to_vector(scaled_to_unit("vector")).alias("features")), "training")
    model = KMeans(k=cells, seed=seed, maxIter=10).fit(training)
    centers = [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())]
    discard(training)
    return items.sparkSession.createDataFrame(centers, CENTROID_SCHEMA)


def build_index(
    corpus: DataFrame,
    cells: int = 16,
    item_id: str = "vec_id",
    vector: str = "embedding",
    seed: int = 42,
    path: str | None = None,
    centroids: DataFrame | None = None,
    training_share: float = 1.0,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> VectorIndex:
    """Assign every item to its nearest centroid; with ``path`` the index is stored there.

    ``centroids``, ``(cell, vector)`` of any number, take the place of training.
    The assignment is written once either way.
    """
    items = as_items(corpus, item_id, vector)
    spark = corpus.sparkSession
    if centroids is None:
        centroids = trained_centroids(items, cells, seed, training_share)
    given = centroids.select(F.col("cell").cast("int").alias("cell"), F.col("vector").cast("array<double>").alias("vector"))
    centroids = materialize(given, "centroids") if path is None else given
    assigned = nearest_cells(items, "item_id", centroids, broadcast_bytes=broadcast_bytes)
    if path is None:
        return VectorIndex(materialize(assigned, "index"), centroids, centroids.count())
    assigned.repartition("cell", F.pmod(F.xxhash64("item_id"), F.lit(16))).write.mode("overwrite").partitionBy(
        "cell"
    ).parquet(f"{path}/items")
    centroids.write.mode("overwrite").parquet(f"{path}/centroids")
    return load_index(spark, path)


def load_index(spark: SparkSession, path: str) -> VectorIndex:
    items = spark.read.schema("item_id long, vector array<double>, cell int").parquet(f"{path}/items")
    centroids = spark.read.schema(CENTROID_SCHEMA).parquet(f"{path}/centroids")
    return VectorIndex(items, centroids, centroids.count())


def index_topk(
    queries: DataFrame,
    index: VectorIndex,
    k: int = 5,
    probes: int = 4,
    query_id: str = "vec_id",
    vector: str = "embedding",
    metric: str = "cosine",
    exclude_self: bool = False,
    block_rows: int | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Top-k among the items of the cells nearest to each query.

    A query walks ``probes`` non-empty cells, and further ones until they hold k
    items besides itself; it gets min(k, items) hits. Exact when ``probes``
    reaches the number of cells.
    """
    check_metric(metric)
    check_k(k)
    width = measured(index.centroids)[1]
    block_rows = block_rows or block_rows_for(width)
    sizes = materialize(index.items.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "cell-sizes")
    asked = as_queries(queries, query_id, vector)
    walked = nearest_cells(
        asked, "query_id", index.centroids, sizes, probes, k + int(exclude_self), broadcast_bytes
    )
    return best_k(cell_hits(materialize(walked, "walks"), index.items, sizes, k, metric, exclude_self, block_rows, width), k)


def cell_hits(
    asked: DataFrame, items: DataFrame, sizes: DataFrame, k: int, metric: str, exclude_self: bool, block_rows: int, width: int
) -> DataFrame:
    """``(query_id, item_id, similarity)``: the best k of every walked cell, or part of one.

    ``asked``: ``(query_id, vector, cell)``, stored; ``items``: ``(item_id, vector, cell)``;
    ``sizes``: ``(cell, n)`` of the items. A cell is cut by its measured size on both sides into parts that a task
    can hold. Beyond that only its queries are cut, into as many parts as its share of all comparisons asks for
    to keep the cores busy, none of fewer than ``block_rows``: a part costs one more copy of the cell's items.
    """
    most, cores = part_rows_for(width), asked.sparkSession.sparkContext.defaultParallelism
    parts = lambda n, rows: F.greatest(F.lit(1), F.ceil(n / F.lit(rows))).cast("int")
    asked_sizes = asked.groupBy("cell").agg(F.count(F.lit(1)).alias("asked"))
    both = materialize(sizes.join(asked_sizes, "cell"), "walked-sizes")
    work = both.agg(F.sum(F.col("n").cast("double") * F.col("asked"))).first()[0] or 1.0
    item_blocks = parts(F.col("n"), most)
    busy = F.ceil(F.col("n") * F.col("asked").cast("double") / F.lit(work) * F.lit(cores * CELLS_PER_CORE) / item_blocks)
    query_blocks = F.greatest(parts(F.col("asked"), most), F.least(busy, parts(F.col("asked"), min(block_rows, ITEMS_AT_ONCE))))
    both = both.select("cell", item_blocks.alias("item_blocks"), query_blocks.cast("int").alias("query_blocks"))
    left = asked.join(both, "cell").select(
        "query_id",
        "vector",
        "cell",
        F.pmod(F.xxhash64("query_id"), F.col("query_blocks")).cast("int").alias("qb"),
        F.explode(F.sequence(F.lit(0), F.col("item_blocks") - 1)).alias("cb"),
    )
    right = items.join(both, "cell").select(
        "item_id",
        "vector",
        "cell",
        F.explode(F.sequence(F.lit(0), F.col("query_blocks") - 1)).alias("qb"),
        F.pmod(F.xxhash64("item_id"), F.col("item_blocks")).cast("int").alias("cb"),
    )
    key = ["cell", "qb", "cb"]
    scored = left.groupBy(*key).cogroup(right.groupBy(*key))
    return scored.applyInArrow(cell_kernel(k, metric, exclude_self), PARTIAL_SCHEMA)


def closer_cells(shared):
    """Per row ``(query_id, item_id, vector, cell)``: how many of some centroids are nearer, and the items they hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, c, held, whose, all_own = shared.value
        half = 0.5 * np.einsum("ij,ij->i", c, c)
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = unit_rows(matrix_of(batch.column(2)))
            own = batch.column(3).to_numpy()
            at = np.searchsorted(whose, own)
            mine = all_own[at]
            limit = 0.5 * np.einsum("ij,ij->i", mine, mine) - np.einsum("ij,ij->i", vectors, mine)
            d = half[None, :] - vectors @ c.T
            nearer = (d < limit[:, None]) | ((d == limit[:, None]) & (numbers[None, :] < own[:, None]))
            nearer &= numbers[None, :] != own[:, None]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(nearer.sum(axis=1).astype("i8")), pa.array((nearer * held).sum(axis=1).astype("i8"))],
                names=["query_id", "item_id", "n_closer", "items_closer"],
            )

    return run


def hit_places(hits: DataFrame, asked: DataFrame, index: VectorIndex, needed: int, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """``place`` of each hit: how many probes its query needs to reach it.

    That is one more than the number of cells nearer than the hit's own, or 1
    where those hold fewer than ``needed`` items, as such a walk goes on by
    itself. Numbers of nearer cells add up, so the centroids are sent in parts of
    a checked size, each with the cells of the hits, which are few.
    """
    sizes = index.items.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    centroids = materialize(index.centroids.join(sizes, "cell"), "held-centroids")
    rows = hits.select("query_id", "item_id").join(index.items.select("item_id", "cell"), "item_id")
    rows = materialize(rows.join(asked, "query_id").select("query_id", "item_id", "vector", "cell"), "placed-hits")
    own = centroids.join(rows.select("cell").distinct(), "cell").orderBy("cell").toArrow()
    if not own.num_rows:
        return rows.select("query_id", "item_id", F.lit(1).cast("long").alias("place"))
    n, width = measured(centroids)
    parts, found = max(1, -(-n * (width + 2) * 8 // broadcast_bytes)), None
    for p in range(parts):
        some = centroids.where(F.pmod(F.xxhash64("cell"), F.lit(parts)) == p).orderBy("cell").toArrow()
        if not some.num_rows:
            continue
        shared = asked.sparkSession.sparkContext.broadcast(
            (some["cell"].to_numpy(), matrix_of(some["vector"]), some["n"].to_numpy(), own["cell"].to_numpy(), matrix_of(own["vector"]))
        )
        part = rows.mapInArrow(closer_cells(shared), "query_id long, item_id long, n_closer long, items_closer long")
        found = part if found is None else found.unionByName(part)
    sums = found.groupBy("query_id", "item_id").agg(F.sum("n_closer").alias("c"), F.sum("items_closer").alias("i"))
    return sums.select("query_id", "item_id", F.when(F.col("i") < needed, 1).otherwise(F.col("c") + 1).alias("place"))


def probes_for(
    queries: DataFrame,
    index: VectorIndex,
    k: int = 5,
    recall: float = 0.95,
    query_id: str = "vec_id",
    vector: str = "embedding",
    metric: str = "cosine",
    exclude_self: bool = False,
    measured_on: int = 1000,
    seed: int = 42,
) -> int:
    """The fewest probes whose hits hold a share ``recall`` of the exact ones.

    Measured on ``measured_on`` of the queries, chosen by the hash of their ids,
    in one pass: each exact hit needs as many probes as its cell's place in its
    query's order, and the wanted quantile of these places is the answer.
    """
    asked = as_queries(queries, query_id, vector).orderBy(F.xxhash64("query_id", F.lit(seed))).limit(measured_on)
    asked = materialize(asked, "measured-queries")
    exact = exact_topk(asked, index.items, k, "query_id", "item_id", "vector", metric=metric, exclude_self=exclude_self)
    places = hit_places(exact, asked, index, k + int(exclude_self))
    counted = places.groupBy("place").agg(F.count(F.lit(1)).alias("n"))
    order = W.orderBy("place").rowsBetween(W.unboundedPreceding, 0)  # a row per place: no more than hits were measured
    shares = counted.select("place", (F.sum("n").over(order) / F.sum("n").over(W.partitionBy())).alias("share"))
    found = shares.where(F.col("share") >= recall).agg(F.min("place")).first()[0]
    discard(asked)
    return int(found) if found is not None else 1


def recall_against(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate result also has."""
    found = approximate.select("query_id", "item_id", F.lit(1).alias("found"))
    return exact.join(found, ["query_id", "item_id"], "left").agg(
        F.count(F.lit(1)).alias("exact_hits"),
        F.sum(F.coalesce("found", F.lit(0))).alias("found_hits"),
        F.avg(F.coalesce("found", F.lit(0))).alias("recall"),
    )
