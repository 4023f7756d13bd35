"""Approximate retrieval by random projections: several tables of sign buckets, probed in order of likelihood.

A table cuts the space by ``bits`` planes through the origin; a vector's bucket
is the side of each plane it is on. A query visits its own bucket first, then
those behind the planes it is nearest to: a bucket costs the sum of the squared
distances to the planes that part it from the query. Buckets are split by their
measured size like index cells, and hits are ranked by their exact similarity.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.functions.vectors import check_metric
from pairweave.operators.index import cell_hits
from pairweave.operators.retrieve import (
    PARTIAL_SCHEMA,
    as_items,
    as_queries,
    best_k,
    block_rows_for,
    check_k,
    exact_topk,
    matrix_of,
    measured,
    no_hits,
    unit_rows,
)
from pairweave.session import discard, materialize

MOST_BITS = 12  # a query orders all 2**bits buckets of a table; larger buckets are split instead
BUCKET_ITEMS = 64  # items aimed at in a bucket


def planes(tables: int, bits: int, dim: int, seed: int) -> np.ndarray:
    """Normals of all planes, ``tables * bits`` rows: digits of md5, the same everywhere."""
    digest = lambda t, b, j: hashlib.md5(f"{seed}:{t}:{b}:{j}".encode()).hexdigest()[:8]
    numbers = [[[int(digest(t, b, j), 16) for j in range(dim)] for b in range(bits)] for t in range(tables)]
    return np.array(numbers, float).reshape(tables * bits, dim) / 2**32 - 0.5


@dataclass(frozen=True)
class ProjectionIndex:
    items: DataFrame  # item_id, vector, cell: one row per table
    normals: np.ndarray
    tables: int
    bits: int
    n_items: int


def bits_for(n_items: int, bucket_items: int = BUCKET_ITEMS) -> int:
    return int(min(MOST_BITS, max(1, np.ceil(np.log2(max(2, n_items) / bucket_items)))))


def bucket_numbers(vectors: np.ndarray, normals: np.ndarray, tables: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each vector in each table, and its distances to the planes."""
    away = (unit_rows(vectors) @ normals.T).reshape(len(vectors), tables, bits)
    return ((away >= 0) << np.arange(bits)).sum(axis=2), away


def probe_order(away: np.ndarray, bits: int) -> np.ndarray:
    """All masks of crossed planes of each row of distances, cheapest first, ties by mask."""
    masks = (np.arange(1 << bits)[:, None] >> np.arange(bits)) & 1
    return np.argsort(np.round(away**2 @ masks.T, 12), axis=-1, kind="stable")


def _placed(shared, tables: int, bits: int, id_name: str, probes: int):
    """A row per vector, table and visited bucket; items visit their own only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):  # sizes the arrays of masks
                part = batch.slice(first, 256)
                own, away = bucket_numbers(matrix_of(part.column(1)), normals, tables, bits)
                masks = probe_order(away, bits)[:, :, :probes] if probes > 1 else np.zeros((*own.shape, 1), np.int64)
                cells = (own[:, :, None] ^ masks) + (np.arange(tables) << bits)[None, :, None]
                rows = pa.array(np.repeat(np.arange(part.num_rows), cells[0].size))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(rows), part.column(1).cast(pa.list_(pa.float64())).take(rows), pa.array(cells.ravel().astype("i4"))],
                    names=[id_name, "vector", "cell"],
                )

    return run


def build_projections(
    corpus: DataFrame,
    tables: int = 8,
    bits: int | None = None,
    item_id: str = "vec_id",
    vector: str = "embedding",
    seed: int = 42,
) -> ProjectionIndex:
    """Buckets of every item in every table, written once.

    ``bits`` follows from the number of items unless given. The planes are a
    small matrix of fixed size, which is broadcast.
    """
    items = as_items(corpus, item_id, vector)
    n, width = measured(items)
    bits = bits_for(n) if bits is None else bits
    if not 1 <= bits <= MOST_BITS:
        raise ValueError(f"bits must lie between 1 and {MOST_BITS}")
    normals = planes(tables, bits, width, seed)
    shared = corpus.sparkSession.sparkContext.broadcast(normals)
    schema = "item_id long, vector array<double>, cell int"
    placed = items.mapInArrow(_placed(shared, tables, bits, "item_id", 1), schema)
    return ProjectionIndex(materialize(placed, "projections"), normals, tables, bits, n)


def projection_topk(
    queries: DataFrame,
    index: ProjectionIndex,
    k: int = 5,
    probes: int = 2,
    query_id: str = "vec_id",
    vector: str = "embedding",
    metric: str = "cosine",
    exclude_self: bool = False,
    block_rows: int | None = None,
) -> DataFrame:
    """Top-k among the items of the ``probes`` likeliest buckets of each table.

    An item met in several tables counts once. Exact when ``probes`` reaches the
    number of buckets; a query whose buckets hold fewer than k items gets fewer
    hits, never wrong ones.
    """
    check_metric(metric)
    check_k(k)
    asked = as_queries(queries, query_id, vector)
    if k == 0 or not index.n_items:
        return no_hits(asked)
    block_rows = block_rows or block_rows_for(index.normals.shape[1])
    shared = queries.sparkSession.sparkContext.broadcast(index.normals)
    probes = min(probes, 1 << index.bits)
    visit = asked.mapInArrow(
        _placed(shared, index.tables, index.bits, "query_id", probes), "query_id long, vector array<double>, cell int"
    )
    sizes = materialize(index.items.groupBy("cell").agg(F.count(F.lit(1)).alias("n")), "bucket-sizes")
    hits = cell_hits(materialize(visit, "visits"), index.items, sizes, k, metric, exclude_self, block_rows, index.normals.shape[1])
    once = hits.groupBy("query_id", "item_id").agg(F.max("similarity").alias("similarity"))
    return best_k(once.select(*[c.split()[0] for c in PARTIAL_SCHEMA.split(", ")]), k)


def _places(shared, tables: int, bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        normals = shared.value
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                own, away = bucket_numbers(matrix_of(part.column(0)), normals, tables, bits)
                there, _ = bucket_numbers(matrix_of(part.column(1)), normals, tables, bits)
                at = np.argmax(probe_order(away, bits) == (own ^ there)[:, :, None], axis=2)
                yield pa.RecordBatch.from_arrays([pa.array(at.min(axis=1).astype("i8") + 1)], names=["place"])

    return run


def projection_probes_for(
    queries: DataFrame,
    index: ProjectionIndex,
    corpus: DataFrame,
    k: int = 5,
    recall: float = 0.95,
    query_id: str = "vec_id",
    item_id: str = "vec_id",
    vector: str = "embedding",
    exclude_self: bool = False,
    measured_on: int = 1000,
    seed: int = 42,
) -> int:
    """The fewest probes a table that find a share ``recall`` of the exact hits of ``measured_on`` queries."""
    asked = as_queries(queries, query_id, vector).orderBy(F.xxhash64("query_id", F.lit(seed))).limit(measured_on)
    asked = materialize(asked, "measured-queries")
    items = as_items(corpus, item_id, vector)
    exact = exact_topk(asked, items, k, "query_id", "item_id", "vector", exclude_self=exclude_self)
    both = exact.join(asked, "query_id").join(items.select("item_id", F.col("vector").alias("there")), "item_id")
    shared = queries.sparkSession.sparkContext.broadcast(index.normals)
    places = both.select("vector", "there").mapInArrow(_places(shared, index.tables, index.bits), "place long")
    found = places.agg(F.expr(f"percentile_disc({recall}) within group (order by place)")).first()[0]
    discard(asked)
    return int(found) if found is not None else 1
