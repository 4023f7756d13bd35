"""Exact top-k retrieval: every query against every corpus vector.

Two physical forms of one result:

* ``broadcast`` - the query vectors, whose size is counted first, go to every
  task and the corpus is scanned in place in its own splits. No corpus row is
  shuffled; each task keeps a running top-k and emits at most k rows per query.
  Queries beyond the limit are cut into chunks, each of which is one scan.
* ``grid`` - for more than ``CHUNKS`` such scans: both sides are cut into parts as large as a task's memory and the
  number of tasks allow, a cell of the grid scores one query part against one corpus part in steps, and only its
  top-k leaves the task. Any number of queries fits, and few parts mean few copies.

Pairs are never emitted; what is shuffled afterwards is k rows per query and
task. Order: similarity (12 decimals) descending, then item id.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairweave.functions.vectors import RANK_DIGITS, check_metric, similarity
from pairweave.session import discard, materialize

PARTIAL_SCHEMA = "query_id long, item_id long, similarity double"
BROADCAST_BYTES = 64 << 20
BLOCK_BYTES = 256 << 20
PART_BYTES = 32 << 20  # doubles of one side of a grid cell, which a task holds a few times
CELLS_PER_CORE = 4
CHUNKS = 16
SCORES_IN_MEMORY = 1_000_000  # one score matrix in a task: 8 MB of doubles
ITEMS_AT_ONCE = 8_192
QUERIES_AT_ONCE = 512  # their candidates are cut to k before the next ones are scored
SLACK = 2.0 * 10.0**-RANK_DIGITS


def matrix_of(vectors: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Rows of a list column as a double matrix; all lists must be of one length."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype("f8")
    n = len(vectors)
    lengths = np.diff(vectors.offsets.to_numpy())
    if n and (lengths != lengths[0]).any():
        raise ValueError("vectors of different length in one column")
    return flat.reshape(n, -1)


def unit_rows(m: np.ndarray) -> np.ndarray:
    """Rows divided by their length; zero rows stay zero, so their cosine is 0."""
    lengths = np.sqrt(np.einsum("ij,ij->i", m, m))
    return m / np.where(lengths == 0.0, 1.0, lengths)[:, None]


def block_candidates(
    queries: np.ndarray,
    query_ids: np.ndarray,
    items: np.ndarray,
    item_ids: np.ndarray,
    k: int,
    exclude_self: bool,
    floor: np.ndarray | None = None,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, item id, score) of all scores that can be in a top-k.

    Keeps everything down to each query's k-th score, ties included, where the
    k-th score is that of this block or ``floor``, the one known so far. Only
    kept scores are rounded; ``SLACK`` covers what rounding can change.
    """
    # a query's own item, if present, may take places among the best
    places = k + (np.unique(item_ids, return_counts=True)[1].max() if exclude_self else 0)
    width = len(item_ids)
    step = max(1, SCORES_IN_MEMORY // max(1, width))
    rows, ids, scores = [], [], []
    for start in range(0, len(query_ids), step):
        s = queries[start : start + step] @ items.T
        low = np.full(len(s), -np.inf) if floor is None else floor[start : start + step] - SLACK
        at = None if np.isneginf(low).any() else np.flatnonzero(s >= low[:, None])
        if at is None or len(at) > 8 * places * len(s):
            if width > places:
                low = np.maximum(low, np.partition(s, width - places, axis=1)[:, width - places] - SLACK)
            at = np.flatnonzero(s >= low[:, None])
        r, c = np.divmod(at, width)
        if exclude_self:
            other = query_ids[start + r] != item_ids[c]
            at, r, c = at[other], r[other], c[other]
        rows.append(start + r)
        ids.append(item_ids[c])
        scores.append(np.round(s.ravel()[at], RANK_DIGITS))
    return np.concatenate(rows), np.concatenate(ids), np.concatenate(scores)


def cut(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """Best k entries of each row number, in order."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]]) if len(rows) else np.array([], int)
    sizes = np.diff(np.r_[starts, len(rows)])
    place = np.arange(len(rows)) - np.repeat(starts, sizes)
    keep = place < k
    return rows[keep], ids[keep], scores[keep], place[keep]


def hits_batch(query_ids, rows, ids, scores) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(query_ids[rows], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.float64())],
        names=["query_id", "item_id", "similarity"],
    )


def running_best(
    queries: np.ndarray,
    query_ids: np.ndarray,
    blocks: Iterator[tuple[np.ndarray, np.ndarray]],
    k: int,
    exclude_self: bool,
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Top-k over blocks of (item ids, item vectors) as (query position, item id, score).

    The k-th score found so far is the floor for the next block, so later
    blocks contribute few candidates.
    """
    none = (np.array([], "i8"), np.array([], "i8"), np.array([], "f8"))
    slices = [slice(a, a + QUERIES_AT_ONCE) for a in range(0, len(query_ids), QUERIES_AT_ONCE)]
    best = [none] * len(slices)
    floor, last = np.full(len(query_ids), -np.inf), np.full(len(query_ids), np.iinfo("i8").max)
    for item_ids, items in blocks:
        if items.shape[1] != queries.shape[1]:
            raise ValueError("query and corpus vectors differ in length")
        for n, part in enumerate(slices):
            rows, ids, scores = block_candidates(queries[part], query_ids[part], items, item_ids, k, exclude_self, floor[part])
            low = floor[part][rows]
            enters = (scores > low) | ((scores == low) & (ids < last[part][rows])) | np.isneginf(low) | np.isnan(scores)
            if enters.any():
                new = rows[enters], ids[enters], scores[enters]
                rows, ids, scores, place = cut(*[np.concatenate(pair) for pair in zip(best[n], new)], k)
                full = place == k - 1
                floor[part.start + rows[full]], last[part.start + rows[full]] = scores[full], ids[full]
                best[n] = (rows, ids, scores)
    if not best:
        return none
    shifted = [(rows + part.start, ids, scores) for part, (rows, ids, scores) in zip(slices, best)]
    return tuple(np.concatenate(column) for column in zip(*shifted))


def scan_kernel(shared, k: int, metric: str, exclude_self: bool):
    """Task body of the broadcast form: running top-k over the corpus batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value

        def blocks():
            for batch in batches:
                if batch.num_rows:
                    items = matrix_of(batch.column(1))
                    yield batch.column(0).to_numpy(), unit_rows(items) if metric == "cosine" else items

        rows, ids, scores = running_best(queries, query_ids, blocks(), k, exclude_self)
        for start in range(0, len(rows), 100_000):
            part = slice(start, start + 100_000)
            yield hits_batch(query_ids, rows[part], ids[part], scores[part])

    return run


def cell_kernel(k: int, metric: str, exclude_self: bool):
    """Task body of one grid cell: bounded query block against bounded corpus block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            empty = np.array([], "i8")
            return pa.Table.from_batches([hits_batch(empty, empty, empty, np.array([], "f8"))])
        queries, items = matrix_of(left["vector"]), matrix_of(right["vector"])
        if metric == "cosine":
            queries, items = unit_rows(queries), unit_rows(items)
        query_ids, item_ids = left["query_id"].to_numpy(), right["item_id"].to_numpy()
        parts = [slice(i, i + ITEMS_AT_ONCE) for i in range(0, len(item_ids), ITEMS_AT_ONCE)]
        blocks = ((item_ids[p], items[p]) for p in parts)
        best = running_best(queries, query_ids, blocks, k, exclude_self)
        return pa.Table.from_batches([hits_batch(query_ids, *best)])

    return run


def best_k(partial: DataFrame, k: int) -> DataFrame:
    """Merge partial results into ranks 1..k per query."""
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), F.asc("item_id"))
    ranked = partial.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "item_id", "similarity")


def as_queries(df: DataFrame, query_id: str, vector: str) -> DataFrame:
    return df.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("vector")).where(
        F.col("vector").isNotNull()
    )


def as_items(df: DataFrame, item_id: str, vector: str) -> DataFrame:
    return df.select(F.col(item_id).cast("long").alias("item_id"), F.col(vector).alias("vector")).where(
        F.col("vector").isNotNull()
    )


def check_k(k: int) -> int:
    if k < 0:
        raise ValueError("k must not be negative")
    return k


def block_rows_for(width: int) -> int:
    """Vectors of this length that make a block of ``BLOCK_BYTES`` floats."""
    return max(1_024, BLOCK_BYTES // (4 * max(1, width)))


def measured(vectors: DataFrame) -> tuple[int, int]:
    """Row count and vector length, by one small aggregate."""
    n, shortest, longest = vectors.agg(
        F.count(F.lit(1)), F.min(F.size("vector")), F.max(F.size("vector"))
    ).first()
    if n and shortest != longest:
        raise ValueError("vectors of different length in one column")
    return n, longest or 0


def scan_topk(queries: DataFrame, items: DataFrame, k: int, metric: str, exclude_self: bool, chunks: int = 1) -> DataFrame:
    """Broadcast form; the caller has checked the size of a chunk of ``queries``.

    Every task emits at most k rows per query, of which the merge keeps k per
    query before its shuffle.
    """
    context, found = queries.sparkSession.sparkContext, None
    for c in range(chunks):
        part = queries if chunks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(chunks)) == c)
        table = part.toArrow()
        if not table.num_rows:
            continue
        matrix = matrix_of(table["vector"])
        shared = context.broadcast(
            (table["query_id"].to_numpy(), unit_rows(matrix) if metric == "cosine" else matrix)
        )
        partial = items.mapInArrow(scan_kernel(shared, k, metric, exclude_self), PARTIAL_SCHEMA)
        found = partial if found is None else found.unionByName(partial)
    if found is None:
        return no_hits(queries)
    return best_k(found, k)


def no_hits(queries: DataFrame) -> DataFrame:
    return queries.sparkSession.createDataFrame([], "query_id long, rank int, item_id long, similarity double")


def part_rows_for(width: int) -> int:
    """Vectors of this length that make a part of ``PART_BYTES`` doubles."""
    return max(1_024, PART_BYTES // (8 * max(1, width)))


def grid_parts(n_queries: int, n_items: int, most: int, least: int, cells: int) -> tuple[int, int]:
    """Into how many parts to cut queries and items.

    No part has more than ``most`` rows. Beyond that the larger parts are cut
    until there are ``cells`` cells, but not below ``least`` rows: each cut costs
    one more copy of the other side.
    """
    parts, sizes = [max(1, -(-n // most)) for n in (n_queries, n_items)], (n_queries, n_items)
    while parts[0] * parts[1] < cells:
        side = 0 if sizes[0] / parts[0] >= sizes[1] / parts[1] else 1
        if sizes[side] / (parts[side] + 1) < least:
            break
        parts[side] += 1
    return parts[0], parts[1]


def grid_topk(
    queries: DataFrame, items: DataFrame, k: int, metric: str, exclude_self: bool, n_queries: int, block_rows: int, width: int = 0
) -> DataFrame:
    """Grid form: cells of one query part and one item part.

    Parts are made by the hash of unique ids, so they are even; each side is
    copied once per part of the other. ``block_rows`` is the size below which a
    part is not cut only to keep more cores busy.
    """
    cores = queries.sparkSession.sparkContext.defaultParallelism
    width = width or measured(queries)[1]
    query_parts, item_parts = grid_parts(n_queries, items.count(), part_rows_for(width), min(block_rows, ITEMS_AT_ONCE), cores * CELLS_PER_CORE)
    left = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int")).withColumn(
        "cb", F.explode(F.sequence(F.lit(0), F.lit(item_parts - 1)))
    )
    right = items.withColumn("cb", F.pmod(F.xxhash64("item_id"), F.lit(item_parts)).cast("int")).withColumn(
        "qb", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1)))
    )
    cells = left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb"))
    return best_k(cells.applyInArrow(cell_kernel(k, metric, exclude_self), PARTIAL_SCHEMA), k)


def distinct_topk(queries: DataFrame, items: DataFrame, k: int, search) -> DataFrame | None:
    """Top-k where equal vectors are compared once; None where ids do not tell vectors apart.

    Of items with one vector only the k smallest ids can be hits, and they are
    found together: ``search(queries, items)`` gets the first of each. A query
    takes the hits of its vector.
    """
    order = W.partitionBy("vector").orderBy("item_id")
    kept = items.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    kept = materialize(kept.withColumn("first", F.min("item_id").over(W.partitionBy("vector"))), "vector-items")
    asked = materialize(queries.groupBy("vector").agg(F.min("query_id").alias("first")), "vector-queries")
    firsts = kept.where("place = 1")
    for df, name in ((firsts, "item_id"), (asked, "first")):
        n, given, different = df.agg(F.count(F.lit(1)), F.count(name), F.count_distinct(name)).first()
        if not n == given == different:
            discard(kept, asked)
            return None
    found = search(asked.select(F.col("first").alias("query_id"), "vector"), firsts.select("item_id", "vector"))
    found = found.select(F.col("query_id"), F.col("item_id").alias("first"), "similarity")
    whole = best_k(found.join(kept.select("first", "item_id"), "first").select("query_id", "item_id", "similarity"), k)
    whole = whole.withColumnRenamed("query_id", "first").drop("rank")
    named = queries.join(asked, "vector").select("query_id", "first")
    return best_k(named.join(whole, "first").select("query_id", "item_id", "similarity"), k)


def exact_topk(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = 5,
    query_id: str = "vec_id",
    item_id: str = "vec_id",
    vector: str = "embedding",
    item_vector: str | None = None,
    metric: str = "cosine",
    exclude_self: bool | None = None,
    strategy: str = "auto",
    broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int | None = None,
    distinct: bool = False,
) -> DataFrame:
    """The k most similar corpus items of every query.

    ``exclude_self`` defaults to true when queries and corpus are one table.
    A corpus smaller than k returns whole; k = 0 returns nothing.
    ``strategy``: ``auto`` takes ``broadcast`` while the query vectors fit in
    ``CHUNKS`` chunks of ``broadcast_bytes`` and ``grid`` beyond that. With
    ``distinct`` equal vectors are scored once, for sides that repeat many (not
    together with ``exclude_self``).
    """
    check_metric(metric)
    check_k(k)
    if exclude_self is None:
        exclude_self = queries is corpus
    left = as_queries(queries, query_id, vector)
    right = as_items(corpus, item_id, item_vector or vector)
    if k == 0:
        return no_hits(left)
    if strategy not in ("auto", "broadcast", "grid"):
        raise ValueError(f"unknown strategy: {strategy!r}")
    if distinct and not exclude_self:
        search = lambda q, i: exact_topk(
            q, i, k, "query_id", "item_id", "vector", None, metric, False, strategy, broadcast_bytes, block_rows
        )
        left, right = materialize(left, "query-vectors"), materialize(right, "item-vectors")
        found = distinct_topk(left, right, k, search)
        if found is not None:
            return found
    n, width = measured(left)
    if strategy != "grid":
        chunks = max(1, -(-n * (width * 8 + 16 * k) // broadcast_bytes))
        if strategy == "broadcast" and chunks > CHUNKS:
            raise ValueError(f"{n} query vectors exceed {CHUNKS} chunks of broadcast_bytes={broadcast_bytes}")
        if chunks <= CHUNKS:
            return scan_topk(left, right, k, metric, exclude_self, chunks)
    return grid_topk(left, right, k, metric, exclude_self, n, block_rows or block_rows_for(width), width)


def similarity_to_vector(
    corpus: DataFrame, vector: Column | Sequence[float], item_vector: str = "embedding", metric: str = "cosine"
) -> DataFrame:
    """One vector against many; ``vector`` is a list or a scalar subquery."""
    given = vector if isinstance(vector, Column) else F.lit([float(x) for x in vector])
    scored = corpus.withColumn("__vector", given)
    return scored.withColumn("similarity", similarity("__vector", item_vector, metric)).drop("__vector")


def with_text(hits: DataFrame, texts: DataFrame, item_id: str, text: str = "text") -> DataFrame:
    """Attach the sentence of each hit; a hit without a text keeps a null."""
    lookup = texts.select(F.col(item_id).cast("long").alias("item_id"), F.col(text).alias("sentence"))
    return hits.join(lookup, "item_id", "left")
