"""MinHash near-dedup with min-max hashing: each permutation gives two signature values."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairweave.llm.cells import CELL, cell_tables
from pairweave.llm.graph import components
from pairweave.llm.texts import PlacedHasher, groups, lean, mixed, shingles, text_views
from pairweave.session import discard, materialize

PERMUTATIONS = 64  # hash evaluations per shingle; the signature holds twice as many values
BAND_ROWS = 4  # 32 bands of 4: a pair at similarity 0.8 meets in none of them once in 2e7
BLOCK = 1024  # rows of a bucket compared in one task step
BLOCK_SHINGLES = 1 << 22  # and their shingles, 32 MB, if no text has more
SET_BYTES = 1 << 22  # of text whose sets are given back at once
BROADCAST_IDS = 1_000_000  # a longer list of removed ids is joined by shuffle
SLOTS = 1 << 24  # bits of the bitmap of wanted ids, 2 MB
SURE_BELOW = 0.6  # estimates below this are 5.7 standard deviations under 0.8


def _coefficients(permutations: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    random = mixed(np.arange(2 * permutations, dtype=np.uint64) + np.uint64(seed * 1_000_003 + 17)).astype(np.uint32)
    return random[:permutations] | np.uint32(1), random[permutations:]


def min_max(values: np.ndarray, a: np.ndarray, b: np.ndarray, step: int = 2048) -> np.ndarray:
    """Minimum and maximum of ``a * x + b`` modulo 2**32 under every permutation of a set."""
    low = np.full(len(a), 0xFFFFFFFF, np.uint32)
    high = np.zeros(len(a), np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), step):
        y = a[:, None] * x[None, at : at + step]
        y += b[:, None]
        np.minimum(low, y.min(axis=1), out=low)
        np.maximum(high, y.max(axis=1), out=high)
    return np.concatenate([low, high])


def _sketcher(size: int, permutations: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = PlacedHasher(fold=True)
        a, b = _coefficients(permutations, seed)
        for batch in batches:
            counts, digests, signatures = [], [], []
            for view in text_views(batch.column(1)):
                found = np.unique(shingles(hasher.words(view), size)) if view is not None else np.zeros(0, np.uint64)
                counts.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest() if len(found) else None)
                signatures.append(min_max(found, a, b).tobytes() if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), pa.array(signatures, pa.binary())],
                ["id", "n_shingles", "digest", "signature"],
            )

    return run


def band_keys(marks: np.ndarray, rows: int) -> np.ndarray:
    """One key per signature and band of ``rows`` values; the band's number is part of the key."""
    bands = marks.shape[1] // rows
    keys = np.repeat(np.arange(bands, dtype=np.uint64)[None, :], len(marks), axis=0)
    for k in range(rows):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + marks[:, k : bands * rows : rows].astype(np.uint64))
    return keys.view(np.int64)


def _marks(column: pa.Array) -> np.ndarray:
    return np.stack([np.frombuffer(x, np.uint32) for x in column.to_pylist()])


def _bander(rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                keys = band_keys(_marks(batch.column(1)), rows)
                ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(keys.ravel())], ["id", "key"])

    return run


def _setter(size: int, wanted):
    """Sets of the texts whose slot is marked in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, marks = PlacedHasher(fold=True), wanted.value
        for batch in batches:
            slot = batch.column(2).to_numpy()
            batch = batch.filter(pa.array((marks[slot >> 6] >> (slot & 63).astype(np.uint64) & np.uint64(1)).astype(bool)))
            for first, end in groups(batch.column(1), SET_BYTES):
                part = batch.slice(first, end - first)
                sets = [
                    np.unique(shingles(hasher.words(v), size)) if v is not None else np.zeros(0, np.uint64)
                    for v in text_views(part.column(1))
                ]
                ends = np.cumsum([0, *map(len, sets)])
                flat = pa.array(np.concatenate(sets).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "items"]
                )

    return run


class Cell:
    """Rows of one bucket, or of two of its blocks, and the pairs that this cell must compare.

    Left out are pairs of one component, pairs with the bucket's smallest id
    (the star step had them), pairs inside a block that has a cell of its own,
    pairs that already share an earlier band, and pairs whose signatures agree
    too little. What is left is one comparison per pair over all buckets.
    """

    def __init__(self, table: pa.Table, rows: int, least: float):
        self.table, self.least, self.rows = table, least, rows
        self.ids, self.component, self.block = (table.column(c).to_numpy() for c in ("id", "component", "block"))
        self.halves = table.column("left")[0].as_py() != table.column("right")[0].as_py()
        self.star = self.ids == table.column("least")[0].as_py()
        self.marks = _marks(table.column("signature"))
        self.band = int(np.flatnonzero(band_keys(self.marks[:1], rows)[0] == table.column("key")[0].as_py())[0])

    def partners(self, i: int) -> np.ndarray:
        if self.star[i]:
            return np.zeros(0, np.int64)
        fits = (self.component != self.component[i]) & (self.ids > self.ids[i]) & ~self.star
        if self.halves:
            fits &= self.block != self.block[i]
        other = np.flatnonzero(fits)
        if len(other):
            same = self.marks[other] == self.marks[i]
            earlier = same[:, : self.band * self.rows].reshape(len(other), self.band, self.rows).all(axis=2).any(axis=1)
            other = other[(same.mean(axis=1) >= self.least) & ~earlier]
        return other


def _open_rows(rows: int, least: float):
    """Rows that have a pair to compare: never more than came in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cell_tables(batches):
            cell = Cell(table, rows, least)
            wanted = np.zeros(len(cell.ids), bool)
            for i in range(len(cell.ids)):
                other = cell.partners(i)
                wanted[other] = True
                wanted[i] |= len(other) > 0
            if wanted.any():
                yield from table.filter(pa.array(wanted)).combine_chunks().to_batches()

    return run


def _joined(rows: int, least: float, percent: int):
    """Links between components, confirmed on full sets; at most one per row of the cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in cell_tables(batches):
            cell = Cell(table, rows, least)
            items = table.column("items").combine_chunks()
            flat, ends = items.values.to_numpy().view(np.uint64), items.offsets.to_numpy()
            size, group, found = np.diff(ends), cell.component.copy(), []
            for i in range(len(cell.ids)):
                other = cell.partners(i)
                other = other[group[other] != group[i]]
                if not len(other):
                    continue
                own = flat[ends[i] : ends[i + 1]]
                every = np.concatenate([flat[ends[j] : ends[j + 1]] for j in other])
                at = np.minimum(np.searchsorted(own, every), len(own) - 1)
                shared = np.add.reduceat((own[at] == every).astype(np.int64), np.cumsum(size[other]) - size[other])
                for j in other[100 * shared >= percent * (size[i] + size[other] - shared)]:
                    if group[j] != group[i]:
                        found.append((cell.ids[i], cell.ids[j]))
                        group[group == group[j]] = group[i]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*found, strict=True)], ["a", "b"])

    return run


def _sets(texts: DataFrame, ids: DataFrame, size: int, unique: bool) -> DataFrame:
    """Full shingle sets of the texts with these ids.

    Texts are never shuffled. A bitmap of fixed size holds the hash slots of the
    ids and lets the scan skip other texts; the exact join then sees sets only.
    With more ids than slots the bitmap skips less and the result is the same.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(SLOTS).cast("long"))
    bits = ids.select(slot.alias("slot")).selectExpr("slot div 64 as word", "shiftleft(1L, cast(slot % 64 as int)) as bit")
    marks = np.zeros(SLOTS // 64, np.uint64)
    for row in bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toLocalIterator():
        marks[row["word"]] = row["bits"] & 0xFFFFFFFFFFFFFFFF
    sent = texts.sparkSession.sparkContext.broadcast(marks)
    sets = texts.where("id is not null").select("id", "text", slot.alias("slot"))
    sets = sets.mapInArrow(lean(_setter(size, sent)), "id long, items array<long>").join(ids, "id", "left_semi")
    return sets if unique else sets.dropDuplicates(["id", "items"])


def _verified(pairs: DataFrame, texts: DataFrame, size: int, percent: int, unique: bool) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity; sets are built only for texts in a pair."""
    pairs = materialize(pairs, "pairs")
    wanted = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
    sets = materialize(_sets(texts, wanted, size, unique), "sets")
    one, two = sets.withColumnsRenamed({"id": "a", "items": "x"}), sets.withColumnsRenamed({"id": "b", "items": "y"})
    both = pairs.join(two, "b").join(one, "a")
    same = F.size(F.array_intersect("x", "y"))
    linked = both.where(100 * same >= percent * (F.size("x") + F.size("y") - same)).select("a", "b")
    linked = materialize(linked.distinct(), "links")
    discard(pairs, sets)
    return linked


def near_duplicates(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    permutations: int = PERMUTATIONS,
    band_rows: int = BAND_ROWS,
    seed: int = 1,
) -> DataFrame:
    """One row per document: ``id``, ``n_shingles``, ``component_id``, ``kept``.

    A document's set holds its distinct runs of ``size`` words, A-Z lower-cased;
    a shorter text is one run. Documents link when 100 * shared >= percent * all
    runs of both. Components are numbered by their smallest id, which is kept.

    1. Texts with equal sets fall into one class; its smallest id stands for it.
    2. Min-max signatures are banded. In each bucket every class is checked
       against the smallest one, so candidates grow with rows, not with pairs.
    3. After components of those links, only buckets that still hold several
       components are compared pair by pair, in cells of bounded size; pairs
       inside one component need no check, and a pair is compared in the first
       bucket it shares. A cell gives back rows, then at most one link per row,
       never pairs. Every link is confirmed on full sets.

    Null, empty and blank texts have an empty set, link with nothing and are
    kept. A null id gives a null component and is kept. Rows repeated under one
    id are all returned, each placed by its own text. Only the id and text columns are read; an
    empty table gives an empty result.
    """
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    schema = "id long, n_shingles long, digest binary, signature binary"
    sketches = materialize(texts.mapInArrow(lean(_sketcher(size, permutations, seed)), schema), "sketches")
    full = sketches.where("n_shingles > 0 and id is not null")
    of_set = full.groupBy("digest", "signature").agg(F.min("id").alias("id"), F.max("n_shingles").alias("size"))
    classes = materialize(of_set, "classes")

    keys = classes.select("id", "signature").mapInArrow(lean(_bander(band_rows)), "id long, key long")
    shared = keys.groupBy("key").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1")
    members = materialize(keys.join(shared, "key"), "members")
    # texts repeated under one id would multiply in the joins on it
    unique = full.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty()
    pairs = members.where("id != least").select(F.col("least").alias("a"), F.col("id").alias("b")).distinct()
    stars = _verified(pairs, texts, size, percent, unique)
    found = materialize(components(stars), "components")

    named = members.where("n > 2").join(found, "id", "left")
    named = named.select("key", "n", "id", "least", F.coalesce("component_id", "id").alias("component"))
    mixed_keys = named.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi"))
    open_rows = named.join(mixed_keys.where("lo != hi").select("key"), "key", "left_semi")
    open_rows = materialize(open_rows.join(classes.select("id", "size"), "id"), "open-ids")
    # a bucket's blocks are bounded by rows and by the shingles that will be fetched for them
    weights = open_rows.groupBy("key").agg(F.sum("size").alias("weight")).where(F.col("weight") > BLOCK_SHINGLES)
    open_ids, open_rows = open_rows, open_rows.join(weights, "key", "left").join(classes.select("id", "signature"), "id")
    halves = F.ceil(F.greatest(F.col("n") / F.lit(BLOCK), F.col("weight") / F.lit(BLOCK_SHINGLES))).cast("int")
    cells = open_rows.withColumn("block", F.pmod(F.xxhash64("id"), halves).cast("int")).withColumn(
        "other", F.explode(F.sequence(F.lit(0), halves - 1))
    )
    cells = cells.select(
        "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", "id",
        "least", "component", "signature",
    )
    cell_schema = "key long, left int, right int, block int, id long, least long, component long, signature binary"
    least = SURE_BELOW * percent / 80
    cells = cells.repartition(*CELL).sortWithinPartitions(*CELL)
    wanted = materialize(cells.mapInArrow(lean(_open_rows(band_rows, least)), cell_schema), "open")
    filled = wanted.join(_sets(texts, wanted.select("id").distinct(), size, unique), "id").select(*wanted.columns, "items")
    filled = filled.repartition(*CELL).sortWithinPartitions(*CELL)
    cross = materialize(filled.mapInArrow(lean(_joined(band_rows, least, percent)), "a long, b long"), "cross")
    if not cross.isEmpty():
        known = found.select(F.col("component_id").alias("a"), F.col("id").alias("b"))
        whole = materialize(components(known.unionByName(cross)), "components")
        discard(found)
        found = whole
    discard(members, open_ids, stars, cross, wanted)

    of_class = classes.join(found, "id", "left").select("digest", F.coalesce("component_id", "id").alias("component_id"))
    rows = sketches.drop("signature").join(of_class, "digest", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("id"))
    component = F.when(F.col("id").isNotNull(), component)
    kept = F.coalesce(F.col("id") == component, F.lit(True))
    return rows.select(F.col("id").alias(id), "n_shingles", component.alias("component_id"), kept.alias("kept"))


def without_near_duplicates(docs: DataFrame, id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """One row of each group of near duplicates, all columns as they were.

    Only the ids of rows that go are joined, broadcast up to a checked number.
    Rows without an id stay. Rows under one id are one node of the groups, whatever
    their texts, so ids should be unique. Of rows repeated under a kept id one stays, the one
    whose text hashes lowest; it is found by a top-1 per task before any shuffle.
    """
    clear = "_" * (1 + max((len(c) - len(c.lstrip("_")) for c in docs.columns), default=0))
    here, row = clear + "id", clear + "row"  # names that no column has
    marked = near_duplicates(docs, id, text, **options).where(F.col(id).isNotNull())
    marked = marked.groupBy(F.col(id).alias(here)).agg(F.count(F.lit(1)).alias("n"), F.max("kept").alias("kept"))
    marked = materialize(marked.where("not kept or n > 1"), "marked")
    same = F.col(id) == F.col(here)

    def listed(condition: str) -> DataFrame:
        ids = marked.where(condition).select(here)
        return F.broadcast(ids) if marked.count() <= BROADCAST_IDS else ids

    kept = docs.join(listed("not kept"), same, "left_anti")
    if marked.where("kept").isEmpty():
        return kept
    first = W.partitionBy(id).orderBy(F.xxhash64(text))
    several = kept.join(listed("kept"), same, "left_semi").withColumn(row, F.row_number().over(first))
    return kept.join(listed("kept"), same, "left_anti").unionByName(several.where(F.col(row) == 1).drop(row))
