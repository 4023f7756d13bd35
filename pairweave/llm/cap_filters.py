"""Embedding near-dedup with spherical-cap filters from structured random product codes.

A filter is a direction; a vector passes it when their inner product exceeds a
bound. Directions are pairs of code words, one from either half of the rotated
space, so a vector's filters are list-decoded from two short score lists instead
of being tried one by one. Vectors that share a filter are compared exactly. Very
short vectors are placed in the cells of a grid instead.
"""

from __future__ import annotations

import hashlib
import itertools
import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from pairweave.llm.cells import CELL, cell_tables
from pairweave.llm.graph import components
from pairweave.llm.texts import lean
from pairweave.session import discard, materialize

TURNS = 12  # independent rotations and code books; few vectors are unlucky in all of them
BUCKET = 128  # vectors of unrelated directions expected in a filter
SHARED = 24  # filters that two vectors at the least similarity are expected to share, all turns together
EVEN = 32  # shorter vectors get more filters in proportion, as lengths of short code words differ more
SHORT = 4  # vectors up to this length are placed in a grid, which misses nothing
BLOCK = 1024  # rows of a filter compared in one task step
HOT_KEYS = 100_000  # a longer list of large filters is joined by shuffle


class Codes:
    """Filters for vectors of one length.

    The bound lets ``BUCKET`` of ``rows`` unrelated vectors pass a filter; the
    number of code words then makes ``SHARED`` common filters expected at the
    least cosine. Code words are Gaussian and not brought to unit length, so the
    score of a unit vector obeys the normal law exactly, at any length and as far
    in the tail as many rows move the bound. Both depend on nothing but the
    arguments.
    """

    def __init__(self, size: int, rows: int, cosine: float, seed: int = 4):
        pass_rate = min(0.25, BUCKET / max(rows, 1))
        bound = NormalDist().inv_cdf(1 - pass_rate)
        z = np.linspace(bound, bound + 12, 20_001)
        tail = np.array([0.5 * math.erfc(x / math.sqrt(2)) for x in (bound - cosine * z) / math.sqrt(1 - cosine**2)])
        both = float(np.trapezoid(np.exp(-z * z / 2) / math.sqrt(2 * math.pi) * tail, z))
        self.half = (size + 1) // 2
        self.words = max(2, math.ceil(math.sqrt(SHARED * max(1, EVEN / size) / TURNS / both)))
        self.bound = bound
        rng = np.random.default_rng([seed, size])
        self.turns = []
        for _ in range(TURNS):
            turn = np.linalg.qr(rng.normal(size=(size, size)))[0]
            books = [rng.normal(size=(self.words, n)) for n in (self.half, size - self.half)]
            self.turns.append((turn, *books))

    def scores(self, unit: np.ndarray, turn: int) -> tuple[np.ndarray, np.ndarray]:
        """Inner products with the words of either half."""
        rotation, one, two = self.turns[turn]
        turned = unit @ rotation
        return turned[:, : self.half] @ one.T, turned[:, self.half :] @ two.T

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers of each unit vector: every filter that it exceeds."""
        out: list[list[np.ndarray]] = [[] for _ in unit]
        for turn in range(TURNS):
            for found, a, b in zip(out, *self.scores(unit, turn), strict=True):
                order = np.argsort(-b)
                firsts = np.flatnonzero(a >= self.bound - b[order[0]])  # others exceed with no partner
                many = np.searchsorted(-b[order], a[firsts] - self.bound, side="right")
                first = np.repeat(firsts, many)
                place = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                found.append(np.sort(first * self.words + order[place]) | (turn << 38))
        return [np.concatenate(found) for found in out]


class Grid:
    """Cells for short unit vectors: each vector is placed in all cells that its links' middle points can lie in.

    The middle of two vectors is as far from either as half their distance, so
    vectors at the least cosine or nearer always share the cell of their middle.
    """

    def __init__(self, size: int, cosine: float):
        self.reach = math.sqrt(max(2 - 2 * cosine, 0) + 1e-12) / 2  # the small number covers rounding of the cosine
        self.sides = np.array(list(itertools.product((0, 1), repeat=size)), np.int64)
        self.powers = np.array([(2 * math.ceil(0.5 / self.reach) + 4) ** k for k in range(size)], object)
        self.powers = (self.powers % (1 << 44)).astype(np.int64)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted cell numbers of each unit vector; numbers that fall together only cost comparisons."""
        place = unit / (2 * self.reach)
        home = np.floor(place).astype(np.int64)
        low = place - home < 0.5
        gap = np.where(low, place - home, 1 - place + home)  # to the nearer neighbour, in widths
        near = gap**2 @ self.sides.T <= 0.25
        cells = home[:, None, :] + self.sides * np.where(low, -1, 1)[:, None, :]
        numbers = (cells * self.powers).sum(axis=2) & ((1 << 44) - 1)
        return [np.unique(n[k]) for n, k in zip(numbers, near, strict=True)]


def raw_vectors(column: pa.Array, kind: type) -> list[bytes | None]:
    """Components as bytes; None for a vector that can link with nothing."""
    out: list[bytes | None] = []
    for value in column.to_pylist():
        v = np.array(value, kind) if value and None not in value else np.zeros(0, kind)
        out.append(v.tobytes() if np.isfinite(v).all() and v.any() else None)
    return out


def unit_rows(raw: list[bytes], kind: type) -> np.ndarray:
    """Unit vectors in double precision; dividing by the largest component first keeps all squares finite."""
    v = np.stack([np.frombuffer(x, kind) for x in raw]).astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _reader(kind: type):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = raw_vectors(batch.column(1), kind)
            digests = [None if x is None else hashlib.blake2b(x, digest_size=16).digest() for x in raw]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(digests, pa.binary()), pa.array(raw, pa.binary())], ["id", "digest", "raw"]
            )

    return run


class Decoder:
    """Filter numbers of raw vectors; the length is part of a number, so unlike lengths never meet."""

    def __init__(self, rows: int, cosine: float, kind: type, seed: int):
        self.make = lambda size: Grid(size, cosine) if size <= SHORT else Codes(size, rows, cosine, seed)
        self.kind, self.codes = kind, {}

    def __call__(self, raw: list[bytes]) -> list[np.ndarray]:
        out: list[np.ndarray] = [np.zeros(0, np.int64)] * len(raw)
        sizes = np.array([len(x) // np.dtype(self.kind).itemsize for x in raw], np.int64)
        for size in np.unique(sizes).tolist():
            if size not in self.codes:
                self.codes[size] = self.make(size)
            at = np.flatnonzero(sizes == size)
            found = self.codes[size].decode(unit_rows([raw[i] for i in at], self.kind))
            for i, f in zip(at, found, strict=True):
                out[i] = f | (size << 44)
        return out


def _filters(decoder: Decoder, names: list[str]):
    """A row for each filter a vector passes, with the columns ``names``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                keys = decoder(part.column(part.schema.get_field_index("raw")).to_pylist())
                take = pa.array(np.repeat(np.arange(len(keys)), [len(k) for k in keys]))
                columns = [part.column(part.schema.get_field_index(c)).take(take) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(np.concatenate(keys))], [*names, "key"])

    return run


def _links(decoder: Decoder, cosine: float):
    """Counts of links per row, and at most one link per row that joins the cell's groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, np.ndarray] = {}
        for table in cell_tables(batches):
            ids, copies, block = (table.column(c).to_numpy() for c in ("id", "copies", "block"))
            key, left, right = (table.column(c)[0].as_py() for c in CELL)
            raw = table.column("raw").to_pylist()
            units = unit_rows(raw, decoder.kind)
            near = units @ units.T >= cosine
            near &= ids[:, None] != ids[None, :]
            if left != right:
                near &= block[:, None] != block[None, :]
            hit = np.flatnonzero(near.any(axis=1))
            if not len(hit):
                continue
            near = near[np.ix_(hit, hit)]
            # a pair is counted in the first filter it shares
            if len(known) > 50_000:
                known.clear()
            new = [raw[i] for i in hit if raw[i] not in known]
            known.update(zip(new, decoder(new), strict=True))
            before = [known[raw[i]][known[raw[i]] < key] for i in hit]
            kinds = np.unique(np.concatenate(before))
            bits = np.zeros((len(hit), (len(kinds) + 63) // 64 * 64), bool)
            for i, k in enumerate(before):
                bits[i, np.searchsorted(kinds, k)] = True
            words = np.packbits(bits, axis=1, bitorder="little").view(np.uint64)
            counts, group, found = np.zeros(len(hit), np.int64), np.arange(len(hit)), []
            for i in range(len(hit)):
                other = np.flatnonzero(near[i])
                other = other[~(words[other] & words[i]).any(axis=1)]
                counts[i] = copies[hit[other]].sum()
                for j in other[group[other] != group[i]]:
                    if group[j] != group[i]:
                        found.append((ids[hit[i]], ids[hit[j]]))
                        group[group == group[j]] = group[i]
            some = np.flatnonzero(counts)
            a = [*ids[hit[some]], *[x for x, _ in found]]
            b = [*[None] * len(some), *[y for _, y in found]]
            links = [*counts[some], *[0] * len(found)]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (a, b, links)], ["a", "b", "links"])

    return run


def near_vectors(
    vectors: DataFrame, id: str = "vec_id", vector: str = "embedding", cosine: float = 0.9, seed: int = 4
) -> DataFrame:
    """One row per vector: ``id``, ``n_links``, ``component_id``, ``kept``.

    Vectors link when their cosine in double precision is at least ``cosine``.
    Equal vectors form a class, compared once and counted as often as they
    occur. Classes that share a filter are compared by blocks of bounded size; a
    pair counts in the first filter it shares, and a block gives back counts and
    at most one link per row, never pairs. Large filters are split by their
    counted size, so a group of near copies of any size is spread over tasks.

    A pair at exactly the least cosine is expected to share ``SHARED`` filters or
    more, whatever the number of rows, nearer ones more still; recall is measured
    in the tests. Vectors of at most ``SHORT`` components miss no link.

    Null, empty and zero vectors and those with null or non-finite components
    link with nothing, as do rows without an id and vectors of unlike lengths.
    Equal rows repeated under one id count as copies of each other; unlike
    vectors under one id are not told apart as ends of links. Components are
    named by their smallest id, which is kept; a row without an id is kept with
    a null component. Extra columns are not read; an empty table gives an empty
    result.
    """
    read = vectors.select(F.col(id).cast("long").alias("id"), F.col(vector).alias("vector"))
    kind = np.float32 if read.schema["vector"].dataType.elementType == FloatType() else np.float64
    marked = materialize(read.mapInArrow(lean(_reader(kind)), "id long, digest binary, raw binary"), "vectors")
    able = marked.where("digest is not null and id is not null")
    classes = able.groupBy("digest", "raw").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes, "classes")
    decoder = Decoder(classes.count(), cosine, kind, seed)

    light = classes.select("id", "raw").mapInArrow(lean(_filters(decoder, ["id"])), "id long, key long")
    hot = light.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > BLOCK)
    hot = materialize(hot.select("key", F.ceil(F.col("n") / BLOCK).cast("int").alias("parts")), "large-filters")
    carried = ["id", "copies", "raw"]
    passed = classes.select(*carried).mapInArrow(lean(_filters(decoder, carried)), "id long, copies long, raw binary, key long")
    sized = passed.join(F.broadcast(hot) if hot.count() <= HOT_KEYS else hot, "key", "left")
    parts = F.coalesce("parts", F.lit(1))
    sized = sized.withColumn("block", F.pmod(F.xxhash64("id"), parts).cast("int"))
    sized = sized.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    cells = sized.select(
        "key", F.least("block", "other").alias("left"), F.greatest("block", "other").alias("right"), "block", *carried
    )
    cells = cells.repartition(*CELL).sortWithinPartitions(*CELL)
    found = materialize(cells.mapInArrow(lean(_links(decoder, cosine)), "a long, b long, links long"), "links")

    counts = found.where("links > 0").groupBy(F.col("a").alias("id")).agg(F.sum("links").alias("links"))
    joined = components(found.where("b is not null").select("a", "b"))
    of_class = classes.join(counts, "id", "left").join(joined, "id", "left").select(
        "digest",
        (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("component_id", "id").alias("component_id"),
    )
    of_class = materialize(of_class, "of-class")
    discard(classes, hot, found)
    named = F.col("id").isNotNull()
    placed = marked.select("id", F.when(named, F.col("digest")).alias("digest")).join(of_class, "digest", "left")
    component = F.when(named, F.coalesce("component_id", "id"))
    return placed.select(
        F.col("id").alias(id),
        F.coalesce("n_links", F.lit(0)).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
