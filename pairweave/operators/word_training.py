"""Word vectors trained on a corpus: co-occurrence counts, PPMI, and the leading eigenspace of that matrix.

Words have numbers. A vocabulary of a checked size is broadcast: pairs are then
counted, stored and multiplied as lists of numbers, each pair once, and get
their words only where they leave. Every step is a scan of these lists; counting
and the one change from pairs to rows of the matrix shuffle them. Frames that
come from elsewhere, or whose vocabulary is larger, are joined by word; there
the matrix is cut into stripes of columns and, by counted size, into cells, and a
cell and the part of the block of vectors it needs meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from weakref import WeakKeyDictionary

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.functions.text import words
from pairweave.functions.vectors import col
from pairweave.operators.joins import skew_join
from pairweave.operators.lexical import coded_words, digests_of, flat, lists_of, parts_of
from pairweave.operators.ordering import global_index
from pairweave.operators.retrieve import matrix_of
from pairweave.session import discard, materialize

WINDOW = 2  # words on either side that count as context
STRIPE = 1 << 16  # columns of a stripe: the vectors a cell may need
CELL = 1 << 18  # matrix entries aimed at in a cell
CHUNK = 1 << 14  # entries multiplied at a time
HELD_BYTES = 256 << 20  # of a vocabulary's digests and names that a task may hold
HELD_VECTORS = 256 << 20  # bytes of the vectors that a task may hold
FETCHED = 1 << 19  # rows of a block of vectors that the driver takes at a time
HASHED_AT_ONCE = 1 << 18  # words of a vocabulary that the driver hashes at a time
PAIRS_AT_ONCE = 1 << 22  # pairs that a task counts together, some 50 bytes each
PART_PAIRS = 1 << 22  # counts of pairs aimed at in a task that adds them up
MOST_PARTS = 1 << 13
ROW_PAIRS = 1 << 9  # pairs in one stored row; Parquet's reader holds 4096 rows at once
ROWS_READ = 1 << 9  # stored rows that a task takes at once
PASSES = 4  # scans of the pairs that make the matrix, each for a share of its rows, whose shuffle files go before the next
ONE_PASS = 1 << 24  # entries that are shuffled in one scan
SPREAD = 16  # parts that the pairs of one word may be in, a power of 2
PAIRS = "a array<int>, size array<int>, b array<int>, n array<long>"


@dataclass(frozen=True)
class Held:
    """What stands behind a frame of this module when its vocabulary is broadcast."""

    rows: DataFrame  # PAIRS, a row of lists: a pair of numbers once, a <= b; of a matrix both orders
    names: Broadcast  # the word of each number
    words: int
    margins: Broadcast | None = None  # how often each word stands in a pair
    total: float = 0.0


#: frames by their pairs, so that the next step needs no words; a frame made from one of them is not in it
_HELD: WeakKeyDictionary[DataFrame, Held] = WeakKeyDictionary()


def _with(frame: DataFrame, held: Held) -> DataFrame:
    _HELD[frame] = held
    return frame


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each different word of a run of texts with its count."""
    for part in (p for batch in batches for p in parts_of(batch, 0)):
        _, coded = coded_words(part.column(0))
        counts = np.bincount(coded.indices.to_numpy(), minlength=len(coded.dictionary))
        yield pa.RecordBatch.from_arrays([coded.dictionary, pa.array(counts.astype("i8"))], ["word", "c"])


def _digests(words_: pa.Array, seed: int) -> np.ndarray:
    cut = [words_[at : at + HASHED_AT_ONCE].to_numpy(zero_copy_only=False) for at in range(0, len(words_), HASHED_AT_ONCE)]
    return np.concatenate([digests_of(x, seed, "n") for x in cut] or [np.array([], "i8")])


def _places(digests: np.ndarray, held: np.ndarray) -> np.ndarray:
    """Where each digest is among the held ones, -1: nowhere."""
    if not len(held):
        return np.full(len(digests), -1)
    at = np.searchsorted(held, digests)
    at[at == len(held)] = 0
    return np.where(held[at] == digests, at, -1)


def held_vocabulary(kept: DataFrame, others: DataFrame) -> tuple[Broadcast, Broadcast, int]:
    """Digests of the kept words, ascending, their names, and the seed of the digests.

    A word's number is its digest's place. No two kept words share a digest, and
    none of the other words has that of a kept one: else the next seed is taken.
    """
    spark, seed = kept.sparkSession, 0
    names = kept.select("word").toArrow()["word"].combine_chunks()
    names = pa.concat_arrays(names.chunks) if isinstance(names, pa.ChunkedArray) else names
    while True:
        digests = _digests(names, seed)
        order = np.argsort(digests)
        digests = digests[order]
        if not (digests[1:] == digests[:-1]).any():
            shared = spark.sparkContext.broadcast(digests)

            def strange(batches: Iterator[pa.RecordBatch], seed: int = seed, shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    yield batch.filter(pa.array(_places(_digests(batch.column(0), seed), shared.value) >= 0))

            if others.select("word").mapInArrow(strange, "word string").isEmpty():
                return shared, spark.sparkContext.broadcast(names.take(pa.array(order))), seed
        seed += 1


def _starts(values: np.ndarray) -> np.ndarray:
    return np.r_[True, values[1:] != values[:-1]][: len(values)]


def packed(group: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[pa.ListArray]]:
    """A row per group, groups ascending: the values of ``a``, each once for a run of it, the runs' lengths, ``b`` and ``n``."""
    new = _starts(group)
    run, first = np.flatnonzero(new | _starts(a)), np.flatnonzero(new)
    edges = np.r_[first, len(a)]
    entries, runs = np.diff(edges), np.diff(np.searchsorted(run, edges))
    values = (a[run].astype("i4"), np.diff(np.r_[run, len(a)]).astype("i4"), b.astype("i4"), n)
    return group[first], [lists_of(size, x) for size, x in zip((runs, runs, entries, entries), values)]


def unpacked(rows: pa.RecordBatch | pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``a``, ``b`` and ``n`` of each pair."""
    parts = []
    for batch in rows.to_batches() if isinstance(rows, pa.Table) else [rows]:
        a, size, b, n = (flat(batch.column(c))[0] for c in ("a", "size", "b", "n"))
        parts.append((np.repeat(a.astype("i8"), size), b.astype("i8"), n.astype("i8")))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, "i8"),) * 3


def runs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_READ):
            yield unpacked(batch.slice(at, ROWS_READ))


def pair_lists(shared: Broadcast, seed: int, window: int, parts: int, most: int):
    """Pairs of numbers counted in runs of about ``most``, a row for each part.

    A hash of the first word and a few bits of the second tells the part: the
    pairs of a hot word are in several, those of the others stand together.
    """

    def counted(keys: np.ndarray, bits: int) -> pa.RecordBatch:
        of = ((keys >> bits) * SPREAD) | (keys & (SPREAD - 1))
        mixed = (of.view("u8") * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        keys |= (mixed % np.uint64(parts)).view("i8") << (2 * bits)
        keys.sort()
        first = np.flatnonzero(_starts(keys))
        n, keys, word = np.diff(np.r_[first, len(keys)]).astype("i4"), keys[first], (1 << bits) - 1
        part, lists = packed(keys >> (2 * bits), (keys >> bits) & word, keys & word, n)
        return pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), *lists], ["part", "a", "size", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        bits, found, size = len(held).bit_length(), [], 0
        for part in (p for batch in batches for p in parts_of(batch, 0)):
            length, coded = coded_words(part.column(0))
            words_ = coded.dictionary.to_numpy(zero_copy_only=False)
            number = np.where(words_ == "", -1, _places(digests_of(words_, seed, "n"), held))[coded.indices.to_numpy()]
            text = np.repeat(np.arange(len(length)), length)
            for d in range(1, window + 1):
                a, b = number[:-d], number[d:]
                near = (a >= 0) & (b >= 0) & (text[:-d] == text[d:])
                a, b = a[near], b[near]
                found.append((np.minimum(a, b) << bits) | np.maximum(a, b))
                size += len(a)
                if size >= most:
                    yield counted(np.concatenate(found), bits)
                    found, size = [], 0
        if size:
            yield counted(np.concatenate(found), bits)

    return run


def added_up(bits: int, row_pairs: int):
    """The counts of one part by pair, in rows of ``row_pairs``."""

    def run(rows: pa.Table) -> pa.Table:
        a, b, n = unpacked(rows)
        keys = (a << bits) | b
        order = np.argsort(keys)
        keys, n = keys[order], n[order]
        first = np.flatnonzero(_starts(keys))
        keys, n = keys[first], np.add.reduceat(n, first) if len(first) else n
        _, lists = packed(np.arange(len(keys)) // row_pairs, keys >> bits, keys & ((1 << bits) - 1), n)
        return pa.table(lists, ["a", "size", "b", "n"])

    return run


def both_orders(a: np.ndarray, b: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each pair and its mirror; a word beside itself has none."""
    other = a != b
    return np.r_[a, b[other]], np.r_[b, a[other]], *[np.r_[v, v[other]] for v in values]


def _named(held: Held, values: Callable, kind: str) -> DataFrame:
    """``(word, context, ...)``; ``values`` gives the pairs to keep of a run, with one value each."""
    names, column = held.names, kind.split(" ")[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for pairs in runs_of(batches):
            word, context, value = both_orders(*values(*pairs))
            yield pa.RecordBatch.from_arrays(
                [names.value.take(pa.array(word)), names.value.take(pa.array(context)), pa.array(value)], ["word", "context", column]
            )

    return held.rows.mapInArrow(run, f"word string, context string, {kind}")


def cooccurrences(texts: DataFrame, window: int = WINDOW, least_count: int = 1, text: str = "text") -> DataFrame:
    """``(word, context, n)`` for both orders of a pair: how often they stand at most ``window`` words apart.

    Words that occur fewer than ``least_count`` times are taken out before
    distances are counted from the remaining places, which stay as they were. A
    word beside itself counts twice, once from either side. Null and empty texts
    have no words. The words are counted first: of a vocabulary of up to
    ``HELD_BYTES`` the tasks count the pairs by number, and the pairs are stored
    as numbers.
    """
    if window < 1:
        raise ValueError("window must be at least 1")
    rows = texts.select(col(text).alias("text"))
    counted = rows.mapInArrow(word_counts, "word string, c long").where("word <> ''").groupBy("word").agg(F.sum("c").alias("c"))
    counted = materialize(counted, "vocabulary", keep_shuffles=False)
    kept, others = counted.where(F.col("c") >= least_count), counted.where(F.col("c") < least_count)
    size, letters, places = kept.agg(F.count(F.lit(1)), F.sum(F.octet_length("word")), F.sum("c")).first()
    if size * 12 + (letters or 0) > HELD_BYTES:
        counts = joined_cooccurrences(rows, kept.select("word") if least_count > 1 else None, window)
        discard(counted)
        return counts
    shared, names, seed = held_vocabulary(kept, others)
    discard(counted)
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, -(-window * (places or 0) // PART_PAIRS))
    lists = rows.mapInArrow(
        pair_lists(shared, seed, window, min(parts, MOST_PARTS), PAIRS_AT_ONCE),
        "part int, a array<int>, size array<int>, b array<int>, n array<int>",
    )
    pairs = lists.groupBy("part").applyInArrow(added_up(int(size).bit_length(), ROW_PAIRS), PAIRS)
    held = Held(materialize(pairs, "word-pairs", keep_shuffles=False), names, size)
    return _with(_named(held, lambda a, b, n: (a, b, np.where(a == b, 2 * n, n)), "n long"), held)


def joined_cooccurrences(rows: DataFrame, kept: DataFrame | None, window: int) -> DataFrame:
    """``cooccurrences`` of a vocabulary that no task holds; of the words in ``kept``, None: of all.

    Pairs are counted before they are shuffled, and the counts are
    stored at once: joins look at a sample first, which would count them again.
    """
    cut = rows.select(words("text").alias("w"))
    shift = lambda d: F.arrays_zip(
        F.expr(f"slice(w, 1, greatest(size(w) - {d}, 0))").alias("a"), F.expr(f"slice(w, {d + 1}, greatest(size(w) - {d}, 0))").alias("b")
    )
    pairs = cut.select(F.explode(F.concat(*[shift(d) for d in range(1, window + 1)])).alias("p"))
    ordered = pairs.groupBy(F.least("p.a", "p.b").alias("a"), F.greatest("p.a", "p.b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    if kept is not None:
        raw = ordered = materialize(ordered, "all-pairs", keep_shuffles=False)
        for side in ("a", "b"):
            ordered = skew_join(ordered, kept.withColumnRenamed("word", side), side, ["a", "b"], probe=raw.sample(0.01, 7))
    stored = materialize(ordered, "word-pairs", keep_shuffles=False)
    if kept is not None:
        discard(raw)
    ends = F.array(
        F.struct(F.col("a").alias("word"), F.col("b").alias("context")), F.struct(F.col("b").alias("word"), F.col("a").alias("context"))
    )
    doubled = F.when(F.col("a") == F.col("b"), F.slice(ends, 1, 1)).otherwise(ends)
    n = F.when(F.col("a") == F.col("b"), 2 * F.col("n")).otherwise(F.col("n"))
    return stored.select(F.explode(doubled).alias("e"), n.alias("n")).select("e.word", "e.context", "n")


def _summed(held: Held, count: Callable) -> np.ndarray:
    """A number per word: what ``count`` adds up to over all runs of pairs, first in the tasks."""
    size = held.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, "i8")
        for pairs in runs_of(batches):
            total += count(size, *pairs)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(total[at])], ["i", "n"])

    table = held.rows.mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size, "i8")
    out[table["i"].to_numpy()] = table["n"].to_numpy()
    return out


def _information(a: np.ndarray, b: np.ndarray, n: np.ndarray, margins: np.ndarray, total: float) -> np.ndarray:
    """Log of a pair's count, from both sides if it is a word beside itself, over what independence would give."""
    return np.log(n.astype("f8") * total / (margins[a] * margins[b]))


def _positive(held: Held) -> Callable:
    """The pairs of a run with positive information, and that."""
    margins, total = held.margins, held.total

    def run(a: np.ndarray, b: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, ...]:
        n = np.where(a == b, 2 * n, n)
        v = _information(a, b, n, margins.value, total)
        keep = v > 0
        return a[keep], b[keep], v[keep], n[keep]

    return run


def positive_information(counts: DataFrame) -> DataFrame:
    """``(word, context, ppmi)`` where it is positive: log of the count over what independence would give."""
    if held := _HELD.get(counts):
        sums = _summed(held, lambda size, a, b, n: (np.bincount(a, n, size) + np.bincount(b, n, size)).astype("i8"))
        shared = counts.sparkSession.sparkContext.broadcast(sums.astype("f8"))
        held = Held(held.rows, held.names, held.words, shared, float(sums.sum()))
        positive = _positive(held)
        return _with(_named(held, lambda *pairs: positive(*pairs)[:3], "ppmi double"), held)
    margins = materialize(counts.groupBy("word").agg(F.sum("n").alias("m")), "word-margins")
    total = margins.agg(F.sum("m")).first()[0] or 0
    probe = counts.sample(0.01, 7)  # of the input for both joins: a sample of the first join would run it twice
    sided = skew_join(counts, margins, "word", ["context"], probe)
    sided = skew_join(sided, margins.select(F.col("word").alias("context"), F.col("m").alias("mc")), "context", ["word"], probe)
    pmi = F.log(F.col("n").cast("double") * F.lit(float(total)) / (F.col("m").cast("double") * F.col("mc").cast("double")))
    return sided.select("word", "context", pmi.alias("ppmi")).where("ppmi > 0")


def numbered(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(word, i)`` with contiguous numbers, and the entries as ``(i, j, v)`` with their stripe and cell.

    Of pairs behind ``entries`` the matrix has rows of lists instead, ``PAIRS``: a
    word's entries are in one of them, by counts, from which they are computed again.
    """
    held = _HELD.get(entries)
    if held and held.margins:
        return _numbered_rows(held)
    entries = materialize(entries, "word-information", keep_shuffles=False)
    vocabulary = materialize(global_index(entries.select("word").distinct(), "word", "i"), "word-numbers")
    probe = entries.sample(0.01, 7)
    named = skew_join(entries, vocabulary, "word", ["context"], probe)
    named = skew_join(named, vocabulary.select(F.col("word").alias("context"), F.col("i").alias("j")), "context", ["word"], probe)
    placed = named.select("i", "j", F.col("ppmi").alias("v"), F.expr(f"cast(j div {STRIPE} as int)").alias("stripe"))
    placed = materialize(placed, "word-matrix", keep_shuffles=False)
    sizes = placed.groupBy("stripe").agg(F.ceil(F.count(F.lit(1)) / CELL).cast("int").alias("cells"))
    cells = materialize(sizes, "stripe-cells").join(placed, "stripe").select(
        "stripe", F.pmod(F.xxhash64("i"), F.col("cells")).cast("int").alias("cell"), "i", "j", "v"
    )
    matrix = materialize(cells, "matrix-cells", keep_shuffles=False)
    discard(placed)
    return vocabulary, matrix


def matrix_rows(row_pairs: int):
    """Entries by word, in order, in stored rows of about ``row_pairs``; a word's are all in one."""

    def run(rows: pa.Table) -> pa.Table:
        i, j, n = unpacked(rows)
        order = np.argsort((i << 32) | j)
        i, j, n = i[order], j[order], n[order]
        first = np.flatnonzero(_starts(i))
        start = np.repeat(first, np.diff(np.r_[first, len(i)]))
        _, lists = packed(start // row_pairs, i, j, n)
        return pa.table(lists, ["a", "size", "b", "n"])

    return run


def _numbered_rows(held: Held) -> tuple[DataFrame, DataFrame]:
    """``numbered`` of pairs: entries are counted by word, cut by that into ranges of words and put into rows there."""
    spark, positive = held.rows.sparkSession, _positive(held)

    def entries(size: int, *pairs: np.ndarray) -> np.ndarray:
        return np.bincount(both_orders(*positive(*pairs)[:2])[0], minlength=size)

    sizes = _summed(held, entries)
    present = np.flatnonzero(sizes)
    ends = np.cumsum(sizes[present])
    number = np.full(held.words, -1)
    number[present] = np.arange(len(present))
    broadcast = spark.sparkContext.broadcast
    part_of = (ends - sizes[present]) // PART_PAIRS
    shared = broadcast((number, part_of))
    entered = int(ends[-1]) if len(ends) else 0
    passes = PASSES if entered > ONE_PASS else 1
    names, known = held.names, broadcast(present)

    def lists(batches: Iterator[pa.RecordBatch], first: int, last: int) -> Iterator[pa.RecordBatch]:
        number, part_of = shared.value
        for pairs in runs_of(batches):
            a, b, _, n = positive(*pairs)
            i, j, n = both_orders(number[a], number[b], n)
            if passes > 1:
                now = (i >= first) & (i < last)
                i, j, n = i[now], j[now], n[now]
            order = np.argsort((i << 32) | j)
            i, j, n = i[order], j[order], n[order]
            part, rows = packed(part_of[i], i, j, n)
            yield pa.RecordBatch.from_arrays([pa.array(part.astype("i4")), *rows], ["part", "a", "size", "b", "n"])

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = known.value[batch.column(0).to_numpy()]
            yield pa.RecordBatch.from_arrays([names.value.take(pa.array(at)), batch.column(0)], ["word", "i"])

    vocabulary = materialize(spark.range(len(present)).mapInArrow(named, "word string, i long"), "word-numbers")
    edges = np.searchsorted(ends, np.arange(1, passes) * (entered / passes)).tolist()
    rows = [
        held.rows.mapInArrow(lambda batches, a=a, z=z: lists(batches, a, z), f"part int, {PAIRS}")
        .groupBy("part").applyInArrow(matrix_rows(ROW_PAIRS), PAIRS)
        for a, z in zip([0, *edges], [*edges, len(present)])
    ]
    rows = materialize(rows, "matrix-cells", keep_shuffles=False)
    return vocabulary, _with(rows, Held(held.rows, names, len(present), broadcast(held.margins.value[present]), held.total))


def _multiply(dim: int):
    """Rows of one cell times the vectors of its stripe, summed per row number."""

    def run(entries: pa.Table, vectors: pa.Table) -> pa.Table:
        none = pa.table({"i": pa.array([], pa.int64()), "x": pa.array([], pa.list_(pa.float64()))})
        if not entries.num_rows or not vectors.num_rows:
            return none
        at = vectors["i"].to_numpy()
        order = np.argsort(at)
        x = matrix_of(vectors["x"])[order]
        i, j, v = (entries[c].to_numpy() for c in ("i", "j", "v"))
        by_row = np.argsort(i, kind="stable")
        i, v, j = i[by_row], v[by_row], np.searchsorted(at[order], j[by_row])
        rows, place = np.unique(i, return_inverse=True)
        out = np.zeros((len(rows), dim))
        for a in range(0, len(i), CHUNK):
            part = slice(a, a + CHUNK)
            own = place[part]
            first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
            out[own[first]] += np.add.reduceat(v[part, None] * x[j[part]], first, axis=0)
        lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dim).cast(pa.list_(pa.float64()))
        return pa.table({"i": pa.array(rows), "x": lists})

    return run


def _held_vectors(block: DataFrame, start: int, stop: int, dim: int) -> Broadcast:
    """Vectors of a range of numbers; the driver takes some of them at a time."""
    x = np.zeros((stop - start, dim))
    for at in range(start, stop, FETCHED):
        table = block.where(F.col("i").between(at, min(at + FETCHED, stop) - 1)).select("i", "x").toArrow()
        if table.num_rows:
            x[table["i"].to_numpy() - start] = matrix_of(table["x"])
    return block.sparkSession.sparkContext.broadcast(x)


def _multiply_rows(shared: Broadcast, margins: Broadcast, total: float, start: int, stop: int, dim: int):
    """Rows of the matrix times the vectors of the columns from ``start`` to before ``stop``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        x, m = shared.value, margins.value
        for i, j, n in runs_of(batches):
            if start or stop < len(m):
                inside = (j >= start) & (j < stop)
                i, j, n = i[inside], j[inside], n[inside]
            v, j = _information(i, j, n, m, total), j - start
            rows = i[_starts(i)]
            place = np.cumsum(_starts(i)) - 1
            out = np.zeros((len(rows), dim))
            for a in range(0, len(i), CHUNK):
                part = slice(a, a + CHUNK)
                own = place[part]
                first = np.flatnonzero(_starts(own))
                out[own[first]] += np.add.reduceat(v[part, None] * x[j[part]], first, axis=0)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([pa.array(rows), lists], ["i", "x"])

    return run


def product(matrix: DataFrame, block: DataFrame, dim: int) -> DataFrame:
    """``matrix`` times ``block``, stored.

    The vectors are sent to the rows of the matrix, ``HELD_VECTORS`` at a time:
    if that is all of them, a row's product is whole where it is made.
    """
    held = _HELD.get(matrix)
    if not held:
        return materialize(multiplied(matrix, block, dim), "product", keep_shuffles=False)
    step = max(1, HELD_VECTORS // (8 * dim))
    sent, parts = [], []
    for start in range(0, held.words, step):
        stop = min(start + step, held.words)
        sent.append(_held_vectors(block, start, stop, dim))
        part = matrix.mapInArrow(_multiply_rows(sent[-1], held.margins, held.total, start, stop, dim), "i long, x array<double>")
        if held.words > step:
            part = materialize(part, "product")
            sent[-1].destroy()
        parts.append(part)
    out = materialize(parts[0] if len(parts) == 1 else _sums(parts, dim), "product", keep_shuffles=False)
    if len(parts) == 1:
        sent[0].destroy()
    else:
        discard(*parts)
    return out


def _sums(parts: list[DataFrame], dim: int) -> DataFrame:
    all_parts = parts[0]
    for part in parts[1:]:
        all_parts = all_parts.unionByName(part)
    sums = all_parts.groupBy("i").agg(*[F.sum(F.col("x")[k]).alias(f"x{k}") for k in range(dim)])
    return sums.select("i", F.array(*[f"x{k}" for k in range(dim)]).alias("x"))


def multiplied(matrix: DataFrame, block: DataFrame, dim: int) -> DataFrame:
    """``matrix`` times ``block``, both by number: ``(i, x)``."""
    cells = matrix.groupBy("stripe").agg((F.max("cell") + 1).alias("cells"))
    striped = block.withColumn("stripe", F.expr(f"cast(i div {STRIPE} as int)")).join(cells, "stripe")
    needed = striped.select("stripe", F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("cell"), "i", "x")
    parts = matrix.groupBy("stripe", "cell").cogroup(needed.groupBy("stripe", "cell")).applyInArrow(
        _multiply(dim), "i long, x array<double>"
    )
    return _sums([parts], dim)


def _products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = None
    for batch in batches:
        if batch.num_rows:
            more = matrix_of(batch.column(0)).T @ matrix_of(batch.column(1))
            total = more if total is None else total + more
    if total is not None:
        r, c = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(r.ravel()), pa.array(c.ravel()), pa.array(total.ravel())], ["r", "c", "v"])


def inner(pairs: DataFrame, dim: int) -> np.ndarray:
    """Sum over rows of the outer product of two vector columns: ``dim`` x ``dim`` numbers."""
    parts = pairs.mapInArrow(_products, "r long, c long, v double").groupBy("r", "c").agg(F.sum("v").alias("v"))
    out = np.zeros((dim, dim))
    for row in parts.collect():
        out[row["r"], row["c"]] = row["v"]
    return out


def turned(block: DataFrame, by: np.ndarray) -> DataFrame:
    """Each row's vector times a small matrix."""
    shared = block.sparkSession.sparkContext.broadcast(by)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = matrix_of(batch.column(1)) @ shared.value
                lists = pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), out.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["i", "x"])

    return block.select("i", "x").mapInArrow(run, "i long, x array<double>")


def orthonormal(block: DataFrame, dim: int) -> DataFrame:
    """Columns of the same span with unit length and right angles; a column that adds nothing becomes zero."""
    values, axes = np.linalg.eigh(inner(block.select("x", F.col("x").alias("y")), dim))
    keep = values > 1e-12 * max(float(values[-1]), 1e-300)
    return turned(block, axes * np.where(keep, 1 / np.sqrt(np.where(keep, values, 1)), 0))


def leading_vectors(
    vocabulary: DataFrame, matrix: DataFrame, dim: int, rounds: int = 8, seed: int = 42
) -> tuple[DataFrame, np.ndarray]:
    """``(i, x)`` and eigenvalues: the ``dim`` largest in size of a symmetric matrix, by block power iteration.

    A round multiplies the block twice, so both ends of the spectrum converge
    alike, and makes its columns orthonormal; a Rayleigh-Ritz step ends it. Each
    product is stored, so a lost executor costs one step.
    """
    start = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda k: F.xxhash64("word", k, F.lit(seed)) / float(1 << 63))
    now = materialize(orthonormal(vocabulary.select("i", start.alias("x")), dim), "block")
    for _ in range(rounds):
        once = product(matrix, now, dim)
        twice = product(matrix, once, dim)
        after = materialize(orthonormal(twice, dim), "block")
        discard(now, once, twice)
        now = after
    image = product(matrix, now, dim)
    small = inner(now.join(image.withColumnRenamed("x", "y"), "i").select("x", "y"), dim)
    values, axes = np.linalg.eigh((small + small.T) / 2)
    order = np.argsort(-np.abs(values), kind="stable")
    vectors = materialize(turned(now, axes[:, order]), "eigenvectors")
    discard(now, image)
    return vectors, values[order]


def train_word_vectors(
    texts: DataFrame, dim: int = 64, window: int = WINDOW, least_count: int = 5, rounds: int = 8, text: str = "text", seed: int = 42
) -> DataFrame:
    """``(word, vector)`` for ``word_average``: eigenvectors of the PPMI matrix by the root of their eigenvalue's size.

    Words rarer than ``least_count`` and words without positive information get
    no vector. Without words the table is empty.
    """
    counts = cooccurrences(texts, window, least_count, text)
    vocabulary, matrix = numbered(positive_information(counts))
    if held := _HELD.get(counts):
        discard(held.rows)
    if not vocabulary.limit(1).count():
        return texts.sparkSession.createDataFrame([], "word string, vector array<double>")
    vectors, values = leading_vectors(vocabulary, matrix, dim, rounds, seed)
    discard(matrix)
    scaled = turned(vectors, np.diag(np.sqrt(np.abs(values))))
    return vocabulary.join(scaled, "i").select("word", F.col("x").alias("vector"))
