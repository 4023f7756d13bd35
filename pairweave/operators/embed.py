"""Text to vector: word-vector averages, hashed character n-grams, reuse by text.

Every text is identified by a digest (``text_key``); embedders take
``(text_key, text)`` with unique keys and return ``(text_key, vector)``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.functions.ngrams import ngram_vector
from pairweave.functions.text import BLANKS, text_key
from pairweave.functions.vectors import clamp01, cosine, norm
from pairweave.operators.joins import skew_join
from pairweave.operators.retrieve import matrix_of
from pairweave.session import materialize

Embedder = Callable[[DataFrame], DataFrame]
WORD_BLOCK_BYTES = 64 << 20
WORD_BLOCKS = 16
HEAD_BLOCKS = 4  # blocks' worth of the most frequent words that is broadcast when a word table is joined
HEAD_SAMPLE = 0.1  # share of the texts on which they are found
ROWS_AT_ONCE = 8_192


def zero_vector(dim: int):
    return F.array_repeat(F.lit(0.0), dim)


def distinct_texts(df: DataFrame, *columns: str) -> DataFrame:
    """Each non-null text of the given columns once, as ``(text_key, text)``."""
    texts = df.select(F.explode(F.array(*columns)).alias("text")).where(F.col("text").isNotNull())
    return texts.groupBy(text_key("text").alias("text_key")).agg(F.first("text").alias("text"))


def word_counts(batches: Iterator[pa.RecordBatch], leave_out=None) -> Iterator[pa.RecordBatch]:
    """Each different word of a text with its count; a text is one row, so nothing needs a shuffle.

    ``leave_out``: a broadcast whose first entry has words that are not wanted.
    """
    cut, known = re.compile(BLANKS), set(leave_out.value[0]) if leave_out else ()
    for batch in batches:
        found = [Counter(w for w in cut.split(t or "") if w and w not in known) for t in batch.column(1).to_pylist()]
        rows = np.repeat(np.arange(len(found)), [len(c) for c in found])
        words_ = pa.array([w for c in found for w in c], pa.string())
        counts = pa.array([n for c in found for n in c.values()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), words_, counts], ["text_key", "word", "n"])


def block_sums(shared, dim: int):
    """Per text: how many of its words the block knows, and the sum of their unit vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, units, times = shared.value
        place, cut = {w: i for i, w in enumerate(names)}, re.compile(BLANKS)
        for batch in batches:
            total, sums = np.zeros(batch.num_rows, "i8"), np.zeros((batch.num_rows, dim))
            for row, text in enumerate(batch.column(1).to_pylist()):
                known = Counter(place[w] for w in cut.split(text or "") if w in place)
                if known:
                    n = np.fromiter(known.values(), "f8", len(known))
                    total[row], sums[row] = n @ times[list(known)], n @ units[list(known)]
            hit = pa.array(np.flatnonzero(total))
            vectors = pa.FixedSizeListArray.from_arrays(pa.array(sums.ravel()), dim).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(hit), pa.array(total).take(hit), vectors.take(hit)], ["text_key", "total", "sums"]
            )

    return run


def row_sums(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[pa.RecordBatch]:
    """Per text of a task: how many words its rows stand for, and the sum of their unit vectors."""
    place, total, sums = {}, np.zeros(0), np.zeros((0, dim))
    for batch in batches:
        batch = batch.filter(batch.column(0).is_valid())
        if not batch.num_rows:
            continue
        coded = batch.column(0).dictionary_encode()
        at = np.array([place.setdefault(k, len(place)) for k in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        if len(place) > len(total):
            more = max(len(place) - len(total), len(total))
            total, sums = np.r_[total, np.zeros(more)], np.vstack([sums, np.zeros((more, dim))])
        order = np.argsort(at, kind="stable")
        first = np.flatnonzero(np.diff(at[order], prepend=-1))
        n = batch.column(1).to_numpy()
        vectors = matrix_of(batch.column(3)) * (n / batch.column(2).to_numpy())[:, None]
        total[at[order[first]]] += np.add.reduceat(n[order], first)
        sums[at[order[first]]] += np.add.reduceat(vectors[order], first)
    keys = list(place)
    for a in range(0, len(keys), ROWS_AT_ONCE):
        part = slice(a, min(a + ROWS_AT_ONCE, len(keys)))
        vectors = pa.FixedSizeListArray.from_arrays(pa.array(sums[part].ravel()), dim).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays(
            [pa.array(keys[part], pa.string()), pa.array(total[part].astype("i8")), vectors], ["text_key", "total", "sums"]
        )


def frequent_words(texts: DataFrame, word_vectors: DataFrame, most: int, sample: float) -> DataFrame:
    """Up to ``most`` words of the table, those most frequent on a sample of the texts; equally frequent ones all or none."""
    counted = texts.sample(min(sample, 1.0), 7).select("text_key", "text").mapInArrow(word_counts, "text_key string, word string, n long")
    counted = counted.groupBy("word").agg(F.sum("n").alias("n")).join(word_vectors.groupBy("word").count(), "word")
    counted = materialize(counted, "frequent-words")
    least, held = None, 0
    for n, words_ in counted.groupBy("n").agg(F.sum("count")).orderBy(F.desc("n")).toLocalIterator():
        held += words_
        if held > most:
            break
        least = n
    return counted.where(F.lit(False) if least is None else F.col("n") >= least).select("word")


def word_average(
    texts: DataFrame, word_vectors: DataFrame, dim: int, sample: float = 0.01, block_bytes: int = WORD_BLOCK_BYTES
) -> DataFrame:
    """Mean of the unit-length vectors of a text's known words; zero without any.

    ``texts``: ``(text_key, text)`` with unique keys. ``word_vectors``:
    ``(word, vector)``. The word table's size is counted first. Up to
    ``WORD_BLOCKS`` blocks of ``block_bytes`` are broadcast one after the other,
    and each is a scan of the texts that gives one row per text. Of a larger table
    the most frequent words, found on a sample, are broadcast in one block and
    the others joined: a row of a text and a word carries the vector as it is to
    the text's task, where it is added up. Both forms give the same numbers.
    """
    usable = word_vectors.where(F.exists("vector", lambda x: x != 0))
    measured = usable.select("word", "vector", norm("vector").alias("length"))
    measured = materialize(measured, "word-vectors")
    n, letters = measured.agg(F.count(F.lit(1)), F.sum(F.octet_length("word"))).first()
    blocks = -(-(n * (dim * 8 + 100) + (letters or 0)) // block_bytes)
    if blocks <= WORD_BLOCKS:
        found = None
        for b in range(blocks):
            table = measured.where(F.pmod(F.xxhash64("word"), F.lit(blocks)) == b).toArrow()
            if not table.num_rows:
                continue
            units = matrix_of(table["vector"]) / table["length"].to_numpy()[:, None]
            shared = texts.sparkSession.sparkContext.broadcast((table["word"].to_pylist(), units, np.ones(len(units))))
            part = texts.select("text_key", "text").mapInArrow(block_sums(shared, dim), "text_key string, total long, sums array<double>")
            found = part if found is None else found.unionByName(part)
        if found is None:
            return texts.select("text_key", zero_vector(dim).alias("vector"))
        sums = found.groupBy("text_key").agg(
            F.sum("total").alias("total"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
        )
    else:
        head = frequent_words(texts, measured, HEAD_BLOCKS * block_bytes // (dim * 8 + 100 + -(-letters // n)), max(sample, HEAD_SAMPLE))
        table = measured.join(head, "word", "left_semi").toArrow()
        names, at, times = np.unique(np.array(table["word"].to_pylist(), object), return_inverse=True, return_counts=True)
        units = np.zeros((len(names), dim))
        if len(names):
            np.add.at(units, at, matrix_of(table["vector"]) / table["length"].to_numpy()[:, None])
        shared = texts.sparkSession.sparkContext.broadcast((names.tolist(), units, times.astype("f8")))
        rows = "text_key string, total long, sums array<double>"
        found = texts.select("text_key", "text").mapInArrow(block_sums(shared, dim), rows)
        count = lambda df: df.select("text_key", "text").mapInArrow(
            lambda batches: word_counts(batches, shared), "text_key string, word string, n long"
        )
        others = measured.join(head, "word", "left_anti")
        joined = skew_join(count(texts), others, "word", ["text_key"], probe=count(texts.sample(sample, 7)))
        carried = joined.select("text_key", "n", "length", "vector").repartition("text_key")
        found = found.unionByName(carried.mapInArrow(lambda batches: row_sums(batches, dim), rows))
        sums = found.groupBy("text_key").agg(
            F.sum("total").alias("total"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]
        )
    means = F.transform(F.array(*[f"s{i}" for i in range(dim)]), lambda s: s / F.col("total"))
    known = sums.select("text_key", means.alias("vector"))
    return texts.select("text_key").join(known, "text_key", "left").select(
        "text_key", F.coalesce("vector", zero_vector(dim)).alias("vector")
    )


def hashed_ngrams(texts: DataFrame, n: int = 3, dim: int = 64) -> DataFrame:
    """Unit-length vector of hashed character n-gram counts; needs no model."""
    return texts.select("text_key", ngram_vector(n, dim)("text").alias("vector"))


def model_vectors(texts: DataFrame, load: Callable[[], Callable[[list[str]], list[list[float]]]]) -> DataFrame:
    """Embed with any model: ``load`` runs once per task, the model once per batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for batch in batches:
            vectors = model(batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["text_key", "vector"]
            )

    return texts.select("text_key", "text").mapInArrow(run, "text_key string, vector array<double>")


def embed_column(df: DataFrame, text: str, embed: Embedder, name: str = "vector") -> DataFrame:
    """Add the vector of a text column; every distinct text is embedded once.

    The join back carries the digest instead of the text; a text copied into a
    large share of the rows is spread over many tasks.
    """
    vectors = embed(distinct_texts(df, text)).withColumnRenamed("vector", name)
    keyed = df.withColumn("text_key", text_key(text))
    probe = df.sample(0.01, 7).select(text_key(text).alias("text_key"))
    return skew_join(keyed, vectors, "text_key", df.columns, probe, "left").drop("text_key")


def clamped_score(vector1: Column | str, vector2: Column | str) -> Column:
    """Clamped cosine; null or empty sentences and failed vectors give 0."""
    usable = (F.length("sentence1") > 0) & (F.length("sentence2") > 0)
    return F.coalesce(F.when(usable, clamp01(cosine(vector1, vector2))), F.lit(0.0))


def pair_similarity(
    pairs: DataFrame, vectorize: Callable[[Column], Column], name: str = "similarity"
) -> DataFrame:
    """Score each pair in its own row; for embedders that are column functions.

    Nothing is shuffled. ``vectorize`` turns a text column into a vector column.
    """
    embedded = pairs.withColumn("__v1", vectorize(F.col("sentence1"))).withColumn("__v2", vectorize(F.col("sentence2")))
    return embedded.withColumn(name, clamped_score("__v1", "__v2")).drop("__v1", "__v2")


def pair_similarity_reusing(pairs: DataFrame, embed: Embedder, name: str = "similarity") -> DataFrame:
    """The same score for costly embedders: each distinct sentence is embedded once."""
    vectors = embed(distinct_texts(pairs, "sentence1", "sentence2"))
    keyed = pairs
    for side, vector in (("sentence1", "__v1"), ("sentence2", "__v2")):
        named = vectors.select(F.col("text_key").alias("__key"), F.col("vector").alias(vector))
        keyed = keyed.withColumn("__key", text_key(side))
        probe = pairs.sample(0.01, 7).select(text_key(side).alias("__key"))
        keyed = skew_join(keyed, named, "__key", pairs.columns, probe, "left").drop("__key")
    return keyed.withColumn(name, clamped_score("__v1", "__v2")).drop("__v1", "__v2")
