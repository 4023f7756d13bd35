"""Quality selection by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairweave.functions.text import digest_number, seeded_digest
from pairweave.llm.texts import WordHasher, lean, mixed, text_views
from pairweave.session import materialize

BUCKETS = 1 << 14  # hashed words and pairs of words
LENGTH = 100.0  # a document's weight is that of so many n-grams of its kind
TARGET_ROWS = 20_000  # target documents that its model is fitted on, at most
SHARE = 0.8  # documents selected
STEPS = 16  # first cut of the ranking value, per unit
FINE = 4096  # second cut, per first one


def grams(words: np.ndarray) -> np.ndarray:
    """Buckets of all words and all pairs of neighbours."""
    if not len(words):
        return np.zeros(0, np.int64)
    with np.errstate(over="ignore"):
        pairs = mixed(words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    return (np.concatenate([words, pairs]) >> np.uint64(50)).astype(np.int64)


def _counter(target):
    """Counts of each n-gram bucket in all texts, and in those whose id is a target's."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, wanted = WordHasher(), target.value
        raw, aim = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(-1).to_numpy()
            named = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            is_target = named & np.isin(ids, wanted)
            for view, hit in zip(text_views(pc.utf8_lower(batch.column(1))), is_target, strict=True):
                if view is not None:
                    found = np.bincount(grams(hasher.words(view)), minlength=BUCKETS)
                    raw += found
                    if hit:
                        aim += found
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(aim[some])], ["gram", "raw", "target"])

    return run


def _weigher(ratio, length: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, table = WordHasher(), ratio.value
        for batch in batches:
            weights, sizes = [], []
            for view in text_views(pc.utf8_lower(batch.column(1))):
                found = grams(hasher.words(view)) if view is not None else np.zeros(0, np.int64)
                sizes.append(len(found))
                scale = 1.0 if length is None or not len(found) else length / len(found)
                weights.append(float(table[found].sum() * scale) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(weights, pa.float64())], ["id", "n_grams", "log_weight"]
            )

    return run


def resample(
    docs: DataFrame,
    target: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    share: float = SHARE,
    rows: int = TARGET_ROWS,
    length: float | None = LENGTH,
    seed: int = 8,
) -> DataFrame:
    """One row per document: ``id, n_grams, log_weight, rank_value, selected``.

    ``target`` is a table of ids of target documents. Its n-gram model is fitted
    on at most ``rows`` of them, the first in a seeded order; the raw model
    counts every document. A document's log weight is the mean log ratio of the
    two models over all its words and word pairs, times ``length``, so that long
    and short documents of one kind weigh alike; with ``length`` None it is the
    sum, the ratio of the document's probabilities, under which short texts of
    any kind can win over long ones of the target's. Adding Gumbel noise from a
    seeded digest of the id and taking the ``share`` largest values draws without
    replacement in proportion to the weights.

    The place of the last one taken is found by counting values in two rounds
    of buckets; only rows of the last bucket are ranked. Null and wordless texts
    have no weight and are not selected, nor counted. Null ids share one noise
    value and equal values are taken by id and weight. Repeated rows are repeated,
    extra columns not read, empty tables give an empty result.
    """
    spark = docs.sparkSession
    chosen = target.select(F.col(id).cast("long").alias("id")).where("id is not null").distinct()
    chosen = chosen.orderBy(seeded_digest("id", seed), "id").limit(rows).collect()
    wanted = spark.sparkContext.broadcast(np.array(sorted(r["id"] for r in chosen), np.int64))
    texts = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    found = texts.mapInArrow(lean(_counter(wanted)), "gram long, raw long, target long")
    raw, aim = np.ones(BUCKETS), np.ones(BUCKETS)  # one more of each, so that none is impossible
    for r in found.groupBy("gram").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect():
        raw[r["gram"]] += r["raw"]
        aim[r["gram"]] += r["target"]
    ratio = np.log(aim / aim.sum()) - np.log(raw / raw.sum())
    weighed = texts.mapInArrow(lean(_weigher(spark.sparkContext.broadcast(ratio), length)), "id long, n_grams long, log_weight double")

    u = (digest_number(seeded_digest(F.coalesce(F.col("id").cast("string"), F.lit("")), seed), 1, 13) + F.lit(0.5)) / F.lit(float(1 << 52))
    ranked = weighed.withColumn("rank_value", F.col("log_weight") - F.log(-F.log(u)))
    ranked = materialize(
        ranked.withColumn("cut", F.floor(F.col("rank_value") * STEPS)).withColumn(
            "fine", F.floor((F.col("rank_value") * STEPS - F.col("cut")) * FINE)
        ),
        "weights",
    )
    able = ranked.where("rank_value is not null")
    left = int(able.count() * share)
    cut = _last(able, "cut", left)

    if cut is not None:
        left -= cut[1]
        fine = _last(able.where(F.col("cut") == cut[0]), "fine", left)
        left -= fine[1]
        at_end = (F.col("cut") == cut[0]) & (F.col("fine") == fine[0])
        above = (F.col("cut") > cut[0]) | ((F.col("cut") == cut[0]) & (F.col("fine") > fine[0]))
        order = W.partitionBy("cut", "fine").orderBy(F.desc("rank_value"), "id", "log_weight")
        last = ranked.where(at_end).withColumn("selected", F.row_number().over(order) <= left)
        rest = ranked.where(~F.coalesce(at_end, F.lit(False))).withColumn("selected", F.coalesce(above, F.lit(False)))
        ranked = rest.unionByName(last)
    else:
        ranked = ranked.withColumn("selected", F.lit(False))
    return ranked.select(F.col("id").alias(id), "n_grams", "log_weight", "rank_value", "selected")


def _last(rows: DataFrame, bucket: str, n: int) -> tuple[int, int] | None:
    """The bucket that holds the n-th largest row, and how many rows lie above it."""
    if n <= 0:
        return None
    sizes = rows.groupBy(bucket).agg(F.count(F.lit(1)).alias("n"))
    order = W.orderBy(F.desc(bucket)).rowsBetween(W.unboundedPreceding, -1)
    before = sizes.withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    row = before.where(F.col("before") < n).orderBy(bucket).first()
    return int(row[bucket]), int(row["before"])
