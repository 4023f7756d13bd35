"""Mixing sources to target weights by Pareto order sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairweave.functions.text import digest_number, seeded_digest
from pairweave.session import materialize

WORD = r"[^\x20\x09-\x0D]+"
BROADCAST_SOURCES = 10_000  # more sources than this are joined by shuffle
BUCKET_ROWS = 4096  # documents of a source ranked together at the cut


def word_count(text: str | Column) -> Column:
    """Number of maximal runs of characters other than space and \\x09-\\x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, copies: int) -> DataFrame:
    """``(src, n, source_size, target)``: one row per source, by code point, null last.

    The target of a source is its weight times one level for all, at most
    ``copies`` times its size. The level at which the targets use up the total
    is found on sources ordered by the level at which they fill up: it is the
    first source that does not fill up when all before it do. That is where
    resharing the excess by weight ends. The windows see one row per source.
    """
    by_source = sizes.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("source_size"))
    place = F.row_number().over(W.orderBy(F.col("src.source").asc_nulls_last())) - 1
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    weighed = by_source.withColumn("weight", F.element_at(cycle, (place % len(weights) + 1).cast("int")))
    weighed = weighed.withColumn("most", F.col("source_size") * F.lit(float(copies)))
    filling = W.orderBy(F.col("most") / F.col("weight"), F.col("src.source").asc_nulls_last())
    before, after = filling.rowsBetween(W.unboundedPreceding, -1), filling.rowsBetween(W.currentRow, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    levelled = weighed.withColumn("level", left / F.sum("weight").over(after))
    levelled = levelled.withColumn("fits", F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level")))
    first = F.first("fits", ignorenulls=True).over(filling.rowsBetween(W.unboundedPreceding, W.currentRow))
    target = F.when(first.isNull(), F.col("most")).otherwise(F.least(first * F.col("weight"), "most"))
    return levelled.select("src", "n", "source_size", target.alias("target"))


def _inclusion(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Adds, per source, the sure copies, the words left for the sample and the factor of inclusion.

    A document is included with probability min(1, factor * size) so that the
    expected words are the words left. Sizes that reach 1 are sure too; they are
    found on one row per distinct size of a source, largest first.
    """
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = targets.withColumn("whole", whole.cast("long"))
    rest = rest.withColumn("words", F.col("target") - F.col("whole") * F.col("source_size"))
    counted = sizes.where("size > 0").groupBy("src", "size").agg(F.count(F.lit(1)).cast("double").alias("k"))
    counted = _attach(counted, rest.select("src", "words"), targets)
    down = W.partitionBy("src").orderBy(F.desc("size"))
    larger = F.coalesce(F.sum(F.col("size") * F.col("k")).over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    squares = F.sum(F.col("size").cast("double") * F.col("size") * F.col("k"))
    counted = counted.withColumn("larger", larger).withColumn(
        "squares", squares.over(down.rowsBetween(W.currentRow, W.unboundedFollowing))
    )
    sure = F.col("size") * (F.col("words") - F.col("larger")) >= F.col("squares")
    counted = counted.withColumn("sure", sure & (F.col("words") > 0))
    per_source = counted.groupBy("src").agg(
        F.min(F.when(F.col("sure"), F.col("size"))).alias("sure_from"),
        F.coalesce(F.sum(F.when(F.col("sure"), F.col("size") * F.col("k"))), F.lit(0.0)).alias("sure_words"),
        F.sum(F.when(~F.col("sure"), F.col("size").cast("double") * F.col("size") * F.col("k"))).alias("open_squares"),
    )
    joined = rest.join(per_source, "src", "left")
    left = F.col("words") - F.coalesce("sure_words", F.lit(0.0))
    return joined.select(
        "src", "n", "source_size", "target", "whole", "sure_from", left.alias("left"),
        (left / F.col("open_squares")).alias("factor"),
    )


def _attach(rows: DataFrame, per_source: DataFrame, targets: DataFrame, how: str = "inner") -> DataFrame:
    """Join one row per source; ``targets`` is stored, so counting it checks the broadcast."""
    small = targets.count() <= BROADCAST_SOURCES
    return rows.join(F.broadcast(per_source) if small else per_source, "src", how)


def _ranked(rows: DataFrame, seed: int) -> DataFrame:
    """Adds whether a row is sure or open, its ranking value, and the bucket of that value."""
    chance = F.least(F.col("factor") * F.col("size"), F.lit(1.0))
    sure = F.coalesce(F.col("size") >= F.col("sure_from"), F.lit(False))
    rows = rows.withColumn("sure", sure).withColumn("open", ~sure & (F.col("left") > 0) & (F.col("size") > 0))
    digest = seeded_digest(F.coalesce(F.col("id").cast("string"), F.lit("")), seed)
    u = (digest_number(digest, 1, 13) + F.lit(0.5)) / F.lit(float(1 << 52))
    value = F.when(F.col("open"), (u * (1 - chance)) / ((1 - u) * chance))
    buckets = F.ceil(F.col("n") / F.lit(BUCKET_ROWS))
    rows = rows.withColumn("value", value)
    return rows.withColumn("bucket", F.floor(F.col("value") / (1 + F.col("value")) * buckets).cast("long"))


PLACE = ("value", "id", "size")  # the order of ranking


def mixing_plan(sizes: DataFrame, weights: Sequence[float], share: float, copies: int, seed: int) -> DataFrame:
    """One row per source: its target, whole copies, inclusion factor, and the place where its sample ends.

    With it every document's copies follow from its own id and size.
    """
    targets = materialize(source_targets(sizes, weights, share, copies), "targets")
    plan = materialize(_inclusion(sizes, targets), "inclusion")
    rows = _ranked(_attach(sizes, plan, targets), seed).where("open")
    sums = rows.groupBy("src", "bucket", "left").agg(F.sum("size").alias("words"))
    order = W.partitionBy("src").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("before", F.coalesce(F.sum("words").over(order), F.lit(0)))
    ends = sums.where("before <= left").groupBy("src").agg(
        F.max("bucket").alias("last"), F.max_by("before", "bucket").alias("before")
    )
    ends = materialize(ends, "ends")
    inside = W.partitionBy("src", "bucket").orderBy(*PLACE).rowsBetween(W.unboundedPreceding, W.currentRow)
    at_end = _attach(rows, ends, targets).where("bucket = last")
    upto = F.col("before") + F.sum("size").over(inside) - F.col("size") / 2
    cuts = at_end.withColumn("upto", upto).where("upto <= left").groupBy("src").agg(F.max(F.struct(*PLACE)).alias("cut"))
    return materialize(plan.join(ends.drop("before"), "src", "left").join(cuts, "src", "left"), "mixing-plan")


def _decided(rows: DataFrame, plan: DataFrame, seed: int) -> DataFrame:
    """Adds ``copies`` to rows with ``src``, ``id`` and ``size``; nothing is shuffled."""
    rows = _ranked(_attach(rows, plan, plan), seed)
    here = F.coalesce(F.struct(*PLACE) <= F.col("cut"), F.lit(False))
    picked = F.col("open") & ((F.col("bucket") < F.col("last")) | ((F.col("bucket") == F.col("last")) & here))
    extra = (F.col("sure") | F.coalesce(picked, F.lit(False))).cast("long")
    return rows.withColumn("copies", F.when(F.col("size") > 0, F.col("whole") + extra).otherwise(F.lit(0)))


def mix_sources(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    copies: int = 2,
    seed: int = 9,
) -> DataFrame:
    """One row per document: ``id, size, source_size, target, copies, taken``.

    Sources in code-point order, null last, take the weights in turn; together
    they get ``share`` times all words, none more than ``copies`` times its own.
    A source's target divided by its words gives whole copies of every document,
    which are certain. The words left are drawn once: each document gets the
    inclusion probability min(1, factor * size), 1 is certain as well, and the
    others are ranked by ``u / (1 - u)`` over their inclusion odds, with ``u``
    from a seeded digest of the id. The sample is the beginning of that order
    whose words come nearest to the words left, so it misses the target by at
    most half a document.

    The order is cut into buckets by the ranking value, about 4096 documents
    each; running sums of buckets find the one where a source's sample ends, and
    only its rows are ranked. What comes out is one row per source, from which
    every document decides for itself. A source of any size is spread over all
    tasks, and texts are read twice but never shuffled.

    Null or blank texts have size 0 and are never taken. Null ids share one
    random number; rows that share id and size share a decision. Extra columns
    are not read. An empty table gives an empty result. The same input gives the
    same result.
    """
    sizes = materialize(_sized(docs, F.col(id), text, source), "sizes")
    decided = _decided(sizes, mixing_plan(sizes, weights, share, copies, seed), seed)
    taken = (F.col("copies") * F.col("size")).alias("taken")
    return decided.select(F.col("id").alias(id), "size", "source_size", "target", "copies", taken)


def _sized(docs: DataFrame, key: Column, text: str, source: str, *more: Column) -> DataFrame:
    return docs.select(key.alias("id"), F.struct(F.col(source).alias("source")).alias("src"), word_count(text).alias("size"), *more)


def mixed_documents(
    docs: DataFrame,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (3, 1, 2),
    share: float = 1.5,
    copies: int = 2,
    seed: int = 9,
) -> DataFrame:
    """Rows of ``docs`` as often as the mix takes them, all columns as they were.

    Rows without an id are told apart by their text; equal ones share a decision.
    """
    nameless = F.concat(F.lit("~"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    key = F.coalesce(F.col(id).cast("string"), nameless)
    sizes = materialize(_sized(docs, key, text, source), "sizes")
    plan = mixing_plan(sizes, weights, share, copies, seed)
    whole = _sized(docs, key, text, source, F.struct(*docs.columns).alias("row"))
    repeated = _decided(whole, plan, seed).where("copies > 0")
    repeated = repeated.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
    return repeated.select("row.*")
