"""Row positions and running totals without a window over everything.

Spark runs a window partition in one task. Here the order is cut into buckets:
totals per bucket are small, their running sum gives each bucket its offset,
and only the rows inside one bucket are windowed together. The result is the
exact global order at any size and for any hot group.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairweave.functions.text import digest_number, seeded_digest
from pairweave.session import materialize

BUCKET_ROWS = 4_096  # rows aimed at in a bucket, which one task orders
BROADCAST_BUCKETS = 500_000


def bucket_digits(rows: int) -> int:
    """Leading hex digits of a digest that cut so many rows into buckets of about ``BUCKET_ROWS``."""
    digits = 1
    while 16**digits * BUCKET_ROWS < rows:
        digits += 1
    return digits


def running_totals(
    df: DataFrame,
    sums: dict[str, str | Column],
    order: Sequence[Column],
    bucket: str,
    group: Sequence[str] = (),
    bucket_descending: bool = False,
    grand_totals: bool = False,
) -> DataFrame:
    """Add one inclusive running sum per entry of ``sums``.

    ``bucket`` must agree with ``order``: all rows of an earlier bucket come
    first. With ``grand_totals`` the totals per group are added as ``total_<name>``.

    Group and bucket travel as one struct: it is never null, null group values
    compare equal inside it, and the aggregate, the window and the join all
    cluster on the same expression, so the detail rows are shuffled once.
    """
    group = list(group)
    values = {n: (F.col(c) if isinstance(c, str) else c) for n, c in sums.items()}
    slotted = df.withColumn("__slot", F.struct(*group, bucket))
    per_bucket = slotted.groupBy("__slot").agg(
        *[F.sum(v).alias(f"in_{n}") for n, v in values.items()]
    )
    group_cols = [F.col(f"__slot.{g}") for g in group]
    edge = F.desc(f"__slot.{bucket}") if bucket_descending else F.asc(f"__slot.{bucket}")
    before = W.partitionBy(*group_cols).orderBy(edge).rowsBetween(W.unboundedPreceding, -1)
    whole = W.partitionBy(*group_cols)
    offsets = per_bucket.select(
        "__slot",
        *[F.coalesce(F.sum(f"in_{n}").over(before), F.lit(0)).alias(f"before_{n}") for n in values],
        *([F.sum(f"in_{n}").over(whole).alias(f"total_{n}") for n in values] if grand_totals else []),
    )
    inside = W.partitionBy("__slot").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    local = slotted.select("*", *[F.sum(v).over(inside).alias(f"cum_{n}") for n, v in values.items()])
    joined = local.join(offsets, "__slot")
    totals = [f"total_{n}" for n in values] if grand_totals else []
    return joined.select(
        *df.columns,
        *[(F.col(f"before_{n}") + F.col(f"cum_{n}")).alias(n) for n in values],
        *totals,
    )


def digest_position(
    df: DataFrame,
    key: str,
    seed: int | str,
    group: Sequence[str] = (),
    name: str = "position",
    total: str | None = None,
) -> DataFrame:
    """0-based position of each row in the seeded pseudo-random order of its group.

    ``key`` must be unique. Buckets are leading digest digits, so they are even
    whatever the keys look like, and a hot group is spread over all of them.
    """
    keyed = df.withColumn("__digest", seeded_digest(key, seed))
    keyed = keyed.withColumn("__bucket", digest_number(F.col("__digest"), 1, bucket_digits(df.count())))
    placed = running_totals(
        keyed,
        {"__n": F.lit(1).cast("bigint")},
        [F.col("__digest"), F.col(key)],
        "__bucket",
        group,
        grand_totals=total is not None,
    )
    placed = placed.withColumn(name, F.col("__n") - 1)
    if total is not None:
        placed = placed.withColumnRenamed("total___n", total)
    return placed.drop("__digest", "__bucket", "__n")


def digest_parts(
    df: DataFrame,
    key: str,
    seed: int | str,
    part_of: Callable[[Column, Column], Column],
    group: Sequence[str] = (),
    name: str = "part",
) -> DataFrame:
    """Part of each row, as a function of its seeded position and its group's size.

    ``part_of(position, size)`` must change at few positions, as a split or a
    sample does. Bucket counts then settle the part of almost all buckets, whose
    rows are never shuffled; only the buckets holding a change are ranked.
    """
    keyed = df.withColumn("__digest", seeded_digest(key, seed))
    keyed = keyed.withColumn(
        "__slot", F.struct(*group, digest_number(F.col("__digest"), 1, bucket_digits(df.count())).alias("bucket"))
    )
    counted = keyed.groupBy("__slot").agg(F.count(F.lit(1)).alias("n"))
    group_cols = [F.col(f"__slot.{g}") for g in group]
    order = W.partitionBy(*group_cols).orderBy("__slot.bucket").rowsBetween(W.unboundedPreceding, -1)
    edges = counted.select(
        "__slot",
        "n",
        F.coalesce(F.sum("n").over(order), F.lit(0)).alias("__before"),
        F.sum("n").over(W.partitionBy(*group_cols)).alias("__size"),
    )
    edges = edges.select(
        "__slot",
        "__before",
        "__size",
        part_of(F.col("__before"), F.col("__size")).alias("__first"),
        part_of(F.col("__before") + F.col("n") - 1, F.col("__size")).alias("__last"),
    )
    stored = materialize(edges, "bucket-edges")
    if stored.count() <= BROADCAST_BUCKETS:
        stored = F.broadcast(stored)
    joined = keyed.join(stored, "__slot")
    settled = joined.where(F.col("__first") == F.col("__last")).select(*df.columns, F.col("__first").alias(name))
    inside = W.partitionBy("__slot").orderBy("__digest", key)
    ranked = joined.where(F.col("__first") != F.col("__last")).withColumn(
        "__position", F.col("__before") + F.row_number().over(inside) - 1
    )
    part = part_of(F.col("__position"), F.col("__size"))
    return settled.unionByName(ranked.select(*df.columns, part.alias(name)))


def range_parts(df: DataFrame, key: str, partitions: int | None) -> DataFrame:
    """Rows cut into key ranges and sorted inside; the session decides how many without a number."""
    cut = df.repartitionByRange(key) if partitions is None else df.repartitionByRange(partitions, key)
    return cut.sortWithinPartitions(key)


def global_index(
    df: DataFrame, key: str, name: str = "global_index", partitions: int | None = None
) -> DataFrame:
    """Contiguous 0-based row number in the order of a unique key.

    One range shuffle sorts the rows; each row then knows its partition and its
    place inside it, and that is stored in the shared folder, so the numbers are
    data and cannot change when a task runs again. What is left is to add the
    number of rows in earlier partitions, a table of one row per partition.
    """
    ordered = range_parts(df, key, partitions)
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    stored = materialize(
        ordered.select("*", F.spark_partition_id().alias("__part"), place.alias("__place")), "ordered"
    )
    sizes = stored.groupBy("__part").agg(F.count(F.lit(1)).alias("__rows"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__rows").over(before), F.lit(0)).alias("__start"))
    return stored.join(F.broadcast(starts), "__part").select(
        *df.columns, (F.col("__start") + F.col("__place")).alias(name)
    )


def first_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first ``n`` rows by a unique key: a filter on the distributed position, as a limit ends in one task."""
    if n < 0:
        raise ValueError("n must not be negative")
    return global_index(df, key, "__position").where(F.col("__position") < n).drop("__position")
