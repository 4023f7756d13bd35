"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairweave.session import discard, materialize


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    return tuple(row)


def components(edges: DataFrame) -> DataFrame:
    """``(id, component_id)`` for every end of an edge; the smallest id names its component.

    ``edges`` has integer columns ``a`` and ``b``. Loops and repeated edges are
    harmless; an empty table gives an empty result. Each round writes the edges
    to the shared folder, a step never makes more edges than it was given, and a
    hub is an aggregate and a join on its id, never a collected list.
    """
    low, high = F.least("a", "b"), F.greatest("a", "b")
    now = materialize(edges.where("a != b").select(low.alias("a"), high.alias("b")).distinct(), "edges")
    mark = _mark(now)
    while mark[0]:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("least")).select("a", F.least("a", "least").alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("m").alias("a"), "b").distinct()
        down = large.groupBy("b").agg(F.min("a").alias("m"))
        joined = large.join(down, "b")
        small = joined.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(
            joined.select(F.col("m").alias("a"), "b")
        )
        after = materialize(small.where("a != b").distinct(), "edges")
        was, mark = mark, _mark(after)
        discard(now)
        now = after
        if was == mark:
            break
    return now.select(F.col("b").alias("id"), F.col("a").alias("component_id")).unionByName(
        now.select(F.col("a").alias("id"), F.col("a").alias("component_id")).distinct()
    )
