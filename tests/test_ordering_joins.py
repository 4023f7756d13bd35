import hashlib

import pytest
from pyspark.sql import functions as F

from pairweave.operators import ordering as o
from pairweave.operators.joins import hot_keys, skew_join


def test_digest_position_with_hot_and_null_groups(spark):
    group = lambda i: "hot" if i % 3 else (None if i % 2 else "cold")
    rows = [(i, group(i)) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, g string").repartition(5)
    placed = o.digest_position(df, "id", 9, ["g"], "p", total="size").collect()
    digest = lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest()
    for g in ("hot", "cold", None):
        ids = sorted((i for i, name in rows if name == g), key=digest)
        assert {r.id: r.p for r in placed if r.g == g} == {i: n for n, i in enumerate(ids)}
        assert {r["size"] for r in placed if r.g == g} == {len(ids)}


@pytest.mark.parametrize("keys", [range(0, 3000, 7), [1, 2, 3, 10**18, -5], [4], list(range(50)) + [10**15 + i for i in range(50)]])
def test_global_index_is_contiguous(spark, keys):
    keys = list(keys)
    df = spark.createDataFrame([(k,) for k in keys], "k long").repartition(4)
    got = {r.k: r.global_index for r in o.global_index(df, "k").collect()}
    assert got == {k: n for n, k in enumerate(sorted(keys))}


def test_running_totals_without_group(spark):
    df = spark.range(100).withColumn("b", F.floor(F.col("id") / 10))
    got = o.running_totals(df, {"s": "id"}, [F.col("id")], "b", grand_totals=True).orderBy("id").collect()
    assert [r.s for r in got] == [i * (i + 1) // 2 for i in range(100)]
    assert {r.total_s for r in got} == {4950}


def test_first_rows(spark):
    df = spark.range(200).select((F.col("id") * 3).alias("k"))
    assert sorted(r.k for r in o.first_rows(df, "k", 20).collect()) == [3 * i for i in range(20)]
    assert o.first_rows(df, "k", 0).count() == 0 and o.first_rows(df, "k", 1000).count() == 200
    with pytest.raises(ValueError):
        o.first_rows(df, "k", -1)


def test_no_window_runs_over_the_detail_rows_as_a_whole(spark):
    df = spark.range(100).withColumnRenamed("id", "k")
    plan = o.digest_position(df, "k", 1)._jdf.queryExecution().executedPlan().toString()
    detail = [line for line in plan.splitlines() if "cum___n" in line and "Window" in line]
    assert detail and all("__slot" in line for line in detail)


def test_skew_join_equals_plain_join(spark):
    left = spark.range(3000).select(
        F.col("id").alias("row"), F.when(F.col("id") % 3 == 0, 0).when(F.col("id") % 50 == 1, None).otherwise(F.col("id") % 97).alias("k")
    )
    right = spark.range(90).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    for how in ("inner", "left"):
        got = sorted(map(repr, skew_join(left, right, "k", ["row"], probe=left, how=how).select("row", "k", "v").collect()))
        assert got == sorted(map(repr, left.join(right, "k", how).select("row", "k", "v").collect()))


def test_hot_key_list_is_bounded(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 400, 7).otherwise(F.col("id")).alias("k"))
    assert [r.k for r in hot_keys(df, "k", 0.1).collect()] == [7]


def test_exact_copies_of_a_hot_row_are_spread(spark):
    left = spark.range(0, 4000, 1, 16).select(F.lit(5).alias("k"))
    nulls = left.select(F.lit(None).cast("int").alias("k"))
    assert skew_join(nulls, left.distinct(), "k", ["k"], probe=left, how="left").count() == 4000
    right = spark.createDataFrame([(5, 1)], "k int, v int")
    joined = skew_join(left, right, "k", ["k"], probe=left, salts=8)
    assert joined.count() == 4000
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "__salt" in plan and "spark_partition_id" in plan.lower()


def test_skew_join_with_a_probe_that_changes(spark):
    """A probe that gives other hot keys each time it runs must not lose rows."""
    left = spark.range(20_000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"))
    right = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        joined = skew_join(left, right, "k", ["id"], probe=left.where(F.rand() < 0.02))
        assert joined.count() == 20_000 and joined.where("v is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")
