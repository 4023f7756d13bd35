import math
import os
import random

import pytest
from pyspark.sql import functions as F

from pairweave.operators import eval_retrieval as ev
from pairweave.sources import results
from pairweave.streaming import scoring

SCHEMA = "id long, x double"


def deliver(spark, source, ids, files=2):
    spark.createDataFrame([(i, float(i)) for i in ids], SCHEMA).repartition(files).write.mode("append").parquet(source)


def half(df):
    return df.select("id", (F.col("x") / 2).alias("score"))


def test_rows_are_scored_once_over_files_runs_and_a_crash(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = spark.createDataFrame([], SCHEMA).schema

    def failing(df):
        bad = F.when(F.col("id") == 12, F.raise_error(F.lit("crash")).cast("double")).otherwise(F.col("x") / 2)
        return df.select("id", bad.alias("score"))

    deliver(spark, source, [*range(10), 3, 3, 4])
    scoring.score_new_rows(spark, source, schema, "id", half, sink, log, files_per_batch=1)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(10))
    deliver(spark, source, [5, 6, 10, 11], files=1)  # a row again, in another file
    deliver(spark, source, [12, 7, 13], files=1)
    with pytest.raises(Exception, match="crash"):
        scoring.score_new_rows(spark, source, schema, "id", failing, sink, log, files_per_batch=1)
    deliver(spark, source, range(15))  # all again after the crash
    for _ in range(2):
        scoring.score_new_rows(spark, source, schema, "id", half, sink, log, files_per_batch=1)
    got = sorted((r.id, r.score) for r in spark.read.parquet(sink).collect())
    assert got == [(i, i / 2) for i in range(15)]


def test_rows_done_elsewhere_and_rows_without_index(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = spark.createDataFrame([], SCHEMA).schema
    deliver(spark, source, range(8))
    done = spark.range(5).withColumn("extra", F.lit("x"))
    scoring.score_new_rows(spark, source, schema, "id", half, sink, log, done=done)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == [5, 6, 7]
    spark.createDataFrame([(None, 1.0)], SCHEMA).write.mode("append").parquet(source)
    with pytest.raises(Exception, match="row without id"):
        scoring.score_new_rows(spark, source, schema, "id", half, sink, log)


def test_state_class_is_left_as_it_was(spark):
    before = spark.conf.get(scoring.STATE_CLASS)
    with pytest.raises(ZeroDivisionError), scoring.state_on_disk(spark):
        assert spark.conf.get(scoring.STATE_CLASS) == scoring.ON_DISK
        raise ZeroDivisionError
    assert spark.conf.get(scoring.STATE_CLASS) == before


def test_running_totals_equal_one_batch(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "cp"))
    df = spark.range(30).select("id", F.when(F.col("id") != 3, F.col("id") / 30).alias("s"), (F.col("id") >= 15).cast("int").alias("label"))
    totals = scoring.chunk_partials("id", 10, "s", "label")
    for lot in (df.where("id < 12"), df.where("id >= 12 and id < 25"), df.where("id >= 25")):
        lot.repartition(2).write.mode("append").parquet(source)
        for _ in range(2):
            scoring.track_totals(spark, source, df.schema, totals, sink, log, files_per_batch=1)
    columns = ("rows", "scored", "correct", "completion", "accuracy")
    want = {r.chunk: [r[c] for c in columns] for r in scoring.with_shares(totals(df)).collect()}
    assert {r.chunk: [r[c] for c in columns] for r in scoring.latest_totals(spark, sink).collect()} == want
    assert want[0] == [10, 9, 9, 90.0, 1.0]


def stamps(path):
    found = {}
    for folder, _, files in os.walk(path):
        for f in files:
            if f.endswith(".parquet"):
                found[os.path.join(folder, f)] = os.stat(os.path.join(folder, f)).st_mtime_ns
    return found


@pytest.mark.parametrize("listed", [1000, 1])
def test_updates_rewrite_touched_chunks_only(spark, tmp_path, monkeypatch, listed):
    monkeypatch.setattr(results, "LISTED_CHUNKS", listed)
    path = str(tmp_path / "chunks")
    rows = spark.range(95).select(F.col("id").alias("global_index"), F.lit("t").alias("text"), F.lit(None).cast("double").alias("a"))
    results.write_chunks(rows.repartition(4), path, chunk_rows=10)
    before = stamps(path)
    assert len(before) == 10
    updates = spark.createDataFrame([(11, 1.5), (12, None), (94, 2.5), (500, 9.0), (None, 3.0)], "global_index long, a double")
    for _ in range(2):  # a repeated call changes nothing
        results.update_chunks(updates, path, rows.schema, ["a"], chunk_rows=10)
    after = stamps(path)
    kept = {p for p, t in before.items() if after.get(p) == t}
    assert {p.split("chunk=")[1].split("/")[0] for p in before.keys() - kept} == {"1", "9"}
    assert len(after) == 10
    stored = results.read_chunks(spark, path, rows.schema)
    got = {r.global_index: r.a for r in stored.collect()}
    assert got == {i: {11: 1.5, 94: 2.5}.get(i) for i in range(95)}
    assert [r.global_index for r in stored.where("chunk = 9").collect()] == list(range(90, 95))
    assert "PartitionFilters: [isnotnull(chunk" in stored.where("chunk = 9")._jdf.queryExecution().toString()
    results.update_chunks(updates.limit(0), path, rows.schema, ["a"], chunk_rows=10)
    assert stamps(path) == after


def test_one_chunk_is_replaced_whole(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = spark.range(20).select(F.col("id").alias("global_index"), F.lit(0).alias("v"))
    results.write_chunks(rows, path, chunk_rows=10)
    results.write_chunks(rows.where("global_index in (3, 4)").withColumn("v", F.lit(1)), path, chunk_rows=10)
    got = sorted((r.global_index, r.v) for r in results.read_chunks(spark, path, rows.schema).collect())
    assert got == [(3, 1), (4, 1)] + [(i, 0) for i in range(10, 20)]


def best(rels, k):
    return sum(r / math.log2(i + 2) for i, r in enumerate(sorted(rels, reverse=True)[:k]))


def test_ideal_of_the_corpus(spark):
    rng = random.Random(2)
    classes = [rng.randrange(6) for _ in range(40)] + [20]
    items = spark.createDataFrame(list(enumerate(classes)), "item_id long, item_class int")
    asked = items.toDF("query_id", "query_class")
    rel = ev.graded_by_distance()
    for k, minus_self in ((1, True), (7, True), (60, False)):
        got = ev.ideal_by_class(asked.select("query_id"), asked, items, rel, k, reach=2, minus_self=minus_self)
        for row in got.collect():
            q = row.query_id
            rels = [max(0, 3 - abs(classes[q] - c)) for i, c in enumerate(classes) if i != q or not minus_self]
            assert row.ideal_dcg == pytest.approx(best(rels, k))
    hits = spark.createDataFrame([(0, r + 1, i) for r, i in enumerate([5, 9, 11])], "query_id long, rank int, item_id long")
    queries = ev.ideal_by_class(asked.select("query_id").withColumn("positives", F.lit(3)), asked, items, rel, 3, reach=2)
    scored = {r.query_id: r.ndcg for r in ev.score_queries(queries, ev.judge_by_class(hits, asked, items, rel)).collect()}
    gained = sum(max(0, 3 - abs(classes[0] - classes[i])) / math.log2(r + 2) for r, i in enumerate([5, 9, 11]))
    ideal = best([max(0, 3 - abs(classes[0] - c)) for c in classes[1:]], 3)
    assert scored[0] == pytest.approx(gained / ideal) and scored[1] == scored[40] == 0.0


def test_ideal_of_judged_items(spark):
    qrels = spark.createDataFrame([(1, 1, 2), (1, 2, 2), (1, 3, 1), (1, 4, 0), (2, 1, 0)], "query_id long, item_id long, rel int")
    got = {r.query_id: r.ideal_dcg for r in ev.ideal_per_query(spark.createDataFrame([(1,), (2,), (3,)], "query_id long"), qrels, 3).collect()}
    assert got == {1: pytest.approx(best([2, 2, 1], 3)), 2: 0.0, 3: 0.0}
