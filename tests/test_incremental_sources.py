import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pairweave.operators import eval_pairs as ep
from pairweave.operators import incremental as inc
from pairweave.operators.models import model_map, score_models
from pairweave.schemas import SCORE_COLUMNS
from pairweave.sources import pairs as src
from pairweave.sources import results
from pairweave.streaming import scoring

ROWS = [
    (1, "今晚的火车几点到达北站", "北站今晚有哪些到达的车次", 1),
    (2, "山路在雨后很滑", "邮局星期日不开门", 0),
    (3, 'quoted "text", with comma', "line\nbreak", 0),
]


def csv(tmp_path, text, name="p.csv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_load_csv_and_projections(spark, tmp_path):
    quoted = "id,sentence1,sentence2,label\n" + "\n".join(
        f'{i},"{a.replace(chr(34), chr(34) * 2)}","{b}",{l}' for i, a, b, l in ROWS
    )
    df = src.load_pairs(spark, csv(tmp_path, quoted), multi_line=True)
    assert [tuple(r) for r in df.orderBy("id").collect()] == ROWS
    assert df.schema["id"].dataType == T.LongType()
    assert src.sentence1_list(df).count() == 3 and src.sentence2_list(df).columns == ["sentence2"]
    assert [r.label for r in src.labels(df).collect()] == [1, 0, 0]
    assert src.sentence_pairs(df).columns == ["sentence1", "sentence2"]


def test_columns_by_name_and_group(spark, tmp_path):
    path = csv(tmp_path, "group,label,id,sentence2,sentence1\ntech,1,7,b,a\n")
    row = src.load_pairs(spark, path, extra={"group": T.StringType()}).first()
    assert (row.id, row.sentence1, row.sentence2, row.label, row.group) == (7, "a", "b", 1, "tech")


def test_bad_files(spark, tmp_path):
    with pytest.raises(ValueError, match="missing columns"):
        src.load_pairs(spark, csv(tmp_path, "id,sentence1\n1,x\n"))
    with pytest.raises(Exception):
        src.load_pairs(spark, str(tmp_path / "absent.csv"))
    with pytest.raises(ValueError):
        src.load_pairs(spark, csv(tmp_path, "", "empty.csv"))
    with pytest.raises(Exception):
        src.load_pairs(spark, csv(tmp_path, "id,sentence1,sentence2,label\nx,a,b,1\n", "typed.csv")).collect()


def test_parquet(spark, tmp_path):
    df = spark.createDataFrame(ROWS, "id int, sentence1 string, sentence2 string, label long")
    df.write.parquet(str(tmp_path / "p"))
    loaded = src.load_pairs(spark, str(tmp_path / "p"))
    assert sorted(map(tuple, loaded.collect())) == ROWS and loaded.schema["label"].dataType == T.IntegerType()


def test_chunks_lookup_and_updates(spark, tmp_path):
    df = spark.range(25).select((F.col("id") * 5 + 2).alias("id"), F.lit("t").alias("sentence1")).repartition(3)
    scan = inc.indexed_scan(df, "id", SCORE_COLUMNS)
    assert [r.id for r in scan.orderBy("global_index").collect()] == [i * 5 + 2 for i in range(25)]
    chunks = {r.chunk: (r.start_index, r.rows, r.total_rows, r.total_chunks) for r in inc.count_and_chunks(scan, chunk_rows=10).collect()}
    assert chunks == {0: (0, 10, 25, 3), 1: (10, 10, 25, 3), 2: (20, 5, 25, 3)}
    assert inc.row_lookup(scan, 24).first().id == 122
    with pytest.raises(Exception, match="out of range"):
        inc.row_lookup(scan, 25).collect()
    updates = spark.createDataFrame(
        [(3, 0.5, 1, "x"), (3, 0.7, 2, "x"), (4, None, 1, "x"), (99, 0.1, 1, "x")],
        f"global_index long, {SCORE_COLUMNS[0]} double, v int, other string",
    )
    done = inc.apply_updates(scan, updates, SCORE_COLUMNS, version="v")
    assert done.columns == scan.columns and done.count() == 25
    assert {r.global_index: r[SCORE_COLUMNS[0]] for r in done.collect() if r[SCORE_COLUMNS[0]] is not None} == {3: 0.7}
    results.write_results(done, str(tmp_path / "out"), chunk_rows=10)
    back = results.read_results(spark, str(tmp_path / "out"), done.schema)
    assert sorted(map(repr, back.collect())) == sorted(map(repr, done.collect()))


def test_pending_done_merge_progress(spark):
    df = spark.range(20).withColumnRenamed("id", "global_index")
    processed = spark.createDataFrame([(i,) for i in (0, 1, 2, 11, 11, 50)], "global_index long")
    assert inc.unprocessed_rows(df, processed).count() == 16
    assert sorted(r.global_index for r in inc.already_done(df, processed).collect()) == [0, 1, 2, 11]
    parts = [df.where("global_index >= 10"), df.where("global_index < 10")]
    assert [r.global_index for r in inc.merge_results(parts).collect()] == list(range(20))
    report = {r.chunk: (r.rows, r.done, r.chunk_completion, r.dataset_completion) for r in inc.progress_report(df, processed, chunk_rows=10).collect()}
    assert report == {0: (10, 3, 30.0, 20.0), 1: (10, 1, 10.0, 20.0)}


def test_summary_and_evaluation_files(spark, tmp_path):
    df = spark.createDataFrame([(0.9, 1), (0.8, 0), (0.3, 1), (0.1, 0)], "m double, label int")
    summary = ep.pair_eval_summary(ep.cumulative_counts(ep.long_scores(df, ["m"])))
    results.save_summary(summary, str(tmp_path / "s"))
    assert results.load_summary(spark, str(tmp_path / "s")).collect() == summary.collect()
    hits = spark.createDataFrame(
        [("a", 1, 2, 6, 0.25), ("a", 1, 1, 5, 0.5)],
        "approach string, query_id long, rank int, item_id long, similarity double",
    )
    averages = spark.createDataFrame([("a", 0.1, 0.2, 0.3, 0.4, 0.5)], "approach string, precision double, recall double, f1 double, mrr double, ndcg double")
    queries = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "approach string, query_id long")
    averages = averages.unionByName(averages.withColumn("approach", F.lit("b")))
    told = hits.withColumn("sentence", F.concat(F.lit("text "), "item_id"))
    results.save_evaluation(results.evaluation_records(queries, told, averages), str(tmp_path / "e"))
    rows = {(r.approach_name, r.query_id): r for r in results.load_evaluation(spark, str(tmp_path / "e")).collect()}
    assert set(rows) == {("a", 1), ("a", 2), ("b", 1)}
    row = rows["a", 1]
    assert row.retrieved_indices == [5, 6] and row.retrieved_similarities == [0.5, 0.25] and row.evaluation.ndcg == 0.5
    assert row.retrieved_results == ["text 5", "text 6"]
    assert rows["a", 2].retrieved_indices == rows["b", 1].retrieved_results == [] and rows["b", 1].evaluation.ndcg == 0.5


def test_model_map_loads_per_task_and_captures_errors(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def load():
        import uuid

        (log / f"load-{uuid.uuid4()}").touch()

        def predict(batch):
            if (batch["x"] < 0).any():
                raise ValueError("negative")
            return np.sqrt(batch["x"])

        return predict

    def release(_):
        import uuid

        (log / f"free-{uuid.uuid4()}").touch()

    df = spark.createDataFrame([(i, float(i - 1)) for i in range(10)], "id long, x double").repartition(2)
    out = {r.id: (r.y, r.problem) for r in model_map(df, load, ["x"], "y", error="problem", release=release).collect()}
    assert out[0] == (None, "ValueError: negative") and out[5] == (2.0, None)
    names = [p.name[:4] for p in log.iterdir()]
    assert names.count("load") == names.count("free") <= 2
    with pytest.raises(Exception, match="negative"):
        model_map(df, load, ["x"], "y").collect()


def test_failing_rows_are_found_by_halving():
    import pandas as pd

    from pairweave.operators.models import predict_rows

    calls = []

    def predict(batch):
        calls.append(len(batch))
        if (batch["x"] == 700).any():
            raise ValueError("bad")
        return batch["x"] * 2.0

    scores, errors = predict_rows(predict, pd.DataFrame({"x": range(1000)}))
    assert [i for i, e in enumerate(errors) if e] == [700] and scores[700] is None
    assert [s for i, s in enumerate(scores) if i != 700] == [2.0 * i for i in range(1000) if i != 700]
    assert len(calls) < 25


def test_two_runs_score_like_one(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "cp"))
    schema = T.StructType([T.StructField("id", T.LongType())])
    score = lambda df: df.withColumn("score", F.col("id") * 0.5)
    for lot in (spark.range(10), spark.range(10, 15)):
        lot.repartition(2).write.mode("append").parquet(source)
        for _ in range(2):  # the second run finds nothing new
            scoring.score_new_files(spark, source, schema, score, sink, log, files_per_batch=1)
    assert sorted(r.id for r in spark.read.parquet(sink).collect()) == list(range(15))


def test_stream_quality_adds_up(spark, tmp_path):
    source, sink, log = (str(tmp_path / n) for n in ("in", "out", "cp"))
    df = spark.range(30).select("id", F.when(F.col("id") != 3, F.col("id") / 30).alias("s"), (F.col("id") >= 15).cast("int").alias("label"))
    partials = scoring.chunk_partials("id", 10, "s", "label")
    for lot in (df.where("id < 12"), df.where("id >= 12")):
        lot.repartition(2).write.mode("append").parquet(source)
        scoring.track_quality(spark, source, df.schema, partials, sink, log, files_per_batch=1)
    got = {r.chunk: (r.rows, r.scored, r.correct, r.completion) for r in scoring.quality_report(spark, sink).collect()}
    assert got == {0: (10, 9, 9, 90.0), 1: (10, 10, 10, 100.0), 2: (10, 10, 10, 100.0)}


def test_models_fail_independently(spark):
    def picky():
        def predict(batch):
            if (batch["x"] == 2).any():
                raise ValueError("two")
            return batch["x"] * 10.0

        return predict

    df = spark.createDataFrame([(i, float(i), 9.0) for i in range(4)], "id long, x double, old double")
    out = {r.id: (r.a, r.old) for r in score_models(df, {"a": picky, "old": lambda: lambda b: b["x"] + 1}, ["x"]).collect()}
    assert out == {0: (0.0, 1.0), 1: (10.0, 2.0), 2: (None, 3.0), 3: (30.0, 4.0)}
    scored = score_models(df, {"a": picky, "old": lambda: lambda b: b["x"] + 1}, ["x"])
    assert {r.id: (r.a_error, r.old_error) for r in scored.collect()} == {i: ("ValueError: two" if i == 2 else None, None) for i in range(4)}
    assert score_models(df, {"a": picky}, ["x"], errors=False).columns == ["id", "x", "old", "a"]
