import pytest
from pyspark.sql import types as T

from pairweave.operators.embed import hashed_ngrams
from pairweave.plans.workflows import Approach, evaluate_pairs, retrieval_experiment, score_pairs
from pairweave.schemas import PAIRS, SCORE_COLUMNS


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [(i, f"topic{i} words about {i}", f"topic{i} words about {i}", i % 2) for i in range(12)]
    return spark.createDataFrame(rows, PAIRS)


def test_experiment_compares_and_times(spark, pairs):
    answer = lambda prompts: prompts.selectExpr("query_id", "'1' as response")
    approaches = [
        Approach("direct", hashed_ngrams),
        Approach("index", hashed_ngrams, cells=2, probes=2),
        Approach("answered", hashed_ngrams, respond=answer),
    ]
    result = retrieval_experiment(pairs, approaches, k=3)
    rows = {r.approach: r for r in result.averages.collect()}
    assert set(rows) == {"direct", "index", "answered"} and rows["direct"].queries == 12
    assert rows["index"].ndcg == pytest.approx(rows["direct"].ndcg) == pytest.approx(rows["answered"].ndcg)
    top = {r.query_id: r.item_id for r in result.hits.where("approach = 'direct' and rank = 1").collect()}
    assert top == {i: i for i in range(12)}
    assert {r.metric for r in result.comparison.collect()} == {"precision", "recall", "f1", "mrr", "ndcg"}
    assert all(r.indexing_time > 0 and r.avg_retrieval_time > 0 for r in result.timing.collect())
    assert retrieval_experiment(pairs, approaches[:1], 2, sample_size=5).averages.first().queries == 5


def test_score_then_evaluate(spark, pairs, tmp_path):
    source, sink, log, out = (str(tmp_path / n) for n in ("in", "scored", "cp", "out"))
    pairs.repartition(3).write.parquet(source)

    def model(width):
        def load():
            return lambda b: [float(len(set(x[:width]) & set(y[:width]))) / width for x, y in zip(b.sentence1, b.sentence2)]

        return load

    loaders = {c: model(w) for c, w in zip(SCORE_COLUMNS, (4, 6, 8))}
    first = score_pairs(spark, source, PAIRS, loaders, sink, log)
    assert first.count() == 12 and set(SCORE_COLUMNS) <= set(first.columns)
    assert score_pairs(spark, source, PAIRS, loaders, sink, log).count() == 12
    summary = evaluate_pairs(first, out)
    assert summary.count() == 3
    read = spark.read.option("header", True).csv(f"{out}/threshold_sensitivity")
    assert read.count() == 54 and "model" in read.columns
    assert spark.read.parquet(f"{out}/roc_curves").where("threshold = double('inf')").count() == 3
    assert T.StringType() == spark.read.parquet(f"{out}/pr_curves").schema["model"].dataType
