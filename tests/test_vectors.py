import pytest
from pyspark.sql import functions as F

from pairweave.functions import vectors as V


def score(spark, a, b, fn):
    df = spark.createDataFrame([(a, b)], "a array<double>, b array<double>")
    return df.select(fn("a", "b")).first()[0]


@pytest.mark.parametrize(
    "a, b, want",
    [
        ([1.0, 0.0], [0.0, 1.0], 0.0),
        ([1.0, 0.0], [2.0, 0.0], 1.0),
        ([1.0, 0.0], [1.0, 1.0], 0.7071),
        ([1.0, 0.0], [-1.0, 0.0], -1.0),
        ([0.0, 0.0], [1.0, 1.0], 0.0),
    ],
)
def test_cosine(spark, a, b, want):
    assert score(spark, a, b, V.cosine) == pytest.approx(want, abs=1e-4)


@pytest.mark.parametrize("b, want", [([4.0, 5.0], 23), ([1.0, 1.0], 5), ([0.0, 0.0], 0), ([-1.0, -1.0], -5)])
def test_dot(spark, b, want):
    assert score(spark, [2.0, 3.0], b, V.dot) == want


def test_null_and_length_mismatch_give_null(spark):
    assert score(spark, None, [1.0], V.cosine) is None
    assert score(spark, [1.0], [1.0, 2.0], V.cosine) is None
    assert score(spark, [1.0], [1.0, 2.0], V.dot) is None


def test_unknown_metric_is_refused_while_planning():
    with pytest.raises(ValueError):
        V.similarity("a", "b", "manhattan")
    with pytest.raises(ValueError):
        V.distance_to_similarity(F.lit(1.0), "manhattan")


def test_unit_and_distance(spark):
    df = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0])], "a array<double>, z array<double>")
    row = df.select(V.scaled_to_unit("a"), V.scaled_to_unit("z"), V.clamp01(F.lit(-0.2)), V.clamp01(F.lit(1.2))).first()
    assert list(row) == [[0.6, 0.8], [0.0, 0.0], 0.0, 1.0]
    assert spark.range(1).select(V.distance_to_similarity(F.lit(0.25))).first()[0] == 0.75
    assert spark.range(1).select(V.distance_to_similarity(F.lit(0.5), "l2sq")).first()[0] == 0.75
