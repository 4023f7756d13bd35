"""Column contracts of the tables this package reads and writes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

PAIRS = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("sentence1", T.StringType()),
        T.StructField("sentence2", T.StringType()),
        T.StructField("label", T.IntegerType()),
    ]
)

PAIR_COLUMNS = tuple(PAIRS.fieldNames())

# Names of the three score columns of a scored pair table.
SCORE_COLUMNS = ("word2vec_match_res", "bge_large_match_res", "bge_m3_match_res")

HITS = T.StructType(
    [
        T.StructField("query_id", T.LongType()),
        T.StructField("rank", T.IntegerType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("similarity", T.DoubleType()),
    ]
)


def require_columns(df: DataFrame, columns) -> DataFrame:
    """Fail while the plan is built when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df
