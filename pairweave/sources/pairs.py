"""Reading sentence-pair tables with a declared schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from pairweave.schemas import PAIR_COLUMNS, PAIRS, require_columns


def header_of(spark: SparkSession, path: str) -> list[str]:
    """Column names in a CSV header; an empty file is an error."""
    names = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    if not names:
        raise ValueError(f"no header in {path}")
    return names


def load_pairs(
    spark: SparkSession,
    path: str,
    fmt: str | None = None,
    schema: T.StructType = PAIRS,
    extra: dict[str, T.DataType] | None = None,
    mode: str = "FAILFAST",
    multi_line: bool = False,
) -> DataFrame:
    """Pairs from CSV (UTF-8, comma, header) or parquet.

    Files are split between tasks. Pass ``multi_line=True`` for CSV files whose
    values span lines; then each file is read by one task.

    CSV columns are matched to the schema by name, in any order; ``extra`` adds
    typed columns such as ``group``. A malformed value stops the read unless
    ``mode`` is PERMISSIVE.
    """
    fmt = fmt or ("csv" if path.rstrip("/").endswith((".csv", ".csv.gz")) else "parquet")
    wanted = T.StructType([*schema.fields, *[T.StructField(n, t) for n, t in (extra or {}).items()]])
    if fmt != "csv":
        df = spark.read.format(fmt).load(path)
        return require_columns(df, wanted.fieldNames()).select(
            *[df[f.name].cast(f.dataType).alias(f.name) for f in wanted]
        )
    header = header_of(spark, path)
    missing = [c for c in wanted.fieldNames() if c not in header]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    types = {f.name: f.dataType for f in wanted}
    in_file_order = T.StructType([T.StructField(n, types.get(n, T.StringType())) for n in header])
    reader = (
        spark.read.schema(in_file_order)
        .option("header", True)
        .option("enforceSchema", False)
        .option("encoding", "UTF-8")
        .option("multiLine", multi_line)
        .option("escape", '"')
        .option("mode", mode)
    )
    return reader.csv(path).select(*wanted.fieldNames())


def sentence_pairs(df: DataFrame) -> DataFrame:
    return df.select("sentence1", "sentence2")


def sentence1_list(df: DataFrame) -> DataFrame:
    return df.select("sentence1")


def sentence2_list(df: DataFrame) -> DataFrame:
    return df.select("sentence2")


def labels(df: DataFrame) -> DataFrame:
    return df.select("label")


def project_pairs(df: DataFrame) -> DataFrame:
    return require_columns(df, PAIR_COLUMNS).select(*PAIR_COLUMNS)
