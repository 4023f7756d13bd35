"""Any Python model over a table: loaded once per task, fed in Arrow batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

Predict = Callable[[pd.DataFrame], Sequence[float]]


def predict_rows(predict: Predict, inputs: pd.DataFrame) -> tuple[list[float | None], list[str | None]]:
    """Score a batch; a failing batch is halved until only the failing rows are left."""
    try:
        return [None if pd.isna(s) else float(s) for s in predict(inputs)], [None] * len(inputs)
    except Exception as e:
        if len(inputs) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    half = len(inputs) // 2
    (scores, errors), (more, more_errors) = (
        predict_rows(predict, part) for part in (inputs.iloc[:half], inputs.iloc[half:])
    )
    return scores + more, errors + more_errors


def score_models(
    df: DataFrame, loaders: dict[str, Callable[[], Predict]], inputs: Sequence[str], errors: bool = True
) -> DataFrame:
    """One score column per model in one pass; a row a model fails on gets null there.

    With ``errors`` a column ``<model>_error`` tells why, null where it worked. A model that cannot be loaded fails the task, as no row could be scored.
    """
    told = [f"{name}_error" for name in loaders] if errors else []
    kept = [f for f in df.schema.fields if f.name not in loaders and f.name not in told]
    scored = [T.StructField(name, T.DoubleType()) for name in loaders]
    schema = T.StructType([*kept, *scored, *[T.StructField(name, T.StringType()) for name in told]])
    names, wanted = [f.name for f in kept], list(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        models = {name: load() for name, load in loaders.items()}
        for batch in batches:
            found = {name: predict_rows(model, batch[wanted]) for name, model in models.items()}
            out = {n: pd.Series(scores, index=batch.index, dtype="float64") for n, (scores, _) in found.items()}
            if errors:
                out |= {f"{n}_error": reasons for n, (_, reasons) in found.items()}
            yield batch[names].assign(**out)

    return df.mapInPandas(run, schema)


def model_map(
    df: DataFrame,
    load: Callable[[], Predict],
    inputs: Sequence[str],
    output: str,
    error: str | None = None,
    release: Callable[[Predict], None] | None = None,
) -> DataFrame:
    """Add the model's score; with ``error`` a failing row gets null and its message.

    Without ``error`` a failure fails the task. Batches follow
    ``spark.sql.execution.arrow.maxRecordsPerBatch``. The input columns of the
    model and everything else pass through unchanged.
    """
    fields = [*df.schema.fields, T.StructField(output, T.DoubleType())]
    if error is not None:
        fields.append(T.StructField(error, T.StringType()))
    wanted = list(inputs)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        predict = load()
        try:
            for batch in batches:
                if error is None:
                    yield batch.assign(**{output: list(predict(batch[wanted]))})
                else:
                    scores, errors = predict_rows(predict, batch[wanted])
                    scored = pd.Series(scores, index=batch.index, dtype="float64")
                    yield batch.assign(**{output: scored, error: errors})
        finally:
            if release is not None:
                release(predict)

    return df.mapInPandas(run, T.StructType(fields))
