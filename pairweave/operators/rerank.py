"""Second-stage reranking from a table of model responses.

A response is free text naming candidates by number. All arrays here belong to
one query and hold at most the first-stage k entries.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INSTRUCTION = (
    "Judge how close in meaning each numbered candidate is to the query. "
    "Answer with the numbers of the {k} closest candidates, best first, separated by commas, and nothing else."
)


def numbered_list(candidates: Column) -> Column:
    """``1. first`` newline ``2. second`` ... from an array of (rank, sentence)."""
    lines = F.transform(
        F.array_sort(candidates), lambda c: F.concat(c["rank"].cast("string"), F.lit(". "), c["sentence"])
    )
    return F.array_join(lines, "\n", "")


def rerank_prompts(candidates: DataFrame, queries: DataFrame, k: int = 5, instruction: str = INSTRUCTION) -> DataFrame:
    """One prompt per query: instruction, query text, numbered candidates.

    ``candidates``: ``(query_id, rank, sentence)``; ``queries``: ``(query_id, query)``.
    """
    listed = candidates.groupBy("query_id").agg(
        numbered_list(F.collect_list(F.struct("rank", F.coalesce("sentence", F.lit("")).alias("sentence")))).alias(
            "numbered"
        ),
        F.count(F.lit(1)).alias("n_candidates"),
    )
    prompt = F.concat(
        F.lit(instruction.format(k=k) + '\n\nQuery: "'), F.col("query"), F.lit('"\n\nCandidates:\n'), F.col("numbered")
    )
    return queries.join(listed, "query_id").select("query_id", "n_candidates", prompt.alias("prompt"))


def picked_numbers(response: Column, n: Column, k: int) -> Column:
    """The first k numbers of a response that name a candidate, repeats removed."""
    numbers = F.slice(F.regexp_extract_all(response, F.lit(r"(\d+)"), 1), 1, k)
    as_int = F.transform(numbers, lambda x: x.try_cast("int"))
    return F.array_distinct(F.filter(as_int, lambda x: (x >= 1) & (x <= n)))


def rerank_apply(candidates: DataFrame, responses: DataFrame, k: int = 5) -> DataFrame:
    """New ranks 1..k: picked candidates first, then the unused ones in old order.

    ``candidates``: ``(query_id, rank, item_id, similarity, ...)`` with ranks
    1..n; ``responses``: ``(query_id, response)``, at most one row per query. A
    query without a response keeps its first k candidates. The original
    similarity stays with its item.
    """
    others = [c for c in candidates.columns if c not in ("query_id", "rank")]
    listed = candidates.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", *others))).alias("list")
    )
    joined = listed.join(responses.select("query_id", "response"), "query_id", "left")
    n = F.size("list")
    picked = F.coalesce(picked_numbers(F.col("response"), n, k), F.array().cast("array<int>"))
    order = F.slice(F.concat(picked, F.array_except(F.sequence(F.lit(1), n), picked)), 1, k)
    placed = joined.select("query_id", "list", F.posexplode(order).alias("place", "old_rank"))
    entry = F.element_at("list", F.col("old_rank"))
    return placed.select(
        "query_id", (F.col("place") + 1).alias("rank"), "old_rank", *[entry[c].alias(c) for c in others]
    )


def responses_from_scores(candidates: DataFrame, score: str) -> DataFrame:
    """Answer table of a numeric second stage: candidate numbers by falling score."""
    listed = candidates.groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct((-F.col(score)).alias("s"), "rank"))).alias("list")
    )
    numbers = F.transform("list", lambda c: c["rank"].cast("string"))
    return listed.select("query_id", F.array_join(numbers, ", ").alias("response"))


def answer_batch(model: Callable[[list[str]], list[str]], prompts: list[str]) -> tuple[list[str | None], list[str | None]]:
    """Answers and reasons; a failing batch is halved until only the failing prompts are left."""
    try:
        return list(model(prompts)), [None] * len(prompts)
    except Exception as e:
        if len(prompts) == 1:
            return [None], [f"{type(e).__name__}: {e}"]
    half = len(prompts) // 2
    (answers, errors), (more, more_errors) = (answer_batch(model, p) for p in (prompts[:half], prompts[half:]))
    return answers + more, errors + more_errors


def model_responses(prompts: DataFrame, load: Callable[[], Callable], batched: bool = False) -> DataFrame:
    """``(query_id, response, error)``: every prompt answered by a text model, loaded once per task.

    With ``batched`` the model takes a list of prompts and gives a list of
    answers, else one at a time. A prompt the model fails on gets a null
    response, which keeps the first k, and the reason.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        many = model if batched else lambda texts: [model(t) for t in texts]
        for batch in batches:
            asked = batch.column(1).to_pylist()
            parts = [[p] for p in asked] if not batched else [asked] if asked else []
            found = [answer_batch(many, part) for part in parts]
            answers, errors = ([x for pair in found for x in pair[i]] for i in (0, 1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(answers, pa.string()), pa.array(errors, pa.string())],
                names=["query_id", "response", "error"],
            )

    return prompts.select("query_id", "prompt").mapInArrow(run, "query_id long, response string, error string")


def rerank(
    candidates: DataFrame, queries: DataFrame, respond: Callable[[DataFrame], DataFrame], k: int = 5
) -> DataFrame:
    """Prompts, answers and new ranks in one go; ``candidates`` carry their sentence."""
    answers = respond(rerank_prompts(candidates, queries, k)).select("query_id", "response")
    return rerank_apply(candidates, answers, k)
