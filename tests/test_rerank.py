import pytest

from pairweave.operators.rerank import model_responses, rerank, rerank_apply, rerank_prompts, responses_from_scores


def reorder(spark, response, k, ids=(10, 20, 30, 40)):
    rows = [(1, r + 1, i, 1 - r / 10) for r, i in enumerate(ids)]
    candidates = spark.createDataFrame(rows, "query_id long, rank int, item_id long, similarity double")
    answers = [] if response is None else [(1, response)]
    responses = spark.createDataFrame(answers, "query_id long, response string")
    out = rerank_apply(candidates, responses, k).orderBy("rank").collect()
    assert [r["rank"] for r in out] == list(range(1, len(out) + 1))
    assert all(r.similarity == pytest.approx(1 - ids.index(r.item_id) / 10) for r in out)
    return [r.item_id for r in out]


@pytest.mark.parametrize(
    "response, k, want",
    [
        ("1, 3, 2", 3, [10, 30, 20]),
        ("2, 4, 1", 3, [20, 40, 10]),
        ("no numbers at all", 2, [10, 20]),
        ("1", 3, [10, 20, 30]),
        ("3", 3, [30, 10, 20]),
        (None, 2, [10, 20]),
        ("0, 2", 2, [20, 10]),
        ("2, 2, 2", 3, [20, 10, 30]),
        ("9, 8, 4, 3", 2, [10, 20]),
        ("99999999999999999999 then 4", 2, [40, 10]),
        ("4,3,2,1", 9, [40, 30, 20, 10]),
    ],
)
def test_response_rules(spark, response, k, want):
    assert reorder(spark, response, k) == want


def test_scores_become_a_response(spark):
    rows = [(1, 1, 10, 0.9, 0.1), (1, 2, 20, 0.8, 0.7), (1, 3, 30, 0.7, 0.7)]
    candidates = spark.createDataFrame(rows, "query_id long, rank int, item_id long, similarity double, s double")
    responses = responses_from_scores(candidates, "s")
    assert responses.first().response == "2, 3, 1"
    out = rerank_apply(candidates, responses, 2).orderBy("rank").collect()
    assert [(r.item_id, r.similarity) for r in out] == [(20, 0.8), (30, 0.7)]


def test_prompt_numbers_candidates_in_rank_order(spark):
    candidates = spark.createDataFrame(
        [(1, 2, "second"), (1, 1, "first"), (1, 3, None)], "query_id long, rank int, sentence string"
    )
    queries = spark.createDataFrame([(1, "what?"), (2, "nothing")], "query_id long, query string")
    row = rerank_prompts(candidates, queries, 2).collect()
    assert len(row) == 1 and row[0].n_candidates == 3
    assert '"what?"' in row[0].prompt and row[0].prompt.endswith("1. first\n2. second\n3. ")
    assert "2 closest" in row[0].prompt


def test_model_answers_and_failures(spark):
    rows = [(q, r, q * 10 + r, 1.0 - r / 10, f"sentence {r}") for q in (1, 2) for r in (1, 2, 3)]
    candidates = spark.createDataFrame(rows, "query_id long, rank int, item_id long, similarity double, sentence string")
    queries = spark.createDataFrame([(1, "fine"), (2, "broken")], "query_id long, query string")

    def load():
        def model(prompt):
            if "broken" in prompt:
                raise RuntimeError("no answer")
            return "3 and 1"

        return model

    out = rerank(candidates, queries, lambda p: model_responses(p, load), 2)
    got = {q: [r.item_id for r in out.orderBy("rank").collect() if r.query_id == q] for q in (1, 2)}
    assert got == {1: [13, 11], 2: [21, 22]}


def test_model_responses_in_batches_tell_why(spark):
    prompts = spark.createDataFrame([(i, f"p{i}") for i in range(7)], "query_id long, prompt string").coalesce(1)

    def load():
        def model(texts):
            if "p3" in texts:
                raise ValueError("not this one")
            return [t.upper() for t in texts]

        return model

    got = {r.query_id: (r.response, r.error) for r in model_responses(prompts, load, batched=True).collect()}
    assert got == {i: (None, "ValueError: not this one") if i == 3 else (f"P{i}", None) for i in range(7)}
    one = model_responses(prompts, lambda: lambda t: load()([t])[0]).collect()
    assert {r.query_id: (r.response, r.error) for r in one} == got
