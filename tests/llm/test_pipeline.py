import random
import re

import pytest

import corpus_pipeline as cp
from pairweave.llm import toxicity as tx
from pairweave.llm.queries import public_tokenizer
from tests.llm.test_decontaminate import plain_score, split
from tests.llm.test_minmax_dedup import plain


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    vocabulary = [a + b for a in ("ka", "lo", "mi", "nu", "re", "to") for b in ("ba", "de", "fi", "gu", "so", "x")]
    docs, labels = [], []
    for i in range(240):
        text = [rng.choice(vocabulary) for _ in range(rng.randrange(8, 90))]
        if i % 6 == 1:
            text[rng.randrange(len(text))] = "vile" + rng.choice(["x", "ly", "ness"])
        labels.append((i, 1, int(i % 6 == 1)))
        docs.append((i, " ".join(text), f"s{i % 3}" if i % 7 else None))
    for i in range(240, 280):  # copies, exact and near
        text = docs[rng.randrange(200)][1].split()
        if i % 2 and len(text) > 60:
            text[-1] = "changed"
        docs.append((i, " ".join(text), "s0"))
    items = [(0, " ".join(rng.choice(vocabulary) for _ in range(20))), (1, None)]
    docs += [(300, f"before {items[0][1]} after", "s1"), (301, None, "s1"), (302, "", None), (303, "x " * 4000, "s2")]
    docs += [(None, "no id here " * 5, "s1"), (None, None, None), (5, docs[5][1], "s1")]
    root = str(tmp_path_factory.mktemp("tables"))
    rows = [(i, t, "en", s, 0, "clash") for i, t, s in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string").repartition(
        5
    ).write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return root, docs, items


def ids(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_stages_against_plain_versions(spark, tables):
    root, rows, items = tables
    docs = spark.read.parquet(f"{root}/documents.parquet")
    model = tx.fit(docs, spark.read.parquet(f"{root}/labels.parquet"))
    scores = {(r.doc_id, r.text): r[tx.SCORE] for r in tx.with_toxicity(docs, model).collect()}

    one = cp.toxicity(spark, docs, root)
    assert one.columns == docs.columns
    want = sorted([(i, t) for i, t, _ in rows if scores[(i, t)] < 0.5], key=repr)
    assert ids(one) == want

    two = cp.near_duplicates(spark, one, root)
    component = plain([r for r in want if r[0] is not None], 5, 80)
    named = sorted({i for i, c in component.items() if i == c})
    got = ids(two)
    assert sorted(i for i, _ in got if i is not None) == named
    assert all(r in want for r in got)
    assert [r for r in got if r[0] is None] == [r for r in want if r[0] is None]

    three = cp.decontamination(spark, two, root)
    item = split(items[0][1])
    assert ids(three) == [r for r in got if plain_score(item, split(r[1])) < 0.5 * len(item)]
    assert three.columns == docs.columns

    four = cp.mixing(spark, three, root)
    before, after = ids(three), ids(four)
    assert set(after) <= set(before) and max(map(after.count, after)) <= 2
    assert all(re.search(r"\S", t or "") for _, t in after)
    size = sum(len((t or "").split()) for _, t in before)
    assert 0.9 * size < sum(len(t.split()) for _, t in after) <= 2 * size
    assert ids(cp.mixing(spark, three, root)) == after

    five = sorted(cp.tokens(spark, four, root).collect(), key=lambda r: r.start)
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizer())
    order = sorted(after, key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert [r.doc_id for r in five] == [i for i, _ in order]
    assert [r.n_tokens for r in five] == [len(tokenizer.encode(t).ids) + 1 for _, t in order]


def test_run_is_its_stages(spark, tables):
    root = tables[0]
    docs = spark.read.parquet(f"{root}/documents.parquet")
    for _, stage in cp.STAGES:
        docs = stage(spark, docs, root)
    assert sorted(map(tuple, cp.run(spark, root).collect()), key=repr) == sorted(map(tuple, docs.collect()), key=repr)


def test_empty_documents(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables[0]}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert cp.run(spark, str(tmp_path)).collect() == []
