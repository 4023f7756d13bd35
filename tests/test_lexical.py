"""BM25 retrieval beside the formula over all pairs."""

import math
import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest

from pairweave.operators import lexical
from pairweave.operators.lexical import build_lexical_index, lexical_rerank, lexical_scores, lexical_topk
from pairweave.session import materialize

TEXTS = {1: "a b c", 2: "a a b", 3: "the the the a", 4: "", 5: None, 6: "the c d e", 7: "c b a", 8: "é  the\tx"}


def plain(texts, query, skip=None):
    cut = {i: (t or "").split() for i, t in texts.items()}
    mean = sum(map(len, cut.values())) / len(cut)
    out = {}
    for i, words in cut.items():
        score = 0.0
        for q in query.split():
            df, tf = sum(q in w for w in cut.values()), words.count(q)
            if tf:
                score += math.log(1 + (len(cut) - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words) / mean))
        if score and i != skip:
            out[i] = round(score, 9)
    return sorted(out.items(), key=lambda x: (-x[1], x[0]))


def frame(spark, texts, name="doc_id"):
    return spark.createDataFrame(list(texts.items()), f"{name} long, text string").repartition(3)


def hits_of(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.item_id, r.similarity))
    return out


@pytest.mark.parametrize("block", [2, 1 << 16])
def test_small(spark, block):
    index = build_lexical_index(frame(spark, TEXTS), block_postings=block)
    queries = {1: "a", 2: "the a a", 3: "c e x", 4: "unknown", 5: "", 6: None}
    got = hits_of(lexical_topk(frame(spark, queries, "query_id"), index, 3))
    want = {i: plain(TEXTS, q)[:3] for i, q in queries.items() if q and plain(TEXTS, q)}
    assert {i: [x for x, _ in v] for i, v in got.items()} == {i: [x for x, _ in v] for i, v in want.items()}
    for i, v in got.items():
        assert [s for _, s in v] == pytest.approx([s for _, s in want[i]])


@pytest.mark.parametrize("lead", [1, 4])
def test_bounds_lose_nothing(spark, lead):
    rng = random.Random(lead)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    texts = {i: " ".join(rng.choices(vocabulary, weights, k=rng.randrange(1, 40))) for i in range(150)}
    index = build_lexical_index(frame(spark, texts), block_postings=16)
    asked = {i: texts[i] for i in range(0, 150, 7)}
    got = hits_of(lexical_topk(frame(spark, asked, "query_id"), index, 5, exclude_self=True, lead_terms=lead))
    for i, text in asked.items():
        want = plain(texts, text, i)[:5]
        assert [x for x, _ in got[i]] == [x for x, _ in want]
        assert [s for _, s in got[i]] == pytest.approx([s for _, s in want])


def test_given_pairs_and_rerank(spark):
    index = build_lexical_index(frame(spark, TEXTS))
    queries = frame(spark, {1: "a b", 2: "zzz"}, "query_id")
    hits = [(1, 1, 3, 0.9), (1, 2, 7, 0.8), (1, 3, 2, 0.7), (1, 4, 4, 0.6), (2, 1, 6, 0.5), (2, 2, 1, 0.4)]
    df = spark.createDataFrame(hits, "query_id long, rank int, item_id long, similarity double")
    scores = {(r.query_id, r.item_id): r.score for r in lexical_scores(df, queries, index).collect()}
    whole = dict(plain(TEXTS, "a b"))
    assert scores == pytest.approx({(1, 3): whole[3], (1, 7): whole[7], (1, 2): whole[2], (1, 4): 0, (2, 6): 0, (2, 1): 0})
    got = sorted((r.query_id, r["rank"], r.old_rank, r.item_id, r.similarity) for r in lexical_rerank(df, queries, index, 2).collect())
    order = sorted([3, 7, 2], key=lambda i: -whole[i])[:2]
    place = {h[2]: (h[1], h[3]) for h in hits if h[0] == 1}
    assert got == [(1, r + 1, place[i][0], i, place[i][1]) for r, i in enumerate(order)] + [(2, 1, 1, 6, 0.5), (2, 2, 2, 1, 0.4)]


def test_empty(spark):
    index = build_lexical_index(spark.createDataFrame([], "doc_id long, text string"))
    assert lexical_topk(frame(spark, {1: "a"}, "query_id"), index, 3).count() == 0


def test_pairs_are_never_stored(spark, monkeypatch):
    """a table that a search stores grows with the terms asked for, not with the texts that hold them."""
    stored = {}

    def counting(df, name):
        table = materialize(df, name)
        stored[name] = table.count()
        return table

    texts = {i: " ".join(f"w{j}" for j in range(12) if (i >> j % 4) & 1 or j > 7) for i in range(400)}
    index = build_lexical_index(frame(spark, texts))
    monkeypatch.setattr(lexical, "materialize", counting)
    asked = {i: texts[i] for i in range(0, 400, 20)}
    got = hits_of(lexical_topk(frame(spark, asked, "query_id"), index, 5, exclude_self=True))
    assert all([x for x, _ in got[i]] == [x for x, _ in plain(texts, t, i)[:5]] for i, t in asked.items())
    assert max(stored.values()) <= sum(len(set(t.split())) for t in asked.values())


@pytest.mark.parametrize("common, short", [(12, 200), (1e-9, 0), (1e-9, 2), (3, 1)])
@pytest.mark.parametrize("block", [1, 40, 10_000])
def test_every_way_through_a_block(monkeypatch, common, short, block):
    """The table of common terms, terms added at once and terms left to the bound give the scores of plain sums."""
    monkeypatch.setattr(lexical, "COMMON", common)
    monkeypatch.setattr(lexical, "SHORT", short)
    monkeypatch.setattr(lexical, "SCORES_AT_ONCE", 300)
    rng = random.Random(block)
    weights = [1 / (i + 1) for i in range(30)]
    held = {i: {t: rng.randrange(1, 9) / 4 for t in rng.choices(range(30), weights, k=rng.randrange(0, 12))} for i in range(90)}
    asked = {i: {t: 1.0 + t / 8 for t in held[i]} for i in range(0, 90, 7) if held[i]}
    rows = [(i, list(h), list(h.values())) for i, h in held.items()]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.list_(pa.int64())), pa.array([r[2] for r in rows], pa.list_(pa.float64()))],
        ["item_id", "numbers", "gains"],
    )
    terms = [t for q in asked.values() for t in sorted(q, reverse=True)]
    vocabulary, local = np.unique(terms, return_inverse=True)
    sent = (vocabulary, np.array(list(asked)), np.r_[0, np.cumsum([len(q) for q in asked.values()])], local, np.array([1.0 + t / 8 for t in terms]))
    got = {}
    for out in lexical.block_search(SimpleNamespace(value=sent), 4, True, 1, block)(iter([batch.slice(0, 50), batch.slice(50)])):
        for q, item, score in zip(*(c.to_pylist() for c in out.columns)):
            got.setdefault(q, []).append((item, score))
    for q, query in asked.items():
        whole = {i: round(sum(w * h[t] for t, w in query.items() if t in h), 9) for i, h in held.items() if i != q}
        assert got.get(q, []) == sorted([(i, s) for i, s in whole.items() if s], key=lambda x: (-x[1], x[0]))[:4]


def test_rows_of_one_id_are_one_text(spark):
    rows = [(1, "a b"), (1, "a c c"), (2, "a b"), (3, "c"), (None, "a b")]
    index = build_lexical_index(spark.createDataFrame(rows, "doc_id long, text string"), block_postings=1)
    got = hits_of(lexical_topk(frame(spark, {2: "a b"}, "query_id"), index, 3, exclude_self=True))
    gain = 2.2 / (1 + 1.2 * (0.25 + 0.75 * 5 / 2))
    weigh = lambda df: math.log(1 + (5 - df + 0.5) / (df + 0.5))
    assert got == {2: [(1, pytest.approx(2 * weigh(4) * gain + weigh(3) * gain))]}


def test_given_pairs_are_found_once_and_meet_in_one_row(spark, monkeypatch):
    """a costly first stage runs once, and a pair is scored from one row whatever its query's terms."""
    runs = spark.sparkContext.accumulator(0)
    met = spark.sparkContext.accumulator(0)
    scorer = lexical.pair_scores

    def seen(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    def counted(batches, texts):
        def rows():
            for batch in batches:
                met.add(batch.num_rows)
                yield batch

        return scorer(rows(), texts)

    monkeypatch.setattr(lexical, "pair_scores", counted)
    index = build_lexical_index(frame(spark, TEXTS))
    pairs = spark.createDataFrame([(1, 3), (1, 7), (1, 2), (1, 4)], "query_id long, item_id long").mapInArrow(seen, "query_id long, item_id long")
    got = {r.item_id: r.score for r in lexical_scores(pairs, frame(spark, {1: "a b a the"}, "query_id"), index).collect()}
    whole = dict(plain(TEXTS, "a b a the"))
    assert got == pytest.approx({3: whole[3], 7: whole[7], 2: whole[2], 4: 0})
    assert runs.value == 4
    assert met.value == 4


def test_repeated_terms_of_a_pair():
    """A query's and a text's terms may repeat in their lists; each meeting counts."""
    lists = lambda values, kind: pa.array([values], pa.list_(kind))
    batch = pa.RecordBatch.from_arrays(
        [pa.array([1]), pa.array([2]), lists([5, 9, 5], pa.int64()), lists([2, 1, 2], pa.int32()), lists([1, 1, 3], pa.int32()),
         lists([5, 7, 5], pa.int64()), lists([0.5, 1.0, 0.25], pa.float64())],
        ["query_id", "item_id", "number", "df", "n", "numbers", "gains"],
    )
    got = [out.column(2).to_pylist() for out in lexical.pair_scores(iter([batch]), 10)]
    assert got == [[pytest.approx(4 * math.log(1 + 8.5 / 2.5) * 0.75, abs=1e-9)]]


@pytest.mark.parametrize("head", [0, 2, 5, 1 << 20])
def test_frequent_terms_are_broadcast_and_others_joined(spark, monkeypatch, head):
    """wherever the line between frequent and rare terms is, pairs have the plain scores; ids may repeat."""
    monkeypatch.setattr(lexical, "HEAD_TERMS", head)
    index = build_lexical_index(frame(spark, TEXTS))
    asked = {1: "a b a the nowhere", 2: "x é d", 3: "", 4: None}
    queries = frame(spark, asked, "query_id").union(frame(spark, {2: "the x"}, "query_id"))
    pairs = spark.createDataFrame([(q, i) for q in asked for i in TEXTS if i != 6], "query_id long, item_id long")
    got = {(r.query_id, r.item_id): r.score for r in lexical_scores(pairs, queries, index).collect()}
    whole = {q: dict(plain(TEXTS, t or "")) for q, t in (asked | {2: "x é d the x"}).items()}
    assert got == pytest.approx({(q, i): whole[q].get(i, 0) for q in asked for i in TEXTS if i != 6})


def test_words_are_counted_by_run_and_only_named_texts_leave_their_place(spark, monkeypatch):
    """a term is no row per text that holds it, neither of the index nor of the queries."""
    stored = []

    def kept(df, name):
        stored.append((name, materialize(df, name)))
        return stored[-1][1]

    monkeypatch.setattr(lexical, "materialize", kept)
    texts = {i: " ".join(f"w{j}" for j in range(12) if (i >> j % 4) & 1 or j > 7) for i in range(400)}
    index = build_lexical_index(frame(spark, texts).repartition(3))
    pairs = spark.createDataFrame([(1, 3), (1, 7)], "query_id long, item_id long")
    scores = lexical_scores(pairs, frame(spark, texts, "query_id").where("query_id < 200"), index)
    assert {r.item_id: r.score for r in scores.collect()} == pytest.approx({i: dict(plain(texts, texts[1]))[i] for i in (3, 7)})
    for name in ("counted", "asked"):
        table = next(t for n, t in stored if n == name)
        words = table.where("length is null").selectExpr("sum(size(numbers))").first()[0]
        assert words <= 12 * 8 < table.where("length is not null").selectExpr("sum(size(numbers))").first()[0] / 10
    assert "LeftSemi" in scores._jdf.queryExecution().optimizedPlan().toString()


def test_words_of_one_number_are_told_apart(spark, monkeypatch):
    """Terms that share a number get others; a query's word outside the index that shares one counts nothing."""
    plainly = lexical.digests_of

    def alike(words, seed, name):
        same = {"a": "b", "unknown": "c"} if name == "n" and seed == 0 else {"unknown": "c"} if name == "n" else {}
        return plainly(np.array([same.get(w, w) for w in words], object), seed, name)

    monkeypatch.setattr(lexical, "digests_of", alike)
    index = build_lexical_index(frame(spark, TEXTS))
    assert index.seed == 1
    asked = {1: "a unknown", 2: "unknown"}
    pairs = spark.createDataFrame([(q, i) for q in asked for i in (1, 3, 7)], "query_id long, item_id long")
    got = {(r.query_id, r.item_id): r.score for r in lexical_scores(pairs, frame(spark, asked, "query_id"), index).collect()}
    whole = dict(plain(TEXTS, "a"))
    assert got == pytest.approx({(q, i): whole[i] if q == 1 else 0 for q in asked for i in (1, 3, 7)})
    assert hits_of(lexical_topk(frame(spark, {2: "unknown"}, "query_id"), index, 3)) == {}


def test_texts_are_cut_in_runs(monkeypatch):
    """Runs of bounded bytes lose no text, and blanks are those of BLANKS."""
    monkeypatch.setattr(lexical, "BYTES_AT_ONCE", 4)
    texts = ["a\x0bb\0c\x1cd a", None, "", "x　y x", "\t\n"]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5)), pa.array(texts)], ["item_id", "text"])
    out = [dict(zip(b.schema.names, (c.to_pylist() for c in b.columns))) for b in lexical.term_lists(0)(iter([batch.slice(0, 2), batch.slice(2)]))]
    rows = [r for b in out for r in zip(b["item_id"], b["numbers"], b["counts"], b["length"]) if r[3] is not None]
    assert [(i, sorted(c), n) for i, _, c, n in rows] == [(0, [1, 1, 2], 4), (1, [], 0), (2, [], 0), (3, [1, 1], 2), (4, [], 0)]
    assert all(numbers == sorted(numbers) for _, numbers, _, _ in rows)
