"""Merkle manifest beside a plain version that folds lists of digests."""

import hashlib

import pytest
from pyspark.sql import functions as F

from pairweave.llm import merkle_manifest
from pairweave.llm.merkle_manifest import verified_manifest

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        now = levels[-1]
        levels.append([h("".join(now[i : i + 16])) for i in range(0, len(now), 16)])
    return levels


def sides(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(nodes[run:at]), "".join(nodes[at + 1 : run + 16])))
        at //= 16
    return out


def plain(rows, tampered, altered):
    by = {}
    for row in rows:
        by.setdefault(row[1], []).append(row)
    trees = {}
    for source, own in by.items():
        own.sort(key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), leaf(r)))
        trees[source] = tree([leaf(r) for r in own])
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, source in enumerate(order):
        for at, row in enumerate(by[source]):
            path = sides(trees[source], at) + sides(top, k)
            start = leaf(row[:4] + (altered(row[4]),)) if tampered(row) else leaf(row)
            fold = start
            for left, right in path:
                fold = h(left + fold + right)
            root = top[-1][0]
            out.append((row[0], leaf(row), trees[source][-1][0], root, h("".join(x + y for x, y in path)), fold, fold == root))
    return sorted(out, key=repr)


def check(spark, rows):
    docs = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA + ", leaf string").repartition(3)
    got = verified_manifest(docs, F.col("doc_id") % 5 == 0, F.upper("text"))
    found = sorted((tuple(r) for r in got.collect()), key=repr)
    assert found == plain(rows, lambda r: r[0] is not None and r[0] % 5 == 0, lambda t: None if t is None else t.upper())
    return got


@pytest.mark.parametrize("sizes", [(1,), (17, 16, 2), (257, 16, 1)])
def test_small_trees(spark, sizes):
    rows = [(i * 7 + s, f"s{s}", "en", i, f"text {i}") for s, n in enumerate(sizes) for i in range(n)]
    check(spark, rows)


def test_several_rounds_and_many_sources(spark):
    rows = [(i, "hot", None, i, f"t{i}") for i in range(merkle_manifest.BLOCK + 3)]
    rows += [(i, f"source {i % 300}", "de", None, None if i % 7 else "") for i in range(900)]
    check(spark, rows)


@pytest.mark.parametrize("levels", [2])
def test_more_rounds_with_small_blocks(spark, monkeypatch, levels):
    monkeypatch.setattr(merkle_manifest, "LEVELS", levels)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 16**levels)
    check(spark, [(i, f"s{i % 3 if i % 50 == 0 else 0}", "en", i, f"T{i}") for i in range(600)])
    check(spark, [(i, f"s{i}", "en", i, f"T{i}") for i in range(290)])


def test_nulls_ties_repeats_and_other_letters(spark):
    rows = [
        (None, None, None, None, None),
        (None, None, None, None, "A"),
        (None, "é", "en", 1, "x" * 100_000),
        (5, "z", "en", 1, "ÄB c"),
        (5, "z", "en", 1, "ÄB c"),
        (5, "z", "en", 2, None),
        (-10, "z", "en", -3, "lower"),
        (3, "", "fr", 0, ""),
        (4, "\U0001f600", "fr", 0, "-"),
        (4, "\uffff", "fr", 0, "1:a"),
    ]
    check(spark, rows)


def test_fields_cannot_run_into_each_other(spark):
    a = spark.createDataFrame([(1, "a", "b", 1, "x")], SCHEMA)
    b = spark.createDataFrame([(1, "ab", "", 1, "x")], SCHEMA)
    assert verified_manifest(a).first().leaf != verified_manifest(b).first().leaf


def test_empty_table(spark):
    got = verified_manifest(spark.createDataFrame([], SCHEMA))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert got.count() == 0
