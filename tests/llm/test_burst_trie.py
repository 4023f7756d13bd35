"""Burst trie beside a plain version that counts every prefix."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from pairweave.llm.burst_trie import common_turns, conversation_trie, paths_of, prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256".split()


def plain(rows, share=True):
    convs = {}
    for c, t, r, x in rows:
        if c is not None:
            convs.setdefault(c, []).append(((0, 0) if t is None else (1, t), r or "", x or ""))
    own = {c: [(r, x) for _, r, x in sorted(v)] for c, v in convs.items()}
    full = {}
    for c, turns in own.items():
        n = zlib.crc32(str(c).encode()) % 6 if share else 0
        base = int(c - (abs(c) % 100) * (1 if c >= 0 else -1))
        full[c] = tuple(own.get(base, [])[:n] + turns[n:])
    members = {}
    for c, path in full.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    out = []
    for p, m in members.items():
        below = [q for q in members if q[: len(p)] == p]
        kids = [q for q in below if len(q) == len(p) + 1]
        leaves = [q for q in below if not any(len(o) == len(q) + 1 and o[: len(q)] == q for o in below)]
        saved = sum((len(members[q]) - 1) * (len(q[-1][1]) if q else 0) for q in below)
        ends = ",".join(str(c) for c in sorted(m) if full[c] == p)
        up = min(members[p[:-1]]) if p else None
        out.append((min(m), len(p), up, len(m), len(kids), len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def found(df):
    assert set(df.columns) == set(COLUMNS)
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def random_rows(seed, n, turns=4, words=2):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        c = c * rng.choice([1, 1, 7])
        for t in range(rng.randrange(0, turns)):
            rows.append((c, t, "user", rng.choice(["é", "bb", "", "dddd"][:words])))
    return list({(c, t): (c, t, r, x) for c, t, r, x in rows}.values())


@pytest.mark.parametrize("least_rows", [1, 2, 5, 512])
def test_bursts_do_not_change_the_trie(spark, least_rows):
    rows = random_rows(least_rows, 120, turns=6)
    paths = paths_of(spark.createDataFrame(rows, SCHEMA).repartition(4))
    assert found(prefix_trie(paths, least_rows)) == plain(rows, share=False)


@pytest.mark.parametrize("least_rows", [1, 3])
def test_long_common_runs_burst_at_once(spark, least_rows):
    rows = [(c, t, "user", f"shared {t}") for c in range(12) for t in range(30)]
    rows += [(c, 30, "user", f"own {c % 5}") for c in range(10)] + [(c, 31, "user", "x") for c in range(4)]
    paths = paths_of(spark.createDataFrame(rows, SCHEMA))
    assert found(prefix_trie(paths, least_rows)) == plain(rows, share=False)


def test_rebuilt_on_a_base(spark):
    rows = random_rows(9, 330, turns=9, words=4)
    rows += [(-205, 1, "user", "a"), (-200, 0, "user", "b"), (-200, None, None, None), (7_000_105, 0, "user", "alone")]
    turns = spark.createDataFrame([(*r, 1) for r in rows], SCHEMA + ", path int").repartition(5)
    base = F.col("conv_id") - F.col("conv_id") % 100
    shared = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 6).cast("int")
    assert found(conversation_trie(turns, base, shared)) == plain(rows)


def test_copies_in_great_number_and_id_order(spark):
    rows = [(c, 0, "user", "same") for c in range(-3000, 3000)] + [(c, 1, "user", "more") for c in range(-3000, 3000, 2)]
    paths = paths_of(spark.createDataFrame(rows, SCHEMA).repartition(4))
    for least_rows in (1, 512):
        assert found(prefix_trie(paths, least_rows)) == plain(rows, share=False)


def test_nulls_repeats_and_long_texts(spark):
    rows = [
        (None, 1, "user", "no conversation"),
        (1, None, "user", "first"),
        (1, 2, None, None),
        (1, 2, "", ""),
        (2, None, "user", "first"),
        (2, 2, "", "x" * 200_000),
        (3, 0, "user", "ab"),
        (4, 0, "userab", ""),
    ]
    got = found(prefix_trie(paths_of(spark.createDataFrame(rows, SCHEMA))))
    assert got == plain(rows, share=False)
    assert found(conversation_trie(spark.createDataFrame([], SCHEMA))) == []


def test_turnless_conversations_are_members(spark):
    base = F.col("conv_id") - F.col("conv_id") % 100
    turns = spark.createDataFrame([(101, 0, "user", "a"), (102, 0, "user", "b")], SCHEMA)
    got = found(conversation_trie(turns, base, F.lit(5)))
    assert got == [(101, 0, None, 2, 0, 1, 0, hashlib.sha256(b"101,102").hexdigest())]


def test_common_turns():
    a, b = bytes(20) + b"a" * 20, bytes(20) + b"b" * 20
    assert [common_turns(*x) for x in ((a, b), (a, a), (a, b""), (a, bytes(20)))] == [1, 2, 0, 1]
