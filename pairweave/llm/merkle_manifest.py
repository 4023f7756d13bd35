"""Merkle manifest of a dataset: levels kept as one hex string per aligned block of leaves.

A block holds up to 16**3 consecutive nodes of a group and three levels above
them, each as the concatenation of its 64-digit digests. Parents hash fixed-width
substrings of such a string, and the siblings of a node are the substrings to
its left and right. The tops of the blocks are the nodes of the next round, until
a group has one node left; the groups' roots then form a tree of their own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.operators.ordering import global_index
from pairweave.session import materialize

FAN = 16  # children of a node
DIGITS = 64  # hex digits of a digest
LEVELS = 3  # levels that a block reduces
BLOCK = FAN**LEVELS
BROADCAST_GROUPS = 100_000  # groups whose sizes are sent to the tasks; more are joined

PATH = "array<struct<left:binary,right:binary>>"


def digest(value: Column) -> Column:
    """Lower-case hex SHA-256, as 64 bytes of text: substrings of bytes are cut in place."""
    return F.sha2(value, 256).cast("binary")


def field(value: Column) -> Column:
    """``-`` for null, else the length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: Sequence[Column]) -> Column:
    return F.sha2(F.concat(*[field(v) for v in values]), 256)


def _parents(level: Column) -> Column:
    runs = F.floor((F.length(level) - 1) / (FAN * DIGITS)).cast("int")
    hashed = F.transform(
        F.sequence(F.lit(0), runs),
        lambda r: F.sha2(F.substring(level, r * (FAN * DIGITS) + 1, F.lit(FAN * DIGITS)), 256),
    )
    return F.array_join(hashed, "").cast("binary")


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """``grp, block, total, depth, members, level0.., top`` from ``grp, pos, total, node`` (a digest as 32 bytes).

    ``members`` keeps the columns ``more`` in order of position; a block's rows
    are bounded by ``BLOCK``, whatever the size of its group.
    """
    kept = F.sort_array(F.collect_list(F.struct("pos", "node", *more)))
    grouped = nodes.groupBy("grp", F.expr(f"pos div {BLOCK}").alias("block")).agg(
        F.first("total").alias("total"), kept.alias("members")
    )
    # a group of more than one block reduces all of its blocks by LEVELS, the last one too
    depth = sum((F.when(F.col("total") > FAN**k, 1).otherwise(0) for k in range(LEVELS)), F.lit(0))
    joined = F.array_join(F.transform("members", lambda m: F.lower(F.hex(m["node"]))), "").cast("binary")
    with_leaves = grouped.select("grp", "block", "total", depth.alias("depth"), "members", joined.alias("level0"))
    level = with_leaves
    for k in range(LEVELS):
        up = F.when(F.col("depth") > k, _parents(F.col(f"level{k}")))
        level = level.withColumn(f"level{k + 1}", up)
    top = F.coalesce(*[F.col(f"level{k}") for k in range(LEVELS, -1, -1)])
    slim = F.transform("members", lambda m: F.struct(*[m[c].alias(c) for c in more])) if more else F.lit(None)
    return level.select("grp", "block", "total", "depth", slim.alias("members"), *_levels(), top.alias("top"))


def _levels() -> list[str]:
    return [f"level{k}" for k in range(LEVELS)]


def _siblings(place: Column) -> Column:
    """Left and right flank of a member of a block on each level that the block reduces."""
    pairs = []
    for k in range(LEVELS):
        at = F.shiftright(place, 4 * k)
        inside = at.bitwiseAND(F.lit(FAN - 1))
        level = F.col(f"level{k}")
        left = F.substring(level, (at - inside) * DIGITS + 1, inside * DIGITS)
        right = F.substring(level, (at + 1) * DIGITS + 1, (F.lit(FAN - 1) - inside) * DIGITS)
        pairs.append(F.struct(left.alias("left"), right.alias("right")))
    return F.slice(F.array(*pairs), F.lit(1), F.col("depth"))


def _rise(nodes: DataFrame, name: str, *more: str) -> list[DataFrame]:
    """Written block tables, round by round, until every group has one block."""
    rounds = [materialize(_blocks(nodes, *more), name)]
    while rounds[-1].where(F.col("total") > BLOCK).limit(1).count():
        tops = rounds[-1].where(F.col("total") > BLOCK).select(
            "grp",
            F.col("block").alias("pos"),
            F.ceil(F.col("total") / BLOCK).cast("long").alias("total"),
            F.unhex(F.col("top").cast("string")).alias("node"),
        )
        rounds.append(materialize(_blocks(tops), name))
    return rounds


def _tops(rounds: list[DataFrame]) -> DataFrame:
    """``grp, top``: the last node of each group, from the round in which it had one block."""
    last = [r.where(F.col("total") <= BLOCK).select("grp", "top") for r in rounds]
    out = last[0]
    for more in last[1:]:
        out = out.unionByName(more)
    return out


def _fall(rounds: list[DataFrame], crown: DataFrame, carried: Sequence[str]) -> DataFrame:
    """``grp, block, path, *carried`` for the blocks of the first round.

    ``crown`` has ``grp, path, *carried`` for each group: what lies above its last
    node. Each round hands its path and its own siblings down to the blocks below.
    """
    below: DataFrame | None = None
    for table in reversed(rounds):
        single = table.where(F.col("total") <= BLOCK).select("grp", "block").join(crown, "grp")
        above = single.select("grp", "block", "path", *carried)
        if below is not None:
            above = above.unionByName(below)
        if table is rounds[0]:
            return above
        sized = table.withColumn("n", F.expr(f"length(level0) div {DIGITS}").cast("int")).join(above, ["grp", "block"])
        placed = sized.select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("place"))
        below = placed.select(
            "grp",
            (F.col("block") * BLOCK + F.col("place")).alias("block"),
            F.concat(_siblings(F.col("place")), F.col("path")).alias("path"),
            *carried,
        )
    raise ValueError("no rounds")


def _placed(nodes: DataFrame, order: Column, carried: Sequence[str]) -> DataFrame:
    """Add ``pos`` and ``total``: place of each row inside its group ``grp`` and the group's size."""
    indexed = global_index(nodes.select(*carried, "grp", order.alias("order")), "order", "at")
    groups = materialize(
        indexed.groupBy("grp").agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("total")), "merkle-groups"
    )
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    joined = indexed.join(groups, "grp")
    return joined.select(*carried, "grp", (F.col("at") - F.col("first")).alias("pos"), "total")


def verified_manifest(
    docs: DataFrame,
    tampered: Column | None = None,
    altered: Column | None = None,
    id: str = "doc_id",
    source: str = "source",
    values: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"),
    text: str = "text",
) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: one row per document.

    A leaf is the digest of ``values``. The leaves of a source, ordered by id,
    form its tree of fan-out 16; the roots of the sources, ordered by source, form
    the tree of the whole. ``folded_root`` is computed from the leaf and its
    siblings alone: where ``tampered`` is true, from the leaf of a row whose
    ``text`` reads ``altered``.

    Null values have a mark of their own in a leaf. Null ids come first in their
    source, null sources form a group of their own that comes first, equal ids
    are ordered by their leaf; equal rows give equal leaves and one result row
    each, whose proofs differ by their place. A null condition does not tamper.
    Texts of any length are hashed where they are read; only digests are
    shuffled. A hot source is cut into blocks of 4096 leaves by position, and its
    order comes from a range shuffle on source and id, so no task holds more than
    its range. An empty table gives an empty result; other columns are ignored.
    """
    cols = [F.col(v) for v in values]
    leaf = leaf_digest(cols)
    tamper = F.coalesce(tampered, F.lit(False)) if tampered is not None else F.lit(False)
    other = leaf_digest([altered if v == text and altered is not None else F.col(v) for v in values])
    hashed = docs.select(
        F.struct(F.col(source).cast("string").alias("source")).alias("grp"),
        F.col(id).cast("long").alias("id"),
        F.unhex(leaf).alias("node"),
        F.when(tamper, F.unhex(other)).alias("other"),
    )
    leaves = materialize(hashed, "merkle-leaves")
    order = F.struct(F.col("grp.source").alias("source"), "id", "node")
    placed = _placed(leaves, order, ["id", "node", "other"])
    rounds = _rise(placed, "merkle-blocks", "id", "other")

    subroots = materialize(
        _tops(rounds).select(F.col("grp").alias("of"), F.unhex(F.col("top").cast("string")).alias("node")), "merkle-subroots"
    )
    whole = F.struct(F.lit(None).cast("string").alias("source"))
    ranked = _placed(subroots.withColumn("grp", whole), F.col("of"), ["of", "node"])
    upper = _rise(ranked, "merkle-roots", "of")
    none = F.array().cast(PATH)
    summit = _tops(upper).select("grp", none.alias("path"), F.col("top").cast("string").alias("root"))
    over = upper[0].join(_fall(upper, summit, ["root"]), ["grp", "block"])
    crown = over.select("depth", *_levels(), "path", "root", F.posexplode("members").alias("place", "m")).select(
        F.col("m.of").alias("grp"),
        F.concat(_siblings(F.col("place")), F.col("path")).alias("path"),
        F.substring("level0", F.col("place") * DIGITS + 1, F.lit(DIGITS)).cast("string").alias("subroot"),
        "root",
    )
    crown = materialize(crown, "merkle-crown")

    above = _fall(rounds, crown, ["subroot", "root"])
    each = (
        rounds[0]
        .join(above, ["grp", "block"])
        .select("depth", *_levels(), "path", "subroot", "root", F.posexplode("members").alias("place", "m"))
    )
    own = F.substring("level0", F.col("place") * DIGITS + 1, F.lit(DIGITS))
    each = each.select(
        F.col("m.id").alias("id"),
        own.alias("leaf"),
        F.coalesce(F.lower(F.hex("m.other")).cast("binary"), own).alias("start"),
        "subroot",
        "root",
        F.concat(_siblings(F.col("place")), F.col("path")).alias("path"),
    )
    proof = F.aggregate("path", F.lit(b""), lambda acc, p: F.concat(acc, p["left"], p["right"]))
    folded = F.aggregate("path", F.col("start"), lambda acc, p: digest(F.concat(p["left"], acc, p["right"])))
    found = each.select(
        F.col("id").alias(id),
        F.col("leaf").cast("string").alias("leaf"),
        "subroot",
        "root",
        F.sha2(proof, 256).alias("proof_sha256"),
        folded.cast("string").alias("folded_root"),
    )
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
