"""Prefix trie of conversations, built as a burst trie.

A turn is a 20-byte id and a conversation its path, the ids in order, so that byte
order is trie order. All paths start in one container. A container of too many
rows bursts: its common prefix becomes a head of the trie and its paths part by
their next turn id. Containers that stay are sorted, and one sweep over the sorted
paths gives their nodes; what lies above them is the table of heads.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairweave.session import discard, materialize

TURN = 20  # bytes of a turn id: 16 of a SHA-256 over role and text, 4 of the text's length
BURST_ROWS = 512  # rows from which a container may burst
BURSTS = 2_000  # a round bursts at most so many containers, as each holds over 1 / BURSTS of the rows
ID_RANGE = 1_024  # ids of equal conversations are joined into one string per range of so many ids
CHUNK = 8_192  # nodes of an output batch

NODE = pa.schema(
    [("head", pa.int64()), ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64())]
    + [(c, pa.int64()) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")]
    + [("ends_sha256", pa.string()), ("kind", pa.string())]
)
NODE_DDL = (
    "head long, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, "
    "saved_tokens long, ends_sha256 string, kind string"
)
EMPTY = hashlib.sha256(b"").hexdigest()


def turn_id(role: Column, text: Column) -> Column:
    """40 hex digits that name a turn; its text's length in code points is their last eight."""
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.substring(F.sha2(whole, 256), 1, 32), F.lpad(F.hex(F.length(text)), 8, "0"))


def paths_of(
    turns: DataFrame, id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, path`` of each conversation; texts stay where they are read, only turn ids are shuffled."""
    r, t = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = turns.where(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.unhex(turn_id(r, t)).alias("id")).alias("at")
    )
    ids = F.transform(F.sort_array(F.collect_list("at")), lambda x: F.hex(x["id"]))
    return rows.groupBy("conv_id").agg(F.unhex(F.array_join(ids, "")).alias("path"))


def rebuilt(paths: DataFrame, base_of: Column, shared_turns: Column) -> DataFrame:
    """Each conversation's first turns replaced by those of its base.

    ``base_of`` and ``shared_turns`` are columns over ``conv_id``: the base's id and
    how many turns are taken from it (all if it has fewer, none if it is absent).
    Every conversation has at most one base; bases are joined on their id.
    """
    stored = materialize(paths.select("conv_id", "path", base_of.alias("base"), shared_turns.alias("h")), "conversations")
    wanted = stored.groupBy("base").agg(F.max("h").alias("most"))
    bases = stored.select(F.col("conv_id").alias("base"), F.col("path").alias("base_path")).join(wanted, "base")
    bases = bases.select("base", F.expr(f"substring(base_path, 1, {TURN} * most)").alias("start"))
    start = F.coalesce(F.expr(f"substring(start, 1, {TURN} * h)"), F.lit(b""))
    own = F.expr(f"substring(path, {TURN} * h + 1, length(path))")
    return stored.join(bases, "base", "left").select("conv_id", F.concat(start, own).alias("path"))


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths start with alike."""
    low, high = 0, min(len(a), len(b)) // TURN
    while low < high:
        mid = (low + high + 1) // 2
        if a[low * TURN : mid * TURN] == b[low * TURN : mid * TURN]:
            low = mid
        else:
            high = mid - 1
    return low


class _Node:
    __slots__ = ("depth", "tokens", "n", "first", "children", "leaves", "saved", "ends", "waiting")

    def __init__(self, depth: int, tokens: int):
        self.depth, self.tokens = depth, tokens
        self.n = self.children = self.leaves = self.saved = 0
        self.first: int | None = None
        self.ends = None  # running SHA-256 of the ids of conversations that end here
        self.waiting: list[int] = []  # rows of children whose parent's id is not known yet

    def meet(self, n: int, first: int) -> None:
        self.n += n
        self.first = first if self.first is None else min(self.first, first)


class Sweep:
    """Nodes of sorted paths: a stack holds the nodes of the present path only.

    A node is given out when the sweep leaves it, but for the id of its parent,
    which is known when the parent is left; such rows wait until their container
    ends, which a container of limited size keeps few.
    """

    def __init__(self) -> None:
        self.rows: list[list] = []
        self.done: list[list] = []
        self.stack: list[_Node] = []
        self.path, self.container, self.head = b"", None, None

    def _close(self) -> None:
        node = self.stack.pop()
        if not node.children:
            node.leaves = 1
        node.saved += (node.n - 1) * node.tokens
        for row in node.waiting:
            self.rows[row][3] = node.first
        ends = node.ends.hexdigest() if node.ends else EMPTY
        row = [self.head, node.first, node.depth, None, node.n, node.children, node.leaves, node.saved, ends, "node"]
        self.rows.append(row)
        if self.stack:
            up = self.stack[-1]
            up.children += 1
            up.leaves += node.leaves
            up.saved += node.saved
            up.meet(node.n, node.first)
            up.waiting.append(len(self.rows) - 1)
        else:
            row[9] = "top"

    def end(self) -> None:
        """Close the container: its top node becomes a child of its head, or the root."""
        while self.stack:
            self._close()
        self.done.extend(self.rows)
        self.rows = []

    def _push(self, path: bytes, depth: int) -> None:
        tokens = int.from_bytes(path[depth * TURN - 4 : depth * TURN], "big") if depth else 0
        self.stack.append(_Node(depth, tokens))

    def add(self, container: bytes, head: int | None, path: bytes, ended: bool, n: int, least: int, ids: str) -> None:
        if container != self.container:
            self.end()
            self.container, self.head, self.path = container, head, path
            first = len(path) // TURN if ended else len(container) // TURN
        else:
            shared = common_turns(self.path, path)
            while self.stack[-1].depth > shared:
                self._close()
            first, self.path = shared + 1, path
        for depth in range(first, len(path) // TURN + 1):
            self._push(path, depth)
        node = self.stack[-1]
        node.meet(n, least)
        node.ends = node.ends or hashlib.sha256()
        if node.n > n:
            node.ends.update(b",")
        node.ends.update(ids.encode())


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sweep = Sweep()

    def out(all_of_it: bool) -> Iterator[pa.RecordBatch]:
        while len(sweep.done) >= CHUNK or (all_of_it and sweep.done):
            part, sweep.done = sweep.done[:CHUNK], sweep.done[CHUNK:]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*part, strict=True), NODE.types, strict=True)], schema=NODE
            )

    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("container", "head", "path", "ended", "n", "least", "ids")]
        for row in zip(*columns, strict=True):
            sweep.add(*row)
        yield from out(False)
    sweep.end()
    yield from out(True)


def _burst(paths: DataFrame, least_rows: int) -> tuple[DataFrame, list[dict]]:
    """Rows with their ``container``, its ``head`` and whether they end in the head; and the heads.

    A round counts the rows of each container and bursts those above the limit.
    The least and the greatest path of a container share exactly what all of its
    paths share, so a head takes in the whole common run at once. The limit is
    1 / ``BURSTS`` of all rows at least, so the heads of a round are few at any size
    and are sent to the tasks; copies of one path never burst, as they do not part.
    """
    total = paths.count()
    limit = max(least_rows, total // BURSTS)
    heads: list[dict] = []
    rows = paths.select(
        "*", F.lit(b"").alias("container"), F.lit(None).cast("long").alias("head"), F.lit(False).alias("ended")
    )
    opened = rows
    stored: DataFrame | None = None
    while True:
        groups = opened.where(~F.col("ended")).groupBy("container").agg(
            F.count(F.lit(1)).alias("rows"), F.first("head").alias("head"), F.min("path").alias("low"), F.max("path").alias("high")
        )
        large = groups.where((F.col("rows") > limit) & (F.col("low") < F.col("high"))).collect()
        if not large:
            return rows, heads
        new = []
        for g in large:
            low, high = bytes(g["low"]), bytes(g["high"])
            branch = common_turns(low, high)
            head = {"id": len(heads), "up": g["head"], "top": len(g["container"]) // TURN, "path": low[: branch * TURN]}
            heads.append(head)
            new.append((bytearray(g["container"]), head["id"], branch))
        table = paths.sparkSession.createDataFrame(new, "container binary, new_head long, branch int")
        joined = rows.join(F.broadcast(table), "container", "left")
        here = F.col("branch").isNotNull() & ~F.col("ended")
        ends = here & (F.expr(f"length(path) div {TURN}") == F.col("branch"))
        child = F.expr(f"substring(path, 1, {TURN} * (branch + 1))")
        rows = joined.select(
            *paths.columns,
            # one byte more than a prefix can have: what ends in a head never meets a container
            F.when(ends, F.concat("path", F.lit(b"."))).when(here, child).otherwise(F.col("container")).alias("container"),
            F.when(here, F.col("new_head")).otherwise(F.col("head")).alias("head"),
            (F.col("ended") | ends).alias("ended"),
            here.alias("moved"),
        )
        rows, last = materialize(rows, "burst"), stored
        if last is not None:
            discard(last)
        stored = rows
        opened, rows = rows.where("moved"), rows.drop("moved")


def _heads_nodes(heads: list[dict], sums: dict[int, dict]) -> list[tuple]:
    """Rows of the nodes that heads stand for, from the sums of the containers below each head.

    Heads are few by construction. A head whose container had a longer common
    prefix stands for every node of that run; they have one child each.
    """
    none = {"n": 0, "first": None, "children": 0, "leaves": 0, "saved": 0, "ends": EMPTY}
    state = {h["id"]: dict(none, **sums.get(h["id"], {})) for h in heads}
    rows = []
    for h in reversed(heads):  # a head comes after the one above it
        s, path = state[h["id"]], h["path"]
        depth, chain = len(path) // TURN, []
        for d in range(depth, h["top"] - 1, -1):
            tokens = int.from_bytes(path[d * TURN - 4 : d * TURN], "big") if d else 0
            s["saved"] += (s["n"] - 1) * tokens
            at_branch = d == depth
            ends = s["ends"] if at_branch else EMPTY
            chain.append([s["first"], d, s["first"], s["n"], s["children"] if at_branch else 1, s["leaves"], s["saved"], ends])
        h["first"] = s["first"]
        rows.append((h, chain))
        if h["up"] is not None:
            up = state[h["up"]]
            up["n"] += s["n"]
            up["first"] = s["first"] if up["first"] is None else min(up["first"], s["first"])
            up["children"] += 1
            up["leaves"] += s["leaves"]
            up["saved"] += s["saved"]
    out = []
    for h, chain in rows:
        chain[-1][2] = None if h["up"] is None else heads[h["up"]]["first"]
        out.extend(map(tuple, chain))
    return out


def prefix_trie(paths: DataFrame, least_rows: int = BURST_ROWS) -> DataFrame:
    """One row per node of the trie over ``conv_id, path``.

    ``conv_id`` is the smallest member, ``depth`` its turns, ``parent_conv_id`` the
    parent's smallest member (null for the root), ``n_convs`` the members,
    ``n_children``, ``n_leaves`` (childless nodes of the subtree), ``saved_tokens``
    (over the subtree, members less one times the code points of the last text)
    and ``ends_sha256`` of the comma-joined ids of members that end there.

    Equal paths are put together before anything else, their ids joined per range
    of 1024 ids, so a group of very many copies is few rows. Without conversations
    there is no node.
    """
    spark = paths.sparkSession
    ids = F.sort_array(F.collect_list("conv_id"))
    grouped = paths.groupBy("path", F.floor(F.col("conv_id") / ID_RANGE).alias("range")).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("conv_id").alias("least"),
        F.array_join(F.transform(ids, lambda i: i.cast("string")), ",").alias("ids"),
    )
    rows, heads = _burst(materialize(grouped, "paths"), least_rows)
    sorted_rows = rows.repartition("container").sortWithinPartitions("container", "path", "least")
    columns = ["container", "head", "path", "ended", "n", "least", "ids"]
    swept = materialize(sorted_rows.select(*columns).mapInArrow(_sweep, NODE_DDL), "nodes")
    names = [f.name for f in swept.schema.fields if f.name not in ("head", "kind")]
    if not heads:
        return swept.select(*names)

    depth_of = spark.createDataFrame([(h["id"], len(h["path"]) // TURN) for h in heads], "head long, branch long")
    tops = swept.where("kind = 'top'").join(F.broadcast(depth_of), "head")
    below = F.col("depth") > F.col("branch")
    summed = tops.groupBy("head").agg(
        F.sum("n_convs").alias("n"),
        F.min("conv_id").alias("first"),
        F.sum(F.when(below, 1).otherwise(0)).alias("children"),
        F.sum(F.when(below, F.col("n_leaves")).otherwise(0)).alias("leaves"),
        F.sum(F.when(below, F.col("saved_tokens")).otherwise(0)).alias("saved"),
        F.coalesce(F.max(F.when(~below, F.col("ends_sha256"))), F.lit(EMPTY)).alias("ends"),
    )
    sums = {r["head"]: {k: r[k] for k in ("n", "first", "children", "leaves", "saved", "ends")} for r in summed.collect()}
    upper = spark.createDataFrame(
        _heads_nodes(heads, sums),
        "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string",
    )
    known = spark.createDataFrame(
        [(h["id"], h["first"], len(h["path"]) // TURN) for h in heads], "head long, head_conv long, branch long"
    )
    joined = swept.join(F.broadcast(known), "head", "left").where(
        F.col("branch").isNull() | (F.col("kind") != "top") | (F.col("depth") > F.col("branch"))
    )
    parent = F.when(F.col("kind") == "top", F.col("head_conv")).otherwise(F.col("parent_conv_id"))
    return joined.withColumn("parent_conv_id", parent).select(*names).unionByName(upper.select(*names))


def conversation_trie(
    turns: DataFrame,
    base_of: Column | None = None,
    shared_turns: Column | None = None,
    id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """The trie of ``turns``; with ``base_of`` and ``shared_turns``, of conversations rebuilt on their base.

    Turns are ordered by ``turn``, null first; equal turns by the digest of role and
    text. Null role or text counts as empty, rows without a conversation are no
    conversation, repeated rows are turns of their own. Texts of any length enter
    as 20 bytes. Extra columns are ignored; an empty table gives no rows.
    """
    paths = paths_of(turns, id, turn, role, text)
    if base_of is not None and shared_turns is not None:
        paths = rebuilt(paths, base_of, shared_turns)
    return prefix_trie(paths)
