"""Conversation prefix trie: intervals of sorted conversations, found by range minima over common prefix lengths.

Conversations are strings of turn keys. Sorted, those that share a prefix stand side by side, and the prefix reaches
as far as the common prefix lengths (LCP) of neighbours do not fall below its depth. Every candidate prefix searches
its left and its right end by itself, halving steps over a sparse table of range minima; nothing is kept on a stack.

Equal conversations are one row with a count, rows are sorted in ranges, and every range is a block of its own that
knows the last row before it and the first behind it. What a block says of a node is a sum or a minimum over its own
rows, so nodes that reach over several blocks are put together by plain aggregation.
"""

from __future__ import annotations

import hashlib
import sys
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from terrafold.plans.ordering import PART, POS, in_ranges, number_rows
from terrafold.plans.session import bounded_broadcast, written

cloudpickle.register_pickle_by_value(sys.modules[__name__])

TURN = 24  # bytes of a turn in a path: 16 of its key, 8 of its size
TURNS_PER_STEP = 4_096  # a conversation is cut into rows of so many turns
ROWS_PER_BLOCK = 20_000
BYTES_PER_BLOCK = 32_000_000
IDS_PER_LIST = 10_000

NODES = (
    "level int, up binary, node binary, parent binary, depth bigint, n bigint, first bigint, leaves bigint, saved bigint, children bigint"
)


def conversation_turns(conversations: DataFrame) -> DataFrame:
    """(conv_id, pos, turn, size): turns numbered from 0, null turn numbers first; ``turn`` is the md5 of role and text,
    ``size`` the UTF-8 bytes of the text. Null role and text are empty; turns of equal number go by their md5; rows
    without conv_id take no part. Texts are not shuffled, and a conversation of any length is numbered by ranges."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    key = F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text))
    slim = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").alias("no"), key.alias("turn"), F.octet_length(text).cast("bigint").alias("size")
    )
    return number_rows(slim, ["no", "turn"], "pos", by=["conv_id"]).select("conv_id", "pos", "turn", "size")


def prefix_trie(turns: DataFrame, ids: DataFrame, step: int = TURNS_PER_STEP, rows_per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """One row per node of the trie over all conversations ``ids`` (conv_id) with their ``turns``
    (conv_id, pos from 0 without gaps, turn, size): node and parent (binary names), conv_id (smallest member), depth,
    parent_conv_id, n_convs, n_children, n_leaves, saved (over the subtree, (n_convs - 1) times the size of a node's
    last turn), ends_sha256 (of the ids of members that end here, ascending, comma-joined).

    Conversations without turns are members of the root. No conversations, no nodes. Turns of conversations that are
    not in ``ids`` must not be there; an id that repeats counts once.
    """
    paths = _paths(turns, ids.select("conv_id").distinct(), step)
    classes = written(
        paths.groupBy("level", "up", "group", "next", "path").agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("first")), "trie-classes"
    )
    sizes = {r["level"]: r for r in classes.groupBy("level").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.length("path")).alias("bytes")).collect()}
    found, below = None, None
    for level in sorted(sizes, reverse=True):  # one level, unless a conversation is longer than ``step``
        rows = classes.filter(F.col("level") == level)
        gone = {c: F.lit(None).cast("bigint") for c in ("sub_leaves", "sub_saved", "sub_children")}
        rows = rows.withColumns(gone) if below is None else rows.join(below, "next", "left")
        nodes = written(_level_nodes(rows, level, step, sizes[level]["rows"], sizes[level]["bytes"], rows_per_block), "trie-nodes")
        tops = nodes.filter((F.col("depth") == level * step) & (F.col("level") > 0))
        below = tops.groupBy(F.col("node").alias("next")).agg(*[F.sum(c).alias(f"sub_{c}") for c in ("leaves", "saved", "children")])
        own = nodes.filter((F.col("level") == 0) | (F.col("depth") > level * step))
        found = own if found is None else found.unionByName(own)
    if found is None:
        found = turns.sparkSession.createDataFrame([], NODES)
    merged = found.groupBy("node").agg(
        F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.min("first").alias("conv_id"),
        *[F.sum(c).alias(k) for c, k in (("n", "n_convs"), ("children", "n_children"), ("leaves", "n_leaves"), ("saved", "saved"))],
    )
    nodes = written(merged, "trie")
    ends = _ends(paths.filter("last").select(_name("level", "group", "path").alias("node"), "conv_id"))
    parents = nodes.filter("n_children > 0").select(F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    named = nodes.join(bounded_broadcast(parents, parents.count()), "parent", "left").join(ends, "node", "left")
    return named.withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)))


def _name(level: str, group: str, path: str) -> Column:
    """A node's name: level, what stands before the level, and the path in it."""
    return F.unhex(F.md5(F.concat(F.col(level).cast("string").cast("binary"), F.lit(":").cast("binary"), group, path)))


def _paths(turns: DataFrame, ids: DataFrame, step: int) -> DataFrame:
    """(conv_id, level, path, group, next, up, last): each conversation in rows of ``step`` turns.

    ``group`` names all that stands before the row, ``next`` all up to its end, ``up`` the node that the row goes on from."""
    width = F.lpad(F.hex("size"), 16, "0")
    keyed = turns.select("conv_id", F.floor(F.col("pos") / step).cast("int").alias("level"), "pos", F.concat("turn", width).alias("t"))
    rows = keyed.groupBy("conv_id", "level").agg(F.array_sort(F.collect_list(F.struct("pos", "t"))).alias("ts"))
    path = F.unhex(F.array_join(F.transform("ts", lambda s: s["t"]), ""))
    rows = written(rows.select("conv_id", "level", path.alias("path")), "trie-rows")
    mute = ids.join(rows.filter("level = 0").select("conv_id"), "conv_id", "left_anti").select("conv_id", F.lit(0).alias("level"), F.lit(b"").alias("path"))
    both = rows.unionByName(mute)
    order = Window.partitionBy("conv_id").orderBy("level")  # turns / step rows of one conversation

    def so_far(last: int) -> Column:
        marks = [F.bit_xor(F.xxhash64(F.lit(seed), "level", "path")).over(order.rowsBetween(Window.unboundedPreceding, last)) for seed in (1, 2)]
        return F.unhex(F.concat(*[F.lpad(F.hex(F.coalesce(m, F.lit(0))), 16, "0") for m in marks]))

    chained = both.withColumns({"group": F.when(F.col("level") > 0, so_far(-1)).otherwise(F.lit(b"")), "next": so_far(0)})
    own = _name("level", "group", "path")
    # a node at the end of a full row is named by that row; deeper rows hang below it
    return chained.withColumn("end", own).withColumns({"up": F.lag("end").over(order), "last": F.lead("level").over(order).isNull()}).drop("end")


def _level_nodes(rows: DataFrame, level: int, step: int, n: int, size: int, rows_per_block: int) -> DataFrame:
    """What each block of this level says of its nodes (schema NODES); the node of depth level * step is named by
    ``group`` where level > 0."""
    least = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = max(1, min(least, n), -(-n // rows_per_block), -(-(size or 0) // BYTES_PER_BLOCK))
    placed, _ = in_ranges(rows, ["group", "path"], parts=parts)
    at = F.struct("group", "path")
    ends = placed.groupBy(PART).agg(F.min_by(at, POS).alias("first_row"), F.max_by(at, POS).alias("last_row"))
    beside = Window.orderBy(PART)  # one row per block
    edges = ends.select(PART, F.lag("last_row").over(beside).alias("before"), F.lead("first_row").over(beside).alias("behind"))

    def block(left: pa.Table, right: pa.Table) -> pa.Table:
        edge = right.to_pylist()[0]
        return block_nodes(left.sort_by(POS), edge["before"], edge["behind"], level, step)

    return placed.groupBy(PART).cogroup(edges.groupBy(PART)).applyInArrow(block, NODES)


def common_turns(a: bytes, b: bytes) -> int:
    """Turns that two paths have in common at their start."""
    size = min(len(a), len(b))
    if a[:size] == b[:size]:
        return size // TURN
    differ = np.frombuffer(a, np.uint8, size) != np.frombuffer(b, np.uint8, size)
    return int(differ.argmax()) // TURN


def sparse_minima(values: np.ndarray) -> list[np.ndarray]:
    """Table k holds the minima of all runs of 2 ** k values."""
    tables = [values]
    while 2 ** len(tables) <= len(values):
        half = 2 ** (len(tables) - 1)
        tables.append(np.minimum(tables[-1][:-half], tables[-1][half:]))
    return tables


def range_min(tables: list[np.ndarray], low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Minima over [low, high], two overlapping runs each."""
    out = np.empty(len(low), dtype=tables[0].dtype)
    power = np.floor(np.log2(high - low + 1)).astype(int)
    for k in np.unique(power):
        here = power == k
        out[here] = np.minimum(tables[k][low[here]], tables[k][high[here] - 2**k + 1])
    return out


def extents(lcp: np.ndarray, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The farthest rows left and right of ``at`` that share ``depth`` turns with it; lcp[i] is between rows i - 1 and i.

    Each candidate halves its steps on its own: a step is taken where the minimum over it stays at ``depth`` or more."""
    tables, n = sparse_minima(lcp), len(lcp)
    left, right = at.copy(), at.copy()
    for k in reversed(range(len(tables))):
        size = 2**k
        start = left - size + 1  # lcp[start .. left]
        ok = start >= 1
        ok[ok] = tables[k][start[ok]] >= depth[ok]
        left[ok] -= size
        ok = right + size < n  # lcp[right + 1 .. right + size]
        ok[ok] = tables[k][right[ok] + 1] >= depth[ok]
        right[ok] += size
    return left, right


def block_nodes(rows: pa.Table, before: dict | None, behind: dict | None, level: int, step: int) -> pa.Table:
    """Nodes of one sorted block of distinct paths, each by its first row here; sums cover this block's rows only.

    A node that an earlier block has too is not owned here: its size was taken off once, there, and it is no new child."""
    groups, paths, ups = (rows.column(c).to_pylist() for c in ("group", "path", "up"))
    members, first = (rows.column(c).to_numpy().astype(np.int64) for c in ("n", "first"))
    subs = {c: rows.column(f"sub_{c}").to_pylist() for c in ("leaves", "saved", "children")}
    n = len(paths)
    shared = lambda g, p, i: common_turns(p, paths[i]) if g == groups[i] else -1
    lcp = np.array([shared(before["group"], before["path"], 0) if before else -1] + [shared(groups[i - 1], paths[i - 1], i) for i in range(1, n)], dtype=np.int64)
    after = shared(behind["group"], behind["path"], n - 1) if behind else -1
    size = np.array([len(p) // TURN for p in paths], dtype=np.int64)

    offset = np.concatenate(([0], np.cumsum(size + 1)))
    at = np.repeat(np.arange(n), size + 1)
    depth = np.arange(offset[-1]) - offset[at]
    left, right = extents(lcp, at, depth)
    mine = left == at
    owned = mine & ((at > 0) | (depth > lcp[0]))

    has_sub = np.array([s is not None for s in subs["leaves"]], dtype=bool)
    sub = {c: np.array([s or 0 for s in v], dtype=np.int64) for c, v in subs.items()}
    leaf = np.where(has_sub, sub["leaves"], (np.append(lcp[1:], after) < size).astype(np.int64))
    total = lambda x: np.concatenate(([0], np.cumsum(x)))
    count, leaves, deeper = total(members), total(leaf), total(sub["saved"])
    n_here = count[right + 1] - count[left]
    turn_size = np.zeros(offset[-1], dtype=np.int64)
    for i, p in enumerate(paths):
        if p:
            turn_size[offset[i] + 1 : offset[i + 1]] = np.frombuffer(p, ">u8").reshape(-1, 3)[:, 2].astype(np.int64)
    value = total(np.where(mine, n_here * turn_size, 0) - np.where(owned, turn_size, 0))
    saved = value[offset[right + 1]] - value[np.arange(offset[-1])] + deeper[right + 1] - deeper[at]
    children = np.zeros(offset[-1], dtype=np.int64)
    kids = np.flatnonzero(owned & (depth > 0))
    np.add.at(children, offset[left[kids - 1]] + depth[kids] - 1, 1)  # the candidate before is one turn shorter
    np.add.at(children, offset[1:] - 1, sub["children"])  # below the end of a full row
    smallest = range_min(sparse_minima(first), left, right)

    at_mine = np.flatnonzero(mine)
    names, parents = _names(paths, groups, ups, at[at_mine], depth[at_mine], level)
    made = [
        pa.array(np.full(len(at_mine), level), pa.int32()), pa.array([ups[i] for i in at[at_mine]], pa.binary()), pa.array(names, pa.binary()),
        pa.array(parents, pa.binary()), *[pa.array(x, pa.int64()) for x in (
            depth[at_mine] + level * step, n_here[at_mine], smallest[at_mine], (leaves[right + 1] - leaves[left])[at_mine], saved[at_mine], children[at_mine])],
    ]
    return pa.table(made, names=[f.split()[0] for f in NODES.split(", ")])


def _names(paths, groups, ups, at, depth, level) -> tuple[list[bytes], list[bytes | None]]:
    """Names of prefixes and of the prefixes one turn shorter; a path is hashed once, turn by turn."""
    names, parents, row, digests, state = [], [], -1, [], None
    for i, d in zip(at.tolist(), depth.tolist()):
        if i != row:
            row, state = i, hashlib.md5(b"%d:" % level + groups[i], usedforsecurity=False)
            digests = [state.digest()]
        while len(digests) <= d:
            k = len(digests) - 1
            state.update(paths[i][k * TURN : (k + 1) * TURN])
            digests.append(state.digest())
        top = level > 0 and d == 0
        names.append(groups[i] if top else digests[d])
        parents.append(None if d == 0 else ups[i] if level > 0 and d == 1 else digests[d - 1])
    return names, parents


def _ends(members: DataFrame) -> DataFrame:
    """(node, ends_sha256): ids in numeric order. Ids are cut at multiples of IDS_PER_LIST, so every list is bounded,
    and the lists of a node run through the hash one after the other."""
    part = F.floor(F.col("conv_id") / F.lit(IDS_PER_LIST)).cast("bigint")
    lists = members.groupBy("node", part.alias("part")).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda i: i.cast("string")), ",").alias("ids")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            done: list[tuple[bytes, str]] = []
            for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
                if name != node:
                    if state is not None:
                        done.append((node, state.hexdigest()))
                    node, state = name, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield _pairs(done)
        if state is not None:
            yield _pairs([(node, state.hexdigest())])

    ordered = lists.repartition("node").sortWithinPartitions("node", "part")
    return ordered.mapInArrow(run, "node binary, ends_sha256 string")


def _pairs(done: list[tuple[bytes, str]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.binary()), pa.array([d[1] for d in done], pa.string())], names=["node", "ends_sha256"])


def with_borrowed_heads(turns: DataFrame, every: int = 5, most: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, ids) of conversations rebuilt: the first h turns of conversation c - c % every (all, if fewer), then c's
    own from its h-th on, where h = crc32(decimal c) % most."""
    slim = written(turns, "turns")
    heads = written(slim.filter(F.col("pos") < most - 1), "heads")
    c, h = F.col("conv_id"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int")
    known = heads.groupBy(c.alias("base")).agg(F.count(F.lit(1)).alias("held"))
    plan = slim.select("conv_id").distinct().withColumns({"base": c - c % every, "h": h}).join(known, "base", "left")
    plan = written(plan.select("conv_id", "base", "h", F.least("h", F.coalesce("held", F.lit(0))).alias("taken")), "plan")
    borrowed = heads.withColumnRenamed("conv_id", "base").join(plan, "base").filter(F.col("pos") < F.col("h"))
    hinted = bounded_broadcast(plan, plan.count())
    own = slim.join(hinted, "conv_id").filter(F.col("pos") >= F.col("h")).withColumn("pos", F.col("taken") + F.col("pos") - F.col("h"))
    columns = ["conv_id", "pos", "turn", "size"]
    return borrowed.select(*columns).unionByName(own.select(*columns)), plan.select("conv_id")
