"""Prefix trie of conversations: union-find over sorted-neighbour prefixes, deepest first.

A conversation is a sequence of turns, each a 128-bit digest. Every distinct sequence of
first d turns is a node; conversations that start with it are its members.

1. *Sort.* Conversations are range-partitioned and sorted by (their digests one after another, id). Digests have one
   width, so this is the order of the trie, and conversations that are the same split over partitions by id.
2. *Forest.* In a partition, neighbours share the first l turns: an edge of depth l. Edges are
   taken deepest first (equal ones from left to right) and joined by union-find. A merge at depth l whose left component
   doesn't already end there makes a branching node; an edge of the forest stands for a chain of nodes with the same members.
3. *Contraction.* Only nodes on the path to a partition's first or last conversation, no deeper than what
   that one shares with the neighbouring partition, go on across the boundary. Everything below them is final and is
   folded into one row for each of these open nodes.
4. *Merge.* Open rows are summed by the digest of their path. Each open node belongs to the first boundary it crosses; the
   sums of a subtree add up along the boundaries' paths, which a window of one path's length does, and then by node.

No task holds more than one partition's digests or one boundary path, the root and any other hot node
get one row a partition, and the parents of final nodes are looked up by (partition, path).

Defined results: rows with a null id are no members; a null sequence is empty, its conversation a member of
the root alone; repeated ids are separate members; an empty table has no nodes; other columns are ignored, whatever
their names. ``turn_sequences`` orders the turns of a conversation by (turn, null first; role; digest), so rows that
tie or repeat have one order; a null role or text is an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casegrain.llm.tables import arrow, written
from casegrain.llm.words import column

WIDTH = 16          # bytes of a turn's digest
PART = ("pid int, open boolean, on_left boolean, id binary, parent_id binary, conv_id long, depth long, parent_conv_id long, "
        "n_convs long, n_children long, n_leaves long, saved long, weight long, has_child boolean, members array<long>")
_PART = pa.schema([("pid", pa.int32()), ("open", pa.bool_()), ("on_left", pa.bool_()), ("id", pa.binary()), ("parent_id", pa.binary()),
                   ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()),
                   ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("saved", pa.int64()), ("weight", pa.int64()),
                   ("has_child", pa.bool_()), ("members", pa.list_(pa.int64()))])
ROWS = 4096
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens"]


def turn_sequences(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, turn, role, text) as (conv_id, steps): a digest and a weight (code points) per turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    step = F.struct(F.col("turn"), role.alias("role"), F.md5(F.concat(F.md5(role.cast("binary")), F.md5(text.cast("binary")))).alias("key"),
                    F.char_length(text).cast("long").alias("weight"))
    rows = turns.where("conv_id IS NOT NULL").groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(
        F.sort_array(F.collect_list(step)).alias("steps"))
    return rows.select("conv_id", F.transform("steps", lambda s: F.struct(s["key"].alias("key"), s["weight"].alias("weight"))).alias("steps"))


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences share at their start."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // WIDTH
    lo, hi = 0, n // WIDTH          # the first lo turns are the same, the first hi are not
    while hi - lo > 1:
        mid = (lo + hi) // 2
        if a[lo * WIDTH:mid * WIDTH] == b[lo * WIDTH:mid * WIDTH]:
            lo = mid
        else:
            hi = mid
    return lo


class Forest(NamedTuple):
    """Branching nodes and ends of some sorted sequences; the first ``len(depths of the sequences)`` nodes are the sequences."""

    depth: list[int]
    parent: list[int]               # -1: none
    leaf: list[int]                 # a sequence below the node
    root: int


def forest(keys: list[bytes]) -> Forest:
    """The trie of distinct sorted sequences, by union-find over neighbours' edges in descending depth."""
    depth = [len(k) // WIDTH for k in keys]
    parent, leaf = [-1] * len(keys), list(range(len(keys)))
    up, top = list(range(len(keys))), list(range(len(keys)))

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    edges = sorted(((_shared(keys[j - 1], keys[j]), j) for j in range(1, len(keys))), key=lambda e: (-e[0], e[1]))
    for shared, j in edges:
        a, b = find(j - 1), find(j)
        if depth[top[a]] != shared:
            depth.append(shared)
            parent.append(-1)
            leaf.append(leaf[top[a]])
            parent[top[a]] = len(depth) - 1
            top[a] = len(depth) - 1
        parent[top[b]] = top[a]
        up[b] = a
    root = top[find(0)]
    if depth[root]:
        depth.append(0)
        parent.append(-1)
        leaf.append(0)
        parent[root] = len(depth) - 1
        root = len(depth) - 1
    return Forest(depth, parent, leaf, root)


def _path_ids(key: bytes, depth: int) -> list[bytes]:
    """Digests of a sequence's first 0, 1, ... ``depth`` turns."""
    h = hashlib.md5()
    out = [h.digest()]
    for d in range(depth):
        h.update(key[d * WIDTH:(d + 1) * WIDTH])
        out.append(h.copy().digest())
    return out


def _nodes(pid: int, left: int, right: int, keys: list[bytes], members: list[list[int]], weights: list[list[int]]) -> Iterator[tuple]:
    """Rows of ``PART`` of one partition's sorted distinct sequences; left and right: turns shared with the neighbours."""
    f = forest(keys)
    n = len(f.depth)
    count, least, leaves, below, kids = [0] * n, [None] * n, [0] * n, [0] * n, [[] for _ in range(n)]
    saved = [0] * n                 # of the whole chain that ends in the node, and all below
    for j, own in enumerate(members):
        count[j], least[j] = len(own), own[0]
    order = sorted(range(n), key=lambda v: -f.depth[v])
    for v in order:
        leaves[v] = leaves[v] or int(not kids[v])
        p = f.parent[v]
        above = f.depth[p] if p >= 0 else -1
        w = weights[f.leaf[v]]
        saved[v] = below[v] + (count[v] - 1) * sum(w[max(above, 0):f.depth[v]])
        if p >= 0:
            kids[p].append(v)
            count[p] += count[v]
            least[p] = least[v] if least[p] is None else min(least[p], least[v])
            leaves[p] += leaves[v]
            below[p] += saved[v]
    ids = {}
    side = [(0, left, _path_ids(keys[0], left) if left >= 0 else []),
            (len(keys) - 1, right, _path_ids(keys[-1], right) if right >= 0 else [])]
    # Depths down to which a node's chain is open, by the path to the first and to the last sequence.
    reach = [[-1, -1] for _ in range(n)]
    for s, (j, limit, path) in enumerate(side):
        v = j
        while v >= 0 and limit >= 0:
            reach[v][s] = limit
            v = f.parent[v]
    for v in order:
        p, w = f.parent[v], weights[f.leaf[v]]
        above = f.depth[p] if p >= 0 else -1
        limit = max(reach[v])
        path = side[0][2] if reach[v][0] == limit else side[1][2]
        total = below[v]
        for d in range(f.depth[v], above, -1):
            weight = w[d - 1] if d else 0
            last = d == f.depth[v]
            own = members[v] if last and v < len(keys) else None
            if d <= limit:
                # Final children: those of the forest, or the next node of this chain.
                if last:
                    final = [c for c in kids[v] if max(reach[c]) <= d]
                    sums = len(final), sum(leaves[c] for c in final), sum(saved[c] for c in final)
                else:
                    sums = (1, leaves[v], total) if d == limit else (0, 0, 0)
                yield (pid, True, d <= reach[v][0], path[d], path[d - 1] if d else None, least[v], d, None, count[v],
                       sums[0], sums[1], sums[2], weight, not last or bool(kids[v]), own)
            else:
                total += (count[v] - 1) * weight
                up_open, up_conv = None, None
                if d - 1 > above:
                    up_open = path[d - 1] if d - 1 <= limit else None
                    up_conv = least[v]
                elif p >= 0:
                    up_conv = least[p]
                    if d - 1 <= max(reach[p]):
                        up_open = (side[0][2] if reach[p][0] == max(reach[p]) else side[1][2])[d - 1]
                yield (pid, False, False, None, up_open, least[v], d, None if up_open is not None else up_conv, count[v],
                       len(kids[v]) if last else 1, leaves[v], total, weight, not last or bool(kids[v]), own)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of sorted partitions (pid, left_shared, right_shared, key, conv_id, weights) to rows of ``PART``."""
    now, keys, members, weights = None, [], [], []

    def rows(of):
        out = []
        for row in _nodes(*of, keys, members, weights):
            out.append(row)
            if len(out) == ROWS:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    for batch in batches:
        cols = [column(batch, c).to_pylist() for c in ("pid", "left_shared", "right_shared", "key", "conv_id", "weights")]
        for pid, left, right, key, conv, w in zip(*cols):
            if now is not None and now[0] != pid:
                yield from rows(now)
                keys, members, weights = [], [], []
            now = (pid, left, right)
            if not keys or keys[-1] != key:
                keys.append(key)
                members.append([])
                weights.append(w)
            members[-1].append(conv)
    if now is not None:
        yield from rows(now)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _PART)], schema=_PART)


def _shared_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = column(batch, "a").to_pylist(), column(batch, "b").to_pylist()
        shared = [-1 if x is None or y is None else _shared(x, y) for x, y in zip(a, b)]
        yield pa.RecordBatch.from_arrays([column(batch, "pid"), column(batch, "next_pid"), pa.array(shared, pa.int32())],
                                         names=["pid", "next_pid", "shared"])


def _partitions(seqs: DataFrame) -> DataFrame:
    """Rows of ``PART`` of the sorted partitions of ``seqs``, written."""
    spark = seqs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    steps = F.coalesce("steps", F.array().cast("array<struct<key:string,weight:long>>"))
    rows = seqs.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.unhex(F.array_join(F.transform(steps, lambda s: s["key"]), "")).alias("key"),
        F.transform(steps, lambda s: s["weight"].cast("long")).alias("weights"))
    # Written once: the bounds of a range partitioning are sampled and may differ between two computations.
    rows = written(rows.repartitionByRange(parts, "key", "conv_id").withColumn("pid", F.spark_partition_id()), "trie-sorted")
    ends = rows.groupBy("pid").agg(F.min("key").alias("first"), F.max("key").alias("last"))
    # One row per partition.
    w = Window.orderBy("pid")
    pairs = ends.select("pid", F.lead("pid").over(w).alias("next_pid"), F.col("last").alias("a"), F.lead("first").over(w).alias("b"))
    shared = written(arrow(pairs, _shared_ends, "pid int, next_pid int, shared int"), "trie-bounds")
    bounds = shared.select("pid", F.col("shared").alias("right_shared")).join(
        shared.select(F.col("next_pid").alias("pid"), F.col("shared").alias("left_shared")), "pid", "left").na.fill(-1, ["left_shared"])
    dealt = rows.join(F.broadcast(bounds), "pid").repartition(parts, "pid").sortWithinPartitions("pid", "key", "conv_id")
    cols = ["pid", "left_shared", "right_shared", "key", "conv_id", "weights"]
    return written(arrow(dealt.select(cols), _forests, PART), "trie-parts")


def prefix_trie(seqs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes of the trie of ``seqs`` (conv_id, steps array<struct<key string (md5), weight long>>) and split member lists.

    Nodes: conv_id (smallest member; with depth it names the node), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree, each node's n_convs - 1 times the weight of its last turn), members (ids of conversations that end
    here, ascending; null where they stand in the second table), split. The second table: conv_id, depth, part,
    members: the ids that end in a node of several partitions, ascending from part to part.
    """
    parts = _partitions(seqs)
    crossing = parts.where("open")
    totals = crossing.groupBy("id").agg(
        F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"), F.min("parent_id").alias("parent_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("n_children"), F.sum("n_leaves").alias("n_leaves"),
        F.sum("saved").alias("saved"), F.min("weight").alias("weight"), F.max("has_child").alias("has_child"),
        F.min(F.when(F.col("on_left"), F.col("pid"))).alias("owner"),
        F.sum(F.when(F.col("members").isNotNull(), F.size("members")).otherwise(0).cast("long")).alias("n_ends"))
    totals = written(totals, "trie-open")
    own = totals.select("id", "owner", (F.col("saved") + (F.col("n_convs") - 1) * F.col("weight")).alias("saved"),
                        (F.col("n_leaves") + F.when(F.col("has_child"), 0).otherwise(1)).alias("n_leaves"))
    # One boundary's path, deepest first: what belongs to it is added up once for every node above.
    w = Window.partitionBy("pid").orderBy(F.col("depth").desc())
    mine = F.col("owner") == F.col("pid")
    sums = crossing.where("on_left").select("id", "pid", "depth").join(own, "id").select(
        "id", F.sum(F.when(mine, F.col("saved")).otherwise(0)).over(w).alias("s"),
        F.sum(F.when(mine, F.col("n_leaves")).otherwise(0)).over(w).alias("l")).groupBy("id").agg(
        F.sum("s").alias("saved_tokens"), F.sum("l").alias("all_leaves"))
    kids = totals.where("parent_id IS NOT NULL").groupBy("parent_id").agg(F.count(F.lit(1)).alias("n_open"))
    named = totals.select(F.col("id").alias("parent_id"), F.col("conv_id").alias("parent_conv_id"))
    open_nodes = (totals.select("id", "conv_id", "depth", "parent_id", "n_convs", "n_children", "n_ends")
                  .join(sums, "id").join(kids.withColumnRenamed("parent_id", "id"), "id", "left").join(named, "parent_id", "left")
                  .select("conv_id", "depth", "parent_conv_id", "n_convs", (F.col("n_children") + F.coalesce("n_open", F.lit(0))).alias("n_children"),
                          F.col("all_leaves").alias("n_leaves"), "saved_tokens",
                          F.when(F.col("n_ends") == 0, F.array().cast("array<long>")).alias("members"), (F.col("n_ends") > 0).alias("split")))
    final = parts.where("NOT open")
    shape = lambda df, up: df.select("conv_id", "depth", up, "n_convs", "n_children", "n_leaves", F.col("saved").alias("saved_tokens"),
                                     F.coalesce("members", F.array().cast("array<long>")).alias("members"), F.lit(False).alias("split"))
    inner = shape(final.where("parent_id IS NULL"), F.col("parent_conv_id"))
    # By (partition, path): no more rows meet under one key than a partition holds.
    by_part = crossing.select("pid", "id").join(totals.select("id", F.col("conv_id").alias("up")), "id")
    outer = final.where("parent_id IS NOT NULL").alias("f").join(
        by_part.alias("p"), (F.col("f.pid") == F.col("p.pid")) & (F.col("f.parent_id") == F.col("p.id"))).select("f.*", "p.up")
    nodes = inner.unionByName(shape(outer, F.col("up").alias("parent_conv_id"))).unionByName(open_nodes)
    chunks = crossing.where("size(members) > 0").select("id", F.col("pid").alias("part"), "members").join(
        totals.select("id", "conv_id", "depth"), "id").select("conv_id", "depth", "part", "members")
    return nodes, chunks


def members_digest(nodes: DataFrame, chunks: DataFrame) -> DataFrame:
    """``nodes`` with ``ends_sha256`` of their comma-joined ascending members instead of ``members`` and ``split``.

    The digest of a split list reads its parts in order, one at a time: a chain of SHA-256 can't be cut, but nothing is gathered.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, out = None, None, []
        for batch in batches:
            cols = [column(batch, c) for c in ("conv_id", "depth", "members")]
            for i in range(batch.num_rows):
                key = cols[0][i].as_py(), cols[1][i].as_py()
                text = ",".join(map(str, cols[2][i].as_py())).encode()
                if key != now:
                    out += [(*now, h.hexdigest())] if now else []
                    now, h = key, hashlib.sha256()
                else:
                    h.update(b",")
                h.update(text)
        out += [(*now, h.hexdigest())] if now else []
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int64()), pa.array([r[1] for r in out], pa.int64()),
                                          pa.array([r[2] for r in out], pa.string())], names=["conv_id", "depth", "ends_sha256"])
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = chunks.repartition(parts, "conv_id", "depth").sortWithinPartitions("conv_id", "depth", "part")
    told = arrow(ordered.select("conv_id", "depth", "members"), run, "conv_id long, depth long, ends_sha256 string")
    whole = nodes.where("NOT split").select(*NODE, F.sha2(F.array_join(F.col("members").cast("array<string>"), ","), 256).alias("ends_sha256"))
    return whole.unionByName(nodes.where("split").join(told, ["conv_id", "depth"]).select(*NODE, "ends_sha256"))
