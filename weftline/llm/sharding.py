"""Resharding by minimum-cost flow.

Rows lie in old shards. A row's block is its old shard and a hash of its id and text (and of its number, if it repeats both); block sizes are summed, and
the old shards' sizes with the new capacities make a transport problem: moving bytes from shard i to shard j
costs a unit each (or what `cost` says), staying is free. `transfers` solves it by successive shortest paths on
the graph of shards. Each old shard's blocks are then dealt, in order of their number, to its flows, so whole
blocks move; shards that neither gain nor lose blocks keep their files (`rewrite`), the others are rewritten. Shards
within `SLACK` of the mean size are left alone.

Only tables of a size fixed by parameters are broadcast or reach the driver: shards, and at most `BLOCKS` blocks
for each old shard. A shard is cut into segments of near `segment_bytes`, so that no task writes a whole shard.

Law `bytes`: shards' sizes are near equal, and nothing else decides: equal texts under different ids may lie in
different shards.

Defined cases: a null text has 8 bytes and no CRC; null ids and null sources are ordinary values; rows that
repeat an id and a text are numbered and dealt one by one; shards may stay empty and an empty table gives an empty result; other
columns are ignored (or carried by `reshard`).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

BLOCKS = 1 << 12
OLD_SHARDS = 16
SLACK = 0.01  # of the mean size, by which shards may differ from it
ADDED = ["__size", "__shard", "__slot", "__old"]


def row_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long")


def old_shard(source: Column, shards: int = OLD_SHARDS) -> Column:
    """The layout that rows arrive in: by source."""
    return F.pmod(F.crc32(F.coalesce(source.cast("string"), F.lit(""))), F.lit(shards)).cast("int")


def block(doc_id: Column, text: Column, rank: Column) -> Column:
    """By id and text; a row that repeats both is in a block of its own number, so that repeats are no block that cannot be split."""
    own = F.xxhash64(doc_id.cast("string"), text)
    return F.pmod(F.when(rank > 0, F.xxhash64(own, rank)).otherwise(own), F.lit(BLOCKS)).cast("int")


def capacities(total: int, shards: int) -> list[int]:
    """Whole numbers that add up to total, at most one apart."""
    return [total * (k + 1) // shards - total * k // shards for k in range(shards)]


def rooms(sizes: Sequence[int], shards: int, slack: float) -> list[int]:
    """New sizes that add up to the old ones: a shard within `slack` of the mean keeps its size, as long as the others can be within it too."""
    total = sum(sizes)
    even = capacities(total, shards)
    kept = {j: s for j, s in enumerate(sizes[:shards]) if abs(s - total / shards) <= slack * total / shards}
    while kept:
        rest = [j for j in range(shards) if j not in kept]
        left = total - sum(kept.values())
        if not rest:
            if left == 0:
                return [kept[j] for j in range(shards)]
        elif abs(left / len(rest) - total / shards) <= slack * total / shards:
            share = iter(capacities(left, len(rest)))
            return [kept[j] if j in kept else next(share) for j in range(shards)]
        del kept[max(kept, key=lambda j: (abs(kept[j] - total / shards), j))]  # the one that is farthest off joins the others
    return even


def transfers(sizes: Sequence[int], room: Sequence[int], cost: np.ndarray | None = None) -> np.ndarray:
    """flow[i, j]: bytes that go from old shard i to new shard j, at the least total cost; sum(sizes) = sum(room).

    Successive shortest paths with potentials (Dijkstra on the dense graph): each round sends what fits along the
    cheapest path from shards with bytes left to shards with room left. cost[i, j] is at least 0; by default 0
    for i = j and 1 otherwise.
    """
    n, m = len(sizes), len(room)
    if cost is None:
        cost = (np.arange(n)[:, None] != np.arange(m)).astype(float)
    if sum(sizes) != sum(room):
        raise ValueError("sizes and capacities differ in total")
    left, free = [int(x) for x in sizes], [int(x) for x in room]
    flow = np.zeros((n, m), object)
    u, v = np.zeros(n), np.zeros(m)  # potentials of old and new shards
    while any(left):
        dist, done = np.r_[np.where(np.array([x > 0 for x in left]), 0.0, np.inf), np.full(m, np.inf)], np.zeros(n + m, bool)
        back = np.full(n + m, -1)
        goal = -1
        while True:
            k = int(np.argmin(np.where(done, np.inf, dist)))
            done[k] = True
            if k >= n and free[k - n] > 0:
                goal = k
                break
            if k < n:
                new = dist[k] + np.maximum(cost[k] + u[k] - v, 0.0)
                better = np.flatnonzero(~done[n:] & (new < dist[n:]))
                dist[n + better], back[n + better] = new[better], k
            else:
                used = np.array([f > 0 for f in flow[:, k - n]])
                new = dist[k] + np.where(used, np.maximum(v[k - n] - cost[:, k - n] - u, 0.0), np.inf)
                better = np.flatnonzero(~done[:n] & (new < dist[:n]))
                dist[better], back[better] = new[better], k
        near = np.minimum(dist, dist[goal])
        u, v = u + near[:n], v + near[n:]
        path = [goal]
        while back[path[-1]] >= 0:
            path.append(int(back[path[-1]]))
        path.reverse()  # old, new, old, ..., new
        most = min([left[path[0]], free[goal - n], *(int(flow[b, a - n]) for a, b in zip(path[1::2], path[2::2], strict=False))])
        for a, b in zip(path, path[1:], strict=False):
            if a < n:
                flow[a, b - n] += most
            else:
                flow[b, a - n] -= most
        left[path[0]] -= most
        free[goal - n] -= most
    return flow


def deal(blocks: Sequence[tuple[int, int, int, int]], shards: int, segment_bytes: int, cost: np.ndarray | None = None, slack: float = SLACK) -> tuple[list[tuple], np.ndarray]:
    """(old, block, shard, segment, slots before the segment) for each block (old, block, bytes, rows), and the bytes that move.

    Shards within `slack` of the mean size are left as they are. Where a flow ends inside a block, the block goes to the side that holds its middle; what one flow gets too
    much or too little by that is carried on to the next.
    """
    old = max((b[0] for b in blocks), default=-1) + 1
    sizes = [0] * old
    for o, _, s, _ in blocks:
        sizes[o] += s
    room = rooms(sizes, shards, slack)
    flow = transfers(sizes, room, cost)
    placed: dict[int, list] = {}
    filled = [0] * shards
    by_old: dict[int, list] = {}
    for b in sorted(blocks):
        by_old.setdefault(b[0], []).append(b)
    for o, own in by_old.items():
        goes = [j for j in [o, *range(shards)] if j < shards and flow[o, j] > 0]
        goes = list(dict.fromkeys(goes))
        at = 0
        ends = np.cumsum([int(flow[o, j]) for j in goes]).tolist()
        k = 0
        for b in own:
            while k + 1 < len(goes) and at + b[2] / 2 > ends[k]:
                k += 1
            placed.setdefault(goes[k], []).append(b)
            filled[goes[k]] += b[2]
            at += b[2]
    level(placed, filled, room, [j for j in range(shards) if j >= old or room[j] != sizes[j]])
    moved = np.zeros((old, shards), object)
    for j, own in placed.items():
        for o, _, s, _ in own:
            moved[o, j] += s
    out = []
    for j, own in sorted(placed.items()):
        own.sort()
        parts = max(1, -(-room[j] // segment_bytes))
        before, rows, seen, first = 0, 0, -1, 0
        for o, n, s, r in own:
            seg = min(parts - 1, before * parts // max(1, filled[j]))
            if seg != seen:
                seen, first = seg, rows
            out.append((o, n, j, seg, first))
            before, rows = before + s, rows + r
    return out, moved


def level(placed: dict[int, list], filled: list[int], room: Sequence[int], among: Sequence[int], rounds: int = 400) -> None:
    """Even out what whole blocks left uneven: the fullest shard gives the emptiest the block nearest to half their gap.

    Only shards of `among` take part, those that are written anew. Blocks that have left their old shard anyway are
    preferred, as they cost nothing more.
    """
    over = [f - r for f, r in zip(filled, room, strict=True)]
    for _ in range(rounds if among else 0):
        a, b = max(among, key=over.__getitem__), min(among, key=over.__getitem__)
        gap = over[a] - over[b]
        own = [x for x in placed.get(a, []) if 0 < x[2] < gap]
        own = [x for x in own if x[0] != a] or own
        if not own:
            return
        x = min(own, key=lambda x: (abs(x[2] - gap / 2), x))
        placed[a].remove(x)
        placed.setdefault(b, []).append(x)
        for j, sign in ((a, -1), (b, 1)):
            over[j] += sign * x[2]
            filled[j] += sign * x[2]


def assign(spark: SparkSession, docs: DataFrame, shards: int, old: Column | None = None, segment_bytes: int = 32 << 20, cost: np.ndarray | None = None, slack: float = SLACK) -> tuple[DataFrame, np.ndarray]:
    """docs(doc_id, text, ...) with __size, __shard, __slot and __old, dealt so that a task has segments of shards; and the bytes that move."""
    old = old_shard(F.col("source")) if old is None else old
    columns, docs = docs.columns, common.ranked(spark, docs, F.xxhash64(F.col("doc_id").cast("string"), "text"))
    at = block(F.col("doc_id"), F.col("text"), F.col("__rank"))
    spot = docs.select(old.alias("__old"), at.alias("__block"), row_size(F.col("text")).alias("__size"))
    sums = spot.groupBy("__old", "__block").agg(F.sum("__size").alias("s"), F.count(F.lit(1)).alias("n"))
    rows, flow = deal([tuple(r) for r in sums.collect()], shards, segment_bytes, cost, slack)
    parts = {k: i for i, k in enumerate(sorted({(r[2], r[3]) for r in rows}))}  # a segment of a shard is a partition
    places = spark.createDataFrame([(*r, parts[r[2], r[3]]) for r in rows], "__old int, __block int, __shard int, __seg int, __first long, __part int")
    put = docs.withColumns({"__old": old, "__block": at, "__size": row_size(F.col("text"))}).join(F.broadcast(places), ["__old", "__block"])
    order = W.Window.partitionBy("__part").orderBy("__old", "__block", "doc_id", F.xxhash64("text"))
    slot = (F.col("__first") + F.row_number().over(order) - 1).cast("long")
    return put.repartitionById(max(1, len(parts)), F.col("__part")).withColumn("__slot", slot).select(*columns, *ADDED), flow


def affected(flow: np.ndarray) -> list[int]:
    """New shards that gain or lose bytes; the files of all others stay as they are."""
    n, m = flow.shape
    return [j for j in range(m) if any(flow[i, j] > 0 for i in range(n) if i != j) or j >= n or any(flow[j, k] > 0 for k in range(m) if k != j)]


def write(dealt: DataFrame, at: str) -> DataFrame:
    """Write docs of `assign` as files of shards under at/__shard=N, and read them."""
    dealt.write.partitionBy("__shard").parquet(at)
    return dealt.sparkSession.read.schema(dealt.schema).parquet(at)


def rewrite(spark: SparkSession, layout: str, at: str, shards: int, segment_bytes: int = 32 << 20) -> list[int]:
    """Reshard the files layout/__shard=N (with doc_id and text) into at: only shards that a flow touches are written anew.

    The files of the other shards are not read again after planning; they stay under `layout`, and the
    returned list names the shards to take from `at`. Old files are left to the caller, so a failed job can be run again.
    """
    docs = spark.read.parquet(layout)
    plain = docs.select(*[c for c in docs.columns if c != "__shard"], F.col("__shard").cast("int").alias("__from"))
    dealt, flow = assign(spark, plain, shards, F.col("__from"), segment_bytes)
    touched = affected(flow)
    moved = dealt.where(F.col("__shard").isin(touched)) if touched else dealt.limit(0)
    moved.drop("__from", "__old").write.partitionBy("__shard").parquet(at)
    return touched


def reshard(spark: SparkSession, docs: DataFrame, shards: int = 24, name: str = "shards") -> DataFrame:
    """The rewritten shard files of docs(doc_id, text, source, ...): its columns with __size, __shard, __slot and __old."""
    return write(assign(spark, docs, shards)[0], common.new_path(spark, name))


def digest(spark: SparkSession, docs: DataFrame, shards: int = 24) -> DataFrame:
    """What the rewritten files hold: doc_id, size, text_crc32, law, shard, slot, grown_shard, and the old shard."""
    files = reshard(spark, docs.select("doc_id", "text", "source"), shards)
    return files.select(
        "doc_id", row_size(F.col("text")).alias("size"), F.crc32("text").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("__shard").alias("shard"),
        F.col("__slot").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), F.col("__old").alias("old_shard"),
    )
