"""Near-duplicate documents by a chosen-path set similarity join.

A document's set holds the hashes of its distinct word shingles. `POSITIONS` minwise values of the set give its
sketch (4 bits each); of sets that have any candidate, `WIDE` values give a sharper one for the later rounds. Trees of
chosen paths bring similar sets together: in each of several independent trees a node picks, from its own key, one
minwise position and with the chance 1 / threshold - 1 a second one, and sends each of its sets to the child named by
the set's token there, so that a set has 1 / threshold children on average and two sets at the threshold share one on
average. The number of trees follows from the threshold and the target recall (`trees`). Nodes of at most `SMALL` sets
are compared exhaustively. Larger ones branch on, as rows: a child's key depends on its parent's key and the row
alone, so no task ever holds a large node.

Three things keep large nodes from costing more than comparing all their pairs, in groups of bounded size that are
dealt over tasks. Pivots: each set of a large root child is first compared with a few of its sets, so that a family of
near copies becomes one component at once. Only pairs across components are compared after that: the sets outside a
node's largest component, with all of it. And where the children of a node would cost as much as the node itself, as
those of near copies do, the node is not branched but compared in blocks (`deal`).

Equal word sequences are joined first (by a digest of the words themselves), so trees hold one set for each text.
Candidate pairs are then confirmed on full sets. Only connectivity matters, so the pairs are asked for in rounds: at
first each set's nearest and its least-numbered candidate, then the candidates in other components, four for each
set and component, then, of the sets that had more, all that are left in other components. In the later rounds a pair is named only by the first
root child that both sets share and that is compared exhaustively, so that other trees do not repeat it; branched
ones always name what they find. No candidate is capped away: what a round leaves out the last one takes, or it lies
within one component. Components are found by alternating large-star and small-star steps over tables of edges. No
link, component or sketch of the corpus reaches the driver.

Defined cases: a document without words or text has an empty set, links with nothing and is its own component;
with fewer words than a shingle, the whole sequence is the one shingle; a null doc_id (or one that is no whole
number) is linked with nothing and has a null component; rows that share a doc_id are one document, so their texts
share a component; ties do not matter, as components do not depend on the order of links; other columns are ignored (or
carried by `deduplicate`). `deduplicate` keeps one of the rows that share both doc_id and words, and a row without doc_id
only where no document has its words, and then one for each text.
"""

from __future__ import annotations

import functools
import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common, words

POSITIONS, WIDE = 128, 1024
ROOTS, MOST_ROOTS = 32, 63  # positions that are kept for root children, and bits of a mask of them
RECALL, NODE_RECALL = 0.99999, 0.9  # of a pair at the threshold: by all trees, and by the branches of one large root child
SMALL, DEPTH, PIVOTS = 256, 8, 4
BLOCK, WORK = 4096, 1 << 20  # most sets of a block; comparisons in a node that are not worth branching
SHARD = 2 << 20
_U = np.uint64
_rng = np.random.default_rng(7_919)
MULTIPLY = _rng.integers(0, 1 << 31, WIDE, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
FLIP = _rng.integers(0, 1 << 32, WIDE, dtype=np.uint32)


def shingles(h: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text, from its words' hashes."""
    whole = np.zeros(0, _U)
    if len(h) >= k:
        whole = h[: len(h) - k + 1].copy()
        for j in range(1, k):
            whole = words.mix64(whole * _U(0x9E3779B97F4A7C15) + h[j : len(h) - k + 1 + j])
    out = []
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= k:
            out.append(np.unique(whole[a : b - k + 1]))
        elif b > a:  # the whole sequence; its length keeps it apart from longer shingles
            x = _U(b - a)
            with np.errstate(over="ignore"):
                for y in h[a:b]:
                    x = words.mix64(np.array([x * _U(0xD6E8FEB86659FD93) + y]))[0]
            out.append(np.array([x], _U))
        else:
            out.append(np.zeros(0, _U))
    return out


def minwise(sets: list[np.ndarray], positions: int = POSITIONS) -> np.ndarray:
    """Minwise values of each set; no set is empty."""
    out = np.empty((len(sets), positions), np.uint32)
    begin = 0
    while begin < len(sets):
        end, size = begin, 0
        while end < len(sets) and (end == begin or size + len(sets[end]) <= 1 << 17):
            size += len(sets[end])
            end += 1
        x = (np.concatenate(sets[begin:end]) >> _U(32)).astype(np.uint32)
        at = np.cumsum([0, *[len(s) for s in sets[begin : end - 1]]])
        for j in range(positions):
            out[begin:end, j] = np.minimum.reduceat((x ^ FLIP[j]) * MULTIPLY[j], at)
        begin = end
    return out


def sketch(low: np.ndarray) -> np.ndarray:
    """Four bits of each minwise value, packed in 8-byte words."""
    nibble = ((low * np.uint32(0x9E3779B1)) >> np.uint32(28)).astype(np.uint8)
    return np.ascontiguousarray(nibble[:, 0::2] << 4 | nibble[:, 1::2]).view(_U)


def extra(least: float) -> float:
    """The chance of a second position: a set has 1 / least children on average."""
    return min(1.0, 1 / least - 1)


def parted(least: float, levels: int) -> float:
    """The chance that a pair at the threshold shares no node `levels` below one that it shares."""
    q = 0.0
    for _ in range(levels):
        one = 1 - least + least * q
        q = one * (1 - extra(least) + extra(least) * one)
    return q


def trees(least: float) -> int:
    """How many trees bring a pair at the threshold together with the chance RECALL, if each root child that it shares does with NODE_RECALL.

    A similarity under about 0.2 asks for more root children than a mask has bits for; it raises, as recall would drop.
    """
    roots = math.log(1 - RECALL) / math.log(1 - least * NODE_RECALL)
    n = math.ceil(roots / (1 + extra(least)))
    if int(n * (1 + extra(least))) > MOST_ROOTS:
        raise ValueError(f"a similarity of {least} asks for {n} trees, more than a set's mask can name")
    return n


@functools.cache
def first_branch(least: float) -> int:
    """The first position that branches use: those before it are the root children's."""
    return max(ROOTS, len(root_picks(least)))


def repeats(least: float, levels: int) -> int:
    """How many independent branchings of a node, `levels` deep, bring a pair at the threshold together with NODE_RECALL."""
    return max(1, math.ceil(math.log(1 - NODE_RECALL) / math.log(max(parted(least, levels), 1e-9))))


def root_picks(least: float) -> list[tuple[int, int]]:
    """(tree, position) of all root children: each tree has one or two positions of its own."""
    n = trees(least)
    second = [r for r in range(n) if int((r + 1) * extra(least)) > int(r * extra(least))]
    return [(r, r) for r in range(n)] + [(r, n + i) for i, r in enumerate(second)]


def root_keys(low: np.ndarray, least: float) -> np.ndarray:
    """Keys of the children of the roots, in the order of their positions."""
    return np.stack([words.mix64(low[:, p].astype(_U) + _U((r * POSITIONS + p + 1) << 32)) for r, p in root_picks(least)], 1).view(np.int64)


def branch(key: int, rows: np.ndarray, least: float, again: int = 0) -> list[tuple[int, np.ndarray]]:
    """(child's key, places of its rows) for sketches of a node; `again` counts independent branchings of one node."""
    own = words.mix64(np.array([key], np.int64).view(_U) + _U(again << 48))
    seed = words.mix64(np.repeat(own, 2) + np.array([1, 2], _U))
    low = first_branch(least)
    spots = [low + int(seed[0] % _U(POSITIONS - low))] + ([low + int((seed[1] >> _U(8)) % _U(POSITIONS - low))] if int(seed[1] & _U(0xFF)) < 256 * extra(least) else [])
    out = []
    flat = rows.view(np.uint8)
    for p in dict.fromkeys(spots):
        token = flat[:, p // 2] >> (4 if p % 2 == 0 else 0) & 15
        for t in np.unique(token).tolist():
            child = words.mix64(own + _U(((p * 16 + t + 1) << 40) & 0xFFFFFFFFFFFFFFFF))
            out.append((int(child.view(np.int64)[0]), np.flatnonzero(token == t)))
    return out


def agreement(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How many tokens agree, for sketches along the last axis."""
    x = a ^ b
    x |= x >> _U(2)
    x |= x >> _U(1)
    x &= _U(0x1111111111111111)
    return 16 * a.shape[-1] - np.bitwise_count(x).sum(-1, dtype=np.int64)


def bar(least: float, positions: int) -> int:
    """Agreements below which a pair is not asked for: four standard deviations under those of the threshold."""
    p = least + (1 - least) / 16
    return int(positions * p - 4 * (positions * p * (1 - p)) ** 0.5)


Rows = dict[str, np.ndarray]


class Asker:
    """Gathers candidates of groups: (a, b, agreement, kind), of a kind that tells nearest (0) from least-numbered (1) ones.

    mode: "first" for each set's nearest and least, "near" for the nearest only, "top" for the four nearest in each
    other component, with a row of kind 2 for a set that has more, and "all".
    A row has: id, component, sketch, the values at root positions, the number of its root child, which root children
    of the set are branched, and its side (1 or 2 of two blocks, 3 of a node that is one group, 4 for pivots).
    """

    def __init__(self, least: float, mode: str) -> None:
        self.least, self.mode, self.out, self.held = least, mode, [], 0

    def put(self, a: np.ndarray, b: np.ndarray, s: np.ndarray, kind: int) -> None:
        if len(a):
            self.out.append(np.stack([a, b, s, np.full(len(a), kind)]))
            self.held += len(a)

    def named_here(self, x: np.ndarray, y: np.ndarray, mask: np.ndarray, root: np.ndarray) -> np.ndarray:
        """Whether `root` is branched, or the first of the others that the sets of x and y (values at root positions) share.

        mask: the branched root children of x; those that y shares are branched for y too.
        """
        branched = (mask[..., None] >> np.arange(x.shape[-1])) & 1 == 1
        return ((mask >> root) & 1 == 1) | (((x == y) & ~branched).argmax(-1) == root)

    def pairs(self, rows: Rows) -> None:
        """Groups of two sets, all at once: each array has a row for each group."""
        ids, group, sketches = rows["id"], rows["comp"], rows["sketch"]
        s = agreement(sketches[:, 0], sketches[:, 1])
        ok = (s >= bar(self.least, 16 * sketches.shape[-1])) & (ids[:, 0] != ids[:, 1]) & (group[:, 0] != group[:, 1])
        if self.mode in ("top", "all"):
            ok &= self.named_here(rows["roots"][:, 0], rows["roots"][:, 1], rows["mask"][:, 0], rows["root"][:, 0])
        a, b, s = ids[ok, 0], ids[ok, 1], s[ok]
        self.put(a, b, s, 0)
        if self.mode in ("first", "near"):
            self.put(b, a, s, 0)

    def group(self, rows: Rows) -> None:
        side, group = rows["side"], rows["comp"]
        if (group[0] == group).all():
            return
        part = lambda own: {c: x[own] for c, x in rows.items()}
        if (side == 4).any():
            self.compare(part(side == 2), part(side == 4), least_too=False)
        elif (side == 3).all():
            self.compare(rows, rows)
        else:
            one, two = part(side == 1), part(side == 2)
            self.compare(one, two)
            if self.mode != "all":
                self.compare(two, one)

    def compare(self, x: Rows, y: Rows, least_too: bool = True) -> None:
        step = max(1, (1 << 21) // max(1, len(y["id"]) * y["sketch"].shape[-1]))
        for i in range(0, len(x["id"]) if len(y["id"]) else 0, step):
            self.block({c: v[i : i + step] for c, v in x.items()}, y, least_too)

    def block(self, x: Rows, y: Rows, least_too: bool) -> None:
        """Compare some rows with all of y."""
        mine, ids, group = x["id"], y["id"], y["comp"]
        least = bar(self.least, 16 * y["sketch"].shape[-1])
        s = agreement(x["sketch"][:, None], y["sketch"][None])
        s[(mine[:, None] == ids) | (x["comp"][:, None] == group)] = -1
        if self.mode in ("first", "near"):
            r, best = np.arange(len(mine)), s.argmax(1)
            ok = s[r, best] >= least
            self.put(mine[ok], ids[best[ok]], s[r, best][ok], 0)
            if least_too and self.mode == "first":
                low = np.where(s >= least, ids[None], np.iinfo(np.int64).max).min(1)
                ok = low < mine
                self.put(mine[ok], low[ok], np.zeros(ok.sum(), np.int64), 1)
            return
        i, j = np.nonzero(s >= least)
        if self.mode == "top" and len(i):  # the four nearest of each set in each other component
            by = np.lexsort((-s[i, j], group[j], i))
            i, j = i[by], j[by]
            begins = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (group[j][1:] != group[j][:-1])])
            rank = np.arange(len(i)) - np.repeat(begins, np.diff(np.r_[begins, len(i)]))
            more = mine[np.unique(i[rank >= 4])]
            self.put(more, more, np.zeros(len(more), np.int64), 2)
            i, j = i[rank < 4], j[rank < 4]
        if len(i):
            ok = self.named_here(x["roots"][i], y["roots"][j], x["mask"][i], x["root"][i])
            i, j = i[ok], j[ok]
        self.put(mine[i], ids[j], s[i, j], 0)

    def take(self) -> np.ndarray:
        got = np.concatenate(self.out, 1) if self.out else np.zeros((4, 0), np.int64)
        self.out, self.held = [], 0
        if self.mode in ("first", "near") and got.shape[1]:  # one nearest and one least for each set
            a, b, s, kind = got
            got = got[:, np.lexsort((b, -s, kind, a))]
            got = got[:, np.r_[True, (got[0, 1:] != got[0, :-1]) | (got[3, 1:] != got[3, :-1])]]
        elif got.shape[1]:
            got[:2] = np.sort(got[:2], 0)
            got = np.unique(got, axis=1)
        return got


COLUMNS = {"key": "long", "id": "long", "comp": "long", "sketch": "binary", "roots": "binary", "root": "int", "mask": "long", "side": "int"}
NODES = ", ".join(f"{c} {t}" for c, t in COLUMNS.items())


def _rows(batch: pa.RecordBatch) -> Rows:
    """The columns of COLUMNS as arrays."""
    out = {c: batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i, c in enumerate(COLUMNS) if c not in ("sketch", "roots")}
    for i, c, kind in ((3, "sketch", _U), (4, "roots", np.uint32)):
        out[c] = np.frombuffer(b"".join(batch.column(i).to_pylist()), kind).reshape(batch.num_rows, -1)
    return out


def ask(batches: Iterator[pa.RecordBatch], least: float, mode: str) -> Iterator[pa.RecordBatch]:
    """Candidates of groups that come sorted by key."""
    asker = Asker(least, mode)
    held = None

    def groups(rows: Rows) -> None:
        key = rows["key"]
        begins = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        size = np.diff(np.r_[begins, len(key)])
        two = begins[size == 2]
        for at in range(0, len(two), 1 << 14):
            both = two[at : at + (1 << 14), None] + np.arange(2)
            asker.pairs({c: x[both] for c, x in rows.items()})
        for b, n in zip(begins[size > 2].tolist(), size[size > 2].tolist(), strict=True):
            asker.group({c: x[b : b + n] for c, x in rows.items()})

    def flush():
        got = asker.take()
        if got.shape[1]:
            yield pa.record_batch([pa.array(x) for x in got], ["a", "b", "s", "kind"])

    for batch in batches:
        if not batch.num_rows:
            continue
        now = _rows(batch)
        if held is not None:
            now = {c: np.concatenate([held[c], now[c]]) for c in COLUMNS}
        last = int(np.searchsorted(now["key"], now["key"][-1], "left"))  # the last group may go on in the next batch
        if last:
            groups({c: x[:last] for c, x in now.items()})
        held = {c: x[last:] for c, x in now.items()}
        if asker.held > 1 << 18:
            yield from flush()
    if held is not None:
        groups(held)
    yield from flush()
    words.trim()


PAIRS = "a long, b long, s long, kind long"


def stats(rows: DataFrame, *more: str) -> DataFrame:
    """A row for each key of rows(key, comp, ...) that has several components: n, main (its largest one) and minor (rows outside it)."""
    each = rows.groupBy("key", "comp", *more).agg(F.count(F.lit(1)).alias("rows"))
    whole = each.groupBy("key", *more).agg(F.max(F.struct("rows", "comp")).alias("top"), F.sum("rows").alias("n")).where("top.rows < n")
    return whole.select("key", *more, "n", F.col("top.comp").alias("main"), (F.col("n") - F.col("top.rows")).alias("minor"))


def in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    """Nodes (COLUMNS with n, main and minor) as pairs of blocks, so that every pair across components meets in one group.

    Sets outside the node's largest component lie in the first blocks, which meet all blocks; the others meet only those.
    """
    most = F.least(F.lit(block), F.greatest(F.lit(SMALL), F.ceil(F.col("n") / 4)))
    blocks = lambda rows: F.ceil(rows / most).cast("int")
    minor, major = blocks(F.col("minor")), blocks(F.col("n") - F.col("minor"))
    place = F.xxhash64("id", "key")
    inner = F.col("comp") == F.col("main")
    own = F.when(inner, minor + F.pmod(place, major)).otherwise(F.pmod(place, minor)).cast("int")
    last = F.when(inner, minor - 1).otherwise(minor + major - 1)
    dealt = nodes.withColumns({"own": own, "last": last}).select("*", F.explode(F.sequence(F.lit(0), "last")).alias("other"))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    side = F.when(lo == hi, 3).when(F.col("own") == lo, 1).otherwise(2)
    return dealt.withColumn("side", side).withColumn("key", F.xxhash64("key", lo, hi)).select(*COLUMNS)


def attach(rows: DataFrame, keys: DataFrame, salt: Column) -> DataFrame:
    """Rows whose key is in keys, with its columns; keys are broadcast only if they are few, which is counted first."""
    if keys.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        return rows.join(F.broadcast(keys), "key")
    return common.lookup(rows, keys.withColumn("__there", F.lit(True)), "key", salt).where("__there").drop("__there")


def with_pivots(nodes: DataFrame, crowds: DataFrame, block: int) -> DataFrame:
    """Nodes of crowds(key, n) in groups of near `block` rows, each with the node's PIVOTS pivots: by id, so that other trees take the same."""
    slot = F.pmod(F.xxhash64("id"), F.lit(PIVOTS))
    groups = F.ceil(F.col("n") / block).cast("int")
    own = attach(nodes, crowds, F.xxhash64("id"))
    pivots = own.groupBy("key", "n", slot.alias("slot")).agg(F.min(F.struct("id", "comp", "sketch")).alias("x"))
    pivots = pivots.select("key", F.explode(F.sequence(F.lit(0), groups - 1)).alias("part"), "x.*", F.lit(b"").alias("roots"), F.lit(0).alias("root"), F.lit(0).cast("long").alias("mask"), F.lit(4).alias("side"))
    members = own.select("key", F.pmod(F.xxhash64("id", "key"), groups).cast("int").alias("part"), "id", "comp", "sketch", "roots", "root", "mask", F.lit(2).alias("side"))
    return members.unionByName(pivots).withColumn("key", F.xxhash64("key", "part")).select(*COLUMNS)


def deal(spark: SparkSession, nodes: DataFrame, least: float, small: int = SMALL, block: int = BLOCK, work: int = WORK, named: bool = True) -> DataFrame:
    """Nodes (key, id, comp, sketch, roots, root) that have several components, as groups of bounded size.

    Small nodes are groups of their own, and larger ones become pairs of blocks. Those that take over `work`
    comparisons so are branched instead, with as many repeats as the recall of their depth asks for, unless their
    children take as many or DEPTH is reached. `named`: the mask tells which root children of a set are branched.
    """
    known = common.materialize(spark, stats(nodes), "mixed-keys")
    large, heavy = F.col("n") > small, (F.col("n") > small) & (F.col("minor") * F.col("n") > work)
    live = common.lookup(nodes, known, "key", F.xxhash64("id"), seen=nodes.select("key", "id")).where("n IS NOT NULL")
    live = common.materialize(spark, live.withColumns({"side": F.lit(3), "mask": F.lit(0).cast("long")}).select(*COLUMNS, "n", "main", "minor"), "mixed-nodes")
    out, masks = [], None
    for level in range(DEPTH + 1):
        out.append(live.where(~large).select(*COLUMNS))
        seen = known.agg(F.count_if(large).alias("large"), F.count_if(heavy).alias("heavy")).first()
        if level == DEPTH or not seen.heavy:
            if seen.large:
                out.append(in_blocks(live.where(large), block))
            break

        def expand(batches, level=level):
            for batch in batches:
                rows, n = _rows(batch), batch.column(len(COLUMNS)).to_numpy()
                parts, up = [], []
                for k in np.unique(rows["key"]).tolist():
                    own = np.flatnonzero(rows["key"] == k)
                    deep = min(DEPTH, max(1, math.ceil(math.log2(n[own[0]] / small) / 3)))
                    for again in range(1 if level else repeats(least, deep)):
                        for child, at in branch(int(k), rows["sketch"][own], least, again):
                            parts.append({c: x[own[at]] for c, x in rows.items()} | {"key": np.full(len(at), child)})
                            up.append(np.full(len(at), k))
                if parts:
                    got = {c: np.concatenate([x[c] for x in parts]) for c in COLUMNS}
                    cols = [pa.array([x.tobytes() for x in got[c]], pa.binary()) if t == "binary" else pa.array(got[c], pa.int32() if t == "int" else pa.int64()) for c, t in COLUMNS.items()]
                    yield pa.record_batch([*cols, pa.array(np.concatenate(up))], [*COLUMNS, "up"])

        children = common.materialize(spark, live.where(heavy).select(*COLUMNS, "n").mapInArrow(expand, f"{NODES}, up long"), "children")
        below = common.materialize(spark, stats(children, "up"), "children-keys")
        cost = below.groupBy(F.col("up").alias("key")).agg(F.sum(F.col("minor") * F.col("n")).alias("cost"))
        poor = known.where(heavy).join(cost, "key").where(F.col("cost") >= F.col("minor") * F.col("n")).select("key", F.lit(True).alias("poor"))
        poor = common.materialize(spark, poor, "poor-keys")
        salt = F.xxhash64("id")
        if seen.large > seen.heavy:
            out.append(in_blocks(live.where(large & ~heavy), block))
        if not poor.isEmpty():
            out.append(in_blocks(attach(live.where(heavy), poor, salt), block))
            below = below.join(poor.select(F.col("key").alias("up")), "up", "left_anti")
        if named and not level:  # root children that are branched, so that their pairs may part
            masks = common.lookup(live.where(heavy), poor, "key", salt).where("poor IS NULL").groupBy("id").agg(F.bit_or(F.expr("shiftleft(1L, root)")).alias("mask"))
            masks = common.materialize(spark, masks, "branched-roots")
        known = below.drop("up")
        live = common.materialize(spark, attach(children.drop("up"), known, salt), "branched-nodes")
    whole = out[0]
    for part in out[1:]:
        whole = whole.unionByName(part)
    if masks is None or not (n := masks.count()):
        return whole
    masks = F.broadcast(masks) if n <= common.BROADCAST_ROWS else masks
    return whole.drop("mask").join(masks, "id", "left").withColumn("mask", F.coalesce("mask", F.lit(0).cast("long"))).select(*COLUMNS)


def signatures(docs: DataFrame, k: int, least: float) -> DataFrame:
    """doc_id, seq (digest of the words), n (set size), sketch and keys of docs(doc_id, text); all but n null for an empty set."""

    def run(batches):
        lut = words.folded("space")
        for shard in words.shards(batches, "text", SHARD):
            col = shard.column("text")
            for piece, ids in zip(col.chunks, shard.column("doc_id").chunks, strict=True):
                data, off = words.buffers(piece)
                h, at = words.hashes(data, off, lut)
                sets = shingles(h, at, k)
                full = [i for i, s in enumerate(sets) if len(s)]
                n = len(sets)
                seq, rows, keys = [None] * n, [None] * n, [None] * n
                if full:
                    low = minwise([sets[i] for i in full])
                    packed, roots = sketch(low), root_keys(low, least)
                    for x, i in enumerate(full):
                        seq[i] = hashlib.blake2b(words.plain(data[off[i] : off[i + 1]].tobytes()), digest_size=16).digest()
                        rows[i], keys[i] = packed[x].tobytes(), roots[x]
                words.trim()
                yield pa.record_batch([ids, pa.array(seq, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), pa.array(rows, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "seq", "n", "sketch", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, seq binary, n long, sketch binary, keys array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """id and items (the whole set) of docs(id, text)."""

    def run(batches):
        lut = words.folded("space")
        for shard in words.shards(batches, "text", SHARD):
            for piece, ids in zip(shard.column("text").chunks, shard.column("id").chunks, strict=True):
                sets = shingles(*words.hashes(*words.buffers(piece), lut), k)
                at = np.cumsum([0, *[len(s) for s in sets]])
                items = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(np.concatenate(sets).view(np.int64) if sets else np.zeros(0, np.int64)))
                yield pa.record_batch([ids, items], ["id", "items"])
        words.trim()

    return docs.select("id", "text").mapInArrow(run, "id long, items array<long>")


def wide_sketches(sets: DataFrame, least: float) -> DataFrame:
    """id, sketch, roots and keys of sets(id, items), with WIDE positions."""

    def run(batches):
        for batch in batches:
            for begin in range(0, batch.num_rows, 256):
                part = batch.slice(begin, 256)
                col = part.column(1)
                at = np.asarray(col.offsets)
                flat = np.asarray(col.values).view(_U)
                low = minwise([flat[a:b] for a, b in zip(at[:-1], at[1:], strict=True)], WIDE)
                roots = np.ascontiguousarray(low[:, [p for _, p in root_picks(least)]])
                yield pa.record_batch([part.column(0), pa.array([x.tobytes() for x in sketch(low)], pa.binary()), pa.array([x.tobytes() for x in roots], pa.binary()), pa.array(list(root_keys(low, least)), pa.list_(pa.int64()))], ["id", "sketch", "roots", "keys"])

    return sets.select("id", "items").mapInArrow(run, "id long, sketch binary, roots binary, keys array<long>")


def asked_for(spark: SparkSession, groups: DataFrame, least: float, mode: str) -> DataFrame:
    """What `Asker` names in groups (as COLUMNS), a group in a task."""
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.select(*COLUMNS).repartition(n, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(lambda batches: ask(batches, least, mode), PAIRS)


def candidates(spark: SparkSession, groups: DataFrame, least: float, mode: str) -> DataFrame:
    """a < b: candidate pairs of ids from groups (as COLUMNS)."""
    got = asked_for(spark, groups, least, mode)
    if mode in ("first", "near"):
        one = got.groupBy("a").agg(F.max(F.when(F.col("kind") == 0, F.struct("s", (-F.col("b")).alias("b")))).alias("near"), F.min("b").alias("low"))
        got = one.select("a", F.explode(F.array(-F.col("near.b"), "low") if mode == "first" else F.array(-F.col("near.b"))).alias("b")).where("b IS NOT NULL")
    return distinct_pairs(got)


def distinct_pairs(got: DataFrame) -> DataFrame:
    return got.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs of ids (a, b) whose full sets reach the threshold: 100 * intersection >= percent * union."""
    left = common.lookup(pairs, sets.select(F.col("id").alias("a"), F.col("items").alias("xs")), "a", F.xxhash64("b"))
    both = common.lookup(left, sets.select(F.col("id").alias("b"), F.col("items").alias("ys")), "b", F.xxhash64("a"), seen=pairs)
    shared = F.size(F.array_intersect("xs", "ys")).cast("long")
    return both.where(100 * shared >= percent * (F.size("xs") + F.size("ys") - shared)).select("a", "b")


def components(spark: SparkSession, edges: DataFrame, few: int = common.BROADCAST_ROWS) -> DataFrame:
    """id and comp (the least id it reaches) of every id in edges(a, b), by alternating stars.

    The least neighbours are broadcast while the counted edges bound them to `few` rows; beyond that they are joined by
    (key, salt).
    """
    at = common.materialize(spark, edges.select("a", "b"), "edges")
    state = lambda e: e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("sum")).first()
    # most: how many nodes `low` can have, which are ends of edges
    least = lambda rows, low, on, salt, most: rows.join(F.broadcast(low), on) if most <= few else common.lookup(rows, low, on, salt)
    was = state(at)
    while was.n:
        # large star: larger neighbours of a node go to the least of node and neighbours
        both = at.unionByName(at.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = least(both, low, "a", F.xxhash64("b"), 2 * was.n).where("b > a").select(F.col("m").alias("a"), "b").where("a < b").distinct()
        large = common.materialize(spark, large, "large-star")
        # small star: smaller neighbours and the node itself go to the least of them
        low = large.groupBy("b").agg(F.min("a").alias("m"))
        own = least(large, low, "b", F.xxhash64("a"), was.n)
        small = own.select(F.col("m").alias("a"), F.col("a").alias("b")).unionByName(low.select(F.col("m").alias("a"), "b")).where("a < b").distinct()
        small = common.materialize(spark, small, "small-star")
        now = state(small)
        done, was = now == was, now
        common.drop(spark, at, large)
        at = small
        if done:
            break
    return at.select(F.col("b").alias("id"), F.col("a").alias("comp"))


def link(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80, small: int = SMALL, work: int = WORK) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every row of docs(doc_id, text); doc_id is a whole number."""
    return grouped(spark, docs, k, percent, small, work).drop("seq")


def grouped(spark: SparkSession, docs: DataFrame, k: int, percent: int, small: int = SMALL, work: int = WORK) -> DataFrame:
    """`link` with seq, the digest of the row's words (null without words)."""
    docs = docs.select(whole_id(docs).alias("doc_id"), "text")
    least = percent / 100
    sig = common.materialize(spark, signatures(docs, k, least), "signatures")
    some = sig.where("n > 0 AND doc_id IS NOT NULL")
    classes = common.materialize(spark, some.groupBy("seq").agg(F.min("doc_id").alias("id"), F.min(F.struct("sketch", "keys")).alias("x")).select("seq", "id", "x.sketch", "x.keys"), "classes")
    narrow = classes.select("id", F.col("id").alias("comp"), "sketch", F.lit(b"").alias("roots"), F.posexplode("keys").alias("root", "key"), F.lit(0).cast("long").alias("mask"), F.lit(3).alias("side"))
    crowds = common.materialize(spark, narrow.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > small), "crowds")
    few = crowds.select("key")
    n_crowds = few.count()
    brief = lambda df: F.broadcast(df) if n_crowds <= common.BROADCAST_ROWS else df
    groups, busy = narrow, None
    if n_crowds:
        busy = common.materialize(spark, narrow.join(brief(few), "key").select(*COLUMNS), "crowd-nodes")
        groups = narrow.join(brief(few), "key", "left_anti").select(*COLUMNS).unionByName(with_pivots(busy, crowds, small))
    asked = common.materialize(spark, candidates(spark, groups, least, "first"), "asked")
    shared = some.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("seq").alias("lo"), F.max("seq").alias("hi")).where("rows > 1")
    shared = common.materialize(spark, shared, "shared-ids")
    repeated = not shared.isEmpty()
    made = [asked, crowds]

    def sets_of(ids: DataFrame, name: str) -> DataFrame:
        """Full sets; of rows that share a doc_id, repeats count once."""
        ids = ids.withColumnRenamed("id", "doc_id")
        ids = F.broadcast(ids) if ids.count() <= common.BROADCAST_ROWS else ids
        sets = full_sets(docs.join(ids, "doc_id").select(F.col("doc_id").alias("id"), "text"), k)
        made.append(common.materialize(spark, sets.dropDuplicates(["id", "items"]) if repeated else sets, name))
        return made[-1]

    ends = lambda pairs: pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    active = common.materialize(spark, ends(asked), "active")
    sets = sets_of(active, "sets")
    # different texts of one doc_id belong together
    texts = some.join(shared.where("lo <> hi").select("doc_id"), "doc_id").select("doc_id", "seq").distinct().join(classes.select("seq", "id"), "seq")
    shared = texts.select(F.least("doc_id", "id").alias("a"), F.greatest("doc_id", "id").alias("b")).where("a < b").distinct()
    comps = components(spark, confirm(asked, sets, percent).unionByName(shared))
    of_comp = lambda rows: rows.drop("comp").join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))

    def joined(new: DataFrame) -> DataFrame:
        return components(spark, confirm(new, sets, percent).unionByName(comps.select(F.col("comp").alias("a"), F.col("id").alias("b"))))

    if busy is not None:  # crowds again, now across the components that their pivots made
        new = candidates(spark, deal(spark, of_comp(busy), least, small, work=work, named=False), least, "near")
        new = common.materialize(spark, new.join(asked, ["a", "b"], "left_anti"), "asked-crowds")
        made += [new, busy]
        if not new.isEmpty():
            late = common.materialize(spark, ends(new).join(active, "id", "left_anti"), "active-late")
            sets = sets.unionByName(sets_of(late, "sets-late"))
            comps = joined(new)
            asked = asked.unionByName(new)
    wide = common.materialize(spark, wide_sketches(sets, least), "wide-sketches")
    made += [active, wide]
    sketches = wide
    for mode in ("top", "all"):
        nodes = of_comp(sketches).select("id", "comp", "sketch", "roots", F.posexplode("keys").alias("root", "key"))
        named = common.materialize(spark, asked_for(spark, deal(spark, nodes, least, small, work=work), least, mode), "named")
        new = common.materialize(spark, distinct_pairs(named).join(asked, ["a", "b"], "left_anti"), "asked-more")
        made += [new, named]
        if not new.isEmpty():
            comps = joined(new)
            asked = asked.unionByName(new)
        # a pair that is not named yet was left out by both of its sets
        more = named.where("kind = 2").select(F.col("a").alias("id")).distinct()
        if more.isEmpty():
            break
        sketches = wide.join(more, "id", "left_semi")
    common.drop(spark, *made)  # what is left reads signatures, classes and components
    named = classes.select("seq", "id").join(comps, "id", "left").select("seq", F.coalesce("comp", "id").alias("comp"))
    got = common.lookup(sig.select("doc_id", "n", "seq"), named, "seq", F.xxhash64("doc_id"))
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return got.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"), F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"), "seq")


def whole_id(docs: DataFrame) -> Column:
    return F.col("doc_id").try_cast("long")


def deduplicate(spark: SparkSession, docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs without those that are not the least doc_id of their component, with the columns of docs."""
    got = common.materialize(spark, grouped(spark, docs, k, percent).select("doc_id", "kept", "seq"), "deduplicated")
    gone = common.materialize(spark, got.where(~F.col("kept")).select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    few = F.broadcast(gone) if gone.count() <= common.BROADCAST_ROWS else gone
    kept = docs.join(few, whole_id(docs) == F.col("__gone"), "left_anti")
    # rows that repeat in doc_id and words, and rows without a doc_id: mostly none, else only they are shuffled
    again = got.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("__id"))
    again = common.materialize(spark, again, "repeated")
    lost = not got.where("doc_id IS NULL").isEmpty()
    if not lost and again.isEmpty():
        return kept
    some = F.broadcast(again) if again.count() <= common.BROADCAST_ROWS else again
    plain = F.sha2(F.array_join(F.filter(F.split(common.ascii_lower(F.coalesce("text", F.lit(""))), r"[\x20\x09-\x0D]+"), lambda w: w != ""), " "), 256)
    order = W.Window.partitionBy("__id", "__plain").orderBy(*[F.col(c).cast("string") for c, t in docs.dtypes if "map" not in t and "variant" not in t])
    first = lambda rows: rows.withColumn("__row", F.row_number().over(order)).where("__row = 1").select(*docs.columns)
    marked = kept.withColumn("__id", whole_id(docs))
    once = marked.where("__id IS NOT NULL").join(some, "__id", "left_anti").select(*docs.columns)
    twice = first(marked.join(some, "__id").withColumn("__plain", plain))
    out = once.unionByName(twice)
    if not lost:
        return out
    orphans = marked.where("__id IS NULL").withColumn("__plain", plain)
    wordless = F.col("__plain") == F.sha2(F.lit("").cast("binary"), 256)
    named = docs.where(whole_id(docs).isNotNull()).select(plain.alias("__plain")).distinct()
    return out.unionByName(first(orphans.where(~wordless).join(named, "__plain", "left_anti"))).unionByName(orphans.where(wordless).select(*docs.columns))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[p:p + 2], ' ') AS s FROM w, unnest(range(1, greatest(1, len(w) - 2) + 1)) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
i AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM i JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 85 * (x.n + y.n - i)),
r(doc_id, to_id) AS (
  SELECT doc_id, doc_id FROM w
  UNION
  SELECT r.doc_id, e.b FROM r JOIN e ON r.to_id = e.a)
SELECT w.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, w.doc_id = c.component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(to_id) AS component_id FROM r GROUP BY doc_id) c USING (doc_id)
"""
