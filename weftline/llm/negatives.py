"""Hard negatives by a vantage-point tree over norm-augmented vectors.

A vector x gets one more component, sqrt(M2 - |x|2) where M2 is the largest squared norm of the table; a query gets 0
there. Then the squared distance of a query q to x is |q|2 + M2 - 2 q.x: the nearest rows are those of the highest
scores, and a window of scores is an annulus of distances.

The top of the tree is fitted on a sample of at most `SAMPLE` rows (those with the smallest hashes; a bound, as the
number of leaves follows the table up to half of it) and every row is indexed: it goes down to a leaf, leaves are cut
into blocks of about `BLOCK` rows by a hash, so that thousands of copies are several blocks, and each block is a
vantage-point tree of its own in one row of the written index. A leaf's least and greatest distances to the vantage
points above it are taken over all its rows, so bounds hold for each of them.

A query visits its nearest leaf first; what it finds there bounds the other leaves that it visits, all at once. Inside
a block the tree's nodes are visited nearest first, within the annulus, until k rows of the wanted label are found that
no later node can beat. Nothing is approximate: bounds have a slack for rounding, and scores are whole numbers.

Defined cases: rows with a null label, a null vector, or any null or non-finite component take no part; equal rows count
once; rows that share a vec_id are rows of their own, and "other" means another id or vector; a null vec_id is last
among ties; vectors of different lengths are compared as if zeros were added; components beyond `MOST` after scaling
count as that, so that scores fit a long (for up to 2047 components); an empty vector scores 0; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import chunks, common

SAMPLE, LEAVES, BLOCK, NODE = 2048, 1024, 1024, 128
QUERIES = 512  # that go to a block together
MOST = 1 << 26
SLACK = 1e-6  # of the largest norm
NO_ID = np.iinfo(np.int64).max


def prepared(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, label, x (floor of scale times each component) of the rows that take part, equal rows once."""
    good = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v.cast("double")) & (F.abs(v.cast("double")) < float("inf")))
    x = F.transform("embedding", lambda v: F.greatest(F.lit(-MOST), F.least(F.lit(MOST), F.floor(v.cast("double") * scale))).cast("int"))
    label = F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(10))).otherwise(F.col("label"))
    return vectors.where(F.col("label").isNotNull() & F.col("embedding").isNotNull() & good).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x")).distinct()


def matrix(col: pa.Array, dim: int) -> np.ndarray:
    """Vectors as rows of one length, zeros added."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    n = np.diff(np.frombuffer(col.buffers()[1], np.int32)[col.offset : col.offset + len(col) + 1]) if len(col) else np.zeros(0, np.int64)
    flat = col.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    if len(n) and (n == dim).all():
        return flat.reshape(len(n), dim)
    out = np.zeros((len(n), dim), np.int64)
    out[np.repeat(np.arange(len(n)), n), np.arange(len(flat)) - np.repeat(np.cumsum(n) - n, n)] = flat
    return out


def exact(x: np.ndarray, m2: int) -> np.ndarray:
    """As doubles, which multiply faster, where all products of the table are exact in them."""
    return x.astype(np.float64) if m2 < 1 << 52 else x


def augmented(x: np.ndarray, m2: int) -> np.ndarray:
    own = x.astype(np.float64)
    return np.column_stack([own, np.sqrt(np.maximum(0.0, float(m2) - (own * own).sum(1)))])


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of rows of a to rows of b."""
    return np.sqrt(np.maximum(0.0, (a * a).sum(1)[:, None] + (b * b).sum(1) - 2 * (a @ b.T)))


class Tree:
    """Nodes with parents before children: the parent, the vantage row of the parent, least and greatest distance of the node's rows to it, and the node's run of rows."""

    def __init__(self, parent, vantage, low, high, begin, end, leaf) -> None:
        self.parent, self.vantage, self.low, self.high, self.begin, self.end, self.leaf = (np.asarray(a) for a in (parent, vantage, low, high, begin, end, leaf))

    @staticmethod
    def build(points: np.ndarray, most: int, leaves: int) -> tuple[Tree, np.ndarray]:
        """The tree and the order in which its nodes hold the points. Nodes of at most `most` points, or at the depth of `leaves`, are leaves."""
        order = np.arange(len(points))
        nodes = [[-1, -1, 0.0, np.inf, 0, len(points), True]]
        todo = [(0, 0)]
        depth_most = max(0, int(np.ceil(np.log2(max(1, leaves)))))
        while todo:
            k, depth = todo.pop()
            b, e = nodes[k][4], nodes[k][5]
            if e - b <= most or depth >= depth_most:
                continue
            own = order[b:e]
            from_first = distances(points[own], points[own[:1]])[:, 0]
            v = own[int(np.argmax(from_first))]
            d = distances(points[own], points[v : v + 1])[:, 0]
            by = np.argsort(d, kind="stable")
            order[b:e], d = own[by], d[by]
            m = (e - b) // 2
            nodes[k][6] = False
            for lo, hi in ((0, m), (m, e - b)):
                todo.append((len(nodes), depth + 1))
                nodes.append([k, v, d[lo], d[hi - 1], b + lo, b + hi, True])
        place = np.empty(len(points), np.int64)
        place[order] = np.arange(len(points))
        cols = list(zip(*nodes, strict=True))
        cols[1] = [int(place[v]) if v >= 0 else -1 for v in cols[1]]
        return Tree(*cols), order

    def bounds(self, to_vantage: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distances of queries to the rows of each node; to_vantage has the columns that `columns` names."""
        low, high = np.zeros((len(to_vantage), len(self.parent))), np.full((len(to_vantage), len(self.parent)), np.inf)
        at = {int(v): i for i, v in enumerate(columns)}
        for k in range(1, len(self.parent)):
            p, d = self.parent[k], to_vantage[:, at[int(self.vantage[k])]]
            low[:, k] = np.maximum(low[:, p], np.maximum(d - self.high[k], self.low[k] - d))
            high[:, k] = np.minimum(high[:, p], d + self.high[k])
        return low, high


class Top:
    """The tree's top: vantage points (augmented) and, once all rows are in their leaves, the bounds of its nodes."""

    def __init__(self, sample: np.ndarray, m2: int, leaves: int) -> None:
        points = augmented(sample, m2)
        tree, order = Tree.build(points, 1, leaves)
        self.points, self.m2 = points[order], m2
        self.tree = tree
        self.columns = np.unique(tree.vantage[1:])
        self.leaves = np.flatnonzero(tree.leaf)

    def leaf_of(self, x: np.ndarray) -> np.ndarray:
        """The leaf's number for each row: at each node the half whose distances to the vantage point are nearer."""
        points, t = augmented(x, self.m2), self.tree
        at = np.zeros(len(x), np.int64)
        children = {int(p): np.flatnonzero(t.parent == p) for p in np.flatnonzero(~t.leaf)}
        for p, (near, far) in children.items():  # parents before children
            here = np.flatnonzero(at == p)
            if len(here):
                d = distances(points[here], self.points[t.vantage[near]][None])[:, 0]
                at[here] = np.where(d <= (t.high[near] + t.low[far]) / 2, near, far)
        return at

    def path(self, leaf: int) -> list[int]:
        out = [leaf]
        while self.tree.parent[out[-1]] > 0:
            out.append(int(self.tree.parent[out[-1]]))
        return out if leaf else []

    def reach(self, x: np.ndarray, leaf: int) -> list[tuple[int, float, float]]:
        """For each node from the leaf up: its number, the least and greatest distance of the rows to its vantage point."""
        points, out = augmented(x, self.m2), []
        for node in self.path(leaf):
            d = distances(points, self.points[self.tree.vantage[node]][None])[:, 0]
            out.append((node, float(d.min()), float(d.max())))
        return out


class Block:
    """Rows of one block in the order of its tree."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, tree: Tree, m2: int) -> None:
        self.ids, self.labels, self.tree, self.m2 = ids, labels, tree, m2
        self.x = exact(x, m2)
        self.square = (self.x * self.x).sum(1)
        self.columns = np.unique(tree.vantage[1:])
        self.leaves = np.flatnonzero(tree.leaf)

    @staticmethod
    def pack(ids: np.ndarray, labels: np.ndarray, x: np.ndarray, m2: int) -> bytes:
        tree, order = Tree.build(augmented(x, m2), NODE, 1 << 30)
        ends = np.concatenate([tree.low, tree.high]).astype(np.float64).tobytes()
        return chunks.pack(ids[order], labels[order], x[order].ravel(), tree.parent, tree.vantage, tree.begin, tree.end, tree.leaf.astype(np.int64), ends)

    @staticmethod
    def unpack(blob: bytes, dim: int, m2: int) -> Block:
        ids, labels, x, parent, vantage, begin, end, leaf, ends = chunks.unpack(blob)
        low, high = np.frombuffer(ends).reshape(2, -1)
        return Block(ids, labels, x.reshape(len(ids), dim), Tree(parent, vantage, low, high, begin, end, leaf > 0), m2)

    def search(self, q: np.ndarray, label: np.ndarray, same: bool, low: np.ndarray, high: np.ndarray, k: int, own_id: np.ndarray) -> list[list[tuple[int, int]]]:
        """For each query its first k (-score, id) with low <= score <= high and the same or another label, the query's own row left out."""
        q = q.astype(self.x.dtype)
        square = (q * q).sum(1)
        far = lambda s, square=square: np.sqrt(np.maximum(0.0, square + float(self.m2) - 2.0 * s))
        lower, upper = self.tree.bounds(far_to(q, self.x[self.columns], square, self.m2), self.columns)
        slack = SLACK * max(1.0, float(self.m2) ** 0.5)
        bound, inner = far(low) + slack, far(high) - slack
        order = self.leaves[np.argsort(lower[:, self.leaves], axis=1, kind="stable")]
        none = self.x.dtype.type(-(2**63 - 1))  # below every score
        best, best_id = np.full((len(q), k), none), np.full((len(q), k), NO_ID)
        every = np.arange(len(q))
        # all queries take their t-th nearest node together, those of one node by one product
        for t in range(order.shape[1]):
            node_of = order[:, t]
            live = lower[every, node_of] <= bound
            if not live.any():
                break
            live &= upper[every, node_of] >= inner
            for node in np.unique(node_of[live]).tolist():
                own = np.flatnonzero(live & (node_of == node))
                at = slice(self.tree.begin[node], self.tree.end[node])
                s = q[own] @ self.x[at].T
                fit = (s >= low[own, None]) & (s <= high[own, None]) & ((self.labels[at] == label[own, None]) == same)
                if same:
                    fit &= ~((self.ids[at] == own_id[own, None]) & (s == square[own, None]) & (self.square[at] == square[own, None]))
                s = np.where(fit, s, none)
                most = s.max(1)
                hit = (most > none) & (most >= best[own, -1])
                own, s = own[hit], s[hit]
                if not len(own):
                    continue
                both, ids = np.concatenate([best[own], s], 1), np.concatenate([best_id[own], np.broadcast_to(self.ids[at], s.shape)], 1)
                pick = np.lexsort((ids, -both), axis=1)[:, :k]
                best[own], best_id[own] = np.take_along_axis(both, pick, 1), np.take_along_axis(ids, pick, 1)
                full = own[best[own, -1] > none]
                bound[full] = np.minimum(bound[full], far(best[full, -1], square[full]) + slack)
        return [[(-int(s), int(i)) for s, i in zip(a, b, strict=True) if s > none] for a, b in zip(best.tolist(), best_id.tolist(), strict=True)]


def far_to(q: np.ndarray, x: np.ndarray, square: np.ndarray, m2: int) -> np.ndarray:
    """Distances of queries to augmented rows, from their scores."""
    return np.sqrt(np.maximum(0.0, square[:, None] + float(m2) - 2.0 * (q @ x.T)))


class Index:
    """All rows in blocks: a written table (leaf, block, blob), the top of the tree, and the sizes."""

    def __init__(self, spark: SparkSession, rows: DataFrame) -> None:
        """rows: a written table of vec_id, label, x."""
        self.spark = spark
        square = F.aggregate("x", F.lit(0).cast("long"), lambda a, v: a + v.cast("long") * v.cast("long"))
        got = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(square), F.lit(0)).alias("m2"), F.coalesce(F.max(F.size("x")), F.lit(0)).alias("dim")).first()
        self.m2, self.dim, dim, m2 = got.m2, got.dim, got.dim, got.m2
        sample = rows.orderBy(F.xxhash64("vec_id", "x"), "vec_id").limit(SAMPLE).select("x").toArrow()
        leaves = min(LEAVES, max(1, len(sample) // 2), 1 << max(0, (got.n // BLOCK).bit_length()))
        self.top = top = Top(matrix(sample.column(0), dim), m2, leaves if len(sample) else 1)
        held = spark.sparkContext.broadcast(top)

        def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                leaf = held.value.leaf_of(matrix(batch.column(2), dim))
                yield pa.record_batch([*batch.columns, pa.array(leaf.astype(np.int32))], ["vec_id", "label", "x", "leaf"])

        placed = rows.select("vec_id", "label", "x").mapInArrow(down, "vec_id long, label long, x array<int>, leaf int")
        sizes = placed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))  # at most LEAVES rows
        cut = placed.join(F.broadcast(sizes), "leaf").withColumn("block", F.pmod(F.xxhash64("vec_id", "x"), F.col("blocks")).cast("int"))
        schema = pa.schema([("leaf", pa.int32()), ("block", pa.int32()), ("blob", pa.binary()), ("reach", pa.list_(pa.struct([("node", pa.int64()), ("low", pa.float64()), ("high", pa.float64())])))])

        def build(table: pa.Table) -> pa.Table:
            ids = np.array([NO_ID if i is None else i for i in table.column("vec_id").to_pylist()], np.int64)
            x = matrix(table.column("x"), dim)
            leaf = table.column("leaf")[0].as_py()
            reach = [dict(zip(("node", "low", "high"), r, strict=True)) for r in held.value.reach(x, leaf)]
            return pa.Table.from_pylist([{"leaf": leaf, "block": table.column("block")[0].as_py(), "blob": Block.pack(ids, table.column("label").to_numpy(), x, m2), "reach": reach}], schema)

        spec = "leaf int, block int, blob binary, reach array<struct<node: bigint, low: double, high: double>>"
        made = cut.select("leaf", "block", "vec_id", "label", "x").groupBy("leaf", "block").applyInArrow(build, spec)
        made = common.materialize(spark, made, "negatives-index")
        self.blocks = made.select("leaf", "block", "blob")
        reach = made.select(F.explode("reach").alias("r")).groupBy("r.node").agg(F.min("r.low").alias("low"), F.max("r.high").alias("high"))
        top.tree.low, top.tree.high = np.full(len(top.tree.parent), np.inf), np.full(len(top.tree.parent), -np.inf)  # a node without rows is out of reach
        for r in reach.collect():  # at most a row for each node of the top
            top.tree.low[r.node], top.tree.high[r.node] = r.low, r.high
        self._top = spark.sparkContext.broadcast(top)

    def _route(self, queries: DataFrame, k: int, first: bool) -> DataFrame:
        """leaf, q and the query, for the query's nearest leaf or for all others within reach of low and high."""
        held, dim, m2 = self._top, self.dim, self.m2
        names = queries.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = held.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                q = matrix(batch.column(names.index("x")), dim)
                points = np.column_stack([q.astype(np.float64), np.zeros(len(q))])
                square = (points * points).sum(1)
                low, high = (batch.column(names.index(c)).to_numpy().astype(np.float64) for c in ("low", "high"))
                slack = SLACK * max(1.0, float(m2) ** 0.5)
                outer, inner = (np.sqrt(np.maximum(0.0, square + m2 - 2 * s)) for s in (low, high))
                lower, upper = top.tree.bounds(distances(points, top.points[top.columns]), top.columns)
                lower, upper = lower[:, top.leaves], upper[:, top.leaves]
                inside = (lower <= outer[:, None] + slack) & (upper >= inner[:, None] - slack)
                nearest = np.where(inside, np.maximum(lower, inner[:, None]), np.inf).argmin(1)
                only = np.zeros_like(inside)
                only[np.arange(len(q)), nearest] = True
                at, leaf = np.nonzero(inside & only if first else inside & ~only)
                yield pa.record_batch([*batch.take(pa.array(at)).columns, pa.array(top.leaves[leaf].astype(np.int32))], [*names, "leaf"])

        return queries.mapInArrow(run, f"{queries_spec(queries)}, leaf int")

    def _visit(self, routed: DataFrame, same: bool, k: int) -> DataFrame:
        """q, score, id of the first k in each block that a query visits."""
        dim, m2 = self.dim, self.m2
        sized = routed.groupBy("leaf").agg(F.ceil(F.count(F.lit(1)) / QUERIES).cast("int").alias("parts"))  # at most LEAVES rows
        cut = routed.join(F.broadcast(sized), "leaf").withColumn("part", F.pmod(F.xxhash64("q"), F.col("parts")))
        packed = cut.groupBy("leaf", "part").agg(F.collect_list(F.struct("q", "own", "label", "x", "low", "high")).alias("queries"))
        both = self.blocks.join(packed, "leaf").select("queries", "blob")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for listed, blob in zip(batch.column(0), batch.column(1), strict=True):
                    qs, block = listed.values, Block.unpack(blob.as_py(), dim, m2)
                    col = lambda c, qs=qs: qs.field(c).to_numpy(zero_copy_only=False)
                    found = block.search(matrix(qs.field("x"), dim), col("label"), same, col("low"), col("high"), k, col("own"))
                    n = [len(f) for f in found]
                    flat = np.array([x for f in found for x in f], np.int64).reshape(-1, 2)
                    yield pa.record_batch([pa.array(np.repeat(col("q"), n)), pa.array(-flat[:, 0]), pa.array(flat[:, 1])], ["q", "score", "id"])

        return both.mapInArrow(run, "q long, score long, id long")

    def nearest(self, queries: DataFrame, same: bool, k: int) -> DataFrame:
        """q, rank (from 1), id, score: the first k rows of the same or another label with low <= score <= high, by falling score and rising id.

        queries: a written table of q (unique), own (the query's vec_id), label, x, low, high.
        """
        order = W.Window.partitionBy("q").orderBy(F.col("score").desc(), "id")
        best = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        first = common.materialize(self.spark, best(self._visit(self._route(queries, k, True), same, k)), "negatives-first")
        beaten = first.where(F.col("rank") == k).select("q", F.col("score").alias("__kth"))  # a row for a query
        rest = queries.join(beaten, "q", "left").withColumn("low", F.greatest("low", F.coalesce("__kth", "low"))).drop("__kth")
        more = self._visit(self._route(rest, k, False), same, k)
        return best(first.drop("rank").unionByName(more))


def queries_spec(df: DataFrame) -> str:
    return ", ".join(f"{c} {t}" for c, t in df.dtypes)


def mine(spark: SparkSession, vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 5, floor: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Anchors are rows whose vec_id `every` divides. Negatives score at least floor[0] / floor[1] of the positive's score
    and at most the positive's.
    """
    rows = common.materialize(spark, prepared(vectors), "negatives-rows")
    index = Index(spark, rows)
    low, high = F.lit(-(1 << 62)).cast("long"), F.lit(1 << 62).cast("long")
    anchors = rows.where(F.col("vec_id") % every == 0).select(F.monotonically_increasing_id().alias("q"), F.col("vec_id").alias("own"), "label", "x", low.alias("low"), high.alias("high"))
    anchors = common.materialize(spark, anchors, "negatives-anchors")
    good = index.nearest(anchors, True, positives).select(F.col("q").alias("a"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    least = F.ceil(F.col("positive_score").cast("decimal(38,0)") * floor[0] / floor[1]).cast("long")
    asked = good.where("positive_score >= 0").join(anchors.select(F.col("q").alias("a"), "own", "label", "x"), "a")
    asked = asked.select(F.monotonically_increasing_id().alias("q"), "own", "label", "x", least.alias("low"), F.col("positive_score").alias("high"), "positive_id")
    asked = common.materialize(spark, asked, "negatives-windows")
    bad = index.nearest(asked.drop("positive_id"), False, negatives)
    out = bad.join(asked.select("q", "own", "positive_id", F.col("high").alias("positive_score")), "q")
    no_id = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(F.col("own").alias("anchor_id"), no_id("positive_id").alias("positive_id"), F.col("rank").cast("int").alias("rank"), no_id("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


SQL = """WITH v AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, v.vec_id AS id, v.label = a.label AS same, list_inner_product(a.x, v.x)::BIGINT AS score
  FROM v AS a JOIN v ON a.vec_id % 100 = 0 AND v.vec_id <> a.vec_id),
p AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) AS r FROM s WHERE same) WHERE r <= 5),
n AS (
  SELECT p.anchor_id, p.id AS positive_id, s.id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.anchor_id, p.id ORDER BY s.score DESC, s.id) AS rank
  FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 80 * p.score <= 100 * s.score AND s.score <= p.score)
SELECT anchor_id, positive_id, rank::INTEGER AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 5"""
