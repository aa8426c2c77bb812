"""Boosted trees on bags of words: each split is found from sums of gradients by (node, feature, bin).

A row has a label 0 or 1 and a map from features to bins over 0; a feature that it lacks has bin 0. Trees are grown level
by level for the logistic loss. Rows are written once as blocks of some thousands, which hold for each (feature, bin) the places of its rows.
In a level a task walks its blocks, adds up the gradients in arrays, and returns one row for each node, feature and bin, so what is
shuffled grows with the features and tasks, not with the rows; bin 0 is what the node's sum leaves. What reaches the driver
is the best split of each node, at most 2 ** depth rows. A tree is an expression over the map, so rows are neither joined nor moved.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from weftline import storage

#: Rows and entries of a block at most (a row alone may have more entries; places in a block have 16 bits).
BLOCK_ROWS, BLOCK_ENTRIES = 16_384, 1 << 20

#: Sums that a task holds before it returns them, and rows of a batch that it returns.
HELD_SUMS, BATCH_ROWS = 1 << 20, 100_000

#: Trees that each pass goes through; then their sum is written into the blocks.
HELD_TREES = 20

BLOCK = "y binary, base binary, features array<string>, bins array<int>, ends array<long>, places binary"


@dataclass(frozen=True)
class Tree:
    """Inner nodes (feature, bin: rows with at most this bin go left) and leaves (weights); the children of node k are 2 k + 1 and 2 k + 2."""

    splits: dict[int, tuple[str, int]]
    weights: dict[int, float]

    def node(self, bag: str) -> Column:
        """The number of the leaf that a row comes to."""

        def at(k: int) -> Column:
            if k not in self.splits:
                return F.lit(k)
            feature, most = self.splits[k]
            return F.when(F.coalesce(F.try_element_at(bag, F.lit(feature)), F.lit(0)) <= most, at(2 * k + 1)).otherwise(at(2 * k + 2))

        return at(0)

    def weight(self, bag: str) -> Column:
        def at(k: int) -> Column:
            if k not in self.splits:
                return F.lit(self.weights.get(k, 0.0))
            feature, most = self.splits[k]
            return F.when(F.coalesce(F.try_element_at(bag, F.lit(feature)), F.lit(0)) <= most, at(2 * k + 1)).otherwise(at(2 * k + 2))

        return at(0)


def bags(docs: DataFrame, words: Column, features: int = 500, bins: int = 4, doc: str = "doc_id", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc, the columns of `keep` and bag (feature to min(count, bins - 1)) over the words that most rows have, ties by word; one row for each of docs.

    The words of a row are counted in its row, so only the words' numbers of rows are shuffled; the features go to all tasks.
    """
    df = docs.select(F.array_distinct(words).alias("w")).mapInArrow(_counted, "word string, n long").where("word IS NOT NULL").groupBy("word").agg(F.sum("n").alias("df"))
    top = [r.word for r in df.orderBy(F.col("df").desc(), "word").limit(features).collect()]  # at most `features` rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pa.array(top, pa.string())
        width = max(1, len(top))
        for batch in batches:
            col = batch.column(batch.num_columns - 1)
            sizes = pc.fill_null(pc.list_value_length(col), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = col.flatten().dictionary_encode()
            feature = pc.index_in(coded.dictionary, value_set=known).take(coded.indices).fill_null(-1).to_numpy(zero_copy_only=False)
            own = feature >= 0
            key, n = np.unique(np.repeat(np.arange(len(sizes)), sizes)[own] * width + feature[own], return_counts=True)
            ends = np.concatenate([[0], np.cumsum(np.bincount(key // width, minlength=len(sizes)))])
            bag = pa.MapArray.from_arrays(pa.array(ends, pa.int32()), known.take(pa.array(key % width)), pa.array(np.minimum(n, bins - 1), pa.int32()))
            yield pa.record_batch([*batch.columns[:-1], bag], [*batch.schema.names[:-1], "bag"])

    rows = docs.select(F.col(doc).alias("doc"), *keep, words.alias("bag"))
    return rows.mapInArrow(run, f"{', '.join(f'`{c}` {t}' for c, t in rows.dtypes[:-1])}, bag map<string,int>")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """word and n: how many rows of a batch have a word, from lists of distinct words."""
    for batch in batches:
        got = pc.value_counts(batch.column(0).flatten())
        for i in range(0, len(got), BATCH_ROWS):
            yield pa.record_batch(got.slice(i, BATCH_ROWS).flatten(), ["word", "n"])


class _Block:
    """Rows with the places of each (feature, bin), as `_blocks` writes them."""

    def __init__(self, row: dict) -> None:
        self.y, self.base, self.places = np.frombuffer(row["y"]), np.frombuffer(row["base"]), np.frombuffer(row["places"], np.uint16)
        self.pairs = list(zip(row["features"], row["bins"], strict=True))
        self.ends = np.array([0, *row["ends"]], np.int64)
        self.of: dict[str, list[int]] = {}
        for i, (feature, _) in enumerate(self.pairs):
            self.of.setdefault(feature, []).append(i)

    def node(self, tree: Tree) -> np.ndarray:
        """The node that each row comes to."""
        out = np.zeros(len(self.y), np.int64)
        for k in sorted(tree.splits):  # parents come before their children
            feature, most = tree.splits[k]
            right = np.zeros(len(self.y), np.int64)
            for i in self.of.get(feature, ()):
                if self.pairs[i][1] > most:
                    right[self.places[self.ends[i] : self.ends[i + 1]]] = 1
            out = np.where(out == k, 2 * k + 1 + right, out)
        return out

    def score(self, trees: list[Tree]) -> np.ndarray:
        out = self.base.copy()
        for t in trees:
            weights = np.zeros(max(t.weights, default=0) + 1)
            weights[list(t.weights)] = list(t.weights.values())
            out += weights[self.node(t)]
        return out

    def slopes(self, trees: list[Tree]) -> tuple[np.ndarray, np.ndarray]:
        """First and second derivatives of the loss by each row's score."""
        p = 1 / (1 + np.exp(-self.score(trees)))
        return p - self.y, p * (1 - p)

    def sums(self, values: np.ndarray, node: np.ndarray, width: int) -> np.ndarray:
        """Sums of a value of rows by (feature, bin) and node; those of node `width` are left out."""
        pair = np.repeat(np.arange(len(self.pairs)) * (width + 1), np.diff(self.ends))
        return np.bincount(pair + node[self.places], values[self.places], len(self.pairs) * (width + 1)).reshape(-1, width + 1)[:, :width]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[_Block]:
    for batch in batches:
        for i in range(len(batch)):
            yield _Block(batch.slice(i, 1).to_pylist()[0])


def _cut(y: np.ndarray, bag: pa.MapArray) -> Iterator[dict]:
    """Rows of `BLOCK` with a score of 0, of the labels and bags of a batch in its order."""
    offsets = bag.offsets.to_numpy().astype(np.int64)
    begin = 0
    while begin < len(y):
        end = min(max(int(np.searchsorted(offsets, offsets[begin] + BLOCK_ENTRIES, "right")) - 1, begin + 1), begin + BLOCK_ROWS, len(y))
        low, n = offsets[begin], offsets[end] - offsets[begin]
        coded = bag.keys.slice(low, n).dictionary_encode()
        bins = pc.fill_null(bag.items.slice(low, n), 0).to_numpy(zero_copy_only=False)
        key = (coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) << 32) + bins
        place = np.repeat(np.arange(end - begin, dtype=np.uint16), np.diff(offsets[begin : end + 1]))
        key, place = key[bins > 0], place[bins > 0]
        order = np.argsort(key, kind="stable")
        pair, size = np.unique(key[order], return_counts=True)
        yield {
            "y": y[begin:end].astype(float).tobytes(), "base": np.zeros(end - begin).tobytes(), "features": coded.dictionary.take(pa.array(pair >> 32)).to_pylist(),
            "bins": (pair & 0xFFFFFFFF).tolist(), "ends": np.cumsum(size).tolist(), "places": place[order].tobytes(),
        }
        begin = end


def _blocks(rows: DataFrame) -> DataFrame:
    """Blocks of rows(label, bag) with a score of 0."""
    kinds = pa.schema([("y", pa.binary()), ("base", pa.binary()), ("features", pa.list_(pa.string())), ("bins", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("places", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in _cut(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                yield pa.RecordBatch.from_pylist([block], kinds)

    own = rows.select(F.col("label").cast("double").alias("y"), _bag_of("bag")).where("y IS NOT NULL")
    return own.mapInArrow(run, BLOCK)


def _bag_of(bag: str) -> Column:
    """The map, empty where it is null."""
    return F.coalesce(F.col(bag), F.create_map().cast("map<string,int>")).alias("bag")


def _scored(blocks: DataFrame, trees: list[Tree]) -> DataFrame:
    """The blocks with the trees' sum added to their rows' scores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base = pa.array([b.score(trees).tobytes() for b in _read(iter([batch]))], pa.binary())
            yield pa.record_batch([base if name == "base" else c for name, c in zip(batch.schema.names, batch.columns, strict=True)], batch.schema.names)

    return blocks.mapInArrow(run, BLOCK)


def _totals(blocks: DataFrame, trees: list[Tree]) -> tuple[float, float] | None:
    """Sums of g and h of all rows, none if there are no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _read(batches):
            g, h = block.slopes(trees)
            yield pa.record_batch([pa.array([g.sum()]), pa.array([h.sum()])], ["g", "h"])

    got = blocks.mapInArrow(run, "g double, h double").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).first()
    return None if got.g is None else (got.g, got.h)


def _sums(blocks: DataFrame, trees: list[Tree], tree: Tree, nodes: list[int]) -> DataFrame:
    """node, feature, bin, g and h: each task's sums over the rows that come to one of `nodes`."""
    width = len(nodes)
    names = ["node", "feature", "bin", "g", "h"]

    def told(at: dict[tuple[str, int], int], sums: np.ndarray) -> Iterator[pa.RecordBatch]:
        pairs = list(at)
        pair, node = np.nonzero((sums != 0).any(axis=0))
        for i in range(0, len(pair), BATCH_ROWS):
            p, k = pair[i : i + BATCH_ROWS], node[i : i + BATCH_ROWS]
            yield pa.record_batch([pa.array(np.array(nodes, np.int32)[k]), pa.array([pairs[j][0] for j in p], pa.string()), pa.array([pairs[j][1] for j in p], pa.int32()), pa.array(sums[0, p, k]), pa.array(sums[1, p, k])], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.full(2 * max(nodes) + 3, width)  # the number of each node; all others are left out
        own[nodes] = np.arange(width)
        at: dict[tuple[str, int], int] = {}
        sums = np.zeros((2, 0, width))
        for block in _read(batches):
            node = own[block.node(tree)]
            for pair in block.pairs:
                at.setdefault(pair, len(at))
            sums = np.concatenate([sums, np.zeros((2, len(at) - sums.shape[1], width))], axis=1)
            to = np.fromiter((at[p] for p in block.pairs), np.int64, len(block.pairs))
            for i, values in enumerate(block.slopes(trees)):
                sums[i, to] += block.sums(values, node, width)
            if sums.size > HELD_SUMS:
                yield from told(at, sums)
                at, sums = {}, np.zeros((2, 0, width))
        yield from told(at, sums)

    return blocks.mapInArrow(run, "node int, feature string, bin int, g double, h double")


def _best_splits(sums: DataFrame, totals: dict[int, tuple[float, float]], reg: float, least: float) -> list[tuple[int, str, int, float, float]]:
    """(node, feature, bin, g and h of its right side) of the split with the largest gain over 0 of each node; ties by feature, then bin.

    `totals` are the sums of g and h of each node. Each side must have a sum of h of at least `least`.
    """
    sums = sums.repartition("node", "feature").groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
    down = W.Window.partitionBy("node", "feature").orderBy(F.col("bin").desc())
    over = down.rowsBetween(W.Window.unboundedPreceding, 0)
    tg, th = (F.create_map(*[F.lit(v) for node, both in totals.items() for v in (node, both[i])])[F.col("node")] for i in range(2))
    right = sums.select("node", "feature", F.coalesce(F.lead("bin").over(down), F.lit(0)).alias("most"), F.sum("g").over(over).alias("rg"), F.sum("h").over(over).alias("rh"), tg.alias("tg"), th.alias("th"))
    part = lambda g, h: g * g / (h + reg)
    lg, lh = F.col("tg") - F.col("rg"), F.col("th") - F.col("rh")
    gain = part(lg, lh) + part(F.col("rg"), F.col("rh")) - part(F.col("tg"), F.col("th"))
    ok = right.withColumn("gain", F.round(gain, 9)).where((lh >= least) & (F.col("rh") >= least) & (F.col("gain") > 0))
    best = ok.groupBy("node").agg(F.min(F.struct((-F.col("gain")).alias("g"), "feature", "most", "rg", "rh")).alias("b"))
    return [(r.node, r.b.feature, r.b.most, r.b.rg, r.b.rh) for r in best.collect()]


def fit(rows: DataFrame, rounds: int = 10, depth: int = 3, rate: float = 0.3, reg: float = 1.0, least: float = 0.1) -> list[Tree]:
    """Trees for rows(label, bag), one after another; the score of a row is the sum of its weights, from 0. Rows without a label are left out."""
    blocks = storage.materialize(_blocks(rows), "blocks")
    trees: list[Tree] = []
    held = 0  # trees whose sum is in the blocks
    for _ in range(rounds):
        if len(trees) - held == HELD_TREES:
            blocks, held = storage.materialize(_scored(blocks, trees[held:]), "blocks"), len(trees)
        root = _totals(blocks, trees[held:])
        if root is None:
            trees.append(Tree({}, {}))
            continue
        splits, ends, nodes = {}, {0: root}, [0]
        for _ in range(depth):
            found = _best_splits(_sums(blocks, trees[held:], Tree(splits, {}), nodes), {k: ends[k] for k in nodes}, reg, least)
            if not found:
                break
            nodes = []
            for k, feature, most, rg, rh in sorted(found):
                g, h = ends.pop(k)
                splits = splits | {k: (feature, most)}
                ends |= {2 * k + 1: (g - rg, h - rh), 2 * k + 2: (rg, rh)}
                nodes += [2 * k + 1, 2 * k + 2]
        trees.append(Tree(splits, {k: -rate * g / (h + reg) for k, (g, h) in ends.items()}))
    return trees


def score(trees: list[Tree], bag: str = "bag") -> Column:
    """The log odds of label 1."""
    out = F.lit(0.0)
    for t in trees:
        out = out + t.weight(bag)
    return out


def scores(rows: DataFrame, trees: list[Tree], keep: tuple[str, ...]) -> DataFrame:
    """The columns of `keep` and score, as `score` gives it, of rows with a bag; a task goes through the trees with a block at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [_Block(b).score(trees) for b in _cut(np.zeros(len(batch)), batch.column(len(keep)))]
            yield pa.record_batch([*batch.columns[:-1], pa.array(np.concatenate([np.zeros(0), *got]))], [*keep, "score"])

    own = rows.select(*keep, _bag_of("bag"))
    return own.mapInArrow(run, f"{', '.join(f'`{c}` {t}' for c, t in own.dtypes[:-1])}, score double")
