"""Log-bilinear language model over word classes, trained in NumPy by noise-contrastive estimation.

Words are counted over all learnable documents through chunk dictionaries (`chunks`). The end of a text and the `TOP` most
frequent words are classes of their own; every other word belongs to one of `ENDINGS` classes by a hash of its last bytes.
The model predicts a token's class from the two tokens before it: the prediction vector is the sum of the context classes'
vectors, each weighted component by component by its distance, and a class scores its own vector's product with that plus
a bias. Within a class a word has its share of the class's base mass, and a word never learned has the base's
probability, so that the probabilities of all known words and one unknown word sum to one.

Training. Noise comes from the classes' shares of the tokens; a batch shares its `NOISE` draws, so that scores are matrix
products. Passes over one chunk give the starting point (a documented bound: the chunk with the least number, repeated until
`START_TOKENS` are seen); then every task trains on all learnable documents it has, and the parameters and step sizes are
averaged by tokens, in groups, `ROUNDS` times. Scoring takes the distinct contexts of a chunk and normalises each over all classes by batched matrix products.

Defined cases: null texts are empty and have the end token only; a null doc_id is learned from and not held out; with
nothing to learn from every token has probability one under both; repeated rows count as often as they occur and score
alike; very long texts are a chunk of their own; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import chunks, common, words

TOP, ENDINGS, DIM, CONTEXT = 512, 256, 16, 2
CLASSES = 1 + TOP + ENDINGS  # class 0 is the end of a text
START = CLASSES  # what stands before a text, in contexts only
NOISE, BATCH, RATE, ROUNDS, SEED = 64, 1024, 0.2, 1, 1
START_TOKENS = 1_500_000  # that the starting point is trained on, its chunk repeated
SCORED = 4096  # contexts normalised at once
FAN = 32  # parameters that are averaged at once
ENDING = 3  # bytes


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 1, F.lit(False))


def cut_words(data: np.ndarray, off: np.ndarray) -> chunks.Cut:
    """The words of texts that lie one after another, A-Z lower-cased, without what is between them."""
    low = words.folded("space")[data]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = off[:-1][np.diff(off) > 0]
    first[edge] = inside[edge]
    starts = np.flatnonzero(first)
    kept = low[inside]
    at = np.append(np.cumsum(inside)[starts] - 1, len(kept)) if len(starts) else np.zeros(1, np.int64)
    return chunks.Cut(kept, at, np.searchsorted(starts, off, "left"))


def endings(pieces: pa.LargeBinaryArray) -> np.ndarray:
    """The class number, from 0, of each word's last bytes."""
    flat, at = chunks.raw(pieces)
    return (words.hash_spans(flat, np.maximum(at[:-1], at[1:] - ENDING), at[1:]) % np.uint64(ENDINGS)).astype(np.int64)


class Counted(NamedTuple):
    """What the driver knows of the corpus: a few numbers, and the classes' words and masses."""

    tokens: int
    types: int
    top: dict[bytes, int]
    shares: np.ndarray  # of the tokens, by class
    masses: np.ndarray  # sums of count + 0.5, by class

    @property
    def all_mass(self) -> float:
        return self.tokens + 0.5 * (self.types + 1)


def _buckets(spark: SparkSession, held: DataFrame) -> DataFrame:
    """For each bucket its most frequent words, its sums by class of ending, and a blob of counts, classes and places."""
    schema = pa.schema([("blob", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("top", pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int64())]))), ("ends", pa.list_(pa.struct([("n", pa.int64()), ("types", pa.int64())])))])

    def run(table: pa.Table) -> pa.Table:
        got = chunks.merge(table)
        known, end = got.counts > 0, endings(got.pieces)
        top = np.lexsort((np.arange(len(known)), -got.counts))[: TOP * 2]  # ties beyond TOP are settled by the words
        if len(top) == TOP * 2:
            top = np.flatnonzero(got.counts >= got.counts[top[TOP - 1]])
            order = sorted(top.tolist(), key=lambda i: (-got.counts[i], got.pieces[i].as_py()))
            top = np.array(order[:TOP])
        top = top[got.counts[top] > 0]
        listed = [{"word": got.pieces[i].as_py(), "n": int(got.counts[i])} for i in top.tolist()]
        n = np.bincount(end, got.counts.astype(np.float64), ENDINGS).astype(np.int64)
        types = np.bincount(end[known], minlength=ENDINGS)
        ends = [{"n": a, "types": b} for a, b in zip(n.tolist(), types.tolist(), strict=True)]
        back = [x for c, codes, places in got.chunks for x in (np.array([c]), codes, places)]
        row = {"blob": chunks.pack(got.counts, end, top, *back), "tokens": int(got.counts.sum()), "types": int(known.sum()), "top": listed, "ends": ends}
        words.trim()
        return pa.Table.from_pylist([row], schema)

    spec = "blob binary, tokens long, types long, top array<struct<word: binary, n: bigint>>, ends array<struct<n: bigint, types: bigint>>"
    rows = held.where("bucket IS NOT NULL").select("chunk", "bucket", "blob")
    return common.materialize(spark, rows.groupBy("bucket").applyInArrow(run, spec), "lm-buckets")


def _counted(buckets: DataFrame, texts: int) -> Counted:
    sums = buckets.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.coalesce(F.sum("types"), F.lit(0)).alias("types")).first()
    top = buckets.select(F.explode("top").alias("x")).select("x.*").orderBy(F.col("n").desc(), "word").limit(TOP).collect()
    n, types = np.zeros(ENDINGS, np.int64), np.zeros(ENDINGS, np.int64)
    by_end = buckets.select(F.posexplode("ends").alias("k", "x")).groupBy("k").agg(F.sum("x.n").alias("n"), F.sum("x.types").alias("types"))  # ENDINGS rows
    for r in by_end.collect():
        n[r.k], types[r.k] = r.n, r.types
    names = [bytes(r.word) for r in top]
    if names:
        own = endings(pa.array(names, pa.large_binary()))
        np.subtract.at(n, own, [r.n for r in top])
        np.subtract.at(types, own, 1)
    count = np.zeros(CLASSES, np.int64)
    kinds = np.zeros(CLASSES, np.int64)
    count[0], kinds[0] = texts, int(texts > 0)
    count[1 : 1 + len(top)], kinds[1 : 1 + len(top)] = [r.n for r in top], 1
    count[1 + TOP :], kinds[1 + TOP :] = n, types
    tokens = sums.tokens + texts
    return Counted(tokens, sums.types + int(texts > 0), {w: i + 1 for i, w in enumerate(names)}, count / max(1, tokens), count + 0.5 * kinds)


def _streams(spark: SparkSession, held: DataFrame, buckets: DataFrame, corpus: Counted) -> DataFrame:
    """A written table of chunks: docs (key, counted, n, known, base, inside) and the classes of all their tokens.

    base and inside are log10 of the base's probability, and of what the class leaves open. Classes of tokens never
    learned are -1 minus the class.
    """
    top = corpus.top

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob, listed in zip(batch.column(0), batch.column(1), strict=True):
                counts, end, heads, *back = chunks.unpack(blob.as_py())
                own = 1 + TOP + end
                for i, x in zip(heads.tolist(), listed.as_py(), strict=True):
                    own[i] = top.get(x["word"], own[i])
                for k in range(0, len(back), 3):
                    at = back[k + 2]
                    yield pa.record_batch([pa.array([int(back[k][0])]), pa.array([0], pa.int32()), pa.array([chunks.pack(back[k + 1], counts[at], own[at])], pa.binary())], ["chunk", "bucket", "blob"])

    back = buckets.select("blob", "top").mapInArrow(classes, "chunk long, bucket int, blob binary")
    back = back.select("chunk", "bucket", F.lit(None).cast(held.schema["docs"].dataType).alias("docs"), "blob")
    key = held.schema["docs"].dataType.elementType["key"].dataType
    item = pa.struct([("key", to_arrow_type(key)), ("counted", pa.bool_()), ("n", pa.int64()), ("known", pa.int64()), ("base", pa.float64()), ("inside", pa.float64())])
    schema = pa.schema([("chunk", pa.int64()), ("docs", pa.list_(item)), ("blob", pa.binary())])
    mass, masses = corpus.all_mass, corpus.masses

    def run(table: pa.Table) -> pa.Table:
        docs, codes, parts = chunks.rejoin(table)
        size = int(codes.max()) + 1 if len(codes) else 0
        count, own = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for at, c, k in parts:
            count[at], own[at] = c, k
        known = count > 0
        base = np.log10((count + 0.5) / mass)
        inside = np.where(known, np.log10((count + 0.5) / np.maximum(masses[own], 0.5)) + math.log10(max(1 - 0.5 / mass, 1e-300)), base)
        n = np.array([d["n"] for d in docs], np.int64)
        ends = np.cumsum(n)
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x[codes])])[ends], prepend=0)
        end_base = math.log10((masses[0] if masses[0] else 0.5) / mass)
        end_inside = math.log10(max(1 - 0.5 / mass, 1e-300)) if masses[0] else end_base
        stream = np.insert(np.where(known, own, -1 - own)[codes], ends, 0 if masses[0] else -1)
        rows = [{"key": d["key"], "counted": d["counted"], "n": d["n"] + 1, "known": int(k) + int(masses[0] > 0), "base": b + end_base, "inside": i + end_inside} for d, k, b, i in zip(docs, total(known.astype(np.int64)), total(base), total(inside), strict=True)]
        out = pa.Table.from_pylist([{"chunk": table.column("chunk")[0].as_py(), "docs": rows, "blob": chunks.pack(stream)}], schema)
        words.trim()
        return out

    spec = f"chunk long, docs array<struct<key: {key.simpleString()}, counted: boolean, n: bigint, known: bigint, base: double, inside: double>>, blob binary"
    got = held.where("bucket IS NULL").unionByName(back).groupBy("chunk").applyInArrow(run, spec)
    return common.materialize(spark, got, "lm-streams")


class Model:
    """The parameters (context vectors, class vectors, weights of distances, biases) and the squares of what each has moved."""

    def __init__(self, context: np.ndarray, output: np.ndarray, weight: np.ndarray, bias: np.ndarray, *moved: np.ndarray) -> None:
        self.all = [context, output, weight, bias]
        self.moved = list(moved) or [np.full_like(a, 1e-6) for a in self.all]

    @staticmethod
    def start(shares: np.ndarray) -> Model:
        rng = np.random.default_rng(SEED)
        draw = lambda n: (rng.normal(size=(n, DIM)) * 0.1).astype(np.float32)
        return Model(draw(CLASSES + 1), draw(CLASSES), np.full((CONTEXT, DIM), 0.5, np.float32), np.log(np.maximum(shares, 1e-12)).astype(np.float32))

    def blob(self) -> bytes:
        return b"".join(np.ascontiguousarray(a, np.float64).tobytes() for a in [*self.all, *self.moved])

    @staticmethod
    def of(blob: bytes | np.ndarray) -> Model:
        flat = np.frombuffer(blob, np.float64) if isinstance(blob, bytes) else blob
        out, at = [], 0
        for shape in ((CLASSES + 1, DIM), (CLASSES, DIM), (CONTEXT, DIM), (CLASSES,)) * 2:
            n = math.prod(shape)
            out.append(flat[at : at + n].reshape(shape).astype(np.float32))
            at += n
        return Model(*out)

    def predicted(self, before: np.ndarray) -> np.ndarray:
        context, _, weight, _ = self.all
        return sum(context[before[k]] * weight[k] for k in range(CONTEXT))

    def log_norm(self, before: np.ndarray, possible: np.ndarray) -> np.ndarray:
        """ln of the sum over all possible classes, for each context."""
        _, output, _, bias = self.all
        flat, bias = np.ascontiguousarray(output[possible].T), bias[possible]
        out = np.zeros(before.shape[1])
        if not len(bias):  # nothing was learned
            return out
        for i in range(0, len(out), SCORED):
            s = self.predicted(before[:, i : i + SCORED]) @ flat
            s += bias
            most = s.max(1)
            s -= most[:, None]
            np.exp(s, out=s)
            out[i : i + SCORED] = most + np.log(s.sum(1))
        return out


def contexts(stream: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The classes one and two places before each token, as rows; START before a text."""
    plain = np.where(stream < 0, -1 - stream, stream)
    place = np.arange(len(plain)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out = np.full((CONTEXT, len(plain)), START, np.int64)
    for k in range(CONTEXT):
        out[k, k + 1 :] = plain[: -k - 1]
        out[k, place <= k] = START
    return out


def _summed(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of rows by their place in 0..n."""
    at = at.astype(np.uint16)
    order = np.argsort(at, kind="stable")  # of 16 bits: a radix sort
    own = at[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
    out = np.zeros((n, rows.shape[1]), np.float32)
    out[own[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


class Trainer:
    """Noise-contrastive gradient steps with step sizes that fall with what a parameter has moved."""

    def __init__(self, model: Model, shares: np.ndarray, seed: int) -> None:
        self.model = model
        self.upto = np.cumsum(shares)
        self.noise = np.log(NOISE * np.maximum(shares, 1e-12)).astype(np.float32)
        self.rng = np.random.default_rng(seed)
        self.seen = 0

    def step(self, before: np.ndarray, own: np.ndarray) -> None:
        context, output, weight, bias = self.model.all
        drawn = np.minimum(np.searchsorted(self.upto, self.rng.random(NOISE) * self.upto[-1], "right"), CLASSES - 1)
        vectors = [context[before[k]] for k in range(CONTEXT)]
        q = sum(v * w for v, w in zip(vectors, weight, strict=True))
        mine, theirs = output[own], output[drawn]
        score = np.einsum("ij,ij->i", q, mine) + bias[own] - self.noise[own]
        noise = q @ theirs.T + (bias[drawn] - self.noise[drawn])
        up = 1 / (1 + np.exp(np.minimum(score, 30)))
        down = -1 / (1 + np.exp(np.minimum(-noise, 30)))
        g_q = up[:, None] * mine + down @ theirs
        g_out = _summed(own, up[:, None] * q, CLASSES)
        np.add.at(g_out, drawn, down.T @ q)
        g_bias = np.bincount(own, up, CLASSES).astype(np.float32)
        np.add.at(g_bias, drawn, down.sum(0))
        g_context = sum(_summed(before[k], g_q * weight[k], CLASSES + 1) for k in range(CONTEXT))
        g_weight = np.stack([(g_q * v).sum(0) for v in vectors])
        for a, g, moved in zip(self.model.all, (g_context, g_out, g_weight, g_bias), self.model.moved, strict=True):
            g /= math.sqrt(len(own))
            moved += g * g
            a += RATE * g / np.sqrt(moved)
        self.seen += len(own)

    def learn(self, stream: np.ndarray, lengths: np.ndarray, counted: np.ndarray) -> None:
        """One pass over the counted documents of a chunk."""
        keep = np.repeat(counted, lengths)
        before, own = contexts(stream, lengths)[:, keep], stream[keep]
        for i in range(0, len(own), BATCH):
            self.step(before[:, i : i + BATCH], own[i : i + BATCH])


def _chunk(row_docs: pa.Scalar, blob: pa.Scalar) -> tuple[pa.StructArray, np.ndarray, np.ndarray]:
    docs = row_docs.values
    return docs, chunks.unpack(blob.as_py())[0], docs.field("n").to_numpy(zero_copy_only=False)


def _trained(spark: SparkSession, streams: DataFrame, model: Model, shares: np.ndarray, name: str, least: int = 1) -> Model:
    """The parameters after every task's pass over its chunks, averaged by the tokens they have seen; each chunk is repeated until `least` are seen."""
    held = spark.sparkContext.broadcast((model.blob(), shares))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, own_shares = held.value
        part = TaskContext.get().partitionId()
        own = Trainer(Model.of(blob), own_shares, part)
        for batch in batches:
            for row_docs, codes in zip(batch.column(0), batch.column(1), strict=True):
                docs, stream, lengths = _chunk(row_docs, codes)
                counted, upto = docs.field("counted").to_numpy(zero_copy_only=False).astype(bool), own.seen + least
                while own.seen < upto and counted.any():
                    own.learn(stream, lengths, counted)
        if own.seen:
            flat = np.frombuffer(own.model.blob()) * own.seen
            yield pa.record_batch([pa.array([part], pa.int64()), pa.array([own.seen], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "params"])

    def add(table: pa.Table) -> pa.Table:
        flat = sum(np.frombuffer(b.as_py()) for b in table.column("params"))
        return pa.table([table.column("part").slice(0, 1), pa.array([sum(table.column("n").to_pylist())], pa.int64()), pa.array([flat.tobytes()], pa.binary())], ["part", "n", "params"])

    spec = "part long, n long, params binary"
    rows = common.materialize(spark, streams.select("docs", "blob").mapInArrow(run, spec), name)
    n = rows.count()
    while n > FAN:
        n = -(-n // FAN)
        rows = rows.withColumn("part", F.pmod("part", F.lit(n))).groupBy("part").applyInArrow(add, spec)
    got = rows.collect()  # at most FAN rows
    if not got:
        return model
    return Model.of(sum(np.frombuffer(bytes(r.params)) for r in got) / sum(r.n for r in got))


class Fitted(NamedTuple):
    model: Model
    corpus: Counted
    streams: DataFrame


def fit(spark: SparkSession, docs: DataFrame) -> Fitted:
    """The model, the corpus's counts, and all documents as streams of classes."""
    ready = docs.select(F.col("doc_id").alias("key"), (~held_out(F.col("doc_id"))).alias("counted"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    first = ready.agg(F.coalesce(F.sum(F.col("counted").cast("long")), F.lit(0)).alias("texts"), F.sum(F.octet_length("text")).alias("bytes")).first()
    held = chunks.split(spark, ready, cut_words, "lm", max(1, -(-(first.bytes or 0) // chunks.BUCKET)))
    buckets = _buckets(spark, held)
    corpus = _counted(buckets, first.texts)
    streams = _streams(spark, held, buckets, corpus)
    model = Model.start(corpus.shares)
    least = streams.agg(F.min("chunk").alias("c")).first().c
    if least is not None:
        model = _trained(spark, streams.where(F.col("chunk") == least), model, corpus.shares, "lm-start", START_TOKENS)
    for _ in range(ROUNDS):
        model = _trained(spark, streams, model, corpus.shares, "lm-round")
    return Fitted(model, corpus, streams)


def scores(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    fitted = fit(spark, docs)
    held = spark.sparkContext.broadcast((fitted.model.blob(), fitted.corpus.masses > 0))
    tokens = fitted.corpus.tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blob, possible = held.value
        model = Model.of(blob)
        _, output, _, bias = model.all
        for batch in batches:
            for row_docs, codes in zip(batch.column(0), batch.column(1), strict=True):
                docs, stream, lengths = _chunk(row_docs, codes)
                before = contexts(stream, lengths)
                key, where = np.unique(before[0] * (CLASSES + 1) + before[1], return_inverse=True)
                norm = model.log_norm(np.stack([key // (CLASSES + 1), key % (CLASSES + 1)]), possible)
                own = np.zeros(len(stream))
                for i in range(0, len(stream), 1 << 16):
                    at = slice(i, i + (1 << 16))
                    y = np.maximum(stream[at], 0)
                    s = np.einsum("ij,ij->i", model.predicted(before[:, at]), output[y]) + bias[y] - norm[where[at]]
                    own[at] = np.where(stream[at] >= 0, s / math.log(10), 0)
                model_part = np.add.reduceat(own, np.cumsum(lengths) - lengths) if len(lengths) else np.zeros(0)
                counted = docs.field("counted").to_numpy(zero_copy_only=False)
                score = docs.field("inside").to_numpy() + model_part
                yield pa.record_batch([docs.field("key"), pa.array(~counted.astype(bool)), docs.field("n"), docs.field("known"), pa.array(np.full(len(lengths), tokens, np.int64)), docs.field("base"), pa.array(score)], ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            words.trim()

    key = docs.schema["doc_id"].dataType.simpleString()
    return fitted.streams.select("docs", "blob").mapInArrow(run, f"doc_id {key}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
