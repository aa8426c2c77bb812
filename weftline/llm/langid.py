"""Language identification by the nearest of several centroids per language.

A text is a vector of hashed byte 2- and 3-grams (lower-cased, everything that is not a letter taken as space),
square root of counts times inverse document frequency, of unit length. Each language has `clusters` centroids,
found by spherical k-means over a bounded sample of labelled documents; a text gets the language of the centroid
with the largest cosine, which is its score. A text is rejected when it has no letter, or when its cosine is below
its language's floor for its size: cosines grow with the number of distinct n-grams, so sizes are told apart by powers
of two. A floor is `reject` times the cosine that all but `QUANTILE` of the learnable texts of that language and size
exceed, rounded down to BINS steps; floors never fall with size, and a size with fewer than 1 / QUANTILE texts has the
floor of the next smaller one, or `reject` times the lowest cosine of its language where none has as many (of any
language, if the size is below SHORT), so that short clean texts, whose cosines are low, stay.

Centroids are fitted on about `fit_rows` documents in all (a documented bound: those with the smallest hashes of id and
text, so the sample does not depend on how the table is cut; of repeated rows one counts; of more languages than that,
one text each or so); floors are counted over all learnable rows, and prediction covers whole texts of all rows.
Noise and foreign texts go where they share fewer n-grams with every learned language than its own texts of that size
do. What is labelled as a language is learned as that language, junk too; a foreign text of a few words may pass.

Defined cases: null texts and texts without a letter give `und`, score 0 and rejected; rows without a label are
predicted but not learned from; with nothing to learn from, all is `und`; a null doc_id is not held out and not
learned from; repeated rows get equal results; other columns are ignored or, in `keep_known`, carried.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import words

DIM = 4096
BLOCK_DOCS, BLOCK_BYTES = 128, 1 << 20
SIZES, BINS, QUANTILE = 13, 256, 0.01
SHORT = 6  # sizes below, some 35 letters, are held to the lowest cosine of any language
PIECE = 1000  # texts that are Python strings at a time
LETTER = regex.compile(r"\p{L}")


def _lut() -> np.ndarray:
    lut = np.full(256, 32, np.uint8)
    lut[97:123] = np.arange(97, 123)
    lut[128:] = np.arange(128, 256)
    return lut


def blocks(texts: Sequence[str | None]):
    """Bounds of runs of texts that are counted together."""
    begin = size = 0
    for i, t in enumerate(texts):
        n = len(t or "")
        if i > begin and (i - begin >= BLOCK_DOCS or size + n > BLOCK_BYTES):
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def counts(texts: Sequence[str | None]) -> np.ndarray:
    """Counts of hashed 2- and 3-grams: a row of DIM for each text."""
    raw = [b" " + (t or "").lower().encode("utf-8", "replace") + b" " for t in texts]
    out = np.zeros((len(raw), DIM), np.float32)
    lut = _lut()
    whole = lut[np.frombuffer(b"".join(raw), np.uint8)]
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    keep = np.ones(len(whole), bool)
    keep[1:] = (whole[1:] != 32) | (whole[:-1] != 32) | (doc[1:] != doc[:-1])
    b, doc = whole[keep].astype(np.uint32), doc[keep]
    for begin in range(0, len(b), BLOCK_BYTES):  # a very long text is counted piece by piece
        x, d = b[begin : begin + BLOCK_BYTES + 2], doc[begin : begin + BLOCK_BYTES + 2]
        n = min(BLOCK_BYTES, len(b) - begin)
        low, total = int(d[0]), int(d[-1]) - int(d[0]) + 1
        for order, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
            m = min(n, len(x) - order + 1)
            if m <= 0:
                continue
            code = x[:m].copy()
            for k in range(1, order):
                code = (code << np.uint32(8)) | x[k : k + m]
            bucket = ((code * np.uint32(salt)) >> np.uint32(20)).astype(np.int64)
            ok = d[:m] == d[order - 1 : order - 1 + m]
            out[low : low + total] += np.bincount((d[:m][ok] - low) * DIM + bucket[ok], minlength=total * DIM).reshape(total, DIM)
    return out


def vectors(raw: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.sqrt(raw) * idf
    return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-12)


def has_letter(text: str | None) -> bool:
    return bool(text and LETTER.search(text))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def k_means(x: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from a farthest-first start: reruns agree."""
    picked = [int(np.argmax(x @ x.mean(0)))]
    near = x @ x[picked[0]]
    while len(picked) < min(k, len(x)):
        picked.append(int(np.argmin(near)))
        near = np.maximum(near, x @ x[picked[-1]])
    c = x[picked]
    for _ in range(rounds):
        own = np.argmax(x @ c.T, 1)
        c = np.stack([x[own == j].sum(0) if (own == j).any() else c[j] for j in range(len(c))])
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c


def fit(spark: SparkSession, docs: DataFrame, clusters: int = 4, fit_rows: int = 6000, reject: float = 0.5) -> dict:
    """Centroids of the languages in docs(doc_id, text, lang); held-out rows are never read for it."""
    rows = docs.select("doc_id", "text", "lang").where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    totals = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    each = max(1, fit_rows // max(1, len(totals)))
    share = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, min(1.0, each / n))]) if totals else None
    got: dict[str, list] = {}
    if totals:
        spread = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), "text"), F.lit(1 << 30)) / F.lit(float(1 << 30))

        def sparse(batches):
            for batch in batches:
                texts = batch.column(0).to_pylist()
                for i, j in blocks(texts):
                    own = [n for n in range(i, j) if has_letter(texts[n])]
                    if own:
                        c = counts([texts[n] for n in own]).astype(np.uint32)
                        ids = [np.flatnonzero(r).astype(np.uint16) for r in c]
                        yield pa.record_batch([pa.array([batch.column(1)[n].as_py() for n in own]), pa.array([x.tobytes() for x in ids], pa.binary()), pa.array([r[x].tobytes() for r, x in zip(c, ids, strict=True)], pa.binary())], ["lang", "ids", "counts"])

        for r in rows.where(spread < share[F.col("lang")]).dropDuplicates(["doc_id", "text", "lang"]).select("text", "lang").mapInArrow(sparse, "lang string, ids binary, counts binary").collect():
            got.setdefault(r.lang, []).append((bytes(r.ids), bytes(r["counts"])))
    langs = sorted(got)
    df = np.zeros(DIM)
    for k in langs:
        got[k].sort()  # the order of tasks must not matter
        for ids, _ in got[k]:
            df[np.frombuffer(ids, np.uint16)] += 1
    idf = (np.log((1 + sum(map(len, got.values()))) / (1 + df)) + 1).astype(np.float32)
    centroids, owner = [], []
    for i, k in enumerate(langs):
        x = np.zeros((len(got[k]), DIM), np.float32)  # one language at a time: the driver holds few dense rows
        for row, (ids, n) in zip(x, got.pop(k), strict=True):
            row[np.frombuffer(ids, np.uint16)] = np.frombuffer(n, np.uint32)
        c = k_means(vectors(x, idf), clusters)
        centroids.append(c)
        owner += [i] * len(c)
    model = {"langs": langs, "idf": idf, "centroids": np.concatenate(centroids) if langs else np.zeros((0, DIM), np.float32), "owner": np.array(owner, int), "floors": np.zeros((len(langs), SIZES))}
    return {**model, "floors": reject * lows(spark, rows, model)}


def lows(spark: SparkSession, rows: DataFrame, model: dict) -> np.ndarray:
    """For each language and size the cosine that all but QUANTILE of its rows(text, lang) exceed that are predicted as it."""
    out = np.zeros((len(model["langs"]), SIZES))
    if not model["langs"]:
        return out
    cells = classify(spark, rows.select("text", "lang"), model).where(F.col("__found.lang") == F.col("lang")).select("lang", F.col("__found.size").alias("size"), F.floor(F.col("__found.score") * BINS).alias("bin"))
    counted = cells.groupBy("lang", "size", "bin").agg(F.count(F.lit(1)).alias("n"))
    own = W.Window.partitionBy("lang", "size")
    upto, whole = F.sum("n").over(own.orderBy("bin")), F.sum("n").over(own)
    low = counted.withColumn("upto", upto).withColumn("whole", whole).groupBy("lang", "size").agg(F.min(F.when(F.col("upto") > QUANTILE * F.col("whole"), F.col("bin"))).alias("bin"), F.min("bin").alias("least"), F.max("whole").alias("n"))
    at = {k: i for i, k in enumerate(model["langs"])}
    least = np.full(len(at), BINS)
    for r in low.collect():
        least[at[r.lang]] = min(least[at[r.lang]], r.least)
        if r.n >= 1 / QUANTILE:
            out[at[r.lang], r["size"]] = r.bin / BINS
    seen = np.where(out > 0, out, np.inf)
    seen = np.minimum.accumulate(seen[:, ::-1], 1)[:, ::-1]  # a size is held to no more than any larger one
    base = np.repeat(np.where(least < BINS, least, 0)[:, None] / BINS, SIZES, 1)
    base[:, :SHORT] = base.min()
    return np.maximum.accumulate(np.maximum(np.where(out > 0, seen, 0), base), 1)


def predict(texts: Sequence[str | None], model: dict) -> tuple[list[str], list[float], list[bool]]:
    """Language, score and whether it is rejected, of each text."""
    return measured(texts, model)[:3]


def measured(texts: Sequence[str | None], model: dict) -> tuple[list[str], list[float], list[bool], list[int]]:
    """As `predict`, with the size: the number of distinct n-grams as a power of two."""
    langs, scores, gone, sizes = ["und"] * len(texts), [0.0] * len(texts), [True] * len(texts), [0] * len(texts)
    if not model["langs"]:
        return langs, scores, gone, sizes
    for i, j in blocks(texts):
        own = [n for n in range(i, j) if has_letter(texts[n])]
        if own:
            raw = counts([texts[n] for n in own])
            size = np.log2(np.maximum(np.count_nonzero(raw, axis=1), 1)).astype(int)
            cos = vectors(raw, model["idf"]) @ model["centroids"].T
            best = cos.argmax(1)
            for n, k, s, z in zip(own, best, cos[np.arange(len(own)), best], size.tolist(), strict=True):
                at = model["owner"][k]
                langs[n], scores[n], sizes[n] = model["langs"][at], float(min(1.0, max(0.0, s))), z
                gone[n] = bool(scores[n] < model["floors"][at, z])
    return langs, scores, gone, sizes


def classify(spark: SparkSession, docs: DataFrame, model: dict) -> DataFrame:
    """docs(text, ...) with __found: lang, score, rejected and size. Only the texts go to Python, and only the struct comes back."""
    fitted = spark.sparkContext.broadcast(model)

    def found(texts: pa.Array) -> pa.Array:
        out: tuple[list, ...] = ([], [], [], [])
        for begin in range(0, len(texts), PIECE):
            for held, new in zip(out, measured(texts.slice(begin, PIECE).to_pylist(), fitted.value), strict=True):
                held += new
        words.trim()
        return pa.StructArray.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.string(), pa.float64(), pa.bool_(), pa.int32()), strict=True)], ["lang", "score", "rejected", "size"])

    # non-deterministic in name only, so that a filter on its result does not run it twice
    return docs.withColumn("__found", F.arrow_udf(found, "lang string, score double, rejected boolean, size int").asNondeterministic()(F.col("text")))


def identify(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score and rejected for every row."""
    return classify(spark, docs.select("doc_id", "text"), fit(spark, docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("__found.lang").alias("lang_pred"), F.col("__found.score").alias("score"), F.col("__found.rejected").alias("rejected"))


def keep_known(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without rejected rows, with the columns of docs."""
    return classify(spark, docs, fit(spark, docs)).where(~F.col("__found.rejected")).select(*docs.columns)
