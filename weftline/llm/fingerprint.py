"""Document fingerprints: quartile bucket digests of byte triplets.

The byte triplets of a text are hashed into 512 buckets. A digest holds one byte for the length (on a log scale)
and two bits a bucket: in which quartile of all bucket counts its count lies. Two digests are compared by a
difference score: 0, 1, 2 or 6 for a bucket whose quartiles differ by 0 to 3, plus LENGTH_COST for each step of
length, bounded by the score that unrelated digests have on average; likeness is 1 less the share of that bound.

`neighbours` hands every document its successor in doc_id order with one shuffle of the texts: cut points of the
ids split the table into ranges, the first document of a range is sent to the range before as well, and each
range is read in order.

Defined cases: a null text counts as empty, and an empty text has the digest of no triplet; texts of one or two
bytes have none either but keep their length; rows that share a doc_id are ordered by text; null ids come last;
a single document is its own successor; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BUCKETS = 512
STEP = np.array([0, 1, 2, 6], np.int64)
LENGTH_COST = 8
#: Mean score of independent digests: 26 / 16 for a bucket.
BOUND = 26 / 16 * BUCKETS
BLOCK_DOCS, BLOCK_BYTES = 512, 4 << 20


def length_code(n: int) -> int:
    """0 for empty, then one step for each factor of 1.2."""
    return 0 if n == 0 else min(255, 1 + int(math.log(n) / math.log(1.2)))


def triplet_counts(raw: Sequence[bytes]) -> np.ndarray:
    """Counts of hashed triplets: a row for each text."""
    out = np.zeros((len(raw), BUCKETS), np.int64)
    data = np.frombuffer(b"".join(raw), np.uint8)
    doc = np.repeat(np.arange(len(raw)), [len(r) for r in raw])
    for begin in range(0, len(data) - 2, BLOCK_BYTES):
        b = data[begin : begin + BLOCK_BYTES + 2].astype(np.uint32)
        d = doc[begin : begin + BLOCK_BYTES + 2]
        x = (b[:-2] << np.uint32(16)) | (b[1:-1] << np.uint32(8)) | b[2:]
        x = x * np.uint32(0x9E3779B1)
        x = (x ^ (x >> np.uint32(15))) * np.uint32(0x85EBCA6B)
        bucket = (x >> np.uint32(23)).astype(np.int64)
        ok = d[:-2] == d[2:]
        low, total = int(d[0]), int(d[-1]) - int(d[0]) + 1
        out[low : low + total] += np.bincount((d[:-2][ok] - low) * BUCKETS + bucket[ok], minlength=total * BUCKETS).reshape(total, BUCKETS)
    return out


def quartiles(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The quartile (0 to 3) of each bucket and the length code of each text."""
    codes, lengths = [], []
    held: list[bytes] = []
    size = 0

    def flush() -> None:
        nonlocal held, size
        if held:
            c = triplet_counts(held)
            q = np.partition(c, [BUCKETS // 4 - 1, BUCKETS // 2 - 1, 3 * BUCKETS // 4 - 1], axis=1)
            codes.append(sum((c > q[:, [k * BUCKETS // 4 - 1]]).astype(np.uint8) for k in (1, 2, 3)))
            held, size = [], 0

    for t in texts:
        held.append(t.encode("utf-8", "surrogatepass"))
        lengths.append(length_code(len(held[-1])))
        size += len(held[-1])
        if len(held) >= BLOCK_DOCS or size >= BLOCK_BYTES:
            flush()
    flush()
    return np.concatenate(codes) if codes else np.zeros((0, BUCKETS), np.uint8), np.array(lengths, np.int64)


def encode(codes: np.ndarray, lengths: np.ndarray) -> list[str]:
    """Hexadecimal digests: the length byte, then four buckets a byte."""
    packed = (codes[:, 0::4] << 6) | (codes[:, 1::4] << 4) | (codes[:, 2::4] << 2) | codes[:, 3::4]
    return [f"{n:02x}{row.tobytes().hex()}" for n, row in zip(lengths.tolist(), packed.astype(np.uint8), strict=True)]


def decode(digest: str) -> tuple[np.ndarray, int]:
    raw = np.frombuffer(bytes.fromhex(digest), np.uint8)
    return np.stack([raw[1:] >> 6, raw[1:] >> 4 & 3, raw[1:] >> 2 & 3, raw[1:] & 3], 1).reshape(-1), int(raw[0])


def likeness(a: np.ndarray, b: np.ndarray, a_len: np.ndarray, b_len: np.ndarray) -> np.ndarray:
    score = STEP[np.abs(a.astype(np.int8) - b.astype(np.int8))].sum(1) + LENGTH_COST * np.abs(a_len - b_len)
    return 1 - np.minimum(score, BOUND) / BOUND


def compare(a: str, b: str) -> float:
    """Likeness of two digests, from 0 to 1."""
    (x, n), (y, m) = decode(a), decode(b)
    return float(likeness(x[None], y[None], np.array([n]), np.array([m]))[0])


def edited(text: str, after: str) -> str:
    """text with its last half replaced by as many code points from the start of the next text."""
    half = len(text) // 2
    return text[: len(text) - half] + after[:half]


def neighbours(spark: SparkSession, docs: DataFrame, run, schema: str) -> DataFrame:
    """run(ids, texts, nexts) -> Arrow batch, over docs(doc_id, text) in doc_id order; texts are never null."""
    n = max(1, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    shares = [k / n for k in range(1, n)]
    cuts = docs.agg(F.percentile_approx("doc_id", shares, 20 * n).alias("c")).first().c if shares else None
    cuts = sorted(set(cuts or []))
    steps = [1 << k for k in reversed(range(max(1, len(cuts)).bit_length()))]
    if cuts:  # the number of cut points at or below the id, by binary search
        at = F.lit(cuts)
        part = F.aggregate(F.lit(steps), F.lit(0), lambda p, s: F.when(F.try_element_at(at, p + s) <= F.col("doc_id"), p + s).otherwise(p))
        part = F.when(F.col("doc_id").isNull(), F.lit(len(cuts))).otherwise(part)
    else:
        part = F.lit(0)
    placed = docs.withColumn("part", part.cast("int"))
    heads = placed.groupBy("part").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id")).alias("head")).orderBy("part").collect()
    before = [(r.part, heads[i - 1].part, r["head"].doc_id) for i, r in enumerate(heads)]
    ends = spark.createDataFrame(before, f"part int, before int, first {docs.schema['doc_id'].dataType.simpleString()}")
    copies = F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(F.struct("part", F.lit(0).alias("guest")), F.struct(F.col("before").alias("part"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct("part", F.lit(0).alias("guest"))))
    sent = placed.join(F.broadcast(ends), "part").select("doc_id", "text", F.explode(copies).alias("to")).select("doc_id", "text", "to.part", "to.guest")
    dealt = sent.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "guest", F.col("doc_id").asc_nulls_last(), "text")

    def read(batches):
        held: tuple | None = None  # the last row, which waits for its successor
        guest_seen = False
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1).to_pylist()
            guests = batch.column(3).to_pylist()
            own = guests.index(1) if 1 in guests else len(guests)
            take = own + (own < len(guests) and not guest_seen)
            if guest_seen or not take:
                continue
            guest_seen = own < len(guests)
            rows = ([held] if held else []) + [(ids[i], texts[i]) for i in range(take)]
            held = None if guest_seen else rows[-1]
            if len(rows) > 1:
                yield run(pa.array([r[0].as_py() for r in rows[:-1]], ids.type), [r[1] for r in rows[:-1]], [r[1] for r in rows[1:]])

    return dealt.mapInArrow(read, schema)


def digest(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """A row a document: its fingerprint, that of its edited text, and how near its own is to that and to the next one's."""

    def run(ids, texts, nexts):
        changed = [edited(t, n) for t, n in zip(texts, nexts, strict=True)]
        a, a_len = quartiles([*texts, nexts[-1]])
        e, e_len = quartiles(changed)
        own, own_len = a[:-1], a_len[:-1]
        sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed]
        return pa.record_batch([ids, pa.array([len(t) for t in texts], pa.int64()), pa.array(sha), pa.array(encode(own, own_len)), pa.array(encode(e, e_len)), pa.array(likeness(own, e, own_len, e_len)), pa.array(likeness(own, a[1:], own_len, a_len[1:]))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return neighbours(spark, docs, run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every document, without a shuffle."""

    def run(batches):
        for batch in batches:
            yield pa.record_batch([batch.column(0), pa.array(encode(*quartiles([t or "" for t in batch.column(1).to_pylist()])))], ["doc_id", "fingerprint"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")
