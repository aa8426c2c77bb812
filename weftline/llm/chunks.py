"""Chunk dictionaries: what belongs to every distinct piece of all texts, without a row for each occurrence.

Texts are cut into pieces (words, or segments with their white space) and gathered into chunks of about `CHUNK` bytes.
A chunk keeps its documents as codes into a dictionary of its own distinct pieces, so the corpus is cut once. The
dictionaries go, packed by a hash of the piece into buckets, to where each distinct piece of the corpus is seen once, and
what was found for it goes back to the chunks that have it. A piece that makes up a third of all occurrences is one entry
for each chunk. Buckets are as many as the corpus has `BUCKET` bytes, so that chunks and buckets are of bounded size at
any size of the corpus; a single text longer than a chunk is a chunk of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import common, words

CHUNK, BUCKET = 8 << 20, 8 << 20


def pack(*arrays: np.ndarray | bytes) -> bytes:
    """Whole numbers and bytes in one compressed blob; numbers lie by their bytes' places, as high bytes are mostly zero."""
    parts, head = [], []
    for a in arrays:
        if isinstance(a, bytes):
            parts.append(a)
            head += [1, len(a)]
        else:
            a = np.asarray(a, np.int64)
            size = next(s for s in (1, 2, 4, 8) if s == 8 or not len(a) or (a.min() >= -(1 << 8 * s - 1) and a.max() < 1 << 8 * s - 1))
            parts.append(a.astype(f"<i{size}").view(np.uint8).reshape(-1, size).T.tobytes())
            head += [-size, len(a)]
    raw = np.array([len(arrays), *head], "<i8").tobytes() + b"".join(parts)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray | bytes]:
    raw = pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8).reshape(n, 2).tolist()
    out, at = [], 8 + 16 * n
    for kind, length in head:
        size = length * abs(kind)
        own = raw[at : at + size]
        out.append(own if kind == 1 else np.frombuffer(own, np.uint8).reshape(-kind, length).T.copy().view(f"<i{-kind}").ravel().astype(np.int64))
        at += size
    return out


def strings(data: np.ndarray | bytes, at: np.ndarray) -> pa.LargeBinaryArray:
    """The pieces data[at[i]:at[i+1]] as an Arrow array."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(np.ascontiguousarray(at, np.int64)), pa.py_buffer(data)])


def raw(pieces: pa.LargeBinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow array's pieces, and their offsets."""
    off = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
    held = pieces.buffers()[2]
    data = np.frombuffer(held, np.uint8)[off[0] : off[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, off - off[0]


class Cut(NamedTuple):
    """Pieces of texts that lie one after another: their bytes, their offsets, and how many pieces lie before each text."""

    data: np.ndarray
    at: np.ndarray
    before: np.ndarray


def buckets_for(docs: DataFrame, text: str = "text") -> int:
    total = docs.agg(F.sum(F.octet_length(text)).alias("n")).first().n or 0
    return max(1, -(-total // BUCKET))


def split(spark: SparkSession, docs: DataFrame, cut: Callable[[np.ndarray, np.ndarray], Cut], name: str, buckets: int) -> DataFrame:
    """A written table of chunks and their dictionaries, from docs(key, counted, text).

    chunk, bucket, docs (key, counted, n pieces of each document), blob: where bucket is null the codes of the chunk's
    pieces, else of the dictionary's entries in the bucket the codes, lengths, counts within counted documents, and bytes.
    """
    key = docs.schema["key"].dataType
    listed = pa.list_(pa.struct([("key", to_arrow_type(key)), ("counted", pa.bool_()), ("n", pa.int64())]))
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("docs", listed), ("blob", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, k = TaskContext.get().partitionId(), 0
        for table in words.shards(batches, "text", CHUNK):
            chunk = task << 32 | k
            k += 1
            col = table.column("text")
            data, off = words.buffers(col.chunk(0) if col.num_chunks == 1 else pa.concat_arrays(col.chunks))
            got = cut(data, off)
            n = np.diff(got.before)
            flags = table.column("counted").to_pylist()
            own = [{"key": a, "counted": bool(b), "n": c} for a, b, c in zip(table.column("key").to_pylist(), flags, n.tolist(), strict=True)]
            enc = strings(got.data, got.at).dictionary_encode()
            index, pieces = enc.indices.to_numpy(), enc.dictionary
            # codes by falling frequency: small numbers pack better
            often = np.argsort(-np.bincount(index, minlength=len(pieces)), kind="stable")
            code = np.empty(len(pieces), np.int64)
            code[often] = np.arange(len(pieces))
            counted = np.bincount(index[np.repeat(np.array(flags, bool), n)], minlength=len(pieces))
            rows = [(chunk, None, own, pack(code[index]))]
            if len(pieces):
                flat, at = raw(pieces)
                hashed = words.hash_pieces(flat, at)
                to = (hashed % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(to, kind="stable")
                flat, at = raw(pieces.take(pa.array(order)))
                edges = np.flatnonzero(np.diff(to[order], prepend=-1, append=buckets))
                for lo, hi in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
                    mine = order[lo:hi]
                    rows.append((chunk, int(to[mine[0]]), None, pack(code[mine], np.diff(at[lo : hi + 1]), counted[mine], flat[at[lo] : at[hi]].tobytes())))
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
            del enc, index, pieces, got, data, rows
        words.trim()

    spec = f"chunk long, bucket int, docs array<struct<key: {key.simpleString()}, counted: boolean, n: bigint>>, blob binary"
    return common.materialize(spark, docs.select("key", "counted", "text").mapInArrow(run, spec), f"{name}-chunks")


class Merged(NamedTuple):
    """A bucket: its distinct pieces, their counts, and for each chunk (chunk, codes, places among the pieces)."""

    pieces: pa.LargeBinaryArray
    counts: np.ndarray
    chunks: list[tuple[int, np.ndarray, np.ndarray]]


def merge(table: pa.Table) -> Merged:
    """The distinct pieces of the dictionary rows of one bucket."""
    table = table.sort_by("chunk")
    parts = [unpack(b.as_py()) for b in table.column("blob").combine_chunks()]
    flat = b"".join(p[3] for p in parts)
    at = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in parts]))])
    enc = strings(flat, at).dictionary_encode()
    index = enc.indices.to_numpy()
    counts = np.bincount(index, np.concatenate([p[2] for p in parts]).astype(np.float64), len(enc.dictionary)).astype(np.int64)
    ends = np.cumsum([len(p[0]) for p in parts])
    chunks = [(c, p[0], index[e - len(p[0]) : e]) for c, p, e in zip(table.column("chunk").to_pylist(), parts, ends.tolist(), strict=True)]
    return Merged(enc.dictionary, counts, chunks)


def rejoin(table: pa.Table) -> tuple[list[dict], np.ndarray, list[list[np.ndarray | bytes]]]:
    """Of the rows of one chunk: its documents, the codes of all its pieces, and the blobs that buckets sent back."""
    docs, codes, back = [], np.zeros(0, np.int64), []
    for bucket, own, blob in zip(table.column("bucket").to_pylist(), table.column("docs"), table.column("blob"), strict=True):
        if bucket is None:
            docs, codes = own.as_py(), unpack(blob.as_py())[0]
        else:
            back.append(unpack(blob.as_py()))
    return docs, codes, back
