"""Cross-tokenizer alignment by segment deduplication.

A text with a space before it is cut into segments, each from a space that follows something else than white space to
the next one. `verified` proves from the two vocabulary files that no token of either can lie across such a place: A is a
byte-level BPE without normaliser whose own pattern always parts there, and no token of A or piece of B has such a
place inside. So tokens of a text are those of its segments, one after another. Each distinct segment of the corpus is
tokenised and aligned once, in the bucket of its hash (`chunks`); how often an id pair is linked is counted from the
segments' occurrences, joined back to the segments, and the segments' alignments to the chunks, which compose documents.

A group of tokens ends where tokens of both end. The common refinement of both cuts has one cell for each overlapping
pair of tokens, so links are cells.

Outputs: `groups` (a document's groups with byte offsets and the ids of both), `pair_counts` (id pairs linked, their
counts, whether the count is the highest of the B id), `digest` (the columns of the query).

Defined cases: null and empty texts, texts that are not valid UTF-8, and texts that have U+2581 (which B reads as a
space, so its bytes differ) have no tokens; a null doc_id and repeated rows are rows as any other; very long texts are a
chunk of their own, a very long segment one string; an empty table gives an empty result; other columns are ignored.
Vocabularies that cannot be verified raise ValueError. Their files are shipped with the job, at most a few MB each.
"""

from __future__ import annotations

import functools
import hashlib
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import storage

from . import chunks, common, words

TOKENIZERS = "/opt/tokenizers"
A_FILE, B_FILE = "byte_bpe_50k.json", "piece_bpe_32k.model"
MARK = "▁"
AT_ONCE, RUNS = 2048, 8  # segments that are one string for the tokenizers, and strings at a time
PLACE = 1 << 20  # an id pair is a * PLACE + b


def segment_starts(data: np.ndarray) -> np.ndarray:
    """Places of spaces before which no token of A or B can be joined: after a visible character that is no white space.

    Left out are those after other ASCII up to the space and DEL, and after the lead bytes of all wide white space of Unicode.
    """
    at = np.flatnonzero(data[1:] == 0x20) + 1
    one = data[at - 1]
    two = np.where(at >= 2, data[at - 2], 0)
    three = np.where(at >= 3, data[at - 3], 0)
    blank = (one >= 0x80) & (((two == 0xC2) & ((one == 0x85) | (one == 0xA0))) | ((three == 0xE1) & ((two == 0x9A) | (two == 0xA0))) | ((three == 0xE2) & ((two == 0x80) | (two == 0x81))) | ((three == 0xE3) & (two == 0x80)))
    return at[(one > 0x20) & (one != 0x7F) & ~blank]


def segments(data: np.ndarray, off: np.ndarray) -> chunks.Cut:
    """All segments of texts; a text without bytes has none."""
    edge = np.zeros(len(data) + 1, bool)
    edge[segment_starts(data)] = True
    edge[off] = True  # a text begins with a space, whatever the text before it ends with
    at = np.flatnonzero(edge)
    return chunks.Cut(data, at if len(data) else np.zeros(1, np.int64), np.searchsorted(at, off, "left"))


class Tokenizers:
    """Both tokenizers and the bytes of their tokens."""

    def __init__(self, a_path: str, b_path: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        # byte-level BPE writes bytes that are no visible character as characters from 256 on
        seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in seen)}
        vocab = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(byte[c] for c in t) for t, i in vocab.items()}
        self.b_bytes = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else b"" if self.b.is_control(i) or self.b.is_unknown(i) else p.replace(MARK, " ").encode() for i in range(self.b.get_piece_size()) for p in [self.b.id_to_piece(i)]]
        self.a_len = np.zeros(max(self.a_bytes) + 1, np.int64)
        self.a_len[list(self.a_bytes)] = [len(x) for x in self.a_bytes.values()]
        self.b_len = np.array([len(x) for x in self.b_bytes], np.int64)

    def verified(self, a_path: str, b_path: str) -> bool:
        """Whether the files prove that segments can be tokenised apart and that no byte is lost but by U+2581."""
        import json

        from sentencepiece import sentencepiece_model_pb2

        with open(a_path, encoding="utf-8") as f:
            made = json.load(f)
        proto = sentencepiece_model_pb2.ModelProto()
        with open(b_path, "rb") as f:
            proto.ParseFromString(f.read())
        norm, kind, parts = proto.normalizer_spec, proto.trainer_spec, made.get("pre_tokenizer") or {}
        whole = made["model"]["type"] == "BPE" and not made.get("normalizer") and parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space") and set(range(256)) <= {x[0] for x in self.a_bytes.values() if len(x) == 1}
        same = kind.model_type == kind.BPE and norm.name == "identity" and not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.add_dummy_prefix and norm.escape_whitespaces and kind.byte_fallback and sum(map(self.b.is_byte, range(len(self.b_bytes)))) == 256
        return bool(whole and same and not any(len(segment_starts(np.frombuffer(x, np.uint8))) for x in [*self.a_bytes.values(), *self.b_bytes] if b" " in x[1:]))

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids and ends (in bytes over all texts) of the tokens of A and of B, for segments that begin with a space.

        Segments that end in white space or a control character are strings of their own, the others are joined.
        """
        runs, run = [], []
        for t in texts:
            run.append(t)
            if len(run) == AT_ONCE or t[-1] <= 0x20 or t[-1] >= 0x7F:
                runs.append(b"".join(run).decode())
                run = []
        if run:
            runs.append(b"".join(run).decode())
        mark, a_parts, b_parts = self.b.piece_to_id(MARK), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in range(0, len(runs), RUNS):  # encodings hold much more than ids, so only a few exist at a time
            own = runs[k : k + RUNS]
            a_parts.append(np.fromiter((i for e in self.a.encode_batch(own, add_special_tokens=False) for i in e.ids), np.int64))
            b_parts.append(np.fromiter((i for e in self.b.encode([r[1:] for r in own], num_threads=1) for i in (e or [mark])), np.int64))
        a, b = np.concatenate(a_parts), np.concatenate(b_parts)
        return a, np.cumsum(self.a_len[a]), b, np.cumsum(self.b_len[b])


@functools.lru_cache(1)
def tokenizers(a_file: str, b_file: str) -> Tokenizers:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Tokenizers(SparkFiles.get(a_file), SparkFiles.get(b_file))


class Aligned:
    """Alignments of segments: ids and links as flat arrays with offsets, and each segment's groups as text."""

    def __init__(self, own: Tokenizers, pieces: pa.LargeBinaryArray) -> None:
        flat, at = chunks.raw(pieces)
        ends = at[1:]
        a, a_end, b, b_end = own.encode(pieces.to_pylist())
        if len(ends) and not (a_end[-1] == b_end[-1] == ends[-1] and np.isin(ends, a_end).all() and np.isin(ends, b_end).all()):
            raise ValueError("a token lies across segments")
        self.n_a = np.diff(np.searchsorted(a_end, ends, "right"), prepend=0)
        self.n_b = np.diff(np.searchsorted(b_end, ends, "right"), prepend=0)
        both = np.intersect1d(a_end, b_end, assume_unique=True)
        self.n_groups = np.diff(np.searchsorted(both, ends, "right"), prepend=0)
        cells = np.union1d(a_end, b_end)
        self.n_links = np.diff(np.searchsorted(cells, ends, "right"), prepend=0)
        self.pair = a[np.searchsorted(a_end, cells, "left")] * PLACE + b[np.searchsorted(b_end, cells, "left")]
        a_str, b_str = a.astype(str).tolist(), b.astype(str).tolist()
        a_at, b_at = np.searchsorted(a_end, both, "right").tolist(), np.searchsorted(b_end, both, "right").tolist()
        written = [f"{','.join(a_str[i:j])}|{','.join(b_str[k:m])}" for i, j, k, m in zip([0, *a_at], a_at, [0, *b_at], b_at, strict=False)]
        upto = np.cumsum(self.n_groups).tolist()
        self.text = [";".join(written[i:j]).encode() for i, j in zip([0, *upto], upto, strict=False)]


def _prepared(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, int]:
    """A space and the text of each document, empty where it has no tokens; the vocabulary files go to the executors."""
    if not Tokenizers(a_path, b_path).verified(a_path, b_path):
        raise ValueError("these vocabularies may merge across white space")
    for path in (a_path, b_path):
        spark.sparkContext.addFile(path)
    text = F.col("text").cast("string")
    ok = F.is_valid_utf8(text) & ~F.contains(text, F.lit(MARK)) & (text != "")
    ready = docs.select(F.col("doc_id").alias("key"), F.lit(True).alias("counted"), F.when(ok, F.concat(F.lit(" "), text)).otherwise("").alias("text"))
    return ready, chunks.buckets_for(docs)


def _segments(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str) -> tuple[DataFrame, DataFrame]:
    """(the chunks; for each bucket its aligned segments as one row with a blob, and its id pairs with counts)."""
    ready, buckets = _prepared(spark, docs, a_path, b_path)
    held = chunks.split(spark, ready, segments, "align", buckets)
    a_file, b_file = os.path.basename(a_path), os.path.basename(b_path)
    schema = pa.schema([("bucket", pa.int32()), ("pair", pa.int64()), ("n", pa.int64()), ("blob", pa.binary())])

    def run(table: pa.Table) -> pa.Table:
        got = chunks.merge(table)
        al = Aligned(tokenizers(a_file, b_file), got.pieces)
        pairs, where = np.unique(al.pair, return_inverse=True)
        n = np.bincount(where, np.repeat(got.counts, al.n_links).astype(np.float64), len(pairs)).astype(np.int64)
        bucket = table.column("bucket")[0].as_py()
        back = [x for c, codes, places in got.chunks for x in (np.array([c]), codes, places)]
        texts = b"".join(al.text)
        blob = chunks.pack(al.n_a, al.n_b, al.n_groups, al.n_links, where, np.array([len(t) for t in al.text], np.int64), texts, *back)
        out = pa.table([pa.array([bucket] * (len(pairs) + 1), pa.int32()), pa.array([None, *pairs.tolist()], pa.int64()), pa.array([None, *n.tolist()], pa.int64()), pa.array([blob, *[None] * len(pairs)], pa.binary())], schema)
        words.trim()
        return out

    got = held.where("bucket IS NOT NULL").select("chunk", "bucket", "blob").groupBy("bucket").applyInArrow(run, "bucket int, pair long, n long, blob binary")
    return held, common.materialize(spark, got, "align-buckets")


def _counted(aligned: DataFrame) -> DataFrame:
    counts = aligned.where("pair IS NOT NULL").groupBy("pair").agg(F.sum("n").alias("n")).withColumn("b", F.pmod("pair", F.lit(PLACE)))
    most = counts.groupBy("b").agg(F.max("n").alias("most"))  # of each B id, at most as many rows as B has pieces
    return counts.join(F.broadcast(most) if storage.fits(most) else most, "b").select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def pair_counts(spark: SparkSession, docs: DataFrame, a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}") -> DataFrame:
    """a, b, n and best: how many links of the corpus hold each id pair, and whether no pair of its B id has more."""
    _, aligned = _segments(spark, docs, a_path, b_path)
    return _counted(aligned).select(F.floor(F.col("pair") / PLACE).cast("long").alias("a"), F.pmod("pair", F.lit(PLACE)).alias("b"), "n", "best")


def _summaries(spark: SparkSession, aligned: DataFrame, name: str) -> DataFrame:
    """For each chunk and bucket: what the chunk's segments have, in the order of their codes there."""
    counts = common.materialize(spark, _counted(aligned), f"{name}-pairs")
    own = aligned.where("pair IS NOT NULL").select(F.col("bucket").alias("to"), "pair")
    known = common.lookup(own, counts, "pair", F.col("to")).select("to", "pair", "n", "best")
    schema = pa.schema([("chunk", pa.int64()), ("bucket", pa.int32()), ("blob", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        bucket = left.column("bucket")[0].as_py()
        n_a, n_b, n_groups, n_links, where, lengths, texts, *back = chunks.unpack(left.column("blob")[0].as_py())
        right = right.sort_by("pair")  # pairs were numbered in this order
        at = np.repeat(np.arange(len(n_links)), n_links)
        total = np.zeros(len(n_links), np.int64)
        np.add.at(total, at, right.column("n").to_numpy()[where])
        best = np.bincount(at, right.column("best").to_numpy()[where].astype(np.float64), len(n_links)).astype(np.int64)
        written = chunks.strings(texts, np.concatenate([[0], np.cumsum(lengths)]))
        rows = []
        for k in range(0, len(back), 3):
            chunk, codes, places = int(back[k][0]), back[k + 1], back[k + 2]
            own, off = chunks.raw(written.take(pa.array(places)))
            rows.append({"chunk": chunk, "bucket": bucket, "blob": chunks.pack(codes, n_a[places], n_b[places], n_groups[places], n_links[places], best[places], total[places], np.diff(off), own.tobytes())})
        return pa.Table.from_pylist(rows, schema)

    rows = aligned.where("blob IS NOT NULL").select("bucket", "blob")
    return rows.groupBy("bucket").cogroup(known.groupBy("to")).applyInArrow(run, "chunk long, bucket int, blob binary")


def _composed(table: pa.Table) -> tuple[list[dict], np.ndarray, list[np.ndarray], list[bytes]]:
    """Of one chunk: documents, codes, and by code the six numbers and the groups of segments."""
    docs, codes, back = chunks.rejoin(table)
    size = int(codes.max()) + 1 if len(codes) else 0
    numbers, texts = [np.zeros(size, np.int64) for _ in range(6)], np.empty(size, object)
    for own, *six, lengths, data in back:
        for into, x in zip(numbers, six, strict=True):
            into[own] = x
        upto = np.cumsum(lengths).tolist()
        texts[own] = [data[i:j] for i, j in zip([0, *upto], upto, strict=False)]
    return docs, codes, numbers, texts.tolist()


def _compose(spark: SparkSession, docs: DataFrame, a_path: str, b_path: str, run, fields: str) -> DataFrame:
    held, aligned = _segments(spark, docs, a_path, b_path)
    back = _summaries(spark, aligned, "align").select("chunk", "bucket", F.lit(None).cast(held.schema["docs"].dataType).alias("docs"), "blob")
    key = docs.schema["doc_id"].dataType.simpleString()
    return held.where("bucket IS NULL").unionByName(back).groupBy("chunk").applyInArrow(run, f"doc_id {key}, {fields}")


NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def digest(spark: SparkSession, docs: DataFrame, a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}") -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every document."""

    def run(table: pa.Table) -> pa.Table:
        rows, codes, numbers, texts = _composed(table)
        ends = np.cumsum([r["n"] for r in rows])
        sums = [np.diff(np.concatenate([[0], np.cumsum(x[codes])])[ends], prepend=0) for x in numbers]
        sha, begin = [], 0
        for end in ends.tolist():
            sha.append(hashlib.sha256(b";".join([texts[c] for c in codes[begin:end].tolist()])).hexdigest() if end > begin else "")
            begin = end
        out = pa.table([pa.array([r["key"] for r in rows], table.schema.field("docs").type.value_type.field("key").type), *map(pa.array, sums), pa.array(sha, pa.string())], ["doc_id", *NUMBERS, "groups_sha256"])
        words.trim()
        return out

    return _compose(spark, docs, a_path, b_path, run, ", ".join(f"{n} long" for n in NUMBERS) + ", groups_sha256 string")


def groups(spark: SparkSession, docs: DataFrame, a_path: str = f"{TOKENIZERS}/{A_FILE}", b_path: str = f"{TOKENIZERS}/{B_FILE}") -> DataFrame:
    """doc_id and groups of every document: the bytes from begin to end of a space and the text, and the ids of A and B there."""
    a_file, b_file = os.path.basename(a_path), os.path.basename(b_path)
    item = pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(table: pa.Table) -> Iterator[pa.RecordBatch] | pa.Table:
        rows, codes, _, texts = _composed(table)
        size = tokenizers(a_file, b_file).a_len
        parsed = []
        for t in texts:
            own = [[list(map(int, side.split(b","))) for side in g.split(b"|")] for g in t.split(b";")]
            parsed.append([(int(size[a].sum()), a, b) for a, b in own])
        out, begin = [], 0
        for r in rows:
            at, own = 0, []
            for c in codes[begin : begin + r["n"]].tolist():
                for length, a, b in parsed[c]:
                    own.append({"begin": at, "end": at + length, "a": a, "b": b})
                    at += length
            begin += r["n"]
            out.append(own)
        key = table.schema.field("docs").type.value_type.field("key").type
        return pa.table([pa.array([r["key"] for r in rows], key), pa.array(out, pa.list_(item))], ["doc_id", "groups"])

    return _compose(spark, docs, a_path, b_path, run, "groups array<struct<begin: bigint, end: bigint, a: array<int>, b: array<int>>>")
