"""WARC archives as a PySpark data source (`warc`).

Writing: each task writes one archive (WARC 1.1, records one after another, uncompressed so that payloads can be
skipped) under a name of its own and reports where records begin, about every `block` bytes. The driver's commit
lists the files in a manifest; what lost or repeated tasks left is in no manifest and is never read.

Reading: partitions are the manifest's blocks, or whole files where there is no manifest (`.warc.gz` too).
Predicates on record_type and header columns are pushed down and judged as soon as a record's headers are
parsed; the block of a record that fails is skipped by its Content-Length. Payloads are read only with
option payload or verify. verify recomputes the digest and length of each payload that is there.

Defined cases: a null payload is empty; a null page_id gives a record whose page_id reads as null, and such
records are never what others refer to; rows that repeat with the same page_id and payload are all responses;
page_ids of text may hold any characters, as they are percent-encoded in record names; a null url gives a record
without WARC-Target-URI; line breaks in header values are percent-encoded, so they
cannot end a header; payloads of any length are one record; an empty table gives an archive without records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, IsNotNull, IsNull, Not, StringContains, StringEndsWith, StringStartsWith, WriterCommitMessage

from . import common

SCHEMA = "record_type string, record_id string, target_uri string, date string, refers_to string, payload_digest string, payload_bytes long, payload binary"
HEADERS = {"record_type": "WARC-Type", "record_id": "WARC-Record-ID", "target_uri": "WARC-Target-URI", "date": "WARC-Date", "refers_to": "WARC-Refers-To", "payload_digest": "WARC-Payload-Digest"}
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BLOCK = 16 << 20


def file_system(at: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path as Spark names it, and the path in it."""
    return pafs.FileSystem.from_uri(at.replace("s3a://", "s3://", 1) if at.startswith("s3a://") else at)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()  # noqa: S324  the archive format asks for SHA-1


def safe(value: str) -> str:
    return value.replace("\r", "%0D").replace("\n", "%0A")


def record(row: dict) -> bytes:
    """One record; a revisit holds the HTTP headers of its payload, not the payload."""
    payload = row["payload"] or b""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n".encode()
    block = head if row["record_type"] == "revisit" else head + payload
    lines = ["WARC/1.1"] + [f"{h}: {safe(row[c])}" for c, h in HEADERS.items() if row[c] is not None]
    if row["record_type"] == "revisit":
        lines.append(f"WARC-Profile: {PROFILE}")
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


@dataclass
class Written(WriterCommitMessage):
    file: str
    starts: list[int]
    end: int
    records: int


class WarcWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.at, self.block, self.overwrite = options["path"], int(options.get("block", BLOCK)), overwrite

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        fs, root = file_system(self.at)
        fs.create_dir(root)
        name, starts, at, n = f"part-{uuid.uuid4().hex}.warc", [], 0, 0
        with fs.open_output_stream(f"{root}/{name}") as out:
            for batch in iterator:
                for i in range(batch.num_rows):
                    if not starts or at - starts[-1] >= self.block:
                        starts.append(at)
                    data = record({c: batch.column(k)[i].as_py() for k, c in enumerate(batch.schema.names)})
                    out.write(data)
                    at += len(data)
                    n += 1
        return Written(name, starts, at, n)

    def commit(self, messages: list) -> None:
        fs, root = file_system(self.at)
        fs.create_dir(root)
        old = [f.path for f in fs.get_file_info(pafs.FileSelector(root)) if f.base_name.startswith("_manifest-")] if self.overwrite else []
        with fs.open_output_stream(f"{root}/_manifest-{uuid.uuid4().hex}.json") as out:
            out.write(json.dumps([[m.file, m.starts, m.end, m.records] for m in messages if m]).encode())
        for path in old:
            fs.delete_file(path)

    def abort(self, messages: list) -> None:
        fs, root = file_system(self.at)
        for m in messages:
            if m:
                fs.delete_file(f"{root}/{m.file}")


def predicate(f: Filter) -> Callable[[dict], bool] | None:
    """A test of the header columns, or None if Spark must judge this filter itself."""
    if isinstance(f, Not):
        inner, known = predicate(f.child), getattr(f.child, "attribute", None)
        return None if inner is None else lambda row: (row[known[0]] is not None or isinstance(f.child, IsNull | IsNotNull)) and not inner(row)
    if not hasattr(f, "attribute") or len(f.attribute) != 1 or f.attribute[0] not in HEADERS:
        return None
    c = f.attribute[0]
    tests: dict[type, Callable] = {
        EqualTo: lambda v: v is not None and v == f.value, In: lambda v: v is not None and v in f.value, IsNull: lambda v: v is None, IsNotNull: lambda v: v is not None,
        StringStartsWith: lambda v: v is not None and v.startswith(f.value), StringEndsWith: lambda v: v is not None and v.endswith(f.value), StringContains: lambda v: v is not None and f.value in v,
    }
    test = tests.get(type(f))
    return None if test is None else lambda row: test(row[c])


@dataclass
class Piece(InputPartition):
    file: str
    begin: int
    end: int | None


def parse_headers(f) -> dict[str, str] | None:
    """The headers of the next record by lower-cased name, or None at the end."""
    line = f.readline()
    while line in (b"\r\n", b"\n"):
        line = f.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins here: {line[:40]!r}")
    got: dict[str, str] = {}
    name = ""
    while (line := f.readline()) not in (b"\r\n", b"\n", b""):
        text = line.decode("utf-8", "replace")
        if text[0] in " \t" and name:  # a folded line goes on with the header before it
            got[name] = f"{got[name]} {text.strip()}".strip()
            continue
        name, _, value = text.partition(":")
        name = name.strip().lower()
        got[name] = value.strip()
    return got


def end_record(f) -> None:
    """Step over the two line ends that follow a block."""
    for _ in range(2):
        f.readline()


class WarcReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.at = options["path"]
        self.payload, self.verify = (str(options.get(k, "false")).lower() == "true" for k in ("payload", "verify"))
        self.tests: list = []

    def pushFilters(self, filters: list[Filter]):  # noqa: N802  the name is Spark's
        for f in filters:
            if (test := predicate(f)) is None:
                yield f
            else:
                self.tests.append(test)

    def partitions(self) -> list[Piece]:
        fs, root = file_system(self.at)
        files = fs.get_file_info(pafs.FileSelector(root))
        manifests = [f.path for f in files if f.base_name.startswith("_manifest-")]
        out = []
        for path in manifests:
            with fs.open_input_file(path) as f:
                for name, starts, end, _ in json.loads(f.read()):
                    if not starts:  # an archive without records
                        continue
                    out += [Piece(name, a, b) for a, b in zip(starts, [*starts[1:], end], strict=True)]
        if not manifests:
            out = [Piece(f.base_name, 0, None) for f in files if f.base_name.endswith((".warc", ".warc.gz"))]
        return out or [Piece("", 0, 0)]

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c, pa.int64() if c == "payload_bytes" else pa.binary() if c == "payload" else pa.string()) for c in [x.split()[0] for x in SCHEMA.split(", ")]])
        rows: list[dict] = []
        size = 0
        for row in self.records(partition):
            rows.append(row)
            size += len(row["payload"] or b"")
            if len(rows) >= 2000 or size >= 8 << 20:
                yield pa.RecordBatch.from_pylist(rows, schema)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    def records(self, piece: Piece) -> Iterator[dict]:
        if not piece.file:
            return
        fs, root = file_system(self.at)
        with fs.open_input_file(f"{root}/{piece.file}") as raw:
            raw.seek(piece.begin)
            f = gzip.GzipFile(fileobj=raw) if piece.file.endswith(".gz") else _Buffered(raw)
            while piece.end is None or f.tell() < piece.end:
                head = parse_headers(f)
                if head is None:
                    return
                length = int(head.get("content-length", 0))
                row = {c: head.get(h.lower()) for c, h in HEADERS.items()}
                if not all(test(row) for test in self.tests):
                    f.seek(length, 1)
                    end_record(f)
                    continue
                http = head.get("content-type", "").startswith("application/http")
                said, used = None, 0
                while http and used < length:  # the HTTP headers, without the payload
                    line = f.readline()
                    used += len(line)
                    if line in (b"\r\n", b"\n", b""):
                        break
                    if line.lower().startswith(b"content-length:"):
                        said = int(line.split(b":")[1])
                there = row["record_type"] != "revisit"
                payload = f.read(length - used) if (self.payload or self.verify) and there else None
                if payload is None:
                    f.seek(length - used, 1)
                elif self.verify:
                    digest = f"sha1:{base32_sha1(payload)}"
                    if len(payload) != length - used or (row["payload_digest"] or digest) != digest or (said is not None and said != len(payload)):
                        raise ValueError(f"{row['record_id']}: the payload is not what its headers say")
                    row["payload_digest"] = digest
                end_record(f)  # else the last record of a block would seem to go on into the next block
                yield row | {"payload_bytes": length - used if there else said, "payload": payload if self.payload else None}


class _Buffered:
    """readline over a seekable file, whose own readline reads byte by byte; long blocks are skipped by seeking."""

    def __init__(self, raw, ahead: int = 1 << 16) -> None:
        self.raw, self.ahead, self.held, self.at, self.pos = raw, ahead, b"", 0, raw.tell()

    def tell(self) -> int:
        return self.pos

    def _more(self) -> bool:
        got = self.raw.read(self.ahead)
        self.held, self.at = self.held[self.at :] + got, 0
        return bool(got)

    def readline(self) -> bytes:
        while (end := self.held.find(b"\n", self.at)) < 0:
            if not self._more():
                end = len(self.held) - 1
                break
        line = self.held[self.at : end + 1]
        self.at += len(line)
        self.pos += len(line)
        return line

    def read(self, n: int) -> bytes:
        out = self.held[self.at : self.at + n]
        self.at += len(out)
        if len(out) < n:
            out += self.raw.read(n - len(out))
        self.pos += len(out)
        return out

    def seek(self, n: int, whence: int) -> None:
        inside = min(n, len(self.held) - self.at)
        self.at += inside
        if n > inside:
            self.raw.seek(n - inside, 1)
            self.held, self.at = b"", 0
        self.pos += n


class WarcSource(DataSource):
    """spark.read.format("warc").load(path) and df.write.format("warc").save(path); see the module."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> WarcReader:
        return WarcReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> WarcWriter:
        return WarcWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WarcSource)


def read(spark: SparkSession, at: str, payload: bool = False, verify: bool = False) -> DataFrame:
    register(spark)
    return spark.read.format("warc").option("payload", str(payload)).option("verify", str(verify)).load(at)


def base32(hex_: Column) -> Column:
    """Base32 of a hexadecimal SHA-1, from 40 bits at a time."""
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    chars = []
    for k in range(4):
        bits = F.conv(F.substring(hex_, 1 + 10 * k, 10), 16, 10).cast("long")
        chars += [F.substr(letters, F.shiftright(bits, 35 - 5 * i).bitwiseAND(F.lit(31)).cast("int") + 1, F.lit(1)) for i in range(8)]
    return F.concat(*chars)


def archive(spark: SparkSession, pages: DataFrame, at: str, least: int = 0, date: str = "2000-01-01T00:00:00Z", block: int = BLOCK) -> None:
    """Write pages(page_id, url, html): of equal payloads of at least `least` bytes the smallest page_id is the response, others revisit it."""
    register(spark)
    rows = pages.select("page_id", "url", F.coalesce(F.col("html").cast("binary"), F.lit(b"")).alias("payload")).withColumn("hex", F.sha1("payload"))
    large = rows.where(F.octet_length("payload") >= least)
    firsts = large.groupBy("hex").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("hex", "first")
    firsts = common.materialize(spark, firsts, "warc-firsts")
    if firsts.count() <= common.BROADCAST_ROWS:  # else a salted join, as a payload may have a third of all pages
        found = rows.join(F.broadcast(firsts), "hex", "left")
    else:
        found = common.lookup(rows, firsts, "hex", F.xxhash64("page_id"))
    again = (F.col("first") != F.col("page_id")) & (F.octet_length("payload") >= least)
    again = F.coalesce(again, F.col("page_id").isNull() & F.col("first").isNotNull() & (F.octet_length("payload") >= least))
    urn = lambda c: F.coalesce(F.concat(F.lit("<urn:page:"), F.url_encode(c.cast("string")), F.lit(">")), F.lit("<urn:no-page>"))
    out = found.select(
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"), urn(F.col("page_id")).alias("record_id"), F.col("url").alias("target_uri"), F.lit(date).alias("date"),
        F.when(again, urn(F.col("first"))).alias("refers_to"), F.concat(F.lit("sha1:"), base32(F.col("hex"))).alias("payload_digest"), F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(~again, F.col("payload")).alias("payload"),
    )
    out.write.format("warc").option("block", block).mode("append").save(at)
    common.drop(spark, firsts)


def page_of(urn: Column, kind: str) -> Column:
    """The page_id of a record's name, in which it is percent-encoded; null for records without one."""
    return F.when(F.startswith(urn, F.lit("<urn:page:")), F.url_decode(F.regexp_extract(urn, "(?s)^<urn:page:(.*)>$", 1))).try_cast(kind)


def digest(spark: SparkSession, pages: DataFrame, at: str | None = None) -> DataFrame:
    """Archive pages, read the archives back with their payloads verified, and return a row a page."""
    at = at or common.new_path(spark, "warc")
    archive(spark, pages, at)
    kind = pages.schema["page_id"].dataType.simpleString()
    return read(spark, at, verify=True).select(page_of(F.col("record_id"), kind).alias("page_id"), "payload_bytes", F.substring("payload_digest", 6, 32).alias("payload_digest"), "record_type", page_of(F.col("refers_to"), kind).alias("refers_to"))


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(h, 1 + 10 * (k // 8)::INTEGER, 10))::BIGINT >> (35 - 5 * (k % 8))::INTEGER) & 31) + 1)::INTEGER, 1), '' ORDER BY k)
        FROM range(32) AS t(k)) AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM p JOIN f USING (h)
"""
