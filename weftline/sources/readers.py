"""Readers: every one returns an explicit order key, as rows of a table have no order of their own."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import storage
from weftline.functions import text as T


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line_no (from 0, in the order of files and lines) and text of text files."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))
    raw = raw.withColumn("at", F.monotonically_increasing_id())  # rises with the lines of one split
    return storage.number_rows(raw, [F.col("file").asc(), F.col("start").asc(), F.col("at").asc()], "line_no").select("line_no", F.col("value").alias("text"))


def words_of_lines(spark: SparkSession, path: str) -> DataFrame:
    return lines(spark, path).select("line_no", T.split_words(F.col("text")).alias("words"))


def first_line_words(spark: SparkSession, path: str) -> DataFrame:
    """Words of the first line, split at single spaces."""
    return lines(spark, path).where("line_no = 0").select("line_no", F.split(F.trim("text"), " ", -1).alias("words"))


def whole_file_words(spark: SparkSession, path: str) -> DataFrame:
    """pos and word of all words of a corpus, as one sequence of lines."""
    return words_of_lines(spark, path).select("line_no", F.posexplode("words").alias("pos", "word"))


def json_lines(spark: SparkSession, path: str, schema: str = "text string") -> DataFrame:
    """Records of JSON lines; control characters inside strings are allowed."""
    return spark.read.schema(schema).option("allowUnquotedControlChars", "true").json(path)


def labelled_csv(spark: SparkSession, path: str, fields: int = 2) -> DataFrame:
    """label (from 0) and text (all fields after the first, joined by a space) of quoted CSV without a header."""
    names = [f"f{i}" for i in range(fields)]
    schema = ", ".join(["label string", *[f"{n} string" for n in names]])
    raw = spark.read.schema(schema).csv(path, quote='"', escape='"', multiLine=True)
    return raw.select(T.label_from(F.col("label")).alias("label"), T.join_fields(*[F.col(n) for n in names]).alias("text"))


def double_tab(spark: SparkSession, path: str, rating: int = 2) -> DataFrame:
    """line_no, label (rating less 1) and text (the last field) of lines with fields between double tabs."""
    fields = T.split_on(F.col("text"), "\t\t")
    return lines(spark, path).select("line_no", T.label_from(fields[rating]).alias("label"), F.element_at(fields, -1).alias("text"))


def labelled_by_file(spark: SparkSession, paths: dict[int, str]) -> DataFrame:
    """label, line_no and text of one file for each label; bytes that are no UTF-8 are dropped."""
    out = None
    for label, path in paths.items():
        part = lines(spark, path).select(F.lit(label).alias("label"), "line_no", T.drop_bad_bytes(F.col("text")).alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def parallel_files(spark: SparkSession, source: str, target: str) -> DataFrame:
    """line_no, src and tgt of two aligned files."""
    return lines(spark, source).withColumnRenamed("text", "src").join(lines(spark, target).withColumnRenamed("text", "tgt"), "line_no")


def alphabet(spark: SparkSession, path: str) -> str:
    """The characters of a JSON array, joined."""
    return "".join(x for r in spark.read.text(path, wholetext=True).select(F.from_json("value", "array<string>").alias("a")).collect() for x in r.a)


def text_vectors(spark: SparkSession, path: str, header: bool = True) -> DataFrame:
    """word and vec of text vectors.

    A header is a line of two whole numbers that says how many vectors its file, or all files of the path together, have
    beside it, and how many components they have; other lines of two whole numbers are vectors of one component.
    """
    rows = spark.read.text(path)
    parts = F.split(F.rtrim("value"), " ")
    if header:
        rows = rows.withColumn("file", F.col("_metadata.file_path"))
        two = F.col("value").rlike(r"^[0-9]+ [0-9]+ *$")
        files = rows.groupBy("file").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.when(~two, F.size(parts) - 1)), F.lit(1)).alias("dim"))
        total = files.agg(F.sum("n").alias("total"), F.max("dim").alias("most")).withColumn("one", F.lit(1))  # one row
        sized = files.withColumn("one", F.lit(1)).join(F.broadcast(total), "one").drop("one")
        names = [parts[0].cast("long"), parts[1].cast("long")]
        heads = rows.where(two).join(sized, "file").where(((names[0] == F.col("n") - 1) & (names[1] == F.col("dim"))) | ((names[0] == F.col("total") - 1) & (names[1] == F.col("most"))))
        rows = rows.join(heads.select("file", "value").distinct(), ["file", "value"], "left_anti")
    rows = rows.select(parts.alias("p"))
    return rows.select(F.col("p")[0].alias("word"), F.slice("p", F.lit(2), F.size("p")).cast("array<double>").alias("vec"))


def parse_binary(blobs: list[bytes], most: int = 10_000) -> Iterator[pa.RecordBatch]:
    """word and vec of binary vectors, gzip or not: a header line `V D`, then for each word its name, a space and D 32-bit floats."""
    for raw in blobs:
        data = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
        at = data.index(b"\n") + 1
        n, dim = map(int, data[: at - 1].split())
        words, vecs = [], []
        for i in range(n):
            end = data.index(b" ", at)
            words.append(data[at:end].lstrip(b"\n").decode("utf-8", "replace"))
            vecs.append(np.frombuffer(data, "<f4", dim, end + 1))
            at = end + 1 + 4 * dim
            if len(words) == most or i == n - 1:
                yield pa.record_batch([pa.array(words), pa.array(vecs, pa.list_(pa.float32()))], ["word", "vec"])
                words, vecs = [], []


def binary_vectors(spark: SparkSession, path: str) -> DataFrame:
    """word and vec of files of binary vectors."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield from parse_binary(batch.column(0).to_pylist())

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(parse, "word string, vec array<float>")


def cached(spark: SparkSession, path: str, build) -> DataFrame:
    """The table at path, built and written first if it is not there."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    done = hadoop(path, "_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
