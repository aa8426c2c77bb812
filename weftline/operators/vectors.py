"""Vectors of words: coverage, statistics, initial weights, looking up and averaging rows of matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import storage


def coverage(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    """Words of vocab(word, id) that have a row in vectors(word, vec)."""
    return vocab.join(vectors.select("word").distinct(), "word", "left_semi")


def missing(vocab: DataFrame, vectors: DataFrame) -> DataFrame:
    return vocab.join(vectors.select("word").distinct(), "word", "left_anti")


def component_stats(vectors: DataFrame, vec: str = "vec") -> DataFrame:
    """One row: mean and population deviation over all components of all vectors."""
    flat = vectors.select(F.explode(vec).alias("x")).select(F.col("x").cast("double").alias("x"))
    return flat.agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.count("x").alias("n"))


def initial_vectors(vocab: DataFrame, vectors: DataFrame, dim: int, seed: int = 1) -> DataFrame:
    """word, id, vec, pretrained: the word's vector, or normal draws with the mean and deviation of the vectors found, seeded by the word."""
    found = coverage(vocab, vectors)
    stats = component_stats(vectors.join(found.select("word"), "word", "left_semi")).first()
    mean, std = float(stats.mean or 0.0), float(stats.std if stats.std is not None else 1.0)
    unit = lambda i, s: (F.pmod(F.xxhash64("word", i, F.lit(seed), F.lit(s)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = lambda i: F.sqrt(-2 * F.log(unit(i, 1))) * F.cos(2 * np.pi * unit(i, 2))
    drawn = F.transform(F.sequence(F.lit(1), F.lit(dim)), lambda i: mean + std * normal(i))
    got = vocab.select("word", "id").join(vectors.select("word", F.col("vec").cast("array<double>").alias("vec")), "word", "left")
    return got.select("word", "id", F.coalesce("vec", drawn).alias("vec"), F.col("vec").isNotNull().alias("pretrained"))


def rows_of(ids: DataFrame, matrix: DataFrame) -> DataFrame:
    """doc, pos, id and vec: the matrix row of each id of doc and ids."""
    flat = ids.select("doc", F.posexplode("ids").alias("pos", "id"))
    return storage.join_keys(flat.withColumn("id", F.col("id").cast("long")), matrix.select(F.col("id").cast("long").alias("id"), "vec"), "id", "left", salt=F.xxhash64("doc", "pos"))


def matrix_of(frame: DataFrame, most: int = 2_000_000) -> np.ndarray:
    """A matrix(id, vec) as an array for a kernel; over `most` rows raise ValueError."""
    got: pa.Table = frame.orderBy("id").limit(most + 1).select("vec").toArrow()
    if got.num_rows > most:
        raise ValueError(f"more than {most} rows")
    return np.array(got.column(0).to_pylist(), np.float64)
