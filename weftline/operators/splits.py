"""Orders, splits, folds and batches. Every order has explicit keys; none is left to how rows lie."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import storage


def budget_split(docs: DataFrame, n: Column, order: list[Column], budgets: Sequence[tuple[str, int]]) -> DataFrame:
    """docs with n, cum (tokens up to and with the row) and split: the first one whose budget, added to those before, holds them.

    A row that crosses a budget belongs to the next split. Rows beyond the last budget are left out.
    """
    summed = storage.running_sum(docs.withColumn("n", n.cast("long")), "n", order)
    ends, end = [], 0
    for name, size in budgets:
        end += size
        ends.append((name, end))
    split = F.lit(None).cast("string")
    for name, end in reversed(ends):
        split = F.when(F.col("cum") <= end, F.lit(name)).otherwise(split)
    return summed.withColumn("split", split).where(F.col("split").isNotNull())


def shuffle_key(key: Column, seed: int) -> Column:
    """A pseudo-random order that any engine can repeat."""
    return F.md5(F.concat(F.lit(f"{seed}-"), key.cast("string")))


def k_fold(rows: DataFrame, order: list[Column], k: int, folds: int = 10, valid: float = 0.1) -> DataFrame:
    """rows with row and split: fold k of the order is test; of the rest the last `valid` share is valid, the others train."""
    numbered = storage.number_rows(rows, order, "row")
    n = numbered.count()
    low, high = k * n // folds, (k + 1) * n // folds
    rest = n - (high - low)
    train = int((1 - valid) * rest)
    place = F.when(F.col("row") < low, F.col("row")).otherwise(F.col("row") - (high - low))
    split = F.when((F.col("row") >= low) & (F.col("row") < high), "test").when(place < train, "train").otherwise("valid")
    return numbered.withColumn("split", split)


def batches(rows: DataFrame, order: list[Column], size: int, name: str = "batch") -> DataFrame:
    """rows with row and batch, numbered in order."""
    return storage.number_rows(rows, order, "row").withColumn(name, F.floor(F.col("row") / size))


def length_batches(rows: DataFrame, length: Column, tie: list[Column], size: int) -> DataFrame:
    """Batches of rows sorted by length, longest first, and each batch's largest length."""
    numbered = batches(rows.withColumn("length", length.cast("long")), [F.col("length").desc(), *tie], size)
    most = numbered.groupBy("batch").agg(F.max("length").alias("batch_length"))
    return numbered.join(most, "batch")


def cyclic(step: Column, n: int) -> Column:
    """The index that a scan of n rows has reached after `step` steps."""
    return F.pmod(step, F.lit(n))


def concat_samples(*parts: DataFrame, order: str) -> DataFrame:
    """All rows of the parts, with part (from 0) before `order` as the key of their order."""
    out = None
    for i, p in enumerate(parts):
        p = p.withColumn("part", F.lit(i))
        out = p if out is None else out.unionByName(p)
    return out.select("part", F.col(order), *[c for c in out.columns if c not in ("part", order)])


def head(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """The first n rows of an order (a negative n: the last ones)."""
    if n >= 0:
        return rows.orderBy(*order).limit(n)
    numbered = storage.number_rows(rows, order, "row")
    return numbered.where(F.col("row") >= numbered.count() + n).drop("row")
