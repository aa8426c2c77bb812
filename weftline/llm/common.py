"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.storage import new_path, number_rows, remove, table

__all__ = ["BROADCAST_ROWS", "WORD", "ascii_lower", "drop", "lookup", "materialize", "new_path", "ranked", "remove", "table"]

#: White space that separates words in sizes and shingles: space and TAB to CR.
WORD = r"[^\x20\x09-\x0D]+"
#: A side gets a broadcast hint only after its rows have been counted and are at most this many.
BROADCAST_ROWS = 200_000


def materialize(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it: cuts the lineage and survives lost executors."""
    at = new_path(spark, name)
    df.write.parquet(at)
    out = spark.read.schema(df.schema).parquet(at)
    out.weft_path = at
    return out


def drop(spark: SparkSession, *made: DataFrame) -> None:
    """Remove tables of `materialize` that nothing reads any more."""
    for df in made:
        remove(spark, df.weft_path)


def ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(rows: DataFrame, keys: DataFrame, on: str, salt: Column, parts: int = 32, seen: DataFrame | None = None) -> DataFrame:
    """Left join to a table with one row a key, where one key may hold a third of `rows`.

    Each key's rows are spread over `parts` salts, and `keys` gets a copy only for the salts a key has: those
    are found by an aggregation that combines before its shuffle. Nulls in `on` match nothing. `seen` may name a
    frame with the same keys and salts that is cheaper to read than `rows`.
    """
    seen = (rows if seen is None else seen).withColumn("__salt", F.pmod(salt, F.lit(parts)))
    rows = rows.withColumn("__salt", F.pmod(salt, F.lit(parts)))
    have = seen.where(F.col(on).isNotNull()).groupBy(on, "__salt").agg(F.count(F.lit(1)).alias("__n")).select(on, "__salt")
    return rows.join(have.join(keys, on), [on, "__salt"], "left").drop("__salt")


def ranked(spark: SparkSession, rows: DataFrame, key: Column) -> DataFrame:
    """rows with __rank: 0, or where a key (a hash) occurs several times the number of the row among those of its key, from 0.

    Only rows of repeated keys are written and numbered, by ranges of (key, row), so that a key with a third of all rows
    is many ranges. Which of them has which number is left open; their numbers are always 0 to n - 1.
    """
    keys = rows.select(key.alias("__k")).groupBy("__k").agg(F.count(F.lit(1)).alias("__n")).where("__n > 1").select("__k", F.lit(True).alias("__twice"))
    keys = materialize(spark, keys, "repeated")
    n = keys.limit(BROADCAST_ROWS + 1).count()
    if not n:
        return rows.withColumn("__rank", F.lit(0).cast("long"))
    keyed, salt = rows.withColumn("__k", key), F.monotonically_increasing_id()
    near = lambda df, side: df.join(F.broadcast(side), "__k", "left") if n <= BROADCAST_ROWS else lookup(df, side, "__k", F.xxhash64("__k", salt))
    marked = near(keyed, keys)
    numbered = number_rows(marked.where("__twice").withColumn("__i", salt), [F.col("__k").asc(), F.col("__i").asc()], "__row")
    first = numbered.groupBy("__k").agg(F.min("__row").alias("__first"))
    again = near(numbered.drop("__twice"), first).withColumn("__rank", F.col("__row") - F.col("__first"))
    once = marked.where("__twice IS NULL").withColumn("__rank", F.lit(0).cast("long"))
    return once.select(*rows.columns, "__rank").unionByName(again.select(*rows.columns, "__rank"))
