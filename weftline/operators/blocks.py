"""Matrices as tables of blocks: no row, column or array grows with the matrix.

A block is a row of (rb, cb, ri, ci, x): the numbers of its band of rows and of columns, the places within the bands that it
has, and its values row by row. Bands have `ROWS` rows and `COLS` columns; transposing swaps them block by block.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import storage

ROWS, COLS = 256, 64


@dataclass(frozen=True)
class Blocks:
    table: DataFrame
    rows: int = ROWS
    cols: int = COLS

    @staticmethod
    def of(frame: DataFrame, row: str, values: str, rows: int = ROWS, cols: int = COLS) -> Blocks:
        """From a table with one row of the matrix (a number from 0, unique) and its values; null values are null in their block."""
        bands = F.sequence(F.lit(0), F.ceil(F.size(values) / cols).cast("int") - 1)
        parts = F.transform(bands, lambda c: F.struct(c.alias("cb"), F.slice(values, c * cols + 1, cols).alias("part")))
        flat = frame.where(F.size(values) > 0).select(F.floor(F.col(row) / rows).alias("rb"), (F.col(row) % rows).cast("int").alias("r"), F.explode(parts).alias("p"))
        flat = flat.select("rb", "r", F.col("p.cb").cast("long").alias("cb"), F.col("p.part").cast("array<double>").alias("part"))
        own = flat.groupBy("rb", "cb").agg(F.array_sort(F.collect_list(F.struct("r", "part"))).alias("own"))  # at most `rows` parts
        width = F.array_max(F.transform("own", lambda v: F.size(v["part"])))
        filled = F.transform("own", lambda v: F.concat(v["part"], F.array_repeat(F.lit(None).cast("double"), width - F.size(v["part"]))))
        return Blocks(own.select("rb", "cb", F.transform("own", lambda v: v["r"]).alias("ri"), F.sequence(F.lit(0), width - 1).alias("ci"), F.flatten(filled).alias("x")), rows, cols)

    def transpose(self) -> Blocks:
        h, w = F.size("ri"), F.size("ci")
        turned = F.transform(F.sequence(F.lit(0), h * w - 1), lambda k: F.get("x", ((k % h) * w + F.floor(k / h)).cast("int")))
        both = self.table.withColumn("turned", turned)  # named apart: in one select with the new names, the lambda would see those
        return Blocks(both.select(F.col("cb").alias("rb"), F.col("rb").alias("cb"), F.col("ci").alias("ri"), F.col("ri").alias("ci"), F.col("turned").alias("x")), self.cols, self.rows)

    def cells(self) -> DataFrame:
        """row, col, value."""
        w = F.size("ci")
        flat = self.table.select("rb", "cb", "ri", "ci", w.alias("w"), F.posexplode("x").alias("k", "value"))
        row = F.col("rb") * self.rows + F.get("ri", F.floor(F.col("k") / F.col("w")).cast("int"))
        return flat.select(row.alias("row"), (F.col("cb") * self.cols + F.get("ci", (F.col("k") % F.col("w")).cast("int"))).alias("col"), "value")

    def row_sums(self) -> DataFrame:
        """row, total and n (values that are not null) of every row; each block adds up its own first."""
        w = F.size("ci")
        own = F.transform("ri", lambda r, i: F.struct(r.alias("r"), F.slice("x", (i * w + 1).cast("int"), w).alias("v")))
        flat = self.table.select("rb", F.explode(own).alias("o")).select((F.col("rb") * self.rows + F.col("o.r")).alias("row"), F.filter("o.v", lambda z: z.isNotNull()).alias("v"))
        return flat.groupBy("row").agg(F.sum(F.aggregate("v", F.lit(0.0), lambda a, z: a + z)).alias("total"), F.sum(F.size("v")).cast("long").alias("n"))

    def lookup(self, wanted: DataFrame, row: str) -> DataFrame:
        """wanted with cb and part for each band of columns: the row's values there. Rows that the matrix lacks are left out.

        A block is the one row of its key, so the join spreads rows that are wanted often.
        """
        most = self.table.agg(F.coalesce(F.max("cb"), F.lit(-1)).alias("cb")).first().cb + 1
        table = self.table.select((F.col("rb") * most + F.col("cb")).alias("__key"), "ri", "ci", "x")
        bands = F.explode(F.sequence(F.lit(0), F.lit(max(0, most - 1)))).alias("cb")
        keyed = wanted.select(*wanted.columns, bands).withColumn("cb", F.col("cb").cast("long")).withColumn("__key", F.floor(F.col(row) / self.rows) * most + F.col("cb"))
        got = storage.join_keys(keyed, table, "__key", "inner")
        at = F.array_position("ri", (F.col(row) % self.rows).cast("int"))
        w = F.size("ci")
        return got.withColumn("__at", at).where(F.col("__at") > 0).select(*wanted.columns, "cb", F.slice("x", ((F.col("__at") - 1) * w + 1).cast("int"), w).alias("part"))

    def means(self, members: DataFrame, key: str, row: str) -> DataFrame:
        """key, col, mean: the mean of the rows that members(key, row) name, each as often as it is named."""
        named = members.groupBy(key, row).agg(F.count(F.lit(1)).alias("__n"))
        got = self.lookup(named, row).select(key, "cb", "__n", F.posexplode("part").alias("k", "v"))
        mean: Column = F.sum(F.col("v") * F.col("__n")) / F.sum(F.when(F.col("v").isNotNull(), F.col("__n")))
        return got.groupBy(key, (F.col("cb") * self.cols + F.col("k")).alias("col")).agg(mean.alias("mean"))
