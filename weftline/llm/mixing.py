"""Mixing sources to target weights by hash-threshold histograms.

Every document gets a 60-bit hash. A source takes `full` whole copies of all its documents and one more of
those whose hash is at most the source's cut. The cut comes from nested histograms: sizes are summed by
(source, ten bits of hash), the bucket in which the running sum crosses the budget is found, and only that
bucket is summed again by the next ten bits, until it holds one hash. No document is sorted, each level
shuffles at most 1024 pre-aggregated rows a source, and reruns agree because the hash depends on the row alone. What
is known of sources is a table too, so their number is not bounded.

Defined cases: a null or wordless text has size 0; null sources form one source, ordered last; rows that
repeat with the same doc_id, text and source are numbered, and each has a hash of its own by its number, so that some of them
may be taken and others not; an empty table gives an empty result; columns other than doc_id, text and source are ignored (or carried by `remix`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

from weftline import storage

from . import common

BITS, LEVELS = 10, 6
PLAN = T.StructType([
    T.StructField("__key", T.StringType()), T.StructField("source_size", T.LongType()),
    T.StructField("target", T.DoubleType()), T.StructField("full", T.LongType()), T.StructField("cut", T.LongType()),
])


def size(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(common.WORD)), F.lit(0)).cast("long")


def doc_hash(doc_id: Column, text: Column, rank: Column | None = None) -> Column:
    """60 bits of MD5 over id and text, and over the number of a repeated row from the second on."""
    more = F.lit("") if rank is None else F.when(rank > 0, F.concat(F.lit(":"), rank.cast("string"))).otherwise("")
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit("")), more)
    return F.conv(F.substring(F.md5(whole), 1, 15), 16, 10).cast("long")


def source_key(source: Column) -> Column:
    """Never null: nulls sort last, as '~' is beyond '='."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("~"))


def goals(spark: SparkSession, sized: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """__key, source_size, target and full of each source: shares of all sizes by weight, none over cap times its size, the excess reshared.

    Water filling: sources by cap * size / weight; the first at which the level that the others share is not above that
    has the level of all that follow. Sizes are whole numbers, so their sums do not depend on the order of tasks.
    """
    sums = sized.groupBy("__key").agg(F.sum("size").alias("s"))
    named = storage.number_rows(sums, [F.col("__key").asc()], "at")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = named.select("__key", "s", weight.alias("w")).withColumn("c", F.lit(float(cap)) * F.col("s") / F.col("w"))
    order = [F.col("c").asc(), F.col("__key").asc()]
    ranked = storage.running_sum(storage.running_sum(ranked, "s", order, "upto"), "w", order, "weights", "double")
    ranked = common.materialize(spark, ranked, "mix-sources")
    total = ranked.agg(F.sum("s").alias("s"), F.sum("w").alias("w")).first()  # one row
    if total.s is None:
        return spark.createDataFrame([], PLAN).drop("cut")
    level = (F.lit(total.s) - cap * (F.col("upto") - F.col("s"))).cast("double") / (F.lit(total.w) - (F.col("weights") - F.col("w")))
    levels = ranked.withColumn("level", level)
    held = levels.where("level <= c").agg(F.min_by("level", F.struct("c", "__key")).alias("l")).first().l
    held = levels.agg(F.min_by("level", F.struct((-F.col("c")).alias("c"))).alias("l")).first().l if held is None else held
    target = F.least(F.lit(float(cap)) * F.col("s"), F.lit(held) * F.col("w"))
    full = F.when(F.col("s") > 0, F.least(F.lit(cap), F.floor(target / F.col("s")))).otherwise(0).cast("long")
    return ranked.select("__key", F.col("s").alias("source_size"), target.alias("target"), full.alias("full"))


def near(rows: DataFrame, sources: DataFrame, salt: Column) -> DataFrame:
    """Rows with the columns of their source, which are broadcast only if they are few (counted first)."""
    if sources.limit(common.BROADCAST_ROWS + 1).count() <= common.BROADCAST_ROWS:
        return rows.join(F.broadcast(sources), "__key")
    return common.lookup(rows, sources.withColumn("__there", F.lit(1)), "__key", salt).where("__there = 1").drop("__there")


def plan(spark: SparkSession, sized: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """A row for each source of sized(__key, size, h): source_size, target, full copies and the cut of one more."""
    sources = common.materialize(spark, goals(spark, sized, weights, cap), "mix-goals")
    rest = F.col("target") - F.col("full") * F.col("source_size")
    open_ = common.materialize(spark, sources.select("__key", F.lit(0).cast("long").alias("prefix"), rest.alias("rest")).where("rest > 0"), "mix-open")
    done = []
    for level in range(LEVELS):
        if open_.isEmpty():
            break
        shift = BITS * (LEVELS - level - 1)
        inside = near(sized, open_, F.col("h")).where(F.shiftright("h", shift + BITS) == F.col("prefix"))
        hist = inside.groupBy("__key", "rest", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("s"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        upto = F.sum("s").over(W.Window.partitionBy("__key").orderBy("bucket").rowsBetween(W.Window.unboundedPreceding, 0))  # at most 1024 rows
        crossed = hist.withColumn("upto", upto).where((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("s") <= F.col("rest")))
        found = open_.select("__key", "rest").join(crossed.drop("rest"), "__key", "left")
        left = F.col("rest") - (F.col("upto") - F.col("s"))
        # without a bucket the whole rest fits; a bucket of one hash is taken if that comes nearer
        one = F.when(F.col("upto") - F.col("rest") < left, F.col("hi")).otherwise(F.col("lo") - 1)
        cut = F.when(F.col("bucket").isNull(), F.lit((1 << BITS * LEVELS) - 1)).when(F.col("lo") == F.col("hi"), one)
        found = common.materialize(spark, found.select("__key", cut.alias("cut"), F.col("bucket").alias("prefix"), left.alias("rest")), "mix-cuts")
        done.append(found.where("cut IS NOT NULL").select("__key", "cut"))
        open_ = found.where("cut IS NULL").select("__key", "prefix", "rest")
    cuts = spark.createDataFrame([], "__key string, cut long")
    for part in done:
        cuts = cuts.unionByName(part)
    got = sources.join(cuts, "__key", "left").withColumn("cut", F.coalesce("cut", F.lit(-1).cast("long")))
    return common.materialize(spark, got.select(*[f.name for f in PLAN]), "mix-plan")


def numbered(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with __rank, the number of a row among those with its doc_id, text and source."""
    return common.ranked(spark, docs, F.xxhash64(F.col("doc_id").cast("string"), "text", source_key(F.col("source"))))


def mix(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """A row for each row of docs: doc_id, size, source_size, target, copies and taken (size times copies)."""
    docs = numbered(spark, docs.select("doc_id", "text", "source"))
    sized = common.materialize(spark, docs.select("doc_id", source_key(F.col("source")).alias("__key"), size(F.col("text")).alias("size"), doc_hash(F.col("doc_id"), F.col("text"), F.col("__rank")).alias("h")), "mix-sized")
    got = near(sized, plan(spark, sized, weights, cap), F.col("h")).withColumn("copies", F.col("full") + (F.col("h") <= F.col("cut")).cast("long"))
    return got.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def remix(spark: SparkSession, docs: DataFrame, weights: Sequence[float] = (1, 2, 3), cap: int = 3) -> DataFrame:
    """The mix itself: rows of docs, each as often as it is taken, with the columns of docs."""
    columns, docs = docs.columns, numbered(spark, docs)
    key, h = source_key(F.col("source")), doc_hash(F.col("doc_id"), F.col("text"), F.col("__rank"))
    sized = common.materialize(spark, docs.select(key.alias("__key"), size(F.col("text")).alias("size"), h.alias("h")), "mix-sized")
    cuts = plan(spark, sized, weights, cap).select("__key", F.col("full").alias("__full"), F.col("cut").alias("__cut"))
    common.drop(spark, sized)
    marked = docs.withColumns({"__key": key, "__h": h})
    copies = (F.col("__full") + (F.col("__h") <= F.col("__cut")).cast("long")).cast("int")
    return near(marked, cuts, F.col("__h")).withColumn("__copy", F.explode(F.array_repeat(F.lit(1), copies))).select(*columns)


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '') || CASE WHEN nth > 1 THEN ':' || (nth - 1) ELSE '' END), 1, 15))::BIGINT AS h
  FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text, source) AS nth FROM documents)),
sources AS (
  SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM sized GROUP BY source),
ranked AS (
  SELECT *, 3.0::DOUBLE * s / w AS c, row_number() OVER (ORDER BY 3.0::DOUBLE * s / w, source NULLS LAST) AS k FROM sources),
levels AS (
  SELECT k, c, (sum(s) OVER () - coalesce(3 * sum(s) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / (sum(w) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level FROM ranked),
chosen AS (SELECT level FROM levels WHERE level <= c ORDER BY k LIMIT 1),
goals AS (
  SELECT source, s, least(3.0::DOUBLE * s, level * w) AS target FROM ranked, chosen),
cuts AS (
  SELECT *, CASE WHEN s = 0 THEN 0 ELSE least(3, floor(target / s)) END AS copies_all FROM goals),
cum AS (
  SELECT z.*, c.s, c.target, c.copies_all, c.target - c.copies_all * c.s AS rest,
         sum(size) OVER (PARTITION BY z.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
         sum(size) OVER (PARTITION BY z.source, h) AS own
  FROM sized z JOIN cuts c ON z.source IS NOT DISTINCT FROM c.source)
SELECT doc_id, size, s AS source_size, target,
       (copies_all + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END)::BIGINT AS copies,
       (size * (copies_all + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM cum
"""
