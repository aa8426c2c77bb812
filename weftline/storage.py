"""Tables in the folder that driver and executors share, and joins and numberings that hold at any size."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import window as W

#: A side is broadcast only after its rows and their bytes have been summed and are at most these.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20

_made: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or a temporary folder where it is unset and all runs in one process, as in tests."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="weftline-")
        spark.conf.set("spark.checkpoint.dir", at)
        _made.append((spark, at))
    return at.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses; removed when this process ends."""
    at = f"{shared_dir(spark)}/weftline/{name}-{uuid.uuid4().hex}"
    _made.append((spark, at))
    return at


def remove(spark: SparkSession, at: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@atexit.register
def _clean() -> None:
    for spark, at in _made:
        try:
            remove(spark, at)
        except Exception:  # noqa: BLE001  the session may have ended before
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as a table in the shared folder and read it: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    at = new_path(spark, name)
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def width(name: str, kind: T.DataType) -> Column:
    """About how many bytes a column has in a row."""
    c = F.col(f"`{name}`")
    if isinstance(kind, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        own = F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 8) if isinstance(inner, T.StringType | T.BinaryType) else F.size(c) * (8 if not isinstance(inner, T.StructType) else 8 * len(inner))
        return F.coalesce(own, F.lit(0)) + 8
    return F.lit(8)


def fits(df: DataFrame) -> bool:
    """Whether a table is small enough in rows and bytes to be broadcast."""
    size = sum((width(f.name, f.dataType) for f in df.schema), F.lit(0)).cast("long")
    got = df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes")).first()
    return got.n <= BROADCAST_ROWS and got.bytes <= BROADCAST_BYTES


def join_keys(rows: DataFrame, keys: DataFrame, on: str, how: str = "left", parts: int = 32, salt: Column | None = None) -> DataFrame:
    """Join `rows` to `keys`, which has one row for each value of `on`.

    Small tables of keys (summed first) are broadcast. Others are joined by (key, salt), so that a frequent key is
    spread: the salts that a key has are found by an aggregation that combines before its shuffle.
    """
    if fits(keys):
        return rows.join(F.broadcast(keys), on, how)
    salt = F.xxhash64(*[c for c, t in rows.dtypes if not t.startswith("map")]) if salt is None else salt
    rows = rows.withColumn("__salt", F.pmod(salt, F.lit(parts)))
    have = rows.groupBy(on, "__salt").agg(F.count(F.lit(1)).alias("__n")).drop("__n")
    return rows.join(have.join(keys, on), [on, "__salt"], how).drop("__salt")


def number_rows(df: DataFrame, order: list[Column], name: str = "row") -> DataFrame:
    """Number rows from 0 in a global order without bringing them to one task.

    Rows are range-partitioned and sorted, written once, and each partition's numbers start after the rows of those before it.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "numbered").withColumn("__part", F.shiftright("__at", 33))
    counts = ranged.groupBy("__part").agg(F.count(F.lit(1)).alias("__n"))  # one row for each partition
    first = F.coalesce(F.sum("__n").over(W.Window.orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select("__part", first.alias("__first"))
    return ranged.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__first") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).drop("__part", "__at", "__first")


def running_sum(df: DataFrame, value: str, order: list[Column], name: str = "cum", kind: str = "long") -> DataFrame:
    """Add the sum of `value` over all rows up to and with each one, in a global order, in two levels of prefix sums."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    ranged = materialize(ranged, "running").withColumn("__part", F.shiftright("__at", 33))
    totals = ranged.groupBy("__part").agg(F.sum(value).alias("__s"))
    before = F.coalesce(F.sum("__s").over(W.Window.orderBy("__part").rowsBetween(W.Window.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.select("__part", before.alias("__before"))
    own = F.sum(value).over(W.Window.partitionBy("__part").orderBy("__at").rowsBetween(W.Window.unboundedPreceding, 0))
    return ranged.withColumn(name, own).join(F.broadcast(offsets), "__part").withColumn(name, (F.col(name) + F.col("__before")).cast(kind)).drop("__part", "__at", "__before")


#: Rows of one key that are scanned together; a longer key is cut into segments.
SEGMENT = 100_000


def running(df: DataFrame, key: str, row: str, values: dict[str, tuple[str, Column]], segment: int = SEGMENT) -> DataFrame:
    """Add, for each name, the running "min", "max" or "sum" of a value over the key's rows up to and with each one.

    `row` is a number of rows in the global order of (key, order), as `number_rows` gives it. A key's rows are cut into segments
    of at most `segment` by that number; each is scanned by itself, and starts from what the key's segments before it add up
    to, of which there is one row a segment. So no key is scanned in one task.
    """
    spec = {"min": (F.min, F.least), "max": (F.max, F.greatest), "sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0)))}
    cut = df.withColumn("__seg", F.floor(F.col(row) / segment)).withColumns({f"__v_{n}": v for n, (_, v) in values.items()})
    ends = cut.groupBy(key, "__seg").agg(*[spec[k][0](f"__v_{n}").alias(f"__s_{n}") for n, (k, _) in values.items()])
    before = W.Window.partitionBy(key).orderBy("__seg").rowsBetween(W.Window.unboundedPreceding, -1)
    ends = ends.select(key, "__seg", *[spec[k][0](f"__s_{n}").over(before).alias(f"__b_{n}") for n, (k, _) in values.items()])
    upto = W.Window.partitionBy(key, "__seg").orderBy(row).rowsBetween(W.Window.unboundedPreceding, 0)
    cut = cut.withColumns({f"__r_{n}": spec[k][0](f"__v_{n}").over(upto) for n, (k, _) in values.items()})
    both = cut.join(ends.withColumnRenamed(key, "__key"), cut[key].eqNullSafe(F.col("__key")) & (cut["__seg"] == ends["__seg"])).drop(ends["__seg"])
    out = both.withColumns({n: spec[k][1](F.col(f"__r_{n}"), F.col(f"__b_{n}")) for n, (k, _) in values.items()})
    return out.drop("__key", "__seg", *[f"__{p}_{n}" for n in values for p in "vbr"])
