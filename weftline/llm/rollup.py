"""Token counts by source, language and tokenizer version, kept up to date by signed deltas.

A batch of changes (inserts, deletes and revised counts) becomes signed rows, is summed by key before its
shuffle, and is written as one small delta table in a folder named by the batch. A batch counts as committed when
Spark's job commit has put `_SUCCESS` into its folder; committing it again does nothing, and what a failed
attempt left is overwritten. Totals are the sums of all committed deltas, so batches may come in any
order; `compact` folds them into a snapshot that remembers which batches it holds.

Defined cases: null keys are a key of their own; null counts are 0; keys whose documents are all gone are left
out of the totals; a repeated change row counts as often as it occurs, a repeated batch once; an unknown kind of
change fails the batch before anything is committed; empty batches commit; columns beyond the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

KEYS = ("source", "lang", "version")
SUMS = ("docs", "tokens")
#: Word patterns by tokenizer version.
TOKENIZERS = {"space-1": common.WORD, "alnum-2": r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"}


def count_tokens(text: Column, version: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(TOKENIZERS[version])), F.lit(0)).cast("long")


def signed(changes: DataFrame) -> DataFrame:
    """Delta sums of changes(op, source, lang, version, tokens, old_source, old_lang, old_version, old_tokens).

    op: insert adds the new values, delete takes the old ones away, revise does both.
    """
    side = lambda sign, old: F.struct(*[F.col(f"{old}{k}").cast("string").alias(k) for k in KEYS], F.lit(sign).cast("long").alias("docs"), (sign * F.coalesce(F.col(f"{old}tokens"), F.lit(0))).cast("long").alias("tokens"))
    both = F.when(F.col("op") == "insert", F.array(side(1, ""))).when(F.col("op") == "delete", F.array(side(-1, "old_"))).when(F.col("op") == "revise", F.array(side(1, ""), side(-1, "old_")))
    both = F.coalesce(both, F.raise_error(F.concat(F.lit("unknown change: "), F.coalesce(F.col("op"), F.lit("null")))))
    return changes.select(F.explode(both).alias("d")).select("d.*").groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS])


class Rollup:
    """The store of deltas and snapshots under a folder."""

    def __init__(self, spark: SparkSession, at: str) -> None:
        self.spark, self.at = spark, at.rstrip("/")

    def _listed(self, kind: str) -> dict[str, str]:
        """Complete tables `kind=NAME` by name."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(self.at)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return {}
        found = {s.getPath().getName(): s.getPath() for s in fs.listStatus(root)}
        return {n.split("=", 1)[1]: p.toString() for n, p in found.items() if n.startswith(f"{kind}=") and fs.exists(hadoop.Path(p, "_SUCCESS"))}

    def _state(self) -> tuple[str | None, set[str], dict[str, str]]:
        """The latest snapshot, the batches in it, and the paths of committed batches beyond it."""
        snapshots, batches = self._listed("totals"), self._listed("batch")
        if not snapshots:
            return None, set(), batches
        last = max(snapshots, key=int)
        folded = {r.batch for r in self.spark.read.parquet(f"{self.at}/folded={last}").collect()}  # names of batches, not data
        return snapshots[last], folded, {k: p for k, p in batches.items() if k not in folded}

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it had been committed before."""
        _, folded, batches = self._state()
        if batch in folded or batch in batches:
            return False
        signed(changes).repartition(1).write.mode("overwrite").parquet(f"{self.at}/batch={batch}")  # one file, but not one task that aggregates
        return True

    def totals(self) -> DataFrame:
        """source, lang, version, docs and tokens of all committed batches."""
        snapshot, _, batches = self._state()
        return self._sum(snapshot, batches)

    def _sum(self, snapshot: str | None, batches: dict[str, str]) -> DataFrame:
        schema = "source string, lang string, version string, docs long, tokens long"
        paths = [*([snapshot] if snapshot else []), *batches.values()]
        deltas = self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return deltas.groupBy(*KEYS).agg(*[F.sum(c).alias(c) for c in SUMS]).where("docs <> 0 OR tokens <> 0")

    def compact(self) -> None:
        """Fold all committed batches into a new snapshot; it counts once its totals are complete.

        Names and totals come from one listing, so a batch that is committed meanwhile is in neither and stays a delta.
        """
        snapshot, folded, batches = self._state()
        number = max([0, *map(int, self._listed("totals"))]) + 1
        names = sorted(folded | set(batches))
        self.spark.createDataFrame([(n,) for n in names], "batch string").coalesce(1).write.mode("overwrite").parquet(f"{self.at}/folded={number}")
        self._sum(snapshot, batches).repartition(1).write.mode("overwrite").parquet(f"{self.at}/totals={number}")

    def stream(self, changes: DataFrame, checkpoint: str, name: str = "stream"):
        """Commit each micro-batch of a streaming frame of changes; a replayed one changes nothing."""
        return changes.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, n: self.commit(f"{name}-{n}", df) and None).start()


def change(df: DataFrame, op: str, new: str | None, old: str | None) -> DataFrame:
    """Changes of one kind for df(source, lang, and a column of counts for each version)."""
    side = lambda version, prefix: [F.col("source").alias(f"{prefix}source"), F.col("lang").alias(f"{prefix}lang"), F.lit(version).alias(f"{prefix}version"), (F.col(f"`{version}`") if version else F.lit(None).cast("long")).alias(f"{prefix}tokens")]
    return df.select(F.lit(op).alias("op"), *side(new, ""), *side(old, "old_"))


def replay(spark: SparkSession, docs: DataFrame, labels: DataFrame, at: str | None = None) -> DataFrame:
    """The life of a corpus as batches: all documents arrive, those not in English get the newer tokenizer, toxic ones go; two batches come twice."""
    foreign = F.coalesce(F.col("lang") != "en", F.lit(False))
    newer = F.when(foreign, count_tokens(F.col("text"), "alnum-2"))  # only the rows that are revised need it
    counted = docs.select("doc_id", "source", "lang", count_tokens(F.col("text"), "space-1").alias("space-1"), newer.alias("alnum-2"))
    counted = common.materialize(spark, counted, "token-counts")
    store = Rollup(spark, at or common.new_path(spark, "rollup"))
    bad = counted.join(labels.where("toxic = 1").select("doc_id").distinct(), "doc_id", "left_semi")
    revised = change(counted.where(foreign), "revise", "alnum-2", "space-1")
    gone = change(bad.where(foreign), "delete", None, "alnum-2").unionByName(change(bad.where(~foreign), "delete", None, "space-1"))
    store.commit("arrivals", change(counted, "insert", "space-1", None))
    store.commit("revision", revised)
    store.compact()
    store.commit("takedown", gone)
    store.commit("revision", revised)
    store.commit("takedown", gone)
    return store.totals()


SQL = r"""
WITH d AS (
  SELECT source, lang, CASE WHEN lang <> 'en' THEN 'alnum-2' ELSE 'space-1' END AS version, text FROM documents
  WHERE doc_id IS NULL OR doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1 AND doc_id IS NOT NULL))
SELECT source, lang, version, count(*)::BIGINT AS docs,
       sum(len(regexp_extract_all(coalesce(text, ''), CASE WHEN version = 'alnum-2' THEN '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+' ELSE '[^\x20\x09-\x0D]+' END)))::BIGINT AS tokens
FROM d GROUP BY ALL
"""
