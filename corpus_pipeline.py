"""The corpus pipeline: documents through language ID, near-dedup, decontamination, mixing and sharding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read again as the next
one's docs. All but the last keep the columns of documents.

Defined cases, in any stage: nulls in any column are ordinary values; texts without a letter go in the first stage;
of rows that repeat in doc_id and words one stays after the second, and of rows without a doc_id one for each text that
no document has; very long texts are one row; ties go to the least doc_id; an empty table gives an empty result;
extra columns are carried, and where one has the name of a column that the last stage adds, the added one's name gets
underscores at its end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm import common, decontam, langid, mixing, neardup, sharding


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: documents without a letter, or far from every language's centroids, go."""
    return langid.keep_known(spark, docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8, five words and a similarity of 0.8: of each group the document with the least doc_id stays."""
    return neardup.deduplicate(spark, docs, k=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: documents with benchmark passages over a twentieth of their words go."""
    return decontam.remove(spark, docs, common.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 2: documents are left out or repeated until each source has its target."""
    return mixing.remix(spark, docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 3: 24 shards of near equal bytes; the rewritten files' rows with size, shard and slot."""
    files = sharding.reshard(spark, docs)
    taken = {c.lower() for c in docs.columns}
    added = []
    for name in ("size", "shard", "slot"):
        free = name
        while free in taken:
            free += "_"
        taken.add(free)
        added.append(F.col(f"__{name}").alias(free))
    return files.select(*docs.columns, *added)


STAGES = [("language_id", language_id), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("mix", mix), ("shard", shard)]

#: None: the centroids that language ID learns are beyond SQL. Tests hold near-duplicates, decontamination and mixing
#: against plain versions or SQL, sharding by its round trip, and language ID by planted rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.materialize(spark, stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
