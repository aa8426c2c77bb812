"""The registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weftline.llm import align, decontam, fingerprint, langid, lm, mixing, neardup, negatives, quotes, rollup, sharding, url_filter, warc
from weftline.llm.common import table


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(spark, table(spark, sf_dir, "pages"))


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(spark, table(spark, sf_dir, "documents"))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.digest(spark, table(spark, sf_dir, "pages"))


def op5_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.digest(spark, table(spark, sf_dir, "documents"))


def op6_quotes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotes.digest(spark, table(spark, sf_dir, "conversations"))


def op7_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.digest(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.link(spark, table(spark, sf_dir, "documents"), k=3, percent=85)


def op9_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollup.replay(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(spark, table(spark, sf_dir, "documents"))


def op11_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.digest(spark, table(spark, sf_dir, "documents"))


def op12_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.scores(spark, table(spark, sf_dir, "documents"))


def op13_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(spark, table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # at the repository's top

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_mixing": op2_mixing,
    "op3_sharding": op3_sharding,
    "op4_warc": op4_warc,
    "op5_fingerprint": op5_fingerprint,
    "op6_quotes": op6_quotes,
    "op7_decontam": op7_decontam,
    "op8_neardup": op8_neardup,
    "op9_rollup": op9_rollup,
    "op10_langid": op10_langid,
    "op11_align": op11_align,
    "op12_lm": op12_lm,
    "op13_negatives": op13_negatives,
    "pipeline": pipeline,
}
ORACLES: dict[str, str] = {
    "op2_mixing": mixing.SQL,
    "op4_warc": warc.SQL,
    "op6_quotes": quotes.SQL,
    "op7_decontam": decontam.SQL,
    "op8_neardup": neardup.SQL,
    "op9_rollup": rollup.SQL,
    "op13_negatives": negatives.SQL,
}
