"""Folds in event time over batches that come out of order."""

import datetime as dt

from pyspark.sql import functions as F

from weftline.streaming import timed

START = dt.datetime(2024, 1, 1)


def fold(values):
    out = values[0]
    for v in values[1:]:
        out = 0.5 * out + 0.5 * v
    return out


def stream_of(spark, at, batches):
    schema = "k string, minute long, id long, v double"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(at)
        assert i < 9
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(at)
    return read.withColumn("ts", F.timestamp_millis((F.lit(int(START.timestamp() * 1000)) + F.col("minute") * 60_000).cast("long")))


def test_out_of_order_batches_give_the_batch_fold(spark, tmp_path):
    batches = [
        [("a", 1, 1, 4.0), ("b", 2, 2, 1.0), ("a", 9, 3, 8.0)],
        [("a", 5, 4, 2.0), ("b", 1, 5, 3.0), ("a", 14, 6, 6.0), ("c", 16, 7, 1.0)],  # behind rows of the first batch, within ten minutes
        [("b", 12, 9, 5.0), ("a", 14, 10, 7.0)],  # the watermark is at minute 6
        [("a", 2, 8, 99.0), ("b", 13, 13, 2.0)],  # minute 2 is too late
        [("end", 500, 11, 0.0)],
        [("end", 501, 12, 0.0)],
    ]
    got, late = timed.run_counted(timed.ordered_fold(stream_of(spark, f"{tmp_path}/in", batches), "k", "ts", "id", "v", lambda old, v: v if old is None else 0.5 * old + 0.5 * v, "10 minutes", "3 hours"), "t-timed")
    rows = got.collect()
    last = {k: max((r for r in rows if r.k == k), key=lambda r: (r.n, r.ended)) for k in {r.k for r in rows}}
    assert late == 1
    assert (last["a"].n, last["a"].value) == (5, fold([4.0, 2.0, 8.0, 6.0, 7.0]))
    assert (last["b"].n, last["b"].value) == (4, fold([3.0, 1.0, 5.0, 2.0]))
    assert (last["c"].n, last["c"].value) == (1, 1.0)
    assert all(last[k].ended for k in "abc")  # idle for over three hours: put out as ended and forgotten
