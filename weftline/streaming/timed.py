"""Folds in event time: rows wait until the watermark has passed them, and are folded in their order whatever batch they came in.

State of a key is its fold (a few numbers) and the rows that still wait, which the watermark's delay bounds; an event-time
timer at the earliest of them wakes the key. A key that had no row for `idle` after its last one is put out as ended and
forgotten. Rows that come later than the watermark allows are left out by Spark and counted (`run_counted`).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from weftline import storage

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows that wait together as one value of the state.
TOGETHER = 50_000
WAITS = np.dtype([("at", "<i8"), ("rank", "<i8"), ("v", "<f8")])


def _chunks(rows: np.ndarray) -> list[tuple[bytes]]:
    return [(rows[i : i + TOGETHER].tobytes(),) for i in range(0, len(rows), TOGETHER)]


class OrderedFold(StatefulProcessor):
    """key, n, value and ended after each wake: step(value so far or None, next value) over rows by (time, order)."""

    def __init__(self, key: str, step: Callable[[float | None, float], float], idle_ms: int) -> None:
        self.key, self.step, self.idle = key, step, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.fold = handle.getValueState("fold", "n long, value double, last long, wake long")
        self.waiting = handle.getListState("waiting", "rows binary")  # many rows a value

    def _wake(self, at: int, old: int) -> None:
        if old != at:
            if old >= 0:
                self.handle.deleteTimer(old)
            self.handle.registerTimer(at)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, value, last, wake = self.fold.get() if self.fold.exists() else (0, None, -1, -1)
        held = pd.concat(list(rows), ignore_index=True)
        held.columns = ["key", "time", "__at", "__rank", "__v"]  # names of computed columns do not reach the processor
        rows_ = np.empty(len(held), WAITS)
        rows_["at"], rows_["rank"], rows_["v"] = held["__at"], held["__rank"], held["__v"]
        last = max(last, int(held["__at"].max()))
        first = int(held["__at"].min())
        self.waiting.appendList(_chunks(rows_))
        pending = self.waiting.exists() and wake >= 0 and wake < last + self.idle
        at = min(wake, first) if pending else first
        self._wake(at, wake)
        self.fold.update((n, value, last, at))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n, value, last, _ = self.fold.get()
        upto = timerValues.getCurrentWatermarkInMs()
        rows = np.concatenate([np.zeros(0, WAITS), *(np.frombuffer(bytes(r[0]), WAITS) for r in self.waiting.get())])
        rows = rows[np.lexsort((rows["v"], rows["rank"], rows["at"]))]
        many = int(np.searchsorted(rows["at"], upto, "right"))
        ready, rest = rows[:many], rows[many:]
        for v in ready["v"].tolist():
            value = self.step(value, v)
            n += 1
        ended = not len(rest) and last + self.idle <= upto
        if ended:
            self.waiting.clear()
            self.fold.clear()
        else:
            if len(rest):
                self.waiting.put(_chunks(rest))
            else:
                self.waiting.clear()
            at = int(rest["at"][0]) if len(rest) else last + self.idle
            self.handle.registerTimer(at)
            self.fold.update((n, value, last, at))
        if many or ended:
            yield pd.DataFrame({self.key: [key[0]], "n": [n], "value": [value], "ended": [ended]})

    def close(self) -> None:
        pass


def ordered_fold(stream: DataFrame, key: str, time: str, rank: str, value: str, step: Callable[[float | None, float], float], delay: str = "10 minutes", idle: str = "1 day") -> DataFrame:
    """key, n, value and ended whenever the watermark has passed rows of a key.

    `time` is a timestamp and `rank` a whole number that orders rows of one time. Rows up to `delay` behind the latest are
    folded in their place; a key that has been idle for `idle` starts anew with its next row.
    """
    kind = stream.schema[key].dataType.simpleString()
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)
    marked = stream.withWatermark(time, delay).select(F.col(key), F.col(time), F.unix_millis(time).alias("__at"), F.col(rank).cast("long").alias("__rank"), F.col(value).cast("double").alias("__v"))
    return marked.groupBy(key).transformWithStateInPandas(OrderedFold(key, step, idle_ms), f"{key} {kind}, n long, value double, ended boolean", "Update", "EventTime")


def run_counted(updates: DataFrame, name: str) -> tuple[DataFrame, int]:
    """Run a stream of folds over what is there now: all rows it put out, with `epoch`, and how many rows came too late.

    Folds with timers keep their state in RocksDB; the session's provider is put back afterwards.
    """
    spark = updates.sparkSession
    at = storage.new_path(spark, name)
    conf, old = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(conf, STORE)

    def put(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/{epoch}")

    try:
        query = updates.writeStream.outputMode("update").option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start()
        query.awaitTermination()
    finally:
        spark.conf.set(conf, old)
    late = sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
    return spark.read.schema(updates.schema.add("epoch", "long")).parquet(f"{at}/rows/*"), late
