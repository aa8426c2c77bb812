"""Training metrics as Structured Streaming: moving averages and early stopping, one state for each run.

State is a few numbers a key; a restart takes it from the stream's checkpoint. Within a micro-batch rows are folded
in the order of `order`, so batches must come in that order: a row that comes in a later batch than its place is folded
in where it arrives. State lives as long as the stream, a few numbers for each key that was ever seen.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline import storage


def moving_average(stream: DataFrame, key: str, order: list[str], value: str, keep: float = 0.95) -> DataFrame:
    """key, n and ema after each micro-batch that touches the key."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, ema = state.get if state.exists else (0, None)
        rows = pd.concat(list(parts)).sort_values(order, kind="stable")
        for x in rows[value].astype(float):
            ema = x if ema is None else keep * ema + (1 - keep) * x
            n += 1
        state.update((n, ema))
        yield pd.DataFrame({key: [k[0]], "n": [n], "ema": [ema]})

    kind = stream.schema[key].dataType.simpleString()
    return stream.select(key, *order, value).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, n long, ema double", "n long, ema double", "update", "NoTimeout")


def early_stop(stream: DataFrame, key: str, order: list[str], loss: str, patience: int) -> DataFrame:
    """key, best, counter, seen and stop_at after each micro-batch; a run that has stopped does not move again."""

    def fold(k: tuple, parts: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        best, counter, seen, stop = state.get if state.exists else (None, 0, 0, None)
        for x in pd.concat(list(parts)).sort_values(order, kind="stable")[loss].astype(float):
            if stop is not None:
                break
            seen += 1
            if best is None or x <= best:
                best, counter = x, 0
            else:
                counter += 1
            stop = seen if counter >= patience else None
        state.update((best, counter, seen, stop))
        yield pd.DataFrame({key: [k[0]], "best": [best], "counter": [counter], "seen": [seen], "stop_at": pd.array([stop], dtype="Int64")})

    kind = stream.schema[key].dataType.simpleString()
    names = "best double, counter long, seen long, stop_at long"
    return stream.select(key, *order, loss).groupBy(key).applyInPandasWithState(fold, f"{key} {kind}, {names}", names, "update", "NoTimeout")


def run_once(updates: DataFrame, name: str, mode: str = "update") -> DataFrame:
    """Run a stream over what is there now, and return all rows it put out with the number of their micro-batch, `epoch`.

    Each micro-batch replaces its own folder, so one that runs twice counts once.
    """
    spark = updates.sparkSession
    at = storage.new_path(spark, name)

    def put(df: DataFrame, epoch: int) -> None:
        df.withColumn("epoch", F.lit(epoch).cast("long")).write.mode("overwrite").parquet(f"{at}/rows/{epoch}")

    updates.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(updates.schema.add("epoch", "long")).parquet(f"{at}/rows/*")


def windowed(stream: DataFrame, at: str, keys: list[str], value: str, size: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts and sums of event-time windows, closed once the watermark passes."""
    return stream.withWatermark(at, late).groupBy(F.window(at, size), *keys).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
