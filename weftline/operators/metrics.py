"""Evaluation metrics as aggregates: accuracy, losses, perplexity, averages, early stopping and BLEU."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import storage
from weftline.functions import arrays


def accuracy(rows: DataFrame, predicted: Column, label: Column) -> DataFrame:
    return rows.agg(F.avg((predicted == label).cast("double")).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def masked_mean_loss(rows: DataFrame, loss: Column, weight: Column) -> DataFrame:
    """Sum of loss times weight over the number of weights that are not 0."""
    return rows.agg((F.sum(loss * weight) / F.sum((weight != 0).cast("long"))).alias("loss"))


def perplexity(rows: DataFrame, sentence: str, loss: Column, weight: Column) -> DataFrame:
    """Mean over sentences of exp of their masked mean loss."""
    own = rows.groupBy(sentence).agg((F.sum(loss * weight) / F.sum((weight != 0).cast("long"))).alias("m"))
    return own.agg(F.avg(F.exp("m")).alias("perplexity"), F.count(F.lit(1)).alias("n_sentences"))


def summed_batch_loss(rows: DataFrame, batch: Column, loss: Column) -> DataFrame:
    """Sum of the batches' mean losses."""
    return rows.groupBy(batch.alias("batch")).agg(F.avg(loss).alias("m")).agg(F.sum("m").alias("loss"))


def moving_average(rows: DataFrame, key: str, order: list[str], value: str, keep: float = 0.95) -> DataFrame:
    """key, ema and n: the average after each key's last value, in its closed form.

    A value that has d values after it weighs keep ** d, times 1 - keep unless it is the first. Rows are numbered in the
    order of (key, order) by ranges and then summed with partial sums, so no key's values need to be in one task.
    """
    plain = rows.select(key, *order, F.col(value).cast("double").alias("__v"))
    numbered = storage.number_rows(plain, [F.col(key).asc(), *[F.col(c).asc() for c in order]], "__row")
    ends = numbered.groupBy(key).agg(F.min("__row").alias("__lo"), F.max("__row").alias("__hi"))
    known = storage.join_keys(numbered.select(key, "__row", "__v"), ends, key, "inner", salt=F.col("__row"))
    weight = F.pow(F.lit(keep), F.col("__hi") - F.col("__row")) * F.when(F.col("__row") == F.col("__lo"), 1.0).otherwise(1 - keep)
    return known.groupBy(key).agg(F.sum(F.col("__v") * weight).alias("ema"), F.count(F.lit(1)).alias("n"))


def interval_means(rows: DataFrame, step: Column, value: Column, every: int = 100) -> DataFrame:
    """Mean of each run of `every` steps."""
    return rows.groupBy(F.floor(step / every).alias("interval")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n"))


def early_stops(rows: DataFrame, key: str, order: list[str], loss: str, patience: int) -> DataFrame:
    """key, best, counter, stop_at of each key's losses in order: where the first `patience` losses in a row are above the best one before.

    best and counter are those at the stop, or at the end; a loss alike to the best counts as an improvement. Rows
    are numbered by ranges and scanned in segments: the running least loss tells improvements, the running last improvement
    the counter, so one key may have any number of rows.
    """
    plain = rows.select(key, *order, F.col(loss).cast("double").alias("__v"))
    numbered = storage.number_rows(plain, [F.col(key).asc(), *[F.col(c).asc() for c in order]], "__row").select(key, "__row", "__v")
    numbered = storage.materialize(numbered, "losses")
    least = storage.materialize(storage.running(numbered, key, "__row", {"__best": ("min", F.col("__v"))}), "least")
    # a loss that is its own running least is an improvement
    better = F.when(F.col("__v") <= F.col("__best"), F.col("__row"))
    steps = storage.running(least, key, "__row", {"__last": ("max", better), "__n": ("sum", F.lit(1))})
    steps = steps.withColumn("__counter", F.col("__row") - F.col("__last"))
    stop = F.min(F.when(F.col("__counter") >= patience, F.struct("__n", "__best", "__counter")))
    end = F.max(F.struct("__n", "__best", "__counter"))
    got = steps.groupBy(key).agg(stop.alias("stop"), end.alias("end"))
    at = lambda c: F.coalesce(F.col(f"stop.{c}"), F.col(f"end.{c}"))
    return got.select(key, at("__best").alias("best"), at("__counter").cast("long").alias("counter"), F.col("stop.__n").cast("long").alias("stop_at"))


def ngram_matches(pairs: DataFrame, key: str, most: int = 4) -> DataFrame:
    """key, n, clipped and total: how many n-grams of `pred` occur in `ref`, each at most as often as there."""

    def counted(words: str) -> DataFrame:
        size = pairs.select(key, F.col(words), F.size(words).alias("size"))
        flat = size.select(key, words, "size", F.explode(F.sequence(F.lit(1), F.lit(most))).alias("n")).where("size >= n")
        flat = flat.select(key, "n", F.explode(F.transform(F.sequence(F.lit(1), F.col("size") - F.col("n") + 1), lambda i: F.array_join(F.slice(F.col(words), i, F.col("n")), "\x01"))).alias("g"))
        return flat.groupBy(key, "n", "g").agg(F.count(F.lit(1)).alias(f"c_{words}"))

    both = counted("pred").join(counted("ref"), [key, "n", "g"], "left")
    return both.groupBy(key, "n").agg(F.sum(F.least("c_pred", F.coalesce("c_ref", F.lit(0)))).alias("clipped"), F.sum("c_pred").alias("total"))


def corpus_bleu(pairs: DataFrame, key: str, most: int = 4) -> DataFrame:
    """One row: BLEU times 100 of `pred` against one `ref` each: clipped precisions of 1 to 4 words, uniform weights, no smoothing, brevity penalty."""
    sums = ngram_matches(pairs, key, most).groupBy("n").agg(F.sum("clipped").alias("clipped"), F.sum("total").alias("total"))
    log_p = sums.agg(F.sum(F.when(F.col("clipped") > 0, F.log(F.col("clipped") / F.col("total")))).alias("log_p"), F.sum((F.col("clipped") > 0).cast("int")).alias("orders"))
    size = pairs.agg(F.sum(F.size("pred")).alias("c"), F.sum(F.size("ref")).alias("r"))
    one = log_p.withColumn("k", F.lit(1)).join(size.withColumn("k", F.lit(1)), "k")  # one row each
    score = 100 * F.exp(F.least(F.lit(0.0), 1 - F.col("r") / F.col("c"))) * F.exp(F.col("log_p") / most)
    return one.select(F.when(F.col("orders") == most, score).otherwise(0.0).alias("bleu"), F.col("c").cast("long").alias("pred_words"), F.col("r").cast("long").alias("ref_words"))
