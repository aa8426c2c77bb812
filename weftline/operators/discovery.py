"""New words: character sequences that hold together inside and are free at their sides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import storage


def grams(docs: DataFrame, runs: Column, longest: int) -> DataFrame:
    """gram, n: every character sequence of 1 to `longest` characters inside the runs of texts, with its occurrences.

    Equal runs are counted first, so that a frequent word is cut into its sequences once.
    """
    counted = docs.select(F.explode(runs).alias("run")).groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    size = F.length("run")
    of = lambda k: F.transform(F.sequence(F.lit(1), size - k + 1), lambda i: F.substring("run", i, F.lit(k)))
    cut = F.concat(*[F.when(size >= k, of(k)).otherwise(F.array().cast("array<string>")) for k in range(1, longest + 1)])
    return counted.select(F.explode(cut).alias("gram"), "n").groupBy("gram").agg(F.sum("n").alias("n"))


def candidates(docs: DataFrame, runs: Column, longest: int = 4, least: int = 5) -> DataFrame:
    """gram, n, cohesion, left, right of sequences of 2 to `longest` characters that occur `least` times or more.

    cohesion is the least of ln(p(gram) / (p(a) p(b))) over the gram's cuts into a and b, where p is a sequence's share of
    all of its length. left and right are the entropies (natural) of the characters next to the gram; the side of a run
    counts as one character. Counts of longer sequences give the neighbours, so texts are cut and shuffled once.
    """
    counts = storage.materialize(grams(docs, runs, longest + 1).withColumn("k", F.length("gram")), "grams")
    totals = counts.groupBy("k").agg(F.sum("n").alias("total"))  # a row for each length
    sized = storage.materialize(counts.where(F.col("k") <= longest).join(F.broadcast(totals), "k"), "sized")
    known = sized.where((F.col("k") >= 2) & (F.col("n") >= least)).select("gram", "n", "k", (F.col("n") / F.col("total")).alias("p"))
    known = storage.materialize(known, "candidates")
    share = sized.select(F.col("gram"), (F.col("n") / F.col("total")).alias("q"))
    cuts = known.select("gram", "k", "p", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.select("gram", "p", F.substring("gram", F.lit(1), F.col("at")).alias("a"), F.substring("gram", F.col("at") + 1, F.col("k")).alias("b"))
    cuts = storage.join_keys(cuts, share.select(F.col("gram").alias("a"), F.col("q").alias("qa")), "a", "inner", salt=F.xxhash64("gram"))
    cuts = storage.join_keys(cuts, share.select(F.col("gram").alias("b"), F.col("q").alias("qb")), "b", "inner", salt=F.xxhash64("gram"))
    cohesion = cuts.groupBy("gram").agg(F.min(F.log(F.col("p") / (F.col("qa") * F.col("qb")))).alias("cohesion"))

    def side(start: int, name: str) -> DataFrame:
        longer = counts.where(F.col("k") >= 3)
        own = longer.select(F.substring("gram", F.lit(start), F.col("k") - 1).alias("gram"), "n")
        return own.groupBy("gram").agg(F.sum("n").alias(f"{name}_n"), F.sum(F.col("n") * F.log(F.col("n").cast("double"))).alias(f"{name}_s"))

    def entropy(name: str) -> Column:
        n, inside = F.col("n"), F.coalesce(F.col(f"{name}_n"), F.lit(0))
        edge = n - inside  # occurrences at the side of a run
        return F.log(n.cast("double")) - (F.coalesce(F.col(f"{name}_s"), F.lit(0.0)) + F.when(edge > 0, edge * F.log(edge.cast("double"))).otherwise(0.0)) / n

    got = known.join(cohesion, "gram").join(side(2, "left"), "gram", "left").join(side(1, "right"), "gram", "left")
    return got.select("gram", "n", "cohesion", entropy("left").alias("left"), entropy("right").alias("right"))


def accepted(found: DataFrame, cohesion: float = 3.0, entropy: float = 1.0) -> DataFrame:
    """Candidates that hold together and have free sides."""
    return found.where((F.col("cohesion") >= cohesion) & (F.least("left", "right") >= entropy))
