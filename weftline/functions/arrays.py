"""Array functions as Spark expressions: padding, shifting, n-grams, and vector arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, UNKNOWN, START, END = 0, 1, 2, 3


def bind(x: Column, f) -> Column:
    """f(x) with x evaluated once, however often f names it (also inside lambdas)."""
    return F.element_at(F.transform(F.array(x), f), 1)


def pad(ids: Column, n: int, value: int = PAD) -> Column:
    """Exactly n ids: cut at the right or filled there."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(value).cast("int"), F.greatest(F.lit(0), F.lit(n) - F.size(ids)))), 1, n)


def pad_reversed(ids: Column, n: int) -> Column:
    """Padded, then turned round, so that padding leads."""
    return F.reverse(pad(ids, n))


def close_and_pad(ids: Column, n: int) -> Column:
    """At most n - 1 ids, the end mark, then padding."""
    return pad(F.concat(F.slice(ids, 1, n - 1), F.array(F.lit(END).cast("int"))), n)


def shift_right(ids: Column) -> Column:
    """The start mark before all but the last id."""
    return F.concat(F.array(F.lit(START).cast("int")), F.slice(ids, 1, F.size(ids) - 1))


def until_end(ids: Column) -> Column:
    """Ids before the first end mark."""
    at = F.array_position(ids, END).cast("int")
    return F.when(at > 0, F.slice(ids, 1, at - 1)).otherwise(ids)


def without(ids: Column, *values: int) -> Column:
    return F.filter(ids, lambda x: ~x.isin(*values))


def backward_ngrams(words: Column, n: int) -> Column:
    """For each word, it alone and then with one to n - 1 words before it."""

    def grams(w: Column) -> Column:
        all_ = F.transform(w, lambda x, i: F.transform(F.sequence(F.lit(0), F.least(F.lit(n - 1), i)), lambda j: F.when(j == 0, x).otherwise(F.array_join(F.slice(w, i - j + 1, j + 1), " "))))
        return F.flatten(all_)

    return bind(words, grams)


def one_hot(text_chars: Column, alphabet: str, n: int) -> Column:
    """(pos, idx) of the first n characters that are in the alphabet; others have a zero row."""
    cells = F.transform(F.slice(text_chars, 1, n), lambda c, i: F.struct(i.alias("pos"), (F.position(c, F.lit(alphabet)) - 1).cast("int").alias("idx")))
    return F.filter(cells, lambda x: x["idx"] >= 0)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y))


def mean_of_two(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: (x + y) / 2)


def argmax(values: Column) -> Column:
    """Place of the first largest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def softmax(x: Column) -> Column:
    shifted = bind(x, lambda y: bind(F.array_max(y), lambda top: F.transform(y, lambda v: F.exp(v - top))))
    return bind(shifted, lambda e: bind(total(e), lambda t: F.transform(e, lambda v: v / t)))


def masked_softmax(x: Column, ids: Column) -> Column:
    """Softmax over all places, padding then set to 0 and the rest scaled by its sum plus 1e-4."""
    kept = F.zip_with(softmax(x), ids, lambda p, i: F.when(i != PAD, p).otherwise(0.0))
    return bind(kept, lambda k: bind(total(k), lambda t: F.transform(k, lambda v: v / (t + 1e-4))))


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(v, F.lit(0.0)))


def tanh(x: Column) -> Column:
    return F.transform(x, F.tanh)


def cross_entropy(logits: Column, label: Column) -> Column:
    """Log of the summed exponentials less the label's logit."""
    return bind(logits, lambda x: bind(F.array_max(x), lambda top: top + F.log(total(F.transform(x, lambda v: F.exp(v - top)))) - F.element_at(x, label + 1)))


def clamp(x: Column, bound: float = 10.0) -> Column:
    return F.greatest(F.lit(-bound), F.least(F.lit(bound), x))


def log_sigmoid(x: Column) -> Column:
    return -F.log1p(F.exp(-x))


def moving_average(values: Column, keep: float = 0.95) -> Column:
    """Fold of ordered values: the first one, then keep * average + (1 - keep) * value."""
    return F.aggregate(values, F.lit(None).cast("double"), lambda a, x: F.coalesce(F.lit(keep) * a + F.lit(1 - keep) * x, x))


def early_stop(losses: Column, patience: int, delta: float = 0.0) -> Column:
    """(best, counter, stop_at): the fold of ordered losses, frozen once `patience` losses in a row were no better; a tie is better."""

    def step(s: Column, x: Column) -> Column:
        better = s["best"].isNull() | (-x >= -s["best"] + delta)
        counter = F.when(better, 0).otherwise(s["counter"] + 1)
        best = F.when(better, x).otherwise(s["best"])
        seen = s["seen"] + 1
        stop = F.when(counter >= patience, seen)
        moved = F.struct(best.alias("best"), counter.alias("counter"), seen.alias("seen"), stop.cast("int").alias("stop_at"))
        return F.when(s["stop_at"].isNotNull(), s).otherwise(moved)

    start = F.struct(F.lit(None).cast("double").alias("best"), F.lit(0).alias("counter"), F.lit(0).alias("seen"), F.lit(None).cast("int").alias("stop_at"))
    return F.aggregate(losses, start, step)


def text_of(values: Column) -> Column:
    """An array as text, its values joined by commas."""
    return F.array_join(F.transform(values, lambda x: x.cast("string")), ",")
