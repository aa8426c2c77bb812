"""Golden cases of text and array functions."""

import math

import pytest
from pyspark.sql import functions as F

from weftline.functions import arrays, text


@pytest.fixture
def value(spark):
    return lambda c: spark.range(1).select(c.alias("x")).first().x


def ints(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<int>")


def strings(*xs):
    return F.array(*[F.lit(x) for x in xs]).cast("array<string>")


def test_padding(value):
    assert value(arrays.pad(ints(7, 8), 5)) == [7, 8, 0, 0, 0]
    assert value(arrays.pad(ints(1, 2, 3), 2)) == [1, 2] and value(arrays.pad(ints(), 2)) == [0, 0]
    assert value(arrays.pad_reversed(ints(5, 6), 100)) == [0] * 98 + [6, 5]
    assert value(arrays.close_and_pad(ints(5, 6), 100)) == [5, 6, 3] + [0] * 97
    assert value(arrays.close_and_pad(ints(*range(10, 160)), 100)) == [*range(10, 109), 3]
    assert value(arrays.shift_right(ints(5, 6, 3, 0))) == [2, 5, 6, 3]


def test_cutting(value):
    assert value(arrays.until_end(ints(5, 6, 3, 9))) == [5, 6] and value(arrays.until_end(ints(5, 6, 9))) == [5, 6, 9]
    assert value(arrays.without(ints(5, 3, 6, 0), 3, 0)) == [5, 6]


def test_backward_ngrams(value):
    assert value(arrays.backward_ngrams(strings("a", "b", "c"), 2)) == ["a", "b", "a b", "c", "b c"]
    assert value(arrays.backward_ngrams(strings("a", "b", "c"), 3)) == ["a", "b", "a b", "c", "b c", "a b c"]
    assert value(arrays.backward_ngrams(strings(), 2)) == []


def test_characters(value):
    hot = value(arrays.one_hot(text.chars(F.lit("b?a")), "abc", 10))
    assert [(r.pos, r.idx) for r in hot] == [(0, 1), (2, 0)]
    assert value(text.char_index("abc", F.lit("c"))) == 2 and value(text.char_index("abc", F.lit("z"))) == -1
    assert value(text.chars(F.lit("aé😀"))) == ["a", "é", "😀"]


def test_text(value):
    assert value(text.newlines_to_stops(F.lit("A\n\nB\nC"))) == "A. B. C"
    assert value(text.split_words(F.lit("  a \t b\nc "))) == ["a", "b", "c"] and value(text.split_words(F.lit(""))) == []
    assert value(text.split_on(F.lit("a\t\tb\t\t"), "\t\t")) == ["a", "b", ""]
    assert value(text.split_lines(F.lit("a\r\nb\x0bc\n"))) == ["a", "b", "c"]
    assert value(text.tokenize(F.lit("It's 5 o'clock."))) == ["It", "'", "s", "5", "o", "'", "clock", "."]
    assert value(text.join_fields(F.lit("a"), F.lit(None), F.lit("b"))) == "a  b"
    assert value(text.label_from(F.lit(" 3 "))) == 2 and value(text.drop_bad_bytes(F.lit("a�b"))) == "ab"
    assert value(text.strip_newline(F.lit("x\n"))) == "x" and value(text.strip_newline(F.lit("x"))) == "x"


def test_numbers(value):
    assert value(arrays.moving_average(F.lit([1.0, 2.0, 3.0]))) == pytest.approx(1.1475)
    assert value(arrays.moving_average(F.array().cast("array<double>"))) is None
    assert value(arrays.log_sigmoid(F.lit(0.0))) == pytest.approx(-math.log(2)) and value(arrays.clamp(F.lit(42.0))) == 10
    assert value(arrays.softmax(F.lit([1000.0, 1000.0]))) == pytest.approx([0.5, 0.5])
    assert sum(value(arrays.masked_softmax(F.lit([1.0, 2.0]), ints(0, 0)))) == 0
    assert value(arrays.argmax(F.lit([1.0, 3.0, 3.0]))) == 1
    assert value(arrays.cross_entropy(F.lit([0.0, 0.0]), F.lit(1))) == pytest.approx(math.log(2))


@pytest.mark.parametrize(("losses", "best", "stop"), [([1.0, 0.9, 0.95, 0.95], 0.9, 4), ([1.0, 1.0, 1.0], 1.0, None), ([1.0, 2.0, 3.0, 0.1], 1.0, 3), ([], None, None)])
def test_early_stopping(value, losses, best, stop):
    got = value(arrays.early_stop(F.array(*[F.lit(x) for x in losses]).cast("array<double>"), 2))
    assert (got.best, got.stop_at) == (best, stop)
