"""Text functions as Spark expressions: splitting, joining, folding and looking up characters."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE = r"[ \t\n\r\f\x0B]+"
LINE_END = r"\r\n|[\n\r\x0B\f\x1C\x1D\x1E\x{85}\x{2028}\x{2029}]"
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def split_words(text: Column) -> Column:
    """Words between runs of white space."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def split_on(text: Column, separator: str) -> Column:
    """All fields between separators, empty ones too."""
    return F.split(text, re.escape(separator), -1)


def join_words(words: Column, separator: str = " ") -> Column:
    return F.array_join(words, separator)


def lower(text: Column) -> Column:
    return F.lower(text)


def newlines_to_stops(text: Column) -> Column:
    """Blank lines, then single line ends, become `. `."""
    return F.replace(F.replace(text, F.lit("\n\n"), F.lit(". ")), F.lit("\n"), F.lit(". "))


def split_lines(text: Column) -> Column:
    """Lines by every kind of line end; a final line end begins no line."""
    parts = F.split(text, LINE_END, -1)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)


def strip_newline(line: Column) -> Column:
    return F.regexp_replace(line, r"\n\z", "")


def drop_bad_bytes(text: Column) -> Column:
    """Text without the replacement characters that bad bytes were read as."""
    return F.replace(F.make_valid_utf8(text), F.lit("�"), F.lit(""))


def tokenize(text: Column) -> Column:
    """Runs of letters and digits, and every other visible character alone."""
    return F.regexp_extract_all(text, F.lit(f"({TOKEN})"), F.lit(1))


def chars(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def char_index(alphabet: str | Column, char: Column) -> Column:
    """Place of a character in the alphabet from 0, or -1."""
    at = F.lit(alphabet) if isinstance(alphabet, str) else alphabet
    return (F.position(char, at) - 1).cast("int")


def has_space(word: Column) -> Column:
    """Whether a gram has more than one word."""
    return F.contains(word, F.lit(" "))


def label_from(text: Column) -> Column:
    """Labels from 1 become classes from 0."""
    return (F.trim(text).cast("int") - 1).cast("int")


def join_fields(*fields: Column) -> Column:
    """Fields joined by one space; nulls count as empty."""
    return F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f in fields])
