"""Learned sentence ends: abbreviations and sentence starters by log-likelihood ratios over the corpus.

After Kiss and Strunk (2006). A type is a word in lower case without closing marks and final full stops. It is an
abbreviation if it comes with a full stop more often than chance, the more so the shorter it is and the more inner full
stops it has; it is a starter if it follows sure ends more often than chance. Everything is counted from distinct words
and from the words next to full stops; both models are tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline import storage

CLOSING = "[\"'”’»)\\]]+$"  # what may stand after a full stop
SURE = 0.99  # share of its occurrences in which an abbreviation has a full stop


def core(word: Column) -> Column:
    return F.regexp_replace(word, CLOSING, "")


def kind(word: Column) -> Column:
    """The type of a word."""
    return F.lower(F.regexp_replace(core(word), "[.]+$", ""))


def stopped(word: Column) -> Column:
    return F.endswith(core(word), F.lit("."))


def _log(k: Column, n: Column, p: Column) -> Column:
    """k ln p + (n - k) ln(1 - p), with 0 ln 0 as 0."""
    part = lambda m, q: F.when(m > 0, m * F.log(q)).otherwise(0.0)
    return part(k, p) + part(n - k, 1 - p)


def types(docs: DataFrame, words: Column) -> DataFrame:
    """type, n, n_stop: how often each type comes, and how often with a full stop."""
    counted = docs.select(F.explode(words).alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n"))
    return counted.groupBy(kind(F.col("w")).alias("type")).agg(F.sum("n").alias("n"), F.sum(F.when(stopped(F.col("w")), F.col("n")).otherwise(0)).alias("n_stop"))


def abbreviations(docs: DataFrame, words: Column, least: float = 0.3, seen: int = 3, types: DataFrame | None = None) -> DataFrame:
    """type, n, n_stop, score, short: all types with a letter that come with a full stop at least once; short marks abbreviations.

    n counts all occurrences, n_stop those with a full stop. score is the log-likelihood ratio of the type's full stops
    against the corpus's share of words with one, times the inner full stops and one, times e to minus the number of other
    characters, over that number once for each occurrence without a full stop. An abbreviation is also seen with one `seen` times or more.
    """
    types = storage.materialize(_types(docs, words), "types") if types is None else types
    total = types.agg(F.sum("n").alias("all"), F.sum("n_stop").alias("all_stop")).withColumn("one", F.lit(1))
    known = types.where((F.col("n_stop") > 0) & F.col("type").rlike(r"\p{L}")).withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    ratio = -2 * (_log(F.col("n_stop"), F.col("n"), F.col("all_stop") / F.col("all")) - _log(F.col("n_stop"), F.col("n"), F.lit(SURE)))
    inner = F.length("type") - F.length(F.replace(F.col("type"), F.lit("."), F.lit("")))
    plain = (F.length("type") - inner).cast("double")
    score = ratio * (inner + 1) * F.exp(-plain) * F.pow(plain, -(F.col("n") - F.col("n_stop")).cast("double"))
    return known.select("type", "n", "n_stop", score.alias("score"), ((score >= least) & (F.col("n_stop") >= seen)).alias("short"))


def _marked(word: Column) -> Column:
    return F.contains(word, F.lit(".")) | F.contains(word, F.lit("!")) | F.contains(word, F.lit("?"))


_types = types


def ends(docs: DataFrame, words: Column, doc: str = "doc_id") -> DataFrame:
    """doc, pos, type, word and next of every word that ends with a full stop, question mark or exclamation mark and has a word after it."""
    held = docs.select(F.col(doc).alias("doc"), words.alias("w"))
    spots = F.filter(F.sequence(F.lit(1), F.size("w") - 1), lambda i: _marked(F.get("w", i - 1)) & core(F.get("w", i - 1)).rlike("[.!?]$"))  # most words are told by the first
    flat = held.where(F.size("w") > 1).select("doc", "w", F.explode(spots).alias("i"))
    return flat.select("doc", (F.col("i") - 1).alias("pos"), F.get("w", F.col("i") - 1).alias("word"), F.get("w", F.col("i")).alias("next")).withColumn("type", kind(F.col("word")))


def starters(docs: DataFrame, words: Column, short: DataFrame, least: float = 30.0, types: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """type, n, n_first, score, starts: types that follow an end which is no abbreviation; starts marks sentence starters.

    score is the log-likelihood ratio of the type's occurrences after such ends against its occurrences elsewhere; a
    starter also has a larger share there than all words have.
    """
    found = ends(docs, words) if found is None else found
    marked = storage.join_keys(found, short.where("short").select("type", F.lit(True).alias("is_short")), "type", "left", salt=F.xxhash64("doc", "pos"))
    firsts = marked.where(F.col("is_short").isNull() | ~stopped(F.col("word"))).groupBy(kind(F.col("next")).alias("type")).agg(F.count(F.lit(1)).alias("n_first"))
    firsts = storage.materialize(firsts, "firsts")
    counted = (storage.materialize(_types(docs, words), "types") if types is None else types).select("type", "n")
    total = counted.agg(F.sum("n").alias("all")).withColumn("one", F.lit(1)).join(firsts.agg(F.sum("n_first").alias("ends")).withColumn("one", F.lit(1)), "one")
    both = counted.join(firsts, "type").where(F.col("type").rlike(r"\p{L}")).withColumn("one", F.lit(1)).join(F.broadcast(total), "one")
    a, b, ab, n = (F.col(c) for c in ("ends", "n", "n_first", "all"))
    apart = _log(ab, a, ab / a) + _log(b - ab, n - a, (b - ab) / F.greatest(F.lit(1), n - a))
    score = -2 * (_log(ab, a, b / n) + _log(b - ab, n - a, b / n) - apart)
    return both.select("type", "n", "n_first", score.alias("score"), ((score >= least) & (ab * n > b * a)).alias("starts"))


def breaks(docs: DataFrame, words: Column, short: DataFrame, first: DataFrame, doc: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """doc, pos of the words after which a sentence ends and another one begins.

    A question mark or exclamation mark ends a sentence. So does a full stop, except after an abbreviation or a single letter
    whose next word is no starter with a capital, and after a number whose next word begins with a small letter.
    """
    found = ends(docs, words, doc) if found is None else found
    at = storage.join_keys(found, short.where("short").select("type", F.lit(True).alias("is_short")), "type", "left", salt=F.xxhash64("doc", "pos"))
    at = at.withColumn("own", F.col("type")).withColumn("type", kind(F.col("next")))
    at = storage.join_keys(at, first.where("starts").select("type", F.lit(True).alias("is_first")), "type", "left", salt=F.xxhash64("doc", "pos"))
    held = F.col("is_short").isNotNull() | F.col("own").rlike(r"^\p{L}$")
    begins = F.col("is_first").isNotNull() & F.col("next").rlike(r"^\p{Lu}")
    number = F.col("own").rlike(r"^\p{N}+$") & F.col("next").rlike(r"^\p{Ll}")
    return at.where(~stopped(F.col("word")) | (F.when(held, begins).otherwise(~number))).select("doc", "pos")


def sentences(docs: DataFrame, words: Column, short: DataFrame, first: DataFrame, doc: str = "doc_id", found: DataFrame | None = None) -> DataFrame:
    """doc, sent (from 0) and words of every sentence. Ends are gathered by document, and documents are joined to them once."""
    at = breaks(docs, words, short, first, doc, found).groupBy("doc").agg(F.array_sort(F.collect_list("pos")).alias("at"))
    # texts are shuffled as they are, and cut into words after the join
    both = docs.join(at.withColumnRenamed("doc", "__doc"), F.col(doc) == F.col("__doc"), "left")
    held = both.select(F.col(doc).alias("doc"), words.alias("w"), "at").where(F.size("w") > 0)
    upto = F.concat(F.coalesce(F.transform("at", lambda p: p + 1), F.array().cast("array<int>")), F.array(F.size("w")))
    cut = held.select("doc", "w", upto.alias("upto")).select("doc", "w", "upto", F.posexplode("upto").alias("sent", "end"))
    begin = F.when(F.col("sent") == 0, 0).otherwise(F.get("upto", F.col("sent") - 1))
    return cut.select("doc", F.col("sent").cast("long").alias("sent"), F.slice("w", begin + 1, F.col("end") - begin).alias("words"))
