"""Quotation linking: messages that quote others become reply-ordered conversations without quotes.

Lines are parsed into levels (how many `>` they begin with) and runs of one level into passages. Passages are
normalised (A-Z lower-cased, white space collapsed) and hashed. A message's own passages - its runs at level 0 and its
whole own text - index it; the passages it quotes are looked up: first in its own conversation, then among all
messages, always the earliest message that has the passage and never a later one than the quoting message.
A quote that is no whole passage of any message is looked up by its parts, paragraphs and lines of at least three
words. The earlier messages that have one of its rare parts (held by at most `RARE` messages) are its candidates, and all
its parts are counted in each of them; the one that has most, of several one of its own conversation, then the earliest, is
its original. A quote of common parts only links to the earliest holders of its parts, to the one of them that most parts name.
A message replies to the original of its shallowest, among those its last, linked quote. Depths and roots
follow from the replies by pointer doubling. Each conversation is then numbered so that a reply comes after what it answers.

All joins are to tables with one row a key, with salts for keys of many rows; numbering is done by depth and slices
of turns with offsets, so that no task holds the messages of a whole conversation (one holds a count for each depth and slice).

Defined cases: a null text is empty; empty passages link with nothing; a quote without an original stays unlinked;
lines end at LF, CR or CRLF and nowhere else;
messages with a null conv_id or turn are roots of their own at position 0 and are not linked to; rows with one
(conv_id, turn) are one message, of which the least text counts; ties go to the earliest message; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import common

SPACE = " \t\n\x0b\x0c\r"
MARK = re.compile(r"[ \t]?((?:>[ \t]?)+)(.*)", re.S)
WROTE = re.compile(r".{1,300}\b(?:wrote|writes):[ \t]*", re.S)
_UPPER = {c: c + 32 for c in range(65, 91)}
SLICE = 4096
PART_WORDS = 3
RARE = 50


def levels(text: str) -> list[tuple[int, str]]:
    """Runs of lines of one quote level; the line that introduces a quote (`... wrote:`) is no part of any."""
    lines = []
    for line in re.split(r"\r\n|\n|\r", text):
        m = MARK.fullmatch(line)
        lines.append((m[1].count(">"), m[2]) if m else (0, line))
    runs: list[tuple[int, list[str]]] = []
    for i, (level, line) in enumerate(lines):
        if i + 1 < len(lines) and lines[i + 1][0] > level and WROTE.fullmatch(line):
            continue
        if runs and runs[-1][0] == level:
            runs[-1][1].append(line)
        else:
            runs.append((level, [line]))
    return [(level, "\n".join(own)) for level, own in runs]


def normal(passage: str) -> str:
    return " ".join(x for x in re.split(r"[\x20\x09-\x0D]+", passage.translate(_UPPER)) if x)


def digest_of(passage: str) -> str | None:
    plain = normal(passage)
    return hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if plain else None


def parts_of(passage: str) -> list[str]:
    """Hashes of the paragraphs and lines of a passage that have at least PART_WORDS words."""
    found = [*re.split(r"\n[ \t]*(?:\n[ \t]*)+", passage), *passage.split("\n")]
    return sorted({h for p in found if len(normal(p).split(" ")) >= PART_WORDS and (h := digest_of(p))})


def parse(messages: DataFrame, parts: bool = False) -> DataFrame:
    """conv_id, turn, own (text without quotes), has (hashes of own passages) and quotes (place, level, hash) of each row.

    With `parts`, has and quotes hold the hashes of the passages' parts instead.
    """

    def run(batches):
        kind = pa.list_(pa.struct([("n", pa.int32()), ("level", pa.int32()), ("hash", pa.string())]))
        for batch in batches:
            own, has, quotes = [], [], []
            for t in batch.column(2).to_pylist():
                runs = levels(t or "")
                mine = [r for level, r in runs if level == 0]
                own.append("\n".join(mine).strip(SPACE))
                if parts:
                    has.append(sorted({h for r in mine for h in parts_of(r)}))
                    quotes.append([{"n": n, "level": level, "hash": h} for n, (level, r) in enumerate(runs) if level for h in parts_of(r)])
                else:
                    has.append(sorted({h for h in map(digest_of, [*mine, own[-1]]) if h}))
                    quotes.append([{"n": n, "level": level, "hash": h} for n, (level, r) in enumerate(runs) if level and (h := digest_of(r))])
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(own, pa.string()), pa.array(has, pa.list_(pa.string())), pa.array(quotes, kind)], ["conv_id", "turn", "own", "has", "quotes"])

    return messages.mapInArrow(run, "conv_id long, turn long, own string, has array<string>, quotes array<struct<n:int,level:int,hash:string>>")


def originals(spark: SparkSession, parsed: DataFrame, asked: DataFrame) -> DataFrame:
    """conv_id, turn, n, level and to (conv_id, turn of the original, or null) for asked(conv_id, turn, n, level, hash)."""
    index = parsed.select("conv_id", "turn", F.explode("has").alias("hash"))
    salt = F.xxhash64("conv_id", "turn")
    near = index.groupBy(F.concat_ws(":", F.col("conv_id"), "hash").alias("key")).agg(F.min("turn").alias("in_turn"))
    far = index.groupBy("hash").agg(F.min(F.struct("conv_id", "turn")).alias("first"))
    got = common.lookup(asked.withColumn("key", F.concat_ws(":", F.col("conv_id"), "hash")), near, "key", salt)
    got = common.lookup(got.select("conv_id", "turn", "n", "level", "hash", "in_turn"), far, "hash", salt, seen=asked)
    here = F.when(F.col("in_turn") < F.col("turn"), F.struct("conv_id", F.col("in_turn").alias("turn")))
    there = F.when(F.col("first") < F.struct("conv_id", "turn"), F.col("first"))
    return got.select("conv_id", "turn", "n", "level", F.coalesce(here, there).alias("to"))


def by_parts(spark: SparkSession, pieces: DataFrame, wanted: DataFrame) -> DataFrame:
    """conv_id, turn, n and to, of the quotes of wanted(conv_id, turn, n, level, hash) that have a candidate or a holder.

    Holders of a rare part are a list of at most RARE; common parts are only looked for in the candidates that rare ones gave.
    """
    salt, quote = F.xxhash64("conv_id", "turn"), ["conv_id", "turn", "n"]
    index = common.materialize(spark, pieces.select("conv_id", "turn", F.explode("has").alias("hash")), "parts")
    held = common.materialize(spark, index.groupBy("hash").agg(F.count(F.lit(1)).alias("holders")), "holders")
    known = common.materialize(spark, common.lookup(wanted, held, "hash", salt).where("holders IS NOT NULL"), "known-parts")
    few = common.lookup(index, held.where(F.col("holders") <= RARE), "hash", salt).where("holders IS NOT NULL")
    lists = few.groupBy("hash").agg(F.collect_list(F.struct("conv_id", "turn")).alias("list"))
    rare = common.lookup(known.where(F.col("holders") <= RARE), lists, "hash", salt).select(*quote, F.explode("list").alias("to"))
    counted = rare.where(F.col("to") < F.struct("conv_id", "turn")).groupBy(*quote, "to").agg(F.count(F.lit(1)).alias("parts"))
    counted = common.materialize(spark, counted, "candidates")
    more = counted.select(*quote, "to").join(known.where(F.col("holders") > RARE).select(*quote, "hash"), quote)
    own = index.select(F.struct("conv_id", "turn").alias("to"), "hash")
    more = more.join(own, ["to", "hash"], "left_semi").groupBy(*quote, "to").agg(F.count(F.lit(1)).alias("parts"))
    both = counted.unionByName(more).groupBy(*quote, "to").agg(F.sum("parts").alias("parts"))
    best = both.groupBy(*quote).agg(F.min(F.struct((-F.col("parts")).alias("p"), (F.col("to.conv_id") != F.col("conv_id")).alias("far"), "to")).alias("b"))
    best = common.materialize(spark, best.select(*quote, "b.to"), "best-parts")
    rest = known.join(best, quote, "left_anti").drop("holders")
    if rest.isEmpty():
        return best
    found = originals(spark, pieces, common.materialize(spark, rest, "common-parts")).where("to IS NOT NULL").groupBy(*quote, "to").agg(F.count(F.lit(1)).alias("parts"))
    return best.unionByName(found.groupBy(*quote).agg(F.min(F.struct((-F.col("parts")).alias("p"), "to")).alias("b")).select(*quote, "b.to"))


def link(spark: SparkSession, messages: DataFrame) -> DataFrame:
    """messages(conv_id, turn, text) as conv_id, turn, own, n_quotes, n_linked, reply_conv, reply_turn, root_conv, root_turn, depth and position."""
    plain = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "text")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    one = plain.where(known)
    if not one.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():  # only then do texts need a shuffle
        one = one.groupBy("conv_id", "turn").agg(F.min("text").alias("text"))
    parsed = common.materialize(spark, parse(one), "parsed")
    asked = common.materialize(spark, parsed.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*"), "asked")
    salt = F.xxhash64("conv_id", "turn")
    got = common.materialize(spark, originals(spark, parsed, asked), "originals")
    lone = got.where("to IS NULL")
    if not lone.isEmpty():  # only then are texts parsed again, for the parts of their passages
        pieces = common.materialize(spark, parse(one, parts=True), "parsed-parts")
        wanted = pieces.select("conv_id", "turn", F.explode("quotes").alias("q")).select("conv_id", "turn", "q.*").join(lone.select("conv_id", "turn", "n"), ["conv_id", "turn", "n"], "left_semi")
        wanted = common.materialize(spark, wanted, "asked-parts")
        best = by_parts(spark, pieces, wanted).withColumnRenamed("to", "best")
        got = got.join(best, ["conv_id", "turn", "n"], "left").select("conv_id", "turn", "n", "level", F.coalesce("to", "best").alias("to"))
    replies = got.groupBy("conv_id", "turn").agg(F.count(F.lit(1)).alias("n_quotes"), F.count("to").alias("n_linked"), F.max(F.when(F.col("to").isNotNull(), F.struct((-F.col("level")).alias("l"), "n", "to"))).alias("best"))
    tree = parsed.select("conv_id", "turn").join(replies.select("conv_id", "turn", "n_quotes", "n_linked", F.col("best.to").alias("to")), ["conv_id", "turn"], "left")
    name = lambda c, t: F.concat_ws(":", c, t)
    tree = tree.select(
        "conv_id", "turn", F.coalesce("n_quotes", F.lit(0)).cast("long").alias("n_quotes"), F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.col("to.conv_id").alias("reply_conv"), F.col("to.turn").alias("reply_turn"),
        F.coalesce(F.col("to.conv_id"), "conv_id").alias("root_conv"), F.coalesce(F.col("to.turn"), "turn").alias("root_turn"), F.when(F.col("to").isNotNull(), F.lit(1)).otherwise(0).cast("long").alias("depth"),
    )
    tree = common.materialize(spark, tree, "replies")
    while True:  # each round doubles how far up a message sees
        up = tree.select(name(F.col("conv_id"), F.col("turn")).alias("above"), F.col("root_conv").alias("up_conv"), F.col("root_turn").alias("up_turn"), F.col("depth").alias("up_depth")).where("up_depth > 0")
        seen = common.lookup(tree.withColumn("above", name(F.col("root_conv"), F.col("root_turn"))), up, "above", salt)
        far_up = F.col("up_depth").isNotNull() & (F.col("depth") > 0)
        new = seen.select(*[c for c in tree.columns if c not in ("root_conv", "root_turn", "depth")], F.when(far_up, F.col("up_conv")).otherwise(F.col("root_conv")).alias("root_conv"), F.when(far_up, F.col("up_turn")).otherwise(F.col("root_turn")).alias("root_turn"), F.when(far_up, F.col("depth") + F.col("up_depth")).otherwise(F.col("depth")).alias("depth"), far_up.alias("__moved"))
        new = common.materialize(spark, new, "replies")
        moved = not new.where("__moved").isEmpty()
        common.drop(spark, tree)
        tree = new.drop("__moved")
        tree.weft_path = new.weft_path
        if not moved:
            break
    group = ["root_conv", "root_turn", "conv_id", "depth", "slice"]
    tree = tree.withColumn("slice", F.floor(F.col("turn") / SLICE))
    sizes = tree.groupBy(*group).agg(F.count(F.lit(1)).alias("size"))
    before = F.sum("size").over(W.Window.partitionBy("root_conv", "root_turn", "conv_id").orderBy("depth", "slice").rowsBetween(W.Window.unboundedPreceding, -1))
    sizes = sizes.select(*group, F.coalesce(before, F.lit(0)).alias("before"))
    place = F.row_number().over(W.Window.partitionBy(*group).orderBy("turn"))
    placed = tree.withColumn("place", place).join(sizes, group).withColumn("position", (F.col("before") + F.col("place") - 1).cast("long")).drop("slice", "place", "before")
    named = parsed.select("conv_id", "turn", "own").join(placed, ["conv_id", "turn"])
    lost = parse(plain.where(~known)).select("conv_id", "turn", "own", F.size("quotes").cast("long").alias("n_quotes"), F.lit(0).cast("long").alias("n_linked"), *[F.lit(None).cast("long").alias(c) for c in ("reply_conv", "reply_turn")], F.col("conv_id").alias("root_conv"), F.col("turn").alias("root_turn"), *[F.lit(0).cast("long").alias(c) for c in ("depth", "position")])
    return named.select(*lost.columns).unionByName(lost)


def as_mail(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as mail: each turn quotes the one before it and, a level deeper, the one before that.

    Repeated turns are one turn, of which the least text counts, so one aggregation by turn brings a turn and the two
    before it together. Rows without conv_id or turn quote nothing.
    """
    c = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    known = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    seen = c.where(known).select("conv_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"), "turn", F.struct("text", "role").alias("m"))
    seen = seen.groupBy("conv_id", (F.col("turn") + F.col("k")).alias("turn")).agg(*[F.min(F.when(F.col("k") == k, F.col("m"))).alias(f"m{k}") for k in range(3)]).where("m0 IS NOT NULL")

    def quoted(k: int) -> F.Column:
        head = F.concat(F.lit("> " * (k - 1)), F.coalesce(f"m{k}.role", F.lit("someone")), F.lit(" wrote:\n"))
        marked = F.regexp_replace(F.col(f"m{k}.text"), r"(\A|\r\n|\n|\r)", "$1" + "> " * k)  # the line ends of `levels`
        return F.coalesce(F.concat(head, marked, F.lit("\n")), F.lit(""))

    mail = F.concat(quoted(1), F.when(F.col("m1.text").isNotNull(), quoted(2)).otherwise(""), F.coalesce("m0.text", F.lit("")))
    return seen.select("conv_id", "turn", mail.alias("text")).unionByName(c.where(~known).select("conv_id", "turn", "text"))


def digest(spark: SparkSession, conversations: DataFrame) -> DataFrame:
    """The linked mail of all conversations, with own_sha256 in place of the texts."""
    got = link(spark, as_mail(conversations))
    return got.select("conv_id", "turn", F.sha2("own", 256).alias("own_sha256"), *[c for c in got.columns if c not in ("conv_id", "turn", "own")])


SQL = r"""
WITH RECURSIVE m AS (
  SELECT conv_id, turn, trim(coalesce(text, ''), E' \t\n\x0b\x0c\r') AS own,
         trim(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+', ' ', 'g')) AS norm
  FROM conversations),
f AS (SELECT conv_id, norm, min(turn) AS first FROM m WHERE norm <> '' GROUP BY ALL),
q AS (
  SELECT m.conv_id, m.turn, 1 AS level, f.first FROM m JOIN m p ON p.conv_id = m.conv_id AND p.turn = m.turn - 1 JOIN f ON f.conv_id = p.conv_id AND f.norm = p.norm
  UNION ALL
  SELECT m.conv_id, m.turn, 2, f.first FROM m JOIN m p ON p.conv_id = m.conv_id AND p.turn = m.turn - 2 JOIN f ON f.conv_id = p.conv_id AND f.norm = p.norm
  WHERE EXISTS (SELECT 1 FROM m x WHERE x.conv_id = m.conv_id AND x.turn = m.turn - 1)),
r AS (
  SELECT m.conv_id, m.turn, own, count(q.level)::BIGINT AS n, arg_min(q.first, q.level) AS parent FROM m LEFT JOIN q USING (conv_id, turn) GROUP BY m.conv_id, m.turn, own),
t(conv_id, turn, root, depth) AS (
  SELECT conv_id, turn, turn, 0 FROM r WHERE parent IS NULL
  UNION ALL
  SELECT r.conv_id, r.turn, t.root, t.depth + 1 FROM r JOIN t ON r.conv_id = t.conv_id AND r.parent = t.turn)
SELECT r.conv_id, r.turn, sha256(own) AS own_sha256, n AS n_quotes, n AS n_linked, CASE WHEN parent IS NOT NULL THEN r.conv_id END AS reply_conv, parent AS reply_turn,
       r.conv_id AS root_conv, root AS root_turn, depth::BIGINT AS depth, row_number() OVER (PARTITION BY r.conv_id, root ORDER BY depth, r.turn) - 1 AS position
FROM r JOIN t USING (conv_id, turn)
"""
