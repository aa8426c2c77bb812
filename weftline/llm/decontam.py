"""Benchmark decontamination by suffix arrays of the training text.

Each task cuts its documents into shards of some MB, builds the suffix array of a shard's words (ordered by the
first `window` words or more, by prefix doubling of ranks) and binary-searches every suffix of every test item in
it. The ranges found give all verbatim occurrences; runs on one diagonal are merged into longest matches with
their locations. Nothing is shuffled: the shards stay where they are read, and the benchmark goes to them, as one
hash a word into which the windows are indices. A benchmark of over `group_bytes` is written as word hashes, in groups
of items, to the shared folder: a task builds the suffix arrays of some shards once and walks the groups with them.
So what a task holds is bounded at any size, the documents are read once and nothing of theirs is written.

Rules: words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z. An item's windows are its runs of
13 words; an item of fewer words, but not none, is one window. A document word in any occurrence is hit.

Defined cases: a null or wordless text has no words and is clean; a null or wordless item has no window; items
with one id are one item, and a null id counts for hits but is not listed; repeated documents are judged alike;
either table may be empty; a text of any length is one document of one shard.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.dataset as pads
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, warc, words

SHARD = 2 << 20
HELD = 8  # shards that walk the groups of a large benchmark together
FOUND = "n_words long, n_hit long, items array<string>, matches array<struct<item_id:string,item_word:long,doc_word:long,n_words:long>>"


def suffix_array(rank0: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the suffixes of rank0 (dense ranks of words), ordered by their first `depth` words at least."""
    n = len(rank0)
    order = np.argsort(rank0)
    rank = rank0.astype(np.int64)
    sorted_ = rank[order]
    begins = np.flatnonzero(np.r_[True, sorted_[1:] != sorted_[:-1]]) if n else np.zeros(0, np.int64)
    size = np.diff(np.r_[begins, n])
    rank[order] = np.repeat(begins, size)
    h = 1
    while h < depth:
        tied = np.flatnonzero(np.repeat(size > 1, size))  # places in `order` that are not settled
        if not len(tied):
            break
        pos = order[tied]
        after = np.zeros(len(pos), np.int64)
        ok = pos + h < n
        after[ok] = rank[pos[ok] + h] + 1
        key = rank[pos] * (n + 1) + after
        by = np.argsort(key)
        order[tied] = pos[by]
        key = key[by]
        new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        fresh = np.ones(n + 1, bool)  # where a group of equal prefixes begins
        fresh[tied] = False
        fresh[tied[new]] = True
        begins = np.flatnonzero(fresh[:n])
        size = np.diff(np.r_[begins, n])
        rank = np.empty(n, np.int64)
        rank[order] = np.repeat(begins, size)
        h *= 2
    return order


def search(rank0: np.ndarray, order: np.ndarray, query: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of query (ranks, of which the first `lengths` count) the range of `order` that begins with it."""
    n, width = len(rank0), query.shape[1]
    padded = np.r_[rank0, np.full(width, -1, rank0.dtype)]
    used = np.arange(width) < lengths[:, None]

    def bound(upper: bool) -> np.ndarray:
        lo, hi = np.zeros(len(query), np.int64), np.full(len(query), n, np.int64)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) >> 1
            seen = padded[order[mid][:, None] + np.arange(width)]
            differ = (seen != query[open_]) & used[open_]
            first = differ.argmax(1)
            rows = np.arange(len(open_))
            less = differ[rows, first] & (seen[rows, first] < query[open_][rows, first])
            go = less | (upper & ~differ.any(1))
            lo[open_[go]] = mid[go] + 1
            hi[open_[~go]] = mid[~go]
        return lo

    return bound(False), bound(True)


def suffixes(h: np.ndarray, at: np.ndarray, ids: Sequence[str | None], window: int) -> dict[str, np.ndarray]:
    """All windows of items, as places in the hashes of their words: the item and place of each."""
    names = {}
    item_no = np.array([names.setdefault(k, len(names)) for k in ids], np.int64)
    n = np.diff(at)
    count = np.where(n >= window, n - window + 1, (n > 0).astype(np.int64))
    owner = np.repeat(np.arange(len(ids), dtype=np.int32), count)
    place = (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)).astype(np.int32)
    return {"words": np.r_[h, np.zeros(window, np.uint64)], "begin": at[:-1], "length": np.minimum(n, window), "item": item_no, "owner": owner, "place": place, "names": np.array(list(names), object)}


def test_suffixes(items: Sequence[tuple[str | None, str | None]], window: int) -> dict[str, np.ndarray]:
    """Words of the items as hashes, and all windows."""
    h, at = words.hashes(*words.buffers(pa.array([t for _, t in items], pa.large_string())), words.folded("alnum"))
    return suffixes(h, at, [k for k, _ in items], window)


def windows_of(tests: dict[str, np.ndarray], b: int, size: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, lengths, item numbers and places of some windows."""
    owner, place = tests["owner"][b : b + size], tests["place"][b : b + size].astype(np.int64)
    return tests["words"][(tests["begin"][owner] + place)[:, None] + np.arange(window)], tests["length"][owner], tests["item"][owner], place


class Shard:
    """The suffix array of some texts, and what groups of items were found to have in common with them."""

    def __init__(self, col: pa.Array, window: int) -> None:
        self.window, self.n_docs = window, len(col)
        self.words, self.at = words.hashes(*words.buffers(col), words.folded("alnum"))
        n_words = np.diff(self.at)
        self.hits, self.found, self.names = np.zeros(len(self.words) + 1, np.int64), [], []
        self.known, self.rank0 = np.unique(self.words, return_inverse=True)
        self.doc = np.repeat(np.arange(self.n_docs), n_words)
        self.left = self.at[1:][self.doc] - np.arange(len(self.words))  # words up to the end of the document
        self.order = suffix_array(self.rank0, window)

    def match(self, tests: dict[str, np.ndarray], block: int = 1 << 16) -> None:
        """Search every window of a group of items; an item is in one group only."""
        if not len(self.words):
            return
        for b in range(0, len(tests["owner"]), block):
            q, length, item_no, begin = windows_of(tests, b, block, self.window)
            near = np.minimum(np.searchsorted(self.known, q), len(self.known) - 1)
            there = np.flatnonzero(((self.known[near] == q) | (np.arange(self.window) >= length[:, None])).all(1))
            lo, hi = search(self.rank0, self.order, near[there], length[there])
            count = hi - lo
            which = np.repeat(there, count)
            pos = self.order[np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + np.repeat(lo, count)]
            ok = self.left[pos] >= length[which]
            which, pos = which[ok], pos[ok]
            if not len(pos):
                continue
            np.add.at(self.hits, pos, 1)
            np.add.at(self.hits, pos + length[which], -1)
            own, name = np.unique(item_no[which], return_inverse=True)
            if self.names[-len(own) :] != (names := tests["names"][own].tolist()):
                self.names += names
            self.found.append(np.stack([self.doc[pos], len(self.names) - len(own) + name, begin[which], pos - self.at[:-1][self.doc[pos]], length[which]]))

    def judged(self) -> tuple[np.ndarray, np.ndarray, list, list]:
        """Words, hit words, items and matches of each text."""
        hit = np.cumsum(self.hits[:-1]) > 0
        upto = np.r_[0, np.cumsum(hit)]
        n_hit = upto[self.at[1:]] - upto[self.at[:-1]]
        items: list = [[] for _ in range(self.n_docs)]
        matches: list = [[] for _ in range(self.n_docs)]
        f = np.concatenate(self.found, 1) if self.found else np.zeros((5, 0), np.int64)
        if f.shape[1]:
            one: dict[str | None, int] = {}
            f[1] = np.array([one.setdefault(n, len(one)) for n in self.names], np.int64)[f[1]]  # an item may be named by several blocks
            names = list(one)
            f = f[:, np.lexsort((f[3], f[3] - f[2], f[1], f[0]))]
            d, item, place, pos, length = f
            new = np.ones(len(d), bool)
            new[1:] = (d[1:] != d[:-1]) | (item[1:] != item[:-1]) | (pos[1:] - place[1:] != pos[:-1] - place[:-1]) | (pos[1:] != pos[:-1] + 1)
            first = np.flatnonzero(new)
            last = np.r_[first[1:], len(d)] - 1
            for i, j in zip(first.tolist(), last.tolist(), strict=True):
                matches[d[i]].append({"item_id": names[item[i]], "item_word": int(place[i]), "doc_word": int(pos[i]), "n_words": int(pos[j] + length[j] - pos[i])})
            for k in np.flatnonzero(np.bincount(d, minlength=self.n_docs)).tolist():
                items[k] = sorted({m["item_id"] for m in matches[k] if m["item_id"] is not None})
        return np.diff(self.at), n_hit, items, matches


def written_groups(spark: SparkSession, items: DataFrame, groups: int) -> tuple[str, list[int]]:
    """A folder of the items' word hashes, by group, and the groups that have items; rows of one id share a group."""

    def hashed(batches):
        for batch in batches:
            h, at = words.hashes(*words.buffers(batch.column(2)), words.folded("alnum"))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([h[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["part", "item_id", "words"])

    at = common.new_path(spark, "items")
    part = F.pmod(F.xxhash64(F.coalesce("item_id", "text")), F.lit(groups)).cast("int")
    items.select(part.alias("part"), "item_id", "text").mapInArrow(hashed, "part int, item_id string, words binary").repartition(groups, "part").write.partitionBy("part").parquet(at)
    return at, sorted(r.part for r in spark.read.parquet(at).select("part").distinct().collect())


def read_group(at: str, part: int, window: int) -> dict[str, np.ndarray]:
    fs, root = warc.file_system(at)
    got = pads.dataset(f"{root}/part={part}", filesystem=fs, format="parquet").to_table(columns=["item_id", "words"])
    held = [np.frombuffer(x.as_py(), np.uint64) for x in got["words"]]
    return suffixes(np.concatenate(held), np.cumsum([0, *map(len, held)]), got["item_id"].to_pylist(), window)


def scan(spark: SparkSession, docs: DataFrame, items: DataFrame, window: int = 13, group_bytes: int = 32 << 20) -> DataFrame:
    """docs(text, ...) with __found: n_words, n_hit, items and matches (the longest ones, with their places).

    items(item_id, text) are dealt by their ids into as many groups as `group_bytes` of their text ask for. Only texts
    go to Python, and only the struct comes back.
    """
    items = items.select(F.col("item_id").cast("string"), "text")
    groups = -(-max(1, items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // group_bytes)
    if groups == 1:
        tests = spark.sparkContext.broadcast(test_suffixes([(r.item_id, r.text) for r in items.collect()], window))
        load, members = (lambda _: tests.value), [0]
    else:
        at, members = written_groups(spark, items, groups)
        load = lambda part: read_group(at, part, window)

    def found(texts: pa.Array) -> pa.Array:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.struct([("item_id", pa.string()), ("item_word", pa.int64()), ("doc_word", pa.int64()), ("n_words", pa.int64())]))]
        parts, held = [], []

        def walk() -> None:
            for part in members:
                group = load(part)
                for shard in held:
                    shard.match(group)
            for shard in held:
                parts.append([pa.array(x, k) for x, k in zip(shard.judged(), kinds, strict=True)])
            held.clear()

        for table in words.shards([pa.record_batch([texts], ["text"])], "text", SHARD):
            for col in table.column("text").chunks:
                held.append(Shard(col, window))
                if len(held) == (HELD if len(members) > 1 else 1):
                    walk()
        if held:
            walk()
        words.trim()
        whole = [pa.concat_arrays([p[i] for p in parts]) if parts else pa.array([], k) for i, k in enumerate(kinds)]
        return pa.StructArray.from_arrays(whole, ["n_words", "n_hit", "items", "matches"])

    # non-deterministic in name only, so that a filter on its result does not run it twice
    return docs.withColumn("__found", F.arrow_udf(found, FOUND).asNondeterministic()(F.col("text")))


def is_contaminated():
    return (F.col("__found.n_hit") > 0) & (20 * F.col("__found.n_hit") >= F.col("__found.n_words"))


def digest(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row a document: n_words, n_hit, n_items, items_sha256, contaminated and the longest match in words."""
    return scan(spark, docs.select("doc_id", "text"), items).select(
        "doc_id", F.col("__found.n_words").alias("n_words"), F.col("__found.n_hit").alias("n_hit"), F.size("__found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("__found.items", ","), 256).alias("items_sha256"), is_contaminated().alias("contaminated"),
        F.coalesce(F.array_max(F.transform("__found.matches", lambda m: m["n_words"])), F.lit(0)).cast("long").alias("longest_match"),
    )


def remove(spark: SparkSession, docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones, with the columns of docs."""
    return scan(spark, docs, items).where(~is_contaminated()).select(*docs.columns)


SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT item_id, least(13, len(w)) AS n, j, array_to_string(w[j:j + least(13, len(w)) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(j) WHERE len(w) > 0),
n AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS s FROM d, n, unnest(range(1, len(w) - n + 2)) AS t(p)),
m AS (SELECT doc_id, item_id, j, p, n FROM dw JOIN bw USING (n, s)),
hit AS (
  SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, k FROM m, unnest(range(p, p + n)) AS t(k)) GROUP BY doc_id),
own AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id),
runs AS (
  SELECT doc_id, max(c) AS longest FROM (
    SELECT doc_id, item_id, max(n) + count(*) - 1 AS c FROM (
      SELECT *, p - row_number() OVER (PARTITION BY doc_id, item_id, p - j ORDER BY p) AS g FROM m) GROUP BY doc_id, item_id, p - j, g) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated, coalesce(longest, 0)::BIGINT AS longest_match
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN runs USING (doc_id)
"""
