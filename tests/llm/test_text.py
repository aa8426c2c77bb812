"""Fingerprints, quotations, decontamination, near-duplicates and rollups."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from conftest import DATA

from weftline.llm import common, decontam, fingerprint, neardup, quotes, rollup

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def prose(rng, n, words=200):
    return " ".join(f"w{rng.randrange(words)}" for _ in range(n))


def test_fingerprints_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    got = {r.doc_id: r for r in fingerprint.digest(spark, docs.repartition(5)).collect()}
    assert len(got) == len(rows)
    own = {r.doc_id: r.fingerprint for r in fingerprint.fingerprints(docs).collect()}
    for (i, t), (_, after) in zip(rows, [*rows[1:], rows[0]], strict=True):
        e = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), own[i])
        assert r.edited_fingerprint == fingerprint.encode(*fingerprint.quartiles([e]))[0]
        assert r.near_edited == pytest.approx(fingerprint.compare(r.fingerprint, r.edited_fingerprint))
    assert np.mean([r.near_edited > r.near_next for r in got.values()]) > 0.9


def plain_counts(text):
    raw, out = text.encode(), np.zeros(fingerprint.BUCKETS, int)
    for i in range(len(raw) - 2):
        x = (raw[i] << 16 | raw[i + 1] << 8 | raw[i + 2]) * 0x9E3779B1 & 0xFFFFFFFF
        out[((x ^ x >> 15) * 0x85EBCA6B & 0xFFFFFFFF) >> 23] += 1
    return out


def test_triplets_against_a_plain_version():
    texts = ["", "a", "ab", "abc", "héllo wörld " * 40, "x" * 5000]
    assert np.array_equal(fingerprint.triplet_counts([t.encode() for t in texts]), np.stack([plain_counts(t) for t in texts]))


def test_fingerprint_edge_cases(spark):
    schema = "doc_id long, text string, fingerprint string"
    rows = [(1, "abc def", "x"), (2, None, "x"), (3, "", "x"), (3, "", "x"), (4, "ü" * 300_000, "x"), (None, "last", "x"), (9, "abc def", "x")]
    got = fingerprint.digest(spark, spark.createDataFrame(rows, schema)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert by[2].n_chars == 0 and by[2].fingerprint == by[3].fingerprint and by[1].fingerprint == by[9].fingerprint
    assert by[9].edited_sha256 == hashlib.sha256(b"abc las").hexdigest()
    assert by[None].edited_sha256 == hashlib.sha256(b"laab").hexdigest()
    alone = fingerprint.digest(spark, spark.createDataFrame(rows[:1], schema)).first()
    assert alone.edited_sha256 == hashlib.sha256(b"abc abc").hexdigest() and alone.near_next == 1
    assert fingerprint.digest(spark, spark.createDataFrame([], schema)).count() == 0
    assert fingerprint.compare(by[1].fingerprint, by[1].fingerprint) == 1


def test_quote_levels():
    text = "Hi\nBob wrote:\n> one\n> two\n>> Al wrote:\n> > three\nmine\n>four"
    assert quotes.levels(text) == [(0, "Hi"), (1, "one\ntwo"), (2, "Al wrote:\nthree"), (0, "mine"), (1, "four")]
    assert quotes.digest_of(" A  b\n") == quotes.digest_of("a B") and quotes.digest_of(" \n ") is None


def test_quotes_link_and_order(spark):
    rows = [(1, 0, "start here"), (1, 1, "> Start  HERE\nreply a"), (1, 2, "> reply a\n>> start here\nreply b"), (1, 3, "> start here\nreply c"), (1, 4, "> never said\nalone"), (2, 0, "> reply b\nfrom elsewhere"), (0, 0, "> reply b\ntoo early"), (3, 0, None), (3, 1, ""), (None, 1, "> start here\nlost"), (1, 1, "> Start  HERE\nreply a"), (4, 0, "> a\n" * 50_000)]
    df = spark.createDataFrame([(*r, 7) for r in rows], "conv_id long, turn long, text string, depth int")
    got = quotes.link(spark, df).collect()
    assert len(got) == len(rows) - 1  # one message comes twice
    by = {(r.conv_id, r.turn): r for r in got}
    reply = lambda c, t: (by[c, t].reply_conv, by[c, t].reply_turn)
    assert reply(1, 1) == (1, 0) and reply(1, 2) == (1, 1) and reply(1, 3) == (1, 0) and reply(1, 4) == (None, None)
    assert reply(2, 0) == (1, 2) and reply(0, 0) == (None, None)
    assert by[2, 0].depth == 3 and (by[2, 0].root_conv, by[2, 0].root_turn) == (1, 0)
    assert [by[1, t].position for t in (0, 1, 3, 2)] == [0, 1, 2, 3] and by[1, 2].own == "reply b"
    assert by[3, 0].own == "" and by[None, 1].n_quotes == 1 and by[None, 1].reply_turn is None
    assert quotes.link(spark, df.limit(0)).count() == 0


def judged(docs, items, window=13):
    """A plain version: hit words, and items found, of each text."""
    split = lambda t: WORD.findall((t or "").translate(LOWER))
    tests = [(i, tuple(w[j : j + window])) for i, t in items if (w := split(t)) for j in range(max(1, len(w) - window + 1))]
    out = []
    for text in docs:
        w = split(text)
        hit, found = set(), set()
        for i, q in tests:
            for p in range(len(w) - len(q) + 1):
                if tuple(w[p : p + len(q)]) == q:
                    hit |= set(range(p, p + len(q)))
                    found.add(i)
        out.append((len(w), len(hit), sorted(x for x in found if x is not None)))
    return out


@pytest.mark.parametrize("seed", range(4))
def test_decontamination_against_a_plain_version(spark, seed):
    rng = random.Random(seed)
    items = [(str(i), prose(rng, rng.choice([0, 1, 5, 12, 13, 14, 30]), 6)) for i in range(12)] + [("0", "Only, THIS!"), (None, "null item words"), ("n", None)]
    docs = [prose(rng, rng.randrange(60), 6) + " " + (rng.choice(items)[1] or "") + " " + prose(rng, 5, 6) for _ in range(60)] + [None, "", "  ", "only this", "null item words x" * 3, "a " * 30_000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(docs)], "doc_id long, text string, n_hit int").repartition(3)
    found = {r.doc_id: r.__getitem__("__found") for r in decontam.scan(spark, df, spark.createDataFrame(items, "item_id string, text string")).collect()}
    for i, (n, hit, own) in enumerate(judged(docs, items)):
        assert (found[i].n_words, found[i].n_hit, list(found[i]["items"])) == (n, hit, own)


def test_decontamination_matches_and_removal(spark):
    item = " ".join(f"t{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"x y {item} z"), (2, "clean words"), (3, " ".join(["c"] * 2000) + " " + item), (4, None), (4, None)], "doc_id long, text string")
    items = spark.createDataFrame([(7, item)], "item_id long, text string")
    m = decontam.scan(spark, docs, items).where("doc_id = 1").first().__getitem__("__found").matches
    assert [tuple(x) for x in m] == [("7", 0, 2, 20)]
    kept = decontam.remove(spark, docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 4]
    assert decontam.remove(spark, docs, items.limit(0)).count() == 5 and decontam.scan(spark, docs.limit(0), items).count() == 0


def test_decontamination_by_a_benchmark_of_several_groups(spark, monkeypatch):
    rng = random.Random(9)
    items = [(str(i), prose(rng, rng.choice([1, 5, 13, 20, 30]), 6)) for i in range(12)] + [(None, "null item words"), (None, "w1 w2"), ("n", None)]
    docs = [prose(rng, rng.randrange(60), 6) + " " + (rng.choice(items)[1] or "") + " " + prose(rng, 5, 6) for _ in range(40)] + [None, "", "null item words x" * 3]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = judged(docs, items)
    monkeypatch.setattr(common, "materialize", None)  # no table of documents is written
    monkeypatch.setattr(decontam, "SHARD", 400)
    for group_bytes in (1, 300, 1 << 20):
        found = {r.doc_id: r.__getitem__("__found") for r in decontam.scan(spark, df, bench, group_bytes=group_bytes).collect()}
        assert [(found[i].n_words, found[i].n_hit, list(found[i]["items"])) for i in range(len(docs))] == want


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        ranks = rng.integers(0, 3, n)
        order = decontam.suffix_array(ranks, n + 1)
        assert sorted(order.tolist()) == list(range(n))
        assert all(tuple(ranks[a:]) < tuple(ranks[b:]) for a, b in itertools.pairwise(order))


def shingle_sets(texts, k):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def plain_components(ids, texts, k, percent):
    sets = shingle_sets(texts, k)
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, x), (b, y) in itertools.combinations(zip(ids, sets, strict=True), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            lo, hi = sorted((find(a), find(b)))
            root[hi] = lo
    return {i: (len(s), find(i)) for i, s in zip(ids, sets, strict=True)}


@pytest.mark.parametrize(("seed", "small", "work"), [(1, neardup.SMALL, neardup.WORK), (2, 16, neardup.WORK), (3, 16, 100)])
def test_near_duplicates_against_a_plain_version(spark, seed, small, work):
    rng = random.Random(seed)
    texts = [prose(rng, rng.randrange(1, 120), 400) for _ in range(60)]
    for base in range(6):  # families of edited copies, many around the threshold
        words = prose(rng, 100, 400).split()
        for _ in range(30):
            copy = list(words)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(100)] = f"e{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
        texts += [" ".join(words)] * 20
    texts += [None, "", " \t", "one", "one", "One", "two words", "two words", "a b c"] + ["z" * 200_000 + " tail end"] * 2
    ids = rng.sample(range(10**6), len(texts))
    df = spark.createDataFrame([(i, t, 1, False) for i, t in zip(ids, texts, strict=True)], "doc_id long, text string, n int, kept boolean").repartition(4)
    got = {r.doc_id: r for r in neardup.link(spark, df, 3, 85, small, work).collect()}
    want = plain_components(ids, texts, 3, 85)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_single_links_inside_a_crowded_family(spark):
    rng = random.Random(11)
    base = prose(rng, 100, 400).split()

    def edited(words, places):
        copy = list(words)
        for i in places:
            copy[i] = f"e{rng.randrange(10**9)}"
        return copy

    members = [edited(base, rng.sample(range(2, 98), 6)) for _ in range(500)]  # near the same base, but hardly linked with each other
    members += [edited(m, rng.sample(range(2, 98), 2)) for m in members[:150]]  # linked with one member only
    df = spark.createDataFrame([(i, " ".join(m)) for i, m in enumerate(members)], "doc_id long, text string").repartition(4)
    want = plain_components(range(len(members)), [" ".join(m) for m in members], 3, 85)
    assert sum(c != i for i, (_, c) in want.items()) > 100
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.link(spark, df, 3, 85, small=32, work=400).collect()}
    assert got == want


def test_branches_part_unrelated_crowds_and_find_their_links(spark):
    """2000 sets share a third of their shingles, so that whole nodes are crowds; 40 pairs of them are links."""
    rng = random.Random(3)
    passage = prose(rng, 60, 300)
    own = [prose(rng, 120, 5000) for _ in range(2000)]
    texts = [f"{passage} {t}" for t in own] + [f"{passage} {t} tail{i}" for i, t in enumerate(own[:40])]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in neardup.link(spark, df, 3, 85, small=64, work=5000).collect()}
    assert got == {i: i if i < 2000 else i - 2000 for i in range(len(texts))}


def test_trees_follow_threshold_and_recall():
    assert [len(neardup.root_picks(t)) for t in (0.8, 0.85, 0.95)] == [10, 8, 6]
    assert all(len(neardup.root_picks(t)) <= neardup.ROOTS for t in (0.5, 0.6, 0.7))
    for t in (0.2, 0.3, 0.4):
        assert 1 - (1 - t * neardup.NODE_RECALL) ** len(neardup.root_picks(t)) >= 0.9999
        assert len(neardup.root_picks(t)) <= neardup.first_branch(t) < neardup.POSITIONS
    with pytest.raises(ValueError):
        neardup.trees(0.1)
    assert neardup.parted(0.85, 1) == pytest.approx(0.15 * (1 - neardup.extra(0.85)) + 0.15**2 * neardup.extra(0.85))
    assert neardup.repeats(0.85, 1) == 2 and neardup.repeats(0.85, 8) >= 4


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_low_similarities_are_linked(spark):
    rng = random.Random(5)
    docs = []
    for _ in range(60):  # pairs of sets that share 22 of 56 or more words, just over 0.3
        common_words = [f"w{rng.randrange(10**9)}" for _ in range(22)]
        docs += [" ".join(common_words + [f"w{rng.randrange(10**9)}" for _ in range(17)]) for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    comp = {r.doc_id: r.component_id for r in neardup.link(spark, df, k=1, percent=30).collect()}
    assert comp == {i: i - i % 2 for i in range(len(docs))}


def test_structured_words_do_not_collide(spark):
    long, other = thue_morse(1024), thue_morse(2048)[1024:]
    short, differ = thue_morse(32), thue_morse(64)[32:]
    for a, b in ((long, other), (short, differ)):
        x, y = " ".join([a, "x", a, "y", a]), " ".join([b, "x", b, "y", b])
        got = neardup.link(spark, spark.createDataFrame([(1, x), (2, y)], "doc_id long, text string"), 3, 85).collect()
        assert {(r.doc_id, r.component_id) for r in got} == {(1, 1), (2, 2)}
        docs, items = spark.createDataFrame([(1, x)], "doc_id long, text string"), spark.createDataFrame([("i", b)], "item_id string, text string")
        assert not decontam.digest(spark, docs, items).first().contaminated


def test_near_duplicate_edge_cases(spark):
    rng = random.Random(5)
    base = prose(rng, 60, 500)
    rows = [(5, base), (3, base + " more"), (None, base), (None, None), (7, "other text of its own"), (7, "other text of its own"), (8, base), (8, "quite another text here")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, neardup.link(spark, df, 3, 85).collect()), key=repr)
    assert len(got) == len(rows)
    comp = {(r[0], r[2]) for r in got}
    assert comp == {(5, 3), (3, 3), (None, None), (7, 7), (8, 3)}
    kept = neardup.deduplicate(spark, df, 3, 85)
    assert kept.columns == df.columns and sorted((r.doc_id for r in kept.collect()), key=repr) == sorted([3, 7, None], key=repr)  # of the rows without an id the wordless one
    assert neardup.link(spark, df.limit(0)).count() == 0 and neardup.deduplicate(spark, df.limit(0)).count() == 0
    lost = spark.createDataFrame([(None, "Same words"), (None, "same  words"), (4, "other words"), (None, "other words"), (5, "x"), (5, "x"), (5, "y")], "doc_id long, text string")
    assert sorted(map(tuple, neardup.deduplicate(spark, lost, 3, 85).collect()), key=repr) == sorted([(None, "Same words"), (4, "other words"), (5, "x"), (5, "y")], key=repr)
    words_as_ids = spark.createDataFrame([("a", base), ("12", base)], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in neardup.link(spark, words_as_ids).collect()} == {(None, None), (12, 12)}


@pytest.mark.parametrize("few", [0, 200_000])
def test_components_of_paths_and_stars(spark, few):
    assert not neardup.components(spark, spark.createDataFrame([], "a long, b long"), few).collect()
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(200, 201)] * 2
    got = {r.id: r.comp for r in neardup.components(spark, spark.createDataFrame(edges, "a long, b long"), few).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 160)} | {201: 200}


def test_partial_quotes_link_to_the_message_that_has_most_parts(spark, monkeypatch):
    """Two and more holders of a line, common lines, and every quote against counting all parts of all messages."""
    a, b, c = "this is line one", "that is line two", "here is line three"
    rows = [(1, 0, f"{a}\n{b}\nbye"), (1, 1, f"{a}\n{b}\n{c}\nend"), (1, 2, f"> {a}\n> {b}\n> {c}\nreply"), (1, 3, f"> {b}\n> {a}\nother"), (2, 0, f"> {c}\n> {b}\nelsewhere")]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.link(spark, spark.createDataFrame(rows, "conv_id long, turn long, text string")).collect()}
    assert got[1, 2] == (1, 1) and got[1, 3] == (1, 0) and got[2, 0] == (1, 1)
    monkeypatch.setattr(quotes, "RARE", 12)  # some lines are common
    rng = random.Random(12)
    lines = [f"sentence number {i} of the letters" for i in range(40)] + ["very common line here"] * 6
    said = [(d, t, "\n".join(sorted(set(rng.sample(lines, 5)))) + f"\nown {d} {t}") for d in range(6) for t in range(5)]
    asked = [(d, 9, "\n".join(f"> {x}" for x in sorted(set(rng.sample(lines, 3)), reverse=True)) + "\nmine") for d in range(6)]
    got = {(r.conv_id, r.turn): (r.reply_conv, r.reply_turn) for r in quotes.link(spark, spark.createDataFrame(said + asked, "conv_id long, turn long, text string")).collect()}
    for d, t, q in asked:
        parts = {x[2:] for x in q.split("\n") if x.startswith("> ")}
        holders = {x: [(i, j) for i, j, own in said if x in own.split("\n")] for x in parts}
        rare = {m for x in parts if len(holders[x]) <= 12 for m in holders[x] if m < (d, t)}
        if rare:
            assert got[d, t] == min(rare, key=lambda m: (-sum(m in holders[x] for x in parts), m[0] != d, m))


def test_partial_and_inline_quotes(spark):
    letter = "First paragraph of the letter.\nIt has two lines here.\n\nSecond paragraph is about cats.\n\nYes."
    rows = [(1, 0, letter), (1, 1, "> Second paragraph is about CATS.\nI like them."), (1, 2, "> It has two lines here.\nTrue.\n> Second paragraph is about cats.\nAnd so do I."), (1, 3, "> Yes.\nShort lines are too common."), (1, 4, "> Something that nobody said\nHm.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, text string")
    got = {r.turn: r for r in quotes.link(spark, df).collect()}
    assert [(got[t].n_quotes, got[t].n_linked, got[t].reply_turn) for t in range(5)] == [(0, 0, None), (1, 1, 0), (2, 2, 0), (1, 0, None), (1, 0, None)]


def test_mail_of_repeated_turns_and_odd_line_ends(spark):
    base = [(1, t, "user", f"text number {t}\u2028goes on\u0085here\r\nand ends") for t in range(3)]
    odd = [(None, 1, "user", "lost"), (2, None, None, None), (3, 0, None, ""), (3, 1, "user", None), (3, 2, "user", "last")]
    schema = "conv_id long, turn long, role string, text string"
    got = quotes.digest(spark, spark.createDataFrame(base * 30 + odd, schema)).collect()
    once = quotes.digest(spark, spark.createDataFrame(base + odd, schema)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, once)) and len(got) == 8
    by = {(r.conv_id, r.turn): r for r in got}
    assert [(by[1, t].n_quotes, by[1, t].n_linked, by[1, t].depth) for t in range(3)] == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
    assert quotes.digest(spark, spark.createDataFrame([], schema)).count() == 0


def test_rollup_commit_during_compaction(spark, monkeypatch):
    store = rollup.Rollup(spark, common.new_path(spark, "t-race"))
    schema = "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long"
    batch = lambda n: spark.createDataFrame([("insert", "s", "en", "1", n, None, None, None, None)], schema)
    store.commit("a", batch(1))
    state = store._state

    def late():
        got = state()
        monkeypatch.setattr(store, "_state", state)
        store.commit("b", batch(10))  # between the listing and the totals
        return got

    monkeypatch.setattr(store, "_state", late)
    store.compact()
    assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(2, 11)]
    store.compact()
    assert [(r.docs, r.tokens) for r in store.totals().collect()] == [(2, 11)]


def test_replay_on_odd_rows(spark):
    rows = [(1, "a b c", "en", "x"), (2, None, "de", "x"), (2, None, "de", "x"), (3, "d-e f", "de", None), (4, "g!", None, "x"), (None, "h i", "en", "x"), (5, "gone now", "en", "x"), (6, "weg-da", "de", "x"), (6, "weg-da", "de", "x")]
    docs = spark.createDataFrame([(*r, 9, "v") for r in rows], "doc_id long, text string, lang string, source string, tokens long, version string")
    labels = spark.createDataFrame([(5, 1, 0), (6, 1, 0), (6, 1, 1), (None, 1, 0), (77, 1, 1)], "doc_id long, toxic int, quality int")
    want = {}
    for i, t, lang, source in rows:
        if i in (5, 6):
            continue
        version = "alnum-2" if lang not in (None, "en") else "space-1"
        n = len(WORD.findall(t or "")) if version == "alnum-2" else len((t or "").split())
        d, k = want.get((source, lang, version), (0, 0))
        want[source, lang, version] = (d + 1, k + n)
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollup.replay(spark, docs, labels).collect()}
    assert got == want
    assert rollup.replay(spark, docs.limit(0), labels).count() == 0 and rollup.replay(spark, docs, labels.limit(0)).agg({"docs": "sum"}).first()[0] == len(rows)


def test_rollup_batches(spark):
    store = rollup.Rollup(spark, common.new_path(spark, "t-rollup"))
    schema = "op string, source string, lang string, version string, tokens long, old_source string, old_lang string, old_version string, old_tokens long, docs int"
    change = lambda *rows: spark.createDataFrame([(*r, 1) for r in rows], schema)
    assert store.totals().count() == 0
    a = change(("insert", "s", "en", "1", 5, None, None, None, None), ("insert", None, None, "1", None, None, None, None, None), ("insert", "s", "en", "1", 5, None, None, None, None))
    b = change(("revise", "s", "en", "2", 7, "s", "en", "1", 5), ("delete", None, None, None, None, None, None, "1", 0))
    assert store.commit("b", b) and store.commit("a", a) and not store.commit("a", a)  # in any order, once each
    want = {("s", "en", "1", 1, 5), ("s", "en", "2", 1, 7)}
    assert {tuple(r) for r in store.totals().collect()} == want
    store.compact()
    assert {tuple(r) for r in store.totals().collect()} == want and not store.commit("b", b)
    assert store.commit("c", change(("delete", None, None, None, None, "s", "en", "2", 7))) and {tuple(r) for r in store.totals().collect()} == {("s", "en", "1", 1, 5)}
    with pytest.raises(Exception, match="unknown change"):
        store.commit("bad", change(("rename", "s", "en", "1", 1, None, None, None, None)))
    assert store.commit("bad", change()) and {tuple(r) for r in store.totals().collect()} == {("s", "en", "1", 1, 5)}
