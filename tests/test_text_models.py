"""Ranking, selection, discovery, segmentation and sentence ends against plain versions."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline import storage
from weftline.functions import text
from weftline.operators import discovery, ranking, segment, sentences


def plain_rank(edges, damping, rounds):
    nodes = sorted({x for e in edges for x in e[:2]})
    at = {x: i for i, x in enumerate(nodes)}
    m = np.zeros((len(nodes), len(nodes)))
    for a, b, w in edges:
        m[at[b], at[a]] += w
    out = m.sum(0)
    m = m / np.where(out > 0, out, 1)
    r = np.full(len(nodes), 1 / len(nodes))
    for _ in range(rounds):
        r = (1 - damping) / len(nodes) + damping * (m @ r + r[out == 0].sum() / len(nodes))
    return dict(zip(nodes, r, strict=True))


def test_rank_with_hubs_and_dangling_nodes(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(40), rng.randrange(40, 60), rng.randrange(1, 5)) for _ in range(200)] + [(0, i, 1) for i in range(1, 60)] + [(i, 0, 2) for i in range(1, 40)]
    df = spark.createDataFrame([(a, b, float(w)) for a, b, w in edges], "src long, dst long, weight double")
    want = plain_rank(edges, 0.8, 6)
    got = {r.node: r.score for r in ranking.rank(df, 0.8, 6).collect()}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and sum(got.values()) == pytest.approx(1)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)  # hubs are salted
    assert {r.node: r.score for r in ranking.rank(df, 0.8, 6).collect()} == {k: pytest.approx(v) for k, v in want.items()}
    end = ranking.rank(df, 0.5, 100, tolerance=1e-9).collect()
    assert {r.node: r.score for r in end} == {k: pytest.approx(v, abs=1e-8) for k, v in plain_rank(edges, 0.5, 100).items()}
    assert ranking.rank(df.limit(0)).count() == 0


def lines_of(rng, n):
    out = [[f"w{min(int(rng.expovariate(0.3)), 12)}" for _ in range(rng.randrange(0, 9))] for _ in range(n)]
    return out + [[], ["alone"], out[0] if out else []]


def test_lines_ranked_and_selected(spark):
    rng = random.Random(4)
    docs = {d: lines_of(rng, rng.randrange(0, 25)) for d in range(6)} | {9: [[]], 10: [["only"]]}
    df = spark.createDataFrame([(d, i, w) for d, ls in docs.items() for i, w in enumerate(ls)], "doc long, sent long, words array<string>").repartition(3)
    ranked = {(r.doc, r.sent): r.score for r in ranking.rank_lines(df, rounds=7).collect()}
    chosen = {(r.doc, r["rank"]): (r.sent, r.gain) for r in ranking.select_lines(df, 4, 0.6).collect()}
    assert len(ranked) == sum(map(len, docs.values()))
    for d, ls in docs.items():
        sets = [set(w) for w in ls]
        sim = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) if i != j and a and b else 0.0 for j, b in enumerate(sets)] for i, a in enumerate(sets)])
        out, r = sim.sum(0), np.full(len(sets), 1 / len(sets))
        for _ in range(7):
            r = 0.15 / len(sets) + 0.85 * (sim @ np.where(out > 0, r / np.where(out > 0, out, 1), 0) + r[out == 0].sum() / len(sets))
        for i, x in enumerate(r):
            assert ranked[d, i] == pytest.approx(x)
        df_ = {w: sum(w in s for s in sets) for s in sets for w in s}
        norm = math.sqrt(sum(n * n for n in df_.values()))
        rel = [sum(df_[w] for w in s) / (math.sqrt(len(s)) * norm) if s else None for s in sets]
        left, taken = [i for i, s in enumerate(sets) if s], []
        for k in range(1, 5):
            worth = {i: 0.6 * rel[i] - 0.4 * max((len(sets[i] & sets[j]) / math.sqrt(len(sets[i]) * len(sets[j])) for j in taken), default=0) for i in left}
            if not worth:
                assert (d, k) not in chosen
                break
            best = max(worth.values())
            assert chosen[d, k][1] == pytest.approx(best) and worth[chosen[d, k][0]] == pytest.approx(best)
            taken.append(chosen[d, k][0])
            left.remove(taken[-1])


def test_new_words_hold_together_and_are_free_at_their_sides(spark):
    rng = random.Random(1)
    letters = "abcdefghijklmnop"
    runs = ["".join("xyz" if rng.random() < 0.15 else rng.choice(letters) for _ in range(12)) for _ in range(400)]
    docs = spark.createDataFrame([(" ".join(runs[i : i + 7]),) for i in range(0, 400, 7)], "text string")
    found = {r.gram: r for r in discovery.candidates(docs, text.split_words(F.col("text")), 3, 5).collect()}
    count = lambda g: sum(r.startswith(g, i) for r in runs for i in range(len(r)))
    total = lambda k: sum(max(0, len(r) - k + 1) for r in runs)
    p = lambda g: count(g) / total(len(g))
    for g in ["xyz", "xy", *list(found)[:5]]:
        assert found[g].n == count(g)
        assert found[g].cohesion == pytest.approx(min(math.log(p(g) / (p(g[:i]) * p(g[i:]))) for i in range(1, len(g))))
        after = [r[i + len(g) : i + len(g) + 1] for r in runs for i in range(len(r)) if r.startswith(g, i)]
        assert found[g].right == pytest.approx(-sum(after.count(c) / len(after) * math.log(after.count(c) / len(after)) for c in set(after)))
    kept = {r.gram for r in discovery.accepted(discovery.candidates(docs, text.split_words(F.col("text")), 3, 5), 1.5, 1.0).collect()}
    assert kept == {"xyz"}


def plain_path(t, words, unknown):
    best, back = [0.0] + [-math.inf] * len(t), [0] * (len(t) + 1)
    for j in range(1, len(t) + 1):
        for i in range(max(0, j - max(map(len, words), default=1)), j):  # the longest first
            w = words.get(t[i:j], unknown if j - i == 1 else -math.inf)
            if best[i] + w > best[j]:
                best[j], back[j] = best[i] + w, i
    out, j = [], len(t)
    while j:
        out.append(t[back[j] : j])
        j = back[j]
    return out[::-1]


def test_dictionary_paths(spark):
    rng = random.Random(6)
    words = {"".join(rng.choice("abcé🙂") for _ in range(rng.randrange(1, 6))): -rng.random() * 9 for _ in range(80)}
    words.pop("🙂", None)
    texts = ["", None, "q", "a" * 5000, *("".join(rng.choice("abcé🙂q") for _ in range(rng.randrange(1, 60))) for _ in range(200))]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "id long, text string, words string").repartition(4)
    table = spark.createDataFrame(list(words.items()), "word string, weight double")
    want = {i: None if t is None else plain_path(t, words, -7.0) for i, t in enumerate(texts)}
    assert {r.id: r.found for r in segment.by_dictionary(df, table, name="found", unknown=-7.0).collect()} == want
    assert {r.id: r.found for r in segment.by_dictionary(df, table, name="found", unknown=-7.0, most=10).collect()} == want  # by a join
    assert segment.by_dictionary(df.where("id = 2"), table.limit(0), name="found").first().found == ["q"]


def test_double_array_knows_its_words_only():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("ab語") for _ in range(rng.randrange(1, 7))) for _ in range(300)})
    trie = segment.Trie([(w, -float(i + 1)) for i, w in enumerate(words)])
    for t in ["".join(rng.choice("ab語x") for _ in range(30)) for _ in range(50)]:
        points = np.array([ord(c) for c in t])
        lattice = trie.lattice(points, np.full(len(t), len(t)))
        for i, k in itertools.product(range(len(t)), range(trie.longest)):
            w = t[i : i + k + 1]
            assert lattice[i, k] == (-float(words.index(w) + 1) if len(w) == k + 1 and w in words else -math.inf)


def test_tags_against_all_paths(spark):
    docs = spark.createDataFrame([(["ab", "c", "abd", "ab"],), (["c"],), ([],), (["dda", "b"],)], "w array<string>")
    counts = segment.tag_counts(docs, F.col("w"))
    rows = [tuple(r) for r in counts.collect()]
    assert {r[1:] for r in rows if r[0] == "start"} == {("B", "", 2), ("S", "", 1)}
    assert ("next", "E", "S", 2) in rows and ("next", "S", "B", 1) in rows and ("emit", "B", "a", 3) in rows
    model = segment.Tagger(rows)
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcdz") for _ in range(n)) for n in [1, 2, 3, 4, 5, 6, 6, 7] * 4] + [""]
    got = segment.by_tags(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").repartition(3), counts)
    for r in got.collect():
        emit = model.emissions(np.array([ord(c) for c in r.text], np.int64))

        def score(tags, emit=emit):
            return model.start[tags[0]] + sum(emit[i, t] for i, t in enumerate(tags)) + sum(model.step[a, b] for a, b in itertools.pairwise(tags))

        assert "".join(r.words) == r.text
        if r.text:
            own = [segment.TAGS.index(c) for w in r.words for c in ("S" if len(w) == 1 else "B" + "M" * (len(w) - 2) + "E")]
            assert score(own) == pytest.approx(max(score(p) for p in itertools.product(range(4), repeat=len(r.text)) if p[-1] >= 2))


def test_planted_abbreviations_and_starters(spark):
    rng = random.Random(9)
    plain = [f"word{i}" for i in range(60)]
    texts = []
    for _ in range(400):
        out = []
        for _ in range(6):
            s = [rng.choice(plain) for _ in range(rng.randrange(4, 9))]
            s.insert(2, rng.choice(["Dr. Smith", "etc. and", "No. 7", "on the 3. day", "e.g. this", "J. Doe", "so? Why"]))
            out.append(rng.choice(["The ", "However "]) + " ".join(s) + ".")
        texts.append(" ".join(out))
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    words = text.split_words(F.col("text"))
    short = sentences.abbreviations(docs, words)
    assert {r.type for r in short.where("short").collect()} == {"dr", "etc", "no", "e.g", "j"}
    first = sentences.starters(docs, words, short)
    assert {"the", "however"} <= {r.type for r in first.where("starts").collect()} and not first.where("starts AND type LIKE 'word%'").count()
    got = {}
    for r in sentences.sentences(docs, words, short, first).collect():
        got.setdefault(r.doc, {})[r.sent] = " ".join(r.words)
    for i, t in enumerate(texts):
        want = t.replace("so? Why", "so?|Why").replace(". The ", ".|The ").replace(". However ", ".|However ").split("|")
        assert [got[i][k] for k in sorted(got[i])] == want
    ends = sentences.sentences(spark.createDataFrame([(1, "Ask Dr. Who. The end etc. The rest."), (2, ""), (3, None), (4, "one")], "doc_id long, text string"), words, short, first).collect()
    assert sorted((r.doc, r.sent, " ".join(r.words)) for r in ends) == [(1, 0, "Ask Dr. Who."), (1, 1, "The end etc."), (1, 2, "The rest."), (4, 0, "one")]
