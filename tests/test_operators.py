"""Golden cases and properties of operators, sources, kernels and streams."""

import gzip
import hashlib
import math
import random
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline import storage
from weftline.models import kernels, train
from weftline.operators import blocks, metrics, pairs, splits, vectors, vocab
from weftline.plans import corpora
from weftline.sources import readers, writers
from weftline.streaming import folds


def toks(spark, *docs):
    return vocab.tokens(spark.createDataFrame([(i, d.split()) for i, d in enumerate(docs)], "doc_id long, w array<string>"), F.col("w"))


def test_vocabulary_orders(spark):
    t = toks(spark, "b a a b c")
    ids = lambda p: {r.word: r.id for r in vocab.fit_vocab(t, p).collect()}
    assert ids(vocab.VocabPolicy("frequency", 1, 2)) == {"b": 0, "a": 1}
    assert ids(vocab.VocabPolicy("first_seen", 2, None, ("<pad>",))) == {"b": 1, "a": 2}
    assert ids(vocab.VocabPolicy("first_seen", 9)) == {}
    far = vocab.tokens(spark.createDataFrame([(1 << 50, ["b", "a"]), (-3, ["a"])], "doc_id long, w array<string>"), F.col("w"))
    assert {r.word: r.id for r in vocab.fit_vocab(far, vocab.VocabPolicy(), wide=True).collect()} == {"a": 0, "b": 1}
    assert {r.word: r.id for r in vocab.fit_vocab(far, vocab.VocabPolicy()).collect()} == {"a": 0, "b": 1}
    named = vocab.tokens(spark.createDataFrame([("y", ["b", "a"]), ("x", ["c", "a"])], "doc_id string, w array<string>"), F.col("w"))
    assert {r.word: r.id for r in vocab.fit_vocab(named, vocab.VocabPolicy()).collect()} == {"c": 0, "a": 1, "b": 2}


def test_unknown_words_close_the_gap_or_keep_it(spark):
    t = toks(spark, "a X b")
    v = spark.createDataFrame([("a", 0), ("b", 1)], "word string, id long")
    ids = vocab.lookup_ids(t, v)
    both = lambda df: {(r.center, r.ctx) for r in df.collect()}
    assert both(pairs.skipgram_counts(ids, 1)) == {(0, 1), (1, 0)}
    assert pairs.windows(ids, 1).count() == 0
    with pytest.raises(Exception, match="not in the vocabulary"):
        vocab.require_all(t, v).collect()


def test_windows(spark):
    ids = spark.createDataFrame([(0, p, p) for p in range(3)], "doc long, pos int, id long")
    assert sorted((r.center, r.ctx) for r in pairs.windows(ids, 1).collect()) == [(0, 1), (1, 0), (1, 2), (2, 1)]
    cells = {(r.w_id, r.c_id): r.x for r in pairs.cooccurrence(ids, 2).collect()}
    assert all(cells[j, i] == x for (i, j), x in cells.items())
    assert kernels.glove_weight(np.array([16.0, 100.0, 500.0])) == pytest.approx([0.252982, 1, 1], abs=1e-6)


def huffman(freqs):
    """(word id, bits, inner nodes) of (id, frequency), ids in the list's order."""
    order = sorted(range(len(freqs)), key=lambda i: (freqs[i][1], i))
    tree = pairs.Huffman(sorted(Counter(f for _, f in freqs).items()))
    got = dict(zip(order, tree.paths(np.arange(len(freqs))), strict=True))
    return [(w, *got[i]) for i, (w, _) in enumerate(freqs)]


def test_huffman_example():
    got = {w: (bits, path) for w, bits, path in huffman([(0, 4), (1, 6), (2, 3), (3, 2), (4, 2)])}
    assert got == {0: ([1, 0], [8, 7]), 1: ([1, 1], [8, 7]), 2: ([0, 0], [8, 6]), 3: ([0, 1, 1], [8, 6, 5]), 4: ([0, 1, 0], [8, 6, 5])}


@given(st.lists(st.integers(1, 50), min_size=1, max_size=40))
@settings(max_examples=100, deadline=None)
def test_huffman_codes_are_prefix_free(freqs):
    codes = ["".join(map(str, bits)) for _, bits, _ in huffman(list(enumerate(freqs)))]
    assert len(set(codes)) == len(codes)
    assert not any(a != b and b.startswith(a) for a in codes for b in codes) or len(codes) == 1


def test_huffman_joins_the_rarest_first_places_winning():
    """A plain list version: scan for the two smallest by strict comparison; the new node goes to the front."""
    rng = random.Random(4)
    for k in range(400):
        freqs = [rng.randrange(1, 6 if k % 2 else 60) for _ in range(rng.randrange(1, 12 if k % 4 else 60))]
        nodes = [(f, i) for i, f in enumerate(freqs)]
        up = {}
        while len(nodes) > 1:
            order = sorted(range(len(nodes)), key=lambda i: (nodes[i][0], i))[:2]
            a, b = nodes[order[0]], nodes[order[1]]
            left, right = (a, b) if a[0] == b[0] else (b, a)
            new = len(freqs) + len(up) // 2
            up[left[1]], up[right[1]] = (new, 1), (new, 0)
            nodes = [(a[0] + b[0], new)] + [n for i, n in enumerate(nodes) if i not in order]
        for i, bits, path in huffman(list(enumerate(freqs))):
            at, want = i, []
            while at in up:
                at, bit = up[at]
                want.append((at, bit))
            assert list(zip(path, bits, strict=True)) == want[::-1]


def test_noise_and_draws(spark, monkeypatch):
    v = spark.createDataFrame([(0, 16), (1, 1), (2, 81)], "id long, freq long")
    dist = pairs.noise(v)
    p = {r.id: r.p for r in dist.collect()}
    assert sum(p.values()) == pytest.approx(1) and p[2] / p[1] == pytest.approx(27)
    both = spark.range(4000).select(F.col("id").alias("center"), F.lit(7).alias("ctx"))
    drawn = pairs.negative_samples(both, dist, 3, ["center"])
    rows = sorted(map(tuple, drawn.collect()))
    assert len(rows) == 12_000 and rows == sorted(map(tuple, pairs.negative_samples(both.repartition(5), dist, 3, ["center"]).collect()))
    assert np.mean([r[-1] == 2 for r in rows]) == pytest.approx(p[2], abs=0.02)
    # by a plain table of slots
    few = spark.createDataFrame([(5, 3), (6, 0), (9, 1), (11, 6)], "id long, slots long")
    table = [5] * 3 + [9] + [11] * 6
    want = sorted((c, 7, table[int(hashlib.md5(f"4-{c}-{k}".encode()).hexdigest()[:15], 16) % 10]) for c in range(4000) for k in (1, 2))
    assert sorted(map(tuple, pairs.negative_samples(both, few, 2, ["center"], seed=4).collect())) == want
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)  # draws go to the words
    assert sorted(map(tuple, pairs.negative_samples(both, few, 2, ["center"], seed=4).collect())) == want
    assert pairs.negative_samples(both, few.where("slots = 0"), 2, ["center"]).count() == 0


def test_folds_and_budgets(spark):
    got = {r.id: r.split for r in splits.k_fold(spark.range(10), [F.col("id").asc()], 0).collect()}
    assert [i for i, s in got.items() if s == "test"] == [0] and sum(s == "train" for s in got.values()) == 8
    seen = [i for k in range(10) for i, s in {r.id: r.split for r in splits.k_fold(spark.range(25), [F.col("id").asc()], k).collect()}.items() if s == "test"]
    assert sorted(seen) == list(range(25))
    cut = splits.budget_split(spark.range(6), F.lit(4), [F.col("id").asc()], (("train", 10), ("valid", 3))).collect()
    assert {r.id: r.split for r in cut} == {0: "train", 1: "train", 2: "valid"}
    exact = splits.budget_split(spark.range(3), F.lit(5), [F.col("id").asc()], (("train", 10), ("valid", 3))).collect()
    assert {r.id: r.split for r in exact} == {0: "train", 1: "train"}
    assert [r.x for r in spark.range(5).select(splits.cyclic(F.col("id"), 3).alias("x")).collect()] == [0, 1, 2, 0, 1]


def test_numbering_and_sums_are_global(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k"))
    assert sorted((r.k, r.row) for r in storage.number_rows(df, [F.col("k").asc()]).collect()) == [(i, i) for i in range(1000)]
    assert {r.k: r.cum for r in storage.running_sum(df, "k", [F.col("k").asc()]).collect()} == {i: i * (i + 1) // 2 for i in range(1000)}


def test_join_beyond_the_broadcast_bound(spark, monkeypatch):
    rows = spark.range(500).select((F.col("id") % 5 % 3).alias("k"), F.col("id").alias("v"))
    keys = spark.createDataFrame([(0, "a"), (1, "b")], "k long, name string")
    want = sorted(map(tuple, storage.join_keys(rows, keys, "k").select("k", "v", "name").collect()), key=repr)
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 1)
    assert sorted(map(tuple, storage.join_keys(rows, keys, "k").select("k", "v", "name").collect()), key=repr) == want


def test_bleu(spark):
    same = spark.createDataFrame([(1, "a b c d e".split(), "a b c d e".split())], "row long, ref array<string>, pred array<string>")
    assert metrics.corpus_bleu(same, "row").first().bleu == pytest.approx(100)
    none = spark.createDataFrame([(1, "a b c".split(), "x y".split())], "row long, ref array<string>, pred array<string>")
    assert metrics.corpus_bleu(none, "row").first().bleu == 0
    short = spark.createDataFrame([(1, "a b c d e f".split(), "a b c d".split())], "row long, ref array<string>, pred array<string>")
    assert metrics.corpus_bleu(short, "row").first().bleu == pytest.approx(100 * math.exp(1 - 6 / 4))


def test_text_vectors_and_cache(spark, tmp_path):
    m = spark.createDataFrame([("a", 0, [1.0, 2.5]), ("b", 1, [0.5, -1.0])], "word string, id long, vec array<double>")
    writers.write_embeddings(m, f"{tmp_path}/v")
    raw = [r.value for r in spark.read.text(f"{tmp_path}/v").collect()]
    assert sorted(raw) == sorted(["2 2", "a 1.0 2.5", "b 0.5 -1.0"])
    assert {r.word: r.vec for r in readers.text_vectors(spark, f"{tmp_path}/v").collect()} == {"a": [1.0, 2.5], "b": [0.5, -1.0]}
    writers.write_embeddings(spark.createDataFrame([("a", 0, [1.0]), ("7", 1, [2.0]), ("c", 2, [0.5])], "word string, id long, vec array<double>"), f"{tmp_path}/one")
    assert {r.word: r.vec for r in readers.text_vectors(spark, f"{tmp_path}/one").collect()} == {"a": [1.0], "7": [2.0], "c": [0.5]}
    (tmp_path / "plain.txt").write_text("x 3\n12 5\n7 1\n")  # no line of two whole numbers is a header here
    assert {r.word: r.vec for r in readers.text_vectors(spark, f"{tmp_path}/plain.txt").collect()} == {"x": [3.0], "12": [5.0], "7": [1.0]}
    (tmp_path / "head.txt").write_text("2 1\n12 5\n7 1\n")
    assert {r.word: r.vec for r in readers.text_vectors(spark, f"{tmp_path}/head.txt").collect()} == {"12": [5.0], "7": [1.0]}
    (tmp_path / "x.bin.gz").write_bytes(gzip.compress(writers.binary_embeddings([("a", [1.0, 2.5]), ("bb", [0.5, -1.0])])))
    assert {r.word: r.vec for r in readers.binary_vectors(spark, f"{tmp_path}/x.bin.gz").collect()} == {"a": [1.0, 2.5], "bb": [0.5, -1.0]}
    calls = []
    build = lambda: calls.append(1) or spark.range(3)
    assert readers.cached(spark, f"{tmp_path}/c", build).count() == readers.cached(spark, f"{tmp_path}/c", build).count() == 3 and calls == [1]


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text('1,"say ""hi""","two\nlines"\n4,x,\n')
    assert sorted((r.label, r.text) for r in readers.labelled_csv(spark, f"{tmp_path}/a.csv").collect()) == [(0, 'say "hi" two\nlines'), (3, "x ")]
    (tmp_path / "b.json").write_text('{"text": "a\tb", "id": 3}\n{"text": "c"}\n')
    assert sorted(r.text for r in readers.json_lines(spark, f"{tmp_path}/b.json").collect()) == ["a\tb", "c"]
    (tmp_path / "c.txt").write_bytes(b"x y\nb\xffad\n\nlast")
    assert [(r.line_no, r.text) for r in readers.lines(spark, f"{tmp_path}/c.txt").orderBy("line_no").collect()][2:] == [(2, ""), (3, "last")]
    assert sorted(r.text for r in readers.labelled_by_file(spark, {1: f"{tmp_path}/c.txt"}).collect()) == ["", "bad", "last", "x y"]
    assert readers.first_line_words(spark, f"{tmp_path}/c.txt").first().words == ["x", "y"]
    assert readers.whole_file_words(spark, f"{tmp_path}/c.txt").count() == 4
    (tmp_path / "d.ss").write_text("u\t\tp\t\t7\t\tgood <sssss> film\n")
    assert tuple(readers.double_tab(spark, f"{tmp_path}/d.ss").first()) == (0, 6, "good <sssss> film")
    (tmp_path / "e.json").write_text('["a", "b", "?"]')
    assert readers.alphabet(spark, f"{tmp_path}/e.json") == "ab?"


def test_first_losses():
    p = kernels.skipgram_init(100, 10, 1)
    c = np.array([0, 1, 2, 3, 4])
    center, node = np.repeat(c, 4), np.arange(20)
    assert kernels.skipgram_loss(p, center, node, np.tile([1, 0, 0, 0], 5)) == pytest.approx(20 * math.log(2))
    assert kernels.skipgram_loss(kernels.skipgram_init(100, 10, 1, 199), np.r_[c, c], np.arange(10), np.r_[np.ones(5), np.zeros(5)]) == pytest.approx(10 * math.log(2))
    g = kernels.glove_init(9, 4, 1)
    i, j, x = np.array([0]), np.array([1]), np.array([7.0])
    assert kernels.glove_loss(g, i, j, x) == pytest.approx(kernels.glove_loss(g, i, j, x, literal=True))


def test_shapes():
    ids = np.random.default_rng(0).integers(0, 20, (1, 12))
    assert kernels.text_cnn(kernels.text_cnn_init(20, 8, 2, 1, filters=5), ids).shape == (1, 2)
    p = kernels.char_cnn_init(70, 4, 1)
    assert p["c0"].size + p["c0_b"].size == 125_696 and p["f0"].shape[0] == 8704
    assert kernels.conv1d(np.zeros((1, 1014, 70)), p["c0"][:, :, :2], p["c0_b"][:2]).shape == (1, 1008, 2)
    assert kernels.char_cnn(kernels.char_cnn_init(5, 4, 1, (4,) * 6, hidden=8), np.zeros((2, 1014, 5))).shape == (2, 4)
    assert kernels.char_word_lm(kernels.char_word_init(9, 11, 1, 3, 4, 5, 6), np.zeros((2, 3, 4), int)).shape == (2, 3, 11)
    han = kernels.han_init(9, 3, 1, 4, 5)
    assert kernels.han(han, np.zeros((2, 3, 4), int)) == pytest.approx(np.broadcast_to(han["fc_b"], (2, 3)))  # nothing but padding
    t = kernels.translator_init(9, 8, 1, 4, 4)
    assert kernels.translate_forced(t, ids % 9, ids % 8).shape == (1, 12, 8) and kernels.translate_greedy(t, ids % 9, 7).shape == (1, 7)
    a = kernels.attention_init(9, 8, 1, 4, 4)
    assert kernels.attention_translate(a, ids % 9, ids % 8).shape == (1, 12, 8) and kernels.attention_translate(a, ids % 9, None, 5).shape == (1, 5)


def test_attention_against_a_plain_version():
    """One place at a time: the state starts from the forward end, scores are relu of place and state, word, context and state are classified."""
    p = kernels.attention_init(9, 8, 1, 3, 4)
    p = {k: v if isinstance(v, dict) else v + 0.1 for k, v in p.items()}
    src, tgt = np.array([[1, 5, 2, 7]]), np.array([[2, 4, 6]])
    s = lambda x: 1 / (1 + math.e**-x)

    def cell(q, x, h, c):
        i, f, g, o = np.split(x @ q["x"] + q["bx"] + h @ q["h"] + q["bh"], 4)
        c = s(f) * c + s(i) * np.tanh(g)
        return s(o) * np.tanh(c), c

    x = [p["src"][k] for k in src[0]]
    ends, places = [], []
    for q, order in (("fw", range(4)), ("bw", reversed(range(4)))):
        h = c = np.zeros(4)
        seen = [None] * 4
        for t in order:
            h, c = cell(p[q], x[t], h, c)
            seen[t] = h
        ends.append((h, c))
        places.append(seen)
    enc = [np.concatenate([a, b]) for a, b in zip(*places, strict=True)]
    (h, c), want = ends[0], []
    for k in tgt[0]:
        e = [math.exp(np.maximum(np.concatenate([y, h]) @ p["score1"] + p["score1_b"], 0) @ p["score2"]) for y in enc]
        context = sum(w / sum(e) * y for w, y in zip(e, enc, strict=True))
        word = p["tgt"][k]
        h, c = cell(p["dec"], np.concatenate([word, context]), h, c)
        want.append(np.maximum(np.concatenate([word, context, h]) @ p["c1"] + p["c1_b"], 0) @ p["c2"] + p["c2_b"])
    assert kernels.attention_translate(p, src, tgt)[0] == pytest.approx(np.array(want))


def test_small_tables_are_bounded_in_bytes(spark, monkeypatch):
    wide = spark.range(100).select("id", F.array_repeat(F.lit(1.0), 50).alias("vec"), F.lit("ab").alias("s"))
    assert storage.fits(wide)
    monkeypatch.setattr(storage, "BROADCAST_BYTES", 30_000)
    assert not storage.fits(wide) and storage.fits(wide.select("id"))


def test_adam_descends():
    p, adam = {"x": np.array([5.0])}, kernels.Adam(0.1)
    for _ in range(300):
        adam.step(p, {"x": 2 * p["x"]})
    assert abs(p["x"][0]) < 0.1 and kernels.l2_penalty({"fc": np.ones((2, 2))}) == pytest.approx(0.016)


def test_training_lowers_the_loss(spark):
    rng = np.random.default_rng(2)
    rows = [([int(c * 10 + k) for k in rng.integers(0, 10, 6)], int(c)) for c in rng.integers(0, 3, 600)]
    df = spark.createDataFrame(rows, "ids array<int>, label int").repartition(3)
    params, losses = train.bag_classifier(df, 30, 8, 3, 12, rate=5.0, size=8)
    assert losses[-1] < losses[0]
    got = train.infer(df, params, kernels.bag_forward, ["label"])
    from weftline.functions import arrays

    assert metrics.accuracy(got, arrays.argmax(F.col("scores")), F.col("label")).first().accuracy > 0.95
    cells = spark.createDataFrame([(i, j, float(1 + (i * j) % 7)) for i in range(12) for j in range(12)], "w_id long, c_id long, x double")
    _, losses = train.glove(cells, 12, 6, 6, rate=0.2, size=16)
    assert losses[-1] < losses[0]


def test_huffman_of_many_words():
    """A million words of a few thousand frequencies: the mean length is the sum of all inner nodes' frequencies."""
    rng = np.random.default_rng(2)
    sizes = sorted({int(f): int(n) for f, n in zip(rng.integers(1, 10**6, 3000), rng.integers(1, 700, 3000), strict=True)}.items())
    tree = pairs.Huffman(sizes)
    freqs = np.repeat([f for f, _ in sizes], [n for _, n in sizes])
    at = np.arange(0, tree.words, 997)
    lengths = np.array([len(b) for b, _ in tree.paths(at)])
    assert tree.words == len(freqs) and (np.diff(lengths) <= 0).all()
    entropy = -np.log2(freqs[at] / freqs.sum())
    assert (np.abs(lengths - entropy) < 2).all()
    assert pairs.Huffman([(3, 1)]).paths(np.array([0])) == [([], [])]


def test_running_values_of_long_keys(spark):
    rng = random.Random(3)
    rows = [(None if i % 11 == 5 else "big" if i % 3 else f"k{i % 7}", i, float(rng.randrange(50))) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, n long, v double")
    numbered = storage.materialize(storage.number_rows(df, [F.col("k").asc(), F.col("n").asc()], "row"), "t")
    got = storage.running(numbered, "k", "row", {"lo": ("min", F.col("v")), "hi": ("max", F.col("v")), "s": ("sum", F.col("v"))}, segment=13).collect()
    assert len(got) == len(rows)
    own = {}
    for k, n, v in rows:
        own.setdefault(k, []).append(v)
        at = next(r for r in got if r.k == k and r.n == n)
        assert (at.lo, at.hi, at.s) == (min(own[k]), max(own[k]), sum(own[k]))


def test_early_stops_of_one_long_key(spark, monkeypatch):
    monkeypatch.setattr(storage.running, "__defaults__", (17,))
    rng = random.Random(8)
    rows = [("big" if i % 3 == 0 else f"k{rng.randrange(6)}", i, float(rng.randrange(1000) + 2 * i % 7)) for i in range(600)]
    got = {r.k: (r.best, r.counter, r.stop_at) for r in metrics.early_stops(spark.createDataFrame(rows, "k string, n long, v double"), "k", ["n"], "v", 6).collect()}
    for k in {r[0] for r in rows}:
        best, counter, stop = math.inf, 0, None
        for i, v in enumerate((v for c, _, v in rows if c == k), 1):
            best, counter = (v, 0) if v <= best else (best, counter + 1)
            if counter >= 6:
                stop = i
                break
        assert got[k] == (best, counter, stop)


def test_block_matrices(spark, monkeypatch):
    rng = np.random.default_rng(5)
    m = rng.normal(size=(23, 11))
    rows = [(i, m[i].tolist()) for i in range(23) if i != 7]
    b = blocks.Blocks.of(spark.createDataFrame(rows, "id long, vec array<double>").repartition(3), "id", "vec", 4, 3)
    assert max(len(r.x) for r in b.table.collect()) <= 12
    cells = {(r.row, r.col): r.value for r in b.cells().collect()}
    assert cells == {(i, j): m[i, j] for i in range(23) if i != 7 for j in range(11)}
    assert {(r.row, r.col): r.value for r in b.transpose().cells().collect()} == {(j, i): v for (i, j), v in cells.items()}
    assert {(r.row, r.col): r.value for r in b.transpose().transpose().cells().collect()} == cells
    assert {r.row: (pytest.approx(r.total), r.n) for r in b.transpose().row_sums().collect()} == {j: (sum(v for (_, c), v in cells.items() if c == j), 22) for j in range(11)}
    wanted = [("a", 0), ("a", 0), ("a", 22), ("b", 5), ("b", 7), ("b", 99)]
    members = spark.createDataFrame(wanted, "g string, id long")
    want = {(g, j): np.mean([m[i, j] for k, i in wanted if k == g and i < 23 and i != 7]) for g in "ab" for j in range(11)}
    assert {(r.g, r.col): pytest.approx(r["mean"]) for r in b.means(members, "g", "id").collect()} == want
    monkeypatch.setattr(storage, "BROADCAST_ROWS", 0)
    assert {(r.g, r.col): pytest.approx(r["mean"]) for r in b.means(members, "g", "id").collect()} == want
    assert blocks.Blocks.of(spark.createDataFrame([], "id long, vec array<double>"), "id", "vec").means(members, "g", "id").count() == 0


def test_initial_vectors(spark):
    v = spark.createDataFrame([("a", 0), ("b", 1)], "word string, id long")
    e = spark.createDataFrame([("a", [1.0, 3.0])], "word string, vec array<double>")
    got = {r.word: r for r in vectors.initial_vectors(v, e, 2).collect()}
    assert got["a"].vec == [1.0, 3.0] and not got["b"].pretrained and len(got["b"].vec) == 2
    assert vectors.initial_vectors(v, e, 2).where("word = 'b'").first().vec == got["b"].vec
    assert vectors.matrix_of(v.select("id", F.array(F.col("id").cast("double")).alias("vec"))).tolist() == [[0.0], [1.0]]


def test_stream_over_several_batches_is_the_batch_fold(spark, tmp_path):
    rng = random.Random(6)
    rows = [(i, rng.randrange(4), float(rng.randrange(20))) for i in range(200)]
    for k in range(4):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], "n long, run int, loss double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    whole = spark.read.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(whole.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    got = folds.run_once(folds.early_stop(stream, "run", ["n"], "loss", 4), "t-stop").groupBy("run").agg(F.max_by(F.struct("best", "counter", "stop_at"), "epoch").alias("s")).select("run", "s.*")
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, metrics.early_stops(whole, "run", ["n"], "loss", 4).collect()), key=repr)
    ema = folds.run_once(folds.moving_average(stream, "run", ["n"], "loss"), "t-ema").groupBy("run").agg(F.max_by("ema", "epoch").alias("ema")).collect()
    want = {r.run: r.ema for r in metrics.moving_average(whole, "run", ["n"], "loss").collect()}
    assert {r.run: pytest.approx(r.ema) for r in ema} == want


def test_char_rows_are_their_sql(spark, duck):
    from conftest import DATA, assert_same

    from weftline.plans import catalogue as c
    from weftline.plans import config

    sql = f"""WITH c AS (SELECT doc_id AS doc, {c.CHARS} AS c FROM documents), ct AS (SELECT doc, unnest(c) AS word, generate_subscripts(c, 1) - 1 AS pos FROM c),
    cv AS ({c.most_common(509, 3, "ct")}), t AS ({c.toks(c.LOWER)}), wv AS ({c.most_common(4998, 2)}), w AS (SELECT doc_id AS doc, {c.WORDS} AS w FROM documents),
    p AS (SELECT doc, k AS pos, w, CASE WHEN k < len(w) THEN w[k + 1] END AS word, CASE WHEN k > 0 AND k <= len(w) THEN w[k] END AS before FROM w, unnest(range(20)) AS r(k)),
    i AS (SELECT doc, pos, list(coalesce(cv.id, 1) ORDER BY n) AS ids FROM (SELECT doc, pos, substr(before, n, 1) AS word, n FROM p, unnest(range(1, 17)) AS r(n) WHERE before IS NOT NULL AND n <= length(before)) LEFT JOIN cv USING (word) GROUP BY doc, pos)
    SELECT p.doc, p.pos, CASE WHEN p.word IS NULL THEN 0 ELSE coalesce(wv.id, 1) END::INT AS word_id,
      CASE WHEN p.pos = 0 THEN list_transform(range(16), lambda z: 2) ELSE {c.padded("coalesce(i.ids, [])", 16)} END AS chars, (p.word IS NOT NULL)::INT AS weight
    FROM p LEFT JOIN wv ON wv.word = lower(p.word) LEFT JOIN i ON i.doc = p.doc AND i.pos = p.pos"""
    d = spark.read.parquet(f"{DATA}/documents.parquet")
    chars = vocab.fit_vocab(vocab.tokens(d, corpora.chars_of(d)), config.POLICIES["lm_chars"])
    lower = vocab.fit_vocab(vocab.tokens(d, corpora.words_of(d, True)), config.POLICIES["lm_words"])
    assert_same(vocab.char_rows(d, corpora.words_of(d), chars, lower, 20, 16), duck, sql)


def test_lm_rows_of_every_sentence(spark):
    """Against a plain version: every sentence of 10 to 100 words has 100 places, shorter and longer ones none."""
    from collections import Counter

    long = " ".join(f"w{i % 7}" for i in range(100))
    texts = ["One two three Four five six seven eight nine ten. Too short.\na b c d e f g h i j k l antidisestablishmentarianisms m", long, long + " w", "", None]
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sents = {(r.doc_id, r.sent): r.words for r in corpora.lm_sentences(d).collect()}
    assert sorted(k[0] for k in sents) == [0, 0, 1] and sorted(map(len, sents.values())) == [10, 14, 100]
    words = [w for t in texts if t for w in t.split()]
    first = lambda xs: {x: i for i, x in reversed(list(enumerate(xs)))}

    def numbered(xs, offset):
        at, n = first(xs), Counter(xs)
        return {x: offset + i for i, x in enumerate(sorted(n, key=lambda x: (-n[x], at[x])))}

    chars, lower = numbered([c for w in words for c in w], 3), numbered([w.lower() for w in words], 2)
    want = set()
    for (doc, sent), own in sents.items():
        for pos in range(100):
            before = [chars[c] for c in own[pos - 1][:16]] if 0 < pos <= len(own) else []
            want.add((doc, sent, pos, lower[own[pos].lower()] if pos < len(own) else 0, (2,) * 16 if pos == 0 else tuple(before + [0] * (16 - len(before))), int(pos < len(own))))
    assert {(r.doc_id, r.sent, r.pos, r.word_id, tuple(r.chars), r.weight) for r in corpora.lm_rows(d).collect()} == want


def test_negatives_are_drawn_for_every_occurrence(spark):
    ids = spark.createDataFrame([(d, p, 0 if p % 2 else 1) for d in range(2) for p in range(5)], "doc long, pos int, id long")
    both = pairs.windows(pairs.close_gaps(ids), 3)
    n = sum(1 for i in range(5) for j in range(5) if 0 < abs(i - j) <= 3) * 2
    assert both.count() == n == pairs.skipgram_counts(ids, 3).agg(F.sum("n")).first()[0]
    dist = pairs.noise(spark.createDataFrame([(0, 4), (1, 6)], "id long, freq long"))
    assert pairs.negative_samples(both, dist, 3, ["doc", "pos", "distance"]).count() == 3 * n
