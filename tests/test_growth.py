"""Steps whose work must be dealt out and must not grow faster than the input."""


import __spark_entry__ as e


def test_word2vec_learns_in_many_tasks(spark, monkeypatch):
    from pyspark.ml.feature import Word2Vec

    seen, fit = [], Word2Vec.fit
    monkeypatch.setattr(Word2Vec, "fit", lambda self, rows: seen.append(self.getNumPartitions()) or fit(self, rows))
    assert e.queries()["train_word2vec_ml"](spark, "/root/testdata/sf0.001").count() > 0
    assert seen == [spark.sparkContext.defaultParallelism]


def test_grams_are_counted_in_tasks(spark, monkeypatch):
    from pyspark.sql import functions as F

    from weftline.functions import arrays
    from weftline.operators import vocab
    from weftline.plans import corpora

    docs = spark.createDataFrame([(3, "a b a b c"), (0, "b a  a b"), (1, None), (2, ""), (9, "c"), (7, "a")], "doc_id long, text string")
    words = corpora.words_of(docs)
    for n in (1, 2, 3):
        plain = docs.select(F.col("doc_id").alias("doc"), F.posexplode(arrays.backward_ngrams(words, n)).alias("pos", "word"))
        monkeypatch.setattr(vocab, "GRAMS", 3)
        assert sorted(map(tuple, vocab.count_grams(docs, words, n).collect())) == sorted(map(tuple, vocab.count_words(plain).collect()))
    want = sorted(map(tuple, vocab.fit_ngram_vocab(docs, words, 2, 1).collect()))
    shifted = vocab.fit_ngram_vocab(docs.withColumn("doc_id", F.col("doc_id") - 100), words, 2, 1)  # places that do not fit
    assert sorted(map(tuple, shifted.collect())) == want


def test_pairs_are_packed(spark, monkeypatch):
    from collections import Counter

    import numpy as np

    from weftline.operators import pairs

    rng = np.random.default_rng(1)
    key, n = np.unique(rng.integers(0, 1 << 31, 1000) << 32 | rng.integers(0, 1 << 31, 1000)), rng.integers(1, 1 << 40, 1000)
    back = pairs._unpacked(len(key), pairs._packed(key, n))
    assert (back[0] == key).all() and (back[1] == n).all()
    monkeypatch.setattr(pairs, "SUMMED", 3)
    lists = [(d, [int(x) if x < 5 else None for x in rng.integers(0, 7, 30)]) for d in range(9)]
    want = Counter()
    for _, ids in lists:
        for i, a in enumerate(ids):
            for j in range(max(0, i - 2), min(len(ids), i + 3)):
                if j != i and a is not None and ids[j] is not None:
                    want[a, ids[j]] += 1
    got = pairs.list_counts(spark.createDataFrame(lists, "doc long, ids array<int>"), 2, True)
    assert "HashAggregate" not in got._jdf.queryExecution().toString()  # no pair is a row between tasks
    assert {(r.center, r.ctx): r.n for r in got.collect()} == want


def test_tfidf_and_agreement_shuffle_no_words(spark):
    import re

    from weftline.operators import ranking, segment
    from weftline.plans import corpora

    rows = [(i, " ".join(f"w{(i * j) % 13}" for j in range(i))) for i in range(12)] + [(20, None), (21, "z z y x w v u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    words = corpora.words_of(docs)
    fast, joined = ranking.tfidf(docs, words, 3), ranking.tfidf(docs, words, 3, most=0)
    assert sorted(map(tuple, fast.collect())) == sorted(map(tuple, joined.collect()))
    assert "Exchange" not in fast._jdf.queryExecution().toString()
    held = spark.createDataFrame([(1, ["ab", "c", "d"], ["ab", "cd"]), (2, ["é", "bc"], ["é", "b", "c"]), (3, [], []), (4, None, None), (5, ["a"], ["a"])], "doc_id long, t array<string>, f array<string>")
    got = segment.agreement(held, "doc_id", "t", "f")
    assert {r.doc_id: r.n_right for r in got.collect()} == {1: 1, 2: 1, 3: 0, 4: 0, 5: 1}
    assert not re.search("Exchange|Window", got._jdf.queryExecution().toString())


def test_waiting_rows_are_few_values():
    import numpy as np

    from weftline.streaming import timed

    rows = np.zeros(2 * timed.TOGETHER + 1, timed.WAITS)
    rows["at"] = np.arange(len(rows))
    chunks = timed._chunks(rows)
    assert len(chunks) == 3 and (np.concatenate([np.frombuffer(c, timed.WAITS) for c, in chunks]) == rows).all()


def test_trees_write_rows_once_and_shuffle_sums_only(spark, monkeypatch):
    import random

    import numpy as np
    import pyarrow as pa
    from pyspark.sql import functions as F

    from weftline import storage
    from weftline.models import boost

    rng = random.Random(5)
    rows = [(i, i % 3 % 2, {f"w{k}": rng.randrange(1, 6) for k in rng.sample(range(9), rng.randrange(6))}) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, label int, bag map<string,int>").repartition(3)
    written, write = [], storage.materialize
    monkeypatch.setattr(storage, "materialize", lambda df, name: written.append(name) or write(df, name))
    want = boost.fit(df, 5, 2)
    assert written == ["blocks"]  # not once a tree
    plan = boost._sums(write(boost._blocks(df), "blocks"), want[:1], boost.Tree({}, {}), [0])
    assert plan.count() <= 3 * 9 * 5  # one row for each task, feature and bin

    plain = {r.id: r.s for r in df.select("id", boost.score(want).alias("s")).collect()}
    assert {r.id: r.score for r in boost.scores(df, want, ("id",)).collect()} == plain
    for name, small in (("HELD_SUMS", 3), ("BATCH_ROWS", 2), ("HELD_TREES", 2)):
        monkeypatch.setattr(boost, name, small)
    odd = df.unionByName(spark.createDataFrame([(-1, None, {"w1": 1})], df.schema))  # a row without a label is left out
    got = boost.fit(odd, 5, 2)
    assert [t.splits for t in got] == [t.splits for t in want] and len(written) > 2
    assert all(abs(g.weights[k] - w.weights[k]) < 1e-9 for g, w in zip(got, want, strict=True) for k in w.weights)
    assert boost.fit(df.where("id < 0"), 2) == [boost.Tree({}, {})] * 2

    bag = pa.array([list(b.items()) for _, _, b in rows], pa.map_(pa.string(), pa.int32()))
    for name, small, most in (("BLOCK_ENTRIES", 4, 5), ("BLOCK_ROWS", 7, 7)):  # a row alone may have five entries
        monkeypatch.setattr(boost, name, small)
        blocks = [boost._Block(b) for b in boost._cut(np.array([y for _, y, _ in rows]), bag)]
        assert max(len(b.places) if name == "BLOCK_ENTRIES" else len(b.y) for b in blocks) <= most
        assert [float(s) for b in blocks for s in b.score(want)] == [plain[i] for i in range(90)]
        assert [y for b in blocks for y in b.y] == [y for _, y, _ in rows]
        monkeypatch.setattr(boost, name, 1000)


def test_bags_are_made_in_rows(spark):
    from pyspark.sql import functions as F

    from weftline.models import boost
    from weftline.plans import corpora

    docs = spark.createDataFrame([(1, "b a a A a", 1), (1, "a c", 0), (2, None, 1), (3, "", 0), (4, "b d", 1), (None, "c", 1)], "doc_id long, text string, label int")
    got = boost.bags(docs, corpora.words_of(docs, True), 3, 4, keep=("label",))
    want = [(None, 1, {"c": 1}), (1, 0, {"a": 1, "c": 1}), (1, 1, {"a": 3, "b": 1}), (2, 1, {}), (3, 0, {}), (4, 1, {"b": 1})]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()  # neither texts nor counts of documents are moved
    assert [r.bag for r in boost.bags(docs.where("doc_id > 1 AND doc_id < 4"), corpora.words_of(docs, True)).select(F.col("bag")).collect()] == [{}, {}]


def test_char_vocab_is_that_of_its_sql(spark, tmp_path):
    import duckdb

    from conftest import assert_same

    long_ = "a" * 1_000_003 + "z"  # its places go into those of the next document
    rows = [(0, "b a \U0001f600"), (1, ""), (2, " \t\n\r\f\x0b"), (3, None), (4, long_), (5, "yxw"), (9, "\u0000v\x1c"), (-7, "u"), (11, "  ")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert_same(e.queries()["char_vocab"](spark, str(tmp_path)), con, e.oracle_sql()["char_vocab"])


def test_draws_are_made_where_the_lists_are(spark, monkeypatch):
    import hashlib

    import numpy as np

    from weftline.functions import digest
    from weftline.operators import pairs

    texts = [f"1-{i * 7919}-{-i}".encode() for i in range(5000)] + [b"", b"x" * digest.MOST]
    sizes, rows = np.array([len(x) for x in texts]), np.zeros((len(texts), 64), np.uint8)
    for i, x in enumerate(texts):
        rows[i, : len(x)] = np.frombuffer(x, np.uint8)
    digest.closed(rows, sizes)
    assert digest.first_bits(rows).tolist() == [int(hashlib.md5(x).hexdigest()[:15], 16) for x in texts]
    lists = spark.createDataFrame([(1 << 62, list(range(30)) * 40), (-5, [1, None, 2, 3]), (7, []), (8, None), (0, [4, 4]), (12, [3])], "doc long, ids array<int>")
    dist = spark.createDataFrame([(i, (i * 7) % 5) for i in range(30)], "id long, slots long")
    monkeypatch.setattr(pairs, "DRAWN", 3)  # some parts
    got = pairs.list_negatives(lists, dist, 3, 2)
    assert "md5" not in got._jdf.queryExecution().toString()
    want = pairs.negative_samples(pairs.list_windows(lists, 3), dist, 2, ["doc", "pos", "distance"], keep=["center", "ctx"])
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    monkeypatch.setattr(pairs, "HELD_WORDS", 0)
    assert sorted(map(tuple, pairs.list_negatives(lists, dist, 3, 2).collect())) == sorted(map(tuple, want.collect()))
    assert pairs.list_negatives(lists, dist.where("slots = 0"), 3, 2).count() == 0


def test_triples_are_made_where_the_lists_are(spark, monkeypatch):
    import numpy as np
    import pyarrow as pa

    from weftline.models import kernels, train
    from weftline.operators import pairs

    lists = spark.createDataFrame([(d, [(d * 3 + i * i) % 12 if (d + i) % 4 else None for i in range(40)]) for d in range(20)] + [(30, []), (31, None), (32, [5])], "doc long, ids array<int>")
    v = spark.createDataFrame([(i, 20 + (i * 7) % 5) for i in range(12)], "id long, freq long")
    dist = spark.createDataFrame([(i, (i * 7) % 5) for i in range(12)], "id long, slots long")
    paths = pairs.huffman_paths(v)
    monkeypatch.setattr(pairs, "MIXED", 64)
    both = pairs.list_windows(lists, 3)
    drawn = pairs.list_negatives(lists, dist, 3, 2)
    wants = (sorted([(r.center, r.ctx, 1) for r in both.collect()] + [(r.center, r.neg, 0) for r in drawn.collect()]), sorted(map(tuple, pairs.path_pairs(both.select("center", "ctx"), paths).collect())))
    for most in (pairs.HELD_WORDS, 0):
        monkeypatch.setattr(pairs, "HELD_WORDS", most)
        monkeypatch.setattr(pairs, "HELD_NODES", most)
        for want, (rows, made) in zip(wants, (pairs.draw_triples(lists, dist, 3, 2), pairs.path_triples(lists, paths, 3)), strict=True):
            assert rows.columns == (["doc", "ids"] if most else ["center", "node", "sign"])  # nothing else is written
            got = [np.stack(x, 1) for b in rows.toArrow().to_batches() for x in made(iter([b]))]
            assert sorted(map(tuple, np.concatenate(got).tolist())) == want
            assert not most or all((x[:, 2] == 0).any() and (x[:, 2] == 1).any() for x in got if len(x) > 30)
            _, losses = train.skipgram(rows, 12, 4, 6, nodes=24, rate=0.02, size=64, expand=made)
            assert losses[-1] < losses[0]
    r, p = np.random.default_rng(1), kernels.skipgram_init(9, 4, 1)
    p["v"] += r.normal(0, 1, p["v"].shape)
    center, node, sign = r.integers(0, 9, 200), r.integers(0, 9, 200), r.integers(0, 2, 200)
    q = {k: x.copy() for k, x in p.items()}
    a, b = p["w"][center], p["v"][node]
    g = (kernels.sigmoid((a * b).sum(-1)) - sign)[:, None]
    np.add.at(q["w"], center, -0.1 * g * b)
    np.add.at(q["v"], node, -0.1 * g * a)
    want = kernels.skipgram_loss(p, center, node, sign)
    assert np.isclose(kernels.skipgram_step(p, center, node, sign, 0.1), want) and all(np.allclose(p[k], q[k]) for k in p)


def test_a_round_has_no_more_tasks_than_cores(spark, monkeypatch):
    from weftline.models import train

    seen, plain = [], train._means
    cells = spark.range(400).selectExpr("id % 12 AS w_id", "id % 7 AS c_id", "1.0D + id % 5 AS x").repartition(40)
    monkeypatch.setattr(train, "_means", lambda moved, width: seen.append(moved.rdd.getNumPartitions()) or plain(moved, width))
    train.glove(cells, 12, 4, 2)
    assert seen == [spark.sparkContext.defaultParallelism] * 2


def test_documents_are_read_together(spark, monkeypatch):
    import numpy as np

    from weftline.models import kernels, train

    r, p = np.random.default_rng(2), kernels.han_init(30, 4, 1, 5, 3)
    docs = [(d, int(n), [r.integers(1, 30, r.integers(0, 7)).tolist() for _ in range(r.integers(1, n + 1))]) for d, n in enumerate(r.choice([1, 2, 5, 9], 40))]
    monkeypatch.setattr(kernels, "LINES", 7)
    monkeypatch.setattr(train, "HELD_LINES", 20)
    got = dict(map(tuple, train.infer_documents(spark.createDataFrame(docs, "doc long, most int, sents array<array<int>>"), p, 6).collect()))
    for d, most, sents in docs:
        ids = np.zeros((1, most, 6), int)
        for i, x in enumerate(sents):
            ids[0, i, : len(x)] = x
        assert np.allclose(got[d], kernels.han(p, ids)[0], rtol=1e-12, atol=1e-14)


def test_sentences_are_scored_without_their_padding(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import functions as F

    from weftline.models import kernels
    from weftline.operators import vocab

    r, names = np.random.default_rng(4), ["ab", "Ab", "c", "dddddd", "éx", "abc", "zz"]
    rows = spark.createDataFrame([(i, r.choice(names, r.integers(1, 9)).tolist()) for i in range(60)], "doc_id long, words array<string>")
    chars = spark.createDataFrame([(c, 3 + i, 1) for i, c in enumerate("abcdx")], "word string, id long, freq long")
    words = spark.createDataFrame([(w, 2 + i, 1) for i, w in enumerate(["ab", "c", "zz"])], "word string, id long, freq long")
    p = kernels.char_word_init(9, 6, 1, 3, 4, 3, 4)
    monkeypatch.setattr(vocab, "SCORED", 25)
    got = {x.doc: x for x in vocab.sentence_losses(rows, F.col("words"), chars, words, 8, 4, kernels.char_word_losses, p).collect()}
    assert len(got) == 60
    for x in vocab.char_places(rows, F.col("words"), chars, words, 8, 4).collect():
        loss = kernels.cross_entropy(kernels.char_word_lm(p, np.array([[q.chars for q in x.places]])), np.array([[q.word_id for q in x.places]]))[0]
        weight = np.array([q.weight for q in x.places])
        assert np.isclose(got[x.doc].loss, (loss * weight).sum()) and got[x.doc].n == weight.sum()


def test_parameters_come_to_the_driver_as_blocks(spark, monkeypatch):
    import numpy as np
    from pyspark.sql import DataFrame

    from weftline.models import train

    seen, plain = [], DataFrame.toLocalIterator
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a, **k: (seen.append(r) or r for r in plain(self, *a, **k)))
    moves = lambda p, i: (p["a"].__setitem__(i, p["a"][i] + [1.0, 2.0, 3.0]), p["b"].__setitem__(i % 7, 1.0), 0.5)[-1]
    params, losses = train.averaged(spark.range(3000).repartition(4), {"a": np.zeros((3000, 3)), "b": np.zeros((7, 1))}, moves, 1, 64)
    assert losses == [0.5] and (params["a"] == [1, 2, 3]).all() and (params["b"] == 1).all()
    assert len(seen) < 60  # not a row for each of the model's


def test_counted_pairs_go_packed_to_their_center(spark, monkeypatch):
    from weftline.operators import pairs

    v = spark.createDataFrame([(i, 20 + (i * 7) % 11) for i in range(40)], "id long, freq long")
    counts = spark.createDataFrame([(c, x, 1 + (c * x) % 5) for c in range(40) for x in range(0, 44, 1 + c % 3)], "center long, ctx long, n long").repartition(5)
    paths = pairs.huffman_paths(v)
    monkeypatch.setattr(pairs, "SUMMED", 50)
    monkeypatch.setattr(pairs, "PATHED", 7)
    got = pairs.path_counts(counts, paths)
    assert "share" in got._jdf.queryExecution().toString() and "Sort" not in got._jdf.queryExecution().executedPlan().toString()
    want = pairs.path_pairs(counts, paths).groupBy("center", "node", "sign").agg({"n": "sum"})
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
