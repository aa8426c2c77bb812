"""The language model against plain counts and sums, hard negatives against all pairs."""

import collections
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from conftest import DATA

from weftline.llm import chunks, lm, negatives

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def plain_base(rows):
    """doc_id -> (held out, tokens, known, N, base) of (doc_id, text) rows."""
    cut = [(i, i is not None and zlib.crc32(str(i).encode()) % 5 == 1, [*WORD.findall((t or "").translate(LOWER)), None]) for i, t in rows]
    count = collections.Counter(w for _, held, ws in cut if not held for w in ws)
    n, v = sum(count.values()), len(count)
    return {i: (held, len(ws), sum(count[w] > 0 for w in ws), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in ws)) for i, held, ws in cut}


def agree(got, want):
    assert set(got) == set(want)
    for i, (held, n, known, total, base) in want.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base, rel=1e-9, abs=1e-9)


def test_model_beats_its_base_on_held_out_texts(spark):
    docs = spark.read.parquet(f"{DATA}/../sf0.01/documents.parquet")
    got = {r.doc_id: r for r in lm.scores(spark, docs.repartition(5)).collect()}
    agree(got, plain_base([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]))
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_model_on_odd_rows_and_many_chunks(spark, monkeypatch):
    monkeypatch.setattr(chunks, "BUCKET", 20_000)
    monkeypatch.setattr(lm, "FAN", 2)
    rng = random.Random(3)
    texts = [None, "", " \t\n", "A a  A", "same", "same", "x" * 20_000, "the " * 30_000, "nul \x00 ütf ﬀ z", *(" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(50))) for _ in range(60))]
    rows = [(None if i == 8 else i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(6)
    agree({r.doc_id: r for r in lm.scores(spark, df).collect()}, plain_base([r[:2] for r in rows]))
    assert lm.scores(spark, df.limit(0)).count() == 0
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 1)
    only = lm.scores(spark, spark.createDataFrame([(held, "never learned")], "doc_id long, text string")).first()
    assert (only.n_tokens, only.n_known, only.train_tokens, only.base_score, only.score) == (3, 0, 0, 0.0, 0.0)


def test_probabilities_sum_to_one(spark):
    """After any two words: those of all known words, of the end, and of one unknown word."""
    rng = random.Random(1)
    train = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 != 1]
    probe = [i for i in range(400, 4000) if zlib.crc32(str(i).encode()) % 5 == 1]
    vocab = [f"v{i}x{i % 7}" for i in range(700)]  # more than the classes of their own
    rows = [(i, " ".join(rng.choice(vocab) for _ in range(20))) for i in train]
    known = sorted({w for _, t in rows for w in t.split()})
    ids = iter(probe)
    for start in ("", "v1x1 v2x2"):
        rows += [(next(ids), start)]
        base = len(rows)
        rows += [(next(ids), f"{start} {w}".strip()) for w in [*known[:: max(1, len(known) // 300)], "never"]]
        assert base
    fitted = lm.fit(spark, spark.createDataFrame(rows, "doc_id long, text string"))
    possible = fitted.corpus.masses > 0
    for before in ([lm.START, lm.START], [1, 2], [5, lm.START], [lm.CLASSES - 1, 0]):
        at = np.array(before)[:, None]
        _, output, _, bias = fitted.model.all
        p = np.exp(fitted.model.predicted(at) @ output[possible].T + bias[possible] - fitted.model.log_norm(at, possible)[:, None])
        assert p.sum() == pytest.approx(1, abs=1e-5)
    # words share their class's probability by base mass, known words have all but an unknown word's mass
    count = collections.Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in t.split())
    assert fitted.corpus.masses.sum() == pytest.approx(sum(c + 0.5 for c in count.values()) + len(train) + 0.5)
    assert fitted.corpus.all_mass == pytest.approx(fitted.corpus.masses.sum() + 0.5)


def test_score_is_the_sum_of_its_tokens(spark):
    """The score from the fitted parameters, token by token."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    fitted = lm.fit(spark, docs)
    _, output, _, bias = fitted.model.all
    possible = fitted.corpus.masses > 0
    rows = [(r.doc_id, [*WORD.findall(r.text.translate(LOWER)), None]) for r in docs.collect()]
    count = collections.Counter(w for i, ws in rows if zlib.crc32(str(i).encode()) % 5 != 1 for w in ws)
    import pyarrow as pa

    def cls(w):
        data = w.encode() if w is not None else b""
        return 0 if w is None else fitted.corpus.top.get(data, 1 + lm.TOP + int(lm.endings(pa.array([data], pa.large_binary()))[0]))

    got = {r.doc_id: r.score for r in lm.scores(spark, docs).collect()}
    for i, ws in rows[:12]:
        total, one, two = 0.0, lm.START, lm.START
        for w in ws:
            k = cls(w)
            if count[w]:
                at = np.array([[one], [two]])
                s = float(fitted.model.predicted(at)[0] @ output[k] + bias[k] - fitted.model.log_norm(at, possible)[0])
                total += s / math.log(10) + math.log10((count[w] + 0.5) / fitted.corpus.masses[k]) + math.log10(1 - 0.5 / fitted.corpus.all_mass)
            else:
                total += math.log10(0.5 / fitted.corpus.all_mass)
            one, two = k, one
        assert got[i] == pytest.approx(total, rel=1e-4)


def plain_negatives(rows):
    """All pairs of (vec_id, vector, label) rows."""
    kept = []
    for i, v, label in dict.fromkeys((i, None if v is None else tuple(v), label) for i, v, label in rows):
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        row = (i, (label + 1) % 10 if i is not None and i % 7 == 0 else label, tuple(max(-negatives.MOST, min(negatives.MOST, math.floor(256 * x))) for x in v))
        if row not in kept:
            kept.append(row)
    dot = lambda a, b: sum(x * y for x, y in itertools.zip_longest(a, b, fillvalue=0))
    key = lambda r: (-r[1], r[0] is None, r[0] or 0)
    out = []
    for a in kept:
        if a[0] is None or a[0] % 100:
            continue
        scored = [(r[0], dot(a[2], r[2]), r[1] == a[1]) for r in kept if r is not a]
        for p in sorted((r for r in scored if r[2]), key=key)[:5]:
            fit = sorted((r for r in scored if not r[2] and 80 * p[1] <= 100 * r[1] <= 100 * p[1]), key=key)[:5]
            out += [(a[0], p[0], k + 1, n[0], p[1], n[1]) for k, n in enumerate(fit)]
    return sorted(out, key=repr)


def mined(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return sorted(map(tuple, negatives.mine(spark, spark.createDataFrame(rows, schema).repartition(3)).collect()), key=repr)


def test_negatives_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "BLOCK", 40)
    monkeypatch.setattr(negatives, "QUERIES", 3)
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 12))
    rows = [(i, (centers[i % 6] + rng.normal(size=12) * 0.4).astype(np.float32).tolist(), int(i % 4)) for i in range(0, 1500, 2)]
    rows += [(5001 + i, rows[0][1], int(i % 2)) for i in range(200)]  # copies of an anchor, in both labels
    assert mined(spark, rows) == plain_negatives(rows)


def test_negatives_of_odd_rows(spark):
    rows = [(0, [1.0, 0.5], 1), (100, [0.5, 0.5], 2), (100, [0.5, 0.25], 2), (1, [1.0, 0.5], 1), (2, [0.9, 0.5], 2), (2, [0.9, 0.5], 2), (3, None, 1), (4, [1.0, None], 1), (5, [float("nan"), 1.0], 2), (6, [float("inf"), 1.0], 2)]
    rows += [(7, [0.5, 0.5], 9), (8, [1.0, 0.5], None), (None, [0.9, 0.5], 3), (9, [1.0, 0.25, 0.125], 3), (10, [], 3), (200, [-1.0, -1.0], 1), (300, [1e30, -1e30], 5), (11, [1e30, 1.0], 5), (12, [0.0, 0.0], 4), (400, [0.0, 0.0], 4), (13, [0.9, 0.5], 2)]
    assert mined(spark, rows) == plain_negatives(rows)
    assert mined(spark, rows[:1]) == [] and mined(spark, []) == []
    clash = spark.createDataFrame([(*r, 1, 2) for r in rows], "vec_id long, embedding array<double>, label int, rank int, leaf int")
    assert sorted(map(tuple, negatives.mine(spark, clash).collect()), key=repr) == plain_negatives(rows)
