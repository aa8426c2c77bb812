"""Boosted trees against a plain version that tries every split on all rows."""

import math
import random

import pytest
from pyspark.sql import functions as F

from weftline.models import boost


def plain_fit(rows, rounds, depth, rate, reg, least):
    scores = [0.0] * len(rows)
    features = sorted({f for _, bag in rows for f in bag})
    for _ in range(rounds):
        g = [1 / (1 + math.exp(-s)) - y for s, (y, _) in zip(scores, rows, strict=True)]
        h = [(a + y) * (1 - a - y) for a, (y, _) in zip(g, rows, strict=True)]
        part = lambda own, g=g, h=h: sum(g[i] for i in own) ** 2 / (sum(h[i] for i in own) + reg)
        leaves, todo = [], [(list(range(len(rows))), 0)]
        while todo:
            own, d = todo.pop()
            best = None
            for f in features if d < depth else []:
                for m in sorted({0, *(rows[i][1].get(f, 0) for i in own)}):
                    left, right = [i for i in own if rows[i][1].get(f, 0) <= m], [i for i in own if rows[i][1].get(f, 0) > m]
                    if not right or sum(h[i] for i in left) < least or sum(h[i] for i in right) < least:
                        continue
                    gain = round(part(left) + part(right) - part(own), 9)
                    if gain > 0 and (best is None or (-gain, f, m) < best[0]):
                        best = ((-gain, f, m), left, right)
            if best:
                todo += [(best[1], d + 1), (best[2], d + 1)]
            else:
                leaves.append(own)
        for own in leaves:
            w = -rate * sum(g[i] for i in own) / (sum(h[i] for i in own) + reg)
            for i in own:
                scores[i] += w
    return scores


def test_trees_are_those_of_the_plain_version(spark):
    rng = random.Random(11)
    rows = []
    for _ in range(60):
        bag = {f"w{k}": rng.randrange(1, 4) for k in rng.sample(range(8), rng.randrange(0, 6))}
        rows.append((int((bag.get("w1", 0) > 1) ^ (bag.get("w2", 0) > 0) or rng.random() < 0.1), bag))
    df = spark.createDataFrame([(i, y, b) for i, (y, b) in enumerate(rows)], "id long, label int, bag map<string,int>").repartition(3)
    trees = boost.fit(df, 4, 3, 0.5, 1.0, 0.2)
    got = {r.id: r.s for r in df.select("id", boost.score(trees).alias("s")).collect()}
    assert got == {i: pytest.approx(s) for i, s in enumerate(plain_fit(rows, 4, 3, 0.5, 1.0, 0.2))}
    assert sum((got[i] > 0) == (y == 1) for i, (y, _) in enumerate(rows)) > 50


def test_bags_and_held_out_accuracy(spark):
    rng = random.Random(2)
    docs = []
    for i in range(300):
        bad = i % 3 == 0
        docs.append((i, " ".join(rng.choice(["spam", "win", "a", "b", "c"] if bad else ["good", "read", "a", "b", "c"]) for _ in range(12)), int(not bad)))
    df = spark.createDataFrame([*docs, (999, "", 0)], "doc_id long, text string, label int")
    bags = boost.bags(df, F.split("text", " "), 6, 4)
    assert bags.count() == 301 and max(max(r.bag.values(), default=0) for r in bags.collect()) == 3
    rows = bags.join(df.select(F.col("doc_id").alias("doc"), "label"), "doc")
    trees = boost.fit(rows.where("doc % 5 <> 0"), 3, 2)
    held = rows.where("doc % 5 = 0").select("label", boost.score(trees).alias("s")).collect()
    assert sum((r.s > 0) == (r.label == 1) for r in held) > 0.9 * len(held)
