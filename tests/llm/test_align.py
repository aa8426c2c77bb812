"""Alignment of two tokenizers against tokenising and linking whole texts."""

import collections
import hashlib
import random

import numpy as np
import pytest
from conftest import DATA

from weftline.llm import align, chunks

A, B = f"{align.TOKENIZERS}/{align.A_FILE}", f"{align.TOKENIZERS}/{align.B_FILE}"


@pytest.fixture(scope="module")
def own():
    return align.Tokenizers(A, B)


def whole(own, text):
    """Tokens of the whole text, links and groups by walking over both."""
    data = f" {text}".encode()
    a, b = own.a.encode(f" {text}", add_special_tokens=False).ids, own.b.encode(text)
    if not text or b"".join(own.b_bytes[i] for i in b) != data or b"".join(own.a_bytes[i] for i in a) != data:
        return [], [], [], []
    i = j = ai = bj = 0
    links, groups, at = [], [], (0, 0)
    ai, bj = len(own.a_bytes[a[0]]), len(own.b_bytes[b[0]])
    while True:
        links.append((a[i], b[j]))
        step_a, step_b = ai <= bj, bj <= ai
        if ai == bj:
            groups.append((a[at[0] : i + 1], b[at[1] : j + 1]))
            at = (i + 1, j + 1)
            if i + 1 == len(a):
                return a, b, links, groups
        if step_a:
            i += 1
            ai += len(own.a_bytes[a[i]])
        if step_b:
            j += 1
            bj += len(own.b_bytes[b[j]])


def plain(own, texts):
    """The query's columns for a list of texts."""
    got = [whole(own, t or "") for t in texts]
    count = collections.Counter(x for _, _, links, _ in got for x in links)
    most = collections.defaultdict(int)
    for (_, b), n in count.items():
        most[b] = max(most[b], n)
    out = []
    for a, b, links, groups in got:
        text = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        out.append((len(a), len(b), len(groups), len(links), sum(count[x] == most[x[1]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if a else ""))
    return out, count


ODD = [None, "", " ", "  two  spaces ", "\n", "a  b", "x  y　 z\u0085 w", "▁ mark", "a <|endoftext|> b <s> <0x41>", "tab\t x\r\n  y", "é è à la", "日本 語 🙂 👍🏽 x", "nul \x00 in", "don't we'll  'S", "x" * 30_000, "w " * 20_000, "same text", "same text"]


def test_alignment_against_whole_texts(spark, own):
    rng = random.Random(5)
    letters = ["a", "B", "é", " ", " ", "\n", " ", "1", ".", "'s", "語", "\t", " ", "🙂", "\x7f", "\x1c"]
    texts = ODD + ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(300)]
    rows = [(i if i != 3 else None, t, 1) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_a int").repartition(5)
    want, count = plain(own, texts)
    got = {r.doc_id: tuple(r)[1:] for r in align.digest(spark, df).collect()}
    assert got == {i: w for (i, _, _), w in zip(rows, want, strict=True)}
    assert {(r.a, r.b): r.n for r in align.pair_counts(spark, df).collect()} == count
    groups = {r.doc_id: [(list(g.a), list(g.b)) for g in r.groups] for r in align.groups(spark, df).collect()}
    assert groups == {i: [(list(x), list(y)) for x, y in whole(own, t or "")[3]] for i, t, _ in rows}
    assert align.digest(spark, df.limit(0)).count() == 0


def test_query_against_whole_texts(spark, own):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want, _ = plain(own, [r.text for r in rows])
    assert {r.doc_id: tuple(r)[1:] for r in align.digest(spark, docs).collect()} == {r.doc_id: w for r, w in zip(rows, want, strict=True)}


def test_many_chunks_and_buckets_give_the_same(spark, monkeypatch):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    want = sorted(align.digest(spark, docs).collect())
    monkeypatch.setattr(chunks, "BUCKET", 50_000)
    assert chunks.buckets_for(docs) > 5
    assert sorted(align.digest(spark, docs.repartition(13)).collect()) == want


def test_vocabularies_are_verified(own, tmp_path):
    assert own.verified(A, B)
    made = own.b_bytes[500]
    own.b_bytes[500] = b"a b"  # such a piece could merge across a space
    assert not own.verified(A, B)
    own.b_bytes[500] = made
    cut = lambda t: align.segment_starts(np.frombuffer(t.encode(), np.uint8)).tolist()
    assert cut(" a  b c") == [2, 5] and cut("a  b　 c\n d") == [] and cut("é x") == [2]


def test_packing():
    for arrays in ([np.arange(5)], [np.array([-1, 1 << 40]), b"xyz", np.zeros(0, np.int64)], [b""]):
        back = chunks.unpack(chunks.pack(*arrays))
        assert len(back) == len(arrays) and all(list(a) == list(b) for a, b in zip(arrays, back, strict=True))
