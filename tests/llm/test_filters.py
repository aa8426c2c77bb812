"""URL filters, language ID and mixing."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from weftline.llm import langid, mixing, url_filter
from weftline.llm.queries import op1_url_filter, op10_langid
from conftest import DATA


def test_url_parts_and_rules(spark):
    urls = [None, "abc", "http://EXAMPLE.org", "x://a.Org/es/?q", "http://example.org/es/1", "a://b://c/d#e", "http://É.example.org/en/12?x/y", "", "http://xexample.org/es/", "HTTP://a.com/fr/#x", "https://org/", "http://a.com/de/" + "x" * 20_000, "http://a.com/de/1\nb"]
    df = spark.createDataFrame([(i, u, "clash", "clash") for i, u in enumerate(urls)], "page_id long, url string, host string, verdict string")
    got = {r.page_id: r for r in url_filter.judge(spark, df).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", u or "")
        host = m[1].translate({c: c + 32 for c in range(65, 91)}) if m else ""
        path = m[2] if m else ""
        fits = [(h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        rule, verdict = max(fits, key=lambda x: len(x[0]), default=(None, "block" if got[i].score >= 0.5 else "allow"))
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict)
    assert got[0].score == got[1].score == got[7].score


def test_url_model_and_empty_tables(spark):
    assert url_filter.judge(spark, spark.createDataFrame([], "page_id long, url string")).count() == 0
    table = url_filter.labelled(spark)
    own = {r.url: r.bad for r in table.collect()}
    got = url_filter.judge(spark, table.selectExpr("url AS page_id", "url"), rules=()).collect()
    assert np.mean([(r.score >= 0.5) == own[r.page_id] for r in got]) > 0.95
    weights = url_filter.fit(spark.createDataFrame([], "url string, bad int"))
    assert set(weights[:-1]) == {0.0}
    with pytest.raises(ValueError, match="labelled table"):
        url_filter.fit(table, most=3)
    with pytest.raises(ValueError, match="twice"):
        url_filter.judge(spark, table.selectExpr("1 AS page_id", "url"), rules=(("a", "/", "allow"), ("a", "/", "block")))


def test_rules_of_one_length_do_not_depend_on_their_order(spark):
    df = spark.createDataFrame([(1, "http://a.b.c/xx/y")], "page_id long, url string")
    rules = (("b.c", "/xx/", "allow"), ("a.b.c", "/x", "block"))
    for order in (rules, rules[::-1]):
        got = url_filter.judge(spark, df, rules=order).first()
        assert (got.rule, got.verdict) == ("a.b.c/x", "block")


def test_url_query_blocks_junk_hosts(spark):
    got = op1_url_filter(spark, DATA)
    assert got.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Arrow|Pandas", plan)


def test_language_accuracy_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(spark, docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    assert np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_language_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "de"), (3, "12 ... !!", None), (4, "the and of the", None), (None, "und der die", "de"), (5, "é" * 300_000 + " the", None), (5, "é" * 300_000 + " the", None)]
    rows += [(100 + i, "the cat and the dog are in the house of the man " * 3, "en") for i in range(40)] + [(200 + i, "und der hund ist nicht in das haus gegangen weil " * 3, "de") for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 0.5) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    got = langid.identify(spark, df).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    assert [by[i].lang_pred for i in (1, 2, 3)] == ["und"] * 3 and all(by[i].rejected and by[i].score == 0 for i in (1, 2, 3))
    assert by[4].lang_pred == "en" and by[None].lang_pred == "de" and by[None].held_out is False
    kept = langid.keep_known(spark, df)
    assert kept.columns == df.columns and not {1, 2, 3} & {r.doc_id for r in kept.collect()}
    assert {100 + i for i in range(40)} <= {r.doc_id for r in kept.collect()}
    assert langid.identify(spark, df.limit(0)).count() == 0
    unlabelled = langid.identify(spark, spark.createDataFrame([(1, "hello", None)], "doc_id long, text string, lang string")).first()
    assert unlabelled.lang_pred == "und" and unlabelled.rejected


def test_language_fit_is_bounded_and_repeatable(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    a, b = langid.fit(spark, docs.repartition(7)), langid.fit(spark, docs.repartition(2))
    assert a["langs"] == b["langs"] and np.array_equal(a["centroids"], b["centroids"])
    assert len(op10_langid(spark, DATA).collect()) == docs.count()


def test_language_sample_counts_repeated_rows_once(spark):
    rows = [(7, "the same row again", "en")] * 3000 + [(i, f"und das ist text nummer {i} in diesem haus", "de") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(spark, df, fit_rows=40_000)
    assert set(model["langs"]) <= {"de", "en"} and len(model["centroids"]) <= 5


def test_language_rejects_noise_and_keeps_clean_text(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(spark, docs)
    foreign = ["Это предложение написано по-русски и длинное", "这是一个中文句子没有别的语言", "これは日本語の文章です", "αυτό είναι ελληνικό κείμενο"]
    assert all(langid.predict(foreign, model)[2])
    rng = random.Random(3)
    noise = [" ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9))) for _ in range(n)) for n in (120, 1000) for _ in range(5)]
    finnish = "Suomen kieli kuuluu uralilaiseen kielikuntaan ja sitä puhutaan pääosin Suomessa. Kirjasto on avoinna joka päivä kello kahdeksasta alkaen, ja lapset saavat lainata kirjoja ilmaiseksi."
    code = "def f(x):\n  for i in range(10):\n    if x[i] is None: return foo(bar, baz)\n  raise ValueError('bad')\n" * 3
    assert all(langid.predict([*noise, finnish, code], model)[2])
    clean = [r.text for r in docs.where("lang IS NOT NULL AND text IS NOT NULL").collect()]
    assert sum(langid.predict(clean, model)[2]) == 0


def test_language_floors_against_a_plain_version(spark, monkeypatch):
    quantile = 0.2
    monkeypatch.setattr(langid, "QUANTILE", quantile)
    docs = spark.read.parquet(f"{DATA}/documents.parquet").where("lang IN ('en', 'de')")
    model = langid.fit(spark, docs, reject=1.0)
    rows = docs.where("text IS NOT NULL").where(~langid.held_out(F.col("doc_id"))).collect()
    langs, scores, _, sizes = langid.measured([r.text for r in rows], model)
    cells = {}
    for r, lang, score, size in zip(rows, langs, scores, sizes, strict=True):
        if lang == r.lang and langid.has_letter(r.text):
            cells.setdefault((lang, size), []).append(int(score * langid.BINS) / langid.BINS)
    low = {k: sorted(v)[int(len(v) * quantile)] for k, v in cells.items() if len(v) * quantile >= 1}
    assert len(low) >= 2
    for i, lang in enumerate(model["langs"]):
        floor = 0.0
        for size in range(langid.SIZES):
            floor = max(floor, min(min(v) for (k, _), v in cells.items() if k == lang or size < langid.SHORT))
            if (lang, size) in low:
                floor = max(floor, min(low[lang, z] for z in range(size, langid.SIZES) if (lang, z) in low))
            assert model["floors"][i, size] == pytest.approx(floor)


def plain_scores(texts, model):
    """Cosines with all centroids, written out with dictionaries."""
    out = []
    for t in texts:
        kept, grams = [32], {}
        for b in (" " + t.lower() + " ").encode():
            b = b if 97 <= b <= 122 or b >= 128 else 32
            if b != 32 or kept[-1] != 32:
                kept.append(b)
        kept = kept if (" " + t.lower() + " ").encode() else [32]
        for n, salt in ((2, 0x9E3779B1), (3, 0x85EBCA6B)):
            for i in range(len(kept) - n + 1):
                code = int.from_bytes(bytes(kept[i : i + n]), "big")
                k = (code * salt & 0xFFFFFFFF) >> 20
                grams[k] = grams.get(k, 0) + 1
        v = {k: c**0.5 * float(model["idf"][k]) for k, c in grams.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        out.append([sum(x * float(c[k]) for k, x in v.items()) / size for c in model["centroids"]])
    return out


def test_language_scores_against_a_plain_version(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = langid.fit(spark, docs)
    texts = [r.text for r in docs.limit(40).collect()] + ["Ein Text, 12 mal!", "é à"]
    langs, scores, _ = langid.predict(texts, model)
    for lang, score, cos in zip(langs, scores, plain_scores(texts, model), strict=True):
        assert score == pytest.approx(max(cos), abs=1e-4)
        assert lang == model["langs"][model["owner"][int(np.argmax(cos))]]


def test_counts_are_those_of_each_text_alone():
    texts = ["The cat", None, "", "été " * 50, "a" * 3_000_000]
    whole = langid.counts(texts)
    for row, t in zip(whole, texts, strict=True):
        assert np.array_equal(row, langid.counts([t])[0])


def test_mix_targets_by_water_filling(spark):
    def targets(sizes, weights, cap):
        sized = spark.createDataFrame([(f"k{i:03}", s, i) for i, s in enumerate(sizes)], "__key string, size long, h long")
        return [r.target for r in mixing.goals(spark, sized, weights, cap).orderBy("__key").collect()]

    assert targets([10, 10, 10], [1.0, 2.0, 3.0], 3) == [5.0, 10.0, 15.0]
    assert targets([1, 100, 1], [3.0, 1.0, 1.0], 3) == [3.0, 96.0, 3.0]
    assert targets([0, 0], [1.0, 2.0], 3) == [0.0, 0.0] and targets([], [1.0], 3) == []


def test_mix_of_more_sources_than_are_broadcast(spark, monkeypatch):
    rows = [(i, "w " * (i % 11 + 1), f"s{i % 40:02}") for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want = sorted(map(repr, mixing.mix(spark, df).collect()))
    monkeypatch.setattr(mixing.common, "BROADCAST_ROWS", 3)
    assert sorted(map(repr, mixing.mix(spark, df).collect())) == want
    assert mixing.remix(spark, df).count() == sum(r.copies for r in mixing.mix(spark, df).collect())


def test_mix_edge_cases(spark):
    rows = [(i, "w " * (i % 7 + 1), None if i % 3 == 0 else f"s{i % 3}") for i in range(300)] + [(900, None, "s1"), (901, "", "s9"), (902, "x " * 50_000, "s2"), (1, "w w ", "s1"), (None, "q", "s1")]
    df = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, source string, size long")
    got = mixing.mix(spark, df).collect()
    assert len(got) == len(rows)
    assert {(r["size"], r.taken) for r in got if r.doc_id in (900, 901)} == {(0, 0)}
    assert all(r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0 for r in got)
    assert sorted(map(repr, got)) == sorted(map(repr, mixing.mix(spark, df.repartition(5)).collect()))
    mixed = mixing.remix(spark, df)
    assert mixed.columns == df.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.mix(spark, df.limit(0)).count() == 0
