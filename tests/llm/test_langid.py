import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np

from pyspark.sql import functions as F

from girder.llm import langid as L


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = L.op1_language_id(spark, sf)
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"]
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    own = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(own) / len(own) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_edges(spark):
    train = [(i, t, x) for i in range(0, 40, 2) for t, x in (("the cat and the hat", "en"), ("der Hund und die Katze", "de"))]
    df = spark.createDataFrame(train + [(100, "ignored", None), (None, "the", "en"), (101, None, "fr")], "doc_id long, text string, lang string")
    proto = L.fit(df)
    assert list(proto) == ["de", "en"]
    ask = spark.createDataFrame([(1, None, "a"), (2, "", "a"), (3, "12 !!", "a"), (4, "the hat " * 40000, "a"), (4, "und der Hund", "a"), (4, "und der Hund", "a"), (5, "漢", "a")], "doc_id long, text string, score string")
    out = L.predict(ask, proto)
    assert out.columns == ["doc_id", "text", "score", "lang_pred", "_score"]
    got = [(r.doc_id, r.lang_pred) for r in out.orderBy("doc_id", F.length("text").desc()).collect()]
    assert got[:6] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "de"), (4, "de")]
    assert L.predict(ask, L.fit(df.limit(0))).filter("lang_pred <> 'und' OR _score <> 0").count() == 0


def test_vectors_add_up():
    a, b = L.document_vectors(["the cat", "the cat the cat"])
    assert a.any() and (b != a).any()
    both = L.document_vectors(["Straße 漢字 x", "Straße 漢字 x"])
    assert (both[0] == both[1]).all() and both[0].any()


@lru_cache(maxsize=None)
def plain_vector(text):
    """The sum of all trigrams of letters, by the definition."""
    symbols, out = [0], np.zeros(L.DIMENSIONS)
    for c in (text or "").lower():
        if c.isalpha() or symbols[-1]:
            symbols.append(ord(c) if c.isalpha() else 0)
    if symbols[-1]:
        symbols.append(0)
    for gram, n in Counter(zip(symbols, symbols[1:], symbols[2:])).items():
        out += float(n) * gram_vector(*gram)
    return out


@lru_cache(maxsize=None)
def gram_vector(a, b, c):
    one = L.letter_vectors(np.array([a, b, c])).astype(np.int8)
    return np.roll(one[0], 2) * np.roll(one[1], 1) * one[2]


def plain_model(rows):
    """(unit prototypes less their mean, mean) of (text, lang) rows, by language."""
    sums = {}
    for text, lang in rows:
        if lang is not None:
            sums[lang] = sums.get(lang, 0) + plain_vector(text)
    unit = {k: v / np.linalg.norm(v) for k, v in sorted(sums.items()) if v.any()}
    mean = sum(unit.values()) / len(unit) if len(unit) > 1 else 0
    return {k: (v - mean) / np.linalg.norm(v - mean) for k, v in unit.items()}, mean


def plain_prediction(text, model):
    axes, mean = model
    v = plain_vector(text)
    if not v.any() or not axes:
        return "und", 0.0
    v = v / np.linalg.norm(v) - mean
    v /= np.linalg.norm(v)
    best = max(axes, key=lambda k: (v @ axes[k], [-ord(c) for c in k]))
    return best, min(1.0, max(0.0, (1 + v @ axes[best]) / 2))


def test_predictions_against_a_plain_version(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang").collect()
    model = plain_model([(r.text, r.lang) for r in docs if zlib.crc32(str(r.doc_id).encode()) % 4 != 2])
    got = {r.doc_id: r for r in L.op1_language_id(spark, sf).collect()}
    assert len(got) == len(docs)
    for r in docs:
        lang, score = plain_prediction(r.text, model)
        assert got[r.doc_id].lang_pred == lang and abs(got[r.doc_id].score - score) < 1e-6


def test_stage_rejects_what_is_in_no_learned_language(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rnd = np.random.default_rng(4)
    # noise of many alphabets, long and short, and labelled texts that are written in another language
    noise = ["".join(chr(int(c)) for c in rnd.integers(lo, lo + 40, 400)) for lo in range(0x0400, 0xA000, 0x320)]
    unlabelled = [(1000 + i, t, None) for i, t in enumerate(noise + [n[:50] for n in noise] + [None, "", "12 34"])]
    docs += unlabelled + [(5000, docs[0][1], "xx" if docs[0][2] == "en" else "en")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("own")).withColumn("lang_pred", F.lit(1))
    kept = L.keep_known(df, L.fit(df))
    assert kept.columns == df.columns and kept.schema["score"].dataType.simpleString() == "string"
    model, want = plain_model([(t, x) for _, t, x in docs]), {}
    for i, t, _ in docs:
        lang, score = plain_prediction(t, model)
        if lang != "und" and (score >= 0.515625 or len(t) < 200):
            want[i] = lang
    assert {r.doc_id: r.lang for r in kept.collect()} == want
    lettered = {i for i, t, _ in docs if re.search(r"[^\W\d_]", t or "")}
    assert want.keys() < lettered and {i for i, _, x in docs if x and i < 1000} <= want.keys()
    assert any(want[i] != x for i, _, x in docs if i in want and x)
    assert {r.lang for r in L.keep_known(df, L.fit(df), languages=["fr"]).collect()} == {"fr"}
    assert L.keep_known(df, {}).count() == len(docs) and L.keep_known(df.limit(0), L.fit(df)).count() == 0
