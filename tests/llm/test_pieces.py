import hashlib
import random

import numpy as np
import pytest
import sentencepiece

from girder.llm import pieces


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())


@pytest.fixture(scope="module")
def own():
    with open(pieces.default_model(), "rb") as f:
        return pieces.PieceTables(f.read())


CASES = ["", " ", "  a", "a  ", "\n", "▁a", " ▁", "\x00b", "é漢😀", "<s> x </s>", "<0x41>", "a" * 1000, " " * 1000, " " * 37 + "the", " " * 200 + "x" + " " * 77, "\r" * 9, "abab" * 50, "﻿x", "ﬁ "]


def same(own, library, texts):
    ids, per = own.encode(texts)
    stop = np.cumsum(per)
    decoded = own.decode(ids, per)
    for t, lo, hi, d in zip(texts, stop - per, stop, decoded):
        want = library.encode(t)
        assert ids[lo:hi].tolist() == want, t
        assert d.decode() == library.decode(want), t


def test_cases(own, library):
    same(own, library, CASES)
    for t in CASES:
        same(own, library, [t])


def test_random_texts(own, library):
    rnd = random.Random(1)
    bits = ["a", "b", "e", " ", "  ", "\n", "\t", "the", "in", "é", "漢", "😀", "1", "(", ")", ";", "\r", "▁", "ing", "er", "THE", "_", "////", "    ", "\x00"]
    same(own, library, ["".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 60))) for _ in range(4000)])


def test_decoding_of_wrong_bytes(own, library):
    for ids in ([3 + 0xE6, 3 + 0xBC], [3 + 0xFF, 264], [28705, 3 + 0xE6, 3 + 0xBC, 3 + 0xA2], [0, 264], [1, 264, 2, 264]):
        assert own.decode(np.array(ids), np.array([len(ids)]))[0].decode() == library.decode(ids)


def test_query(spark, sf_dir, library):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in pieces.op8_sentencepiece(spark, sf_dir).collect()}
    for doc_id, text in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        r = got[doc_id]
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


def test_null_rows_and_taken_names(spark):
    df = spark.createDataFrame([(1, None, 5), (1, None, 5), (2, "x", 6)], "doc_id long, text string, decoded int")
    out = pieces.encode_decode(df)
    assert out.columns == ["doc_id", "text", "decoded", "piece_ids", "_decoded"]
    got = sorted((r.doc_id, len(r.piece_ids) // 4, r._decoded) for r in out.collect())
    assert got == [(1, 2, ""), (1, 2, ""), (2, 3, "x")]
    assert pieces.encode_decode(df.limit(0)).count() == 0


def test_words_with_equal_hashes_stay_apart(monkeypatch):
    real = pieces.span_hashes
    # the first hash tells few words apart, within a slice and against what is remembered
    monkeypatch.setattr(pieces, "span_hashes", lambda values, starts, ends, *base: real(values, starts, ends, *base) % np.uint64(5) if not base else real(values, starts, ends, *base))
    with open(pieces.default_model(), "rb") as f:
        t = pieces.PieceTables(f.read())
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    for texts in (["one"], ["the quick brown fox jumps over the lazy dog", "été 漢字 x  y", "", "one two"], ["another"]):
        ids, per = t.encode(texts)
        assert ids.tolist() == [i for x in texts for i in library.encode(x)] and per.sum() == len(ids)
