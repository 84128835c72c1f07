import math
import random

import pytest
import sentencepiece

from girder.llm import token_count as C
from girder.llm.pieces import default_model


def unigram(score=None):
    """The public vocabulary as a unigram model, with other scores if asked for."""
    pb = pytest.importorskip("sentencepiece.sentencepiece_model_pb2")
    m = pb.ModelProto()
    with open(default_model(), "rb") as f:
        m.ParseFromString(f.read())
    m.trainer_spec.model_type = 1
    for i, p in enumerate(m.pieces):
        if p.type == 1 and score:
            p.score = score(i, p.piece)
    return m.SerializeToString()


BITS = ["a", "b", "e", " ", "  ", "\n", "\t", "ab", "the", "in", "é", "漢", "😀", "1", "(", ";", "\r", "▁", "ing", "er", "THE", "_", "////", "\x00"]
SCORES = {
    "log rank": lambda i, p: -math.log(i + 1),
    "all tie": lambda i, p: -float(len(p)),
    "many ties": lambda i, p: -float(i % 7) - 1,
    "large": lambda i, p: -float(len(p)) * 1e7,
}


@pytest.mark.parametrize("name", SCORES)
def test_counts_are_the_library_s(name):
    proto = unigram(SCORES[name])
    library, own = sentencepiece.SentencePieceProcessor(model_proto=proto), C.Counter(proto, own_scores=True)
    rnd = random.Random(0)
    texts = ["".join(rnd.choice(BITS) for _ in range(rnd.randrange(1, 80))) for _ in range(3000)] + ["", " " * 300, "a" * 5000, "x " * 20000]
    for t in texts:
        assert own.count(t) == len(library.encode(t)), t
    own.most_pieces = 0
    for t in texts[:300]:
        assert own.count(t) == len(library.encode(t)), t


def test_query(spark, sf_dir):
    library = sentencepiece.SentencePieceProcessor(model_proto=unigram(SCORES["log rank"]))
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r.n_tokens for r in C.op9_token_counts(spark, sf_dir).collect()}
    assert got == {d: len(library.encode(t or "")) for d, t in docs.items()}


def test_edges(spark):
    df = spark.createDataFrame([(1, None, "k"), (2, "", "k"), (3, "漢", "k"), (3, "漢", "k")], "doc_id long, text string, n_tokens string")
    out = C.token_counts(df)
    assert out.columns == [*df.columns, "_n_tokens"]
    assert sorted((r.doc_id, r._n_tokens) for r in out.collect()) == [(1, 0), (2, 0), (3, 4), (3, 4)]
    assert C.token_counts(df.limit(0)).count() == 0
