import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from girder.llm import pieces

from .test_decontam import brute as decontaminated
from .test_langid import plain_model, plain_prediction
from .test_near_copies import brute_near, first_of_components
from .test_secret_scan import brute as secret_spans


def redacted(text):
    out, at = "", 0
    for start, _, _, stop in secret_spans(text):
        if start >= at:
            out += text[at:start] + "[SECRET]"
        at = max(at, stop)
    return out + text[at:]


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_pipeline_against_a_plain_version(spark, sf):
    sf_dir = f"/root/testdata/{sf}"
    table = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()
    docs = {r.doc_id: r.text for r in table}
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    library = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model())
    model = plain_model([(r.text, r.lang) for r in table])
    found = {d: plain_prediction(t, model) for d, t in docs.items()}
    kept = [d for d, (lang, score) in found.items() if lang != "und" and (score >= 0.515625 or len(docs[d]) < 200)]
    roots = first_of_components(len(kept), brute_near([docs[d] for d in kept]))
    kept = [d for i, d in enumerate(kept) if roots[i] == i]
    hits = decontaminated([(d, docs[d]) for d in kept], items)
    want = {d: redacted(docs[d]) for d in kept if not hits[d][-1]}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    assert got.keys() == want.keys() and len(want) < len(docs)
    for d, r in got.items():
        assert r.lang == found[d][0]
        assert r.text == want[d] and r.n_chars == len(want[d])
        assert [int.from_bytes(r.piece_ids[i : i + 4], "little") for i in range(0, len(r.piece_ids), 4)] == library.encode(want[d], add_bos=True, add_eos=True)


EDGES = [(None, None), (0, ""), (1, " \n"), (2, "x"), (3, "x"), (3, "x"), (4, "the token = \"abcdef12\" here"), (5, "long words " * 20000), (6, "\U0001f600 漢字"), (7, "one two three four five six")]
KEPT = {
    "language_id": [2, 3, 3, 4, 5, 6, 7],
    "near_duplicates": [0, 2, 4, 5, 6, 7],
    "decontaminate": [None, 0, 1, 2, 3, 3, 4, 5, 6],
    "secrets": [None, 0, 1, 2, 3, 3, 4, 5, 6, 7],
    "encode": [None, 0, 1, 2, 3, 3, 4, 5, 6, 7],
}


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_each_stage_on_edges_and_clashing_names(spark, tmp_path, name, stage):
    rows = [(i, t, "en", None) for i, t in EDGES]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for c in ("n_chars", "row", "key", "blob", "path", "found", "lang_pred", "score", "fp", "n_words", "hit_items", "hit_from", "piece_ids", "decoded", "place", "root"):
        df = df.withColumn(c, F.lit(7))
    spark.createDataFrame([(0, "One two, three FOUR five six"), (1, None), (2, "")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = stage(spark, df, str(tmp_path))
    extra = [] if name != "encode" else ["_piece_ids", "_decoded"]
    assert out.columns == df.columns + extra
    got = out.collect()
    assert sorted((r.doc_id for r in got), key=lambda i: -1 if i is None else i) == KEPT[name]
    assert all(r.key == r.fp == r.hit_items == 7 for r in got)
    if name == "secrets":
        texts = {r.doc_id: r.text for r in got}
        assert texts == {**dict(EDGES), 4: 'the [SECRET]" here'} and {r.n_chars for r in got if r.doc_id == 5} == {220000}
    assert stage(spark, df.limit(0), str(tmp_path)).count() == 0


def test_stages_keep_columns_and_edges(spark, tmp_path):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "the token = \"abcdef12\" here", "en", "s", 1), (4, "x", None, None, None)] + [(10 + i, "same words in the same text", "en", "s", 9) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("key", F.lit("mine")).withColumn("blob", F.lit(1))
    spark.createDataFrame([(0, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for frame in (df, df.limit(0)):
        docs = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, str(tmp_path))
            assert docs.columns == df.columns
        docs = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
        if frame is df:
            assert sorted((r.doc_id, r.text) for r in docs.collect()) == [(3, 'the [SECRET]" here'), (4, "x"), (10, "same words in the same text")]
        else:
            assert docs.count() == 0
