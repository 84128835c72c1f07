import hashlib
import random
import re

import duckdb
import numpy as np
import pytest

from girder.llm import substring as S


def brute(rows, window=20):
    docs = sorted((d, re.findall("[^ \t-\r]+", t or "")) for d, t in rows)
    first, out = {}, {}
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if first.setdefault(tuple(w[i : i + window]), (d, i)) < (d, i):
                gone.update(range(i, i + window))
        out[d] = (len(w), len(gone), hashlib.sha256(" ".join(x for k, x in enumerate(w) if k not in gone).encode()).hexdigest())
    return out


def got(df):
    return {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in df.collect()}


def save(spark, rows, path, n=5):
    spark.createDataFrame(rows, "doc_id long, text string").repartition(n).write.parquet(str(path / "documents.parquet"))


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(11)
    vocab = ["the", "of", "été", "A", "a", "x,", "漢", "1"] + [f"w{i}" for i in range(60)]
    word = lambda: rnd.choice(vocab)
    passages = [[word() for _ in range(rnd.randrange(18, 90))] for _ in range(6)]
    texts = [None, "", " \n", "short text", "a " * 300, "a b " * 100]
    for _ in range(150):
        body = []
        for _ in range(rnd.randrange(1, 6)):
            body += [word() for _ in range(rnd.randrange(0, 40))]
            p = rnd.choice(passages)
            lo = rnd.randrange(len(p) // 2)
            body += p[lo : lo + rnd.randrange(10, 90)]
        if rnd.random() < 0.3:
            body[rnd.randrange(len(body))] = "changed"
        texts.append(rnd.choice([" ", "\n", " \t"]).join(body))
    texts += [texts[20]] * 10 + [" ".join(word() for _ in range(20000))]
    rnd.shuffle(texts)
    rows = list(enumerate(texts))
    save(spark, rows, tmp_path)
    assert got(S.op6_substring_dedup(spark, str(tmp_path))) == brute(rows)


def test_small_portions_give_the_same(spark, tmp_path, monkeypatch):
    rnd = random.Random(1)
    base = [f"w{rnd.randrange(40)}" for _ in range(400)]
    rows = [(i, " ".join(base[rnd.randrange(200) : rnd.randrange(200, 400)])) for i in range(80)]
    save(spark, rows, tmp_path, 3)
    assert got(S.op6_substring_dedup(spark, str(tmp_path))) == brute(rows)


def test_query_against_sql(spark, sf_dir):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = {r[0]: r[1:] for r in con.sql(S.OP6_SQL).fetchall()}
    assert got(S.op6_substring_dedup(spark, sf_dir)) == want


def test_anchors():
    rnd = np.random.default_rng(0)
    h = rnd.integers(0, 5, 200).astype(np.uint64)
    for span in (1, 2, 3, 15, 16):
        assert S.leftmost_minimum(h, span).tolist() == [i + int(np.argmin(h[i : i + span])) for i in range(len(h) - span + 1)]


def test_equal_and_null_ids_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, "x"), (1, text, "x"), (None, text, "y"), (2, text, "z")], "doc_id long, text string, kept string")
    rows = sorted((r.doc_id if r.doc_id is not None else -1, r.n_removed) for r in S.deduplicated(df).collect())
    assert rows == [(-1, 0), (1, 30), (1, 30), (2, 30)]
    assert S.deduplicated(df.limit(0)).count() == 0
    # rows that share an id but not the text keep their own places
    other = " ".join(f"v{i}" for i in range(200))
    df = spark.createDataFrame([(0, text), (1, other), (1, text + " " + other), (1, "short"), (3, " ".join(other.split()[:100]) + " x")], "doc_id long, text string").repartition(3)
    rows = sorted((r.doc_id, r.n_words, r.n_removed) for r in S.deduplicated(df).collect())
    assert rows == [(0, 30, 0), (1, 1, 0), (1, 200, 0), (1, 230, 30), (3, 101, 100)]


def test_other_file_splits_in_a_later_job_lose_no_repeat(spark, tmp_path):
    rnd = random.Random(9)
    passage = " ".join(f"p{i}" for i in range(60))
    for i in range(6):
        text = " ".join([*[f"a{rnd.random()}" for _ in range(30)], passage, *[f"b{rnd.random()}" for _ in range(30)]])
        spark.createDataFrame([(i, text)], "doc_id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    name = "spark.sql.files.minPartitionNum"
    try:
        spark.conf.set(name, "1")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        found = S.deduplicated(spark.read.parquet(str(tmp_path / "documents.parquet")))
        spark.conf.set(name, "6")
        assert {r.doc_id: r.n_removed for r in found.collect()} == {i: 60 if i else 0 for i in range(6)}
    finally:
        spark.conf.unset(name)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_anchors_with_many_contexts(spark, tmp_path):
    rnd = random.Random(5)
    phrases = [[f"p{k}x{i}" for i in range(6)] for k in range(12)]
    shared = [[f"s{k}x{i}" for i in range(25)] for k in range(4)]
    rows = []
    for i in range(300):
        body = []
        for _ in range(5):
            body += [f"r{rnd.random()}" for _ in range(rnd.randrange(5, 14))] + rnd.choice(phrases)
        # windows around the common phrases that stand in two or three documents only
        if i % 3 == 0:
            body += rnd.choice(shared) + phrases[i % 12] + rnd.choice(shared)
        rows.append((i, " ".join(body)))
    frequent = sum(S.HOT < n for n in np.unique(S.Slice(*flat(" ".join(t for _, t in rows)), 20, 6).runs()[3], return_counts=True)[1])
    assert frequent > 3
    for n in (1, 7):
        save(spark, rows, tmp_path / str(n), n)
        assert got(S.op6_substring_dedup(spark, str(tmp_path / str(n)))) == brute(rows)


def flat(text):
    data = np.frombuffer(text.encode(), np.uint8)
    return data, np.array([0, len(data)])


def test_words_with_one_first_hash_stay_apart(monkeypatch):
    rnd = random.Random(8)
    words = [rnd.choice("abcdefgh") * 3 for _ in range(4000)]
    words[1000:1030] = words[200:230]
    want = brute([(0, " ".join(words))])[0][1]
    # all words of one length have one first hash
    monkeypatch.setattr(S, "BYTE_VALUES", np.full(256, 7, np.uint64))
    s = S.Slice(*flat(" ".join(words)), 20, 6)
    assert len(set(s.hashes.tolist())) == 1 and len(set(s.others.tolist())) == 8
    assert S.covered(s.repeats_within(), s.repeats_within() + 20, len(words)).sum() == want >= 30
    assert len(set(zip(*(x.tolist() for x in s.windows())))) == len({tuple(words[i : i + 20]) for i in range(3981)})
    *_, context, second = s.runs()
    assert len(set(context.tolist())) < len(set(second.tolist()))


def test_one_very_long_text(spark, tmp_path):
    rnd = random.Random(9)
    long = [f"w{rnd.randrange(4000)}" for _ in range(150_000)]
    long[90_000:90_400] = long[1000:1400]
    rows = [(1, " ".join(long)), (2, " ".join(long[40_000:40_300])), (3, "short")]
    save(spark, rows, tmp_path, 2)
    assert got(S.op6_substring_dedup(spark, str(tmp_path))) == brute(rows)


def test_ids_that_are_no_numbers_raise(spark):
    with pytest.raises(TypeError, match="doc_id"):
        S.deduplicated(spark.createDataFrame([("a", "x y")], "doc_id string, text string"))
