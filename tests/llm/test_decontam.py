import hashlib
import random
import re

import duckdb

from girder.llm import decontam

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def low(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def brute(docs, items):
    wins = {}
    for i, t in items:
        w = WORD.findall(low(t))
        m = min(10, len(w))
        for k in range(len(w) - m + 1) if w else ():
            wins.setdefault(tuple(w[k : k + m]), set()).add(str(i))
    out = {}
    for d, t in docs:
        w = WORD.findall(low(t))
        hit, ids = set(), set()
        for m in {len(x) for x in wins}:
            for k in range(len(w) - m + 1):
                if own := wins.get(tuple(w[k : k + m])):
                    hit.update(range(k, k + m))
                    ids |= own
        out[d] = (len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
    return out


def query(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


def test_against_brute_force(spark, tmp_path):
    rnd = random.Random(7)
    vocab = ["alpha", "Beta", "gamma", "d1", "été", "漢字", "x"]
    passage = [rnd.choice(vocab) for _ in range(60)]
    items = [(i, " ".join(passage[i * 3 : i * 3 + n])) for i, n in enumerate([12, 10, 25, 9, 1, 3, 30])] + [(7, None), (8, "!!"), (9, "zeta"), (9, "eta theta")]
    docs = [(0, None), (1, ""), (2, "..."), (3, " ".join(passage)), (3, " ".join(passage))]
    docs += [(i, rnd.choice([" ", ", ", "\n"]).join(rnd.choice(vocab) for _ in range(rnd.randrange(1, 300)))) for i in range(10, 40)]
    docs += [(i, "zeta " * 5 + " ".join(passage[rnd.randrange(30) :]).upper() + " eta theta") for i in range(50, 60)]
    docs += [(99, " ".join(rnd.choice(vocab) for _ in range(30000)))]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    for n, df in (("documents", d), ("benchmark", b)):
        df.write.parquet(str(tmp_path / f"{n}.parquet"))
    want = brute(docs, items)
    assert query(decontam.op7_decontamination(spark, str(tmp_path))) == want
    # several blocks of patterns give the same
    from pyspark.sql import functions as F

    many = decontam.scan(d, b, block_bytes=150)
    for r in many.select("doc_id", "n_words", F.size("hit_items").alias("n")).collect():
        assert (r.n_words, r.n) == (want[r.doc_id][0], want[r.doc_id][2])


def test_blocks_are_bounded_and_hold_all_windows(spark):
    from pyspark.sql import functions as F

    rnd = random.Random(1)
    texts = {i: " ".join(f"W{rnd.randrange(300)}" for _ in range(n)) for i, n in enumerate([5000, 9, 10, 11, 300, 0, 70])}
    items = spark.createDataFrame([(str(i), t) for i, t in texts.items()] + [("0", texts[0]), ("x", None)], "id string, text string")
    parts = decontam.parts_of(items, 10, 4096)
    block_of, blocks = decontam.blocks_of(parts, 4096)
    held = parts.groupBy(block_of).agg(F.sum(F.octet_length("text") + 16).alias("n")).collect()
    assert blocks > 4 and max(r.n for r in held if r.n) <= 4096
    wins = lambda w: {tuple(w[i : i + 10]) for i in range(max(1, len(w) - 9))} if w else set()
    got = {}
    for r in parts.collect():
        got.setdefault(r.id, set()).update(wins(low(r.text).split()))
    assert all(got[str(i)] == wins(low(t).split()) for i, t in texts.items()) and got["x"] == set()


def test_against_sql(spark, sf_dir):
    got = decontam.op7_decontamination(spark, sf_dir).toPandas().sort_values("doc_id").reset_index(drop=True)
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    want = con.sql(decontam.OP7_SQL).df().sort_values("doc_id").reset_index(drop=True)
    assert got.astype(str).equals(want[got.columns].astype(str))
    assert got.contaminated.any()


def test_empty_tables_and_taken_names(spark):
    d = spark.createDataFrame([], "doc_id long, text string, n_words string")
    b = spark.createDataFrame([], "item_id long, text string")
    out = decontam.scan(d, b)
    assert out.count() == 0 and "_n_words" in out.columns
    one = decontam.scan(spark.createDataFrame([(1, "a b", "mine")], d.schema), b).first()
    assert (one.n_words, one._n_words, list(one.hit_items)) == ("mine", 2, [])


def test_one_very_long_text(spark, tmp_path):
    rnd = random.Random(4)
    long = [f"w{rnd.randrange(300)}" for _ in range(120_000)]
    items = [(f"i{k}", " ".join(long[k * 9000 : k * 9000 + 30])) for k in range(6)] + [("other", " ".join(f"x{k}" for k in range(20))), ("one", "w7")]
    docs = [(1, " ".join(long)), (2, "x1 x2")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert query(decontam.op7_decontamination(spark, str(tmp_path))) == brute(docs, items)
