import hashlib
import random

import numpy as np

from girder.llm import fingerprint as P


def plain_labels(x):
    for _ in range(P.ROUNDS):
        out = []
        for i, v in enumerate(x):
            d = v ^ (x[i - 1] if i else v ^ 1)
            bit = (d & -d).bit_length() - 1
            out.append(2 * bit + (v >> bit & 1))
        x = out
    return x


def test_labels_and_phrases_are_as_defined():
    rnd = random.Random(0)
    seqs = [[rnd.randrange(1, 9) for _ in range(rnd.randrange(1, 60))] for _ in range(200)]
    values = np.array([v for s in seqs for v in s], np.uint64)
    bound = np.concatenate([[0], np.cumsum([len(s) for s in seqs])])
    names, edges = P.level(values, bound)
    for d, s in enumerate(seqs):
        runs = [v for i, v in enumerate(s) if not i or s[i - 1] != v]
        lab = plain_labels(runs)
        assert max(lab) < 8 and all(a != b for a, b in zip(lab, lab[1:]))
        n = 1 + sum(lab[i] > lab[i - 1] and lab[i] > lab[i + 1] for i in range(1, len(lab) - 1))
        assert edges[d + 1] - edges[d] == n
        # a sequence alone gives the same names
        alone, _ = P.level(np.array(s, np.uint64), np.array([0, len(s)]))
        assert alone.tolist() == names[edges[d] : edges[d + 1]].tolist()


def test_equal_substrings_share_interior_names():
    rnd = random.Random(1)
    common = [rnd.randrange(97, 123) for _ in range(2000)]
    names = []
    for n in (0, 7, 501):
        seq = [rnd.randrange(97, 123) for _ in range(n)] + common
        v, b = P.level(np.array(seq, np.uint64), np.array([0, len(seq)]))
        v, b = P.level(v, b)
        names.append(v[-100:-3].tolist())
    assert names[0] == names[1] == names[2]


def test_likeness():
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randrange(1, 8))) for _ in range(500)]
    a, b = (" ".join(rnd.choice(vocab) for _ in range(3000)) for _ in range(2))
    texts = [a, b, P.edited(a, b), a[:-50], "", "x", "x" * 1000, a]
    f = P.fingerprints(texts)
    assert f[0] == f[7] and P.likeness(f[4], f[4]) == 1.0 and P.likeness(f[4], f[5]) == 0.0
    assert P.likeness(f[0], f[3]) > 0.8 > P.likeness(f[0], f[2]) > 0.2 > P.likeness(f[0], f[1])
    assert f == [P.fingerprints([t])[0] for t in texts]


def test_query(spark, tmp_path):
    rnd = random.Random(3)
    rows = [(i * 3, "".join(rnd.choice("abc é漢 \n") for _ in range(rnd.choice([0, 1, 2, 5, 300, 4000])))) for i in range(200)]
    rows += [(1001, None), (1002, "x" * 50000), (1003, "x" * 50000), (-5, "negative")]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in P.op10_fingerprints(spark, str(tmp_path)).collect()}
    order = sorted(((d, t or "") for d, t in rows), reverse=True)
    assert len(got) == len(rows)
    for (d, t), (_, nxt) in zip(order, order[1:] + order[:1]):
        e = P.edited(t, nxt)
        assert len(e) <= len(t)
        f, g, h = (P.fingerprints([x])[0] for x in (t, e, nxt))
        r = got[d]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(t), hashlib.sha256(e.encode()).hexdigest(), f, g)
        assert (r.near_edited, r.near_next) == (P.likeness(f, g), P.likeness(f, h))


def test_one_row_empty_table_and_repeated_ids(spark, tmp_path):
    for i, rows in enumerate(([(7, "abcdef")], [], [(1, "a b c"), (1, "a b c"), (1, "other"), (None, "null id")])):
        spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / f"{i}" / "documents.parquet"))
        got = P.op10_fingerprints(spark, str(tmp_path / f"{i}")).collect()
        assert len(got) == len(rows)
        if len(rows) == 1:
            assert got[0].near_next == 1.0
    df = spark.createDataFrame([(1, "abc", "k")], "doc_id long, text string, fingerprint string")
    assert P.fingerprinted(df).columns == ["doc_id", "text", "fingerprint", "_fingerprint"]
