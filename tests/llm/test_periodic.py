import hashlib
import random
import re
import zlib

from hypothesis import given, settings
from hypothesis import strategies as st

from girder.llm import periodic as P


def brute(words, least=24, times=3):
    """Each period's maximal stretches; of a stretch with several periods the smallest counts."""
    n, found = len(words), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, times * q):
                found.setdefault((i, j + q), q)
            i = j
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def rewritten(doc_id, text):
    w = re.findall("[^ \t-\r]+", text or "")
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def expected(doc_id, text):
    w = rewritten(doc_id, text)
    runs = brute(w)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = None
    for r in runs:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, sha("".join(f"{s},{n},{q}\n" for s, n, q in runs)), sha(" ".join(x for i, x in enumerate(w) if i not in gone)))


def got(df):
    return {r.doc_id: tuple(r)[1:] for r in df.select("doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256").collect()}


@settings(max_examples=120, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=70), max_size=4), st.integers(2, 12), st.integers(2, 4))
def test_runs_of_any_words(documents, least, times):
    assert P.runs_of(documents, least, times) == [brute(d, least, times) for d in documents]


def test_copies_inside_blocks():
    rnd = random.Random(5)
    for _ in range(60):
        part = [b"%d" % rnd.randrange(50) for _ in range(rnd.randrange(5, 30))]
        unit = [b"%d" % rnd.randrange(4) for _ in range(rnd.randrange(1, 6))]
        part[3:3] = unit * rnd.randrange(4, 20)
        words = part * rnd.randrange(1, 6)
        words[rnd.randrange(len(words))] = b"x"
        words += words[: rnd.randrange(len(words))]
        assert P.runs_of([words, part]) == [brute(words), brute(part)]
    fibonacci = [[b"a"], [b"a", b"b"]]
    for _ in range(11):
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    assert P.runs_of(fibonacci, 4, 2) == [brute(f, 4, 2) for f in fibonacci]


def test_query_on_the_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    found = got(P.op11_periodic_runs(spark, sf))
    assert found == {r.doc_id: expected(r.doc_id, r.text) for r in rows}
    assert sum(v[0] > 0 for v in found.values()) > 5


def test_edges(spark, tmp_path):
    long_text = " ".join(["the quick brown fox"] * 3000 + [f"w{i}" for i in range(2000)] + ["é ü"] * 2000)
    rows = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a " * 24), (6, "a " * 23), (6, "a " * 23), (None, "b\n" * 30), (7, long_text), (8, "x y z " * 8 + "w " + "x y z " * 8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    out = P.op11_periodic_runs(spark, str(tmp_path)).collect()
    assert len(out) == len(rows)
    want = {(d, *expected(d, t)) for d, t in rows if d is not None}
    assert {tuple(r) for r in out if r.doc_id is not None} == want
    assert [(r.n_runs, r.start, r.length, r.period) for r in out if r.doc_id is None] == [(1, 0, 30, 1)]
    clash = df.selectExpr("doc_id", "text", "1 AS runs", "'k' AS collapsed")
    kept = P.periodic_runs(clash)
    assert kept.columns == ["doc_id", "runs", "collapsed", "n_words", "_runs", "_collapsed"] and kept.count() == len(rows)
    assert P.periodic_runs(df.limit(0)).count() == 0
