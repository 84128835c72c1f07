import random
import re
from collections import Counter, defaultdict

import duckdb

from girder.llm import collocations as C


def brute(rows, least=30, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split("[.,;:!?\n-\r]", low):
            w = tuple(re.findall("[^ \t]+", piece))
            n[lang] += len(w)
            f[lang].update(w[i : i + k] for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        own = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in own.items():
            if any(len(q) > len(p) and 100 * b >= 80 * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in own.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k, count[p[:k]], count[p[k:]]) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -score))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def corpus(seed, docs):
    rnd = random.Random(seed)
    vocab = ["the", "The", "of", "été", "漢", "a\x00", "a\x01", "a", "\x00", "\x01b", "x\x05", "don't"] + [f"w{i}" for i in range(25)]
    line = ["Every", "page", "says", "the", "same", "line"]
    rows = [("en", None), (None, ""), ("de", " \t"), ("en", "one"), (None, "und und und " * 40), ("und", "und nun und " * 30)]
    for i in range(docs):
        body = []
        for _ in range(rnd.randrange(1, 90)):
            body += line if rnd.random() < 0.1 else [vocab[int(len(vocab) * rnd.random() ** 2)]]
            body += rnd.choice([[], [], [], [",", "."], ["\n"], ["\t"], ["end."]])
        rows.append((rnd.choice(["en", "en", "en", "de", None]), rnd.choice(["", " "]) + " ".join(body)))
    return rows + [rows[9]] * 40 + [("fr", "tres long texte " * 20000)]


def test_against_brute_force(spark):
    rows = corpus(3, 300)
    df = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    want = brute(rows)
    assert len(want) > 40 and got(C.collocations(df)) == want
    # frequent words whose suffixes are dealt by more words, and small portions
    for options in ({"share": 40, "portion": 1 << 13}, {"share": 400, "portion": 1 << 16}, {"share": 1, "portion": 1 << 15}):
        assert got(C.collocations(df, **options)) == want
    assert got(C.collocations(df, top=5)) == brute(rows, top=5)
    assert got(C.collocations(df, least=3)) == brute(rows, least=3)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame(corpus(4, 30), "lang string, text string")
    assert C.collocations(df.limit(0)).count() == 0
    more = df.selectExpr("lang", "text", "1 AS n", "'x' AS phrase", "2 AS word", "3 AS head")
    assert got(C.collocations(more)) == got(C.collocations(df))


def test_exact_beyond_64_bits(spark, monkeypatch):
    big = 10**17
    counts = spark.createDataFrame([("en", "a", 1, big + 1), ("en", "b", 1, big), ("en", "a b", 2, big)], "lang string, phrase string, size int, n long")
    totals = spark.createDataFrame([("en", 3 * big)], "lang string, n long")
    monkeypatch.setattr(C, "phrase_counts", lambda *a, **k: (totals, counts))
    assert got(C.collocations(counts)) == [("en", 1, "a b", big, big + 1, big, 3 * big, 2_000_000 * big // (2 * big + 1))]


def test_query_equals_its_sql(spark, sf_dir):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf_dir}/documents.parquet'")
    want = con.sql(C.OP13_SQL)
    names = want.columns
    assert sorted(want.fetchall()) == sorted(tuple(r) for r in C.op13_collocations(spark, sf_dir).select(*names).collect())
