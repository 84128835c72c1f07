import random

import numpy as np
import xxhash

from girder.llm import simhash


def brute_print(text, k=3):
    w = [x for x in __import__("re").split("[ \t-\r]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")) if x]
    if not w:
        return 0
    s = [" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints, radius=3):
    ids = list(range(len(prints)))
    root = ids[:]

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in ids:
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in ids]


def test_query_against_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    words = ["The", "quick", "été", "fox", "jumps", "over", "ABC", "dog", "x1", "漢"]
    docs = [None, "", " \n\t", "one", "ONE", "one two", "a b c d"]
    for _ in range(25):
        base = [rnd.choice(words) for _ in range(rnd.randrange(3, 200))]
        docs.append(" ".join(base))
        for _ in range(3):
            near = base[:]
            near[rnd.randrange(len(near))] = rnd.choice(words)
            docs.append("  ".join(near))
    rows = [(i, t) for i, t in enumerate(docs)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, str(tmp_path)).collect()}
    prints = [brute_print(t) for t in docs]
    want = brute_components(prints)
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, want))}
    assert len(set(want)) < len(docs)


def test_spark_hash_is_the_same(spark):
    texts = ["one two three", "été 漢 x", ""]
    got = [r.h for r in spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("xxhash64(t) AS h").collect()]
    assert [h % (1 << 64) for h in got] == [xxhash.xxh64_intdigest(t.encode(), 42) for t in texts]


def test_links_connect_dense_and_chained_groups(spark):
    rnd = random.Random(5)
    centre = rnd.getrandbits(64)
    prints = {centre}
    for _ in range(400):  # a dense group with members up to six bits apart
        x = centre
        for b in rnd.sample(range(64), rnd.randrange(1, 4)):
            x ^= 1 << b
        prints.add(x)
    x = rnd.getrandbits(64)
    for _ in range(60):  # a chain
        prints.add(x)
        for b in rnd.sample(range(64), 3):
            x ^= 1 << b
    prints |= {rnd.getrandbits(64) for _ in range(300)}
    prints = sorted(prints)
    want = brute_components(prints)
    signed = [(int(np.uint64(p).view(np.int64)),) for p in prints]
    df = spark.createDataFrame(signed, "fp long")
    edges = simhash.links(df)
    assert edges.count() <= 20 * len(prints)
    longer = {tuple(r) for r in simhash.components(simhash.links(df, 3, 8)).collect()}
    assert longer == {tuple(r) for r in simhash.components(edges).collect()}
    # buckets that are dealt again give the same components
    assert longer == {tuple(r) for r in simhash.components(simhash.links(df, crowd=3)).collect()}
    assert [simhash.blocks_for(n, 3) for n in (0, 1000, 1 << 31, 1 << 40)] == [6, 6, 6, 9]
    roots = {r.node % (1 << 64): r.root for r in simhash.components(edges).collect()}
    label = [roots.get(p, int(np.uint64(p).view(np.int64))) for p in prints]
    groups, expect = {}, {}
    for i, (a, b) in enumerate(zip(label, want)):
        groups.setdefault(a, set()).add(i)
        expect.setdefault(b, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expect.values()))


def test_keep_first_and_edges(spark):
    rows = [(1, "a b c d", "x"), (2, "a b c d", "y"), (2, "a b c d", "y"), (3, "totally other words here", "z"), (4, None, "n"), (5, "", "e")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3, 4]
    assert simhash.groups(df.limit(0)).count() == 0
    # rows that share an id but not the text belong to groups of their own
    rows = [(0, "a b c d"), (1, "a b c d"), (1, "totally other words here"), (1, "Totally other words here"), (None, "z z z z"), (None, "q r s t u v")]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id is None, r.doc_id, r.text.lower()) for r in kept if r.doc_id is not None) == [(False, 0, "a b c d"), (False, 1, "totally other words here")]
    assert sorted(r.text for r in kept if r.doc_id is None) == ["q r s t u v", "z z z z"]


def test_bucket_of_near_texts_discards_by_pivots():
    rnd = np.random.default_rng(2)
    base = [np.unique(rnd.integers(0, 1 << 63, 200).astype(np.uint64)) for _ in range(30)]
    texts = [x for b in base for x in (b, np.unique(np.concatenate([b[10:], rnd.integers(0, 1 << 63, 5).astype(np.uint64)])))]
    prints = [int(simhash.majority(x, np.array([0, len(x)]))[0]) for x in texts]
    bucket = simhash.Bucket(0.8, held_bytes=1 << 30)
    for i, grams in enumerate(texts):
        assert bucket.near(i, prints[i], grams) == ([i - 1] if i % 2 else [], True)
    assert len(bucket.nodes) == 60
    # most pairs fall to the pivot table, and few sets are read in vain
    assert 30 <= bucket.read < 60 and bucket.left < bucket.met / 2
    # without room one text is held, and all others are left for another round
    tight = simhash.Bucket(0.8, held_bytes=0)
    assert [tight.near(i, prints[i], x) for i, x in enumerate(texts)] == [([], True), ([0], False), *[([], False)] * 58]


def test_one_very_long_text(spark, tmp_path):
    rnd = random.Random(5)
    long = [rnd.choice("abcdefgh") + str(rnd.randrange(900)) for _ in range(120_000)]
    texts = [" ".join(long), "\n".join([*long[:60_000], "other", *long[60_001:]]), "a b c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op3_simhash(spark, str(tmp_path)).collect()}
    prints = [brute_print(t) for t in texts]
    assert got == {i: (f"{p:016x}", c) for i, (p, c) in enumerate(zip(prints, brute_components(prints)))}
