import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from girder.llm import simhash


def brute_near(texts):
    """Pairs of different positions whose five-word Jaccard similarity is 0.8 or more."""
    sets, places, common = [], defaultdict(list), Counter()
    for i, t in enumerate(texts):
        w = (t or "").lower().split()
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))})
        for s in sets[-1]:
            common.update((j, i) for j in places[s])
            places[s].append(i)
    return [(a, b) for (a, b), n in common.items() if n / (len(sets[a]) + len(sets[b]) - n) >= 0.8]


def first_of_components(n, pairs):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df.repartition(4), "").collect()}
    pairs = brute_near(texts)
    missed = [(a, b) for a, b in pairs if a in kept and b in kept]
    roots = first_of_components(len(texts), pairs)
    assert missed == []
    # nothing is dropped that no chain of near pairs links to an earlier document
    assert {i for i in range(len(texts)) if roots[i] == i} <= kept
    return pairs, kept


def test_stage_drops_copies_with_edited_words(spark):
    rnd = random.Random(7)
    vocabulary = [f"w{i}" for i in range(3000)]
    texts = []
    for _ in range(60):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randrange(60, 400))]
        texts.append(" ".join(base))
        for share in (0.002, 0.01, 0.015, 0.02, 0.03, 0.1):
            texts.append(" ".join(rnd.choice(vocabulary) if rnd.random() < share else w for w in base))
    dense = [rnd.choice(vocabulary) for _ in range(200)]
    for i in range(150):
        at = rnd.randrange(200)
        texts.append(" ".join([*dense[:at], f"other{i}", *dense[at + 1 :]]))
    rnd.shuffle(texts)
    pairs, kept = check(spark, texts + [None, "", " ", "one two", "One  two", "one three"])
    assert len(pairs) > 10_000 and len(kept) < len(texts) / 2


def test_stage_on_the_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").collect()
    pairs, kept = check(spark, [r.text for r in docs])
    assert len(pairs) > 100 and len(kept) < len(docs)


def test_edges(spark):
    rows = [(0, "a b c d"), (1, "a b c d"), (1, "totally other words here"), (1, "Totally other words here"), (None, "z z z z"), (None, "q r s t u v")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = simhash.keep_first(df).collect()
    assert sorted((str(r.doc_id), r.text.lower()) for r in kept) == [("0", "a b c d"), ("1", "totally other words here"), ("None", "q r s t u v"), ("None", "z z z z")]
    assert simhash.keep_first(df.limit(0)).count() == 0


def chained(rnd, vocabulary, steps, n=60):
    """Texts of which each is near to the next ones only."""
    words = [rnd.choice(vocabulary) for _ in range(n)]
    out = [" ".join(words)]
    for i in range(steps):
        words = [*words[1:], f"new{rnd.randrange(10**9)}"]
        out.append(" ".join(words))
    return out


def test_bounds_change_no_components(spark):
    """Chains and dense groups, with room for hardly a text, against components of brute force."""
    rnd = random.Random(3)
    vocabulary = [f"w{i}" for i in range(2000)]
    texts = [t for _ in range(3) for t in chained(rnd, vocabulary, 25)]
    base = [rnd.choice(vocabulary) for _ in range(120)]
    for i in range(80):
        at = rnd.randrange(120)
        texts.append(" ".join([*base[:at], f"other{i}", *base[at + 1 :]]))
    texts += ["alone in the world of words", None]
    rnd.shuffle(texts)
    want = first_of_components(len(texts), brute_near(texts))
    df = spark.createDataFrame([(i, str(i), t) for i, t in enumerate(texts)], "doc_id long, place string, text string").repartition(3)
    for bounds in ({}, {"held_bytes": 3000, "texts": 8}, {"held_bytes": 1, "texts": 1000}):
        got = {r.doc_id: r.component_id for r in simhash.near_components(df, **bounds).collect()}
        assert [got[i] for i in range(len(texts))] == want


def test_a_chain_in_one_bucket():
    rnd = random.Random(1)
    words = [rnd.randrange(1 << 62) for _ in range(200)]
    sets = [np.array(sorted(words[i * 8 : i * 8 + 100]), np.uint64) for i in (0, 3, 2, 1)]
    bucket = simhash.Bucket(0.8, far=64)
    for i, s in enumerate(sets):
        bucket.near(i, 0, s)
    roots = {bucket.root(i) for i in range(4)}
    assert len(roots) == 1
    # without room nothing is held beyond the first, and all else is left over
    tight = simhash.Bucket(0.8, far=64, held_bytes=1)
    assert [tight.near(i, 0, s)[1] for i, s in enumerate(sets)] == [True, False, False, False]
