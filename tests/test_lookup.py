"""Lookup joins against all-pairs versions in plain Python."""

import hashlib
import math
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from girder.operators import documents, drawing, lookup, metrics, quantity, versions
from girder.operators.checkpoints import checkpointed
from girder.plans import lookups, takeoff

few = settings(max_examples=6, deadline=None)
grid = st.integers(0, 40).map(lambda i: i * 0.01)


@few
@given(st.lists(st.tuples(st.sampled_from("ab"), grid, grid), min_size=1, max_size=60))
def test_near_pairs(spark, points):
    rows = [(i, *p) for i, p in enumerate(points)]
    got = lookup.near_pairs(spark.createDataFrame(rows, "id int, k string, x double, y double"), ["k"], "x", "y", "id", 0.03).collect()
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] == b[1] and abs(a[2] - b[2]) <= 0.03 and abs(a[3] - b[3]) <= 0.03]
    assert sorted(map(tuple, got)) == want


@few
@given(st.lists(st.tuples(grid, grid, grid), min_size=1, max_size=60))
def test_overlapping_runs(spark, runs):
    rows = [(i, o, lo, lo + n) for i, (o, lo, n) in enumerate(runs)]
    got = lookup.overlapping_runs(spark.createDataFrame(rows, "id int, o double, lo double, hi double").withColumn("k", F.lit(1)), ["k"], "id", "o", "lo", "hi", 0.02).collect()
    want = [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and abs(a[1] - b[1]) <= 0.02 and min(a[3], b[3]) - max(a[2], b[2]) > 0.02]
    assert sorted((r.a, r.b) for r in got) == want


@few
@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 20)), max_size=30), st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 20)), max_size=15, unique=True))
def test_as_of(spark, asked, known):
    left = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, k string, at int")
    right = spark.createDataFrame([(*k, f"{k}") for k in known], "k string, since int, v string")
    for earliest in (False, True):
        got = {r.id: r.v for r in lookup.as_of(left, right, ["k"], "at", "since", ["id"], earliest).collect()}
        for i, (k, at) in enumerate(asked):
            own = sorted(x for x in known if x[0] == k)
            before = [x for x in own if x[1] <= at] or (own[:1] if earliest else [])
            assert got[i] == (f"{before[-1]}" if before else None)
        assert len(got) == len(asked)


@few
@given(st.lists(st.tuples(st.integers(0, 40), st.integers(0, 40)), max_size=50))
def test_components(spark, edges):
    got = {r.node: r.root for r in lookup.components(spark.createDataFrame(edges, "a int, b int"), checkpointed).collect()}
    root = {x: x for e in edges if e[0] != e[1] for x in e}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == root


@few
@given(st.lists(st.tuples(st.sampled_from("st"), st.integers(0, 12), st.integers(0, 12), st.integers(0, 9)), max_size=60, unique_by=lambda t: t[:3]))
def test_greedy(spark, candidates):
    rows = [(g, a, b, d / 10) for g, a, b, d in candidates]
    got = lookup.greedy_matches(spark.createDataFrame(rows, "g string, a int, b int, distance double"), "g", checkpointed).collect()
    used, want = set(), []
    for g, a, b, d in sorted(rows, key=lambda r: (r[3], r[1], r[2])):
        if not {(g, "a", a), (g, "b", b)} & used:
            used |= {(g, "a", a), (g, "b", b)}
            want.append((g, a, b, d))
    assert sorted(map(tuple, got)) == sorted(want)


@few
@given(
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), max_size=40),
    st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 40)), max_size=25, unique=True),
)
def test_as_of_by_parts(spark, asked, known):
    left = spark.createDataFrame([(i, *a) for i, a in enumerate(asked)], "id int, k string, at int")
    right = spark.createDataFrame([(*k, f"{k}") for k in known], "k string, since int, v string")
    for earliest in (False, True):
        plain, parts = (lookup.as_of(left, right, ["k"], "at", "since", ["id"], earliest, bucket).collect() for bucket in (None, lambda c: F.floor(c / 5)))
        assert sorted(map(str, plain)) == sorted(map(str, parts)) and len(parts) == len(asked)


some = st.none() | st.integers(0, 3)


@few
@given(st.lists(st.tuples(st.sampled_from("gh"), st.sampled_from([None, "P", "C"]), some, some), max_size=14))
def test_latest_by_order(spark, candidates):
    rows = [(g, i, s, n, d) for i, (g, s, n, d) in enumerate(candidates)]
    got = {r.g: r.id for r in metrics.latest_by_order(spark.createDataFrame(rows, "g string, id int, s string, n int, d int"), "g", "id", "s", "n", "d").collect()}

    def later(a, b):
        x, y = (a[3], b[3]) if a[2] is not None and a[2] == b[2] else (a[4], b[4])
        return x is not None and y is not None and x > y

    want = {}
    for g in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == g]
        want[g] = next((a[1] for a in own if all(later(a, b) for b in own if b is not a)), None)
    assert got == want


@few
@given(st.lists(st.tuples(st.sampled_from("ab"), grid, grid), min_size=1, max_size=30), st.lists(st.tuples(st.sampled_from("ab"), grid, grid, grid, grid), max_size=20))
def test_nearest_segment(spark, points, lines):
    p, m = [(i, *x) for i, x in enumerate(points)], [(i, *x) for i, x in enumerate(lines)]
    lines_df = spark.createDataFrame(m, "segment int, s string, x0 double, y0 double, x1 double, y1 double")
    got = {r.point: (r.segment, r.gap) for r in drawing.nearest_segment(spark.createDataFrame(p, "point int, s string, x double, y double"), lines_df, "s", "point", "segment", checkpointed).collect()}

    def gap(x, y, x0, y0, x1, y1):
        size = (x1 - x0) ** 2 + (y1 - y0) ** 2
        t = max(0.0, min(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / size)) if size else 0.0
        return round(math.hypot(x - x0 - t * (x1 - x0), y - y0 - t * (y1 - y0)), 9)

    want = {}
    for i, s, x, y in p:
        best = min(((gap(x, y, *e), k) for k, t, *e in m if t == s), default=None)
        if best:
            want[i] = best[0]
    assert got.keys() == want.keys()
    assert all(abs(got[i][1] - want[i]) < 1e-8 for i in want)


def test_nearest_and_within_by_blocks(spark, monkeypatch):
    rnd = random.Random(3)
    rows = [(i, [rnd.randrange(20) / 8 for _ in range(4 if i % 7 else 3)] if i != 5 else None) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    asked = df.filter("vec_id % 10 = 0 OR vec_id = 5")

    def distance(a, b):
        return round(sum(abs(x - y) for x, y in zip(a, b)) / 2, 6) if a is not None and b is not None and len(a) == len(b) else 1.0

    monkeypatch.setattr(lookups, "BLOCK", 4)
    monkeypatch.setattr(takeoff, "BLOCK", 4)
    best = {r.vec_id: (r.distance, r.other) for r in lookups.nearest(asked, df).collect()}
    vectors = dict(rows)
    assert best == {i: min((distance(vectors[i], v), j) for j, v in rows if j != i) for i in vectors if i % 10 == 0 or i == 5}
    limits = spark.createDataFrame([(i, d) for i, (d, _) in best.items()], "vec_id long, tolerance double")
    got = {(r.vec_id, r.other) for r in takeoff.within(asked.join(limits, "vec_id"), df, 1.5).collect()}
    assert got == {(i, j) for i, (d, _) in best.items() for j, v in rows if j != i and d < distance(vectors[i], v) <= d * 1.5}


def test_chains_are_walked_in_order(spark):
    rows = [(k, i, f"b{k}{i}") for k in ("x", "y", None) for i in range(1, 300)]
    got = {(r.k, r.seq): r for r in versions.linked(spark.createDataFrame(rows, "k string, seq int, body_hash string").repartition(5), "k").collect()}
    last = {}
    for k, i, body in rows:
        r = got[k, i]
        assert r.prev_hash == last.get(k, "")
        last[k] = hashlib.sha256(f"{last.get(k, '')}:{body}".encode()).hexdigest()
        assert r.hash == last[k]
    assert len(got) == len(rows)


def test_grid_labels(spark):
    got = [r.l for r in spark.range(1, 20000).select(drawing.grid_label(F.col("id")).alias("l")).collect()]
    assert got[:27] == [*"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "AA"] and got[701:703] == ["ZZ", "AAA"] and got[18277:18279] == ["ZZZ", "AAAA"]
    back = spark.createDataFrame([(x,) for x in got], "l string").select(drawing.label_ordinal(F.col("l")).alias("n")).collect()
    assert [r.n for r in back] == list(range(1, 20000))


@few
@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 60), st.integers(0, 30), st.integers(0, 30)), min_size=1, max_size=40))
def test_touching(spark, boxes):
    rows = [(i, float(x), float(y), float(x + w), float(y + h)) for i, (x, y, w, h) in enumerate(boxes)]
    got = drawing.touching(spark.createDataFrame(rows, "id int, minx double, miny double, maxx double, maxy double").withColumn("k", F.lit(1)), ["k"], "id", 0.3, 10.0).collect()
    near = lambda a, b: a[1] <= b[3] + 0.3 and b[1] <= a[3] + 0.3 and a[2] <= b[4] + 0.3 and b[2] <= a[4] + 0.3
    assert sorted((r.a, r.b) for r in got) == [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and near(a, b)]


@few
@given(st.lists(st.tuples(st.integers(0, 20), st.floats(0, 1), st.integers(1, 9)), min_size=1, max_size=20, unique_by=lambda p: p[0]))
def test_isotonic_fit(points):
    fit = metrics.isotonic([(float(s), a, w) for s, a, w in points])
    values = [v for _, v in fit]
    assert [s for s, _ in fit] == sorted(float(s) for s, _, _ in points) and all(a <= b + 1e-12 for a, b in zip(values, values[1:]))
    weights = {float(s): w for s, _, w in points}
    assert abs(sum(weights[s] * v for s, v in fit) - sum(a * w for _, a, w in points)) < 1e-9


def test_sampling_plan():
    from fractions import Fraction

    assert metrics.chance_of_passing(10, 2, 5, 0) == Fraction(2, 9)
    n = metrics.smallest_sample(200, 10, 1, Fraction(95, 100))
    assert metrics.chance_of_passing(200, 10, n, 1) <= Fraction(5, 100) < metrics.chance_of_passing(200, 10, n - 1, 1)


def test_rounding_and_repairs(spark):
    assert [r.r for r in spark.createDataFrame([(0.5,), (1.5,), (2.5,)], "v double").select(quantity.half_even(F.col("v")).alias("r")).collect()] == [0, 2, 2]
    got = [r.r for r in spark.createDataFrame([("1O0",), ("OO5",), ("lO1",), ("FOO",), ("3I",)], "v string").select(documents.ocr_digits(F.col("v")).alias("r")).collect()]
    assert got == ["100", "005", "101", "FOO", "31"]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k int, v int")
    assert versions.delta(none, none, "k", ["v"]).count() == 0 and versions.recompute(none, none, "k", "v").count() == 0
    assert lookup.latest(none, ["k"], "v").count() == 0
    assert lookup.components(none.select(F.col("k").alias("a"), F.col("v").alias("b")), checkpointed).count() == 0


def test_overlap_counts(spark):
    rnd = random.Random(12)
    end = lambda x: None if rnd.random() < 0.1 else x
    ranges = [(rnd.choice("ab"), end(lo), end(lo + rnd.randrange(6))) for lo in (rnd.randrange(40) for _ in range(120))]
    asked = [(rnd.choice("abc"), i, end(lo), end(lo + rnd.randrange(9))) for i, lo in enumerate(rnd.randrange(-5, 50) for _ in range(200))]
    low, high = (lambda x: -1e9 if x is None else x), (lambda x: 1e9 if x is None else x)
    want = {i: sum(k == kk and low(lo) <= high(hi2) and low(lo2) <= high(hi) for kk, lo, hi in ranges) for k, i, lo2, hi2 in asked}
    got = lookup.overlap_counts(spark.createDataFrame(asked, "k string, i int, lo int, hi int"), spark.createDataFrame(ranges, "k string, lo int, hi int"), ["k"], "i")
    assert {r.i: r.n for r in got.collect()} == {i: n for i, n in want.items() if n}
