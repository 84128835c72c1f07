"""Every query with SQL gives DuckDB's rows, on the small tables."""

import math
import random

import duckdb
import pytest

from girder.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in data), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query_equals_sql(spark, duck, sf_dir, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    found = duck.sql(catalog.ORACLES[name])
    got, want = rows(df.columns, df.collect()), rows(found.columns, found.fetchall())
    assert got[0] == want[0]
    assert got[1] == want[1]
    kinds = dict(zip(found.columns, map(str, found.types)))
    same = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
    assert {c: same[t] for c, t in df.dtypes if t in same} == {c: kinds[c] for c, t in df.dtypes if t in same}


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs(spark, sf_dir, name):
    assert catalog.QUERIES[name](spark, sf_dir).count() >= 0


def small(spark, name):
    return spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").collect()


def test_network_components_against_a_search(spark, sf_dir):
    near = {}
    for r in small(spark, "lineitem"):
        near.setdefault(r.l_partkey, set()).add(-1 - r.l_suppkey)
        near.setdefault(-1 - r.l_suppkey, set()).add(r.l_partkey)
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            n = todo.pop()
            if n not in want:
                want[n] = start
                todo += near[n]
    assert {r.node: r.root for r in catalog.QUERIES["network_components"](spark, sf_dir).collect()} == want


def test_greedy_against_a_loop(spark, sf_dir):
    from girder.plans.lookups import points

    cells = {}
    p = [(r.id, r.kind, r.x, round(r.y, 6)) for r in points(spark, sf_dir).collect()]
    for i, k, x, y in p:
        cells.setdefault((k, math.floor(x / 0.05), math.floor(y / 0.05)), []).append((i, x, y))
    pairs = []
    for i, k, x, y in p:
        if i % 2 == 0:
            cx, cy = math.floor(x / 0.05), math.floor(y / 0.05)
            for j, u, v in (o for dx in (-1, 0, 1) for dy in (-1, 0, 1) for o in cells.get((k, cx + dx, cy + dy), ())):
                if j % 2 and abs(x - u) <= 0.05 and abs(y - v) <= 0.05 and (d := math.hypot(x - u, y - v)) <= 0.05:
                    pairs.append((d, i, j))
    used, want = set(), set()
    for _, a, b in sorted(pairs):
        if a not in used and b not in used:
            used |= {a, b}
            want.add((a, b))
    got = {(r.a, r.b) for r in catalog.QUERIES["greedy_one_to_one"](spark, sf_dir).collect()}
    assert len(want) > 100 and len(got ^ want) <= len(want) // 500  # distances that differ in their last bit may swap


def test_review_draws_against_the_generator(spark, sf_dir):
    lots = {}
    for r in small(spark, "supplier"):
        lots.setdefault(r.s_nationkey, set()).add(r.s_name)
    want = {(k, x) for k, lot in lots.items() for x in random.Random(k).sample(sorted(lot), min(3, len(lot)))}
    assert {tuple(r) for r in catalog.QUERIES["review_draws"](spark, sf_dir).collect()} == want


def test_edit_ratios_against_a_table(spark, sf_dir):
    from .test_text import distance

    rows = {(r.conv_id, r.turn, r.role): (r.text or "").split() for r in small(spark, "conversations")}
    want = {}
    for (c, t, role), q in rows.items():
        a = rows.get((c, t + 1, "assistant"))
        if role == "user" and a is not None:
            want[c, t] = distance(q, a) / max(len(q), len(a), 1)
    got = {(r.conv_id, r.turn): r.ratio for r in catalog.QUERIES["edit_ratios"](spark, sf_dir).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_sampling_plans_against_a_search(spark, sf_dir):
    lots = {}
    for r in small(spark, "orders"):
        lots[r.o_orderpriority] = lots.get(r.o_orderpriority, 0) + 1
    for r in catalog.QUERIES["sampling_plans"](spark, sf_dir).collect():
        n, wrong = lots[r.o_orderpriority], -(-lots[r.o_orderpriority] // 20)
        passes = lambda s, n=n, wrong=wrong: math.comb(n - wrong, s) / math.comb(n, s)
        assert r["count"] == n and r.sample == next(s for s in range(n + 1) if passes(s) <= 0.05)


def test_calibrated_scores_against_a_plain_fit(spark, sf_dir):
    from girder.plans.evaluation import outcomes

    seen = outcomes(spark, sf_dir).collect()
    sums = {}
    for r in seen:
        n, ok = sums.get(round(r.confidence, 3), (0, 0))
        sums[round(r.confidence, 3)] = n + 1, ok + r.correct
    x = sorted(sums)
    # the least-squares fit that does not fall: the largest of least means over all stretches
    mean = lambda i, j: sum(sums[v][1] for v in x[i : j + 1]) / sum(sums[v][0] for v in x[i : j + 1])
    fit = [max(min(mean(i, j) for j in range(k, len(x))) for i in range(k + 1)) for k in range(len(x))]

    def at(v):
        if v <= x[0] or v >= x[-1]:
            return fit[0] if v <= x[0] else fit[-1]
        k = next(k for k in range(len(x)) if x[k] > v)
        return fit[k - 1] + (v - x[k - 1]) * (fit[k] - fit[k - 1]) / (x[k] - x[k - 1])

    for r in catalog.QUERIES["calibrated_scores"](spark, sf_dir).collect():
        assert abs(r.calibrated - at(r.confidence)) < 1e-9


def test_shape_descriptors_by_definition(spark, sf_dir):
    got = {r.vec_id: r.histogram for r in catalog.QUERIES["shape_descriptors"](spark, sf_dir).collect()}
    for r in small(spark, "embeddings")[:50]:
        e = [float(v) for v in r.embedding]
        x, y = e[:32], e[32:]
        mx, my = sum(x) / 32, sum(y) / 32
        want = [0] * 8
        for a, b in zip(x, y):
            want[int((math.atan2(b - my, a - mx) + math.pi) / (2 * math.pi) * 8) % 8] += 1
        assert [round(h * 32) for h in got[r.vec_id]] == want


def test_empty_labels_give_no_scores(spark, tmp_path):
    for name in ("labels", "documents"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert catalog.QUERIES["calibrated_scores"](spark, str(tmp_path)).count() == 0
