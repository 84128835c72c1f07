"""What larger tables brought up: one test a finding."""

import contextlib
import io
import math
import random
from decimal import Decimal
from fractions import Fraction

from pyspark.sql import functions as F

from girder.operators import costing, documents, drawing, lookup, metrics, network, quantity
from girder.operators.checkpoints import checkpointed
from girder.plans import evaluation, lookups, networks, takeoff


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain()
    return out.getvalue()


def test_nearest_segment_sorts_no_pairs(spark):
    rnd = random.Random(5)
    place = lambda: (rnd.gauss(0, 1), rnd.gauss(0, 1))
    lines = [(i, "s", *place(), *place()) for i in range(60)]
    # copies of a line and of a place count once, under the smallest id
    lines += [(100 + i, *lines[i][1:]) for i in range(60)]
    points = [(i, "s", *place()) for i in range(40)]
    points += [(50 + i, *points[i][1:]) for i in range(40)]
    plans = []

    def keep(df):
        plans.append(plan(df))
        return checkpointed(df)

    lines_df = spark.createDataFrame(lines, "segment int, s string, x0 double, y0 double, x1 double, y1 double")
    got = {r.point: (r.segment, r.gap) for r in drawing.nearest_segment(spark.createDataFrame(points, "point int, s string, x double, y double"), lines_df, "s", "point", "segment", keep).collect()}

    def gap(x, y, x0, y0, x1, y1):
        t = max(0.0, min(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2)))
        return ((x - x0 - t * (x1 - x0)) ** 2 + (y - y0 - t * (y1 - y0)) ** 2) ** 0.5

    want = {i: min((round(gap(x, y, *e), 9), k) for k, _, *e in lines) for i, _, x, y in points}
    assert {i: s for i, (s, _) in got.items()} == {i: s for i, (_, s) in want.items()}
    assert all(abs(got[i][1] - want[i][0]) < 1e-8 for i in want)
    assert not any("SortAggregate" in p for p in plans)


def test_section_totals_beyond_one_line(spark):
    rows = [("A", Decimal("999999999999.99")), ("A", Decimal("999999999999.99")), ("B", None), ("B", Decimal("0.02"))]
    got = costing.section_totals(spark.createDataFrame(rows, "section string, amount decimal(14,2)"), "section", "amount").collect()
    assert {r.section: (r.total, r.priced, r.unpriced) for r in got} == {"A": (Decimal("1999999999999.98"), 2, 0), "B": (Decimal("0.02"), 1, 1), None: (Decimal("2000000000000.00"), 3, 1)}


def test_turns_of_paths_that_rest(spark):
    rnd = random.Random(4)
    rows = [(p, i, float(rnd.randrange(3)), float(rnd.randrange(3))) for p in range(20) for i in range(40)]
    got = {(r.p, r.i): r.turn for r in quantity.elbows(spark.createDataFrame(rows, "p int, i int, x double, y double"), "p", "i", "x", "y", 150.0).collect()}
    want = {}
    for (p, _, x0, y0), (q, i, x1, y1), (r, _, x2, y2) in zip(rows, rows[1:], rows[2:]):
        bx, by, ax, ay = x1 - x0, y1 - y0, x2 - x1, y2 - y1
        turn = math.degrees(abs(math.atan2(bx * ay - by * ax, bx * ax + by * ay)))
        if p == q == r and turn > 150:
            want[p, i] = turn
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def test_labels_of_rows_that_are_one_run(spark):
    # two rows have the number 1: one with a label, one without; both ways of stating labels agree on the sizes
    rows = [(1, 0, 10, 11, 0.0, 180.0, 50, 0.8), (1, 1, 20, 21, 0.0, 180.0, None, 0.9), (2, 1, 21, 22, 0.0, 180.0, None, 0.3), (3, 2, 30, 31, 0.0, 180.0, None, 0.3)]
    runs = spark.createDataFrame(rows, "run long, sheet int, a long, b long, angle_a double, angle_b double, label int, confidence double")
    nodes = spark.createDataFrame([(1, 21, "joint", False)], "sheet int, node long, kind string, reducer boolean")
    got = network.run_sizes(runs, nodes, None, 10.0, checkpointed)
    assert sorted((r.run, r.sheet, r.group, r.dn, r.status, r.label_confidence) for r in got.collect()) == [
        (1, 0, 1, 50, "labelled", 0.8), (1, 1, 1, 50, "propagated", 0.8), (2, 1, 1, 50, "propagated", 0.8), (3, 2, 3, None, "unknown", 0.0),
    ]


def test_references_where_lines_share_a_place(spark):
    # 2.675 and 25.05 are no exact numbers: copies just outside a tolerance must not hide the line behind them
    lines = [("a", 100.1, x) for x in ("AB", "B", "AA", "Z")] + [("a", 110.0, "C"), ("a", 160.0, "AD"), ("a", 160.0, "E"), ("b", 5.0, "F")]
    points = [(0, "a", 125.1), (1, "a", 130.2), (2, "a", 135.5), (3, "a", 170.0), (4, "a", 400.0), (5, "b", 90.0), (6, "a", 10.0), (7, "c", 1.0), (8, "a", 185.1)]
    got = drawing.grid_reference(spark.createDataFrame(points, "i int, s string, x double"), spark.createDataFrame(lines, "s string, p double, l string"), ["s"], "x", "p", "l", 25.0)

    def expected(s, x):
        own = sorted({p: max((len(n), n) for k, q, n in lines if (k, q) == (s, p))[1] for k, p, _ in lines if k == s}.items())
        on = [n for p, n in own if abs(p - x) <= 25]
        return on[0] if on else "-".join([n for p, n in own if p < x][-1:] + [n for p, n in own if p > x][:1])

    assert {r.i: r.reference for r in got.collect()} == {i: expected(s, x) for i, s, x in points}


def test_samples_of_large_lots():
    # numbers as of half the lot would take hours here
    lot = 10**9
    n = metrics.smallest_sample(lot, lot // 20, 0, Fraction(95, 100))
    assert metrics.chance_of_passing(lot, lot // 20, n, 0) <= Fraction(5, 100) < metrics.chance_of_passing(lot, lot // 20, n - 1, 0)
    assert metrics.chance_of_passing(lot, 1, lot // 2, 0) == Fraction(1, 2)


def test_attributes_use_all_cores(spark):
    clauses = spark.createDataFrame([(i, "Pipes shall be galvanised.") for i in range(50)], "c int, text string").coalesce(1)
    assert documents.attributes(clauses, "c", "text").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_twins_take_more_portions_of_more_rows(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(takeoff, "PORTION", 200)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        takeoff.twins_of_rejections(spark, sf_dir).explain()
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert "hashpartitioning(l_partkey#" in out.getvalue() and f", {1 + rows // 200})" in out.getvalue()


def test_groups_of_sheets_in_parts(spark, monkeypatch):
    """Chains on sheets that no task holds whole, and a run on two sheets, by the numbers of shuffles and by all sizes."""
    rnd, rows = random.Random(5), []
    for sheet in range(30):
        for i in range(rnd.choice([1, 3, 40])):
            # run 7 is on sheets 0 and 9 too, whose groups are one then
            run = 7 if (sheet, i) in ((0, 0), (9, 0)) else 1000 * sheet + 10 + i
            rows.append((run, sheet, i, i + 1, 0.0, 180.0, rnd.choice([25, 32, None, None, None, None]), 0.5 + i / 100))
    runs = spark.createDataFrame(rows, "run long, sheet int, a long, b long, angle_a double, angle_b double, label int, confidence double")
    kinds = F.lit("joint"), F.col("node") % 25 == 24
    group, root = {}, {}
    find = lambda r: r if root.setdefault(r, r) == r else find(root[r])
    ends = {}
    for run, sheet, a, b, *_ in rows:
        find(run)
        for node in (a, b):
            if node % 25 != 24 and (other := ends.setdefault((sheet, node), run)) != run:
                x, y = find(run), find(other)
                root[max(x, y)] = min(x, y)
    for run, *_, label, confidence in rows:
        group.setdefault(find(run), []).append((label, confidence if label else None))
    want = []
    for run, sheet, *_, label, _c in rows:
        own = {x for x, _ in group[find(run)]} - {None}
        status = "conflict" if len(own) > 1 else "labelled" if label else "propagated" if own else "unknown"
        want.append((run, sheet, find(run), own.pop() if len(own) == 1 else None, status, max((c for _, c in group[find(run)] if c), default=0.0)))
    key = lambda r: str(r)
    for held in (3, 50, 100_000):
        monkeypatch.setattr(network, "HELD", held)
        code = network.grouped_by_sheet
        # workers import the module anew, so the number goes along with the function
        def parts(batches, held=held):
            network.HELD = held
            return code(b for batch in batches for b in (batch.slice(k, 2) for k in range(0, len(batch), 2)))

        monkeypatch.setattr(network, "grouped_by_sheet", parts)
        got = network.run_sizes(runs, kinds, None, 10.0, checkpointed, 3)
        monkeypatch.setattr(network, "grouped_by_sheet", code)
        assert sorted((tuple(r) for r in got.select("run", "sheet", "group", "dn", "status", "label_confidence").collect()), key=key) == sorted(want, key=key), held


def test_sizes_are_dealt_by_sheet_once(spark, sf_dir):
    with contextlib.redirect_stdout(io.StringIO()) as out:
        network.linked_legs(networks.runs(spark, sf_dir).repartition(5, "sheet"), (F.lit("joint"), F.lit(False)), 10.0).explain()
    assert out.getvalue().count("Exchange") == 1


def test_latest_revisions_are_dealt_by_sheet_once(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(lookup, "PORTION", 200)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        evaluation.latest_revisions(spark, sf_dir).explain()
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    assert out.getvalue().count("Exchange") == 1 and f", {1 + rows // 200})" in out.getvalue() and "Join" not in out.getvalue()


def test_sides_meet_once_with_their_distance(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice("ab"), rnd.randrange(-60, 60) / 100, rnd.randrange(-60, 60) / 100) for i in range(600)]
    p = spark.createDataFrame(rows, "id int, k string, x double, y double")
    near = lookup.near_between(p.filter("id % 2 = 0"), p.filter("id % 2 = 1"), ["k"], "x", "y", "id", 0.05)
    far = lambda a, b: math.hypot(a[2] - b[2], a[3] - b[3])
    want = [(a[1], a[0], b[0]) for a in rows[::2] for b in rows[1::2] if a[1] == b[1] and max(abs(a[2] - b[2]), abs(a[3] - b[3]), far(a, b)) <= 0.05]
    got = near.collect()
    assert len(want) > 200 and sorted((r.k, r.a, r.b) for r in got) == sorted(want)
    assert all(abs(r.distance - far(rows[r.a], rows[r.b])) < 1e-12 for r in got)


def test_greedy_candidates_are_not_looked_up_again(spark, sf_dir, monkeypatch):
    seen = []
    monkeypatch.setattr(lookup, "greedy_matches", lambda df, *_: seen.append(df) or df)
    with contextlib.redirect_stdout(io.StringIO()) as out:
        lookups.greedy_one_to_one(spark, sf_dir).explain()
    joins = sum("Join" in line for line in out.getvalue().splitlines())
    assert len(seen) == 1 and joins == 1 and out.getvalue().count("FileScan") == 2
