import random

from girder.operators import metrics
from girder.operators.checkpoints import checkpointed
from girder.plans import catalog


def test_nearest_ranks(spark):
    rnd = random.Random(3)
    rows = [("a", rnd.choice([None, rnd.gauss(0, 1), float(rnd.randrange(5))])) for _ in range(3001)]
    rows += [("b", 1.5)] * 400 + [("b", 2.5)] * 400 + [(None, 4.0), (None, 3.0), ("none", None), ("one", 7.0)]
    got = {r.g: (r.p0, r.p50, r.p95) for r in metrics.nearest_ranks(spark.createDataFrame(rows, "g string, v double").repartition(5), "g", "v", {"p0": 0.0, "p50": 0.5, "p95": 0.95}, checkpointed).collect()}
    want = {}
    for g in {g for g, _ in rows}:
        v = sorted(x for h, x in rows if h == g and x is not None)
        want[g] = tuple(v[max(1, round(len(v) * p)) - 1] if v else None for p in (0.0, 0.5, 0.95))
    assert got == want


def test_percentiles_hold_no_group_in_an_array(spark, sf_dir):
    plan = catalog.QUERIES["nearest_rank_percentiles"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan


def test_tax_without_a_rate_is_an_error(spark):
    import pytest

    from girder.operators import costing

    rates = spark.sql("SELECT 'a' AS k, DATE '2020-01-01' AS since, CAST(7 AS DECIMAL(6,3)) AS percent")
    totals = spark.sql("SELECT * FROM VALUES (1, 'a', DATE '2020-01-01', 10.05), (2, 'a', DATE '2021-05-01', 0.50) AS t(id, k, day, total)")
    got = costing.with_tax(totals, rates, ["k"], "day", "total", ["id"]).orderBy("id").collect()
    assert [(str(r.tax), str(r.inclusive)) for r in got] == [("0.70", "10.75"), ("0.04", "0.54")]
    early = totals.unionAll(spark.sql("SELECT 3, 'a', DATE '2019-12-31', 1.00"))
    with pytest.raises(Exception, match="no tax rate"):
        costing.with_tax(early, rates, ["k"], "day", "total", ["id"]).collect()
