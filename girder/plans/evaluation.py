"""Metrics of predictions, reviews and runs over the supplied tables."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators import metrics
from girder.operators.checkpoints import checkpointed
from girder.plans.registry import query
from girder.sources.tables import table

_COUNTS = "SELECT l_suppkey AS sheet, l_returnflag AS kind, CAST(count(*) AS BIGINT) AS n FROM lineitem WHERE l_linenumber {} GROUP BY ALL"
_BOTH = f"WITH t AS ({_COUNTS.format('<= 4')}), p AS ({_COUNTS.format('BETWEEN 3 AND 6')})"


def counts(spark, sf_dir) -> DataFrame:
    """True and predicted counts of each sheet and kind: two slices of the line items."""
    item = table(spark, sf_dir, "lineitem")
    side = lambda keep, name: item.filter(keep).groupBy(F.col("l_suppkey").alias("sheet"), F.col("l_returnflag").alias("kind")).agg(F.count("*").alias(name))
    return side("l_linenumber <= 4", "t").join(side("l_linenumber BETWEEN 3 AND 6", "p"), ["sheet", "kind"], "left")


@query(f"{_BOTH} SELECT t.sheet, t.kind, greatest(0.0, 1 - abs(coalesce(p.n, 0) - t.n) / t.n::DOUBLE) AS accuracy FROM t LEFT JOIN p USING (sheet, kind)")
def count_accuracy(spark, sf_dir) -> DataFrame:
    """Accuracy of counts by sheet and kind: two slices of the line items are truth and prediction."""
    return counts(spark, sf_dir).select("sheet", "kind", metrics.count_accuracy(F.col("t"), F.col("p")).alias("accuracy"))


@query(f"{_BOTH} SELECT t.sheet, CASE WHEN t.kind <> 'N' THEN abs(coalesce(p.n, 0) - t.n) / t.n::DOUBLE END AS error, CASE WHEN t.kind = 'N' THEN 'not to scale' END AS reason, t.kind FROM t LEFT JOIN p USING (sheet, kind)")
def length_errors(spark, sf_dir) -> DataFrame:
    """Relative errors of lengths by sheet; those of kind N are not to scale and have none."""
    ok = F.col("kind") != "N"
    return counts(spark, sf_dir).select("sheet", metrics.length_error(F.col("t"), F.col("p"), ok).alias("error"), F.when(~ok, "not to scale").alias("reason"), "kind")


@query(f"{_BOTH} SELECT t.kind, sum(greatest(t.n - coalesce(p.n, 0), 0)) / sum(t.n)::DOUBLE AS missed_rate, sum(greatest(coalesce(p.n, 0) - t.n, 0)) / nullif(sum(coalesce(p.n, 0)), 0)::DOUBLE AS false_rate FROM t LEFT JOIN p USING (sheet, kind) GROUP BY t.kind")
def missed_and_false(spark, sf_dir) -> DataFrame:
    """Rates of missed and of falsely found items by kind."""
    return metrics.miss_and_excess(counts(spark, sf_dir), "t", "p", "kind")


@query(f"""{_BOTH}, v AS (SELECT t.kind, t.sheet % 3 AS consultant, CASE WHEN t.kind <> 'N' THEN CAST(abs(coalesce(p.n, 0) - t.n) AS DOUBLE) END AS v FROM t LEFT JOIN p USING (sheet, kind))
SELECT kind, consultant, avg(v) AS mean, CAST(count(v) AS BIGINT) AS n, CAST(count(*) - count(v) AS BIGINT) AS excluded, CAST(count(*) - count(v) AS BIGINT) AS not_to_scale FROM v GROUP BY GROUPING SETS ((), (kind), (consultant))""")
def suite_summary(spark, sf_dir) -> DataFrame:
    """Overall, by class and by consultant, in one pass."""
    v = counts(spark, sf_dir).withColumn("consultant", F.col("sheet") % 3).withColumn("v", F.when(F.col("kind") != "N", F.abs(F.coalesce("p", F.lit(0)) - F.col("t")).cast("double")))
    v = v.withColumn("reason", F.when(F.col("v").isNull(), "not to scale"))
    return metrics.summary(v, "v", "reason", [[], ["kind"], ["consultant"]])


@query("""WITH s AS (SELECT event_type, list_sort(list(value)) AS v FROM events GROUP BY event_type) SELECT event_type, v[greatest(1, CAST(round_even(len(v) * 0.5::DOUBLE, 0) AS INTEGER))] AS p50, v[greatest(1, CAST(round_even(len(v) * 0.95::DOUBLE, 0) AS INTEGER))] AS p95 FROM s""")
def nearest_rank_percentiles(spark, sf_dir) -> DataFrame:
    """Median and 95th percentile of each event type's values, as values that occur."""
    return metrics.nearest_ranks(table(spark, sf_dir, "events"), "event_type", "value", {"p50": 0.5, "p95": 0.95}, checkpointed)


_OUT = "SELECT (doc_id % 101) / 100.0::DOUBLE AS confidence, quality = 1 AS correct FROM labels"


def outcomes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(((F.col("doc_id") % 101) / F.lit(100.0)).alias("confidence"), (F.col("quality") == 1).alias("correct"))


_BIN = "(confidence >= 0.1::DOUBLE)::INT + (confidence >= 0.2::DOUBLE)::INT + (confidence >= 0.3::DOUBLE)::INT + (confidence >= 0.4::DOUBLE)::INT + (confidence >= 0.5::DOUBLE)::INT + (confidence >= 0.6::DOUBLE)::INT + (confidence >= 0.7::DOUBLE)::INT + (confidence >= 0.8::DOUBLE)::INT + (confidence >= 0.9::DOUBLE)::INT"


@query(f"WITH o AS ({_OUT}) SELECT {_BIN} AS bin, CAST(count(*) AS BIGINT) AS n, round(avg(confidence), 6) AS confidence, avg(correct::INT) AS accuracy FROM o GROUP BY ALL")
def reliability_bins(spark, sf_dir) -> DataFrame:
    """Mean confidence and accuracy in ten bins of confidence."""
    return metrics.reliability(outcomes(spark, sf_dir), "confidence", "correct").withColumn("confidence", F.round("confidence", 6))


@query(f"WITH o AS ({_OUT}), b AS (SELECT {_BIN} AS bin, count(*) AS n, avg(confidence) AS c, avg(correct::INT) AS a FROM o GROUP BY ALL) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS calibration_error FROM b")
def calibration_error(spark, sf_dir) -> DataFrame:
    """Mean distance of confidence and accuracy over the bins, weighted by their counts."""
    return metrics.calibration_error(metrics.reliability(outcomes(spark, sf_dir), "confidence", "correct")).select(F.round("calibration_error", 6).alias("calibration_error"))


@query()
def calibrated_scores(spark, sf_dir) -> DataFrame:
    """Scores through an isotonic fit of the labels; scores are rounded to a thousandth, so the fit has 1001 points at most."""
    o = outcomes(spark, sf_dir)
    fit = metrics.isotonic([(r.score, r.accuracy, r.weight) for r in metrics.pooled(o, "confidence", "correct").collect()])
    return o.withColumn("calibrated", metrics.interpolated(F.col("confidence"), fit))


_FAMILIES = """o AS (SELECT l_returnflag AS family, CAST(CAST(l_quantity AS INT) * 2 AS BIGINT) AS percent, CAST(l_quantity AS INT) * 2 / 100.0::DOUBLE AS raw,
CAST((CAST(floor(l_extendedprice) AS BIGINT) % 100 < CAST(l_quantity AS INT) * 3 // 2 + 10) AS INT) AS correct, l_orderkey % 3 = 0 AS held FROM lineitem),
w AS (SELECT family, percent, count(*) AS n, sum(correct) AS k FROM o WHERE NOT held GROUP BY ALL),
s AS (SELECT *, sum(n) OVER (PARTITION BY family ORDER BY percent) AS cn, sum(k) OVER (PARTITION BY family ORDER BY percent) AS ck FROM w),
ab AS (SELECT a.family, a.percent AS a, b.percent AS b, (b.ck - a.ck + a.k) / CAST(b.cn - a.cn + a.n AS DOUBLE) AS mean FROM s a JOIN s b ON a.family = b.family AND b.percent >= a.percent),
least AS (SELECT family, a, b, min(mean) OVER (PARTITION BY family, a ORDER BY b DESC) AS low FROM ab),
fit AS (SELECT family, b AS percent, round(max(low), 6) AS fitted FROM least GROUP BY ALL)"""
_HELD_BIN = " + ".join(f"({{0}} >= {i / 10}::DOUBLE)::INT" for i in range(1, 10))
_HELD_ERROR = "(SELECT family, sum(n * abs(c - a)) / sum(n) AS e FROM (SELECT family, {1} AS bin, count(*) AS n, avg({0}) AS c, avg(correct) AS a FROM t GROUP BY ALL) GROUP BY family)"


@query(f"""WITH {_FAMILIES}, t AS (SELECT o.*, fitted FROM o LEFT JOIN fit USING (family, percent) WHERE held)
SELECT family, CAST(count(*) FILTER (NOT held) AS BIGINT) AS train, CAST(count(*) FILTER (held) AS BIGINT) AS holdout, round(avg(correct) FILTER (held), 6) AS accuracy, round(min(r.e), 6) AS raw_error, round(min(f.e), 6) AS error
FROM o JOIN {_HELD_ERROR.format("raw", _HELD_BIN.format("raw"))} r USING (family) JOIN {_HELD_ERROR.format("fitted", _HELD_BIN.format("fitted"))} f USING (family) GROUP BY family""")
def calibration_holdout(spark, sf_dir) -> DataFrame:
    """How well scores are calibrated on held-out items, before and after an isotonic fit to the others of their family.
    (The SQL states the fit as the largest of least means: over stretches that begin up to a score and end behind it.)"""
    i, n = table(spark, sf_dir, "lineitem"), F.col("l_quantity").cast("int")
    right = F.col("l_extendedprice").cast("long") % 100 < F.expr("CAST(l_quantity AS INT) * 3 div 2 + 10")
    rows = i.select(F.col("l_returnflag").alias("family"), (n * 2 / F.lit(100.0)).alias("raw"), right.alias("correct"), (F.col("l_orderkey") % 3 == 0).alias("held"))
    found = metrics.holdout_report(rows, "family", "raw", "correct", "held")
    return found.select("family", "train", "holdout", *[F.round(c, 6).alias(c) for c in ("accuracy", "raw_error", "error")])


@query()
def sampling_plans(spark, sf_dir) -> DataFrame:
    """The least review sample of each lot size that finds a 5 % share of wrong items with 95 % confidence."""
    lots = table(spark, sf_dir, "orders").groupBy("o_orderpriority").count()

    def plan(batches):
        for frame in batches:
            frame["sample"] = [metrics.smallest_sample(n, max(1, -(-n // 20)), 0, Fraction(95, 100)) for n in frame["count"]]
            yield frame

    return lots.mapInPandas(plan, "o_orderpriority string, count long, sample long")


@query("""WITH c AS (SELECT l_partkey AS sheet, l_orderkey AS id, l_returnflag AS series, l_linenumber AS number, CAST(l_shipdate AS DATE) AS day FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_partkey, l_orderkey ORDER BY l_linenumber, l_returnflag, l_shipdate) = 1),
w AS (SELECT a.sheet, a.id, bool_and(b.id IS NULL OR coalesce(CASE WHEN a.series = b.series THEN a.number > b.number ELSE a.day > b.day END, b.id IS NULL)) AS wins FROM c a LEFT JOIN c b ON a.sheet = b.sheet AND a.id <> b.id GROUP BY ALL)
SELECT s.sheet, w.id FROM (SELECT DISTINCT sheet FROM c) s LEFT JOIN w ON s.sheet = w.sheet AND wins""")
def latest_revisions(spark, sf_dir) -> DataFrame:
    """The revision that is later than every other of its sheet, or none where that is undecided."""
    from girder.operators.lookup import latest, portions

    items = table(spark, sf_dir, "lineitem")
    c = items.select(F.col("l_partkey").alias("sheet"), F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("series"), F.col("l_linenumber").alias("number"), F.col("l_shipdate").cast("date").alias("day"))
    # dealt once by sheet, with more portions where there are more rows; what follows keeps to that
    c = latest(c.repartition(portions(items), "sheet"), ["sheet", "id"], "number", "series", "day")
    return metrics.latest_by_order(c, "sheet", "id", "series", "number", "day")


@query("""WITH b AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY 1), r AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE ts >= TIMESTAMP '2024-01-16' AND event_type <> 'signup' GROUP BY 1)
SELECT b.metric, round(b.v, 6) AS was, round(r.v, 6) AS now, CASE WHEN r.v IS NULL THEN 'missing' ELSE 'worse' END AS reason FROM b LEFT JOIN r USING (metric)
WHERE r.v IS NULL OR CASE WHEN b.metric = 'purchase' THEN b.v - r.v ELSE r.v - b.v END > 0.5""")
def regression_gate(spark, sf_dir) -> DataFrame:
    """Metrics that got worse than a base (means of event values before and after a day)."""
    e = table(spark, sf_dir, "events")
    mean = lambda keep: e.filter(keep).groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("v"))
    base = mean("ts < '2024-01-16'").withColumn("higher", F.col("metric") == "purchase")
    out = metrics.regressions(base, mean("ts >= '2024-01-16' AND event_type <> 'signup'"), "metric", "v", "higher", 0.5)
    return out.select("metric", F.round("was", 6).alias("was"), F.round("now", 6).alias("now"), "reason")


@query("""SELECT source, CAST(count(*) AS BIGINT) AS items, CAST(count(quality) AS BIGINT) AS decided, count(*) FILTER (WHERE quality = 1) / count(*)::DOUBLE AS verified, CAST(sum(CASE WHEN quality = 1 THEN n_chars END) AS DOUBLE) / sum(n_chars) AS verified_value FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def verified_coverage(spark, sf_dir) -> DataFrame:
    """The share verified by count and by value; rows nobody decided on count as not verified."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    ok = F.col("quality") == 1
    return d.groupBy("source").agg(F.count("*").alias("items"), F.count("quality").alias("decided"), (F.count_if(ok) / F.count("*")).alias("verified"), (F.sum(F.when(ok, F.col("n_chars"))) / F.sum("n_chars")).alias("verified_value"))


@query("""SELECT toxic, count(*) FILTER (WHERE quality = 0) / nullif(count(*), 0)::DOUBLE AS false_rate, CAST(count(*) AS BIGINT) AS n FROM labels GROUP BY toxic""")
def review_kpis(spark, sf_dir) -> DataFrame:
    """Share of rejected items among reviewed ones, by kind (labels)."""
    labels = table(spark, sf_dir, "labels")
    return labels.groupBy("toxic").agg(F.try_divide(F.count_if(F.col("quality") == 0), F.count("*")).alias("false_rate"), F.count("*").alias("n"))


@query("""WITH a AS (SELECT c_custkey AS k, c_nationkey AS v FROM customer), b AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_nationkey END AS v FROM customer)
SELECT CAST(count(*) AS BIGINT) AS n, avg((a.v IS NOT DISTINCT FROM b.v)::INT) AS accuracy FROM a LEFT JOIN b USING (k)""")
def mapping_accuracy(spark, sf_dir) -> DataFrame:
    """Mappings right by value, none against none included."""
    c = table(spark, sf_dir, "customer")
    a = c.select("c_custkey", F.col("c_nationkey").alias("a"))
    b = c.select("c_custkey", F.when(F.col("c_custkey") % 3 != 0, F.col("c_nationkey")).alias("b"))
    return a.join(b, "c_custkey", "left").agg(F.count("*").alias("n"), F.avg(F.col("a").eqNullSafe(F.col("b")).cast("int")).alias("accuracy"))
