"""As-of, band, range, proximity and best-match lookups over the supplied tables."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators import lookup
from girder.operators.checkpoints import checkpointed
from girder.plans.registry import query
from girder.sources.tables import table


@query("""WITH r AS (SELECT event_id, user_id AS ccy, CAST(ts AS DATE) AS since, value AS rate FROM events WHERE event_type = 'purchase'),
r1 AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY ccy, since ORDER BY event_id DESC) = 1)
SELECT q.event_id, q.user_id AS ccy, r1.rate, r1.since FROM (SELECT * FROM events WHERE event_type = 'view') q LEFT JOIN r1 ON r1.ccy = q.user_id AND r1.since <= CAST(q.ts AS DATE)
QUALIFY row_number() OVER (PARTITION BY q.event_id ORDER BY r1.since DESC NULLS LAST) = 1""")
def fx_rates(spark, sf_dir) -> DataFrame:
    """The newest rate of a currency on or before a day (null if there is none yet)."""
    e = table(spark, sf_dir, "events")
    rates = e.filter("event_type = 'purchase'").select("event_id", F.col("user_id").alias("ccy"), F.col("ts").cast("date").alias("since"), F.col("value").alias("rate"))
    rates = lookup.latest(rates, ["ccy", "since"], F.desc("event_id")).select("ccy", "since", "rate")
    asked = e.filter("event_type = 'view'").select("event_id", F.col("user_id").alias("ccy"), F.col("ts").cast("date").alias("day"))
    # currencies are few: each week of one is a part of its own
    week = lambda day: F.date_trunc("week", day)
    return lookup.as_of(asked, rates, ["ccy"], "day", "since", ["event_id"], bucket=week).select("event_id", "ccy", "rate", "since")


@query("""WITH p(since, policy) AS (VALUES (DATE '1996-01-01', 'one'), (DATE '1998-06-01', 'two'), (DATE '2000-01-01', 'three'))
SELECT o_orderkey, coalesce((SELECT max_by(policy, since) FROM p WHERE since <= CAST(o_orderdate AS DATE)), (SELECT min_by(policy, since) FROM p)) AS policy FROM orders""")
def policy_in_force(spark, sf_dir) -> DataFrame:
    """The newest policy in force, or the earliest for days before all of them."""
    known = [("1996-01-01", "one"), ("1998-06-01", "two"), ("2000-01-01", "three")]
    day = F.col("o_orderdate").cast("date")
    policy = F.lit(known[0][1])
    for since, name in known:
        policy = F.when(day >= F.lit(since).cast("date"), name).otherwise(policy)
    return table(spark, sf_dir, "orders").select("o_orderkey", policy.alias("policy"))


@query("""SELECT p_partkey, CASE WHEN p_size <= 5 THEN 'low' WHEN p_size <= 20 THEN 'mid' WHEN p_size <= 35 THEN 'high' ELSE 'high' END AS height, CASE WHEN p_size = 13 THEN 1500 WHEN p_size <= 10 THEN 1500 WHEN p_size <= 25 THEN 2400 WHEN p_size <= 40 THEN 3000 ELSE 3700 END AS spacing FROM part""")
def bands(spark, sf_dir) -> DataFrame:
    """Height bands, of which the last is open, and support spacings, of which the least serves unknown sizes."""
    p = table(spark, sf_dir, "part")
    size = F.nullif(F.col("p_size"), F.lit(13))
    spacing = F.coalesce(lookup.in_band(size, [(10, 1500), (25, 2400), (40, 3000), (10**9, 3700)]), F.lit(1500))
    return p.select("p_partkey", lookup.in_band(p.p_size, [(5, "low"), (20, "mid"), (35, "high")]).alias("height"), spacing.alias("spacing"))


@query("""WITH v AS (SELECT p_brand AS system, CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END AS lo, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size + 3 END AS hi, p_type AS given FROM part WHERE p_partkey % 2 = 0),
n AS (SELECT p_partkey AS n, p_brand AS system, p_size AS lo, p_size + 1 AS hi, p_type AS noted FROM part WHERE p_partkey % 2 = 1),
j AS (SELECT n.n, n.noted, v.given FROM v JOIN n ON v.system = n.system AND coalesce(v.lo, -1e9) <= n.hi AND n.lo <= coalesce(v.hi, 1e9))
SELECT n, CAST(count(*) AS BIGINT) AS governing FROM j GROUP BY n HAVING NOT bool_or(noted = given)""")
def range_conflicts(spark, sf_dir) -> DataFrame:
    """Notes whose size range meets specified values of their system, none of which agrees.

    Values that state the same are one row with their number.  The values that a note meets are counted in order of all
    ends, once for the system and once for what the note says, and a note disagrees if the second count is none."""
    p = table(spark, sf_dir, "part").withColumnRenamed("p_brand", "system")
    v = p.filter("p_partkey % 2 = 0").select("system", F.when(F.col("p_size") % 7 != 0, F.col("p_size")).alias("lo"), F.when(F.col("p_size") % 5 != 0, F.col("p_size") + 3).alias("hi"), F.col("p_type").alias("said"))
    v = v.groupBy("system", "lo", "hi", "said").agg(F.count("*").alias("times"))
    n = p.filter("p_partkey % 2 = 1").select(F.col("p_partkey").alias("n"), "system", F.col("p_size").alias("lo"), (F.col("p_size") + 1).alias("hi"), F.col("p_type").alias("said"))
    asked = n.withColumnRenamed("n", "note")
    governing = lookup.overlap_counts(asked, v, ["system"], "note", "times").withColumnRenamed("n", "governing")
    agreeing = lookup.overlap_counts(asked, v, ["system", "said"], "note", "times")
    return governing.join(agreeing, "note", "left_anti").select(F.col("note").alias("n"), "governing")


_POINTS = "SELECT l_orderkey * 1000003 + l_partkey * 1009 + l_suppkey * 11 + l_linenumber AS id, l_returnflag AS kind, l_discount * 10 + l_tax AS x, CAST(l_partkey AS DOUBLE) / 97 + l_quantity / 100 AS y FROM lineitem"


@query(f"""WITH p AS ({_POINTS}), q AS (SELECT *, unnest(generate_series(CAST(floor(y * 20) AS BIGINT) - 1, CAST(floor(y * 20) AS BIGINT) + 1)) AS cell FROM p)
SELECT a.id AS a, b.id AS b FROM q a JOIN p b ON a.kind = b.kind AND a.cell = CAST(floor(b.y * 20) AS BIGINT) AND a.id < b.id AND abs(a.x - b.x) <= 0.03 AND abs(a.y - b.y) <= 0.03""")
def near_detections(spark, sf_dir) -> DataFrame:
    """Pairs of detections of one kind within 0.03 on both axes (points that line items are read as)."""
    return lookup.near_pairs(points(spark, sf_dir), ["kind"], "x", "y", "id", 0.03)


def points(spark, sf_dir) -> DataFrame:
    ident = F.col("l_orderkey") * 1000003 + F.col("l_partkey") * 1009 + F.col("l_suppkey") * 11 + F.col("l_linenumber")
    y = F.col("l_partkey").cast("double") / 97 + F.col("l_quantity") / 100
    return table(spark, sf_dir, "lineitem").select(ident.alias("id"), F.col("l_returnflag").alias("kind"), (F.col("l_discount") * 10 + F.col("l_tax")).alias("x"), y.alias("y"))


_RUNS = "SELECT o_orderkey AS id, o_orderpriority AS axis, o_custkey / 100.0::DOUBLE AS at, (o_orderkey % 1000) / 1000.0::DOUBLE AS lo, (o_orderkey % 1000) / 1000.0::DOUBLE + o_totalprice / 5000000 AS hi FROM orders"


@query(f"WITH r AS ({_RUNS}) SELECT a.id AS a, b.id AS b, round(least(a.hi, b.hi) - greatest(a.lo, b.lo), 9) AS shared FROM r a JOIN r b ON a.axis = b.axis AND a.id < b.id AND abs(a.at - b.at) <= 0.025 AND least(a.hi, b.hi) - greatest(a.lo, b.lo) > 0.025")
def overlapping_runs(spark, sf_dir) -> DataFrame:
    """Pairs of runs on nearly one line that share some of their extents (orders as runs)."""
    o = table(spark, sf_dir, "orders")
    lo = (F.col("o_orderkey") % 1000) / F.lit(1000.0)
    runs = o.select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("axis"), (F.col("o_custkey") / F.lit(100.0)).alias("at"), lo.alias("lo"), (lo + F.col("o_totalprice") / 5000000).alias("hi"))
    return lookup.overlapping_runs(runs, ["axis"], "id", "at", "lo", "hi", 0.025).select("a", "b", F.round("shared", 9).alias("shared"))


@query()
def greedy_one_to_one(spark, sf_dir) -> DataFrame:
    """Symbols of two revisions within 0.05 of each other, matched one to one by ascending distance."""
    p = points(spark, sf_dir).withColumn("y", F.round("y", 6))
    # the old revision's side is a; the sides meet each other only, and pairs come with their distance
    near = lookup.near_between(p.filter("id % 2 = 0"), p.filter("id % 2 <> 0"), ["kind"], "x", "y", "id", 0.05).withColumnRenamed("kind", "sheet")
    return lookup.greedy_matches(near.select("sheet", "a", "b", "distance"), "sheet", checkpointed)


#: Signatures asked for that go to the tasks at once (64 numbers each: 2 MB).
BLOCK = 4096


def nearest(asked: DataFrame, legend: DataFrame) -> DataFrame:
    """(vec_id, other, distance): the nearest other signature of each one asked for, the smallest id among equals."""

    def compare(ids, vectors, _, others, theirs):
        distance = lookup.half_l1(vectors, theirs)
        own, at = {}, np.argsort(np.array(others), kind="stable")
        distance, others = distance[:, at], [others[k] for k in at]
        for k, o in enumerate(others):
            own.setdefault(o, []).append(k)
        for i, a in enumerate(ids):
            distance[i, own.get(a, [])] = np.inf
        best = distance.argmin(axis=1)
        keep = [i for i in range(len(ids)) if np.isfinite(distance[i, best[i]])]
        yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in keep]), pa.array([others[best[i]] for i in keep]), pa.array([distance[i, best[i]] for i in keep], pa.float64())], names=["vec_id", "other", "distance"])

    kind = legend.schema["vec_id"].dataType.simpleString()
    found = lookup.against_all(asked, legend, "vec_id", "embedding", BLOCK, compare, f"vec_id {kind}, other {kind}, distance double")
    best = found.groupBy("vec_id").agg(F.min(F.struct("distance", "other")).alias("m"))
    return best.select("vec_id", F.col("m.other").alias("other"), F.col("m.distance").alias("distance"))


@query("""WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id AS other, embedding AS f FROM embeddings)
SELECT vec_id, other, round(d, 6) AS distance FROM (SELECT vec_id, other, list_sum([abs(e[i]::DOUBLE - f[i]::DOUBLE) for i in range(1, 65)]) / 2 AS d FROM q, c WHERE vec_id <> other)
QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY round(d, 6), other) = 1""")
def nearest_signature(spark, sf_dir) -> DataFrame:
    """The nearest of all other signatures for each of a stated set of queries, which meet all rows block by block."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(v.filter("vec_id % 100 = 0"), v)


@query("""WITH d AS (SELECT array_to_string([round(x, 1) + 0 for x in embedding], ',') AS digest, label, vec_id FROM embeddings),
m AS (SELECT digest, min(label) AS label FROM d GROUP BY digest) SELECT d.vec_id, m.label AS matched FROM d JOIN m USING (digest)""")
def shapes_matched_once(spark, sf_dir) -> DataFrame:
    """Distinct shapes are matched once, by all their coordinates to a tenth, and the result spread to all instances."""
    shape = F.transform(F.col("embedding").cast("array<float>"), lambda x: F.round(x, 1))
    v = table(spark, sf_dir, "embeddings").select("vec_id", "label", shape.alias("shape"))
    matched = v.groupBy("shape").agg(F.min("label").alias("matched"))
    return v.join(matched, "shape").select("vec_id", "matched")


@query("""WITH r AS (SELECT p_partkey AS entry, p_brand AS brand, p_type AS kind, CAST(p_retailprice AS DECIMAL(14,2)) AS rate, DATE '1995-01-01' + CAST(p_partkey % 900 AS INTEGER) AS since, p_size % 3 AS source FROM part)
SELECT p_partkey, entry, CAST(rate AS DOUBLE) AS rate FROM part JOIN r ON brand = p_brand AND kind = p_type AND since <= DATE '1997-01-01'
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY since DESC, source, entry) = 1""")
def exact_rates(spark, sf_dir) -> DataFrame:
    """The rate entry with an item's key and unit: the newest in force, then the preferred source.  The best entry of a key
    is the same for all its items, so keys are reduced to it before they meet the items."""
    p = table(spark, sf_dir, "part")
    r = p.select(F.col("p_partkey").alias("entry"), "p_brand", "p_type", F.col("p_retailprice").cast("decimal(14,2)").alias("rate"), F.date_add(F.lit("1995-01-01").cast("date"), (F.col("p_partkey") % 900).cast("int")).alias("since"), (F.col("p_size") % 3).alias("source"))
    age = F.datediff(F.lit("1997-01-01").cast("date"), "since")
    best = r.filter(age >= 0).groupBy("p_brand", "p_type").agg(F.min(F.struct(age.alias("age"), "source", "entry", "rate")).alias("best"))
    found = p.select("p_partkey", "p_brand", "p_type").join(best, ["p_brand", "p_type"])
    return found.select("p_partkey", "best.entry", F.col("best.rate").cast("double").alias("rate"))


@query("""SELECT a.p_partkey AS item, CAST(count(*) AS BIGINT) AS candidates, min_by(b.p_partkey, (CASE WHEN a.p_size = b.p_size THEN 0 ELSE 1 END, b.p_partkey)) AS entry
FROM part a JOIN part b ON a.p_type = b.p_type AND a.p_name = b.p_name AND a.p_brand <> b.p_brand AND (a.p_size = b.p_size OR b.p_size % 10 = 0) GROUP BY 1""")
def partial_rates(spark, sf_dir) -> DataFrame:
    """Candidates of the same type whose size agrees or is silent, without the equal ones: their number and the best, one
    of the item's own size before a silent one.  Items and entries meet as what they state, not one by one."""
    p = table(spark, sf_dir, "part")
    stated = p.groupBy("p_type", "p_name", F.col("p_brand").alias("brand2"), F.col("p_size").alias("size2")).agg(F.count("*").alias("times"), F.min("p_partkey").alias("entry"))
    asked = p.select("p_type", "p_name", "p_brand", "p_size").distinct()
    met = asked.join(stated, ["p_type", "p_name"]).filter((F.col("p_brand") != F.col("brand2")) & ((F.col("p_size") == F.col("size2")) | (F.col("size2") % 10 == 0)))
    best = F.min(F.struct(F.col("p_size") != F.col("size2"), "entry"))["entry"]
    found = met.groupBy("p_type", "p_name", "p_brand", "p_size").agg(F.sum("times").alias("candidates"), best.alias("entry"))
    return p.join(found, ["p_type", "p_name", "p_brand", "p_size"]).select(F.col("p_partkey").alias("item"), "candidates", "entry")


@query("""WITH e AS (SELECT p_partkey AS entry, p_type, CASE WHEN p_partkey % 3 <> 0 THEN p_size END AS dn, CASE WHEN p_partkey % 2 = 0 THEN p_brand END AS joining FROM part)
SELECT p_partkey, entry, score FROM (SELECT p.p_partkey, entry, 4 + CASE WHEN dn IS NOT NULL THEN 2 ELSE 0 END + CASE WHEN joining IS NOT NULL THEN 1 ELSE 0 END AS score
FROM part p JOIN e ON e.p_type = p.p_type AND coalesce(dn, p.p_size) = p.p_size AND coalesce(joining, p.p_brand) = p.p_brand)
QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY score DESC, entry) = 1""")
def most_specific(spark, sf_dir) -> DataFrame:
    """The entry that agrees in most of what it states; among equals the smallest id."""
    p = table(spark, sf_dir, "part")
    e = p.select(F.col("p_partkey").alias("entry"), "p_type", F.when(F.col("p_partkey") % 3 != 0, F.col("p_size")).alias("dn"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_brand")).alias("joining"))
    return lookup.most_specific(p.select("p_partkey", "p_type", "p_size", "p_brand"), e, ["p_type"], [("p_size", "dn", 2), ("p_brand", "joining", 1)], "entry", 4).select("p_partkey", "entry", "score")


@query("""WITH m AS (SELECT p_partkey AS measured, p_type, p_size, p_brand FROM part WHERE p_partkey % 2 = 1), c AS (SELECT p_partkey AS client, p_type, p_size, p_brand FROM part WHERE p_partkey % 2 = 0)
SELECT client, min(measured) AS measured, 0.9::DOUBLE AS confidence FROM c JOIN m USING (p_type, p_size, p_brand) GROUP BY client HAVING count(*) = 1""")
def unique_matches(spark, sf_dir) -> DataFrame:
    """Client lines with one measured candidate; ambiguous ones are left open."""
    p = table(spark, sf_dir, "part")
    m, c = p.filter("p_partkey % 2 = 1").withColumnRenamed("p_partkey", "measured"), p.filter("p_partkey % 2 = 0").withColumnRenamed("p_partkey", "client")
    # the measured side is counted first, so keys with many of them don't meet the clients
    sole = m.groupBy("p_type", "p_size", "p_brand").agg(F.count("*").alias("n"), F.min("measured").alias("measured")).filter("n = 1")
    return c.join(sole, ["p_type", "p_size", "p_brand"]).select("client", "measured", F.lit(0.9).alias("confidence"))


@query("""WITH lv AS (SELECT user_id, max_by(value, (ts, event_id)) AS v FROM events WHERE event_type = 'view' GROUP BY user_id), bid AS (SELECT max_by(value, (ts, event_id)) AS v FROM events WHERE event_type = 'signup')
SELECT c_custkey, coalesce(lv.v, bid.v, 2750) AS value, CASE WHEN lv.v IS NOT NULL THEN 'level' WHEN bid.v IS NOT NULL THEN 'bid' ELSE 'default' END AS source FROM customer LEFT JOIN lv ON user_id = c_custkey CROSS JOIN bid""")
def parameter_values(spark, sf_dir) -> DataFrame:
    """The value stated last for a level, else for the bid, else the rule's default."""
    e = table(spark, sf_dir, "events")
    newest = F.max_by("value", F.struct("ts", "event_id"))
    level = e.filter("event_type = 'view'").groupBy(F.col("user_id").alias("c_custkey")).agg(newest.alias("level"))
    bid = e.filter("event_type = 'signup'").agg(newest.alias("bid"))
    rows = table(spark, sf_dir, "customer").join(level, "c_custkey", "left").join(F.broadcast(bid))  # one row
    source = F.when(F.col("level").isNotNull(), "level").when(F.col("bid").isNotNull(), "bid").otherwise("default")
    return rows.select("c_custkey", F.coalesce("level", "bid", F.lit(2750.0)).alias("value"), source.alias("source"))


@query("""SELECT a.s_suppkey AS a, a.s_nationkey AS line, CAST(lead AS DOUBLE) AS spacing FROM (SELECT s_suppkey, s_nationkey, lead(s_acctbal) OVER (PARTITION BY s_nationkey ORDER BY s_acctbal, s_suppkey) - s_acctbal AS lead FROM supplier) a WHERE lead > 0""")
def neighbour_spacings(spark, sf_dir) -> DataFrame:
    """Distances of adjacent lines or levels, the positive ones."""
    from pyspark.sql import Window

    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal", "s_suppkey")
    s = table(spark, sf_dir, "supplier").withColumn("spacing", F.lead("s_acctbal").over(w) - F.col("s_acctbal")).filter("spacing > 0")
    return s.select(F.col("s_suppkey").alias("a"), F.col("s_nationkey").alias("line"), "spacing")


@query("""WITH s AS (SELECT l_orderkey AS pair, CAST(l_quantity AS DOUBLE) AS d FROM lineitem) SELECT pair, avg(d) AS spacing FROM s GROUP BY pair HAVING max(d) - min(d) <= 0.3 * max(d)""")
def agreed_spacings(spark, sf_dir) -> DataFrame:
    """Pairs of lines whose known distances agree; disputed pairs drop out."""
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("pair")).agg(F.avg("l_quantity").alias("spacing"), F.max("l_quantity").alias("hi"), F.min("l_quantity").alias("lo"))
    return s.filter("hi - lo <= 0.3 * hi").select("pair", "spacing")


@query("""SELECT CAST(count(DISTINCT l_partkey) + count(DISTINCT l_suppkey) AS BIGINT) AS nodes FROM lineitem""")
def network_nodes(spark, sf_dir) -> DataFrame:
    """How many nodes the network of parts and suppliers has."""
    e = edges(spark, sf_dir)
    return e.agg((F.countDistinct("a") + F.countDistinct("b")).alias("nodes"))


def edges(spark, sf_dir) -> DataFrame:
    """Parts and suppliers as the nodes of a network; suppliers have the negative numbers."""
    return table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), (-1 - F.col("l_suppkey")).alias("b")).distinct()


@query()
def network_components(spark, sf_dir) -> DataFrame:
    """The smallest node that each node of a network is connected with (tests compare with a plain search)."""
    return lookup.components(edges(spark, sf_dir), checkpointed)
