"""Takeoff, review and estimate queries that are short compositions of Spark's own operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.operators import lookup, takeoffs
from girder.plans.lookups import BLOCK, nearest
from girder.plans.registry import query
from girder.sources.tables import table


@query("""SELECT p_partkey, CASE p_type WHEN 'SMALL' THEN 'nr' WHEN 'LARGE' THEN 'm' WHEN 'PROMO' THEN 'm' END AS unit FROM part""")
def canonical_units(spark, sf_dir) -> DataFrame:
    """Units by their aliases, null for what can't be quoted."""
    aliases = F.create_map(*[F.lit(x) for pair in {"SMALL": "nr", "LARGE": "m", "PROMO": "m"}.items() for x in pair])
    return table(spark, sf_dir, "part").select("p_partkey", aliases[F.col("p_type")].alias("unit"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'O' AND l_linestatus = 'O' AND l_quantity > 40""")
def live_items(spark, sf_dir) -> DataFrame:
    """Items that are not superseded, of sheets that are current."""
    current = table(spark, sf_dir, "orders").filter("o_orderstatus = 'O'")
    item = table(spark, sf_dir, "lineitem").filter("l_linestatus = 'O' AND l_quantity > 40")
    return item.join(current, F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""WITH q AS (SELECT vec_id, embedding AS e FROM embeddings WHERE vec_id % 100 = 0), c AS (SELECT vec_id AS other, embedding AS f FROM embeddings),
d AS (SELECT vec_id, other, round(list_sum([abs(e[i]::DOUBLE - f[i]::DOUBLE) for i in range(1, 65)]) / 2, 6) AS distance FROM q, c WHERE vec_id <> other),
t AS (SELECT vec_id, min(distance) AS tolerance FROM d GROUP BY vec_id) SELECT vec_id, other, distance FROM d JOIN t USING (vec_id) WHERE distance > tolerance AND distance <= tolerance * 1.1""")
def near_misses(spark, sf_dir) -> DataFrame:
    """Signatures outside the tolerance but within 1.1 times it; the tolerance here is the best match's distance."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    asked = v.filter("vec_id % 100 = 0")
    best = nearest(asked, v).select("vec_id", F.col("distance").alias("tolerance"))
    return within(asked.join(best, "vec_id"), v, 1.1)


def within(asked: DataFrame, legend: DataFrame, reach: float) -> DataFrame:
    """(vec_id, other, distance) of the signatures of legend that are beyond the tolerance of one asked for but within
    reach times it."""

    def compare(ids, vectors, more, others, theirs):
        distance = lookup.half_l1(vectors, theirs)
        limit = np.array(more[0], np.float64)[:, None]
        own = np.array([[a == b for b in others] for a in ids])
        i, j = np.nonzero((distance > limit) & (distance <= limit * reach) & ~own)
        yield pa.RecordBatch.from_arrays([pa.array([ids[k] for k in i]), pa.array([others[k] for k in j]), pa.array(distance[i, j])], names=["vec_id", "other", "distance"])

    kind = legend.schema["vec_id"].dataType.simpleString()
    return lookup.against_all(asked, legend, "vec_id", "embedding", BLOCK, compare, f"vec_id {kind}, other {kind}, distance double", ("tolerance",))


_DRAWN = """d AS (SELECT o_orderkey AS run, o_orderpriority AS level, o_custkey % 20 AS sheet, CASE WHEN o_custkey % 20 % 3 = 0 THEN 1 ELSE 0 END AS rank, o_custkey / 100.0::DOUBLE AS at,
(o_orderkey % 1000) / 1000.0::DOUBLE AS lo, (o_orderkey % 1000) / 1000.0::DOUBLE + o_totalprice / 5000000 AS hi, CASE WHEN o_orderkey % 4 = 1 THEN 25 + o_orderkey % 3 * 7 END AS dn FROM orders)"""


@query(f"""WITH {_DRAWN}, p AS (SELECT o.run, k.run AS kept, k.dn AS kept_dn, o.dn, k.sheet AS kept_sheet, k.rank AS kept_rank, greatest(o.lo, k.lo) AS lo, least(o.hi, k.hi) AS hi, o.hi - o.lo AS length
  FROM d o JOIN d k ON o.level = k.level AND o.sheet <> k.sheet AND (k.rank, k.sheet) < (o.rank, o.sheet) AND abs(o.at - k.at) <= 0.02 AND least(o.hi, k.hi) - greatest(o.lo, k.lo) > 0.02),
c AS (SELECT *, greatest(0, hi - greatest(lo, coalesce(max(hi) OVER (PARTITION BY run ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), lo))) AS adds FROM p)
SELECT run, CAST(count(*) AS BIGINT) AS twins, round(least(sum(adds), min(length)), 6) AS excluded, min_by(kept_sheet, (kept_rank, kept_sheet)) AS kept_sheet,
  CASE WHEN min(dn) IS NULL THEN min_by(kept_dn, (kept_rank, kept_sheet, kept)) FILTER (kept_dn IS NOT NULL) END AS carried_dn FROM c GROUP BY run""")
def duplicate_runs(spark, sf_dir) -> DataFrame:
    """What a level's runs lose to runs drawn along them on other sheets: the length that those cover together, counted
    once, the sheet that is kept (plans before enlarged plans, then the first sheet), and the size it lends to a run
    that states none."""
    o = table(spark, sf_dir, "orders")
    sheet, lo = F.col("o_custkey") % 20, (F.col("o_orderkey") % 1000) / 1000.0
    drawn = o.select(
        F.col("o_orderkey").alias("run"), F.col("o_orderpriority").alias("level"), sheet.alias("sheet"), F.when(sheet % 3 == 0, 1).otherwise(0).alias("rank"), (F.col("o_custkey") / 100.0).alias("at"),
        lo.alias("lo"), (lo + F.col("o_totalprice") / 5000000).alias("hi"), F.when(F.col("o_orderkey") % 4 == 1, 25 + F.col("o_orderkey") % 3 * 7).alias("dn"),
    )
    return takeoffs.duplicate_runs(drawn, 0.02).withColumn("excluded", F.round("excluded", 6))


@query("""WITH p AS (SELECT DISTINCT l_partkey AS shape, l_suppkey AS sheet FROM lineitem)
SELECT shape, sheet, min(sheet) OVER (PARTITION BY shape) AS first_sheet, CAST(count(*) OVER (PARTITION BY shape) AS BIGINT) AS sheets FROM p QUALIFY count(*) OVER (PARTITION BY shape) > 1""")
def duplicate_groups(spark, sf_dir) -> DataFrame:
    """The sheets that share a shape: each with the group's first sheet and its size, and not with each of the others."""
    p = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("shape"), F.col("l_suppkey").alias("sheet")).distinct()
    groups = p.groupBy("shape").agg(F.min("sheet").alias("first_sheet"), F.count("*").alias("sheets")).filter("sheets > 1")
    return p.join(groups, "shape").select("shape", "sheet", "first_sheet", "sheets")


#: Rows of line items in one portion, so that a task's memory does not grow with the table.
PORTION = 1_000_000


@query("""SELECT DISTINCT l_orderkey, l_partkey, l_suppkey FROM lineitem l WHERE EXISTS (SELECT 1 FROM lineitem r WHERE r.l_returnflag = 'R' AND r.l_partkey = l.l_partkey AND r.l_suppkey <> l.l_suppkey)""")
def twins_of_rejections(spark, sf_dir) -> DataFrame:
    """Copies, on other sheets, of what was rejected.  A shape rejected on one sheet has twins on all others, one rejected
    on several has them everywhere: two sheets a shape say which."""
    rows = table(spark, sf_dir, "lineitem")
    # dealt once by shape, with more portions where there are more rows; what follows keeps to that
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + rows.count() // PORTION)
    item = rows.select("l_orderkey", "l_partkey", "l_suppkey", "l_returnflag").repartition(parts, "l_partkey")
    rejected = item.filter("l_returnflag = 'R'").groupBy("l_partkey").agg(F.min("l_suppkey").alias("lo"), F.max("l_suppkey").alias("hi"))
    twins = item.join(rejected, "l_partkey").filter((F.col("lo") != F.col("hi")) | (F.col("l_suppkey") != F.col("lo")))
    return twins.select("l_orderkey", "l_partkey", "l_suppkey").distinct()


@query("""SELECT c_custkey, c_nationkey || '/' || CAST(floor(c_acctbal / 1000) AS BIGINT) || CASE WHEN row_number() OVER w > 1 THEN '#' || row_number() OVER w ELSE '' END AS riser FROM customer WINDOW w AS (PARTITION BY c_nationkey, floor(c_acctbal / 1000) ORDER BY c_custkey)""")
def riser_keys(spark, sf_dir) -> DataFrame:
    """One key a riser: its rounded place, and its ordinal where several stand there."""
    place = F.floor(F.col("c_acctbal") / 1000)
    n = F.row_number().over(Window.partitionBy("c_nationkey", place).orderBy("c_custkey"))
    key = F.concat(F.col("c_nationkey").cast("string"), F.lit("/"), place.cast("string"), F.when(n > 1, F.concat(F.lit("#"), n.cast("string"))).otherwise(""))
    return table(spark, sf_dir, "customer").select("c_custkey", key.alias("riser"))


@query("""WITH b AS (SELECT o_custkey AS bid, count(*) FILTER (WHERE o_orderstatus = 'F') AS good, count(*) AS n, avg(o_orderkey % 30) AS days FROM orders GROUP BY o_custkey)
SELECT CAST(sum(good) AS DOUBLE) / sum(n) AS acceptance, round(avg(days), 6) AS turnaround, CAST(count(*) AS BIGINT) AS bids FROM b""")
def portfolio_kpis(spark, sf_dir) -> DataFrame:
    """Acceptance as a ratio of sums, turnaround as a mean of means."""
    b = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("good"), F.count("*").alias("n"), F.avg(F.col("o_orderkey") % 30).alias("days"))
    return b.agg((F.sum("good") / F.sum("n")).alias("acceptance"), F.round(F.avg("days"), 6).alias("turnaround"), F.count("*").alias("bids"))


@query("""SELECT CASE WHEN p_size % 3 = 0 THEN p_type END AS mapped, CASE WHEN p_size % 3 <> 0 THEN p_brand END AS unmapped, CAST(count(*) AS BIGINT) AS n, min(p_partkey) AS sample FROM part GROUP BY ALL""")
def symbol_counts(spark, sf_dir) -> DataFrame:
    """Counts of confirmed types, and of unmapped shapes with one sample each."""
    p = table(spark, sf_dir, "part")
    known = F.col("p_size") % 3 == 0
    return p.groupBy(F.when(known, F.col("p_type")).alias("mapped"), F.when(~known, F.col("p_brand")).alias("unmapped")).agg(F.count("*").alias("n"), F.min("p_partkey").alias("sample"))


@query("""WITH m AS (SELECT p_type AS kind, CAST(count(*) AS BIGINT) AS manual FROM part WHERE p_size % 10 <> 0 AND p_type <> 'PROMO' GROUP BY 1), a AS (SELECT p_type AS kind, CAST(count(*) AS BIGINT) AS found FROM part WHERE p_size % 9 <> 0 AND p_type <> 'LARGE' GROUP BY 1)
SELECT coalesce(m.kind, a.kind) AS kind, coalesce(manual, 0) AS manual, coalesce(found, 0) AS found FROM m FULL JOIN a ON m.kind = a.kind""")
def manual_against_found(spark, sf_dir) -> DataFrame:
    """Counts by hand against counts found, by kind (two slices of parts)."""
    p = table(spark, sf_dir, "part")
    side = lambda keep, name: p.filter(keep).groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias(name))
    both = side("p_size % 10 <> 0 AND p_type <> 'PROMO'", "manual").join(side("p_size % 9 <> 0 AND p_type <> 'LARGE'", "found"), "kind", "full")
    return both.select("kind", F.coalesce("manual", F.lit(0)).alias("manual"), F.coalesce("found", F.lit(0)).alias("found"))


@query("""SELECT p_partkey, list_filter([CASE WHEN p_size % 4 = 0 THEN 'name' END, CASE WHEN p_size % 6 = 0 THEN 'brand' END, CASE WHEN p_size % 10 = 0 THEN 'type' END], lambda x: x IS NOT NULL) AS missing FROM part WHERE p_brand <> 'Brand#1' AND (p_size % 4 = 0 OR p_size % 6 = 0 OR p_size % 10 = 0)""")
def evidence_completeness(spark, sf_dir) -> DataFrame:
    """Items without a field that evidence must have; rejected ones are excused."""
    hide = lambda name, n: F.when(F.col("p_size") % n != 0, F.col(name))
    p = table(spark, sf_dir, "part").filter("p_brand <> 'Brand#1'").select("p_partkey", hide("p_name", 4).alias("name"), hide("p_brand", 6).alias("brand"), hide("p_type", 10).alias("type"))
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in ("name", "brand", "type")]))
    return p.select("p_partkey", missing.alias("missing")).filter(F.size("missing") > 0)


@query("""SELECT l_partkey, l_returnflag, l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 30 QUALIFY row_number() OVER (PARTITION BY l_partkey, l_returnflag ORDER BY (l_linestatus <> 'F'), l_orderkey, l_linenumber, l_suppkey) = 1""")
def first_places(spark, sf_dir) -> DataFrame:
    """The first place of each kind on a level: a plan before others, then the lowest sheet."""
    item = table(spark, sf_dir, "lineitem").filter("l_quantity > 30")
    return lookup.latest(item, ["l_partkey", "l_returnflag"], F.col("l_linestatus") != "F", "l_orderkey", "l_linenumber", "l_suppkey").select("l_partkey", "l_returnflag", "l_orderkey", "l_linenumber")


@query("""SELECT o_orderkey, CAST(floor((epoch(TIMESTAMP '1998-01-01 12:00:00') - epoch(o_orderdate)) / 86400) * -1 AS BIGINT) AS days FROM orders WHERE o_orderstatus = 'P'""")
def days_until(spark, sf_dir) -> DataFrame:
    """Whole days to a deadline, counted down to the past one."""
    seconds = F.unix_timestamp(F.lit("1998-01-01 12:00:00").cast("timestamp")) - F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").select("o_orderkey", (-F.floor(seconds / 86400)).cast("long").alias("days"))


@query("""WITH s AS (SELECT c_nationkey AS system, c_custkey % 6 AS item, CASE WHEN c_nationkey % 4 = 0 THEN 'ours' WHEN c_nationkey % 4 = 1 THEN CASE WHEN c_acctbal > 0 THEN 'ours' ELSE 'theirs' END WHEN c_nationkey % 4 = 2 THEN 'theirs' END AS status FROM customer), t AS (SELECT s_nationkey AS system, s_suppkey % 6 AS item, count(*) AS n FROM supplier GROUP BY ALL),
g AS (SELECT n_nationkey AS system, i AS item FROM nation, (SELECT unnest(generate_series(0, 5)) AS i)), a AS (SELECT system, item, count(DISTINCT status) AS k, min(status) AS status FROM s GROUP BY ALL)
SELECT g.system, CAST(g.item AS INTEGER) AS item, CASE WHEN a.k = 1 THEN a.status WHEN t.n > 0 THEN 'drawn' ELSE 'open' END AS answer FROM g LEFT JOIN a USING (system, item) LEFT JOIN t USING (system, item)""")
def scope_checklist(spark, sf_dir) -> DataFrame:
    """Each system's checklist: the one clear status, else what the takeoff counts, else open."""
    n = F.col("c_nationkey") % 4
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("system"), (F.col("c_custkey") % 6).cast("int").alias("item"), F.when((n == 0) | ((n == 1) & (F.col("c_acctbal") > 0)), "ours").when(n < 3, "theirs").alias("status"))
    a = s.groupBy("system", "item").agg(F.when(F.min("status") == F.max("status"), F.min("status")).alias("status"))
    t = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("system"), (F.col("s_suppkey") % 6).cast("int").alias("item")).agg(F.count("*").alias("n"))
    grid = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("system"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("item"))
    joined = grid.join(a, ["system", "item"], "left").join(t, ["system", "item"], "left")
    return joined.select("system", "item", F.coalesce("status", F.when(F.col("n") > 0, "drawn"), F.lit("open")).alias("answer"))


@query("""SELECT p_partkey, 'basement' AS risk FROM part WHERE p_name LIKE '%ring%' UNION ALL SELECT p_partkey, 'height' FROM part WHERE p_size > 45 UNION ALL SELECT p_partkey, 'high rise' FROM part WHERE p_partkey % 40 = 39""")
def execution_risks(spark, sf_dir) -> DataFrame:
    """Risks of items by rules on their names, sizes and keys (parts)."""
    rules = {"basement": F.col("p_name").contains("ring"), "height": F.col("p_size") > 45, "high rise": F.col("p_partkey") % 40 == 39}
    risk = F.explode(F.array_compact(F.array(*[F.when(fits, F.lit(name)) for name, fits in rules.items()])))
    return table(spark, sf_dir, "part").select("p_partkey", risk.alias("risk"))


@query("""WITH m AS (SELECT s_suppkey AS entry, s_nationkey AS level, s_suppkey % 4 AS key, 1 + s_nationkey / 100.0::DOUBLE AS factor FROM supplier WHERE s_suppkey % 5 <> 0 UNION ALL SELECT s_suppkey, NULL, s_suppkey % 4, 1.5 FROM supplier WHERE s_suppkey % 5 = 0)
SELECT n_nationkey AS level, key, factor FROM nation JOIN m ON m.level = n_nationkey OR m.level IS NULL QUALIFY row_number() OVER (PARTITION BY n_nationkey, key ORDER BY m.level IS NULL, entry) = 1""")
def multipliers_applied(spark, sf_dir) -> DataFrame:
    """A level's own multiplier before the bid's."""
    s = table(spark, sf_dir, "supplier").withColumn("key", F.col("s_suppkey") % 4)
    level = s.filter("s_suppkey % 5 <> 0").select(F.col("s_nationkey").alias("level"), "key", (1 + F.col("s_nationkey") / F.lit(100.0)).alias("factor"), F.lit(0).alias("rank"), F.col("s_suppkey").alias("entry"))
    bid = s.filter("s_suppkey % 5 = 0").select("key", F.lit(1.5).alias("factor"), F.lit(1).alias("rank"), F.col("s_suppkey").alias("entry"))
    bid = lookup.latest(bid, ["key"], "entry")
    levels = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("level"))
    everywhere = levels.join(bid)  # one row a key, of which there are four
    return lookup.latest(level.unionByName(everywhere), ["level", "key"], "rank", "entry").select("level", "key", "factor")


@query("""WITH g AS (SELECT s_nationkey AS trade, s_suppkey % 3 AS grade, CAST(round(avg(abs(s_acctbal)), 4) AS DECIMAL(18,4)) AS rate FROM supplier GROUP BY ALL) SELECT trade, CAST(round(sum(rate * CASE grade WHEN 0 THEN 50 WHEN 1 THEN 30 ELSE 20 END) / 100 * 1.0, 2) AS DOUBLE) AS hourly FROM g GROUP BY trade HAVING count(*) = 3""")
def trade_rates(spark, sf_dir) -> DataFrame:
    """Rates of trades from their crews' grades; a crew must add up to 100 %."""
    g = table(spark, sf_dir, "supplier").groupBy(F.col("s_nationkey").alias("trade"), (F.col("s_suppkey") % 3).alias("grade")).agg(F.round(F.avg(F.abs("s_acctbal")), 4).cast("decimal(18,4)").alias("rate"))
    share = F.when(F.col("grade") == 0, 50).when(F.col("grade") == 1, 30).otherwise(20)
    crew = g.groupBy("trade").agg(F.sum(F.col("rate") * share).alias("sum"), F.sum(share).alias("share")).filter("share = 100")
    return crew.select("trade", F.round(F.col("sum") / 100, 2).cast("double").alias("hourly"))


@query("""WITH e AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 50 AS b FROM orders WHERE o_orderstatus = 'F'), f AS (SELECT DISTINCT o_custkey AS a, o_orderkey % 50 AS b FROM orders WHERE o_totalprice > 250000)
SELECT CAST((SELECT count(*) FROM (SELECT * FROM e INTERSECT SELECT * FROM f)) AS DOUBLE) / (SELECT count(*) FROM e) AS found_rate""")
def duplicate_rate(spark, sf_dir) -> DataFrame:
    """The share of expected duplicate pairs that were flagged."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("a"), (F.col("o_orderkey") % 50).alias("b"), "o_orderstatus", "o_totalprice")
    expected, flagged = o.filter("o_orderstatus = 'F'").select("a", "b").distinct(), o.filter("o_totalprice > 250000").select("a", "b", F.lit(1).alias("hit")).distinct()
    return expected.join(flagged, ["a", "b"], "left").agg((F.count("hit") / F.count("*")).alias("found_rate"))


@query("""WITH t AS (SELECT p_partkey AS k, p_brand AS number, p_type AS revision, p_size AS status FROM part), p AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 11 = 0 THEN 'x' ELSE p_brand END AS number, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_type END AS revision, CASE WHEN p_partkey % 5 = 0 THEN 0 ELSE p_size END AS status FROM part WHERE p_partkey % 13 <> 0)
SELECT avg(coalesce(t.number = p.number AND t.revision = p.revision AND t.status = p.status, false)::INT) AS sheets, avg(coalesce(t.number = p.number, false)::INT) AS numbers, avg(coalesce(t.revision = p.revision, false)::INT) AS revisions FROM t LEFT JOIN p USING (k)""")
def sheet_classification(spark, sf_dir) -> DataFrame:
    """Sheets whose number, revision and status are all right, and numbers and revisions by themselves."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    said = p.filter("p_partkey % 13 <> 0").select("p_partkey", F.when(k % 11 == 0, "x").otherwise(F.col("p_brand")).alias("number"), F.when(k % 7 != 0, F.col("p_type")).alias("revision"), F.when(k % 5 == 0, 0).otherwise(F.col("p_size")).alias("status"))
    right = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("int"))
    number, revision, status = F.col("p_brand") == F.col("number"), F.col("p_type") == F.col("revision"), F.col("p_size") == F.col("status")
    return p.join(said, "p_partkey", "left").agg(right(number & revision & status).alias("sheets"), right(number).alias("numbers"), right(revision).alias("revisions"))


@query("""WITH e AS (SELECT c_custkey AS fact, round(c_acctbal, 0) AS v FROM customer WHERE c_custkey % 9 <> 0), a AS (SELECT c_custkey AS fact, round(c_acctbal, 0) + CASE WHEN c_custkey % 4 = 0 THEN 3 ELSE 0 END AS v FROM customer WHERE c_custkey % 8 <> 0)
SELECT CASE WHEN a.fact IS NULL THEN 'missing' WHEN e.fact IS NULL THEN 'extra' WHEN abs(a.v - e.v) <= greatest(1, abs(e.v) * 0.001::DOUBLE) THEN 'same' ELSE 'wrong' END AS state, CAST(count(*) AS BIGINT) AS facts FROM e FULL JOIN a ON e.fact = a.fact GROUP BY 1""")
def golden_differences(spark, sf_dir) -> DataFrame:
    """Facts of a package that are missing, extra, or off by more than a tolerance (absolute or relative)."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("fact"), F.round("c_acctbal", 0).alias("v"))
    e = c.filter("fact % 9 <> 0").withColumnRenamed("v", "e")
    a = c.filter("fact % 8 <> 0").select("fact", (F.col("v") + F.when(F.col("fact") % 4 == 0, 3).otherwise(0)).alias("a"))
    near = F.abs(F.col("a") - F.col("e")) <= F.greatest(F.lit(1.0), F.abs("e") * 0.001)
    state = F.when(F.col("a").isNull(), "missing").when(F.col("e").isNull(), "extra").when(near, "same").otherwise("wrong")
    return e.join(a, "fact", "full").groupBy(state.alias("state")).agg(F.count("*").alias("facts"))


@query("""SELECT sha256(text) AS sha256, min(doc_id) AS doc_id, CAST(count(*) AS BIGINT) AS copies FROM documents GROUP BY 1""")
def content_hashes(spark, sf_dir) -> DataFrame:
    """Uploads by the hash of their content, the first of each kept."""
    return table(spark, sf_dir, "documents").groupBy(F.sha2("text", 256).alias("sha256")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("""SELECT user_id, CAST(max(ts) AS DATE) AS last_day, CAST(count(*) AS BIGINT) AS beats, bool_or(event_type = 'purchase') AS bought FROM events GROUP BY user_id""")
def heartbeat_upserts(spark, sf_dir) -> DataFrame:
    """The newest heartbeat of each name, as repeated upserts leave it."""
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max("ts").cast("date").alias("last_day"), F.count("*").alias("beats"), F.max(F.col("event_type") == "purchase").alias("bought"))
