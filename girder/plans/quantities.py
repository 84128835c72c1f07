"""Takeoff quantities, versions and audit chains over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.operators import quantity, versions
from girder.plans.registry import query
from girder.sources.tables import table


@query("""SELECT l_returnflag AS kind, l_linestatus AS level, CAST(l_linenumber AS INTEGER) AS zone, CAST(count(*) AS BIGINT) AS quantity, min(l_discount + 0) AS confidence, min(l_orderkey) AS first_member FROM lineitem GROUP BY ALL""")
def counted_items(spark, sf_dir) -> DataFrame:
    """Items counted by kind and place, with their least confidence (line items as detections)."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("kind"), F.col("l_linestatus").alias("level"), F.col("l_linenumber").alias("zone"), "l_orderkey", (F.col("l_discount") + 0).alias("confidence"))
    return quantity.items(d, ["kind"], ["level", "zone"], "l_orderkey", "confidence").drop("item_key")


@query("""SELECT l_returnflag, l_linestatus, CAST(count(*) AS BIGINT) AS quantity, min(l_discount + 0) AS confidence, min(l_orderkey) AS first_member,
substring(sha256('{"l_returnflag":"' || l_returnflag || '","l_linestatus":"' || l_linestatus || '"}'), 1, 24) AS item_key FROM lineitem GROUP BY l_returnflag, l_linestatus""")
def item_keys(spark, sf_dir) -> DataFrame:
    """Items with the hash of what they are and where, which row ids do not enter."""
    d = table(spark, sf_dir, "lineitem").withColumn("confidence", F.col("l_discount") + 0)
    return quantity.items(d, ["l_returnflag"], ["l_linestatus"], "l_orderkey", "confidence")


@query("""SELECT p_type, CAST(sum(greatest(p_size * 137 - CASE WHEN p_size % 3 = 0 THEN 500 ELSE 0 END, 0)) AS BIGINT) AS length_mm, sum(greatest(p_size * 137 - CASE WHEN p_size % 3 = 0 THEN 500 ELSE 0 END, 0)) / 1000::DOUBLE AS metres,
CAST(ceil(sum(greatest(p_size * 137 - CASE WHEN p_size % 3 = 0 THEN 500 ELSE 0 END, 0)) / 6000::DOUBLE) - 1 + 2 AS BIGINT) AS couplings, CAST(ceil(sum(greatest(p_size * 137 - CASE WHEN p_size % 3 = 0 THEN 500 ELSE 0 END, 0)) / 3700::DOUBLE) AS BIGINT) AS supports FROM part GROUP BY p_type""")
def pipe_lengths(spark, sf_dir) -> DataFrame:
    """Metres of each type, with the couplings and supports that its length takes."""
    p = table(spark, sf_dir, "part").select("p_type", (F.col("p_size") * 137).alias("mm"), F.when(F.col("p_size") % 3 == 0, 500).alias("excluded"))
    rolled = quantity.length_rollup(p, ["p_type"], "mm", "excluded")
    return rolled.select("p_type", "length_mm", F.col("metres").cast("double").alias("metres"), quantity.couplings(F.col("length_mm"), F.lit(2)).alias("couplings"), quantity.supports(F.col("length_mm"), F.lit(3700)).alias("supports"))


@query("""SELECT s_suppkey, CAST(greatest(0, round_even(3000.5 - s_nationkey * 100.0::DOUBLE - 250, 0)) AS BIGINT) AS drop_mm FROM supplier""")
def drops(spark, sf_dir) -> DataFrame:
    """Lengths of drops from ceiling heights and levels (suppliers)."""
    s = table(spark, sf_dir, "supplier")
    return s.select("s_suppkey", quantity.drop_mm(F.lit(3000.5), F.col("s_nationkey") * 100.0, F.lit(250.0)).alias("drop_mm"))


@query("""SELECT p_partkey, CAST(round_even(CAST(p_size AS DECIMAL(14,3)) * 102.5 / 100, 3) AS DOUBLE) AS quantity FROM part WHERE p_size % 2 = 0""")
def allowances(spark, sf_dir) -> DataFrame:
    """Quantities with an allowance of 2.5 percent (parts of even size, which stand for items that take one)."""
    p = table(spark, sf_dir, "part").filter("p_size % 2 = 0")
    return p.select("p_partkey", quantity.adjusted(F.col("p_size").cast("decimal(14,3)"), F.lit("2.5").cast("decimal(5,1)")).cast("double").alias("quantity"))


@query("""WITH e AS (SELECT l_suppkey AS network, l_partkey % 20 AS node, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40 UNION ALL SELECT l_suppkey, 100 + l_orderkey % 20, p_size FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity > 40)
SELECT network, node, CAST(count(*) AS BIGINT) AS degree, CASE WHEN count(*) >= 3 THEN 'tee' ELSE 'reducer' END AS fitting FROM e GROUP BY network, node HAVING count(*) >= 3 OR count(*) = 2 AND max(p_size) <> min(p_size)""")
def network_fittings(spark, sf_dir) -> DataFrame:
    """Tees and reducers of pipe networks by the number and sizes of runs at a node (line items over 40 pieces, as
    all of them would join every node to every other)."""
    e = table(spark, sf_dir, "lineitem").filter("l_quantity > 40").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    e = e.select(F.col("l_suppkey").alias("network"), (F.col("l_partkey") % 20).alias("a"), (100 + F.col("l_orderkey") % 20).alias("b"), "p_size")
    return quantity.fittings(e, "network", "a", "b", "p_size").select("network", "node", "degree", "fitting")


@query("""WITH p AS (SELECT user_id, event_id, value AS x, hash_k AS y FROM (SELECT *, CAST(props->>'k' AS DOUBLE) AS hash_k FROM events)),
t AS (SELECT user_id, event_id, x - lag(x) OVER w AS bx, y - lag(y) OVER w AS by_, lead(x) OVER w - x AS ax, lead(y) OVER w - y AS ay FROM p WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, event_id, round(degrees(abs(atan2(bx * ay - by_ * ax, bx * ax + by_ * ay))), 6) AS turn FROM t WHERE degrees(abs(atan2(bx * ay - by_ * ax, bx * ax + by_ * ay))) > 150""")
def path_turns(spark, sf_dir) -> DataFrame:
    """Points where a user's path turns by more than 150 degrees (event values as coordinates)."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.col("value").alias("x"), F.get_json_object("props", "$.k").cast("double").alias("y"))
    return quantity.elbows(e, "user_id", "event_id", "x", "y", 150.0).select("user_id", "event_id", F.round("turn", 6).alias("turn"))


@query("""WITH g AS (SELECT p_type AS section, p_brand AS description, CAST(sum(p_size) AS BIGINT) AS quantity, CASE WHEN min(spare) = max(spare) THEN min(spare) END AS allowance FROM (SELECT *, CASE WHEN p_type = 'PROMO' THEN p_size % 2 ELSE 5 END AS spare FROM part) GROUP BY ALL)
SELECT section, description, quantity, allowance, chr(CAST(64 + dense_rank() OVER (ORDER BY section) AS INTEGER)) || row_number() OVER (PARTITION BY section ORDER BY description) AS item FROM g""")
def bill_of_quantities(spark, sf_dir) -> DataFrame:
    """Lines of a bill by section, numbered A1, A2, B1; allowances stay where all items agree (parts)."""
    p = table(spark, sf_dir, "part").select(F.col("p_type").alias("section"), F.col("p_brand").alias("description"), "p_size", F.when(F.col("p_type") == "PROMO", F.col("p_size") % 2).otherwise(5).alias("spare"))
    return quantity.bill_lines(p, "section", ["description"], "p_size", "spare").select("section", "description", "quantity", "allowance", "item")


@query("""SELECT p_partkey, coalesce(CASE WHEN p_size % 4 = 0 THEN p_name END, CASE WHEN p_size % 3 = 0 THEN p_brand END, 'not specified') AS resolved FROM part""")
def resolved_attributes(spark, sf_dir) -> DataFrame:
    """An attribute as drawn, else as specified if specifications agree (parts)."""
    p = table(spark, sf_dir, "part")
    drawn, spec = F.when(F.col("p_size") % 4 == 0, F.col("p_name")), F.when(F.col("p_size") % 3 == 0, F.col("p_brand"))
    return p.select("p_partkey", quantity.resolve(drawn, F.array(spec, spec)).alias("resolved"))


@query("""WITH s AS (SELECT DISTINCT o_custkey AS k, o_custkey % 7 AS h FROM orders WHERE o_orderstatus = 'F'), d AS (SELECT DISTINCT o_custkey AS k, o_custkey % 14 AS h FROM orders WHERE o_orderstatus = 'O')
SELECT coalesce(s.k, d.k) AS k, CASE WHEN s.k IS NULL THEN 'create' WHEN d.k IS NULL THEN 'supersede' WHEN s.h = d.h THEN 'keep' ELSE 'replace' END AS action FROM s FULL JOIN d ON s.k = d.k""")
def idempotent_recompute(spark, sf_dir) -> DataFrame:
    """What a second computation adds, changes or leaves, by keys and hashes (orders of two states)."""
    o = table(spark, sf_dir, "orders")
    side = lambda status, m: o.filter(F.col("o_orderstatus") == status).select(F.col("o_custkey").alias("k"), (F.col("o_custkey") % m).alias("h")).distinct()
    return versions.recompute(side("F", 7), side("O", 14), "k", "h")


@query("""SELECT c_custkey, c_mktsegment AS source, CASE WHEN c_mktsegment = 'BUILDING' AND c_nationkey < 10 THEN NULL WHEN c_mktsegment = 'BUILDING' THEN 'role may not' ELSE 'no such step' END AS problem FROM customer""")
def state_transitions(spark, sf_dir) -> DataFrame:
    """Whether a change of state is allowed to a role (customers' segments and nations)."""
    c = table(spark, sf_dir, "customer").withColumn("target", F.lit("closed")).withColumn("role", F.when(F.col("c_nationkey") < 10, "lead").otherwise("guest"))
    return versions.transitions(c, [("BUILDING", "closed", "lead")], "c_mktsegment", "target", "role").select("c_custkey", F.col("c_mktsegment").alias("source"), "problem")


@query("""WITH RECURSIVE e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, sha256(event_id || '|' || event_type || '|' || coalesce(props, '~')) AS body FROM events),
c(user_id, seq, hash) AS (SELECT user_id, seq, sha256(':' || body) FROM e WHERE seq = 1 UNION ALL SELECT e.user_id, e.seq, sha256(c.hash || ':' || e.body) FROM c JOIN e ON e.user_id = c.user_id AND e.seq = c.seq + 1)
SELECT user_id, CAST(seq AS INTEGER) AS seq, hash FROM c""")
def audit_chain(spark, sf_dir) -> DataFrame:
    """The hash chain of each user's events, in order."""
    e = table(spark, sf_dir, "events")
    return versions.linked(versions.chain(e, "user_id", ["ts", "event_id"], ["event_id", "event_type", "props"]), "user_id").select("user_id", "seq", "hash")


@query("""SELECT user_id, CAST(seq AS INTEGER) AS seq, 'own hash differs' AS reason FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM events) WHERE seq = 3""")
def audit_chain_problems(spark, sf_dir) -> DataFrame:
    """Rows of a chain that was tampered with which do not follow from the row before."""
    e = versions.chain(table(spark, sf_dir, "events"), "user_id", ["ts", "event_id"], ["event_id", "event_type", "props"])
    bad = versions.linked(e, "user_id").withColumn("body_hash", F.when(F.col("seq") == 3, F.lit("0")).otherwise(F.col("body_hash")))
    return versions.chain_problems(bad, "user_id").select("user_id", "seq", "reason")


@query("""SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS INTEGER) AS version,
CAST(ts AS DATE) AS valid_from, CAST(lead(ts) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS DATE) AS valid_to FROM events""")
def version_lineage(spark, sf_dir) -> DataFrame:
    """Versions of each user's events of one type, and from when to when each was valid."""
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.row_number().over(w).alias("version"), F.col("ts").cast("date").alias("valid_from"), F.lead("ts").over(w).cast("date").alias("valid_to"))


@query("""SELECT user_id, date_trunc('minute', ts) AS minute, CAST(count(*) AS BIGINT) AS calls, least(count(*), 1)::BIGINT AS admitted FROM events GROUP BY ALL""")
def rate_buckets(spark, sf_dir) -> DataFrame:
    """Calls of each key and minute, and how many the cap of one a minute admits."""
    buckets = table(spark, sf_dir, "events").groupBy("user_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("minute")).agg(F.count("*").alias("calls"))
    return buckets.withColumn("admitted", F.least("calls", F.lit(1)).cast("long"))
