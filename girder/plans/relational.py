"""Filters, equi-joins, aggregates, pages and set operations over the supplied tables.

Events stand for audit events, orders and line items for bills and their lines,
parts for the rate library, customers for members of a bid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.operators import lookup, versions
from girder.plans.registry import query
from girder.sources.tables import table


@query("""SELECT event_id, user_id, event_type, value FROM events
WHERE event_type IN ('error', 'purchase') AND props ILIKE '%"K": 7%' AND ts >= TIMESTAMP '2024-01-05' AND ts < TIMESTAMP '2024-01-20' AND value BETWEEN 5 AND 100""")
def audit_filter(spark, sf_dir) -> DataFrame:
    """Optional criteria, all of which must hold: equality, range and a substring in any case."""
    e = table(spark, sf_dir, "events")
    wanted = e.event_type.isin("error", "purchase") & e.props.ilike('%"K": 7%') & (e.ts >= "2024-01-05") & (e.ts < "2024-01-20") & e.value.between(5, 100)
    return e.filter(wanted).select("event_id", "user_id", "event_type", "value")


@query("SELECT p_partkey, p_name, p_type FROM part WHERE p_type LIKE 'S%' AND p_brand IS DISTINCT FROM 'Brand#4' AND p_size NOT IN (1, 2, 3)")
def prefix_and_distinct(spark, sf_dir) -> DataFrame:
    """Rows by a prefix, a null-safe difference and a list of exclusions."""
    p = table(spark, sf_dir, "part")
    return p.filter(p.p_type.startswith("S") & ~p.p_brand.eqNullSafe(F.lit("Brand#4")) & ~p.p_size.isin(1, 2, 3)).select("p_partkey", "p_name", "p_type")


@query("""SELECT event_id, user_id, event_type FROM events
WHERE (ts, event_id) < (SELECT (ts, event_id) FROM events ORDER BY ts DESC, event_id DESC OFFSET 100 LIMIT 1) ORDER BY ts DESC, event_id DESC LIMIT 51""")
def keyset_page(spark, sf_dir) -> DataFrame:
    """The page after a cursor, newest first, with one row more to tell whether another follows."""
    e = table(spark, sf_dir, "events")
    order = [F.desc("ts"), F.desc("event_id")]
    cursor = e.orderBy(*order).offset(100).limit(1).first()
    after = F.struct("ts", "event_id") < F.struct(F.lit(cursor.ts).cast("timestamp_ntz").alias("ts"), F.lit(cursor.event_id).alias("event_id")) if cursor else F.lit(False)
    return e.filter(after).orderBy(*order).limit(51).select("event_id", "user_id", "event_type")


@query("""SELECT event_id, CAST(props->>'k' AS BIGINT) AS k FROM events
WHERE CAST(props->>'k' AS BIGINT) IN (SELECT p_size FROM part WHERE p_brand = 'Brand#7')""")
def json_semi_join(spark, sf_dir) -> DataFrame:
    """Events whose JSON field is among the sizes of a brand."""
    e = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    sizes = table(spark, sf_dir, "part").filter("p_brand = 'Brand#7'").select(F.col("p_size").cast("long").alias("k"))
    return e.join(sizes, "k", "left_semi").select("event_id", "k")


@query("""SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer, nation WHERE c_nationkey = n_nationkey AND n_regionkey = 2)""")
def member_rows(spark, sf_dir) -> DataFrame:
    """Rows of those bids only whose members the caller is among."""
    n = table(spark, sf_dir, "nation").filter("n_regionkey = 2")
    mine = table(spark, sf_dir, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left_semi")
    return table(spark, sf_dir, "orders").join(mine, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("o_orderkey", "o_custkey")


@query("SELECT vec_id, label FROM embeddings WHERE label IN (1, 3, 5) AND embedding[1] BETWEEN -0.1 AND 0.1 AND embedding[2] BETWEEN -0.1 AND 0.2")
def box_and_kind(spark, sf_dir) -> DataFrame:
    """Vectors of some kinds whose first two coordinates are in a box."""
    v = table(spark, sf_dir, "embeddings")
    return v.filter(v.label.isin(1, 3, 5) & v.embedding[0].between(-0.1, 0.1) & v.embedding[1].between(-0.1, 0.2)).select("vec_id", "label")


@query("""SELECT l_orderkey, l_linenumber, l_suppkey, l_partkey, CASE WHEN l_linestatus = 'F' THEN l_quantity END AS measured,
CASE WHEN l_linestatus <> 'F' THEN 'scale not verified' END AS reason FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45""")
def measured_if_verified(spark, sf_dir) -> DataFrame:
    """A measure only where the scale is verified; else null, with the reason."""
    item = table(spark, sf_dir, "lineitem").filter("l_returnflag = 'R' AND l_quantity > 45")
    ok = F.col("l_linestatus") == "F"
    return item.select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", F.when(ok, F.col("l_quantity")).alias("measured"), F.when(~ok, "scale not verified").alias("reason"))


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, l_extendedprice FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE CAST(l_extendedprice AS DECIMAL(14,2)) <> CAST(CAST(l_quantity AS DECIMAL(14,3)) * CAST(p_retailprice AS DECIMAL(14,2)) AS DECIMAL(14,2)) AND l_quantity >= 49""")
def price_integrity(spark, sf_dir) -> DataFrame:
    """Amounts that are not quantity times rate."""
    item, part = table(spark, sf_dir, "lineitem").filter("l_quantity >= 49"), table(spark, sf_dir, "part")
    due = F.round(F.col("l_quantity").cast("decimal(14,3)") * F.col("p_retailprice").cast("decimal(14,2)"), 2).cast("decimal(14,2)")
    bad = item.join(part, F.col("l_partkey") == F.col("p_partkey")).filter(F.col("l_extendedprice").cast("decimal(14,2)") != due)
    return bad.select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")


@query("""SELECT o_orderkey, c_name, n_name, o_orderstatus FROM orders JOIN customer ON o_custkey = c_custkey LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) n ON c_nationkey = n_nationkey
WHERE o_orderdate >= DATE '2000-01-01'""")
def register(spark, sf_dir) -> DataFrame:
    """Revisions with their sheet and, where there is one, the addendum."""
    o = table(spark, sf_dir, "orders").filter("o_orderdate >= '2000-01-01'")
    n = table(spark, sf_dir, "nation").filter("n_regionkey < 3")
    joined = o.join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return joined.select("o_orderkey", "c_name", "n_name", "o_orderstatus")


_MONTH = "SELECT user_id AS item, CAST(count(*) AS BIGINT) AS quantity FROM events WHERE event_type <> 'error' AND ts {} TIMESTAMP '2024-01-16' AND event_type {} GROUP BY user_id"


@query(f"""WITH w AS ({_MONTH.format('<', "IN ('view', 'purchase')")}), n AS ({_MONTH.format('>=', "IN ('view', 'click')")})
SELECT coalesce(w.item, n.item) AS item, w.quantity AS was_quantity, n.quantity AS now_quantity,
  CASE WHEN w.item IS NULL THEN 'added' WHEN n.item IS NULL THEN 'removed' WHEN w.quantity IS NOT DISTINCT FROM n.quantity THEN 'unchanged' ELSE 'changed' END AS change
FROM w FULL JOIN n ON w.item = n.item""")
def delta_report(spark, sf_dir) -> DataFrame:
    """A takeoff against its baseline; rejected rows are dropped on either side first."""
    e = table(spark, sf_dir, "events").filter("event_type <> 'error'")
    count = lambda df: df.groupBy(F.col("user_id").alias("item")).agg(F.count("*").alias("quantity"))
    was = count(e.filter("ts < '2024-01-16' AND event_type IN ('view', 'purchase')"))
    now = count(e.filter("ts >= '2024-01-16' AND event_type IN ('view', 'click')"))
    return versions.delta(was, now, "item", ["quantity"])


@query("""WITH c AS (SELECT c_custkey AS ref, c_nationkey AS place FROM customer WHERE c_acctbal > 0), m AS (SELECT o_custkey AS ref, CAST(count(*) AS BIGINT) AS n FROM orders WHERE o_orderstatus = 'P' GROUP BY o_custkey)
SELECT c.ref, CASE WHEN m.ref IS NULL THEN 'client_only' ELSE 'mapped' END AS state, n FROM c LEFT JOIN m ON c.ref = m.ref
UNION ALL SELECT m.ref, 'measured_only', n FROM m WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.ref = m.ref)""")
def reconciliation(spark, sf_dir) -> DataFrame:
    """Client lines with what was measured for them, and measured lines that nobody mapped."""
    c = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").alias("ref"))
    m = table(spark, sf_dir, "orders").filter("o_orderstatus = 'P'").groupBy(F.col("o_custkey").alias("ref")).agg(F.count("*").alias("n"))
    left = c.join(m, "ref", "left").select("ref", F.when(F.col("n").isNull(), "client_only").otherwise("mapped").alias("state"), "n")
    return left.unionByName(m.join(c, "ref", "left_anti").select("ref", F.lit("measured_only").alias("state"), "n"))


@query("""SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey) AND NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_mktsegment = 'BUILDING')""")
def untraced_lines(spark, sf_dir) -> DataFrame:
    """Lines with neither an item that has evidence nor a marker."""
    o = table(spark, sf_dir, "orders")
    marked = table(spark, sf_dir, "customer").filter("c_mktsegment = 'BUILDING'")
    bare = o.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return bare.join(marked, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("o_orderkey")


@query("""SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber FROM lineitem WHERE l_extendedprice > 0 AND l_tax = 0 AND trim(coalesce(nullif(l_returnflag, 'N'), ' ')) = ''""")
def unsourced_lines(spark, sf_dir) -> DataFrame:
    """Amounts without a rate whose allowance has a blank name."""
    blank = F.trim(F.coalesce(F.nullif(F.col("l_returnflag"), F.lit("N")), F.lit(" "))) == ""
    return table(spark, sf_dir, "lineitem").filter((F.col("l_extendedprice") > 0) & (F.col("l_tax") == 0) & blank).select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")


@query("""SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1""")
def latest_versions(spark, sf_dir) -> DataFrame:
    """The newest event of each user and type."""
    e = table(spark, sf_dir, "events")
    return lookup.latest(e, ["user_id", "event_type"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_type", "event_id", "value")


@query("""SELECT user_id, event_id, event_type = 'error' AS deprecated FROM events WHERE ts <= TIMESTAMP '2024-01-10' QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def library_as_of(spark, sf_dir) -> DataFrame:
    """The version of each entry that was current at a time; deprecated ones stay, flagged."""
    e = table(spark, sf_dir, "events").filter("ts <= '2024-01-10'")
    return lookup.latest(e, ["user_id"], F.desc("ts"), F.desc("event_id")).select("user_id", "event_id", (F.col("event_type") == "error").alias("deprecated"))


@query("""SELECT role, turn, CAST(count(*) AS BIGINT) AS runs, CAST(sum(length(text)) AS BIGINT) AS cost FROM conversations GROUP BY role, turn""")
def run_statistics(spark, sf_dir) -> DataFrame:
    """Runs and their cost by role and turn (lengths of conversation texts as cost)."""
    return table(spark, sf_dir, "conversations").groupBy("role", "turn").agg(F.count("*").alias("runs"), F.sum(F.length("text")).alias("cost"))


@query("""SELECT event_type, CAST(count(*) AS BIGINT) AS calls, CAST(count(*) FILTER (WHERE value < 10) AS BIGINT) AS hits, CAST(sum(CAST(value AS DECIMAL(14,2))) AS DOUBLE) AS cost FROM events GROUP BY event_type""")
def conditional_counts(spark, sf_dir, by: str = "event_type") -> DataFrame:
    """Counts with a filter of their own; the grouping column is chosen when the query is made."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(by).agg(F.count("*").alias("calls"), F.count_if(F.col("value") < 10).alias("hits"), F.sum(F.col("value").cast("decimal(14,2)")).cast("double").alias("cost"))


@query("""SELECT event_type AS area, CAST(count(DISTINCT (user_id, date_trunc('minute', ts))) AS BIGINT) AS minutes, CAST(count(DISTINCT user_id) AS BIGINT) AS users, CAST(count(*) AS BIGINT) AS beats FROM events GROUP BY event_type""")
def time_on_task(spark, sf_dir) -> DataFrame:
    """Minutes in which a user was active: a minute counts once, however often it was noted."""
    e = table(spark, sf_dir, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    return e.groupBy(F.col("event_type").alias("area")).agg(F.countDistinct("user_id", "minute").alias("minutes"), F.countDistinct("user_id").alias("users"), F.count("*").alias("beats"))


@query("""SELECT * FROM (SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT user_id FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '2024-01-29'))""")
def retention(spark, sf_dir) -> DataFrame:
    """What stays when all rows of jobs that ended before a day are deleted."""
    e = table(spark, sf_dir, "events")
    old = e.groupBy("user_id").agg(F.max("ts").alias("last")).filter("last < '2024-01-29'")
    return e.join(old, "user_id", "left_anti").select("event_id", "user_id")


@query("""SELECT CAST(count(*) AS BIGINT) AS n, CAST(coalesce(sum(CAST(o_totalprice AS DECIMAL(14,2))), 0) AS DOUBLE) AS spend, CAST(min(o_orderdate) AS DATE) AS first_day, CAST(max(o_orderdate) AS DATE) AS last_day FROM orders WHERE o_orderstatus = 'F'""")
def spend(spark, sf_dir) -> DataFrame:
    """Number, sum and first and last day of finished orders."""
    o = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'")
    return o.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("o_totalprice").cast("decimal(14,2)")), F.lit(0)).cast("double").alias("spend"), F.min("o_orderdate").cast("date").alias("first_day"), F.max("o_orderdate").cast("date").alias("last_day"))


@query("""WITH s AS (SELECT unnest(['O', 'F', 'P', 'X']) AS state) SELECT state, CAST(count(o_orderkey) AS BIGINT) AS n, CAST(count(CASE WHEN o_totalprice > 200000 THEN 1 END) AS BIGINT) AS large FROM s LEFT JOIN orders ON o_orderstatus = state GROUP BY state""")
def progress(spark, sf_dir) -> DataFrame:
    """Counts by state, with zero for states that no row has."""
    states = spark.createDataFrame([(s,) for s in "OFPX"], "state string")
    counts = table(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("state")).agg(F.count("*").alias("n"), F.count_if(F.col("o_totalprice") > 200000).alias("large"))
    return states.join(counts, "state", "left").select("state", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("large", F.lit(0)).alias("large"))


@query("""SELECT o_orderkey, CAST(rank AS BIGINT) AS rank FROM (SELECT o_orderkey, row_number() OVER (ORDER BY (o_orderstatus = 'F'), CAST(o_totalprice AS DECIMAL(14,2)) DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 200""")
def risk_queue(spark, sf_dir) -> DataFrame:
    """Undecided first, then by value at risk; a capped list in order (the cap is the page's size)."""
    o = table(spark, sf_dir, "orders")
    top = o.select("o_orderkey", (F.col("o_orderstatus") == "F").alias("decided"), F.col("o_totalprice").cast("decimal(14,2)").alias("risk")).orderBy("decided", F.desc("risk"), "o_orderkey").limit(200)
    return top.select("o_orderkey", F.row_number().over(Window.orderBy("decided", F.desc("risk"), "o_orderkey")).cast("long").alias("rank"))


@query("""WITH a AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'R'), b AS (SELECT DISTINCT l_partkey AS p FROM lineitem WHERE l_returnflag = 'A')
SELECT CAST((SELECT count(*) FROM (SELECT p FROM a INTERSECT SELECT p FROM b)) AS BIGINT) AS both, CAST((SELECT count(*) FROM (SELECT p FROM a EXCEPT SELECT p FROM b)) AS BIGINT) AS only_a,
CAST((SELECT count(*) FROM (SELECT p FROM b EXCEPT SELECT p FROM a)) AS BIGINT) AS only_b, CAST((SELECT count(*) FROM (SELECT p FROM a UNION SELECT p FROM b)) AS BIGINT) AS either""")
def set_operations(spark, sf_dir) -> DataFrame:
    """Intersection, both differences and union of two sets, from one grouping."""
    item = table(spark, sf_dir, "lineitem").filter("l_returnflag IN ('R', 'A')")
    sides = item.groupBy("l_partkey").agg(F.max(F.col("l_returnflag") == "R").alias("a"), F.max(F.col("l_returnflag") == "A").alias("b"))
    return sides.agg(F.count_if(F.col("a") & F.col("b")).alias("both"), F.count_if(F.col("a") & ~F.col("b")).alias("only_a"), F.count_if(F.col("b") & ~F.col("a")).alias("only_b"), F.count("*").alias("either"))


@query("""WITH s AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS p FROM orders GROUP BY o_custkey)
SELECT a.o_custkey AS a, b.o_custkey AS b, len(list_intersect(a.p, b.p)) / len(list_distinct(list_concat(a.p, b.p)))::DOUBLE AS jaccard
FROM s a JOIN s b ON b.o_custkey = a.o_custkey + 1""")
def jaccard_neighbours(spark, sf_dir) -> DataFrame:
    """Likeness of the priorities of customers next to each other by key."""
    sets = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("p"))
    a, b = sets.select(F.col("o_custkey").alias("a"), F.col("p").alias("pa")), sets.select(F.col("o_custkey").alias("b"), F.col("p").alias("pb"))
    return a.join(b, F.col("b") == F.col("a") + 1).select("a", "b", (F.size(F.array_intersect("pa", "pb")) / F.size(F.array_union("pa", "pb"))).alias("jaccard"))
