"""Documents, issues, risks and frozen records over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators import documents as D
from girder.plans.registry import query
from girder.sources.tables import table


@query("""WITH l AS (SELECT l_orderkey AS doc, l_linenumber * 1000000 + row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_quantity) AS o, CASE WHEN l_returnflag = 'R' THEN l_linenumber || '.1 heading' ELSE 'body' END AS t, l_returnflag = 'R' AS h, l_linenumber FROM lineitem),
c AS (SELECT *, count(*) FILTER (WHERE h) OVER (PARTITION BY doc ORDER BY o) AS clause FROM l)
SELECT doc, CAST(clause AS BIGINT) AS clause, max(CASE WHEN h THEN l_linenumber || '.1' END) AS number, string_agg(t, chr(10) ORDER BY o) AS text FROM c GROUP BY doc, clause""")
def spec_clauses(spark, sf_dir) -> DataFrame:
    """Clauses of specifications by their numbers (an order's line items stand for a document's lines; returned ones
    begin a clause)."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey", "l_linenumber").orderBy("l_partkey", "l_suppkey", "l_quantity")
    item = table(spark, sf_dir, "lineitem")
    lines = item.select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 1000000 + F.row_number().over(w)).alias("o"), F.when(F.col("l_returnflag") == "R", F.concat(F.col("l_linenumber").cast("string"), F.lit(".1 heading"))).otherwise("body").alias("t"))
    return D.clauses(lines, "doc", "o", "t")


@query("""SELECT p_partkey, list_filter([CASE WHEN p_size <= 40 THEN NULL ELSE 'size over 40' END, CASE WHEN p_brand LIKE 'Brand#1%' THEN NULL ELSE 'unknown brand' END, CASE WHEN p_retailprice > 950 THEN NULL ELSE 'rate too low' END], lambda x: x IS NOT NULL) AS problems FROM part""")
def validated_rates(spark, sf_dir) -> DataFrame:
    """Every problem of every row of a rate list."""
    p = table(spark, sf_dir, "part")
    checked = D.validated(p, {"size over 40": F.col("p_size") <= 40, "unknown brand": F.col("p_brand").startswith("Brand#1"), "rate too low": F.col("p_retailprice") > 950})
    return checked.select("p_partkey", "problems")


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS section FROM events""")
def bill_sections(spark, sf_dir) -> DataFrame:
    """The section of each bill line, filled down from the last section head (a signup, in a user's events)."""
    e = table(spark, sf_dir, "events").withColumn("o", F.struct("ts", "event_id"))
    return D.filled_down(e, "user_id", "o", F.when(F.col("event_type") == "signup", F.col("event_id"))).select("event_id", "section")


@query("""WITH r AS (SELECT DISTINCT l_partkey AS system, l_returnflag AS item FROM lineitem WHERE l_linenumber = 1), p AS (SELECT DISTINCT l_partkey AS system, l_returnflag AS item FROM lineitem WHERE l_linenumber = 2 AND l_quantity > 25)
SELECT *, 'required' AS side FROM (SELECT * FROM r EXCEPT SELECT * FROM p) UNION ALL SELECT *, 'present' FROM (SELECT * FROM p EXCEPT SELECT * FROM r)""")
def missing_items(spark, sf_dir) -> DataFrame:
    """Items that a system requires and lacks, and that it has without need (first and large second line items of a
    part)."""
    item = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("system"), F.col("l_returnflag").alias("item"), "l_linenumber", "l_quantity")
    return D.missing_both_ways(item.filter("l_linenumber = 1"), item.filter("l_linenumber = 2 AND l_quantity > 25"), ["system", "item"])


@query("""SELECT DISTINCT o_custkey AS sheet, o_orderpriority AS severity, o_orderstatus AS category FROM orders""")
def issue_list(spark, sf_dir) -> DataFrame:
    """The different issues of sheets, by severity, category and sheet (orders' priorities and states)."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("sheet"), F.col("o_orderpriority").alias("severity"), F.col("o_orderstatus").alias("category"))
    ranks = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
    return D.ranked_issues(o, ["sheet", "severity", "category"], "severity", ranks, "category", "sheet")


@query("""SELECT p_brand AS system, list_sort(list(DISTINCT p_type)) AS "values", list_sort(list(DISTINCT p_size)) AS citations FROM part GROUP BY p_brand""")
def spec_answers(spark, sf_dir) -> DataFrame:
    """What a specification answers for each system: its different values with their citations (types and sizes of a
    brand)."""
    p = table(spark, sf_dir, "part")
    return D.answers(p.withColumnRenamed("p_brand", "system"), ["system"], "p_type", "p_size")


@query("""WITH s AS (SELECT user_id AS doc, event_type AS kind, count(*) / 40.0::DOUBLE AS confidence FROM events GROUP BY ALL), r AS (SELECT *, row_number() OVER w AS n, lead(confidence) OVER w AS nx FROM s WINDOW w AS (PARTITION BY doc ORDER BY confidence DESC, kind))
SELECT doc, kind, CASE WHEN coalesce(confidence - nx <= 0.1::DOUBLE, false) THEN greatest(confidence - 0.2::DOUBLE, 0) ELSE confidence END AS confidence, coalesce(confidence - nx <= 0.1::DOUBLE, false) AS rivalled FROM r WHERE n = 1""")
def document_classes(spark, sf_dir) -> DataFrame:
    """The likeliest class of each document, with less confidence if a rival is near (a user's events vote)."""
    scores = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("doc"), F.col("event_type").alias("kind")).agg((F.count("*") / 40.0).alias("confidence"))
    return D.classified(scores, "doc", "kind", "confidence")


@query("""SELECT p_partkey, CASE WHEN p_size * 8 < 120 OR p_partkey % 10 / 10.0 < 0.5 THEN 'low' WHEN p_size * 8 < 200 OR p_partkey % 10 / 10.0 < 0.8 OR p_type <> 'PROMO' THEN 'medium' ELSE 'high' END AS band,
list_filter([CASE WHEN p_size * 8 < 200 THEN 'resolution' END, CASE WHEN p_partkey % 10 / 10.0 < 0.8 THEN 'text' END, CASE WHEN p_type <> 'PROMO' THEN 'scale' END], lambda x: x IS NOT NULL) AS reasons FROM part""")
def quality_bands(spark, sf_dir) -> DataFrame:
    """Quality bands of sheets by resolution, skew and scale, with the reasons (parts' sizes and keys)."""
    scale = F.when(F.col("p_type") == "PROMO", "verified").otherwise("stated")
    band, reasons = D.quality_band(F.col("p_size") * 8, F.col("p_partkey") % 10 / F.lit(10.0), scale)
    return table(spark, sf_dir, "part").select("p_partkey", band.alias("band"), reasons.alias("reasons"))


@query("""SELECT coalesce(nullif(CASE WHEN p_size % 2 = 0 THEN p_brand ELSE '' END, ''), 'single:' || p_partkey) AS group_key, CAST(count(*) AS BIGINT) AS members, list_sort(list(DISTINCT p_type)) AS evidence FROM part GROUP BY 1""")
def clarification_groups(spark, sf_dir) -> DataFrame:
    """Candidates for one question, grouped by what they concern; those without a group stand alone (parts)."""
    p = table(spark, sf_dir, "part").withColumn("g", F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(""))
    return D.grouped_candidates(p, "p_partkey", "g", "p_type")


@query("""SELECT conv_id, rule, turn FROM (SELECT conv_id, turn, 'delay' AS rule FROM conversations WHERE text LIKE '%the%' UNION ALL SELECT conv_id, turn, 'access' FROM conversations WHERE text LIKE '%an%') QUALIFY row_number() OVER (PARTITION BY conv_id, rule ORDER BY turn) = 1""")
def design_risks(spark, sf_dir) -> DataFrame:
    """The first turn of a conversation that each rule fits; the rules are two words that stand for the risk table."""
    c = table(spark, sf_dir, "conversations")
    return D.first_findings(c, "conv_id", "turn", "text", [("delay", "the"), ("access", "an")]).select("conv_id", "rule", "turn")


@query("""SELECT p_partkey, CAST(CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 2 = 0 THEN 0 ELSE round(CAST(p_size AS DECIMAL(10,2)) * 0.155, 2) END AS DOUBLE) AS hours, CASE WHEN p_size % 5 = 0 THEN 'not_computed' WHEN p_size % 2 = 0 THEN 'already_priced' ELSE 'computed' END AS state FROM part""")
def risk_impacts(spark, sf_dir) -> DataFrame:
    """Hours that a risk adds to labour, or why none are known (parts' sizes as hours)."""
    size = F.col("p_size")
    hours, state = D.labour_impact(F.when(size % 5 != 0, size.cast("decimal(10,2)")), F.lit("1.155").cast("decimal(6,3)"), size % 2 == 0)
    return table(spark, sf_dir, "part").select("p_partkey", hours.cast("double").alias("hours"), state.alias("state"))


@query("SELECT c_custkey FROM customer WHERE c_nationkey = 3 UNION SELECT c_custkey FROM customer WHERE c_acctbal <= -900 AND c_nationkey <> 4")
def tampered_records(spark, sf_dir) -> DataFrame:
    """Records that no longer have the hash which a frozen manifest gives them."""
    c = table(spark, sf_dir, "customer")
    frozen = D.manifest(c.filter("c_acctbal > -900 OR c_nationkey = 4"), "c_custkey")
    changed = c.withColumn("c_acctbal", F.when(F.col("c_nationkey") == 3, F.col("c_acctbal") + 1).otherwise(F.col("c_acctbal")))
    return D.tampered(changed, "c_custkey", frozen)


@query("""WITH s AS (SELECT c_custkey AS k, c_nationkey AS d FROM customer WHERE c_mktsegment <> 'BUILDING'), o AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 99 ELSE CASE WHEN c_custkey % 7 = 0 THEN 98 ELSE c_nationkey END END AS d, CASE WHEN c_custkey % 7 = 0 THEN 98 ELSE c_nationkey END AS b FROM customer WHERE c_acctbal > 0)
SELECT coalesce(s.k, o.k) AS k, CASE WHEN o.d IS NULL THEN 'create' WHEN s.d IS NULL THEN 'own' WHEN s.d = o.d THEN 'keep' WHEN o.d <> o.b THEN 'diverged' ELSE 'replace' END AS action FROM s FULL JOIN o ON s.k = o.k""")
def shared_takeoff(spark, sf_dir) -> DataFrame:
    """A shared takeoff adopted by bids: taken, changed since, or in conflict (customers' keys as versions)."""
    c = table(spark, sf_dir, "customer").withColumn("k", F.col("c_custkey"))
    base = F.when(F.col("k") % 7 == 0, 98).otherwise(F.col("c_nationkey"))
    own = c.filter("c_acctbal > 0").select("k", F.when(F.col("k") % 5 == 0, 99).otherwise(base).alias("d"), base.alias("b"))
    return D.adopted(c.filter("c_mktsegment <> 'BUILDING'").select("k", F.col("c_nationkey").alias("d")), own, "k", "d", "b")


@query("SELECT o_custkey AS item FROM orders WHERE o_orderstatus = 'P' UNION SELECT c_custkey FROM customer WHERE c_acctbal < 0")
def affected_items(spark, sf_dir) -> DataFrame:
    """Items that any of several providers of affected items names, each once."""
    changed = lambda s, d: table(s, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("item"))
    negative = lambda s, d: table(s, d, "customer").filter("c_acctbal < 0").select(F.col("c_custkey").alias("item"))
    return D.affected([changed, negative], spark, sf_dir)
