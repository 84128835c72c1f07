"""Bills, prices, cost build-ups and labour over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators import costing
from girder.plans.registry import query
from girder.sources.tables import table

_AMOUNT = "CAST(round(CAST(l_extendedprice AS DECIMAL(14,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))), 2) AS DECIMAL(14,2))"


def amounts(spark, sf_dir) -> DataFrame:
    item = table(spark, sf_dir, "lineitem")
    return item.withColumn("amount", costing.money(F.col("l_extendedprice").cast("decimal(14,2)") * (F.lit(1).cast("decimal(4,2)") - F.col("l_discount").cast("decimal(4,2)"))))


@query(f"""WITH l AS (SELECT l_returnflag AS section, CASE WHEN p_size % 10 <> 0 THEN {_AMOUNT} END AS amount FROM lineitem LEFT JOIN part ON l_partkey = p_partkey)
SELECT section, CAST(coalesce(sum(amount), 0) AS DOUBLE) AS total, CAST(count(amount) AS BIGINT) AS priced, CAST(count(*) FILTER (WHERE amount IS NULL) AS BIGINT) AS unpriced, grouping(section) = 1 AS is_total FROM l GROUP BY ROLLUP (section)""")
def priced_bill_totals(spark, sf_dir) -> DataFrame:
    """Lines priced from the rate library, with section totals and the grand total; unpriced lines are counted."""
    rates = table(spark, sf_dir, "part").filter("p_size % 10 <> 0").select("p_partkey")
    lines = amounts(spark, sf_dir).join(rates, F.col("l_partkey") == F.col("p_partkey"), "left").select(F.col("l_returnflag").alias("section"), F.when(F.col("p_partkey").isNotNull(), F.col("amount")).alias("amount"))
    return costing.section_totals(lines, "section", "amount").withColumn("total", F.col("total").cast("double"))


@query(f"""WITH d AS (SELECT l_orderkey AS bid, CAST(sum({_AMOUNT}) * 100 AS BIGINT) AS direct FROM lineitem GROUP BY l_orderkey),
c AS (SELECT bid, direct, direct + (direct * 650 + 5000) // 10000 + (direct * 400 + 5000) // 10000 + (direct * 75 + 5000) // 10000 + (direct * 50 + 5000) // 10000 AS cost FROM d),
w AS (SELECT *, cost + (cost * 5 + 50) // 100 AS cwc FROM c)
SELECT bid, direct / 100 AS direct, cost / 100 AS cost, cwc / 100 AS cost_with_contingency, (cwc + (cwc * 125 + 500) // 1000) / 100 AS price FROM w""")
def cost_build_up(spark, sf_dir) -> DataFrame:
    """Direct cost, indirects, contingency and margin of each bid, every percentage of its own base."""
    direct = amounts(spark, sf_dir).groupBy(F.col("l_orderkey").alias("bid")).agg(F.sum("amount").alias("direct"))
    percents = {"site_overheads": "6.5", "preliminaries": "4", "insurance": "0.75", "bonds": "0.5", "contingency": "5", "margin": "12.5"}
    out = costing.build_up(direct, percents)
    return out.select("bid", *[F.col(c).cast("double").alias(c) for c in ("direct", "cost", "cost_with_contingency", "price")])


@query("""WITH h AS (SELECT event_type AS item, event_id, ts, CAST(value AS DECIMAL(14,2)) AS price FROM events WHERE value > 0)
SELECT item, CAST(count(*) AS BIGINT) AS n, CAST(min(price) AS DOUBLE) AS least, CAST(max(price) AS DOUBLE) AS most, round(median(price::DOUBLE), 4) AS median, CAST(max_by(price, (ts, event_id)) AS DOUBLE) AS latest FROM h GROUP BY item""")
def price_history(spark, sf_dir) -> DataFrame:
    """Number, extremes, exact median and latest of each item's prices (event values)."""
    h = table(spark, sf_dir, "events").select(F.col("event_type").alias("item"), "event_id", "ts", F.col("value").cast("decimal(14,2)").alias("price"))
    found = costing.price_statistics(h, ["item"], "price", "ts", "event_id")
    return found.select("item", "n", *[F.col(c).cast("double").alias(c) for c in ("least", "most", "median", "latest")])


@query("""WITH c AS (SELECT p_brand AS ref, CAST(sum(p_size) AS BIGINT) AS client FROM part WHERE p_partkey % 2 = 0 AND p_brand <> 'Brand#3' GROUP BY p_brand), m AS (SELECT p_brand AS ref, CAST(sum(p_size) AS BIGINT) AS measured FROM part WHERE p_partkey % 2 = 1 GROUP BY p_brand),
j AS (SELECT m.ref, client, measured FROM m LEFT JOIN c USING (ref))
SELECT ref, measured - client AS gap, sign(measured - client) * floor(abs(measured - client) * 1000.0::DOUBLE / client + 0.5) / 10 AS percent,
CASE WHEN client IS NULL THEN measured > 0 ELSE floor(abs(measured - client) * 1000.0::DOUBLE / client + 0.5) / 10 > 5 END AS flagged FROM j""")
def quantity_variance(spark, sf_dir) -> DataFrame:
    """Differences of measured and client quantities by item, flagged beyond five percent (parts by brand)."""
    p = table(spark, sf_dir, "part")
    total = lambda keep, name: p.filter(keep).groupBy(F.col("p_brand").alias("ref")).agg(F.sum("p_size").alias(name))
    both = total("p_partkey % 2 = 1", "measured").join(total("p_partkey % 2 = 0 AND p_brand <> 'Brand#3'", "client"), "ref", "left")
    gap, percent, over = costing.variance(F.col("client").cast("decimal(14,3)"), F.col("measured").cast("decimal(14,3)"))
    return both.select("ref", gap.cast("long").alias("gap"), percent.cast("double").alias("percent"), over.alias("flagged"))


@query("""WITH b AS (SELECT s_suppkey, CAST(round(CAST(abs(s_acctbal) AS DECIMAL(14,2)) * 1.3475, 4) AS DECIMAL(18,4)) AS base FROM supplier),
f AS (SELECT s_suppkey, base + CAST(round(base * 2.5 / 100, 4) AS DECIMAL(18,4)) AS base FROM b)
SELECT s_suppkey, CAST(round(base + CAST(round(base * 3 / 100, 4) AS DECIMAL(18,4)) + CAST(round(base * 0.4 / 100, 4) AS DECIMAL(18,4)), 2) AS DOUBLE) AS landed FROM
(SELECT s_suppkey, CAST(base AS DECIMAL(18,4)) AS base FROM f)""")
def landed_cost(spark, sf_dir) -> DataFrame:
    """Foreign prices in own money with buffer and import percentages (suppliers' balances)."""
    price, rate = F.abs("s_acctbal").cast("decimal(14,2)"), F.lit("1.3475").cast("decimal(8,4)")
    return table(spark, sf_dir, "supplier").select("s_suppkey", costing.landed_unit(price, rate, "2.5", ["3", "0.4"]).cast("double").alias("landed"))


@query("""WITH l AS (SELECT l_returnflag AS section, l_linestatus AS trade, CAST(l_quantity AS DECIMAL(14,3)) AS quantity, CASE WHEN l_tax > 0.04 THEN 1.1500 ELSE 1.0000 END * CASE WHEN l_discount > 0.05 THEN 1.0500 ELSE 1.0000 END AS factor FROM lineitem),
h AS (SELECT section, trade, CAST(round(quantity * 0.35 * CAST(round(factor, 4) AS DECIMAL(10,4)), 2) AS DECIMAL(14,2)) AS hours FROM l)
SELECT section, trade, CAST(sum(hours) AS DOUBLE) AS hours, CAST(sum(CAST(round(hours * 41.25, 2) AS DECIMAL(14,2))) AS DOUBLE) AS cost FROM h GROUP BY section, trade""")
def labour_estimate(spark, sf_dir) -> DataFrame:
    """Hours and cost by section and trade, from lines that are rounded first."""
    item = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("section"), F.col("l_linestatus").alias("trade"), F.col("l_quantity").cast("decimal(14,3)").alias("quantity"), "l_tax", "l_discount")
    dec = lambda x: F.lit(x).cast("decimal(18,4)")
    factors = F.array(F.when(F.col("l_tax") > 0.04, dec("1.15")).otherwise(dec("1")), F.when(F.col("l_discount") > 0.05, dec("1.05")).otherwise(dec("1")))
    lines = costing.labour_lines(item, F.lit("0.35").cast("decimal(6,2)"), factors, F.lit("41.25").cast("decimal(8,2)"))
    return lines.groupBy("section", "trade").agg(F.sum("hours").cast("double").alias("hours"), F.sum("cost").cast("double").alias("cost"))


@query("""SELECT p_partkey // 2 AS kind, CASE WHEN count(DISTINCT p_brand) = 1 THEN min(p_brand) ELSE '' END AS brand, CASE WHEN count(DISTINCT p_name) = 1 THEN min(p_name) ELSE '' END AS name FROM part GROUP BY p_partkey // 2""")
def agreed_key_parts(spark, sf_dir) -> DataFrame:
    """A part of the key stays only where all keys agree in it."""
    agreed = lambda c: F.when(F.min(c) == F.max(c), F.min(c)).otherwise("")
    return table(spark, sf_dir, "part").groupBy(F.floor(F.col("p_partkey") / 2).alias("kind")).agg(agreed("p_brand").alias("brand"), agreed("p_name").alias("name"))


@query("""SELECT o_custkey, CAST(count(*) FILTER (WHERE o_orderstatus = 'F') AS BIGINT) AS won, CAST(count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')) AS BIGINT) AS decided,
floor(1000.0::DOUBLE * count(*) FILTER (WHERE o_orderstatus = 'F') / nullif(count(*) FILTER (WHERE o_orderstatus IN ('F', 'P')), 0) + 0.5) / 10 AS win_rate FROM orders GROUP BY o_custkey""")
def win_rate(spark, sf_dir) -> DataFrame:
    """Bids won of those decided, by customer (order states)."""
    won, decided = F.count_if(F.col("o_orderstatus") == "F"), F.count_if(F.col("o_orderstatus").isin("F", "P"))
    out = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(won.alias("won"), decided.alias("decided"))
    return out.withColumn("win_rate", F.floor(F.try_divide(F.col("won") * 1000.0, F.col("decided")) + 0.5) / 10)


@query("""SELECT o_orderkey, CAST(o_orderdate AS DATE) + 45 AS valid_until, CASE WHEN o_custkey % 4 = 0 THEN 'no validity' WHEN CAST(o_orderdate AS DATE) + 45 < DATE '1999-01-01' THEN 'expired' WHEN CAST(o_orderdate AS DATE) + 45 < DATE '2000-01-01' THEN 'ends before the tender' ELSE '' END AS flag FROM orders""")
def validity_flags(spark, sf_dir) -> DataFrame:
    """Whether quotations state a validity and it reaches the tender (45 days from the order's day)."""
    until = F.date_add(F.col("o_orderdate").cast("date"), 45)
    day = lambda d: F.lit(d).cast("date")
    flag = F.when(F.col("o_custkey") % 4 == 0, "no validity").when(until < day("1999-01-01"), "expired").when(until < day("2000-01-01"), "ends before the tender").otherwise("")
    return table(spark, sf_dir, "orders").select("o_orderkey", until.alias("valid_until"), flag.alias("flag"))


@query("""WITH r AS (SELECT state, since, percent FROM (VALUES ('F', DATE '1990-01-01', 700), ('F', DATE '1996-07-01', 800), ('F', DATE '2000-01-01', 900), ('O', DATE '1995-01-01', 550), ('O', DATE '1999-03-15', 625), ('P', DATE '1980-01-01', 0)) AS v(state, since, percent)),
o AS (SELECT o_orderkey, o_orderstatus AS state, CAST(o_orderdate AS DATE) AS day, CAST(round(CAST(o_totalprice AS DECIMAL(14,2)) * 100) AS BIGINT) AS cents FROM orders)
SELECT o_orderkey, percent / 100.0::DOUBLE AS percent, CAST((cents * percent + 5000) // 10000 AS BIGINT) AS tax_cents, CAST(cents + (cents * percent + 5000) // 10000 AS BIGINT) AS inclusive_cents FROM o ASOF JOIN r ON o.state = r.state AND o.day >= r.since""")
def taxed_totals(spark, sf_dir) -> DataFrame:
    """Totals with the tax in force on the day of their order, by state; a day without a rate stops the query."""
    known = [("F", "1990-01-01", "7"), ("F", "1996-07-01", "8"), ("F", "2000-01-01", "9"), ("O", "1995-01-01", "5.5"), ("O", "1999-03-15", "6.25"), ("P", "1980-01-01", "0")]
    rates = spark.createDataFrame(known, "state string, since string, percent string").select("state", F.col("since").cast("date").alias("since"), F.col("percent").cast("decimal(6,3)").alias("percent"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderstatus").alias("state"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_totalprice").cast("decimal(14,2)").alias("total"))
    found = costing.with_tax(o, rates, ["state"], "day", "total", ["o_orderkey"])
    cents = lambda c: (F.col(c) * 100).cast("long").alias(f"{c}_cents")
    return found.select("o_orderkey", F.col("percent").cast("double").alias("percent"), cents("tax"), cents("inclusive"))


@query("""WITH p AS (SELECT * FROM (VALUES ('user', DATE '2024-02-01', 300, 1500, 30), ('user', DATE '2024-09-15', 250, 1255, NULL), ('assistant', DATE '2023-01-01', 75, 301, 7)) AS v(model, since, i, o, c)),
u AS (SELECT conv_id, turn, role AS model, DATE '2024-01-01' + CAST(conv_id % 400 AS INTEGER) AS day, length(coalesce(text, '')) AS tokens, length(coalesce(text, '')) % 90 AS cached, turn * 7 + 3 AS output FROM conversations),
t AS (SELECT conv_id, turn, u.model, coalesce(greatest(tokens - cached, 0) * i + output * o + cached * coalesce(c, i), 0) AS total FROM u ASOF LEFT JOIN p ON u.model = p.model AND u.day >= p.since)
SELECT conv_id, turn, model, CAST(total // 100 + CASE WHEN total % 100 > 50 OR (total % 100 = 50 AND total // 100 % 2 = 1) THEN 1 ELSE 0 END AS BIGINT) AS micros FROM t""")
def call_costs(spark, sf_dir) -> DataFrame:
    """What model calls cost by the price in force on their day, in millionths; unpriced calls cost nothing."""
    known = [("user", "2024-02-01", "3.00", "15.00", "0.30"), ("user", "2024-09-15", "2.50", "12.55", None), ("assistant", "2023-01-01", "0.75", "3.01", "0.07")]
    prices = spark.createDataFrame(known, "model string, since string, per_input string, per_output string, per_cached string")
    prices = prices.select("model", F.col("since").cast("date").alias("since"), *[F.col(c).cast("decimal(10,2)").alias(c) for c in ("per_input", "per_output", "per_cached")])
    n = F.length(F.coalesce("text", F.lit("")))
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("conv_id") % 400).cast("int"))
    calls = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("role").alias("model"), day.alias("day"), n.alias("tokens"), (n % 90).alias("cached"), (F.col("turn") * 7 + 3).alias("output"))
    found = costing.call_costs(calls, prices, ["model"], "day", ["conv_id", "turn", "tokens"])
    return found.select("conv_id", "turn", "model", (F.col("cost") * 1_000_000).cast("long").alias("micros"))
