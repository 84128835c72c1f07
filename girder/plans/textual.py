"""Text functions, rules and clause checks over the supplied tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.functions import text as X
from girder.plans.registry import query
from girder.sources.tables import table


@query("""SELECT p_partkey, lower(trim(regexp_replace(p_name, '\\s+', ' ', 'g'))) || '|' || array_to_string(regexp_extract_all(p_brand, '\\d+(?:\\.\\d+)?'), 'x') || '|' || lower(p_type) AS key, lower(p_type) AS third FROM part""")
def item_key_text(spark, sf_dir) -> DataFrame:
    """Keys of items from normalised parts, and a part of them read back."""
    p = table(spark, sf_dir, "part")
    keyed = p.select("p_partkey", X.key(X.part(F.col("p_name")), X.size(F.col("p_brand")), X.part(F.col("p_type"))).alias("key"))
    return keyed.withColumn("third", X.key_part(F.col("key"), 3))


@query("""SELECT doc_id, CAST(len(regexp_extract_all(text, '[.;]\\s+\\p{Lu}')) + 1 AS INTEGER) AS n FROM documents""")
def sentence_counts(spark, sf_dir) -> DataFrame:
    """How many sentences each document has."""
    return table(spark, sf_dir, "documents").select("doc_id", F.size(X.sentences(F.col("text"))).alias("n"))


@query("""SELECT o_orderkey, CAST(coalesce(list_sum([CASE WHEN isodow(CAST(o_orderdate AS DATE) + i::INT) < 6 AND CAST(o_orderdate AS DATE) + i::INT NOT IN (DATE '1998-12-25', DATE '1999-01-01') THEN 1 ELSE 0 END for i in range(1, 1 + o_custkey % 30)]), 0) AS INTEGER) AS days FROM orders""")
def working_days(spark, sf_dir) -> DataFrame:
    """Working days of up to a month from each order's day, without two holidays."""
    o = table(spark, sf_dir, "orders")
    start = F.col("o_orderdate").cast("date")
    return o.select("o_orderkey", X.working_days(start, F.date_add(start, (F.col("o_custkey") % 30).cast("int")), ["1998-12-25", "1999-01-01"]).alias("days"))


@query("""SELECT p_partkey, CASE WHEN p_name LIKE '%ring%' AND p_name NOT LIKE '%red%' THEN 'ring' WHEN p_name LIKE '%red%' AND p_name NOT LIKE '%ring%' THEN 'colour' END AS proposal, CASE WHEN p_name LIKE '%red%' THEN 'colour' WHEN p_name LIKE '%ring%' THEN 'ring' END AS first FROM part""")
def rule_matches(spark, sf_dir) -> DataFrame:
    """Rules that must agree, and rules of which the first decides."""
    rules = [("colour", "red"), ("ring", "ring")]
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", X.sole_match(F.col("p_name"), rules).alias("proposal"), X.first_match(F.col("p_name"), rules).alias("first"))


@query("""SELECT p_partkey, p_name || CASE WHEN p_size % 2 = 0 THEN ', size ' || p_size ELSE '' END || CASE WHEN p_type = 'PROMO' THEN ', promo' ELSE '' END AS description FROM part""")
def descriptions(spark, sf_dir) -> DataFrame:
    """Descriptions from a template without its unknown parts (parts)."""
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size").cast("string"))
    kind = F.when(F.col("p_type") == "PROMO", F.lower("p_type"))
    return table(spark, sf_dir, "part").select("p_partkey", X.described([("%s", F.col("p_name")), ("size %s", size), ("%s", kind)]).alias("description"))


@query("""SELECT event_id, CAST(props->>'k' AS INTEGER) AS k, CASE WHEN CAST(props->>'k' AS INTEGER) >= 50 THEN 'high' ELSE 'low' END AS band FROM events WHERE event_type = 'signup'""")
def json_fields(spark, sf_dir) -> DataFrame:
    """A JSON field of signups, and its band."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").filter("event_type = 'signup'").select("event_id", k.alias("k"), F.when(k >= 50, "high").otherwise("low").alias("band"))


@query("""WITH d AS (SELECT doc_id, text, source FROM documents WHERE lang = 'en'), r(category, word) AS (VALUES ('testing', 'the'), ('warranty', 'was'), ('spares', 'with'))
SELECT source, category, CAST(count(*) FILTER (WHERE regexp_matches(lower(text), '\\b' || word || '\\b')) AS BIGINT) AS clauses FROM d, r GROUP BY ALL""")
def obligations(spark, sf_dir) -> DataFrame:
    """Clauses of each category, by the pattern of the category; none counts as zero."""
    rules = [("testing", "the"), ("warranty", "was"), ("spares", "with")]
    d = table(spark, sf_dir, "documents").filter("lang = 'en'").select("source", F.lower("text").alias("t"))
    found = d.groupBy("source").agg(*[F.count_if(F.col("t").rlike(rf"\b{w}\b")).alias(c) for c, w in rules])
    return found.unpivot("source", [c for c, _ in rules], "category", "clauses")


@query("""SELECT doc_id FROM documents WHERE lang = 'en' AND NOT regexp_matches(lower(text), '\\b(?:the|was|with)\\b')""")
def unread_clauses(spark, sf_dir) -> DataFrame:
    """English documents without any of three common words, which stand for clauses that no rule reads."""
    return table(spark, sf_dir, "documents").filter("lang = 'en'").filter(~F.lower("text").rlike(r"\b(?:the|was|with)\b")).select("doc_id")


@query("""WITH c AS (SELECT n_nationkey AS section, n_regionkey AS system FROM nation), w(category) AS (VALUES (0), (1), (2), (3)), f AS (SELECT c_nationkey AS section, c_nationkey % 4 AS category, c_nationkey % 3 = 0 AS clear FROM customer)
SELECT system, category, coalesce(CASE WHEN bool_or(clear) THEN 'clear' WHEN count(clear) > 0 THEN 'unclear' END, 'silent') AS status FROM c CROSS JOIN w LEFT JOIN f USING (section, category) GROUP BY ALL""")
def scope_matrix(spark, sf_dir) -> DataFrame:
    """Every system and category with the best status that a section gives it, silent where none does."""
    c = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("section"), F.col("n_regionkey").alias("system"))
    grid = c.withColumn("category", F.explode(F.array(*[F.lit(i) for i in range(4)])))
    f = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("section"), (F.col("c_nationkey") % 4).alias("category"), (F.col("c_nationkey") % 3 == 0).alias("clear"))
    joined = grid.join(f, ["section", "category"], "left").groupBy("system", "category").agg(F.max("clear").alias("clear"))
    return joined.select("system", "category", F.when(F.col("clear"), "clear").when(F.col("clear").isNotNull(), "unclear").otherwise("silent").alias("status"))


@query("""SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, string_agg(lang, ',' ORDER BY lang) AS langs FROM (SELECT source, lang, sum(n_chars) AS n_chars FROM documents GROUP BY ALL) GROUP BY source HAVING count(*) > 1""")
def ambiguous_groups(spark, sf_dir) -> DataFrame:
    """Groups with two or more distinct values."""
    d = table(spark, sf_dir, "documents").groupBy("source", "lang").agg(F.sum("n_chars").alias("n_chars"))
    return d.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.array_join(F.array_sort(F.collect_list("lang")), ",").alias("langs")).filter("n > 1")


@query()
def edit_ratios(spark, sf_dir) -> DataFrame:
    """How far each answer is from the question before it, in words."""
    c = table(spark, sf_dir, "conversations")
    q, a = c.filter("role = 'user'"), c.filter("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return q.join(a, ["conv_id", "turn"]).select("conv_id", "turn", X.edit_ratio(F.col("text"), F.col("answer")).alias("ratio"))
