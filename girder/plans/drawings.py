"""Drawing geometry over the supplied tables, whose numbers are read as coordinates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from girder.operators import drawing
from girder.operators.checkpoints import checkpointed
from girder.plans.registry import query
from girder.sources.tables import table


@query("""WITH p AS (SELECT vec_id, embedding, label % 2 = 0 AS closed FROM embeddings), s AS (SELECT vec_id, unnest(generate_series(0, CASE WHEN closed THEN 31 ELSE 30 END)) AS part, embedding FROM p)
SELECT vec_id, CAST(part AS INTEGER) AS part, embedding[2 * part + 1]::DOUBLE AS x0, embedding[2 * part + 2]::DOUBLE AS y0, embedding[2 * ((part + 1) % 32) + 1]::DOUBLE AS x1, embedding[2 * ((part + 1) % 32) + 2]::DOUBLE AS y1 FROM s""")
def polyline_segments(spark, sf_dir) -> DataFrame:
    """Segments of polylines, closed ones back to their start (embeddings as points)."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("points"), (F.col("label") % 2 == 0).alias("closed"))
    return drawing.segments(v, "points", "closed")


_POINTS = "SELECT vec_id AS point, label AS sheet, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y FROM embeddings"
_LINES = "SELECT vec_id AS segment, label AS sheet, embedding[3]::DOUBLE AS x0, embedding[4]::DOUBLE AS y0, embedding[5]::DOUBLE AS x1, embedding[6]::DOUBLE AS y1 FROM embeddings"


@query(f"""WITH p AS ({_POINTS}), l AS ({_LINES}), j AS (SELECT *, greatest(0.0, least(1.0, ((x - x0) * (x1 - x0) + (y - y0) * (y1 - y0)) / ((x1 - x0) ** 2 + (y1 - y0) ** 2))) AS t FROM p JOIN l USING (sheet))
SELECT sheet, point, segment, round(sqrt((x - (x0 + t * (x1 - x0))) ** 2 + (y - (y0 + t * (y1 - y0))) ** 2), 9) AS gap FROM j QUALIFY row_number() OVER (PARTITION BY sheet, point ORDER BY round(sqrt((x - (x0 + t * (x1 - x0))) ** 2 + (y - (y0 + t * (y1 - y0))) ** 2), 9), segment) = 1""")
def nearest_segments(spark, sf_dir) -> DataFrame:
    """The nearest line of its sheet to each point, and its distance (embeddings as points and lines)."""
    v = table(spark, sf_dir, "embeddings").withColumnRenamed("label", "sheet")
    e = lambda i, name: F.col("embedding")[i].cast("double").alias(name)
    points = v.select(F.col("vec_id").alias("point"), "sheet", e(0, "x"), e(1, "y"))
    lines = v.select(F.col("vec_id").alias("segment"), "sheet", e(2, "x0"), e(3, "y0"), e(4, "x1"), e(5, "y1"))
    return drawing.nearest_segment(points, lines, "sheet", "point", "segment", checkpointed)


@query("""WITH n AS (SELECT s_nationkey AS sheet, s_acctbal AS p, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal) - 1 AS n FROM supplier),
l AS (SELECT sheet, p, CASE WHEN n < 26 THEN '' WHEN n < 702 THEN chr((65 + (n - 26) // 26)::INT) ELSE chr((65 + (n - 702) // 676)::INT) || chr((65 + (n - 702) // 26 % 26)::INT) END || chr((65 + CASE WHEN n < 702 THEN n % 26 ELSE (n - 702) % 26 END)::INT) AS l FROM n),
c AS (SELECT c_custkey, c_nationkey AS sheet, c_acctbal AS x FROM customer)
SELECT c_custkey, coalesce((SELECT arg_min(l, p) FROM l WHERE l.sheet = c.sheet AND abs(p - x) <= 25), concat_ws('-', (SELECT arg_max(l, p) FROM l WHERE l.sheet = c.sheet AND p < x), (SELECT arg_min(l, p) FROM l WHERE l.sheet = c.sheet AND p > x))) AS reference FROM c""")
def grid_references(spark, sf_dir) -> DataFrame:
    """The gridline that a point stands on, or the two between (suppliers' balances as gridlines, customers' as
    points)."""
    order = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_acctbal"))
    lines = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("sheet"), F.col("s_acctbal").alias("p"), drawing.grid_label(order).alias("l"))
    points = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("sheet"), F.col("c_acctbal").alias("x"))
    return drawing.grid_reference(points, lines, ["sheet"], "x", "p", "l", 25.0).select("c_custkey", "reference")


@query("""SELECT * FROM (SELECT l_suppkey AS sheet, CAST(round_even((l_discount + 0) * 100 / 5, 0) * 5 AS DOUBLE) AS dx, CAST(round_even(l_tax * 100 / 5, 0) * 5 AS DOUBLE) AS dy, CAST(count(*) AS BIGINT) AS votes FROM lineitem GROUP BY ALL) WHERE votes >= 3 QUALIFY row_number() OVER (PARTITION BY sheet ORDER BY votes DESC, dx, dy) = 1""")
def common_offsets(spark, sf_dir) -> DataFrame:
    """The offset that most pairs of a sheet agree on, three votes at least (discount and tax as offsets)."""
    item = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "sheet")
    return drawing.commonest_offset(item, "sheet", (F.col("l_discount") + 0) * 100, F.col("l_tax") * 100, 5.0, 3)


_BOXES = """b AS (SELECT c_custkey AS id, c_nationkey AS sheet, c_acctbal AS minx, c_custkey % 97 * 10.0::DOUBLE AS miny,
c_acctbal + CASE WHEN c_custkey % 50 = 0 THEN 900 ELSE 60 END AS maxx, c_custkey % 97 * 10.0::DOUBLE + 25 AS maxy FROM customer),
p AS (SELECT a.id AS a, b.id AS b FROM b a JOIN b ON a.sheet = b.sheet AND a.id < b.id AND a.minx <= b.maxx + 0.3 AND b.minx <= a.maxx + 0.3 AND a.miny <= b.maxy + 0.3 AND b.miny <= a.maxy + 0.3)"""


def boxes(spark, sf_dir) -> DataFrame:
    """Boxes of all customers, some of them wide."""
    c = table(spark, sf_dir, "customer")
    y, width = (F.col("c_custkey") % 97) * F.lit(10.0), F.when(F.col("c_custkey") % 50 == 0, 900).otherwise(60)
    return c.select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("sheet"), F.col("c_acctbal").alias("minx"), y.alias("miny"), (F.col("c_acctbal") + width).alias("maxx"), (y + 25).alias("maxy"))


@query(f"WITH {_BOXES} SELECT a, b FROM p")
def touching_boxes(spark, sf_dir) -> DataFrame:
    """Pairs of boxes of a sheet that touch, or nearly so."""
    return drawing.touching(boxes(spark, sf_dir), ["sheet"], "id", 0.3, 100.0)


@query(f"""WITH RECURSIVE {_BOXES}, r(a, b) AS (SELECT id, id FROM b UNION SELECT r.a, n.b FROM r JOIN (SELECT a, b FROM p UNION ALL SELECT b, a FROM p) n ON n.a = r.b)
SELECT a AS id, min(b) AS cluster FROM r GROUP BY a""")
def touching_clusters(spark, sf_dir) -> DataFrame:
    """The cluster of every box: boxes of a sheet that touch, directly or through others."""
    return drawing.clusters(boxes(spark, sf_dir), ["sheet"], "id", 0.3, 100.0, checkpointed)


@query()
def shape_descriptors(spark, sf_dir) -> DataFrame:
    """Direction histograms of each shape's 32 points."""
    v = table(spark, sf_dir, "embeddings").withColumn("e", F.col("embedding").cast("array<double>"))
    return v.select("vec_id", drawing.descriptor(F.slice("e", 1, 32), F.slice("e", 33, 32)).alias("histogram"))


@query("""WITH e AS (SELECT l_suppkey AS view, 100.0::DOUBLE AS stated, 98 + l_linenumber / 2.0::DOUBLE AS measured FROM lineitem WHERE l_quantity > 30), s AS (SELECT view, CAST(count(*) AS BIGINT) AS n, CAST(count(*) FILTER (WHERE abs(measured / stated - 1) <= 0.01::DOUBLE) AS BIGINT) AS agree FROM e GROUP BY view)
SELECT view, n, agree, CASE WHEN n < 5 THEN 'unverified' WHEN agree / n::DOUBLE >= 0.8::DOUBLE THEN 'verified' ELSE 'disputed' END AS status FROM s""")
def scale_verdicts(spark, sf_dir) -> DataFrame:
    """Whether measured scales bear out the stated one (line items with quantities over 30, which are those that have
    a dimension)."""
    item = table(spark, sf_dir, "lineitem").filter("l_quantity > 30").select(F.col("l_suppkey").alias("view"), F.lit(100.0).alias("stated"), (98 + F.col("l_linenumber") / F.lit(2.0)).alias("measured"))
    return drawing.scale_verdict(item, "view", "stated", "measured")


@query("""WITH i AS (SELECT p_partkey, p_size * 100 AS w, p_size * 60 AS h FROM part), n AS (SELECT *, greatest(0, ceil(log2(greatest(w, h) / 512::DOUBLE)))::INT AS levels FROM i), l AS (SELECT *, unnest(generate_series(0, levels)) AS level FROM n),
s AS (SELECT *, 2.0::DOUBLE ** (levels - level) AS scale FROM l) SELECT p_partkey, CAST(level AS INTEGER) AS level, CAST(sum(ceil(ceil(w / scale) / 512) * ceil(ceil(h / scale) / 512)) AS BIGINT) AS tiles FROM s GROUP BY ALL""")
def tile_index(spark, sf_dir) -> DataFrame:
    """Tiles of each level of an image pyramid (sizes from parts)."""
    images = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 100).alias("w"), (F.col("p_size") * 60).alias("h"))
    return drawing.tiles(images, "w", "h").groupBy("p_partkey", "level").agg(F.count("*").alias("tiles"))


@query("""WITH r AS (SELECT p_partkey, p_size * 400 AS w, 3000 + p_partkey % 50 * 100 AS d FROM part), n AS (SELECT *, CAST(ceil(w / 4600.0::DOUBLE) AS BIGINT) AS columns, CAST(ceil(d / 4600.0::DOUBLE) AS BIGINT) AS r0, ceil(w * d / (1e6 * 12.0)) AS more FROM r)
SELECT p_partkey, columns, greatest(r0, CAST(ceil(more / columns) AS BIGINT)) AS rows, columns * greatest(r0, CAST(ceil(more / columns) AS BIGINT)) AS heads FROM n""")
def head_layout(spark, sf_dir) -> DataFrame:
    """Rows, columns and number of sprinkler heads of rooms (sizes from parts)."""
    rooms = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 400).alias("w"), (3000 + F.col("p_partkey") % 50 * 100).alias("d"))
    return drawing.heads(rooms, "w", "d", 4600, 12.0).select("p_partkey", "columns", "rows", "heads")
