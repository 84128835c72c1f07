"""Joins that are more than equality: as-of, bands, overlapping ranges, near points, versions, best matches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of one portion of a table, so that a task's memory does not grow with the table.
PORTION = 1_000_000


def portions(df: DataFrame, rows: int = 0) -> int:
    """In how many portions a table is dealt: one for each million rows (or as many as given), the set number at least."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1 + df.count() // (rows or PORTION))


def latest(df: DataFrame, keys: list, *order) -> DataFrame:
    """The first row of each key in the given order, which must be total to be repeatable."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rank", F.row_number().over(w)).filter("__rank = 1").drop("__rank")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, since: str, row: list[str], earliest_if_none: bool = False, bucket: Callable[[Column], Column] | None = None) -> DataFrame:
    """left with the newest row of right that is in force at its time (a left join: null if none is).

    row names the columns that tell the rows of left apart.  earliest_if_none takes right's
    earliest row where none is in force yet.  Both sides meet by the keys, in one shuffle,
    as a running last value over the merged rows: no pairs are made, so a key with many
    changes costs as much as any other.  bucket cuts the time of few and heavy keys into
    parts (a week, say; it must not fall as time rises): a task then has one key's one part,
    which begins with what the parts before it leave in force.
    """
    values = [c for c in right.columns if c not in keys]
    part = bucket or (lambda c: F.lit(0))
    packed = right.select(*keys, F.col(since).alias("__at"), F.struct(*values).alias("__value"), F.lit(1).alias("__side"))
    asked = left.select(*keys, F.col(at).alias("__at"), F.struct(*left.columns).alias("__row"), F.lit(2).alias("__side"))
    both = packed.unionByName(asked, allowMissingColumns=True).withColumn("__part", part(F.col("__at")))
    if bucket is not None or earliest_if_none:
        # what is in force when a part begins, one row a key and part
        order = F.struct("__at", "__value")
        parts = both.groupBy(*keys, "__part").agg(
            F.max(F.when(F.col("__side") == 1, order)).alias("newest"), F.min(F.when(F.col("__side") == 1, order)).alias("earliest")
        )
        across = Window.partitionBy(*keys).orderBy("__part")
        held = F.last("newest", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1))["__value"]
        if earliest_if_none:
            held = F.coalesce(held, F.min("earliest").over(Window.partitionBy(*keys))["__value"])
        both = both.unionByName(parts.select(*keys, "__part", held.alias("__value"), F.lit(0).alias("__side")), allowMissingColumns=True)
    order = Window.partitionBy(*keys, "__part").orderBy(
        F.col("__side") > 0, F.asc_nulls_first("__at"), "__side", *[F.col("__row")[c] for c in row], *[F.col("__value")[c] for c in values]
    )
    found = F.last("__value", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    out = both.withColumn("__found", found).filter("__side = 2")
    return out.select("__row.*", *[F.col("__found")[v].alias(v) for v in values if v not in left.columns])


def bands(limits: DataFrame, up_to: str, *group: str) -> DataFrame:
    """limits with `above`, the limit before each (null for the first): a band is above < x <= up_to."""
    w = Window.partitionBy(*group).orderBy(up_to) if group else Window.orderBy(up_to)
    return limits.withColumn("above", F.lag(up_to).over(w))


def in_band(value: Column, limits: list[tuple[float, object]], beyond_last: bool = True) -> Column:
    """What belongs to the first limit that value does not exceed; beyond the last limit the last one's, or null."""
    out = F.lit(limits[-1][1]) if beyond_last else F.lit(None)
    for limit, given in reversed(limits):
        out = F.when(value <= limit, F.lit(given)).otherwise(out)
    return F.when(value.isNull(), F.lit(None)).otherwise(out)


def overlap(lo: Column, hi: Column, lo2: Column, hi2: Column) -> Column:
    """Whether two closed ranges meet; a null end is open."""
    low = lambda c: F.coalesce(c.cast("double"), F.lit(float("-inf")))
    high = lambda c: F.coalesce(c.cast("double"), F.lit(float("inf")))
    return (low(lo) <= high(hi2)) & (low(lo2) <= high(hi))


def overlap_counts(asked: DataFrame, ranges: DataFrame, keys: list[str], ident: str, times: str | None = None) -> DataFrame:
    """(ident, n): how many ranges (keys, lo, hi) meet each asked range (keys, ident, lo, hi) with equal keys, touching ends
    included; a null end is open, and asked ranges that meet none are left out.  No range may end before it starts.

    Of the ranges that begin up to an asked range's end, those that end before its start don't meet it: two running
    counts in order of all ends give both numbers, and no pairs are made.  times is a count of equal ranges in one row.
    """
    low = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))
    high = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(float("inf")))
    n = F.col(times) if times else F.lit(1).cast("long")
    # where ends are equal, an asked start comes before ranges, and an asked end after them
    row = lambda at, turn, begun, ended, who: F.struct(at.alias("at"), F.lit(turn).alias("turn"), begun.cast("long").alias("begun"), ended.cast("long").alias("ended"), who.alias(ident))
    none, nobody = F.lit(0), F.lit(None).cast(asked.schema[ident].dataType)
    ends = ranges.select(*keys, F.explode(F.array(row(low("lo"), 1, n, none, nobody), row(high("hi"), 1, none, n, nobody))).alias("e"))
    asks = asked.select(*keys, F.explode(F.array(row(low("lo"), 0, none, none, F.col(ident)), row(high("hi"), 2, none, none, F.col(ident)))).alias("e"))
    order = Window.partitionBy(*keys).orderBy("at", "turn").rowsBetween(Window.unboundedPreceding, 0)
    swept = ends.union(asks).select(*keys, "e.*").withColumns({"begun": F.sum("begun").over(order), "ended": F.sum("ended").over(order)}).filter(F.col(ident).isNotNull())
    met = swept.groupBy(ident).agg((F.max(F.when(F.col("turn") == 2, F.col("begun"))) - F.max(F.when(F.col("turn") == 0, F.col("ended")))).alias("n"))
    return met.filter("n > 0")


def near_pairs(points: DataFrame, keys: list[str], x: str, y: str, row: str, radius: float) -> DataFrame:
    """(a, b) of points with equal keys whose coordinates differ by radius at most on both axes, a < b.

    Points meet in square cells wider than twice the radius: one side stands in its own
    cell, the other in those that its square reaches, of which only the ones up to its own
    count: each pair meets in one cell, that of the earlier cell of the two.
    """
    # the reach is a trifle wider than the radius, so that rounding can't part two points; the filter decides
    size, reach_by = 2.5 * radius, radius * (1 + 1e-6)
    cell = lambda c: F.floor(c / size)
    home = {"hx": cell(F.col(x)), "hy": cell(F.col(y))}
    own = points.select(*keys, F.col(row).alias("p"), F.col(x).alias("px"), F.col(y).alias("py"), home["hx"].alias("cx"), home["hy"].alias("cy"))
    across, along = (F.array_distinct(F.array(cell(F.col(c) - reach_by), cell(F.col(c) + reach_by))) for c in (x, y))
    reach = points.select(*keys, F.col(row).alias("q"), F.col(x).alias("qx"), F.col(y).alias("qy"), *[c.alias(n) for n, c in home.items()], along.alias("ys"), F.explode(across).alias("cx"))
    reach = reach.filter("cx <= hx").withColumn("cy", F.explode("ys")).drop("ys").filter("cx < hx OR cy <= hy")
    near = (F.abs(F.col("px") - F.col("qx")) <= radius) & (F.abs(F.col("py") - F.col("qy")) <= radius)
    near &= (F.col("cx") != F.col("hx")) | (F.col("cy") != F.col("hy")) | (F.col("p") < F.col("q"))
    return own.join(reach, [*keys, "cx", "cy"]).filter(near).select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"))


def near_between(left: DataFrame, right: DataFrame, keys: list[str], x: str, y: str, row: str, radius: float) -> DataFrame:
    """(keys, a, b, distance) of a left and a right point with equal keys that are radius apart at most.

    Right points stand in their own square cell, left ones in those that their square reaches: each pair meets in one
    cell, with both places at hand, so none is looked up afterwards.
    """
    size, reach_by = 2.5 * radius, radius * (1 + 1e-6)
    cell = lambda c: F.floor(c / size)
    own = right.select(*keys, F.col(row).alias("b"), F.col(x).alias("bx"), F.col(y).alias("by"), cell(F.col(x)).alias("cx"), cell(F.col(y)).alias("cy"))
    # a square not wider than a cell reaches two each way at most
    ends = F.array(*[F.struct(cell(F.col(x) + i * reach_by).alias("cx"), cell(F.col(y) + j * reach_by).alias("cy"), F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 1) for j in (-1, 1)])
    reach = left.select(*keys, F.col(row).alias("a"), F.col(x).alias("ax"), F.col(y).alias("ay"), F.explode(ends).alias("e"))
    once = ((F.col("e.i") < 0) | (F.col("e.cx") != cell(F.col("ax") - reach_by))) & ((F.col("e.j") < 0) | (F.col("e.cy") != cell(F.col("ay") - reach_by)))
    reach = reach.filter(once).select(*keys, "a", "ax", "ay", "e.cx", "e.cy")
    distance = F.hypot(F.col("ax") - F.col("bx"), F.col("ay") - F.col("by"))
    near = (F.abs(F.col("ax") - F.col("bx")) <= radius) & (F.abs(F.col("ay") - F.col("by")) <= radius)
    return own.join(reach, [*keys, "cx", "cy"]).filter(near & (distance <= radius)).select(*keys, "a", "b", distance.alias("distance"))


def overlapping_runs(runs: DataFrame, keys: list[str], row: str, offset: str, lo: str, hi: str, tolerance: float, more: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, shared) of runs on nearly the same line (offsets within tolerance) that share more than tolerance of their
    extents, a < b; columns in more come along as a_.. and b_...

    Runs meet in stretches of a line twice as long as the mean run, so all runs together stand in not much more
    stretches than there are runs, and runs far apart on a line don't meet; the first stretch of both counts the pair.
    """
    mean = runs.agg(F.avg(F.col(hi) - F.col(lo))).first()[0]
    length = max(2 * (mean or 0.0), tolerance, 1e-9)
    cell = lambda c: F.floor(c / (tolerance * (1 + 1e-6)))
    part = lambda c: F.floor(c / length)
    along = F.explode(F.sequence(part(F.col(lo)), F.greatest(part(F.col(lo)), part(F.col(hi))))).alias("part")
    side = lambda s: [F.col(row).alias(s), F.col(offset).alias(f"{s}o"), F.col(lo).alias(f"{s}l"), F.col(hi).alias(f"{s}h"), *[F.col(c).alias(f"{s}_{c}") for c in more]]
    own = runs.select(*keys, *side("a"), cell(F.col(offset)).alias("cell"), along)
    other = runs.select(*keys, *side("b"), F.array(*[cell(F.col(offset)) + d for d in (-1, 0, 1)]).alias("cells"), along).withColumn("cell", F.explode("cells")).drop("cells")
    shared = F.least("ah", "bh") - F.greatest("al", "bl")
    once = F.col("part") == part(F.greatest("al", "bl"))
    pairs = own.join(other, [*keys, "cell", "part"]).filter((F.col("a") < F.col("b")) & (F.abs(F.col("ao") - F.col("bo")) <= tolerance) & (shared > tolerance) & once)
    return pairs.select("a", "b", shared.alias("shared"), *[f"{s}_{c}" for c in more for s in "ab"])


def covered(intervals: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """(keys, covered): the length that a key's intervals cover together, what several cover counting once.  In order of
    their starts, each adds what lies beyond the furthest end before it."""
    before = Window.partitionBy(*keys).orderBy(lo, hi).rowsBetween(Window.unboundedPreceding, -1)
    reached = F.coalesce(F.max(hi).over(before), F.col(lo))
    adds = F.greatest(F.lit(0.0), F.col(hi) - F.greatest(F.col(lo), reached))
    return intervals.withColumn("__adds", adds).groupBy(*keys).agg(F.sum("__adds").alias("covered"))


def most_specific(items: DataFrame, statements: DataFrame, always: list[str], stated: list[tuple[str, str, int]], entry: str, base: int) -> DataFrame:
    """items with the entry, and its score, that agrees with them in all it states and states most; the smallest of equals.

    always are columns that agree in any case; stated has pairs of an item's and a statement's column (null where a
    statement says nothing) and what agreement counts.  Each set of stated columns is a look-up of its own, the best
    first, so an item meets one statement a set and not all of its key.
    """
    sets = [[stated[k] for k in range(len(stated)) if n >> k & 1] for n in range(1 << len(stated))]
    sets.sort(key=lambda own: -sum(weight for _, _, weight in own))
    out, found, score = items, [], []
    for n, own in enumerate(sets):
        names = {column for _, column, _ in own}
        says = F.lit(True)
        for _, column, _ in stated:
            says &= F.col(column).isNotNull() if column in names else F.col(column).isNull()
        best = statements.filter(says).groupBy(*always, *[F.col(c).alias(i) for i, c, _ in own]).agg(F.min(entry).alias(f"__entry{n}"))
        out = out.join(best, [*always, *[i for i, _, _ in own]], "left")
        found.append((base + sum(weight for _, _, weight in own), f"__entry{n}"))
    for value in sorted({v for v, _ in found}, reverse=True):
        # sets that count the same compete by their entries
        entries = [c for v, c in found if v == value]
        score.append(F.when(F.coalesce(*entries).isNotNull(), F.struct(F.lit(value).alias("score"), F.least(*entries).alias(entry) if len(entries) > 1 else F.col(entries[0]).alias(entry))))
    out = out.withColumn("__best", F.coalesce(*score)).filter("__best IS NOT NULL")
    return out.select(*items.columns, f"__best.{entry}", "__best.score")


def greedy_matches(candidates: DataFrame, group: str, checkpoint) -> DataFrame:
    """One-to-one matches of each group by ascending distance, each side used once.

    candidates: group, a, b, distance (ties by a, then b).  In each round the candidates
    that are the best of both their sides are taken, and what their sides have besides goes;
    those are the ones that the order of distances takes.  Rounds end when none is left, so a
    group of any size spreads over tasks.
    """
    best = F.struct("distance", "a", "b")
    # equal candidates need not become one: they are the best together, and go together
    left = checkpoint(candidates.select(group, "a", "b", "distance"))
    taken = []
    while left.limit(1).count():
        of_a, of_b = (left.groupBy(group, side).agg(F.min(best).alias(f"best_{side}")) for side in "ab")
        mutual = of_a.select(group, "best_a.a", "best_a.b", "best_a.distance").join(of_b.select(group, "best_b.a", "best_b.b"), [group, "a", "b"])
        found = checkpoint(mutual)
        taken.append(found)
        left = checkpoint(left.join(found.select(group, "a"), [group, "a"], "left_anti").join(found.select(group, "b"), [group, "b"], "left_anti"))
    out = taken[0] if taken else left
    for more in taken[1:]:
        out = out.union(more)
    return out.select(group, "a", "b", "distance")


def against_all(asked: DataFrame, others: DataFrame, ident: str, vector: str, block: int, compare, schema: str, columns: tuple[str, ...] = ()) -> DataFrame:
    """What compare gives for each block of the vectors asked against all others, as one frame.

    The asked ones (a stated set of queries) go to the tasks in blocks of about `block` rows; every block
    reads the others once, a batch at a time, and no pairs are made but those that compare gives.
    compare takes the block's ids, its vectors, the block's further columns, and a batch's ids and vectors.
    """
    spark = asked.sparkSession
    blocks = max(1, -(-asked.count() // block))
    frames = []
    for i in range(blocks):
        own = asked.filter(F.pmod(F.xxhash64(ident), F.lit(blocks)) == i).select(ident, vector, *columns).toArrow()
        if own.num_rows:
            ids, vectors = own.column(0).to_pylist(), vectors_of(own.column(1))
            more = [own.column(2 + k).to_pylist() for k in range(len(columns))]

            def run(batches: Iterator[pa.RecordBatch], ids=ids, vectors=vectors, more=more) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for lo in range(0, len(batch), 1024):
                        part = batch.slice(lo, 1024)
                        yield from compare(ids, vectors, more, part.column(0).to_pylist(), vectors_of(part.column(1)))

            frames.append(others.select(ident, vector).mapInArrow(run, schema))
    out = frames[0] if frames else spark.createDataFrame([], schema)
    for more in frames[1:]:
        out = out.union(more)
    return out


def vectors_of(column) -> list[np.ndarray]:
    """Rows of a list column as float64; a null row has no length."""
    return [np.array(v if v is not None else [], np.float64) for v in column.to_pylist()]


def half_l1(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Half of the sum of absolute differences of each pair of vectors, to six places; 1 where lengths differ or a
    vector is missing."""
    out = np.ones((len(a), len(b)))
    for size in {len(v) for v in a} - {0}:
        i, j = ([k for k, v in enumerate(side) if len(v) == size] for side in (a, b))
        if j:
            y = np.stack([b[k] for k in j])
            for k in i:
                out[k, j] = np.abs(y - a[k]).sum(axis=1) / 2
    return np.round(out, 6)


def components(edges: DataFrame, checkpoint) -> DataFrame:
    """(node, root): the smallest node that each node of the edges (a, b) is connected with.

    Large and small stars alternate until nothing changes; each round is a few shuffles of the
    links, kept by checkpoint.
    """
    edges = checkpoint(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct())
    while True:
        # large star: larger neighbours of a node move to its smallest neighbour
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: a node and its smaller neighbours move to the smallest
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        moved = large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = checkpoint(moved.union(least.select("a", F.col("m").alias("b"))).distinct())
        was, now = (x.agg(F.count("a"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0))).first() for x in (edges, small))
        edges = small
        if tuple(was) == tuple(now):
            roots = edges.select(F.col("b").alias("node")).distinct()
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root")))
