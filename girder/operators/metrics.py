"""Accuracy of predictions against truth, calibration, sampling plans, and small exact statistics."""

from __future__ import annotations

import random
from collections.abc import Iterator
from fractions import Fraction
from math import comb

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def count_accuracy(truth: Column, predicted: Column) -> Column:
    """1 - |p - t| / t, not below 0; null where there is nothing to find."""
    return F.when(truth > 0, F.greatest(F.lit(0.0), 1 - F.abs(F.coalesce(predicted, F.lit(0)) - truth) / truth))


def length_error(truth: Column, predicted: Column, to_scale: Column) -> Column:
    return F.when(to_scale & (truth > 0), F.abs(F.coalesce(predicted, F.lit(0)) - truth) / truth)


def miss_and_excess(counts: DataFrame, truth: str, predicted: str, *by: str) -> DataFrame:
    """Missed items over all there are, and excess items over all found; ratios of sums, null over zero."""
    t, p = F.coalesce(F.col(truth), F.lit(0)), F.coalesce(F.col(predicted), F.lit(0))
    missed, extra = F.sum(F.greatest(t - p, F.lit(0))), F.sum(F.greatest(p - t, F.lit(0)))
    return counts.groupBy(*by).agg(F.try_divide(missed, F.sum(t)).alias("missed_rate"), F.try_divide(extra, F.sum(p)).alias("false_rate"))


def summary(values: DataFrame, value: str, reason: str, groupings: list[list[str]]) -> DataFrame:
    """Mean of the defined values, their number and that of the excluded ones, under several groupings in one pass."""
    names = list(dict.fromkeys(x for g in groupings for x in g))
    return values.groupingSets([[F.col(x) for x in g] for g in groupings], *map(F.col, names)).agg(
        F.avg(value).alias("mean"), F.count(value).alias("n"), F.count_if(F.col(value).isNull()).alias("excluded"), F.count_if(F.col(value).isNull() & (F.col(reason) == "not to scale")).alias("not_to_scale")
    )


def nearest_ranks(rows: DataFrame, by: str, value: str, shares: dict[str, float], checkpoint) -> DataFrame:
    """Percentiles of each group that are values themselves: place round(p * n), ties to even, within the values.

    Values are counted, and the counts lie in ranges of (group, value), so that a group of any size spreads over
    tasks; a value's places follow those of the ranges before its own.  Nulls have no place.
    """
    counts = rows.groupBy(by, value).agg(F.count(value).alias("n")).repartitionByRange(by, value).withColumn("part", F.spark_partition_id())
    counts = checkpoint(counts)
    ranges = counts.groupBy(by, "part").agg(F.sum("n").alias("held"))
    ahead = Window.partitionBy(by).orderBy("part")
    ranges = ranges.select(F.col(by).alias("__group"), F.col("part").alias("__range"), (F.sum("held").over(ahead) - F.col("held")).alias("before"), F.sum("held").over(Window.partitionBy(by)).alias("total"))
    placed = counts.join(ranges, F.col(by).eqNullSafe(F.col("__group")) & (F.col("part") == F.col("__range")))
    last = F.col("before") + F.sum("n").over(Window.partitionBy(by, "part").orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    placed = placed.withColumn("last", last)

    def at(p: float) -> Column:
        place = F.greatest(F.lit(1), F.rint(F.col("total") * p).cast("long"))
        return F.max(F.when((F.col("n") > 0) & (F.col("last") - F.col("n") < place) & (place <= F.col("last")), F.col(value)))

    return placed.groupBy(by).agg(*[at(p).alias(name) for name, p in shares.items()])


def reliability(outcomes: DataFrame, confidence: str, correct: str, bins: int = 10) -> DataFrame:
    """count, mean confidence and accuracy of each bin; edges are i / bins, and the last bin holds 1."""
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    place = F.size(F.filter(edges, lambda e: F.col(confidence) >= e))
    return outcomes.groupBy(place.alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("confidence"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("calibration_error"))


def pooled(scores: DataFrame, score: str, correct: str, places: int = 3) -> DataFrame:
    """weight and accuracy of each score, rounded to so many places, by which an isotonic fit is bounded."""
    return scores.groupBy(F.round(score, places).alias("score")).agg(F.count("*").alias("weight"), F.avg(F.col(correct).cast("double")).alias("accuracy"))


def isotonic(points: list[tuple[float, float, float]]) -> list[tuple[float, float]]:
    """Pool-adjacent-violators over (score, accuracy, weight) of distinct scores: (score, fitted), not falling."""
    blocks: list[list] = []
    for score, value, weight in sorted(points):
        blocks.append([[score], value, weight])
        while len(blocks) > 1 and blocks[-2][1] > blocks[-1][1]:
            scores, value, weight = blocks.pop()
            last = blocks[-1]
            last[1] = (last[1] * last[2] + value * weight) / (last[2] + weight)
            last[2] += weight
            last[0] += scores
    return [(s, value) for scores, value, _ in blocks for s in scores]


def fitted_by(scores: DataFrame, family: str, score: str, correct: str, places: int = 3) -> DataFrame:
    """(family, score, fitted): an isotonic fit of each family at every score between 0 and 1 of so many places, linear
    between the scores that occur and flat beyond them.

    Scores are counted by family and rounded score first, so a family is one group of 10**places + 1 rows at most, however
    many outcomes it has, and no fit goes through the driver.
    """
    import numpy as np
    import pandas as pd

    steps = 10**places

    def fit(own: pd.DataFrame) -> pd.DataFrame:
        points = isotonic(list(zip(own["score"], own["accuracy"], own["weight"])))
        grid = np.arange(steps + 1) / steps
        values = np.interp(grid, [p[0] for p in points], [p[1] for p in points])
        return pd.DataFrame({family: own[family].iloc[0], "score": grid, "fitted": values})

    counted = scores.groupBy(family, F.round(score, places).alias("score")).agg(F.count("*").alias("weight"), F.avg(F.col(correct).cast("double")).alias("accuracy"))
    kind = scores.schema[family].dataType.simpleString()
    return counted.filter("score IS NOT NULL").groupBy(family).applyInPandas(fit, f"`{family}` {kind}, score double, fitted double")


def holdout_report(outcomes: DataFrame, family: str, score: str, correct: str, held_out: str, places: int = 3, bins: int = 10) -> DataFrame:
    """(family, train, holdout, accuracy, raw_error, error): calibration errors of held-out outcomes, as scored and after a
    fit to the others of their family; null without any held out, and the scored ones' alone without a fit."""
    fit = fitted_by(outcomes.filter(~F.col(held_out)), family, score, correct, places)
    key = F.round(F.col("score") * 10**places).cast("long").alias("__key")
    tests = outcomes.filter(held_out).select(family, F.col(score).alias("raw"), F.col(correct).cast("double").alias("right"), F.round(F.col(score) * 10**places).cast("long").alias("__key"))
    tests = tests.join(fit.select(family, key, F.round("fitted", 6).alias("said")), [family, "__key"], "left")
    edges = F.array(*[F.lit(i / bins) for i in range(1, bins)])
    place = lambda c: F.size(F.filter(edges, lambda e: F.col(c) >= e))

    def error(c: str, name: str) -> DataFrame:
        per = tests.filter(F.col(c).isNotNull()).groupBy(family, place(c).alias("bin")).agg(F.count("*").alias("n"), F.avg(c).alias("said"), F.avg("right").alias("was"))
        return per.groupBy(family).agg((F.sum(F.col("n") * F.abs(F.col("said") - F.col("was"))) / F.sum("n")).alias(name))

    sizes = outcomes.groupBy(family).agg(F.count_if(~F.col(held_out)).alias("train"), F.count_if(F.col(held_out)).alias("holdout"), F.avg(F.when(F.col(held_out), F.col(correct).cast("double"))).alias("accuracy"))
    return sizes.join(error("raw", "raw_error"), family, "left").join(error("said", "error"), family, "left")


def interpolated(value: Column, fit: list[tuple[float, float]]) -> Column:
    """The fitted value at a score: linear between its points, flat beyond them, null without any."""
    if not fit:
        return F.lit(None).cast("double")
    # the first point above a score is found in a sorted array, one comparison a point
    scores, values = (F.array(*[F.lit(p[i]) for p in fit]) for i in (0, 1))
    above = F.array_position(F.transform(scores, lambda s: s > value), True).cast("int")
    x0, x1, y0, y1 = (F.try_element_at(c, above + d) for c in (scores, values) for d in (-1, 0))
    between = y0 + (value - x0) * ((y1 - y0) / (x1 - x0))
    return F.when(value.isNull(), None).when(above == 0, fit[-1][1]).when(above == 1, fit[0][1]).otherwise(between)


def chance_of_passing(lot: int, wrong: int, sample: int, accept: int) -> Fraction:
    """The exact chance that a sample of a lot shows at most `accept` of its wrong ones."""
    if not 0 <= sample <= lot or not 0 <= wrong <= lot:
        raise ValueError("a sample or a number of wrong ones is no part of the lot")
    # drawing the wrong ones among those sampled is the same chance, and the fewer are drawn the smaller the numbers
    sample, wrong = min(sample, wrong), max(sample, wrong)
    ways = sum(comb(wrong, k) * comb(lot - wrong, sample - k) for k in range(0, min(accept, sample) + 1))
    return Fraction(ways, comb(lot, sample))


def smallest_sample(lot: int, wrong: int, accept: int, confidence: Fraction) -> int:
    """The least sample that a lot with so many wrong ones passes with a chance of 1 - confidence at most.

    Samples double until one is large enough, so the numbers are those of about the sample sought and not of half the lot.
    """
    lo = hi = min(accept + 1, lot)
    while hi < lot and chance_of_passing(lot, wrong, hi, accept) > 1 - confidence:
        lo, hi = hi + 1, min(2 * hi, lot)
    while lo < hi:
        mid = (lo + hi) // 2
        if chance_of_passing(lot, wrong, mid, accept) <= 1 - confidence:
            hi = mid
        else:
            lo = mid + 1
    return lo


def latest_by_order(candidates: DataFrame, group: str, ident: str, series: str, number: str, day: str) -> DataFrame:
    """The candidate of each group that is later than every other: by number within a series, else by day.
    Where two can't be ordered there is none.

    Each series is first brought to its highest number and newest day, each group then to the newest day
    of its series and the next one: no candidates meet in pairs.  Candidates dealt by group are not dealt again.
    """
    # a candidate without a series is ordered by day alone, as a series of its own
    own = candidates.withColumn("__series", F.when(F.col(series).isNotNull(), F.struct(F.col(series).cast("string"), F.lit(None).cast("string"))).otherwise(F.struct(F.lit(None).cast("string"), F.col(ident).cast("string"))))
    steps = own.groupBy(group, "__series", number).agg(F.count("*").alias("__n"), F.max(ident).alias("__ident"), F.max(day).alias("__day"), F.count(day).alias("__days"))
    per = steps.groupBy(group, "__series").agg(
        F.max(F.struct(F.col(number).alias("number"), F.col("__n").alias("n"), F.col("__ident").alias("ident"), F.col("__day").alias("own_day"))).alias("top"),
        F.sum("__n").alias("n"), F.sum("__days").alias("days"), F.max("__day").alias("newest"), F.count_if(F.col(number).isNull()).alias("unnumbered"),
    )
    whole = Window.partitionBy(group)
    per = per.withColumns({"newest_all": F.max("newest").over(whole), "n_all": F.sum("n").over(whole), "days_all": F.sum("days").over(whole)})
    at_top = F.col("newest") == F.col("newest_all")
    per = per.withColumns({"at_top": F.count_if(at_top).over(whole), "second": F.max(F.when(~at_top, F.col("newest"))).over(whole)})
    others = F.when((F.col("newest") == F.col("newest_all")) & (F.col("at_top") == 1), F.col("second")).otherwise(F.col("newest_all"))
    first_of_series = (F.col("n") == 1) | ((F.col("top.n") == 1) & (F.col("unnumbered") == 0))
    alone = F.col("n") == F.col("n_all")
    days_known = F.col("n_all") - F.col("n") == F.col("days_all") - F.col("days")
    wins = first_of_series & (alone | (days_known & F.coalesce(F.col("top.own_day") > others, F.lit(False))))
    return per.groupBy(group).agg(F.max(F.when(wins, F.col("top.ident"))).alias(ident))


def regressions(baseline: DataFrame, result: DataFrame, name: str, value: str, higher_is_better: str, tolerance: float) -> DataFrame:
    """Metrics that got worse by more than a tolerance, and those that are missing."""
    was, now = baseline.select(name, F.col(value).alias("was"), higher_is_better), result.select(name, F.col(value).alias("now"))
    worse = F.when(F.col(higher_is_better), F.col("was") - F.col("now")).otherwise(F.col("now") - F.col("was"))
    reason = F.when(F.col("now").isNull(), "missing").when(worse > tolerance, "worse")
    return was.join(now, name, "left").withColumn("reason", reason).filter("reason IS NOT NULL").select(name, "was", "now", "reason")


def seeded_draws(items: DataFrame, lot: str, item: str, size: int) -> DataFrame:
    """(lot, item): a repeatable sample of each lot's different items, drawn by a generator that the lot's number seeds.

    The generator needs the number of items only and gives places in their order, so no lot is ever one row: items get
    their places by a window, and those drawn join them.
    """
    import pandas as pd

    def draw(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            picked = [(k, place + 1) for k, n in zip(frame[lot], frame["n"]) for place in random.Random(int(k)).sample(range(n), min(size, n))]
            yield pd.DataFrame(picked, columns=[lot, "place"])

    different = items.select(lot, item).distinct()
    kind = items.schema[lot].dataType.simpleString()
    places = different.groupBy(lot).agg(F.count("*").alias("n")).mapInPandas(draw, f"`{lot}` {kind}, place int")
    placed = different.withColumn("place", F.row_number().over(Window.partitionBy(lot).orderBy(item)))
    return placed.join(places, [lot, "place"]).select(lot, item)


def running_share(rows: DataFrame, by: str, order: str, value: str) -> DataFrame:
    w = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("running", F.sum(value).over(w))
