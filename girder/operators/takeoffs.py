"""What is drawn several times, on plans of one level: which side is kept, and what the others lose."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from girder.operators import lookup


def duplicate_runs(runs: DataFrame, tolerance: float) -> DataFrame:
    """(run, twins, excluded, kept_sheet, carried_dn) of runs that have twins on better sheets.

    runs: run, level, sheet, rank, at (the offset of its line), lo, hi, dn.  Two runs of a level, of different sheets, are
    twins if their lines and more than tolerance of their extents agree.  The one with the smaller (rank, sheet) is kept;
    the other loses what all its kept twins cover together, and takes their size where it states none.
    """
    found = lookup.overlapping_runs(runs, ["level"], "run", "at", "lo", "hi", tolerance, ("sheet", "rank", "lo", "hi", "dn")).filter("a_sheet <> b_sheet")
    first = F.struct("a_rank", "a_sheet") < F.struct(F.col("b_rank").alias("a_rank"), F.col("b_sheet").alias("a_sheet"))
    kept, other = (lambda c: F.when(first, F.col(f"a{c}")).otherwise(F.col(f"b{c}"))), (lambda c: F.when(first, F.col(f"b{c}")).otherwise(F.col(f"a{c}")))
    twins = found.select(
        other("").alias("run"), kept("").alias("kept"), other("_dn").alias("dn"), kept("_dn").alias("kept_dn"), F.struct(kept("_rank").alias("rank"), kept("_sheet").alias("sheet")).alias("side"),
        F.greatest("a_lo", "b_lo").alias("lo"), F.least("a_hi", "b_hi").alias("hi"), (other("_hi") - other("_lo")).alias("length"),
    )
    sized = F.when(F.col("kept_dn").isNotNull(), F.struct("side", "kept"))
    per = twins.groupBy("run").agg(
        F.count("*").alias("twins"), F.min("length").alias("length"), F.min("side")["sheet"].alias("kept_sheet"), F.min("dn").alias("dn"), F.min_by("kept_dn", sized).alias("lent")
    )
    out = per.join(lookup.covered(twins, ["run"], "lo", "hi"), "run")
    return out.select("run", "twins", F.least("covered", "length").alias("excluded"), "kept_sheet", F.when(F.col("dn").isNull(), F.col("lent")).alias("carried_dn"))
