"""Spans of regular expressions in text columns, with DataFrame functions alone.

Spark's regular expressions give the matches of a text but not their places.  The
pieces between matches (`split` by the same expression) give those: a match starts
where the lengths of all pieces and matches before it end.  Lengths count code
points, and ends are exclusive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,stop:bigint,found:string>"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def walk(items: Column, start: Column, step: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """What a walk over an array puts out: start is a struct with an empty array `out`, and step gives the struct after an
    item, with at most a few values more in it.

    Appending copies an array, so a walk that put out a long one at once would take quadratic time.  The items go in
    blocks, each with an `out` of its own, and those are joined at the end.
    """
    empty = F.slice(start["out"], F.lit(1), F.lit(0))

    def blocks(all_items: Column) -> Column:
        last = F.floor((F.size(all_items) - 1) / block).cast("int")
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(all_items, i * block + 1, F.lit(block)))

    def go(acc: Column, own: Column) -> Column:
        return F.concat(acc, F.array(F.aggregate(own, F.element_at(acc, -1).withField("out", empty), step)))

    # an array of one lets the items be computed once for all blocks
    dealt = F.transform(F.array(items), blocks)[0]
    return F.when(F.size(items) > 0, F.flatten(F.transform(F.aggregate(dealt, F.array(start), go), lambda a: a["out"]))).otherwise(empty)


def placed(text: Column, found: Column, pattern: str) -> Column:
    """array<struct<start, stop, found>> of the matches `found` of pattern in text."""
    none = F.lit(None).cast(f"array<{SPAN}>")
    empty = F.coalesce(none, F.array().cast(f"array<{SPAN}>"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"]).cast("long")
        stop = start + F.length(x["found"]).cast("long")
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["found"].alias("found")))).alias("out"))

    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    pairs = F.zip_with(gaps, found, lambda g, m: F.struct(g.alias("gap"), m.alias("found")))
    walked = walk(pairs, F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), step)
    return F.when(F.size(found) > 0, walked).otherwise(empty)


def joined(spans: Column) -> Column:
    """kind:start:end of each struct<kind, start, stop>, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))), ",")
