"""Snapshots, deltas, recomputation and hash chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def digest(*columns, length: int = 24) -> Column:
    """A short hash of values; nulls and empty strings differ."""
    return F.substring(F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256), 1, length)


def delta(was: DataFrame, now: DataFrame, key: str, values: list[str]) -> DataFrame:
    """key, change (added, removed, changed, unchanged) and the values of both sides, as was_x and now_x."""
    a = was.select(key, *[F.col(v).alias(f"was_{v}") for v in values], F.lit(True).alias("__was"))
    b = now.select(key, *[F.col(v).alias(f"now_{v}") for v in values], F.lit(True).alias("__now"))
    same = F.lit(True)
    for v in values:
        same &= F.col(f"was_{v}").eqNullSafe(F.col(f"now_{v}"))
    change = F.when(F.col("__was").isNull(), "added").when(F.col("__now").isNull(), "removed").when(same, "unchanged").otherwise("changed")
    return a.join(b, key, "full").withColumn("change", change).drop("__was", "__now")


def recompute(stored: DataFrame, drafts: DataFrame, key: str, inputs: str) -> DataFrame:
    """key, action: what a recomputation does with each item.  Equal inputs keep it, other inputs or no draft supersede it."""
    a = stored.select(key, F.col(inputs).alias("__old"))
    b = drafts.select(key, F.col(inputs).alias("__new"))
    action = F.when(F.col("__old").isNull(), "create").when(F.col("__new").isNull(), "supersede").when(F.col("__old") == F.col("__new"), "keep").otherwise("replace")
    return a.join(b, key, "full").select(key, action.alias("action"))


def chain(events: DataFrame, chain_key: str, order: list[str], body: list[str]) -> DataFrame:
    """events with seq and body_hash in each chain; linked() adds the hashes."""
    w = Window.partitionBy(chain_key).orderBy(*order)
    return events.withColumn("seq", F.row_number().over(w)).withColumn("body_hash", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in body]), 256))


def linked(events: DataFrame, chain_key: str) -> DataFrame:
    """(chain, seq, prev_hash, hash, body_hash) of chained events: hash = sha256(prev_hash : body_hash).

    A link needs the one before, so the rows of a chain are walked in order, in one task; what is kept
    from row to row is one hash, however long the chain is.
    """
    fields = events.select(chain_key, "seq", "body_hash").schema
    schema = T.StructType([*fields.fields, T.StructField("prev_hash", T.StringType()), T.StructField("hash", T.StringType())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chain, last, begun = None, "", False
        for batch in batches:
            before, own = [], []
            for key, body in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
                if not begun or key != chain:
                    chain, last, begun = key, "", True
                before.append(last)
                last = hashlib.sha256(f"{last}:{body}".encode()).hexdigest()
                own.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(own, pa.string())], names=[*batch.schema.names, "prev_hash", "hash"])

    sorted_rows = events.select(chain_key, "seq", "body_hash").repartition(chain_key).sortWithinPartitions(chain_key, "seq")
    return sorted_rows.mapInArrow(walk, schema)


def chain_problems(links: DataFrame, chain_key: str) -> DataFrame:
    """Rows of (chain, seq, prev_hash, body_hash, hash) that do not follow from the row before, with the reason."""
    w = Window.partitionBy(chain_key).orderBy("seq")
    rows = links.withColumn("__n", F.row_number().over(w)).withColumn("__before", F.coalesce(F.lag("hash").over(w), F.lit("")))
    reason = (
        F.when(F.col("seq") != F.col("__n"), "gap in the sequence")
        .when(F.col("prev_hash") != F.col("__before"), "previous hash differs")
        .when(F.col("hash") != F.sha2(F.concat_ws(":", "prev_hash", "body_hash"), 256), "own hash differs")
    )
    return rows.withColumn("reason", reason).filter("reason IS NOT NULL").drop("__n", "__before")


def transitions(rows: DataFrame, legal: list[tuple[str, str, str]], source: str, target: str, role: str) -> DataFrame:
    """rows with problem: null where (source, target, role) is a legal step."""
    known = F.array(*[F.lit("|".join(x)) for x in legal])
    pairs = F.array(*[F.lit(f"{a}|{b}") for a, b, _ in legal])
    step = F.concat_ws("|", source, target)
    problem = F.when(F.array_contains(known, F.concat_ws("|", step, role)), None).when(F.array_contains(pairs, step), "role may not").otherwise("no such step")
    return rows.withColumn("problem", problem)
