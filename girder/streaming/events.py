"""Structured Streaming forms of the operators that follow a clock: rate windows, heartbeats, alerts, chains.

Each takes and returns a streaming DataFrame, so source and sink are the caller's.
Late events are bounded by a watermark, and with it the state that is kept.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def rate_windows(events: DataFrame, key: str, at: str, late: str = "10 minutes", width: str = "1 minute") -> DataFrame:
    """Calls of each key in each tumbling window."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("window"), key).agg(F.count("*").alias("calls")).select(key, F.col("window.start").alias("start"), "calls")


def admitted(events: DataFrame, key: str, at: str, cap: int, width_seconds: int = 60, late: str = "10 minutes") -> DataFrame:
    """Events with whether the cap of their key and window lets them through, in order of arrival.

    State is one window start and one count a key; it goes when the watermark passes the window's end.  As only the newest
    window of a key is kept, a late event of an earlier window is refused, even if that window had room.
    """
    schema = f"{key} string, at timestamp, admitted boolean"

    def decide(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        start, used = state.get if state.exists else (0, 0)
        for frame in frames:
            rows = []
            for at_ in frame.sort_values("at")["at"]:
                window = int(at_.timestamp()) // width_seconds * width_seconds
                if window > start:
                    start, used = window, 0
                rows.append((str(group[0]), at_, window == start and used < cap))
                used += window == start
            yield pd.DataFrame(rows, columns=[key, "at", "admitted"])
        state.update((start, used))
        state.setTimeoutTimestamp(max((start + width_seconds) * 1000, state.getCurrentWatermarkMs() + 1))

    keyed = events.select(F.col(key).cast("string").alias(key), F.col(at).cast("timestamp").alias("at")).withWatermark("at", late)
    return keyed.groupBy(key).applyInPandasWithState(decide, schema, "start long, used long", "append", "EventTimeTimeout")


def chained(events: DataFrame, key: str, order: str, body_hash: str) -> DataFrame:
    """(chain, seq, prev_hash, hash) of an append-only log: each batch's rows, in order, go on from the last hash of their
    chain, which with its number is the state."""
    schema = f"{key} string, seq long, prev_hash string, hash string"

    def link(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        seq, last = state.get if state.exists else (0, "")
        # a batch's rows of one chain come in several frames; their order is that of all of them
        rows, out = pd.concat(list(frames)).sort_values(order, kind="stable"), []
        for body in rows[body_hash]:
            seq, before = seq + 1, last
            last = hashlib.sha256(f"{before}:{body}".encode()).hexdigest()
            out.append((str(group[0]), seq, before, last))
        state.update((seq, last))
        yield pd.DataFrame(out, columns=[key, "seq", "prev_hash", "hash"])

    keyed = events.select(F.col(key).cast("string").alias(key), order, body_hash)
    return keyed.groupBy(key).applyInPandasWithState(link, schema, "seq long, hash string", "append", "NoTimeout")


def periodic(spark: SparkSession, seconds: float, job: Callable[[int], None]) -> DataStreamWriter:
    """A writer that runs job(period) every so many seconds of processing time.  With a checkpointLocation set on it, the
    periods go on counting after a restart, and those that were missed run once."""
    clock = spark.readStream.format("rate").option("rowsPerSecond", 1).load()
    return clock.writeStream.foreachBatch(lambda _, period: job(period)).trigger(processingTime=f"{seconds} seconds")


def deadline_alerts(deadlines: DataFrame, sent: DataFrame, today, days_before: list[int]) -> DataFrame:
    """(item, days) of the alerts that are due and were not sent: an open item's deadline is so many days ahead or fewer.
    Of several alerts of an item that are due the last one, with the fewest days, counts."""
    left = F.datediff("deadline", F.lit(today).cast("date"))
    due = F.array_min(F.filter(F.array(*[F.lit(d) for d in days_before]), lambda d: d >= left))
    rows = deadlines.filter((F.col("status") == "open") & (left >= 0)).select("item", due.alias("days")).filter("days IS NOT NULL")
    return rows.join(sent.select("item", "days"), ["item", "days"], "left_anti")


def heartbeats(events: DataFrame, keys: list[str], at: str, late: str = "10 minutes") -> DataFrame:
    """One row for each user, area and minute; repeats within the watermark are dropped."""
    minutes = events.withColumn("minute", F.date_trunc("minute", at)).withWatermark("minute", late)
    return minutes.dropDuplicatesWithinWatermark([*keys, "minute"]).select(*keys, "minute")


def sessions(events: DataFrame, key: str, at: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("session"), key).agg(F.count("*").alias("n")).select(key, F.col("session.start").alias("start"), F.col("session.end").alias("end"), "n")


def threshold_alerts(spend: DataFrame, key: str, amount: str, thresholds: list[float]) -> DataFrame:
    """One alert for each key and threshold, when its running sum first reaches it."""
    schema = f"{key} string, threshold double, total double"

    def watch(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        (total,) = state.get if state.exists else (0.0,)
        alerts = []
        for frame in frames:
            for x in frame[amount]:
                alerts += [(str(group[0]), t, total + x) for t in thresholds if total < t <= total + x]
                total += float(x)
        state.update((total,))
        yield pd.DataFrame(alerts, columns=[key, "threshold", "total"])

    keyed = spend.select(F.col(key).cast("string").alias(key), F.col(amount).cast("double").alias(amount))
    return keyed.groupBy(key).applyInPandasWithState(watch, schema, "total double", "append", "NoTimeout")


def reviewed_samples(decisions: DataFrame) -> DataFrame:
    """(lot, status, reviewed, errors), once a lot: `escalated` with the first error over those accepted, `passed` when all
    of the sample is decided without that.

    decisions: lot, at, error, size (of the sample) and accepted (errors).  State is two counts a lot and whether its
    verdict is out; what is decided after that changes nothing.
    """
    schema = "lot string, status string, reviewed long, errors long"

    def judge(group: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        reviewed, errors, done = state.get if state.exists else (0, 0, False)
        # a batch's rows of a lot come in several frames
        rows, out = pd.concat(list(frames)).sort_values("at", kind="stable"), []
        for error, size, accepted in zip(rows["error"], rows["size"], rows["accepted"]):
            if done:
                break
            reviewed, errors = reviewed + 1, errors + int(error)
            status = "escalated" if errors > accepted else "passed" if reviewed == size else None
            if status:
                done = True
                out.append((str(group[0]), status, reviewed, errors))
        state.update((reviewed, errors, done))
        yield pd.DataFrame(out, columns=["lot", "status", "reviewed", "errors"])

    keyed = decisions.select(F.col("lot").cast("string").alias("lot"), "at", "error", "size", "accepted")
    return keyed.groupBy("lot").applyInPandasWithState(judge, schema, "reviewed long, errors long, done boolean", "append", "NoTimeout")


def upserts(target: str, key: list[str], order: str, buckets: int = 64) -> Callable[[DataFrame, int], None]:
    """A foreachBatch writer: a table at a path that holds the newest row of each key; upserted() reads it.

    Keys fall into buckets by hash.  A batch writes a new version of the buckets that it touches, and of no others,
    named by the batch, so a batch that is run again overwrites its own versions alone.
    """
    from girder.operators.lookup import latest

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)).cast("int"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]
        before = upserted(spark, target, number)
        if before is not None:
            rows = before.filter(F.col("bucket").isin(touched)).unionByName(rows)
        out = latest(rows, key, F.desc(order)).withColumn("version", F.lit(number))
        out.repartition("bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "version").parquet(target)

    return write


def upserted(spark: SparkSession, target: str, before: int | None = None) -> DataFrame | None:
    """The rows of a table of upserts with their bucket: the newest version of each bucket (before a batch, if one is
    given); None if there is no such table.  Older versions may be deleted once no reader needs them."""
    try:
        rows = spark.read.parquet(target)
    except AnalysisException:
        return None
    if before is not None:
        rows = rows.filter(F.col("version") < before)
    newest = rows.groupBy("bucket").agg(F.max("version").alias("version"))
    return rows.join(newest, ["bucket", "version"], "left_semi").drop("version")


def stalled(jobs: DataFrame, workers: DataFrame, now, silent_seconds: int = 300, most: int = 3) -> DataFrame:
    """Jobs in progress whose worker is absent or silent, and what becomes of them: retry, or fail after so many attempts."""
    beat = F.col("beat").cast("timestamp") < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {silent_seconds} SECONDS")
    doing = jobs.filter("status = 'doing'").join(workers.select("worker", "beat"), "worker", "left").filter(F.col("beat").isNull() | beat)
    return doing.select("job", F.when(F.col("attempts") >= most, "fail").otherwise("retry").alias("action"))


def queued_once(jobs: DataFrame, queued: DataFrame, lock: str, order: str) -> DataFrame:
    """New jobs to queue: of those with one lock the earliest, and none whose lock is queued already.  Jobs without a lock all are."""
    from girder.operators.lookup import latest

    free = jobs.filter(F.col(lock).isNotNull()).join(queued.filter("status = 'todo'").select(lock).distinct(), lock, "left_anti")
    return latest(free, [lock], F.asc(order)).unionByName(jobs.filter(F.col(lock).isNull()))
