"""Streaming forms, replayed: the events come as a stream that ends when all of the table is read, the operators of
girder.streaming keep their state, and what they put out is written to a table in the shared folder and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from girder.operators.checkpoints import checkpoint_folder
from girder.plans.registry import query
from girder.sources.tables import table
from girder.streaming import events

#: All of the table's time: a replay reads its files in any order.
LATE = "400 days"


def event_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = table(spark, sf_dir, "events")
    # a stream's path has to be a folder or a pattern, and the table may be a single file
    return spark.readStream.schema(batch.schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("ts", F.col("ts").cast("timestamp"))


def replayed(found: DataFrame, complete: bool = False) -> DataFrame:
    """The rows that a streaming frame puts out until its source ends; of a complete one those of the last batch."""
    spark = found.sparkSession
    folder = f"{checkpoint_folder(spark)}/replay-{uuid.uuid4().hex}"
    # what a source without rows leaves
    spark.createDataFrame([], found.schema).write.parquet(f"{folder}/rows")
    writer = found.writeStream.option("checkpointLocation", f"{folder}/state").trigger(availableNow=True)
    if complete:
        writer = writer.outputMode("complete").foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(f"{folder}/rows"))
        writer.start().awaitTermination()
    else:
        writer.outputMode("append").format("parquet").start(f"{folder}/rows").awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{folder}/rows")


@query("""SELECT user_id, date_trunc('minute', ts) AS minute, CAST(count(*) AS BIGINT) AS calls FROM events GROUP BY ALL""")
def replayed_rates(spark, sf_dir) -> DataFrame:
    """Calls of each key in each minute, from windows over a stream."""
    found = replayed(events.rate_windows(event_stream(spark, sf_dir), "user_id", "ts", LATE), complete=True)
    return found.select("user_id", F.col("start").cast("timestamp_ntz").alias("minute"), "calls")


@query("""SELECT DISTINCT user_id, event_type, date_trunc('minute', ts) AS minute FROM events""")
def replayed_heartbeats(spark, sf_dir) -> DataFrame:
    """One heartbeat for each user, area and minute, whatever is repeated in the stream."""
    found = replayed(events.heartbeats(event_stream(spark, sf_dir), ["user_id", "event_type"], "ts", LATE))
    return found.select("user_id", "event_type", F.col("minute").cast("timestamp_ntz").alias("minute"))


@query("""SELECT CAST(user_id AS VARCHAR) AS user_id, CAST(t AS DOUBLE) AS threshold FROM (SELECT user_id, sum(value) AS total FROM events GROUP BY user_id), (SELECT unnest([100, 500, 2000]) AS t) WHERE total >= t""")
def replayed_alerts(spark, sf_dir) -> DataFrame:
    """One alert for each user and threshold that the sum of their values reaches in the stream."""
    found = replayed(events.threshold_alerts(event_stream(spark, sf_dir), "user_id", "value", [100.0, 500.0, 2000.0]))
    return found.select("user_id", "threshold")


@query("""WITH plan AS (SELECT user_id, count(*) + CASE WHEN user_id % 3 = 0 THEN 5 ELSE 0 END AS size, count(*) * 22 // 100 AS accepted FROM events GROUP BY user_id),
d AS (SELECT e.user_id, size, accepted, row_number() OVER w AS reviewed, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) OVER w AS errors
  FROM events e JOIN plan USING (user_id) WINDOW w AS (PARTITION BY e.user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)),
v AS (SELECT *, CASE WHEN errors > accepted THEN 'escalated' WHEN reviewed = size THEN 'passed' END AS status FROM d)
SELECT CAST(user_id AS VARCHAR) AS lot, status, CAST(reviewed AS BIGINT) AS reviewed, CAST(errors AS BIGINT) AS errors FROM v WHERE status IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY reviewed) = 1""")
def sample_verdicts(spark, sf_dir) -> DataFrame:
    """Samples under review: a lot is escalated by the first error over those accepted, and passed when all of its sample is
    decided; lots of which decisions are missing have no verdict yet.  Every event decides an item of its user's lot."""
    plan = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("lot")).agg(F.count("*").alias("n"))
    plan = plan.select("lot", (F.col("n") + F.when(F.col("lot") % 3 == 0, 5).otherwise(0)).alias("size"), F.expr("n * 22 div 100").alias("accepted"))
    decided = event_stream(spark, sf_dir).select(F.col("user_id").alias("lot"), F.col("event_id").alias("at"), (F.col("event_type") == "error").alias("error")).join(plan, "lot")
    return replayed(events.reviewed_samples(decided)).select("lot", "status", "reviewed", "errors")
