import datetime

from pyspark.sql import functions as F

from girder.streaming import events as S


def run(spark, stream, name, mode="append"):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name)


def source(spark, sf_dir, tmp_path):
    spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")).repartition(3).write.parquet(str(tmp_path / "in"))
    batch = spark.read.parquet(str(tmp_path / "in"))
    return batch, spark.readStream.schema(batch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_rate_windows_equal_the_batch(spark, sf_dir, tmp_path):
    batch, stream = source(spark, sf_dir, tmp_path)
    got = run(spark, S.rate_windows(stream, "user_id", "ts", late="60 days"), "rates", "complete")
    want = batch.groupBy("user_id", F.date_trunc("minute", "ts").alias("start")).count()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_heartbeats(spark, sf_dir, tmp_path):
    batch, stream = source(spark, sf_dir, tmp_path)
    got = run(spark, S.heartbeats(stream, ["user_id", "event_type"], "ts", late="60 days"), "beats")
    assert got.count() == batch.select("user_id", "event_type", F.date_trunc("minute", "ts")).distinct().count()


def test_alerts_come_once(spark, sf_dir, tmp_path):
    batch, stream = source(spark, sf_dir, tmp_path)
    got = run(spark, S.threshold_alerts(stream, "event_type", "value", [100.0, 1000.0]), "alerts").collect()
    totals = {r[0]: r[1] for r in batch.groupBy("event_type").agg(F.sum("value")).collect()}
    assert sorted((r.event_type, r.threshold) for r in got) == sorted((k, t) for k, v in totals.items() for t in (100.0, 1000.0) if v >= t)


def test_cap(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 0, 0)
    rows = [("a", at + datetime.timedelta(seconds=s)) for s in (0, 1, 2, 61, 62)] + [("b", at)]
    spark.createDataFrame(rows, "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("k string, ts timestamp").parquet(str(tmp_path / "in"))
    got = run(spark, S.admitted(stream, "k", "ts", 2), "caps").collect()
    assert sorted((r.k, r.admitted) for r in got) == [("a", False), ("a", True), ("a", True), ("a", True), ("a", True), ("b", True)]


def test_state_of_a_cap_goes_with_the_watermark(spark, tmp_path):
    at = datetime.datetime(2024, 1, 1, 10, 0, 0)
    for i, (k, minutes) in enumerate([("a", 0), ("b", 60), ("c", 180), ("d", 181)]):
        spark.createDataFrame([(k, at + datetime.timedelta(minutes=minutes))], "k string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    stream = spark.readStream.schema("k string, ts timestamp, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = S.admitted(stream, "k", "ts", 2).writeStream.format("memory").queryName("states").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("states").count() == 4 and spark.table("states").filter("admitted").count() == 4
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] < 4


def test_upserts_keep_the_newest_row(spark, tmp_path):
    target = str(tmp_path / "t")
    write = S.upserts(target, ["k"], "v", 4)
    assert S.upserted(spark, target) is None
    write(spark.createDataFrame([(i, 1) for i in range(20)], "k int, v int"), 0)
    for _ in range(2):  # a batch that is run again changes nothing
        write(spark.createDataFrame([(2, 5), (30, 1), (3, 0)], "k int, v int"), 1)
    rows = S.upserted(spark, target).select("k", "v").collect()
    assert sorted(map(tuple, rows)) == [(i, 5 if i == 2 else 1) for i in [*range(20), 30]]
    assert spark.read.parquet(target).filter("version = 1").select("bucket").distinct().count() <= 3


def test_chains_go_on_over_batches(spark, tmp_path):
    rows = [(k, i, f"b{k}{i}") for i in range(6) for k in "xy"]
    for i in range(3):
        spark.createDataFrame(rows[4 * i : 4 * i + 4], "k string, o int, body string").coalesce(1).write.parquet(str(tmp_path / f"in/p={i}"))
    stream = spark.readStream.schema("k string, o int, body string, p int").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = {(r.k, r.seq): (r.prev_hash, r.hash) for r in run(spark, S.chained(stream, "k", "o", "body"), "chains").collect()}
    assert len(got) == 12
    for k in "xy":
        assert got[k, 1][0] == "" and all(got[k, i][1] == got[k, i + 1][0] for i in range(1, 6))


def test_periodic_jobs_and_deadlines(spark, tmp_path):
    ran = []
    q = S.periodic(spark, 0.5, ran.append).option("checkpointLocation", str(tmp_path / "clock")).start()
    q.awaitTermination(8)
    q.stop()
    assert len(ran) >= 2 and ran == sorted(set(ran))
    day = datetime.date(2024, 3, 1)
    items = [(i, day + datetime.timedelta(days=d), s) for i, (d, s) in enumerate([(0, "open"), (2, "open"), (7, "open"), (9, "open"), (1, "closed"), (-1, "open")])]
    sent = spark.createDataFrame([(1, 3)], "item int, days int")
    deadlines = spark.createDataFrame(items, "item int, deadline date, status string")
    assert sorted(map(tuple, S.deadline_alerts(deadlines, sent, day, [7, 3, 1]).collect())) == [(0, 1), (2, 7)]


def test_stalled_jobs(spark):
    now = datetime.datetime(2024, 1, 1, 12)
    jobs = spark.createDataFrame([(1, "doing", "w1", 1), (2, "doing", "w2", 1), (3, "doing", "gone", 3), (4, "done", "gone", 1)], "job int, status string, worker string, attempts int")
    workers = spark.createDataFrame([("w1", now), ("w2", now - datetime.timedelta(seconds=301))], "worker string, beat timestamp")
    assert sorted(map(tuple, S.stalled(jobs, workers, now).collect())) == [(2, "retry"), (3, "fail")]


def test_samples_are_judged_once_over_batches(spark, tmp_path):
    rows = [("a", i, i in (1, 3, 4), 6, 1) for i in range(6)] + [("b", i, i == 2, 4, 1) for i in range(4)] + [("c", 0, False, 3, 0)]
    df = spark.createDataFrame(rows, "lot string, at int, error boolean, size int, accepted int")
    for i in range(6):
        df.filter(F.col("at") == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = run(spark, S.reviewed_samples(stream), "samples").collect()
    assert sorted(map(tuple, got)) == [("a", "escalated", 4, 2), ("b", "passed", 4, 1)]
