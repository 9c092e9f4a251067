"""Streams in event-time order: late hits, open tails, job ends, state that goes back to zero, retried sinks."""

from datetime import datetime, timezone

from pyspark.sql import functions as F

from labelgrove.operators import library as L
from labelgrove.plans.library_queries import with_state_store
from labelgrove.streaming import limiter as LIM
from labelgrove.streaming import merging as MG
from labelgrove.streaming import ordered as O

FAR = 10_000_000


def drain(spark, tmp_path, batches, schema, build):
    """Rows that come out of `build(stream)` fed with one file per batch, and the state rows left."""
    class T:
        pass
    T.spark = spark
    with_state_store(T)
    folder = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(folder)
    timed = stream.withColumn("ts", F.timestamp_seconds("s"))
    got = []
    query = build(timed).writeStream.foreachBatch(lambda b, _: got.extend(tuple(r) for r in b.collect())).option(
        "checkpointLocation", str(tmp_path / "checkpoint")).trigger(availableNow=True).start()
    query.awaitTermination()
    return got, sum(o["numRowsTotal"] for o in query.lastProgress["stateOperators"])


def test_late_hits_change_nothing(spark, tmp_path):
    hits = [("a", 1, 100.0), ("a", 2, 130.0), ("a", 3, 101.0), ("a", 4, 159.0), ("b", 5, 90.0), ("a", 6, 161.5), ("b", 7, 150.5)]
    batches = [[hits[1], hits[4]], [hits[0], hits[6]], [hits[3]], [hits[2], hits[5]], [("", O.TICK, float(FAR))]]
    got, state = drain(spark, tmp_path, batches, "key string, event_id long, s double",
                       lambda s: O.limit_stream_in_order(s.select("key", "event_id", F.col("s").alias("ts")), 2, 60, "100 seconds"))
    log = spark.createDataFrame(hits, "key string, event_id long, ts double")
    want = {(r.key, r.event_id): (r.allowed, r.remaining) for r in LIM.limit_log(log, 2, 60).collect()}
    assert {(r[0], r[1]): (r[3], r[4]) for r in got} == want and len(got) == len(hits)
    assert state == 0


def test_admission_equals_batch(spark, tmp_path):
    day = 86400
    changes = [(float(100 + 7 * i), 2, i, i % 3) for i in range(20)] + [(float(105 + 7 * i), 1, i, i % 3) for i in range(0, 20, 2)] + [
        (float(180 + 9 * i), 0, i, i % 3) for i in range(0, 20, 4)] + [(float(day + 10 * i), 2, 100 + i, i % 2) for i in range(6)]
    batches = [changes[1::3], changes[0::3], changes[2::3], [(float(FAR), O.TICK, -1, -1)]]
    schema = "s double, step int, job_id long, user_id long"
    got, _ = drain(spark, tmp_path, batches, schema, lambda s: O.admission_stream(s, 4, 6, 9, 2, delay="3 days"))
    table = spark.createDataFrame(changes, schema).withColumn("ts", F.timestamp_seconds("s")).drop("s")
    want = L.admission(table, 4, 6, 9, 2).select("ts", "job_id", "user_id", "running", "queued", "code", "retry_s").collect()
    assert sorted(got, key=lambda r: r[1]) == sorted((tuple(r) for r in want), key=lambda r: r[1])
    assert len({r[5] for r in got}) >= 3


def test_open_tails_close_and_state_is_empty(spark, tmp_path):
    frames = [("x", float(100 + i), i, p) for i, p in enumerate([.1, .9, .5, .1, .8, .7])] + [("y", float(100 + i), i, .9) for i in range(3)]
    batches = [frames[1:4], [frames[0], *frames[5:]], [frames[4]], [("", float(FAR), O.TICK, 0.0)]]
    got, state = drain(spark, tmp_path, batches, "series string, s double, frame long, p double",
                       lambda s: O.closing_intervals(s, .6, .4, idle_s=60, delay="30 seconds"))
    assert sorted(got) == [("x", 1.0, 3.0), ("x", 4.0, 6.0), ("y", 0.0, 3.0)]
    assert state == 0


def test_finished_jobs_leave_the_state(spark, tmp_path):
    events = [("1", 10.0, 1, "stage", "mix", "running"), ("1", 20.0, 2, "job", "", "done"), ("1", 15.0, 3, "stage", "mix", "done"),
              ("2", 12.0, 4, "job", "", "running")]
    batches = [events[1:2], [events[0], *events[2:]], [("", float(FAR), O.TICK, "job", "", "")]]
    got, state = drain(spark, tmp_path, batches, "job_id string, s double, event_id long, type string, stage string, status string",
                       lambda s: O.progress_stream(s, keep_s=5, delay="60 seconds"))
    assert sorted(got, key=repr) == sorted([("1", None, "done", True), ("1", "mix", "done", True), ("2", None, "running", False)], key=repr)
    assert state == 1  # the status of the running job


def test_sinks_are_repeatable_and_keep_late_rows(spark, tmp_path):
    costs = spark.createDataFrame([(1, datetime(2024, 1, d, tzinfo=timezone.utc), 1.5, 10, 1) for d in (3, 2, 1, 1)],
                                  "user_id long, ts timestamp, gpu_s double, storage_bytes long, jobs long")
    for k in range(4):  # the oldest day comes last
        costs.limit(k + 1).exceptAll(costs.limit(k)).coalesce(1).write.mode("append").parquet(str(tmp_path / "costs"))
    stream = spark.readStream.schema(costs.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "costs"))
    for _ in range(2):  # nothing new the second time
        ledger = {r.day.day: (r.gpu_s, r.storage_bytes, r.jobs_count) for r in MG.ledger_sink(stream, str(tmp_path / "ledger")).collect()}
    assert ledger == {3: (1.5, 10, 1), 2: (1.5, 10, 1), 1: (3.0, 20, 2)}
    uploads = spark.createDataFrame([(i, f"h{i % 4}") for i in range(10)], "upload_id long, content_hash string")
    for a in (0, 3, 6, 9):
        uploads.where(f"upload_id >= {a} and upload_id < {a + 3}").coalesce(1).write.mode("append").parquet(str(tmp_path / "up"))
    stream = spark.readStream.schema(uploads.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "up"))
    members = sorted((r.content_hash, r.upload_id) for r in MG.membership_sink(stream, str(tmp_path / "members")).collect())
    assert members == [("h0", 0), ("h1", 1), ("h2", 2), ("h3", 3)]
