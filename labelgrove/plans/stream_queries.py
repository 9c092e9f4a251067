"""Streams whose rows arrive out of order, against the same answers over stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelgrove.plans.catalog import ORACLES, query
from labelgrove.plans.library_queries import DAY, STATUS, allowed_counts, changes, job_events, requests, with_state_store
from labelgrove.plans.report_queries import INTERVALS, frames
from labelgrove.session import work_folder
from labelgrove.streaming import epochs as E
from labelgrove.streaming import merging as MG
from labelgrove.streaming import ordered as O

SLICES = 5
#: Rows of a file, about; slices of fewer are one file.
FILE_ROWS = 500_000


def arriving(t, rows: DataFrame, name: str, clock: dict | None = None) -> tuple[DataFrame, str]:
    """`rows(ts, ...)` as a stream of SLICES slices of as many files as their rows fill: a row comes with
    the slice of its time or with the next one. `clock` are the columns of a last row, far ahead, that lets the watermark pass all others."""
    with_state_store(t)
    folder = work_folder(t.spark, name)
    rows = t.stored(rows, f"{name}-rows")
    seconds = F.unix_seconds(F.col("ts"))
    low, high, n = rows.agg(F.min(seconds), F.max(seconds), F.count(F.lit(1))).first()
    late = F.pmod(F.xxhash64(*rows.columns), F.lit(100)) / 100.0
    part = F.floor((seconds - low) / (high - low + 1.0) * SLICES + late)
    files = max(1, -(-n // (SLICES * FILE_ROWS)))
    for k in range(SLICES + 1):
        slice_ = rows.where(part == k)
        (slice_.coalesce(1) if files == 1 else slice_.repartition(files)).write.mode("append").parquet(f"{folder}/in")
    if clock is not None:
        last = [F.lit(v).cast(rows.schema[c].dataType).alias(c) for c, v in clock.items()]
        ahead = F.timestamp_seconds(F.lit(high + 20 * (high - low))).alias("ts")
        t.spark.range(1).select(ahead, *last).select(*rows.columns).coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    return stream, folder


@query("stream_admission", ORACLES["admission_decisions"])
def stream_admission(t):
    """Admission decisions from changes that arrive out of order."""
    s, folder = arriving(t, changes(t), "admission", {"step": O.TICK, "job_id": -1, "user_id": -1})
    out = E.admission_epochs(s, folder, 25, 15, 38, 1, delay_s=900 * DAY)
    return out.select("job_id", "running", "queued", "code", "retry_s")


@query("stream_admission_per_user", """WITH c AS (SELECT * FROM (
      SELECT o_orderdate AS ts, 2 AS step, o_orderkey AS job_id, o_custkey % 50 AS user_id FROM orders
      UNION ALL SELECT o_orderdate + to_days(CAST(o_custkey % 5 AS INT)), 1, o_orderkey, o_custkey % 50 FROM orders
      UNION ALL SELECT o_orderdate + to_days(CAST(o_custkey % 5 + o_orderkey % 7 + 1 AS INT)), 0, o_orderkey, o_custkey % 50 FROM orders) x),
    r AS (SELECT *, sum(CASE step WHEN 1 THEN 1 WHEN 0 THEN -1 ELSE 0 END) OVER w AS running,
      sum(CASE step WHEN 2 THEN 1 WHEN 1 THEN -1 ELSE 0 END) OVER w AS queued FROM c
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, step, job_id ROWS UNBOUNDED PRECEDING))
  SELECT job_id, CAST(running AS BIGINT) AS running, CAST(queued AS BIGINT) AS queued,
    CASE WHEN running >= 1 THEN 'concurrency' WHEN queued >= 3 THEN 'queue_full' END AS code,
    CASE WHEN running >= 1 THEN 120 WHEN queued >= 3 THEN 300 END AS retry_s FROM r WHERE step = 2""")
def stream_admission_per_user(t):
    s, folder = arriving(t, changes(t), "admission", {"step": O.TICK, "job_id": -1, "user_id": -1})
    out = E.admission_epochs(s, folder, 1, 3, per_user=True, delay_s=900 * DAY)
    return out.select("job_id", "running", "queued", "code", "retry_s")


@query("rate_limit_out_of_order", ORACLES["rate_limit_stream"])
def rate_limit_out_of_order(t):
    """The limiter on hits that arrive behind newer ones."""
    rows = requests(t.events()).withColumnRenamed("ts", "at").withColumn("ts", F.timestamp_seconds("at"))
    s, folder = arriving(t, rows, "limit", {"key": "", "event_id": O.TICK, "at": 0})
    seconds = s.select("key", "event_id", (F.unix_micros("ts") / 1e6).alias("ts"))
    return allowed_counts(E.limit_epochs(seconds, folder, 2, DAY, 8 * DAY))


@query("stream_closed_intervals", f"SELECT CAST(song AS VARCHAR) || '/' || label AS series, start_s, end_s FROM ({INTERVALS}) i")
def stream_closed_intervals(t):
    """All intervals of frame streams, those included that no frame closes."""
    rows = frames(t).select(F.concat_ws("/", "song", "label").alias("series"), "frame", "p", "ts")
    s, folder = arriving(t, rows, "frames", {"series": "", "frame": O.TICK, "p": 0.0})
    return E.interval_epochs(s, folder, 0.6, 0.42, idle_s=40 * DAY, delay_s=8 * DAY)


@query("stream_job_progress", f"""SELECT CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'error' THEN NULL ELSE event_type END AS stage,
    arg_max({STATUS}, (ts, event_id)) AS status FROM events GROUP BY 1, 2""")
def stream_job_progress(t):
    """The last status of every job and stage, from events in any order; finished jobs leave the state."""
    s, folder = arriving(t, job_events(t.events()), "progress", {
        "event_id": O.TICK, "job_id": -1, "type": "job", "stage": "", "status": ""})
    out = E.progress_epochs(s, folder, keep_s=40 * DAY, delay_s=8 * DAY)
    return out.groupBy("job_id", "stage").agg(F.max_by("status", "epoch").alias("status"))


@query("stream_merged_ledger", """SELECT user_id, CAST(ts AS DATE) AS day, round(sum(value), 4) AS gpu_s, CAST(sum(event_id % 1000) AS BIGINT) AS storage_bytes,
    count(*) FILTER (WHERE event_type = 'purchase') AS jobs_count FROM events GROUP BY 1, 2""")
def stream_merged_ledger(t):
    """Costs of any age counted on their day, with the bytes they store."""
    rows = t.events().select("event_id", "user_id", "ts", F.col("value").alias("gpu_s"), (F.col("event_id") % 1000).alias("storage_bytes"),
                    (F.col("event_type") == "purchase").cast("long").alias("jobs"))
    s, folder = arriving(t, rows, "costs")
    return MG.ledger_sink(s.drop("event_id"), folder).withColumn("gpu_s", F.round("gpu_s", 4))


@query("stream_exact_membership", """SELECT sha256(text) AS content_hash, min(doc_id) AS upload_id FROM documents GROUP BY 1""")
def stream_exact_membership(t):
    """Contents known for good, each with its least upload, though some arrive behind greater ones."""
    rows = t.read("documents").select(F.col("doc_id").alias("upload_id"), F.sha2("text", 256).alias("content_hash"),
                                      F.timestamp_seconds(F.col("doc_id") * 3600).alias("ts"))
    s, folder = arriving(t, rows, "uploads")
    return MG.membership_sink(s.drop("ts"), folder)
