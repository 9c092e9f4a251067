"""Streams of job events, costs, uploads and frame scores.

Event time is `ts`; the watermark is one hour and Spark drops (and counts) later rows. Every
function takes a streaming or a batch DataFrame and gives equal rows for equal input.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor



WATERMARK = "1 hour"
TERMINAL = ("done", "failed", "partial")


def stage_progress(events: DataFrame) -> DataFrame:
    """Latest status per (job, stage); for update mode."""
    return events.groupBy("job_id", "stage").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"))


def job_progress(events: DataFrame) -> DataFrame:
    """Latest job status and whether the job's stream has ended."""
    own = events.where("type = 'job'").groupBy("job_id").agg(
        F.max_by("status", F.struct("ts", "event_id")).alias("status"))
    return own.withColumn("ended", F.col("status").isin(*TERMINAL))


def subscribe(events: DataFrame, finished: DataFrame) -> DataFrame:
    """Events of running jobs, plus one terminal event for each job that had already finished.

    `finished(job_id, status)` are jobs that ended before the subscription.
    """
    live = events.join(finished.select("job_id"), "job_id", "left_anti").select(
        "job_id", "type", "stage", "status")
    late = finished.select("job_id", F.lit("job").alias("type"),
                           F.lit(None).cast("string").alias("stage"), "status")
    return live.unionByName(late)


def daily_ledger(costs: DataFrame) -> DataFrame:
    """Cost sums per user and UTC day as a watermarked tumbling window."""
    return (costs.withWatermark("ts", WATERMARK)
            .groupBy("user_id", F.window("ts", "1 day"))
            .agg(F.sum("gpu_s").alias("gpu_s"), F.sum("jobs").alias("jobs_count"))
            .select("user_id", F.to_date("window.start").alias("day"), "gpu_s", "jobs_count"))


def dedup_stream(uploads: DataFrame, within: str = "1 day") -> DataFrame:
    """First upload of each content hash; state is bounded by the watermark delay."""
    return uploads.withWatermark("ts", within).dropDuplicatesWithinWatermark(["content_hash"])


class IntervalState(StatefulProcessor):
    """Open interval of one series, carried between micro-batches."""

    def __init__(self, enter: float, exit_: float, hop_s: float):
        self.enter, self.exit_, self.hop_s = enter, exit_, hop_s

    def init(self, handle):
        self.open = handle.getValueState("open", "start double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        batch = pd.concat(list(rows)).sort_values("frame")
        held = self.open.get() if self.open.exists() else None
        start = None if held is None else held[0]
        done = []
        for frame, p in zip(batch["frame"], batch["p"]):
            t = frame * self.hop_s
            if start is None and p >= self.enter:
                start = t
            elif start is not None and p < self.exit_:
                done.append((start, t))
                start = None
        if start is None:
            self.open.clear()
        else:
            self.open.update((start,))
        yield pd.DataFrame({"series": pd.Series([key[0]] * len(done), dtype=object),
                            "start_s": [round(a, 2) for a, _ in done],
                            "end_s": [round(b, 2) for _, b in done]})

    def close(self):
        pass


def interval_stream(frames: DataFrame, enter: float, exit_: float, hop_s: float = 1.0) -> DataFrame:
    """Closed activity intervals as frames(series, frame, p) arrive in frame order."""
    return frames.groupBy("series").transformWithStateInPandas(
        statefulProcessor=IntervalState(enter, exit_, hop_s),
        outputStructType="series string, start_s double, end_s double",
        outputMode="Append", timeMode="None")


# ---- sinks
def read_table_stream(spark: SparkSession, folder: str, name: str, schema) -> DataFrame:
    """One table of a folder as a file stream. The table is a file or a folder of files; a file
    stream takes a single file only by a pattern."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", 16)
            .parquet(f"{folder}/{name}[.]parquet"))


def run_to_table(stream: DataFrame, folder: str, mode: str = "append") -> DataFrame:
    """Drain everything available into parquet and read it back.

    Each epoch overwrites its own folder, so a retried epoch cannot write rows twice.
    """
    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    query = (stream.writeStream.outputMode(mode).foreachBatch(write)
             .option("checkpointLocation", f"{folder}/checkpoint")
             .trigger(availableNow=True).start())
    query.awaitTermination()
    spark = stream.sparkSession
    return spark.read.schema(stream.schema.add("epoch", "long")).parquet(f"{folder}/out")


def upserted(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Current table behind update-mode epochs: the newest epoch of every key wins."""
    rest = [c for c in rows.columns if c not in (*keys, "epoch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "epoch").alias("r")).select(*keys, "r.*")


def ingest_batch(incoming: DataFrame, songs: DataFrame) -> DataFrame:
    """Exact, unbounded deduplication for `foreachBatch`: new content only, one row per hash."""
    fresh = incoming.join(songs.select("content_hash"), "content_hash", "left_anti")
    owner = fresh.groupBy("content_hash").agg(F.min("upload_id").alias("upload_id"))
    return fresh.join(owner, ["content_hash", "upload_id"])


