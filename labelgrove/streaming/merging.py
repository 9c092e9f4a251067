"""Sinks that merge: cost ledgers and known contents that no watermark cuts off.

Every epoch writes its own folder and replaces it when it is retried, so nothing counts twice. A
reader merges the epochs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "user_id long, day date, gpu_s double, storage_bytes long, jobs_count long"
MEMBERS = "content_hash string, upload_id long"


def drained(stream: DataFrame, folder: str, write: Callable[[DataFrame, int], None]) -> None:
    """Run everything available through `write(batch, epoch)`, which must be repeatable."""
    stream.writeStream.foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(
        availableNow=True).start().awaitTermination()


def _epochs(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Rows of all epochs with their number; none if nothing was written yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return spark.createDataFrame([], f"{schema}, epoch long")
    return spark.read.schema(f"{schema}, epoch long").parquet(folder)


def ledger_sink(costs: DataFrame, folder: str) -> DataFrame:
    """The ledger after all available costs(user_id, ts, gpu_s, storage_bytes, jobs): sums per user and
    UTC day. A cost counts on the day of its time, however late it arrives."""
    def write(batch: DataFrame, epoch: int) -> None:
        sums = batch.groupBy("user_id", F.to_date("ts").alias("day")).agg(
            F.sum("gpu_s").cast("double").alias("gpu_s"), F.sum("storage_bytes").cast("long").alias("storage_bytes"),
            F.sum("jobs").cast("long").alias("jobs_count"))
        sums.write.mode("overwrite").parquet(f"{folder}/ledger/epoch={epoch}")

    drained(costs, folder, write)
    return read_ledger(costs.sparkSession, folder)


def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return _epochs(spark, f"{folder}/ledger", LEDGER).groupBy("user_id", "day").agg(
        *[F.sum(c).alias(c) for c in ("gpu_s", "storage_bytes", "jobs_count")])


def membership_sink(uploads: DataFrame, folder: str) -> DataFrame:
    """(content_hash, upload_id) with the least upload of every content after all available
    uploads(upload_id, content_hash), exactly and in whatever order they arrive: an epoch writes the
    contents that no earlier epoch had, and those for which it has a lesser id. Null is a content."""
    def write(batch: DataFrame, epoch: int) -> None:
        known = read_members(batch.sparkSession, folder, epoch).select(F.col("content_hash").alias("known"), F.col("upload_id").alias("first"))
        least = batch.groupBy("content_hash").agg(F.min("upload_id").cast("long").alias("upload_id"))
        held = F.col("content_hash").eqNullSafe(F.col("known")) & (F.col("first") <= F.col("upload_id"))
        least.join(known, held, "left_anti").write.mode("overwrite").parquet(f"{folder}/members/epoch={epoch}")

    drained(uploads, folder, write)
    return read_members(uploads.sparkSession, folder)


def read_members(spark: SparkSession, folder: str, before: int | None = None) -> DataFrame:
    """The least upload of every content, of all epochs or of those before one."""
    rows = _epochs(spark, f"{folder}/members", MEMBERS)
    rows = rows if before is None else rows.where(F.col("epoch") < before)
    return rows.groupBy("content_hash").agg(F.min("upload_id").alias("upload_id"))
