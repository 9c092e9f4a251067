"""The replays of `ordered` for many rows: what waits and what is carried are tables, not a state per key.

An epoch puts its rows beside those that wait, decides all rows that the watermark has passed with the
operators of stored tables, and writes what still waits and what later rows need to know. Every epoch
has folders of its own and replaces them when it is retried.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelgrove.operators.library import UNLIMITED, admission
from labelgrove.operators.report import hysteresis_intervals
from labelgrove.operators.scan import time_chunk
from labelgrove.streaming.jobs import TERMINAL
from labelgrove.streaming.limiter import limit_log
from labelgrove.streaming.merging import drained

DAY_S = 86400


@dataclass
class Epoch:
    """Rows that the watermark has passed since the last epoch, rows that wait, what the last epoch
    carried, and both watermarks in seconds."""
    ready: DataFrame
    waiting: DataFrame
    carried: DataFrame
    before: float
    watermark: float


def replayed(stream: DataFrame, folder: str, delay_s: float, tick: Column, carried: str, out: str,
             decide: Callable[[Epoch], DataFrame], carry: Callable[[Epoch, DataFrame], DataFrame]) -> DataFrame:
    """All decisions `out` on the available rows of `stream(ts, ...)`, with their epoch. Rows behind the
    watermark are dropped; those where `tick` holds only move it. `carry` gets the written decisions."""
    spark = stream.sparkSession

    def table(kind: str, epoch: int, schema) -> DataFrame:
        return spark.read.schema(schema).parquet(f"{folder}/{kind}/{epoch}") if epoch >= 0 else spark.createDataFrame([], schema)

    def put(df: DataFrame, path: str) -> None:
        df.write.mode("overwrite").parquet(f"{folder}/{path}")

    def write(batch: DataFrame, epoch: int) -> None:
        put(batch, f"arrived/{epoch}")
        arrived = table("arrived", epoch, stream.schema)
        clock = table("clock", epoch - 1, "us long").first()
        before = clock["us"] if clock else None
        seen = arrived.agg(F.max(F.unix_micros("ts"))).first()[0]
        us = max((x for x in (before, None if seen is None else seen - int(delay_s * 1e6)) if x is not None), default=None)
        put(spark.range(0 if us is None else 1).select(F.lit(us).cast("long").alias("us")), f"clock/{epoch}")
        at, low = F.unix_micros("ts"), -2**63 if before is None else before
        high = -2**63 if us is None else us
        rows = table("waiting", epoch - 1, stream.schema).unionByName(arrived.where(~tick & (at >= low)))
        put(rows.where(at >= high), f"waiting/{epoch}")
        now = Epoch(rows.where(at < high), table("waiting", epoch, stream.schema), table("carried", epoch - 1, carried), low / 1e6, high / 1e6)
        put(decide(now), f"out/epoch={epoch}")
        put(carry(now, spark.read.schema(out).parquet(f"{folder}/out/epoch={epoch}")), f"carried/{epoch}")

    drained(stream, folder, write)
    return spark.read.schema(f"{out}, epoch long").parquet(f"{folder}/out")


def admission_epochs(changes: DataFrame, folder: str, concurrency: int = UNLIMITED, queued: int = UNLIMITED, depth: int = UNLIMITED,
                     daily: int = UNLIMITED, per_user: bool = False, delay_s: float = DAY_S) -> DataFrame:
    """`ordered.admission_stream` for many changes(ts, step, job_id, user_id). Carried are the counters of
    the scopes and the jobs admitted on the watermark's day."""
    schema = "user_id long, running long, queued long, day long, admitted long"

    def decide(e: Epoch) -> DataFrame:
        return admission(e.ready, concurrency, queued, depth, daily, per_user, e.carried).select(
            "ts", "job_id", "user_id", "running", "queued", F.col("code").cast("string").alias("code"), F.col("retry_s").cast("int").alias("retry_s"))

    def carry(e: Epoch, out: DataFrame) -> DataFrame:
        step, none = F.col("step"), F.lit(None).cast("long")
        scope = F.col("user_id") if per_user else none
        moves = e.ready.select(scope.alias("user_id"), F.when(step == 1, 1).when(step == 0, -1).otherwise(0).cast("long").alias("running"),
                               F.when(step == 2, 1).when(step == 1, -1).otherwise(0).cast("long").alias("queued"))
        counters = moves.unionByName(e.carried.where("day is null").select("user_id", "running", "queued")).groupBy("user_id").agg(
            F.sum("running").alias("running"), F.sum("queued").alias("queued")).withColumns({"day": none, "admitted": none})
        new = out.where("code is null").select("user_id", time_chunk("ts").alias("day"), F.lit(1).cast("long").alias("admitted"))
        days = new.unionByName(e.carried.where("day is not null").select("user_id", "day", "admitted")).where(
            F.col("day") >= int(e.watermark // DAY_S)).groupBy("user_id", "day").agg(F.sum("admitted").alias("admitted"))
        return counters.unionByName(days.withColumns({"running": none, "queued": none})) if daily != UNLIMITED else counters

    return replayed(changes.select("ts", F.col("step").cast("int").alias("step"), F.col("job_id").cast("long").alias("job_id"),
                                   F.col("user_id").cast("long").alias("user_id")), folder, delay_s, F.col("step") == -1, schema,
                    "ts timestamp, job_id long, user_id long, running long, queued long, code string, retry_s int", decide, carry)


def limit_epochs(requests: DataFrame, folder: str, limit: int, window_s: int = 60, delay_s: float = 60) -> DataFrame:
    """`ordered.limit_stream_in_order` for many requests(key, event_id, ts in seconds). Carried are the
    allowed hits of the window before the watermark; replayed alone they are all allowed again."""
    out = "key string, event_id long, at double, allowed boolean, remaining int, reset long"

    def decide(e: Epoch) -> DataFrame:
        hits = e.ready.select("key", "event_id", "at").unionByName(e.carried)
        return limit_log(hits.withColumnRenamed("at", "ts"), limit, window_s).withColumnRenamed("ts", "at").where(F.col("at") >= e.before)

    def carry(e: Epoch, out: DataFrame) -> DataFrame:
        return out.where("allowed").select("key", "event_id", "at").unionByName(e.carried).where(F.col("at") > e.watermark - window_s)

    rows = requests.select(F.timestamp_seconds("ts").alias("ts"), F.col("key").cast("string").alias("key"),
                           F.col("event_id").cast("long").alias("event_id"), F.col("ts").cast("double").alias("at"))
    done = replayed(rows, folder, delay_s, F.col("event_id") == -1, "key string, event_id long, at double", out, decide, carry)
    return done.withColumnRenamed("at", "ts")


def interval_epochs(frames: DataFrame, folder: str, enter: float, exit_: float, hop_s: float = 1.0, idle_s: float = 3600.0,
                    delay_s: float = 3600.0) -> DataFrame:
    """`ordered.closing_intervals` for many frames(series, ts, frame, p). Carried are the start and the last
    frame of every open interval, as frames."""
    if exit_ > enter:
        raise ValueError("exit threshold above the enter threshold")
    frame = "series string, ts timestamp, frame long, p double"

    def known(e: Epoch) -> DataFrame:
        return e.ready.unionByName(e.carried)

    def decide(e: Epoch) -> DataFrame:
        ends = known(e).groupBy("series").agg(F.max("frame").alias("last"), F.max("ts").alias("last_ts"))
        found = hysteresis_intervals(known(e), ["series"], enter, exit_)
        idle = F.unix_micros("last_ts") / 1e6 + idle_s < e.watermark
        alive = e.waiting.select("series").distinct().withColumn("waits", F.lit(True))
        rows = found.join(ends, "series").join(alive, "series", "left")
        tail = F.col("end_s") > F.col("last")
        return rows.select("series", F.col("start_s").cast("long").alias("start"), F.col("end_s").cast("long").alias("end"), "last", "last_ts",
                           (tail & ~(idle & F.col("waits").isNull())).alias("open"))

    def carry(e: Epoch, out: DataFrame) -> DataFrame:
        tails = out.where("open")
        return tails.select("series", F.col("last_ts").alias("ts"), F.inline(F.array(
            F.struct(F.col("start").alias("frame"), F.lit(float(enter)).alias("p")),
            F.struct(F.greatest("last", F.col("start")).alias("frame"), F.lit(None).cast("double").alias("p")))))

    rows = frames.select("series", "ts", F.col("frame").cast("long").alias("frame"), F.col("p").cast("double").alias("p"))
    done = replayed(rows, folder, delay_s, F.col("frame") == -1, frame,
                    "series string, start long, end long, last long, last_ts timestamp, open boolean", decide, carry)
    return done.where("not open").select("series", F.bround(F.col("start") * hop_s, 2).alias("start_s"), F.bround(F.col("end") * hop_s, 2).alias("end_s"))


def interval_epochs_in_order(frames: DataFrame, folder: str, enter: float, exit_: float, hop_s: float = 1.0) -> DataFrame:
    """`jobs.interval_stream` for many frames(series, frame, p): the closed intervals of frames that arrive
    in order. An epoch carries the starts of its open intervals in its output. It may be called again
    with the same folder as more frames come."""
    if exit_ > enter:
        raise ValueError("exit threshold above the enter threshold")
    spark = frames.sparkSession
    frame, out = "series string, frame long, p double", "series string, start long, end long, open boolean"

    def write(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/arrived/{epoch}")
        known = spark.read.schema(frame).parquet(f"{folder}/arrived/{epoch}")
        if epoch:
            held = spark.read.schema(out).parquet(f"{folder}/out/epoch={epoch - 1}").where("open")
            known = known.unionByName(held.select("series", F.col("start").alias("frame"), F.lit(float(enter)).alias("p")))
        ends = known.groupBy(F.col("series").alias("of")).agg(F.max("frame").alias("last"))
        found = hysteresis_intervals(known, ["series"], enter, exit_).join(ends, F.col("series").eqNullSafe(F.col("of")))
        found.select("series", F.col("start_s").cast("long").alias("start"), F.col("end_s").cast("long").alias("end"),
                     (F.col("end_s") > F.col("last")).alias("open")).write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    rows = frames.select("series", F.col("frame").cast("long").alias("frame"), F.nanvl(F.col("p").cast("double"), F.lit(None)).alias("p"))
    drained(rows, folder, write)
    done = spark.read.schema(f"{out}, epoch long").parquet(f"{folder}/out").where("not open")
    return done.select("series", F.bround(F.col("start") * hop_s, 2).alias("start_s"), F.bround(F.col("end") * hop_s, 2).alias("end_s"))


def progress_epochs(events: DataFrame, folder: str, keep_s: float = 3600.0, delay_s: float = 3600.0) -> DataFrame:
    """`ordered.progress_stream` for many events(job_id, event_id, ts, type, stage, status), with the epoch of
    every status. Carried are the jobs that ended within `keep_s`."""
    def ends(e: Epoch) -> DataFrame:
        own = e.ready.where("type = 'job'").groupBy("job_id").agg(F.max_by(F.struct("status", "ts"), F.struct("ts", "event_id")).alias("r"))
        fresh = own.select("job_id", F.col("r.ts").alias("ts"), F.col("r.status").isin(*TERMINAL).alias("over"))
        kept = e.carried.join(fresh, "job_id", "left_anti").withColumn("over", F.lit(True))
        return fresh.unionByName(kept).where("over").select("job_id", "ts")

    def decide(e: Epoch) -> DataFrame:
        name = F.when(F.col("type") != "job", F.col("stage"))
        last = e.ready.groupBy("job_id", name.alias("stage")).agg(F.max_by("status", F.struct("ts", "event_id")).alias("status"))
        return last.join(ends(e).select("job_id", F.lit(True).alias("over")), "job_id", "left").select(
            "job_id", "stage", "status", F.coalesce("over", F.lit(False)).alias("ended"))

    def carry(e: Epoch, out: DataFrame) -> DataFrame:
        return ends(e).where(F.unix_micros("ts") / 1e6 + keep_s >= e.watermark)

    rows = events.select(F.col("job_id").cast("string").alias("job_id"), "ts", F.col("event_id").cast("long").alias("event_id"), "type", "stage", "status")
    return replayed(rows, folder, delay_s, F.col("event_id") == -1, "job_id string, ts timestamp",
                    "job_id string, stage string, status string, ended boolean", decide, carry)
