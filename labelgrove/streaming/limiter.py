"""Sliding-window rate limit where rejected hits do not count.

State of a key = the times of its recent allowed hits, at most `limit` numbers. The same replay
serves a stream (state store) and a stored log (sorted partitions), so both give equal decisions.
"""

from __future__ import annotations

from collections import deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from labelgrove.operators.scan import previous_value, running_totals, time_chunk

UNLIMITED = -1
DECISION = "key string, event_id long, ts double, allowed boolean, remaining int, reset long"


def decide(hits: deque, now: float, limit: int, window_s: int) -> tuple[bool, int, int]:
    """(allowed, remaining, reset) of one hit; records it in `hits` when allowed."""
    while hits and hits[0] <= now - window_s:
        hits.popleft()
    wall = int(now)
    if limit == UNLIMITED:
        return True, UNLIMITED, wall + window_s
    if len(hits) >= limit:
        return False, 0, wall + int(window_s - (now - hits[0])) + 1
    hits.append(now)
    return True, limit - len(hits), wall + window_s


def _replay(key, hits: deque, pdf: pd.DataFrame, limit: int, window_s: int) -> pd.DataFrame:
    out = [decide(hits, t, limit, window_s) for t in pdf["ts"]]
    return pd.DataFrame({"key": pd.Series([key] * len(pdf), dtype=object), "event_id": pdf["event_id"].to_numpy(),
                         "ts": pdf["ts"].to_numpy(), "allowed": [o[0] for o in out],
                         "remaining": [o[1] for o in out], "reset": [o[2] for o in out]})


class LimiterState(StatefulProcessor):
    """Keeps the allowed hits of a key between micro-batches."""

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window_s = limit, window_s

    def init(self, handle):
        self.hits = handle.getListState("hits", "ts double")

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803 - Spark's names
        batch = pd.concat(list(rows)).sort_values(["ts", "event_id"], kind="stable")
        hits = deque(sorted(h[0] for h in self.hits.get()))
        yield _replay(key[0], hits, batch, self.limit, self.window_s)
        if hits:
            self.hits.put([(t,) for t in hits])
        else:
            self.hits.clear()

    def close(self):
        pass


def limit_stream(requests: DataFrame, limit: int, window_s: int = 60) -> DataFrame:
    """Decisions of a stream of requests(key, event_id, ts in seconds), in arrival batches."""
    return requests.select(F.col("key").cast("string").alias("key"), "event_id", "ts").groupBy(
        "key").transformWithStateInPandas(
        statefulProcessor=LimiterState(limit, window_s), outputStructType=DECISION,
        outputMode="Append", timeMode="None")


def limit_log(requests: DataFrame, limit: int, window_s: int = 60) -> DataFrame:
    """The same decisions for a stored log, exactly.

    A pause of at least the window forgets everything, so a key is split there and its busy
    periods are replayed in parallel. Partitions are sorted and read in batches; a task holds only
    the hits of the current period.
    """
    r = requests.select(F.col("key").cast("string").alias("key"), "event_id", "ts",
                        time_chunk(F.timestamp_seconds("ts"), 3600).alias("hour"))
    order = [F.col("ts"), F.col("event_id")]
    gaps = previous_value(r, ["key"], "hour", order, {"ts": "before"})
    fresh = F.col("before").isNull() | (F.col("ts") - F.col("before") >= window_s)
    marked = gaps.withColumn("fresh", fresh.cast("long")).drop("before")
    periods = running_totals(marked, ["key"], "hour", order, {"fresh": "period"})

    def replay(batches):
        current, hits = None, deque()
        for pdf in batches:
            out = []
            for key, period, now in zip(pdf["key"], pdf["period"], pdf["ts"]):
                if (key, period) != current:
                    current, hits = (key, period), deque()
                out.append(decide(hits, now, limit, window_s))
            yield pd.DataFrame({"key": pdf["key"], "event_id": pdf["event_id"], "ts": pdf["ts"],
                                "allowed": [o[0] for o in out], "remaining": [o[1] for o in out],
                                "reset": [o[2] for o in out]})

    return (periods.select("key", "period", "ts", "event_id").repartition("key", "period")
            .sortWithinPartitions("key", "period", "ts", "event_id").mapInPandas(replay, DECISION))


def trailing_hits(requests: DataFrame, window_s: int = 60) -> DataFrame:
    """Hits of the key in the trailing window, counting every hit (itself included).

    Hits are bucketed by the window length; a hit only meets its own and the previous bucket, and
    the count is a difference of two running counts, not a list of pairs.
    """
    r = requests.select("key", "event_id", "ts", F.floor(F.col("ts") / 3600).alias("hour"))
    marks = (r.select("key", "event_id", "hour", F.col("ts").alias("at"), F.lit(0).alias("side"),
                      F.lit(1).cast("long").alias("one"))
             .unionByName(r.select("key", "event_id",
                                   F.floor((F.col("ts") - window_s) / 3600).alias("hour"),
                                   (F.col("ts") - window_s).alias("at"), F.lit(1).alias("side"),
                                   F.lit(0).cast("long").alias("one"))))
    run = running_totals(marks, ["key"], "hour",
                         [F.col("at"), F.col("side"), F.col("event_id")], {"one": "seen"})
    return run.groupBy("key", "event_id").agg(
        (F.max(F.when(F.col("side") == 0, F.col("seen")))
         - F.max(F.when(F.col("side") == 1, F.col("seen")))).alias("hits"))
