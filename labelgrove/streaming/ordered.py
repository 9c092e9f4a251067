"""Streams replayed in event-time order: admission, rate limits, intervals and job progress.

A key's rows wait in the state until the watermark has passed them; then they are replayed in order,
so a row that arrives behind newer ones changes nothing against a stored log. What waits is bounded by
the watermark delay. Timers close what has ended, and its state goes away.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from labelgrove.operators.library import UNLIMITED
from labelgrove.streaming.jobs import TERMINAL
from labelgrove.streaming.limiter import decide

DAY_US = 86_400_000_000
#: Rows with this in the column after `at` only move the watermark.
TICK = -1


class OrderedState(StatefulProcessor):
    """Buffers rows (at, ...) of a key, `at` in microseconds, and replays them in the order of their
    columns once the watermark has passed. Subclasses set ROW and OUT, and give `replay` and `closing`."""

    ROW = ""
    OUT = ""

    def init(self, handle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", self.ROW)
        self.start(handle)

    def start(self, handle) -> None:
        """States of the subclass."""

    def replay(self, key, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def closing(self, key, watermark_ms: int) -> list[tuple]:
        """What ends at the watermark while nothing waits."""
        return []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - Spark's names
        names = [c.split()[0] for c in self.ROW.split(", ")]
        fresh = [r for batch in rows for r in batch[names].itertuples(index=False, name=None) if r[1] != TICK]
        if fresh:
            self.pending.appendList(fresh)
            self.handle.registerTimer(min(r[0] for r in fresh) // 1000 + 1)
        yield self.frame([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        waiting = sorted(self.pending.get()) if self.pending.exists() else []
        ready = [r for r in waiting if r[0] // 1000 < watermark]
        out = self.replay(key, ready) if ready else []
        if ready:
            rest = waiting[len(ready):]
            if rest:
                self.pending.put(rest)
                self.handle.registerTimer(rest[0][0] // 1000 + 1)
            else:
                self.pending.clear()
        if len(ready) == len(waiting):
            out = out + self.closing(key, watermark)
        yield self.frame(out)

    def frame(self, rows: list[tuple]) -> pd.DataFrame:
        names = [c.split()[0] for c in self.OUT.split(", ")]
        return pd.DataFrame({n: pd.Series([r[i] for r in rows], dtype=object) for i, n in enumerate(names)})

    def close(self) -> None:
        pass


def _ordered(rows: DataFrame, delay: str, processor: OrderedState) -> DataFrame:
    """Rows (key, ts, ...) through `processor`; `ts` carries the watermark."""
    timed = rows.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts"))
    return timed.groupBy("key").transformWithStateInPandas(
        statefulProcessor=processor, outputStructType=processor.OUT, outputMode="Append", timeMode="EventTime")


class AdmissionState(OrderedState):
    """Running and queued jobs of a scope, and the admitted jobs of every user on the current day."""

    ROW = "at long, step int, job_id long, user_id long"
    OUT = "at long, job_id long, user_id long, running long, queued long, code string, retry_s int"

    def __init__(self, concurrency: int, queued: int, depth: int, daily: int):
        self.limits, self.daily = (concurrency, queued, depth), daily

    def start(self, handle):
        self.counts = handle.getValueState("counts", "running long, queued long, day long")
        self.admitted = handle.getMapState("admitted", "user_id long", "n long")

    def replay(self, key, rows):
        running, queued, day = self.counts.get() if self.counts.exists() else (0, 0, -1)
        concurrency, waiting, depth = self.limits
        out = []
        for at, step, job, user in rows:
            running += (step == 1) - (step == 0)
            queued += (step == 2) - (step == 1)
            if at // DAY_US != day:
                day = at // DAY_US
                self.admitted.clear()
            if step != 2:
                continue
            code = retry = None
            if concurrency != UNLIMITED and running >= concurrency:
                code, retry = "concurrency", 120
            elif waiting != UNLIMITED and queued >= waiting or depth != UNLIMITED and running + queued >= depth:
                code, retry = "queue_full", 300
            elif self.daily != UNLIMITED:
                n = self.admitted.getValue((user,))[0] if self.admitted.containsKey((user,)) else 0
                if n >= self.daily:
                    code, retry = "quota_daily", 3600
                else:
                    self.admitted.updateValue((user,), (n + 1,))
            out.append((at, job, user, running, queued, code, retry))
        self.counts.update((running, queued, day))
        return out


def admission_stream(changes: DataFrame, concurrency: int = UNLIMITED, queued: int = UNLIMITED, depth: int = UNLIMITED,
                     daily: int = UNLIMITED, per_user: bool = False, delay: str = "1 day") -> DataFrame:
    """The decisions of `library.admission` as changes(ts, step, job_id, user_id) arrive, each once the
    watermark has passed its time; the daily quota starts anew with the first change of a day.

    The platform's counters follow one order of all changes, so they are one key; per user, keys are
    independent. Rows with step TICK only move the watermark.
    """
    key = F.col("user_id").cast("string") if per_user else F.lit("platform")
    rows = changes.select(key.alias("key"), "ts", F.col("step").cast("int").alias("step"), F.col("job_id").cast("long").alias("job_id"),
                          F.col("user_id").cast("long").alias("user_id"))
    out = _ordered(rows, delay, AdmissionState(concurrency, queued, depth, daily))
    return out.select(F.timestamp_micros("at").alias("ts"), "job_id", "user_id", "running", "queued", "code", "retry_s")


class LimiterState(OrderedState):
    """Allowed hits of a key within the window."""

    ROW = "at long, event_id long"
    OUT = "key string, event_id long, ts double, allowed boolean, remaining int, reset long"

    def __init__(self, limit: int, window_s: int):
        self.limit, self.window_s = limit, window_s

    def start(self, handle):
        self.hits = handle.getListState("hits", "ts double")

    def replay(self, key, rows):
        hits = deque(sorted(h[0] for h in self.hits.get()) if self.hits.exists() else [])
        out = [(key[0], event, at / 1e6, *decide(hits, at / 1e6, self.limit, self.window_s)) for at, event in rows]
        if hits:
            self.hits.put([(t,) for t in hits])
            self.handle.registerTimer(int((hits[-1] + self.window_s) * 1000) + 1)
        return out

    def closing(self, key, watermark_ms):
        if self.hits.exists() and max(h[0] for h in self.hits.get()) + self.window_s < watermark_ms / 1000:
            self.hits.clear()
        return []


def limit_stream_in_order(requests: DataFrame, limit: int, window_s: int = 60, delay: str = "1 minute") -> DataFrame:
    """The decisions of the limiter for requests(key, event_id, ts in seconds) in the order of their
    times, however they arrive; a key without hits in the window keeps no state. An event_id of TICK only
    moves the watermark."""
    rows = requests.select(F.col("key").cast("string").alias("key"), F.timestamp_seconds("ts").alias("ts"),
                           F.col("event_id").cast("long").alias("event_id"))
    return _ordered(rows, delay, LimiterState(limit, window_s))


class ClosingIntervals(OrderedState):
    """Open interval of a series; a series without frames for a while ends after its last one."""

    ROW = "at long, frame long, p double"
    OUT = "series string, start_s double, end_s double"

    def __init__(self, enter: float, exit_: float, hop_s: float, idle_s: float):
        self.enter, self.exit_, self.hop_s, self.idle_ms = enter, exit_, hop_s, int(idle_s * 1000)

    def start(self, handle):
        self.series = handle.getValueState("series", "start long, last long, last_ms long")

    def replay(self, key, rows):
        start, last, last_ms = self.series.get() if self.series.exists() else (-1, -1, 0)
        out = []
        for at, frame, p in rows:
            if start < 0 and p >= self.enter:
                start = frame
            elif start >= 0 and p < self.exit_:
                out.append((key[0], round(start * self.hop_s, 2), round(frame * self.hop_s, 2)))
                start = -1
            last, last_ms = max(last, frame), max(last_ms, at // 1000)
        self.series.update((start, last, last_ms))
        self.handle.registerTimer(last_ms + self.idle_ms + 1)
        return out

    def closing(self, key, watermark_ms):
        if not self.series.exists():
            return []
        start, last, last_ms = self.series.get()
        if watermark_ms <= last_ms + self.idle_ms:
            return []
        self.series.clear()
        return [(key[0], round(start * self.hop_s, 2), round((last + 1) * self.hop_s, 2))] if start >= 0 else []


def closing_intervals(frames: DataFrame, enter: float, exit_: float, hop_s: float = 1.0, idle_s: float = 3600.0,
                      delay: str = "1 hour") -> DataFrame:
    """Activity intervals of frames(series, ts, frame, p), open tails included: a series is over once the
    watermark is `idle_s` past its last frame. Frames may arrive out of order within the delay."""
    if exit_ > enter:
        raise ValueError("exit threshold above the enter threshold")
    rows = frames.select(F.col("series").alias("key"), "ts", F.col("frame").cast("long").alias("frame"), F.col("p").cast("double").alias("p"))
    return _ordered(rows, delay, ClosingIntervals(enter, exit_, hop_s, idle_s))


class ProgressState(OrderedState):
    """Latest status of a job and its stages, until some time after the job has ended."""

    ROW = "at long, event_id long, type string, stage string, status string"
    OUT = "job_id string, stage string, status string, ended boolean"

    def __init__(self, keep_s: float):
        self.keep_ms = int(keep_s * 1000)

    def start(self, handle):
        self.stages = handle.getMapState("stages", "stage string", "status string")
        self.ended = handle.getValueState("ended", "at_ms long")

    def replay(self, key, rows):
        changed = {}
        for at, event, kind, stage, status in rows:
            name = "" if kind == "job" else stage
            self.stages.updateValue((name,), (status,))
            changed[name] = status
            if kind == "job" and status in TERMINAL:
                self.ended.update((at // 1000,))
                self.handle.registerTimer(at // 1000 + self.keep_ms + 1)
            elif kind == "job":
                self.ended.clear()
        over = self.ended.exists()
        return [(key[0], stage or None, status, over) for stage, status in sorted(changed.items())]

    def closing(self, key, watermark_ms):
        if self.ended.exists() and watermark_ms > self.ended.get()[0] + self.keep_ms:
            self.stages.clear()
            self.ended.clear()
        return []


def progress_stream(events: DataFrame, keep_s: float = 3600.0, delay: str = "1 hour") -> DataFrame:
    """(job_id, stage, status, ended) whenever a status changes; the job itself has a null stage. Nothing
    is kept of a job `keep_s` after it has ended.

    `events(job_id, event_id, ts, type, stage, status)`; later events of a finished job start it anew.
    """
    rows = events.select(F.col("job_id").cast("string").alias("key"), "ts", F.col("event_id").cast("long").alias("event_id"),
                         "type", "stage", "status")
    return _ordered(rows, delay, ProgressState(keep_s))
