"""Logs with memory: numbered traces, watched jobs and admitted requests, as state of a stream.

The state of a key is small and its own; timers and bounds let go of what is
old.  What a batch brings for a key is taken in order of time, so results do not
depend on how events are cut into batches as long as they come in order of time.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: The state store that keyed state of several kinds and timers need.
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Within it, streams that are started keep their state in a store that has timers."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name, None)
    spark.conf.set(name, _PROVIDER)
    try:
        yield
    finally:
        spark.conf.set(name, before) if before else spark.conf.unset(name)


def epoch_micros(events: DataFrame, ts: str = "ts") -> Column:
    """Microseconds since 1970, UTC; a time without a zone is taken as UTC, whatever the session's zone."""
    if events.schema[ts].dataType.typeName() == "timestamp":
        return F.unix_micros(ts)
    parts = f"year({ts}), month({ts}), dayofmonth({ts}), hour({ts}), minute({ts}), extract(SECOND FROM {ts})"
    return F.unix_micros(F.expr(f"make_timestamp_ltz({parts}, 'UTC')"))


def _ordered(rows: Iterator[Row], *columns: str) -> Iterator[tuple]:
    """The rows of a batch in order of time: the named columns and the epoch milliseconds.

    Rows, not frames: a key has few of them in a batch, for which a frame costs more than all that is done with it.
    """
    for r in sorted(rows, key=lambda r: (r["us"], r["event_id"])):
        yield *(r[c] for c in columns), r["us"] // 1000


class _Numbers(StatefulProcessor):
    def __init__(self, late_ms: int):
        self.late_ms = late_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "next long, newest long, seen binary")  # seen: pairs of an event and its time

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        # read and written once for all rows, as one value: each value that goes to the store or comes from it costs as much as many rows
        number, newest, held = self.last.get() if self.last.exists() else (0, -(1 << 62), b"")
        seen = dict(np.frombuffer(held, np.int64).reshape(-1, 2).tolist())
        out = []
        for event, at in _ordered(rows, "event_id"):
            event = int(event)
            if event in seen:
                out.append((key[0], event, None, "repeated"))
                continue
            if at < newest - self.late_ms:
                out.append((key[0], event, None, "late"))
                continue
            out.append((key[0], event, number, "new"))
            seen[event] = at
            number, newest = number + 1, max(newest, at)
        kept = [(event, at) for event, at in seen.items() if at >= newest - self.late_ms]  # what came again after that would be late
        self.last.update((number, newest, np.array(kept, np.int64).tobytes()))
        yield from (Row(trace_id=t, event_id=e, seq=n, status=s) for t, e, n, s in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def numbered_traces(events: DataFrame, key: str = "user_id", late_seconds: float = 86_400) -> DataFrame:
    """``trace_id``, ``event_id``, ``seq`` from 0 in order of arrival, ``status``.

    An event whose id the trace has had is ``repeated``; one older than the
    trace's newest by more than ``late_seconds`` is ``late``; neither has a
    number.  Ids are remembered as long as they would not be late.
    """
    rows = events.select(key, "event_id", epoch_micros(events).alias("us")).groupBy(key)
    return rows.transformWithState(_Numbers(int(late_seconds * 1000)), "trace_id long, event_id long, seq long, status string", "append", "None")


class _Watch(StatefulProcessor):
    def __init__(self, patience_ms: int, ends: frozenset):
        self.patience_ms, self.ends = patience_ms, ends

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, at long")

    @staticmethod
    def _told(rows: list[tuple]) -> Iterator[Row]:
        return (Row(job_id=j, status=s, at_ms=a) for j, s, a in rows)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        status, last = self.job.get() if self.job.exists() else (None, 0)
        out = []
        for kind, at in _ordered(rows, "event_type"):
            if status == "running" and at > last + self.patience_ms:
                out.append((key[0], "interrupted", last + self.patience_ms))
                status = "interrupted"
            now = "ended" if kind in self.ends else "running"
            if now != status:
                out.append((key[0], now, at))
            status, last = now, max(last, at)
        self.job.update((status, last))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if status == "running":
            self.handle.registerTimer(last + self.patience_ms)
        yield from self._told(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        status, last = self.job.get()
        if status == "running":
            self.job.update(("interrupted", last))
            yield from self._told([(key[0], "interrupted", last + self.patience_ms)])

    def close(self) -> None:
        pass


def watched_jobs(events: DataFrame, key: str = "user_id", ends: tuple[str, ...] = ("purchase",), patience_seconds: float = 86_400, late: str = "1 minute") -> DataFrame:
    """``job_id``, ``status``, ``at_ms`` of every change: a job runs with its events, has ended with one of ``ends``, and is interrupted when nothing is heard of it for ``patience_seconds``.

    A job that falls silent is told by a timer as soon as the stream's time has
    passed its patience; one that is heard of again runs again.
    """
    timed = events.select(key, "event_id", "event_type", epoch_micros(events).alias("us"))
    rows = timed.withColumn("at", F.timestamp_micros("us")).withWatermark("at", late).groupBy(key)
    return rows.transformWithState(_Watch(int(patience_seconds * 1000), frozenset(ends)), "job_id long, status string, at_ms long", "append", "eventTime")


class _Admit(StatefulProcessor):
    def __init__(self, per_minute: int, per_day: int, window_ms: int):
        self.per_minute, self.per_day, self.window_ms = per_minute, per_day, window_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.recent = handle.getListState("recent", "at long")
        self.day = handle.getValueState("day", "day long, n int")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        recent = [at for (at,) in self.recent.get()]
        day, n = self.day.get() if self.day.exists() else (-1, 0)
        out = []
        for event, at in _ordered(rows, "event_id"):
            recent = [t for t in recent if t > at - self.window_ms]
            if at // 86_400_000 != day:
                day, n = at // 86_400_000, 0
            verdict = "minute" if len(recent) >= self.per_minute else "day" if n >= self.per_day else "ok"
            if verdict == "ok":
                recent.append(at)
                n += 1
            out.append((key[0], int(event), verdict))
        self.recent.put([(t,) for t in recent[-self.per_minute :]]) if recent else self.recent.clear()
        self.day.update((day, n))
        yield from (Row(client=c, event_id=e, verdict=v) for c, e, v in out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return iter(())

    def close(self) -> None:
        pass


def admitted_requests(events: DataFrame, key: str = "user_id", per_minute: int = 5, per_day: int = 20, window_seconds: float = 60) -> DataFrame:
    """``client``, ``event_id``, ``verdict``: ok, or minute or day where that many requests of the client have been admitted in the window or on the UTC day."""
    rows = events.select(key, "event_id", epoch_micros(events).alias("us")).groupBy(key)
    return rows.transformWithState(_Admit(per_minute, per_day, int(window_seconds * 1000)), "client long, event_id long, verdict string", "append", "None")
