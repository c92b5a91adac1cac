"""The same ledgers over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def read_events(spark, folder: str, schema: str = EVENTS, files_at_once: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(folder)


def minute_totals(events: DataFrame, key: str = "user_id", late: str = "10 minutes") -> DataFrame:
    """Events of each key in tumbling minutes; later ones than the watermark are not counted."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", "1 minute").alias("w"), key).agg(F.count("*").alias("n"), F.sum("value").alias("value")).select("w.start", key, "n", "value")


def last_status(events: DataFrame, key: str = "user_id") -> DataFrame:
    """The latest status of each key, updated as events come."""
    return events.groupBy(key).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("updated_at"))


def append(events: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """The append-only log as files, each event once."""
    return events.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def admitted(events: DataFrame, per_minute: int = 5, key: str = "user_id") -> DataFrame:
    """Check-then-record rate limiting with state: an event is admitted if fewer than ``per_minute`` admitted ones lie in the last 60 seconds.

    Events of a key that arrive together are taken in order of time; a key's
    state is at most ``per_minute`` times.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    def work(k, batches, state: GroupState):
        times = list(state.get[0]) if state.exists else []
        parts = list(batches)
        rows = pd.concat(parts).sort_values(["ts", "event_id"]) if parts else pd.DataFrame()
        out = []
        for event, ts in zip(rows["event_id"], rows["ts"]):
            at = ts.timestamp()
            times = [t for t in times if t > at - 60]
            yes = len(times) < per_minute
            if yes:
                times.append(at)
            out.append((int(event), int(k[0]), yes))
        state.update((times[-per_minute:],))
        yield pd.DataFrame(out, columns=["event_id", key, "admitted"])

    return events.select(key, "event_id", "ts").groupBy(key).applyInPandasWithState(work, f"event_id long, {key} long, admitted boolean", "times array<double>", "append", GroupStateTimeout.NoTimeout)
