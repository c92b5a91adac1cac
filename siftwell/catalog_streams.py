"""Registered queries over streams with state, and over keyed and hashed tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftwell.catalog import _event_stream, _streamed, table
from siftwell.operators import graph
from siftwell.registry import register
from siftwell.sources import sinks
from siftwell.sources.keyed import KeyedTable
from siftwell.streaming import stateful

_ORDERED = "e AS (SELECT user_id, event_id, event_type, epoch_us(ts) // 1000 AS ms, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events)"


@register("stream_trace_numbers", f"""
WITH {_ORDERED}
SELECT user_id AS trace_id, event_id, k - 1 AS seq, 'new' AS status FROM e UNION ALL SELECT user_id, event_id, -1, 'repeated' FROM e WHERE event_id % 10 = 0
""")
def stream_trace_numbers(spark, d):
    """Every tenth event comes twice; only its first coming has a number."""
    events = _event_stream(spark, d)
    twice = events.withColumn("again", F.explode(F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    with stateful.keyed_state(spark):
        rows = _streamed(spark, stateful.numbered_traces(twice), "append")
    return rows.select("trace_id", "event_id", F.coalesce("seq", F.lit(-1).cast("long")).alias("seq"), "status")


PATIENCE, LATE = 129_600, 60


@register("stream_watched_jobs", f"""
WITH {_ORDERED},
p AS (SELECT user_id, ms, k, CASE WHEN event_type = 'purchase' THEN 'ended' ELSE 'running' END AS now FROM e),
q AS (SELECT *, lag(ms) OVER w AS last, lag(now) OVER w AS before, lead(ms) OVER w AS follows FROM p WINDOW w AS (PARTITION BY user_id ORDER BY k)),
g AS (SELECT *, before = 'running' AND ms > last + {PATIENCE} * 1000 AS gap FROM q)
SELECT user_id AS job_id, 'interrupted' AS status, last + {PATIENCE} * 1000 AS at_ms FROM g WHERE gap
UNION ALL SELECT user_id, now, ms FROM g WHERE gap OR before IS NULL OR now <> before
UNION ALL SELECT user_id, 'interrupted', ms + {PATIENCE} * 1000 FROM g WHERE follows IS NULL AND now = 'running' AND ms + {PATIENCE} * 1000 < (SELECT max(ms) FROM e) - {LATE} * 1000
""")
def stream_watched_jobs(spark, d):
    """Users as jobs that a purchase ends; who is silent for a day and a half is interrupted, at the stream's end by a timer."""
    with stateful.keyed_state(spark):
        return _streamed(spark, stateful.watched_jobs(_event_stream(spark, d), patience_seconds=PATIENCE, late=f"{LATE} seconds"), "append").select("job_id", "status", "at_ms")


_WINDOW, _MOST, _DAILY = 172_800, 3, 2


@register("stream_admitted_requests", f"""
WITH RECURSIVE {_ORDERED},
r(user_id, k, event_id, verdict, recent, day, n) AS (
  SELECT user_id, CAST(0 AS BIGINT), CAST(NULL AS BIGINT), '', CAST([] AS BIGINT[]), CAST(-1 AS BIGINT), 0 FROM (SELECT DISTINCT user_id FROM e)
  UNION ALL
  SELECT user_id, k, event_id, verdict, CASE WHEN verdict = 'ok' THEN list_append(rec, ms) ELSE rec END, d, CASE WHEN verdict = 'ok' THEN m + 1 ELSE m END
  FROM (SELECT *, CASE WHEN len(rec) >= {_MOST} THEN 'minute' WHEN m >= {_DAILY} THEN 'day' ELSE 'ok' END AS verdict FROM (
    SELECT e.user_id, e.k, e.event_id, e.ms, list_filter(r.recent, lambda t: t > e.ms - {_WINDOW} * 1000) AS rec, e.ms // 86400000 AS d, CASE WHEN e.ms // 86400000 = r.day THEN r.n ELSE 0 END AS m
    FROM r JOIN e ON e.user_id = r.user_id AND e.k = r.k + 1))
)
SELECT user_id AS client, event_id, verdict FROM r WHERE k > 0
""")
def stream_admitted_requests(spark, d):
    """Two days for a minute: the test events lie far apart."""
    with stateful.keyed_state(spark):
        return _streamed(spark, stateful.admitted_requests(_event_stream(spark, d), per_minute=_MOST, per_day=_DAILY, window_seconds=_WINDOW), "append").select("client", "event_id", "verdict")


@register("keyed_upserts", """
WITH e AS (SELECT user_id, event_type, event_id, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS last FROM events)
SELECT user_id, event_type, event_id, value FROM e WHERE last = 1
""")
def keyed_upserts(spark, d):
    """The last event of each user and kind, by three writes of which the second comes twice."""
    kept = KeyedTable(spark, graph.shared_path(spark, "keyed"), "user_id long, event_type string, event_id long, value double", ["user_id", "event_type"], buckets=8)
    events = table(spark, d, "events")
    third = events.agg((F.max("event_id") / 3).cast("long")).head()[0] or 0
    for low, high in ((-1, third), (third, 2 * third), (third, 2 * third), (2 * third, 1 << 62)):
        kept.upsert(events.where((F.col("event_id") > low) & (F.col("event_id") <= high)), order="event_id")
    return kept.read()


FAN = 64


@register("ordered_digests", f"""
WITH r AS (SELECT row_number() OVER (ORDER BY doc_id) - 1 AS n, sha256(to_json({{'doc_id': doc_id, 'lang': lang, 'source': source}})) AS digest FROM documents)
SELECT n // {FAN} AS node, sha256(string_agg(digest, '' ORDER BY n)) AS digest FROM r GROUP BY ALL
""")
def ordered_digests(spark, d):
    """Digests of documents in their order, {FAN} to a node."""
    docs = table(spark, d, "documents")
    return sinks.digest_levels(docs, ["doc_id"], ["doc_id", "lang", "source"], FAN)[0].select("node", "digest")
