"""Keyed tables, hashes in order, and streams with state in several batches."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from siftwell.sources import sinks
from siftwell.sources.keyed import Conflict, KeyedTable
from siftwell.streaming import stateful

SCHEMA = "run string, query long, value string"


def rows(spark, *given):
    return spark.createDataFrame(list(given), SCHEMA)


def held(table):
    return sorted(map(tuple, table.read().collect()))


def test_upserts(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["run", "query"], buckets=4)
    assert held(table) == [] and table.upsert(rows(spark).limit(0)) == 0
    assert table.upsert(rows(spark, ("r", 1, "a"), ("r", 2, "b"), ("s", 1, "c"))) == 1
    assert table.upsert(rows(spark, ("r", 2, "B"), ("r", 3, "d"), (None, 1, "n"))) == 2
    want = sorted([("r", 1, "a"), ("r", 2, "B"), ("r", 3, "d"), ("s", 1, "c"), (None, 1, "n")], key=str)
    assert sorted(held_any(table), key=str) == want
    again = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["run", "query"], buckets=99)  # buckets are the table's own
    again.upsert(rows(spark, ("r", 2, "B"), ("r", 3, "d"), (None, 1, "n")))
    assert sorted(held_any(again), key=str) == want
    # of equal keys in one write the last by order stays
    again.upsert(rows(spark, ("q", 1, "x"), ("q", 1, "z"), ("q", 1, "y")), order="value")
    assert ("q", 1, "z") in held_any(again) and len(held_any(again)) == 6


def held_any(table):
    return [tuple(r) for r in table.read().collect()]


def test_a_broken_write_is_not_seen(spark, tmp_path, monkeypatch):
    table = KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["run", "query"], buckets=2)
    table.upsert(rows(spark, ("r", 1, "a"), ("r", 2, "b")))
    monkeypatch.setattr(table, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("the driver is gone")))
    with pytest.raises(RuntimeError, match="gone"):
        table.upsert(rows(spark, ("r", 2, "X"), ("r", 3, "X")))
    monkeypatch.undo()
    assert held(table) == [("r", 1, "a"), ("r", 2, "b")]
    (tmp_path / "t/commits/000000000002.json").write_text('{"buckets": 2, "at"')  # a writer that broke off within the commit itself
    assert held(table) == [("r", 1, "a"), ("r", 2, "b")]
    assert table.upsert(rows(spark, ("r", 2, "X"), ("r", 3, "X"))) == 3  # resumed: each key once
    assert held(table) == [("r", 1, "a"), ("r", 2, "X"), ("r", 3, "X")]
    assert table.sweep() >= 1 and held(table) == [("r", 1, "a"), ("r", 2, "X"), ("r", 3, "X")]


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    one, two = (KeyedTable(spark, str(tmp_path / "t"), SCHEMA, ["run", "query"], buckets=2) for _ in range(2))
    commit, met = one._commit, []

    def late(number, doc):
        if not met:
            met.append(two.upsert(rows(spark, ("r", 1, "two"), ("r", 2, "two"))))
        commit(number, doc)

    monkeypatch.setattr(one, "_commit", late)
    one.upsert(rows(spark, ("r", 1, "one")))
    assert met == [1] and held(two) == [("r", 1, "one"), ("r", 2, "two")]
    monkeypatch.setattr(one, "_commit", lambda *a: (_ for _ in ()).throw(Conflict("again")))
    with pytest.raises(Conflict, match="other writes"):
        one.upsert(rows(spark, ("r", 1, "one")))


def test_hash_in_order(spark, tmp_path):
    given = [(k, f"text {k}", None if k % 5 == 0 else float(k)) for k in range(200)]
    frame = spark.createDataFrame(given, "n long, text string, x double")
    want = sinks.ordered_hash(frame.coalesce(1), ["n"], ["text", "x"], fan=7)
    assert {sinks.ordered_hash(frame.repartition(p), ["n"], ["text", "x"], fan=7) for p in (2, 9)} == {want}
    assert [level.count() for level in sinks.digest_levels(frame, ["n"], ["text"], fan=7)] == [29, 5, 1]
    swapped = [(k if k not in (3, 4) else 7 - k, t, x) for k, t, x in given]
    assert sinks.ordered_hash(spark.createDataFrame(swapped, frame.schema), ["n"], ["text", "x"], fan=7) != want
    assert sinks.ordered_hash(frame.withColumn("x", F.coalesce("x", F.lit(0.0))), ["n"], ["text", "x"], fan=7) != want  # a null is not a zero
    assert sinks.ordered_hash(frame.limit(0), ["n"], ["text"]) == sinks.ordered_hash(frame.limit(0), ["n"], ["x"])
    for name, data in (("a.txt", b"one"), ("b.txt", b"two"), ("c.bin", b"\x00")):
        (tmp_path / name).write_bytes(data)
    before = sinks.hash_files(spark, str(tmp_path))
    assert before == sinks.hash_files(spark, str(tmp_path)) and before != sinks.hash_files(spark, str(tmp_path), "*.txt")
    (tmp_path / "b.txt").write_bytes(b"twO")
    assert sinks.hash_files(spark, str(tmp_path)) != before


# ---- streams


EVENTS = "event_id long, ts timestamp, user_id long, event_type string"
START = dt.datetime(2024, 3, 1, 12, tzinfo=dt.UTC)


def stream(spark, tmp_path, batches, make, name):
    """What a stream says over one file for each batch."""
    for k, batch in enumerate(batches):
        frame = spark.createDataFrame([(e, START + dt.timedelta(seconds=s), u, kind) for e, s, u, kind in batch], EVENTS)
        frame.coalesce(1).write.parquet(str(tmp_path / f"{name}-in" / f"b{k}"))
    read = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / f"{name}-in" / "*"))
    with stateful.keyed_state(spark):
        q = make(read).writeStream.format("parquet").option("path", str(tmp_path / f"{name}-out")).option("checkpointLocation", str(tmp_path / f"{name}-log")).trigger(availableNow=True).start()
        q.awaitTermination()
    return spark.read.parquet(str(tmp_path / f"{name}-out"))


def test_numbered_traces(spark, tmp_path):
    batches = [[(1, 0, 7, "a"), (2, 5, 7, "a"), (9, 1, 8, "a")], [(2, 5, 7, "a"), (3, 200, 7, "a"), (3, 200, 7, "a")], [(4, 20, 7, "a"), (5, 150, 7, "a"), (1, 0, 7, "a")]]
    got = stream(spark, tmp_path, batches, lambda e: stateful.numbered_traces(e, late_seconds=100), "n").collect()
    assert sorted((r.trace_id, r.event_id, r.seq, r.status) for r in got if r.seq is not None) == [(7, 1, 0, "new"), (7, 2, 1, "new"), (7, 3, 2, "new"), (7, 5, 3, "new"), (8, 9, 0, "new")]
    assert sorted((r.event_id, r.status) for r in got if r.seq is None) == [(1, "late"), (2, "repeated"), (3, "repeated"), (4, "late")]


def test_watched_jobs(spark, tmp_path):
    batches = [[(1, 0, 1, "step"), (2, 10, 2, "step"), (3, 20, 3, "done")], [(4, 500, 2, "step"), (5, 510, 2, "done")], [(6, 2000, 9, "step")]]
    got = stream(spark, tmp_path, batches, lambda e: stateful.watched_jobs(e, ends=("done",), patience_seconds=100, late="1 second"), "w")
    at = {(r.job_id, r.status, r.at_ms // 1000 - int(START.timestamp())) for r in got.collect()}
    assert at == {(1, "running", 0), (1, "interrupted", 100), (2, "running", 10), (2, "interrupted", 110), (2, "running", 500), (2, "ended", 510), (3, "ended", 20), (9, "running", 2000)}


def test_admitted_requests(spark, tmp_path):
    day = 86_400
    batches = [[(1, 0, 1, ""), (2, 1, 1, ""), (3, 2, 1, ""), (4, 2, 2, "")], [(5, 60, 1, ""), (6, 61, 1, ""), (7, 62, 1, "")], [(8, 300, 1, ""), (9, 301, 1, ""), (10, day, 1, "")]]
    got = {r.event_id: r.verdict for r in stream(spark, tmp_path, batches, lambda e: stateful.admitted_requests(e, per_minute=2, per_day=5), "a").collect()}
    assert got == {1: "ok", 2: "ok", 3: "minute", 4: "ok", 5: "ok", 6: "ok", 7: "minute", 8: "ok", 9: "day", 10: "ok"}


def test_a_trace_reads_and_writes_its_state_once_for_all_rows():
    from pyspark.sql import Row

    class Value:
        def __init__(self):
            self.value, self.calls = None, 0

        def exists(self):
            self.calls += 1
            return self.value is not None

        def get(self):
            self.calls += 1
            return self.value

        def update(self, value):
            self.calls += 1
            self.value = value

    class Handle:
        def getValueState(self, name, schema):
            self.state = Value()
            return self.state

    handle, numbers = Handle(), stateful._Numbers(100_000)
    numbers.init(handle)
    for k in range(2):  # the second time all come again
        out = list(numbers.handleInputRows((7,), iter([Row(event_id=e, us=e * 1_000_000) for e in reversed(range(90))]), None))
        assert [(r.event_id, r.seq, r.status) for r in out] == [(e, None if k else e, "repeated" if k else "new") for e in range(90)]
    assert handle.state.calls <= 6
