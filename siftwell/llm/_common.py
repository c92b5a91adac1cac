"""What the corpus operators share: storage that all executors see, and Arrow helpers."""

from __future__ import annotations

import ctypes
import os
import sys
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step takes at a time; a longer text is a step of its own.
STEP_BYTES = 1_000_000
#: Rows of ids and keys that are broadcast at most, after a count; more are joined by a shuffle, with the same result.
BROADCAST_ROWS = 1_000_000


_LIBC = ctypes.CDLL("libc.so.6") if sys.platform == "linux" and os.path.exists("/proc/self/maps") else None


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only where it is unset and all runs in one process (tests), one of our own."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if place:
        return place
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftwell-"))
    return jsc.getCheckpointDir().get()


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/siftwell/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder, with its partitioning; later reads start from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def cut_dealt(df: DataFrame) -> DataFrame:
    """As :func:`cut`, for rows just dealt out by a key: joins on that key then leave them where they are.

    Spark keeps a checkpoint's partitioning only where the plan was not adaptive.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return cut(df)
    finally:
        conf.set("spark.sql.adaptive.enabled", before)


def small(rows: DataFrame) -> DataFrame:
    """``rows``, written, to be broadcast if there are few: the texts on the other side of a join then stay where they are."""
    rows = cut(rows)
    return F.broadcast(rows) if rows.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else rows


def grouped(batches, by: tuple[str, ...]):
    """Columns as arrays, whole groups of sorted rows at a time, with the groups' bounds."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        part = {k: batch.column(k).to_numpy(zero_copy_only=False) for k in batch.schema.names}
        if held is not None:
            part = {k: np.concatenate([held[k], part[k]]) for k in part}
        new = np.flatnonzero(np.any([part[k][1:] != part[k][:-1] for k in by], axis=0)) + 1
        if not len(new):
            held = part
            continue
        yield part, np.r_[0, new]
        held = {k: x[new[-1] :] for k, x in part.items()}
    if held is not None:
        yield held, np.array([0, len(held[by[0]])])


def stash(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a compressed columnar table in the shared folder, for rows that hold texts."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under internal names: other columns cannot clash."""
    return df.select(*(F.col(f"`{old}`").alias(new) for new, old in columns.items()))


def give_back() -> None:
    """Freed memory goes back to the system: workers are kept from stage to stage, and share an executor's memory."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def raw_text(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of a string column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or not len(column):
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def steps(offsets: np.ndarray, most: int = STEP_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes each (one row at least)."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + most, "right")) - 1
        last = min(n, max(first + 1, last))
        yield first, last
        first = last


def text_steps(column, most: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, last row, bytes, offsets from 0) over a string column, step by step."""
    data, offsets = raw_text(column)
    for a, b in steps(offsets, most):
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]


def lower_ascii() -> np.ndarray:
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    return to


LOWER = lower_ascii()


def byte_class(*ranges: tuple[int, int]) -> np.ndarray:
    inside = np.zeros(256, bool)
    for a, b in ranges:
        inside[a : b + 1] = True
    return inside


def word_spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray):
    """Start, end and row of every maximal run of bytes of a class; runs end with their row."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    is_word = inside[data]
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = is_word[:-1]
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = is_word[1:]
    bounds = offsets[1:-1]
    before[bounds[bounds < n]] = False
    after[bounds[(bounds > 0)] - 1] = False
    starts = np.flatnonzero(is_word & ~before)
    ends = np.flatnonzero(is_word & ~after) + 1
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, ends, rows


class Powers:
    """Powers of a number modulo 2**64, longer when asked."""

    def __init__(self, base: int):
        self.base, self.table = base, np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.table) <= n:
            step = np.full(max(n + 1, STEP_BYTES + 1), self.base, np.uint64)
            step[0] = 1
            self.table = np.cumprod(step, dtype=np.uint64)
        return self.table


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads every bit of a 64-bit number over the others."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


_BASE = 0x9E3779B97F4A7C15
_POWERS, _INVERSE = Powers(_BASE), Powers(pow(_BASE, -1, 2**64))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span, by content alone."""
    n = len(data)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _POWERS.upto(n)[:n], out=sums[1:])
    h = (sums[ends] - sums[starts]) * _INVERSE.upto(n)[starts]
    return mix(h ^ ((ends - starts).astype(np.uint64) << np.uint64(56)))
