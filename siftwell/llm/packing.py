"""Bounded-space online packing of documents into fixed training windows."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._common import cut, give_back, pick, table, text_steps
from siftwell.llm._tokens import encoder

WINDOW = 4096
OPEN_WINDOWS = 32
#: Partitions whose leftover windows are merged together.
MERGED_PARTITIONS = 64

_PIECES = "id long, start long, length long, ids_crc32 long, doc_tokens long, window long, offset long, open boolean"


class Bins:
    """At most ``most`` open windows, kept by free space.  A piece goes where it leaves the least; if it fits nowhere, the fullest is closed."""

    def __init__(self, size: int, most: int, first: int):
        self.size, self.most, self.next = size, most, first
        self.free: list[tuple[int, int]] = []

    def place(self, length: int) -> tuple[int, int, int | None]:
        """(window, offset, window closed to make room)."""
        closed = None
        if length == self.size:  # a window of its own needs no room among the open ones
            self.next += 1
            return self.next - 1, 0, None
        at = bisect.bisect_left(self.free, (length, -1))
        if at < len(self.free):
            room, window = self.free.pop(at)
        else:
            if len(self.free) == self.most:
                closed = self.free.pop(0)[1]
            room, window = self.size, self.next
            self.next += 1
        if room > length:
            bisect.insort(self.free, (room - length, window))
        return window, self.size - room, closed


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    window: int = WINDOW, open_windows: int = OPEN_WINDOWS, with_ids: bool = False,
) -> DataFrame:
    """Every token id of every whole document in exactly one piece of one sequence.

    A document's ids (then ``end_id``) are cut after every ``window`` ids; whole
    windows are sequences of their own and the rest goes best-fit into one of
    ``open_windows`` open windows of its partition, without a shuffle.  Windows
    still open at a partition's end are merged, best fit, over groups of
    partitions; at most ``open_windows`` a partition, they are few.

    Columns: the id, ``start``, ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset``, ``n_filled`` and ``padded_to`` (the window, or
    the filled length where that is a power of two), with ``ids`` if asked.  A
    null or empty text is the end id alone; repeated rows are packed each;
    an empty table gives no piece; other columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))

    def work(batches):
        known, number = encoder(tokenizer), TaskContext.get().partitionId()
        bins = Bins(window, open_windows, number << 40)
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(1)):
                ids, at = known.encode(data, offsets)
                ids = np.insert(ids, at[1:], np.uint32(end_id)).astype("<u4", copy=False)
                at = (at + np.arange(len(at))).tolist()
                out, texts = [], []
                for doc, x, y in zip(batch.column(0)[a:b].to_pylist(), at, at[1:]):
                    for s in range(x, y, window):
                        e = min(y, s + window)
                        place, offset, _ = bins.place(e - s)
                        out.append((doc, s - x, e - s, zlib.crc32(ids[s:e]), y - x, place, offset, False))
                        if with_ids:
                            texts.append(ids[s:e])
                yield _pieces(out, texts, with_ids)
            give_back()
        if bins.free:  # which windows are left, as rows without a piece
            left = [(None, 0, window - room, 0, 0, place, 0, True) for room, place in bins.free]
            yield _pieces(left, [np.zeros(0, np.uint32)] * len(left), with_ids)

    pieces = cut(rows.mapInArrow(work, _PIECES + ", ids array<long>" * with_ids))
    moved = _merge_left(pieces.where("open").select("window", F.col("length").alias("filled")), window)
    placed = pieces.where("not open").join(moved, "window", "left")
    placed = placed.withColumn("offset", F.col("offset") + F.coalesce("base", F.lit(0))).withColumn("window", F.coalesce("into", "window"))
    filled = placed.groupBy("window").agg(F.sum("length").alias("n_filled"))
    padded = F.when(F.col("n_filled").bitwiseAND(F.col("n_filled") - 1) == 0, F.col("n_filled")).otherwise(F.lit(window).cast("long"))
    return placed.join(filled, "window").select(
        F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", F.col("window").alias("sequence_id"), "offset",
        "n_filled", padded.alias("padded_to"), *(["ids"] if with_ids else []),
    )


def _pieces(rows: list[tuple], ids: list, with_ids: bool) -> pa.RecordBatch:
    names = ["id", "start", "length", "ids_crc32", "doc_tokens", "window", "offset", "open"]
    arrays = [pa.array([r[k] for r in rows], pa.int64() if k < 7 else pa.bool_()) for k in range(8)]
    if with_ids:
        names, arrays = [*names, "ids"], [*arrays, pa.array(ids, pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names)


def _merge_left(left: DataFrame, window: int) -> DataFrame:
    """Leftover windows put together: window, the window that takes it, and where it begins there."""
    import pandas as pd

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        bins, out, first = Bins(window, len(group) + 1, 0), [], {}
        for own, filled in group.sort_values(["filled", "window"], ascending=[False, True])[["window", "filled"]].itertuples(index=False):
            place, base, _ = bins.place(int(filled))
            out.append((own, first.setdefault(place, own), base))
        return pd.DataFrame(out, columns=["window", "into", "base"])

    group = F.shiftright("window", 40) / MERGED_PARTITIONS
    return left.groupBy(F.floor(group).alias("g")).applyInPandas(merge, "window long, into long, base long")


def op9_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=2)
