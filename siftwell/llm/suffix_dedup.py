"""Exact removal of repeated passages by two-stage suffix sorting.

A byte is removed when a string of ``least`` bytes covers it that also starts in
a document with a smaller id.  The work is dealt out so that no task needs the
suffixes of all documents:

1.  Documents are put into blocks, which are dealt to partitions once and kept
    there.  Every window of ``least`` bytes has an anchor, the least hash of the
    grams within it; equal windows have equal anchors.  Anchors are gathered by
    their hash, and those of one document alone are ruled out.
2.  Windows with the same other anchor that follow each other form a segment.
    Segments are gathered by their anchor, equal ones at once, and the suffixes
    that start in them are sorted in two stages: those that start with a byte
    not larger than the next are sorted directly, the others follow by scanning
    the buckets of the first byte in order.  Neighbours whose common prefix has
    ``least`` bytes are the same string; its smallest document keeps it.
    Windows with an anchor of very many blocks are gathered by the anchor of
    longer grams instead, so that no bucket has all of them.
3.  Each block hears which windows go and cuts the bytes they cover.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._common import _INVERSE, _POWERS, cut, cut_dealt, give_back, mix, pick, raw_text, span_hashes, steps, table

LEAST = 50
#: Bytes of a gram whose hash can be an anchor: long enough that few are shared where no window is, also in a large table.
GRAM = 24
#: Share of a window's bytes in the longer gram of windows whose anchor very many blocks have.
LONG_SHARE = 0.8
#: Compression of the blocks, which are written twice.
BLOCK_LEVEL = 6
#: Text bytes of a block (one document at least).
BLOCK_BYTES = 3_000_000
#: Text bytes of a block that are hashed at a time (one document at least).
SLICE_BYTES = 1_000_000
#: Windows of a segment; longer runs are several segments.
SEGMENT = 64
#: Suffixes sorted at a time, about; a sort ends between two anchors.
SORTED = 300_000
#: Text bytes of a bucket, about; there are as many as there are shuffle partitions at least.
BUCKET_BYTES = 64_000_000
#: An anchor that more blocks have is not gathered in one bucket: its windows are, by the anchors of longer grams.
HOT_BLOCKS = 1000
#: Bits of an anchor that are told to its bucket; two that agree in them are both gathered, which costs bytes but no result.
_SUFFIX = np.uint64((1 << 31) - 1)
#: Bytes of a segment's key that are told to its bucket.
_KEY_BYTES = 5
_LAST_ID = np.iinfo(np.int64).max


# ---- two-stage suffix sorting


def _word(text8: np.ndarray, at: np.ndarray) -> np.ndarray:
    return text8[at].view(">u8").reshape(-1).astype(np.uint64)


def _direct_order(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """Positions in ``at`` in the order of their first ``depth`` bytes, equal ones in any order."""
    text8 = np.lib.stride_tricks.as_strided(text, (len(text) - 7, 8), (1, 1))
    key = _word(text8, at)
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    group = np.cumsum(new) - 1
    for done in range(8, depth, 8):
        tied = ~new
        tied[:-1] |= ~new[1:]
        here = np.flatnonzero(tied)
        if not len(here):
            break
        key = _word(text8, at[order[here]] + done)
        if depth - done < 8:
            key &= ~np.uint64((1 << 8 * (8 - depth + done)) - 1)
        sub = np.lexsort((key, group[here]))
        order[here] = order[here[sub]]
        key, of = key[sub], group[here]
        new[here[1:]] |= (of[1:] == of[:-1]) & (key[1:] != key[:-1])
        group = np.cumsum(new) - 1
    return order


def suffix_order(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes at ``starts`` (ascending) in the order of their first ``depth`` bytes.

    Each has ``depth`` bytes of its own, and ``text`` goes on for 8 more after
    the last.  Directly sorted are the suffixes whose first byte is not larger
    than the next, and those whose successor is not to be sorted itself.
    """
    if not len(starts):
        return starts
    number = np.full(len(text) + 1, -1, np.int64)
    number[starts] = np.arange(len(starts))
    first = text[starts]
    falls = first > text[starts + 1]
    alone = number[starts + 1] < 0
    rest = np.flatnonzero(~falls)
    rest = rest[_direct_order(text, starts[rest], depth)]
    rest_at = np.searchsorted(first[rest], np.arange(257))
    lone = np.flatnonzero(falls & alone)
    lone = lone[_direct_order(text, starts[lone], depth)] if len(lone) else lone
    lone_at = np.searchsorted(first[lone], np.arange(257))
    rows = np.lib.stride_tricks.as_strided(text, (len(text) - depth + 1, depth), (1, 1))
    induced: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []
    for c in range(256):
        bucket = np.concatenate(induced[c]) if induced[c] else np.zeros(0, np.int64)
        single = lone[lone_at[c] : lone_at[c + 1]]
        if len(single):
            if len(bucket):
                keys = np.ascontiguousarray(rows[starts[bucket]]).view(f"S{depth}").reshape(-1)
                own = np.ascontiguousarray(rows[starts[single]]).view(f"S{depth}").reshape(-1)
                bucket = np.insert(bucket, np.searchsorted(keys, own), single)
            else:
                bucket = single
        bucket = np.concatenate([bucket, rest[rest_at[c] : rest_at[c + 1]]])
        induced[c] = []
        if len(bucket):
            out.append(bucket)
            before = starts[bucket] - 1
            before = number[before[before >= 0]]
            before = before[before >= 0]
            before = before[falls[before]]
            if len(before):
                byte = first[before]
                by = np.argsort(byte, kind="stable")
                byte, before = byte[by], before[by]
                edge = np.flatnonzero(np.r_[True, byte[1:] != byte[:-1]])
                for a, b in zip(edge.tolist(), [*edge[1:].tolist(), len(byte)]):
                    induced[int(byte[a])].append(before[a:b])
    return np.concatenate(out)


def common_prefixes(text: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """Bytes, up to ``depth``, that each suffix shares with the one before it in the given order (the first: 0)."""
    out = np.zeros(len(starts), np.int64)
    rows = np.lib.stride_tricks.as_strided(text, (len(text) - depth + 1, depth), (1, 1))
    for k in range(1, len(starts), 100_000):
        to = min(len(starts), k + 100_000)
        part = rows[starts[k - 1 : to]]
        differ = part[1:] != part[:-1]
        out[k:to] = np.where(differ.any(axis=1), differ.argmax(axis=1), depth)
    return out


def least_owners(segments: list[np.ndarray] | np.ndarray, sizes: np.ndarray, owners: np.ndarray, depth: int) -> np.ndarray:
    """For each window of each segment, in order, the smallest owner of an equal window.

    ``segments`` is the segments' bytes one after the other.
    """
    text = np.concatenate([segments, np.zeros(depth + 8, np.uint8)])
    at = np.cumsum(sizes) - sizes
    windows = sizes - depth + 1
    of = np.repeat(np.arange(len(sizes)), windows)
    starts = at[of] + np.arange(len(of)) - np.repeat(np.cumsum(windows) - windows, windows)
    order = suffix_order(text, starts, depth)
    same = common_prefixes(text, starts[order], depth) >= depth
    group = np.flatnonzero(~same)
    low = np.minimum.reduceat(owners[of[order]], group) if len(group) else np.zeros(0, np.int64)
    out = np.empty(len(of), np.int64)
    out[order] = np.repeat(low, np.diff(np.r_[group, len(order)]))
    return out


# ---- anchors and segments of a block


def _sums(data: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(data) + 1, np.uint64)
    term = data.astype(np.uint64)
    term += np.uint64(1)
    term *= _POWERS.upto(len(data))[: len(data)]
    np.cumsum(term, out=sums[1:])
    return sums


def _least_grams(sums: np.ndarray, gram: int, least: int) -> np.ndarray:
    """The least hash of the grams within the window at each position."""
    low = sums[gram:] - sums[:-gram]
    low *= _INVERSE.upto(len(sums) - 1)[: len(low)]
    low = mix(low)
    width, span = least - gram + 1, 1
    while 2 * span <= width:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if width > span:
        low = np.minimum(low[: span - width], low[width - span :])
    return low


def _segment_parts(first: np.ndarray, stop: np.ndarray, row: np.ndarray):
    """Runs of more than SEGMENT windows as several."""
    parts = -(-(stop - first) // SEGMENT)
    if (parts > 1).any():
        k = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
        first, stop, row = (np.repeat(x, parts) for x in (first, stop, row))
        first = first + k * SEGMENT
        stop = np.minimum(stop, first + SEGMENT)
    return first, stop, row


class Block:
    """A block's texts and its runs of windows with a common anchor, found slice by slice."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, ids: np.ndarray, least: int):
        self.data, self.offsets, self.ids, self.least = data, offsets, ids, least
        found = [self._slice(a, b) for a, b in steps(offsets, SLICE_BYTES) if offsets[b] - offsets[a] >= least]
        found = found or [(np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2]
        self.first, self.count, self.row, self.key, self.content = (np.concatenate(x) for x in zip(*found))

    def _slice(self, a: int, b: int):
        least, begin = self.least, int(self.offsets[a])
        data, offsets = self.data[begin : self.offsets[b]], self.offsets[a : b + 1] - begin
        sums, inverse = _sums(data), _INVERSE.upto(len(data))
        low = _least_grams(sums, min(GRAM, least), least)
        whole = np.zeros(len(low) + 1, np.int8)  # windows that stay in their document
        fits = np.diff(offsets) >= least
        np.add.at(whole, offsets[:-1][fits], 1)
        np.add.at(whole, (offsets[1:] - least + 1)[fits], -1)
        whole = np.cumsum(whole[:-1], dtype=np.int8) > 0
        new = whole.copy()
        new[1:] &= (low[1:] != low[:-1]) | ~whole[:-1]
        new[offsets[:-1][fits]] = True
        first = np.flatnonzero(new)
        stop = np.r_[first[1:], len(low)]
        row = np.searchsorted(offsets, first, "right") - 1
        stop = np.minimum(stop, offsets[row + 1] - least + 1)
        first, stop, row = _segment_parts(first, stop, row)
        key = mix(low[first] ^ np.uint64(0xA0761D6478BD642F))
        content = mix((sums[stop + least - 1] - sums[first]) * inverse[first] ^ ((stop - first).astype(np.uint64) << np.uint64(56)))
        return first + begin, stop - first, row + a, key, content

    def anchors(self, buckets: int):
        """Different anchors in order of bucket and suffix: bucket, suffix, whether two documents here have it; and where each run's is."""
        order = np.argsort(self.key, kind="stable")
        key = self.key[order]
        new = np.r_[True, key[1:] != key[:-1]] if len(key) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        ids = self.ids[self.row[order]]
        several = np.minimum.reduceat(ids, at) != np.maximum.reduceat(ids, at) if len(at) else np.zeros(0, bool)
        key = key[at]
        bucket, suffix = (key >> np.uint64(47)).astype(np.int64) % buckets, key & _SUFFIX
        place = np.lexsort((suffix, bucket))
        where = np.empty(len(key), np.int64)
        where[place] = np.arange(len(key))
        of = np.empty(len(order), np.int64)
        of[order] = where[np.cumsum(new) - 1]
        return bucket[place], suffix[place], several[place], of


def _planes(values: np.ndarray, size: int) -> bytes:
    """The low ``size`` bytes of numbers, all lowest bytes first."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].T).tobytes()


def _from_planes(raw: bytes, n: int, size: int, at: int = 0) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :size] = np.frombuffer(raw, np.uint8, n * size, at).reshape(size, n).T
    return out.view("<u8").reshape(-1)


def _ascending(values: np.ndarray) -> bytes:
    """Numbers below 2**32, ascending but for equal suffixes, as their differences modulo 2**32."""
    return _squeeze(_planes(np.diff(values, prepend=np.uint64(0)), 4))


def _from_ascending(raw: bytes) -> np.ndarray:
    raw = _stretch(raw)
    return np.cumsum(_from_planes(raw, len(raw) // 4, 4), dtype=np.uint64) & np.uint64(0xFFFFFFFF)


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _stretch(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _open(body: bytes, id_at: int, text_at: int, least: int):
    rows = pa.ipc.open_stream(body).read_all().combine_chunks()
    data, offsets = raw_text(rows.column(text_at))
    ids = rows.column(id_at).cast(pa.int64()).combine_chunks().fill_null(_LAST_ID).to_numpy(zero_copy_only=False)
    return rows, Block(data, offsets, ids, least)


def _blocks(docs: DataFrame, text_at: int, parts: int) -> DataFrame:
    """Rows put together as compressed Arrow streams, dealt out by block number and written once."""
    def work(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0

        def block():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", compression_level=BLOCK_LEVEL))) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_pydict({"block": [number], "body": [sink.getvalue().to_pybytes()]})

        for batch in batches:
            _, offsets = raw_text(batch.column(text_at))
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(offsets, offsets[first] + BLOCK_BYTES - size, "right")) - 1
                last = min(batch.num_rows, max(first + (not held), last))
                if last > first:
                    held.append(batch.slice(first, last - first))
                    size += int(offsets[last] - offsets[first])
                if last < batch.num_rows:
                    yield block()
                    number, held, size = number + 1, [], 0
                first = last
        if held:
            yield block()
        del held
        give_back()

    return cut_dealt(docs.mapInArrow(work, "block long, body binary").repartition(parts, "block"))


def _told(blocks: DataFrame, told: DataFrame) -> DataFrame:
    """Blocks with what the buckets say to them; the blocks stay where they are."""
    gathered = told.groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias("told"))
    return blocks.join(gathered.hint("shuffle_hash"), "block", "left")


def _said(row) -> dict[int, bytes]:
    return {x["bucket"]: x["body"] for x in (row.as_py() or [])}


def _hits(bucket: np.ndarray, said: dict[int, bytes], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """What the buckets returned for a block's anchors, which are in order of bucket: whether several documents have it, and very many blocks."""
    hit, hot = np.zeros(len(bucket), bool), np.zeros(len(bucket), bool)
    edge = np.searchsorted(bucket, np.arange(buckets + 1))
    for k, body in said.items():
        part, n = slice(edge[k], edge[k + 1]), int(edge[k + 1] - edge[k])
        bits = np.frombuffer(_stretch(body), np.uint8)
        hit[part], hot[part] = (np.unpackbits(x, count=n).astype(bool) for x in np.split(bits, 2))
    return hit, hot


class Runs:
    """A block's runs of windows with an anchor that is shared; those of very many blocks by the anchors of longer grams."""

    def __init__(self, block: Block, said: dict[int, bytes], buckets: int):
        bucket, _, _, of = block.anchors(buckets)
        hit, hot = _hits(bucket, said, buckets)
        own = np.flatnonzero((hit & ~hot)[of])
        parts = [(block.first[own], block.count[own], block.row[own], block.key[own], block.content[own], bucket[of[own]])]
        split = np.flatnonzero((hit & hot)[of])
        if len(split):
            n = block.count[split]
            row = np.repeat(block.row[split], n)
            first = np.repeat(block.first[split], n) + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
            parts += [_longer(block, first[a:b], row[a:b], buckets) for a, b in _near_each_other(first)]
        self.first, self.count, self.row, self.key, self.content, self.bucket = (np.concatenate(x) for x in zip(*parts))
        self.ids = block.ids[self.row]

    def __len__(self) -> int:
        return len(self.first)


def _near_each_other(first: np.ndarray):
    """Ranges of ascending positions in stretches of SLICE_BYTES."""
    a = 0
    while a < len(first):
        b = int(np.searchsorted(first, first[a] + SLICE_BYTES))
        yield a, b
        a = b


def _longer(block: Block, at: np.ndarray, row: np.ndarray, buckets: int):
    """Runs of the windows at ascending positions that follow each other with the same anchor of longer grams."""
    least, begin = block.least, at[0]
    data, at = block.data[begin : at[-1] + block.least], at - begin
    low = _least_grams(_sums(data), max(min(GRAM, least), int(LONG_SHARE * least)), least)[at]
    edge = np.flatnonzero(np.r_[True, (np.diff(at) != 1) | (low[1:] != low[:-1]) | (row[1:] != row[:-1])])
    first, stop, row = _segment_parts(at[edge], at[np.r_[edge[1:], len(at)] - 1] + 1, row[edge])
    key = mix(low[np.searchsorted(at, first)] ^ np.uint64(0xE7037ED1A0B428DB))
    return first + begin, stop - first, row, key, span_hashes(data, first, stop + least - 1), (key >> np.uint64(47)).astype(np.int64) % buckets


def _segments(runs: Runs):
    """Different segments in order of bucket: runs that stand for them, their smallest document, and where each run's is."""
    order = np.lexsort((runs.content, runs.key, runs.bucket))
    content, key = runs.content[order], runs.key[order]
    new = np.r_[True, (content[1:] != content[:-1]) | (key[1:] != key[:-1])] if len(order) else np.zeros(0, bool)
    at = np.flatnonzero(new)
    ids = runs.ids
    owner = np.minimum.reduceat(ids[order], at) if len(at) else np.zeros(0, np.int64)
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return order[at], owner, of


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    stop = np.cumsum(sizes)
    return data[np.repeat(starts - (stop - sizes), sizes) + np.arange(int(stop[-1]) if len(stop) else 0)]


_ROW = "bucket int, block long, body binary"


def _rows(bucket, block, body) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket, pa.int32()), pa.array(block, pa.int64()), pa.array(body, pa.binary())], ["bucket", "block", "body"])


def _by_bucket(batches):
    """Bucket, blocks and bodies of each bucket in a partition."""
    found: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for bucket, block, body in zip(*(c.to_pylist() for c in batch.columns)):
            blocks, bodies = found.setdefault(bucket, ([], []))
            blocks.append(block)
            bodies.append(body)
    for bucket in sorted(found):
        order = np.argsort(found[bucket][0], kind="stable").tolist()
        yield bucket, [found[bucket][0][k] for k in order], [found[bucket][1][k] for k in order]


def _send_anchors(id_at: int, text_at: int, least: int, buckets: int):
    def work(batches):
        for batch in batches:
            for number, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                _, block = _open(body.as_py(), id_at, text_at, least)
                bucket, suffix, several, _ = block.anchors(buckets)
                value = suffix << np.uint64(1) | several.astype(np.uint64)
                edge = np.searchsorted(bucket, np.arange(buckets + 1))
                full = np.flatnonzero(np.diff(edge)).tolist()
                if full:
                    yield _rows(full, [number] * len(full), [_ascending(value[edge[k] : edge[k + 1]]) for k in full])
                del block
                give_back()

    return work


def _shared_anchors(hot_blocks: int):
    def work(batches):
        for bucket, blocks, bodies in _by_bucket(batches):
            parts = [_from_ascending(b) for b in bodies]
            value = np.concatenate(parts)
            suffix, several = value >> np.uint64(1), (value & np.uint64(1)).astype(bool)
            order = np.argsort(suffix, kind="stable")
            new = np.r_[True, suffix[order][1:] != suffix[order][:-1]]
            at = np.flatnonzero(new)
            n = np.diff(np.r_[at, len(order)])
            shared, very = (n > 1) | np.logical_or.reduceat(several[order], at), n > hot_blocks
            hit, hot = np.empty(len(order), bool), np.empty(len(order), bool)
            hit[order], hot[order] = shared[np.cumsum(new) - 1], very[np.cumsum(new) - 1]
            edge = np.cumsum([0, *map(len, parts)])
            yield _rows([bucket] * len(blocks), blocks, [_squeeze(np.packbits(hit[a:b]).tobytes() + np.packbits(hot[a:b]).tobytes()) for a, b in zip(edge, edge[1:])])

    return work


def _send_segments(id_at: int, text_at: int, least: int, buckets: int):
    def work(batches):
        for batch in batches:
            for number, body, told in zip(batch.column("block").to_pylist(), batch.column("body"), batch.column("told")):
                _, block = _open(body.as_py(), id_at, text_at, least)
                runs = Runs(block, _said(told), buckets)
                if not len(runs):
                    continue
                chosen, owner, _ = _segments(runs)
                edge = np.searchsorted(runs.bucket[chosen], np.arange(buckets + 1))
                first, key = runs.first[chosen], runs.key[chosen]
                size = runs.count[chosen] + least - 1
                full = np.flatnonzero(np.diff(edge)).tolist()
                bodies = []
                for k in full:
                    part = slice(edge[k], edge[k + 1])
                    text = _gather(block.data, first[part], size[part])
                    head = np.array([edge[k + 1] - edge[k]], "<u8").tobytes()
                    bodies.append(_squeeze(b"".join([head, _planes(key[part], _KEY_BYTES), owner[part].astype("<i8").tobytes(), size[part].astype("<u2").tobytes(), text.tobytes()])))
                yield _rows(full, [number] * len(full), bodies)
                del block, bodies
                give_back()

    return work


def _judge_segments(least: int):
    def work(batches):
        for bucket, blocks, bodies in _by_bucket(batches):
            counts, keys, owners, sizes, texts = [], [], [], [], []
            for raw in map(_stretch, bodies):
                n = int(np.frombuffer(raw, "<u8", 1)[0])
                counts.append(n)
                at = 8 + _KEY_BYTES * n
                keys.append(_from_planes(raw, n, _KEY_BYTES, 8))
                owners.append(np.frombuffer(raw, "<i8", n, at))
                sizes.append(np.frombuffer(raw, "<u2", n, at + 8 * n).astype(np.int64))
                texts.append(np.frombuffer(raw, np.uint8, offset=at + 10 * n))
            key, owner, size = (np.concatenate(x) for x in (keys, owners, sizes))
            text = np.concatenate(texts)
            texts.clear()
            gone = _gone(key, owner, size, text, least)
            edge = np.cumsum([0, *counts])
            told = [(b, gone[x:y]) for b, x, y in zip(blocks, edge, edge[1:]) if gone[x:y].any()]
            if told:
                yield _rows([bucket] * len(told), [b for b, _ in told], [_squeeze(x.astype("<u8").tobytes()) for _, x in told])
            del counts, keys, owners, sizes, texts, key, owner, size, text, gone, told
            give_back()

    return work


def _gone(key, owner, size, text, least) -> np.ndarray:
    """A bit for each window of each segment: whether a smaller document has the same string."""
    ends = np.r_[0, np.cumsum(size)]
    at = ends[:-1]
    content = np.concatenate([span_hashes(text[ends[a] : ends[b]], at[a:b] - ends[a], ends[a + 1 : b + 1] - ends[a]) for a, b in steps(ends, SLICE_BYTES)])
    order = np.lexsort((owner, content, key))
    new = np.r_[True, (content[order][1:] != content[order][:-1]) | (key[order][1:] != key[order][:-1])]
    first = np.flatnonzero(new)
    rep, of = order[first], np.empty(len(order), np.int64)  # the segment of the smallest owner stands for equal ones
    of[order] = np.cumsum(new) - 1
    windows = size[rep] - least + 1
    edge = np.r_[0, np.cumsum(windows)]
    low = np.empty(int(edge[-1]), np.int64)
    same_key = np.r_[key[rep][1:] == key[rep][:-1], False]
    a = 0
    while a < len(rep):
        b = min(len(rep), max(a + 1, int(np.searchsorted(edge, edge[a] + SORTED))))
        while b < len(rep) and same_key[b - 1]:
            b += 1
        part = rep[a:b]
        low[edge[a] : edge[b]] = least_owners(_gather(text, at[part], size[part]), size[part], owner[part], least)
        a = b
    # windows of equal segments are the same; only the owner differs
    bits = np.zeros(len(key), np.uint64)
    for j in range(int(windows.max())):
        here = np.flatnonzero(windows[of] > j)
        bits[here] |= (low[edge[of[here]] + j] < owner[here]).astype(np.uint64) << np.uint64(j)
    return bits


def _cut_blocks(id_at: int, text_at: int, least: int, buckets: int, finish):
    def work(batches):
        for batch in batches:
            for body, told, judged in zip(batch.column("body"), batch.column("told"), batch.column("judged")):
                rows, block = _open(body.as_py(), id_at, text_at, least)
                goes = np.zeros(len(block.data) + 1, np.int32)
                said = _said(judged)
                runs = Runs(block, _said(told), buckets)
                if len(runs):
                    chosen, owner, segment = _segments(runs)
                    bits = np.zeros(len(chosen), np.uint64)
                    edge = np.searchsorted(runs.bucket[chosen], np.arange(buckets + 1))
                    for k, raw in said.items():
                        bits[edge[k] : edge[k + 1]] = np.frombuffer(_stretch(raw), "<u8")
                    here = bits[segment]
                    here[runs.ids > owner[segment]] = ~np.uint64(0)
                    some, here = here > 0, here[here > 0]
                    n = runs.count[some]
                    k = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    starts = np.repeat(runs.first[some], n) + k
                    starts = starts[(np.repeat(here, n) >> k.astype(np.uint64) & np.uint64(1)) > 0]
                    goes[starts] += 1
                    np.subtract.at(goes, starts + least, 1)
                yield from finish(rows, block, np.cumsum(goes[:-1]) > 0)
                del rows, block, goes
                give_back()

    return work


def _digest(rows: pa.Table, block: Block, gone: np.ndarray):
    out = []
    at = block.offsets.tolist()
    spans = gone.copy()
    spans[1:] &= ~gone[:-1]
    inner = block.offsets[:-1][np.diff(block.offsets) > 0]
    spans[inner] = gone[inner]
    for a, b in zip(at, at[1:]):
        keep = block.data[a:b][~gone[a:b]]
        out.append((b - a, b - a - len(keep), int(spans[a:b].sum()), hashlib.sha256(keep.tobytes()).hexdigest()))
    columns = [rows.column(0).combine_chunks(), *(pa.array([x[k] for x in out], pa.int64() if k < 3 else pa.string()) for k in range(4))]
    yield pa.RecordBatch.from_arrays(columns, ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _rewrite(text_at: int, count_at: int | None):
    def finish(rows: pa.Table, block: Block, gone: np.ndarray):
        for batch in rows.to_batches():
            columns = list(batch.columns)
            at = block.offsets.tolist()
            texts = [block.data[a:b][~gone[a:b]].tobytes().decode(errors="ignore") for a, b in zip(at, at[1:])]
            columns[text_at] = pa.array(texts, batch.schema.field(text_at).type)
            if count_at is not None:
                columns[count_at] = pa.array([len(t) for t in texts], batch.schema.field(count_at).type)
            empty = pa.array([bool(t) or a == b for t, a, b in zip(texts, at, at[1:])])
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(empty)

    return finish


def _run(docs: DataFrame, id_at: int, text_at: int, least: int, finish, schema) -> DataFrame:
    if least < 8:
        raise ValueError("least is 8 bytes or more")
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{docs.columns[text_at]}`")))).head()[0] or 0
    buckets = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // BUCKET_BYTES))
    blocks = _blocks(docs, text_at, buckets)
    own = (id_at, text_at, least, buckets)
    anchors = blocks.mapInArrow(_send_anchors(*own), _ROW).repartitionById(buckets, "bucket")
    shared = cut(anchors.mapInArrow(_shared_anchors(HOT_BLOCKS), _ROW))
    hits = _told(blocks, shared)
    segments = hits.mapInArrow(_send_segments(*own), _ROW).repartitionById(buckets, "bucket")
    judged = cut(segments.mapInArrow(_judge_segments(least), _ROW))
    final = judged.groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias("judged"))
    return hits.join(final.hint("shuffle_hash"), "block", "left").mapInArrow(_cut_blocks(*own, finish), schema)


def repeated_bytes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST) -> DataFrame:
    """Each document with ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept_sha256`` of its remaining bytes.

    Null and empty texts have no bytes; rows that share an id (repeated rows)
    do not remove each other's text; a null id counts as larger than any; an
    empty table gives an empty result; other columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    found = _run(rows, 0, 1, least, _digest, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return found.withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", count_col: str | None = None, least: int = LEAST) -> DataFrame:
    """``docs`` with repeated passages cut out of their texts, other columns as they were.

    A document that loses its whole text goes; a cut within a character drops
    the character.  ``count_col`` is set to the characters left.  Ids, nulls and
    empty tables as in :func:`repeated_bytes`.
    """
    names = docs.columns
    at = None if count_col is None else names.index(count_col)
    return _run(docs, names.index(id_col), names.index(text_col), least, _rewrite(names.index(text_col), at), docs.schema)


def op4_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))
