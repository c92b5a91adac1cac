"""Removal of repeated word windows behind a count-min prefilter.

Texts are put into blocks, which are dealt to partitions once and kept there.

1.  Every window of ``size`` words has an anchor, the least hash of the shorter
    grams within it.  A block counts its anchors in a count-min sketch: two rows
    of cells for each bucket of anchors.  Buckets merge the blocks' sketches and
    tell each block which of its cells count two or more.  All occurrences of a
    window have an occurrence of its anchor each, in another place, so the
    lesser of its two cells never falls below the window's count: the estimate
    errs upwards only, and no repeated window is lost.
2.  Only windows that are estimated repeated go on.  Blocks send the different
    ones among them, by a 95-bit hash, to buckets of windows, which group them
    exactly and tell each block which ones repeat.
3.  Each block removes the words that repeated windows cover.

A block and a bucket both hold about the root of the input times a constant, so
a message goes for every MESSAGE_BYTES of text, until blocks reach MOST_BYTES.
However often a window or anchor occurs, a block sends it once.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._common import _INVERSE, _POWERS, byte_class, cut, cut_dealt, give_back, mix, pick, raw_text, span_hashes, steps, table, word_spans

#: Words of a window, and of a gram whose hash can be its anchor.
SIZE, GRAM = 35, 18
#: Text bytes for which one message goes, and bounds of the text bytes of a block and of a bucket.
MESSAGE_BYTES, LEAST_BYTES, MOST_BYTES = 65_536, 1_000_000, 128_000_000
#: Text bytes that are hashed at a time (one text at least).
SLICE_BYTES = 1_000_000
#: Text bytes for each cell of a sketch's row: about a tenth of all words are anchors.
BYTES_PER_CELL = 16
_LOW = np.uint64((1 << 47) - 1)
_SECOND = np.uint64(0xA0761D6478BD642F)
_SPACE = ((0x20, 0x20), (0x09, 0x0D))
WORD = ~byte_class(*_SPACE)

_MESSAGE = "bucket int, block long, body binary"


def block_bytes(total: int) -> int:
    """Text bytes of a block and of a bucket for ``total`` bytes of text."""
    return min(MOST_BYTES, max(LEAST_BYTES, int(math.sqrt(total * MESSAGE_BYTES))))


def _squeeze(raw: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(raw)


def _stretch(raw: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(raw)


def _six(values: np.ndarray) -> bytes:
    """The lower 48 bits of each number."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").reshape(-1)


# ---- windows and anchors of a block


class _Sums:
    """Hashes of runs of numbers, by their content, for runs of any length."""

    def __init__(self, numbers: np.ndarray):
        n = len(numbers)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(numbers * _POWERS.upto(n)[:n], out=self.sums[1:])
        self.inverse = _INVERSE.upto(n)

    def runs(self, size: int) -> np.ndarray:
        """The hash of every run of ``size`` numbers."""
        h = self.sums[size:] - self.sums[:-size]
        h *= self.inverse[: len(h)]
        return mix(h)


def anchor_places(words: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window of ``size`` words where its anchor stands (the first least gram), and the hashes of all grams."""
    grams = _Sums(words).runs(gram)
    n = len(words) - size + 1
    low, at = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, size - gram + 1):
        less = grams[k : k + n] < low
        low[less] = grams[k : k + n][less]
        at[less] = k
    return at + np.arange(n), grams


class Block:
    """A block's words and its runs of windows with a common anchor."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, size: int):
        self.data, self.offsets, self.size = data, offsets, size
        self.slices: list[tuple[int, int, int, int]] = []  # rows and words
        hashes, rows, runs, done = [], [], [], 0
        gram = max(1, min(GRAM, size // 2 + 1))
        for a, b, starts, ends, of in self._words():
            n = len(starts)
            self.slices.append((a, b, done, done + n))
            part = self.data[offsets[a] : offsets[b]]
            own = span_hashes(part, starts, ends) if n else np.zeros(0, np.uint64)
            hashes.append(own)
            rows.append((of + a).astype(np.int32))
            if n >= size:
                place, grams = anchor_places(own, size, gram)
                whole = of[: len(place)] == of[size - 1 :]
                new = whole.copy()
                new[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
                first = np.flatnonzero(new)
                stops = np.flatnonzero(whole & np.r_[new[1:] | ~whole[1:], True]) + 1
                runs.append((first + done, stops - first, mix(grams[place[first]] ^ _SECOND)))
            done += n
        self.hashes = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.rows = np.concatenate(rows) if rows else np.zeros(0, np.int32)
        runs = runs or [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64))]
        self.first, self.count, self.anchor = (np.concatenate(x) for x in zip(*runs))

    def _words(self) -> Iterator[tuple]:
        for a, b in steps(self.offsets, SLICE_BYTES):
            begin = self.offsets[a]
            yield a, b, *word_spans(self.data[begin : self.offsets[b]], self.offsets[a : b + 1] - begin, WORD)

    def cells(self, buckets: int, width: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """For both rows of the sketch the different cells (bucket * width + cell), whether they count twice here, and each run's."""
        bucket = (self.anchor >> np.uint64(47)).astype(np.int64) % buckets * width
        out = []
        for row in range(2):
            h = self.anchor & _LOW if row == 0 else mix(self.anchor + _SECOND) >> np.uint64(17)
            cell, of, n = np.unique(bucket + (h % np.uint64(width)).astype(np.int64), return_inverse=True, return_counts=True)
            out.append((cell, n > 1, of))
        return out

    def windows(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First words, and two hashes, of the windows of the wanted runs."""
        firsts, one, two = [], [], []
        for _, _, lo, hi in self.slices:
            here = wanted[np.searchsorted(self.first[wanted], lo) : np.searchsorted(self.first[wanted], hi)]
            if not len(here):
                continue
            n = self.count[here]
            first = np.repeat(self.first[here], n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            words = self.hashes[lo:hi]
            firsts.append(first)
            one.append(_Sums(words).runs(self.size)[first - lo])
            two.append(_Sums(mix(words ^ _SECOND)).runs(self.size)[first - lo])
        if not firsts:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return np.concatenate(firsts), np.concatenate(one), np.concatenate(two)


class Candidates:
    """A block's windows that are estimated repeated: the different ones in order of bucket and hash."""

    def __init__(self, block: Block, heavy: np.ndarray, buckets: int):
        self.first, one, two = block.windows(np.flatnonzero(heavy))
        bucket = (one >> np.uint64(47)).astype(np.int64) % buckets
        one, two = one & _LOW, two & np.uint64((1 << 48) - 1)
        order = np.lexsort((two, one, bucket))
        bucket, one, two = bucket[order], one[order], two[order]
        new = np.r_[True, (bucket[1:] != bucket[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])] if len(order) else np.zeros(0, bool)
        at = np.flatnonzero(new)
        self.of = np.empty(len(order), np.int64)
        self.of[order] = np.cumsum(new) - 1
        self.twice = np.diff(np.r_[at, len(order)]) > 1
        self.one, self.two = one[at], two[at]
        self.edge = np.searchsorted(bucket[at], np.arange(buckets + 1))


# ---- blocks and messages


def _blocks(docs: DataFrame, text_at: int, parts: int, size: int) -> DataFrame:
    """Rows put together as compressed Arrow streams of about ``size`` text bytes, dealt out by block number and written once."""

    def work(batches):
        number, held, filled = TaskContext.get().partitionId() << 32, [], 0

        def block():
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, held[0].schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                for part in held:
                    out.write_batch(part)
            return pa.RecordBatch.from_pydict({"block": [number], "body": [sink.getvalue().to_pybytes()]})

        for batch in batches:
            _, offsets = raw_text(batch.column(text_at))
            first = 0
            while first < batch.num_rows:
                last = int(np.searchsorted(offsets, offsets[first] + size - filled, "right")) - 1
                last = min(batch.num_rows, max(first + (not held), last))
                if last > first:
                    held.append(batch.slice(first, last - first))
                    filled += int(offsets[last] - offsets[first])
                if last < batch.num_rows:
                    yield block()
                    number, held, filled = number + 1, [], 0
                first = last
        if held:
            yield block()
        del held
        give_back()

    return cut_dealt(docs.mapInArrow(work, "block long, body binary").repartition(parts, "block"))


def _told(blocks: DataFrame, answers: DataFrame, name: str) -> DataFrame:
    """Blocks with what the buckets answer them; the blocks stay where they are."""
    gathered = answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "body")).alias(name))
    return blocks.join(gathered.hint("shuffle_hash"), "block", "left")


def _opened(batches, text_at: int, size: int) -> Iterator[tuple]:
    """Each block's number, rows, words, and what it was told, by bucket."""
    for batch in batches:
        said = batch.schema.names[2:]
        for k in range(batch.num_rows):
            rows = pa.ipc.open_stream(batch.column(1)[k].as_py()).read_all().combine_chunks()
            told = [{x["bucket"]: x["body"] for x in batch.column(name)[k].as_py() or []} for name in said]
            yield batch.column(0)[k].as_py(), rows, Block(*raw_text(rows.column(text_at)), size), *told
            del rows, told
            give_back()


def _messages(number: int, bodies: dict[int, bytes]) -> pa.RecordBatch:
    n = len(bodies)
    return pa.RecordBatch.from_arrays([pa.array(list(bodies), pa.int32()), pa.array([number] * n, pa.int64()), pa.array(list(bodies.values()), pa.binary())], ["bucket", "block", "body"])


def _by_bucket(batches) -> Iterator[tuple[int, list[int], list[bytes]]]:
    """Bucket, blocks and bodies of each bucket in a partition."""
    found: dict[int, tuple[list, list]] = {}
    for batch in batches:
        for bucket, block, body in zip(*(c.to_pylist() for c in batch.columns)):
            blocks, bodies = found.setdefault(bucket, ([], []))
            blocks.append(block)
            bodies.append(body)
    for bucket in sorted(found):
        yield bucket, *found.pop(bucket)


def _bits(told: dict[int, bytes], edge: np.ndarray) -> np.ndarray:
    """The answers' bits for what a block asked, in its order; a bucket without an answer says no."""
    out = np.zeros(int(edge[-1]), bool)
    for bucket, body in told.items():
        n = int(edge[bucket + 1] - edge[bucket])
        out[edge[bucket] : edge[bucket + 1]] = np.unpackbits(np.frombuffer(_stretch(body), np.uint8), count=n)
    return out


def _asked(cells: list, buckets: int, width: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Bounds of the buckets in both rows of a block's sketch, and in what both rows ask together."""
    edges = [np.searchsorted(cell, np.arange(buckets + 1) * width) for cell, _, _ in cells]
    return edges, edges[0] + edges[1]


def _estimated(block: Block, told: dict[int, bytes], buckets: int, width: int) -> np.ndarray:
    """Whether both cells of each run's anchor count two or more."""
    cells = block.cells(buckets, width)
    edges, both = _asked(cells, buckets, width)
    heavy = _bits(told, both)
    out = np.ones(len(block.anchor), bool)
    for row, (_, _, of) in enumerate(cells):
        k = np.arange(len(cells[row][0]))
        bucket = np.searchsorted(edges[row], k, "right") - 1
        before = np.zeros(buckets, np.int64) if row == 0 else np.diff(edges[0])  # a bucket's first row comes first
        own = heavy[both[bucket] + before[bucket] + k - edges[row][bucket]]
        out &= own[of]
    return out


def _send_sketches(text_at: int, size: int, buckets: int, width: int):
    def work(batches):
        for number, _, block in _opened(batches, text_at, size):
            cells = block.cells(buckets, width)
            edges, both = _asked(cells, buckets, width)
            bodies = {}
            for k in np.flatnonzero(np.diff(both)).tolist():
                own = [(cell[e[k] : e[k + 1]] - k * width, twice[e[k] : e[k + 1]]) for (cell, twice, _), e in zip(cells, edges)]
                sizes = np.array([len(x) for x, _ in own], "<u4").tobytes()
                steps_ = [np.diff(x, prepend=0).astype("<u4").tobytes() for x, _ in own]
                bodies[k] = _squeeze(b"".join([sizes, *steps_, np.packbits(np.concatenate([y for _, y in own])).tobytes()]))
            if bodies:
                yield _messages(number, bodies)

    return work


def _merge_sketches(width: int):
    def work(batches):
        for bucket, blocks, bodies in _by_bucket(batches):
            counts, asked = np.zeros(2 * width, np.uint8), []
            for raw in map(_stretch, bodies):
                n, m = np.frombuffer(raw, "<u4", 2).tolist()
                delta = np.frombuffer(raw, "<u4", n + m, 8)
                cell = np.r_[np.cumsum(delta[:n], dtype=np.int64), width + np.cumsum(delta[n:], dtype=np.int64)]
                twice = np.unpackbits(np.frombuffer(raw, np.uint8, offset=8 + 4 * (n + m)), count=n + m)
                counts[cell] = np.minimum(counts[cell] + 1 + twice, 2)
                asked.append(cell)
            yield from _answers(bucket, blocks, [counts[cell] > 1 for cell in asked])
            del counts, asked
            give_back()

    return work


def _answers(bucket: int, blocks: list[int], yes: list[np.ndarray]):
    some = [(b, y) for b, y in zip(blocks, yes) if y.any()]
    if some:
        n = len(some)
        bodies = [_squeeze(np.packbits(y).tobytes()) for _, y in some]
        yield pa.RecordBatch.from_arrays([pa.array([bucket] * n, pa.int32()), pa.array([b for b, _ in some], pa.int64()), pa.array(bodies, pa.binary())], ["bucket", "block", "body"])


def _send_windows(text_at: int, size: int, buckets: int, width: int):
    def work(batches):
        for number, _, block, sketch in _opened(batches, text_at, size):
            found = Candidates(block, _estimated(block, sketch, buckets, width), buckets)
            bodies = {}
            for k in np.flatnonzero(np.diff(found.edge)).tolist():
                part = slice(found.edge[k], found.edge[k + 1])
                bodies[k] = _six(found.one[part] << np.uint64(1) | found.twice[part].astype(np.uint64)) + _six(found.two[part])
            if bodies:
                yield _messages(number, bodies)

    return work


def _group_windows(batches):
    for bucket, blocks, bodies in _by_bucket(batches):
        sizes = np.array([len(b) // 12 for b in bodies])
        one = np.concatenate([_from_six(b[: len(b) // 2]) for b in bodies])
        two = np.concatenate([_from_six(b[len(b) // 2 :]) for b in bodies])
        bodies.clear()
        twice, one = (one & np.uint64(1)).astype(bool), one >> np.uint64(1)
        order = np.lexsort((two, one))
        new = np.r_[True, (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])]
        at = np.flatnonzero(new)
        many = (np.diff(np.r_[at, len(order)]) > 1) | np.logical_or.reduceat(twice[order], at)
        repeated = np.empty(len(order), bool)
        repeated[order] = many[np.cumsum(new) - 1]
        edge = np.r_[0, np.cumsum(sizes)]
        yield from _answers(bucket, blocks, [repeated[a:b] for a, b in zip(edge, edge[1:])])
        del one, two, twice, order, new, repeated
        give_back()


def _remove(text_at: int, size: int, buckets: int, width: int, finish):
    def work(batches):
        for _, rows, block, sketch, judged in _opened(batches, text_at, size):
            covered = np.zeros(len(block.hashes) + 1, np.int32)
            if judged:  # else no window of the block repeats
                found = Candidates(block, _estimated(block, sketch, buckets, width), buckets)
                first = found.first[_bits(judged, found.edge)[found.of]]
                covered[first] += 1
                np.subtract.at(covered, first + size, 1)
            yield from finish(rows, block, np.cumsum(covered[:-1]) > 0)

    return work


# ---- results


def kept_texts(block: Block, gone: np.ndarray) -> Iterator[bytes]:
    """Each row's kept words, joined by one space."""
    for (a, b, lo, hi), (_, _, starts, ends, of) in zip(block.slices, block._words()):
        keep = ~gone[lo:hi]
        starts, ends, of = starts[keep], ends[keep], of[keep]
        sizes = ends - starts + 1
        stop = np.cumsum(sizes)
        if not len(stop):
            yield from [b""] * (b - a)
            continue
        part = np.append(block.data[block.offsets[a] : block.offsets[b]], np.uint8(32))
        text = part[np.repeat(starts - (stop - sizes), sizes) + np.arange(int(stop[-1]))]
        text[stop - 1] = 32
        whole = text.tobytes()
        at = np.r_[0, stop][np.searchsorted(of, np.arange(b - a + 1))].tolist()
        yield from (whole[x : max(x, y - 1)] for x, y in zip(at, at[1:]))


def _digest(rows: pa.Table, block: Block, gone: np.ndarray):
    n = rows.num_rows
    words, removed = np.bincount(block.rows, minlength=n), np.bincount(block.rows[gone], minlength=n)
    kept = [hashlib.sha256(x).hexdigest() for x in kept_texts(block, gone)]
    yield pa.RecordBatch.from_arrays([rows.column(0).combine_chunks(), pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.string())], ["id", "n_words", "n_removed", "kept_sha256"])


def _rewrite(text_at: int):
    def finish(rows: pa.Table, block: Block, gone: np.ndarray):
        hit = np.bincount(block.rows[gone], minlength=rows.num_rows) > 0
        old = rows.column(text_at).to_pylist()
        texts = [new.decode() if h else text for text, new, h in zip(old, kept_texts(block, gone), hit.tolist())]
        out = rows.set_column(text_at, rows.schema.field(text_at), pa.array(texts, rows.schema.field(text_at).type))
        yield from out.filter(pa.array([bool(t) or not h for t, h in zip(texts, hit.tolist())], pa.bool_())).to_batches()

    return finish


def _run(docs: DataFrame, text_at: int, size: int, finish: Callable, schema) -> DataFrame:
    if size < 2:
        raise ValueError("a window has two words or more")
    total = docs.agg(F.sum(F.octet_length(F.col(f"`{docs.columns[text_at]}`")))).head()[0] or 0
    each = block_bytes(total)
    buckets, width = max(1, -(-total // each)), max(64, each // BYTES_PER_CELL)
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), buckets)
    blocks = _blocks(docs, text_at, parts, each)
    own = (text_at, size, buckets, width)
    sketches = blocks.mapInArrow(_send_sketches(*own), _MESSAGE).repartitionById(buckets, "bucket")
    estimated = _told(blocks, cut(sketches.mapInArrow(_merge_sketches(width), _MESSAGE)), "sketch")
    windows = estimated.mapInArrow(_send_windows(*own), _MESSAGE).repartitionById(buckets, "bucket")
    judged = cut(windows.mapInArrow(_group_windows, _MESSAGE))
    return _told(estimated, judged, "judged").mapInArrow(_remove(*own, finish), schema)


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE) -> DataFrame:
    """Each document with ``n_words``, ``n_removed`` and ``kept_sha256`` of its kept words, joined by one space.

    Words are the runs without white space (0x20, 0x09 to 0x0D) of whole texts,
    unchanged.  A word goes if a window of ``size`` words covers it whose words
    also stand, in this order, anywhere else, in the same document or another;
    windows are judged on the input.  Null, empty and blank texts have no words;
    a text of fewer words than a window has none.  Repeated rows repeat each
    other's windows; ids may be null or repeated; an empty table gives an empty
    result; other columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    return _run(rows, 1, size, _digest, "id long, n_words long, n_removed long, kept_sha256 string").withColumnRenamed("id", id_col)


def drop_repeated_windows(docs: DataFrame, text_col: str = "text", size: int = SIZE) -> DataFrame:
    """``docs`` without the words that repeated windows cover, other columns as they were.

    A text that loses words has the others joined by one space; one that loses
    all goes with its row; all other texts stay as they are.
    """
    at = docs.columns.index(text_col)
    return _run(docs, at, size, _rewrite(at), docs.schema)


def op13_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return repeated_windows(table(spark, sf_dir, "documents"))


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, k, array_to_string(w[k + 1 : k + {SIZE}], ' ') AS key FROM (SELECT doc_id, w, unnest(range(greatest(len(w) - {SIZE} + 1, 0))) AS k FROM d)),
r AS (SELECT key FROM x GROUP BY key HAVING count(*) > 1),
g AS (SELECT doc_id, list_sort(list_distinct(flatten(list(range(k, k + {SIZE}))))) AS gone FROM x JOIN r USING (key) GROUP BY doc_id),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
t AS (SELECT doc_id, unnest(gone) + 1 AS i FROM g),
s AS (SELECT p.doc_id, string_agg(word, ' ' ORDER BY p.i) AS kept FROM p LEFT JOIN t ON t.doc_id = p.doc_id AND t.i = p.i WHERE t.i IS NULL GROUP BY p.doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(gone), 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN g USING (doc_id) LEFT JOIN s USING (doc_id)
"""
