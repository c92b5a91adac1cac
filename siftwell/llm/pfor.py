"""Token-ID files of patched frame-of-reference blocks.

File layout, all little-endian::

    "PFR1", u32 ids in a block
    blocks: u32 minimum, u8 width, u16 exceptions,
            packed offsets from the minimum (64 values to ``width`` 64-bit words),
            u16 positions and u32 offsets of the exceptions
    index:  u64 start of each block; i64 document id and u32 ids of each document
    u64 blocks, u64 documents, u64 ids, u64 start of the index, "PFR1"

A block's width holds the offsets up to a percentile of the block; larger ones
are exceptions.  The last block is filled up with its own minimum.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm._common import cut, give_back, new_path, pick, table, text_steps
from siftwell.llm._files import write_file
from siftwell.llm._tokens import encoder

MAGIC = b"PFR1"
BLOCK = 1024
PERCENTILE = 0.9
#: Ids in a file, about; a partition with more goes on in a further file.
FILE_IDS = 4_000_000
#: Manifest rows (a name and a number each) that are broadcast at most.
BROADCAST_FILES = 100_000
_HEAD = struct.Struct("<IBH")
_TAIL = struct.Struct("<QQQQ4s")


def pack_bits(values: np.ndarray, width: int) -> np.ndarray:
    """Rows of 64 values to rows of ``width`` 64-bit words."""
    lanes = np.ascontiguousarray(values.T, np.uint64)
    out = np.zeros((width, len(values)), np.uint64)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        out[word] |= lanes[j] << np.uint64(bit)
        if bit + width > 64:
            out[word + 1] |= lanes[j] >> np.uint64(64 - bit)
    return np.ascontiguousarray(out.T)


def unpack_bits(words: np.ndarray, width: int) -> np.ndarray:
    lanes = np.ascontiguousarray(words.T)
    mask = np.uint64((1 << width) - 1)
    out = np.empty((64, len(words)), np.uint64)
    for j in range(64):
        word, bit = divmod(j * width, 64)
        value = lanes[word] >> np.uint64(bit)
        if bit + width > 64:
            value = value | lanes[word + 1] << np.uint64(64 - bit)
        out[j] = value & mask
    return np.ascontiguousarray(out.T)


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """One byte string for each block of a multiple of BLOCK ids."""
    rows = ids.reshape(-1, BLOCK)
    low = rows.min(axis=1)
    offsets = rows - low[:, None]
    k = int(np.ceil(PERCENTILE * BLOCK)) - 1
    edge = np.partition(offsets, k, axis=1)[:, k]
    widths = np.zeros(len(rows), np.uint8)
    for bit in range(32):
        widths[(edge >> np.uint32(bit)) > 0] = bit + 1
    out: list[bytes] = [b""] * len(rows)
    for width in np.unique(widths).tolist():
        at = np.flatnonzero(widths == width)
        part = offsets[at].astype(np.uint64)
        large = (part >> np.uint64(width)) > 0
        packed = pack_bits((part & np.uint64((1 << width) - 1)).reshape(-1, 64), width).reshape(len(at), -1).astype("<u8") if width else np.zeros((len(at), 0), "<u8")
        for i, block in enumerate(at.tolist()):
            where = np.flatnonzero(large[i])
            head = _HEAD.pack(int(low[block]), width, len(where))
            out[block] = b"".join([head, packed[i].tobytes(), where.astype("<u2").tobytes(), offsets[block, where].astype("<u4").tobytes()])
    return out


class PforWriter:
    """One file, built in memory from documents in their order."""

    def __init__(self):
        self.parts, self.at, self.starts = [MAGIC + struct.pack("<I", BLOCK)], 8, []
        self.docs, self.sizes, self.rest, self.n = [], [], np.zeros(0, np.uint32), 0

    def _blocks(self, ids: np.ndarray) -> None:
        for block in encode_blocks(ids):
            self.starts.append(self.at)
            self.parts.append(block)
            self.at += len(block)

    def add(self, docs: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(np.asarray(docs, "<i8"))
        self.sizes.append(np.asarray(sizes, "<u4"))
        self.n += len(ids)
        ids = np.concatenate([self.rest, ids])
        whole = len(ids) // BLOCK * BLOCK
        if whole:
            self._blocks(ids[:whole])
        self.rest = ids[whole:]

    def close(self) -> bytes:
        if len(self.rest):
            self._blocks(np.concatenate([self.rest, np.full(BLOCK - len(self.rest), self.rest.min(), np.uint32)]))
        docs, sizes = np.concatenate(self.docs or [np.zeros(0, "<i8")]), np.concatenate(self.sizes or [np.zeros(0, "<u4")])
        tail = _TAIL.pack(len(self.starts), len(docs), self.n, self.at, MAGIC)
        return b"".join([*self.parts, np.array(self.starts, "<u8").tobytes(), docs.tobytes(), sizes.tobytes(), tail])


class PforFile:
    """Reads ids of any range of a file through its block index."""

    def __init__(self, content: bytes):
        if content[:4] != MAGIC or content[-4:] != MAGIC:
            raise ValueError("not a PFR1 file")
        self.raw = np.frombuffer(content, np.uint8)
        blocks, docs, self.n, at, _ = _TAIL.unpack(content[-_TAIL.size :])
        self.starts = np.frombuffer(content, "<u8", blocks, at).astype(np.int64)
        self.docs = np.frombuffer(content, "<i8", docs, at + 8 * blocks)
        self.sizes = np.frombuffer(content, "<u4", docs, at + 8 * blocks + 8 * docs)
        self.offsets = np.r_[0, np.cumsum(self.sizes, dtype=np.int64)]

    def _field(self, at: np.ndarray, kind: str) -> np.ndarray:
        size = np.dtype(kind).itemsize
        return self.raw[at[:, None] + np.arange(size)].reshape(-1).view(kind)

    def blocks(self, first: int, last: int) -> np.ndarray:
        at = self.starts[first:last]
        low, widths, n = self._field(at, "<u4"), self.raw[at + 4], self._field(at + 5, "<u2").astype(np.int64)
        out = np.zeros((len(at), BLOCK), np.uint32)
        for width in np.unique(widths).tolist():
            rows = np.flatnonzero(widths == width)
            if width:
                size = BLOCK * width // 8
                words = self.raw[(at[rows] + 7)[:, None] + np.arange(size)].view("<u8").reshape(-1, width)
                out[rows] = unpack_bits(words, width).reshape(len(rows), BLOCK)
        if n.any():
            body = at + 7 + BLOCK * widths.astype(np.int64) // 8
            of, k = np.repeat(np.arange(len(at)), n), np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            place = self._field(body[of] + 2 * k, "<u2")
            out[of, place] = self._field(body[of] + 2 * n[of] + 4 * k, "<u4")
        return (out + low[:, None]).reshape(-1)

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids ``start`` to ``stop`` of the file; only their blocks are decoded."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first = start // BLOCK
        return self.blocks(first, (stop - 1) // BLOCK + 1)[start - first * BLOCK : stop - first * BLOCK]

    def documents(self, step: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document, start in the file, ids) in order, decoding about ``step`` ids at a time."""
        k = 0
        while k < len(self.docs):
            to = max(k + 1, int(np.searchsorted(self.offsets, self.offsets[k] + step, "right")) - 1)
            base = int(self.offsets[k])
            ids = self.ids(base, int(self.offsets[to]))
            for d in range(k, to):
                yield int(self.docs[d]), int(self.offsets[d]), ids[self.offsets[d] - base : self.offsets[d + 1] - base]
            k = to


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text",
    file_ids: int = FILE_IDS,
) -> DataFrame:
    """Tokenises whole texts and writes their ids, each with ``end_id`` after it, in ascending id order.

    Returns the manifest: ``file``, ``part`` (order of the files), ``n_docs``,
    ``n_ids`` and ``base`` (ids in all files before).  Documents are ranged over
    the partitions by their id; each partition writes files of about ``file_ids``
    ids.  A null text is empty, rows with a null id come first as id -1, equal
    ids stay as separate documents, an empty table gives no file.
    """
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = pick(docs, id=id_col, text=text_col).select(F.coalesce(F.col("id").cast("long"), F.lit(-1)).alias("id"), "text")
    ranged = rows.repartitionByRange(n, "id").sortWithinPartitions("id")

    def work(batches):
        known, number, part, writer = encoder(tokenizer), TaskContext.get().partitionId(), 0, PforWriter()

        def closed():
            name = f"tokens-{number:06d}-{part:04d}.pfr"
            write_file(f"{path}/{name}", writer.close())
            return pa.RecordBatch.from_pydict(
                {"file": [name], "part": [number * 10_000 + part], "n_docs": [sum(map(len, writer.docs))], "n_ids": [writer.n]},
            )

        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(1)):
                ids, at = known.encode(data, offsets)
                ids = np.insert(ids, at[1:], np.uint32(end_id))
                at = at + np.arange(len(at))
                writer.add(batch.column(0)[a:b].to_numpy(), np.diff(at), ids)
                if writer.n >= file_ids:
                    yield closed()
                    part, writer = part + 1, PforWriter()
                    give_back()
        if writer.docs:
            yield closed()
        del writer
        give_back()

    written = cut(ranged.mapInArrow(work, "file string, part long, n_docs long, n_ids long"))
    base, files = 0, []
    for row in written.orderBy("part").toLocalIterator():  # one row a file
        files.append((row.file, row.part, row.n_docs, row.n_ids, base))
        base += row.n_ids
    return spark.createDataFrame(files, "file string, part long, n_docs long, n_ids long, base long")


def read_token_files(spark: SparkSession, path: str, manifest: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32`` and, if asked, ``ids``."""
    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not manifest.head(1):
        return spark.createDataFrame([], shape)
    content = spark.read.format("binaryFile").load(path).where(F.col("path").endswith(".pfr"))
    bases = manifest.select("file", "base")
    if manifest.limit(BROADCAST_FILES + 1).count() <= BROADCAST_FILES:  # else the files are shuffled to their bases
        bases = F.broadcast(bases)
    files = content.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").join(bases, "file")

    def work(batches):
        for batch in batches:
            for base, content in zip(batch.column("base").to_pylist(), batch.column("content")):
                rows = []
                for doc, start, ids in PforFile(content.as_py()).documents():
                    rows.append((doc, base + start, len(ids), zlib.crc32(ids.astype("<u4", copy=False)), *([ids] if with_ids else [])))
                    if len(rows) == 5000:
                        yield _batch(rows, with_ids)
                        rows = []
                if rows:
                    yield _batch(rows, with_ids)
                del rows
                give_back()

    return files.select("base", "content").mapInArrow(work, shape)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
    arrays = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
    if with_ids:
        names, arrays = [*names, "ids"], [*arrays, pa.array([r[4] for r in rows], pa.list_(pa.int64()))]
    return pa.RecordBatch.from_arrays(arrays, names)


def op6_token_files(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = new_path(spark, "tokens")
    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    manifest = write_token_files(table(spark, sf_dir, "documents"), path, tokenizer, end_id=1)
    return read_token_files(spark, path, manifest)
