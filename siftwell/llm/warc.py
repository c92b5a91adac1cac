"""WARC archives: a writer with revisit records, and a reader that salvages damaged files."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm._common import cut, new_path, pick, table
from siftwell.llm._files import write_file

#: Payloads of fewer bytes are always stored, not referred to.
LEAST_SHARED = 100
#: Bytes of an archive file, about.
FILE_BYTES = 16_000_000
#: A record that claims more is quarantined: it would be longer than any value that Spark has.
RECORD_BYTES = (1 << 31) - 1
#: Bytes that a member is unpacked to at once; a larger one is unpacked and read piece by piece, with the same result.
MEMBER_BYTES = 64_000_000
#: Bytes of a record's headers.
HEADER_BYTES = 1_000_000
_GZIP = b"\x1f\x8b\x08"
_CUT_SHORT = "truncated member"
_VERSION = re.compile(rb"WARC/1\.[01]\r?\n")
_DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page, url: str | None, payload: bytes, refers_to=None) -> bytes:
    """One record as a gzip member.  A revisit has the HTTP head, with the payload's length, but no payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head + payload if refers_to is None else head
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page}>", f"WARC-Date: {_DATE}"]
    if url:
        lines.append("WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    lines += [
        f"WARC-Payload-Digest: sha256:{hashlib.sha256(payload).hexdigest()}", f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


@dataclass
class Record:
    start: int
    stop: int
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]

    @property
    def http_length(self) -> int:
        found = re.search(rb"(?im)^content-length:\s*(\d+)", self.block.partition(b"\r\n\r\n")[0])
        return int(found[1]) if found else len(self.payload)


@dataclass
class Gap:
    start: int
    stop: int
    reason: str


class _Large(Exception):
    """A member that is not unpacked at once."""


def _pieces(content: memoryview, at: int) -> Iterator[tuple[bytes, int]]:
    """What a whole gzip member unpacks to, piece by piece, with the position reached; zlib checks its CRC and length."""
    unpack, k = zlib.decompressobj(31), at
    while not unpack.eof:
        if k >= len(content):
            raise ValueError(_CUT_SHORT)
        piece = content[k : k + 65536]
        k += len(piece)
        yield unpack.decompress(piece), k - len(unpack.unused_data)


def _member(content: memoryview, at: int) -> tuple[bytes, int]:
    """A whole gzip member of at most MEMBER_BYTES and the position after it."""
    out, size, stop = [], 0, at
    for piece, stop in _pieces(content, at):
        out.append(piece)
        size += len(piece)
        if size > MEMBER_BYTES:
            raise _Large
    return b"".join(out), stop


def _prefix(content: memoryview, at: int) -> Iterator[bytes]:
    """What a broken member unpacks to before it breaks."""
    unpack, k, step = zlib.decompressobj(31), at, 65536
    while k < len(content) and not unpack.eof:
        before = unpack.copy() if step > 1 else None
        try:
            yield unpack.decompress(content[k : k + step])
        except zlib.error:
            if before is None:
                break
            unpack, step = before, 1  # byte by byte up to the damage
            continue
        k += step


class _Window:
    """Unpacked bytes of which only those from the present record on are held."""

    def __init__(self, pieces: Iterator[bytes]):
        self.pieces, self.held, self.base, self.ended = pieces, bytearray(), 0, False

    def fill(self, k: int, size: int) -> None:
        """Holds ``size`` bytes from position ``k`` of the held ones on, if there are so many."""
        while not self.ended and len(self.held) - k < size:
            piece = next(self.pieces, None)
            if piece is None:
                self.ended = True
            else:
                self.held += piece

    def fill_record(self, k: int) -> None:
        """Holds the record at ``k``, or as much as tells that there is none."""
        self.fill(k, 16)
        if not _VERSION.match(self.held, k):
            return
        end = self.held.find(b"\r\n\r\n", k)
        while end < 0 and not self.ended and len(self.held) - k < HEADER_BYTES:
            self.fill(k, len(self.held) - k + 65536)
            end = self.held.find(b"\r\n\r\n", k)
        length = re.search(rb"(?im)^content-length[ \t]*:[ \t]*(\d+)[ \t]*\r?$", self.held[k : end + 2]) if end >= 0 else None
        if length and int(length[1]) <= RECORD_BYTES:
            self.fill(k, end - k + int(length[1]) + 8)

    def find(self, mark: bytes, k: int) -> int:
        """The next position of ``mark`` from ``k`` on, or the end; what lies before it is let go."""
        while True:
            at = self.held.find(mark, k)
            if at >= 0 or self.ended:
                return at if at >= 0 else len(self.held)
            k = self.drop(max(k, len(self.held) - len(mark)))
            self.fill(k, 65536)

    def drop(self, k: int) -> int:
        """Lets go of the bytes before ``k``, which is then at the position returned."""
        if k < 65536 and not self.ended:
            return k
        del self.held[:k]
        self.base += k
        return 0


def _inside(pieces: Iterator[bytes], at: int, stop: int, broken: str | None) -> Iterator[Record | Gap]:
    """Records in a member's bytes and the gaps between them, from the first to the last record that passes; no other gaps before there is one.

    Of a ``broken`` member only records with a digest that agrees are kept, but
    of one that is merely cut short all that are whole.
    """
    window, k, bad, reason, some = _Window(pieces), 0, None, "", False
    while True:
        window.fill_record(k)
        if k >= len(window.held):
            break
        try:
            headers, block, after = _parse(window.held, k)
            if broken not in (None, _CUT_SHORT) and not headers.get("warc-block-digest", "").lower().startswith("sha256:"):
                raise ValueError("no digest in a broken member")
        except ValueError as error:
            if bad is None:
                bad, reason = window.base + k, str(error)
            k = window.find(b"WARC/1.", k + 1)
            continue
        if bad is not None:
            yield Gap(at, stop, f"{reason}: unpacked bytes {bad} to {window.base + k}")
            bad = None
        yield Record(at, stop, headers, block)
        some, k = True, window.drop(after)
    if bad is not None and some:
        yield Gap(at, stop, f"{reason}: unpacked bytes {bad} to {window.base + len(window.held)}")


def _parse(raw, at: int) -> tuple[dict[str, str], bytes, int]:
    """Headers and block of the record at a position of plain bytes, and the position after it, checks included."""
    version = _VERSION.match(raw, at)
    if not version:
        raise ValueError("no version line")
    end = raw.find(b"\r\n\r\n", version.end() - 2)
    if end < 0:
        raise ValueError("headers without an end")
    headers = {}
    for line in raw[version.end() : end].decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError("bad header line")
        headers[name.strip().lower()] = value.strip()
    length = headers.get("content-length", "")
    if not length.isdigit() or int(length) > RECORD_BYTES:
        raise ValueError("bad length")
    stop = end + 4 + int(length)
    if raw[stop : stop + 4] != b"\r\n\r\n":
        raise ValueError("record does not end where its length says")
    block = bytes(raw[end + 4 : stop])
    digest = headers.get("warc-block-digest", "").lower()
    if digest.startswith("sha256:") and digest[7:] != hashlib.sha256(block).hexdigest():
        raise ValueError("block digest differs")
    return headers, block, stop + 4


def _whole_member(view: memoryview, at: int) -> tuple[Iterator[Record | Gap], int]:
    """Records and gaps of the gzip member at a position, which holds a record at least, and the position after it."""
    try:
        raw, stop = _member(view, at)
        found = list(_inside(iter((raw,)), at, stop, None))
        if raw and not any(isinstance(x, Record) for x in found):
            _parse(raw, 0)
            raise ValueError("no record in the member")
        return iter(found), stop
    except _Large:
        stop = at
    for _, stop in _pieces(view, at):  # checked as a whole before any of its records counts
        pass
    pieces = lambda: (piece for piece, _ in _pieces(view, at))
    if not any(isinstance(x, Record) for x in _inside(pieces(), at, stop, None)):
        window = _Window(pieces())
        window.fill_record(0)
        _parse(window.held, 0)
        raise ValueError("no record in the member")
    return _inside(pieces(), at, stop, None), stop


def salvage(content: bytes) -> Iterator[Record | Gap]:
    """All records that pass their checks, in order, and the byte ranges between them.

    After a failed check the reader looks for the next place at which a whole
    record stands: a gzip member that unpacks, or a version line.  Within the
    bytes that a member unpacks to it looks for version lines too, and gaps there
    name their range of unpacked bytes.  Of a member that breaks the records
    before the damage are kept; their range, and that of its gap, end where the
    next whole record begins.  However much a member unpacks to, one record of
    it is held at a time.
    """
    view, at, bad, reason, saved = memoryview(content), 0, None, "", None

    def kept(place: int, why: str, stop: int) -> Iterator[Record]:
        return (x for x in _inside(_prefix(view, place), place, stop, why) if isinstance(x, Record))

    while at < len(content):
        member = content[at : at + 3] == _GZIP
        try:
            if member:
                found, stop = _whole_member(view, at)
            else:
                headers, block, stop = _parse(content, at)
                found = iter((Record(at, stop, headers, block),))
        except (ValueError, zlib.error) as error:
            if member and not _unpacks(view, at) and next(kept(at, str(error), at), None) is not None:
                if bad is not None:
                    if saved:
                        yield from kept(*saved, at)
                    yield Gap(bad, at, reason)
                bad, reason, saved = at, str(error), (at, str(error))
            elif bad is None:
                bad, reason = at, str(error)
            places = [p for p in (content.find(_GZIP, at + 1), content.find(b"WARC/1.", at + 1)) if p >= 0]
            at = min(places, default=len(content))
            continue
        if bad is not None:
            if saved:
                yield from kept(*saved, at)
            yield Gap(bad, at, reason)
            bad, saved = None, None
        yield from found
        at = stop
    if bad is not None:
        if saved:
            yield from kept(*saved, len(content))
        yield Gap(bad, len(content), reason)


def _unpacks(view: memoryview, at: int) -> bool:
    """Whether the member at a position is whole."""
    try:
        for _ in _pieces(view, at):
            pass
    except (ValueError, zlib.error):
        return False
    return True


def _with_references(pages: DataFrame) -> DataFrame:
    """Pages with ``refers_to``: of equal payloads, if not small, the smallest page (null for that page itself)."""
    payload = F.coalesce("html", F.lit(""))
    rows = pages.withColumn("digest", F.unhex(F.sha2(payload, 256)))
    keys = rows.where(F.octet_length(payload) >= LEAST_SHARED).select("page", "digest")
    first = keys.groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("n")).where("n > 1")
    named = keys.join(first, "digest").where("page != first").select(F.col("page").alias("again"), F.col("digest").alias("same"), "first").distinct()
    return rows.join(named, (F.col("page") == F.col("again")) & (F.col("digest") == F.col("same")), "left").select("page", "url", "html", F.col("first").alias("refers_to"))


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Writes a record per page to gzip archives under ``path``; returns ``file``, ``n_records``, ``n_bytes``.

    Of equal payloads of at least LEAST_SHARED bytes the smallest page is a
    response and the others are revisits of it.  A null payload is empty; a null
    id is kept as such and takes no part in this; repeated rows are responses
    or revisits alike; an empty table gives no file; other columns are ignored.
    """
    rows = _with_references(pick(pages, page=id_col, url=url_col, html=html_col).withColumn("page", F.col("page").cast("long")))

    def work(batches):
        number, part, held, size = TaskContext.get().partitionId(), 0, [], 0

        def closed():
            name = f"part-{number:06d}-{part:04d}.warc.gz"
            write_file(f"{path}/{name}", b"".join(held))
            return pa.RecordBatch.from_pydict({"file": [name], "n_records": [len(held)], "n_bytes": [size]})

        for batch in batches:
            page, url, body, refers = batch.columns
            for k in range(batch.num_rows):
                held.append(record(page[k].as_py(), url[k].as_py(), (body[k].as_py() or "").encode(), refers[k].as_py()))
                size += len(held[-1])
                if size >= file_bytes:
                    yield closed()
                    part, held, size = part + 1, [], 0
        if held:
            yield closed()

    return cut(rows.mapInArrow(work, "file string, n_records long, n_bytes long"))


_FOUND = (
    "file string, start long, stop long, kind string, page_id long, url string, record_type string, refers_to long, "
    "payload_bytes long, payload_digest string, payload_ok boolean, payload binary, reason string"
)
_NAMES = [x.split()[0] for x in _FOUND.split(", ")]


def _number(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def _row(file: str, x: Record | Gap, with_payload: bool) -> tuple:
    if isinstance(x, Gap):
        return (file, x.start, x.stop, "gap", *[None] * 8, x.reason)
    kind, digest = x.headers.get("warc-type"), x.headers.get("warc-payload-digest", "").lower().removeprefix("sha256:")
    payload = None if kind == "revisit" else x.payload
    size = x.http_length if payload is None else len(payload)
    own = hashlib.sha256(payload).hexdigest() if payload is not None else digest
    return (file, x.start, x.stop, "record", _number(x.headers.get("warc-record-id")), x.headers.get("warc-target-uri"), kind,
            _number(x.headers.get("warc-refers-to")), size, own, own == digest, payload if with_payload else None, None)


def read_archives(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """Records (``kind`` record) and quarantined byte ranges (``kind`` gap, with ``reason``) of all archives under ``path``."""

    def work(batches):
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_(), pa.binary(), pa.string()]

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kinds[k]) for k in range(len(kinds))], _NAMES)

        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                for x in salvage(content.as_py()):
                    rows.append(_row(file, x, with_payload))
                    size += len(x.block) if isinstance(x, Record) and with_payload else 200
                    if size > 4_000_000:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(work, _FOUND)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    written = write_archives(table(spark, sf_dir, "pages"), path)
    if not written.head(1):
        return spark.createDataFrame([], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    return read_archives(spark, path, with_payload=False).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP1_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
k AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first FROM k GROUP BY digest)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, k.digest AS payload_digest,
       CASE WHEN n >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 100 AND page_id <> first THEN first END AS refers_to
FROM k JOIN f ON k.digest = f.digest
"""
