"""Alignment of two tokenizers' tokens by a dangling-suffix transducer.

The two token streams of a text are read in turns.  One side leads by the bytes
that the other has not matched yet, a suffix of its last token; the next token
is taken from the side that trails.  Where nothing dangles, a group of tokens
closes.  A transition depends on the leading side, the residual bytes and the
next token alone, and is kept.

Both tokenizers never let a token cross the place before a lone space or line
end, so a text is a sequence of segments, and what is known of a segment holds
for each of its occurrences: the libraries and the transducer see every segment
once for each cache.  A text's groups are its segments' groups.

Two tokens that end together are suffixes of one another, so there are at most
as many linked pairs of ids as both vocabularies have bytes, whatever the size
of the corpus: their counts are broadcast.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._common import cut, give_back, pick, span_hashes, table, text_steps
from siftwell.llm._tokens import WordTable

#: Segments that a worker remembers, their bytes, and transitions of the transducer; a full cache starts again from nothing.
CACHE_SEGMENTS, CACHE_BYTES, CACHE_STEPS = 500_000, 60_000_000, 500_000
_SPACE = "▁"
#: White space beyond ASCII, before or after which no cut is made.
_ODD_SPACES = re.compile(rb"\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81\x9f|\xe2\x96\x81|\xe3\x80\x80|\xef\xbb\xbf")
_BLANK = np.zeros(256, bool)
_BLANK[:33] = _BLANK[127] = True

_ROWS = "ids array<long>, tokens binary, parts binary, fresh binary, pairs binary"


def byte_level() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable ones are themselves, the others follow 255."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Transducer:
    """Reads two token streams and closes groups where both end."""

    def __init__(self, first: list[bytes], second: list[bytes]):
        self.tokens = first, second
        self.clear()

    def clear(self) -> None:
        self.states, self.numbers = [(0, b"")], {(0, b""): 0}  # (side that leads, unmatched bytes); nothing dangles in 0
        self.from_first = [True]  # the side whose token comes next: the trailing one, or the first if nothing dangles
        self.known: dict[int, int] = {}

    def step(self, state: int, token: int) -> int:
        """The state after the next token, and -1 if its bytes differ; kept in ``known`` by state and token."""
        side, residual = self.states[state]
        if not residual:
            after = (0, self.tokens[0][token])
        else:
            new = self.tokens[1 - side][token]
            if len(new) <= len(residual):
                after = (side, residual[len(new) :]) if residual.startswith(new) else None
            else:
                after = (1 - side, new[len(residual) :]) if new.startswith(residual) else None
        to = -1
        if after is not None:
            after = after if after[1] else (0, b"")
            if after not in self.numbers:
                self.numbers[after] = len(self.states)
                self.states.append(after)
                self.from_first.append(after[0] == 1)
            to = self.numbers[after]
        self.known[state << 32 | token] = to
        return to

    def ends(self, first: list[int], second: list[int]) -> list[tuple[int, int]] | None:
        """How many tokens of both sides there are where groups close; None if the streams differ."""
        if len(self.known) > CACHE_STEPS:
            self.clear()
        out, i, j, state, n, m = [], 0, 0, 0, len(first), len(second)
        known, from_first = self.known.get, self.from_first
        while i < n or j < m:
            if from_first[state]:
                if i == n:
                    return None
                token = first[i]
                i += 1
            else:
                if j == m:
                    return None
                token = second[j]
                j += 1
            to = known(state << 32 | token)
            state = self.step(state, token) if to is None else to
            if state == 0:
                out.append((i, j))
            elif state < 0:
                return None
        return out if state == 0 else None

    def groups(self, first: list[int], second: list[int]) -> list[tuple[list[int], list[int]]] | None:
        """Runs of tokens of both sides with the same bytes, as short as can be; None if the streams differ."""
        ends = self.ends(first, second)
        return ends and [(first[a:i], second[b:j]) for (a, b), (i, j) in zip([(0, 0), *ends], ends)]


class Pair:
    """Two tokenizers, the bytes of their tokens, and what is known of segments."""

    def __init__(self, first: str, second: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.one = Tokenizer.from_file(first)
        self.one.encode_special_tokens = True  # their strings in texts are ordinary text
        self.two = sentencepiece.SentencePieceProcessor(model_file=second)
        spec, level = json.loads(self.one.to_str()), byte_level()
        names = [self.one.id_to_token(k) or "" for k in range(self.one.get_vocab_size(with_added_tokens=True))]
        bytes_one = [bytes(level[c] for c in name) if all(c in level for c in name) else name.encode() for name in names]
        pieces = [self.two.id_to_piece(k) for k in range(self.two.get_piece_size())]
        bytes_two = [bytes([int(p[3:-1], 16)]) if self.two.is_byte(k) else p.replace(_SPACE, " ").encode() for k, p in enumerate(pieces)]
        self.transducer = Transducer(bytes_one, bytes_two)
        self.mark = self.two.piece_to_id(_SPACE)
        before = spec.get("pre_tokenizer") or {}
        plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not spec.get("normalizer")
        #: Whether no token of either can cross the place before a lone space or line end.
        self.by_segment = bool(plain and not any(_SPACE in p[1:] and set(p) != {_SPACE} for p in pieces) and not any("\n" in p for p in pieces) and self.mark > 0)
        self.clear()

    def clear(self) -> None:
        self.table, self.n, self.held = WordTable(), 0, 0
        self.text: list[bytes | None] = []  # groups of each segment; None where the bytes differ
        self.sizes = np.zeros((1 << 14, 3), np.int32)  # tokens of both, groups
        self.first, self.links, self.used = np.zeros(1 << 14, np.int64), np.zeros(1 << 16, np.int64), 0

    def _add(self, segments: list[bytes]) -> None:
        texts = [s.decode() for s in segments]
        one = [e.ids for e in self.one.encode_batch_fast(texts, add_special_tokens=False)]
        two = self.two.encode([t[1:] if t[0] == " " else t for t in texts], num_threads=1)
        token_one, ends_of = self.transducer.tokens[0], self.transducer.ends
        sizes, links = [], []
        for raw, a, b in zip(segments, one, two):
            if raw[:1] != b" ":
                b = b[1:] if b and b[0] == self.mark else []  # the space that the library adds
            ends = ends_of(a, b)
            # where both streams have the same bytes, one of them tells whether they are the segment's
            if not ends or (token_one[a[0]] if len(a) == 1 else b"".join([token_one[x] for x in a])) != raw:
                self.text.append(None)
                sizes.append((0, 0, 0))
                continue
            parts, x, y = [], 0, 0
            for i, j in ends:
                if i - x == 1 and j - y == 1:
                    parts.append(f"{a[x]}|{b[y]}")
                else:
                    parts.append(",".join(map(str, a[x:i])) + "|" + ",".join(map(str, b[y:j])))
                links.append(a[i - 1] << 32 | b[j - 1])  # one of each side ends a group
                x, y = i, j
            text = ";".join(parts).encode()
            self.text.append(text)
            self.held += len(text) + 60
            sizes.append((len(a), len(b), len(ends)))
        n, used = self.n + len(sizes), self.used + len(links)
        while n > len(self.first):
            self.first, self.sizes = np.concatenate([self.first, np.zeros_like(self.first)]), np.concatenate([self.sizes, np.zeros_like(self.sizes)])
        while used > len(self.links):
            self.links = np.concatenate([self.links, np.zeros_like(self.links)])
        new = np.array(sizes, np.int32).reshape(-1, 3)
        self.sizes[self.n : n] = new
        self.first[self.n : n] = self.used + np.cumsum(new[:, 2]) - new[:, 2]
        self.links[self.used : used] = links
        self.n, self.used = n, used

    def bounds(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Where the segments of some texts start, each text with a space before it."""
        n, first = len(data), offsets[:-1][np.diff(offsets) > 0]
        begins = np.zeros(n, bool)
        if self.by_segment and n > 2:
            blank = _BLANK[data]
            begins[1:-1] = ((data[1:-1] == 32) | (data[1:-1] == 10)) & ~blank[:-2] & ~blank[2:]
            for m in _ODD_SPACES.finditer(data.tobytes()):
                begins[max(0, m.start() - 1) : m.end() + 1] = False
        begins[first] = True
        return np.flatnonzero(begins)

    def segments(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The number of each segment; all are known afterwards."""
        ends = np.r_[starts[1:], len(data)]
        h = span_hashes(data, starts, ends)
        h[h == 0] = 1
        index = self.table.find(h)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            new, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            a, b = starts[missing[where]].tolist(), ends[missing[where]].tolist()
            whole, first = data.tobytes(), self.n
            self._add([whole[x:y] for x, y in zip(a, b)])
            self.table.add(new, np.arange(first, self.n, dtype=np.int32))
            index[missing] = first + back
        return index

    def full(self) -> bool:
        return self.n > CACHE_SEGMENTS or self.held > CACHE_BYTES


_loaded: dict[tuple[str, str], Pair] = {}


def pair(first: str, second: str) -> Pair:
    if (first, second) not in _loaded:
        _loaded[first, second] = Pair(first, second)
    return _loaded[first, second]


def with_space(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts that are not empty with a space before each."""
    size = np.diff(offsets)
    at = offsets[:-1][size > 0]
    new = np.insert(data, at, np.uint8(32))
    return new, np.r_[0, np.cumsum(size + (size > 0))]


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(raw: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw), kind)


class _Told:
    """The segments of a task, numbered in the order in which their links are told, and how often each is there."""

    def __init__(self, known: Pair):
        self.known = known
        self.clear()
        self.total: dict[str, np.ndarray] = {"pair": np.zeros(0, np.int64), "n": np.zeros(0, np.int64)}

    def clear(self) -> None:
        """The numbers go on after a full cache; only the counts so far are summed up."""
        self.place, self.count = np.full(1 << 14, -1, np.int64), np.zeros(1 << 14, np.int64)

    def number(self, index: np.ndarray, told: int) -> tuple[np.ndarray, np.ndarray]:
        """The task's numbers of segments, which are counted, and those that are new."""
        while len(self.place) < self.known.n:
            self.place, self.count = np.r_[self.place, np.full_like(self.place, -1)], np.r_[self.count, np.zeros_like(self.count)]
        new = np.unique(index[self.place[index] < 0])
        self.place[new] = told + np.arange(len(new))
        self.count += np.bincount(index, minlength=len(self.count))
        return self.place[index], new

    def sum_up(self) -> None:
        known, some = self.known, np.flatnonzero(self.count[: self.known.n])
        size = known.sizes[some, 2].astype(np.int64)
        links = known.links[np.repeat(known.first[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
        every, n = np.r_[self.total["pair"], links], np.r_[self.total["n"], np.repeat(self.count[some], size)]
        keys, of = np.unique(every, return_inverse=True)
        self.total = {"pair": keys, "n": np.bincount(of, n, minlength=len(keys)).astype(np.int64)}  # exact below 2**53
        self.clear()


def _aligned(first: str, second: str, with_groups: bool):
    """Step by step: ids, tokens of both and groups and the digest of each text, the texts' segments by number, and the links of new numbers."""

    def work(batches):
        known = pair(first, second)
        told, numbers = _Told(known), 0
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(1)):
                if known.full():
                    told.sum_up()
                    known.clear()
                data, offsets = with_space(data, offsets)
                rows = b - a
                starts = known.bounds(data, offsets) if len(data) else np.zeros(0, np.int64)
                index = known.segments(data, starts) if len(starts) else np.zeros(0, np.int64)
                of = np.searchsorted(offsets, starts, "right") - 1
                good = np.diff(offsets) > 0
                good[of[known.sizes[index, 2] == 0]] = False  # a text with a segment that one of them does not keep
                kept = good[of]
                index, of = index[kept], of[kept]
                own, new = told.number(index, numbers)
                numbers += len(new)
                tokens = np.stack([np.bincount(of, known.sizes[index, k], minlength=rows) for k in range(3)]).astype("<i8")
                edge = np.searchsorted(of, np.arange(rows + 1)).tolist()
                names, text = index.tolist(), known.text
                joined = [b";".join([text[k] for k in names[x:y]]) for x, y in zip(edge, edge[1:])]
                size = known.sizes[new, 2].astype(np.int64)
                links = known.links[np.repeat(known.first[new] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))]
                arrays = [
                    _one_list(batch.column(0)[a:b]), pa.array([_pack(tokens)], pa.binary()),
                    pa.array([_pack(np.r_[np.diff(edge), own].astype("<u4"))], pa.binary()), pa.array([_pack(np.r_[len(new), size, links].astype("<i8"))], pa.binary()), pa.nulls(1, pa.binary()),
                    _one_list(pa.array([x.decode() if with_groups else hashlib.sha256(x).hexdigest() if x else "" for x in joined], pa.string())),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["ids", "tokens", "parts", "fresh", "pairs", "groups"])
            give_back()
        told.sum_up()
        sums = np.r_[told.total["pair"], told.total["n"]].astype("<i8")
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.list_(pa.int64())), *[pa.nulls(1, pa.binary())] * 3, pa.array([_pack(sums)], pa.binary()), pa.nulls(1, pa.list_(pa.string()))], ["ids", "tokens", "parts", "fresh", "pairs", "groups"])

    return work


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _counts(batches) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for raw in batch.column(0):
            both = _unpack(raw.as_py(), "<i8")
            keys, n = np.split(both, 2)
            yield pa.RecordBatch.from_arrays([pa.array(keys >> 32), pa.array(keys & 0xFFFFFFFF), pa.array(n)], ["a", "b", "n"])


def _sums(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The sum of each run of values."""
    edge = np.r_[0, np.cumsum(sizes)]
    total = np.r_[0, np.cumsum(values)]
    return total[edge[1:]] - total[edge[:-1]]


def _scored(shared):
    """Adds to each text's row how many of its links are the best of their second id, and the sum of its links' counts."""

    def work(batches):
        keys, n, best = shared.value
        told, numbers = np.zeros((2, 1 << 16), np.int64), 0
        for batch in batches:
            for k in range(batch.num_rows):
                fresh = _unpack(batch.column(3)[k].as_py(), "<i8")
                size, links = fresh[1 : 1 + fresh[0]], fresh[1 + fresh[0] :]
                at, to = np.searchsorted(keys, links), numbers + len(size)
                while to > told.shape[1]:
                    told = np.concatenate([told, np.zeros_like(told)], axis=1)
                told[:, numbers:to] = _sums(best[at], size), _sums(n[at], size)
                numbers = to
                ids = batch.column(0)[k].values
                rows = len(ids)
                tokens = _unpack(batch.column(1)[k].as_py(), "<i8").reshape(3, rows)
                parts = _unpack(batch.column(2)[k].as_py(), "<u4").astype(np.int64)
                sums = [_sums(x[parts[rows:]], parts[:rows]) for x in told]
                yield pa.RecordBatch.from_arrays(
                    [ids, *map(pa.array, tokens), pa.array(tokens[2]), *map(pa.array, sums), batch.column(4)[k].values],
                    ["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"],
                )
            give_back()

    return work


def align(docs: DataFrame, first: str, second: str, id_col: str = "doc_id", text_col: str = "text", with_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """Each document's alignment, and the corpus-wide counts ``n`` of linked id pairs ``a``, ``b`` (``best``: the most of its ``b``).

    ``first``: a byte-level tokenizer file, given a space and the text;
    ``second``: a sentence piece model with byte fallback, which adds the space.
    Columns: the id, ``n_a``, ``n_b`` tokens, ``n_groups``, ``n_links`` (token
    pairs that end together), ``n_best`` (links whose pair's count is the highest
    of its second id, ties included), ``count_sum`` (over links) and ``groups``:
    `a1,a2|b1;a3|b2,b3`, or its SHA-256 in lower-case hex.

    Null and empty texts, and texts whose tokens' bytes are not a space and the
    text, have no tokens: zeros and an empty string.  Strings of special tokens
    are plain text.  Repeated rows each count; an empty table gives empty
    results; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    steps = cut(rows.mapInArrow(_aligned(first, second, with_groups), _ROWS + ", groups array<string>"))
    counts = steps.where("pairs is not null").select("pairs").mapInArrow(_counts, "a long, b long, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))
    counts = cut(counts)
    best = counts.groupBy("b").agg(F.max("n").alias("best"))
    counts = counts.join(F.broadcast(best), "b").select("a", "b", "n", "best")  # a row for each id of a vocabulary
    known = counts.toArrow()  # at most as many as the vocabularies have bytes
    a, b, n, most = (known.column(c).to_numpy().astype(np.int64) for c in ("a", "b", "n", "best"))
    order = np.argsort(a << 32 | b)
    shared = spark.sparkContext.broadcast(((a << 32 | b)[order], n[order], (n == most)[order].astype(np.int64)))
    kind = "id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string"
    found = steps.where("pairs is null").select("ids", "tokens", "parts", "fresh", "groups").mapInArrow(_scored(shared), kind)
    return found.withColumnRenamed("id", id_col), counts


def op11_token_alignment(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found, _ = align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return found.withColumnRenamed("groups", "groups_sha256")
