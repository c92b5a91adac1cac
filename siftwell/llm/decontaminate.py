"""Benchmark decontamination by a broadcast hash set of normalised test n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._common import LOWER, byte_class, cut, give_back, mix, pick, span_hashes, stash, table, text_steps, word_spans

#: Word bytes after lower-casing: digits, a to z and every byte of a character beyond ASCII.
WORD = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)
_FILTER_BITS = 20
#: Windows that are broadcast at a time.
MAX_WINDOWS = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), WORD)
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


def _window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(words) - n + 1, np.uint64)
    for k in range(n):
        h = h * _STEP + words[k : k + len(h)]
    return mix(h)


class WindowSet:
    """The windows of a bounded number of items: hashes to find them, and the words to verify by."""

    def __init__(self, items: list[tuple[str, list[bytes]]], n: int):
        self.names, self.text, self.sizes = [name for name, _ in items], b" ".join(w for _, words in items for w in words), {}
        counts = np.array([len(words) for _, words in items], np.int64)
        of = np.repeat(np.arange(len(items)), counts)
        data = np.frombuffer(self.text, np.uint8)
        starts, ends, _ = word_spans(data, np.array([0, len(data)]), WORD)
        hashes = span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)
        for size in sorted({min(n, c) for c in counts.tolist() if c}):
            h = _window_hashes(hashes, size)
            at = np.flatnonzero((of[: len(h)] == of[size - 1 :]) & (np.minimum(counts, n)[of[: len(h)]] == size))
            again = _window_hashes(mix(hashes), size)[at]
            order = np.lexsort((of[at], again, h[at]))
            at, again = at[order], again[order]
            new = np.r_[True, (h[at][1:] != h[at][:-1]) | (again[1:] != again[:-1])]
            first = np.flatnonzero(new)
            owner = of[at]
            kept = new | np.r_[True, owner[1:] != owner[:-1]]  # an item once for each different window
            known = h[at[first]]
            maybe = np.zeros(1 << _FILTER_BITS, bool)
            maybe[known >> np.uint64(64 - _FILTER_BITS)] = True
            edge = np.r_[np.cumsum(kept)[first] - 1, kept.sum()]
            self.sizes[size] = (maybe, known, starts[at[first]], ends[at[first] + size - 1], edge, owner[kept].astype(np.int32))

    def mark(self, data: np.ndarray, starts, ends, of, hashes, edges: np.ndarray, items: list[set[str]]) -> None:
        """Adds the verified windows to ``edges`` (+1 at a window's first word, -1 after its last) and their items' names to the rows' ``items``."""
        for size, (maybe, known, begin, stop, edge, owner) in self.sizes.items():
            if len(starts) < size:
                continue
            h = _window_hashes(hashes, size)
            at = np.flatnonzero(maybe[h >> np.uint64(64 - _FILTER_BITS)] & (of[: len(h)] == of[size - 1 :]))
            near = np.searchsorted(known, h[at])
            found = known[np.minimum(near, len(known) - 1)] == h[at]
            for i, k in zip(at[found].tolist(), near[found].tolist()):
                key = b" ".join(data[starts[j] : ends[j]].tobytes() for j in range(i, i + size))
                while k < len(known) and known[k] == h[i]:
                    if self.text[begin[k] : stop[k]] == key:
                        items[of[i]].update(self.names[x] for x in owner[edge[k] : edge[k + 1]].tolist())
                        edges[i] += 1
                        edges[i + size] -= 1
                        break
                    k += 1


def scan(block: WindowSet, data: np.ndarray, offsets: np.ndarray):
    """Per row: words, item names, and the runs of hit words as (first word, last word, first byte, byte after the last)."""
    rows = len(offsets) - 1
    data = LOWER[data]
    starts, ends, of = word_spans(data, offsets, WORD)
    n_words = np.bincount(of, minlength=rows)
    items: list[set[str]] = [set() for _ in range(rows)]
    runs: list[list[tuple[int, int, int, int]]] = [[] for _ in range(rows)]
    if not len(starts) or not block.sizes:
        return n_words, items, runs
    edges = np.zeros(len(starts) + 1, np.int32)
    block.mark(data, starts, ends, of, span_hashes(data, starts, ends), edges, items)
    at = np.flatnonzero(np.cumsum(edges[:-1]) > 0)
    if len(at):
        first = np.r_[True, (np.diff(at) > 1) | (np.diff(of[at]) > 0)]
        last = np.r_[first[1:], True]
        before = np.cumsum(n_words) - n_words
        for a, b in zip(at[first].tolist(), at[last].tolist()):
            row = int(of[a])
            runs[row].append((int(a - before[row]), int(b - before[row]), int(starts[a] - offsets[row]), int(ends[b] - offsets[row])))
    return n_words, items, runs


def merged(runs: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Maximal runs out of runs that may overlap or touch."""
    out: list[list[int]] = []
    for first, last, start, end in sorted(runs):
        if out and first <= out[-1][1] + 1:
            if last > out[-1][1]:
                out[-1][1], out[-1][3] = last, end
        else:
            out.append([first, last, start, end])
    return [tuple(x) for x in out]


def window_sets(benchmark: DataFrame, item_col: str, text_col: str, n: int, max_windows: int) -> Iterator[WindowSet]:
    """The item windows in blocks of at most ``max_windows``; a longer item is in several blocks."""
    block: list[tuple[str, list[bytes]]] = []
    size = 0
    rows = pick(benchmark, item=item_col, text=text_col).where("item is not null and text is not null")
    for row in rows.select(F.col("item").cast("string").alias("item"), "text").toLocalIterator():
        words = words_of(row.text)
        least = min(n, len(words))
        first, windows = 0, len(words) - least + 1 if words else 0
        while first < windows:
            take = min(windows - first, max_windows - size)
            if take:
                block.append((row.item, words[first : first + take + least - 1]))
                first, size = first + take, size + take
            if size >= max_windows:
                yield WindowSet(block, n)
                block, size = [], 0
    if block:
        yield WindowSet(block, n)


_RUNS = pa.list_(pa.struct([(x, pa.int64()) for x in ("first", "last", "start", "end")]))
_RUNS_SQL = "array<struct<first:long,last:long,start:long,end:long>>"


def _as_runs(runs) -> pa.Array:
    return pa.array([[dict(zip(("first", "last", "start", "end"), r)) for r in x] for x in runs], _RUNS)


def _scan(docs: DataFrame, block, hits_only: bool) -> DataFrame:
    """``row``, ``id``, ``n_words``, ``items``, ``runs`` of rows ``row``, ``id``, ``text``."""

    def work(batches):
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(2)):
                n_words, items, runs = scan(block.value, data, offsets)
                found = pa.RecordBatch.from_arrays(
                    [batch.column(0)[a:b], batch.column(1)[a:b], pa.array(n_words, pa.int64()), pa.array([sorted(x) for x in items], pa.list_(pa.string())), _as_runs(runs)],
                    ["row", "id", "n_words", "items", "runs"],
                )
                yield found.filter(pa.array([bool(x) for x in runs], pa.bool_())) if hits_only else found
            give_back()

    return docs.mapInArrow(work, f"row long, id long, n_words long, items array<string>, runs {_RUNS_SQL}")


def _merge(batches):
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), _as_runs(merged([tuple(r.values()) for r in x]) for x in batch.column(2).to_pylist())], ["row", "items", "runs"])


def _leaks(rows: DataFrame, sets: list[WindowSet] | Iterator[WindowSet]) -> DataFrame:
    """As :func:`_scan` over all blocks of windows, ``row`` being unique if there are several blocks.

    Blocks are broadcast one at a time: a worker holds one.
    """
    spark, found = rows.sparkSession, []
    for k, known in enumerate(sets):
        shared = spark.sparkContext.broadcast(known)
        found.append(cut(_scan(rows, shared, hits_only=k > 0)))
        shared.destroy()
    every = found[0].select("row", "items", "runs")
    for more in found[1:]:
        every = every.unionByName(more.select("row", "items", "runs"))
    grouped = every.where("size(runs) > 0").groupBy("row").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), F.flatten(F.collect_list("runs")).alias("runs"))
    hits = grouped.mapInArrow(_merge, f"row long, items array<string>, runs {_RUNS_SQL}").withColumnRenamed("row", "of")
    joined = found[0].select("row", "id", "n_words").join(hits, F.col("row") == F.col("of"), "left")
    return joined.select("row", "id", "n_words", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.coalesce("runs", F.array().cast(_RUNS_SQL)).alias("runs"))


def _first_two(sets: Iterator[WindowSet], n: int) -> list[WindowSet]:
    return [x for x, _ in zip(sets, range(2))] or [WindowSet([], n)]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", n: int = 10, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """Benchmark windows found in whole documents, one row per document.

    Columns: the id (long), ``n_words``, ``n_hit``, ``items`` (sorted as strings,
    those with a verified window in the document) and ``spans`` (byte ranges of
    the maximal runs of hit words).

    Up to ``max_windows`` windows (about 45 bytes each) are broadcast and every
    row is scanned where it is.  More are broadcast in blocks, one after another,
    and what a row has in each is merged by its number, with the same result.
    Null and empty texts have no words; items without words match nothing; an
    empty table gives an empty result; rows that repeat an id, or have none, are
    each scanned by themselves; extra columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))

    def sets():
        return window_sets(benchmark, item_col, item_text_col, n, max_windows)

    known = _first_two(sets(), n)
    if len(known) == 1:
        found = _scan(rows.select(F.lit(0).cast("long").alias("row"), "id", "text"), docs.sparkSession.sparkContext.broadcast(known[0]), hits_only=False)
    else:
        del known
        numbered = stash(rows.select(F.monotonically_increasing_id().alias("row"), "id", "text"), "numbered")
        found = _leaks(numbered, sets())
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda x, r: x + r["last"] - r["first"] + 1)
    spans = F.transform("runs", lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end")))
    return found.select(F.col("id").alias(id_col), "n_words", hit.alias("n_hit"), F.array_sort("items").alias("items"), spans.alias("spans"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, action: str = "documents", id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", n: int = 10, max_windows: int = MAX_WINDOWS,
) -> DataFrame:
    """``docs`` without benchmark text, columns unchanged.

    ``action="documents"`` drops a document with a verified window;
    ``action="spans"`` cuts the runs of hit words out of its text, all of them
    judged on the text as it came.  Up to ``max_windows`` windows there is no
    shuffle.  Nulls, empty tables and extra columns as in :func:`find_leaks`.
    """
    if action not in ("documents", "spans"):
        raise ValueError("action is 'documents' or 'spans'")
    at, schema = docs.columns.index(text_col), docs.schema
    known = _first_two(window_sets(benchmark, item_col, item_text_col, n, max_windows), n)
    if len(known) == 1:
        shared = docs.sparkSession.sparkContext.broadcast(known[0])

        def work(batches):
            for batch in batches:
                for a, b, data, offsets in text_steps(batch.column(at)):
                    yield _cleaned(batch.slice(a, b - a), scan(shared.value, data, offsets)[2], action, at)
                give_back()

        return docs.mapInArrow(work, schema)
    del known
    number = next(f"row{k}" for k in range(len(docs.columns) + 1) if f"row{k}" not in docs.columns)
    numbered = stash(docs.withColumn(number, F.monotonically_increasing_id()), "numbered")
    rows = numbered.select(F.col(number).alias("row"), F.lit(0).cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    hits = _leaks(rows, window_sets(benchmark, item_col, item_text_col, n, max_windows)).where("size(runs) > 0")
    if action == "documents":
        return numbered.join(hits.select(F.col("row").alias(number)), number, "left_anti").select(*(f"`{c}`" for c in docs.columns))
    runs = next(f"runs{k}" for k in range(len(docs.columns) + 1) if f"runs{k}" not in docs.columns)
    joined = numbered.join(hits.select(F.col("row").alias(number), F.col("runs").alias(runs)), number, "left").select(*(f"`{c}`" for c in docs.columns), runs)

    def cleaned(batches):
        for batch in batches:
            found = [[tuple(r.values()) for r in x or []] for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield _cleaned(batch.select(batch.schema.names[:-1]), found, action, at)

    return joined.mapInArrow(cleaned, schema)


def _cleaned(part: pa.RecordBatch, runs: list, action: str, at: int) -> pa.RecordBatch:
    """Rows without hits, or with the runs of hit words cut out of their texts."""
    hit = [bool(x) for x in runs]
    if not any(hit):
        return part
    if action == "documents":
        return part.filter(pa.array([not x for x in hit], pa.bool_()))
    texts = part.column(at).to_pylist()
    for k in np.flatnonzero(hit):
        raw, kept, done = texts[k].encode(), [], 0
        for _, _, s, e in runs[k]:
            kept.append(raw[done:s])
            done = e
        texts[k] = b"".join([*kept, raw[done:]]).decode()
    columns = list(part.columns)
    columns[at] = pa.array(texts, part.schema.field(at).type)
    return pa.RecordBatch.from_arrays(columns, schema=part.schema)


def op3_decontaminate(spark, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
OP3_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
i AS (SELECT item_id, {_WORDS_SQL} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[k + 1 : k + n], ' ') AS key FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(len(w) - least(10, len(w)) + 1)) AS k FROM i WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, k, array_to_string(w[k + 1 : k + n], ' ') AS key FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS k FROM d, z)),
h AS (SELECT doc_id, item_id, n, k FROM dw JOIN iw USING (n, key)),
p AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS place FROM h) GROUP BY doc_id),
m AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN m USING (doc_id)
"""
