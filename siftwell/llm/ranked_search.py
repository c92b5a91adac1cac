"""Ranked lexical search by sort-based accumulation.

The items are the stated queries and go out in bounded blocks; the documents
stay where they are.

1.  One pass over the texts keeps of every document its length and the counts
    of the terms that any item asks for, and adds up in how many documents each
    of them stands.
2.  With the weights known, the arrays (item, document, impact) of all terms
    that a stretch of documents has are concatenated, their packed keys radix
    sorted, and the impacts of equal keys summed by ``reduceat``.  A stretch is a
    range of documents whose impacts fit in IMPACTS.
3.  Each task selects by a heap the best of every item, and ranges of (item,
    part of the tasks) do so once more before each item's best meet.

Scores are 64-bit integers, so no order of adding matters.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.llm._common import LOWER, byte_class, cut, give_back, pick, span_hashes, table, text_steps, word_spans
from siftwell.llm._tokens import WordTable

#: Bytes of terms after lower-casing: digits, a to z and every byte of a character beyond ASCII.
TERM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
BEST = 50
#: Items, and different terms of items, that are broadcast at a time; more items go in further blocks.
MOST_ITEMS, MOST_POSTINGS = 65_536, 2_000_000
#: Impacts that are sorted at a time (one document's at least), and documents of such a stretch.
IMPACTS, STRETCH = 1_000_000, 65_536
#: Parts of the tasks in which an item's best are selected before they meet.
PARTS = 64

_FORWARD = "docs array<long>, sizes array<long>, counts array<long>, terms array<int>, tf array<int>, df_terms array<int>, df array<long>"
_FOUND = "item int, part int, doc long, score long"


def terms_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, starts, ends, rows and 64-bit hashes of all terms."""
    data = LOWER[data]
    starts, ends, of = word_spans(data, offsets, TERM)
    return data, starts, ends, of, span_hashes(data, starts, ends) if len(starts) else np.zeros(0, np.uint64)


class Items:
    """A bounded block of items: their different terms, and for each term its items."""

    def __init__(self, items: list[tuple[object, str]]):
        self.names = [name for name, _ in items]
        data = np.frombuffer("".join(text for _, text in items).encode(), np.uint8)
        offsets = np.cumsum([0, *(len(text.encode()) for _, text in items)])
        data, starts, ends, of, h = terms_of(data, offsets)
        self.keys, first, term = np.unique(h, return_index=True, return_inverse=True)
        self.words = [data[starts[k] : ends[k]].tobytes() for k in first.tolist()]
        pairs = np.unique(term.astype(np.int64) << 32 | of)
        self.items = (pairs & 0xFFFFFFFF).astype(np.int64)
        self.edge = np.searchsorted(pairs >> 32, np.arange(len(self.keys) + 1))


class Finder:
    """The terms of items among the terms of a step of texts, told apart by their bytes."""

    def __init__(self, keys: np.ndarray, words: list[bytes]):
        self.table, self.words = WordTable(), words
        self.table.add(np.where(keys == 0, np.uint64(1), keys), np.arange(len(keys), dtype=np.int32))

    def find(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray) -> np.ndarray:
        found = self.table.find(np.where(h == 0, np.uint64(1), h))
        hit = np.flatnonzero(found >= 0)
        # one look at the bytes of each different term of the step
        _, first, back = np.unique(h[hit], return_index=True, return_inverse=True)
        at = hit[first]
        same = np.array([data[starts[k] : ends[k]].tobytes() == self.words[t] for k, t in zip(at.tolist(), found[at].tolist())], bool)
        found[hit[~same[back]]] = -1
        return found


def item_blocks(items: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[object, str]]]:
    """Items with a text in blocks of at most MOST_ITEMS and about MOST_POSTINGS terms."""
    block, size = [], 0
    for row in pick(items, item=id_col, text=text_col).where("text is not null").toLocalIterator():
        terms = len(row.text) // 2 + 1
        if block and (len(block) >= MOST_ITEMS or size + terms > MOST_POSTINGS):
            yield block
            block, size = [], 0
        block.append((row.item, row.text))
        size += terms
    if block:
        yield block


# ---- the first pass


def _forward(shared):
    def work(batches):
        keys, words = shared.value
        finder = Finder(keys, words)
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(1)):
                rows = b - a
                data, starts, ends, of, h = terms_of(data, offsets)
                sizes = np.bincount(of, minlength=rows)
                term = finder.find(data, starts, ends, h) if len(h) else np.zeros(0, np.int64)
                hit = term >= 0
                pair, tf = np.unique(of[hit] << 32 | term[hit], return_counts=True)
                doc, term = pair >> 32, (pair & 0xFFFFFFFF).astype(np.int32)
                counts = np.bincount(doc, minlength=rows)
                df_terms, df = np.unique(term, return_counts=True)
                some = sizes > 0  # a document without any term is in no count and no list
                lists = [batch.column(0)[a:b].filter(pa.array(some)), sizes[some], counts[some], term, tf.astype(np.int32), df_terms, df]
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()]
                arrays = [pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x, k)) for x, k in zip(lists, kinds)]
                yield pa.RecordBatch.from_arrays(arrays, ["docs", "sizes", "counts", "terms", "tf", "df_terms", "df"])
            give_back()

    return work


def weights(df: np.ndarray, n: int) -> np.ndarray:
    return np.floor(1000 * np.log((2 * n + 2) / (2 * df + 1))).astype(np.int64)


def impacts(weight: np.ndarray, tf: np.ndarray, size: np.ndarray, n: int, total: int) -> np.ndarray:
    """weight * (10^9 tf div (1000 tf + 20 m)), with m = 50 + 50 size n div total."""
    m = 50 + (50 * size * n) // total
    return weight * ((1_000_000_000 * tf) // (1000 * tf + 20 * m))


# ---- the second pass


def radix_order(keys: np.ndarray, most: int) -> np.ndarray:
    """A stable order of keys up to ``most``, by digits of 16 bits from the last."""
    order = np.argsort(keys.astype(np.uint16), kind="stable")  # numpy sorts 16-bit numbers by radix
    shift = 16
    while most >> shift:
        digit = (keys[order] >> shift).astype(np.uint16)
        order = order[np.argsort(digit, kind="stable")]
        shift += 16
    return order


def accumulate(item: np.ndarray, doc: np.ndarray, impact: np.ndarray, docs: int, items: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sums of the impacts of each (item, document), ascending."""
    if not len(item):
        return item, doc, impact
    key = item * docs + doc
    order = radix_order(key, items * docs)
    key = key[order]
    first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    total = np.add.reduceat(impact[order], first)
    key = key[first]
    return key // docs, key % docs, total


class Best:
    """The ``most`` best of every item: highest score, then smallest document; a document without an id comes last."""

    def __init__(self, items: int, most: int):
        self.most, self.heaps = most, [[] for _ in range(items)]
        self.edge = np.zeros(items, np.int64)  # scores below are no longer among the best

    def add(self, item: np.ndarray, doc: np.ndarray, named: np.ndarray, score: np.ndarray) -> None:
        some = np.flatnonzero((score > 0) & (score >= self.edge[item]))
        for i, d, yes, s in zip(item[some].tolist(), doc[some].tolist(), named[some].tolist(), score[some].tolist()):
            heap, entry = self.heaps[i], (s, yes, -d)
            if len(heap) < self.most:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.most:
                self.edge[i] = heap[0][0]

    def rows(self, part: int) -> Iterator[pa.RecordBatch]:
        out = [(i, s, -d if yes else None) for i, heap in enumerate(self.heaps) for s, yes, d in heap]
        for a in range(0, len(out), 10_000):
            some = out[a : a + 10_000]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[0] for x in some], pa.int32()), pa.array([part] * len(some), pa.int32()), pa.array([x[2] for x in some], pa.int64()), pa.array([x[1] for x in some], pa.int64())],
                ["item", "part", "doc", "score"],
            )


def _ids(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers, and whether they are there."""
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_valid().to_numpy(zero_copy_only=False)


def _list(column: pa.Array, k: int) -> np.ndarray:
    return column[k].values.to_numpy(zero_copy_only=False)


def _accumulated(shared, most: int):
    def work(batches):
        n_items, weight, edge, items, n, total = shared.value
        best = Best(n_items, most)
        fan = np.diff(edge)
        for batch in batches:
            docs, sizes, counts, terms, tf = (batch.column(c) for c in range(5))
            for k in range(batch.num_rows):
                (ids, named), size, count = _ids(docs[k].values), _list(sizes, k), _list(counts, k)
                term, times = _list(terms, k), _list(tf, k).astype(np.int64)
                doc = np.repeat(np.arange(len(size)), count)
                own = impacts(weight[term], times, size[doc], n, total)
                work_of = np.r_[0, np.cumsum(np.bincount(doc, fan[term], minlength=len(size)).astype(np.int64))]
                at = np.r_[0, np.cumsum(count)]
                a = 0
                while a < len(size):  # ranges of documents
                    b = int(np.searchsorted(work_of, work_of[a] + IMPACTS, "right")) - 1
                    b = min(len(size), max(a + 1, b), a + STRETCH)
                    here = slice(at[a], at[b])
                    t, f = term[here], fan[term[here]]
                    item = items[np.repeat(edge[t] - (np.cumsum(f) - f), f) + np.arange(int(f.sum()))]
                    i, d, s = accumulate(item, np.repeat(doc[here] - a, f), np.repeat(own[here], f), b - a, n_items)
                    best.add(i, ids[a + d], named[a + d], s)
                    a = b
            give_back()
        yield from best.rows(TaskContext.get().partitionId() % PARTS)

    return work


def _selected(n_items: int, most: int):
    """The best of each item in a range of (item, part)."""

    def work(batches):
        held: dict[int, Best] = {}
        for batch in batches:
            item, part, (doc, named), score = batch.column(0).to_numpy(), batch.column(1).to_numpy(), _ids(batch.column(2)), batch.column(3).to_numpy()
            for p in np.unique(part).tolist():
                own = part == p
                held.setdefault(p, Best(n_items, most)).add(item[own], doc[own], named[own], score[own])
        for p, best in held.items():
            yield from best.rows(p)

    return work


def ranked_documents(
    docs: DataFrame, items: DataFrame, most: int = BEST, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
) -> DataFrame:
    """The ``most`` best documents of each item: the item's id, ``rank`` from 1, the document's id and ``score``.

    Terms are runs of digits, letters and characters beyond ASCII, with A to Z
    lower-cased.  Equal scores rank by ascending id, a null id last.  Items are
    rows: rows that repeat an id are ranked each.  Null texts and texts without
    terms have no part; a score of 0 is not listed; empty tables give an empty
    result; other columns are ignored.
    """
    spark = docs.sparkSession
    kind = items.schema[item_col].dataType.simpleString()
    rows = pick(docs, id=id_col, text=text_col).select(F.col("id").cast("long").alias("id"), "text")
    out = spark.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    for block in item_blocks(items, item_col, item_text_col):
        out = out.unionByName(_ranked(spark, rows, Items(block), most, kind))
    return out.select(F.col("item").alias(item_col), "rank", F.col("doc").alias(id_col), "score")


def _ranked(spark, rows: DataFrame, asked: Items, most: int, kind: str) -> DataFrame:
    forward = cut(rows.mapInArrow(_forward(spark.sparkContext.broadcast((asked.keys, asked.words))), _FORWARD))
    sums = forward.agg(F.sum(F.size("docs")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda x, y: x + y)).alias("total")).head()
    n, total = sums.n or 0, sums.total or 0
    if not n or not len(asked.keys):
        return spark.createDataFrame([], f"item {kind}, rank int, doc long, score long")
    pairs = forward.select(F.explode(F.arrays_zip("df_terms", "df")).alias("x")).groupBy("x.df_terms").agg(F.sum("x.df").alias("df"))
    df = np.zeros(len(asked.keys), np.int64)
    known = pairs.toArrow()  # a row for each term of the block of items at most
    df[known.column(0).to_numpy()] = known.column(1).to_numpy()
    shared = spark.sparkContext.broadcast((len(asked.names), weights(df, n), asked.edge, asked.items, n, total))
    found = forward.select("docs", "sizes", "counts", "terms", "tf").mapInArrow(_accumulated(shared, most), _FOUND)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = cut(found).repartitionByRange(parts, "item", "part").mapInArrow(_selected(len(asked.names), most), _FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    names = spark.createDataFrame(list(enumerate(asked.names)), f"at int, name {kind}")
    return best.join(F.broadcast(names), F.col("item") == F.col("at")).select(F.col("name").alias("item"), "rank", "doc", "score")  # MOST_ITEMS names


def op12_ranked_search(spark, sf_dir: str) -> DataFrame:
    return ranked_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_TERMS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"
OP12_SQL = f"""
WITH d AS (SELECT doc_id, {_TERMS_SQL} AS w FROM documents),
z AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(len(w)) AS BIGINT) AS total FROM d WHERE len(w) > 0),
i AS (SELECT DISTINCT item_id, unnest({_TERMS_SQL}) AS term FROM benchmark),
f AS (SELECT doc_id, size, term, count(*) AS tf FROM (SELECT doc_id, CAST(len(w) AS BIGINT) AS size, unnest(w) AS term FROM d) WHERE term IN (SELECT term FROM i) GROUP BY ALL),
v AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(n) + 2) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, z GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * size * n) // total)))) AS BIGINT) AS score FROM i JOIN v USING (term) JOIN f USING (term), z GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {BEST}
"""
