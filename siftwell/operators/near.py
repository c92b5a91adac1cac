"""Pairs of near vectors by buckets of projection signs, verified exactly.

Every vector has SIGNS signs of random projections.  A band is a choice of some
of them; vectors with equal signs in a band share its bucket.  In a bucket only
pairs whose other signs differ in few places go on, and each is verified by its
cosine in double precision.  The bands follow from the number of vectors and the
wanted recall: with the signs of a band a bucket stays about as large whatever
the number of vectors, so that the work grows with a power below two of it.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Signs of a vector; bands draw on all of them, and 128 are compared in a bucket.
SIGNS, COMPARED = 1024, 128
#: Vectors that a bucket of evenly spread vectors is to hold.
BUCKET = 64
#: Rows of a bucket that are compared as one part; larger buckets are dealt out as pairs of parts.
PART = 2048
#: Chance to share a bucket, and to differ in few enough signs, for a pair just at the threshold.
RECALL = 0.9995
#: Standard deviations above the expected number of differing signs that still go on.
SLACK = 4.0
#: Rows up to which all pairs of a bucket are compared step by step with those of other buckets, and rows that are held for it.
TILED, HELD = 1024, 65_536
#: Copies of a vector that are joined as one part.
COPIES = 1024
_SEED = 20240517
_CANDIDATES = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("band", pa.int32()), ("key", pa.int64()), ("size", pa.int32()), ("id", pa.int64()), ("s0", pa.int64()), ("s1", pa.int64())])


def plan(n: int, least: float, recall: float = RECALL) -> tuple[int, int, int]:
    """Signs of a band, number of bands, and the most compared signs in which a pair may differ."""
    differ = math.acos(max(-1.0, min(1.0, least))) / math.pi
    signs = max(4, min(32, math.ceil(math.log2(max(2.0, n / BUCKET)))))
    bands = max(1, math.ceil(math.log(1 - recall) / math.log(1 - (1 - differ) ** signs))) if differ > 0 else 1
    return signs, bands, math.ceil(COMPARED * differ + SLACK * math.sqrt(COMPARED * differ * (1 - differ)))


def vector_rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The components of all vectors in one array, where each vector's begin and end, and whether all are finite numbers."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    edge = column.offsets.to_numpy().astype(np.int64)
    values = column.values.cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    wrong = np.r_[0, np.cumsum(~np.isfinite(values))]
    good = column.is_valid().to_numpy(zero_copy_only=False) & (edge[1:] > edge[:-1]) & (wrong[edge[1:]] == wrong[edge[:-1]])
    return values, edge, good


def by_size(column: pa.Array):
    """Row numbers and matrix of the vectors of each size that have finite components throughout."""
    values, edge, good = vector_rows(column)
    size = np.diff(edge)
    for d in np.unique(size[good]).tolist():
        rows = np.flatnonzero(good & (size == d))
        yield rows, values[edge[rows][:, None] + np.arange(d)]


def _banded(signs: int, bands: int):
    """``band``, ``key``, ``size``, ``id`` and the compared signs of every vector and band."""

    def work(batches):
        planes: dict[int, np.ndarray] = {}
        choice = np.random.default_rng([_SEED, signs, bands])
        chosen = np.stack([choice.permutation(SIGNS)[:signs] for _ in range(bands)])
        power = (1 << np.arange(signs)).astype(np.int64)
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for rows, x in by_size(batch.column(1)):
                rows, x = rows[x.any(axis=1)], x[x.any(axis=1)]
                d = x.shape[1]
                if d not in planes:
                    planes[d] = np.random.default_rng([_SEED, d]).standard_normal((d, SIGNS))
                step = max(1, 400_000 // bands)
                for a in range(0, len(rows), step):
                    own = x[a : a + step] @ planes[d] > 0
                    n = len(own)
                    keys = own[:, chosen] @ power  # vectors x bands
                    few = np.packbits(own[:, :COMPARED], axis=1).view(">i8")
                    some = np.repeat(np.arange(n), bands)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.tile(np.arange(bands), n), pa.int32()), pa.array(keys.reshape(-1)), pa.array(np.full(n * bands, d), pa.int32()), pa.array(ids[rows[a : a + step]][some], pa.int64()),
                         *(pa.array(few[some, k].astype(np.int64)) for k in range(COMPARED // 64))],
                        ["band", "key", "size", "id", "s0", "s1"],
                    )

    return work


def _close(signs: np.ndarray, other: np.ndarray, most: int):
    """Positions of pairs that differ in few compared signs, a tile at a time."""
    for a in range(0, len(signs), 256):
        part = signs[a : a + 256]
        apart = sum(np.bitwise_count(part[:, None, k] ^ other[None, :, k]) for k in range(signs.shape[1]))
        i, j = np.nonzero(apart <= most)
        if len(i):
            yield i + a, j


def _within(edge: np.ndarray, signs: np.ndarray, most: int):
    """Positions of close pairs of each bucket, for rows that stand bucket after bucket with ``edge`` between them."""
    size = np.diff(edge)
    for k in np.flatnonzero(size > TILED).tolist():
        part = signs[edge[k] : edge[k + 1]]
        for i, j in _close(part, part, most):
            yield i[i < j] + edge[k], j[i < j] + edge[k]
    # the others by size, so that those with rows at a distance of ``step`` are the last rows
    some = np.flatnonzero((size > 1) & (size <= TILED))
    some = some[np.argsort(size[some], kind="stable")]
    size = size[some]
    own = np.repeat(edge[some] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    left = np.repeat(np.cumsum(size), size) - np.arange(len(own)) - 1  # rows after this one in its bucket
    first, second = (np.ascontiguousarray(signs[own, k]) for k in range(2))
    for step in range(1, int(size[-1]) if len(size) else 0):
        a = int(size[: np.searchsorted(size, step, "right")].sum())
        apart = np.bitwise_count(first[a:-step] ^ first[a + step :]) + np.bitwise_count(second[a:-step] ^ second[a + step :])
        i = np.flatnonzero(apart <= most) + a
        i = i[left[i] >= step]
        if len(i):
            yield own[i], own[i + step]


def _candidates(most: int):
    """Close pairs of whole buckets of at most PART rows, many buckets at a time; rows come sorted by bucket.

    The rows of larger buckets are passed on as they are, without a pair.
    """

    def found(bucket, ids, signs):
        begins = np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]).any(axis=1)])
        pairs = [np.stack([ids[i], ids[j]], axis=1) for i, j in _within(np.r_[begins, len(ids)], signs, most)]
        return np.unique(np.sort(np.concatenate(pairs), axis=1), axis=0) if pairs else np.zeros((0, 2), np.int64)

    def told(pairs, rows=None):
        n = len(pairs) if rows is None else len(rows[1])
        whole = [pairs[:, 0], pairs[:, 1]] if rows is None else [None, None]
        rest = [None] * 6 if rows is None else [rows[0][:, 0], rows[0][:, 1], rows[0][:, 2], rows[1], rows[2][:, 0].view(np.int64), rows[2][:, 1].view(np.int64)]
        columns = [pa.nulls(n, f.type) if c is None else pa.array(c, f.type) for c, f in zip([*whole, *rest], _CANDIDATES)]
        return pa.RecordBatch.from_arrays(columns, schema=_CANDIDATES)

    def work(batches):
        held, n, passing = [], 0, None  # rows not yet compared; the large bucket whose rows pass
        for last, batch in _and_end(batches):
            if batch is not None:
                col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
                part = np.stack([col(c).astype(np.int64) for c in range(3)], axis=1), col(3), np.stack([col(4), col(5)], axis=1).view(np.uint64)
                held.append(part)
                n += len(part[1])
            if n < HELD and not last or not n:
                continue
            bucket, ids, signs = (np.concatenate(x) for x in zip(*held))
            if passing is not None:
                k = int(np.argmin(np.r_[(bucket == passing).all(axis=1), False]))
                if k:
                    yield told(None, (bucket[:k], ids[:k], signs[:k]))
                bucket, ids, signs = bucket[k:], ids[k:], signs[k:]
                passing = passing if not len(ids) else None
            edge = np.r_[np.flatnonzero(np.r_[True, (bucket[1:] != bucket[:-1]).any(axis=1)]), len(ids)] if len(ids) else np.zeros(1, np.int64)
            size = np.diff(edge)
            whole = len(size) if last or not len(size) else len(size) - 1  # the last bucket may go on
            large = size > PART
            for i in np.flatnonzero(large).tolist():
                a, b = edge[i], edge[i + 1]
                yield told(None, (bucket[a:b], ids[a:b], signs[a:b]))
                passing = bucket[a] if i == len(size) - 1 and not last else None
            small = np.repeat(~large & (np.arange(len(size)) < whole), size)
            if small.any():
                pairs = found(bucket[small], ids[small], signs[small])
                if len(pairs):
                    yield told(pairs)
            rest = np.repeat(~large & (np.arange(len(size)) >= whole), size)
            held, n = [(bucket[rest], ids[rest], signs[rest])] if rest.any() else [], int(rest.sum())

    return work


def _and_end(batches):
    for batch in batches:
        yield False, batch
    yield True, None


def _dealt(most: int):
    """Close pairs of a large bucket's vectors, a part with itself or two parts."""

    def work(group: pa.Table) -> pa.Table:
        own, ids = group.column("own").to_numpy(), group.column("id").to_numpy()
        signs = np.stack([group.column(c).to_numpy().view(np.uint64) for c in ("s0", "s1")], axis=1)
        i, j = group.column("i")[0].as_py(), group.column("j")[0].as_py()
        left, right = (np.flatnonzero(own == k) for k in (i, j))
        found = [np.zeros((0, 2), np.int64)]
        for a, b in _close(signs[left], signs[right], most):
            pair = np.stack([ids[left[a]], ids[right[b]]], axis=1)
            pair = pair[pair[:, 0] < pair[:, 1]] if i == j else pair[pair[:, 0] != pair[:, 1]]
            found.append(np.sort(pair, axis=1))
        every = np.concatenate(found)
        return pa.table({"a": every[:, 0], "b": every[:, 1]})

    return work


def _verified(least: float):
    def work(batches):
        for batch in batches:
            a, b = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            left, right = vector_rows(batch.column(2)), vector_rows(batch.column(3))
            size = np.diff(left[1])
            for d in np.unique(size).tolist():
                rows = np.flatnonzero(size == d)
                x, y = (v[e[rows][:, None] + np.arange(d)] for v, e, _ in (left, right))
                x, y = (z / np.abs(z).max(axis=1, keepdims=True) for z in (x, y))
                cosine = (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
                near = cosine >= least
                yield pa.RecordBatch.from_arrays([pa.array(a[rows[near]]), pa.array(b[rows[near]]), pa.array(cosine[near])], ["a", "b", "weight"])

    return work


def near_pairs(vectors: DataFrame, least: float, id_col: str = "node_id", vector_col: str = "vector", recall: float = RECALL) -> DataFrame:
    """``a`` < ``b`` and ``weight`` of pairs with a cosine of at least ``least``; none below it.

    A pair just at the threshold is missed with a chance of about 1 - ``recall``,
    nearer ones more seldom.  Vectors that are null, zero, or hold null or
    non-finite components have no pair, and only vectors of one size are
    compared.  Ids are different numbers.
    """
    from siftwell.operators.graph import settle

    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("size(v) > 0 and id is not null")
    equal = rows.groupBy("v").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))  # equal vectors take part once
    rows = settle(rows.join(equal, "v").select("id", "v", "rep", "copies"))
    different = rows.where("id = rep").select("id", "v")
    signs, bands, most = plan(different.count(), least, recall)
    bucket = ["band", "key", "size"]
    banded = different.mapInArrow(_banded(signs, bands), "band int, key long, size int, id long, s0 long, s1 long")
    sorted_rows = banded.repartition(*bucket).sortWithinPartitions(*bucket)
    found = settle(sorted_rows.mapInArrow(_candidates(most), "a long, b long, band int, key long, size int, id long, s0 long, s1 long"))
    pairs, large = found.where("a is not null").select("a", "b"), found.where("a is null").drop("a", "b")
    if large.head(1):
        sizes = large.groupBy(*bucket).agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
        shared = large.join(sizes, bucket).withColumn("own", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        dealt = shared.select(*bucket, F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "id", "s0", "s1")
        pairs = pairs.unionByName(dealt.groupBy(*bucket, "i", "j").applyInArrow(_dealt(most), "a long, b long"))
    both = pairs.distinct().join(different.select(F.col("id").alias("a"), F.col("v").alias("x")), "a").join(different.select(F.col("id").alias("b"), F.col("v").alias("y")), "b")
    copied = rows.where("id = rep and copies > 1 and exists(v, x -> x <> 0)").select(F.col("id").alias("a"), F.col("id").alias("b"), F.col("v").alias("x"), F.col("v").alias("y"))
    links = both.select("a", "b", "x", "y").unionByName(copied).mapInArrow(_verified(least), "a long, b long, weight double")
    return _copies(settle(links), rows)


def _copies(links: DataFrame, rows: DataFrame) -> DataFrame:
    """Links of different vectors, and of a copied one with itself, for all their copies; these are joined part by part."""
    parts = F.ceil(F.col("copies") / COPIES).cast("int")
    copied = rows.where("copies > 1").select("rep", "id", F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    counts = rows.where("id = rep and copies > 1").select("rep", parts.alias("parts"))

    def told(found: DataFrame, end: str) -> DataFrame:
        """``end`` of each link as its copies, one that has none as it is."""
        dealt = found.join(counts.withColumnRenamed("rep", end), end, "left").withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)))
        joined = dealt.join(copied.withColumnRenamed("rep", end), [end, "part"], "left")
        return joined.withColumn(f"{end}_id", F.coalesce("id", end)).drop("id", "part", "parts")

    every = told(told(links, "a"), "b")
    return every.where("a <> b or a_id < b_id").select(F.least("a_id", "b_id").alias("a"), F.greatest("a_id", "b_id").alias("b"), "weight")
