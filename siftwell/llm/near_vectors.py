"""Embedding near-duplicates by sorted projection passes.

In every pass vectors are ordered by the signs of 64 random projections, joined
to one number, and each is compared with those in a window after it, by these
signs and 64 more that are the same in all passes.  Vectors that are close share
long prefixes in most passes, so they come to stand near each other in some.
What the windows of all passes connect is a candidate group; its vectors meet
once, and all pairs in it are verified by their cosine in double precision, tile
by tile.  Only numbers of links and a forest of them leave a tile, so that a
dense group costs no more rows than it has vectors.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftwell.llm._common import cut, give_back, grouped, pick, small, table
from siftwell.llm._components import components, forest_batch, local_roots

#: Neighbours after each vector that it is compared with.
WINDOW = 512
#: Chance to meet that a pair just at the threshold is to have, over all passes.
RECALL = 0.999
#: Standard deviations above the expected number of differing signs that make a candidate.
SLACK = 3.5
#: Vector bytes of a part of a large candidate group.
PART_BYTES = 32_000_000
_TILE = 1024


def passes_for(n: int, least: float, window: int = WINDOW, recall: float = RECALL) -> int:
    """Passes after which a pair at the threshold has met with the chance ``recall``.

    A sign differs with the chance angle / pi.  Among ``n`` evenly spread
    vectors, two with ``log2(n / window) + 1`` equal leading signs are taken to
    stand within a window.
    """
    same = 1 - math.acos(least) / math.pi
    bits = max(1.0, math.log2(max(2.0, n / window)) + 1)
    return max(4, math.ceil(math.log(1 - recall) / math.log(1 - same**bits)))


def budget_for(least: float) -> int:
    """Signs of 128 in which two vectors at the threshold may differ."""
    differ = math.acos(least) / math.pi
    return math.ceil(128 * differ + SLACK * math.sqrt(128 * differ * (1 - differ)))


def _vectors(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
    """Row numbers of the vectors that can be linked, and their components as doubles.  Null, zero or with null or non-finite components: left out."""
    rows, out = [], []
    for k, v in enumerate(column):
        if not v.is_valid or v.values.null_count or not len(v.values):
            continue
        x = v.values.to_numpy(zero_copy_only=False).astype("<f8")
        if np.isfinite(x).all() and x.any():
            rows.append(k)
            out.append(x)
    return rows, out


def _digest(x: np.ndarray) -> bytes:
    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _sketched(vectors: DataFrame, passes: int, seed: int) -> DataFrame:
    """``id``, and for vectors that can be linked ``digest``, ``size`` and ``signs``: a number for each pass and one more."""

    def work(batches):
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            n = batch.num_rows
            digests, sizes, signs = [None] * n, [None] * n, [None] * n
            rows, found = _vectors(batch.column(1))
            by_size: dict[int, list[int]] = {}
            for k, (row, x) in enumerate(zip(rows, found)):
                digests[row], sizes[row] = _digest(x), len(x)
                by_size.setdefault(len(x), []).append(k)
            for size, some in by_size.items():
                if size not in planes:
                    planes[size] = np.random.default_rng([seed, size]).standard_normal((size, 64 * (passes + 1)))
                for a in range(0, len(some), 2000):
                    part = some[a : a + 2000]
                    keys = np.packbits(np.stack([found[k] for k in part]) @ planes[size] > 0, axis=1).view(">u8").astype(np.uint64)
                    for k, own in zip(part, (keys ^ np.uint64(1 << 63)).view(np.int64)):  # signed order is the order of the bits
                        signs[rows[k]] = own
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(digests, pa.binary()), pa.array(sizes, pa.int32()), pa.array(signs, pa.list_(pa.int64()))], ["id", "digest", "size", "signs"])
            give_back()

    return vectors.mapInArrow(work, "id long, digest binary, size int, signs array<long>")


# ---- windows

_COLUMNS = ["grp", "key", "more", "node"]
_FOUND = "node long, root long, border int, side int, place int, grp long, key long, more long"


def window_links(rows: dict[str, np.ndarray], first: int, window: int, budget: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of pairs at most ``window`` apart, the second from ``first`` on, that differ in few signs: as many as connect what they connect."""
    grp, key, more, node = (rows[c] for c in _COLUMNS)
    n, left, right = len(node), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    label = np.arange(n)
    for apart in range(1, min(window, n - 1) + 1):
        a, b = slice(max(0, first - apart), n - apart), slice(max(apart, first), n)
        near = np.flatnonzero((np.bitwise_count(key[a] ^ key[b]) + np.bitwise_count(more[a] ^ more[b]) <= budget) & (label[a] != label[b]) & (grp[a] == grp[b]))
        if len(near):
            i, j = near + a.start, near + b.start
            left.append(node[i])
            right.append(node[j])
            of, root = local_roots(label[i], label[j])
            to = np.arange(n)
            to[of] = root
            label = to[label]
    return np.concatenate(left), np.concatenate(right)


def _link_rows(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    found = forest_batch(left, right)
    none = [pa.nulls(found.num_rows, t) for t in (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64())]
    return pa.RecordBatch.from_arrays([*found.columns, *none], ["node", "root", "border", "side", "place", "grp", "key", "more"])


def _border_rows(rows: dict[str, np.ndarray], border: int, side: int) -> pa.RecordBatch:
    n = len(rows["node"])
    values = [rows["node"], np.full(n, -1), np.full(n, border), np.full(n, side), np.arange(n), rows["grp"], rows["key"].view(np.int64), rows["more"].view(np.int64)]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(values, kinds)], ["node", "root", "border", "side", "place", "grp", "key", "more"])


def _within(window: int, budget: int):
    """Links within a partition, and the rows of a window at each of its borders."""

    def work(batches):
        number, held, head, sent = TaskContext.get().partitionId(), None, 0, False
        for batch in batches:
            if not batch.num_rows:
                continue
            get = lambda c: batch.column(c).to_numpy()
            new = {"grp": get("p").astype(np.int64) << 32 | get("size"), "key": get("key").view(np.uint64), "more": get("more").view(np.uint64), "node": get("node")}
            first = 0 if held is None else len(held["node"])
            rows = new if held is None else {c: np.concatenate([held[c], new[c]]) for c in _COLUMNS}
            left, right = window_links(rows, first, window, budget)
            if len(left):
                yield _link_rows(left, right)
            if not sent:  # the first rows, a window of them at least if there are so many
                head = len(rows["node"])
                if head >= window:
                    yield _border_rows({c: x[:window] for c, x in rows.items()}, number, 1)
                    sent = True
            keep = window if sent else len(rows["node"])
            held = {c: x[max(0, len(x) - keep) :] for c, x in rows.items()}
        if held is not None:
            if not sent:
                yield _border_rows(held, number, 1)
            yield _border_rows({c: x[max(0, len(x) - window) :] for c, x in held.items()}, number + 1, 0)

    return work


def _across(window: int, budget: int):
    def work(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("side", "ascending"), ("place", "ascending")])
        rows = {c: table.column(c).to_numpy() for c in _COLUMNS}
        rows |= {c: rows[c].view(np.uint64) for c in ("key", "more")}
        return pa.Table.from_batches([_link_rows(*window_links(rows, int((table.column("side").to_numpy() == 0).sum()), window, budget))])

    return work


# ---- verification


def tile_links(x: np.ndarray, y: np.ndarray | None, n_x: np.ndarray, n_y: np.ndarray, least: float):
    """For vectors at length 1 the numbers of links, and positions of links that connect what all links connect.

    ``y`` None: pairs within ``x``.  A cosine within 1e-9 of the threshold is
    computed anew in one order.  Positions of ``y`` follow those of ``x``.
    """
    same = y is None
    other, n_other = (x, n_x) if same else (y, n_y)
    counts = np.zeros(len(x) + (0 if same else len(y)), np.int64)
    label = np.arange(len(counts))
    shift = 0 if same else len(x)
    left, right = [], []
    for a in range(0, len(x), _TILE):
        for b in range(a if same else 0, len(other), _TILE):
            u, v = x[a : a + _TILE], other[b : b + _TILE]
            cosine = u @ v.T
            near = cosine >= least
            for i, j in zip(*np.nonzero(np.abs(cosine - least) < 1e-9)):
                near[i, j] = (u[i] * v[j]).sum() >= least
            if same and a == b:
                np.fill_diagonal(near, False)
            counts[a : a + len(u)] += near @ n_other[b : b + len(v)]
            if not same or a != b:
                counts[shift + b : shift + b + len(v)] += near.T @ n_x[a : a + len(u)]
            i, j = np.nonzero(near & (label[a : a + len(u), None] != label[None, shift + b : shift + b + len(v)]))
            if len(i):
                i, j = i + a, j + b + shift
                of, root = local_roots(label[i], label[j])
                left.append(of)
                right.append(root)
                to = np.arange(len(label))
                to[of] = root
                label = to[label]
    none = np.zeros(0, np.int64)
    return counts, np.concatenate(left) if left else none, np.concatenate(right) if right else none


def _unit(raw: np.ndarray, kind: str) -> np.ndarray:
    x = np.frombuffer(b"".join(raw), kind).astype(float).reshape(len(raw), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _verified(dealt: DataFrame, kind: str, least: float) -> DataFrame:
    """``node``, ``root`` of links, and ``node``, ``links`` (a number) of vectors; of parts that share ``cluster``, ``i``, ``j``."""
    dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "own", "node")

    def judged(part, lo, hi):
        own, node, n = (part[c][lo:hi] for c in ("own", "node", "n"))
        new = np.r_[True, node[1:] != node[:-1]]  # a vector that repeated ids brought twice is there once
        own, node, n = own[new], node[new], n[new]
        x = _unit(part["vec"][lo:hi][new], kind)
        if part["i"][lo] == part["j"][lo]:
            counts, left, right = tile_links(x, None, n, n, least)
        else:
            mid = int(np.searchsorted(own, part["j"][lo]))
            counts, left, right = tile_links(x[:mid], x[mid:], n[:mid], n[mid:], least)
        if len(left):
            found = forest_batch(node[left], node[right])
            yield pa.RecordBatch.from_arrays([*found.columns, pa.nulls(found.num_rows, pa.int64())], ["node", "root", "links"])
        some = counts > 0
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(node[some]), pa.nulls(int(some.sum()), pa.int64()), pa.array(counts[some])], ["node", "root", "links"])

    def work(batches):
        for part, bounds in grouped((b.slice(k, 1024) for b in batches for k in range(0, b.num_rows, 1024)), ("cluster", "i", "j")):
            for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                if hi - lo > 1:
                    yield from judged(part, lo, hi)
            give_back()

    return dealt.mapInArrow(work, "node long, root long, links long")


def _bodies(rows: DataFrame, kind: str) -> DataFrame:
    def work(batches):
        for batch in batches:
            _, found = _vectors(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array([_digest(x) for x in found], pa.binary()), pa.array([x.astype(kind).tobytes() for x in found], pa.binary())], ["key", "vec"])
            give_back()

    return rows.mapInArrow(work, "key binary, vec binary")


def near_vectors(
    vectors: DataFrame, least: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding",
    window: int = WINDOW, recall: float = RECALL, seed: int = 20240229,
) -> DataFrame:
    """Each vector with ``n_links`` (other vectors linked directly), ``component_id`` and ``kept``.

    Vectors that are null, empty, zero, or hold null or non-finite components
    link with nothing.  Equal vectors are linked and take part once, by their
    smallest id and their number; vectors of different sizes are never linked.
    Pairs below ``least`` are never linked; the number of passes follows from
    the number of vectors and ``recall``.  Rows that repeat an id count as other
    vectors; an empty table gives an empty result; other columns are ignored.
    """
    rows = pick(vectors, id=id_col, vec=vector_col).withColumn("id", F.col("id").cast("long"))
    passes, budget = passes_for(rows.count(), least, window, recall), budget_for(least)
    sketches = cut(_sketched(rows, passes, seed))
    reps = sketches.where("digest is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n"), F.first("size").alias("size"), F.first("signs").alias("signs"))
    reps = cut(reps.withColumn("node", F.monotonically_increasing_id()))
    parts = max(1, min(int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions")), reps.count() * passes // (8 * window)))
    ordered = reps.select("size", "node", F.posexplode(F.slice("signs", 1, passes)).alias("p", "key"), F.element_at("signs", passes + 1).alias("more"))
    ordered = ordered.repartitionByRange(parts, "p", "size", "key", "node").sortWithinPartitions("p", "size", "key", "node")
    found = cut(ordered.mapInArrow(_within(window, budget), _FOUND))
    borders = found.where("border is not null").groupBy("border").applyInArrow(_across(window, budget), _FOUND)
    groups = components(found.where("border is null").unionByName(borders).select("node", "root")).select(F.col("node").alias("of"), "component")
    groups = groups.unionByName(groups.select(F.col("component").alias("of"), "component").distinct())
    members = reps.join(groups, F.col("node") == F.col("of")).select("digest", "rep", "n", "size", "node", F.col("component").alias("cluster"))
    kind = "<f4" if isinstance(vectors.schema[vector_col].dataType.elementType, T.FloatType) else "<f8"
    large = members.groupBy("cluster").agg(F.ceil(F.sum(F.col("size").cast("long") * int(kind[2])) / PART_BYTES).cast("int").alias("parts")).where("parts > 1")
    members = cut(members.join(small(large.withColumnRenamed("cluster", "of")), F.col("cluster") == F.col("of"), "left").withColumn("parts", F.coalesce("parts", F.lit(1))).drop("of"))
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    wanted = small(members.select("digest", "node", "n", "cluster", "parts", own.alias("own")))
    bodies = _bodies(rows.join(small(members.select(F.col("rep").alias("id")).distinct()), "id", "left_semi").select("vec"), kind)
    dealt = bodies.join(wanted, F.col("key") == F.col("digest")).withColumn("with", F.explode(F.expr("sequence(0, parts - 1)")))
    dealt = dealt.select("cluster", F.least("own", "with").alias("i"), F.greatest("own", "with").alias("j"), "own", "node", "n", "vec")
    judged = cut(_verified(dealt, kind, least))
    degrees = judged.where("links is not null").groupBy(F.col("node").alias("of")).agg(F.sum("links").alias("more"))
    united = components(judged.where("links is null").select("node", "root")).select(F.col("node").alias("member"), "component")
    named = reps.select("digest", "rep", "n", "node").join(degrees, F.col("node") == F.col("of"), "left").join(united, F.col("node") == F.col("member"), "left")
    named = cut(named.select("digest", "rep", "n", F.coalesce("more", F.lit(0)).alias("more"), F.coalesce("component", "node").alias("component")))
    lowest = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(lowest, "component").select(F.col("digest").alias("of"), (F.col("n") - 1 + F.col("more")).alias("n_links"), "component_id")
    linked = sketches.select("id", "digest").join(named, F.col("digest") == F.col("of")).select("id", "n_links", "component_id")
    alone = sketches.where("digest is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_near_vectors(spark, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
