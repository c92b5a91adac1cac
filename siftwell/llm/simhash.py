"""SimHash near-duplicates: 64-bit fingerprints joined with themselves over a binary trie."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._common import LOWER, byte_class, cut, give_back, pick, table, text_steps, word_spans
from siftwell.llm._components import components, forest_batch

SPACES = byte_class((0x09, 0x0D), (0x20, 0x20))
_BLANK = LOWER.copy()
_BLANK[9:14] = 32
#: A trie with more fingerprints is dealt out in parts of this size, each pair of parts to a task.
PART = 2048
#: Pairs of trie nodes that are followed at a time.
FRONTIER = 200_000


def step_fingerprints(data: np.ndarray, offsets: np.ndarray, words: int, seed: int) -> np.ndarray:
    """A fingerprint (uint64) for each row of a step."""
    from xxhash import xxh64_digest

    rows = len(offsets) - 1
    data = _BLANK[data]
    starts, ends, of = word_spans(data, offsets, ~SPACES)
    if not len(starts):
        return np.zeros(rows, np.uint64)
    per_row = np.bincount(of, minlength=rows)
    first = np.cumsum(per_row) - per_row
    counts = np.where(per_row >= words, per_row - words + 1, np.minimum(per_row, 1))
    row = np.repeat(np.arange(rows), counts)
    begin = first[row] + np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
    size = np.minimum(per_row[row], words)
    a, b = starts[begin], ends[begin + size - 1]
    whole = data.tobytes()
    digests = [xxh64_digest(whole[x:y], seed) for x, y in zip(a.tolist(), b.tolist())]
    letters = np.r_[0, np.cumsum(ends - starts)]
    spaced = np.flatnonzero(b - a != letters[begin + size] - letters[begin] + size - 1)
    for k in spaced.tolist():  # more than one blank somewhere between the words
        digests[k] = xxh64_digest(b" ".join(whole[starts[w] : ends[w]] for w in range(begin[k], begin[k] + size[k])), seed)
    bits = np.unpackbits(np.frombuffer(b"".join(digests), np.uint8).reshape(-1, 8), axis=1)
    ends_at = np.cumsum(counts)
    filled = np.flatnonzero(counts)
    chunk = np.unique(np.concatenate([(ends_at - counts)[filled], np.arange(0, len(row), 255)]))
    sums = np.add.reduceat(bits.view(np.uint64), chunk, axis=0).view(np.uint8)  # eight counters in a word, 255 rows at most
    sums = np.add.reduceat(sums.astype(np.int64), np.searchsorted(chunk, (ends_at - counts)[filled]), axis=0)
    out = np.zeros(rows, np.uint64)
    out[filled] = np.packbits(2 * sums > counts[filled, None], axis=1).view(">u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42) -> DataFrame:
    """``id``, ``fp`` (long): a bit is 1 where over half of the shingles' XXH64 have it."""
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))

    def work(batches):
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(1)):
                fp = step_fingerprints(data, offsets, words, seed)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(fp.view(np.int64))], ["id", "fp"])
            give_back()

    return rows.mapInArrow(work, "id long, fp long")


def trie_join(fps: np.ndarray, groups: np.ndarray, budget: int, leaf: int = 64):
    """Pairs of positions in sorted groups of different fingerprints that differ in at most ``budget`` bits.

    ``fps`` are numbers of 64 bits, or rows of several such.  ``groups`` are
    bounds in ``fps``.  A node is a range of fingerprints with a common prefix.
    Pairs of nodes go down the trie together, carrying the bits in which their
    prefixes differ; a pair over the budget is dropped with all below it, and
    nodes of no more than ``leaf`` pairs are compared leaf by leaf.  Yields index
    arrays.
    """
    fps = fps.reshape(len(fps), -1)
    ones: dict[int, np.ndarray] = {}

    def split(lo, hi, depth):
        if depth not in ones:
            ones[depth] = np.r_[0, np.cumsum((fps[:, depth >> 6] >> np.uint64(63 - depth % 64)) & np.uint64(1))].astype(np.int64)
        return hi - (ones[depth][hi] - ones[depth][lo])

    lo, hi = groups[:-1], groups[1:]
    none = np.zeros(len(lo), np.int64)
    todo = [(0, *part) for part in _parts(lo, hi, lo, hi, none)]
    while todo:
        depth, alo, ahi, blo, bhi, err = todo.pop()
        same = alo == blo
        na, nb = ahi - alo, bhi - blo
        live = (na > 0) & (nb > 0) & ~(same & (na < 2))
        small = live & ((na * nb <= leaf) | (depth == 64 * fps.shape[1]))
        if small.any():
            yield from (_leaves if leaf <= 64 else _dense_leaves)(fps, alo[small], ahi[small], blo[small], bhi[small], budget)
        live &= ~small
        if not live.any():
            continue
        alo, ahi, blo, bhi, err, same = (x[live] for x in (alo, ahi, blo, bhi, err, same))
        am, bm = split(alo, ahi, depth), split(blo, bhi, depth)
        further, other = err < budget, (err < budget) & ~same
        pairs = (
            np.concatenate([alo, am, alo[further], am[other]]), np.concatenate([am, ahi, am[further], ahi[other]]),
            np.concatenate([blo, bm, bm[further], blo[other]]), np.concatenate([bm, bhi, bhi[further], bm[other]]),
            np.concatenate([err, err, err[further] + 1, err[other] + 1]),
        )
        todo += [(depth + 1, *part) for part in _parts(*pairs)]


def _parts(*arrays):
    for k in range(0, len(arrays[0]), FRONTIER):
        yield tuple(x[k : k + FRONTIER] for x in arrays)


def _leaves(fps, alo, ahi, blo, bhi, budget):
    na, nb = ahi - alo, bhi - blo
    step = max(1, 4_000_000 // int((na * nb).max()))
    for k in range(0, len(na), step):
        cell = slice(k, k + step)
        n = na[cell] * nb[cell]
        of = np.repeat(np.arange(len(n)), n)
        i = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
        a, b = alo[cell][of] + i // nb[cell][of], blo[cell][of] + i % nb[cell][of]
        near = (a < b) & (np.bitwise_count(fps[a] ^ fps[b]).sum(axis=1) <= budget)
        if near.any():
            yield a[near], b[near]


def _dense_leaves(fps, alo, ahi, blo, bhi, budget):
    """As :func:`_leaves`, a pair of nodes at a time, for nodes of many fingerprints."""
    for p, q, r, s in zip(alo.tolist(), ahi.tolist(), blo.tolist(), bhi.tolist()):
        a, b = cross_near(fps[p:q], fps[r:s], budget)
        a, b = a + p, b + r
        if len(a):
            yield a[a < b], b[a < b]


def cross_near(left: np.ndarray, right: np.ndarray, budget: int):
    """Positions of the pairs of two arrays of fingerprints [n, words] that differ in at most ``budget`` bits."""
    found, step = [], max(1, 1_000_000 // max(1, len(right)))
    for k in range(0, len(left), step):
        apart = np.zeros((len(left[k : k + step]), len(right)), np.uint16)
        for w in range(left.shape[1]):
            apart += np.bitwise_count(left[k : k + step, w, None] ^ right[None, :, w])
        a, b = np.nonzero(apart <= budget)
        found.append((a + k, b))
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*found) if found else ((), ())))


def agreeing_blocks(n: int, budget: int) -> list[int]:
    """Masks of the bits that must agree: two fingerprints within the budget agree in one of them.

    With ``budget + k`` blocks, at least ``k`` agree.  ``k`` is the least for
    which ``n`` fingerprints spread evenly leave some 64 or fewer in a group.
    """
    k = 1
    while k < 4 and n / 2 ** (64 * k / (budget + k)) > 64:
        k += 1
    edges = [64 * i // (budget + k) for i in range(budget + k + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(chosen) for chosen in combinations(blocks, k)]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def near_links(reps: DataFrame, budget: int, n: int) -> DataFrame:
    """Links ``node``, ``root`` that connect the ids of ``reps`` (``fp``, ``rep``) as all pairs within the budget do.

    Fingerprints that agree in a chosen set of bits meet in a group, sorted,
    which is a trie below those bits.  A group of more than PART fingerprints
    is dealt out as pairs of parts.
    """
    masks = agreeing_blocks(n, budget)
    keys = F.array(*(F.struct(F.lit(i).alias("c"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("v")) for i, m in enumerate(masks)))
    rows = reps.select("fp", "rep", F.explode(keys).alias("key")).select("fp", "rep", "key.c", "key.v")
    large = rows.groupBy("c", "v").count().where(F.col("count") > PART).select("c", "v", F.ceil(F.col("count") / PART).cast("int").alias("parts"))
    rows = rows.join(large, ["c", "v"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    own = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    rows = rows.withColumn("own", own).select("fp", "rep", "c", "v", "own", F.explode(F.expr("sequence(0, parts - 1)")).alias("with"))
    rows = rows.select("fp", "rep", "c", "v", F.least("own", "with").alias("p"), F.greatest("own", "with").alias("q"))
    dealt = rows.repartition("c", "v", "p", "q").sortWithinPartitions("c", "v", "p", "q", F.expr("shiftrightunsigned(fp, 1)"), "fp")

    def work(batches):
        held = None
        for batch in batches:
            part = {k: batch.column(k).to_numpy() for k in batch.schema.names}
            if held is not None:
                part = {k: np.concatenate([held[k], part[k]]) for k in part}
            new = np.flatnonzero(np.any([part[k][1:] != part[k][:-1] for k in ("c", "v", "p", "q")], axis=0)) + 1
            if not len(new):
                held = part
                continue
            yield from _joined(part, np.r_[0, new], budget)
            held = {k: x[new[-1] :] for k, x in part.items()}
        if held is not None and len(held["fp"]):
            yield from _joined(held, np.array([0, len(held["fp"])]), budget)

    return dealt.mapInArrow(work, "node long, root long")


def _joined(part: dict, groups: np.ndarray, budget: int):
    fps, rep = part["fp"].view(np.uint64)[: groups[-1]], part["rep"]
    left = right = np.zeros(0, np.int64)
    for a, b in trie_join(fps, groups, budget):
        left, right = np.concatenate([left, rep[a]]), np.concatenate([right, rep[b]])
        if len(left) > 500_000:
            got = forest_batch(left, right)
            left, right = got.column(0).to_numpy(), got.column(1).to_numpy()
    if len(left):
        yield forest_batch(left, right)


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, budget: int = 4,
) -> DataFrame:
    """Each document with its ``fp`` and ``component_id``, the smallest id reachable over links.

    Two documents are linked when their fingerprints differ in at most
    ``budget`` bits.  Equal fingerprints are one node, whatever their number.
    Texts without words (null, empty, blank) have fingerprint zero and are
    linked like any other; shorter texts than a shingle are one shingle; rows
    with a null id take part but name no component; repeated rows give repeated
    results; an empty table gives an empty result; other columns are ignored.
    """
    prints = cut(fingerprints(docs, id_col, text_col, words, seed))
    reps = cut(prints.groupBy("fp").agg(F.min("id").alias("rep")).where("rep is not null"))
    near = components(near_links(reps, budget, reps.count()))
    named = reps.join(near, F.col("rep") == F.col("node"), "left").select(F.col("fp").alias("of"), F.coalesce("component", "rep").alias("component_id"))
    return prints.join(named, F.col("fp") == F.col("of"), "left").select(F.col("id").alias(id_col), "fp", "component_id")


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 4, seed: int = 42, budget: int = 4,
) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of :func:`near_duplicates`.

    Rows that repeat an id are one document and stay or go together; rows
    without an id cannot be told apart and go.  All columns stay as they are.
    """
    found = near_duplicates(docs, id_col, text_col, words, seed, budget)
    kept = found.where(F.col(id_col) == F.col("component_id")).select(F.col(id_col).alias("__kept")).distinct()
    return docs.join(kept, docs[id_col] == F.col("__kept"), "left_semi")
