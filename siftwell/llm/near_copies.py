"""Near copies by SimHash: documents whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

The same trie join as in ``simhash``, over wider fingerprints and with a wider
error budget: two sets of similarity 0.8 differ in about 15 of 100 bits of their
fingerprints.  Fingerprints that agree in a chosen set of bits meet in a trie;
what the join links is only a candidate group, and a group's documents are
verified by their whole sets before they are united.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._common import LOWER, byte_class, cut, give_back, grouped, mix, pick, small, span_hashes, stash, text_steps, word_spans
from siftwell.llm._components import components, forest_batch, local_roots
from siftwell.llm.simhash import cross_near, trie_join

WORDS, SIMILARITY = 5, 0.8
#: Bits of a fingerprint, in words of 64.
FP_WORDS = 2
#: Chance that a pair just at the threshold never agrees in a chosen set of bits.
MISS = 0.005
#: Fingerprints that evenly spread ones leave in a trie.
GROUP = 512
#: Standard deviations above the expected number of differing bits that the budget allows.
SLACK = 3.5
#: Fingerprints of a part of a large trie; sets and set bytes of a part of a large candidate group.
PART, SETS, SET_BYTES = 2048, 2048, 16_000_000
#: A trie's size is estimated from one fingerprint in so many; it decides only how the trie is dealt out.
ESTIMATE = 16

_SPACES = byte_class((0x09, 0x0D), (0x20, 0x20))
_OTHER = np.uint64(0xC2B2AE3D27D4EB4F)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each row of a step as ascending hashes, and their number a row.

    Words are maximal runs without ASCII white space, ASCII letters in lower
    case; a text of fewer words is one shingle, one without words has none.
    """
    rows = len(offsets) - 1
    data = LOWER[data]
    starts, ends, of = word_spans(data, offsets, ~_SPACES)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(rows, np.int64)
    word = span_hashes(data, starts, ends)
    per_row = np.bincount(of, minlength=rows)
    counts = np.where(per_row >= words, per_row - words + 1, np.minimum(per_row, 1))
    row = np.repeat(np.arange(rows), counts)
    begin = (np.cumsum(per_row) - per_row)[row] + np.arange(len(row)) - (np.cumsum(counts) - counts)[row]
    size = np.minimum(per_row[row], words)
    h = np.zeros(len(row), np.uint64)
    for k in range(words):
        inside = size > k
        h[inside] = mix(h[inside] * _OTHER + word[begin[inside] + k])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.r_[True, (h[1:] != h[:-1]) | (row[1:] != row[:-1])]
    return h[new], np.bincount(row[new], minlength=rows)


def set_fingerprints(h: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """[row, word]: a bit is 1 where over half of the set's shingles have it."""
    row = np.repeat(np.arange(len(counts)), counts)
    sums = np.zeros((len(counts), 64 * FP_WORDS), np.int32)
    for a in range(0, len(h), 60_000):
        part, of = h[a : a + 60_000], row[a : a + 60_000]
        first = np.unique(np.r_[0, np.flatnonzero(of[1:] != of[:-1]) + 1, np.arange(0, len(of), 255)])
        for w in range(FP_WORDS):
            bits = np.unpackbits(mix(part ^ np.uint64(w + 1)).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
            few = np.add.reduceat(bits.view(np.uint64), first, axis=0).view(np.uint8)  # eight counters in a word, 255 rows at most
            edge = np.flatnonzero(np.r_[True, of[first][1:] != of[first][:-1]])
            sums[of[first[edge]], 64 * w : 64 * w + 64] += np.add.reduceat(few.astype(np.int32), edge, axis=0)
    return np.packbits(2 * sums > counts[:, None], axis=1).view(">u8").astype(np.uint64).reshape(-1, FP_WORDS)


def _digests(h: np.ndarray, counts: np.ndarray) -> pa.Array:
    """16 bytes for each set."""
    out = np.zeros((len(counts), 2), np.uint64)
    filled = np.flatnonzero(counts)
    if len(filled):
        at = (np.cumsum(counts) - counts)[filled]
        out[filled, 0], out[filled, 1] = np.add.reduceat(mix(h), at), np.add.reduceat(mix(h ^ _OTHER), at)
    ends = np.arange(0, 16 * len(counts) + 1, 16, dtype=np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(ends), pa.py_buffer(out.tobytes())])


_FPS = [f"f{w}" for w in range(FP_WORDS)]


def _sketches(rows: DataFrame, words: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for a, b, data, offsets in text_steps(batch.column(1)):
                h, counts = shingle_sets(data, offsets, words)
                fps = set_fingerprints(h, counts).view(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], _digests(h, counts), pa.array(counts, pa.int64()), *(pa.array(x) for x in fps.T)], ["id", "key", "n", *_FPS])
            give_back()

    return rows.mapInArrow(work, f"id long, key binary, n long, {', '.join(f'{f} long' for f in _FPS)}")


# ---- candidate groups


def masks_for(n: int, similarity: float) -> tuple[int, np.ndarray]:
    """The error budget, and the sets of bits [mask, word] in which some two fingerprints agree with the chance 1 - MISS.

    Two sets of similarity s have the cosine 2s / (1 + s), and a bit differs
    with the chance angle / pi.  So many bits are chosen that ``n`` evenly spread
    fingerprints leave some GROUP in a trie.
    """
    width, differ = 64 * FP_WORDS, math.acos(2 * similarity / (1 + similarity)) / math.pi
    budget = math.ceil(width * differ + SLACK * math.sqrt(width * differ * (1 - differ)))
    bits = max(0, math.ceil(math.log2(max(1, n) / GROUP)))
    count = 1 if not bits else math.ceil(math.log(MISS) / math.log(1 - (1 - differ) ** bits))
    law, out = np.random.default_rng([5, bits]), np.zeros((count, FP_WORDS), np.uint64)
    for mask in out:
        for bit in law.choice(width, bits, replace=False).tolist():
            mask[bit >> 6] |= np.uint64(1 << (bit & 63))
    return budget, out


def candidate_links(reps: DataFrame, similarity: float) -> DataFrame:
    """Links ``node``, ``root`` that connect the nodes of ``reps`` whose fingerprints may belong to similar sets.

    A large trie is dealt out in parts.  What lies within the budget of one of
    its fingerprints is linked with that at once and takes no further part among
    its like; only what does not is compared with every part, so that a dense
    group of any size costs no squares.
    """
    budget, masks = masks_for(reps.count(), similarity)
    keys = F.array(*(F.xxhash64(F.lit(c), *(F.col(f).bitwiseAND(F.lit(int(m.view(np.int64)))) for f, m in zip(_FPS, mask))) for c, mask in enumerate(masks)))
    rows = reps.select("node", *_FPS, F.explode(keys).alias("v"))

    def apart(left: str, right: str) -> F.Column:
        return sum((F.bit_count(F.col(f"{left}{f}").bitwiseXOR(F.col(f"{right}{f}"))) for f in _FPS), F.lit(0))

    some = rows.where(F.pmod(F.xxhash64("node", F.lit(3)), F.lit(ESTIMATE)) == 0)
    pivots = some.groupBy("v").agg(F.min(F.struct(F.xxhash64("node", "v").alias("h"), "node", *_FPS)).alias("p"), F.count("*").alias("m")).where(F.col("m") * ESTIMATE > PART)
    pivots = pivots.select(F.col("v").alias("large"), F.col("p.node").alias("pivot"), *(F.col(f"p.{f}").alias(f"p{f}") for f in _FPS), F.col("m"))
    odd = some.join(pivots, F.col("v") == F.col("large")).groupBy("large").agg(F.sum((apart("", "p") > budget).cast("long")).alias("odd"))
    parts = [F.greatest(F.lit(1), F.ceil(F.col(c) * ESTIMATE / PART)).cast("int").alias(f"{c}_parts") for c in ("m", "odd")]
    pivots = small(pivots.join(odd.withColumnRenamed("large", "of"), F.col("large") == F.col("of")).select("large", "pivot", *(f"p{f}" for f in _FPS), *parts))
    known = rows.join(pivots, F.col("v") == F.col("large"), "left")
    away = F.col("large").isNotNull() & (apart("", "p") > budget)
    near = known.where(F.col("large").isNotNull() & ~away & (F.col("node") != F.col("pivot")))
    near = near.select(F.greatest("node", "pivot").alias("node"), F.least("node", "pivot").alias("root"))
    own = [F.pmod(F.xxhash64("node", F.lit(k)), F.coalesce(F.col(f"{c}_parts"), F.lit(1))).cast("int") for k, c in enumerate(("m", "odd"))]
    known = known.select("node", *_FPS, "v", F.col("large").isNotNull().alias("parted"), own[0].alias("own"), own[1].alias("own_odd"), away.alias("away"), *(F.coalesce(f"{c}_parts", F.lit(1)).alias(f"{c}_parts") for c in ("m", "odd")))
    every = F.transform(F.sequence(F.lit(0), F.col("odd_parts") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks")))
    asks = F.transform(F.sequence(F.lit(0), F.col("m_parts") - 1), lambda j: F.struct(F.col("own_odd").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
    dealt = known.withColumn("to", F.explode(F.when(F.col("away"), F.concat(every, asks)).otherwise(every))).select("v", "to.i", "to.j", "parted", "to.asks", "node", *_FPS)
    order = [F.expr(f"shiftrightunsigned({f}, 1)") for f in _FPS]
    dealt = dealt.repartition("v", "i", "j").sortWithinPartitions("v", "i", "j", *(x for f, o in zip(_FPS, order) for x in (o, f)))

    def joined(part, bounds):
        fps = np.stack([part[f].view(np.uint64)[: bounds[-1]] for f in _FPS], axis=1)
        node, left, right, size = part["node"], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
        parted = part["parted"][bounds[:-1]]
        for lo, hi in zip(bounds[:-1][parted].tolist(), bounds[1:][parted].tolist()):
            asking = part["asks"][lo:hi]
            a, b = np.flatnonzero(asking) + lo, np.flatnonzero(~asking) + lo
            i, j = cross_near(fps[a], fps[b], budget)
            left.append(node[a[i]])
            right.append(node[b[j]])
        for k in np.flatnonzero(~parted).tolist():
            if bounds[k + 1] - bounds[k] > 1:
                for a, b in trie_join(fps[bounds[k] : bounds[k + 1]], np.array([0, bounds[k + 1] - bounds[k]]), budget, leaf=1 << 18):
                    left.append(node[a + bounds[k]])
                    right.append(node[b + bounds[k]])
                    size += len(a)
                    if size > 500_000:
                        got = local_roots(np.concatenate(left), np.concatenate(right))
                        left, right, size = [got[0]], [got[1]], 0
        left, right = np.concatenate(left), np.concatenate(right)
        if len(left):
            yield forest_batch(left, right)

    def work(batches):
        for part, bounds in grouped(batches, ("v", "i", "j")):
            yield from joined(part, bounds)

    return dealt.mapInArrow(work, "node long, root long").unionByName(near)


# ---- verification


def similar_links(sets: list[np.ndarray], comp: np.ndarray, ask: np.ndarray, similarity: float) -> tuple[list[int], list[int]]:
    """Positions of pairs of similar sets that unite all sets that similarity unites.

    ``comp``: sets of the same number are united already.  ``ask``: sets that are
    compared with all others; two that do not ask are not compared.  Pairs in one
    component are left out; so is all that remains once there is one component.
    """
    _, comp = np.unique(comp, return_inverse=True)
    sizes = np.array([len(s) for s in sets])
    left, right = [], []
    if len(sets) == 2:
        if comp[0] != comp[1] and ask.any() and sizes.min() >= similarity * sizes.max() - 1e-9:
            common = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
            if common >= similarity * (sizes.sum() - common) - 1e-9:
                return [0], [1]
        return left, right
    values, number = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    by = np.argsort(number, kind="stable")
    owner, edge = owner[by], np.searchsorted(number[by], np.arange(len(values) + 1))
    bounds = np.r_[0, np.cumsum(sizes)]
    todo, all_ask = ask.copy(), ask.all()
    while True:
        most = np.bincount(comp)
        # where all ask, every pair across components has an end outside the largest
        waits = np.flatnonzero(todo & (comp != most.argmax()) if all_ask else todo)
        if not len(waits) or (most > 0).sum() == 1:
            return left, right
        i = int(waits[0])
        todo[i] = False
        terms = number[bounds[i] : bounds[i + 1]]
        n = edge[terms + 1] - edge[terms]
        where = np.repeat(edge[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        common = np.bincount(owner[where], minlength=len(sets))
        near = (common >= similarity * (sizes + sizes[i] - common) - 1e-9) & (comp != comp[i]) & (sizes + sizes[i] > 0)
        for j in np.flatnonzero(near).tolist():
            if comp[j] != comp[i]:
                left.append(i)
                right.append(j)
                comp[comp == comp[j]] = comp[i]


def _sets(rows: DataFrame, words: int) -> DataFrame:
    def work(batches):
        for batch in batches:
            for _, _, data, offsets in text_steps(batch.column(1)):
                h, counts = shingle_sets(data, offsets, words)
                ends, whole = np.r_[0, np.cumsum(counts)] * 8, h.tobytes()
                yield pa.RecordBatch.from_arrays([_digests(h, counts), pa.array([whole[x:y] for x, y in zip(ends[:-1], ends[1:])], pa.binary())], ["key", "set"])
            give_back()

    return rows.mapInArrow(work, "key binary, set binary")


_LINK = "a long, b long, rep_a long, rep_b long"


def _verified(dealt: DataFrame, similarity: float) -> DataFrame:
    """Verified links of the rows ``cluster``, ``i``, ``j``, ``comp``, ``asks``, ``node``, ``rep``, ``set`` that share the first three."""
    dealt = dealt.repartition("cluster", "i", "j").sortWithinPartitions("cluster", "i", "j", "node", F.desc("asks"))

    def links(part, bounds):
        out = []
        for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
            pick = np.arange(lo, hi)[np.r_[True, part["node"][lo + 1 : hi] != part["node"][lo : hi - 1]]]  # a repeated id has its set once
            if len(pick) > 1:
                sets = [np.frombuffer(part["set"][k], np.uint64) for k in pick.tolist()]
                i, j = similar_links(sets, part["comp"][pick], part["asks"][pick], similarity)
                out += zip(pick[i].tolist(), pick[j].tolist()) if i else []
        if out:
            i, j = np.array(out).T
            yield pa.RecordBatch.from_arrays([pa.array(part[c][k], pa.int64()) for c, k in (("node", i), ("node", j), ("rep", i), ("rep", j))], ["a", "b", "rep_a", "rep_b"])

    def work(batches):
        for part, bounds in grouped((b.slice(k, 256) for b in batches for k in range(0, b.num_rows, 256)), ("cluster", "i", "j")):
            yield from links(part, bounds)
            give_back()

    return dealt.mapInArrow(work, _LINK)


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
) -> DataFrame:
    """``rep``, ``component``: the smallest id of each different text, and the smallest reachable over verified links.

    Equal sets are one node, whatever their number; texts without words are
    alike.  A link is a pair within a candidate group whose whole sets have the
    similarity; a group is what the trie join connects.  The parts of a large
    group are compared within themselves and with one set of the group; after
    that, what its largest component does not hold is compared with every part.
    Rows with a null id name no component.
    """
    rows = pick(docs, id=id_col, text=text_col).withColumn("id", F.col("id").cast("long"))
    reps = _sketches(rows, words).groupBy("key").agg(F.min("id").alias("rep"), F.first("n").alias("n"), *(F.first(f).alias(f) for f in _FPS))
    reps = cut(reps.where("rep is not null").withColumn("node", F.monotonically_increasing_id()))
    groups = components(candidate_links(reps.select("node", *_FPS), similarity)).select(F.col("node").alias("of"), "component")
    groups = groups.unionByName(groups.select(F.col("component").alias("of"), "component").distinct())
    found = reps.join(groups, F.col("node") == F.col("of")).select("node", "key", "rep", "n", F.col("component").alias("cluster"))
    size = found.groupBy("cluster").agg(F.count("*").alias("m"), F.sum("n").alias("bytes"), F.min(F.struct(F.xxhash64("node").alias("h"), "node")).alias("p"))
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / SETS), F.ceil(F.col("bytes") * 8 / SET_BYTES)).cast("int")
    size = small(size.select(F.col("cluster").alias("of"), parts.alias("parts"), F.col("p.node").alias("pivot")).where("parts > 1"))  # a large group's rows stay where they are
    found = found.join(size, F.col("cluster") == F.col("of"), "left").drop("of")
    found = cut(found.withColumns({"parts": F.coalesce("parts", F.lit(1)), "pivot": F.coalesce("pivot", F.lit(-1))}))

    def with_sets(nodes: DataFrame) -> DataFrame:
        wanted = small(nodes)
        texts = rows.join(small(nodes.select(F.col("rep").alias("id")).distinct()), "id", "left_semi")
        return _sets(texts.select("id", "text"), words).join(wanted, "key")

    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    to = F.when(F.col("node") == F.col("pivot"), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(own))
    first = with_sets(found.select("key", "node", "rep", "cluster", F.col("node").alias("comp"), to.alias("to")))
    first = first.select("cluster", F.explode("to").alias("i"), F.lit(0).alias("j"), "comp", F.lit(True).alias("asks"), "node", "rep", "set")
    links = cut(_verified(first, similarity))
    parted = cut(found.where("parts > 1"))
    if parted.head(1):
        labels = components(links.select("a", "b")).withColumnRenamed("node", "of")
        parted = parted.join(labels, F.col("node") == F.col("of"), "left").drop("of").withColumn("comp", F.coalesce("component", "node"))
        held = parted.groupBy("cluster", "comp").agg(F.count("*").alias("m"), F.sum("n").alias("bytes"))
        largest = held.groupBy("cluster").agg(F.max(F.struct("m", "comp", "bytes")).alias("x"), F.sum("m").alias("m"), F.sum("bytes").alias("bytes"))
        odd = F.greatest(F.lit(1), F.ceil((F.col("m") - F.col("x.m")) / SETS), F.ceil((F.col("bytes") - F.col("x.bytes")) * 8 / SET_BYTES)).cast("int")
        largest = largest.where("m > x.m").select(F.col("cluster").alias("of"), F.col("x.comp").alias("main"), odd.alias("odd_parts"))
        rest = parted.join(small(largest), F.col("cluster") == F.col("of")).withColumn("own", own).withColumn("own_odd", F.pmod(F.xxhash64("node", F.lit(1)), F.col("odd_parts")).cast("int"))
        every = F.transform(F.sequence(F.lit(0), F.col("odd_parts") - 1), lambda i: F.struct(i.alias("i"), F.col("own").alias("j"), F.lit(False).alias("asks")))
        asks = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(F.col("own_odd").alias("i"), j.alias("j"), F.lit(True).alias("asks")))
        rest = with_sets(rest.select("key", "node", "rep", "cluster", "comp", F.when(F.col("comp") == F.col("main"), every).otherwise(F.concat(every, asks)).alias("to")))
        rest = rest.withColumn("to", F.explode("to")).select("cluster", "to.i", "to.j", "comp", "to.asks", "node", "rep", "set")
        links = links.unionByName(_verified(rest, similarity))
    united = components(links.select("rep_a", "rep_b"))
    return reps.select("rep").distinct().join(united, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"))


def drop_near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, similarity: float = SIMILARITY,
) -> DataFrame:
    """``docs`` with one document, that of the smallest id, of each group of :func:`near_copies`.

    Rows that repeat an id are one document and stay or go together.  Rows
    without an id are documents of their own, after all others: where there are
    any, the rows are numbered and written first.  All columns stay as they are.
    """
    if docs.where(docs[id_col].isNull()).head(1):
        number = next(f"row{k}" for k in range(len(docs.columns) + 1) if f"row{k}" not in docs.columns)
        last = F.lit(2**63 - 1) - F.monotonically_increasing_id()
        numbered = stash(docs.withColumn(number, F.coalesce(docs[id_col].cast("long"), last)), "numbered")
        return drop_near_copies(numbered, number, text_col, words, similarity).drop(number)
    kept = near_copies(docs, id_col, text_col, words, similarity).where("rep = component").select("rep")
    ids = pick(docs, __gone=id_col).where("__gone is not null").distinct()
    gone = small(ids.join(kept, F.col("__gone") == F.col("rep"), "left_anti"))
    return docs.join(gone, docs[id_col] == F.col("__gone"), "left_anti")
