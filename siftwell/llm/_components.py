"""Connected components of links, without gathering links or nodes in one place."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._common import cut

#: Parts of the links of a node in the join of a star step: a node may have a third of all links.
SALTS = 16
#: Links that one task unites, after a count; more take rounds over all executors, with the same result.
LOCAL_LINKS = 1_000_000


def local_roots(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, ascending, and the smallest node that each is connected with."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        lx, ly = label[x], label[y]
        apart = lx != ly
        if not apart.any():
            return nodes, nodes[label]
        lx, ly = lx[apart], ly[apart]
        low = np.minimum(lx, ly)
        np.minimum.at(label, lx, low)
        np.minimum.at(label, ly, low)
        while not np.array_equal(nearer := label[label], label):
            label = nearer


def forest_batch(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Links that connect the same nodes: each node with its smallest."""
    nodes, roots = local_roots(a, b)
    keep = nodes != roots
    return pa.RecordBatch.from_arrays([pa.array(nodes[keep], pa.int64()), pa.array(roots[keep], pa.int64())], ["node", "root"])


def _forest(batches):
    a = b = np.zeros(0, np.int64)
    for batch in batches:
        a = np.concatenate([a, batch.column(0).to_numpy()])
        b = np.concatenate([b, batch.column(1).to_numpy()])
        if len(a) > 500_000:  # links never outgrow the nodes seen
            nodes, roots = local_roots(a, b)
            a, b = nodes[nodes != roots], roots[nodes != roots]
    if len(a):
        yield forest_batch(a, b)


def _star(links: DataFrame, by: str) -> DataFrame:
    """Links with the smallest end of their node's links; a node's links are dealt out in SALTS parts."""
    low = links.groupBy(by).agg(F.min("other").alias("low"))
    low = low.select(F.col(by).alias("of"), "low", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("part"))
    salted = links.withColumn("salt", F.pmod(F.xxhash64("other"), F.lit(SALTS)).cast("int"))
    return salted.join(low, (F.col(by) == F.col("of")) & (F.col("salt") == F.col("part")))


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """``node``, ``component`` for links (two long columns): the smallest node reachable.

    Nodes without a link (or linked with themselves alone) have no row.
    Each partition first replaces its links by a spanning forest; what is left is
    united by one task where that is few.  Else this alternates large-star and
    small-star steps, with forests between them.  Every round is written to the
    shared folder.  The rounds grow with the logarithm of the nodes.
    """
    a, b = links.columns
    links = links.select(F.greatest(a, b).cast("long").alias("node"), F.least(a, b).cast("long").alias("root")).where("node > root")
    links, before = cut(links.mapInArrow(_forest, "node long, root long")), None
    if links.limit(LOCAL_LINKS + 1).count() <= LOCAL_LINKS:
        return cut(links.repartition(1).mapInArrow(_forest, "node long, root long")).withColumnRenamed("root", "component")
    for _ in range(most_rounds):
        both = links.select(F.col("node").alias("u"), F.col("root").alias("other")).unionByName(links.select(F.col("root").alias("u"), F.col("node").alias("other")))
        large = _star(both, "u").where("other > u").select(F.col("other").alias("u"), F.least("u", "low").alias("other"))
        # a forest depends on which links share a partition, and the star reads it twice: it is written
        small = _star(cut(large.mapInArrow(_forest, "node long, root long")).toDF("u", "other"), "u")
        own = F.when(F.col("other") == F.col("low"), F.col("u")).otherwise(F.col("other"))
        links = small.select(F.explode(F.array_distinct(F.array(F.struct(own.alias("node"), F.col("low").alias("root")), F.struct(F.col("u").alias("node"), F.col("low").alias("root"))))).alias("x"))
        links = cut(links.select("x.node", "x.root").where("node > root").distinct())
        state = links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("node", "root").cast("decimal(38,0)")), F.lit(0))).head()
        if state == before:
            return links.select("node", F.col("root").alias("component"))
        before = state
    raise RuntimeError(f"components did not settle in {most_rounds} rounds")
