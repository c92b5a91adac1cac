"""The knowledge graph: built from triples, ranked by personalised PageRank, searched."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import normal_phrase
from siftwell.functions.vectors import cosine
from siftwell.operators.near import RECALL, near_pairs
from siftwell.operators.search import DIGITS, _small, dense_search, ranked

SYNONYM = 0.85
DAMPING = 0.5
#: With damping 0.5 a step's L1 change is at most 2 * 0.5**t, below 1e-6 from round 21 on.
ROUNDS = 21
#: Residuals up to this stay where they are.
LEAST_RESIDUAL = 1e-11
#: Directed edges of a graph that is broadcast, after a count.
LOCAL_EDGES = 2_000_000
BLEND = 0.5
SEEDS = 30


def shared_folder(spark) -> str:
    """The checkpoint folder of the cluster; an own folder only where none is set and all runs in one process."""
    if place := spark.conf.get("spark.checkpoint.dir", None):
        return place
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="siftwell-"))
    return jsc.getCheckpointDir().get()


def shared_path(spark, name: str) -> str:
    """A new folder for a table that all executors see."""
    return f"{shared_folder(spark)}/siftwell/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder; later reads start from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def phrases(triples: DataFrame) -> DataFrame:
    """Different normalised subjects and objects."""
    return triples.select(normal_phrase(F.col("subject")).alias("text")).union(triples.select(normal_phrase(F.col("object")).alias("text"))).where("text <> ''").distinct()


def nodes(chunks: DataFrame, triples: DataFrame) -> DataFrame:
    """Passages in their order, then phrases by text: node_id, kind, text, chunk_id.

    Numbers are dense: each key range is counted once, then numbered on its own.
    """
    passages = chunks.select(F.lit("passage").alias("kind"), F.lit(0).alias("part"), F.col("ord").cast("long").alias("ord"), F.lit("").alias("key"), "text", "chunk_id")
    named = phrases(triples).select(F.lit("phrase").alias("kind"), F.lit(1).alias("part"), F.lit(0).cast("long").alias("ord"), F.col("text").alias("key"), "text", F.lit(None).cast("string").alias("chunk_id"))
    return dense_numbers(passages.unionByName(named), ["part", "ord", "key"], "node_id").select("node_id", "kind", "text", "chunk_id")


def dense_numbers(df: DataFrame, by: list[str], name: str) -> DataFrame:
    """Numbers from 0 in a total order, without one task that sorts everything; rows are exchanged and written once."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    place = F.monotonically_increasing_id()  # a partition's number, and below 33 bits the row's place in it
    ordered = settle(df.repartitionByRange(parts, *by).sortWithinPartitions(*by).withColumn("__at", place))
    ordered = ordered.select(*df.columns, F.shiftright("__at", 33).alias("__p"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("__at"))
    sizes = {r["__p"]: r["count"] for r in ordered.groupBy("__p").count().collect()}  # a row for each partition
    base, at = {}, 0
    for p in sorted(sizes):
        base[p], at = at, at + sizes[p]
    if not base:
        return ordered.withColumn(name, F.lit(0).cast("long")).drop("__p", "__at")
    offset = F.create_map(*(F.lit(x) for item in base.items() for x in item))
    return ordered.withColumn(name, (offset[F.col("__p")] + F.col("__at")).cast("long")).drop("__p", "__at")


def edges(chunks_nodes: DataFrame, triples: DataFrame, synonyms: DataFrame | None = None) -> DataFrame:
    """src < dst, kind (relation, appears_in, synonym) and the largest weight; no loops."""
    ids = chunks_nodes.where("kind = 'phrase'").select(F.col("text").alias("phrase"), F.col("node_id").alias("phrase_id"))
    passages = chunks_nodes.where("kind = 'passage'").select("chunk_id", F.col("node_id").alias("passage_id"))
    named = triples.select("chunk_id", normal_phrase(F.col("subject")).alias("s"), normal_phrase(F.col("object")).alias("o"))
    named = named.join(ids.toDF("s", "sid"), "s").join(ids.toDF("o", "oid"), "o")
    relation = named.select(F.col("sid").alias("a"), F.col("oid").alias("b"), F.lit("relation").alias("kind"), F.lit(1.0).alias("weight"))
    placed = named.join(passages, "chunk_id").select("passage_id", F.explode(F.array("sid", "oid")).alias("p"))
    appears = placed.select(F.col("passage_id").alias("a"), F.col("p").alias("b"), F.lit("appears_in").alias("kind"), F.lit(1.0).alias("weight"))
    every = relation.unionByName(appears)
    if synonyms is not None:
        every = every.unionByName(synonyms.select("a", "b", F.lit("synonym").alias("kind"), "weight"))
    return dedupe_edges(every)


def dedupe_edges(every: DataFrame) -> DataFrame:
    pairs = every.where("a <> b").groupBy(F.least("a", "b").alias("src"), F.greatest("a", "b").alias("dst"), "kind")
    return pairs.agg(F.max("weight").alias("weight"))


def synonym_pairs(vectors: DataFrame, least: float = SYNONYM, id_col: str = "node_id", recall: float = RECALL) -> DataFrame:
    """Pairs a < b of phrases with a cosine of at least ``least``, by buckets of projection signs; see :func:`near.near_pairs`."""
    return near_pairs(vectors, least, id_col, "vector", recall)


def build_counts(graph_nodes: DataFrame, graph_edges: DataFrame, triples: DataFrame) -> DataFrame:
    """One row of what a graph was built from: n_passage, n_phrase, n_edges and n_triples."""
    kinds = graph_nodes.agg(F.count_if(F.col("kind") == "passage").alias("n_passage"), F.count_if(F.col("kind") == "phrase").alias("n_phrase"))
    sizes = graph_edges.agg(F.count("*").alias("n_edges")).crossJoin(triples.agg(F.count("*").alias("n_triples")))  # one row each
    return kinds.crossJoin(sizes)


def adjacency(undirected: DataFrame) -> DataFrame:
    """Both directions, parallel edges of all kinds summed: src, dst, weight."""
    both = undirected.select("src", "dst", "weight").unionByName(undirected.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "weight"))
    return both.groupBy("src", "dst").agg(F.sum("weight").alias("weight"))


def pagerank(adj: DataFrame, all_nodes: DataFrame, seeds: DataFrame, damping: float = DAMPING, rounds: int = ROUNDS, least: float = LEAST_RESIDUAL, cut_every: int = 7, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """Personalised PageRank of every query at once, by pushing residuals: query_id, node_id, mass.

    A query's mass starts as the residual of its seeds (at sum 1; uniform over
    all nodes if they have no mass).  A node whose residual is above ``least``
    keeps 1 - d of it and pushes the rest to its neighbours; a node without
    edges pushes it back to the seeds.  It ends when no residual is above
    ``least``, or after ``rounds``; what is left counts where it stands, so that
    masses sum to 1.  After k rounds this is the k-th step of the power method
    but for residuals of at most ``least``: the error is at most
    2 * d**rounds + least * (nodes reached).

    Rows are the nodes that a query reaches.  A graph of up to ``local_edges``
    directed edges, after a count, is broadcast (24 bytes an edge) and each query
    is pushed where its seeds are.  In a larger one nodes that receive the same
    from the same neighbours take part once (see :func:`merged`); if it is still
    too large, its edges stay where they are and meet the residuals by a join,
    with the same result.
    """
    seeds = settle(seeds)  # read several times
    total = seeds.groupBy("query_id").agg(F.sum("mass").alias("all"))
    p = seeds.join(total, "query_id").where("all > 0 and mass > 0").groupBy("query_id", "node_id").agg(F.sum(F.col("mass") / F.col("all")).alias("p"))
    empty = total.where("all <= 0 or all is null").select("query_id")
    if empty.head(1):  # one and the same answer for all queries without a seed
        n = max(1, all_nodes.count())
        one = all_nodes.select(F.lit(0).alias("query_id"), "node_id", F.lit(1.0 / n).alias("mass"))
        shared = pagerank(adj, all_nodes, one, damping, rounds, least, cut_every, local_edges).select("node_id", "mass")
        pushed = _pushed(adj, p, damping, rounds, least, cut_every, local_edges)
        return pushed.unionByName(empty.join(shared, how="cross"))
    return _pushed(adj, p, damping, rounds, least, cut_every, local_edges)


def _pushed(adj: DataFrame, p: DataFrame, damping: float, rounds: int, least: float, cut_every: int, local_edges: int) -> DataFrame:
    adj = settle(adj.select("src", "dst", "weight"))
    few = lambda edges: edges.limit(local_edges + 1).count() <= local_edges
    if few(adj):
        return _push_local(adj, p, damping, rounds, least)
    out = adj.groupBy("src").agg(F.sum("weight").alias("out"))
    step = settle(adj.join(out, "src").select("src", "dst", (F.col("weight") / F.col("out")).alias("share")))
    lone = p.join(out.select("src"), F.col("node_id") == F.col("src"), "left_anti").groupBy("query_id").agg(F.sum("p").alias("lone"))
    p = settle(p.join(lone, "query_id", "left").select("query_id", "node_id", "p", F.coalesce("lone", F.lit(0.0)).alias("lone")))
    step, p, twins = merged(step, p)
    mass = _push_local(step, p, damping, rounds, least) if few(step) else _push_joined(step, p, damping, rounds, least, cut_every)
    if not twins.head(1):
        return mass
    mass = settle(mass)
    copies = twins.join(_small(mass.withColumnRenamed("node_id", "own")), "own").select("query_id", "node_id", "mass")
    return mass.unionByName(copies)


def merged(step: DataFrame, p: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The steps and seeds without nodes that are always equal to another, and these: ``node_id`` and ``own``, the node that stands for it.

    Nodes that receive the same shares from the same neighbours, and are the same
    seeds of the same queries, have the same mass in every round: the smallest of
    them stays and hands on the shares of all.  They are found by 128 bits of
    hashes over their rows, so that no node's neighbours meet in one place.
    """
    received = step.select(F.col("dst").alias("node_id"), F.lit(1).alias("of"), F.xxhash64("src", "share").alias("a"), F.xxhash64(F.lit("b"), "src", "share").alias("b"))
    seeded = p.select("node_id", F.lit(0).alias("of"), F.xxhash64(F.lit("p"), "query_id", "p").alias("a"), F.xxhash64(F.lit("q"), "query_id", "p").alias("b"))
    signs = received.unionByName(seeded).groupBy("node_id").agg(F.sum("of").alias("n"), F.bit_xor("a").alias("a"), F.bit_xor("b").alias("b"))
    signs = settle(signs.where("n > 0"))  # a seed without edges stays for itself
    shared = settle(signs.groupBy("n", "a", "b").agg(F.min("node_id").alias("own"), F.count("*").alias("times")).where("times > 1").drop("times"))
    twins = settle(signs.join(_small(shared), ["n", "a", "b"]).where("node_id <> own").select("node_id", "own"))
    kept = step.join(twins.select(F.col("node_id").alias("dst")), "dst", "left_anti")
    kept = kept.join(twins.toDF("src", "own"), "src", "left").groupBy(F.coalesce("own", "src").alias("src"), "dst").agg(F.sum("share").alias("share"))
    return settle(kept), settle(p.join(twins, "node_id", "left_anti").select(*p.columns)), twins


def push(ptr: np.ndarray, dst: np.ndarray, share: np.ndarray, p: np.ndarray, damping: float, rounds: int, least: float) -> np.ndarray:
    """The masses of one query over a graph in rows of neighbours; positions after the last row have no edges."""
    n, kept, residual = len(ptr) - 1, np.zeros(len(p)), p.copy()
    for _ in range(rounds):
        front = np.flatnonzero(residual > least)
        if not len(front):
            break
        mass = residual[front]
        kept[front] += (1 - damping) * mass
        residual[front] = 0
        inside = front < n
        own = front[inside]
        size = ptr[own + 1] - ptr[own]
        edge = np.repeat(ptr[own] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        residual += np.bincount(dst[edge], np.repeat(damping * mass[inside], size) * share[edge], minlength=len(p))
        if not inside.all():
            residual += damping * mass[~inside].sum() * p
    return kept + residual


def _push_local(adj: DataFrame, p: DataFrame, damping: float, rounds: int, least: float) -> DataFrame:
    edges = adj.toArrow()  # local_edges rows at most
    names, at = np.unique(np.concatenate([edges.column(c).to_numpy() for c in ("src", "dst")]), return_inverse=True)
    told = "share" in adj.columns
    src, dst, weight = at[: edges.num_rows], at[edges.num_rows :], edges.column("share" if told else "weight").to_numpy().astype(float)
    order = np.argsort(src, kind="stable")
    src, dst, weight = src[order], dst[order], weight[order]
    share = weight if told else weight / np.bincount(src, weight, minlength=len(names))[src]
    shared = adj.sparkSession.sparkContext.broadcast((names, np.searchsorted(src, np.arange(len(names) + 1)), dst, share))

    def work(group: pa.Table) -> pa.Table:
        names, ptr, dst, share = shared.value
        node, mass = group.column("node_id").to_numpy(), group.column("p").to_numpy()
        place = np.minimum(np.searchsorted(names, node), max(0, len(names) - 1))
        lone = names[place] != node if len(names) else np.ones(len(node), bool)
        place[lone] = len(names) + np.arange(int(lone.sum()))
        start = np.zeros(len(names) + int(lone.sum()))
        start[place] = mass
        found = push(ptr, dst, share, start, damping, rounds, least)
        some = np.flatnonzero(found)
        every = np.concatenate([names, node[lone]]) if lone.any() else names
        return pa.table({"query_id": pa.array([group.column("query_id")[0].as_py()] * len(some), group.schema.field("query_id").type), "node_id": pa.array(every[some], group.schema.field("node_id").type), "mass": found[some]})

    kind = {c: p.schema[c].dataType.simpleString() for c in ("query_id", "node_id")}
    return p.select("query_id", "node_id", "p").groupBy("query_id").applyInArrow(work, f"query_id {kind['query_id']}, node_id {kind['node_id']}, mass double")


def _push_joined(step: DataFrame, p: DataFrame, damping: float, rounds: int, least: float, cut_every: int) -> DataFrame:
    x = p.select("query_id", "node_id", F.lit(0.0).alias("kept"), F.col("p").alias("residual"))
    for k in range(1, rounds + 1):
        above = F.col("residual") > least
        spread = x.where(above).join(step, F.col("node_id") == F.col("src")).select("query_id", F.col("dst").alias("node_id"), F.lit(0.0).alias("kept"), (damping * F.col("residual") * F.col("share")).alias("residual"))
        stay = x.select("query_id", "node_id", F.when(above, F.col("kept") + (1 - damping) * F.col("residual")).otherwise(F.col("kept")).alias("kept"), F.when(above, 0.0).otherwise(F.col("residual")).alias("residual"))
        back = F.pow(damping * F.col("lone"), k)  # what nodes without edges return: the seeds' share of it, round after round
        seeds = p.where("lone > 0").select("query_id", "node_id", F.lit(0.0).alias("kept"), (back * F.col("p")).alias("residual"))
        x = spread.unionByName(stay).unionByName(seeds).groupBy("query_id", "node_id").agg(F.sum("kept").alias("kept"), F.sum("residual").alias("residual"))
        if k % cut_every == 0:
            x = settle(x)
            if not x.where(F.col("residual") > least).head(1):
                break
    return x.select("query_id", "node_id", (F.col("kept") + F.col("residual")).alias("mass")).where("mass > 0")


def seeds_of(queries: DataFrame, node_vectors: DataFrame, most: int = SEEDS, recognised: DataFrame | None = None) -> DataFrame:
    """Up to ``most`` nodes with a positive cosine as seeds; if there is none, the best node with mass 1.

    ``recognised`` (query_id, text) keeps only phrase seeds that it names; if no
    phrase would be left, all seeds stay.
    """
    found = dense_search(queries, node_vectors.select(F.col("node_id").alias("chunk_id"), "vector"), most)
    found = found.select("query_id", F.col("chunk_id").cast("long").alias("node_id"), "score", "rank")
    any_positive = F.max("score").over(Window.partitionBy("query_id")) > 0
    near = found.withColumn("any", any_positive).where((F.col("any") & (F.col("score") > 0)) | (~F.col("any") & (F.col("rank") == 1)))
    near = near.select("query_id", "node_id", F.when(F.col("any"), F.col("score")).otherwise(1.0).alias("mass"))
    if recognised is None:
        return near
    text = F.when(F.col("kind") == "phrase", F.col("text")).alias("text")  # those of passages are not exchanged
    named = near.join(node_vectors.select("node_id", "kind", text), "node_id")
    wanted = recognised.select("query_id", normal_phrase(F.col("text")).alias("text"), F.lit(True).alias("yes")).distinct()
    marked = named.join(wanted, ["query_id", "text"], "left").withColumn("hit", F.col("yes").isNotNull() & (F.col("kind") == "phrase"))
    some = F.max("hit").over(Window.partitionBy("query_id"))
    return marked.withColumn("some", some).where(~F.col("some") | F.col("hit") | (F.col("kind") == "passage")).select("query_id", "node_id", "mass")


def graph_search(queries: DataFrame, node_vectors: DataFrame, undirected: DataFrame, k: int, blend: float = BLEND, recognised: DataFrame | None = None) -> DataFrame:
    """Passages by ``blend`` of their PageRank and the rest of their cosine: chunk_id, score, rank, source graph."""
    mass = pagerank(adjacency(undirected), node_vectors, seeds_of(queries, node_vectors, recognised=recognised))
    passages = node_vectors.where("kind = 'passage'").select("node_id", "chunk_id", "vector")
    # masses are queries x nodes, which their size as estimated from the seeds does not tell: never to be broadcast
    reached = mass.join(passages.hint("shuffle_hash"), "node_id").join(queries.select("query_id", F.col("vector").alias("asked")), "query_id")
    reached = reached.select("query_id", "chunk_id", "mass", F.round(cosine(F.col("asked"), F.col("vector")), DIGITS).alias("near"))
    # a passage without mass is among the best k only if it is among the k nearest
    near = dense_search(queries, passages.select("chunk_id", "vector"), k).select("query_id", "chunk_id", F.lit(0.0).alias("mass"), F.col("score").alias("near"))
    scored = reached.unionByName(near).groupBy("query_id", "chunk_id").agg(F.max("mass").alias("mass"), F.max("near").alias("near"))
    score = F.round(blend * F.col("mass") + (1 - blend) * F.col("near"), DIGITS)
    return ranked(scored.select("query_id", "chunk_id", score.alias("score"), F.lit("graph").alias("source")), k)

