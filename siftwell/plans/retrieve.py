"""One retrieval plan from a configuration."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.functions.text import approx_tokens
from siftwell.functions.vectors import blend, hash_embedding
from siftwell.operators.graph import graph_search, settle
from siftwell.operators.search import DIGITS, Bm25Index, _small, dense_search, rerank, rrf, text_tasks
from siftwell.plans.config import PipelineConfig
from siftwell.plans.providers import Budget, provided


class Unavailable(RuntimeError):
    """A component that cannot answer now; the plan goes on without it."""


@dataclass
class Indexes:
    """What a corpus has been turned into; parts may be missing."""

    chunks: DataFrame
    bm25: Bm25Index | None = None
    vectors: DataFrame | None = None
    node_vectors: DataFrame | None = None
    edges: DataFrame | None = None


def embed_chunks(chunks: DataFrame, embed: Callable | None = None, budget: Budget = Budget(), **options) -> DataFrame:
    """chunk_id with its ``isolated`` and its ``contextual`` vector (0.8 parts chunk, the rest its document).

    ``embed``: a model's call over documents (lists of texts) that returns a
    vector for each text, given whole documents for the contextual and single
    chunks for the isolated vectors.  A document larger than ``budget`` has to be
    split before; then, as for any other failure, its vectors are null.
    """
    if embed is not None:
        return _embedded(chunks, embed, budget, options)
    joined = F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x.text))
    # as for counts of terms, tasks follow from the bytes of the texts, for those of a task are held at once
    document = chunks.select("doc_id", "position", "text").repartition(text_tasks(chunks), "doc_id").groupBy("doc_id").agg(joined.alias("whole")).select("doc_id", hash_embedding(F.col("whole")).alias("of_document"))
    rows = chunks.select("chunk_id", "doc_id", hash_embedding(F.col("text")).alias("isolated")).join(document, "doc_id")
    return rows.select("chunk_id", "isolated", blend(F.col("isolated"), F.col("of_document"), 0.8).alias("contextual"))


def _embedded(chunks: DataFrame, embed: Callable, budget: Budget, options: dict) -> DataFrame:
    kind, fits = "array<array<double>>", lambda texts, vectors: len(texts) == len(vectors)
    sizes = F.transform("texts", approx_tokens)
    whole = chunks.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("position", "chunk_id", "text"))).alias("c"))
    whole = whole.select(F.transform("c", lambda x: x.chunk_id).alias("ids"), F.transform("c", lambda x: x.text).alias("texts"))
    together = provided(whole, embed, ["texts"], kind, ["ids"], sizes, budget, fits, **options)
    together = together.select(F.explode(F.arrays_zip("ids", F.coalesce("value", F.expr("transform(ids, x -> cast(null as array<double>))")).alias("v"))).alias("x")).select(F.col("x.ids").alias("chunk_id"), F.col("x.v").alias("contextual"))
    alone = provided(chunks.select("chunk_id", F.array("text").alias("texts")), embed, ["texts"], kind, ["chunk_id"], sizes, budget, fits, **options)
    return alone.select("chunk_id", F.get("value", F.lit(0)).alias("isolated")).join(together, "chunk_id")


def check(config: PipelineConfig, indexes: Indexes) -> None:
    q = config.query
    if not (q.bm25 or q.dense or q.graph):
        raise ValueError("a configuration needs a retriever")
    for flag, part in ((q.bm25, indexes.bm25), (q.dense, indexes.vectors), (q.graph, indexes.edges)):
        if flag and part is None:
            raise ValueError(f"{config.name}: the index of an enabled retriever is missing")


def retrieve(queries: DataFrame, indexes: Indexes, config: PipelineConfig, score=None, recognised: DataFrame | None = None, failing: frozenset = frozenset()) -> tuple[DataFrame, list[str]]:
    """Ranked rows of all queries, and what was left out (``graph-skipped``, ``dense-skipped``, ``rerank-skipped``).

    One retriever alone keeps its label; several are fused.  ``failing`` names
    components known to be unavailable; each is skipped for itself, and only
    when no retriever is left is there no plan.
    """
    check(config, indexes)
    q, degraded, lists = config.query, [], []
    vectors = indexes.vectors
    column = "contextual" if q.contextual else "isolated"
    asked = queries.withColumn("vector", hash_embedding(F.coalesce("query", F.lit("")))) if "vector" not in queries.columns else queries
    parts = (
        ("bm25", q.bm25, lambda: indexes.bm25.search(queries, q.top_k_fuse)),
        ("dense", q.dense, lambda: dense_search(asked, vectors.select("chunk_id", F.col(column).alias("vector")), q.top_k_fuse)),
        ("graph", q.graph, lambda: graph_search(asked, indexes.node_vectors, indexes.edges, q.top_k_fuse, recognised=recognised)),
    )
    for name, wanted, plan in parts:
        if not wanted:
            continue
        try:
            if name in failing:
                raise Unavailable(name)
            lists.append(plan())
        except Unavailable:
            degraded.append(f"{name}-skipped")
    if not lists:
        raise Unavailable("no retriever is left")
    candidates = lists[0] if len(lists) == 1 else rrf(lists)
    if q.rerank and "rerank" not in failing:
        options = {} if score is None else {"score": score}
        return rerank(candidates, queries, indexes.chunks, q.top_k_final, **options), degraded
    if q.rerank:
        degraded.append("rerank-skipped")
    return candidates.where(F.col("rank") <= q.top_k_final), degraded


@dataclass(frozen=True)
class Steps:
    """Models of a retrieval plan, as calls over lists (see ``providers.provided``); None is the offline rule, which cannot fail.

    ``embed``: questions to vectors.  ``rank``: (question, texts) to the texts'
    scores.  ``recognise``: questions to lists of phrases.
    """

    embed: Callable | None = None
    rank: Callable | None = None
    recognise: Callable | None = None
    budget: Budget = field(default_factory=Budget)
    rank_budget: Budget = field(default_factory=lambda: Budget(tokens=2**40, rows=1, part_tokens=2**40))
    options: dict = field(default_factory=dict)

    def __bool__(self) -> bool:
        return any((self.embed, self.rank, self.recognise))


@dataclass
class Found:
    """Ranked rows; of every query what was left out, whether nothing was left, and why; and what its models took."""

    rows: DataFrame
    told: DataFrame
    events: DataFrame


EVENTS = "query_id string, node string, model string, input_tokens long, output_tokens long, units int, duration_ms double"


def spent(asked: DataFrame, node: str, model: str, units: int = 0, least_tokens: int = 0) -> DataFrame:
    """What a model took for each row that went well; ``least_tokens`` where it does not say."""
    tokens = F.when(F.col("input_tokens") > 0, F.col("input_tokens")).otherwise(F.lit(least_tokens))
    return asked.where("ok").select("query_id", F.lit(node).alias("node"), F.lit(model).alias("model"), tokens.cast("long").alias("input_tokens"), "output_tokens", F.lit(units).alias("units"), "duration_ms")


def retrieve_isolated(queries: DataFrame, indexes: Indexes, config: PipelineConfig, steps: Steps, recognised: DataFrame | None = None, embed_tokens: int = 40) -> Found:
    """As ``retrieve``, with models that may fail for any query while the plan runs.

    Each step's rows say whether they went well.  A query goes on with the lists
    that it has: without a vector it has neither the dense list nor the graph's,
    with one list alone it keeps that list's label, with none it has failed.
    Where its reranking failed it keeps the order that it had.  Other queries
    are not touched.  Every model is asked once for a query: what it answered is
    written before the plan goes on.
    """
    check(config, indexes)
    q = config.query
    base = queries.select(F.col("query_id").cast("string").alias("query_id"), F.coalesce("query", F.lit("")).alias("query"))
    spark, events = queries.sparkSession, []
    known = base.select("query_id", "query", F.lit(True).alias("ok"), F.lit(None).cast("string").alias("error"))
    if q.dense or q.graph:
        if steps.embed is None:
            known = known.withColumn("vector", hash_embedding(F.col("query")))
        else:
            vectors = provided(base, steps.embed, ["query"], "array<double>", ["query_id"], budget=steps.budget, **steps.options)
            events.append(spent(vectors, "embed", "embed", least_tokens=embed_tokens))
            known = base.join(vectors.select("query_id", (F.col("ok") & F.col("value").isNotNull()).alias("ok"), "error", F.col("value").alias("vector")), "query_id")
    known = settle(known)
    able = known.where("ok").select("query_id", "query", "vector") if q.dense or q.graph else known
    lists, missed = {}, base.select("query_id", F.lit("").alias("part"), F.lit(None).cast("string").alias("error")).limit(0)
    if q.bm25:
        lists["bm25"] = indexes.bm25.search(base, q.top_k_fuse)
    if q.dense:
        column = "contextual" if q.contextual else "isolated"
        lists["dense"] = dense_search(able, indexes.vectors.where(F.col(column).isNotNull()).select("chunk_id", F.col(column).alias("vector")), q.top_k_fuse)
    if q.graph:
        if q.graph_recognition and steps.recognise is not None:
            named = provided(able.select("query_id", "query"), steps.recognise, ["query"], "array<string>", ["query_id"], budget=steps.budget, **steps.options)
            events.append(spent(named, "recognise", "small"))
            recognised = named.where("ok").select("query_id", F.explode("value").alias("text"))
            missed = missed.unionByName(named.where("not ok").select("query_id", F.lit("recognition").alias("part"), "error"))
        lists["graph"] = graph_search(able, indexes.node_vectors, indexes.edges, q.top_k_fuse, recognised=recognised)
    for name in ("dense", "graph"):
        if name in lists:
            missed = missed.unionByName(known.where("not ok").select("query_id", F.lit(name).alias("part"), "error"))
    always = int(q.bm25)
    n_lists = F.lit(always) + F.when(F.col("ok"), F.lit(len(lists) - always)).otherwise(F.lit(0))
    rows = settle(_fused(lists, known.select("query_id", n_lists.alias("n_lists"))))
    if q.rerank:
        rows, told, events = _reranked(rows, base, indexes, q.top_k_final, steps, events)
        missed = missed.unionByName(told)
    else:
        rows = rows.where(F.col("rank") <= q.top_k_final)
    order = F.array(*map(F.lit, ("dense", "graph", "recognition", "rerank")))
    parts = missed.groupBy("query_id").agg(F.collect_set("part").alias("parts"), F.max("error").alias("error"))
    degraded = F.transform(F.array_intersect(order, "parts"), lambda p: F.concat(p, F.lit("-skipped")))
    told = known.select("query_id", (n_lists == 0).alias("failed")).join(parts, "query_id", "left")
    told = told.select("query_id", F.when(F.col("failed"), F.array(F.lit("failed"))).otherwise(F.coalesce(degraded, F.array().cast("array<string>"))).alias("degraded"), "failed", "error")
    every = spark.createDataFrame([], EVENTS)
    for one in events:
        every = every.unionByName(one)
    return Found(rows.select("query_id", "chunk_id", "score", "source", "rank"), told, every)


def _fused(lists: dict[str, DataFrame], counts: DataFrame) -> DataFrame:
    """Queries with several lists fused, those with one as they are."""
    if len(lists) == 1:
        return next(iter(lists.values()))
    every = [rows.join(counts, "query_id") for rows in lists.values()]
    fused = rrf([rows.where("n_lists > 1") for rows in every])
    for rows in every:
        fused = fused.unionByName(rows.where("n_lists = 1").select(*fused.columns))
    return fused


def _reranked(rows: DataFrame, base: DataFrame, indexes: Indexes, k: int, steps: Steps, events: list) -> tuple[DataFrame, DataFrame, list]:
    if steps.rank is None:
        none = base.select("query_id", F.lit("rerank").alias("part"), F.lit(None).cast("string").alias("error")).limit(0)
        return rerank(rows, base, indexes.chunks, k), none, events
    few = _small(rows.select("query_id", "chunk_id", "rank"))  # then texts are not exchanged
    texts = few.join(indexes.chunks.select("chunk_id", "text"), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("c"))
    asked = texts.join(base, "query_id").select("query_id", "query", F.transform("c", lambda x: x.text).alias("texts"), F.transform("c", lambda x: x.chunk_id).alias("ids"))
    sizes = F.transform("texts", approx_tokens)
    scores = provided(asked, steps.rank, ["query", "texts"], "array<double>", ["query_id", "ids"], sizes, steps.rank_budget, lambda given, found: len(found) == len(given[1]), **steps.options)
    good = scores.where("ok and value is not null").select("query_id", F.explode(F.arrays_zip("ids", "value")).alias("x"))
    good = good.select("query_id", F.col("x.ids").alias("chunk_id"), F.round("x.value", DIGITS).alias("score")).join(rows.select("query_id", "chunk_id", F.col("rank").alias("before")), ["query_id", "chunk_id"])
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "before", "chunk_id"))
    best = good.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", "chunk_id", "score", F.lit("rerank").alias("source"), "rank")
    bad = scores.where("not ok or value is null").select("query_id", F.lit("rerank").alias("part"), "error")
    kept = rows.join(bad.select("query_id"), "query_id", "left_semi").where(F.col("rank") <= k).select(*best.columns)
    return best.unionByName(kept), bad, [*events, spent(scores, "rerank", "rerank", units=1)]
