"""Answers to whole tables of queries: routed, retrieved in one step, over the graph or in hops, and written with their sources."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.text import numbered_context
from siftwell.operators import agent, evaluate, graph, ledger
from siftwell.operators.search import _small
from siftwell.plans import costs, offline
from siftwell.plans.config import AUTO, PipelineConfig
from siftwell.plans.providers import Budget, provided
from siftwell.plans.schemas import CLASSIFIED, DECOMPOSED, JUDGED, REFINED, WRITTEN, conform
from siftwell.plans.retrieve import EVENTS, Indexes, Steps, Unavailable, retrieve, retrieve_isolated


@dataclass(frozen=True)
class Providers:
    """The steps that a model may take, each from a table of queries to a table.

    ``classify``: route (simple, complex, graph), confidence, tokens.
    ``decompose``: subqueries, tokens.  ``judge(queries, hop rows)``: verdict,
    refined, tokens.  ``write``: from query_id, query, context, texts to answer,
    citations (numbers of the context), contradiction, open_parts, tokens.
    ``recognise(queries, phrases)``: the phrases (text) that a query names, for
    plans with ``graph_recognition``.  ``assess``: from query_id, query, answer,
    texts to faithfulness and relevancy.  ``refine``: a query after a hop that
    did not suffice, from query_id, query to refined, tokens; without it the
    judge's is taken.  ``steps``: models of the retrieval plan, which may fail
    for single queries.  A step may also return input_tokens, output_tokens and
    duration_ms, and ``write`` an ``error``: that query has failed.
    """

    classify: Callable = offline.classify
    decompose: Callable = offline.decompose
    judge: Callable = offline.judge
    write: Callable = offline.write
    recognise: Callable = offline.recognise
    assess: Callable = offline.assess
    refine: Callable | None = None
    steps: Steps = field(default_factory=Steps)


def graph_core(config: PipelineConfig) -> PipelineConfig:
    """The configuration of the graph route: the graph alone, in its own order."""
    return replace(config, query=replace(config.query, bm25=False, dense=False, rerank=False, graph=True))


def route(queries: DataFrame, config: PipelineConfig, providers: Providers, has_graph: bool) -> DataFrame:
    """``query_id``, ``query``, ``next`` (s1_retrieve, graph_retrieve, decompose) and the tokens spent on it.

    A forced mode asks no classifier; a query without a verdict is unsure and is decomposed.
    """
    base = queries.select(F.col("query_id").cast("string").alias("query_id"), "query")
    first = agent.entry(F.lit(config.query.route_mode))
    if config.query.route_mode != AUTO:
        none = F.lit(0).cast("long")
        return base.select("query_id", "query", first.alias("next"), none.alias("tokens_used"), none.alias("input_tokens"), none.alias("output_tokens"), F.lit(0.0).alias("duration_ms"))
    known = base.join(conform(providers.classify(base), CLASSIFIED), "query_id", "left")
    step = agent.after_route(F.coalesce("route", F.lit("simple")), F.coalesce("confidence", F.lit(0.0)), has_graph)
    return known.select("query_id", "query", step.alias("next"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens_used"), *_told_tokens(known, F.col("tokens")))


def _told_tokens(rows: DataFrame, tokens: Column) -> list[Column]:
    """input_tokens, output_tokens and duration_ms as a step tells them, else its tokens as input."""
    get = lambda name, other: F.coalesce(F.col(name), other) if name in rows.columns else other
    zero = F.lit(0)
    return [get("input_tokens", F.coalesce(tokens, zero)).cast("long").alias("input_tokens"), get("output_tokens", zero).cast("long").alias("output_tokens"), get("duration_ms", F.lit(0.0)).cast("double").alias("duration_ms")]


def _event(rows: DataFrame, node: str, model: str | None) -> DataFrame:
    """A step's event for each of its rows."""
    return rows.select("query_id", F.lit(node).alias("node"), F.lit(model).cast("string").alias("model"), "input_tokens", "output_tokens", F.lit(0).alias("units"), "duration_ms")


ROWS = "query_id string, rank int, chunk_id string, hop int, route string"
#: The order of a query's events.
NODES = ("route", "decompose", "embed", "recognise", "rerank", "retrieve", "grade", "refine", "synthesise")


@dataclass
class Answered:
    """``found``: a row for each query; ``rows``: the ranked rows behind it; ``events``: what each step took (query_id, seq, node, model, tokens, units, duration_ms)."""

    found: DataFrame
    rows: DataFrame
    events: DataFrame


def answer(queries: DataFrame, indexes: Indexes, config: PipelineConfig, providers: Providers | None = None, score=None) -> tuple[DataFrame, DataFrame]:
    """Answers, and the ranked rows behind them (query_id, rank, chunk_id, hop, route); see :func:`answer_traced`."""
    out = answer_traced(queries, indexes, config, providers, score)
    return out.found, out.rows


def answer_traced(queries: DataFrame, indexes: Indexes, config: PipelineConfig, providers: Providers | None = None, score=None) -> Answered:
    """Answers with what they cost.

    An answer has its route (s1, graph, s2), text, cited chunks, chunks in order,
    hops and tokens used, the flags of what was left out or contradicts, and the
    sub-queries that stayed open; what the loop knows cannot be hidden by the
    writer.  Queries of a route go through its plan together.  A query for which
    no retriever or no writer was left has an ``error`` and no answer; others go on.
    """
    providers, spark = providers or Providers(), queries.sparkSession
    routed = graph.settle(route(queries, config, providers, indexes.edges is not None))
    rows, events = spark.createDataFrame([], ROWS), []
    told = spark.createDataFrame([], "query_id string, degraded array<string>, failed boolean, error string")
    if config.query.route_mode == AUTO:
        events.append(_event(routed, "route", "small"))
    empty = F.array().cast("array<string>")
    hops = None

    def ranked(asked: DataFrame, plan: PipelineConfig) -> DataFrame:
        nonlocal told
        recognised, missed = None, []
        if plan.query.graph and plan.query.graph_recognition and providers.steps.recognise is None:
            try:
                recognised = providers.recognise(asked, indexes.node_vectors.where("kind = 'phrase'").select("text"))
            except Unavailable:  # all seeds stay
                missed = ["recognition-skipped"]
        if providers.steps:
            found = retrieve_isolated(asked, indexes, plan, providers.steps, recognised)
            told, events[len(events) :] = told.unionByName(found.told), [found.events]
            return found.rows.select("query_id", "rank", "chunk_id")
        found, left_out = retrieve(asked, indexes, plan, score, recognised=recognised)
        told = told.unionByName(asked.select("query_id", F.array(*map(F.lit, left_out + missed)).cast("array<string>").alias("degraded"), F.lit(False).alias("failed"), F.lit(None).cast("string").alias("error")))
        zero = F.lit(0).cast("long")
        told_nothing = asked.select("query_id", zero.alias("input_tokens"), zero.alias("output_tokens"), F.lit(0.0).alias("duration_ms"))
        if plan.query.dense:
            events.append(_event(told_nothing.withColumn("input_tokens", F.lit(costs.EMBED).cast("long")), "embed", "embed"))
        if plan.query.rerank:
            events.append(_event(told_nothing, "rerank", "rerank").withColumn("units", F.lit(1)))
        return found.select("query_id", "rank", "chunk_id")

    for step, name, plan in (("s1_retrieve", "s1", config), ("graph_retrieve", "graph", graph_core(config))):
        asked = routed.where(F.col("next") == step).select("query_id", "query")
        if asked.head(1):
            rows = rows.unionByName(ranked(asked, plan).select("*", F.lit(0).alias("hop"), F.lit(name).alias("route")))
    asked = routed.where("next = 'decompose'").select("query_id", "query")
    states = None
    if asked.head(1):

        def noted(call: Callable, node: str, fields: dict) -> Callable:
            def run(*given):
                out = graph.settle(conform(call(*given), fields))
                events.append(_event(out.select("query_id", *_told_tokens(out, F.col("tokens"))), node, "small"))
                return out

            return run

        refine = noted(providers.refine, "refine", REFINED) if providers.refine is not None else None
        states, hops = agent.Loop(noted(providers.decompose, "decompose", DECOMPOSED), lambda q: ranked(q, config), noted(providers.judge, "grade", JUDGED), refine=refine).run(asked)
        if hops is not None:
            union = evaluate.union_of_hops(hops)
            at = hops.groupBy("query_id", "chunk_id").agg(F.min("hop").alias("hop"))
            rows = rows.unionByName(union.join(at, ["query_id", "chunk_id"]).select("query_id", "rank", "chunk_id", "hop", F.lit("s2").alias("route")))
    rows = graph.settle(rows)
    texts = _small(rows).join(indexes.chunks.select("chunk_id", "text"), "chunk_id").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id", "text"))).alias("found"))
    contexts = routed.select("query_id", "query", "next", "tokens_used").join(texts, "query_id", "left").select(
        "query_id", "query", F.coalesce(F.transform("found", lambda x: x.text), empty).alias("texts"), F.coalesce(F.transform("found", lambda x: x.chunk_id), empty).alias("chunk_ids"),
        "tokens_used", F.when(F.col("next") == "decompose", "s2").when(F.col("next") == "graph_retrieve", "graph").otherwise("s1").alias("route"),
    )
    left_out = told.groupBy("query_id").agg(F.array_distinct(F.flatten(F.collect_list("degraded"))).alias("skipped"), F.min("failed").alias("lost"), F.max("error").alias("lost_error"))
    contexts = contexts.join(graph.settle(left_out), "query_id", "left").withColumn("lost", F.coalesce("lost", F.lit(False)))
    contexts = graph.settle(contexts.withColumn("context", numbered_context(F.col("texts"))))
    said = conform(providers.write(contexts.where("not lost").select("query_id", "query", "context", "texts")), WRITTEN)
    error = F.col("error") if "error" in said.columns else F.lit(None).cast("string")
    said = graph.settle(said.select("query_id", "answer", "citations", "contradiction", "open_parts", F.coalesce("tokens", F.lit(0)).alias("tokens"), error.alias("write_error"), *_told_tokens(said, F.col("tokens"))))
    events.append(_event(said.where("write_error is null"), "synthesise", "answer"))
    written = contexts.drop("texts", "context").join(said, "query_id", "left")
    if states is None:
        states = spark.createDataFrame([], agent.STATE)
    loop = states.select("query_id", "hops_used", F.col("tokens_used").alias("loop_tokens"), "contradiction_flag", "exhausted", "unresolved")
    joined = written.join(loop, "query_id", "left").withColumns({
        "contradiction_flag": F.coalesce("contradiction_flag", F.lit(False)), "exhausted": F.coalesce("exhausted", F.lit(False)), "unresolved": F.coalesce("unresolved", empty),
    })
    disclosed = agent.disclose(joined, F.col("contradiction"), F.col("open_parts"))
    cited = F.transform(F.filter(F.coalesce("citations", F.array().cast("array<int>")), lambda n: (n >= 1) & (n <= F.size("chunk_ids"))), lambda n: F.element_at("chunk_ids", n))
    marks = F.filter(F.array(F.when(F.col("contradiction_flag"), "contradiction"), F.when(F.col("exhausted"), "exhausted")), lambda x: x.isNotNull())
    result = disclosed.select(
        "query_id", "route", F.coalesce("answer", F.lit("")).alias("answer"), cited.alias("cited"), "chunk_ids", F.coalesce("hops_used", F.lit(1)).alias("hops_used"),
        (F.col("tokens_used") + F.coalesce("loop_tokens", F.lit(0)) + F.coalesce("tokens", F.lit(0))).alias("tokens_used"), F.concat(F.array_sort(F.coalesce("skipped", empty)), marks).alias("flags"), "unresolved",
        F.when(F.col("lost"), F.coalesce("lost_error", F.lit("no retriever is left"))).otherwise(F.col("write_error")).alias("error"),
    )
    every = spark.createDataFrame([], EVENTS)
    for one in events:
        every = every.unionByName(one)
    place = F.array_position(F.array(*map(F.lit, NODES)), F.col("node"))
    return Answered(result, rows, ledger.numbered(every.withColumn("place", place), "query_id", ["place", "model", "input_tokens", "output_tokens", "duration_ms"]).drop("place"))


def model_writer(call: Callable, budget: Budget = Budget(rows=1), **options) -> Callable:
    """A writer out of a model's call over (query, context): structs of text, citations, contradiction and open parts.

    A query for which it fails, or answers in another form, has an error.
    """
    kind = "struct<text:string,citations:array<int>,contradiction:boolean,open_parts:array<string>>"

    def write(contexts: DataFrame) -> DataFrame:
        out = provided(contexts, call, ["query", "context"], kind, ["query_id"], F.array(F.length("context") / 4), budget, lambda given, value: value.get("text") is not None, **options)
        return out.select("query_id", F.col("value.text").alias("answer"), F.col("value.citations").alias("citations"), F.coalesce("value.contradiction", F.lit(False)).alias("contradiction"),
                          F.col("value.open_parts").alias("open_parts"), (F.col("input_tokens") + F.col("output_tokens")).alias("tokens"), "input_tokens", "output_tokens", "duration_ms", "error")

    return write


def retrieve_each(queries: DataFrame, indexes: Indexes, config: PipelineConfig, failures: DataFrame, score=None) -> tuple[DataFrame, DataFrame]:
    """As ``retrieve``, where components fail for single queries: ranked rows, and ``degraded`` of each query.

    ``failures``: query_id, component.  Queries with the same failures go through
    one plan; a query without any retriever left has no rows and is ``failed``.
    """
    names = ("bm25", "dense", "graph", "rerank")
    own = failures.where(F.col("component").isin(*names)).groupBy("query_id").agg(F.array_sort(F.collect_set("component")).alias("failing"))
    marked = graph.settle(queries.join(own, "query_id", "left").withColumn("failing", F.coalesce("failing", F.array().cast("array<string>"))))
    rows, told = None, None
    for r in marked.select("failing").distinct().collect():  # at most a row for each set of components
        part = marked.where(F.col("failing") == F.array(*map(F.lit, r.failing)).cast("array<string>")).drop("failing")
        try:
            found, left_out = retrieve(part, indexes, config, score, failing=frozenset(r.failing))
            rows = found.select("query_id", "chunk_id", "score", "source", "rank") if rows is None else rows.unionByName(found.select("query_id", "chunk_id", "score", "source", "rank"))
        except Unavailable:
            left_out = ["failed"]
        mark = part.select("query_id", F.array(*map(F.lit, left_out)).cast("array<string>").alias("degraded"))
        told = mark if told is None else told.unionByName(mark)
    if told is None:
        told = marked.select("query_id", F.array().cast("array<string>").alias("degraded"))
    if rows is None:
        rows = marked.select("query_id", F.lit(None).cast("string").alias("chunk_id"), F.lit(0.0).alias("score"), F.lit("").alias("source"), F.lit(0).alias("rank")).limit(0)
    return rows, told

