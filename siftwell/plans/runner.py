"""Ingestion, and evaluation runs over presets."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.functions.text import exact_match, token_f1
from siftwell.functions.vectors import hash_embedding
from siftwell.operators import evaluate, graph, ledger
from siftwell.operators.chunking import chunk
from siftwell.operators.search import Bm25Index
from siftwell.plans import costs, records
from siftwell.plans.answer import Providers, answer_traced
from siftwell.plans.config import MULTI_HOP, IngestConfig, PipelineConfig, preset
from siftwell.plans.retrieve import Indexes, Unavailable, embed_chunks
from siftwell.sources import files, sinks
from siftwell.sources.keyed import KeyedTable

RESULTS = (
    "run_id string, preset string, query_id string, status string, route string, recall double, mrr double, em double, f1 double, usd double, latency_ms double, "
    "retrieved_chunk_ids array<string>, answer string, flags array<string>, error string"
)


class SpendCap(RuntimeError):
    """The next query would pass the cap; what has been recorded stays."""


@dataclass
class Skipped:
    preset: str
    reason: str


def build_graph(spark: SparkSession, out: str, triples: DataFrame) -> str:
    """The graph of an ingested corpus from triples of its chunks; returns its hash."""
    chunks = spark.read.parquet(f"{out}/chunks")
    nodes = graph.nodes(chunks.select("chunk_id", "ord", "text"), triples).withColumn("vector", hash_embedding(F.col("text")))
    named = nodes.where("kind = 'phrase'").select("node_id", "vector")
    sinks.write_graph(nodes, graph.edges(nodes, triples, graph.synonym_pairs(named)), f"{out}/graph")
    return sinks.table_hash(spark.read.parquet(f"{out}/graph/edges"), "kind", "src", "dst", "weight")


def add_graph(spark: SparkSession, out: str, triples: DataFrame) -> dict:
    """Builds the graph of a corpus that has been ingested without one and enters its hash in the manifest."""
    doc = files.manifest(spark, f"{out}/manifest")
    doc["index_hashes"]["graph"] = build_graph(spark, out, triples)
    sinks.write_manifest(spark, doc, f"{out}/manifest")
    return doc


def ingest(spark: SparkSession, raw: str, out: str, corpus_id: str, config: IngestConfig | None = None, triples: DataFrame | None = None) -> dict:
    """From raw/docs.jsonl to chunks, vectors, the BM25 index, the graph if there are triples, and the manifest."""
    config = config or IngestConfig()
    passages = graph.settle(files.passages(spark, f"{raw}/docs.jsonl"))
    found = chunk(passages, config.chunk_size, config.chunk_overlap)
    order = passages.select("passage_id", "ord").groupBy("passage_id").agg(F.min("ord").alias("ord"))
    found = found.join(order, "passage_id")
    if not found.head(1):
        raise ValueError("the corpus has no chunks")
    sinks.write_chunks(found, f"{out}/chunks")
    chunks = spark.read.parquet(f"{out}/chunks")
    sinks.write_vectors(embed_chunks(chunks), chunks, f"{out}/vectors")
    Bm25Index.build(chunks).write(f"{out}/bm25")
    vectors = spark.read.parquet(f"{out}/vectors")
    hashes = {
        "dense_contextual": sinks.table_hash(vectors, "chunk_id", "contextual"), "dense_isolated": sinks.table_hash(vectors, "chunk_id", "isolated"),
        "sparse": sinks.table_hash(spark.read.parquet(f"{out}/bm25/terms"), "term", "df"),
    }
    if triples is not None:
        hashes["graph"] = build_graph(spark, out, triples)
    counts = passages.agg(F.count_distinct("doc_id")).head()[0], chunks.count(), files.count_queries(spark, f"{raw}/queries.jsonl")
    doc = sinks.manifest(corpus_id, files.dataset_info(spark, raw, corpus_id), {"chunk_size": config.chunk_size, "chunk_overlap": config.chunk_overlap}, config.embed_model, hashes, *counts)
    sinks.write_manifest(spark, doc, f"{out}/manifest")
    return doc


def load(spark: SparkSession, out: str) -> Indexes:
    found = Indexes(spark.read.parquet(f"{out}/chunks"), Bm25Index.read(spark, f"{out}/bm25"), spark.read.parquet(f"{out}/vectors"))
    if files.exists(spark, f"{out}/graph/edges"):
        found.node_vectors, found.edges = spark.read.parquet(f"{out}/graph/nodes"), spark.read.parquet(f"{out}/graph/edges")
    return found


def run_preset(queries: DataFrame, golds: DataFrame, indexes: Indexes, config: PipelineConfig, run_id: str, done: DataFrame | None = None, spend_cap: float | None = None, spent: float = 0.0, providers: Providers | None = None, clock: Callable = time.perf_counter) -> DataFrame:
    """Result rows of the queries not yet recorded.

    A query's cost is that of its own events: the tokens of its models at their
    prices, and its reranked searches.  Its latency is the time of its own models
    and an equal share of what the queries' common plan took besides.  A query
    that no retriever or writer could answer is failed, with its error.

    ``queries``: query_id, question, gold_answers.  With a cap, only the
    queries whose estimates fit what is left are admitted, in order of id, and
    :class:`SpendCap` is raised if not even one is.  Presets that route send
    each query its way.  A plan that cannot run gives failed rows, not a failed
    job.
    """
    own = F.lit(config.name)
    if done is not None:
        queries = ledger.resume(queries, done.where((F.col("run_id") == run_id) & (F.col("preset") == config.name)), ["query_id"])
    each = costs.query_usd(config)
    if spend_cap is not None:
        costed = queries.withColumns({"__run": F.lit(run_id), "__usd": F.lit(each), "__left": F.lit(spend_cap - spent + 1e-12)})
        admitted = graph.settle(ledger.within_cap(costed, "__run", ["query_id"], "__usd", "__usd", "__left").where("admitted").select(*queries.columns))
        if not admitted.head(1) and queries.head(1):
            raise SpendCap(f"{spent} of {spend_cap} dollars are spent")
        queries = admitted
    began = clock()
    base = queries.select("query_id", F.col("question").alias("query"), "gold_answers")
    null = lambda kind: F.lit(None).cast(kind)
    try:
        out = answer_traced(base, indexes, config, providers)
        found, rows, events = graph.settle(out.found), out.rows, graph.settle(out.events)
    except Unavailable as error:
        return base.select(F.lit(run_id).alias("run_id"), own.alias("preset"), "query_id", F.lit("failed").alias("status"), null("string").alias("route"), *(null("double").alias(c) for c in ("recall", "mrr", "em", "f1", "usd", "latency_ms")),
                           F.array().cast("array<string>").alias("retrieved_chunk_ids"), null("string").alias("answer"), F.array().cast("array<string>").alias("flags"), F.lit(str(error)).alias("error"))
    placed = rows.join(indexes.chunks.select("chunk_id", "passage_id", "doc_id", "text", "start_token", "end_token"), "chunk_id")
    scores = evaluate.retrieval_metrics(evaluate.hits(placed, golds), golds)
    took = graph.settle(costs.query_totals(events).select("query_id", "usd", "duration_ms"))
    joined = base.join(found, "query_id", "left").join(scores, "query_id", "left").join(took, "query_id", "left")
    models = took.agg(F.coalesce(F.sum("duration_ms"), F.lit(0.0))).head()[0]
    shared = max(0.0, (clock() - began) * 1000 - models) / max(1, queries.count())
    said, failed = F.coalesce("answer", F.lit("")), F.col("error").isNotNull()
    scored = lambda c: F.when(~failed, c)
    return joined.select(
        F.lit(run_id).alias("run_id"), own.alias("preset"), "query_id", F.when(failed, "failed").when(said == "", "abstained").otherwise("ok").alias("status"),
        F.when(F.lit(config.query.graph and not config.query.bm25), "graph").otherwise(F.col("route")).alias("route"), scored(F.col("recall")).alias("recall"), scored(F.col("mrr")).alias("mrr"),
        scored(exact_match(said, F.col("gold_answers"))).alias("em"), scored(token_f1(said, F.col("gold_answers"))).alias("f1"),
        F.when(failed, 0.0).otherwise(F.coalesce("usd", F.lit(0.0))).alias("usd"), (F.coalesce("duration_ms", F.lit(0.0)) + shared).alias("latency_ms"),
        F.col("chunk_ids").alias("retrieved_chunk_ids"), scored(F.col("answer")).alias("answer"), "flags", "error",
    )


def run(spark: SparkSession, queries: DataFrame, golds: DataFrame, indexes: Indexes, presets: list[str], run_id: str, results_path: str, dataset: str = "", spend_cap: float | None = None, size: str = "", providers: Providers | None = None, recognition: bool | None = None, judged: bool = False, manifest: dict | None = None) -> dict:
    """All presets; results are kept by key under ``results_path``, and a repeated run goes on where it stopped.

    A preset's rows are there together or not at all, so that a run that broke
    off has each query once when it is resumed.

    ``dataset`` may be the corpus that holds it.  ``recognition`` replaces that of
    presets with the graph.  ``judged`` has the providers assess the answers.
    """
    skipped: list[Skipped] = []
    kept = KeyedTable(spark, results_path, RESULTS, ["run_id", "preset", "query_id"])
    for name in presets:
        config = override(preset(name), recognition)
        if config.query.route_mode != "force_s1" and files.dataset_name(dataset) not in MULTI_HOP:
            skipped.append(Skipped(name, f"{name} needs a multi-hop dataset"))
            continue
        missing = config.query.graph and indexes.edges is None
        if missing:
            skipped.append(Skipped(name, "the corpus has no graph"))
            continue
        done = kept.read()
        spent = done.where(F.col("run_id") == run_id).agg(F.coalesce(F.sum("usd"), F.lit(0.0))).head()[0]
        rows = run_preset(queries, golds, indexes, config, run_id, done, spend_cap, spent, providers)
        kept.upsert(rows)
    results = kept.read().where(F.col("run_id") == run_id)
    metrics = evaluate.run_metrics(results)
    found = records.anchors(metrics)
    by_preset: dict[str, list[dict]] = {}
    for a in found.collect():  # a few rows for each preset
        by_preset.setdefault(a.preset, []).append(a.asDict())
    rows = records.per_query(results)
    extra = {r.preset: {"faithfulness": r.faithfulness, "relevancy": r.relevancy, "judge_spend_untracked": True} for r in judge(results, queries, indexes, providers).collect()} if judged else {}
    hashes = (manifest or {}).get("index_hashes")
    receipts = []
    for m in metrics.orderBy("preset").collect():
        config = override(preset(m.preset), recognition)
        used = {} if hashes is None else {"index_hashes": records.used_hashes(config, hashes)}
        receipts.append(m.asDict() | {"config": config.as_dict(), "pricing_version": costs.VERSION, "anchors": by_preset.get(m.preset, []), "per_query": rows.get(m.preset, [])} | used | extra.get(m.preset, {}))
    return json.loads(records.envelope(run_id, receipts, [s.__dict__ for s in skipped], corpus_id=dataset, slice=size))


def override(config: PipelineConfig, recognition: bool | None) -> PipelineConfig:
    """The configuration with another setting of recognition, if it has the graph."""
    return config if recognition is None or not config.query.graph else config.with_query(graph_recognition=recognition)


def judge(results: DataFrame, queries: DataFrame, indexes: Indexes, providers: Providers | None = None) -> DataFrame:
    """Means of the assessed answers of each preset, over queries with status ok."""
    ok = results.where("status = 'ok'").join(queries.select("query_id", F.col("question").alias("query")), "query_id")
    ok = ok.withColumn("key", F.to_json(F.struct("run_id", "preset", "query_id")))
    cited = ok.select("key", F.explode("retrieved_chunk_ids").alias("chunk_id")).join(indexes.chunks.select("chunk_id", "text"), "chunk_id")
    texts = cited.groupBy("key").agg(F.array_sort(F.collect_list("text")).alias("texts"))  # as many as a plan returns
    asked = ok.join(texts, "key", "left").select(F.col("key").alias("query_id"), "query", "answer", "texts")
    scores = (providers or Providers()).assess(asked).withColumnRenamed("query_id", "key")
    return evaluate.judged_means(ok.join(scores, "key", "left"))


def next_seq(log: DataFrame, key: str) -> DataFrame:
    return log.groupBy(key).agg((F.coalesce(F.max("seq"), F.lit(0)) + 1).alias("next"))


def previous_runs(results: DataFrame) -> DataFrame:
    """Runs, the newest first."""
    return results.groupBy("run_id").agg(F.count("*").alias("n")).orderBy(F.desc("run_id"))
