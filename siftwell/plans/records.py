"""Records of evaluation runs: anchors, envelopes, stripped copies, flags between presets."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siftwell.plans.config import PRESETS, PipelineConfig

SCHEMA_VERSION = 1
#: What a row of a query keeps in a record that is committed.
KEPT = ("query_id", "retrieved_chunk_ids", "latency_ms", "usd", "flags")
#: Published differences that a run is held against (fixed values): preset, baseline, metric, published delta, source.
ANCHORS = [
    ("dense-rrf", "bm25-only", "recall_at_5", -0.057, "T2-RAGBench dense against BM25"),
    ("contextual", "dense-rrf", "recall_at_5", 0.025, "contextual retrieval"),
    ("rerank", "contextual", "recall_at_5", 0.121, "T2-RAGBench rerank over hybrid"),
    ("rerank", "contextual", "mrr_at_3", 0.172, "T2-RAGBench rerank over hybrid"),
    ("graph", "rerank", "recall_at_5", 0.07, "arXiv 2502.14802"),
    ("graph-rrf", "rerank", "recall_at_5", 0.07, "arXiv 2502.14802"),
    ("router-on", "rerank", "f1", -0.037, "arXiv 2604.01733"),
]


def ladder(spark) -> DataFrame:
    return spark.createDataFrame([(name, k) for k, name in enumerate(PRESETS)], "preset string, ladder int")


def anchors(metrics: DataFrame, specs: list[tuple] = ANCHORS) -> DataFrame:
    """Measured against published differences; skipped where either metric is missing or null.

    The directions match if both differences are positive or neither is.
    """
    spark = metrics.sparkSession
    wanted = spark.createDataFrame(specs, "preset string, baseline string, metric string, published double, source string")
    names = ["recall_at_5", "mrr_at_3", "f1", "em"]
    long = metrics.select("run_id", "preset", F.explode(F.create_map(*(x for n in names if n in metrics.columns for x in (F.lit(n), F.col(n))))).alias("metric", "value")).where("value is not null")
    own = wanted.join(long, ["preset", "metric"]).withColumnRenamed("value", "own")
    base = long.select("run_id", F.col("preset").alias("baseline"), "metric", F.col("value").alias("base"))
    joined = own.join(base, ["run_id", "baseline", "metric"])
    delta = F.round(F.col("own") - F.col("base"), 4)
    return joined.select("run_id", "preset", "baseline", "metric", "published", "source", delta.alias("measured"), ((F.col("own") - F.col("base") > 0) == (F.col("published") > 0)).alias("direction_matches"))


def cross_index(receipts: DataFrame) -> DataFrame:
    """``cross_index``: the dense index differs from that of the last preset of the ladder that had one."""
    before = Window.partitionBy("run_id").orderBy("ladder").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last("dense_hash", ignorenulls=True).over(before)
    return receipts.withColumn("cross_index", F.coalesce(F.col("dense_hash") != last, F.lit(False)))


def pivot_anchors(found: DataFrame) -> DataFrame:
    """Presets by sources, the measured differences in the cells."""
    return found.groupBy("preset").pivot("source").agg(F.max("measured"))


def strip(rows: DataFrame) -> DataFrame:
    """Per-query rows as they may be committed: no answers and no routes."""
    return rows.select(*KEPT)


def strip_document(doc: dict) -> dict:
    """A run document as it may be committed: the rows of its queries stripped, all else as it is."""
    return doc | {"receipts": [r | ({"per_query": [{k: v for k, v in q.items() if k in KEPT} for q in r["per_query"]]} if "per_query" in r else {}) for r in doc["receipts"]]}


def run_id(corpus_id: str, size: str, at: datetime | None = None) -> str:
    """``corpus-slice-YYYYMMDD-HHMMSS-`` and six hexadecimal digits, in UTC."""
    return f"{corpus_id}-{size}-{(at or datetime.now(UTC)):%Y%m%d-%H%M%S}-{uuid.uuid4().hex[:6]}"


def used_hashes(config: PipelineConfig, hashes: dict) -> dict:
    """Of an index's hashes those of the tables that the configuration's lists come from; the graph's is not among them."""
    q = config.query
    wanted = ["sparse"] * q.bm25 + ["dense_contextual" if q.contextual else "dense_isolated"] * q.dense
    return {name: hashes[name] for name in wanted}


def per_query(results: DataFrame) -> dict[str, list[dict]]:
    """The rows of each preset's queries in order of id, for the run document.

    They fit in one document as the slice of queries does, which is one itself.
    """
    found: dict[str, list[dict]] = {}
    for r in results.drop("run_id").orderBy("preset", "query_id").toLocalIterator():
        row = r.asDict(recursive=True)
        found.setdefault(row.pop("preset"), []).append(row)
    return found


def envelope(run_id: str, receipts: list[dict], skipped: list[dict] | None = None, **about) -> str:
    """A run document; ``about``: corpus_id and slice, where they are known."""
    doc = about | {"schema_version": SCHEMA_VERSION, "run_id": run_id, "receipts": receipts, "skipped": skipped or [], "created_at": datetime.now(UTC).isoformat()}
    return json.dumps(doc, sort_keys=True, ensure_ascii=False)


def open_envelope(text: str) -> dict:
    """A run document, or the envelope of a single receipt; other versions are refused."""
    doc = json.loads(text)
    if doc.get("schema_version") != SCHEMA_VERSION:
        raise ValueError(f"schema_version {doc.get('schema_version')!r} is not {SCHEMA_VERSION}")
    if "receipts" not in doc:
        doc["receipts"] = [doc["receipt"]] if "receipt" in doc else []
    return doc
