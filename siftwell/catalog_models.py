"""Registered queries with models in them: calls that fail for some rows, and runs that cost what their own steps took."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from siftwell.catalog import ITEMS_SQL, _asked, _holding, _indexes, plan_cte
from siftwell.operators import evaluate, graph
from siftwell.plans import costs, offline
from siftwell.plans.answer import Providers, answer
from siftwell.plans.config import preset
from siftwell.plans.providers import ProviderError, Reply, hash_embed, provided
from siftwell.plans.retrieve import Steps, retrieve_isolated
from siftwell.plans.runner import run_preset
from siftwell.registry import register

#: Texts of these remainders of their length are refused by the models of the queries below.
NO_VECTOR, NO_RANKS = (4, 1), (3, 0)


def _refuses(texts, rule: tuple[int, int]) -> bool:
    return any(len(t) % rule[0] == rule[1] for t in texts)


def overlap(query: str, text: str) -> float:
    bag = lambda t: {w for w in re.split(r"\s+", t.lower(), flags=re.ASCII) if w}
    own = bag(query)
    return len(own & bag(text)) / max(1, len(own))


def _models(refusing: bool) -> Steps:
    """An embedder and a reranker; each says that it took a millisecond for each character or text."""

    def embed(texts):
        if refusing and _refuses(texts, NO_VECTOR):
            raise ProviderError("refused", 400)
        return Reply(hash_embed(texts), None, None, [float(len(t)) for t in texts])

    def rank(asked):
        if refusing and _refuses((q for q, _ in asked), NO_RANKS):
            raise ProviderError("refused", 400)
        return Reply([[overlap(q, t) for t in texts] for q, texts in asked], None, None, [float(len(texts)) for _, texts in asked])

    return Steps(embed, rank)


_WORDS = r"list_distinct(list_filter(regexp_split_to_array(lower({t}.text), '\s+'), lambda t: t <> ''))"


def _pool_sql(pool: str) -> str:
    """``ranked``: the rows of ``pool`` by shared words."""
    own, other = _WORDS.format(t="a"), _WORDS.format(t="dc")
    return f"""
po AS ({pool}),
pr AS (SELECT query_id, chunk_id, rank AS before, round(len(list_intersect({own}, {other})) / greatest(len({own}), 1), 6) AS score FROM po JOIN a USING (query_id) JOIN dc USING (chunk_id)),
ranked AS (SELECT query_id, chunk_id, score, 'rerank' AS source, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, before, chunk_id) AS INTEGER) AS rank FROM pr)"""


@register("retrieve_isolated", f"""
WITH {plan_cte(ITEMS_SQL, dense=True)},
k AS (SELECT query_id, length(text) % {NO_VECTOR[0]} = {NO_VECTOR[1]} AS dim, length(text) % {NO_RANKS[0]} = {NO_RANKS[1]} AS plain FROM a),
{_pool_sql("SELECT query_id, chunk_id, score, source, rank FROM fused JOIN k USING (query_id) WHERE NOT dim UNION ALL SELECT query_id, chunk_id, score, 'bm25', rank FROM b JOIN k USING (query_id) WHERE dim AND rank <= 50")},
t AS (SELECT * FROM ranked JOIN k USING (query_id) WHERE NOT plain UNION ALL SELECT po.*, dim, plain FROM po JOIN k USING (query_id) WHERE plain)
SELECT query_id, chunk_id, round(score, 6) AS score, source, rank, concat_ws(',', CASE WHEN dim THEN 'dense-skipped' END, CASE WHEN plain THEN 'rerank-skipped' END) AS degraded FROM t WHERE rank <= 5
""")
def retrieve_isolated_query(spark, d):
    """Models refuse some items while the plan runs: only these go on without a vector, or without new ranks."""
    asked = _asked(spark, d).withColumn("query_id", F.col("query_id").cast("string"))
    found = retrieve_isolated(asked, _indexes(spark, d), preset("rerank"), _models(refusing=True))
    rows = found.rows.join(found.told.select("query_id", F.array_join("degraded", ",").alias("degraded")), "query_id")
    return rows.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "source", "rank", "degraded")


@register("model_requests", """
WITH e AS (SELECT CAST(doc_id AS VARCHAR) AS doc_id, text FROM documents)
SELECT doc_id, length(text) % 7 <> 3 AS ok, CASE WHEN length(text) % 7 <> 3 THEN length(text) ELSE -1 END AS value, CAST(CASE WHEN length(text) % 7 <> 3 THEN greatest(1, length(text) // 4) ELSE 0 END AS BIGINT) AS input_tokens,
       CASE WHEN length(text) % 7 = 3 THEN 'ProviderError: refused' END AS error FROM e
""")
def model_requests(spark, d):
    """A model over all documents, in requests by budget: texts that it refuses fail alone."""

    def call(texts):
        if any(len(t) % 7 == 3 for t in texts):
            raise ProviderError("refused", 400)
        return Reply([len(t) for t in texts], [max(1, len(t) // 4) for t in texts])

    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").cast("string").alias("doc_id"), "text")
    return provided(docs, call, ["text"], "long", ["doc_id"]).select("doc_id", "ok", F.coalesce("value", F.lit(-1).cast("long")).alias("value"), "input_tokens", "error")


RUN = ("bm25-only", "rerank")


def _run_rows(spark, d):
    """Both presets of RUN over all items with golds, as real runs."""
    indexes = _indexes(spark, d)
    indexes.chunks = indexes.chunks.withColumns({"passage_id": F.col("chunk_id"), "start_token": F.lit(0), "end_token": F.lit(1)})
    golds = _holding(spark, d).withColumns({c: F.col(c).cast("string") for c in ("query_id", "passage_id", "doc_id")})
    golds = graph.settle(golds)
    asked = _asked(spark, d).select(F.col("query_id").cast("string").alias("query_id"), F.col("query").alias("question"), F.array("query").alias("gold_answers"))

    def write(contexts):
        return offline.write(contexts).join(contexts.select("query_id", F.length("context").cast("double").alias("duration_ms")), "query_id")

    # both presets ask the same of BM25
    indexes.bm25 = indexes.bm25.ahead(asked.select(F.col("question").alias("query")), max(preset(name).query.top_k_fuse for name in RUN))
    ways = Providers(write=write, steps=_models(refusing=False))
    out = None
    for name in RUN:
        rows = run_preset(asked, golds, indexes, preset(name), "run", providers=ways, clock=lambda: 0.0)
        out = rows if out is None else out.unionByName(rows)
    return out


def _run_cte(name: str, k: int) -> str:
    q = preset(name).query
    price_in, price_out = costs.PRICES["answer"]
    besides = costs.EMBED * costs.PRICES["embed"][0] / 1e6 * q.dense + costs.RERANK_UNIT * q.rerank
    ends = "SELECT query_id, chunk_id, rank FROM ranked WHERE rank <= 5" if q.rerank else "SELECT query_id, chunk_id, rank FROM final"
    pool = "length(a.text) + (SELECT count(*) FROM po WHERE po.query_id = a.query_id)" if q.rerank else "0"
    rows = f"""
WITH {plan_cte(ITEMS_SQL, dense=q.dense)}{", " + _pool_sql("SELECT * FROM fused") if q.rerank else ""},
fi AS ({ends}),
co AS (SELECT query_id, string_agg('[' || rank || '] ' || text, chr(10) || chr(10) ORDER BY rank) AS context, arg_min(text, rank) AS best FROM fi JOIN dc USING (chunk_id) GROUP BY query_id),
sa AS (SELECT query_id, coalesce(context, '') AS context, trim(regexp_extract(coalesce(best, ''), '(?s)^(.*?[.!?])(\\s|$)', 1), ' ') AS answer, {pool} AS more FROM a LEFT JOIN co USING (query_id)),
go AS (SELECT i.item_id AS item, CAST(d.doc_id AS VARCHAR) AS gold FROM benchmark i JOIN documents d ON contains(d.text, i.text) WHERE i.text <> ''),
me AS (SELECT CAST(item AS VARCHAR) AS query_id, count(rank) / count(*) AS recall, coalesce(1.0::DOUBLE / min(rank) FILTER (rank <= 3), 0) AS mrr FROM go LEFT JOIN fi ON fi.query_id = CAST(item AS VARCHAR) AND fi.chunk_id = gold GROUP BY item)
SELECT '{name}' AS preset, query_id, CASE WHEN answer = '' THEN 'abstained' ELSE 'ok' END AS status, recall, mrr,
  ({price_in} * greatest(1, length(context) // 4) + {price_out} * CASE WHEN answer = '' THEN 0 ELSE greatest(1, length(answer) // 4) END) / 1e6 + {besides!r}::DOUBLE AS usd, CAST(length(context) + more AS DOUBLE) AS latency_ms
FROM sa LEFT JOIN me USING (query_id)"""
    return f"r{k} AS ({rows})"


_RUN_SQL = f"WITH {', '.join(_run_cte(name, k) for k, name in enumerate(RUN))}, r AS ({' UNION ALL '.join(f'SELECT * FROM r{k}' for k in range(len(RUN)))})"


@register("run_costs", f"{_RUN_SQL} SELECT preset, query_id, status, round(usd, 9) AS usd, latency_ms FROM r")
def run_costs(spark, d):
    """What each item's own steps cost and took, in runs of two presets."""
    return _run_rows(spark, d).select("preset", "query_id", "status", F.round("usd", 9).alias("usd"), "latency_ms")


@register("run_receipt", f"""
{_RUN_SQL}
SELECT preset, count(*) AS n_total, count(*) FILTER (status = 'abstained') AS n_abstained, round(avg(recall), 9) AS recall_at_5, round(avg(mrr), 9) AS mrr_at_3, round(avg(usd), 9) AS usd_per_query,
  quantile_disc(latency_ms, 0.5) AS latency_p50, quantile_disc(latency_ms, 0.95) AS latency_p95 FROM r GROUP BY preset
""")
def run_receipt(spark, d):
    """The metrics of the same runs."""
    m = evaluate.run_metrics(_run_rows(spark, d))
    return m.select("preset", "n_total", "n_abstained", *(F.round(c, 9).alias(c) for c in ("recall_at_5", "mrr_at_3", "usd_per_query")), "latency_p50", "latency_p95")


_NAMED = "SELECT CAST(n_nationkey AS VARCHAR) AS query_id, 'who buys in ' || n_name || ' now' AS text FROM nation"


@register("answer_graph_route", f"""
WITH g AS (WITH {plan_cte(_NAMED + " WHERE n_nationkey % 2 = 0", bm25=False, with_graph=True, recognise=True)} SELECT query_id, rank, chunk_id, 'graph' AS route FROM final),
s AS (WITH {plan_cte(_NAMED + " WHERE n_nationkey % 2 = 1", dense=True, rerank=True)} SELECT query_id, rank, chunk_id, 's1' AS route FROM final)
SELECT query_id, route, rank, chunk_id FROM g UNION ALL SELECT query_id, route, rank, chunk_id FROM s
""")
def answer_graph_route(spark, d):
    """Questions about nations: every other one is classified as one for the graph, whose seeds are the phrases that it names."""
    asked = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").cast("string").alias("query_id"), F.concat(F.lit("who buys in "), "n_name", F.lit(" now")).alias("query"))

    def classify(queries):
        return queries.select("query_id", F.when(F.col("query_id").cast("int") % 2 == 0, "graph").otherwise("simple").alias("route"), F.lit(0.9).alias("confidence"), F.lit(3).alias("tokens"))

    _, rows = answer(asked, _indexes(spark, d, with_graph=True), preset("router-on").with_query(graph_recognition=True), Providers(classify=classify))
    return rows.select("query_id", "route", "rank", "chunk_id")
