"""Gold alignment and metrics over ranked rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A percentile is the nearest rank: the smallest value that at least this share does not exceed.
PERCENTILES = {"p50": 0.5, "p95": 0.95}


def span_hit(start: Column, end: Column, gold_start: Column, gold_end: Column) -> Column:
    """At least half of the gold span lies in the chunk; integers, no division."""
    return 2 * (F.least(end, gold_end) - F.greatest(start, gold_start)) >= gold_end - gold_start


def check_golds(golds: DataFrame) -> DataFrame:
    """Fails on an empty span when a plan over the golds runs."""
    bad = (F.col("gold_type") == "span") & (F.col("gold_end") <= F.col("gold_start"))
    known = F.col("gold_type").isin("passage", "span")
    return golds.where(F.when(bad, F.raise_error(F.lit("empty gold span"))).when(~known, F.raise_error(F.lit("unknown gold type"))).otherwise(F.lit(True)).cast("boolean"))


def hits(retrieved: DataFrame, golds: DataFrame) -> DataFrame:
    """Which retrieved chunk meets which gold: query_id, gold_idx, rank.

    ``retrieved``: query_id, rank, passage_id, doc_id, start_token, end_token.
    ``golds``: query_id, gold_idx, gold_type, passage_id, doc_id, gold_start,
    gold_end.  Both kinds are hash joins; the overlap is a residual condition.
    """
    golds = check_golds(golds)
    chunk = retrieved.select("query_id", "rank", "passage_id", "doc_id", "start_token", "end_token")
    passages = golds.where("gold_type = 'passage'").select("query_id", "gold_idx", "passage_id")
    spans = golds.where("gold_type = 'span'").select("query_id", "gold_idx", "doc_id", "gold_start", "gold_end")
    by_passage = chunk.join(passages, ["query_id", "passage_id"]).select("query_id", "gold_idx", "rank")
    by_span = chunk.join(spans, ["query_id", "doc_id"]).where(span_hit(F.col("start_token"), F.col("end_token"), F.col("gold_start"), F.col("gold_end")))
    return by_passage.unionByName(by_span.select("query_id", "gold_idx", "rank"))


def retrieval_metrics(found: DataFrame, golds: DataFrame, recall_k: int = 5, mrr_k: int = 3) -> DataFrame:
    """``recall``, ``mrr`` and ``first_rank`` of every query with golds."""
    per_gold = found.groupBy("query_id", "gold_idx").agg(F.min("rank").alias("rank"))
    joined = golds.select("query_id", "gold_idx").join(per_gold, ["query_id", "gold_idx"], "left")
    hit = F.coalesce((F.col("rank") <= recall_k).cast("int"), F.lit(0))
    first = F.min(F.when(F.col("rank") <= mrr_k, F.col("rank")))
    return joined.groupBy("query_id").agg((F.sum(hit) / F.count("*")).alias("recall"), F.coalesce(1.0 / first, F.lit(0.0)).alias("mrr"), first.alias("first_rank"))


def percentile(column: str, share: float) -> Column:
    return F.expr(f"percentile_disc({share}) within group (order by {column})")


def run_metrics(results: DataFrame) -> DataFrame:
    """One row for each run and preset.

    ``results``: run_id, preset, query_id, status (ok, abstained, failed), route,
    recall, mrr, em, f1, usd, latency_ms.  Failed rows count in latencies and
    totals alone.  Where a run mixes in hops or the graph, recall and mrr are
    null and the recall is that of the union of hops.
    """
    scored = F.col("status").isin("ok", "abstained")
    mean = lambda c: F.avg(F.when(scored, F.col(c)))
    many = F.coalesce(F.sum(F.when(scored & F.col("route").isin("s2", "graph"), 1)), F.lit(0)) > 0
    out = results.groupBy("run_id", "preset").agg(
        F.count("*").alias("n_total"), F.count_if(F.col("status") == "failed").alias("n_failed"), F.count_if(F.col("status") == "abstained").alias("n_abstained"),
        *(F.count_if(scored & (F.col("route") == r)).alias(f"n_{r}") for r in ("s1", "s2", "graph")),
        mean("recall").alias("__recall"), mean("mrr").alias("__mrr"), mean("em").alias("em"), mean("f1").alias("f1"), mean("usd").alias("usd_per_query"),
        *(percentile("latency_ms", p).alias(f"latency_{name}") for name, p in PERCENTILES.items()),
        F.avg(F.when(scored & (F.col("route") == "graph"), (F.col("recall") > 0).cast("double"))).alias("graph_route_precision"), many.alias("__many"),
    )
    null = F.lit(None).cast("double")
    return out.select(
        "run_id", "preset", "n_total", "n_failed", "n_abstained", "n_s1", "n_s2", "n_graph",
        F.when(F.col("__many"), null).otherwise(F.col("__recall")).alias("recall_at_5"), F.when(F.col("__many"), null).otherwise(F.col("__mrr")).alias("mrr_at_3"),
        F.when(F.col("__many"), F.col("__recall")).alias("recall_union_of_hops"), "em", "f1", "usd_per_query", "latency_p50", "latency_p95", "graph_route_precision",
    )


def alignment_coverage(found: DataFrame, golds: DataFrame) -> DataFrame:
    """golds, golds_hit and queries_all_hit over everything."""
    per_gold = golds.select("query_id", "gold_idx").join(found.select("query_id", "gold_idx").distinct().withColumn("hit", F.lit(True)), ["query_id", "gold_idx"], "left")
    per_query = per_gold.groupBy("query_id").agg(F.count("*").alias("golds"), F.count("hit").alias("hits"))
    return per_query.agg(F.sum("golds").alias("golds"), F.sum("hits").alias("golds_hit"), F.count_if(F.col("golds") == F.col("hits")).alias("queries_all_hit"))


def union_of_hops(hop_rows: DataFrame) -> DataFrame:
    """The first occurrence of each chunk over a query's hops, in order: query_id, chunk_id, rank."""
    first = hop_rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("hop", "rank")).alias("at"))
    order = Window.partitionBy("query_id").orderBy("at.hop", "at.rank", "chunk_id")
    return first.select("query_id", "chunk_id", F.row_number().over(order).alias("rank"))


def resolve_citations(answers: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Citation n of an answer is its n-th retrieved chunk; numbers out of range fall away."""
    cited = answers.select("query_id", F.posexplode("citations").alias("ord", "rank"))
    return cited.join(retrieved.select("query_id", "rank", "chunk_id"), ["query_id", "rank"])


def hop_context(hop_rows: DataFrame, texts: DataFrame) -> DataFrame:
    """Numbered context over all hops: each chunk once, at its first place, tagged with that hop's sub-query.

    ``hop_rows``: query_id, hop, rank, chunk_id, subquery.
    """
    first = hop_rows.groupBy("query_id", "chunk_id").agg(F.min(F.struct("hop", "rank", "subquery")).alias("at"))
    number = F.row_number().over(Window.partitionBy("query_id").orderBy("at.hop", "at.rank", "chunk_id"))
    lines = first.withColumn("n", number).join(texts.select("chunk_id", "text"), "chunk_id")
    line = F.concat(F.lit("["), F.col("n").cast("string"), F.lit("] ("), F.col("at.subquery"), F.lit(") "), F.col("text"))
    return lines.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", line.alias("line")))), lambda x: x.line), "\n\n").alias("context"))


def judged_means(judged: DataFrame) -> DataFrame:
    """Means of the judge's scores over ok rows; null without any.  The judge's own spend is not tracked, which is told."""
    ok = F.col("status") == "ok"
    mean = lambda c: F.avg(F.when(ok, F.col(c))).alias(c)
    return judged.groupBy("run_id", "preset").agg(mean("faithfulness"), mean("relevancy"), F.lit(True).alias("judge_spend_untracked"))
