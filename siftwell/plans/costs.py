"""Prices and estimates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.agent import MOST_HOPS
from siftwell.plans.config import PipelineConfig

#: Dollars for a million tokens in and out, and for a search unit of reranking (fixed values).
PRICES = {
    "answer": (3.0, 15.0),
    "small": (1.0, 5.0),
    "embed": (0.18, 0.0),
}
RERANK_UNIT = 0.0025
VERSION = "1"
#: Tokens of one query's calls (fixed values): answer, embedding, judge, small calls of the loop, recognition.
ANSWER, EMBED, JUDGE, SMALL, SMALL_CALLS, RECOGNITION = (3300, 300), 40, (4000, 500), (1200, 100), 5, (900, 80)


def tokens_usd(model: str, n_in: int, n_out: int) -> float:
    if model not in PRICES:
        raise KeyError(model)
    price_in, price_out = PRICES[model]
    return (n_in * price_in + n_out * price_out) / 1e6


def query_usd(config: PipelineConfig, judged: bool = False) -> float:
    """The most that one query of a preset is expected to cost."""
    q = config.query
    many = q.route_mode == "auto"
    retrievals = MOST_HOPS if many else 1
    usd = tokens_usd("answer", *ANSWER)
    if q.dense or q.graph:
        usd += retrievals * tokens_usd("embed", EMBED, 0)
    if q.rerank:
        usd += retrievals * RERANK_UNIT
    if many:
        usd += SMALL_CALLS * tokens_usd("small", *SMALL)
    if q.graph and q.graph_recognition:
        usd += tokens_usd("small", *RECOGNITION)
    return usd + (tokens_usd("answer", *JUDGE) if judged else 0.0)


def estimate(configs: list[PipelineConfig], n: int, judged: bool = False) -> float:
    return sum(query_usd(c, judged) * n for c in configs)


def estimates(queries: DataFrame, configs: list[PipelineConfig], judged: bool = False) -> DataFrame:
    """``preset``, ``n`` and ``usd``: what running each preset over a table of queries is expected to cost at most."""
    each = queries.sparkSession.createDataFrame([(c.name, query_usd(c, judged)) for c in configs], "preset string, each double")
    n = queries.agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(each)).where("n > 0").select("preset", "n", (F.col("n") * F.col("each")).alias("usd"))  # one row of n


def price_events(events: DataFrame) -> DataFrame:
    """Trace events with ``usd``; a model without a price fails, an event without a model costs nothing."""
    prices = events.sparkSession.createDataFrame([(m, a, b) for m, (a, b) in PRICES.items()], "model string, price_in double, price_out double")
    joined = events.join(F.broadcast(prices), "model", "left")  # a fixed list
    usd = (F.col("input_tokens") * F.col("price_in") + F.col("output_tokens") * F.col("price_out")) / 1e6
    if "units" in events.columns:
        usd = F.when(F.col("model") == "rerank", F.coalesce("units", F.lit(0)) * RERANK_UNIT).otherwise(usd)
    unknown = F.raise_error(F.concat(F.lit("no price for "), F.col("model"))).cast("double")
    return joined.withColumn("usd", F.when(F.col("model").isNull(), 0.0).when(F.col("price_in").isNull() & (F.col("model") != "rerank"), unknown).otherwise(usd)).drop("price_in", "price_out")


def trace_totals(events: DataFrame) -> DataFrame:
    return price_events(events).groupBy("trace_id").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("usd").alias("usd"))


def query_totals(events: DataFrame) -> DataFrame:
    """What each query took by its own events: input_tokens, output_tokens, usd and the time of its models."""
    sums = [F.sum(c).alias(c) for c in ("input_tokens", "output_tokens", "usd", "duration_ms")]
    return price_events(events).groupBy("query_id").agg(*sums)
