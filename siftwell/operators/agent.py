"""The bounded multi-hop loop over a table of queries: every step is a column expression on the states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CONFIDENCE = 0.7
MOST_HOPS = 3
TOKEN_CEILING = 50_000
MOST_SUBQUERIES = 3

STATE = (
    "query_id string, query string, route string, confidence double, subqueries array<string>, truncated boolean, hop_index int, hops_used int, "
    "tokens_used long, refined_query string, contradiction_retried boolean, contradiction_flag boolean, exhausted boolean, unresolved array<string>, next string"
)


def entry(mode: Column) -> Column:
    return F.when(mode == "force_s1", "s1_retrieve").when(mode == "force_s2", "decompose").otherwise("route")


def after_route(route: Column, confidence: Column, has_graph: bool) -> Column:
    """The graph if asked for and there; decomposition for complex or unsure ones; else one retrieval."""
    graph = (route == "graph") & F.lit(has_graph)
    return F.when(graph, "graph_retrieve").when((route == "complex") | (confidence < CONFIDENCE), "decompose").otherwise("s1_retrieve")


def after_decompose(states: DataFrame, ceiling: int = TOKEN_CEILING) -> DataFrame:
    """At most MOST_SUBQUERIES go on; none, or no tokens left, leads to the synthesis."""
    cut = F.slice(F.coalesce("subqueries", F.array().cast("array<string>")), 1, MOST_SUBQUERIES)
    spent = F.col("tokens_used") >= ceiling
    some = F.size(cut) > 0
    return states.withColumns({
        "truncated": F.size(F.coalesce("subqueries", F.array().cast("array<string>"))) > MOST_SUBQUERIES, "subqueries": cut,
        "exhausted": F.col("exhausted") | (some & spent), "unresolved": F.when(some & spent, F.array_union("unresolved", cut)).otherwise(F.col("unresolved")),
        "next": F.when(some & ~spent, "retrieve_hop").otherwise("synthesise"),
    })


def grade(states: DataFrame, verdict: Column, most_hops: int = MOST_HOPS, ceiling: int = TOKEN_CEILING) -> DataFrame:
    """The transition after grading a hop; hops and tokens count this hop and this call.

    sufficient: on to the next sub-query while there are hops and tokens, else
    the synthesis with what remains unresolved.  insufficient: refine and try
    the hop again, or give the sub-query and the rest up.  contradictory: once
    more with the same query; after that as sufficient, with a flag.
    """
    budget = (F.col("hops_used") < most_hops) & (F.col("tokens_used") < ceiling)
    rest = F.slice("subqueries", F.col("hop_index") + 2, F.greatest(F.size("subqueries") - F.col("hop_index") - 1, F.lit(0)))
    own = F.slice("subqueries", F.col("hop_index") + 1, F.lit(1))
    again = (verdict == "contradictory") & ~F.col("contradiction_retried") & budget
    good = (verdict == "sufficient") | ((verdict == "contradictory") & ~again)
    poor = verdict == "insufficient"
    left = F.size(rest) > 0
    forward, stop = good & left & budget, (good & left & ~budget)
    give_up = poor & ~budget
    unresolved = F.when(stop, F.array_union("unresolved", rest)).when(give_up, F.array_union(F.array_union("unresolved", own), rest)).otherwise(F.col("unresolved"))
    return states.withColumns({
        "next": F.when(again | forward, "retrieve_hop").when(poor & budget, "refine").otherwise("synthesise"),
        "hop_index": F.col("hop_index") + forward.cast("int"), "exhausted": F.col("exhausted") | stop | give_up, "unresolved": unresolved,
        "contradiction_flag": F.col("contradiction_flag") | ((verdict == "contradictory") & ~again),
        "contradiction_retried": F.when(forward, F.lit(False)).otherwise(F.col("contradiction_retried") | again),
        "refined_query": F.when(forward, F.lit(None).cast("string")).otherwise(F.col("refined_query")),
    })


def disclose(states: DataFrame, flag: Column, unresolved: Column) -> DataFrame:
    """The synthesis cannot hide what the loop knows: flags are joined by or, unresolved parts by sorted union."""
    return states.withColumns({
        "contradiction_flag": F.col("contradiction_flag") | F.coalesce(flag, F.lit(False)),
        "unresolved": F.array_sort(F.array_union("unresolved", F.coalesce(unresolved, F.array().cast("array<string>")))),
    })


class Loop:
    """Runs the loop with pluggable steps, set at a time; at most MOST_HOPS retrievals a query.

    ``decompose(df)`` returns query_id, subqueries, tokens; ``retrieve(df)``
    takes query_id, query and returns ranked rows; ``judge(df, hop_rows)``
    returns query_id, verdict, refined, tokens.  ``refine(df)``, if given, returns
    query_id, refined, tokens for the queries whose hop is to be tried again.
    """

    def __init__(self, decompose, retrieve, judge, most_hops: int = MOST_HOPS, ceiling: int = TOKEN_CEILING, settle=None, refine=None):
        from siftwell.operators.graph import settle as cut

        self.decompose, self.retrieve, self.judge, self.refine = decompose, retrieve, judge, refine
        self.most_hops, self.ceiling, self.settle = most_hops, ceiling, settle or cut

    def start(self, queries: DataFrame) -> DataFrame:
        parts = self.decompose(queries)
        none = F.array().cast("array<string>")
        states = queries.join(parts, "query_id", "left").select(
            F.col("query_id").cast("string"), "query", F.lit("complex").alias("route"), F.lit(1.0).alias("confidence"), "subqueries", F.lit(False).alias("truncated"),
            F.lit(0).alias("hop_index"), F.lit(0).alias("hops_used"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens_used"), F.lit(None).cast("string").alias("refined_query"),
            F.lit(False).alias("contradiction_retried"), F.lit(False).alias("contradiction_flag"), F.lit(False).alias("exhausted"), none.alias("unresolved"), F.lit("decompose").alias("next"),
        )
        return self.settle(after_decompose(states, self.ceiling))

    def run(self, queries: DataFrame) -> tuple[DataFrame, DataFrame | None]:
        """Final states, and all hops' rows (query_id, hop, rank, chunk_id)."""
        states, hops = self.start(queries), None
        for hop in range(self.most_hops):
            active = states.where("next = 'retrieve_hop'")
            if not active.head(1):
                break
            asked = active.select("query_id", F.coalesce("refined_query", F.element_at("subqueries", F.col("hop_index") + 1)).alias("query"))
            rows = self.settle(self.retrieve(asked).select("query_id", F.lit(hop).alias("hop"), "rank", "chunk_id"))
            verdicts = self.judge(asked, rows)
            graded = active.join(verdicts, "query_id").withColumns({"hops_used": F.col("hops_used") + 1, "tokens_used": F.col("tokens_used") + F.coalesce("tokens", F.lit(0))})
            graded = grade(graded, F.col("verdict"), self.most_hops, self.ceiling)
            refining = F.col("next") == "refine"
            if self.refine is not None:
                graded = self.settle(graded)
                again = self.refine(graded.where(refining).select("query_id", F.coalesce("refined_query", F.element_at("subqueries", F.col("hop_index") + 1)).alias("query")))
                graded = graded.drop("refined", "tokens").join(again.select("query_id", "refined", "tokens"), "query_id", "left")
                graded = graded.withColumn("tokens_used", F.col("tokens_used") + F.coalesce("tokens", F.lit(0)))
            graded = graded.withColumns({"refined_query": F.when(refining, F.coalesce("refined", F.col("refined_query"))).otherwise(F.col("refined_query")), "next": F.when(refining, "retrieve_hop").otherwise(F.col("next"))})
            states = self.settle(states.where("next <> 'retrieve_hop'").unionByName(graded.select(*states.columns)))
            hops = rows if hops is None else hops.unionByName(rows)
        return states, hops
