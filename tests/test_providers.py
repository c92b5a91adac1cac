"""Models in plans: requests by budget, failures of single rows, costs of single queries."""

import pytest
from pyspark.sql import functions as F

from siftwell.functions.vectors import hash_embedding
from siftwell.operators import evaluate, graph, search
from siftwell.plans import providers
from siftwell.plans.answer import Providers, answer_traced, model_writer
from siftwell.plans.config import PipelineConfig, QueryConfig, preset
from siftwell.plans.providers import Budget, ProviderError, Reply, provided, requests
from siftwell.plans.retrieve import Indexes, Steps, embed_chunks, retrieve, retrieve_isolated
from siftwell.plans.runner import run_preset

TEXTS = ["alpha beta gamma", "beta delta", "gamma epsilon zeta", "alpha zeta", "eta theta", "delta eta iota"]
QUERIES = [("q1", "alpha zeta"), ("q2", "beta bad-embed"), ("q3", "gamma bad-rank"), ("q4", "nothing bad-embed"), ("q5", "eta delta")]
no_wait = {"sleep": lambda s: None}


def test_requests():
    rows = [(k, s) for k, s in enumerate([[50], [60], [30], [200], [10, 10, 10], [], [5]])]
    cut = [(r, bool(reason)) for r, reason in requests(iter(rows), Budget(tokens=100, parts=3, rows=2, part_tokens=90))]
    assert cut == [([0], False), ([1, 2], False), ([3], True), ([4, 5], False), ([6], False)]
    assert [r for r, _ in requests(iter([("a", [80]), ("b", [80])]), Budget(part_tokens=50))] == [["a"], ["b"]]
    # a brute force over many rows
    sizes = [[(7 * k) % 13 + 1] * (k % 4) for k in range(300)]
    got = [r for r, _ in requests(iter(enumerate(sizes)), Budget(tokens=40, parts=6, rows=5))]
    want, held = [], []
    for k, s in enumerate(sizes):
        new = [*held, k]
        if held and (sum(map(sum, (sizes[i] for i in new))) > 40 or sum(len(sizes[i]) for i in new) > 6 or len(new) > 5):
            want, new = [*want, held], [k]
        held = new
    assert got == [*want, held]


def test_retries():
    waits, left = [], [3]

    def call():
        left[0] -= 1
        if left[0]:
            raise ProviderError("busy", 429, 7.0 if left[0] == 1 else None)
        return "done"

    assert providers.with_retry(call, sleep=waits.append, spread=lambda w: w / 2) == "done" and waits == [0.5, 7.0]


def test_failing_rows_fail_alone(spark):
    rows = spark.createDataFrame([(k, "boom" if k in (3, 17) else "down" if k == 5 else f"t{k}") for k in range(40)], "k long, text string").coalesce(1)

    def call(texts):
        if "boom" in texts:
            raise ProviderError("bad request", 400)
        if "down" in texts:
            raise ConnectionError("no line")
        return Reply([t.upper() for t in texts], [len(t) for t in texts], None, [1.5] * len(texts))

    got = {r.k: r for r in provided(rows, call, ["text"], "string", ["k"], budget=Budget(rows=16), **no_wait).collect()}
    assert {k for k, r in got.items() if not r.ok} == {3, 5, 17} and got[3].error == "ProviderError: bad request" and got[5].error == "Exhausted: no line"
    assert got[4].value == "T4" and got[4].input_tokens == 2 and got[4].duration_ms == 1.5 and got[3].value is None
    assert len({r.request for r in got.values()}) == 3  # 40 rows in requests of 16, across Arrow batches
    wrong = provided(rows.where("k < 4"), lambda texts: [7 if t == "t1" else [1.0] for t in texts], ["text"], "array<double>", ["k"], **no_wait)
    assert {r.k: r.ok for r in wrong.collect()} == {0: True, 1: False, 2: True, 3: True}
    short = provided(rows.where("k < 2"), lambda texts: ["x"], ["text"], "string", ["k"], **no_wait)
    assert {r.k: r.ok for r in short.collect()} == {0: True, 1: True}  # one at a time the answers fit
    over = provided(rows.where("k < 2"), lambda texts: texts, ["text"], "string", ["k"], F.array("k"), Budget(tokens=0), **no_wait)
    assert {r.k: r.error for r in over.collect()} == {0: None, 1: "ValueError: 1 tokens in 1 parts are over the budget of a request"}
    assert provided(rows.where("k < 0"), call, ["text"], "string", ["k"]).collect() == []


@pytest.fixture(scope="module")
def indexes(spark):
    chunks = spark.createDataFrame([(f"d{k}:0", f"d{k}", f"d{k}", t, 0, k, 0, len(t.split())) for k, t in enumerate(TEXTS)], "chunk_id string, doc_id string, passage_id string, text string, position int, ord int, start_token int, end_token int")
    triples = spark.createDataFrame([("d0:0", "alpha", "is", "zeta"), ("d4:0", "eta", "is", "theta")], "chunk_id string, subject string, relation string, object string")
    nodes = graph.settle(graph.nodes(chunks, triples).withColumn("vector", hash_embedding(F.col("text"))))
    return Indexes(chunks, search.Bm25Index.build(chunks), graph.settle(embed_chunks(chunks)), nodes, graph.settle(graph.edges(nodes, triples)))


def models():
    """Calls that travel by value: the workers do not import the tests."""

    def embed(texts):
        if any("bad-embed" in t for t in texts):
            raise ProviderError("cannot embed", 400)
        return Reply(providers.hash_embed(texts), [len(t.split()) for t in texts], None, [2.0 * len(t) for t in texts])

    def rank(asked):
        if any("bad-rank" in q for q, _ in asked):
            raise providers.Exhausted("ranker down", 503)
        return Reply(providers.scripted_ranks()(asked), None, None, [3.0] * len(asked))

    return embed, rank


embed, rank = models()


def test_retrieval_degrades_single_queries(spark, indexes):
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    config = PipelineConfig("t", query=QueryConfig(bm25=True, dense=True, rerank=True, top_k_final=4))
    found = retrieve_isolated(asked, indexes, config, Steps(embed, rank, options=no_wait))
    told = {r.query_id: r for r in found.told.collect()}
    assert {k: r.degraded for k, r in told.items()} == {"q1": [], "q2": ["dense-skipped"], "q3": ["rerank-skipped"], "q4": ["dense-skipped"], "q5": []}
    assert not any(r.failed for r in told.values()) and "cannot embed" in told["q2"].error and "ranker down" in told["q3"].error
    rows = {}
    for r in sorted(found.rows.collect(), key=lambda r: r["rank"]):
        rows.setdefault(r.query_id, []).append(r)
    fused, _ = retrieve(asked, indexes, config.with_query(rerank=False, top_k_final=99))
    before = {}
    for r in sorted(fused.collect(), key=lambda r: r["rank"]):
        before.setdefault(r.query_id, []).append(r.chunk_id)
    assert [r.chunk_id for r in rows["q3"]] == before["q3"][:4] and {r.source for r in rows["q3"]} == {"rrf"}  # the order before reranking
    assert [r.chunk_id for r in rows["q1"]] == before["q1"][::-1][:4] and {r.source for r in rows["q1"]} == {"rerank"}  # the script turns it round
    assert {r.chunk_id for r in rows["q2"]} == {"d0:0", "d1:0"} and {r.source for r in rows["q2"]} == {"rerank"}  # BM25 alone, reranked
    assert "q4" not in rows  # BM25 finds nothing for it, and it has not failed
    plain = retrieve_isolated(asked, indexes, config.with_query(rerank=False), Steps(embed, options=no_wait))
    assert {r.source for r in plain.rows.where("query_id = 'q2'").collect()} == {"bm25"}  # one list keeps its label
    alone = retrieve_isolated(asked, indexes, config.with_query(bm25=False, rerank=False), Steps(embed, options=no_wait))
    assert {r.query_id for r in alone.told.where("failed").collect()} == {"q2", "q4"} and {r.degraded[0] for r in alone.told.where("failed").collect()} == {"failed"}
    with_graph = retrieve_isolated(asked, indexes, config.with_query(graph=True, rerank=False, graph_recognition=True), Steps(embed, None, lambda qs: [[w for w in q.split() if w == "alpha"] for q in qs], options=no_wait))
    assert {r.query_id: r.degraded for r in with_graph.told.collect()}["q2"] == ["dense-skipped", "graph-skipped"]
    assert {r.source for r in with_graph.rows.where("query_id = 'q1'").collect()} == {"rrf"}
    events = {(e.query_id, e.node): e for e in found.events.collect()}
    assert events["q1", "embed"].input_tokens == 2 and events["q1", "rerank"].units == 1 and ("q2", "embed") not in events and ("q3", "rerank") not in events


def test_healthy_models_change_nothing(spark, indexes):
    asked = spark.createDataFrame(QUERIES, "query_id string, query string")
    for name in ("dense-rrf", "graph-rrf", "graph"):
        want, _ = retrieve(asked, indexes, preset(name))
        got = retrieve_isolated(asked, indexes, preset(name), Steps(providers.hash_embed)).rows
        key = lambda rows: sorted((r.query_id, r["rank"], r.chunk_id, round(r.score, 6), r.source) for r in rows.collect())
        assert key(got) == key(want), name


def test_costs_of_single_queries(spark, indexes):
    asked = spark.createDataFrame([(k, q, ["alpha zeta"]) for k, q in [*QUERIES, ("q6", "eta bad-write")]], "query_id string, question string, gold_answers array<string>")
    golds = spark.createDataFrame([("q1", 0, "passage", "d3", None, None, None), ("q5", 0, "passage", "d5", None, None, None)], "query_id string, gold_idx int, gold_type string, passage_id string, doc_id string, gold_start int, gold_end int")

    def write(given):
        if any("bad-write" in q for q, _ in given):
            raise ProviderError("no answer", 400)
        return Reply([{"text": c.split("\n")[0][4:], "citations": [1], "contradiction": False, "open_parts": []} for _, c in given], [len(c) for _, c in given], [7] * len(given), [float(len(c)) for _, c in given])

    ways = Providers(write=model_writer(write, **no_wait), steps=Steps(embed, rank, options=no_wait))
    config = PipelineConfig("own", query=QueryConfig(bm25=True, dense=True, rerank=True, top_k_final=2))
    got = run_preset(asked, golds, indexes, config, "r", providers=ways, clock=lambda: 0.0)
    rows = {r.query_id: r for r in got.collect()}
    assert {k: r.status for k, r in rows.items()} == {"q1": "ok", "q2": "ok", "q3": "ok", "q4": "abstained", "q5": "ok", "q6": "failed"}
    assert rows["q6"].error == "ProviderError: no answer" and rows["q6"].usd == 0 and rows["q6"].recall is None and rows["q2"].flags == ["dense-skipped"] and rows["q1"].recall == 0 or rows["q1"].recall == 1
    context = sum(len(f"[{k + 1}] {TEXTS[int(c[1])]}") for k, c in enumerate(rows["q1"].retrieved_chunk_ids)) + 2
    assert rows["q1"].usd == pytest.approx((3 * context + 15 * 7) / 1e6 + 0.18 * 2 / 1e6 + 0.0025)
    assert rows["q1"].latency_ms == pytest.approx(context + 2.0 * len("alpha zeta") + 3.0)
    assert rows["q3"].usd < 0.0025 < rows["q2"].usd and len({r.usd for r in rows.values()}) == 6 and len({r.latency_ms for r in rows.values()}) >= 5
    m = evaluate.run_metrics(got).head()
    assert (m.n_total, m.n_failed, m.n_abstained) == (6, 1, 1) and m.usd_per_query == pytest.approx(sum(r.usd for r in rows.values() if r.status != "failed") / 5) and m.latency_p50 < m.latency_p95
    events = answer_traced(asked.select("query_id", F.col("question").alias("query")), indexes, config, ways).events.where("query_id = 'q1'").orderBy("seq").collect()
    assert [(e.seq, e.node) for e in events] == [(0, "embed"), (1, "rerank"), (2, "synthesise")]


def test_embedding_by_documents(spark, indexes):
    chunks = indexes.chunks.withColumn("doc_id", F.when(F.col("ord") < 3, "one").otherwise(F.col("doc_id"))).withColumn("position", F.col("ord"))

    def call(docs):
        if any("eta theta" in d for d in docs):
            raise ProviderError("refused", 400)
        return [[[float(len(d)), float(len(t))] for t in d] for d in docs]

    got = {r.chunk_id: r for r in embed_chunks(chunks, call, Budget(rows=2), **no_wait).collect()}
    assert got["d0:0"].contextual == [3.0, 16.0] and got["d0:0"].isolated == [1.0, 16.0] and got["d3:0"].contextual == [1.0, 10.0]
    assert got["d4:0"].contextual is None and got["d4:0"].isolated is None and len(got) == 6


def test_triples_by_a_model(spark, indexes):
    def call(texts):
        if any("eta theta" == t for t in texts):
            raise ProviderError("refused", 400)
        return [[{"subject": t.split()[0], "relation": "with", "object": t.split()[-1]}] for t in texts]

    triples, failed = providers.extract_triples(indexes.chunks, call, **no_wait)
    assert {(r.chunk_id, r.subject, r.object) for r in triples.collect()} >= {("d0:0", "alpha", "gamma"), ("d5:0", "delta", "iota")} and triples.count() == 5
    assert [tuple(r) for r in failed.collect()] == [("d4:0", "ProviderError: refused")]


def test_tables_of_models_are_checked(spark, indexes):
    from siftwell.plans import schemas

    rows = spark.createDataFrame([("a", "simple", "0.9", 3), ("b", "nowhere", "0.5", 3), ("c", "graph", "high", 3), ("d", "complex", "2", 3), ("e", "simple", "1", -1), ("a", "simple", "0.9", 3), ("f", None, "0.1", None)], "query_id string, route string, confidence string, tokens int")
    assert sorted((r.query_id, r.route, r.confidence, r.tokens) for r in schemas.conform(rows, schemas.CLASSIFIED).collect()) == [("a", "simple", 0.9, 3)]
    with pytest.raises(ValueError, match="lacks route"):
        schemas.conform(rows.drop("route"), schemas.CLASSIFIED)
    cited = spark.createDataFrame([("a", "x", [1, 2]), ("b", "y", None)], "query_id string, answer string, citations array<long>")
    got = schemas.conform(cited, schemas.WRITTEN)
    assert got.schema["citations"].dataType.simpleString() == "array<int>" and {r.query_id: r.citations for r in got.collect()} == {"a": [1, 2], "b": None}
    asked = spark.createDataFrame([("q1", "alpha zeta"), ("q2", "beta delta")], "query_id string, query string")
    ways = Providers(classify=lambda q: q.select("query_id", F.when(F.col("query_id") == "q1", "simple").otherwise("elsewhere").alias("route"), F.lit(0.9).alias("confidence"), F.lit(1).alias("tokens")))
    found = {r.query_id: r.route for r in answer_traced(asked, indexes, preset("router-on"), ways).found.collect()}
    assert found == {"q1": "s1", "q2": "s2"}  # a route that is none counts as no verdict
