"""PageRank by pushing and the synonym join against dense arithmetic."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwell.operators import graph, near, search


def power(n, edges, seeds, rounds, damping=0.5):
    a = np.zeros((n, n))
    for i, j, w in edges:
        a[j, i] += w
        a[i, j] += w
    p = np.zeros(n)
    for k, m in seeds:
        p[k] += m
    p = p / p.sum() if p.sum() > 0 else np.full(n, 1 / n)
    out = a.sum(axis=0)
    x = p.copy()
    for _ in range(rounds):
        x = damping * (a @ np.divide(x, out, out=np.zeros(n), where=out > 0) + x[out == 0].sum() * p) + (1 - damping) * p
    return x


@pytest.fixture(scope="module")
def random_graph(spark):
    r = np.random.default_rng(4)
    n = 120
    edges = sorted({(int(min(a, b)), int(max(a, b))) for a, b in r.integers(0, n - 10, (260, 2)) if a != b})
    weighted = [(a, b, float(w)) for (a, b), w in zip(edges, r.integers(1, 4, len(edges)))]
    seeds = {"q0": [(3, 1.0), (40, 2.0)], "q1": [(n - 1, 1.0), (5, 1.0)], "q2": [(n - 2, 3.0)], "q3": [(7, 0.0)], "q4": [(k, 1.0) for k in range(0, n, 7)]}
    undirected = spark.createDataFrame([(a, b, "r", w) for a, b, w in weighted], "src long, dst long, kind string, weight double")
    rows = spark.createDataFrame([(q, k, m) for q, s in seeds.items() for k, m in s], "query_id string, node_id long, mass double")
    return n, weighted, seeds, graph.settle(graph.adjacency(undirected)), spark.range(n).select(F.col("id").alias("node_id")), rows


@pytest.mark.parametrize("local_edges", [10_000, 0])
def test_push_is_the_power_method(spark, random_graph, local_edges):
    n, edges, seeds, adj, nodes, rows = random_graph
    got = {}
    for r in graph.pagerank(adj, nodes, rows, local_edges=local_edges).collect():
        got.setdefault(r.query_id, np.zeros(n))[r.node_id] = r.mass
    for q, own in seeds.items():
        assert np.abs(got[q] - power(n, edges, own, graph.ROUNDS)).max() < 1e-9, q
        assert np.abs(got[q] - power(n, edges, own, 200)).sum() < 2e-6 and abs(got[q].sum() - 1) < 1e-10


def test_push_reaches_only_near_nodes(spark):
    chain = spark.createDataFrame([(k, k + 1, "r", 1.0) for k in range(400)], "src long, dst long, kind string, weight double")
    adj, nodes = graph.adjacency(chain), spark.range(401).select(F.col("id").alias("node_id"))
    one = spark.createDataFrame([("q", 200, 1.0)], "query_id string, node_id long, mass double")
    for local in (10_000, 0):
        x = {r.node_id: r.mass for r in graph.pagerank(adj, nodes, one, least=1e-4, rounds=60, local_edges=local).collect()}
        exact = power(401, [(k, k + 1, 1.0) for k in range(400)], [(200, 1.0)], 60)
        assert len(x) < 40 and abs(sum(x.values()) - 1) < 1e-9
        assert sum(abs(exact[k] - x.get(k, 0.0)) for k in range(401)) <= 1e-4 * len(x) * 2


def test_equal_nodes_take_part_once(spark, monkeypatch):
    """Leaves of the same hubs are pushed as one, seeds among them apart; what is left of a large graph is broadcast."""
    hubs, leaves = 6, 600
    edges = sorted({(h, hubs + k, 1.0 + (k % 2)) for k in range(leaves) for h in (k % 3, 3 + k % 3)} | {(0, 1, 2.0), (3, 4, 1.0)})
    n = hubs + leaves + 3  # three nodes without edges
    seeds = {"q0": [(0, 1.0)], "q1": [(hubs + 1, 1.0), (hubs + 7, 1.0), (hubs + 13, 2.0)], "q2": [(n - 1, 1.0), (n - 2, 1.0), (hubs, 2.0)], "q3": [(4, 0.0)]}
    adj = graph.adjacency(spark.createDataFrame([(a, b, "r", w) for a, b, w in edges], "src long, dst long, kind string, weight double"))
    rows = spark.createDataFrame([(q, k, m) for q, s in seeds.items() for k, m in s], "query_id string, node_id long, mass double")
    monkeypatch.setattr(graph, "_push_joined", None)
    got = {}
    for r in graph.pagerank(adj, spark.range(n).select(F.col("id").alias("node_id")), rows, local_edges=100).collect():
        assert (r.query_id, r.node_id) not in got
        got[r.query_id, r.node_id] = r.mass
    for q, own in seeds.items():
        want = power(n, edges, own, graph.ROUNDS)
        assert max(abs(got.get((q, k), 0.0) - want[k]) for k in range(n)) < 1e-9, q


def test_texts_of_nodes_are_exchanged_and_written_once(spark, monkeypatch):
    written = []
    monkeypatch.setattr(graph, "settle", lambda df: written.append(df) or df.checkpoint())
    chunks = spark.createDataFrame([(f"c{k}", 500 - k, f"text {k}") for k in range(500)], "chunk_id string, ord long, text string")
    triples = spark.createDataFrame([("b", "in", "a"), ("c", "in", "a")], "subject string, relation string, object string")
    found = graph.nodes(chunks, triples)
    got = sorted((r.node_id, r.kind, r.text, r.chunk_id) for r in found.collect())
    assert got == [*((k, "passage", f"text {499 - k}", f"c{499 - k}") for k in range(500)), *((500 + k, "phrase", t, None) for k, t in enumerate("abc"))]
    assert len(written) == 1 and "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def clusters(n, d, per, spread, seed=1):
    r = np.random.default_rng(seed)
    centres = r.standard_normal((n // per, d))
    return np.repeat(centres, per, axis=0) + spread * r.standard_normal((n // per * per, d))


def pairs_of(x, least):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    c = u @ u.T
    return {(i, j): c[i, j] for i, j in zip(*np.nonzero(np.triu(c >= least, 1)))}


def test_near_pairs(spark):
    x = clusters(3000, 32, 5, 0.38)
    frame = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "node_id long, vector array<double>").repartition(5)
    want = pairs_of(x, 0.85)
    got = {(r.a, r.b): r.weight for r in graph.synonym_pairs(frame).collect()}
    assert len(want) > 1500 and set(got) <= set(want)
    assert len(got) >= 0.995 * len(want), (len(got), len(want))  # pairs throng just above the threshold
    assert all(abs(got[k] - want[k]) < 1e-12 for k in got)


def test_near_pairs_of_odd_vectors(spark, monkeypatch):
    nan = float("nan")
    rows = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [1.0, None]), (7, [nan, 1.0]), (8, []), (9, [1e-200, 1e-202]), (None, [1.0, 0.0]), (10, [-1.0, 0.0])]
    frame = spark.createDataFrame(rows, "node_id long, vector array<double>")
    assert {(r.a, r.b) for r in graph.synonym_pairs(frame).collect()} == {(1, 2), (1, 9), (2, 9)}
    assert graph.synonym_pairs(frame.where("node_id < 0")).collect() == []
    monkeypatch.setattr(near, "PART", 50)  # a bucket with all rows, dealt out as pairs of parts
    same = spark.createDataFrame([(k, [1.0, 0.001 * k]) for k in range(200)], "node_id long, vector array<double>").repartition(3)
    assert graph.synonym_pairs(same).count() == 200 * 199 // 2


def test_bands_grow_slower_than_the_square():
    cost = [n * bands * max(near.BUCKET, n / 2**signs) for n in (10**6, 10**8) for signs, bands, _ in [near.plan(n, 0.85)]]
    assert cost[1] / cost[0] < 100**1.5


def test_whole_rows():
    import pyarrow as pa

    ids, x = search.whole_rows(pa.array(["a", "b", "c", "d", "e"]), pa.array([[1.0, 2.0], [1.0], None, [None, 1.0], [3.0, 4.0]]), 2)
    assert ids == ["a", "e"] and x.tolist() == [[1.0, 2.0], [3.0, 4.0]]
    ids, x = search.whole_rows(pa.array(["a", "b"])[1:], pa.array([[9.0, 9.0], [3.0, 4.0]])[1:], 2)
    assert ids == ["b"] and x.tolist() == [[3.0, 4.0]]


def test_blocks_give_the_same_and_are_skipped(spark, tmp_path):
    r = np.random.default_rng(8)
    rare = [f"w{k}" for k in range(4000)]
    texts = [" ".join([*r.choice(["common", "often", "usual"], 10), *r.choice(rare, 25)]) for _ in range(1500)]
    texts += [texts[3]] * 9 + ["", "!", "the of"]
    chunks = spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string")
    asked = spark.createDataFrame([(k, " ".join(texts[k].split()[5:30])) for k in range(0, 60, 3)] + [(100, "common"), (101, ""), (102, None), (103, "unknown"), (104, "common common often")], "query_id long, query string")
    search.BlockIndex.build(chunks).write(str(tmp_path / "blocks"))
    found = search.BlockIndex.read(spark, str(tmp_path / "blocks")).search(asked, 5)
    key = lambda rows: sorted((x.query_id, x["rank"], x.chunk_id, x.score, x.source) for x in rows.collect())
    want = key(search.Bm25Index.build(chunks).search(asked, 5))
    assert key(found.rows) == want and len(want) > 100
    read = {x.query_id: (x.n_blocks, x.n_read) for x in found.read.collect()}
    assert set(read) == {*range(0, 60, 3), 100, 104}
    total, used = (sum(v[k] for v in read.values()) for k in (0, 1))
    assert used < 0.75 * total, (used, total)
    best = search.BlockIndex.read(spark, str(tmp_path / "blocks")).search(asked.where("query_id < 100"), 1, first=2)
    assert key(best.rows) == [w for w in want if w[0] < 100 and w[1] == 1]
    total, used = best.read.agg(F.sum("n_blocks"), F.sum("n_read")).head()
    assert used < 0.3 * total, (used, total)  # where one chunk stands out, few ranges reach it


def test_blocks_are_made_and_read_without_an_exchange_of_postings(spark, tmp_path):
    chunks = spark.createDataFrame([(k, f"common w{k % 7} w{k}") for k in range(300)], "chunk_id long, text string")
    index = search.BlockIndex.build(chunks)
    assert index.blocks._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1  # that of the texts, by range
    index.write(str(tmp_path / "blocks"))
    asked = spark.createDataFrame([(1, "common w3 w3"), (2, "w5 w250")], "query_id long, query string")
    rows = search.BlockIndex.read(spark, str(tmp_path / "blocks")).search(asked, 5).rows
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "postings" in plan and all("strategy=broadcast" in line for line in plan.splitlines() if "Join LeftSemi" in line)
    key = lambda found: sorted((x.query_id, x["rank"], x.chunk_id, x.score) for x in found.collect())
    assert key(rows) == key(search.Bm25Index.build(chunks).search(asked, 5)) and rows.count() == 10


def test_tasks_that_join_texts_follow_from_their_bytes(spark, monkeypatch):
    from siftwell.functions.vectors import hash_embedding
    from siftwell.plans.retrieve import embed_chunks

    monkeypatch.setattr(search, "TASK_BYTES", 1000)
    chunks = spark.createDataFrame([(f"c{k}", f"d{k // 2}", f"{k:0200d}", k % 2) for k in range(100)], "chunk_id string, doc_id string, text string, position int")
    found = embed_chunks(chunks)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert ", 20), REPARTITION" in plan and plan.count("Exchange hashpartitioning(doc_id") == 2  # the texts once, and the chunks' vectors
    rows = {r.chunk_id: r for r in found.collect()}
    whole = spark.createDataFrame([(f"{2:0200d} {3:0200d}",)], "t string").select(hash_embedding(F.col("t")).alias("v")).head().v
    want = 0.8 * np.array(rows["c3"].isolated) + 0.2 * np.array(whole)
    got = np.array(rows["c3"].contextual)
    assert len(rows) == 100 and abs(got @ want / np.linalg.norm(got) / np.linalg.norm(want) - 1) < 1e-9


def test_a_search_exchanges_no_postings_when_tables_are_not_broadcast_by_size(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_BYTES", 100)
    chunks = spark.createDataFrame([(k, f"common w{k % 7} w{k}") for k in range(60)], "chunk_id long, text string")
    asked = spark.createDataFrame([("a", "common w3 w3"), ("b", "w5 w50"), ("c", "")], "query_id string, query string")
    key = lambda found: sorted((x.query_id, x["rank"], x.chunk_id, x.score) for x in found.collect())
    want = key(search.Bm25Index.build(chunks).search(asked, 5))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = search.Bm25Index.build(chunks).search(asked, 5)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan
        exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning(query_id" in line]
        assert len(exchanges) == 1 and "chunk_id" not in exchanges[0]  # pairs are summed where their chunk is, only each task's best move
        assert key(found) == want and len(want) == 10
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_model_reranks_without_an_exchange_of_all_texts(spark, monkeypatch):
    from siftwell.plans import retrieve

    chunks = spark.createDataFrame([(f"c{k}", f"text {k}") for k in range(50)], "chunk_id string, text string")
    rows = spark.createDataFrame([("q", f"c{k}", 1.0, "bm25", k + 1) for k in range(4)], "query_id string, chunk_id string, score double, source string, rank int")
    base = spark.createDataFrame([("q", "text 3")], "query_id string, query string")
    asked = []
    provided = retrieve.provided
    monkeypatch.setattr(retrieve, "provided", lambda frame, *rest, **more: asked.append(frame) or provided(frame, *rest, **more))
    rank = lambda given: [[float(t == q) for t in texts] for q, texts in given]
    found, bad, _ = retrieve._reranked(graph.settle(rows), base, retrieve.Indexes(chunks), 2, retrieve.Steps(rank=rank), [])
    plan = asked[0]._jdf.queryExecution().optimizedPlan().toString()
    assert any("strategy=broadcast" in line for line in plan.splitlines() if "Join Inner" in line and "chunk_id" in line), plan
    assert [(x.chunk_id, x["rank"]) for x in found.orderBy("rank").collect()] == [("c3", 1), ("c0", 2)] and bad.count() == 0


def test_searches_done_ahead_are_not_repeated(spark, monkeypatch):
    chunks = spark.createDataFrame([(k, f"common w{k % 7} w{k}") for k in range(60)], "chunk_id long, text string")
    index = search.Bm25Index.build(chunks)
    asked = spark.createDataFrame([("a", "common w3 w3"), ("b", "w5 w50"), ("c", "w5 w50"), ("d", ""), ("e", None), ("f", "unknown")], "query_id string, query string")
    more = asked.unionByName(spark.createDataFrame([("g", "w2 w2")], "query_id string, query string"))
    key = lambda found: sorted((x.query_id, x["rank"], x.chunk_id, x.score, x.source) for x in found.collect())
    want = {(n, k): key(index.search(q, k)) for n, q in enumerate((asked, more)) for k in (3, 5, 7)}
    ahead = index.ahead(asked, 5)
    assert all(key(ahead.search(q, k)) == want[n, k] for n, q in enumerate((asked, more)) for k in (3, 5, 7))
    monkeypatch.setattr(search.Bm25Index, "search", None)
    assert key(ahead.search(asked, 5)) == want[0, 5] and len(want[0, 5]) == 15


def test_equal_vectors_take_part_once(spark, monkeypatch):
    """No bucket of copies is dealt out, no bucket has a Python call of its own; every pair of copies is told."""
    monkeypatch.setattr(near, "PART", 50)
    monkeypatch.setattr(near, "COPIES", 30)
    rows = [(k, [1.0, 0.5, 0.0]) for k in range(0, 240, 2)] + [(k, [1.0, 0.6, 0.0]) for k in range(1, 7, 2)] + [(500, [0.0, 0.0, 1.0]), (501, [0.0, 0.0, 0.0]), (502, [0.0, 0.0, 0.0])]
    frame = spark.createDataFrame(rows, "node_id long, vector array<double>").repartition(3)
    monkeypatch.setattr(type(frame.groupBy("node_id")), "applyInArrow", None)
    got = [(r.a, r.b) for r in graph.synonym_pairs(frame).collect()]
    near_ones = sorted([*range(0, 240, 2), 1, 3, 5])
    assert sorted(got) == [(a, b) for i, a in enumerate(near_ones) for b in near_ones[i + 1 :]]
