"""Golden values of the library's operators."""

import hashlib
import json
import math
import random
import uuid

import pytest
from pyspark.sql import functions as F

from siftwell.functions import text as X
from siftwell.functions import vectors as V
from siftwell.operators import agent, chunking, evaluate, graph, ledger, prep, search
from siftwell.plans import costs, records
from siftwell.plans.config import PRESETS, preset
from siftwell.plans.retrieve import Indexes, Unavailable, embed_chunks, retrieve
from siftwell.sources import files, sinks
from siftwell.streaming import logs


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).head()[0]


# ---- text


@pytest.mark.parametrize("text,want", [("The  Eiffel Tower!", "eiffel tower"), ("A dog, an apple, the end.", "dog apple end"), ("Théâtre a", "théâtre"), ("", "")])
def test_normal_answer(spark, text, want):
    assert one(spark, X.normal_answer(F.col("t")), t=text) == want


def test_tokens_split_on_all_white_space(spark):
    text = " a b\x1cc d\u0085e \n"
    assert one(spark, X.tokens(F.col("t")), t=text) == text.split()


def test_ids(spark):
    assert one(spark, X.content_id("nq-", F.col("t")), t="hello world") == "nq-2aae6c35c94fcfb4"
    assert one(spark, X.uuid5(F.col("t")), t="chunk:é:1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "chunk:é:1"))
    assert one(spark, F.struct(*X.chunk_parts(F.col("t"))), t="a:b:12") == ("a:b", 12)


@pytest.mark.parametrize("a,b,f1", [("Paris France", "Paris", 2 / 3), ("", "Paris", 0), ("the", "a", 1), ("x x y", "x x", 0.8)])
def test_token_f1(spark, a, b, f1):
    assert math.isclose(one(spark, X.token_f1(F.col("a"), F.array("b")), a=a, b=b), f1)


def test_overlap_text(spark):
    words = F.split(F.lit("a b c d"), " ")
    assert one(spark, X.overlap_text(words, F.lit(10), F.lit(12), F.lit(20))) == "c d"
    assert one(spark, X.overlap_text(words, F.lit(10), F.lit(14), F.lit(20))) is None


def test_hash_embedding(spark):
    raw = [b / 255 - 0.5 for b in hashlib.sha256(b"text").digest()]
    size = math.sqrt(sum(x * x for x in raw))
    got = one(spark, V.hash_embedding(F.col("t")), t="text")
    assert all(math.isclose(x, y / size, abs_tol=1e-12) for x, y in zip(got, raw, strict=True))
    assert one(spark, V.unit(F.array(F.lit(0.0), F.lit(0.0)))) == [0.0, 0.0]


# ---- chunks


def sentence(n):
    return ["w"] * (n - 1) + ["w."]


def test_packed_windows():
    pack = chunking.packed_windows
    assert pack(["w"] * 5, 8, 2) == [(0, 5)]
    assert pack(["w"] * 10, 4, 1) == [(0, 4), (3, 7), (6, 10)]
    assert pack([], 4, 0) == []
    words = [w for n in (6, 5, 6, 7, 5) for w in sentence(n)]
    assert pack(words, 12, 5) == [(0, 11), (6, 17), (17, 29)]
    assert pack(sentence(30), 12, 5) == [(0, 12), (7, 19), (14, 26), (21, 30)]


@pytest.mark.parametrize("size,overlap", [(0, 0), (4, 4), (4, 5), (4, -1)])
def test_sizes_are_checked(size, overlap):
    with pytest.raises(ValueError):
        chunking.check_sizes(size, overlap)


def test_chunk_positions(spark):
    rows = [("d", "p1", 0, " ".join(["w"] * 11)), ("d", "p2", 1, " ".join(["v"] * 13)), ("e", "p3", 0, None)]
    got = chunking.chunk(spark.createDataFrame(rows, "doc_id string, passage_id string, ord int, text string"), 100, 10).collect()
    assert sorted((x.chunk_id, x.passage_id, x.start_token, x.end_token) for x in got) == [("d:0", "p1", 0, 11), ("d:1", "p2", 0, 13)]


def test_split_oversized(spark):
    text = "a" * 7 + "\n\n" + "b" * 25 + "\n\n" + "c" * 3
    parts = sorted(chunking.split_oversized(spark.createDataFrame([("x", text), ("y", "short")], "doc_id string, text string"), 10).collect(), key=lambda r: (r.doc_id[0], r.part))
    assert "".join(p.text for p in parts if p.doc_id.startswith("x")) == text and all(len(p.text) <= 10 for p in parts)
    assert [p.doc_id for p in parts][-1] == "y" and parts[0].doc_id == "x#part0"


# ---- search


def ranked_list(spark, ids, query="q"):
    return spark.createDataFrame([(query, i, k + 1) for k, i in enumerate(ids)], "query_id string, chunk_id string, rank int")


def test_rrf(spark):
    got = search.rrf([ranked_list(spark, "abc"), ranked_list(spark, "bd")]).orderBy("rank").collect()
    assert [x.chunk_id for x in got] == ["b", "a", "d", "c"]
    assert math.isclose(got[0].score, 1 / 62 + 1 / 61) and math.isclose(got[3].score, 1 / 63)
    tie = search.rrf([ranked_list(spark, "b"), ranked_list(spark, "a")], 1).collect()
    assert [x.chunk_id for x in tie] == ["a"]
    assert math.isclose(search.rrf([ranked_list(spark, "a")], rrf_k=10).head().score, 1 / 11)


CORPUS = [("d1:0", "d1", "Paris is the capital of France"), ("d2:0", "d2", "Berlin lies on the Spree"), ("d3:0", "d3", "The capital city of France is large and old and grey")]


@pytest.fixture(scope="module")
def indexes(spark):
    chunks = spark.createDataFrame([(c, d, t, 0, k) for k, (c, d, t) in enumerate(CORPUS)], "chunk_id string, doc_id string, text string, position int, ord int")
    return Indexes(chunks, search.Bm25Index.build(chunks), embed_chunks(chunks))


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame([("q", "capital of france")], "query_id string, query string")


def ids(rows):
    return [x.chunk_id.split(":")[0] for x in rows.orderBy("rank").collect()]


def test_presets_and_flags(spark, indexes, asked):
    assert list(PRESETS) == ["bm25-only", "dense-rrf", "contextual", "rerank", "graph", "graph-rrf", "router-on"]
    rows, degraded = retrieve(asked, indexes, preset("bm25-only"))
    assert ids(rows) == ["d1", "d3"] and degraded == [] and {x.source for x in rows.collect()} == {"bm25"}
    rows, _ = retrieve(asked, indexes, preset("dense-rrf"))
    assert len(ids(rows)) == 3 and {x.source for x in rows.collect()} == {"rrf"}
    rows, _ = retrieve(asked, indexes, preset("rerank"))
    assert {x.source for x in rows.collect()} == {"rerank"}
    assert len(ids(retrieve(asked, indexes, preset("dense-rrf").with_query(top_k_final=2))[0])) == 2
    same = asked.select("query_id", F.lit(CORPUS[1][2]).alias("query"))
    top = retrieve(same, indexes, preset("dense-rrf").with_query(bm25=False))[0].orderBy("rank").head()
    assert top.chunk_id == "d2:0" and top.score > 0.99
    with pytest.raises(ValueError):
        preset("nothing")
    with pytest.raises(ValueError):
        retrieve(asked, indexes, preset("graph"))


def test_degradation(spark, indexes, asked):
    rows, degraded = retrieve(asked, indexes, preset("dense-rrf"), failing=frozenset({"dense"}))
    assert ids(rows) == ["d1", "d3"] and degraded == ["dense-skipped"]
    rows, degraded = retrieve(asked, indexes, preset("rerank"), failing=frozenset({"rerank"}))
    assert degraded == ["rerank-skipped"] and {x.source for x in rows.collect()} == {"rrf"}
    with pytest.raises(Unavailable):
        retrieve(asked, indexes, preset("dense-rrf").with_query(bm25=False), failing=frozenset({"dense"}))


def test_bm25_round_trip_and_edges(spark, indexes, asked, tmp_path):
    indexes.bm25.write(str(tmp_path))
    again = search.Bm25Index.read(spark, str(tmp_path))
    assert ids(again.search(asked, 50)) == ["d1", "d3"]
    assert again.search(spark.createDataFrame([("q", "the of")], "query_id string, query string"), 5).count() == 0


def test_dense_blocks_agree(spark):
    r = random.Random(1)
    v = [(f"c{k:03}", [r.gauss(0, 1) for _ in range(8)]) for k in range(60)]
    chunks = spark.createDataFrame(v, "chunk_id string, vector array<double>").repartition(4)
    queries = spark.createDataFrame(v[:7], "query_id string, vector array<double>")
    a = search.dense_search(queries, chunks, 5).orderBy("query_id", "rank").collect()
    b = search.dense_search(queries, chunks, 5, block=2).orderBy("query_id", "rank").collect()
    assert a == b and len(a) == 35 and all(x.chunk_id == x.query_id for x in a if x.rank == 1)
    assert search.dense_search(queries, chunks, 0).count() == 0


# ---- graph


EDGES = [(0, 1), (1, 2), (2, 3), (0, 4)]


def masses(spark, seeds, edges=EDGES):
    undirected = spark.createDataFrame([(a, b, "relation", 1.0) for a, b in edges], "src int, dst int, kind string, weight double")
    nodes = spark.createDataFrame([(k,) for k in range(6)], "node_id int")
    rows = spark.createDataFrame([("q", n, m) for n, m in seeds], "query_id string, node_id int, mass double")
    return {x.node_id: x.mass for x in graph.pagerank(graph.adjacency(undirected), nodes, rows).collect()}


def test_pagerank(spark):
    x = masses(spark, [(0, 1.0)])
    assert math.isclose(sum(x.values()), 1) and max(x, key=x.get) == 0
    assert x[1] > x[2] > x[3] and x[1] > x[4] and 5 not in x
    y = masses(spark, [(0, 7.0)])
    assert all(math.isclose(x[k], y[k]) for k in x)
    lone = masses(spark, [(5, 1.0), (0, 1.0)])
    assert math.isclose(sum(lone.values()), 1) and lone[5] > 0
    assert math.isclose(sum(masses(spark, [(0, 0.0)]).values()), 1)


def test_graph_build(spark):
    chunks = spark.createDataFrame([(f"c{k}", k, f"text {k}") for k in range(2)], "chunk_id string, ord int, text string")
    triples = spark.createDataFrame([("c0", " Paris ", "in", "France"), ("c1", "PARIS", "has", "Seine"), ("c1", "x", "is", "X")], "chunk_id string, subject string, relation string, object string")
    nodes = graph.nodes(chunks, triples)
    assert [(x.node_id, x.kind, x.text) for x in nodes.orderBy("node_id").collect()] == [
        (0, "passage", "text 0"), (1, "passage", "text 1"), (2, "phrase", "france"), (3, "phrase", "paris"), (4, "phrase", "seine"), (5, "phrase", "x")]
    found = {(x.src, x.dst, x.kind) for x in graph.edges(nodes, triples).collect()}
    assert found == {(2, 3, "relation"), (3, 4, "relation"), (0, 2, "appears_in"), (0, 3, "appears_in"), (1, 3, "appears_in"), (1, 4, "appears_in"), (1, 5, "appears_in")}
    vectors = nodes.withColumn("vector", V.hash_embedding(F.col("text")))
    asked = spark.createDataFrame([("q", "text 1")], "query_id string, query string").withColumn("vector", V.hash_embedding(F.col("query")))
    assert graph.graph_search(asked, vectors, graph.edges(nodes, triples), 1).head().chunk_id == "c1"


# ---- alignment, metrics, records


@pytest.mark.parametrize("start,end,hit", [(0, 15, True), (0, 14, False), (12, 30, True), (20, 30, False)])
def test_span_hit(spark, start, end, hit):
    assert one(spark, evaluate.span_hit(F.lit(start), F.lit(end), F.lit(10), F.lit(20))) is hit


def test_retrieval_metrics(spark):
    golds = [("q", 0, "passage", "p1", None, None, None), ("q", 1, "span", None, "d", 10, 20), ("r", 0, "passage", "p9", None, None, None)]
    golds = spark.createDataFrame(golds, "query_id string, gold_idx int, gold_type string, passage_id string, doc_id string, gold_start int, gold_end int")
    rows = [("q", 2, "p1", "x", 0, 5), ("q", 6, "p2", "d", 0, 15), ("q", 1, "p3", "e", 0, 30), ("r", 3, "p9", "x", 0, 5)]
    rows = spark.createDataFrame(rows, "query_id string, rank int, passage_id string, doc_id string, start_token int, end_token int")
    got = {x.query_id: (x.recall, x.mrr, x.first_rank) for x in evaluate.retrieval_metrics(evaluate.hits(rows, golds), golds).collect()}
    assert got["q"] == (0.5, 0.5, 2) and got["r"][0] == 1.0 and math.isclose(got["r"][1], 1 / 3)
    empty = golds.withColumn("gold_end", F.lit(10)).where("gold_type = 'span'")
    with pytest.raises(Exception, match="empty gold span"):
        evaluate.hits(rows, empty).collect()


def test_run_metrics_null_recall_with_hops(spark):
    rows = [("r", "a", "1", "ok", "s1", 1.0, 1.0, 0.0, 0.4, 0.0045, 10.0), ("r", "a", "2", "abstained", "s1", 0.0, 0.0, 0.0, 0.4, 0.0045, 30.0), ("r", "a", "3", "failed", None, None, None, None, None, None, 20.0),
            ("r", "b", "1", "ok", "s2", 1.0, 1.0, 1.0, 1.0, 0.1, 5.0), ("r", "b", "2", "ok", "graph", 0.0, 0.0, 1.0, 1.0, 0.1, 5.0)]
    df = spark.createDataFrame(rows, "run_id string, preset string, query_id string, status string, route string, recall double, mrr double, em double, f1 double, usd double, latency_ms double")
    got = {x.preset: x for x in evaluate.run_metrics(df).collect()}
    a, b = got["a"], got["b"]
    assert (a.recall_at_5, a.mrr_at_3, a.n_failed, a.n_abstained, a.latency_p50, a.latency_p95, a.recall_union_of_hops) == (0.5, 0.5, 1, 1, 20.0, 30.0, None)
    assert (b.recall_at_5, b.mrr_at_3, b.recall_union_of_hops, b.graph_route_precision, b.n_s2, b.n_graph) == (None, None, 0.5, 0.0, 1, 1)


def test_anchors_and_flags(spark):
    metrics = spark.createDataFrame([("r", "contextual", 0.6, None), ("r", "rerank", 0.75, 0.5)], "run_id string, preset string, recall_at_5 double, mrr_at_3 double")
    got = records.anchors(metrics).collect()
    assert [(x.preset, x.metric, x.measured, x.direction_matches) for x in got] == [("rerank", "recall_at_5", 0.15, True)]
    rows = spark.createDataFrame([("r", 0, None), ("r", 1, "a"), ("r", 2, None), ("r", 3, "a"), ("r", 4, "b")], "run_id string, ladder int, dense_hash string")
    assert [x.cross_index for x in records.cross_index(rows).orderBy("ladder").collect()] == [False, False, False, False, True]
    doc = records.open_envelope(records.envelope("r", [{"preset": "a"}]))
    assert doc["receipts"] == [{"preset": "a"}]
    assert records.open_envelope(json.dumps({"schema_version": 1, "receipt": {"x": 1}}))["receipts"] == [{"x": 1}]
    with pytest.raises(ValueError):
        records.open_envelope(json.dumps({"schema_version": 2}))


def test_costs(spark):
    assert math.isclose(costs.estimate([preset("bm25-only")], 10), 0.144)
    assert math.isclose(costs.estimate([preset("rerank")], 1), 0.0169072)
    assert math.isclose(costs.estimate([preset("router-on")], 100), 3.04216)
    assert math.isclose(costs.query_usd(preset("bm25-only"), True) - costs.query_usd(preset("bm25-only")), 0.0195)
    with pytest.raises(KeyError):
        costs.tokens_usd("nothing", 1, 1)
    bad = spark.createDataFrame([("t", "nothing", 1, 1)], "trace_id string, model string, input_tokens int, output_tokens int")
    with pytest.raises(Exception, match="no price"):
        costs.trace_totals(bad).collect()


# ---- preparation


def test_html_tokens(spark):
    raw = [("<p>", True), ("Hello", False), ("big world", False), ("<table>", True), ("x", False), ("</p>", True)]
    df = spark.createDataFrame([("d", k, t, h) for k, (t, h) in enumerate(raw)], "doc_id string, pos int, token string, is_html boolean")
    seen = prep.visible_spans(df)
    assert [(x.start, x.end) for x in seen.orderBy("pos").collect()] == [(None, None), (0, 1), (1, 3), (None, None), (3, 4), (None, None)]
    spans = spark.createDataFrame([("d", 0, 3), ("d", 2, 5), ("d", 0, 1)], "doc_id string, first int, last int")
    got = {(x["first"], x["last"]): (x.start_token, x.end_token) for x in prep.remap_spans(spans, seen).collect()}
    assert got == {(0, 3): (0, 3), (2, 5): (1, 4), (0, 1): (None, None)}


def test_majority(spark):
    rows = [("a", 10, 20), ("a", 10, 20), ("a", 30, 40), ("a", None, None), ("b", 1, 2), ("c", 30, 40), ("c", 10, 20)]
    got = {x.example_id: (x.start_token, x.end_token) for x in prep.majority_spans(spark.createDataFrame(rows, "example_id string, start_token int, end_token int")).collect()}
    assert got == {"a": (10, 20), "c": (10, 20)}


def test_multi_hop_records(spark):
    kind = "id string, question string, answer string, answer_aliases array<string>, paragraphs array<struct<idx:int,title:string,paragraph_text:string,is_supporting:boolean>>, question_decomposition array<struct<paragraph_support_idx:int>>"
    good = ("e", "q?", "a", ["b"], [(0, "T", "x", True), (1, "U", "y", False)], [(0,)])
    queries, passages = prep.multi_hop_records(spark.createDataFrame([good], kind))
    want = "mu-" + hashlib.sha1(b"T\nx").hexdigest()[:16]
    assert queries.head().passage_ids == [want] and passages.count() == 2 and queries.head().gold_answers == ["a", "b"]
    with pytest.raises(Exception, match="supports differ"):
        prep.multi_hop_records(spark.createDataFrame([(*good[:5], [(1,)])], kind))[0].collect()


# ---- agent


def state(spark, **changes):
    base = {"query_id": "q", "subqueries": ["a", "b", "c"], "hop_index": 0, "hops_used": 1, "tokens_used": 0, "contradiction_retried": False, "verdict": "sufficient"} | changes
    kind = "query_id string, subqueries array<string>, hop_index int, hops_used int, tokens_used long, contradiction_retried boolean, verdict string"
    df = spark.createDataFrame([tuple(base.values())], kind)
    return df.withColumns({"refined_query": F.lit(None).cast("string"), "contradiction_flag": F.lit(False), "exhausted": F.lit(False), "unresolved": F.array().cast("array<string>"), "next": F.lit("grade")})


@pytest.mark.parametrize(
    "changes,want",
    [
        ({}, ("retrieve_hop", 1, False, [])),
        ({"hop_index": 2}, ("synthesise", 2, False, [])),
        ({"hops_used": 3}, ("synthesise", 0, True, ["b", "c"])),
        ({"verdict": "insufficient"}, ("refine", 0, False, [])),
        ({"verdict": "insufficient", "tokens_used": 50_000}, ("synthesise", 0, True, ["a", "b", "c"])),
        ({"verdict": "contradictory"}, ("retrieve_hop", 0, False, [])),
        ({"verdict": "contradictory", "contradiction_retried": True}, ("retrieve_hop", 1, False, [])),
    ],
)
def test_grade(spark, changes, want):
    df = state(spark, **changes)
    x = agent.grade(df, F.col("verdict")).head()
    assert (x.next, x.hop_index, x.exhausted, x.unresolved) == want
    assert x.contradiction_flag is (changes.get("contradiction_retried", False))


def test_loop(spark):
    asked = spark.createDataFrame([("two", "x"), ("none", "y"), ("many", "z")], "query_id string, query string")
    parts = {"two": ["s1", "s2"], "none": [], "many": ["1", "2", "3", "4", "5"]}
    split = spark.createDataFrame([(k, v, 10) for k, v in parts.items()], "query_id string, subqueries array<string>, tokens int")
    retrieve_one = lambda q: q.select("query_id", F.lit(1).alias("rank"), F.concat("query_id", "query").alias("chunk_id"))
    judge = lambda q, rows: q.select("query_id", F.lit("sufficient").alias("verdict"), F.lit(None).cast("string").alias("refined"), F.lit(5).alias("tokens"))
    states, hops = agent.Loop(lambda q: split, retrieve_one, judge).run(asked)
    got = {x.query_id: x for x in states.collect()}
    assert all(x.next == "synthesise" for x in got.values())
    assert (got["two"].hops_used, got["none"].hops_used, got["many"].hops_used) == (2, 0, 3) and got["many"].truncated
    assert evaluate.union_of_hops(hops).count() == 5


# ---- ledgers, files, streams


def test_ledgers(spark):
    rows = spark.createDataFrame([("a", 0), ("a", 10), ("a", 60), ("a", 60), ("b", 61), ("a", 86_400)], "ip string, s long")
    got = sorted((x.ip, x.s, x.recent) for x in ledger.minute_counts(rows, "ip", "s").collect())
    assert got == [("a", 0, 0), ("a", 10, 1), ("a", 60, 1), ("a", 60, 1), ("a", 86_400, 0), ("b", 61, 0)]
    days = {(x.ip, x.s): (x.day, x.today) for x in ledger.day_counts(rows, "ip", "s").collect()}
    assert days["a", 60] == ("1970-01-01", 2) and days["a", 86_400] == ("1970-01-02", 0)
    spend = spark.createDataFrame([("r", k, 0.0045, 0.0144, 0.016) for k in range(3)], "run string, k int, usd double, est double, cap double")
    assert [x.admitted for x in ledger.within_cap(spend, "run", ["k"], "usd", "est", "cap").orderBy("k").collect()] == [True, False, False]
    jobs = spark.createDataFrame([("j", "running"), ("k", "failed"), ("l", "succeeded")], "job_id string, status string")
    assert {x.job_id: (x.status, x.resumable) for x in ledger.interrupted(jobs).collect()} == {"j": ("interrupted", True), "k": ("failed", True), "l": ("succeeded", False)}


def test_files(spark, tmp_path):
    (tmp_path / "docs.jsonl").write_text('{"doc_id": "d", "passage_id": "p", "text": "x"}\n\n{"id": "e", "title": "t", "text": "y"}\n')
    got = files.passages(spark, str(tmp_path / "docs.jsonl")).orderBy("ord").collect()
    assert [(x.doc_id, x.passage_id, x.title, x.text) for x in got] == [("d", "p", "", "x"), ("e", "e", "t", "y")]
    assert files.count_queries(spark, str(tmp_path / "none.jsonl")) == 0
    (tmp_path / "slice-smoke.json").write_text('["b", "a"]')
    chosen = files.query_slice(spark, str(tmp_path), "smoke")
    every = spark.createDataFrame([("a",), ("b",)], "query_id string")
    assert [x.query_id for x in files.slice_queries(every, chosen).orderBy("ord").collect()] == ["b", "a"]
    with pytest.raises(ValueError):
        files.slice_queries(every.where("query_id = 'a'"), chosen)
    with pytest.raises(ValueError):
        files.query_slice(spark, str(tmp_path), "other")
    up = tmp_path / "up"
    up.mkdir()
    (up / "a.html").write_text("<html><head><title>t</title></head><body><p>Hi</p><script>x</script></body></html>")
    (up / "b.txt").write_text("text")
    (up / "c.exe").write_bytes(b"\x00")
    (up / "d.md").write_bytes(b"\xff\xfe")
    good, bad = files.read_uploads(spark, str(up))
    assert {(x.file, x.text) for x in good.collect()} == {("a.html", "Hi"), ("b.txt", "text")}
    assert {x.file for x in bad.collect()} == {"c.exe", "d.md"}
    (tmp_path / "r1.json").write_text('{"a": 1}')
    (tmp_path / "r2.json").write_text("{")
    docs, errors = files.json_documents(spark, str(tmp_path / "r*.json"))
    assert docs.count() == 1 and [x.file for x in errors.collect()] == ["r2.json"]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a", [1.0, 2.0]), ("b", [3.0, 4.0])], "chunk_id string, v array<double>")
    assert sinks.table_hash(rows, "chunk_id", "v") == sinks.table_hash(rows.repartition(3).orderBy(F.desc("chunk_id")), "chunk_id", "v")
    assert sinks.table_hash(rows, "chunk_id", "v") != sinks.table_hash(rows.where("chunk_id = 'a'"), "chunk_id", "v")
    assert sinks.create_if_empty(rows, str(tmp_path / "t")) and not sinks.create_if_empty(rows, str(tmp_path / "t"))
    with pytest.raises(ValueError):
        sinks.write_chunks(rows.limit(0), str(tmp_path / "c"))


def test_streams(spark, tmp_path):
    rows = [(k, f"2024-01-01 00:00:{10 * k:02}", 1, "view", 1.0, "{}") for k in range(6)] + [(9, "2024-01-01 00:05:00", 1, "click", 1.0, "{}")]
    df = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string, value double, props string").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    events = logs.read_events(spark, str(tmp_path / "in"))
    logs.append(events, str(tmp_path / "log"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "log")).count() == 7
    query = logs.admitted(events, per_minute=3).writeStream.format("memory").queryName("admitted").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {x.event_id: x.admitted for x in spark.table("admitted").collect()} == {0: True, 1: True, 2: True, 3: False, 4: False, 5: False, 9: True}
    query = logs.last_status(events).writeStream.format("memory").queryName("status").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("status").head().status == "click"


# ---- the contract with the driver


def test_registry(spark):
    import __spark_entry__

    queries, oracles = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert len(queries) > 55 and set(oracles) <= set(queries)
    assert __spark_entry__.entry(spark).count() > 0


def test_texts_of_an_index_are_dealt_out_by_their_bytes(spark, monkeypatch):
    monkeypatch.setattr(search, "TASK_BYTES", 2_000)
    chunks = spark.range(200).select(F.col("id").alias("chunk_id"), F.concat(F.lit("word number "), F.repeat(F.lit("again "), 15), "id").alias("text")).coalesce(1)
    assert search.text_tasks(chunks) >= 10
    assert search.text_tasks(chunks.limit(0)) == 1
    counted = search.Bm25Index.build(chunks).corpus._jdf.queryExecution().toString()
    assert f"hashpartitioning(chunk_id#" in counted and f", {search.text_tasks(chunks)})" in counted


def test_words_of_a_text_are_found_once_for_its_f1(spark):
    """No pattern runs again for each of a text's words: each text is normalised in one place of the expression."""
    rows = spark.createDataFrame([("a b b c", ["b b x", "a b b c"]), ("", ["the"]), ("a", None), (None, ["x"])], "p string, g array<string>").withColumn("f", X.token_f1(F.col("p"), F.col("g")))
    assert rows._jdf.queryExecution().analyzed().toString().count("translate(") <= 2
    assert [r.f for r in rows.collect()] == [1.0, 1.0, 0.0, 0.0]


def test_chunks_are_the_same_a_few_passages_at_a_time(spark, monkeypatch):
    rows = [(f"d{i}", f"p{i}", 0, " ".join(f"word{j}{'.' if j % 9 == 0 else ''}" for j in range(i * 7))) for i in range(30)]
    passages = spark.createDataFrame(rows, "doc_id string, passage_id string, ord int, text string").coalesce(1)
    every = sorted(chunking.chunk(passages, 16, 4).collect())
    monkeypatch.setattr(chunking, "STEP_ROWS", 7)
    assert every and sorted(chunking.chunk(passages, 16, 4).collect()) == every


def test_masses_of_a_graph_search_are_not_broadcast(spark):
    """Their rows are queries x nodes, however small the seeds are from which Spark estimates them."""
    nodes = spark.createDataFrame([(i, "passage", f"t{i}", f"c{i}", [float(i % 3), 1.0]) for i in range(12)], "node_id long, kind string, text string, chunk_id string, vector array<double>")
    links = spark.createDataFrame([(i, i + 1, "relation", 1.0) for i in range(11)], "src long, dst long, kind string, weight double")
    asked = spark.createDataFrame([("q", [1.0, 1.0])], "query_id string, vector array<double>")
    found = graph.graph_search(asked, nodes, links, 5)
    plan = found._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "HashJoin [node_id" in line]
    assert joins and all("ShuffledHashJoin" in line for line in joins)
    assert found.count() == 5
