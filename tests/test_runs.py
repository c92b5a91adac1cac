"""Ingestion, runs, resuming and the command line on a small corpus."""

import json

import pytest
from pyspark.sql import functions as F

from siftwell import cli
from siftwell.operators.prep import gold_rows
from siftwell.plans import providers
from siftwell.plans.runner import SpendCap, ingest, load, run, run_preset
from siftwell.plans.config import preset
from siftwell.sources import files


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    home = tmp_path_factory.mktemp("data") / "mini"
    raw = home / "raw"
    raw.mkdir(parents=True)
    docs = [("d1", "Otters sleep afloat in kelp. They hold hands."), ("d2", "Kelp grows half a metre a day."), ("d3", "The heron stands beside kelp pools. It is patient.")]
    (raw / "docs.jsonl").write_text("\n".join(json.dumps({"doc_id": d, "passage_id": d, "title": d, "text": t}) for d, t in docs))
    asked = [
        {"query_id": "q1", "question": "who sleeps afloat", "answer": "Otters sleep afloat in kelp.", "answer_aliases": ["Otters"], "gold": {"type": "passage", "passage_ids": ["d1"]}},
        {"query_id": "q2", "question": "which bird stands beside pools", "answer_texts": ["The heron"], "gold": {"type": "span", "doc_id": "d3", "start_token": 0, "end_token": 6}},
    ]
    (raw / "queries.jsonl").write_text("\n".join(map(json.dumps, asked)))
    (raw / "slice-smoke.json").write_text('["q1", "q2"]')
    return home


def test_ingest_and_run(spark, corpus, tmp_path):
    doc = ingest(spark, str(corpus / "raw"), str(tmp_path / "index"), "mini")
    assert (doc["n_docs"], doc["n_chunks"], doc["n_queries"]) == (3, 3, 2) and set(doc["index_hashes"]) == {"dense_contextual", "dense_isolated", "sparse"}
    asked, golds = gold_rows(files.queries(spark, str(corpus / "raw/queries.jsonl")))
    indexes = load(spark, str(tmp_path / "index"))
    found = run(spark, asked, golds, indexes, ["bm25-only", "rerank", "router-on", "graph"], "r1", str(tmp_path / "results"))
    by = {r["preset"]: r for r in found["receipts"]}
    assert set(by) == {"bm25-only", "rerank"} and {s["preset"] for s in found["skipped"]} == {"router-on", "graph"}
    assert by["bm25-only"]["recall_at_5"] == 1.0 and by["bm25-only"]["em"] == 0.5 and by["bm25-only"]["n_total"] == 2
    again = run(spark, asked, golds, indexes, ["bm25-only", "rerank"], "r1", str(tmp_path / "results"))
    assert {r["n_total"] for r in again["receipts"]} == {2}
    with pytest.raises(SpendCap):
        run_preset(asked, golds, indexes, preset("bm25-only"), "r2", spend_cap=0.01)
    assert run_preset(asked, golds, indexes, preset("bm25-only"), "r2", spend_cap=0.0144).count() == 1


def test_answers_by_route(spark, corpus, tmp_path):
    from siftwell.plans import offline
    from siftwell.plans.answer import Providers, answer, retrieve_each

    triples = spark.createDataFrame([("d1:0", "otters", "sleep in", "kelp"), ("d2:0", "kelp", "grows", "fast")], "chunk_id string, subject string, relation string, object string")
    ingest(spark, str(corpus / "raw"), str(tmp_path / "index"), "mini", triples=triples)
    indexes = load(spark, str(tmp_path / "index"))
    asked = spark.createDataFrame([("a", "who sleeps afloat"), ("b", "heron pools and then kelp metre"), ("c", "otters graph"), ("d", None), ("e", "unsure heron")], "query_id string, query string")
    ways = {"a": ("simple", 0.9), "b": ("complex", 0.9), "c": ("graph", 0.9), "e": ("simple", 0.2)}
    table = spark.createDataFrame([(k, r, c, 7) for k, (r, c) in ways.items()], "query_id string, route string, confidence double, tokens int")
    parts = spark.createDataFrame([("b", ["heron pools", "kelp metre"], 5), ("e", ["heron"], 5)], "query_id string, subqueries array<string>, tokens int")

    def writes(contexts):
        return offline.write(contexts).withColumns({"contradiction": F.col("query_id") == "a", "open_parts": F.array(F.lit("x")), "citations": F.array(F.lit(1), F.lit(99))})

    providers = Providers(lambda q: table, lambda q: parts, offline.judge, writes)
    found, rows = answer(asked, indexes, preset("router-on"), providers)
    by = {x.query_id: x for x in found.collect()}
    assert {k: x.route for k, x in by.items()} == {"a": "s1", "b": "s2", "c": "graph", "d": "s2", "e": "s2"}
    assert by["a"].answer == "Otters sleep afloat in kelp." and by["a"].cited == ["d1:0"] and by["a"].flags == ["contradiction"]
    assert by["b"].hops_used == 2 and set(by["b"].chunk_ids[:1]) == {"d3:0"} and "d2:0" in by["b"].chunk_ids and by["b"].unresolved == ["x"]
    assert by["c"].chunk_ids and {x.route for x in rows.where("query_id = 'c'").collect()} == {"graph"} and by["d"].hops_used == 0
    forced, _ = answer(asked, indexes, preset("rerank"))
    assert {x.route for x in forced.collect()} == {"s1"}
    failures = spark.createDataFrame([("a", "dense"), ("b", "rerank"), ("c", "bm25"), ("c", "dense")], "query_id string, component string")
    got, told = retrieve_each(asked.where("query is not null"), indexes, preset("rerank"), failures)
    assert {x.query_id: x.degraded for x in told.collect()} == {"a": ["dense-skipped"], "b": ["rerank-skipped"], "c": ["failed"], "e": []}
    assert {x.query_id for x in got.collect()} == {"a", "b", "e"} and {x.source for x in got.where("query_id = 'b'").collect()} == {"rrf"}
    gold_queries, golds = gold_rows(files.queries(spark, str(corpus / "raw/queries.jsonl")))
    found = run(spark, gold_queries, golds, indexes, ["router-on", "graph"], "r9", str(tmp_path / "routed"), dataset="musique")
    by = {r["preset"]: r for r in found["receipts"]}
    assert not found["skipped"] and by["router-on"]["n_s1"] == 2 and by["graph"]["n_graph"] == 2 and by["graph"]["recall_at_5"] is None


def test_sources_of_a_corpus(spark, tmp_path):
    from siftwell.sources import sinks

    assert files.dataset_name("musique-dev-300") == "musique" and files.dataset_name("nq-dev-x") == "nq-dev-x"
    (tmp_path / "download_meta.json").write_text(json.dumps({"corpus_id": "nq-dev-20", "dataset": {"hf_id": "a/b", "split": "dev", "revision": "1", "more": 2}}))
    assert files.dataset_info(spark, str(tmp_path), "x") == {"name": "nq", "hf_id": "a/b", "split": "dev", "revision": "1"}
    assert files.dataset_info(spark, str(tmp_path / "none"), "own-dev-3") == {"name": "own"}
    (tmp_path / "m.json").write_text('{"corpus_id": "x"}')
    with pytest.raises(ValueError, match="lacks dataset"):
        files.manifest(spark, str(tmp_path / "m.json"))
    up = tmp_path / "up"
    up.mkdir()
    for name, data in (("a.pdf", b"%first"), ("b.PDF", b"bad"), ("c.txt", b"plain"), ("d.pdf", b"")):
        (up / name).write_bytes(data)

    def reader(data):
        if data == b"bad":
            raise ValueError("broken")
        return data.decode().strip("%")

    good, bad = files.read_uploads(spark, str(up), reader)
    assert {r.file: r.text for r in good.collect()} == {"a.pdf": "first", "c.txt": "plain"}
    assert {r.file: r.error for r in bad.collect()} == {"b.PDF": "ValueError: broken", "d.pdf": "ValueError: no text"}
    assert [r.file for r in files.source_files(good.unionByName(good)).collect()] == ["a.pdf", "c.txt"]
    rows = spark.createDataFrame([("q", "why", "d:0", 1, "so  it is", True), ("q", "why", "d:1", 2, None, False)], "query_id string, question string, chunk_id string, rank int, text string, hit boolean")
    assert sinks.hand_check_report(rows, 5).splitlines()[2:] == ["## q", "", "why", "", "- hit 1 `d:0`: so it is", "- miss 2 `d:1`: "]


def test_commands_of_a_run(spark, corpus, tmp_path, capsys):
    from siftwell.sources import sinks

    data = tmp_path / "data"
    home = data / "musique-dev-2"
    home.mkdir(parents=True)
    (home / "raw").symlink_to(corpus / "raw")
    at = ["--corpus", "musique-dev-2", "--data-dir", str(data)]
    assert cli.main(["eval", *at, "--yes"]) == cli.MISSING
    assert cli.main(["ingest", *at, "--chunk-size", "64", "--chunk-overlap", "8"]) == cli.OK
    doc = files.manifest(spark, str(home / "index/manifest"))
    assert doc["chunking"] == {"chunk_size": 64, "chunk_overlap": 8} and doc["dataset"] == {"name": "musique"}
    triples = tmp_path / "triples.jsonl"
    triples.write_text(json.dumps({"chunk_id": "d1:0", "subject": "Otters", "relation": "sleep in", "object": "kelp"}) + "\n")
    assert cli.main(["build-graph", *at, "--triples", str(tmp_path / "none")]) == cli.MISSING
    assert cli.main(["build-graph", *at, "--triples", str(triples)]) == cli.OK
    assert set(files.manifest(spark, str(home / "index/manifest"))["index_hashes"]) == {"dense_contextual", "dense_isolated", "sparse", "graph"}
    capsys.readouterr()
    assert cli.main(["eval", *at, "--presets", "bm25-only,graph-rrf,router-on", "--yes", "--ragas", "--graph-recognition", "llm", "--run-id", "r1"]) == cli.OK
    doc = json.loads((home / "r1.json").read_text())
    by = {r["preset"]: r for r in doc["receipts"]}
    assert doc["slice"] == "smoke" and doc["corpus_id"] == "musique-dev-2" and not doc["skipped"] and set(by) == {"bm25-only", "graph-rrf", "router-on"}
    assert set(by["bm25-only"]["index_hashes"]) == {"sparse"} and set(by["graph-rrf"]["index_hashes"]) == {"sparse", "dense_contextual"}
    assert by["graph-rrf"]["config"]["query"]["graph_recognition"] and not by["router-on"]["config"]["query"]["graph_recognition"]
    assert by["bm25-only"]["faithfulness"] == 1.0 and 0 < by["bm25-only"]["relevancy"] <= 1 and by["bm25-only"]["judge_spend_untracked"]
    assert [q["query_id"] for q in by["bm25-only"]["per_query"]] == ["q1", "q2"] and by["bm25-only"]["per_query"][0]["answer"]
    assert cli.main(["receipts", "promote", "r2", "--data-dir", str(data)]) == cli.USAGE
    assert cli.main(["receipts", "promote", "r1", "--data-dir", str(data), "--receipts-dir", str(tmp_path / "kept")]) == cli.OK
    kept = json.loads((tmp_path / "kept" / "r1.json").read_text())
    assert set(kept["receipts"][0]["per_query"][0]) == {"query_id", "retrieved_chunk_ids", "latency_ms", "usd", "flags"}
    (tmp_path / "asked.txt").write_text("who sleeps afloat\n\n")
    assert cli.main(["capture", *at, "--queries", str(tmp_path / "asked.txt"), "--to", str(tmp_path / "examples")]) == cli.OK
    (tmp_path / "examples" / "bad.json").write_text("{")
    from siftwell.service import App

    app = App(spark, str(data), receipts_dir=str(tmp_path / "kept"), examples_dir=str(tmp_path / "examples"))
    status, found = app.route("GET", "/demo/examples", {})
    assert status == 200 and [e["query"] for e in found["examples"]] == ["who sleeps afloat"] and found["skipped"] == 1
    assert ["answer" in r["per_query"][0] for r in app.receipts()[1]["receipts"]] == [False] * 3 + [True] * 3
    capsys.readouterr()
    assert cli.main(["ask", *at, "who sleeps afloat"]) == cli.OK and json.loads(capsys.readouterr().out)["answer"]
    assert cli.main(["ask", *at, "who sleeps afloat", "--route", "force_s2"]) == cli.OK
    said = json.loads(capsys.readouterr().out)
    assert said["route"] == "s2" and {e["node"] for e in said["trace"]["events"]} >= {"decompose", "grade", "synthesise"}
    assert app.query({"query": "x", "corpus_id": "musique-dev-2", "route_mode": "other"})[0] == 422
    assert cli.main(["download", "--folder", str(corpus / "raw"), "--corpus", "copy", "--data-dir", str(data)]) == cli.OK
    assert sorted(r.value for r in spark.read.text(str(data / "copy/raw/docs.jsonl")).collect())[0].startswith('{"doc_id"')
    assert cli.main(["ask", *at, "x", "--preset", "none"]) == cli.MISSING
    assert cli.main(["export-vectors", *at, "--to", str(tmp_path / "vectors")]) == cli.OK and spark.read.parquet(str(tmp_path / "vectors")).count() == 3
    assert sinks.copy_corpus(spark, str(home / "index"), str(tmp_path / "copy")) and not sinks.copy_corpus(spark, str(home / "index"), str(tmp_path / "copy"))
    assert load(spark, str(tmp_path / "copy")).edges is not None and not sinks.copy_corpus(spark, str(tmp_path / "none"), str(tmp_path / "other"))


def test_keys_and_records():
    from datetime import UTC, datetime

    from siftwell.plans import records

    assert cli.missing_keys(["bm25-only", "router-on"], environ={}) == ["ANTHROPIC_API_KEY"]
    assert cli.missing_keys(["rerank"], environ={"VOYAGE_API_KEY": "x"}) == ["ANTHROPIC_API_KEY", "COHERE_API_KEY"]
    name = records.run_id("nq-dev-300", "full", datetime(2026, 1, 2, 3, 4, 5, tzinfo=UTC))
    assert name[:-6] == "nq-dev-300-full-20260102-030405-" and set(name[-6:]) <= set("0123456789abcdef")


def test_recognised_phrases_and_assessed_answers(spark):
    from siftwell.plans import offline

    phrases = spark.createDataFrame([("New York",), ("york",), ("Boston",)], "text string")
    asked = spark.createDataFrame([("a", "Is new york big"), ("b", "nothing here"), ("c", None), ("d", "")], "query_id string, query string")
    assert {tuple(r) for r in offline.recognise(asked, phrases).collect()} == {("a", "New York"), ("a", "york")}
    said = spark.createDataFrame([("a", "red fox?", "The fox ran.", ["a fox", "ran far"]), ("b", "x", "", None)], "query_id string, query string, answer string, texts array<string>")
    assert {r.query_id: (round(r.faithfulness, 4), r.relevancy) for r in offline.assess(said).collect()} == {"a": (0.6667, 0.5), "b": (0.0, 0.0)}


def test_command_line(corpus, tmp_path):
    assert cli.main(["ingest", "--corpus", "none", "--data-dir", str(tmp_path)]) == cli.MISSING
    assert cli.main(["eval", "--corpus", "mini", "--presets", "nothing"]) == cli.USAGE
    assert cli.main(["promote", str(tmp_path / "none.json"), "--to", str(tmp_path / "x.json")]) == cli.USAGE
    (tmp_path / "r.json").write_text(json.dumps({"schema_version": 1, "receipts": [{"per_query": [{"query_id": "q", "answer": "a", "route": "s1", "usd": 1}]}]}))
    assert cli.main(["promote", str(tmp_path / "r.json"), "--to", str(tmp_path / "x.json")]) == cli.OK
    assert json.loads((tmp_path / "x.json").read_text())["receipts"][0]["per_query"] == [{"query_id": "q", "usd": 1}]


def test_providers(spark):
    waits, left = [], [3]

    def call():
        left[0] -= 1
        if left[0]:
            raise providers.ProviderError("busy", 429, 7.0 if left[0] == 1 else None)
        return "done"

    assert providers.with_retry(call, sleep=waits.append) == "done" and waits == [1.0, 7.0]
    with pytest.raises(providers.Exhausted):
        providers.with_retry(lambda: (_ for _ in ()).throw(providers.ProviderError("x", 503)), attempts=2, sleep=lambda s: None)
