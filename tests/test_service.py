"""The service's handlers."""

import base64
import json

from siftwell.service import App, FAILED, INTERRUPTED, RUNNING, SUCCEEDED


def test_service(spark, tmp_path):
    up = tmp_path / "mine" / "uploads"
    up.mkdir(parents=True)
    (up / "a.txt").write_text("Walnuts ripen in the valley orchards by late autumn. Pickers shake the boughs.")
    (up / "b.md").write_text("Salt pans line the northern shore.")
    (up / "c.exe").write_bytes(b"x")
    app = App(spark, str(tmp_path))
    assert app.health()[0] == 200 and app.health()[1]["ok"]
    status, body = app.route("POST", "/corpora/ingest", {"corpus_id": "mine"})
    app.jobs.run_queued()
    job = app.route("GET", f"/jobs/{body['job_id']}", {})[1]
    assert status == 202 and job["status"] == SUCCEEDED and any("c.exe" in e["message"] for e in job["events"]), job
    status, found = app.route("POST", "/query", {"query": "walnuts in valley orchards", "corpus_id": "mine", "preset": "dense-rrf"})
    assert status == 200 and found["citations"][0]["doc_id"] == "a.txt" and found["degraded"] == []
    assert app.route("GET", f"/traces/{found['trace_id']}", {})[1]["events"][0]["node"] == "retrieve"
    assert app.route("GET", "/corpora", {})[1]["corpora"][0]["n_docs"] == 2
    assert app.route("POST", "/query", {"query": "", "corpus_id": "mine"})[0] == 422
    assert app.route("POST", "/query", {"query": "x", "corpus_id": "none"})[0] == 404
    assert app.route("POST", "/query", {"query": "x", "corpus_id": "mine", "preset": "graph"})[0] == 422
    assert app.route("GET", "/traces/none", {})[0] == app.route("GET", "/jobs/none", {})[0] == app.route("GET", "/x", {})[0] == 404
    assert app.route("POST", "/eval/estimate", {"preset": "bm25-only", "n": 10})[1] == {"usd": 0.144}
    assert app.route("POST", "/eval/estimate", {"preset": "bm25-only", "n": 10, "spend_cap_usd": 0.1})[0] == 400
    failed = app.submit_ingest("nothing")[1]["job_id"]
    app.jobs.run_queued()
    assert app.job(failed)[1]["status"] == FAILED and app.resume(failed)[0] == 202 and app.resume(body["job_id"])[0] == 409


def test_uploads(spark, tmp_path):
    app = App(spark, str(tmp_path), pdf=lambda data: data.decode())
    assert ".pdf" in app.health()[1]["formats"] and ".pdf" not in App(spark, str(tmp_path)).health()[1]["formats"]
    send = lambda corpus, sent: app.route("POST", "/corpora/ingest", {"corpus_id": corpus, "files": sent})
    assert send("../x", {})[0] == send("x", ["a"])[0] == send("x", {"a.txt": "*"})[0] == send("x", {"..": ""})[0] == 422
    status, body = send("sent", {"../../a.txt": base64.b64encode(b"Reeds grow by the weir.").decode(), "b.pdf": base64.b64encode(b"Mills stand idle.").decode()})
    app.jobs.run_queued()
    assert status == 202 and app.job(body["job_id"])[1]["status"] == SUCCEEDED and (tmp_path / "sent/uploads/a.txt").exists()
    assert app.corpora()[1]["corpora"][0]["n_docs"] == 2
    assert App(spark, str(tmp_path), demo_corpus="demo").upload("x", {})[0] == 403


def test_demo_limits(spark, tmp_path):
    app = App(spark, str(tmp_path), demo_corpus="demo", clock=lambda: 1000.0)
    assert app.query({"query": "x", "corpus_id": "other"})[0] == 403 and app.submit_ingest("x")[0] == 403
    assert [app._limit("a") for _ in range(6)] == ["ok"] * 5 + ["minute"] and app._limit("b") == "ok"


def test_state_outlasts_the_process(spark, tmp_path):
    state = str(tmp_path / "state.db")
    app = App(spark, str(tmp_path), demo_corpus="demo", clock=lambda: 1000.0, state=state)
    job = app.jobs.submit("ingest", {"corpus_id": "x"})
    app.jobs._set(app.jobs.jobs[job], RUNNING)
    app.store.add_trace("t", [{"seq": k, "node": str(k)} for k in range(2)])
    assert [app._limit("a") for _ in range(5)] == ["ok"] * 5
    app = App(spark, str(tmp_path), demo_corpus="demo", clock=lambda: 1000.0, state=state)
    assert app.job(job)[1]["status"] == INTERRUPTED and app.resume(job)[0] == 202
    assert [e["node"] for e in app.trace("t")[1]["events"]] == ["0", "1"]
    assert app._limit("a") == "minute" and app._limit("b") == "ok"
    app.clock = lambda: 1060.0
    assert app._limit("a") == "ok"
    app.clock = lambda: 86_400.0 * 9
    assert app._limit("a") == "ok" and app.store._do("select count(*) from requests") == [(1,)]


def test_runs_and_answers(spark, tmp_path):
    up = tmp_path / "own" / "uploads"
    up.mkdir(parents=True)
    (up / "a.txt").write_text("Otters rest on their backs in kelp beds.")
    (up / "b.txt").write_text("Herons nest in tall trees near ponds.")
    app = App(spark, str(tmp_path))
    app.submit_ingest("own")
    app.jobs.run_queued()
    status, said = app.query({"query": "Where do otters rest?", "corpus_id": "own", "preset": "bm25-only", "answer": True})
    assert status == 200 and said["route"] == "s1" and said["citations"][0]["doc_id"] == "a.txt" and said["answer"]
    events = app.trace(said["trace_id"])[1]["events"]
    assert [e["node"] for e in events][:2] == ["retrieve", "answer"] and events[-1]["node"] == "synthesise" and events[-1]["payload"]["model"] == "answer" and events[-1]["payload"]["input_tokens"] > 0
    asked = {"corpus_id": "own", "presets": ["bm25-only"], "slice": "full"}
    assert app.route("POST", "/eval/runs", asked)[0] == 404
    line = {"query_id": "1", "question": "Where do otters rest?", "answer": "kelp beds", "gold": {"type": "passage", "passage_ids": ["a.txt"]}}
    (tmp_path / "own" / "raw" / "queries.jsonl").write_text(json.dumps(line) + "\n")
    (tmp_path / "own" / "raw" / "slice-full.json").write_text('["1"]')
    assert app.route("POST", "/eval/runs", asked | {"presets": ["x"]})[0] == 422
    assert app.route("POST", "/eval/runs", asked | {"spend_cap_usd": 0.0001})[0] == 400
    status, body = app.route("POST", "/eval/runs", asked)
    app.jobs.run_queued()
    job = app.job(body["job_id"])[1]
    assert status == 202 and job["status"] == SUCCEEDED, job
    assert app.route("GET", "/eval/runs", {})[1]["runs"][0]["job_id"] == body["job_id"]
    assert app.receipts()[1]["receipts"][0]["preset"] == "bm25-only"
