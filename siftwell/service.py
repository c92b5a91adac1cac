"""The engine's service as plain handlers: each returns (status, body); any HTTP front may call them."""

from __future__ import annotations

import base64
import binascii
import json
import re
import sqlite3
import threading
import time
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.operators import ledger
from siftwell.plans import costs, records
from siftwell.plans.answer import answer_traced
from siftwell.plans.config import AUTO, FORCE_S1, FORCE_S2, PRESETS, preset
from siftwell.plans.retrieve import Unavailable, retrieve
from siftwell.plans.runner import load, run
from siftwell.sources import files, sinks

LONGEST_QUERY = 4000
CORPUS_ID = re.compile(r"[a-z0-9][a-z0-9_-]{0,63}")
#: Dollars that a query of the demo counts for.
QUERY_USD = 0.02
QUEUED, RUNNING, SUCCEEDED, FAILED, INTERRUPTED = "queued", "running", "succeeded", "failed", "interrupted"


@dataclass
class Job:
    job_id: str
    kind: str
    params: dict
    status: str = QUEUED
    error: str | None = None
    created_at: float = field(default_factory=time.time)
    events: list[dict] = field(default_factory=list)

    def say(self, message: str, progress: float | None = None) -> None:
        self.events.append({"seq": len(self.events) + 1, "ts": time.time(), "message": message, "progress": progress})


class Store:
    """Jobs, traces and the ledger of requests, in a file of the service's host; without a path in memory."""

    def __init__(self, path: str | None = None):
        self.db, self.lock = sqlite3.connect(path or ":memory:", check_same_thread=False, isolation_level=None), threading.RLock()
        self._do("create table if not exists jobs (job_id text primary key, doc text)")
        self._do("create table if not exists traces (trace_id text, seq integer, doc text, primary key (trace_id, seq))")
        self._do("create table if not exists requests (ip text, s integer)")
        self._do("create index if not exists by_second on requests (s)")

    def _do(self, statement: str, *values) -> list[tuple]:
        with self.lock:
            return self.db.execute(statement, values).fetchall()

    def save_job(self, job: Job) -> None:
        self._do("insert or replace into jobs values (?, ?)", job.job_id, json.dumps(job.__dict__))

    def jobs(self) -> dict[str, Job]:
        return {job_id: Job(**json.loads(doc)) for job_id, doc in self._do("select job_id, doc from jobs")}

    def add_trace(self, trace_id: str, events: list[dict]) -> None:
        for event in events:
            self._do("insert into traces values (?, ?, ?)", trace_id, event["seq"], json.dumps(event))

    def trace(self, trace_id: str) -> list[dict]:
        return [json.loads(doc) for (doc,) in self._do("select doc from traces where trace_id = ? order by seq", trace_id)]

    def admit(self, ip: str, now: int) -> str:
        """Check, then record: the address's last minute and UTC day, and the day's budget of all, as in the ledger's windows."""
        with self.lock:
            day = now // 86_400
            self._do("delete from requests where s < ?", day * 86_400 - 60)
            recent = self._do("select count(*) from requests where ip = ? and s > ? and s <= ?", ip, now - 60, now)[0][0]
            today = self._do("select count(*) from requests where ip = ? and s / 86400 = ?", ip, day)[0][0]
            spent = QUERY_USD * self._do("select count(*) from requests where s / 86400 = ?", day)[0][0]
            why = "minute" if recent >= ledger.PER_MINUTE else "day" if today >= ledger.PER_DAY else "budget" if spent >= ledger.BUDGET else "ok"
            if why == "ok":
                self._do("insert into requests values (?, ?)", ip, now)
            return why


class Jobs:
    """One job after another; what ran when the process ended counts as interrupted and can be resumed."""

    def __init__(self, store: Store | None = None):
        self.handlers, self.store, self.lock = {}, store or Store(), threading.Lock()
        self.jobs = self.store.jobs()
        self.restart()

    def register(self, kind: str, handler) -> None:
        self.handlers[kind] = handler

    def submit(self, kind: str, params: dict) -> str:
        if kind not in self.handlers:
            raise KeyError(kind)
        job = Job(uuid.uuid4().hex, kind, params)
        self.jobs[job.job_id] = job
        self.store.save_job(job)
        return job.job_id

    def _set(self, job: Job, status: str, error: str | None = None) -> None:
        job.status, job.error = status, error
        self.store.save_job(job)

    def run_queued(self) -> None:
        with self.lock:
            for job in [j for j in self.jobs.values() if j.status == QUEUED]:
                self._set(job, RUNNING)
                try:
                    self.handlers[job.kind](job.params, job)
                    self._set(job, SUCCEEDED)
                except Exception as error:  # noqa: BLE001  a job's failure is its record
                    job.say(f"{type(error).__name__}: {error}")
                    self._set(job, FAILED, f"{type(error).__name__}: {error}")

    def restart(self) -> None:
        for job in self.jobs.values():
            if job.status == RUNNING:
                self._set(job, INTERRUPTED)

    def resume(self, job_id: str) -> bool:
        job = self.jobs[job_id]
        if job.status not in (INTERRUPTED, FAILED):
            return False
        self._set(job, QUEUED)
        return True

    def newest(self, kind: str | None = None) -> list[Job]:
        return sorted((j for j in self.jobs.values() if kind in (None, j.kind)), key=lambda j: -j.created_at)


class App:
    """Handlers over a folder of corpora, each with an ``index`` folder.

    ``state``: a file in which jobs, traces and the ledger outlast the process.
    ``receipts_dir``: run documents that have been committed.  ``examples_dir``:
    saved answers.  ``pdf``: a reader of PDF files for uploads.
    """

    def __init__(self, spark: SparkSession, data_dir: str, demo_corpus: str | None = None, clock=time.time, state: str | None = None, receipts_dir: str | None = None, examples_dir: str | None = None, pdf=None):
        self.receipts_dir, self.examples_dir, self.pdf = receipts_dir, examples_dir, pdf
        self.spark, self.data_dir, self.demo, self.clock = spark, data_dir, demo_corpus, clock
        self.store = Store(state)
        self.jobs = Jobs(self.store)
        self.jobs.register("ingest", self._ingest)
        self.jobs.register("eval", self._eval)

    def health(self) -> tuple[int, dict]:
        return 200, {"ok": files.exists(self.spark, self.data_dir), "presets": list(PRESETS), "demo": self.demo is not None, "formats": [e for e in files.READABLE if e != ".pdf" or self.pdf is not None], "jobs": [] if self.demo is not None else sorted(self.jobs.handlers)}

    def query(self, body: dict, address: str = "local") -> tuple[int, dict]:
        """The best chunks, and with ``answer`` set what is written from them and by which route.

        422 for bad requests and presets that the corpus has no index for, 403 outside the demo corpus, 404 without the corpus, 429 over a limit, 503 if nothing answers.
        The trace has an event for each step, with its model and tokens where it has any.
        """
        text, name, corpus = body.get("query", ""), body.get("preset", "bm25-only"), body.get("corpus_id", "")
        if not isinstance(text, str) or not 1 <= len(text) <= LONGEST_QUERY or name not in PRESETS:
            return 422, {"detail": "the query needs 1 to 4000 characters and a known preset"}
        mode = body.get("route_mode", preset(name).query.route_mode)
        if mode not in (AUTO, FORCE_S1, FORCE_S2):
            return 422, {"detail": f"the route is {AUTO}, {FORCE_S1} or {FORCE_S2}"}
        if self.demo is not None and corpus != self.demo:
            return 403, {"detail": "only the demo corpus can be asked"}
        home = f"{self.data_dir}/{corpus}/index"
        if not corpus or not files.exists(self.spark, f"{home}/chunks"):
            return 404, {"detail": f"no corpus {corpus!r}"}
        if self.demo is not None and (why := self._limit(address)) != "ok":
            return 429, {"detail": f"over the limit: {why}"}
        asked = self.spark.createDataFrame([("q", text)], "query_id string, query string")
        began = time.perf_counter()
        try:
            indexes = load(self.spark, home)
            chunks, said, steps = indexes.chunks.select("chunk_id", "doc_id", "text"), {}, []
            if body.get("answer"):
                out = answer_traced(asked, indexes, preset(name).with_query(route_mode=mode))
                rows, r = out.rows, out.found.head()
                steps = [e.asDict() for e in out.events.orderBy("seq").collect()]  # of one query
                degraded, said = r.flags, {"answer": r.answer, "route": r.route, "cited": r.cited, "hops_used": r.hops_used, "unresolved": r.unresolved}
            else:
                rows, degraded = retrieve(asked, indexes, preset(name))
            found = [r.asDict() for r in rows.join(chunks, "chunk_id").orderBy("rank").collect()]  # top_k_final rows a hop
        except Unavailable as error:
            return 503, {"detail": str(error)}
        except ValueError as error:
            return 422, {"detail": str(error)}
        trace = uuid.uuid4().hex
        rows = [{c: r[c] for c in ("rank", "chunk_id", "doc_id", "score", "source", "hop", "text") if c in r} for r in found]
        events = [("retrieve", {"query": text, "preset": name, "chunks": [r["chunk_id"] for r in rows], "degraded": degraded}), *([("answer", said)] if said else [])]
        events += [(e["node"], {k: e[k] for k in ("model", "input_tokens", "output_tokens", "units", "duration_ms")}) for e in steps]
        spent = (time.perf_counter() - began) * 1000
        self.store.add_trace(trace, [{"trace_id": trace, "seq": k, "node": node, "payload": payload, "duration_ms": spent} for k, (node, payload) in enumerate(events)])
        return 200, {"trace_id": trace, "citations": rows, "degraded": degraded, **said}

    def _limit(self, address: str) -> str:
        return self.store.admit(address, int(self.clock()))

    def trace(self, trace_id: str) -> tuple[int, dict]:
        events = self.store.trace(trace_id)
        return (200, {"events": events}) if events else (404, {"detail": "no such trace"})

    def _documents(self, pattern: str) -> tuple[list[dict], list[dict]]:
        try:
            good, bad = files.json_documents(self.spark, pattern)
            return [json.loads(r.doc) for r in good.select("file", F.to_json("doc").alias("doc")).orderBy("file").collect()], [r.asDict() for r in bad.orderBy("file").collect()]
        except Exception as error:  # noqa: BLE001  Spark says so of a pattern without files
            if "PATH_NOT_FOUND" in str(error):
                return [], []
            raise

    def corpora(self) -> tuple[int, dict]:
        found, errors = self._documents(f"{self.data_dir}/*/index/manifest/*.txt")
        return 200, {"corpora": sorted(found, key=lambda m: m.get("corpus_id", "")), "errors": errors}

    def receipts(self) -> tuple[int, dict]:
        """Those of committed runs, then those of the corpora."""
        found, errors = self._documents(f"{self.receipts_dir}/*.json") if self.receipts_dir else ([], [])
        local, more = self._documents(f"{self.data_dir}/*/*.json")
        return 200, {"receipts": [r for doc in found + local for r in (doc.get("receipts") or ([doc["receipt"]] if "receipt" in doc else []))], "errors": errors + more}

    def examples(self) -> tuple[int, dict]:
        """Saved answers in order of their files; a malformed file is told and hides no other."""
        found, errors = self._documents(f"{self.examples_dir}/*.json") if self.examples_dir else ([], [])
        good = [doc for doc in found if isinstance(doc, dict) and {"query", "response", "events"} <= doc.keys()]
        return 200, {"examples": good, "skipped": len(errors) + len(found) - len(good)}

    def upload(self, corpus: str, sent: dict) -> tuple[int, dict]:
        """``sent``: names of files with their bytes in base64; saved among the corpus's uploads, then a job to ingest them."""
        if self.demo is not None:
            return 403, {"detail": "uploads are closed in the demo"}
        if not isinstance(sent, dict) or not CORPUS_ID.fullmatch(corpus):
            return 422, {"detail": "files by name and a corpus id of a-z, 0-9, _ and - are needed"}
        try:
            known = {re.split(r"[/\\\\]", name)[-1] or "unnamed": base64.b64decode(data, validate=True) for name, data in sent.items()}
        except (binascii.Error, TypeError, ValueError):
            return 422, {"detail": "not base64"}
        if any(name in (".", "..") for name in known):
            return 422, {"detail": "a file needs a name"}
        for name, data in known.items():
            sinks.write_bytes(self.spark, f"{self.data_dir}/{corpus}/uploads/{name}", data)
        return self.submit_ingest(corpus)

    def submit_ingest(self, corpus: str) -> tuple[int, dict]:
        if self.demo is not None:
            return 403, {"detail": "uploads are closed in the demo"}
        if not CORPUS_ID.fullmatch(corpus):
            return 422, {"detail": "a corpus id has a-z, 0-9, _ and -"}
        return 202, {"job_id": self.jobs.submit("ingest", {"corpus_id": corpus})}

    def _ingest(self, params: dict, job: Job) -> None:
        """Uploaded files to a corpus; failures are told, never fatal, unless nothing can be read."""
        from siftwell.operators.chunking import split_oversized
        from siftwell.plans.runner import ingest

        home = f"{self.data_dir}/{params['corpus_id']}"
        good, bad = files.read_uploads(self.spark, f"{home}/uploads", self.pdf)
        for r in bad.collect():  # a row for each file
            job.say(f"{r.file}: {r.error}")
        if not good.head(1):
            raise ValueError("no readable documents")
        parts = split_oversized(good, id_col="file")
        lines: DataFrame = parts.select("doc_id", F.col("doc_id").alias("passage_id"), F.col("doc_id").alias("title"), "text")
        lines.write.mode("overwrite").json(f"{home}/raw/docs.jsonl")
        ingest(self.spark, f"{home}/raw", f"{home}/index", params["corpus_id"])

    def estimate(self, name: str, n: int, cap: float | None = None) -> tuple[int, dict]:
        if name not in PRESETS or n < 1 or (cap is not None and cap <= 0):
            return 422, {"detail": "a known preset, queries and a positive cap are needed"}
        usd = round(costs.estimate([preset(name)], n), 4)
        return (400, {"detail": "the estimate is over the cap", "usd": usd}) if cap is not None and usd > cap else (200, {"usd": usd})

    def submit_eval(self, body: dict) -> tuple[int, dict]:
        """A run of presets over a slice of a corpus's queries, as a job; 400 where the estimate is over the cap."""
        corpus, names, size, cap = str(body.get("corpus_id", "")), body.get("presets") or [], body.get("slice", "smoke"), body.get("spend_cap_usd")
        if self.demo is not None:
            return 403, {"detail": "runs are closed in the demo"}
        if not names or any(n not in PRESETS for n in names) or size not in ("smoke", "full") or (cap is not None and cap <= 0):
            return 422, {"detail": "known presets, a slice (smoke, full) and a positive cap are needed"}
        home = f"{self.data_dir}/{corpus}"
        if not corpus or not files.exists(self.spark, f"{home}/index/chunks") or not all(files.exists(self.spark, f"{home}/raw/{f}") for f in ("queries.jsonl", f"slice-{size}.json")):
            return 404, {"detail": f"no corpus {corpus!r} with this slice of queries"}
        usd = round(costs.estimate([preset(n) for n in names], self._asked(home, size)[0].count()), 4)
        if cap is not None and usd > cap:
            return 400, {"detail": "the estimate is over the cap", "usd": usd}
        run_id = records.run_id(corpus, size, datetime.fromtimestamp(self.clock(), UTC))
        return 202, {"job_id": self.jobs.submit("eval", {"corpus_id": corpus, "presets": list(names), "slice": size, "spend_cap_usd": cap, "run_id": run_id}), "run_id": run_id, "usd": usd}

    def _asked(self, home: str, size: str) -> tuple[DataFrame, DataFrame]:
        from siftwell.operators.prep import gold_rows

        chosen = files.query_slice(self.spark, f"{home}/raw", size)
        return gold_rows(files.slice_queries(files.queries(self.spark, f"{home}/raw/queries.jsonl"), chosen))

    def _eval(self, params: dict, job: Job) -> None:
        """A resumed run goes on with the queries that have no result yet."""
        home = f"{self.data_dir}/{params['corpus_id']}"
        asked, golds = self._asked(home, params["slice"])
        doc = run(self.spark, asked, golds, load(self.spark, f"{home}/index"), params["presets"], params["run_id"], f"{home}/results", params["corpus_id"], params["spend_cap_usd"], size=params["slice"], manifest=files.manifest(self.spark, f"{home}/index/manifest"))
        self.spark.createDataFrame([(json.dumps(doc, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{home}/{params['run_id']}.json")
        job.say(f"{len(doc['receipts'])} receipts", 1.0)

    def job(self, job_id: str) -> tuple[int, dict]:
        job = self.jobs.jobs.get(job_id)
        return (404, {"detail": "no such job"}) if job is None else (200, {"status": job.status, "error": job.error, "events": job.events})

    def resume(self, job_id: str) -> tuple[int, dict]:
        if job_id not in self.jobs.jobs:
            return 404, {"detail": "no such job"}
        return (202, {"status": QUEUED}) if self.jobs.resume(job_id) else (409, {"detail": "the job cannot be resumed"})

    def route(self, method: str, path: str, body: dict, address: str = "local") -> tuple[int, dict]:
        parts = [p for p in path.split("?")[0].split("/") if p]
        match (method, *parts):
            case ("GET", "health"):
                return self.health()
            case ("POST", "query"):
                return self.query(body, address)
            case ("GET", "traces", trace_id):
                return self.trace(trace_id)
            case ("GET", "corpora"):
                return self.corpora()
            case ("POST", "corpora", "ingest"):
                corpus = str(body.get("corpus_id", ""))
                return self.upload(corpus, body["files"]) if "files" in body else self.submit_ingest(corpus)
            case ("GET", "demo", "examples"):
                return self.examples()
            case ("GET", "receipts"):
                return self.receipts()
            case ("GET", "jobs", job_id):
                return self.job(job_id)
            case ("POST", "jobs", job_id, "resume"):
                return self.resume(job_id)
            case ("POST", "eval", "estimate"):
                return self.estimate(body.get("preset", ""), int(body.get("n", 0)), body.get("spend_cap_usd"))
            case ("POST", "eval", "runs"):
                return self.submit_eval(body)
            case ("GET", "eval", "runs"):
                return 200, {"runs": [{"job_id": j.job_id, "status": j.status} for j in self.jobs.newest("eval")]}
        return 404, {"detail": "no such path"}


def serve(app: App, port: int = 8000) -> ThreadingHTTPServer:
    """A small HTTP front; the caller runs ``serve_forever``."""

    class Handler(BaseHTTPRequestHandler):
        def _answer(self, method: str) -> None:
            raw = self.rfile.read(int(self.headers.get("Content-Length") or 0))
            try:
                body = json.loads(raw or b"{}")
            except ValueError:
                status, out = 422, {"detail": "not JSON"}
            else:
                first = (self.headers.get("X-Forwarded-For") or "").split(",")[0].strip()
                status, out = app.route(method, self.path, body, first or self.client_address[0])
            data = json.dumps(out).encode()
            self.send_response(status)
            self.send_header("Content-Type", "application/json")
            self.send_header("Content-Length", str(len(data)))
            self.end_headers()
            self.wfile.write(data)

        def do_GET(self) -> None:
            self._answer("GET")

        def do_POST(self) -> None:
            self._answer("POST")

    return ThreadingHTTPServer(("127.0.0.1", port), Handler)
