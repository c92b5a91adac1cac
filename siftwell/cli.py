"""Command line: ingest a corpus, build its graph, run an evaluation, promote its record, ask, capture examples, export vectors."""

from __future__ import annotations

import argparse
import glob
import importlib
import json
import os
import sys
from collections.abc import Mapping

from siftwell.plans import costs
from siftwell.plans.config import FORCE_S1, PRESETS, IngestConfig, preset

#: Exit codes: done, missing input or declined, bad usage, over the spend cap.
OK, MISSING, USAGE, OVER_CAP = 0, 1, 2, 3
#: The variable that holds the key of each outside model (fixed values).
KEYS = {"answer": "ANTHROPIC_API_KEY", "embed": "VOYAGE_API_KEY", "rerank": "COHERE_API_KEY"}
SPEND_CAP = 5.0
TRIPLES = "chunk_id string, subject string, relation string, object string"
LADDER = [name for name in PRESETS if not name.startswith("graph")]


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="siftwell")
    sub = top.add_subparsers(dest="command", required=True)
    one = sub.add_parser("ingest")
    one.add_argument("--corpus", required=True)
    one.add_argument("--data-dir", default="data")
    one.add_argument("--chunk-size", type=int, default=IngestConfig.chunk_size)
    one.add_argument("--chunk-overlap", type=int, default=IngestConfig.chunk_overlap)
    one.add_argument("--triples", help="JSON lines of chunk_id, subject, relation, object for the graph")
    two = sub.add_parser("eval")
    two.add_argument("--corpus", required=True)
    two.add_argument("--slice", choices=["smoke", "full"], default="smoke")
    two.add_argument("--presets", default=",".join(LADDER))
    two.add_argument("--spend-cap-usd", type=float, default=SPEND_CAP)
    two.add_argument("--run-id", help="that of a run which is to go on")
    two.add_argument("--judge", "--ragas", action="store_true", help="have the answers assessed")
    two.add_argument("--graph-recognition", choices=["llm", "embedding"], help="recognition of presets with the graph")
    two.add_argument("--providers", help="module:name of the Providers for outside models, which need their keys")
    two.add_argument("--data-dir", default="data")
    two.add_argument("--yes", action="store_true")
    three = sub.add_parser("promote")
    three.add_argument("run")
    three.add_argument("--to", required=True)
    four = sub.add_parser("receipts").add_subparsers(dest="receipts_command", required=True).add_parser("promote")
    four.add_argument("run_id")
    four.add_argument("--data-dir", default="data")
    four.add_argument("--receipts-dir", default="receipts")
    five = sub.add_parser("build-graph")
    five.add_argument("--triples", required=True)
    six = sub.add_parser("ask")
    six.add_argument("query")
    six.add_argument("--route", dest="route_mode", choices=["auto", "force_s1", "force_s2"], help="another route than the preset's")
    nine = sub.add_parser("download")
    source = nine.add_mutually_exclusive_group(required=True)
    source.add_argument("--url", help="a service that gives its rows page by page")
    source.add_argument("--folder", help="a folder of JSON lines")
    nine.add_argument("--limit", default="1000", help="rows of a page")
    nine.add_argument("--kind", choices=["docs", "queries"], default="docs")
    seven = sub.add_parser("capture")
    seven.add_argument("--queries", required=True, help="a file with a query in each line")
    eight = sub.add_parser("export-vectors")
    for one in (seven, eight):
        one.add_argument("--to", required=True)
    for one in (five, six, seven, eight, nine):
        one.add_argument("--corpus", required=True)
        one.add_argument("--data-dir", default="data")
    for one in (six, seven):
        one.add_argument("--preset", default="bm25-only")
    return top


def missing_keys(names: list[str], keys: Mapping[str, str] = KEYS, environ: Mapping[str, str] = os.environ) -> list[str]:
    """Variables that presets with a single retrieval need and that are not set: always that of answers."""
    plans = [preset(n).query for n in names if preset(n).query.route_mode == FORCE_S1]
    wanted = ["answer"] + ["embed"] * any(q.dense for q in plans) + ["rerank"] * any(q.rerank for q in plans)
    return [keys[part] for part in wanted if not environ.get(keys[part])]


def _providers(name: str | None):
    if name is None:
        return None
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def _session():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("siftwell").getOrCreate()


def _ingest(args) -> int:
    from siftwell.plans.runner import ingest

    raw = f"{args.data_dir}/{args.corpus}/raw"
    if not os.path.exists(f"{raw}/docs.jsonl"):
        print(f"{raw}/docs.jsonl is missing", file=sys.stderr)
        return MISSING
    spark = _session()
    config = IngestConfig(chunk_size=args.chunk_size, chunk_overlap=args.chunk_overlap)
    triples = spark.read.schema(TRIPLES).json(args.triples) if args.triples else None
    print(json.dumps(ingest(spark, raw, f"{args.data_dir}/{args.corpus}/index", args.corpus, config, triples), indent=1))
    return OK


def _build_graph(args) -> int:
    from siftwell.plans.runner import add_graph

    index = f"{args.data_dir}/{args.corpus}/index"
    if not os.path.exists(f"{index}/manifest") or not os.path.exists(args.triples):
        print(f"{index} or {args.triples} is missing", file=sys.stderr)
        return MISSING
    spark = _session()
    print(json.dumps(add_graph(spark, index, spark.read.schema(TRIPLES).json(args.triples)), indent=1))
    return OK


def _ask(args) -> int:
    """One query with its answer and trace."""
    from siftwell.service import App

    app = App(_session(), args.data_dir)
    route = {"route_mode": args.route_mode} if args.route_mode else {}
    status, said = app.query({"query": args.query, "corpus_id": args.corpus, "preset": args.preset, "answer": True} | route)
    print(json.dumps(said | ({"trace": app.trace(said["trace_id"])[1]} if status == 200 else {}), indent=1))
    return OK if status == 200 else MISSING


def _capture(args) -> int:
    """Answers and traces of the file's queries as documents that the service offers as examples; it ends at the first that fails."""
    from siftwell.service import App

    app = App(_session(), args.data_dir)
    os.makedirs(args.to, exist_ok=True)
    with open(args.queries) as lines:
        asked = [line.strip() for line in lines if line.strip()]
    for n, text in enumerate(asked):
        status, said = app.query({"query": text, "corpus_id": args.corpus, "preset": args.preset, "answer": True})
        if status != 200:
            print(said["detail"], file=sys.stderr)
            return MISSING
        with open(f"{args.to}/example-{n:02d}.json", "w") as out:
            json.dump({"query": text, "preset": args.preset, "response": said, "events": app.trace(said["trace_id"])[1]["events"]}, out, indent=1)
    return OK


def _download(args) -> int:
    """The rows of a paged source as a corpus's raw documents or queries; what is there already is not asked for again."""
    from siftwell.sources.paged import download

    raw = f"{args.data_dir}/{args.corpus}/raw"
    source = {"url": args.url} if args.url else {"folder": args.folder}
    rows = download(_session(), f"{raw}/pages-{args.kind}", told=lambda n, of: print(f"{n} of {of} pages"), limit=args.limit, **source)
    rows.orderBy("page", "place").select("value").write.mode("overwrite").text(f"{raw}/{args.kind}.jsonl")
    return OK


def _export_vectors(args) -> int:
    index = f"{args.data_dir}/{args.corpus}/index"
    if not os.path.exists(f"{index}/vectors"):
        print(f"{index}/vectors is missing", file=sys.stderr)
        return MISSING
    _session().read.parquet(f"{index}/vectors").select("chunk_id", "contextual", "isolated").write.mode("overwrite").parquet(args.to)
    return OK


def _eval(args) -> int:
    from siftwell.operators.prep import gold_rows
    from siftwell.plans.records import run_id
    from siftwell.plans.runner import SpendCap, load, override, run
    from siftwell.sources import files

    names = args.presets.split(",")
    unknown = [n for n in names if n not in PRESETS]
    if unknown:
        print(f"unknown presets: {', '.join(unknown)}", file=sys.stderr)
        return USAGE
    if args.providers and (missing := missing_keys(names)):
        print(f"not set: {', '.join(missing)}", file=sys.stderr)
        return MISSING
    home = f"{args.data_dir}/{args.corpus}"
    if not os.path.exists(f"{home}/index/manifest") or not os.path.exists(f"{home}/raw/slice-{args.slice}.json"):
        print(f"{home} has no index or no slice {args.slice}", file=sys.stderr)
        return MISSING
    spark, run_name = _session(), args.run_id or run_id(args.corpus, args.slice)
    recognition = None if args.graph_recognition is None else args.graph_recognition == "llm"
    manifest = files.manifest(spark, f"{home}/index/manifest")
    chosen = files.query_slice(spark, f"{home}/raw", args.slice)
    asked, golds = gold_rows(files.slice_queries(files.queries(spark, f"{home}/raw/queries.jsonl"), chosen))
    usd = costs.estimate([override(preset(n), recognition) for n in names], asked.count(), args.judge)
    print(f"run {run_name}, estimated: {usd:.4f} dollars")
    if not args.yes and input("go on? [y/N] ").strip().lower() != "y":
        return MISSING
    try:
        doc = run(
            spark, asked, golds, load(spark, f"{home}/index"), names, run_name, f"{home}/results", args.corpus, args.spend_cap_usd,
            size=args.slice, providers=_providers(args.providers), recognition=recognition, judged=args.judge, manifest=manifest,
        )
    except SpendCap as error:
        print(error, file=sys.stderr)
        return OVER_CAP
    with open(f"{home}/{run_name}.json", "w") as out:
        json.dump(doc, out, indent=1, sort_keys=True)
    return OK


def _receipts(args) -> int:
    """Promotes a run by its id, whichever corpus it is of."""
    found = sorted(glob.glob(f"{glob.escape(args.data_dir)}/*/{glob.escape(args.run_id)}.json"))
    if not found:
        print(f"no run {args.run_id}", file=sys.stderr)
        return USAGE
    os.makedirs(args.receipts_dir, exist_ok=True)
    return _promote(argparse.Namespace(run=found[0], to=f"{args.receipts_dir}/{args.run_id}.json"))


def _promote(args) -> int:
    from siftwell.plans.records import open_envelope, strip_document

    if not os.path.exists(args.run):
        print(f"{args.run} is missing", file=sys.stderr)
        return USAGE
    with open(args.run) as source:
        doc = strip_document(open_envelope(source.read()))
    with open(args.to, "w") as out:
        json.dump(doc, out, indent=1, sort_keys=True)
    return OK


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    commands = {"ingest": _ingest, "eval": _eval, "promote": _promote, "receipts": _receipts, "build-graph": _build_graph, "ask": _ask, "capture": _capture, "export-vectors": _export_vectors, "download": _download}
    return commands[args.command](args)


if __name__ == "__main__":
    sys.exit(main())
