"""Every registered corpus query on a whole small folder of tables, against SQL, brute force or the law it promises; the pipeline on odd tables."""

import hashlib
import os
import re
import zlib
from collections import defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import LONG, ODD, WORD_BPE, brute_links, brute_print, brute_repeats, library_ids, reach
from test_scale_operators import brute_alignment

from siftwell import llm
from siftwell.llm import html_text, language_id
from siftwell.llm._common import new_path

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def run(spark, sf_dir):
    queries = llm.queries()
    return lambda name: queries[name](spark, sf_dir).collect()


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("doc_id").collect()]


@pytest.mark.parametrize("name", ["op1_warc", "op3_decontaminate", "op12_ranked_search", "op13_substring_dedup"])
def test_queries_that_sql_states(spark, sf_dir, run, name):
    db = duckdb.connect()
    for table in ("documents", "benchmark", "pages"):
        db.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    want = db.execute(llm.oracle_sql()[name])
    names = [c[0] for c in want.description]
    assert sorted((tuple(r[c] for c in names) for r in run(name)), key=str) == sorted(want.fetchall(), key=str)


def test_op2(spark, sf_dir, run):
    vectors = [(r.vec_id, [float(x) for x in r.embedding]) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    links = brute_links(vectors, 0.95)
    low = reach(links)
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in run("op2_near_vectors")) == [(i, len(links[i]), low[i], low[i] == i) for i, _ in sorted(vectors)]


def test_op4(run, docs):
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run("op4_suffix_dedup")) == brute_repeats(docs)


def test_op5(run, docs):
    rows = run("op5_sharding")
    size = {i: len((t or "").encode()) + 1 for i, t in docs}
    assert sorted((r.doc_id, r.size, r.text_crc32) for r in rows) == [(i, size[i], zlib.crc32((t or "").encode())) for i, t in docs]
    assert {r.law for r in rows} == {"bytes"} and all(r.grown_shard is None for r in rows)
    shards = defaultdict(list)
    for r in rows:
        shards[r.shard].append(r)
    assert set(shards) == set(range(8)) and all(sorted(r.slot for r in own) == list(range(len(own))) for own in shards.values())
    sums = [sum(r.size for r in own) for own in shards.values()]
    assert max(sums) - min(sums) <= 2 * max(size.values())


def test_op6(run, docs):
    start = 0
    got = {r.doc_id: r for r in run("op6_token_files")}
    for (i, _), ids in zip(docs, library_ids([t for _, t in docs], 1)):
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    assert len(got) == len(docs)


def test_op7(spark, sf_dir, run):
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = run("op7_language_id")
    assert {r.doc_id: r.held_out for r in rows} == {i: language_id.is_held_out(i) for i in lang} and len(rows) == len(lang)
    unseen = [r for r in rows if r.held_out and lang[r.doc_id]]
    assert sum(r.lang_pred == lang[r.doc_id] for r in unseen) >= 0.95 * len(unseen) > 20 and all(0 <= r.score <= 1 for r in rows)


def test_op8(run, docs):
    prints = {i: brute_print(t) for i, t in docs}
    low = reach({i: {j for j in prints if (prints[i] ^ prints[j]).bit_count() <= 4} for i in prints})
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in run("op8_simhash")) == [(i, f"{prints[i]:016x}", low[i]) for i, _ in docs]


def test_op9(run, docs):
    ids = dict(zip((i for i, _ in docs), library_ids([t for _, t in docs], 2)))
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in run("op9_packing"):
        pieces[r.doc_id].append(r)
        windows[r.sequence_id].append(r)
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert r.ids_crc32 == zlib.crc32(own.tobytes()) and r.doc_tokens == len(ids[r.doc_id])
    assert set(pieces) == set(ids)
    for i, own in pieces.items():
        ends = [0]
        for r in sorted(own, key=lambda r: r.start):
            assert r.start == ends[-1]
            ends.append(r.start + r.length)
        assert ends[-1] == len(ids[i])
    for own in windows.values():
        filled = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == filled
            filled += r.length
        assert filled <= 4096
    total = sum(map(len, ids.values()))
    assert len(windows) <= 1.1 * total / 4096 + 2


def test_op10(spark, sf_dir, run):
    want = {}
    for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect():
        article = re.search(r"<article>.*?</article>", r.html or "", re.S)
        want[r.page_id] = (r.url, html_text.main_text(article[0]) if article else "")
    rows = run("op10_html_text")
    assert {r.page_id: (r.url, r.text) for r in rows} == want and all(r.n_chars == len(r.text) for r in rows) and len(rows) == len(want)


def test_op11(run, docs):
    want, _ = brute_alignment([t for _, t in docs])
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]
    got = {r.doc_id: r for r in run("op11_token_alignment")}
    for (i, _), w in zip(docs, want):
        assert tuple(got[i][c] for c in names) == w[:6] and got[i].groups_sha256 == (hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "")
    assert len(got) == len(docs)


# ---- the pipeline


def folder(spark, docs, items):
    """A folder with the two tables of the pipeline."""
    path = new_path(spark, "tables")
    docs.write.parquet(f"{path}/documents.parquet")
    items.write.parquet(f"{path}/benchmark.parquet")
    return path


def test_pipeline_on_odd_tables(spark, sf_dir):
    import corpus_pipeline

    given = spark.read.parquet(f"{sf_dir}/documents.parquet").where("doc_id < 60")
    texts = {r.doc_id: r.text for r in given.collect()}
    item = "the words of this very item stand in one of the documents and must not be learnt"
    odd = [(None, texts[3] + " and its own end " * 3, "en"), (None, f"we say that {item} ever", "en"), (None, "a text that nobody else has " * 4, "en"), (7, texts[8], "en"), (900, None, None), (901, "", "en"), (902, LONG[:20_000], None)]
    odd += [(910 + k, t, None) for k, t in enumerate(ODD[:-1])]
    more = spark.createDataFrame([(i, t, lang, "s", len(t or "")) for i, t, lang in odd], DOCS)
    docs = given.unionByName(more).withColumns({c: F.lit("clash") for c in ("row", "id", "block", "rep", "node", "window", "bucket", "row0")})
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string").withColumn("row", F.lit(1))
    path = folder(spark, docs, items)
    state = docs
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        before = state
        state = stage(spark, before, path)
        if name != "packing":
            assert state.columns == docs.columns, name
        seen[name] = state.cache()
    kept = seen["simhash_near_dedup"].where("doc_id is null").select("text").collect()
    assert len(kept) == 3 or {r.text[:6] for r in kept} >= {"we say", "a text"}  # rows without an id are documents of their own
    clean = [r.text for r in seen["benchmark_decontamination"].collect()]
    assert not any(item in t for t in clean if t) and any("nobody else has" in t for t in clean)
    assert {r.doc_id for r in seen["packing"].where("doc_id is not null").select("doc_id").distinct().collect()} <= {r.doc_id for r in docs.collect()}
    assert seen["packing"].where("doc_id is null").count() >= 1
    for frame in seen.values():
        frame.unpersist()


def test_pipeline_on_empty_tables(spark):
    import corpus_pipeline

    path = folder(spark, spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string"))
    assert corpus_pipeline.run(spark, path).collect() == []
    assert os.path.isdir(path.removeprefix("file://"))
