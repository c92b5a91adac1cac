"""The corpus operators against brute force on small fixtures, with the cases that each docstring defines."""

import hashlib
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from siftwell.llm import _common, _components, decontaminate, html_text, language_id, near_vectors, packing, pfor, sharding, simhash, suffix_dedup, warc
from siftwell.llm._common import new_path, text_steps
from siftwell.llm._tokens import Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
rng = random.Random(7)
VOCABULARY = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 7))) for _ in range(400)]
LONG = " ".join(rng.choice(VOCABULARY) for _ in range(60_000))
ODD = [None, "", " \n\t ", "a", "A b  C", "x" * 5000, "é" * 300, "ab" * 500, "\x00\x01 <|endoftext|> \U0001f600", LONG]


def documents(spark, texts, ids=None, clash=False):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in zip(ids or range(len(texts)), texts)]
    df = spark.createDataFrame(rows, DOCS)
    if clash:  # columns that the operators use inside
        for name in ("id", "block", "body", "fp", "size", "old", "n", "first", "key", "window", "bucket", "rep"):
            df = df.withColumn(name, F.lit("clash"))
    return df


def texts_with_copies(n=60):
    r = random.Random(3)
    words = lambda k: " ".join(r.choice(VOCABULARY) for _ in range(k))
    shared = [words(30) for _ in range(4)]
    out = []
    for _ in range(n):
        parts = [words(r.randint(0, 60))]
        if r.random() < 0.5:
            parts.insert(r.randint(0, 1), r.choice(shared))
        out.append("\n".join(parts))
    out += [out[1], out[1], out[5], out[9] + " tail", "head " + out[9]]
    return out + ODD[:-1] + [LONG[:30_000], LONG[10_000:40_000]]


# ---- 1 WARC


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_warc_round_trip(spark):
    big = "<p>" + "y" * 200
    rows = [(3, "http://a/3", big), (1, "http://a/1", big), (2, None, "small"), (4, "u", "small"), (5, "u", None), (6, "u", ""), (7, "u\r\nX: y", LONG), (1, "http://a/1", big)]
    path = new_path(spark, "warc")
    written = warc.write_archives(pages(spark, rows).withColumn("digest", F.lit(1)), path, file_bytes=300)
    assert sum(r.n_records for r in written.collect()) == len(rows)
    found = warc.read_archives(spark, path).collect()
    assert all(r.kind == "record" and r.payload_ok for r in found)
    got = sorted((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload_digest) for r in found)
    want = []
    for page, _, html in rows:
        body = (html or "").encode()
        again = page == 3
        want.append((page, "revisit" if again else "response", 1 if again else None, len(body), hashlib.sha256(body).hexdigest()))
    assert got == sorted(want, key=str) or sorted(got, key=str) == sorted(want, key=str)
    bodies = {r.page_id: r.payload for r in found}
    assert bodies[7].decode() == LONG and bodies[3] is None


def test_warc_salvage():
    parts = [warc.record(k, f"http://h/{k}", b"payload %d " % k * 50) for k in range(8)]
    whole = b"".join(parts)
    at = [sum(map(len, parts[:k])) for k in range(9)]
    broken = bytearray(whole)
    broken[at[2] + 40] ^= 0xFF  # one member's bytes
    broken[at[5] : at[5] + 3] = b"???"  # one member's magic
    broken = bytes(broken[: at[7] + 30])  # the last one is cut short
    found = list(warc.salvage(broken))
    good = [int(x.headers["warc-record-id"].rsplit(":", 1)[1][:-1]) for x in found if isinstance(x, warc.Record)]
    gaps = [(x.start, x.stop) for x in found if isinstance(x, warc.Gap)]
    assert good == [0, 1, 3, 4, 6]
    assert gaps == [(at[2], at[3]), (at[5], at[6]), (at[7], len(broken))]
    plain = b"".join(zlib.decompress(p, 31) for p in parts[:3])
    second = plain.index(b"payload 1")
    assert len(list(warc.salvage(plain))) == 3
    damaged = plain[:second] + b"#" + plain[second + 1 :]
    kinds = [type(x).__name__ for x in warc.salvage(damaged)]
    assert kinds == ["Record", "Gap", "Record"]
    assert list(warc.salvage(b"")) == [] and [type(x) for x in warc.salvage(b"junk")] == [warc.Gap]


def test_warc_salvage_within_a_member():
    noise = random.Random(4)
    bodies = [bytes(noise.randrange(97, 123) for _ in range(20_000)) for _ in range(8)]
    plain = [zlib.decompress(warc.record(k, f"http://h/{k}", body), 31) for k, body in enumerate(bodies)]
    pack = lambda raw: (c := zlib.compressobj(6, zlib.DEFLATED, 31)).compress(raw) + c.flush()
    numbers = lambda found: [int(x.headers["warc-record-id"].rsplit(":", 1)[1][:-1]) for x in found if isinstance(x, warc.Record)]
    at = sum(map(len, plain[:3]))
    raw = b"".join(plain)
    found = list(warc.salvage(pack(raw[:at] + b"#" + raw[at + 1 :])))  # one bad record in a good member
    assert numbers(found) == [0, 1, 2, 4, 5, 6, 7]
    assert [x.reason for x in found if isinstance(x, warc.Gap)] == [f"no version line: unpacked bytes {at} to {at + len(plain[3])}"]
    whole, tail = pack(raw), warc.record(9, "http://h/9", b"tail")
    assert numbers(warc.salvage(whole)) == list(range(8)) and not any(isinstance(x, warc.Gap) for x in warc.salvage(whole))
    short = list(warc.salvage(whole[: len(whole) * 6 // 10]))
    assert numbers(short) == [0, 1, 2, 3] and isinstance(short[-1], warc.Gap)
    crc = bytearray(whole + tail)
    crc[len(whole) - 6] ^= 0xFF
    found = list(warc.salvage(bytes(crc)))
    assert numbers(found) == [*range(8), 9] and [(x.start, x.stop) for x in found if isinstance(x, warc.Gap)] == [(0, len(whole))]


def test_warc_members_of_any_size(monkeypatch):
    noise = random.Random(14)
    bodies = [bytes(noise.randrange(97, 123) for _ in range(noise.choice([0, 10, 3000, 200_000]))) for _ in range(60)]
    plain = [zlib.decompress(warc.record(k, f"http://h/{k}", body), 31) for k, body in enumerate(bodies)]
    pack = lambda raw: (c := zlib.compressobj(1, zlib.DEFLATED, 31)).compress(raw) + c.flush()
    whole, tail = pack(b"".join(plain)), warc.record(99, "http://h/99", b"tail")
    cases = [whole + tail, whole[: len(whole) // 2] + tail, pack(b"no record at all" * 50_000) + tail, pack(b"WARC/1.1\r\nContent-Length: 99999999\r\n\r\n" + b"".join(plain)) + tail, pack(b"") + tail]
    for _ in range(6):
        raw = bytearray(b"".join(plain))
        for _ in range(5):
            raw[noise.randrange(len(raw))] ^= 0x55
        cases.append(pack(bytes(raw)) + tail)
        damaged = bytearray(whole + tail)
        damaged[noise.randrange(len(whole))] ^= 0x10
        cases.append(bytes(damaged))
    told = lambda found: [(x.start, x.stop, x.reason if isinstance(x, warc.Gap) else (x.headers["warc-record-id"], hashlib.sha256(x.block).hexdigest())) for x in found]
    want = [told(warc.salvage(c)) for c in cases]
    assert len(want[0]) == 61 and all(w[-1][2][0] == "<urn:page:99>" for w in want)
    held, fill = [], warc._Window.fill

    def watched(window, k, size):
        fill(window, k, size)
        held.append(len(window.held))

    monkeypatch.setattr(warc, "MEMBER_BYTES", 1000)  # far less than any of the members
    monkeypatch.setattr(warc._Window, "fill", watched)
    assert told(warc.salvage(cases[0])) == want[0] and max(held) < 600_000 < len(b"".join(plain)) / 3
    assert [told(warc.salvage(c)) for c in cases] == want


def test_warc_empty(spark):
    assert warc.write_archives(pages(spark, []), new_path(spark, "warc")).count() == 0


# ---- 2 embeddings


def brute_links(vectors, least):
    ok = {i: np.array(v, float) for i, v in vectors if v and None not in v and np.isfinite(v).all() and any(v)}
    links = {i: set() for i, _ in vectors}
    for i in ok:
        for j in ok:
            if i != j and len(ok[i]) == len(ok[j]) and ok[i] @ ok[j] / math.sqrt((ok[i] @ ok[i]) * (ok[j] @ ok[j])) >= least:
                links[i].add(j)
    return links


def reach(links):
    label = {i: i for i in links}
    while True:
        new = {i: min([label[i], *(label[j] for j in links[i])]) for i in links}
        if new == label:
            return label
        label = new


def test_near_vectors(spark, monkeypatch):
    r = np.random.default_rng(5)
    base = r.standard_normal((120, 16))
    vectors = [(int(i), [float(x) for x in v]) for i, v in enumerate(base)]
    for k in range(40):
        vectors.append((200 + k, [float(x) for x in base[k % 10] + 0.12 * r.standard_normal(16)]))
    vectors += [(300 + k, vectors[3][1]) for k in range(5)]
    vectors += [(400, None), (401, [0.0] * 16), (402, [float("nan")] + [1.0] * 15), (403, [None] + [1.0] * 15), (404, []), (405, [1.0, 2.0]), (406, [2.0, 4.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("rep", F.lit("x"))
    links = brute_links(vectors, 0.95)
    labels = reach(links)
    want = {i: (len(links[i]), labels[i], labels[i] == i) for i in links}
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df).collect()} == want
    for name, value in {"PART_BYTES": 16 * 8 * 4, "_TILE": 3}.items():  # groups in parts, tiles of few
        monkeypatch.setattr(near_vectors, name, value)
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
    assert {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_vectors.near_vectors(df, window=40).collect()} == want
    again = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (2, [1.0, 0.01])], "vec_id long, embedding array<float>")
    assert sorted(map(tuple, near_vectors.near_vectors(again).collect())) == [(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (2, 1, 1, False)]
    assert near_vectors.near_vectors(df.limit(0)).count() == 0


def test_recall_on_a_dense_group(spark):
    """At the default setting: 6,000 different near copies of one vector, pairs at the threshold, and 4,000 other vectors."""
    r = np.random.default_rng(9)
    center = r.standard_normal(32)
    dense = center / np.linalg.norm(center) + 0.035 * r.standard_normal((6000, 32))
    a = r.standard_normal((1000, 32))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = r.standard_normal((1000, 32))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = 0.9505 * a + math.sqrt(1 - 0.9505**2) * b / np.linalg.norm(b, axis=1, keepdims=True)
    x = np.concatenate([dense, a, b, r.standard_normal((2000, 32))])
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(u[k : k + 1000] @ u.T >= 0.95).sum(axis=1) - 1 for k in range(0, len(u), 1000)])
    df = spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(8)
    got = {row.vec_id: row.n_links for row in near_vectors.near_vectors(df).collect()}
    assert all(got[k] <= n for k, n in enumerate(want)) and sum(got.values()) >= 0.995 * want.sum()
    pairs = want[6000:8000]
    assert sum(got[k + 6000] for k in range(2000)) >= 0.99 * pairs.sum()


def test_passes_grow_with_the_logarithm():
    few, many = near_vectors.passes_for(1000, 0.95), near_vectors.passes_for(10**9, 0.95)
    assert 4 <= few < many < 200


# ---- 3 decontamination


def brute_leaks(text, items, n=10):
    words = lambda t: re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").encode().translate(bytes([b + 32 if 65 <= b <= 90 else b for b in range(256)])))
    doc, hit, found = words(text), set(), set()
    for item, t in items:
        w = words(t)
        size = min(n, len(w))
        windows = {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if w else set()
        for i in range(len(doc) - size + 1):
            if tuple(doc[i : i + size]) in windows:
                hit.update(range(i, i + size))
                found.add(str(item))
    return len(doc), len(hit), sorted(found)


@pytest.mark.parametrize("max_windows", [4_000_000, 20, 7])
def test_leaks(spark, max_windows):
    upper = lambda t: t.translate({k: k - 32 for k in range(97, 123)})
    r = random.Random(11)
    passages = [" ".join(r.choice(VOCABULARY) for _ in range(k)) for k in (3, 10, 25, 40)]
    items = [*enumerate(passages), (10, None), (11, "..."), (12, passages[2]), (2, "Éa1-b")]
    docs = texts_with_copies(20) + [f"xx {upper(p)} yy, {p[:20]}" for p in passages] + ["éa1! B éA1 b", passages[0] + " " + passages[3] * 2]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    found = decontaminate.find_leaks(documents(spark, docs, clash=True), bench, max_windows=max_windows)
    got = {x.doc_id: (x.n_words, x.n_hit, x["items"]) for x in found.collect()}
    assert got == {i: brute_leaks(t, items) for i, t in enumerate(docs)}
    kept = decontaminate.decontaminate(documents(spark, docs), bench, "documents", max_windows=max_windows)
    assert {x.doc_id for x in kept.collect()} == {i for i, t in enumerate(docs) if not brute_leaks(t, items)[1]}
    cut = decontaminate.decontaminate(documents(spark, docs), bench, "spans", max_windows=max_windows)
    after = {x.doc_id: x.text for x in cut.collect()}
    assert len(after) == len(docs) and after[0] == docs[0]
    assert all(upper(passages[3]) not in (t or "") for t in after.values())


@pytest.mark.parametrize("max_windows", [4_000_000, 5, 1])
def test_leaks_with_null_and_repeated_ids(spark, max_windows):
    r = random.Random(12)
    passages = [" ".join(r.choice(VOCABULARY) for _ in range(14)) for _ in range(4)]
    items = [*enumerate(passages), (3, passages[0])]
    texts = [passages[0], "xx " + passages[1], passages[2] + " yy " + passages[3], "none here", passages[0] + " " + passages[1], None]
    rows = list(zip([None, 7, 7, 7, None, 8], texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find_leaks(docs, bench, max_windows=max_windows).collect()
    order = lambda rows: sorted(rows, key=str)
    assert order((x.doc_id, x.n_words, x.n_hit, x["items"]) for x in found) == order((i, *brute_leaks(t, items)) for i, t in rows)
    covered = {passages[0] + " " + passages[1]: [(0, len((passages[0] + " " + passages[1]).encode()))]}
    assert [(s.start, s.end) for x in found if x.doc_id is None and x.n_words == 28 for s in x.spans] == covered[texts[4]]
    bench = spark.createDataFrame([(0, passages[0] + " " + passages[1]), (1, passages[1][4:] + " zz " + passages[0])], "item_id long, text string")  # windows that overlap
    docs = spark.createDataFrame([(None, f"a {passages[0]} {passages[1]} b", "c"), (7, "clean", "d"), (7, passages[1], "e"), (7, None, "f")], "doc_id long, text string, row0 string")
    cut = decontaminate.decontaminate(docs, bench, "spans", max_windows=max_windows)
    assert cut.columns == docs.columns and order(map(tuple, cut.collect())) == order([(None, "a  b", "c"), (7, "clean", "d"), (7, "", "e"), (7, None, "f")])
    kept = decontaminate.decontaminate(docs, bench, "documents", max_windows=max_windows)
    assert kept.columns == docs.columns and order(map(tuple, kept.collect())) == order([(7, "clean", "d"), (7, None, "f")])


def test_leaks_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [x.n_hit for x in decontaminate.find_leaks(documents(spark, ["a b c"]), none).collect()] == [0]
    assert decontaminate.find_leaks(documents(spark, []), none).count() == 0


# ---- 4 suffix arrays


def brute_repeats(rows, least=50):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for k in range(len(b) - least + 1):
            first[b[k : k + least]] = min(i, first.get(b[k : k + least], i))
    out = []
    for i, t in rows:
        b, gone = (t or "").encode(), np.zeros(len((t or "").encode()) + 1, bool)
        for k in range(len(b) - least + 1):
            if first[b[k : k + least]] < i:
                gone[k : k + least] = True
        spans = int(gone[:-1].sum() and (gone[:-1] & ~np.r_[False, gone[:-2]]).sum())
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out.append((i, len(b), int(gone[: len(b)].sum()), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def test_suffix_order_is_two_stage_exact():
    r = np.random.default_rng(2)
    for letters, depth in ((2, 12), (4, 9), (256, 50), (1, 10)):
        text = r.integers(0, letters, 3000, dtype=np.uint8)
        starts = np.sort(r.choice(3000 - depth, 1500, replace=False))
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        order = suffix_dedup.suffix_order(padded, starts, depth)
        raw = text.tobytes()
        assert sorted(order.tolist()) == list(range(1500))
        prefixes = [raw[s : s + depth] for s in starts[order]]
        assert prefixes == sorted(prefixes)
        lcp = suffix_dedup.common_prefixes(padded, starts[order], depth)
        want = [next((k for k in range(depth) if a[k] != b[k]), depth) for a, b in zip(prefixes, prefixes[1:])]
        assert lcp[1:].tolist() == want


@pytest.mark.parametrize("hot_blocks", [1000, 2, 1])
def test_repeats(spark, monkeypatch, hot_blocks):
    monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot_blocks)
    texts = texts_with_copies(40)
    ids = list(range(len(texts)))
    random.Random(1).shuffle(ids)
    rows = list(zip(ids, texts)) + [(5, texts[ids.index(5)])]  # a repeated row
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).repartition(3).withColumn("bucket", F.lit(1)).withColumn("block", F.lit(2))
    found = suffix_dedup.repeated_bytes(df).collect()
    assert sorted(tuple(x) for x in found) == brute_repeats(rows)
    assert suffix_dedup.repeated_bytes(df.limit(0)).count() == 0


def test_repeats_with_nul_bytes_and_runs(spark, monkeypatch):
    texts = ["\x00" * 120, "ab" * 60, "x" + "ab" * 60, "\x00" * 60 + "z" * 60, "z" * 49, "z" * 50, "q" * 300]
    rows = list(enumerate(texts)) + [(9, "q" * 299 + "\x00" * 50)]
    for hot_blocks in (1000, 1):
        monkeypatch.setattr(suffix_dedup, "HOT_BLOCKS", hot_blocks)
        found = suffix_dedup.repeated_bytes(documents(spark, [t for _, t in rows], [i for i, _ in rows]).repartition(4)).collect()
        assert sorted(tuple(x) for x in found) == brute_repeats(rows)


def test_drop_repeats(spark):
    passage = "é" + " ".join(VOCABULARY[:30])
    docs = documents(spark, ["own one " + passage, passage, None, passage + " own two"])
    out = {x.doc_id: x for x in suffix_dedup.drop_repeats(docs, count_col="n_chars").collect()}
    assert set(out) == {0, 2, 3} and out[0].text == "own one " + passage and out[2].text is None or out[2].text == ""
    assert out[3].text.strip() == "own two" and out[3].n_chars == len(out[3].text) and out[3].source == "s"


# ---- 5 sharding


def test_min_cost_flow_is_cheapest():
    r = random.Random(4)
    for _ in range(60):
        n, m = r.randint(1, 3), r.randint(1, 3)
        supply = [r.randint(0, 3) for _ in range(n)]
        capacity = [r.randint(0, 4) for _ in range(m)]
        capacity[0] += max(0, sum(supply) - sum(capacity))
        cost = [[r.randint(0, 5) for _ in range(m)] for _ in range(n)]
        flow = sharding.min_cost_flow(supply, capacity, lambda i, j: cost[i][j])
        assert [sum(v for (i, _), v in flow.items() if i == k) for k in range(n)] == supply
        assert all(sum(v for (_, j), v in flow.items() if j == k) <= capacity[k] for k in range(m))
        units = [i for i in range(n) for _ in range(supply[i])]

        def best(k, room):
            if k == len(units):
                return 0
            return min((cost[units[k]][j] + best(k + 1, room[:j] + (room[j] - 1,) + room[j + 1 :]) for j in range(m) if room[j]), default=10**9)

        assert sum(cost[i][j] * v for (i, j), v in flow.items()) == best(0, tuple(capacity))


def written(spark, df, by):
    """A parquet table with a file for each value of a column."""
    place = new_path(spark, "table")
    for k in sorted(r[0] for r in df.select(by).distinct().collect()):
        one = new_path(spark, "one")
        df.where(F.col(by) == k).coalesce(1).write.parquet(one)
        os.makedirs(place.removeprefix("file:"), exist_ok=True)
        (part,) = [f for f in os.listdir(one.removeprefix("file:")) if f.endswith(".parquet")]
        os.rename(f"{one.removeprefix('file:')}/{part}", f"{place.removeprefix('file:')}/part {k:02d}+é.parquet")
    return place


def test_reshard(spark, monkeypatch):
    texts = texts_with_copies(200)
    clash = {c: F.lit("clash") for c in ("old", "at", "row", "block", "_id", "_old", "file", "name", "shard", "new", "_metadata")}
    docs = documents(spark, texts, clash=True).withColumn("old_shard", F.when(F.col("doc_id") % 3 < 2, 0).otherwise(F.col("doc_id") % 7)).withColumns(clash)
    for bytes_of_block in (4_000_000, 2000):
        monkeypatch.setattr(sharding, "BLOCK_BYTES", bytes_of_block)
        source = written(spark, docs, "old_shard")
        out, plan = sharding.reshard(spark, source, new_path(spark, "shards"), shards=3)
        rows = out.collect()
        assert sorted(x.doc_id for x in rows) == list(range(len(texts))) and all(x._old == x.old == x.name == x["_metadata"] == "clash" for x in rows)
        by = {k: [x for x in rows if x["shard"] == k] for k in range(3)}
        sizes = [sum(x["size"] for x in by[k]) for k in range(3)]
        assert max(sizes) - min(sizes) <= 2 * max(len((t or "").encode()) + 1 for t in texts)
        assert all(sorted(x.slot for x in by[k]) == list(range(len(by[k]))) for k in range(3))
        assert all(x.text == texts[x.doc_id] and x["size"] == len((x.text or "").encode()) + 1 for x in rows)
        total = sum(sizes)
        stays = sum(min(total // 3 + (k < total % 3), sum(x["size"] for x in rows if x.old_shard == k)) for k in range(3))
        assert plan.moved == total - stays
    none = new_path(spark, "table")
    docs.limit(0).write.parquet(none)
    assert sharding.reshard(spark, none, new_path(spark, "shards"), shards=3)[0].count() == 0


def test_reshard_leaves_files_alone(spark):
    """Equal shards stay; of a fourth that is to be dealt out, only that file is rewritten."""
    texts = [f"{k:06d}" * 20 for k in range(400)]
    docs = documents(spark, texts).withColumn("old_shard", F.col("doc_id") % 4)
    source = written(spark, docs, "old_shard")
    out, plan = sharding.reshard(spark, source, new_path(spark, "shards"), shards=4)
    assert plan.moved == 0 and plan.rewritten == [] and {(x.old_shard, x.shard) for x in out.collect()} == {(k, k) for k in range(4)}
    place = new_path(spark, "shards")
    out, plan = sharding.reshard(spark, source, place, shards=3)
    assert len(plan.rewritten) == 1 and "03" in plan.rewritten[0]
    rows = out.collect()
    assert sorted(x.doc_id for x in rows) == list(range(400)) and sum(x.old_shard != x.shard for x in rows) == 100
    assert spark.read.parquet(place).count() == 100
    assert all(sorted(x.slot for x in rows if x["shard"] == k) == list(range(sum(x["shard"] == k for x in rows))) for k in range(3))


# ---- 6 token files, 9 packing


def library_ids(texts, end):
    from tokenizers import Tokenizer

    known = Tokenizer.from_file(WORD_BPE)
    return [[*known.encode(t or "", add_special_tokens=False).ids, end] for t in texts]


def test_encoder_equals_library():
    r = random.Random(9)
    letters = "aZ1'.! \n\té́ß中½<|>\x01 \x1cre"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(1500)] + ["don't 've l'été U.S.A. 3́", *[t for t in ODD if t]]
    known, got = Encoder(WORD_BPE), []
    for _, _, data, offsets in text_steps(pa.array(texts), 3000):
        ids, at = known.encode(data, offsets)
        got += [ids[a:b].tolist() for a, b in zip(at, at[1:])]
    assert known.by_word and got == [x[:-1] for x in library_ids(texts, 0)]


@pytest.mark.parametrize("spread", [1, 200, 2**16, 2**32])
def test_pfor_round_trip(spread):
    r = np.random.default_rng(spread % 1000)
    sizes = [0, 1, 5000, 0, 1023, 1024, 1025, 3]
    ids = [r.integers(0, spread, n, dtype=np.uint64).astype(np.uint32) for n in sizes]
    ids[2][::97] = 2**32 - 1
    writer = pfor.PforWriter()
    for k in range(0, len(ids), 3):
        part = ids[k : k + 3]
        writer.add(np.arange(k, k + len(part)), np.array([len(x) for x in part]), np.concatenate(part))
    file = pfor.PforFile(writer.close())
    back = list(file.documents(step=1500))
    assert [d for d, _, _ in back] == list(range(len(ids))) and all((a == b).all() and len(a) == len(b) for a, (_, _, b) in zip(ids, back))
    whole = np.concatenate(ids)
    assert (file.ids(700, 5100) == whole[700:5100]).all()
    assert len(pfor.PforWriter().close()) and list(pfor.PforFile(pfor.PforWriter().close()).documents()) == []


def test_token_files(spark):
    texts = texts_with_copies(30)
    path = new_path(spark, "tokens")
    manifest = pfor.write_token_files(documents(spark, texts, clash=True).repartition(3), path, WORD_BPE, end_id=1, file_ids=2000)
    assert manifest.count() > 2
    rows = sorted(pfor.read_token_files(spark, path, manifest, with_ids=True).collect())
    start = 0
    for row, ids in zip(rows, library_ids(texts, 1), strict=True):
        assert (row.start, row.n_tokens, row.ids) == (start, len(ids), ids)
        assert row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)
    empty = new_path(spark, "tokens")
    assert pfor.read_token_files(spark, empty, pfor.write_token_files(documents(spark, []), empty, WORD_BPE, 1)).count() == 0


def test_whole_windows_close_none():
    bins = packing.Bins(10, 2, 0)
    assert [bins.place(n) for n in (4, 7, 10, 3, 10)] == [(0, 0, None), (1, 0, None), (2, 0, None), (1, 7, None), (3, 0, None)]
    assert bins.place(9) == (4, 0, None) and bins.place(8)[2] == 4


@pytest.mark.parametrize("window,open_windows", [(64, 2), (4096, 8)])
def test_packing(spark, window, open_windows):
    texts = texts_with_copies(60)
    pieces = packing.pack(documents(spark, texts, clash=True).repartition(5), WORD_BPE, 2, window=window, open_windows=open_windows, with_ids=True).collect()
    want = library_ids(texts, 2)
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_sequence.setdefault(p.sequence_id, []).append(p)
    assert set(by_doc) == set(range(len(texts)))
    for doc, parts in by_doc.items():
        parts.sort(key=lambda p: p.start)
        assert [x for p in parts for x in p.ids] == want[doc]
        assert all(p.doc_tokens == len(want[doc]) and p.ids_crc32 == zlib.crc32(np.array(p.ids, "<u4").tobytes()) and p.length == len(p.ids) for p in parts)
    for parts in by_sequence.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == np.r_[0, np.cumsum([p.length for p in parts])][:-1].tolist()
        assert sum(p.length for p in parts) == parts[0].n_filled <= window
    tokens = sum(map(len, want))
    assert len(by_sequence) * window <= 1.35 * tokens + 2 * window
    assert packing.pack(documents(spark, []), WORD_BPE, 2).count() == 0


# ---- 7 language ID


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b" a", b"ab", b"ba", b"aba", b" ab"]
    lattice = language_id.Lattice(pieces)
    r = np.random.default_rng(1)
    p = r.random((len(pieces), 2)) / 4

    def brute(word, lang):
        return 1.0 if not word else sum(p[k, lang] * brute(word[len(x) :], lang) for k, x in enumerate(pieces) if word.startswith(x))

    words = [b" ab", b" a", b" abab", b" bbbaba", b" ababababababababababababababababababab"]
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words])
    starts = np.cumsum(sizes) - sizes
    got = np.exp(lattice.log_likelihoods(data, starts, sizes, p))
    assert np.allclose(got[:4], [[brute(w, k) for k in range(2)] for w in words[:4]])
    f = [1.0] + [0.0] * len(words[4])
    for i in range(1, len(f)):
        f[i] = sum(p[k, 0] * f[i - len(x)] for k, x in enumerate(pieces) if words[4][:i].endswith(x))
    assert math.isclose(math.log(got[4, 0]), math.log(f[-1]), rel_tol=1e-9)
    counts = np.array([[2.0, 0], [1, 1], [3, 0], [0, 2]])
    uses = lattice.expected(data, starts[:4], sizes[:4], counts, p)

    def segmentations(word):
        if not word:
            yield []
        for k, x in enumerate(pieces):
            if word.startswith(x):
                for rest in segmentations(word[len(x) :]):
                    yield [k, *rest]

    want = np.zeros_like(p)
    for w, c in zip(words[:4], counts):
        for lang in range(2):
            ways = list(segmentations(w))
            weights = [math.prod(p[k, lang] for k in way) for way in ways]
            for way, x in zip(ways, weights):
                for k in way:
                    want[k, lang] += c[lang] * x / sum(weights)
    assert np.allclose(uses, want)


def test_language_id(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language_id.fit(docs, PIECES, rows_per_language=60, rounds=2)
    found = language_id.identify(docs, model).join(docs, "doc_id").select("doc_id", "lang", "lang_pred", "score").collect()
    unseen = [x for x in found if language_id.is_held_out(x.doc_id)]
    assert sum(x.lang == x.lang_pred for x in unseen) >= 0.97 * len(unseen) and all(0 <= x.score <= 1 for x in found)
    odd = documents(spark, [*ODD, "12 34 -", "é"], clash=True)
    got = {x.doc_id: x for x in language_id.identify(odd, model).collect()}
    assert len(got) == len(ODD) + 2 and all(got[k].lang_pred == "und" and got[k].score == 0 for k in (0, 1, 2, len(ODD)))
    assert got[len(ODD) + 1].lang_pred in model.languages
    kept = {x.doc_id for x in language_id.keep_identified(odd, model, least_score=0.0).collect()}
    assert kept == set(got) - {0, 1, 2, len(ODD)}
    for text in ["plain words", "漢" * 40 + "é" * 20, "x" * 100]:
        data, starts, ends, of = language_id.stretches(*language_id._words(pa.array(["a", text]), 0, 2))
        assert (ends - starts).max() <= language_id.STRETCH_BYTES and b"".join(data[s:e].tobytes() for s, e in zip(starts, ends)).decode() == " a " + text
        assert all(data[s:e].tobytes().decode() for s, e in zip(starts, ends)) and of.tolist() == [0] + [1] * (len(of) - 1)
    scripts = {"ja": "あいうえおかきくけこさしすせそ", "zh": "的一是不了人我在有他这为之大来", "th": "กขคงจฉชซญดตถทนบ"}  # runs without blanks, many labels
    r = random.Random(4)
    runs = [(i, "".join(r.choice(scripts[lang]) for _ in range(60)), lang) for i in range(240) for lang in [list(scripts)[i % 3]]]
    runs += [(1000 + i, f"label{i} word{i} " * 5, f"l{i}") for i in range(300)]
    runs = spark.createDataFrame(runs, "doc_id long, text string, lang string")
    many = language_id.fit(runs, PIECES)
    assert len(many.languages) == 303 - sum(language_id.is_held_out(1000 + i) for i in range(300))
    got = language_id.identify(runs, many).join(runs, "doc_id").where("doc_id < 1000").collect()
    assert all(x.lang == x.lang_pred and x.score > 0.9 for x in got)
    none = language_id.fit(docs.withColumn("lang", F.lit(None).cast("string")), PIECES)
    assert {x.lang_pred for x in language_id.identify(odd, none).collect()} == {"und"}
    assert language_id.identify(odd.limit(0), model).count() == 0
    assert docs.select(language_id.held_out(F.col("doc_id")), "doc_id").toDF("a", "b").where("a").count() == len(unseen)


# ---- 8 SimHash


def brute_print(text):
    text = (text or "").translate({k: k + 32 for k in range(65, 91)})
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text) if x]
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash(spark, monkeypatch):
    monkeypatch.setattr(_components, "LOCAL_LINKS", 3)
    r = random.Random(8)
    texts = texts_with_copies(50)
    base = " ".join(r.choice(VOCABULARY) for _ in range(900)).split()
    for _ in range(30):
        w = list(base)
        w[r.randrange(len(w))] = "changed"
        texts.append("  ".join(w))
    found = simhash.near_duplicates(documents(spark, texts, clash=True)).collect()
    prints = [brute_print(t) for t in texts]
    assert {x.doc_id: x.fp & (2**64 - 1) for x in found} == dict(enumerate(prints))
    links = {i: {j for j in range(len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 4} for i in range(len(texts))}
    assert {x.doc_id: x.component_id for x in found} == reach(links)
    kept = simhash.drop_near_duplicates(documents(spark, texts)).collect()
    assert {x.doc_id for x in kept} == {i for i, c in reach(links).items() if i == c}
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_pipeline_drops_near_copies_by_similarity(spark, sf_dir, monkeypatch):
    import corpus_pipeline

    from siftwell.llm import near_copies

    r = random.Random(21)
    texts = [t for t in texts_with_copies(20)] + ["one two  three", "One two three"]
    for _ in range(40):
        base = [f"w{r.randrange(5000)}" for _ in range(r.randint(12, 400))]
        texts.append(" ".join(base))
        for _ in range(3):
            w = list(base)
            for _ in range(r.randint(0, max(1, len(w) // 40))):
                w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
            texts.append(" ".join(w))
    base = [f"w{r.randrange(5000)}" for _ in range(300)]
    for _ in range(60):  # a chain: neighbours are alike, the ends are not
        base[r.randrange(300)] = f"y{r.randrange(10**6)}"
        texts.append(" ".join(base))
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    sets = []
    for t in texts:
        w = re.findall(r"[^\t-\r ]+", lower(t))
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    alike = lambda x, y: x == y or len(x & y) >= 0.8 * len(x | y)
    links = {i: {j for j in range(len(texts)) if alike(sets[i], sets[j])} for i in range(len(texts))}
    want = {i for i, c in reach(links).items() if i == c}
    stage = dict(corpus_pipeline.STAGES)["simhash_near_dedup"]
    assert {x.doc_id for x in stage(spark, documents(spark, texts), sf_dir).collect()} == want
    for name, value in {"PART": 4, "SETS": 4, "ESTIMATE": 1, "GROUP": 40, "MISS": 1e-7}.items():
        monkeypatch.setattr(near_copies, name, value)
    monkeypatch.setattr(_common, "BROADCAST_ROWS", 0)
    assert {x.doc_id for x in stage(spark, documents(spark, texts, clash=True), sf_dir).collect()} == want
    assert stage(spark, documents(spark, []), sf_dir).count() == 0


def test_wide_prints_meet_at_the_threshold():
    """Pairs at a similarity of 0.8 to 0.82 are within the budget and share a mask, at the default setting."""
    from siftwell.llm import near_copies

    r, met, pairs = np.random.default_rng(12), 0, 600
    budget, masks = near_copies.masks_for(10**6, 0.8)
    for k in range(pairs):
        size = int(r.integers(10, 600))
        common = math.ceil(2 * size * 0.8 / 1.8)
        h = r.integers(0, 2**64, 2 * size - common, dtype=np.uint64)
        x, y = near_copies.set_fingerprints(np.r_[h[:size], h[:common], h[size:]], np.array([size, size]))
        apart = x ^ y
        met += np.bitwise_count(apart).sum() <= budget and bool(((apart & masks) == 0).all(axis=1).any())
    assert met >= 0.98 * pairs


def test_set_fingerprints_are_majorities():
    from siftwell.llm import near_copies

    r = np.random.default_rng(1)
    counts = np.array([3, 0, 700, 1, 70_000, 0, 4])
    h = r.integers(0, 2**64, counts.sum(), dtype=np.uint64)
    got = near_copies.set_fingerprints(h, counts)
    for k, (a, n) in enumerate(zip(np.cumsum(counts) - counts, counts)):
        for w in range(near_copies.FP_WORDS):
            x = near_copies.mix(h[a : a + n] ^ np.uint64(w + 1))
            want = sum(1 << b for b in range(64) if 2 * int((x >> np.uint64(b) & np.uint64(1)).sum()) > n)
            assert int(got[k, w]) == want


def test_trie_join_equals_all_pairs():
    r = np.random.default_rng(3)
    center = np.uint64(0x0123456789ABCDEF)
    ball = [center ^ np.uint64(1 << int(a)) ^ np.uint64(1 << int(b)) for a in range(0, 64, 2) for b in range(a)]
    fps = np.unique(np.r_[r.integers(0, 2**63, 500, dtype=np.uint64), np.array(ball, np.uint64)])
    got = set()
    for a, b in simhash.trie_join(fps, np.array([0, 100, len(fps)]), 4):
        got |= set(zip(a.tolist(), b.tolist()))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(near)) if i < j and (i < 100) == (j < 100)}
    assert got == want
    wide = np.array(sorted({(int(a), int(b)) for a in fps[::40] for b in fps[:30]}), np.uint64)
    want = {(i, j) for i in range(len(wide)) for j in range(i) if np.bitwise_count(wide[i] ^ wide[j]).sum() <= 34}
    for leaf in (64, 1 << 12):
        assert {(int(b), int(a)) for x in simhash.trie_join(wide, np.array([0, len(wide)]), 34, leaf) for a, b in zip(*x)} == want


def test_simhash_deals_out_large_tries(spark, monkeypatch):
    monkeypatch.setattr(simhash, "PART", 20)
    r = np.random.default_rng(6)
    fps = [int(0x00FF00FF00FF00FF ^ sum(1 << int(b) for b in r.choice(64, 3, replace=False))) for _ in range(300)]
    fps = sorted(set(fps))
    reps = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, k) for k, f in enumerate(fps)], "fp long, rep long")
    near = {x.node: x.component for x in _components.components(simhash.near_links(reps, 4, len(fps))).collect()}
    links = {i: {j for j in range(len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 4} for i in range(len(fps))}
    assert {i: near.get(i, i) for i in links} == reach(links)


def test_agreeing_blocks_cover_all_bits():
    for n in (10, 10**6, 10**9):
        masks = simhash.agreeing_blocks(n, 4)
        for _ in range(300):
            change = sum(1 << b for b in rng.sample(range(64), 4))
            assert any(change & m == 0 for m in masks)


@pytest.mark.parametrize("local", [1_000_000, 0])
def test_components(spark, monkeypatch, local):
    monkeypatch.setattr(_components, "LOCAL_LINKS", local)
    r = random.Random(2)
    links = [(r.randrange(400), r.randrange(400)) for _ in range(250)] + [(k, k + 1) for k in range(1000, 1200)] + [(2000, k) for k in range(2001, 2300)] + [(5, 5)]
    near = {i: set() for x in links for i in x}
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    got = {x.node: x.component for x in _components.components(spark.createDataFrame(links, "x long, y long").repartition(6)).collect()}
    assert {i: got.get(i, i) for i in near} == reach(near)
    assert _components.components(spark.createDataFrame([], "x long, y long")).count() == 0


# ---- 10 HTML


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<nav><ul><li><a href="/x">menu</a></ul></nav><!-- c --><div class="ad">advert</div>%s<footer>&copy; f</footer></body></html>"""


def test_main_text():
    article = "<article><h1>Caf&eacute; &amp; more</h1><p><b>One<br>two &#8212; <i>th</i>ree\n  four<p>five</p><aside>side</aside><ul><li>six<li>seven</ul><div class='comments'><p>c</p></div></article>"
    assert html_text.main_text(PAGE % article) == "Café & more\nOne two — three four\nfive\nsix\nseven"
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>x</nav>") == ""
    plain = "<div id='sidebar'>s</div><div><h2>h</h2><p>long text of the page here</p><form>f</form></div>"
    assert html_text.main_text(PAGE % plain) == "h\nlong text of the page here"
    assert html_text.main_text("<p" * 2000 + "x" * 50_000) is not None


def test_wrapper_inference():
    page = lambda items, extra: f"<div><ul>{''.join(f'<li>{x}</li>' for x in items)}</ul>{extra}<p>{items[0]} text</p></div>"
    pages = [page("ab", ""), page("cdef", "<h2>n</h2>"), page("g", "")]
    wrapper = html_text.infer(pages)
    assert html_text.as_expression(wrapper.nodes) == '<div> <ul> (<li> # </li>)+ </ul> (<h2> "n" </h2>)? <p> # </p> </div>'
    assert html_text.as_expression(html_text.infer(["<dl><dt>a<dd>b<dt>c<dd>d</dl>", "<dl><dt>a<dd>b<dt>c<dd>d<dt>e<dd>f</dl>"]).nodes) == "<dl> (<dt> # </dt> <dd> # </dd>)+ </dl>"
    assert html_text.infer([None]).nodes == [] and html_text.findings(html_text.infer([None])) == ({}, set(), set())
    halves = html_text.infer(pages[:1])  # partial wrappers together are the wrapper
    halves.add(html_text.infer(pages[1:]).nodes, 2)
    assert html_text.findings(halves) == html_text.findings(wrapper) and halves.pages == 3
    deep = html_text.infer(["<div>" * 3000 + f"x{k}" for k in range(3)])
    assert html_text.main_text("<div>" * 3000 + "y", *html_text.findings(deep)) == "y"


def hidden_template(r, host, page):
    """A page of a host without telling names, and the main text that it was made from."""
    word = lambda: f"{r.choice(VOCABULARY)}{r.randrange(1000)}"
    text = lambda lo, hi: " ".join(word() for _ in range(r.randint(lo, hi)))
    menu = "".join(f"<li><a href='/{k}'>section {host} {k}</a></li>" for k in range(6))
    side = "".join(f"<li>top story {host} {r.randrange(5)} of the day</li>" for _ in range(4))
    blocks = [text(4, 8)] + [text(3, 60) for _ in range(r.randint(1, 6))]
    body = f"<h2>{blocks[0]}</h2>" + "".join(f"<p>{x[:9]}<i>{x[9:]}</i></p>" for x in blocks[1:])
    if r.random() < 0.4:
        items = [text(2, 6) for _ in range(r.randint(1, 4))]
        body += f"<ul>{''.join(f'<li>{x}' for x in items)}</ul>"
        blocks += items
    if r.random() < 0.3:
        more = text(5, 20)
        body += f"<h3>part</h3><p>{more}</p>"
        blocks += ["part", more]
    said = f"<div class='c{host}x'>we of host {host} use small files to keep what you like</div>"
    if host == 2 and page % 3:  # a second template
        html = f"<table><tr><td class='q1'>{menu}</td><td class='q2'><div class='k'>{said}{body}</div></td></tr></table><div class='z'>all rights of host {host}</div>"
    elif host == 3:  # all in a form, as some servers have it
        html = f"<form action='/'><div class='m'><ul>{menu}</ul></div><div class='n'>{body}</div></form>"
    else:
        html = f"<div class='u1'><ul>{menu}</ul></div><div class='u2'><div class='u3'>{said if host else ''}{body}</div><div class='u4'><ul>{side}</ul></div></div><div class='u5'>all rights of host {host}</div>"
    return f"<html><head><title>{blocks[0]}</title></head><body>{html}</body></html>", "\n".join(blocks)


def test_wrappers_find_hidden_templates(spark):
    r = random.Random(17)
    made = [(k, k % 4, *hidden_template(r, k % 4, k // 4)) for k in range(160)]
    df = pages(spark, [(k, f"http://h{host}.example/{k}", page) for k, host, page, _ in made]).repartition(7)
    got = {x.page_id: x.text for x in html_text.extract(df).collect()}
    assert got == {k: text for k, _, _, text in made}
    alone = [html_text.main_text(page) for _, _, page, _ in made]
    assert sum(text != x for x, (_, _, _, text) in zip(alone, made)) > 0.7 * len(made)  # names and tags alone do not tell


def test_extract(spark, sf_dir):
    rows = [(k, f"https://h{k % 2}.org/{k}", PAGE % f"<article><p>text {k}</p></article>") for k in range(20)]
    rows += [(50, None, "<p>no host</p>"), (51, "https://h1.org/", None), (52, "https://h1.org/", ""), (53, "nonsense", "<p>x</p>"), (54, "https://h1.org/", "<section><p>other</p></section>"), (3, *rows[3][1:])]
    df = pages(spark, rows).withColumn("host", F.lit(1)).withColumn("mains", F.lit(2))
    got = sorted((x.page_id, x.text, x.n_chars) for x in html_text.extract(df).collect())
    want = [(k, f"text {k}", len(f"text {k}")) for k in range(20)] + [(3, "text 3", 6), (50, "no host", 7), (51, "", 0), (52, "", 0), (53, "x", 1), (54, "other", 5)]
    assert got == sorted(want)
    assert html_text.extract(df.limit(0)).count() == 0


# ---- the queries themselves


def test_queries_and_pipeline(spark, sf_dir):
    import corpus_pipeline

    from siftwell import llm

    names = {re.match(r"op(\d+)_", name)[1] for name in llm.queries()}
    assert names == {str(k) for k in range(1, 14)} and set(llm.oracle_sql()) <= set(llm.queries())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf_dir)
    kept = {x.doc_id for x in pieces.select("doc_id").distinct().collect()}
    assert 0.5 * docs.count() < len(kept) <= docs.count()
    items = [(x.item_id, x.text) for x in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    texts = {x.doc_id: x.text for x in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    clean = stages["benchmark_decontamination"](spark, docs, sf_dir)
    assert clean.schema == docs.schema
    assert {x.doc_id for x in clean.collect()} == {i for i, t in texts.items() if not brute_leaks(t, items)[1]}
