"""Operators 11 to 13 against brute force, with the cases that their docstrings define."""

import hashlib
import math
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from siftwell.llm import ranked_search, repeated_windows, token_alignment

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
rng = random.Random(11)
VOCABULARY = ["".join(rng.choice("abcdeéß.-") for _ in range(rng.randint(1, 7))) for _ in range(300)]
ODD = [None, "", " \n\t ", "a", "A b  C", "x" * 5000, "é" * 300, "ab " * 500, "\x00\x01 <|endoftext|> \U0001f600"]


def documents(spark, texts, ids=None, clash=()):
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in zip(ids if ids is not None else range(len(texts)), texts)], DOCS)
    return df.withColumns({name: F.lit("clash") for name in clash})


def words(n, r=rng):
    return [r.choice(VOCABULARY) for _ in range(n)]


# ---- 13 repeated windows


def brute_windows(texts, size):
    split = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    count = Counter(tuple(w[k : k + size]) for w in split for k in range(len(w) - size + 1))
    out = []
    for w in split:
        gone = set()
        for k in range(len(w) - size + 1):
            if count[tuple(w[k : k + size])] > 1:
                gone.update(range(k, k + size))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return out


def texts_with_repeats(n=80):
    r = random.Random(5)
    shared = [words(40, r), words(36, r), words(35, r), words(34, r)]
    out = []
    for k in range(n):
        part = words(r.randint(0, 90), r)
        if k % 2:
            part[len(part) // 2 : len(part) // 2] = shared[k % 4]
        out.append(r.choice([" ", "  ", "\n", "\t "]).join(part))
    own = words(50, r)
    return out + [" ".join(own + words(3, r) + own), "again and " * 60, out[3], out[3], " ".join(words(20_000, r))] + ODD


@pytest.mark.parametrize("size", [35, 6, 2])
def test_repeated_windows(spark, size):
    texts = texts_with_repeats()
    got = {r.doc_id: r for r in repeated_windows.repeated_windows(documents(spark, texts, clash=("id", "block", "body", "bucket", "sketch", "judged")).repartition(7), size=size).collect()}
    for k, (n, gone, digest, _) in enumerate(brute_windows(texts, size)):
        assert (got[k].n_words, got[k].n_removed, got[k].kept_sha256) == (n, gone, digest), k
    assert sum(r.n_removed for r in got.values()) > 500


def test_repeated_windows_do_not_depend_on_blocks_or_sketch(spark, monkeypatch):
    texts = texts_with_repeats(50)
    docs = documents(spark, texts).repartition(3).cache()
    want = sorted(map(tuple, repeated_windows.repeated_windows(docs).collect()))
    monkeypatch.setattr(repeated_windows, "LEAST_BYTES", 2000)
    monkeypatch.setattr(repeated_windows, "MESSAGE_BYTES", 16)
    assert repeated_windows.block_bytes(10**6) == 4000
    assert sorted(map(tuple, repeated_windows.repeated_windows(docs).collect())) == want
    monkeypatch.setattr(repeated_windows, "BYTES_PER_CELL", 10**9)  # a sketch that is full: all windows are estimated repeated
    assert sorted(map(tuple, repeated_windows.repeated_windows(docs).collect())) == want


def test_sketch_never_falls_below_the_count():
    r = random.Random(1)
    text = " ".join(words(400, r) * 2 + words(3000, r)).encode()
    block = repeated_windows.Block(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 35)
    every = block.windows(np.arange(len(block.first)))
    assert every[0].tolist() == list(range(3800 - 34))
    at = np.repeat(np.arange(len(block.first)), block.count)
    anchors = Counter(block.anchor.tolist())
    count = Counter(zip(every[1].tolist(), every[2].tolist()))
    assert sum(c > 1 for c in count.values()) == 366
    assert all(anchors[block.anchor[a]] >= count[one, two] for a, one, two in zip(at, every[1].tolist(), every[2].tolist()))
    for cell, twice, of in block.cells(3, 64):
        assert (np.bincount(of, minlength=len(cell)) > 1).tolist() == twice.tolist()


def test_repeated_windows_of_odd_tables(spark):
    run = repeated_windows.repeated_windows
    assert run(documents(spark, [])).collect() == []
    assert [tuple(r)[1:3] for r in run(documents(spark, [None, None])).collect()] == [(0, 0), (0, 0)]
    text = " ".join(words(40))
    got = run(documents(spark, [text, text, "short"], ids=[None, 1, 1]))
    assert sorted((r.doc_id or 0, r.n_words, r.n_removed) for r in got.collect()) == [(0, 40, 40), (1, 1, 0), (1, 40, 40)]
    with pytest.raises(ValueError, match="two words"):
        run(documents(spark, []), size=1)


def test_drop_repeated_windows(spark):
    texts = texts_with_repeats(40)
    docs = documents(spark, texts)
    left = {r.doc_id: r for r in repeated_windows.drop_repeated_windows(docs).collect()}
    assert repeated_windows.drop_repeated_windows(docs).schema == docs.schema
    for k, (n, gone, _, kept) in enumerate(brute_windows(texts, 35)):
        if gone and not kept:
            assert k not in left
        else:
            assert left[k].text == (kept if gone else texts[k]) and left[k].source == "s"


# ---- 12 ranked search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_ranked(docs, items, most):
    held = [(i, Counter(t), len(t)) for i, text in docs if (t := terms(text))]
    n, total = len(held), sum(size for _, _, size in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, size in held:
            m = 100 - 50 + (50 * size * n) // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, k + 1, i, -s) for k, (s, _, _, i) in enumerate(sorted(scores)[:most])]
    return sorted(out, key=str)


def search_texts():
    r = random.Random(9)
    rare = ["".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(400)]
    some = lambda k: " ".join(r.choice(rare[:20] if r.random() < 0.6 else rare) for _ in range(k))
    texts = [some(r.randint(1, 60)) for _ in range(150)] + ODD + [some(20_000)]
    texts += [texts[3]] * 30 + ["THE É-é 42_x", "the é É 42 X"]
    return texts, [some(r.randint(1, 30)) for _ in range(12)] + ["the É 42 x", "", None, "nothing?", texts[3]]


@pytest.mark.parametrize("most", [50, 3])
def test_ranked_documents(spark, most):
    texts, asked = search_texts()
    items = spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").withColumns({"item": F.lit(1), "doc": F.lit(2)})
    got = ranked_search.ranked_documents(documents(spark, texts, clash=("doc", "item", "id", "score", "part")).repartition(5), items, most)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    want = brute_ranked(list(enumerate(texts)), list(enumerate(asked)), most)
    assert len(want) > 30 and sorted(map(tuple, got.collect()), key=str) == want


def test_ranked_documents_in_blocks_and_stretches(spark, monkeypatch):
    texts, asked = search_texts()
    docs, items = documents(spark, texts).repartition(3), spark.createDataFrame(list(enumerate(asked)), "item_id long, text string").coalesce(1)
    monkeypatch.setattr(ranked_search, "MOST_ITEMS", 7)
    work = ranked_search._accumulated
    monkeypatch.setattr(ranked_search, "_accumulated", lambda shared, most: _with_small_stretches(work(shared, most)))
    got = ranked_search.ranked_documents(docs, items, 5)
    assert sorted(map(tuple, got.collect()), key=str) == brute_ranked(list(enumerate(texts)), list(enumerate(asked)), 5)


def _with_small_stretches(work):
    def run(batches):
        from siftwell.llm import ranked_search as own

        before = own.IMPACTS, own.STRETCH
        own.IMPACTS, own.STRETCH = 40, 3
        yield from work(batches)
        own.IMPACTS, own.STRETCH = before

    return run


def test_ranked_documents_of_odd_tables(spark):
    items = spark.createDataFrame([("b", "one two"), ("a", "two"), ("a", "two")], "item_id string, text string")
    none = items.where("item_id = 'x'")
    run = ranked_search.ranked_documents
    assert run(documents(spark, []), items).collect() == [] and run(documents(spark, ["one"]), none).collect() == [] and run(documents(spark, [None, "?"]), items).collect() == []
    got = sorted(map(tuple, run(documents(spark, ["two", "two", "two", "x", "y"], ids=[None, 5, 5, 7, 8]), items).collect()), key=str)
    assert [(g[0], g[1], g[2]) for g in got] == [(i, r, d) for i, r, d in [("a", 1, 5), ("a", 1, 5), ("a", 2, 5), ("a", 2, 5), ("a", 3, None), ("a", 3, None), ("b", 1, 5), ("b", 2, 5), ("b", 3, None)]]


def test_radix_order_and_accumulation():
    keys = np.random.default_rng(0).integers(0, 3_000_000_000, 5000)
    keys[::7] = keys[0]
    assert (ranked_search.radix_order(keys, int(keys.max())) == np.argsort(keys, kind="stable")).all()
    item, doc, total = ranked_search.accumulate(np.array([2, 0, 2, 0]), np.array([1, 3, 1, 0]), np.array([5, 7, 6, 8]), 4, 3)
    assert (item.tolist(), doc.tolist(), total.tolist()) == ([0, 0, 2], [0, 3, 1], [8, 7, 11])


# ---- 11 token alignment

BYTE_BPE, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    one, two = Tokenizer.from_file(BYTE_BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    one.encode_special_tokens = True
    level = token_alignment.byte_level()
    assert decoders.ByteLevel().decode([c for c, b in level.items() if b < 128]) == "".join(chr(b) for b in level.values() if b < 128)
    rows = []
    for text in texts:
        if not text:
            rows.append(None)
            continue
        a, b = one.encode(" " + text, add_special_tokens=False).ids, two.encode(text)
        left = [bytes(level[c] for c in one.id_to_token(x)) for x in a]
        right = [bytes([int(two.id_to_piece(x)[3:5], 16)]) if two.is_byte(x) else two.id_to_piece(x).replace("\u2581", " ").encode() for x in b]
        if b"".join(left) != (" " + text).encode() or b"".join(right) != (" " + text).encode():
            rows.append(None)
            continue
        ends = [np.cumsum([len(x) for x in side]).tolist() for side in (left, right)]
        groups, links, i, j = [], [], 0, 0
        at_b = {e: k for k, e in enumerate(ends[1])}
        for k, e in enumerate(ends[0]):
            if e in at_b:
                groups.append(",".join(map(str, a[i : k + 1])) + "|" + ",".join(map(str, b[j : at_b[e] + 1])))
                links.append((a[k], b[at_b[e]]))
                i, j = k + 1, at_b[e] + 1
        rows.append((len(a), len(b), ";".join(groups), links))
    count = Counter(x for r in rows if r for x in r[3])
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    out = []
    for r in rows:
        if r is None:
            out.append((0,) * 6 + ("",))
        else:
            out.append((r[0], r[1], len(r[3]), len(r[3]), sum(count[x] == best[x[1]] for x in r[3]), sum(count[x] for x in r[3]), r[2]))
    return out, count


def alignment_texts():
    r = random.Random(2)
    odd = ["a  b", "  a b ", "a\nb", "a \n b", "\n", " ", "a\n\nb\n", "\nx y\n", "a\tb c", "a\u3000 b", "a \u3000b c", "\u3000 \u3000b", "x\u00a0 y", "\u2581x", "it's we'll 'S", "<|endoftext|> <s> </s> <0x41>", "1 234 5.6", "日本語 テキスト", "\U0001f600 \U0001f468\u200d\U0001f469", "\x00 \x7f x", "\x1c a\x1db c", "e\u0301 é", "\ufeffx y", "\u2028 a\u2029b c", "ab" * 3000, "don't\nstop 's\n's"]
    glue = [" ", " ", " ", "  ", "\n", "\n\n", "\t", "\u00a0", "\u2003 ", " \r\n"]
    return odd + ["".join(w + r.choice(glue) for w in words(r.randint(1, 80), r)) for _ in range(120)] + [" ".join(words(20_000, r)), " ".join(f"w{k} {k % 999}" for k in range(40_000))] + ODD + ["a  b"] * 5


def test_alignment(spark, monkeypatch):
    texts = alignment_texts()
    want, count = brute_alignment(texts)
    docs = documents(spark, texts, clash=("id", "ids", "tokens", "parts", "fresh", "pairs", "groups", "n", "a", "b")).repartition(3)
    names = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"]
    found, pairs = token_alignment.align(docs, BYTE_BPE, PIECES, with_groups=True)
    for r in found.collect():
        assert tuple(r[c] for c in names) == want[r.doc_id], (r.doc_id, texts[r.doc_id])
    got = pairs.collect()
    assert {(r.a, r.b): r.n for r in got} == count
    assert sum(w[0] > 0 for w in want) > 140
    digests = token_alignment.align(docs, BYTE_BPE, PIECES)[0].collect()
    assert {r.doc_id: r.groups for r in digests} == {k: hashlib.sha256(w[6].encode()).hexdigest() if w[6] else "" for k, w in enumerate(want)}


def test_alignment_with_a_full_cache():
    import pyarrow as pa

    texts = alignment_texts()
    known = token_alignment.pair(BYTE_BPE, PIECES)
    assert known.by_segment
    whole = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])
    batches = [whole.slice(k, 10) for k in range(0, len(texts), 10)]

    def run():
        rows = list(token_alignment._aligned(BYTE_BPE, PIECES, True)(iter(batches)))
        told = rows.pop()
        assert told.column(4)[0].is_valid
        counts = next(token_alignment._counts([pa.RecordBatch.from_arrays([told.column(4)], ["pairs"])]))
        return [g for r in rows for g in r.column(5)[0].as_py()], dict(zip(zip(counts.column(0).to_pylist(), counts.column(1).to_pylist()), counts.column(2).to_pylist()))

    want = run()
    before = token_alignment.CACHE_SEGMENTS, token_alignment.CACHE_STEPS
    token_alignment.CACHE_SEGMENTS, token_alignment.CACHE_STEPS = 20, 5
    try:
        assert run() == want
    finally:
        token_alignment.CACHE_SEGMENTS, token_alignment.CACHE_STEPS = before
    brute, count = brute_alignment(texts)
    assert want[0] == [b[6] for b in brute] and want[1] == count


def test_transducer():
    one, two = [b"a", b"ab", b"bc", b"d", b"abcd"], [b"ab", b"c", b"cd", b"a", b"b"]
    t = token_alignment.Transducer(one, two)
    assert t.groups([0, 2, 3], [0, 1, 2]) is None
    assert t.groups([0, 2, 3], [0, 2]) == [([0, 2, 3], [0, 2])]
    assert t.groups([1, 0], [3, 4, 3]) == [([1], [3, 4]), ([0], [3])]
    assert t.groups([4], [3]) is None and t.groups([], []) == [] and t.groups([], [0]) is None
    steps = len(t.known)
    assert t.groups([1, 0], [3, 4, 3]) and len(t.known) == steps  # every transition is known


def test_alignment_of_odd_tables(spark):
    found, pairs = token_alignment.align(documents(spark, []), BYTE_BPE, PIECES)
    assert found.collect() == [] and pairs.collect() == []
    found, pairs = token_alignment.align(documents(spark, [None, "", "\u2581", "a", "a"], ids=[None, 1, 1, 1, 1]), BYTE_BPE, PIECES)
    got = sorted((r.doc_id or 0, r.n_a, r.n_links, r.n_best, r.count_sum, bool(r.groups)) for r in found.collect())
    assert got == [(0, 0, 0, 0, 0, False), (1, 0, 0, 0, 0, False), (1, 0, 0, 0, 0, False), (1, 1, 1, 1, 2, True), (1, 1, 1, 1, 2, True)]
    assert [r.n for r in pairs.collect()] == [2]


def test_windows_of_very_common_anchors_are_told_in_runs():
    """Many different windows about phrases that every block has: no window of its own for each, and few bytes for an anchor."""
    from siftwell.llm import suffix_dedup as s

    rng = np.random.default_rng(5)
    words = [bytes(rng.integers(97, 123, 7, dtype=np.uint8)) for _ in range(300)]
    common = b"a phrase that is found in every block of them"
    texts = [b" ".join([words[k] for k in rng.integers(0, 300, 12)] + [common] + [words[k] for k in rng.integers(0, 300, 12)]) for _ in range(400)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    block, buckets = s.Block(data, offsets, np.arange(400), 50), 4
    bucket, suffix, several, of = block.anchors(buckets)
    every = {k: s._squeeze(np.packbits(np.ones(int((bucket == k).sum()), bool)).tobytes() * 2) for k in range(buckets)}
    runs = s.Runs(block, every, buckets)
    windows = int(sum(len(t) - 49 for t in texts))
    assert runs.count.sum() == windows == block.count.sum()
    at = np.sort(np.concatenate([f + np.arange(n) for f, n in zip(runs.first, runs.count)]))
    assert (at == np.concatenate([o + np.arange(len(t) - 49) for o, t in zip(offsets, texts)])).all()
    chosen = s._segments(runs)[0]
    assert (runs.count[chosen] + 49).sum() < 20 * windows
    same: dict[bytes, int] = {}
    for f, n, key in zip(runs.first.tolist(), runs.count.tolist(), runs.key.tolist()):
        for k in range(f, f + n):
            assert same.setdefault(data[k : k + 50].tobytes(), key) == key
    told = suffix << np.uint64(1) | several.astype(np.uint64)
    for k in range(buckets):
        part = told[bucket == k]
        raw = s._ascending(part)
        assert (s._from_ascending(raw) == part).all() and len(raw) < 4.2 * len(part)
    ties = np.array([5, 4, 9, 2**32 - 1], np.uint64)
    assert (s._from_ascending(s._ascending(ties)) == ties).all()
