"""Language identification by unigrams of pieces, summed over all segmentations.

The pieces are those of a fixed public vocabulary, and its byte pieces.  For
each language every piece has a probability; a text's likelihood is the product
over its words, and a word's is the sum over all ways to put it together from
pieces, by the forward algorithm.  The probabilities are fitted by expectation
maximisation over the same segmentations, in parts on the executors.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm._common import byte_class, cut, give_back, pick, raw_text, span_hashes, steps, table, word_spans
from siftwell.llm._tokens import WordTable

#: Labelled rows of each language that are learned from, about; they are chosen by a hash of the id.
ROWS_PER_LANGUAGE = 1500
#: Text bytes of these rows of each language, about, where the rows are long.
BYTES_PER_LANGUAGE = 30_000_000
#: Rounds of expectation maximisation.
ROUNDS = 3
#: Bytes of the longest piece that is used; a word begins with a blank, as pieces do.
PIECE_BYTES = 16
#: Bytes of a stretch that is learned from; longer words, as in scripts without blanks, are learned from in several.
STRETCH_BYTES = 32
#: Words whose likelihoods a Python worker keeps, and likelihoods in all; a full cache starts again from nothing.
CACHE_WORDS, CACHE_VALUES = 400_000, 8_000_000
UNKNOWN = "und"

_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))
_ASCII_LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A))
_SMOOTH = 0.05
#: Tasks that learn from a share of the words each.
LEARNERS = 24


def pieces_of(path: str) -> list[bytes]:
    """Lower-case pieces of a vocabulary file, the word mark as a blank, and every single byte."""
    from sentencepiece import SentencePieceProcessor

    known = SentencePieceProcessor(model_file=path)
    found = {bytes([b]): None for b in range(256)}
    for i in range(known.get_piece_size()):
        if not (known.is_control(i) or known.is_unknown(i) or known.is_byte(i)):
            piece = known.id_to_piece(i).replace("▁", " ").encode()
            if len(piece) <= PIECE_BYTES and piece == piece.decode().lower().encode() and b" " not in piece[1:]:
                found[piece] = None
    return list(found)


def _words(column: pa.Array, a: int, b: int):
    """Lower-case bytes of rows ``a`` to ``b``, each word with a blank before it: data, starts, ends, row."""
    data, offsets = raw_text(pc.utf8_lower(column.slice(a, b - a)))
    starts, ends, of = word_spans(data, offsets, _LETTERS)
    size = ends - starts + 1
    stop = np.cumsum(size)
    out = data[np.minimum(np.repeat(starts - 1 - (stop - size), size) + np.arange(int(stop[-1]) if len(stop) else 0), len(data) - 1)]
    out[stop - size] = 32
    return out, stop - size, stop, of


class Lattice:
    """Segmentations of words over the pieces."""

    def __init__(self, pieces: list[bytes]):
        self.pieces, self.table = pieces, WordTable()
        data = np.frombuffer(b"".join(pieces), np.uint8)
        stop = np.cumsum([len(p) for p in pieces])
        hashes = span_hashes(data, np.r_[0, stop[:-1]], stop)
        self.table.add(hashes, np.arange(len(pieces), dtype=np.int32))
        self.longest = max(map(len, pieces))

    def groups(self, sizes: np.ndarray, languages: int):
        """Numbers of words of about the same size, so many that their arrays stay small."""
        order = np.argsort(sizes, kind="stable")
        padded = np.where(sizes[order] <= 32, sizes[order], -(-sizes[order] // 32) * 32)
        edge = np.r_[np.flatnonzero(np.r_[True, padded[1:] != padded[:-1]]), len(order)] if len(order) else np.zeros(1, int)
        for a, b in zip(edge, edge[1:]):
            most = max(1, 200_000 // int(padded[a] * max(1, languages / 8)))
            for k in range(a, b, most):
                yield order[k : min(b, k + most)], int(padded[a])

    def numbers(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
        """[word, end, length - 1]: the piece of that length that ends there, or -1."""
        n = len(starts)
        at = np.minimum(starts[:, None] + np.arange(width), len(data) - 1)
        rows = np.where(np.arange(width) < sizes[:, None], data[at], 0).astype(np.uint8).reshape(-1)
        out = np.full((n, width + 1, self.longest), -1, np.int32)
        base = np.arange(n) * width
        for size in range(1, min(self.longest, width) + 1):
            begin = (base[:, None] + np.arange(width - size + 1)).reshape(-1)
            found = self.table.find(span_hashes(rows, begin, begin + size)).reshape(n, -1)
            ends = np.arange(size, width + 1)
            out[:, size:, size - 1] = np.where(ends <= sizes[:, None], found, -1)
        return out

    def forward(self, numbers: np.ndarray, p: np.ndarray):
        """Scaled forward sums [word, position, language], and the log of the scale at each position."""
        n, width, longest = numbers.shape
        f, scale = np.zeros((n, width, p.shape[1])), np.zeros((n, width, p.shape[1]))
        f[:, 0] = 1
        padded = np.vstack([p, np.zeros(p.shape[1])])  # piece -1
        scaled = width > 33  # shorter words cannot underflow
        for i in range(1, width):
            total = np.zeros((n, p.shape[1]))
            for size in range(1, min(longest, i) + 1):
                which = numbers[:, i, size - 1]
                if (which >= 0).any():
                    step = f[:, i - size] * padded[which]
                    total = total + (step * np.exp(scale[:, i - size] - scale[:, i - 1]) if scaled else step)
            f[:, i] = total
            scale[:, i] = scale[:, i - 1]
            if scaled:
                big = np.where(f[:, i] > 0, f[:, i], 1)
                scale[:, i] = scale[:, i - 1] + np.log(big)
                f[:, i] = f[:, i] / big
        return f, scale

    def log_likelihoods(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, p: np.ndarray) -> np.ndarray:
        out = np.zeros((len(starts), p.shape[1]))
        for which, width in self.groups(sizes, p.shape[1]):
            f, scale = self.forward(self.numbers(data, starts[which], sizes[which], width), p)
            at = np.arange(len(which)), sizes[which]
            out[which] = np.log(np.maximum(f[at], 1e-300)) + scale[at]
        return out

    def expected(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, counts: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected uses of each piece by each language, for words with counts [word, language]."""
        uses = np.zeros_like(p)
        padded = np.vstack([p, np.zeros(p.shape[1])])
        for which, width in self.groups(sizes, p.shape[1]):
            numbers = self.numbers(data, starts[which], sizes[which], width)
            f, _ = self.forward(numbers, p)
            rows = np.arange(len(which))
            back = np.zeros_like(f)
            back[rows, sizes[which]] = 1
            whole = np.maximum(f[rows, sizes[which]], 1e-300)
            for i in range(width, 0, -1):
                for size in range(1, min(self.longest, i) + 1):
                    piece = numbers[:, i, size - 1]
                    on = np.flatnonzero(piece >= 0)
                    if not len(on):
                        continue
                    step = padded[piece[on]] * back[on, i]
                    back[on, i - size] += step
                    share = step * f[on, i - size] / whole[on] * counts[which[on]]
                    for lang in range(p.shape[1]):
                        uses[:, lang] += np.bincount(piece[on], share[:, lang], len(p))
        return uses


class Model:
    """Languages, and the piece probabilities [piece, language]."""

    def __init__(self, languages: list[str], pieces: list[bytes], p: np.ndarray):
        self.languages, self.pieces, self.p = languages, pieces, p

    def open(self):
        self.lattice = Lattice(self.pieces)
        self.known, self.likelihoods = WordTable(), np.zeros((1 << 12, len(self.languages)))
        return self

    def __getstate__(self):
        return {"languages": self.languages, "pieces": self.pieces, "p": self.p}

    def word_likelihoods(self, data, starts, ends) -> np.ndarray:
        """Rows of the kept likelihoods for the words."""
        h = span_hashes(data, starts, ends)
        h[h == 0] = 1
        if self.known.n > min(CACHE_WORDS, CACHE_VALUES // len(self.languages)):
            self.known.clear()
        at = self.known.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            first, words = self.known.n, missing[where]
            while first + len(new) > len(self.likelihoods):
                self.likelihoods = np.concatenate([self.likelihoods, np.zeros_like(self.likelihoods)])
            self.likelihoods[first : first + len(new)] = self.lattice.log_likelihoods(data, starts[words], (ends - starts)[words], self.p)
            self.known.add(new, np.arange(first, first + len(new), dtype=np.int32))
            at[missing] = first + back
        return self.likelihoods[at]

    def predict(self, column: pa.Array, a: int, b: int) -> tuple[list[str], np.ndarray]:
        rows = b - a
        total = np.zeros((rows, len(self.languages)))
        letters = _with_letter(column.slice(a, rows))
        data, starts, ends, of = _words(column, a, b)
        if len(starts) and self.languages:
            logs = self.word_likelihoods(data, starts, ends)
            filled = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
            total[of[filled]] = np.add.reduceat(logs, filled, axis=0)
        if not self.languages:
            return [UNKNOWN] * rows, np.zeros(rows)
        best = total.argmax(axis=1)
        share = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
        names = [self.languages[k] if yes else UNKNOWN for k, yes in zip(best.tolist(), letters.tolist())]
        return names, np.where(letters, share, 0.0)


def _with_letter(column: pa.Array) -> np.ndarray:
    """Which texts have a letter."""
    import regex

    data, offsets = raw_text(column)
    seen = np.r_[0, np.cumsum(_ASCII_LETTERS[data])]
    has = seen[offsets[1:]] > seen[offsets[:-1]]
    for k in np.flatnonzero(~has).tolist():
        has[k] = regex.search(r"\p{L}", column[k].as_py() or "") is not None
    return has


def held_out(id_col) -> F.Column:
    """Rows that nothing is learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(
    docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
    rows_per_language: int = ROWS_PER_LANGUAGE, rounds: int = ROUNDS,
) -> Model:
    """Learns from whole texts of about ``rows_per_language`` labelled rows of each language.

    The rows are those with the smallest hash of their id, by a fraction that
    follows from the language's number of rows and bytes; held-out rows and rows
    without text or label are never used.  Every label is learned.  The driver
    gets the languages and, each round, the sums of each piece.
    """
    rows = pick(docs, id=id_col, text=text_col, lang=lang_col).where(~held_out(F.col("id")) & F.col("lang").isNotNull())
    counts = rows.groupBy("lang").agg(F.count("*").alias("rows"), F.sum(F.octet_length("text")).alias("bytes")).collect()
    languages, pieces = sorted(r.lang for r in counts), pieces_of(vocabulary)
    if not languages:
        return Model([], [b"\0"], np.ones((1, 1)))
    parts = 1 << 20
    fraction = {r.lang: min(1.0, rows_per_language / r.rows, BYTES_PER_LANGUAGE / max(1, r.bytes or 0)) for r in counts}
    share = F.create_map(*(x for lang, part in fraction.items() for x in (F.lit(lang), F.lit(math.ceil(part * parts)))))
    sample = rows.where((F.pmod(F.xxhash64("id"), F.lit(parts)) < share[F.col("lang")]) & F.col("text").isNotNull())
    number = {lang: k for k, lang in enumerate(languages)}

    def count(batches):
        for batch in batches:
            langs = [number[x] for x in batch.column(1).to_pylist()]
            _, offsets = raw_text(batch.column(0))
            for a, b in steps(offsets):
                data, starts, ends, of = stretches(*_words(batch.column(0), a, b))
                whole, found = data.tobytes(), {}
                for s, e, k in zip(starts.tolist(), ends.tolist(), of.tolist()):
                    key = langs[a + k], whole[s:e]
                    found[key] = found.get(key, 0) + 1
                yield pa.RecordBatch.from_pydict({"lang": pa.array([k[0] for k in found], pa.int32()), "word": pa.array([k[1] for k in found], pa.binary()), "n": pa.array(list(found.values()), pa.int64())})
            give_back()

    words = sample.select("text", "lang").mapInArrow(count, "lang int, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = words.groupBy("word").agg(F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("n"))
    words = cut(words.repartition(LEARNERS, "word").sortWithinPartitions("word"))
    p = np.full((len(pieces), len(languages)), 1 / len(pieces))
    for _ in range(rounds):
        p = _uses(words, pieces, p) + _SMOOTH
        p = p / p.sum(axis=0)
    return Model(languages, pieces, p)


def stretches(data, starts, ends, of):
    """Words of more than STRETCH_BYTES in parts that are cut between characters."""
    if not len(starts) or (ends - starts).max() <= STRETCH_BYTES:
        return data, starts, ends, of
    whole, found = data.tobytes(), []
    for s, e, k in zip(starts.tolist(), ends.tolist(), of.tolist()):
        while e - s > STRETCH_BYTES:
            cut_at = s + STRETCH_BYTES
            while whole[cut_at] & 0xC0 == 0x80:
                cut_at -= 1
            found.append((s, cut_at, k))
            s = cut_at
        found.append((s, e, k))
    return data, *np.array(found).T


def _uses(words: DataFrame, pieces: list[bytes], p: np.ndarray) -> np.ndarray:
    """Expected uses [piece, language] of all words under the probabilities; sums are of millionths, so that their order does not count."""
    shared = words.sparkSession.sparkContext.broadcast((pieces, p))

    def work(batches):
        pieces, p = shared.value
        lattice, uses = Lattice(pieces), np.zeros_like(p)
        for batch in batches:
            for a in range(0, batch.num_rows, 20_000):
                part = batch.slice(a, 20_000)
                found, counts = part.column(0).to_pylist(), np.zeros((part.num_rows, p.shape[1]))
                for k, by in enumerate(part.column(1).to_pylist()):
                    for lang, n in by:
                        counts[k, lang] = n
                sizes = np.fromiter(map(len, found), np.int64, len(found))
                uses += lattice.expected(np.frombuffer(b"".join(found), np.uint8), np.cumsum(sizes) - sizes, sizes, counts, p)
                give_back()
        rows, langs = np.nonzero(uses)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(langs, pa.int32()), pa.array(np.rint(uses[rows, langs] * 1e6).astype(np.int64))], ["piece", "lang", "use"])

    sums = words.mapInArrow(work, "piece int, lang int, use long").groupBy("piece", "lang").agg(F.sum("use").alias("use")).toArrow()
    out = np.zeros_like(p)
    out[sums.column("piece").to_numpy(), sums.column("lang").to_numpy()] = sums.column("use").to_numpy() / 1e6
    return out


_PREDICTION = "lang_pred string, score double"


def _predict(model, text_at: int, keep):
    state: dict[str, Model] = {}

    def work(batches):
        if "model" not in state:
            state["model"] = model.value.open()
        own = state["model"]
        for batch in batches:
            _, offsets = raw_text(batch.column(text_at))
            for a, b in steps(offsets):
                yield keep(batch.slice(a, b - a), *own.predict(batch.column(text_at), a, b))
            give_back()

    return work


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document's ``lang_pred`` and ``score``, its share of the likelihood over all languages.

    A null text, or one without a letter, is ``und`` with score 0; equally
    likely languages give the first by name; an empty table gives an empty
    result; repeated rows give repeated results; other columns are ignored.
    """
    rows = pick(docs, id=id_col, text=text_col)

    def keep(part, names, share):
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(share)], ["id", "lang_pred", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), 1, keep), f"id {kind}, {_PREDICTION}").withColumnRenamed("id", id_col)


def keep_identified(docs: DataFrame, model: Model, text_col: str = "text", least_score: float = 0.5) -> DataFrame:
    """``docs`` without those whose language cannot be told: ``und``, or no language with ``least_score``."""

    def keep(part, names, share):
        return part.filter(pa.array([n != UNKNOWN and s >= least_score for n, s in zip(names, share.tolist())], pa.bool_()))

    return docs.mapInArrow(_predict(docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text_col), keep), docs.schema)


def is_held_out(doc_id) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def op7_language_id(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents")
    found = identify(docs, fit(docs, public_tokenizers.path("piece_bpe_32k.model")))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
