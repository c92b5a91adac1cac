"""Token ids of whole texts by the tokenizers library, with a bounded cache of words.

A tokenizer whose rules never let a token or a rewriting cross ASCII white space
gives a text the ids of its words one after the other, so the library need only
be asked once for each different word.  Any other tokenizer is applied to the
whole texts, and so is every text that may hold one of its added tokens.
"""

from __future__ import annotations

import itertools
import json
import os

import numpy as np

from siftwell.llm._common import LOWER, span_hashes

#: Entries of the word cache in each Python worker; a full cache starts again from nothing.
CACHE_WORDS = 400_000
_SEPARATOR = "\x01"

_SPACE, _LETTER, _DIGIT, _APOSTROPHE, _OTHER, _BEYOND = range(6)
_KIND = np.full(256, _OTHER, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = _SPACE
_KIND[65:91] = _KIND[97:123] = _LETTER
_KIND[48:58] = _DIGIT
_KIND[39] = _APOSTROPHE
_KIND[128:] = _BEYOND

#: The word pattern of the public tokenizer; where it is used, a word also ends between these kinds of byte.
LETTERS_DIGITS_REST = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_ENDS = np.zeros(36, bool)
for _a, _b in [(_LETTER, _DIGIT), (_LETTER, _APOSTROPHE), (_LETTER, _OTHER), (_DIGIT, _APOSTROPHE), (_DIGIT, _OTHER), (_DIGIT, _LETTER), (_OTHER, _LETTER), (_OTHER, _DIGIT)]:
    _ENDS[6 * _a + _b] = True

_loaded: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a tokenizer file, loaded once."""
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def _pattern(spec: dict) -> str:
    first = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
        return first["pattern"].get("Regex", "")
    return ""


def splits_on_space(spec: dict) -> bool:
    """Whether ASCII white space always separates tokens and no rule looks across it."""
    for part in (spec.get("normalizer") or {}).get("normalizers", [spec.get("normalizer")]):
        kind = (part or {}).get("type", "NFC")
        spaces = kind == "Replace" and part["pattern"] == {"Regex": "\\s+"} and part["content"] == " "
        if kind not in ("NFC", "NFD", "Lowercase") and not spaces:
            return False
    plain = all(not t["lstrip"] and not t["rstrip"] and not any(c.isspace() for c in t["content"]) for t in spec["added_tokens"])
    return bool(_pattern(spec) == LETTERS_DIGITS_REST and plain and not spec.get("truncation") and not spec.get("padding"))


class WordTable:
    """64-bit word hashes to numbers: open addressing over arrays, looked up many at a time."""

    def __init__(self, bits: int = 16):
        self.clear(bits)

    def clear(self, bits: int = 16) -> None:
        self.bits, self.n = bits, 0
        self.keys, self.values = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int32)

    def find(self, h: np.ndarray) -> np.ndarray:
        found = np.full(len(h), -1, np.int64)
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        key = self.keys[slot]
        hit = key == h
        found[hit] = self.values[slot[hit]]
        left = np.flatnonzero(~hit & (key != 0))
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & mask
            key = self.keys[slot]
            hit = key == h[left]
            found[left[hit]] = self.values[slot[hit]]
            go = ~hit & (key != 0)
            left, slot = left[go], slot[go]
        return found

    def add(self, h: np.ndarray, values: np.ndarray) -> None:
        """Different hashes that are not in the table."""
        self.n += len(h)
        if 2 * self.n > len(self.keys):
            used = np.flatnonzero(self.keys)
            h, values = np.r_[self.keys[used], h], np.r_[self.values[used], values]
            self.clear(int(4 * len(h)).bit_length())
            self.n = len(h)
        mask = (1 << self.bits) - 1
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        while len(h):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = h[free]
            mine = free & (self.keys[slot] == h)
            self.values[slot[mine]] = values[mine]
            h, values, slot = h[~mine], values[~mine], (slot[~mine] + 1) & mask


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        self.by_word = splits_on_space(spec)
        self.lowers = any(p.get("type") == "Lowercase" for p in (spec.get("normalizer") or {}).get("normalizers", []))
        #: A text with one of these may hold an added token; the library sees it whole.
        self.marks = tuple({t["content"][:2].encode() for t in spec["added_tokens"]})
        between = self.library.encode(_SEPARATOR, add_special_tokens=False).ids
        self.between = between[0] if len(between) == 1 else None
        self.table = WordTable()
        self._clear()

    def _clear(self) -> None:
        self.table.clear()
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.first, self.length, self.n = np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int32), 0

    def _add(self, ids: np.ndarray, size: np.ndarray) -> None:
        total, n = len(ids), len(size)
        while self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + n > len(self.first):
            self.first = np.concatenate([self.first, np.zeros_like(self.first)])
            self.length = np.concatenate([self.length, np.zeros_like(self.length)])
        self.length[self.n : self.n + n] = size
        self.first[self.n : self.n + n] = self.used + np.cumsum(size) - size
        self.flat[self.used : self.used + total] = ids
        self.used, self.n = self.used + total, self.n + n

    def _by_library(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and how many each text has."""
        ids = [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(itertools.chain.from_iterable(ids), np.uint32, int(size.sum())), size

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """As _by_library; many words go to the library as one text, with a separator of one known id between."""
        if self.between is None or any(_SEPARATOR in w for w in words):
            return self._by_library(words)
        ids, size = [], []
        for k in range(0, len(words), 4096):
            part = words[k : k + 4096]
            got = np.array(self.library.encode_batch_fast([f" {_SEPARATOR} ".join(part)], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(got == self.between)
            if len(at) != len(part) - 1:
                raise ValueError("the tokenizer does not keep words apart")
            size.append(np.diff(np.r_[-1, at, len(got)]) - 1)
            ids.append(np.delete(got, at))
        return np.concatenate(ids), np.concatenate(size)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all rows of a step in order, and the rows' offsets in them."""
        whole = data.tobytes()
        if not self.by_word or any(m in whole for m in self.marks):
            at = offsets.tolist()
            ids, size = self._by_library([whole[a:b].decode() for a, b in zip(at, at[1:])])
            return ids, np.r_[0, np.cumsum(size)]
        n, rows = len(data), len(offsets) - 1
        if not n:
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        if self.lowers:
            data = LOWER[data]
            whole = data.tobytes()
        kind = _KIND[data]
        word = kind != _SPACE
        begins = np.empty(n + 1, bool)
        begins[0] = begins[n] = True
        begins[1:n] = _ENDS[kind[:-1] * np.uint8(6) + kind[1:]] | ~word[:-1]
        begins[offsets] = True
        starts = np.flatnonzero(begins[:n] & word)
        stops = begins[1:].copy()
        stops[:-1] |= ~word[1:]
        ends = np.flatnonzero(stops & word) + 1
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(rows + 1, np.int64)
        h = span_hashes(data, starts, ends)
        h[h == 0] = 1
        if self.n > CACHE_WORDS:
            self._clear()
        index = self.table.find(h)
        missing = np.flatnonzero(index < 0)
        if len(missing):
            new, where, back = np.unique(h[missing], return_index=True, return_inverse=True)
            a, b = starts[missing[where]].tolist(), ends[missing[where]].tolist()
            first = self.n
            self._add(*self._words([whole[x:y].decode() for x, y in zip(a, b)]))
            self.table.add(new, np.arange(first, self.n, dtype=np.int32))
            index[missing] = first + back
        length = self.length[index].astype(np.int64)
        stop = np.cumsum(length)
        ids = self.flat[np.repeat(self.first[index] - (stop - length), length) + np.arange(int(stop[-1]))]
        return ids, np.r_[0, stop][np.searchsorted(starts, offsets)]
