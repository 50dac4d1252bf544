"""A lower-casing BPE with word ends, applied to the distinct parts of words.

White space is dropped before the merges and no token spans it or a change of character class, so a batch may be cut at
every space or line feed, and encodes each distinct part once with the tokenizers library.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa

from .common import KEPT
from .words import distinct, joined, segments

#: Parts whose encodings a Python worker keeps.
KEPT_PARTS = 600_000

# The split pattern of the vocabulary file for lower-case ASCII and Latin-1 letters is
#   's|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-zß-öø-ÿ0-9]+
_SUFFIXES = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
_LATIN = re.compile(r"[\x21-\x7e\xc0-\xff]*")

_SPACE, _LETTER, _DIGIT, _MARK, _ODD = range(5)
_CLASS = np.full(256, _ODD, np.uint8)
_CLASS[0x21:0x7F] = _MARK
_CLASS[0x30:0x3A] = _DIGIT
_CLASS[0x61:0x7B] = _LETTER
_CLASS[0x41:0x5B] = _LETTER
_CLASS[[0x20, 0x0A]] = _SPACE
_LOW = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)


def byte_letters() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def part_starts(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bytes lower-cased, which of them belong to parts, and where parts begin.

    Chunks (between spaces and line feeds) with other characters than ASCII and Latin-1 letters, or with what may begin a
    special token, are one part each and stay as they are.
    """
    low, kind = _LOW[raw], _CLASS[raw]
    lead = raw == 0xC3
    if lead.any():  # Latin-1 letters, but for the signs of multiplication and division
        at = np.flatnonzero(lead[:-1])
        second = raw[at + 1]
        kind[at] = kind[at + 1] = np.where((second == 0x97) | (second == 0xB7), _MARK, _LETTER)
        low[at + 1] = np.where((second < 0x9F) & (second != 0x97), second + 32, second)
    keep = kind != _SPACE
    before = np.concatenate([[np.uint8(_SPACE)], kind[:-1]])
    start = keep & ((kind != before) | (kind == _DIGIT))
    for i in np.flatnonzero((low == 0x27) & start & (before != _MARK)).tolist():  # contractions
        for s in _SUFFIXES:
            if low[i + 1 : i + 1 + len(s)].tobytes() == s:
                end = i + 1 + len(s)
                start[i + 1] = False
                if end < len(kind) and kind[end] == _LETTER:
                    start[end] = True
                break
    odd = kind == _ODD
    odd[:-1] |= (raw[:-1] == 0x3C) & (raw[1:] == 0x7C)
    if odd.any():
        first = np.flatnonzero(keep & (before == _SPACE))
        last = np.flatnonzero(keep & np.concatenate([kind[1:] == _SPACE, [True]])) + 1
        chunk = np.unique(np.searchsorted(first, np.flatnonzero(odd), "right") - 1)
        change = np.zeros(len(raw) + 1, np.int8)
        change[first[chunk]] = 1
        change[last[chunk]] -= 1
        inside = np.cumsum(change[:-1], dtype=np.int8) > 0
        low[inside] = raw[inside]
        start[inside] = False
        start[first[chunk]] = True
    return low, keep, np.flatnonzero(start)


class WordBpe:
    """Codes of parts, kept as stretches of one array of ids."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.full = Tokenizer.from_file(path)
        self.full.no_truncation()
        self.full.no_padding()
        self.bare = Tokenizer(self.full.model)  # without normalizer and splitter: for parts that are split already
        self.letters = byte_letters()
        self._clear()

    def _clear(self) -> None:
        self.number: dict[bytes, int] = {}
        self.ids, self.ends = array("I"), array("q", [0])

    def _add(self, parts: list[bytes]) -> None:
        plain, other = [], []
        for p in parts:
            s = p.decode("utf-8", "replace")
            (plain if "<|" not in s and _LATIN.fullmatch(s) else other).append((p, s))
        letters = self.letters
        shown = [s if s.isascii() else "".join([letters[b] for b in p]) for p, s in plain]
        for model, rows, texts in ((self.bare, plain, shown), (self.full, other, [s for _, s in other])):
            for i in range(0, len(rows), 4096):
                for (p, _), e in zip(rows[i : i + 4096], model.encode_batch_fast(texts[i : i + 4096], add_special_tokens=False)):
                    self.number[p] = len(self.number)
                    self.ids.extend(e.ids)
                    self.ends.append(len(self.ids))

    def numbers(self, parts: pa.Array) -> np.ndarray:
        """Numbers of distinct parts, encoding those that are new."""
        names = parts.to_pylist()
        new = [p for p in names if p not in self.number]
        if new:
            self._add(new)
        return np.fromiter(map(self.number.__getitem__, names), np.int64, len(names))

    def encode(self, column: pa.Array, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts in order (none if not whole), and how many of them each text has."""
        if len(self.number) > KEPT_PARTS:
            self._clear()
        data, places = joined(column)
        ids, counts = [], np.zeros(len(column) + 1, np.int64)
        for a, b in segments(data, 0, len(data), b" \n"):
            low, keep, starts = part_starts(data[a:b])
            if not len(starts):
                continue
            index, parts = distinct(low, keep, starts)
            number = self.numbers(parts)
            ends = np.frombuffer(self.ends, np.int64)
            begin, size = ends[number][index], np.diff(ends)[number][index]
            upto = np.concatenate([[0], np.cumsum(size)])
            del ends
            inner = np.searchsorted(places, a, "right") - 1, np.searchsorted(places, b, "left")
            border = np.clip(places[inner[0] : inner[1] + 1], a, b) - a
            counts[inner[0] : inner[1]] += np.diff(upto[np.searchsorted(starts, border)])
            if whole:
                at = np.repeat(begin - upto[:-1], size) + np.arange(upto[-1])
                ids.append(np.frombuffer(self.ids, np.uint32)[at])
        return np.concatenate(ids) if ids else np.empty(0, np.uint32), counts[:-1]


_loaded: dict[str, WordBpe] = KEPT.setdefault("word_bpe", {})


def word_bpe(path: str) -> WordBpe:
    """One per Python worker and file."""
    if path not in _loaded:
        _loaded[path] = WordBpe(path)
    return _loaded[path]
