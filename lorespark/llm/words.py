"""Words of texts as UTF-8 bytes: A-Z lower-cased, then runs of digits, a-z and characters beyond ASCII.

A batch of texts is split at once: the byte classes of its Arrow buffer give the word borders, and Arrow's dictionary
encoding the distinct words, so Python meets each distinct word of a segment once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: The same words as a regular expression over lower-cased text.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_TABLE = np.array([b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256)], np.uint8)
_BYTES = _TABLE.tobytes()
#: Bytes of text that are split at once.
SEGMENT = 2 << 20


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The texts' bytes, each followed by a line feed (null as empty), and where each begins; the last place is the end."""
    kind = pa.large_string()
    texts = pc.binary_join_element_wise(pc.fill_null(column.cast(kind), pa.scalar("", kind)), pa.scalar("", kind), pa.scalar("\n", kind))
    _, ends, data = texts.buffers()
    places = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8), places


def segments(data: np.ndarray, low: int, high: int, cuts: bytes, limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Stretches of data[low:high] of about limit bytes, cut after one of the bytes in cuts."""
    while high - low > limit:
        cut, step = -1, 1 << 16
        for at in range(low + limit, high, step):
            found = np.flatnonzero(np.isin(data[at : at + step], list(cuts)))
            if len(found):
                cut = at + int(found[0]) + 1
                break
        if cut < 0:
            break
        yield low, cut
        low = cut
    if high > low:
        yield low, high


def distinct(flat: np.ndarray, keep: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, pa.Array]:
    """Number of each run's value in the dictionary, and the dictionary. keep: bytes that belong to runs, which begin at
    starts."""
    upto = np.cumsum(keep, dtype=np.int32)
    offsets = np.append(upto[starts] - 1, upto[-1] if len(upto) else 0).astype(np.int32)
    runs = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(flat[keep])])
    coded = runs.dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), coded.dictionary


def map_words(column: pa.Array, values: Callable[[pa.Array], np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """values(distinct words) for every word in order, and the number of each text's first word (the last: of all words)."""
    found, _, first = placed_words(column, values, kind)
    return found, first


def placed_words(column: pa.Array, values: Callable[[pa.Array], np.ndarray], kind: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, with the byte of its text at which each word begins."""
    data, places = joined(column)
    out, at = [], []
    for a, b in segments(data, 0, len(data), b" \n"):
        flat = _TABLE[data[a:b]]
        keep = flat != 32
        starts = np.flatnonzero(keep & ~np.concatenate([[False], keep[:-1]]))
        if len(starts):
            index, words = distinct(flat, keep, starts)
            out.append(values(words)[index])
            at.append(starts + a)
    if not out:
        return np.empty(0, kind), np.empty(0, np.int64), np.zeros(len(places), np.int64)
    begin = np.concatenate(at)
    first = np.searchsorted(begin, places)
    begin -= np.repeat(places[:-1], np.diff(first))
    return np.concatenate(out), begin, first


def split_bytes(text: bytes) -> list[bytes]:
    """The words of one text, in order."""
    return text.translate(_BYTES).split()


def words_column(text: Column) -> Column:
    """The same words inside the JVM, as an array of strings; empty for null."""
    found = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(f"({WORD})"), F.lit(1))
    return F.coalesce(found, F.array().cast("array<string>"))
