"""13: spelling variants. Words are grouped with the much more frequent words that they differ from by one code point.

Near words are found by a rare-first q-gram prefix filter: the bigrams of a word are ordered by how many bigrams of all
words they equal, and only its PREFIX = 2 * 1 + 1 rarest enter the join, with positions that one edit allows. One edit
destroys at most two bigrams, so two near words share one of their three rarest, at positions at most one apart.

A shared bigram that survives the edit also says where the edit is not: before it or after it all is equal, and of the
other side either the first or the second half. The join key holds these parts, so that a bigram which many words share
deals them into small groups and no pairs of a whole group are made. Candidates are verified by edit distance.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget, lean, materialize
from .words import distinct, joined, segments

LEAST_LENGTH = 7
LEAST_COUNT = 2
PREFIX = 3
RATIO = 10
#: A word of a document whose hash this divides loses a code point.
SLIP = 31
#: Runs are of A-Z, a-z and U+00C0 to U+00FF, the characters that begin with this byte in UTF-8.
_LATIN = 0xC3
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_LETTER = np.array([97 <= b <= 122 or b == _LATIN for b in range(256)], bool)


def slipped(word: str, hash_: int, divisor: int = SLIP) -> str:
    """The word as the document has it: where divisor divides the hash, without the code point at hash modulo length."""
    if hash_ % divisor:
        return word
    at = hash_ % len(word)
    return word[:at] + word[at + 1 :]


def count_words(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word and n of all words of LEAST_LENGTH code points or more."""
    rows = df.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("t"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            heads = [None if i is None else zlib.crc32(f"{i}:".encode()) for i in b.column(0).to_pylist()]
            data, places = joined(b.column(1))
            for low, high in segments(data, 0, len(data), b" \n"):
                flat = _LOWER[data[low:high]]
                keep = _LETTER[flat]
                keep[1:] |= flat[:-1] == _LATIN
                first = keep & ~np.concatenate([[False], keep[:-1]])
                starts = np.flatnonzero(first)
                number = np.cumsum(first, dtype=np.int32)[keep] - 1
                length = np.bincount(number[flat[keep] < 0xC0], minlength=len(starts)) if len(starts) else starts
                length -= np.bincount(number[(flat[keep] >= 0x80) & (flat[keep] < 0xC0)], minlength=len(starts)) if len(starts) else 0
                length += np.bincount(number[flat[keep] == _LATIN], minlength=len(starts)) if len(starts) else 0
                long = length >= LEAST_LENGTH
                if not long.any():
                    continue
                keep[np.flatnonzero(keep)[~long[number]]] = False
                starts = starts[long]
                index, words = distinct(flat, keep, starts)
                doc = np.searchsorted(places, starts + low, side="right") - 1
                pairs, times = np.unique(doc.astype(np.int64) * len(words) + index, return_counts=True)
                names = words.to_pylist()
                total = np.bincount(index, minlength=len(words))
                changed: dict[str, int] = {}
                for pair, n in zip(pairs.tolist(), times.tolist()):
                    d, w = divmod(pair, len(names))
                    if heads[d] is not None and (h := zlib.crc32(names[w], heads[d])) % SLIP == 0:
                        total[w] -= n
                        new = slipped(names[w].decode(), h)
                        if len(new) >= LEAST_LENGTH:
                            changed[new] = changed.get(new, 0) + n
                left = np.flatnonzero(total)
                out = words.take(pa.array(left)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([out, pa.array(total[left], pa.int64())], ["word", "n"])
                if changed:
                    yield pa.RecordBatch.from_arrays([pa.array(changed.keys(), pa.string()), pa.array(changed.values(), pa.int64())], ["word", "n"])

    return rows.mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def rarest(word: str, frequency: dict[str, int]) -> list[int]:
    """Places of the PREFIX rarest bigrams (ties by bigram, then place)."""
    grams = sorted((frequency[word[i : i + 2]], word[i : i + 2], i) for i in range(len(word) - 1))
    return [i for _, _, i in grams[:PREFIX]]


def _keys(word: str, at: int, longer: bool) -> set[int]:
    """Keys of the word and its bigram at a place, as the word that is not longer than its partner or as the longer one.

    Keys hold the length of the shorter word, the side of the edit, and everything but the half of that side which may be
    edited. Of the longer word's side one code point more is left out.
    """
    left, gram, right = word[:at], word[at : at + 2], word[at + 2 :]
    size = len(word) - longer
    out = set()
    for side, edited, whole in (("<", left, right), (">", right, left)):
        if longer and not edited:
            continue
        half = (len(edited) - longer) // 2
        for part, held in (("1", edited[:half]), ("2", edited[half + longer :])):
            out.add(xxhash.xxh64_intdigest(f"{size} {side}{part} {gram} {whole} {held}") - (1 << 63))
    return out


def near_pairs(words: DataFrame) -> DataFrame:
    """Both directions of every pair (word, other) at edit distance 1, with n and other_n; a pair may come several times."""
    grams = words.select(F.explode(F.expr("transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))")).alias("gram"))
    # at most 90 * 90 rows: a-z and 64 characters beyond
    frequency = {r["gram"]: r["n"] for r in grams.groupBy("gram").agg(F.count("*").alias("n")).collect()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, keys, longer = [], [], []
            for i, word in enumerate(b.column(0).to_pylist()):
                places = rarest(word, frequency)
                for is_longer in (False, True):
                    own = set().union(*(_keys(word, p, is_longer) for p in places))
                    at += [i] * len(own)
                    keys += own
                    longer += [is_longer] * len(own)
            at = pa.array(at, pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(longer, pa.bool_()), b.column(0).take(at), b.column(1).take(at)], ["key", "longer", "word", "n"])

    entries = materialize(words.select("word", "n").mapInArrow(lean(run), "key long, longer boolean, word string, n long"), "bigram-entries")
    a = entries.where("not longer").select("key", F.col("word").alias("a"), F.col("n").alias("an"))
    b = entries.select("key", "longer", F.col("word").alias("b"), F.col("n").alias("bn"))
    pairs = a.join(b, "key").where((F.col("longer") | (F.col("a") < F.col("b"))) & (F.levenshtein("a", "b", 1) == 1))
    way = lambda x, y, n: F.struct(F.col(x).alias("word"), F.col(y).alias("other"), F.col(n).alias("other_n"))
    both = F.array(way("a", "b", "bn"), way("b", "a", "an"))
    return pairs.select(F.explode(both).alias("p")).select("p.*")


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word with LEAST_COUNT occurrences or more.

    Words are the runs `[A-Za-z\\u00C0-\\u00FF]+` of whole texts with only A-Z lower-cased, of LEAST_LENGTH code points or
    more, less the code point that `slipped` takes. Near words differ by one inserted, deleted or replaced code point. form
    is the near word of largest n (ties: the first in code-point order) if its n is at least ratio times the word's, else
    null; root is where following forms ends. Null and empty texts have no words; rows with a null id keep their words as
    they are; repeated rows count each; other columns are not read; an empty table gives no rows.

    A word has at most 180 near words a code point, so a word's near words are gathered in one row. Forms grow by the
    factor ratio, so the steps to the root are few; they are doubled.
    """
    bound_batches(df.sparkSession)
    words = materialize(count_words(df, id_col, text_col).where(F.col("n") >= LEAST_COUNT), "words")
    near = near_pairs(words).groupBy("word").agg(F.collect_set(F.struct("other_n", "other")).alias("near"))
    best = F.array_min(F.transform("near", lambda x: F.struct((-x["other_n"]).alias("minus"), x["other"].alias("other"))))
    near = near.select("word", F.size("near").cast("long").alias("n_near"), best.alias("best"))
    near = materialize(near.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.minus")).alias("other_n")), "near-words")
    is_form = F.col("other_n") >= ratio * F.col("n")
    found = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("other")).alias("form"), F.when(is_form, F.col("other_n")).alias("form_n")
    )
    found = materialize(found, "word-forms")
    forget(words, near)
    root = materialize(found.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while root.join(root.select(F.col("word").alias("root")), "root", "left_semi").limit(1).count():
        step = root.select(F.col("word").alias("root"), F.col("root").alias("next"))
        further = materialize(root.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        forget(root)
        root = further
    out = found.join(root, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
