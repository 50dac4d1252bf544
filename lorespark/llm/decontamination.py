"""5: benchmark decontamination over a distributed positional inverted index.

The index is cut by documents: a block holds the postings (positions, as differences) of its documents' terms. A test
window goes only to blocks that hold its rarest term; there its offset-adjusted lists are intersected from the rarest on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, materialize, small
from .words import map_words, words_column

#: Bits of the filter over the test set's terms: a fixed size, however many terms there are.
FILTER_BITS = 1 << 24
#: Terms (about 60 bytes each) that may be broadcast; beyond that a shuffle joins them.
BROADCAST_TERMS = 250_000
_SEED = 42  # of Spark's xxhash64

_INDEX = "block long, term string, tf long, width int, postings binary, doc_ids array<{kind}>, starts array<long>, n_words array<long>"


def term_filter(terms: DataFrame, column: str = "term") -> bytes:
    """A Bloom filter of FILTER_BITS bits over the terms, as bytes: at most FILTER_BITS / 64 rows reach the driver."""
    h = F.xxhash64(F.col(column).cast("binary"))
    low, high = h.bitwiseAND(F.lit(FILTER_BITS - 1)), F.shiftrightunsigned(h, 32).bitwiseAND(F.lit(FILTER_BITS - 1))
    cells = (
        terms.select(F.explode(F.array(low, high)).alias("bit"))
        .groupBy(F.shiftright("bit", 3).alias("cell"))
        .agg(F.bit_or(F.expr("cast(shiftleft(1, cast(bit & 7 as int)) as int)")).alias("bits"))
    )
    out = np.zeros(FILTER_BITS // 8, np.uint8)
    for cell, bits in cells.collect():
        out[cell] = bits
    return out.tobytes()


class _Terms(dict):
    """Numbers of a block's terms; -1 for terms that the filter excludes."""

    def __init__(self, allowed: bytes | None):
        self.allowed, self.names = allowed, []

    def __missing__(self, word: bytes) -> int:
        n = -1
        if self.allowed is None or self._may(word):
            n = len(self.names)
            self.names.append(word)
        self[word] = n
        return n

    def numbers(self, words: pa.Array) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words.to_pylist()), np.int32, len(words))

    def _may(self, word: bytes) -> bool:
        h = xxhash.xxh64_intdigest(word, _SEED)
        a, b = h & (FILTER_BITS - 1), (h >> 32) & (FILTER_BITS - 1)
        return bool(self.allowed[a >> 3] >> (a & 7) & 1 and self.allowed[b >> 3] >> (b & 7) & 1)


def _pack(positions: np.ndarray) -> tuple[int, bytes]:
    """Differences in the narrowest of three widths."""
    gaps = np.diff(positions, prepend=0)
    top = int(gaps.max())
    width = 1 if top < 1 << 8 else 2 if top < 1 << 16 else 4
    return width, gaps.astype(f"<u{width}").tobytes()


def _unpack(width: int, raw: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(raw, f"<u{width}"), dtype=np.int64)


def positional_index(df: DataFrame, allowed: bytes | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (block, term, tf, width, postings); each block also has one row without term that lists its documents.

    A block is one Arrow batch (bounded by bytes; a longer document is alone in its block). Positions count words within
    a block, with one left free after each document. allowed (see term_filter) restricts
    the terms to those of a test set; without it all terms are indexed.
    """
    bound_batches(df.sparkSession)
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        block = (context.partitionId() if context else 0) << 32
        for b in batches:
            terms = _Terms(allowed)
            code, first = map_words(b.column(1), terms.numbers, np.int32)
            counts = np.diff(first)
            starts = first[:-1] + np.arange(b.num_rows)  # one place is left free after each document
            at_term = np.flatnonzero(code >= 0)
            code = code[at_term]
            at_term = at_term + np.searchsorted(first[1:], at_term, "right")
            at_term = at_term[np.argsort(code, kind="stable")]
            ends = np.cumsum(np.bincount(code, minlength=len(terms.names))).tolist()
            packed, begin = [], 0
            for e in ends:
                packed.append((e - begin, *_pack(at_term[begin:e])))
                begin = e
            n = len(packed)
            empty = lambda t: pa.array([None] * n, pa.list_(t))
            fields = ["block", "term", "tf", "width", "postings", "doc_ids", "starts", "n_words"]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([block], pa.int64()),
                    pa.array([None], pa.string()),
                    pa.array([None], pa.int64()),
                    pa.array([None], pa.int32()),
                    pa.array([None], pa.binary()),
                    pa.ListArray.from_arrays(pa.array([0, b.num_rows], pa.int32()), b.column(0)),
                    pa.array([starts], pa.list_(pa.int64())),
                    pa.array([counts], pa.list_(pa.int64())),
                ],
                fields,
            )
            if n:
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block] * n, pa.int64()),
                        pa.array([w.decode("utf-8", "replace") for w in terms.names], pa.string()),
                        pa.array([p[0] for p in packed], pa.int64()),
                        pa.array([p[1] for p in packed], pa.int32()),
                        pa.array([p[2] for p in packed], pa.binary()),
                        empty(b.column(0).type),
                        empty(pa.int64()),
                        empty(pa.int64()),
                    ],
                    fields,
                )
            block += 1

    return rows.mapInArrow(lean(run), _INDEX.format(kind=kind))


def test_windows(items: DataFrame, window: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: words (array), items (the ids, as strings, that have it). Items without words have none."""
    words = items.select(F.col(id_col).cast("string").alias("item"), words_column(F.col(text_col)).alias("w")).where(F.size("w") > 0)
    starts = F.sequence(F.lit(1), F.greatest(F.size("w") - F.lit(window - 1), F.lit(1)))
    cut = words.select("item", F.explode(F.transform(starts, lambda i: F.slice(F.col("w"), i, F.lit(window)))).alias("words"))
    return cut.groupBy("words").agg(F.collect_set("item").alias("items"))


def _phrase(plan: list[dict], postings: dict) -> np.ndarray:
    """Starts of the exact phrase: plan lists (term, offset) from the rarest on."""
    starts = None
    for step in plan:
        held = postings.get(step["term"])
        if held is None:
            return np.empty(0, np.int64)
        if starts is None:
            starts = held - step["off"]
        else:
            want = starts + step["off"]
            place = np.minimum(np.searchsorted(held, want), len(held) - 1)
            starts = starts[held[place] == want]
        if not len(starts):
            break
    return starts


def _near(plan: list[dict], postings: dict, span: int, doc_starts: np.ndarray, doc_ends: np.ndarray) -> np.ndarray:
    """Numbers of documents in which all terms occur within span words, in any order."""
    anchor = postings.get(plan[0]["term"])
    if anchor is None:
        return np.empty(0, np.int64)
    starts = np.unique((anchor[:, None] - np.arange(span)[None, :]).ravel())
    doc = np.searchsorted(doc_starts, starts, "right") - 1
    keep = doc >= 0
    starts, doc = starts[keep], doc[keep]
    for term in dict.fromkeys(step["term"] for step in plan):
        held = postings.get(term)
        if held is None:
            return np.empty(0, np.int64)
        place = np.searchsorted(held, starts)
        at = held[np.minimum(place, len(held) - 1)]
        keep = (place < len(held)) & (at < np.minimum(starts + span, doc_ends[doc]))
        starts, doc = starts[keep], doc[keep]
    return np.unique(doc)


def find_contamination(
    df: DataFrame,
    items: DataFrame,
    window: int = 10,
    slop: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """A row for each document: id, n_words, n_hit, items, spans and, for slop > 0, near_items.

    A window is `window` consecutive words of an item, or a shorter item as a whole. n_hit counts the document's words
    inside any occurrence of a window, spans are those stretches (word numbers, end exclusive), items the ids (strings,
    sorted) that have an occurring window. near_items also count windows whose words all occur, in any order, within
    window + slop words. Null or wordless texts have no hits; wordless items no windows; empty tables on either side are
    fine; ids may be null or repeated (a row in, a row out); other columns are not read.
    """
    windows = materialize(test_windows(items, window, item_id_col, item_text_col), "test-windows")
    allowed = term_filter(windows.select(F.explode("words").alias("term")).distinct())
    index = materialize(positional_index(df, allowed, id_col, text_col), "positional-index")
    kind = index.schema["doc_ids"].dataType.elementType.simpleString()

    tf = materialize(index.where("term is not null").groupBy("term").agg(F.sum("tf").alias("tf")), "term-counts")
    steps = windows.select("words", "items", F.posexplode("words").alias("off", "term")).join(small(tf, BROADCAST_TERMS), "term")
    plans = (
        steps.groupBy("words")
        .agg(F.array_sort(F.collect_list(F.struct("tf", "off", "term"))).alias("plan"), F.first("items").alias("items"))
        .where(F.size("plan") == F.size("words"))
        .select("plan", "items", F.col("plan")[0]["term"].alias("term"))
    )
    plans = materialize(plans, "test-plans")  # the join below then stands alone, so that Spark may split a frequent term
    asked = index.where("term is not null").select("block", "term").join(plans, "term").select(F.col("block").alias("at"), "plan", "items")

    def evaluate(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        postings, docs = {}, None
        for r in left.to_pylist():
            if r["term"] is None:
                docs = r
            else:
                postings[r["term"]] = _unpack(r["width"], r["postings"])
        starts, counts = np.array(docs["starts"], np.int64), np.array(docs["n_words"], np.int64)
        n = len(starts)
        change = np.zeros(int(starts[-1] + counts[-1]) + 2, np.int64)
        found: list[set[str]] = [set() for _ in range(n)]
        near: list[set[str]] = [set() for _ in range(n)]
        for q in right.to_pylist():
            size = len(q["plan"])
            hits = _phrase(q["plan"], postings)
            if len(hits):
                np.add.at(change, hits, 1)
                np.add.at(change, hits + size, -1)
                for d in np.unique(np.searchsorted(starts, hits, "right") - 1).tolist():
                    found[d].update(q["items"])
            if slop:
                for d in _near(q["plan"], postings, size + slop, starts, starts + counts).tolist():
                    near[d].update(q["items"])
        inside = np.cumsum(change) > 0
        upto = np.concatenate([[0], np.cumsum(inside)])
        n_hit = upto[starts + counts] - upto[starts]
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        begins, ends = edges[::2], edges[1::2]
        owner = np.searchsorted(starts, begins, "right") - 1
        spans: list[list[dict]] = [[] for _ in range(n)]
        for d, a, e in zip(owner.tolist(), begins.tolist(), ends.tolist()):
            spans[d].append({"begin": a - int(starts[d]), "end": e - int(starts[d])})
        schema = pa.schema(
            [
                ("id", left.schema.field("doc_ids").type.value_type),
                ("n_words", pa.int64()),
                ("n_hit", pa.int64()),
                ("items", pa.list_(pa.string())),
                ("spans", pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))),
                ("near_items", pa.list_(pa.string())),
            ]
        )
        return pa.Table.from_pydict(
            {
                "id": docs["doc_ids"],
                "n_words": counts,
                "n_hit": n_hit,
                "items": [sorted(x) for x in found],
                "spans": spans,
                "near_items": [sorted(x | y) for x, y in zip(near, found)],
            },
            schema,
        )

    out = (
        index.groupBy("block")
        .cogroup(asked.groupBy("at"))
        .applyInArrow(
            evaluate,
            f"id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<begin:long,end:long>>, near_items array<string>",
        )
        .withColumnRenamed("id", id_col)
    )
    return out if slop else out.drop("near_items")
