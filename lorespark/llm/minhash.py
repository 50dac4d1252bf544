"""8: near duplicates by order MinHash, verified by banded alignment of word shingles.

A table's sketch takes the LEAST labelled k-mers with the smallest hashes (a label counts earlier occurrences of the same
k-mer) and keeps them in text order, so it agrees with a probability that falls with the edit distance. Texts that share
a sketch are candidates; two of them are linked if the shingles that an alignment matches in order make up SIMILARITY of
all their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget, lean, materialize, small
from .components import components
from .words import map_words

SHINGLE = 5
SIMILARITY = 0.8
#: Tables, and labelled k-mers in each sketch: two texts of similarity 0.8 share a sketch with a chance of 0.33 in each
#: table, and none of the thirty with a chance of 6.6e-6.
TABLES = 30
LEAST = 5
#: Texts of fewer shingles have sketches of SHORT_LEAST k-mers, since five of them would nearly be the whole text; texts
#: up to a quarter longer have both kinds, so that two texts of similarity 0.8 always have one in common.
SHORT = 20
SHORT_LEAST = 3
#: Shingles of the texts in one part of a bucket that is compared block by block; a longer text is a part of its own.
BLOCK_SHINGLES = 200_000

_MUL = np.uint64(0x9E3779B97F4A7C15)
_SEEDS = (np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MUL
    return x ^ (x >> np.uint64(29))


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words.to_pylist()), np.uint64, len(words))


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    """The hashes of each text's words."""
    found, first = map_words(texts, _hashes, np.uint64)
    return [found[a:b] for a, b in zip(first[:-1].tolist(), first[1:].tolist())]


def shingles(words: np.ndarray, k: int = SHINGLE) -> np.ndarray:
    """Hashes of k consecutive words each; of all words, if there are fewer but some."""
    n = len(words)
    if not n:
        return words
    k = min(k, n)
    out = np.zeros(n - k + 1, np.uint64)
    for i in range(k):
        out = out * _MUL + words[i : n - k + 1 + i]
    return _mix(out)


def _labelled(grams: np.ndarray) -> np.ndarray:
    """Hashes of (k-mer, number of its earlier occurrences)."""
    order = np.argsort(grams, kind="stable")
    ranked = grams[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    if new.all():
        return grams
    first = np.maximum.accumulate(np.where(new, np.arange(len(grams)), 0))
    label = np.empty(len(grams), np.uint64)
    label[order] = (np.arange(len(grams)) - first).astype(np.uint64)
    return np.where(label == 0, grams, _mix(grams + label * _MUL))


def _family(x: np.ndarray, grams: np.ndarray, least: int) -> np.ndarray:
    n = len(x)
    keys = np.zeros(TABLES, np.uint64)
    step = max(1, min(TABLES, (1 << 20) // n))  # tables at once, so that a long text needs no large matrix
    for t in range(0, TABLES, step):
        seeds = _SEEDS[t : t + step, None]
        h = _mix(x[None, :] * seeds)
        low = np.argpartition(h, least - 1, axis=1)[:, :least] if n > least else np.tile(np.arange(n), (len(h), 1))
        low.sort(axis=1)  # text order
        key = seeds[:, 0] + np.uint64(least)
        for j in range(low.shape[1]):
            key = key * _MUL + grams[low[:, j]]
        keys[t : t + step] = _mix(key)
    return keys


def sketches(grams: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """Keys of one or both kinds of sketches, one for each table; keys of different tables and kinds differ."""
    x, found = _labelled(grams), []
    if len(grams) < SHORT / similarity:
        found.append(_family(x, grams, SHORT_LEAST))
    if len(grams) >= SHORT:
        found.append(_family(x, grams, LEAST))
    return np.concatenate(found)


#: Rows of an alignment between two moves of the band.
_ROWS = 64


def matched_in_order(a: np.ndarray, b: np.ndarray, band: int, need: int = 0) -> int:
    """Longest common subsequence of a and b whose matches lie at most band places off the diagonal, by bit-parallel rows
    over the band alone: memory grows with the band, not with the square. Less than need may be told as 0."""
    order = np.argsort(a, kind="stable")
    low, high = np.searchsorted(a[order], b, "left"), np.searchsorted(a[order], b, "right")
    width = 2 * band + _ROWS
    full = (1 << width) - 1
    v, done = full, 0  # bits stand for places of a from j0 - band on; zero bits are steps of the subsequence
    for j0 in range(0, len(b), _ROWS):
        base = j0 - band
        for j in range(j0, min(j0 + _ROWS, len(b))):
            first, last = max(j - band, 0), min(j + band, len(a) - 1)
            places = order[low[j] : high[j]]
            if len(places) > 8:
                places = places[np.searchsorted(places, first) : np.searchsorted(places, last, "right")]
            if len(places) > 64:
                bits = np.zeros(width, np.uint8)
                bits[places - base] = 1
                m = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            else:
                m = 0
                for p in places.tolist():
                    if first <= p <= last:
                        m |= 1 << (p - base)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        out = v & ((1 << _ROWS) - 1)
        steps = width - v.bit_count()
        if done + steps + max(0, len(b) - j0 - _ROWS) < need:
            return 0
        done += _ROWS - out.bit_count()
        v = (v >> _ROWS) | ((1 << _ROWS) - 1) << (width - _ROWS)
    return done + width - v.bit_count()


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Do matches in order, within the band that the similarity allows, make up that part of all shingles?"""
    na, nb = len(a), len(b)
    if not na or not nb or min(na, nb) < similarity * max(na, nb):
        return False
    need = similarity * (na + nb) / (1 + similarity)  # matches m with m / (na + nb - m) >= similarity
    need = int(np.ceil(need - 1e-9))
    low = min(na, nb)
    differ = np.flatnonzero(a[:low] != b[:low])
    head = int(differ[0]) if len(differ) else low
    rest = low - head
    differ = np.flatnonzero(a[na - rest :][::-1] != b[nb - rest :][::-1]) if rest else differ
    tail = int(differ[0]) if len(differ) else rest
    need -= head + tail
    if need <= 0:
        return True
    left, right = a[head : na - tail], b[head : nb - tail]
    band = len(left) + len(right) - 2 * need  # unmatched shingles that the similarity leaves
    if band < 0:
        return False
    ua, ca = np.unique(left, return_counts=True)
    ub, cb = np.unique(right, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    if int(np.minimum(ca[ia], cb[ib]).sum()) < need:
        return False
    return matched_in_order(left, right, band, need) >= need


def signatures(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """id, digest (of the words), n (shingles) and keys of every row; digest and keys are null without words."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            digests, counts, keys = [], [], []
            for words in word_hashes(b.column(1)):
                grams = shingles(words)
                counts.append(len(grams))
                digests.append(xxhash.xxh128_digest(words.tobytes()) if len(words) else None)
                keys.append(sketches(grams, similarity).view(np.int64) if len(words) else None)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(digests, pa.binary()), pa.array(counts, pa.int64()), pa.array(keys, pa.list_(pa.int64()))],
                ["id", "digest", "n", "keys"],
            )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {kind}, digest binary, n long, keys array<long>")


def _grams_of(df: DataFrame, ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, digest and shingles (32-bit hashes) of the rows that have one of some ids."""
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    rows = rows.join(small(ids), "id", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words = word_hashes(b.column(1))
            grams = [shingles(w).astype("<u4").tobytes() for w in words]
            digests = [xxhash.xxh128_digest(w.tobytes()) if len(w) else None for w in words]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.array(grams, pa.binary())], ["id", "digest", "grams"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lean(run), f"id {kind}, digest binary, grams binary")


def _verify(pairs: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingles align."""
    left = grams.select(F.col("id").alias("a"), F.col("grams").alias("ga"))
    right = grams.select(F.col("id").alias("b"), F.col("grams").alias("gb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keep = [
                aligned(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), similarity)
                for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())
            ]
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    kind = pairs.schema["a"].dataType.simpleString()
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "ga", "gb")
    return both.mapInArrow(lean(run), f"a {kind}, b {kind}")


def _compare(rows: list[dict], similarity: float) -> Iterator[tuple]:
    """Links of one block between its open texts (q) and all others outside their component that share no earlier bucket."""
    asked, there = [r for r in rows if r["q"]], [r for r in rows if not r["q"]]
    held = [np.frombuffer(r["grams"], "<u4") for r in there]
    if not asked or not held:
        return
    sizes = np.array([len(g) for g in held])
    flat, owner = np.concatenate(held), np.repeat(np.arange(len(held)), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    for q in asked:
        grams = np.frombuffer(q["grams"], "<u4")
        g, count = np.unique(grams, return_counts=True)
        low, high = np.searchsorted(flat, g, "left"), np.searchsorted(flat, g, "right")
        common = np.zeros(len(held), np.int64)  # at least what both have in common, so no link is missed
        step = max(1, len(flat) // max(1, int((high - low).max())))
        for at in range(0, len(g), step):
            lo, n = low[at : at + step], (high - low)[at : at + step]
            places = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))
            common += np.bincount(owner[places], minlength=len(held))
        need = similarity * (len(grams) + sizes) / (1 + similarity)
        for k in np.flatnonzero(common >= np.floor(need)).tolist():
            o = there[k]
            if o["root"] == q["root"] or o["id"] == q["id"]:
                continue
            if q["key"] != min(set(q["open_keys"]).intersection(o["open_keys"])):
                continue
            if aligned(grams, held[k], similarity):
                yield q["id"], o["id"]


def _open_links(members: DataFrame, grams: DataFrame, similarity: float) -> DataFrame:
    """Links between what lacks in the component of its bucket's hub and the bucket's other texts, block by block.

    members: (key, id, n, root, open, weight, open_weight, open_keys): open marks the texts that lack; the weights are
    the shingles of all and of the open texts of the bucket; open_keys the buckets with open texts that the text is in.
    """
    kind = members.schema["id"].dataType.simpleString()
    parts = lambda w: F.ceil(F.col(w) / F.lit(BLOCK_SHINGLES)).cast("int")
    place = lambda w: F.pmod(F.xxhash64("id"), parts(w)).cast("int")
    each = lambda w: F.explode(F.sequence(F.lit(0), parts(w) - 1))
    base = ["key", "id", "root", "open_keys"]
    asked = members.where("open").select(*base, place("open_weight").alias("i"), each("weight").alias("j"), F.lit(True).alias("q"))
    there = members.select(*base, each("open_weight").alias("i"), place("weight").alias("j"), F.lit(False).alias("q"))
    block = ["key", "i", "j"]
    rows = asked.unionByName(there).join(grams, "id").select(*block, "id", "root", "open_keys", "q", "grams")
    rows = rows.repartition(*block).sortWithinPartitions(*block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        id_type = None
        for b in batches:
            id_type, found = b.schema.field("id").type, []
            for r in b.to_pylist():
                if held and any(r[c] != held[0][c] for c in block):
                    found += _compare(held, similarity)
                    held = []
                held.append(r)
            yield _pairs(found, id_type)
        if held:
            yield _pairs(list(_compare(held, similarity)), id_type)

    return rows.mapInArrow(lean(run), f"a {kind}, b {kind}")


def _pairs(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i in (0, 1)], ["a", "b"])


def near_duplicates(
    df: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, class_id (the least id of its class) and kept (id is class_id) of every row.

    Classes are the components of links; texts of the same words are linked, others by alignment. Every text of a bucket
    is compared with the bucket's hub (its least id), then those that are not in the hub's component with all others of
    the bucket outside their own, in blocks: so all texts that share a sketch are compared or in one class already,
    whatever the bucket's size. Texts without words (also null) are classes of their own. An id stands for one document:
    of different texts under one id that with the least digest is compared, and all rows of the id share the least class;
    a row with a null id has a null class and is kept. Other columns are not read; an empty table gives no rows.
    """
    signed = materialize(signatures(df, id_col, text_col, similarity), "signatures")
    reps = (
        signed.where("digest is not null and id is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.min("n").alias("n"), F.min("keys").alias("keys"))
    )
    repeats = bool(signed.groupBy("id").agg(F.count("*").alias("k")).where("k > 1 and id is not null").limit(1).count())
    if repeats:
        one = reps.groupBy("rep").agg(F.min(F.struct("digest", "n", "keys")).alias("r"))
        reps = one.select("r.digest", "rep", "r.n", "r.keys")
    reps = materialize(reps, "representatives")
    entries = reps.select(F.col("rep").alias("id"), "n", F.explode("keys").alias("key"))
    hubs = (
        entries.groupBy("key")
        .agg(F.count("*").alias("size"), F.sum("n").alias("weight"), F.min(F.struct(F.col("id").alias("hub"), F.col("n").alias("m"))).alias("h"))
        .where("size > 1")
        .select("key", "size", "weight", "h.*")
    )
    buckets = materialize(entries.join(hubs, "key"), "buckets")
    near_size = F.least("n", "m") >= F.lit(similarity) * F.greatest("n", "m")
    stars = buckets.where((F.col("id") != F.col("hub")) & near_size)
    pairs = materialize(stars.select(F.col("hub").alias("a"), F.col("id").alias("b")).distinct(), "pairs")
    # a bucket of two has no other pair than its star
    wide = buckets.where("size > 2").select("id").union(pairs.select(F.explode(F.array("a", "b"))))
    touched = materialize(wide.distinct(), "touched")
    grams = _grams_of(df, touched, id_col, text_col)
    if repeats:
        known = reps.select(F.col("rep").alias("id"), "digest")
        grams = grams.join(known, ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"])
    grams = materialize(grams.select("id", "grams"), "grams")
    links = materialize(_verify(pairs, grams, similarity), "links")

    first = components(links)
    root_of = first.select(F.col("node").alias("id"), "root")
    placed = buckets.where("size > 2").join(root_of, "id", "left").join(root_of.toDF("hub", "main"), "hub", "left")
    placed = placed.withColumn("root", F.coalesce("root", "id")).withColumn("main", F.coalesce("main", "hub"))
    placed = placed.select("key", "id", "n", "root", "weight", (F.col("root") != F.col("main")).alias("open"))
    placed = materialize(placed, "placed")
    open_ = placed.where("open").groupBy("key").agg(F.sum("n").alias("open_weight"))
    members = materialize(placed.join(open_, "key"), "open-buckets")
    found = first
    if members.limit(1).count():
        held = members.groupBy("id").agg(F.collect_list("key").alias("open_keys"))  # at most two for each table
        more = materialize(_open_links(members.join(held, "id"), grams, similarity), "more-links")
        if more.limit(1).count():
            found = components(first.toDF("a", "b").union(more))
    forget(pairs, links, buckets, placed, touched, grams)

    classes = reps.select("digest", "rep").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    classes = classes.select("digest", F.coalesce("root", "rep").alias("class_id"))
    out = signed.select("id", "digest").join(classes, "digest", "left")
    out = out.withColumn("class_id", F.coalesce("class_id", "id"))
    if repeats:
        least = out.groupBy("id").agg(F.min("class_id").alias("class_id"))
        out = out.drop("class_id").join(least, "id", "left")
    kept = F.coalesce(F.col("id") == F.col("class_id"), F.lit(True))
    return out.select(F.col("id").alias(id_col), "class_id", kept.alias("kept"))
