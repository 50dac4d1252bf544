"""Conflicts among prompts and answers, complete similarity joins, and exact samples by hash rank."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import text
from ..session import forget, java_udf, materialize, partitions, ship
from . import metrics


def labelled_grams(df: DataFrame, key: str, value: Column, n: int = 1) -> DataFrame:
    """(key, token): each n-gram of the value with the number of its occurrence; shorter values have none."""
    places = F.sequence(F.lit(1), F.length("v") - (n - 1))
    cut = F.transform(places, lambda i: F.substring(F.col("v"), i, F.lit(n)))
    grams = df.select(key, value.alias("v")).where(F.length("v") >= n).select(key, F.explode(cut).alias("c"))
    counts = grams.groupBy(key, "c").agg(F.count("*").alias("n"))
    return counts.select(key, F.explode(F.transform(F.sequence(F.lit(1), "n"), lambda i: F.concat("c", i.cast("string")))).alias("token"))


def prefixes(tokens: DataFrame, key: str, share: float) -> DataFrame:
    """(key, token, n): of each key's n tokens the n - ceil(share n) + 1 that are the rarest of all. Two sets that have
    `share` of each one's tokens in common have one of these in common. tokens: (key, token), distinct."""
    frequency = tokens.groupBy("token").agg(F.count("*").alias("f"))
    sizes = tokens.groupBy(key).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy("f", "token"))
    rows = tokens.join(frequency, "token").join(sizes, key).withColumn("rank", rank)
    return rows.where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1).select(key, "token", "n")


def prefix_pairs(held: DataFrame, key: str, share: float) -> DataFrame:
    """Candidates (a, b), a < b, of keys whose token sets may have `share` of each one's tokens in common, by their prefixes:
    no such pair is lost. Frequent tokens are in few prefixes, since prefixes hold the rarest ones."""
    left, right = held.select(F.col(key).alias("a"), "token", "n"), held.select(F.col(key).alias("b"), "token", F.col("n").alias("m"))
    near = F.least("n", "m") >= F.greatest("n", "m") * share - 1e-9
    return left.join(right, "token").where((F.col("a") < F.col("b")) & near).select("a", "b").distinct()


def selective(held: DataFrame, key: str) -> bool:
    """Do prefixes pass fewer than one in 50 of all pairs? Where texts have few different tokens or a threshold is low, they
    pass nearly all of them, each several times; then every pair of sets is counted in blocks instead."""
    met = held.groupBy("token").agg(F.count("*").cast("double").alias("f")).agg(F.sum(F.col("f") * F.col("f"))).first()[0] or 0.0
    return met * 50 < float(held.select(key).distinct().count()) ** 2


def in_blocks(rows: DataFrame, pairs: Callable, schema: T.StructType) -> DataFrame:
    """All pairs of rows, in blocks: pairs(x, y, counts, same) gets two Arrow tables of rows (the same one twice for pairs
    inside a block) and an iterator of (i, common): the numbers of tokens in `g` that x's rows have in common with y's, of at
    most 256 rows of x from row i on; it yields record batches. A row goes to each block once, so what is shuffled grows with
    the rows times the blocks; a task holds two blocks of 4,096 rows or a million tokens about."""
    spark = rows.sparkSession
    ship(spark)
    arrow = to_arrow_schema(schema)
    n, tokens = rows.agg(F.count("*"), F.coalesce(F.sum(F.size("g")), F.lit(0))).first()
    blocks = max(min(16, -(-n // 256)), -(-n // 4096), -(-tokens // 1_000_000), 1)
    mine = F.pmod(F.xxhash64(rows.columns[0]), F.lit(blocks)).cast("int")
    sent = rows.withColumn("_at", mine).withColumn("_with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    sent = sent.withColumns({"_x": F.least("_at", "_with"), "_y": F.greatest("_at", "_with")}).drop("_with")

    def run(table: pa.Table) -> Iterator[pa.RecordBatch]:
        x, y = table["_x"][0].as_py(), table["_y"][0].as_py()
        at = table["_at"].to_numpy()
        sides = [table.filter(pa.array(at == x)), table.filter(pa.array(at == y))]
        if sides[0].num_rows and sides[1].num_rows:
            yield from pairs(*sides, _common(*[side["g"].combine_chunks() for side in sides]), x == y)

    groups = max(partitions(spark), min(blocks * (blocks + 1) // 2, 1000))
    return sent.repartition(groups, "_x", "_y").groupBy("_x", "_y").applyInArrow(lambda t: pa.Table.from_batches(list(run(t)), arrow), schema)


def _common(*lists: pa.Array, rows: int = 256, width: int = 2048, kept: int = 1 << 27) -> Iterator[tuple[int, np.ndarray]]:
    """The counts of in_blocks for two lists of token lists, by matrix products over `width` shared tokens at a time. The
    second list's matrices are made once, unless they take more than `kept` bytes."""
    tokens = [v.flatten() for v in lists]
    both = pa.chunked_array(tokens).dictionary_encode().combine_chunks()
    codes = np.split(both.indices.to_numpy(zero_copy_only=False), [len(tokens[0])])
    place = [np.repeat(np.arange(len(v)), v.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) for v in lists]
    shared = np.intersect1d(codes[0], codes[1])
    number = np.full(len(both.dictionary), -1)
    number[shared] = np.arange(len(shared))
    codes = [number[c] for c in codes]

    def matrix(side: int, low: int, high: int, token: int) -> np.ndarray:
        c, p = codes[side], place[side]
        first, last = np.searchsorted(p, [low, high])
        c, p = c[first:last], p[first:last]
        keep = (c >= token) & (c < token + width)
        m = np.zeros((high - low, min(width, len(shared) - token)), np.float32)
        m[p[keep] - low, c[keep] - token] = 1
        return m

    starts = range(0, len(shared), width)
    held = [matrix(1, 0, len(lists[1]), t) for t in starts] if len(lists[1]) * len(shared) * 4 <= kept else None
    for row in range(0, len(lists[0]), rows):
        end = min(row + rows, len(lists[0]))
        common = np.zeros((end - row, len(lists[1])), np.float32)
        for i, t in enumerate(starts):
            common += matrix(0, row, end, t) @ (held[i] if held else matrix(1, 0, len(lists[1]), t)).T
        yield row, common


def _pair_schema(rows: DataFrame, key: str, *scores: str) -> T.StructType:
    kind = rows.schema[key].dataType
    return T.StructType([T.StructField("a", kind), T.StructField("b", kind), *[T.StructField(c, T.DoubleType()) for c in scores]])


def _sizes(table: pa.Table) -> np.ndarray:
    return table["g"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.float64)


def _alike(x: pa.Table, y: pa.Table, counts: Iterator[tuple[int, np.ndarray]], threshold: float) -> Iterator[tuple[np.ndarray, ...]]:
    """(i, j, score) of pairs of in_blocks with a Jaccard of at least threshold, for some rows of x at a time. In single
    precision most pairs are ruled out, with room for its error; the others are scored exactly."""
    one, two = _sizes(x), _sizes(y)
    least = threshold / (1 + threshold)
    need = [(least * v - 0.01).astype(np.float32) for v in (one, two)]
    for row, common in counts:
        i, j = np.nonzero(common >= need[0][row : row + len(common), None] + need[1])
        c = common[i, j].astype(np.float64)
        i = i + row
        score = c / (one[i] + two[j] - c)
        good = score >= threshold
        yield i[good], j[good], score[good]


def similar_pairs(df: DataFrame, key: str, value: str, threshold: float, n: int = 2) -> DataFrame:
    """All pairs (a, b, score), a < b, of rows with distinct keys whose n-gram Jaccard is at least threshold. Texts
    without any n-gram (empty, or punctuation alone) are in no pair."""
    rows, held = _grams(df, key, value, threshold, n)
    if selective(held, key):
        return _by_prefix(rows, held, key, threshold)
    forget(held)
    schema = _pair_schema(rows, key, "score")
    arrow = to_arrow_schema(schema)

    def pairs(x: pa.Table, y: pa.Table, counts: Iterator, same: bool) -> Iterator[pa.RecordBatch]:
        for i, j, score in _alike(x, y, counts, threshold):
            one, two = x[key].take(pa.array(i)), y[key].take(pa.array(j))
            turned = [] if same else [(two, one)]  # inside a block a pair comes up both ways
            for a, b in [(one, two), *turned]:
                yield from pa.table([a, b, pa.array(score)], schema=arrow).filter(pc.less(a, b)).to_batches()

    return in_blocks(rows.where(F.size("g") > 0), pairs, schema)


def _grams(df: DataFrame, key: str, value: str, threshold: float, n: int, *rest: str) -> tuple[DataFrame, DataFrame]:
    rows = materialize(df.select(key, text.char_ngrams(F.col(value), n).alias("g"), *rest), "grams")
    return rows, materialize(prefixes(rows.select(key, F.explode("g").alias("token")), key, threshold), "prefixes")


def _by_prefix(rows: DataFrame, held: DataFrame, key: str, threshold: float) -> DataFrame:
    left, right = rows.select(F.col(key).alias("a"), F.col("g").alias("x")), rows.select(F.col(key).alias("b"), F.col("g").alias("y"))
    score = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    scored = prefix_pairs(held, key, threshold).join(left, "a").join(right, "b").withColumn("score", score)
    return scored.where(F.col("score") >= threshold).select("a", "b", "score")


#: What a text's length adds to its score as an answer, and the places in which two such sums are told apart.
LONG, MOST, PLACES = 200, 0.2, 1e12


def best_others(df: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """(a, b, score): among the pairs of similar_pairs, both ways, at least each row's best other row. Where pairs are counted
    in blocks, a block returns one other row a row, so that rows grow with the blocks and not with all alike pairs."""
    rows, held = _grams(df.withColumn("n", F.length(value)), key, value, threshold, 2, "n")
    if selective(held, key):
        turn = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"), "score")
        return _by_prefix(rows, held, key, threshold).select(F.inline(F.array(turn("a", "b"), turn("b", "a"))))
    forget(held)
    schema = _pair_schema(rows, key, "score")
    arrow = to_arrow_schema(schema)

    def pairs(x: pa.Table, y: pa.Table, counts: Iterator, same: bool) -> Iterator[pa.RecordBatch]:
        sides = (x, y)
        keys = [t[key].combine_chunks() for t in sides]
        order = np.split(np.unique(np.concatenate([k.to_numpy(zero_copy_only=False) for k in keys]), return_inverse=True)[1], [len(x)])
        bonus = [np.minimum(t["n"].to_numpy().astype(np.float64) / LONG, MOST) for t in sides]
        best = [np.full((3, len(t)), -1.0) for t in sides]  # rank, row of the other side, score
        for i, j, score in _alike(x, y, counts, threshold):
            if same:
                i, j, score = (v[order[0][i] != order[1][j]] for v in (i, j, score))
            for side, mine, other in ((0, i, j), *([] if same else [(1, j, i)])):  # inside a block a pair comes up both ways
                rank = np.rint((score + bonus[1 - side][other]) * PLACES)
                place = np.lexsort((order[1 - side][other], -rank, mine))
                place = place[np.unique(mine[place], return_index=True)[1]]
                m, o, r = mine[place], other[place], rank[place]
                old = best[side][:, m]
                less = order[1 - side][o] < order[1 - side][old[1].astype(np.int64)]
                new = (r > old[0]) | ((r == old[0]) & less)
                best[side][:, m[new]] = r[new], o[new], score[place][new]
        for side in (0,) if same else (0, 1):
            found = np.nonzero(best[side][0] >= 0)[0]
            other = keys[1 - side].take(pa.array(best[side][1, found].astype(np.int64)))
            yield from pa.table([keys[side].take(pa.array(found)), other, pa.array(best[side][2, found])], schema=arrow).to_batches()

    return in_blocks(rows.where(F.size("g") > 0), pairs, schema)


def near_conflicts(df: DataFrame, key: str, user: str, assistant: str, prompt: float = 0.82, answer: float = 0.45) -> DataFrame:
    """Pairs of prompts at least `prompt` alike whose answers are less than `answer` alike: a, b, prompt_sim,
    answer_sim. Of equal normal forms the row with the least key stands for all.

    The ratio is twice the matched characters M over all of them, N. So only pairs with enough characters in common are
    candidates. Of these the ratio, a loop in Python, is computed for those with enough bigrams in common: between two
    blocks of matches at least one character is unmatched, so M characters in blocks keep 3 M - N - 1 bigrams at least.
    """
    rows = df.select(key, text.prompt_key(F.col(user)).alias("p"), text.prompt_key(F.col(assistant)).alias("q"))
    rows = materialize(rows.groupBy("p").agg(F.min(F.struct(key, "q")).alias("r")).select(f"r.{key}", "p", "r.q"), "prompts")
    share = prompt / (2 - prompt)
    letters = materialize(labelled_grams(rows, key, F.col("p")), "letters")
    held = materialize(prefixes(letters, key, share), "prefixes")
    if not selective(held, key):
        forget(letters, held)
        return _conflicts_in_blocks(rows.where(F.length("p") > 0), key, prompt, answer)
    none = F.array().cast("array<string>")
    grams = labelled_grams(rows, key, F.col("p"), 2).groupBy(key).agg(F.collect_list("token").alias("g"))  # of one prompt
    rows = rows.join(grams, key, "left").withColumn("g", F.coalesce("g", none))
    left = rows.select(F.col(key).alias("a"), F.col("p").alias("p1"), F.col("q").alias("q1"), F.col("g").alias("g1"))
    right = rows.select(F.col(key).alias("b"), F.col("p").alias("p2"), F.col("q").alias("q2"), F.col("g").alias("g2"))
    total = F.length("p1") + F.length("p2")
    enough = F.size(F.array_intersect("g1", "g2")) >= (1.5 * prompt - 1) * total - 1 - 1e-9
    both = prefix_pairs(held, key, share).join(left, "a").join(right, "b").where(enough).withColumn("prompt_sim", metrics.sequence_ratio("p1", "p2"))
    both = both.where(F.col("prompt_sim") >= prompt).withColumn("answer_sim", metrics.sequence_ratio("q1", "q2"))
    return both.where(F.col("answer_sim") < answer).select("a", "b", "prompt_sim", "answer_sim")


def _conflicts_in_blocks(rows: DataFrame, key: str, prompt: float, answer: float) -> DataFrame:
    """near_conflicts over all pairs of rows (key, p, q). A task joins blocks of 1,024 rows or four million characters about,
    which stay where they are written, and a pair of blocks is compared inside the JVM."""
    spark = rows.sparkSession
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("p") + F.coalesce(F.length("q"), F.lit(0))), F.lit(0))).first()
    blocks = max(min(16, -(-n // 256)), -(-n // 1024), -(-size // 4_000_000), 1)
    at = F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")
    held = materialize(rows.groupBy(at.alias("x")).agg(F.collect_list(F.struct(key, "p", "q")).alias("one")), "blocks")
    held = held.repartitionByRange(min(blocks, 24), "x")
    even = (F.col("x") + F.col("y")) % 2 == 0
    once = (F.col("x") == F.col("y")) | F.when(even, F.col("x") < F.col("y")).otherwise(F.col("x") > F.col("y"))  # evenly in all tasks
    both = held.join(held.toDF("y", "two").hint("shuffle_replicate_nl"), once)
    compare = java_udf(spark, "NearConflicts", T.ArrayType(_pair_schema(rows, key, "prompt_sim", "answer_sim")))
    return both.select(F.inline(compare("one", "two", F.col("x") == F.col("y"), F.lit(float(prompt)), F.lit(float(answer)))))


def conflicts(df: DataFrame, user: str, assistant: str, unknown: str, ratio: float = 2.5) -> DataFrame:
    """(check, prompt, n): exact prompts with several answers, normal forms with several, answers that are the
    unknown reply, and normal forms whose answers differ in length by the ratio."""
    rows = df.select(
        F.col(user).alias("u"), F.col(assistant).alias("v"), text.prompt_key(F.col(user)).alias("p"), text.prompt_key(F.col(assistant)).alias("q")
    )
    length = F.greatest(F.length("q"), F.lit(1))
    exact = rows.groupBy("u").agg(F.countDistinct("v").alias("n")).where("n > 1").select(F.lit("exact").alias("check"), F.col("u").alias("prompt"), "n")
    by_form = rows.groupBy("p").agg(F.countDistinct("q").alias("n"), F.count("*").alias("k"), F.min(length).alias("low"), F.max(length).alias("high"))
    several = by_form.where("n > 1").select(F.lit("normalized").alias("check"), F.col("p").alias("prompt"), "n")
    lengths = by_form.where((F.col("k") > 1) & (F.col("high") >= ratio * F.col("low"))).select(F.lit("length").alias("check"), F.col("p").alias("prompt"), F.col("k").alias("n"))
    target = rows.where(F.col("v").contains(unknown)).groupBy("u").agg(F.count("*").alias("n"))
    return exact.union(several).union(lengths).union(target.select(F.lit("unknown_target").alias("check"), F.col("u").alias("prompt"), "n"))


def taken_by_hash(df: DataFrame, key: Column, ratio: float) -> DataFrame:
    """Df with `taken`, true for exactly round(n ratio) rows, those with the least sha256 of their distinct keys.

    The cut is found from counts by the first two bytes; only the rows of the cut's own cell are ranked.
    """
    rows = df.withColumn("_h", F.sha2(key.cast("string"), 256)).withColumn("_cell", F.substring("_h", 1, 4))
    cells = rows.groupBy("_cell").agg(F.count("*").alias("_n"))  # 65,536 at most
    upto = cells.withColumn("_before", F.sum("_n").over(Window.orderBy("_cell")) - F.col("_n"))
    total = F.round(F.sum("_n").over(Window.partitionBy()) * F.lit(ratio))
    upto = upto.withColumn("_left", total - F.col("_before"))
    known = rows.join(F.broadcast(upto.select("_cell", "_n", "_left")), "_cell")
    whole = known.where((F.col("_left") >= F.col("_n")) | (F.col("_left") <= 0)).withColumn("taken", F.col("_left") > 0)
    cut = known.where((F.col("_left") < F.col("_n")) & (F.col("_left") > 0))
    cut = cut.withColumn("taken", F.row_number().over(Window.partitionBy("_cell").orderBy("_h")) <= F.col("_left"))
    return whole.union(cut).drop("_h", "_cell", "_n", "_left")


def best_similar(df: DataFrame, key: str, value: str, threshold: float) -> DataFrame:
    """For each row its best other row: (key, other, score) by score + min(length / 200, 0.2), the least key of
    those equal to 12 places. Equal texts are compared once."""
    forms = df.groupBy(value).agg(F.min(key).alias("first"))
    rows = df.join(forms, value)
    second = rows.where(F.col(key) != F.col("first")).groupBy("first").agg(F.min(key).alias("second"))
    both = best_others(forms, "first", value, threshold).toDF("first", "other", "score")
    own = second.select("first", F.col("first").alias("other"), F.lit(1.0).alias("score"))
    texts = forms.select(F.col("first").alias("other"), F.length(value).alias("n"))
    found = both.union(own).join(texts, "other").join(second, "first", "left")
    found = rows.select(key, "first").join(found, "first")
    same = F.col("other") == F.col("first")
    other = F.when(same & (F.col(key) == F.col("first")), F.col("second")).otherwise(F.col("other"))
    rank = F.rint((F.col("score") + F.least(F.col("n") / LONG, F.lit(MOST))) * PLACES)
    best = found.groupBy(key).agg(F.max_by(F.struct(other.alias("other"), "score"), F.struct(rank, -other)).alias("b"))
    return best.select(key, "b.*")
