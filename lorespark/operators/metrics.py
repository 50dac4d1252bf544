"""Similarity, metrics and gates as columns over tables of answers and scores."""

from __future__ import annotations

from bisect import bisect_left

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import grammar, text
from ..functions.text import char_ngrams, let


def jaccard(a: Column, b: Column, n: int = 2) -> Column:
    """M1: of character n-grams; two empty texts are equal, one empty text shares nothing."""

    def share(p: Column) -> Column:
        x, y = p["x"], p["y"]
        both = F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y))
        empty = (F.size(x) == 0).cast("int") + (F.size(y) == 0).cast("int")
        return F.when(empty == 2, 1.0).when(empty == 1, 0.0).otherwise(both)

    return let(F.struct(char_ngrams(a, n).alias("x"), char_ngrams(b, n).alias("y")), share)


def coverage(answer: Column, teacher: Column, n: int = 2) -> Column:
    """M2: the share of the teacher's n-grams that the answer has; 1 if the teacher has none."""
    share = lambda p: F.when(F.size(p["y"]) == 0, 1.0).otherwise(F.size(F.array_intersect(p["x"], p["y"])) / F.size(p["y"]))
    return let(F.struct(char_ngrams(answer, n).alias("x"), char_ngrams(teacher, n).alias("y")), share)


def _places(text: str) -> dict[str, list[int]]:
    found: dict[str, list[int]] = {}
    for i, c in enumerate(text):
        found.setdefault(c, []).append(i)
    return found


class Ratio:
    """M3: Ratcliff and Obershelp's ratio, as difflib's SequenceMatcher(None, a, b).ratio() gives it, with its heuristic: in
    texts b of 200 characters or more a match begins only at characters that make up 1 % of b at most. Only the places of a
    that hold such characters are visited, and what is found of a text once is kept."""

    def __init__(self):
        self.known: dict[str, tuple[dict[str, list[int]], dict[str, list[int]]]] = {}

    def of(self, text: str) -> tuple[dict[str, list[int]], dict[str, list[int]]]:
        if text not in self.known:
            held, most = _places(text), len(text) // 100 + 1
            rare = {c: at for c, at in held.items() if len(at) <= most} if len(text) >= 200 else held
            self.known[text] = held, rare
        return self.known[text]

    def __call__(self, a: str, b: str) -> float:
        total = len(a) + len(b)
        return 2.0 * self.matched(a, b) / total if total else 1.0

    def matched(self, a: str, b: str) -> int:
        held, rare = self.of(a)[0], self.of(b)[1]
        hits = sorted((i, js) for c, js in rare.items() if c in held for i in held[c])
        at = [i for i, _ in hits]
        total, left = 0, [(0, len(a), 0, len(b))]
        while left:
            a0, a1, b0, b1 = left.pop()
            i, j, size, before, last = a0, b0, 0, {}, -2
            for x in range(bisect_left(at, a0), bisect_left(at, a1)):
                p, js = hits[x]
                if p != last + 1:
                    before = {}
                now, last = {}, p
                for q in js:
                    if q < b0:
                        continue
                    if q >= b1:
                        break
                    k = now[q] = before.get(q - 1, 0) + 1
                    if k > size:
                        i, j, size = p - k + 1, q - k + 1, k
                before = now
            while i > a0 and j > b0 and a[i - 1] == b[j - 1]:
                i, j, size = i - 1, j - 1, size + 1
            while i + size < a1 and j + size < b1 and a[i + size] == b[j + size]:
                size += 1
            if size:
                total += size
                if a0 < i and b0 < j:
                    left.append((a0, i, b0, j))
                if i + size < a1 and j + size < b1:
                    left.append((i + size, a1, j + size, b1))
        return total


@F.pandas_udf(T.DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """M3: Ratcliff and Obershelp's ratio, for which Spark has no function."""
    return pd.Series([Ratio()(x or "", y or "") for x, y in zip(a, b)])


def cosine(a: Column, b: Column) -> Column:
    """M5, in double precision; null if a vector is zero or lengths differ."""
    x, y = a.cast("array<double>"), b.cast("array<double>")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda u, v: u * v), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(x, x)) * F.sqrt(dot(y, y))
    return F.when((norm > 0) & (F.size(a) == F.size(b)), dot(x, y) / norm)


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """M8: label and its mean vector, by component: partial sums, not vectors, are shuffled."""
    parts = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    rows = parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v"))
    return rows.select(label, F.transform("v", lambda p: p["x"]).alias("centroid"))


def centroid_margin(df: DataFrame, key: str, label: str, vector: str) -> DataFrame:
    """M8: best label, its cosine, and the margin over the second best. Centroids are one row a label."""
    means = centroids(df.where(F.col(label).isNotNull()), label, vector).select(F.col(label).alias("candidate"), "centroid")
    held = means.agg(F.array_sort(F.collect_list(F.struct("candidate", "centroid"))).alias("all"))
    scored = df.join(F.broadcast(held)).select(
        key,
        label,
        F.array_sort(
            F.transform("all", lambda m: F.struct((-cosine(F.col(vector), m["centroid"])).alias("minus"), m["candidate"].alias("candidate")))
        ).alias("s"),
    )
    return scored.select(
        key, label, F.get("s", F.lit(0))["candidate"].alias("best"), (-F.get("s", F.lit(0))["minus"]).alias("score"),
        (F.get("s", F.lit(1))["minus"] - F.get("s", F.lit(0))["minus"]).alias("margin"),
    )


def gain_summary(df: DataFrame, before: Column, after: Column, *keys: str, tolerance: float = 1e-6) -> DataFrame:
    """Mean gain and how many improved, stayed and regressed, by group."""
    gain = after - before
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.avg(gain).alias("mean_gain"),
        F.count_if(gain > tolerance).alias("improved"),
        F.count_if(F.abs(gain) <= tolerance).alias("same"),
        F.count_if(gain < -tolerance).alias("regressed"),
    )


def composite_fidelity(semantic: Column, answer: Column, teacher: Column, concept: Column) -> Column:
    """M7: struct (semantic, lexical, required, contradiction, score) of an answer against its teacher; the score is the
    mean of the three shares. semantic is the cosine (M5) of the two texts' vectors, computed before."""
    lexical, required = coverage(answer, teacher), grammar.required_coverage(answer, teacher, concept)
    parts = F.struct(semantic.alias("s"), lexical.alias("l"), required.alias("r"), grammar.polarity_differs(answer, teacher).alias("c"))
    mean = lambda p: (p["s"] + p["l"] + p["r"]) / 3
    return let(parts, lambda p: F.struct(p["s"].alias("semantic"), p["l"].alias("lexical"), p["r"].alias("required"), p["c"].alias("contradiction"), mean(p).alias("score")))


def fidelity_failures(semantic: Column, lexical: Column, required: Column, contradiction: Column, limits: tuple[float, float, float]) -> Column:
    """What fails, joined; `composite teacher fidelity passed` if nothing does."""
    show = text.three_places
    low = lambda name, x, limit: F.when(x < limit, F.concat(F.lit(name + " "), show(x), F.lit(f" < {limit:.3f}")))
    fails = F.array_compact(
        F.array(
            low("semantic", semantic, limits[0]),
            low("lexical", lexical, limits[1]),
            low("required", required, limits[2]),
            F.when(contradiction, "contradiction detected"),
        )
    )
    listed = F.concat(F.lit("composite teacher fidelity: "), F.array_join(fails, "; "))
    return F.when(F.size(fails) > 0, listed).otherwise("composite teacher fidelity passed")


def gate_reason(malformed: Column, min_conf: Column, margin: Column, mean_conf: Column, lexical: Column, semantic: Column, limits: dict[str, float], rescue: bool) -> Column:
    """The first failing check of an answer, or why it is accepted."""
    return (
        F.when(malformed, "malformed/repetitive output")
        .when(min_conf < limits["token"], "low local token confidence")
        .when(margin < limits["margin"], "low generation margin")
        .when(mean_conf < limits["confidence"], "low token confidence")
        .when(lexical >= limits["agreement"], "accepted")
        .when(F.lit(rescue) & (semantic >= limits["semantic"]), "semantic probe agreement")
        .otherwise("low response agreement")
    )


def rates(df: DataFrame, truth: Column, prediction: Column) -> DataFrame:
    """Counts, recall of either class and balanced accuracy."""
    hit = F.count_if(truth & prediction) / F.count_if(truth)
    miss = F.count_if(~truth & ~prediction) / F.count_if(~truth)
    return df.agg(F.count("*").alias("n"), hit.alias("accepted_known"), miss.alias("rejected_unknown"), ((hit + miss) / 2).alias("balanced_accuracy"))
