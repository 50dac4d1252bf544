"""Ranks, folds and the prefix forest over ranges of ordered keys: against plain versions, with hot keys."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorespark.operators import curate, lifecycle, ranges, resolve, stores


@pytest.fixture
def many(spark):
    """Many ranges, so that keys cross their borders."""
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    yield spark
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_positions(many):
    rng = random.Random(1)
    rows = [("hot" if rng.random() < 0.9 else rng.choice(["a", "b", None]), i, rng.random()) for i in range(3000)]
    df = many.createDataFrame(rows, "k string, i int, x double")
    got = {r.i: r.p for r in ranges.positions(df, ["k"], [F.desc("x"), "i"], "p").collect()}
    for key in {k for k, _, _ in rows}:
        own = sorted((-x, i) for k, i, x in rows if k == key)
        assert [got[i] for _, i in own] == list(range(1, len(own) + 1))
    assert ranges.dealt(df, "k", "x").where("k = 'hot'").select("_range").distinct().count() >= 7
    assert ranges.positions(df.where("false"), ["k"], ["x"]).collect() == []
    ids = [r.row_id for r in stores.numbered(df.limit(1200), ["i"], "r").orderBy("i").collect()]
    assert ids[:2] == ["r-001", "r-002"] and ids[-1] == "r-1200"


def test_balanced_with_one_large_role(many):
    rows = many.range(1000).select(F.when(F.col("id") < 950, "most").when(F.col("id") < 990, "some").otherwise("few").alias("role"), F.col("id").alias("ord"))
    got = curate.balanced(rows, "role", "ord", 30).groupBy("role").count().collect()
    assert {r["role"]: r["count"] for r in got} == {"most": 950, "some": 950, "few": 300}


def plain_fold(log, moves, start):
    status, n = start, 0
    for _, a in log:
        to = moves.get((status, a), status)
        n, status = n + (to != status), to
    return status, n


def test_fold_of_a_hot_key(many):
    rng = random.Random(2)
    actions = ["promote", "verify", "revoke", "noise", None]
    rows = [(rng.choice([7, 7, 7, 7, 7, 7, 7, 7, 1, 2, None]), rng.randrange(10**6), rng.choice(actions)) for _ in range(30_000)]
    df = many.createDataFrame(rows, "k int, ord int, action string")
    many.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "777")
    got = {r.k: (r.status, r.n_changes) for r in lifecycle.fold_states(df, "k", "action", lifecycle.QUEUE_MOVES, "pending").collect()}
    many.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    order = lambda r: (r[1], r[2] is not None, r[2] or "")
    want = {k: plain_fold([(o, a) for _, o, a in sorted((r for r in rows if r[0] == k), key=order)], lifecycle.QUEUE_MOVES, "pending") for k in {r[0] for r in rows}}
    assert got == want and want[7][1] > 4000
    assert lifecycle.fold_states(df.where("false"), "k", "action", lifecycle.QUEUE_MOVES, "pending").collect() == []


def test_maps_compose():
    rng = np.random.default_rng(0)
    moves = rng.integers(0, 4, (5, 4))
    run, step = np.sort(rng.integers(0, 30, 500)), rng.integers(0, 5, 500)
    _, run = np.unique(run, return_inverse=True)
    state, change = ranges.composed_runs(run, step, moves)
    for r in range(run.max() + 1):
        for s in range(4):
            at, n = s, 0
            for x in step[run == r]:
                n, at = n + (moves[x][at] != at), moves[x][at]
            assert (state[r][s], change[r][s]) == (at, n)


def greedy(rows, share=0.8, least=8):
    kept = []
    for key, _, t in sorted(rows, key=lambda r: r[1]):
        for k, o in kept:
            n = min(len(t), len(o))
            common = next((i for i in range(n) if t[i] != o[i]), n)
            if k == key and (t == o or (n >= least and common >= int(np.ceil(n * share)))):
                break
        else:
            kept.append((key, t))
    return sorted(kept)


@pytest.mark.parametrize("seed", range(4))
def test_prefix_dedup_is_the_greedy_pass(many, seed):
    rng = random.Random(seed)
    texts = ["a" * rng.randrange(1, 40) for _ in range(60)]
    texts += ["".join(rng.choice("ab") for _ in range(rng.randrange(4, 24))) for _ in range(500)]
    texts += [t[: rng.randrange(8, 9 + len(t))] + rng.choice(["", "c", "cd"]) for t in texts if len(t) >= 8]
    rows = [(rng.choice(["k", "k", "k", "k1", "日本"]), i, t) for i, t in enumerate(rng.sample(texts, len(texts)))]
    df = many.createDataFrame(rows, "k string, ord int, t string")
    got = curate.greedy_prefix_dedup(df, "k", "ord", "t")
    assert sorted((r.k, r.t) for r in got.collect()) == greedy(rows)
    by_pair = curate.greedy_prefix_dedup(df.withColumn("ord", F.struct(F.col("ord") % 7, "ord")), "k", "ord", "t")
    assert sorted((r.k, r.t) for r in by_pair.collect()) == greedy([(k, (i % 7, i), t) for k, i, t in rows])
    assert curate.greedy_prefix_dedup(df.where("false"), "k", "ord", "t").collect() == []


def test_prefix_dedup_of_one_large_key(many):
    """A key of 100,000 sentences with long common beginnings; the greedy pass here keeps heads in a set."""
    rng = random.Random(9)
    stems = ["同じ書き出しの長い文章であり" + "".join(rng.choice("あいう") for _ in range(6)) for _ in range(300)]
    rows = [("one", i, rng.choice(stems) + "".join(rng.choice("xyz") for _ in range(rng.randrange(0, 12)))) for i in range(100_000)]
    head = lambda t: t[: int(np.ceil(len(t) * 0.8))]
    kept, heads, starts, seen = [], set(), set(), set()
    for _, i, t in rows:
        h = head(t)
        if t in seen or h in starts or any(h[:n] in heads for n in range(1, len(h) + 1)):
            continue
        kept.append(t)
        seen.add(t)
        heads.add(h)
        starts |= {h[:n] for n in range(1, len(h) + 1)}
    got = curate.greedy_prefix_dedup(many.createDataFrame(rows, "k string, ord int, t string"), "k", "ord", "t")
    assert sorted(r.t for r in got.collect()) == sorted(kept)


def test_longest_held(spark):
    rng = random.Random(6)
    names = {"".join(rng.choice("abあ") for _ in range(rng.randrange(1, 9))) for _ in range(200)} | {"x" * 300, ""}
    rows = [(i, "".join(rng.choice("abcあ") for _ in range(rng.randrange(0, 40)))) for i in range(300)] + [(900, "y" + "x" * 301), (901, None), (902, "x" * 299)]
    df, subjects = spark.createDataFrame(rows, "q int, t string"), spark.createDataFrame([(n,) for n in names], "s string")
    want = {i: max(((len(n), n) for n in names if n and t and n in t), default=(0, None))[1] for i, t in rows}
    for most in (10_000, 0):
        got = {r.q: r.s for r in resolve.longest_held(df, "q", "t", subjects, "s", most=most).collect()}
        assert got == {i: n for i, n in want.items() if n}
        assert resolve.longest_held(df, "q", "t", subjects.where("false"), "s", most=most - 1).collect() == []
