"""Work on ordered keys whose rows need not fit a task: rows are dealt by ranges of (key, order), so that a hot key spans
many of them; what the ranges find is put together from one small row a key and range."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import materialize, partitions, ship


def dealt(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with `_range`, the number of its range of `order`; written, since the ranges come from a sample and everything
    that reads them must see the same ones."""
    return materialize(df.repartitionByRange(partitions(df.sparkSession), *order).withColumn("_range", F.spark_partition_id()), "ranges")


def positions(df: DataFrame, keys: list[str], order: list[str | Column], name: str = "position") -> DataFrame:
    """df with the exact position (long, from 1) of each row among its key's rows in order; no keys: among all rows.

    Two levels: counts of each key and range give where a range begins, a window over one key in one range the rest. Rows
    with equal orders are numbered in some order; null keys are a key.
    """
    ranged = dealt(df, *keys, *order)
    counts = ranged.groupBy("_range", *keys).agg(F.count("*").alias("_n"))  # a row a key and range
    before = F.sum("_n").over(Window.partitionBy(*keys).orderBy("_range")) - F.col("_n")
    starts = counts.select(F.col("_range").alias("_r"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], before.alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    local = F.row_number().over(Window.partitionBy("_range", *keys).orderBy(*order))
    return ranged.withColumn("_local", local).join(starts, same).withColumn(name, F.col("_before") + F.col("_local")).select(*df.columns, name)


def compose(first: tuple[np.ndarray, np.ndarray], then: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two maps, state -> (state, changes), one after the other; arrays of any leading shape, states along the last axis."""
    at = first[0]
    return np.take_along_axis(then[0], at, axis=-1), first[1] + np.take_along_axis(then[1], at, axis=-1)


def composed_runs(run: np.ndarray, step: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The map of each run of ordered steps. run: number of each step's run, ascending from 0; moves: step x state -> state.

    Neighbours of a run are composed in pairs, so the passes are as many as the longest run has binary digits.
    """
    state, change = moves[step], (moves[step] != np.arange(moves.shape[1])).astype(np.int64)
    while len(run) and len(np.unique(run)) < len(run):
        start = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        place = np.arange(len(run)) - np.repeat(start, np.diff(np.append(start, len(run))))
        head = np.flatnonzero(place % 2 == 0)
        paired = np.isin(head + 1, np.flatnonzero(place % 2 == 1))
        a, b = head[paired], head[paired] + 1
        joint = compose((state[a], change[a]), (state[b], change[b]))
        keep_state, keep_change = state[head], change[head]
        keep_state[paired], keep_change[paired] = joint
        run, state, change = run[head], keep_state, keep_change
    return state, change


def folded(events: DataFrame, key: str, action: str, moves: dict[tuple[str, str], str], start: str, order: str) -> DataFrame:
    """key, status (string) and n_changes (long) of every key after its ordered actions.

    moves maps (state, action) to the next state; other actions change nothing. Every range composes its part of a log into
    one map of all states, and a key's maps, one a range, are applied in order. Equal orders are taken by action.
    """
    ship(events.sparkSession)
    states = sorted({start, *(s for s, _ in moves), *moves.values()})
    actions = sorted({a for _, a in moves})
    place = {s: i for i, s in enumerate(states)}
    table = np.tile(np.arange(len(states)), (len(actions) + 1, 1))  # the last row: an action that moves nothing
    for (s, a), to in moves.items():
        table[actions.index(a), place[s]] = place[to]
    number = F.create_map(*[F.lit(x) for i, a in enumerate(actions) for x in (a, i)]) if actions else F.create_map().cast("map<string,int>")
    rows = events.select(F.col(key).alias("key"), F.col(order).alias("_order"), F.col(action).alias("_action"))
    rows = rows.withColumn("_step", F.coalesce(number[F.col("_action")], F.lit(len(actions))))
    ranged = rows.repartitionByRange(partitions(events.sparkSession), "key", "_order", "_action").sortWithinPartitions("key", "_order", "_action")
    ranged = ranged.select("key", F.spark_partition_id().alias("part"), "_step")
    kind = ranged.schema["key"].dataType.simpleString()

    def out(keys: pa.Array, part: int, state: np.ndarray, change: np.ndarray) -> pa.RecordBatch:
        lists = lambda x, t: pa.array(x.tolist(), pa.list_(t))
        return pa.RecordBatch.from_arrays([keys, pa.array([part] * len(keys), pa.int32()), lists(state, pa.int32()), lists(change, pa.int64())], ["key", "part", "state", "change"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # the last key of a batch may go on in the next one
        part = 0
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(1)[0].as_py()
            coded = b.column(0).dictionary_encode()
            codes = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)
            number = np.cumsum(np.concatenate([[0], codes[1:] != codes[:-1]]))
            state, change = composed_runs(number, b.column(2).to_numpy(zero_copy_only=False), table)
            keys = b.column(0).take(pa.array(np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))))
            if held is not None:
                if held[0][0].as_py() == keys[0].as_py():
                    state[0], change[0] = compose((held[1][0], held[2][0]), (state[0], change[0]))
                else:
                    yield out(held[0], part, held[1], held[2])
            yield out(keys[:-1], part, state[:-1], change[:-1])
            held = keys[-1:], state[-1:], change[-1:]
        if held is not None:
            yield out(held[0], part, held[1], held[2])

    maps = ranged.mapInArrow(run, f"key {kind}, part int, state array<int>, change array<long>")
    lists = maps.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("part", "state", "change"))).alias("maps"))  # one a range
    first = F.struct(F.lit(place[start]).alias("at"), F.lit(0).cast("long").alias("n"))
    turn = lambda s, m: F.struct(m["state"][s["at"]].alias("at"), (s["n"] + m["change"][s["at"]]).alias("n"))
    ends = lists.select("key", F.aggregate("maps", first, turn).alias("s"))
    names = F.array(*[F.lit(s) for s in states])
    return ends.select(F.col("key").alias(key), names[F.col("s.at")].alias("status"), F.col("s.n").alias("n_changes"))


# --- the forest of prefixes


def _shared(a: str, b: str) -> int:
    """Length of the common prefix."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        half = (low + high + 1) // 2
        if a[:half] == b[:half]:
            low = half
        else:
            high = half - 1
    return low


def _subtree_least(heads: list[str], ranks: list, beyond: tuple[str, list[tuple[int, object]]] | tuple[()] = ()) -> list:
    """Least rank among the heads that begin with each head. heads: sorted and distinct; beyond: the head that follows them,
    and of the rows from there on (length, rank): what prefix they share with it, and their ranks."""
    least, stack = list(ranks), []

    def close(i: int) -> None:
        if stack and least[i] < least[stack[-1]]:
            least[stack[-1]] = least[i]

    for i, h in enumerate(heads):
        while stack and not h.startswith(heads[stack[-1]]):
            close(stack.pop())
        stack.append(i)
    if beyond:
        follows, steps = beyond
        while stack and not follows.startswith(heads[stack[-1]]):
            close(stack.pop())
        for i in stack:
            for length, rank in steps:
                if length >= len(heads[i]) and rank < least[i]:
                    least[i] = rank
    while stack:
        close(stack.pop())
    return least


def antichain(nodes: DataFrame, head: str, rank: str) -> DataFrame:
    """The nodes that antichain_ranks names."""
    return nodes.join(antichain_ranks(nodes, head, rank), rank).select(*nodes.columns)


def antichain_ranks(nodes: DataFrame, head: str, rank: str) -> DataFrame:
    """The ranks of the nodes that a greedy pass in the order of `rank` keeps, if it keeps a node unless a kept one's head begins with
    its own or its own with theirs. head: distinct strings; rank: distinct values that can be compared (a struct: as a
    tuple).

    The heads are a forest by prefix. A node with a lesser rank below it is never kept: whatever rejects that lesser node is
    above or below it, so it rejects the upper one too. Of the others, the roots of their subtrees' least ranks, the topmost
    are kept. Both need only a sweep over sorted heads: ranges are swept alone, and what crosses a border is a chain of
    prefixes of the next range's first head, found from one small row a range.
    """
    spark = nodes.sparkSession
    ship(spark)
    rows = dealt(nodes.select(F.col(head).alias("head"), F.col(rank).alias("rank")), "head")
    kind = rows.schema["rank"].dataType.simpleString()
    plain = lambda r: tuple(map(plain, r.values())) if isinstance(r, dict) else r

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[str], list]]:
        now, heads, ranks = None, [], []
        for b in batches:
            for part, h, r in zip(*[c.to_pylist() for c in b.columns]):
                if part != now:
                    if heads:
                        yield now, heads, ranks
                    now, heads, ranks = part, [], []
                heads.append(h)
                ranks.append(r)
        if heads:
            yield now, heads, ranks

    by_range = rows.select("_range", "head", "rank").repartition("_range").sortWithinPartitions("_range", "head")

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, heads, ranks in ranges(batches):
            steps, length = [], len(heads[0])
            for h, r in zip(heads, ranks):
                length = min(length, _shared(heads[0], h))
                if not length:
                    break
                if steps and steps[-1][0] == length:
                    steps[-1] = length, min(steps[-1][1], r, key=plain)
                elif not steps or plain(r) < plain(steps[-1][1]):
                    steps.append((length, r))
            lengths, values = zip(*steps) if steps else ((), ())
            arrays = [[part], [heads[0]], [list(lengths)], [list(values)]]
            types = [pa.int32(), pa.string(), pa.list_(pa.int32()), pa.list_(rank_type)]
            yield pa.RecordBatch.from_arrays([pa.array(a, t) for a, t in zip(arrays, types)], ["part", "first", "lengths", "ranks"])

    rank_type = to_arrow_type(rows.schema["rank"].dataType)
    found = by_range.mapInArrow(summary, f"part int, first string, lengths array<int>, ranks array<{kind}>").collect()  # a row a range
    found.sort(key=lambda r: r["part"])
    value = lambda r: tuple(map(value, r)) if isinstance(r, tuple) else r
    beyond: dict[int, tuple] = {}
    carried: list[tuple[int, object]] = []  # of the rows behind range i, by the prefix they share with its first head
    for i in range(len(found) - 1, 0, -1):
        own = [(n, value(r)) for n, r in zip(found[i]["lengths"], found[i]["ranks"])]
        steps = own + carried
        part = found[i - 1]["part"]
        beyond[part] = found[i]["first"], steps
        shared = _shared(found[i - 1]["first"], found[i]["first"])
        best: dict[int, object] = {}
        for n, r in steps:
            n = min(n, shared)
            if n and (n not in best or r < best[n]):
                best[n] = r
        carried = list(best.items())

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, heads, ranks in ranges(batches):
            order = [plain(r) for r in ranks]
            least = _subtree_least(heads, order, beyond.get(part, ()))
            out, stack = [], []
            for h, own, r, m in zip(heads, ranks, order, least):
                while stack and not h.startswith(stack[-1]):
                    stack.pop()
                if r == m:
                    if not stack:
                        goes_on = part in beyond and beyond[part][0].startswith(h)
                        out.append((own, _shared(heads[0], h), h if goes_on else None))
                    stack.append(h)
            columns = list(zip(*out)) if out else [(), (), ()]
            arrays = [pa.array([part] * len(out), pa.int32()), pa.array(columns[0], rank_type), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, ["part", "rank", "shared", "head"])

    tops = materialize(by_range.mapInArrow(sweep, f"part int, rank {kind}, shared int, head string"), "tops")  # a head where it is open
    opened = {r["part"]: r["head"] for r in tops.where("head is not null").groupBy("part").agg(F.min("head").alias("head")).collect()}  # a row a range
    above, chain = [], None  # the topmost open head that is a prefix of each range's first one
    for r in found:
        chain = chain if chain is not None and r["first"].startswith(chain) else opened.get(above[-1][0]) if above else None
        above.append((r["part"], None if chain is None else len(chain)))
    cover = F.broadcast(spark.createDataFrame(above, "part int, covered int"))
    return tops.join(cover, "part").where("covered is null or shared < covered").select(F.col("rank").alias(rank))
