"""11: centroid clustering by Exponion search: exact rounds of Lloyd's algorithm over integer points.

Every point keeps its centroid, an upper bound of the distance to it and a lower bound of the distance to all others. Where
the bounds, moved by what the centroids moved, leave doubt, only the centroids within 2 u + s of the point's own centroid
are scanned (u: the distance to it, s: from it to the next centroid): they hold the nearest and the second nearest. They
are a prefix of the own centroid's list of the others sorted by distance. Squared distances are exact integers; bounds are
rounded outwards, and both the test and the ball include equality, so that ties go to the smaller number.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget, lean, materialize

K = 16
ROUNDS = 3
SCALE = 64
DIM = 64
SEED = "1:"
#: Relative slack of the bounds, far above the rounding of a few operations.
_SLACK = 1e-12
#: Distances computed at once.
_BLOCK = 1 << 18


def _points(column: pa.Array, dim: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    """Rows of vectors with exactly dim components, all finite, and floor(scale * x) of them."""
    column = column.cast(pa.large_list(pa.float64()))
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)  # null components become not a number
    rows = np.flatnonzero(np.asarray(column.is_valid()) & (np.diff(ends) == dim))
    x = flat[ends[rows][:, None] + np.arange(dim)[None, :]]
    good = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        x = np.floor(scale * x[good])
    if len(x) and np.abs(x).max() > largest(dim):
        raise ValueError(f"scaled components beyond {largest(dim)}: a squared distance would not fit a long")
    return rows[good], x.astype(np.int64)


def largest(dim: int) -> int:
    """The largest component for which squared distances stay below 2 ** 62."""
    return min(int((2**62 / dim) ** 0.5 / 2), 2**31 - 1)


def squared(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of rows of x and c. In doubles where no sum can reach 2 ** 53, else in integers."""
    top = max([0, *(int(np.abs(v).max()) for v in (x, c) if v.size)])
    if 4 * x.shape[1] * top * top < 2**53:
        x, c = x.astype(np.float64), c.astype(np.float64)
        return ((x * x).sum(axis=1)[:, None] - 2 * (x @ c.T) + (c * c).sum(axis=1)[None, :]).astype(np.int64)
    out = np.empty((len(x), len(c)), np.int64)
    for j, v in enumerate(c):
        out[:, j] = ((x - v) ** 2).sum(axis=1)
    return out


def _two_least(d: np.ndarray, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each row of distances to the centroids `numbers`: the nearest (ties: smaller number), its distance, and the next
    distance (as a double, infinite if there is none)."""
    order = np.argsort(numbers, kind="stable")
    d, numbers = d[:, order], numbers[order]
    at = d.argmin(axis=1)  # the first of equals
    rows = np.arange(len(d))
    near = d[rows, at]
    rest = d.astype(np.float64)
    rest[rows, at] = np.inf
    return numbers[at], near, rest.min(axis=1)


class Exponion:
    """What a round needs of its centroids; `before` are those that the bounds were made for (None: no bounds yet)."""

    def __init__(self, centroids: np.ndarray, before: np.ndarray | None = None):
        self.centroids, k = centroids, len(centroids)
        self.moved = None if before is None else np.sqrt(((centroids - before).astype(np.float64) ** 2).sum(axis=1)) * (1 + _SLACK)
        between = np.sqrt(squared(centroids, centroids).astype(np.float64))
        np.fill_diagonal(between, -1)  # a centroid comes first in its own list
        self.lists = np.argsort(between, axis=1, kind="stable")
        self.sorted = np.take_along_axis(between, self.lists, axis=1)
        self.next = self.sorted[:, 1] if k > 1 else np.full(k, np.inf)
        self.scanned = 0

    def _first(self, x: np.ndarray):
        own, near, second = np.empty(len(x), np.int32), np.empty(len(x), np.int64), np.empty(len(x))
        numbers = np.arange(len(self.centroids))
        step = max(1, _BLOCK // len(numbers))
        for i in range(0, len(x), step):
            own[i : i + step], near[i : i + step], second[i : i + step] = _two_least(squared(x[i : i + step], self.centroids), numbers)
        self.scanned += len(x) * len(numbers)
        return own, np.sqrt(near) * (1 + _SLACK), np.sqrt(second) * (1 - _SLACK)

    def _own(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        out = np.empty(len(x), np.int64)
        for i in range(0, len(x), step := max(1, _BLOCK // x.shape[1])):
            out[i : i + step] = ((x[i : i + step] - self.centroids[own[i : i + step]]) ** 2).sum(axis=1)
        return out

    def assign(self, x: np.ndarray, own: np.ndarray | None = None, upper: np.ndarray | None = None, lower: np.ndarray | None = None):
        """Centroid, upper and lower bound of every point."""
        if self.moved is None or own is None:
            return self._first(x)
        own, upper, lower = own.copy(), upper.copy(), lower.copy()
        if len(self.centroids) == 1:
            return own, upper + self.moved[own], lower
        order = np.argsort(self.moved)
        others = np.where(own == order[-1], self.moved[order[-2]], self.moved[order[-1]])
        upper = (upper + self.moved[own]) * (1 + _SLACK)
        lower = lower - others - _SLACK * (lower + others)
        safe = np.maximum(lower, self.next[own] / 2 * (1 - _SLACK))
        open_ = np.flatnonzero(upper >= safe)
        upper[open_] = np.sqrt(self._own(x[open_], own[open_])) * (1 + _SLACK)
        self.scanned += len(open_)
        open_ = open_[upper[open_] >= safe[open_]]
        radius = (2 * upper[open_] + self.next[own[open_]]) * (1 + _SLACK)
        for a in np.unique(own[open_]).tolist():
            mine = own[open_] == a
            rows = open_[mine]
            held = np.searchsorted(self.sorted[a], radius[mine], side="right")
            width = np.minimum(1 << np.ceil(np.log2(np.maximum(held, 2))).astype(int), len(self.centroids))
            for m in np.unique(width).tolist():
                part, numbers = rows[width == m], self.lists[a, :m]
                for i in range(0, len(part), step := max(1, _BLOCK // m)):
                    some = part[i : i + step]
                    own[some], near, second = _two_least(squared(x[some], self.centroids[numbers]), numbers)
                    upper[some], lower[some] = np.sqrt(near) * (1 + _SLACK), np.sqrt(second) * (1 - _SLACK)
                self.scanned += len(part) * m
        return own, upper, lower

    def distance(self, x: np.ndarray, own: np.ndarray) -> np.ndarray:
        return self._own(x, own)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    if not len(column):
        return np.empty((0, dim), np.int64)
    return np.frombuffer(b"".join(column.to_pylist()), "<i4").reshape(len(column), dim).astype(np.int64)


def integer_points(df: DataFrame, dim: int, scale: float, id_col: str, vector_col: str) -> DataFrame:
    """id and point (dim little-endian 32-bit integers) of the vectors that are kept."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _points(b.column(1), dim, scale)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), pa.array([v.tobytes() for v in x.astype("<i4")], pa.binary())], ["id", "point"])

    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, point binary")


def _assigned(state: DataFrame, centroids: np.ndarray, before: np.ndarray | None, dim: int, last: bool) -> DataFrame:
    """id, point, cluster, upper, lower of the next round; in the last one id, cluster and distance."""
    kind = state.schema["id"].dataType.simpleString()
    names = ["id", "cluster", "distance"] if last else ["id", "point", "cluster", "upper", "lower"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = Exponion(centroids, before)
        for b in batches:
            x = _matrix(b.column(1), dim)
            bounds = [b.column(i).to_numpy(zero_copy_only=False) for i in range(2, b.num_columns)]
            own, upper, lower = search.assign(x, *bounds)
            cluster = pa.array(own, pa.int32())
            if last:
                yield pa.RecordBatch.from_arrays([b.column(0), cluster, pa.array(search.distance(x, own))], names)
            else:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), cluster, pa.array(upper), pa.array(lower)], names)

    schema = f"id {kind}, cluster int, distance long" if last else f"id {kind}, point binary, cluster int, upper double, lower double"
    return state.mapInArrow(lean(run), schema)


def _moved(state: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The componentwise floors of the clusters' means; each task returns the sums of its points, a row a cluster and place."""
    k, dim = centroids.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros((k, dim), np.int64), np.zeros(k, np.int64)
        for b in batches:
            x, own = _matrix(b.column(1), dim), b.column(0).to_numpy(zero_copy_only=False)
            for a in np.unique(own).tolist():
                sums[a] += x[own == a].sum(axis=0)
            counts += np.bincount(own, minlength=k)
        full = np.flatnonzero(counts)
        arrays = [np.repeat(full, dim), np.tile(np.arange(dim), len(full)), sums[full].ravel(), np.repeat(counts[full], dim)]
        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in arrays], ["cluster", "place", "total", "n"])

    parts = state.select("cluster", "point").mapInArrow(lean(run), "cluster long, place long, total long, n long")
    whole = F.sum(F.col("total").cast("decimal(38,0)"))
    found = parts.groupBy("cluster", "place").agg(whole.alias("total"), F.sum("n").alias("n"))
    out = centroids.copy()
    for r in found.collect():  # k * dim rows
        out[r["cluster"], r["place"]] = int(r["total"]) // r["n"]
    return out


def centroid_clusters(
    df: DataFrame,
    k: int = K,
    rounds: int = ROUNDS,
    dim: int = DIM,
    scale: float = SCALE,
    seed: str = SEED,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """id, cluster, distance (squared), cluster_inertia, inertia and centroid (array of long) of every kept vector.

    Kept are vectors of exactly dim components, none null or not finite; each becomes the integers floor(scale * x).
    Centroids start as the k kept vectors with the least sha256 of seed + id, of rows that repeat an id by their points;
    null ids never start one but are clustered. Fewer kept vectors give fewer centroids; an empty table gives no rows. In
    each round every vector goes to the nearest centroid (ties: the smaller number), and each non-empty centroid to the
    floors of its vectors' means. Repeated rows count each. Other columns are not read. Integers too large for exact
    distances in a long raise an error (components beyond 2 ** 21 for 64 of them and a scale of 64). k * k doubles are
    made in every task: k is meant to be at most a few thousand. An inertia beyond a long is null.
    """
    spark = df.sparkSession
    bound_batches(spark)
    state = materialize(integer_points(df, dim, scale, id_col, vector_col), "points")
    rank = F.sha2(F.concat(F.lit(seed), F.col("id").cast("string")), 256)
    first = state.where("id is not null").orderBy(rank, "point").limit(k).select("point").collect()
    centroids = np.array([np.frombuffer(bytes(r["point"]), "<i4") for r in first], np.int64).reshape(len(first), dim)
    if not len(centroids):
        state, rounds = state.where("false"), 0
    before = None
    for _ in range(rounds):
        following = materialize(_assigned(state, centroids, before, dim, False), "assigned-points")
        forget(state)
        state, before = following, centroids
        centroids = _moved(state, centroids)
    last = _assigned(state, centroids, before, dim, True) if len(centroids) else state.selectExpr("id", "cast(null as int) as cluster", "cast(null as long) as distance")
    assigned = materialize(last, "clusters")
    if hasattr(state, "_scratch"):
        forget(state)
    whole = F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")
    totals = {r["cluster"]: int(r["total"]) for r in assigned.groupBy("cluster").agg(whole).collect()}  # k rows
    long = lambda n: n if n < 2**63 else None
    rows = [(i, long(n), long(sum(totals.values())), centroids[i].tolist()) for i, n in totals.items()]
    ends = F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>"))
    return assigned.withColumnRenamed("id", id_col).join(ends, "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid")
