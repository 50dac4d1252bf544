"""3: embedding near duplicates. Euclidean p-stable hashing puts normalised vectors into buckets of several tables;
exact cosines within buckets decide.

A table's key joins the label and PROJECTIONS random projections, each quantised to WIDTH. Vectors of cosine 0.98 are 0.2
apart and agree in one projection with a chance of 0.92, in a table with 0.22, in at least one of 60 tables with all but
3e-7. Unrelated vectors agree in one projection with 0.49, in a table with 2e-6. Keys travel alone; vectors go only where
a bucket has company.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, materialize
from .components import components

TABLES = 60
PROJECTIONS = 18
WIDTH = 2.0
COSINE = 0.98
#: Members of a bucket that are compared with each other in one block; larger buckets take a block for each pair of parts.
BLOCK = 512


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By dimension: the rows of vectors that are neither null, empty nor zero and have only finite components, and the
    vectors as doubles."""
    column = column.cast(pa.large_list(pa.float64()))
    ends = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)  # null components become not a number
    size = np.diff(ends) * np.asarray(column.is_valid())
    found = {}
    for dim in np.unique(size[size > 0]).tolist():
        rows = np.flatnonzero(size == dim)
        x = flat[ends[rows][:, None] + np.arange(dim)[None, :]]
        good = np.isfinite(x).all(axis=1) & x.any(axis=1)
        found[dim] = rows[good], x[good] + 0.0
    return found


def _units(x: np.ndarray) -> np.ndarray:
    """Unit vectors; scaled first, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _planes(dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rng = np.random.default_rng([dim, 20240])
    n = TABLES * PROJECTIONS
    return rng.standard_normal((dim, n)), rng.random(n) * WIDTH, rng.integers(1, 2**62, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def bucket_keys(x: np.ndarray, planes) -> np.ndarray:
    """One key for each row of unit vectors and table."""
    a, shift, odd = planes
    cells = np.floor((x @ a + shift) / WIDTH).astype(np.int64).view(np.uint64)
    mixed = (cells * odd).reshape(len(x), TABLES, PROJECTIONS)
    mixed = mixed ^ (mixed >> np.uint64(31))
    keys = (mixed * np.uint64(0x9E3779B97F4A7C15)).sum(axis=2, dtype=np.uint64)
    return (keys ^ (keys >> np.uint64(29))).view(np.int64)


def _signed(df: DataFrame, id_col: str, vector_col: str, label_col: str) -> DataFrame:
    """id and digest (of label and vector) of every row; null where it links with nothing."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v"), F.col(label_col).cast("string").alias("label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[bytes | None] = [None] * b.num_rows
            ids, labels = b.column(0).is_valid().to_pylist(), b.column(2).to_pylist()
            for at, x in _vectors(b.column(1)).values():
                for i, v in zip(at.tolist(), x):
                    if ids[i] and labels[i] is not None:
                        out[i] = xxhash.xxh128_digest(labels[i].encode() + b"\0" + v.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(out, pa.binary())], ["id", "v", "label", "digest"])

    f = {x.name: x.dataType.simpleString() for x in rows.schema}
    return rows.mapInArrow(lean(run), f"id {f['id']}, v {f['v']}, label string, digest binary")


def _keyed(reps: DataFrame) -> DataFrame:
    """rep, mult, unit (vector of doubles as bytes), keys (one for each table; labels and dimensions have their own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, tuple] = {}
        for b in batches:
            units: list[bytes] = [b""] * b.num_rows
            own = np.fromiter((xxhash.xxh64_intdigest(x) for x in b.column(2).to_pylist()), np.uint64, b.num_rows)
            keys = np.zeros((b.num_rows, TABLES), np.int64)
            for dim, (at, x) in _vectors(b.column(3)).items():
                planes.setdefault(dim, _planes(dim))
                x = _units(x)
                keys[at] = bucket_keys(x, planes[dim])
                for i, v in zip(at.tolist(), x):
                    units[i] = v.tobytes()
                own[at] += np.uint64(dim)
            table = np.arange(1, TABLES + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
            keys = (keys.view(np.uint64) ^ (own[:, None] * np.uint64(0x9E3779B97F4A7C15) + table[None, :])) * np.uint64(0xBF58476D1CE4E5B9)
            keys = (keys ^ (keys >> np.uint64(31))).view(np.int64)
            ends = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * TABLES)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(units, pa.binary()), pa.ListArray.from_arrays(ends, pa.array(keys.ravel()))],
                ["rep", "mult", "unit", "keys"],
            )

    kind = reps.schema["rep"].dataType.simpleString()
    return reps.select("rep", "mult", "label", "v").mapInArrow(lean(run), f"rep {kind}, mult long, unit binary, keys array<long>")


def _compare(ids: list, mult: np.ndarray, unit: np.ndarray, keys: np.ndarray, t: int, part: np.ndarray, cross: bool, cosine: float):
    """Rows (id, links, root) of one block: pairs within one part, or across two. A pair that shares a bucket of an
    earlier table was counted there."""
    n = len(ids)
    close = unit @ unit.T >= cosine - 1e-9
    close &= np.tri(n, n, -1, dtype=bool)
    if cross:
        close &= part[:, None] != part[None, :]
    i, j = np.nonzero(close)
    keep = np.einsum("ij,ij->i", unit[i], unit[j]) >= cosine
    if t:
        keep &= ~(keys[i, :t] == keys[j, :t]).any(axis=1)
    i, j = i[keep], j[keep]
    links = np.zeros(n, np.int64)
    np.add.at(links, i, mult[j])
    np.add.at(links, j, mult[i])
    root = np.arange(n)
    while True:  # least member over links, to a fixed point
        before = root.copy()
        np.minimum.at(root, i, before[j])
        np.minimum.at(root, j, before[i])
        root = root[root]
        if (root == before).all():
            break
    for k in np.flatnonzero(links).tolist():
        yield ids[k], int(links[k]), ids[int(root[k])]


def _block_links(rows: DataFrame, cosine: float) -> DataFrame:
    """(id, links, root) from rows (t, key, i, j, rep, mult, unit, keys, part), dealt and sorted by block."""
    kind = rows.schema["rep"].dataType.simpleString()
    block = ["t", "key", "i", "j"]
    rows = rows.select(*block, "rep", "mult", "unit", "keys", "part").repartition(*block).sortWithinPartitions(*block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: pa.Table | None = None

        def solve(table: pa.Table, last: bool):
            names = list(zip(*[table.column(c).to_pylist() for c in block]))
            starts = [k for k in range(len(names)) if k == 0 or names[k] != names[k - 1]] + [len(names)]
            whole = starts if last else starts[:-1]
            out = []
            ids, parts = table.column("rep").to_pylist(), np.array(table.column("part").to_pylist())
            mult = np.array(table.column("mult").to_pylist(), np.int64)
            units, keys = table.column("unit").to_pylist(), table.column("keys").to_pylist()
            for a, b in zip(whole[:-1], whole[1:]):
                if b - a > 1:
                    t, _, i, j = names[a]
                    unit = np.stack([np.frombuffer(u, np.float64) for u in units[a:b]])
                    out += _compare(ids[a:b], mult[a:b], unit, np.array(keys[a:b]), t, parts[a:b], i != j, cosine)
            return out, table.slice(whole[-1])

        id_type = None
        for b in batches:
            id_type = b.schema.field("rep").type
            table = pa.Table.from_batches([b]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([b])])
            out, kept = solve(table, False)
            yield _links_batch(out, id_type)
        if kept is not None and len(kept):
            yield _links_batch(solve(kept, True)[0], id_type)

    return rows.mapInArrow(lean(run), f"id {kind}, links long, root {kind}")


def _links_batch(rows: list[tuple], id_type: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[0] for r in rows], id_type), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], id_type)],
        ["id", "links", "root"],
    )


def embedding_duplicates(
    df: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """id, n_links, component_id and kept of every row.

    Links join rows of equal, non-null labels and equal dimension whose cosine in double precision is at least `cosine`.
    Vectors that are null, empty, zero or hold null or non-finite components, and rows with a null id or label, have no
    links and are their own component (a null id: null, kept). Equal vectors count as links of each other and are
    compared with others once. Ids are taken as distinct rows' names: rows that repeat an id count as links. Other
    columns are not read; an empty table gives no rows.
    """
    bound_batches(df.sparkSession)
    signed = _signed(df, id_col, vector_col, label_col)
    reps = (
        signed.where("digest is not null")
        .groupBy("digest")
        .agg(F.min("id").alias("rep"), F.count("*").alias("mult"), F.first("label").alias("label"), F.first("v").alias("v"))
    )
    reps = materialize(reps, "distinct-vectors")
    keyed = materialize(_keyed(reps), "vector-keys")
    entries = keyed.select("rep", F.posexplode("keys").alias("t", "key"))
    sizes = entries.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    held = entries.join(sizes, "key")
    parts = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    held = held.withColumn("part", F.pmod(F.xxhash64("rep"), parts).cast("int"))
    pairs = F.transform(
        F.sequence(F.lit(0), parts - 1), lambda o: F.struct(F.least("part", o).alias("i"), F.greatest("part", o).alias("j"))
    )
    held = held.withColumn("p", F.explode(pairs)).select("t", "key", "p.i", "p.j", "rep", "part")
    rows = held.join(keyed.select("rep", "mult", "unit", "keys"), "rep")
    links = materialize(_block_links(rows, cosine), "vector-links")
    counted = links.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(links.where("id <> root"), "id", "root")
    classes = (
        reps.select("digest", "rep", "mult")
        .join(counted.withColumnRenamed("id", "rep"), "rep", "left")
        .join(roots.withColumnRenamed("node", "rep"), "rep", "left")
        .select("digest", (F.coalesce("links", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("root", "rep").alias("component_id"))
    )
    out = signed.select("id", "digest").join(classes, "digest", "left")
    component = F.coalesce("component_id", "id")
    return out.select(
        F.col("id").alias(id_col),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"),
    )
