"""Connected components of links, by alternating large and small stars; nothing of them reaches the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, lean, materialize


def _least_members(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """For n nodes the least node of each one's component over links a, b."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(before[a], before[b])
        np.minimum.at(root, before[a], low)
        np.minimum.at(root, before[b], low)
        while (root != root[root]).any():
            root = root[root]
        if (root == before).all():
            return root


def contracted(links: DataFrame) -> DataFrame:
    """Links (u, v) with u > v that join the same nodes: within each batch of a task they become stars."""
    kind = links.schema["u"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.concat_arrays([batch.column(0), batch.column(1)])
            nodes = both.unique()
            nodes = nodes.take(pc.sort_indices(nodes))
            code = pc.index_in(both, nodes).to_numpy(zero_copy_only=False)
            root = _least_members(code[: batch.num_rows], code[batch.num_rows :], len(nodes))
            up = np.flatnonzero(root != np.arange(len(nodes)))
            yield pa.RecordBatch.from_arrays([nodes.take(pa.array(up)), nodes.take(pa.array(root[up]))], ["u", "v"])

    return links.select("u", "v").mapInArrow(lean(run), f"u {kind}, v {kind}")


def _stars(edges: DataFrame) -> bool:
    """Is every node either a root or under one root?"""
    nodes = edges.select(F.col("u").alias("x"), F.lit(1).alias("up")).union(edges.select(F.col("v").alias("x"), F.lit(0).alias("up")))
    seen = nodes.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("least"))
    return not seen.where("ups > 1 or (ups = 1 and least = 0)").limit(1).count()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root) of every node that has a link: root is the least node of its component.

    Self links and repeated links don't matter; no links give no rows. Batches of links are contracted where they lie,
    then rounds of large and small stars follow, each written to the shared folder, until all components are stars. The
    number of rounds grows with the logarithm of a component's size.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v")
    edges = materialize(contracted(edges).distinct(), "edges")
    while not _stars(edges):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        near = (
            large.join(low, "u")
            .select(F.explode(F.array(F.col("v"), F.col("u"))).alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        before, edges = edges, materialize(near, "edges")
        forget(before)
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.union(roots.select(F.col("root").alias("node"), "root").distinct())
