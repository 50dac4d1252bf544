"""What the operators of this subpackage share: table access, written tables in the shared folder, batches by bytes."""

from __future__ import annotations

import contextlib
import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import forget, materialize, scratch, shared_dir, ship  # noqa: F401

#: Bytes of one Arrow batch handed to Python, so that a batch of very long texts stays small: the same for all operators,
#: since the bound is the session's.
BATCH_BYTES = 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession, limit: int = BATCH_BYTES) -> None:
    """Bound Arrow batches by bytes, unless the session bounds them lower already; make the package known to workers."""
    ship(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > limit:
        spark.conf.set(key, str(limit))


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # other C libraries than glibc have no malloc_trim
        ctypes.CDLL(None).malloc_trim(0)


#: What workers keep from task to task, by owner: vocabularies and what they have learned of a corpus.
KEPT: dict[str, dict] = {}


def _drop_others(owner: str) -> None:
    others = [kept for name, kept in KEPT.items() if name != owner and kept]
    for kept in others:
        kept.clear()
    if others:
        gc.collect()
        _give_back()


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], owner: str = "") -> Callable:
    """run for mapInArrow; a worker, which tasks of other operators use too, first drops what it keeps for owners other than
    this one, and when the task is done gives back the memory that Arrow and the C library have kept."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(owner)
        yield from run(batches)
        _give_back()

    return task


def by_bytes(rows: Iterable[tuple], size, limit: int) -> Iterator[list[tuple]]:
    """Group rows into lists of about limit bytes; a longer row is alone in its list."""
    group, total = [], 0
    for row in rows:
        n = size(row)
        if group and total + n > limit:
            yield group
            group, total = [], 0
        group.append(row)
        total += n
    if group:
        yield group


#: Rows of ids (and a label) that may be broadcast, about 16 bytes each.
BROADCAST_ROWS = 2_000_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for a broadcast if a count shows that it has at most so many rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
