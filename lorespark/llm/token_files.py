"""9: token-ID output. ORC stripes with integer run-length encoding, row indexes and Bloom filters on document ids."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, lean
from .token_counts import tokenizer_file
from .word_bpe import word_bpe

STRIPE_BYTES = 32 << 20
#: Of the files. Integers are written in ORC's second run-length encoding. A stripe is a unit of parallel reads.
ORC_OPTIONS = {
    "orc.row.index.stride": "5000",
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
    "compression": "zstd",
}


#: Ids in one batch that goes back to the JVM; a longer text is alone in its batch.
BATCH_IDS = 1 << 20


def _groups(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Stretches of rows of at most BATCH_IDS ids, at least one row each."""
    at, upto = 0, np.cumsum(sizes)
    while at < len(sizes):
        end = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + BATCH_IDS, "right")))
        yield at, end
        at = end


def encode_rows(df: DataFrame, tokenizer: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, shard (its partition), pos (its place there), n_tokens, ids with end_id appended; keeps partitions and order."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = word_bpe(tokenizer_file(tokenizer))
        context = TaskContext.get()
        shard, pos = context.partitionId() if context else 0, 0
        for b in batches:
            found, n = model.encode(b.column(1))
            ends = np.cumsum(n)
            ids = np.insert(found, ends, end_id).view(np.int32)
            for at, upto in _groups(n + 1):
                low, high = (int(ends[at - 1]) + at if at else 0), int(ends[upto - 1]) + upto
                offsets = np.concatenate([[0], np.cumsum(n[at:upto] + 1)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(at, upto - at),
                        pa.array(np.full(upto - at, shard, np.int32)),
                        pa.array(np.arange(pos + at, pos + upto, dtype=np.int64)),
                        pa.array(n[at:upto] + 1),
                        pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids[low:high])),
                    ],
                    ["doc_id", "shard", "pos", "n_tokens", "ids"],
                )
            pos += b.num_rows

    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lean(run, "word_bpe"), f"doc_id {kind}, shard int, pos long, n_tokens long, ids array<int>")


def write_token_files(
    df: DataFrame,
    path: str,
    tokenizer: str = "word_bpe_49k.json",
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_bytes: int = STRIPE_BYTES,
) -> None:
    """Encode every text and write ids as ORC files, in ascending order of ids over all files, in stripes of about
    stripe_bytes.

    Texts, which are smaller than their ids, are dealt out by ranges of ids before they are encoded. Null or empty texts
    have the end id alone; null ids come first; repeated ids keep all rows; an empty table writes an empty dataset.
    """
    rows = df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("t"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    encode_rows(dealt, tokenizer, end_id, "doc_id", "t").write.options(**ORC_OPTIONS | {"orc.stripe.size": str(stripe_bytes)}).orc(path)


def read_token_files(spark: SparkSession, path: str, doc_ids: list | None = None) -> DataFrame:
    """The rows, or those of some documents: row indexes and Bloom filters skip what can't hold them. Ids have the type that
    they were written with."""
    rows = spark.read.orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the files.

    start is a prefix sum in two levels: one row for each shard, then a window within each shard.
    """
    bound_batches(spark)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            flat = ids.flatten().to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.asarray(ids.offsets) - ids.offsets[0].as_py()
            raw = memoryview(np.ascontiguousarray(flat)).cast("B") if len(flat) else memoryview(b"")
            crc = [zlib.crc32(raw[4 * i : 4 * j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist())]
            n = pa.array(np.diff(ends).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), b.column(2), n, pa.array(crc, pa.int64())], ["doc_id", "shard", "pos", "n_tokens", "ids_crc32"]
            )

    files = read_token_files(spark, path)
    rows = files.select("doc_id", "shard", "pos", "ids").mapInArrow(
        lean(digest), f"doc_id {files.schema['doc_id'].dataType.simpleString()}, shard int, pos long, n_tokens long, ids_crc32 long"
    )
    shards = files.groupBy("shard").agg(F.sum("n_tokens").alias("total"))  # a row for each written partition
    before = shards.select(
        "shard", F.coalesce(F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before")
    )
    upto = Window.partitionBy("shard").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("within", F.coalesce(F.sum("n_tokens").over(upto), F.lit(0))).join(before, "shard").select(
        "doc_id", (F.col("before") + F.col("within")).alias("start"), "n_tokens", "ids_crc32"
    )
