"""1: token counts. Batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, by_bytes
from .word_bpe import word_bpe

#: Bytes of text that one sentencepiece call gets.
CALL_BYTES = 4 << 20
#: Characters after which a text for sentencepiece is cut at the next line feed.
PIECE_CHARS = 1 << 20


def tokenizer_file(name: str) -> str:
    """name, if it is a path of a file, else the public tokenizer of that name."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


_pieces: dict[str, object] = {}


def _count_sentencepiece(path: str, column: pa.Array) -> np.ndarray:
    """A line feed is a token of its own, so a long text is cut before some; a later part has one token too many, the
    space that is put before every text. A text without a line feed stays whole."""
    import sentencepiece

    if path not in _pieces:
        _pieces[path] = sentencepiece.SentencePieceProcessor(model_file=path)
    model = _pieces[path]
    out = np.zeros(len(column), np.int64)

    def parts() -> Iterator[tuple[int, str, int]]:
        for i, text in enumerate(column.to_pylist()):
            at = 0
            while text and at < len(text):
                cut = text.find("\n", at + PIECE_CHARS)
                cut = len(text) if cut < 0 else cut
                yield i, text[at:cut], int(at > 0)
                at = cut

    for group in by_bytes(parts(), lambda r: len(r[1].encode("utf-8", "replace")), CALL_BYTES):
        for (i, _, less), ids in zip(group, model.encode([t for _, t, _ in group], num_threads=1)):
            out[i] += len(ids) - less
    return out


def token_counts(
    df: DataFrame, tokenizer: str = "word_bpe_49k.json", limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row.

    A null or empty text has 0 bytes and 0 tokens; ids may be null or repeated (a row in, a row out); other columns are
    not read. Batches hold about as many bytes each, and long texts are cut at spaces and line feeds; a stretch without
    one is encoded as one piece, however long. An empty table gives no rows. tokenizer is a white-space-dropping word BPE
    (.json) or a sentencepiece model (.model), by name or path.
    """
    bound_batches(df.sparkSession)
    sentences = tokenizer.endswith(".model")

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path = tokenizer_file(tokenizer)
        for b in batches:
            n = _count_sentencepiece(path, b.column(1)) if sentences else word_bpe(path).encode(b.column(1), whole=False)[1]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    rows = df.select(
        F.col(id_col).alias("id"),
        F.col(text_col).alias("t"),
        F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"),
    )
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lengths, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
