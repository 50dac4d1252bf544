"""12: quality by compression. One zstandard dictionary is trained on good labelled text and one on bad; a text is cut into
blocks, each is compressed with either, and the difference of the sizes, divided by the text's own, becomes a score.

Blocks are small, so that what compresses a block is the dictionary rather than the text before it. The dictionaries and the
calibration use different labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean

BLOCK = 500
DICTIONARY_BYTES = 64 << 10
LEVEL = 3
#: Rows of each label for the dictionaries (with SAMPLE_BLOCKS blocks of each) and for the calibration, at most.
DICTIONARY_ROWS = 1000
SAMPLE_BLOCKS = 6
CALIBRATION_ROWS = 2000
#: Bytes of a text that say as much as the labels' shares say before it is read.
SHORT = 100
THRESHOLD = 0.3


def blocks(raw: bytes) -> list[bytes]:
    return [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]


class CompressionClassifier:
    """dictionaries: of label 0 and 1 (b"": none). score = logistic of prior + (weight * difference + bias) * trust, where
    difference is (bytes with 0 - bytes with 1) / bytes, and trust bytes / (bytes + SHORT)."""

    def __init__(self, dictionaries: list[bytes], prior: float = 0.0, weight: float = 0.0, bias: float = 0.0):
        self.dictionaries, self.prior, self.weight, self.bias = dictionaries, prior, weight, bias
        self._coders: list[zstandard.ZstdCompressor] = []

    def coders(self) -> list[zstandard.ZstdCompressor]:
        if not self._coders:
            for d in self.dictionaries:
                known = {}
                if d:
                    known["dict_data"] = zstandard.ZstdCompressionDict(d)
                    known["dict_data"].precompute_compress(level=LEVEL)
                self._coders.append(zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_dict_id=False, **known))
        return self._coders

    def sizes(self, raw: bytes) -> tuple[int, int]:
        bad, good = (c.compress for c in self.coders())
        a = b = 0
        for x in blocks(raw):
            a += len(bad(x))
            b += len(good(x))
        return a, b

    def difference(self, text: str | None) -> tuple[float, float]:
        raw = (text or "").encode("utf-8", "surrogatepass")
        bad, good = self.sizes(raw)
        return (bad - good) / max(len(raw), 1), len(raw) / (len(raw) + SHORT)

    def score(self, text: str | None) -> float:
        difference, trust = self.difference(text)
        return float(1 / (1 + np.exp(-np.clip(self.prior + (self.weight * difference + self.bias) * trust, -30, 30))))

    def calibrate(self, difference: np.ndarray, trust: np.ndarray, label: np.ndarray) -> None:
        """Logistic regression by Newton's method with a small ridge; the prior is the labels' log odds."""
        good = float(label.sum())
        self.prior = float(np.log((good + 1) / (len(label) - good + 1)))
        x = np.stack([difference * trust, trust], axis=1) if len(label) else np.zeros((0, 2))
        w, ridge = np.zeros(2), np.diag([1e-4, 1e-2])
        loss = lambda w: np.logaddexp(0, -np.where(label == 1, 1, -1) * (self.prior + x @ w)).sum() + w @ ridge @ w / 2
        for _ in range(100):
            p = 1 / (1 + np.exp(-np.clip(self.prior + x @ w, -30, 30)))
            step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (label - p) - ridge @ w)
            while np.abs(step).max() > 1e-9 and loss(w + step) > loss(w):
                step = step / 2
            w = w + step
            if np.abs(step).max() <= 1e-9:
                break
        self.weight, self.bias = map(float, w)


def train(samples: list[bytes]) -> bytes:
    """A dictionary of the samples; of too few samples their text as it is."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[:DICTIONARY_BYTES]


def _sample(rows: DataFrame, per_label: int) -> DataFrame:
    """About per_label rows of each label or a few more, chosen by hashes of ids."""
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}  # two rows
    place = F.pmod(F.shiftright("h", 8), F.lit(1 << 30)) / F.lit(float(1 << 30))
    share = lambda y: F.lit(min(1.0, (1.5 * per_label + 20) / counts.get(y, 1)))
    return rows.where(place < F.when(F.col("label") == 1, share(1)).otherwise(share(0)))


def fit_quality(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    dictionary_rows: int = DICTIONARY_ROWS,
    calibration_rows: int = CALIBRATION_ROWS,
) -> CompressionClassifier:
    """Fit on bounded samples of the rows with label 0 or 1 and a text: half of the rows, by hashes of ids, may give blocks
    to the dictionaries, the other half calibrates. No rows, or none of a label: the shares alone decide."""
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(label_col).isin(0, 1) & F.col(text_col).isNotNull())
    rows = rows.select(F.col(label_col).cast("int").alias("label"), F.col(text_col).alias("t"), F.xxhash64(F.col(id_col), F.lit("quality")).alias("h"))
    half = F.pmod("h", F.lit(2)) == 0

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, h in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                found = blocks(text.encode("utf-8", "surrogatepass"))
                out.append([found[(h + 7919 * i) % len(found)] for i in range(min(SAMPLE_BLOCKS, len(found)))])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(out, pa.list_(pa.binary()))], ["label", "h", "x"])

    taken = _sample(rows.where(half), dictionary_rows).mapInArrow(lean(cut), "label int, h long, x array<binary>").collect()
    dictionaries = []
    for y in (0, 1):
        own = sorted(((r["h"], [bytes(v) for v in r["x"]]) for r in taken if r["label"] == y))[:dictionary_rows]
        dictionaries.append(train([v for _, x in own for v in x]))
    if not all(dictionaries):
        dictionaries = [b"", b""]
    model = CompressionClassifier(dictionaries)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = CompressionClassifier(dictionaries)
        for b in batches:
            found = [m.difference(t) for t in b.column(1).to_pylist()]
            arrays = [b.column(0), b.column(2), pa.array([d for d, _ in found], pa.float64()), pa.array([t for _, t in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, ["label", "h", "difference", "trust"])

    measured = _sample(rows.where(~half), calibration_rows).mapInArrow(lean(measure), "label int, h long, difference double, trust double")
    found = measured.orderBy("h", "difference").collect()
    model.calibrate(*(np.array([r[c] for r in found], float) for c in ("difference", "trust", "label")))
    shares = {y: rows.where(F.col("label") == y).count() for y in (0, 1)}
    seen = {y: sum(r["label"] == y for r in found) for y in (0, 1)}
    if all(seen.values()):  # labels were sampled at different rates
        model.prior += float(np.log(shares[1] / shares[0]) - np.log(seen[1] / seen[0]))
    return model


def score_quality(df: DataFrame, model: CompressionClassifier, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """df with score (0 to 1) and predicted (1 if score >= threshold) appended, replacing columns of these names.

    Null and empty texts score the share of good labels, as nothing else is known of them. Rows and other columns stay as
    they are, also repeated rows and null ids; whole texts are compressed, whatever their length.
    """
    bound_batches(df.sparkSession)
    new = ("score", "predicted")
    kept = df.drop(*new)
    spec = (model.dictionaries, model.prior, model.weight, model.bias)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = CompressionClassifier(*spec)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col))
            score = np.array([m.score(t.as_py()) for t in texts], float)
            arrays = [*b.columns, pa.array(score), pa.array(score >= threshold).cast(pa.int32())]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, *new])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema])
    return kept.mapInArrow(lean(run), f"{schema}, score double, predicted int")
