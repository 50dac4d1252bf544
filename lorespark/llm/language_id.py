"""4: language ID by error-correcting output codes.

Every language has a codeword. One logistic classifier for each bit reads hashed byte n-grams of the whole text; the
codeword with the least weighted loss wins, and a small lead over the next one flags ambiguity. Weights and the line between
small and large leads come from rows that the classifiers were not fitted on.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean

#: Rows of each language that the fit uses, at most (those with the least hashes of ids), and lines taken from each.
SAMPLE_PER_LANGUAGE = 200
SAMPLE_LINES = 2
#: Bins of 1-, 2- and 3-grams.
BINS = (256, 2048, 4096)
DIM = sum(BINS)
EPOCHS = 150
#: Every UNSEEN-th row of the sample is kept from the classifiers. A lead (difference of losses) is small if it is under
#: AMBIGUOUS times the lead that all but LEAST_SHARE of those rows have, or under LEAST_LEAD, which is the line without them.
UNSEEN = 5
AMBIGUOUS = 0.4
LEAST_SHARE = 0.005
LEAST_LEAD = 0.4
UNKNOWN = "und"
_PIECE = 1 << 20


def codewords(n: int) -> np.ndarray:
    """n rows of +1 and -1: all splits of the languages for up to 6, else random columns with a fixed seed."""
    if n <= 1:
        return np.ones((n, 1))
    if n <= 6:
        cols = [[1 if i == 0 or (c >> (i - 1)) & 1 else -1 for i in range(n)] for c in range(2 ** (n - 1) - 1)]
        return np.array(cols, float).T
    rng, bits = np.random.default_rng(7), int(12 * np.ceil(np.log2(n)))
    best, apart = None, -1
    for _ in range(50):
        m = np.where(rng.random((n, bits)) < 0.5, -1.0, 1.0)
        m[:, np.abs(m.sum(axis=0)) == n] = np.where(np.arange(n) % 2 == 0, 1.0, -1.0)[:, None]
        near = ((bits - m @ m.T) / 2 + np.eye(n) * bits).min()
        if near > apart:
            best, apart = m, near
    return best


def ngram_features(text: str) -> np.ndarray:
    """Square roots of the shares of hashed 1-, 2- and 3-grams of lower-cased UTF-8, over the whole text."""
    raw = np.frombuffer(text.lower().encode("utf-8", "surrogatepass"), np.uint8)
    counts = np.zeros(DIM)
    for at in range(0, len(raw), _PIECE):
        b = raw[at : at + _PIECE + 2].astype(np.uint32)
        n = min(_PIECE, len(raw) - at)
        counts[: BINS[0]] += np.bincount(b[:n], minlength=BINS[0])
        if len(b) > 1:
            two = (b[:-1] << np.uint32(8) | b[1:])[:n]
            bins = (two * np.uint32(0x9E3779B1)) >> np.uint32(21)
            counts[BINS[0] : BINS[0] + BINS[1]] += np.bincount(bins, minlength=BINS[1])
        if len(b) > 2:
            three = (b[:-2] << np.uint32(16) | b[1:-1] << np.uint32(8) | b[2:])[:n]
            bins = (three * np.uint32(0x85EBCA6B)) >> np.uint32(20)
            counts[BINS[0] + BINS[1] :] += np.bincount(bins, minlength=BINS[2])
    return np.sqrt(counts / max(counts.sum(), 1)).astype(np.float32)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class OutputCodes:
    def __init__(self, languages: list[str], codes: np.ndarray, weights: np.ndarray, bias: np.ndarray, trust: np.ndarray, line: float = LEAST_LEAD):
        self.languages, self.codes, self.weights, self.bias, self.trust, self.line = languages, codes, weights, bias, trust, line

    @classmethod
    def fit(cls, x: np.ndarray, y: list[str], languages: list[str], epochs: int = EPOCHS, group: list[int] | None = None) -> OutputCodes:
        """Logistic classifiers of all bits at once (Adam, whole batch), classes weighted alike, on all but every UNSEEN-th
        group of rows (a document and its lines; by default each row is one). On the others each bit's trust on each language is the log odds of its accuracy (with one right
        and one wrong row more), scaled to a sum of 1 by language, and the line of small leads is drawn."""
        codes = codewords(len(languages))
        place = {lang: i for i, lang in enumerate(languages)}
        rows = np.array([place[v] for v in y], int)
        unseen = np.array(range(len(rows)) if group is None else group, int) % UNSEEN == UNSEEN - 1
        x, held, rows, held_rows = x[~unseen], x[unseen], rows[~unseen], rows[unseen]
        bits = codes.shape[1]
        w, b = np.zeros((DIM, bits), np.float32), np.zeros(bits, np.float32)
        if len(rows):
            target = codes[rows].astype(np.float32)
            share = (1 / np.maximum(np.bincount(rows, minlength=len(languages)), 1))[rows].astype(np.float32)
            share = (share / share.sum())[:, None]
            mw, vw = np.zeros_like(w), np.zeros_like(w)
            mb, vb = np.zeros_like(b), np.zeros_like(b)
            for i in range(1, epochs + 1):
                f = x @ w + b
                g = -target / (1 + np.exp(np.clip(target * f, -30, 30))) * share
                gw, gb = x.T @ g + 1e-7 * w, g.sum(axis=0)
                mw, vw = 0.9 * mw + 0.1 * gw, 0.99 * vw + 0.01 * gw * gw
                mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
                scale = np.sqrt(1 - 0.99**i) / (1 - 0.9**i)
                w -= 0.5 * scale * mw / (np.sqrt(vw) + 1e-8)
                b -= 0.5 * scale * mb / (np.sqrt(vb) + 1e-8)
        right = (np.sign(held @ w + b) == codes[held_rows]) if len(held) else np.zeros((0, bits), bool)
        odds = lambda r: np.log((r.sum(axis=0) + 1) / (len(r) - r.sum(axis=0) + 1))
        trust = np.stack([np.maximum(odds(right[held_rows == k]), 0.1) for k in range(len(languages))]) if languages else np.ones((0, bits))
        trust = trust / np.maximum(trust.sum(axis=1, keepdims=True), 1e-9)
        model = cls(languages, codes, w, b, trust)
        if len(held) and len(languages) > 1:
            model.line = max(LEAST_LEAD, AMBIGUOUS * float(np.quantile(model.decode(held)[2], LEAST_SHARE)))
        return model

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Number of the language, its probability, and the lead of its loss over the next one's."""
        f = x @ self.weights + self.bias
        loss = np.logaddexp(0, -f[:, None, :] * self.codes[None, :, :])
        total = (loss * self.trust[None, :, :]).sum(axis=2) * self.codes.shape[1]
        p = np.exp(total.min(axis=1, keepdims=True) - total)
        p /= p.sum(axis=1, keepdims=True)
        order = np.sort(total, axis=1)
        lead = order[:, 1] - order[:, 0] if p.shape[1] > 1 else np.full(len(p), np.inf)
        return p.argmax(axis=1), p.max(axis=1), lead


def fit_language_id(
    labelled: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    per_language: int = SAMPLE_PER_LANGUAGE,
) -> OutputCodes:
    """Fit on at most per_language rows of each language and SAMPLE_LINES lines of each; features are made by tasks."""
    bound_batches(labelled.sparkSession)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("t"), F.xxhash64(id_col).alias("h"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return OutputCodes.fit(np.zeros((0, DIM), np.float32), [], [])
    languages = sorted(counts)
    part = F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, 1.5 * per_language / counts[lang] + 20 / counts[lang]))])
    place = (F.col("h").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40)))
    chosen = rows.where(place < part[F.col("lang")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lang, text, h in zip(*[c.to_pylist() for c in b.columns]):
                if not has_letter(text):
                    continue
                lines = [x for x in text.split("\n") if has_letter(x)]
                picked = [lines[(h + 7919 * i) % len(lines)] for i in range(min(SAMPLE_LINES, len(lines) - 1))]
                x = [ngram_features(t).astype(np.float16).tobytes() for t in (text, *picked)]
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([h]), pa.array([x], pa.list_(pa.binary()))], ["lang", "h", "x"])

    found = chosen.select("lang", "t", "h").mapInArrow(lean(run), "lang string, h long, x array<binary>").toLocalIterator()
    held: dict[str, list[tuple[int, list[bytes]]]] = {}
    for r in found:  # half precision until the matrix is filled
        held.setdefault(r["lang"], []).append((r["h"], [bytes(v) for v in r["x"]]))
    for lang, rows_of in held.items():
        rows_of.sort(key=lambda p: p[0])
        held[lang] = rows_of[:per_language]
    y = [lang for lang in languages for _, x in held.get(lang, []) for _ in x]
    group = [i for lang in languages for i, (_, x) in enumerate(held.get(lang, [])) for _ in x]
    matrix = np.empty((len(y), DIM), np.float32)
    at = 0
    for lang in languages:
        for _, x in held.pop(lang, []):
            for v in x:
                matrix[at] = np.frombuffer(v, np.float16)
                at += 1
    return OutputCodes.fit(matrix, y, languages, group=group)


def identify_language(df: DataFrame, model: OutputCodes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """df with lang_pred, score (probability) and ambiguous appended, replacing columns of these names.

    A text that is null or has no letter gets `und`, score 0, not ambiguous; so do all texts if no language was learned.
    Rows and other columns stay as they are, also repeated rows and null ids.
    """
    bound_batches(df.sparkSession)
    new = ("lang_pred", "score", "ambiguous")
    kept = df.drop(*new)
    spec = (model.languages, model.codes, model.weights, model.bias, model.trust, model.line)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = OutputCodes(*spec)
        for b in batches:
            texts = b.column(b.schema.get_field_index(text_col)).to_pylist()
            pred, score, ambiguous = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), bool)
            known = [i for i, t in enumerate(texts) if m.languages and has_letter(t)]
            for at in range(0, len(known), 256):
                part = known[at : at + 256]
                best, p, lead = m.decode(np.stack([ngram_features(texts[i]) for i in part]))
                for i, k in zip(part, best.tolist()):
                    pred[i] = m.languages[k]
                score[part], ambiguous[part] = p, lead < m.line
            arrays = [*b.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(ambiguous)]
            yield pa.RecordBatch.from_arrays(arrays, [*b.schema.names, *new])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema])
    return kept.mapInArrow(lean(run), f"{schema}, lang_pred string, score double, ambiguous boolean")


def is_held_out(id_col: str = "doc_id", parts: int = 4, part: int = 2) -> Column:
    """Is the row held out from fitting? A null id is not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(False))
