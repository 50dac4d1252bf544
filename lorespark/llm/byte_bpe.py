"""6: BPE encoding and decoding. Distinct words form a trie; its depth-first traversal carries last-token states.

The encoding of a word ends in some last token; the tokens before it are the encoding of the shorter prefix. So each
trie node needs one state only, its last token: the token that is a suffix of the node's path and may follow the last
token of the node where it starts. A state depends on the path alone, so words that share a prefix share its states.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import KEPT, bound_batches, by_bytes, lean
from .token_counts import tokenizer_file
from .word_bpe import byte_letters

#: Bytes of text whose distinct words form one trie.
TRIE_BYTES = 8 << 20
#: Entries that a Python worker keeps of words and of token pairs.
KEPT_WORDS = 200_000
KEPT_PAIRS = 400_000

_SPACE = "\t-\r \x85\xa0  -     　"
#: A space inside a run of white space, or the last of a run at the end: not a place to cut.
_INSIDE = re.compile(f"[{_SPACE}] (?:[{_SPACE}]|$)")
_SAFE_CUT = re.compile(f"(?<=[^{_SPACE}]) | (?=[^{_SPACE}])")
_PLAIN = re.compile("[\x21-\x7e\xc0-ɏ\n]*")
#: The first character beyond those that _PLAIN has.
_LATIN_END = "\u0250"
# The split pattern of byte-level BPE files, here for ASCII and Latin letters (U+00C0 to U+024F).
_SPLIT = re.compile(
    r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-zÀ-ÖØ-öø-ɏ]+| ?[0-9]+| ?[^\sA-Za-zÀ-ÖØ-öø-ɏ0-9]+|\s+(?!\S)|\s+"
)


class ByteBpe:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        back = {c: b for b, c in enumerate(byte_letters())}
        raw = lambda s: bytes([back[c] for c in s])
        vocab: dict[str, int] = spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of: list[bytes] = [b""] * size
        self.rank, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.merge: dict[int, int] = {}  # left << 32 | right: rank
        self.prefix: dict[bytes, int] = {}  # the token of these bytes, -1 if they only begin one
        for s, i in vocab.items():
            if s not in self.special:
                self.bytes_of[i] = raw(s)
        for r, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            i = vocab[a + b]
            if self.rank[i] < 0:
                self.rank[i], self.left[i], self.right[i] = r, vocab[a], vocab[b]
            self.merge[vocab[a] << 32 | vocab[b]] = r
        for i, t in enumerate(self.bytes_of):
            for n in range(1, len(t)):
                self.prefix.setdefault(t[:n], -1)
            if t:
                self.prefix[t] = i
        for s, i in self.special.items():
            self.bytes_of[i] = s.encode()
        self.splitter = Tokenizer.from_file(path).pre_tokenizer
        self.back = back
        self.cut_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.first: dict[str, bytes] = {}  # chunks at the start of a text
        self.later: dict[str, bytes] = {}  # chunks after a space

    def follows(self, x: int, y: int) -> bool:
        """Do two tokens stay as they are side by side?

        Undo the merges that made them, latest first. Wherever the two tokens at the boundary could merge before
        either is taken up by its own side (of equal ranks the left merge goes first), the answer is no.
        """
        key = x << 32 | y
        if (known := self.pairs.get(key)) is not None:
            return known
        rank, merge, until_x, until_y, ok = self.rank, self.merge, 1 << 40, 1 << 40, True
        while True:
            r = merge.get(x << 32 | y)
            if r is not None and r < until_x and r <= until_y:
                ok = False
                break
            if rank[x] < 0 and rank[y] < 0:
                break
            if rank[x] > rank[y]:
                until_x, x = rank[x], self.right[x]
            else:
                until_y, y = rank[y], self.left[y]
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        self.pairs[key] = ok
        return ok

    def encode_words(self, words: set[bytes]) -> dict[bytes, bytes]:
        """Ids of each word. Sorted words are their trie in depth-first order: what a word shares with the one before
        it is the path to the node where they part, whose states still stand on the stack."""
        longest = max(map(len, words), default=0)
        last, size, deep = [0] * (longest + 1), [0] * (longest + 1), [0] * (longest + 1)
        prefix, follows, pairs = self.prefix.get, self.follows, self.pairs.get
        out: dict[bytes, bytes] = {}
        before = b""
        for w in sorted(words):
            n, shared = len(w), 0
            for a, b in zip(before, w):
                if a != b:
                    break
                shared += 1
            for d in range(shared + 1, n + 1):
                k = deep[d - 1] + 1  # the longest path end that begins a token grows by one byte at most
                t = prefix(w[d - k : d])
                while t is None:
                    k -= 1
                    t = prefix(w[d - k : d])
                deep[d] = k
                while True:
                    if t is not None and t >= 0:
                        if k == d:
                            break
                        ok = pairs(last[d - k] << 32 | t)
                        if ok if ok is not None else follows(last[d - k], t):
                            break
                    k -= 1
                    t = prefix(w[d - k : d])
                last[d], size[d] = t, k
            ids, d = [], n
            while d:
                ids.append(last[d])
                d -= size[d]
            ids.reverse()
            out[w] = array("I", ids).tobytes()
            before = w
        return out

    def split(self, chunk: str) -> list[bytes]:
        if chunk.isalpha() and max(chunk) < _LATIN_END:  # letters alone are one part
            return [chunk.encode()]
        if _PLAIN.fullmatch(chunk[1:] if chunk[:1] == " " else chunk):
            return [p.encode() for p in _SPLIT.findall(chunk)]
        return [bytes([self.back[c] for c in p]) for p, _ in self.splitter.pre_tokenize_str(chunk)]

    def chunks(self, text: str) -> list[str]:
        """Cut before single spaces; the space belongs to the next chunk, which is kept without it."""
        if _INSIDE.search(text):
            return _SAFE_CUT.split(text)
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[bytes]:
        parts: list[list[list[str] | int]] = []
        for t in texts:
            if self.cut_special and self.cut_special.search(t):
                found = [x for x in self.cut_special.split(t) if x]
                parts.append([self.special[x] if x in self.special else self.chunks(x) for x in found])
            else:
                parts.append([self.chunks(t)] if t else [])
        if len(self.later) + len(self.first) > KEPT_WORDS:
            self.later, self.first = {}, {}
        runs = [run for p in parts for run in p if not isinstance(run, int)]
        at_start = {run[0] for run in runs if run[0] not in self.first}
        after = {c for c in set().union(*[run[1:] for run in runs]) if c not in self.later}
        split_first = {c: self.split(c) for c in at_start}
        split_later = {c: [b" " + c.encode()] if c.isalpha() and max(c) < _LATIN_END else self.split(" " + c) for c in after}
        words = set().union(*split_first.values(), *split_later.values()) if split_first or split_later else set()
        code = self.encode_words(words).__getitem__
        self.first.update((c, b"".join(map(code, s))) for c, s in split_first.items())
        self.later.update({c: code(s[0]) if len(s) == 1 else b"".join(map(code, s)) for c, s in split_later.items()})
        later, out = self.later.__getitem__, []
        for p in parts:
            made = []
            for run in p:
                if isinstance(run, int):
                    made.append(array("I", [run]).tobytes())
                else:
                    made.append(self.first[run[0]])
                    made.append(b"".join(map(later, run[1:])))
            out.append(b"".join(made))
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_loaded: dict[str, ByteBpe] = KEPT.setdefault("byte_bpe", {})


def byte_bpe(name: str) -> ByteBpe:
    if name not in _loaded:
        _loaded[name] = ByteBpe(tokenizer_file(name))
    return _loaded[name]


def _groups(b: pa.RecordBatch) -> Iterator[tuple[int, list[str]]]:
    start = 0
    texts = (("" if t is None else t,) for t in b.column(1).to_pylist())
    for group in by_bytes(texts, lambda r: len(r[0]), TRIE_BYTES):
        yield start, [t for (t,) in group]
        start += len(group)


def bpe_encode(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and ids (array<int>) of every row, special strings in a text as their special ids.

    A null or empty text has an empty array; ids may be null or repeated; other columns are not read; an empty table
    gives no rows. Memory is bounded by one Arrow batch, one trie and the kept entries; a longer text is alone in its
    trie.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(tokenizer)
        for b in batches:
            for start, texts in _groups(b):
                codes = model.encode(texts)
                ends = np.cumsum([0, *(len(c) // 4 for c in codes)], dtype=np.int32)
                ids = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(codes), "<i4")))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(start, len(texts)), ids], ["id", "ids"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(lean(run, "byte_bpe"), f"id {rows.schema['id'].dataType.simpleString()}, ids array<int>")
    return out.withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and text of every row of ids. Null or empty ids give an empty text; broken UTF-8 becomes U+FFFD."""
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(tokenizer)
        for b in batches:
            texts = [model.decode(x or []) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["id", "text"])

    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    out = rows.mapInArrow(lean(run, "byte_bpe"), f"id {rows.schema['id'].dataType.simpleString()}, text string")
    return out.withColumnRenamed("id", id_col)


def bpe_round_trip(
    df: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256: encoding and decoding in one pass, without moving the ids.

    Null and empty texts: 0 tokens and the digests of nothing.
    """
    bound_batches(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = byte_bpe(tokenizer)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for b in batches:
            for start, texts in _groups(b):
                codes = model.encode(texts)
                decoded = [model.decode(np.frombuffer(c, "<u4").tolist()) for c in codes]
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(start, len(texts)),
                        pa.array([len(c) // 4 for c in codes], pa.int64()),
                        pa.array([sha(c) for c in codes], pa.string()),
                        pa.array([sha(d.encode()) for d in decoded], pa.string()),
                    ],
                    ["id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    kind = rows.schema["id"].dataType.simpleString()
    out = rows.mapInArrow(lean(run, "byte_bpe"), f"id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string")
    return out.withColumnRenamed("id", id_col)
