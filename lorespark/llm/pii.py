"""10: personal data. Exact patterns give the base spans; a semi-Markov conditional random field adds others.

The field scores whole candidate spans (up to MAX_TOKENS tokens) by weighted features, none of which forbids a span, and a
dynamic program chooses boundaries and types of a stretch of tokens jointly. It is fitted on a bounded sample of
stretches, labelled by the base spans in them, each together with rewritten copies: spans disguised as people disguise
them (still entities) and spans spoilt so that they are none.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, forget, lean, materialize

KINDS = ("email", "ip", "card", "phone")
#: Longest entity in tokens, and context tokens on either side of a stretch.
MAX_TOKENS = 9
CONTEXT = 2
#: Documents with digits or at signs that are looked at for the fit, stretches that it uses, at most, and its passes.
SAMPLE_DOCS = 2000
SAMPLE_STRETCHES = 300
PASSES = 10
#: Characters of a stretch that the fit still uses.
STRETCH_CHARS = 400

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else (n * 2 if n < 5 else n * 2 - 9)
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join([c for c in s if "0" <= c <= "9"])


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the exact patterns, leftmost and non-overlapping within each kind."""
    out: list[tuple[int, int, str]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at  # a match begins where the run of local characters before the sign begins
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end(), "email"))
            done = m.end()
        else:
            done = max(done, at + 1)
        at = text.find("@", done)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                out.append((m.start(), m.end(), "ip"))
        for m in _CARD.finditer(text):
            if 14 <= m.end() - m.start() < 38 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
                out.append((m.start(), m.end(), "card"))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= len(_digits(m[0])) <= 15:
                    out.append((m.start(), m.end(), "phone"))
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


# --- stretches, candidate spans and their features

_TOKEN = re.compile(r"[^\s,;]+")
_AT, _DOT = re.compile(r"\s*[(\[{<]\s*(?:at|@)\s*[)\]}>]\s*", re.I), re.compile(r"\s*[(\[{<]\s*dot\s*[)\]}>]\s*", re.I)
_TRIGGER = re.compile(r"[0-9@]|[(\[{<]\s*at\s*[)\]}>]", re.I)
_MARKS = ("(at)", "[at]", "{at}", "(dot)", "[dot]", "{dot}", "(", "[", "{")
_EMAIL_SHAPE = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]{1,3}(?:\.[0-9]{1,3}){3}")


class Tokens:
    """Places (start, end) of tokens, kept as two arrays of integers: a line may hold a million."""

    def __init__(self, places: Iterable[tuple[int, int]] = ()):
        self.starts, self.ends = array("q"), array("q")
        for a, b in places:
            self.add(a, b)

    def add(self, a: int, b: int) -> None:
        self.starts.append(a)
        self.ends.append(b)

    def __len__(self) -> int:
        return len(self.starts)

    def __getitem__(self, i: int) -> tuple[int, int]:
        return self.starts[i], self.ends[i]


def _bare_tokens(text: str) -> Iterator[tuple[int, int]]:
    for m in _TOKEN.finditer(text):
        a, b = m.span()
        while b > a and text[b - 1] in ".:!?\"'>":
            b -= 1
        while a < b and text[a] in "\"'<":
            a += 1
        if a < b:
            yield a, b


def stretches(text: str) -> Iterator[tuple[int, Tokens]]:
    """Runs of tokens around digits and at signs, with their places in the text: CONTEXT tokens on either side, and runs that
    would touch are one. Found token by token, so a long text costs no more than its lines with such tokens."""
    if not _DIGIT.search(text) and not _TRIGGER.search(text):
        return
    at = 0
    for line in text.splitlines(keepends=True):
        if _TRIGGER.search(line):
            before: deque[tuple[int, int]] = deque(maxlen=CONTEXT)
            run, left, gap = None, 0, []
            for a, b in _bare_tokens(line):
                if _TRIGGER.search(line, a, b) or line[a:b].lower() in _MARKS:
                    if run is None:
                        run = Tokens(before)
                    for place in gap:
                        run.add(*place)
                    run.add(a, b)
                    left, gap = CONTEXT, []
                elif run is None:
                    before.append((a, b))
                elif left:
                    run.add(a, b)
                    left -= 1
                else:
                    gap.append((a, b))
                    if len(gap) > CONTEXT:
                        yield at, run
                        before.extend(gap)
                        run, gap = None, []
            if run is not None:
                yield at, run
        at += len(line)


_OPEN_DOT = re.compile(r"[(\[{]\s*\.\s*[)\]}]")
_HEX = re.compile(r"[0-9A-Fa-f:]+")
_VERSIONS = frozenset(f"v{i}" for i in range(10))
_MONEY = ("$", "€", "£", "¥")
#: Shapes that a span's features name, and how often digits of a span come in groups.
N_FEATURES = 47
_DATE = re.compile(r"[0-9]{4}[-/.][0-9]{1,2}[-/.][0-9]{1,2}|[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{2,4}")
_PRICE = re.compile(r"[0-9]{1,3}(?:[,. ]?[0-9]{3})*[.,][0-9]{2}")


def features(text: str, a: int, b: int, n_tokens: int) -> list[int]:
    """Numbers of the features that hold for the whole span text[a:b]: its length, its number of digits, what it is once
    disguises are undone, how its digits are grouped, its ends and its surroundings."""
    s = text[a:b]
    d = _digits(s)
    plain = _OPEN_DOT.sub(".", _DOT.sub(".", _AT.sub("@", s)))
    email = _EMAIL_SHAPE.fullmatch(plain) is not None
    quad = _QUAD.fullmatch(plain) is not None
    bytes_ = quad and all(int(p) <= 255 for p in plain.split("."))
    rest = set(s) - set("0123456789 -./()+")
    number = bool(d) and not rest and not quad
    n = len(d)
    letters = any(c.isalpha() for c in s)
    groups = len(re.findall("[0-9]+", s))
    before = text[max(0, a - 24) : a].lower()
    on = [0, 1 if n_tokens == 1 else 2 if n_tokens <= 3 else 3]
    on.append(4 if n == 0 else 5 if n < 7 else 6 if n < 10 else 7 if n < 14 else 8 if n < 16 else 9 if n < 20 else 10)
    for i, holds in enumerate(
        (
            email,
            email and plain == s,
            not email and "@" in plain,
            bytes_,
            bytes_ and plain == s,
            quad and not bytes_,
            number,
            number and s[0] == "+",
            number and s[:2] == "00",
            number and "(" in s and ")" in s,
            number and 14 <= n <= 19 and luhn(d),
            number and 14 <= n <= 19 and not luhn(d),
            number and groups == 1,
            number and 2 <= groups <= 3,
            number and groups > 3,
            number and "." in s,
            number and "/" in s,
            number and 10 <= n <= 15 and groups > 1,
            letters and not email,
            not letters and not d,
            s[0] in "+(" or s[0].isdigit(),
            s[-1].isdigit(),
            (a > 0 and text[a - 1].isalnum()) or (b < len(text) and text[b].isalnum()),
            " " in s and not number and not email and not quad,
            "@" in before or before.endswith(("mail ", "mail: ")),
            any(w in before for w in ("call", "tel", "phone", "fax")),
            any(w in before for w in ("card", "visa", "pay")),
            any(w in before for w in ("ip ", "host", "addr", "server")),
            _HEX.fullmatch(s) is not None and ":" in s,
            _DATE.fullmatch(s) is not None,
            any(w in before for w in ("isbn", "issn", "doi", "no.", "order", "ticket")),
            n in (10, 13) and (d[:3] in ("978", "979") or s[0] not in "+(0"),
            before.endswith(("version ", "release ", "ver. ", "v", "build ")) or s[:2].lower() in _VERSIONS,
            _PRICE.fullmatch(s) is not None or before.rstrip()[-1:] in _MONEY or text[b : b + 2].strip()[:1] in _MONEY,
            number and 9 <= n <= 15 and (s[0] in "+(" or s[:2] == "00"),
            ":" in s and not email,
        ),
        11,
    ):
        if holds:
            on.append(i)
    return on


def _candidates(text: str, at: int, tokens: Tokens):
    """(first token, number of tokens) of every candidate span, and a row of its features: for short stretches."""
    segs, on = [], []
    for i in range(len(tokens)):
        for n in range(1, min(MAX_TOKENS, len(tokens) - i) + 1):
            segs.append((i, n))
            on.append(features(text, at + tokens[i][0], at + tokens[i + n - 1][1], n))
    x = np.zeros((len(segs), N_FEATURES))
    for row, f in enumerate(on):
        x[row, f] = 1
    return segs, x


# --- rewritten copies of spans for the fit


def disguised(s: str, kind: str, k: int) -> str:
    """A span as people disguise it: still an entity of its kind."""
    if kind == "email":
        name, _, host = s.partition("@")
        at, dot = ((" (at) ", "."), (" [at] ", " [dot] "), ("(at)", "(dot)"), (" at@ ", "."))[k % 4]
        return f"{name}{at}{host.replace('.', dot)}" if k % 4 != 3 else f"{name} [at] {host}"
    if kind == "ip":
        return s.replace(".", ("[.]", "(.)", " [dot] ", "(dot)")[k % 4])
    d, sep = _digits(s), (" ", "-", ".", "/")[k % 4]
    if kind == "card":
        return sep.join(_cut(d, ((4, 4, 4), (4, 6), (8,), (6, 6))[k // 4 % 4]))
    head = ("00", "(0)", "", "+")[k // 4 % 4]
    return head + sep.join(_cut(d, ((2, 3, 3), (2, 3), (2, 2, 4), (3, 4))[k // 16 % 4]))


def _cut(d: str, sizes: tuple[int, ...]) -> list[str]:
    """d in parts of these sizes and the rest."""
    ends = [0, *np.cumsum(sizes).tolist(), len(d)]
    return [d[a:b] for a, b in zip(ends, ends[1:]) if d[a:b]]


def spoilt(s: str, kind: str, k: int) -> str:
    """A span that is no longer an entity, though it looks like one."""
    if kind == "email":
        return (s.replace("@", ""), s.replace("@", "."), s.split("@")[0])[k % 3]
    if kind == "ip":
        parts = s.split(".")
        return (".".join([*parts[:3], "9" + parts[3] * 3][:4])[:20], ".".join(parts[:2]), ".".join(parts[:3]))[k % 3]
    if kind == "card":
        i = max(j for j, c in enumerate(s) if c.isdigit())
        return (s[:i] + str((int(s[i]) + 1 + k % 8) % 10) + s[i + 1 :], s[:9], s[: len(s) // 2])[k % 3]
    d = _digits(s)
    return (d[:4], d[:2] + "," + d[2:5], d[:6])[k % 3]


def lookalike(s: str, k: int) -> str:
    """A date, book number, version, price, time or amount with digits of the span."""
    d = (_digits(s) * 4 + "1" * 20)[:20]
    return (
        f"{1950 + int(d[:2]) % 80}-{1 + int(d[2:4]) % 12:02}-{1 + int(d[4:6]) % 28:02}",
        f"ISBN 978-{d[0]}-{d[1:3]}-{d[3:9]}-{d[9]}",
        f"version {d[0]}.{d[1:3]}.{d[3]}",
        f"${d[:3]}.{d[3:5]}",
        f"{1 + int(d[:2]) % 28}.{1 + int(d[2:4]) % 12}.{1950 + int(d[4:6]) % 80}",
        f"{d[0]},{d[1:4]},{d[4:7]}.{d[7:9]} €",
        f"{int(d[:2]) % 24:02}:{int(d[2:4]) % 60:02}",
        f"v{d[0]}.{d[1]}.{d[2]}.{d[3]}",
        f"order {d[:9]}",
        f"{d[0]}-{d[1:4]}-{d[4:9]}-{d[9]}",
    )[k % 10]


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis) + 1e-300)


class SemiMarkovField:
    """Labels 0..3 are KINDS, 4 is outside (one token each). weights: features x kinds; turns: from label to label."""

    def __init__(self, weights: np.ndarray | None = None, turns: np.ndarray | None = None):
        self.weights = np.zeros((N_FEATURES, 4)) if weights is None else weights
        self.turns = np.zeros((5, 5)) if turns is None else turns
        self._known: dict[tuple[int, ...], tuple[float, ...]] = {}

    def _decode(self, n: int, rows: Iterable[list[tuple[float, ...]]]) -> list[tuple[int, int, int]]:
        """The best segmentation's entities as (first token, number of tokens, kind). rows: for each token the scores, by
        kind, of the spans of 1, 2, ... tokens that begin there. Memory is ten bytes a token besides a few rows."""
        turns = self.turns.tolist()
        none = -float("inf")
        value = deque([[none] * 4 + [0.0]], maxlen=MAX_TOKENS + 1)  # of this token's border and the next MAX_TOKENS ones
        value.extend([none] * 5 for _ in range(MAX_TOKENS))
        lengths, befores = bytearray(5 * (n + 1)), bytearray(5 * (n + 1))
        for i, row in enumerate(rows):
            here = value[0]
            came = []
            for y in range(5):
                top, arg = none, 0
                for p in range(5):
                    v = here[p] + turns[p][y]
                    if v > top:
                        top, arg = v, p
                came.append((top, arg))
            top, arg = came[4]
            if top > value[1][4]:
                value[1][4] = top
                lengths[5 * (i + 1) + 4], befores[5 * (i + 1) + 4] = 1, arg
            for m, score in enumerate(row, 1):
                there = value[m]
                for y in range(4):
                    v = came[y][0] + score[y]
                    if v > there[y]:
                        there[y] = v
                        lengths[5 * (i + m) + y], befores[5 * (i + m) + y] = m, came[y][1]
            value.append([none] * 5)
        out, j, y = [], n, max(range(5), key=value[0].__getitem__)
        while j:
            m, before = lengths[5 * j + y], befores[5 * j + y]
            if y < 4:
                out.append((j - m, m, y))
            j, y = j - m, before
        return out[::-1]

    def best(self, n: int, segs: list[tuple[int, int]], x: np.ndarray) -> list[tuple[int, int, int]]:
        rows: list[list[tuple[float, ...]]] = [[] for _ in range(n)]
        for (i, _), score in zip(segs, (x @ self.weights).tolist()):
            rows[i].append(tuple(score))
        return self._decode(n, rows)

    def _rows(self, text: str, at: int, tokens: Tokens) -> Iterator[list[tuple[float, ...]]]:
        weights, known, n = self.weights, self._known, len(tokens)
        for i in range(n):
            row = []
            a = at + tokens.starts[i]
            for m in range(1, min(MAX_TOKENS, n - i) + 1):
                on = tuple(features(text, a, at + tokens.ends[i + m - 1], m))
                score = known.get(on)
                if score is None:
                    if len(known) > 50_000:
                        known.clear()
                    score = known[on] = tuple(weights[list(on)].sum(axis=0).tolist())
                row.append(score)
            yield row

    def gradient(self, n: int, segs: list[tuple[int, int]], x: np.ndarray, gold: dict[tuple[int, int], int]):
        """The log-likelihood of gold entities and its gradient: the difference of observed and expected features and
        turns."""
        score, t = x @ self.weights, self.turns
        place = {s: k for k, s in enumerate(segs)}
        first = [place[i, 1] for i in range(n)]  # spans of a token's 1, 2, ... tokens are neighbours
        widths = [min(MAX_TOKENS, n - i) for i in range(n)]
        alpha, beta = np.full((n + 1, 5), -np.inf), np.full((n + 1, 5), -np.inf)
        came, ahead = np.full((n, 5), -np.inf), np.full((n, 4), -np.inf)
        alpha[0, 4], beta[n] = 0, 0
        ends = np.full((n + 1, MAX_TOKENS, 4), -np.inf)
        for i in range(n):
            if i:
                alpha[i, :4] = _lse(ends[i], 0)
            came[i] = _lse(alpha[i][:, None] + t, 0)
            alpha[i + 1, 4] = came[i, 4]
            for m in range(1, widths[i] + 1):
                ends[i + m, m - 1] = came[i, :4] + score[first[i] + m - 1]
        alpha[n, :4] = _lse(ends[n], 0)
        for i in range(n - 1, -1, -1):
            ahead[i] = _lse(score[first[i] : first[i] + widths[i]] + beta[i + 1 : i + 1 + widths[i], :4], 0)
            beta[i] = np.logaddexp(t[:, 4] + beta[i + 1, 4], _lse(t[:, :4] + ahead[i][None, :], 1))
        z = _lse(alpha[n], 0)
        at = np.array([i for i, _ in segs])
        to = at + np.array([m for _, m in segs])
        expected = np.exp(came[at, :4] + score + beta[to, :4] - z)
        dt = np.zeros_like(t)
        dt[:, :4] -= np.exp(alpha[:n, :, None] + t[None, :, :4] + ahead[:, None, :] - z).sum(axis=0)
        dt[:, 4] -= np.exp(alpha[:n] + t[:, 4][None, :] + beta[1:, 4][:, None] - z).sum(axis=0)
        observed, likely = np.zeros_like(score), -z
        held = {i: (m, y) for (i, m), y in gold.items()}
        j, before = 0, 4
        while j < n:
            m, y = held.get(j, (1, 4))
            if y < 4:
                observed[place[j, m], y] = 1
                likely += score[place[j, m], y]
            likely += t[before, y]
            dt[before, y] += 1
            before, j = y, j + m
        return float(likely), x.T @ (observed - expected), dt

    @classmethod
    def fit(cls, stretches_: list[str], passes: int = PASSES) -> SemiMarkovField:
        """Adagrad over the stretches and their rewritten copies, with a small quadratic penalty."""
        data = [row for i, text in enumerate(stretches_) for row in _examples(text, i)]
        field = cls()
        field.weights[0] = -0.5
        sw, st = np.full_like(field.weights, 1e-6), np.full_like(field.turns, 1e-6)
        for _ in range(passes):
            for n, segs, x, gold in data:
                _, dw, dt = field.gradient(n, segs, x, gold)
                dw -= 1e-4 * field.weights
                dt -= 1e-4 * field.turns
                sw += dw * dw
                st += dt * dt
                field.weights += 0.3 * dw / np.sqrt(sw)
                field.turns += 0.3 * dt / np.sqrt(st)
        return field

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        out = []
        for at, tokens in stretches(text):
            for i, m, y in self._decode(len(tokens), self._rows(text, at, tokens)):
                out.append((at + tokens[i][0], at + tokens[i + m - 1][1], KINDS[y]))
        return out


def _labelled(text: str, spans: list[tuple[int, int, str]]):
    """Examples (tokens, candidates, features, gold) of the stretches of a short text with known spans."""
    for at, tokens in stretches(text):
        gold: dict[tuple[int, int], int] = {}
        used = -1
        for a, b, kind in spans:
            held = [i for i in range(len(tokens)) if at + tokens[i][0] < b and at + tokens[i][1] > a]
            exact = held and at + tokens[held[0]][0] == a and at + tokens[held[-1]][1] == b
            if exact and len(held) <= MAX_TOKENS and held[0] > used:
                gold[held[0], len(held)] = KINDS.index(kind)
                used = held[-1]
        yield len(tokens), *_candidates(text, at, tokens), gold


def _examples(text: str, k: int):
    base = base_spans(text)
    yield from _labelled(text, base)
    for n, (a, b, kind) in enumerate(base):
        if any(s < b and a < e and (s, e) != (a, b) for s, e, _ in base):
            continue
        span = text[a:b]
        for new, is_one in ((disguised(span, kind, k + n), True), (spoilt(span, kind, k + n), False), (lookalike(span, k + n), False)):
            copy = text[:a] + new + text[b:]
            others = [s for s in base_spans(copy) if s[1] <= a or s[0] >= a + len(new)]
            if is_one:
                yield from _labelled(copy, sorted([*others, (a, a + len(new), kind)]))
            elif not any(s[0] < a + len(new) and s[1] > a for s in base_spans(copy)):
                yield from _labelled(copy, others)


def all_spans(text: str, field: SemiMarkovField) -> list[tuple[int, int, str, bool]]:
    """Base spans, and those of the field that overlap none of them: (start, end, kind, base)."""
    base = base_spans(text)
    out = [(*s, True) for s in base]
    out += [(a, b, k, False) for a, b, k in field.spans(text) if not any(a < e and s < b for s, e, _ in base)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def fit_field(df: DataFrame, text_col: str = "text", sample: int = SAMPLE_STRETCHES) -> SemiMarkovField:
    """Fit on at most `sample` stretches, those with the least hashes of their texts, of about SAMPLE_DOCS documents with
    digits. Stretches are cut out by tasks; only they reach the driver."""
    held = df.select(F.col(text_col).alias("t")).where(F.col("t").rlike("[0-9@]"))
    held = held.select("t", F.xxhash64("t").alias("h"))
    n = df.count()
    place = F.col("h").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))
    chosen = held.where(place < min(1.0, 2 * SAMPLE_DOCS / max(n, 1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, marks = [], []
            for text, h in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                for at, tokens in stretches(text):
                    low, high = at + tokens[0][0], at + tokens[-1][1]
                    if high - low <= STRETCH_CHARS:
                        found.append(text[low:high])
                        marks.append(h ^ low)
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(marks, pa.int64())], ["s", "h"])

    cut = materialize(chosen.mapInArrow(lean(run), "s string, h long").distinct(), "stretches")  # both halves are cut from it
    rich = F.when(F.col("s").rlike("@|[0-9]{4}|[0-9]+[.][0-9]+[.]|[+][0-9]"), 0).otherwise(1)  # half of those that look like entities
    rows = []
    for kind in (0, 1):
        rows += [r["s"] for r in cut.where(rich == kind).orderBy("h", "s").limit(sample // 2).collect()]
    forget(cut)
    return SemiMarkovField.fit(rows)


_SPAN = "array<struct<begin:int,end:int,kind:string,base:boolean>>"


def find_pii(df: DataFrame, field: SemiMarkovField | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and spans (begin, end in code points, kind, base), ordered by begin, kind, end.

    Null and empty texts have no spans; ids may be null or repeated (a row in, a row out); other columns are not read;
    an empty table gives no rows and fits a field that finds nothing.
    """
    bound_batches(df.sparkSession)
    field = field or fit_field(df, text_col)
    weights, turns = field.weights, field.turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkovField(weights, turns)
        kind = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("kind", pa.string()), ("base", pa.bool_())]))
        for b in batches:
            spans = [
                [{"begin": s, "end": e, "kind": k, "base": base} for s, e, k, base in all_spans(t or "", model)]
                for t in b.column(1).to_pylist()
            ]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, kind)], ["id", "spans"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, spans {_SPAN}")
    return out.withColumnRenamed("id", id_col)


def redacted(text: str, field: SemiMarkovField) -> str:
    """The text with every span replaced by its kind; overlapping spans by the kind of the first."""
    out, at = [], 0
    for a, b, kind, _ in all_spans(text, field):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    out.append(text[at:])
    return "".join(out)


def redact(df: DataFrame, field: SemiMarkovField | None = None, text_col: str = "text") -> DataFrame:
    """df with text_col redacted, all rows and other columns as they are; null stays null."""
    bound_batches(df.sparkSession)
    field = field or fit_field(df, text_col)
    weights, turns = field.weights, field.turns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = SemiMarkovField(weights, turns)
        for b in batches:
            i = b.schema.get_field_index(text_col)
            texts = [None if t is None else redacted(t, model) for t in b.column(i).to_pylist()]
            yield b.set_column(i, b.schema.field(i), pa.array(texts, b.schema.field(i).type))

    return df.mapInArrow(lean(run), df.schema)
