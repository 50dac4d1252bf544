"""2: toxicity. Levenshtein automata intersected with a lexicon trie find terms and their misspellings; windows around
each hit separate quotation from abuse; a logistic model of the document's hits gives the score.

All of it is learned from labelled rows: the lexicon (words that toxic documents hold far more often than the others),
harmless neighbours of its terms, the weights of the words around hits, and the weights of the score.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean, materialize
from .decontamination import FILTER_BITS, term_filter
from .words import placed_words, split_bytes

#: A term is in at least MIN_DOCS toxic training documents, RATIO times likelier there than in the others, and its
#: log-likelihood statistic is higher than chance makes the highest of all tested words (one in CHANCE times). All words
#: that pass are terms.
MIN_DOCS = 4
RATIO = 12.0
CHANCE = 0.5
#: A word near hits has a weight if its statistic passes the same test; weights are clipped to this.
MOST_LEAN = 3.0
#: Rows of hits that the logistic fit uses, at most.
FIT_ROWS = 20_000
#: Words on either side of a hit that are its context.
WINDOW = 5
THRESHOLD = 0.7
#: States that the lazily built automaton keeps, and words whose lookups a worker keeps.
KEPT_STATES = 100_000
KEPT_WORDS = 500_000

_QUOTES = "\"“”„«»"
_MASKED = re.compile(r"[^\W\d_]+[*@$!#]+[^\W\d_]+")


def edits(term: str) -> int:
    """Edits that still count as the term: none for short ones."""
    return 0 if len(term) < 5 else 1 if len(term) < 10 else 2


class FuzzyLexicon:
    """The product of the terms' trie and the Levenshtein automaton, made deterministic as words need it.

    A state is the set of (trie node, edits so far) that a word's prefix can reach; words outside every term's
    neighbourhood die after a few characters.
    """

    def __init__(self, terms: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.term: list[str | None] = [None]
        self.room = [0]  # edits that some term below a node allows
        for term in sorted(terms):
            at, e = 0, edits(term)
            self.room[0] = max(self.room[0], e)
            for ch in term:
                if ch not in self.child[at]:
                    self.child[at][ch] = len(self.child)
                    self.child.append({})
                    self.term.append(None)
                    self.room.append(0)
                at = self.child[at][ch]
                self.room[at] = max(self.room[at], e)
            self.term[at] = term
        self._reset()

    def _reset(self) -> None:
        self.number: dict[frozenset, int] = {}
        self.sets: list[dict[int, int]] = []
        self.step: list[dict[str, int]] = []
        self.found: list[tuple[int, str] | None] = []
        self.start = self._state({0: 0})

    def _state(self, reached: dict[int, int]) -> int:
        todo = list(reached.items())  # closure: leave out a character of the term
        while todo:
            node, e = todo.pop()
            for n in self.child[node].values():
                if e + 1 <= self.room[n] and e + 1 < reached.get(n, 9):
                    reached[n] = e + 1
                    todo.append((n, e + 1))
        if not reached:
            return -1
        key = frozenset(reached.items())
        if key not in self.number:
            self.number[key] = len(self.sets)
            self.sets.append(reached)
            self.step.append({})
            ends = [(e, self.term[n]) for n, e in reached.items() if self.term[n] and e <= edits(self.term[n])]
            self.found.append(min(ends) if ends else None)
        return self.number[key]

    def _next(self, state: int, ch: str) -> int:
        reached: dict[int, int] = {}
        for node, e in self.sets[state].items():
            for c, n in self.child[node].items():
                cost = e if c == ch or ch == "*" else e + 1
                if cost <= self.room[n] and cost < reached.get(n, 9):
                    reached[n] = cost
            if e + 1 <= self.room[node] and e + 1 < reached.get(node, 9):
                reached[node] = e + 1
        self.step[state][ch] = to = self._state(reached)
        return to

    def match(self, word: str) -> tuple[int, str] | None:
        """(edits, term) of the nearest term that the word may stand for; `*` stands for any character."""
        if len(self.sets) > KEPT_STATES:
            self._reset()
        state, step = self.start, self.step
        for ch in word:
            to = step[state].get(ch)
            if to is None:
                to = self._next(state, ch)
            if to < 0:
                return None
            state = to
        return self.found[state]


_SWAP = str.maketrans({"@": "a", "$": "s", "!": "i", "#": "*"})
_DIGITS = str.maketrans("013457", "oieast")


def _lookup(lexicon: FuzzyLexicon, word: str) -> tuple[int, str] | None:
    hit = lexicon.match(word)
    if hit is None and not word.isalpha():
        hit = lexicon.match(word.translate(_DIGITS))
        hit = hit and (max(1, hit[0]), hit[1])
    return hit


_HITS = "array<struct<surface:string,term:string,edits:int,quoted:boolean,near:array<string>>>"
_HIT = pa.struct(
    [("surface", pa.string()), ("term", pa.string()), ("edits", pa.int32()), ("quoted", pa.bool_()), ("near", pa.list_(pa.string()))]
)


def _quoted(text: str, a: int, b: int) -> bool:
    """Do quotation marks of the line stand around text[a:b]?"""
    line = text[max(0, a - 80) : a].rpartition("\n")[2]
    return sum(line.count(q) for q in _QUOTES) % 2 == 1 and any(q in text[b : b + 80].partition("\n")[0] for q in _QUOTES)


class _Finder:
    """Finds occurrences of terms in batches of texts. benign: a filter of surfaces that don't stand for a term."""

    def __init__(self, terms: list[str], benign: bytes | None):
        self.lexicon, self.benign = FuzzyLexicon(terms), benign
        self.known: dict[bytes, int] = {}
        self.found: list[tuple[int, str, str]] = [(0, "", "")]

    def _harmless(self, surface: str) -> bool:
        if self.benign is None:
            return False
        h = xxhash.xxh64_intdigest(surface.encode(), 42)
        cells = (h & (FILTER_BITS - 1), (h >> 32) & (FILTER_BITS - 1))
        return all(self.benign[c >> 3] >> (c & 7) & 1 for c in cells)

    def number(self, word: bytes) -> int:
        surface = word.decode("utf-8", "replace")
        hit = _lookup(self.lexicon, surface)
        n = 0
        if hit is not None and not (hit[0] and self._harmless(surface)):
            n = len(self.found)
            self.found.append((*hit, surface))
        self.known[word] = n
        return n

    def numbers(self, words: pa.Array) -> np.ndarray:
        known, number = self.known, self.number
        names = words.to_pylist()
        return np.fromiter([known[w] if w in known else number(w) for w in names], np.int32, len(names))

    def hits(self, column: pa.Array) -> tuple[np.ndarray, dict[int, list[dict]]]:
        """The number of words of each text, and the hits of those that have some."""
        if len(self.known) > KEPT_WORDS:
            self.known, self.found = {}, [(0, "", "")]
        low = pc.utf8_lower(column)
        code, begin, first = placed_words(low, self.numbers, np.int32)
        places = np.flatnonzero(code)
        owner = np.searchsorted(first, places, "right") - 1
        out: dict[int, list[dict]] = {}
        masked = pc.match_substring_regex(low, r"\pL[*@$!#]+\pL")
        rows = np.union1d(np.unique(owner), np.flatnonzero(np.asarray(masked.fill_null(False))))
        for i in rows.tolist():
            raw = low[i].as_py().encode("utf-8", "replace")
            words, found = split_bytes(raw), []
            for p in places[np.searchsorted(owner, i, "left") : np.searchsorted(owner, i, "right")].tolist():
                e, term, surface = self.found[code[p]]
                k, a = p - int(first[i]), int(begin[p])
                around = words[max(0, k - WINDOW) : k] + words[k + 1 : k + 1 + WINDOW]
                before, after = (x.decode("utf-8", "ignore") for x in (raw[max(0, a - 240) : a], raw[a + len(words[k]) :][:240]))
                quoted = _quoted(before + surface + after, len(before), len(before) + len(surface))
                found.append({"surface": surface, "term": term, "edits": e, "quoted": quoted, "near": [w.decode("utf-8", "replace") for w in around]})
            if masked[i].as_py():
                text = raw.decode()
                for m in _MASKED.finditer(text):
                    hit = self.lexicon.match(m[0].translate(_SWAP))
                    if hit and not self._harmless(m[0]):
                        around = split_bytes(text[max(0, m.start() - 80) : m.start()].encode())[-WINDOW:]
                        around += split_bytes(text[m.end() : m.end() + 80].encode())[:WINDOW]
                        near = [w.decode("utf-8", "replace") for w in around]
                        found.append({"surface": m[0], "term": hit[1], "edits": max(1, hit[0]), "quoted": _quoted(text, *m.span()), "near": near})
            if found:
                out[i] = found
        return np.diff(first), out


def toxic_hits(df: DataFrame, terms: list[str], keep: list[str], model: ToxicityModel | None = None) -> DataFrame:
    """Columns keep, n_words, and hits: every occurrence of a term or of what stands for one, with its context. With a
    model also score, the probability that the document is toxic."""
    bound_batches(df.sparkSession)
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder(terms, model.benign if model else None)
        for b in batches:
            counts, found = finder.hits(b.column(len(keep)))
            hits = [found.get(i, []) for i in range(b.num_rows)]
            arrays = [*b.columns[: len(keep)], pa.array(counts, pa.int64()), pa.array(hits, pa.list_(_HIT))]
            if model:
                z = np.full(b.num_rows, model.weights[0])
                for i, h in found.items():
                    z[i] += float(np.dot(model.weights[1:], features(h, int(counts[i]), model.leans)))
                arrays.append(pa.array(1 / (1 + np.exp(-z))))
            yield pa.RecordBatch.from_arrays(arrays, [*keep, "n_words", "hits", *["score"] * bool(model)])

    schema = ", ".join([f"`{k}` {kinds[k]}" for k in keep]) + f", n_words long, hits {_HITS}" + ", score double" * bool(model)
    return df.select(*keep, F.col("_text")).mapInArrow(lean(run), schema)


def _word_documents(rows: DataFrame) -> DataFrame:
    """(w, a, b): in how many toxic and in how many other texts each word is. Batches are summed before the shuffle."""
    bound_batches(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            number: dict[bytes, int] = {}
            count = lambda words: np.fromiter([number.setdefault(w, len(number)) for w in words.to_pylist()], np.int64, len(words))  # noqa: B023, E731
            code, _, first = placed_words(pc.utf8_lower(batch.column(0)), count, np.int64)
            n = max(len(number), 1)
            pairs = np.unique(np.repeat(np.arange(batch.num_rows), np.diff(first)) * n + code)
            toxic = np.asarray(batch.column(1)) == 1
            is_toxic, w = toxic[pairs // n], pairs % n
            a, b = np.bincount(w[is_toxic], minlength=len(number)), np.bincount(w[~is_toxic], minlength=len(number))
            words = [w.decode("utf-8", "replace") for w in number]
            yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["w", "a", "b"])

    counted = rows.select("text", "toxic").mapInArrow(lean(run), "w string, a long, b long")
    return counted.groupBy("w").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))


def _evidence(toxic: float, clean: float) -> Column:
    """The log-likelihood statistic of counts a of toxic and b of clean documents."""
    both, share = F.col("a") + F.col("b"), toxic / (toxic + max(clean, 0.5))
    part = lambda c, s: F.when(F.col(c) > 0, F.col(c) * F.log(F.col(c) / (both * F.lit(max(s, 1e-12))))).otherwise(0.0)
    return 2 * (part("a", share) + part("b", 1 - share))


def _beyond_chance(tested: int) -> float:
    """What the highest of so many statistics exceeds by chance CHANCE times in one."""
    return NormalDist().inv_cdf(1 - min(0.25, CHANCE / (2 * max(tested, 1)))) ** 2


def _ratio(toxic: int, clean: int) -> Column:
    return (F.col("a") + 0.5) / (toxic + 1) / ((F.col("b") + 0.5) / (clean + 1))


def learn_lexicon(labelled: DataFrame) -> list[str]:
    """Terms from rows (text, toxic 0 or 1): words are counted once a document, in all rows; all that pass are terms."""
    total = labelled.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("toxic").cast("long")), F.lit(0)).alias("t")).first()
    toxic, clean = total["t"], total["n"] - total["t"]
    if not toxic:
        return []
    tested = _word_documents(labelled).where((F.col("a") >= MIN_DOCS) & (F.length("w") >= 3) & ~F.col("w").rlike("^[0-9]+$"))
    tested = materialize(tested, "tested-words")
    passed = tested.where((_evidence(toxic, clean) >= _beyond_chance(tested.count())) & (_ratio(toxic, clean) >= RATIO))
    return sorted(r["w"] for r in passed.select("w").collect())


def learn_leans(near: DataFrame) -> dict[str, float]:
    """Weights of words around hits, from rows (toxic, w), one for each hit's document and word."""
    counts = near.groupBy("w").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b"))
    counts = materialize(counts.where("a + b >= 4"), "words-near-hits")
    total = counts.agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"), F.count("*").alias("n")).first()
    if not total["a"] or not total["b"]:
        return {}
    line = _beyond_chance(total["n"])
    passed = counts.where(_evidence(total["a"], total["b"]) >= line).select("w", F.log(_ratio(total["a"], total["b"])).alias("lean"))
    return {r["w"]: r["lean"] for r in passed.collect()}


def features(hits: list[dict], n_words: int, leans: dict[str, float]) -> tuple[float, ...]:
    """Log counts of exact and misspelt hits and of quoted ones, what the words around hits lean to, and their density."""
    exact = fuzzy = quoted = 0
    lean_sum = 0.0
    for h in hits:
        if h["quoted"]:
            quoted += 1
        elif h["edits"]:
            fuzzy += 1
        else:
            exact += 1
        lean_sum += min(MOST_LEAN, max(-MOST_LEAN, sum(leans.get(w, 0.0) for w in h["near"])))
    density = min(20 * (exact + fuzzy) / max(n_words, 1), 1.0)
    return (*[float(np.log1p(x)) for x in (exact, fuzzy, quoted)], lean_sum / max(len(hits), 1), density)


class ToxicityModel:
    """terms: the lexicon; benign: a filter (see term_filter) of neighbours of terms that clean training documents hold;
    leans: weights of words around hits; weights: of the features, bias first."""

    def __init__(self, terms: list[str], benign: bytes | None, leans: dict[str, float], weights: list[float]):
        self.terms, self.benign, self.leans, self.weights = terms, benign, leans, weights


def fit_logistic(x: np.ndarray, y: np.ndarray, n: np.ndarray, prior: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Newton steps from, and penalised towards, prior weights; n counts the rows that each one stands for."""
    x = np.column_stack([np.ones(len(x)), x])
    w = prior.copy()
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (n * (p - y)) + penalty * (w - prior)
        h = (x * (n * p * (1 - p))[:, None]).T @ x + penalty * np.eye(x.shape[1])
        step = np.linalg.solve(h, g)
        w = w - step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
    return w


#: Weights that the fit starts from: an unquoted hit is abuse, a misspelt one likely so, a quoted one hardly.
PRIOR = np.array([-3.0, 3.0, 2.5, 0.3, 0.5, 2.0])


def fit_toxicity(labelled: DataFrame) -> ToxicityModel:
    """Fit on rows (text, toxic); rows with a null label are left out. All rows count for the lexicon, the benign
    neighbours and the words around hits; the logistic model uses at most FIT_ROWS rows with hits, those with the least
    hashes, and as many of the others as weights tell."""
    rows = labelled.where("toxic is not null").select("text", F.col("toxic").cast("int").alias("toxic"))
    terms = learn_lexicon(rows)
    found = toxic_hits(rows.withColumn("_text", F.col("text")).select("toxic", "_text"), terms, ["toxic"])
    hits = materialize(found, "training-hits")
    each = hits.select("toxic", F.explode("hits").alias("h"))
    seen = each.where("h.edits > 0").groupBy("h.surface").agg(F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    harmless = materialize(seen.where("clean > 0 and toxic < 12 * clean").select("surface"), "harmless")
    benign = term_filter(harmless, "surface") if harmless.limit(1).count() else None
    near = hits.select("toxic", F.explode(F.array_distinct(F.flatten("hits.near"))).alias("w"))
    leans = learn_leans(near)
    some = hits.where(F.size("hits") > 0).withColumn("at", F.xxhash64("hits", "n_words", "toxic"))
    n_some = some.count()
    part = min(1.0, 1.2 * FIT_ROWS / max(n_some, 1))
    some = some.where((F.col("at").bitwiseAND(F.lit((1 << 40) - 1)) / F.lit(float(1 << 40))) < part)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Finder([], benign)
        for b in batches:
            x = []
            for h, n in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                x.append(features([r for r in h if not (r["edits"] and finder._harmless(r["surface"]))], n, leans))
            columns = [pa.array([r[k] for r in x], pa.float64()) for k in range(5)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(3), *columns], ["toxic", "at", *[f"x{k}" for k in range(5)]])

    made = some.select("toxic", "hits", "n_words", "at").mapInArrow(
        lean(run), "toxic int, at long, " + ", ".join([f"x{k} double" for k in range(5)])
    )
    sample = sorted(map(tuple, made.collect()), key=lambda r: (r[1], r))[:FIT_ROWS]
    none = {r["toxic"]: r["n"] for r in hits.where(F.size("hits") == 0).groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = len(sample) / max(n_some, 1) if sample else 1.0
    x = [r[2:] for r in sample] + [(0.0,) * 5] * len(none)
    y = [r[0] for r in sample] + list(none)
    n = [1.0] * len(sample) + [k * share for k in none.values()]
    weights = fit_logistic(np.array(x), np.array(y, float), np.array(n), PRIOR) if x else PRIOR
    return ToxicityModel(terms, benign, leans, [float(w) for w in weights])


def score_toxicity(df: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1), predicted (score >= THRESHOLD) and hits of every row.

    Null, empty and wordless texts get the score of no hit. Ids may be null or repeated; other columns are not read; an
    empty table gives no rows.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    scored = toxic_hits(rows, model.terms, ["id"], model)
    return scored.select(F.col("id").alias(id_col), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "hits")
