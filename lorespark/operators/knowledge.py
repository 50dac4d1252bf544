"""Training data from a corpus by concept, and the records that verification and repair need."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import gates, grammar, propositions, text
from ..session import materialize, ship
from . import curate, memory, stores
from .resolve import AUTOMATON_CHARS, AUTOMATON_SUBJECTS

# What a statement gains or loses for each cue, and the question forms.
MANY_STARTS, MANY_PARTS = {"は": 4, "も": 3}, {"の定義": 5, "とは": 5}
MANY_CUES = {"。": 1, **dict.fromkeys(("と思う", "かもしれ", "多分", "？", "?", "ごっこ", "ｗ", "笑"), -3)}
ONE_STARTS, ONE_PARTS = {"は": 10, "も": 6}, {"の定義": 12, "とは": 12}
ONE_CUES = {
    **dict.fromkeys(("である", "です", "存在", "進行", "定義", "全体", "空間", "状態", "膨張", "運動", "観測", "世界"), 1),
    **dict.fromkeys(("と思う", "かもしれ", "多分", "ごっこ", "ネタ", "？", "?", "興味深い", "ｗ", "笑", "RT ", "http://", "https://"), -5),
}
FORMS = ("とは", "について教えて", "を説明して", "って何")


def containing(rows: DataFrame, value: str, concepts: DataFrame, concept: str, small: int = AUTOMATON_SUBJECTS, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Rows joined with each concept that their text holds. Empty concepts and null texts match nothing.

    If a count shows that the concepts are few enough, every task builds one automaton of them and reads its texts once.
    Otherwise, without a nested loop, the text's pieces, as long as the shortest concept, are matched with the concepts'
    beginnings, then whole concepts are tested."""
    named = concepts.select(concept).where(F.length(concept) > 0).distinct()
    count, total, least = named.agg(F.count("*"), F.coalesce(F.sum(F.length(concept)), F.lit(0)), F.coalesce(F.min(F.length(concept)), F.lit(1))).first()
    if count <= small and total <= chars:
        return _held_concepts(rows, value, [r[concept] for r in named.collect()], concept)
    heads = named.withColumn("_piece", F.substring(F.col(concept), 1, least))
    cut = F.transform(F.sequence(F.lit(1), F.length(value) - least + 1), lambda i: F.substring(F.col(value), i, F.lit(least)))
    long = rows.where(F.length(value) >= least)
    pieces = long.withColumn("_piece", F.explode(F.array_distinct(cut)))
    return pieces.join(heads, "_piece").where(F.col(value).contains(F.col(concept))).drop("_piece")


def _held_concepts(rows: DataFrame, value: str, names: list[str], concept: str) -> DataFrame:
    ship(rows.sparkSession)
    place = rows.columns.index(value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ahocorasick.Automaton()
        for name in names:
            search.add_word(name, name)
        search.make_automaton()
        for b in batches:
            found = [(i, name) for i, t in enumerate(b.column(place).to_pylist()) if t for name in {v for _, v in search.iter(t)}] if names else []
            held = b.take(pa.array([i for i, _ in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([*held.columns, pa.array([name for _, name in found], pa.string())], [*held.schema.names, concept])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(concept, T.StringType())]))


def statement_score(concept: Column, statement: Column, starts: dict, parts: dict, cues: dict, length: int) -> Column:
    """Sort key of a statement, the best first in descending order."""
    found = [F.when(F.startswith(statement, F.concat(concept, F.lit(t))), n) for t, n in starts.items()]
    found += [F.when(statement.contains(F.concat(concept, F.lit(t))), n) for t, n in parts.items()]
    found += [F.when(statement.contains(t), n) for t, n in cues.items()]
    total = F.lit(0)
    for f in found:
        total = total + F.coalesce(f, F.lit(0))
    return F.struct(total.alias("score"), (-F.abs(F.length(statement) - length)).alias("fit"), (-F.length(statement)).alias("short"))


def _asked(rows: DataFrame, forms: tuple[str, ...]) -> DataFrame:
    tails = F.posexplode(F.array(*[F.lit(f) for f in forms])).alias("form", "_tail")
    return rows.select("*", tails).withColumn("user", F.concat("concept", "_tail")).drop("_tail")


def _statements(rows: DataFrame, concepts: DataFrame) -> DataFrame:
    clean = rows.select("ord", text.clean_statement(F.col("sentence")).alias("statement"))
    return stores.first_per_key(containing(clean, "statement", concepts, "concept"), "statement", "concept")


def many_answers(rows: DataFrame, concepts: DataFrame, least: int = 12, most: int = 120, per_concept: int = 12) -> DataFrame:
    """Concept, user, assistant, source_rank, form: each concept's best usable statements under three questions.

    rows: ord, sentence; concepts: concept. Repeated statements count once, at their first place, which also breaks ties.
    """
    fit = _statements(rows, concepts).where(gates.usable_statement(F.col("concept"), F.col("statement"), least, most))
    fit = fit.withColumn("_s", statement_score(F.col("concept"), F.col("statement"), MANY_STARTS, MANY_PARTS, MANY_CUES, 55))
    best = curate.top_k(fit, "concept", [F.desc("_s"), F.col("ord")], per_concept)
    return _asked(best, FORMS[:3]).select("concept", "user", F.col("statement").alias("assistant"), F.col("rank").alias("source_rank"), "form")


def one_answer(rows: DataFrame, concepts: DataFrame, least: int = 12, most: int = 120, evidence: int = 4, budget: int = 280) -> DataFrame:
    """Concept, user, assistant, form: one answer a concept, of its best statements without near repeats, up to a budget."""
    fit = _statements(rows, concepts).where(gates.usable_statement(F.col("concept"), F.col("statement"), least, most, ()))
    score = statement_score(F.col("concept"), F.col("statement"), ONE_STARTS, ONE_PARTS, ONE_CUES, 60)
    place = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("_s"), "ord"))
    ranked = fit.withColumn("_s", score).withColumn("place", place).select("concept", "place", "statement")
    bare = ranked.withColumn("_bare", F.regexp_replace("statement", rf"[、。]|{text.SPACE}", ""))
    kept = curate.greedy_prefix_dedup(bare, "concept", "place", "_bare", least=1).select("concept", "place")
    best = curate.top_k(ranked.join(kept, ["concept", "place"]), "concept", [F.col("place")], evidence).drop("rank")
    ended = best.withColumn("statement", F.when(F.endswith("statement", F.lit("。")), F.col("statement")).otherwise(F.concat("statement", F.lit("。"))))
    held = curate.within_budget(ended, "concept", [F.col("place")], F.length("statement"), budget)
    lists = held.groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("rank", "statement"))).alias("_l"))  # `evidence` at most
    said = lists.select("concept", F.array_join(F.transform("_l", lambda r: r["statement"]), "").alias("assistant"))
    return _asked(said, FORMS).select("concept", "user", "assistant", "form")


def discovered_concepts(rows: DataFrame, least: int = 2, most: int = 200) -> DataFrame:
    """Concept and n of the concepts that begin at least `least` statements, the `most` frequent ones (ties by name).
    rows: ord, sentence."""
    named = rows.select(grammar.leading_concept(text.clean_statement(F.col("sentence"))).alias("concept")).where("concept is not null")
    found = named.groupBy("concept").agg(F.count("*").alias("n")).where(F.col("n") >= least).orderBy(F.desc("n"), "concept").limit(most)
    return materialize(found, "concepts")  # `most` rows, so that no reader counts the corpus again


def merged_propositions(rows: DataFrame, concepts: DataFrame, most_chars: int = 180, k: int = 8) -> DataFrame:
    """D3: concept, rank, ord, source, predicate, object, condition, context, polarity: of each concept the k best
    propositions of the statements that hold it, without near repeats of better ones of the same polarity.

    rows: ord, sentence; concepts: concept. The near repeats are those of W8 on objects without punctuation and white space.
    """
    held = _statements(rows, concepts).where(F.length("statement") <= most_chars)
    found = held.withColumn("p", propositions.rich_proposition(F.col("concept"), F.col("statement"))).where("p is not null")
    score = propositions.proposition_score(F.col("p"))
    place = F.struct((-score["score"]).alias("score"), (-score["fit"]).alias("fit"), (-score["short"]).alias("short"), F.col("ord"))
    found = materialize(found.select("concept", "ord", F.col("statement").alias("source"), "p.*", place.alias("place")), "propositions")
    bare = F.regexp_replace("object", rf"[、。]|{text.SPACE}", "")
    keyed = found.select(F.concat(F.col("polarity").cast("string"), F.lit(":"), F.col("concept")).alias("key"), "place", bare.alias("bare"))
    kept = curate.greedy_prefix_dedup(keyed, "key", "place", "bare").select("key", "place")
    kept = kept.select(F.expr("substr(key, instr(key, ':') + 1)").alias("concept"), "place.ord")
    best = curate.top_k(found.join(kept, ["concept", "ord"]), "concept", [F.col("place")], k)
    return best.select("concept", "rank", "ord", "source", "predicate", "object", "condition", "context", "polarity")


def semantic_merge(best: DataFrame, budget: int = 280, clauses: int = 6) -> DataFrame:
    """D3: concept, user, assistant, form, n: an answer of the best propositions (see merged_propositions) under four
    questions; n counts the propositions that were chosen, clauses join in order while the budget lasts."""
    said = propositions.clause(F.col("concept"), F.struct("predicate", "object", "condition", "context"))
    rows = materialize(best.withColumn("clause", said).withColumnRenamed("rank", "place"), "clauses")
    n = rows.groupBy("concept").agg(F.count("*").alias("n"))
    held = curate.within_budget(rows.where(F.col("place") <= clauses), "concept", [F.col("place")], F.length("clause"), budget)
    start = F.concat("concept", F.lit("は、"))
    tail = F.when(F.startswith("clause", start), F.substr("clause", F.length(start) + 1)).otherwise(F.col("clause"))
    part = F.when(F.col("place") == 1, F.col("clause")).otherwise(F.concat(F.lit("また、"), tail))
    lists = held.select("concept", F.struct("place", part.alias("part")).alias("r")).groupBy("concept").agg(F.array_sort(F.collect_list("r")).alias("l"))  # `clauses` at most
    answers = lists.select("concept", F.array_join(F.transform("l", lambda r: r["part"]), "").alias("assistant")).join(n, "concept")
    return _asked(answers, FORMS).select("concept", "user", "assistant", "form", "n")


def concept_contexts(rows: DataFrame, concepts: DataFrame, k: int = 3) -> DataFrame:
    """Concept, n_exact, n_units, known, contexts: how often and where a corpus (ord, sentence) holds a concept."""
    found = materialize(containing(rows.select("ord", "sentence"), "sentence", concepts, "concept"), "contexts")  # read twice
    counts = found.groupBy("concept").agg(F.sum(text.occurrences(F.col("sentence"), F.col("concept"))).alias("n_exact"), F.count("*").alias("n_units"))
    first = curate.top_k(found, "concept", [F.col("ord")], k).groupBy("concept").agg(F.array_sort(F.collect_list(F.struct("rank", "sentence"))).alias("_l"))
    every = concepts.select("concept").distinct().join(counts, "concept", "left").join(first, "concept", "left")
    none, n = F.array().cast("array<string>"), F.coalesce("n_exact", F.lit(0).cast("long"))
    contexts = F.coalesce(F.transform("_l", lambda r: r["sentence"]), none)
    return every.select("concept", n.alias("n_exact"), F.coalesce("n_units", F.lit(0).cast("long")).alias("n_units"), (n >= 2).alias("known"), contexts.alias("contexts"))


def role_memory(candidates: DataFrame) -> DataFrame:
    """Ord, subject, statement, relation, object of candidates (ord, concept, answer), each statement of a subject once."""
    subject, said = text.collapse(F.col("concept")), text.collapse(F.col("answer"))
    rows = candidates.select("ord", subject.alias("subject"), said.alias("statement"))
    rows = rows.withColumn("relation", grammar.role_of(F.col("statement"))).withColumn("object", grammar.role_object(F.col("subject"), F.col("statement")))
    return stores.first_per_key(rows.where("subject <> '' and object is not null"), "subject", "statement")


def promotion(concept: Column, statement: Column) -> Column:
    """F8: struct (ok, reason, values) of a statement that is to be promoted for a concept."""
    return plain_promotion(text.nfkc(concept), text.nfkc(statement))


def plain_promotion(concept: Column, statement: Column) -> Column:
    """F8 for texts that are in NFKC already: stays inside the JVM."""

    def judge(row: Column) -> Column:
        fault, values = _fault(row["name"], row["p"]["subject"], row["p"]["values"]), row["p"]["values"]
        ok = F.struct(F.lit(True).alias("ok"), F.lit("validated semantic proposition").alias("reason"), values.alias("values"))
        return text.let(fault, lambda why: F.when(why.isNull(), ok).otherwise(F.struct(F.lit(False).alias("ok"), why.alias("reason"), F.array().cast("array<string>").alias("values"))))

    return text.let(F.struct(text.plain_fragment(concept).alias("name"), grammar.decomposed(statement).alias("p")), judge)


def _fault(name: Column, subject: Column, values: Column) -> Column:
    """F8: what is wrong with a promotion; null if nothing is. subject and values are null for what is no proposition."""
    other = F.concat(F.lit("statement subject does not match promotion concept: "), subject)
    form = F.lit("statement must use semantic proposition form: XはYである")
    return F.when(name == "", F.lit("concept must be non-empty")).when(values.isNull() | (F.size(values) <= 0), form).when(subject != name, other)


def with_promotion(rows: DataFrame, concept: str, statement: str) -> DataFrame:
    """F8 for a whole table, compiled: rows with fault (null if there is none) and values (null with a fault). The concept is
    a fragment (N1), the statement in NFKC."""
    kept = rows.columns
    rows = grammar.with_decomposed(rows, statement)
    rows = rows.select(*kept, "values", _fault(F.col(concept), F.col("subject"), F.col("values")).alias("fault"))
    return rows.select(*kept, "fault", F.when(F.col("fault").isNull(), F.col("values")).alias("values"))


def unmarked(trained: DataFrame, pairs: DataFrame) -> DataFrame:
    """Trained fingerprints without those of pairs (user, assistant) that are to be trained again."""
    return trained.join(pairs.select(text.pair_fingerprint(F.col("user"), F.col("assistant")).alias("fingerprint")), "fingerprint", "left_anti")


def initial_state(log: DataFrame, policy: str = "baseline") -> DataFrame:
    """Distinct fingerprints of a log's trusted pairs, the state of a store that has none yet."""
    return memory.trusted(log, policy).select(text.pair_fingerprint(F.col("user"), F.col("assistant")).alias("fingerprint")).distinct()


def under_verification(records: DataFrame, tasks: DataFrame) -> DataFrame:
    """Of each concept (lower case) its newest record whose fingerprint has an active task. tasks: concept,
    fingerprint, status."""
    active = tasks.where(F.col("status").isin("pending", "retrain")).select(F.lower(F.trim("concept")).alias("concept"), "fingerprint").distinct()
    low = records.withColumn("concept", F.lower(F.trim("concept"))).where("concept <> ''")
    return stores.last_per_key(low.join(active, ["concept", "fingerprint"], "left_semi"), "concept")


def protected(log: DataFrame, bound: DataFrame, fingerprints: DataFrame, concepts: DataFrame, policy: str = "internalized") -> DataFrame:
    """Ord, concept, question, answer, fingerprint: of each concept the newest trusted pair in the checkpoint (bound),
    without excluded fingerprints and concepts (lower case)."""
    q, a = text.strip(F.col("user")), text.strip(F.col("assistant"))
    rows = memory.trusted(log, policy).select("ord", F.lower(grammar.definition_focus(q)).alias("concept"), q.alias("question"), a.alias("answer"), text.pair_fingerprint(q, a).alias("fingerprint"))
    rows = rows.where("question <> '' and answer <> '' and concept <> ''")
    rows = rows.join(bound.select("fingerprint"), "fingerprint", "left_semi").join(fingerprints.select("fingerprint"), "fingerprint", "left_anti")
    names = concepts.select(F.lower(F.trim("concept")).alias("concept"))
    return stores.last_per_key(rows.join(names, "concept", "left_anti"), "concept").select("ord", "concept", "question", "answer", "fingerprint")


def expected_answers(log: DataFrame, targets: DataFrame, policy: str = "log") -> DataFrame:
    """User and its last trusted, non-empty answer, for the targets (user)."""
    rows = memory.trusted(log, policy).select("ord", text.strip(F.col("user")).alias("user"), text.strip(F.col("assistant")).alias("answer"))
    held = rows.where("answer <> ''").join(targets.select("user"), "user", "left_semi")
    return held.groupBy("user").agg(F.max_by("answer", "ord").alias("answer"))


def best_candidate(runs: DataFrame) -> DataFrame:
    """The run that passed strictly, else any that was scored, with the most total, learned, baseline and unknown
    scores, the greatest stability, the least manual weight and rate, and the least place."""
    order = [F.desc(c) for c in ("strict", "total", "learned", "baseline", "unknown", "stability")] + [F.asc(c) for c in ("manual", "rate", "ord")]
    return runs.where("total is not null").orderBy(*order).limit(1)
