"""Questions against prioritized stores: every question is a row, every store a join, the cascade one `when`."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammar
from ..functions.text import surface
from ..session import ship
from .stores import grouped_values

# Routes, actions and priorities of the states.
DISPATCH = {
    "TYPED": ("RETRIEVE", "typed semantic retrieval", 10),
    "CANONICAL": ("RETRIEVE", "canonical definition retrieval", 20),
    "UNIFIED": ("RETRIEVE", "unified semantic retrieval", 30),
    "INTERNALIZED": ("GENERATE", "internalized model generation", 40),
    "INTERNALIZED_STALE": ("BLOCK", "internalized checkpoint stale", 45),
    "RAW_CORPUS_ONLY": ("BLOCK", "raw corpus review", 50),
    "UNKNOWN": ("BLOCK", "unknown knowledge", 60),
    "NON_CONCEPT": ("GENERATE", "normal model generation", 70),
}


#: Subjects and their characters that one automaton may hold; more are joined by their beginnings.
AUTOMATON_SUBJECTS, AUTOMATON_CHARS = 200_000, 8_000_000


def longest_held(rows: DataFrame, key: str, text: str, subjects: DataFrame, subject: str, most: int = AUTOMATON_SUBJECTS, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """Key and the longest subject that its text holds, of equally long ones the greatest; rows without one are left
    out. Keys are distinct. Empty subjects and null texts match nothing.

    If a count shows that the subjects are few enough, every task builds one automaton of them and reads its texts once.
    Otherwise each subject is joined by a beginning: its longest one of 1, 2, 4, 8, ... characters, so that a place of a text
    makes one probe for each such length, however long the longest subject is; then whole subjects are compared.
    """
    names = subjects.select(F.col(subject).alias("subject")).where("subject <> ''").distinct()
    n, total, longest = names.agg(F.count("*"), F.coalesce(F.sum(F.length("subject")), F.lit(0)), F.coalesce(F.max(F.length("subject")), F.lit(0))).first()
    asked = rows.select(F.col(key).alias("key"), F.col(text).alias("text")).where("text is not null")
    if n <= most and total <= chars:
        return _by_automaton(asked, [r["subject"] for r in names.collect()]).select(F.col("key").alias(key), F.col("subject").alias(subject))
    sizes = [1 << i for i in range(max(longest, 1).bit_length())]
    size = F.lit(1)
    for s in sizes:
        size = F.when(F.length("subject") >= s, s).otherwise(size)
    heads = names.withColumn("size", size).withColumn("head", F.expr("substring(subject, 1, size)"))
    probes = asked.select("key", "text", F.explode(F.sequence(F.lit(1), F.greatest(F.length("text"), F.lit(1)))).alias("at"))
    probes = probes.withColumn("size", F.explode(F.array(*map(F.lit, sizes)))).withColumn("head", F.expr("substring(text, at, size)"))
    probes = probes.where(F.length("head") == F.col("size")).select("key", "head", F.expr(f"substring(text, at, {max(longest, 1)})").alias("here"))
    held = probes.join(heads.select("head", "subject"), "head").where(F.startswith("here", "subject"))
    best = held.groupBy("key").agg(F.max_by("subject", F.struct(F.length("subject"), F.col("subject"))).alias("subject"))
    return best.select(F.col("key").alias(key), F.col("subject").alias(subject))


def _by_automaton(asked: DataFrame, names: list[str]) -> DataFrame:
    ship(asked.sparkSession)
    kind = asked.schema["key"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search = ahocorasick.Automaton()
        for name in names:
            search.add_word(name, (len(name), name))
        search.make_automaton()
        for b in batches:
            best = [max((v for _, v in search.iter(t)), default=None) if names else None for t in b.column(1).to_pylist()]
            rows = pa.array([i for i, v in enumerate(best) if v], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array([v[1] for v in best if v], pa.string())], ["key", "subject"])

    return asked.mapInArrow(run, f"key {kind}, subject string")


def typed_lookup(questions: DataFrame, propositions: DataFrame) -> DataFrame:
    """Questions (qid, question) with typed_subject, typed_predicate and typed_answer (null where nothing is found).

    propositions: subject, value, ord. The longest subject that the question holds wins, of equally long ones the
    greatest.
    """
    asked = questions.withColumn("typed_predicate", grammar.asked_predicate_type(F.col("question")))
    typed = propositions.withColumn("typed_predicate", grammar.predicate_type_of(F.col("value")))
    subjects = propositions.select(F.col("subject").alias("typed_subject"))
    best = longest_held(asked.where("typed_predicate is not null"), "qid", "question", subjects, "typed_subject")
    key = F.concat_ws("\x01", "subject", "typed_predicate")
    answers = grouped_values(typed.withColumn("_key", key), "_key", "value")
    found = asked.join(best, "qid", "left")
    found = found.join(answers, F.concat_ws("\x01", "typed_subject", "typed_predicate") == F.col("_key"), "left")
    return found.withColumn("typed_answer", F.when(F.size("values") > 0, grammar.composed(F.col("typed_subject"), F.col("values")))).drop("_key", "values")


def resolve_states(
    questions: DataFrame,
    propositions: DataFrame,
    canonical: DataFrame,
    unified: DataFrame,
    internalized: DataFrame,
    corpus_counts: DataFrame,
    least_occurrences: int = 2,
) -> DataFrame:
    """R2: qid, question, state, focus, answer, predicate_type of every question.

    canonical: concept (lower case), answer; unified: concept, assistant, ord (the first row wins); internalized:
    concept (lower case), bound (trained into the current checkpoint); corpus_counts: concept, n.
    """
    rows = typed_lookup(questions, propositions).withColumn("focus", grammar.query_focus(F.col("question")))
    typed = propositions.withColumn("type", grammar.predicate_type_of(F.col("value")))
    values = grouped_values(propositions, "subject", "value").select(F.col("subject").alias("focus"), F.col("values").alias("_values"))
    types = grouped_values(typed, "subject", "type").select(F.col("subject").alias("focus"), F.array_join("values", ",").alias("_types"))
    memory = unified.groupBy(F.col("concept").alias("focus")).agg(F.min_by("assistant", "ord").alias("_unified"))
    rows = rows.join(values, "focus", "left").join(types, "focus", "left").join(memory, "focus", "left")
    low = canonical.select(F.col("concept").alias("_low"), F.col("answer").alias("_canonical"))
    rows = rows.join(low, F.lower("focus") == F.col("_low"), "left").drop("_low")
    known = internalized.groupBy(F.col("concept").alias("_low")).agg(F.max("bound").alias("_bound"))
    rows = rows.join(known, F.lower("focus") == F.col("_low"), "left").drop("_low")
    rows = rows.join(corpus_counts.select(F.col("concept").alias("focus"), F.col("n").alias("_n")), "focus", "left")
    by_type = F.col("typed_answer").isNotNull()
    has = F.col("focus") != ""
    by_subject = has & (F.size("_values") > 0)
    state = (
        F.when(by_type, "TYPED")
        .when(~has, "NON_CONCEPT")
        .when(by_subject, "TYPED")
        .when(F.col("_canonical").isNotNull(), "CANONICAL")
        .when(F.col("_unified").isNotNull(), "UNIFIED")
        .when(F.col("_bound"), "INTERNALIZED")
        .when(F.col("_bound").isNotNull(), "INTERNALIZED_STALE")
        .when(F.col("_n") >= max(1, least_occurrences), "RAW_CORPUS_ONLY")
        .otherwise("UNKNOWN")
    )
    rows = rows.withColumn("state", state)
    answer = (
        F.when(by_type, F.col("typed_answer"))
        .when(F.col("state") == "TYPED", grammar.composed(F.col("focus"), F.col("_values")))
        .when(F.col("state") == "CANONICAL", F.col("_canonical"))
        .when(F.col("state") == "UNIFIED", F.col("_unified"))
        .otherwise("")
    )
    kind = F.when(by_type, F.col("typed_predicate")).when(F.col("state") == "TYPED", F.col("_types")).otherwise("")
    return rows.select(
        "qid", "question", "state", F.when(by_type, F.col("typed_subject")).otherwise(F.col("focus")).alias("focus"), answer.alias("answer"), kind.alias("predicate_type")
    )


def _of_state(state: Column, i: int) -> Column:
    pairs = [F.lit(x) for name, row in DISPATCH.items() for x in (name, row[i])]
    return F.create_map(*pairs)[state]


def dispatch(states: DataFrame) -> DataFrame:
    """Action and route of each state; an unknown state is an error."""
    bad = F.raise_error(F.concat(F.lit("unsupported knowledge state: "), F.col("state")))
    return states.withColumn("action", F.coalesce(_of_state(F.col("state"), 0), bad)).withColumn("route", _of_state(F.col("state"), 1))


def apply_truth(dispatched: DataFrame, truth: DataFrame) -> DataFrame:
    """The dispatch after the truth policy, and runtime_status and warning. truth: concept, truth, reason, correction.

    The concept is compared in lower case; without a record the truth is UNVERIFIED.
    """
    record = truth.select(F.lower("concept").alias("_low"), "truth", F.col("reason").alias("_reason"), F.coalesce("correction", F.lit("")).alias("_fix"))
    rows = dispatched.join(record, F.lower("focus") == F.col("_low"), "left").withColumn("truth", F.coalesce("truth", F.lit("UNVERIFIED")))
    wrong = F.col("truth").isin("FALSE", "OUTDATED")
    fixed = wrong & (F.col("_fix") != "")
    label = F.when(F.col("truth") == "FALSE", "false").otherwise("outdated")
    status = (
        F.when(F.col("truth") == "TRUE", "PASS").when(fixed, "CORRECTED").when(wrong, "BLOCK").when(F.col("truth").isin("UNVERIFIED", "CONTESTED"), "WARN")
        .otherwise(F.raise_error(F.concat(F.lit("unsupported truth state: "), F.col("truth"))))
    )
    warning = (
        F.when(F.col("truth") == "TRUE", "")
        .when(F.col("truth") == "UNVERIFIED", "knowledge is unverified")
        .when(F.col("truth") == "CONTESTED", F.concat(F.lit("knowledge is contested"), F.when(F.coalesce("_reason", F.lit("")) != "", F.concat(F.lit(": "), "_reason")).otherwise("")))
        .when(fixed, F.concat(F.lit("original knowledge is "), label, F.lit("; stored correction applied")))
        .otherwise(F.concat(F.lit("knowledge is "), label))
    )
    return (
        rows.withColumn("runtime_status", status)
        .withColumn("warning", warning)
        .withColumn("action", F.when(fixed, "RETRIEVE").when(wrong, "BLOCK").otherwise(F.col("action")))
        .withColumn("route", F.when(fixed, "truth-state correction").when(wrong, "truth-state block").otherwise(F.col("route")))
        .withColumn("answer", F.when(fixed, F.col("_fix")).when(wrong, "").otherwise(F.col("answer")))
        .drop("_low", "_reason", "_fix")
    )


def facade(
    questions: DataFrame,
    propositions: DataFrame,
    canonical: DataFrame,
    unified: DataFrame,
    internalized: DataFrame,
    corpus_counts: DataFrame,
    truth: DataFrame,
    least_occurrences: int = 2,
) -> DataFrame:
    """The cascade, its dispatch and the truth overlay, after the rule on bare concepts.

    A question that is only a concept some store knows is routed as `Xとは`; one that no store knows is UNKNOWN at once
    (`bare_blocked`), raw text or not, unless it is a name one may simply say. UNKNOWN and NON_CONCEPT get no overlay:
    their truth, runtime_status and warning are null. `question` is the routed one. Stores as in `resolve_states`.
    """
    exact = propositions.select("subject").union(unified.where(F.trim("assistant") != "").select("concept")).distinct().toDF("_exact")
    low = canonical.where("answer <> ''").select(F.lower("concept")).union(internalized.select(F.lower("concept"))).distinct().toDF("_low")
    rows = questions.select("qid", "question", grammar.bare_concept(F.col("question")).alias("bare"))
    rows = rows.join(exact, F.col("bare") == F.col("_exact"), "left").join(low, F.lower("bare") == F.col("_low"), "left")
    bare = F.col("bare") != ""
    known = bare & (F.col("_exact").isNotNull() | F.col("_low").isNotNull())
    blocked = bare & ~known & ~F.lower("bare").isin(*grammar.BARE_ALLOWED)
    rows = rows.select("qid", F.when(known, F.concat("bare", F.lit("とは"))).otherwise(F.col("question")).alias("question"), "bare", blocked.alias("bare_blocked"))
    asked = rows.where("not coalesce(bare_blocked, false)").select("qid", "question")
    found = resolve_states(asked, propositions, canonical, unified, internalized, corpus_counts, least_occurrences)
    empty = F.lit("")
    gone = rows.where("bare_blocked").select(
        "qid", "question", F.lit("UNKNOWN").alias("state"), F.col("bare").alias("focus"), empty.alias("answer"), empty.alias("predicate_type"), "bare_blocked"
    )
    states = dispatch(found.withColumn("bare_blocked", F.lit(False)).unionByName(gone))
    overlaid = (F.col("_focus") != "") & (F.col("state") != "UNKNOWN")
    rows = states.withColumn("_focus", F.col("focus")).withColumn("focus", F.when(overlaid, F.col("focus")))
    rows = apply_truth(rows, truth).withColumn("focus", F.col("_focus"))
    return rows.withColumns({c: F.when(overlaid, F.col(c)) for c in ("truth", "runtime_status", "warning")}).drop("_focus")


def unknown_gate(questions: DataFrame, known: DataFrame, corpus_counts: DataFrame, least_occurrences: int = 2) -> DataFrame:
    """Qid, focus and unknown, before anything is generated.

    known: concept, of any case. Questions without a concept, or about persons, pass. A concept that is not known is
    unknown, unless it was asked for explicitly and raw text holds it often enough (corpus_counts: concept, n).
    """
    rows = questions.select("qid", grammar.concept_focus(F.col("question")).alias("asked"), grammar.bare_focus(F.col("question")).alias("bare"))
    rows = rows.withColumn("focus", F.when(F.col("asked") != "", F.col("asked")).otherwise(F.col("bare")))
    rows = rows.join(known.select(F.lower("concept").alias("_low")).distinct(), F.lower("focus") == F.col("_low"), "left")
    counts = corpus_counts.groupBy(F.col("concept").alias("focus")).agg(F.max("n").alias("_n"))
    rows = rows.join(counts, "focus", "left")
    passes = (F.col("focus") == "") | F.col("focus").isin(*grammar.PERSONS) | F.col("_low").isNotNull()
    often = (F.col("asked") != "") & (F.coalesce("_n", F.lit(0)) >= max(1, least_occurrences))
    return rows.select("qid", "focus", F.coalesce(~passes & ~often, F.lit(False)).alias("unknown"))


def provenance(state: Column, source: Column, origin: Column) -> Column:
    """Struct (source, origin, priority, compact)."""
    priority = F.coalesce(_of_state(state, 2), F.lit(999))
    dash = lambda c: F.when(c == "", "-").otherwise(c)
    compact = F.concat_ws(", ", F.concat(F.lit("source="), dash(source)), F.concat(F.lit("origin="), dash(origin)), F.concat(F.lit("priority="), priority.cast("string")))
    return F.struct(source.alias("source"), origin.alias("origin"), priority.alias("priority"), compact.alias("compact"))


def answer_conditional(questions: DataFrame, facts: DataFrame) -> DataFrame:
    """Qid, question, answer: the ordered distinct predicates of the fact asked for; empty without one.

    facts: subject, condition, predicate, condition_polarity, ord; only positive ones answer.
    """
    asked = questions.withColumn("_s", surface(F.col("question"))).withColumn("q", grammar.conditional_query(F.col("_s"))).select("qid", "question", "q.subject", "q.condition")
    key = F.concat_ws("\x01", "subject", "condition")
    found = grouped_values(facts.where("condition_polarity").withColumn("_key", key), "_key", "predicate")
    rows = asked.withColumn("_key", F.when(F.col("subject").isNotNull(), key)).join(found, "_key", "left")
    said = F.concat("subject", F.lit("は、"), "condition", F.lit("の場合、"), F.array_join("values", "、"), F.lit("。"))
    return rows.select("qid", "question", F.coalesce(said, F.lit("")).alias("answer"))
