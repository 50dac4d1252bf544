"""Does an answer fit its question? Ordered checks; the first that decides gives the verdict and its reason."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import gates, grammar
from ..functions.propositions import COMPARISON_CUES, echoes
from ..functions.text import let, similarity_key
from . import metrics
from .ranges import positions

# What an answer to a greeting says.
GREETING_TERMS = ("こんにちは", "こんばんは", "おはよう", "お疲れ", "はじめまして", "よろしく", "話しましょう", "何について", "hello", "hi")


def greeting_consistent(answer: Column) -> Column:
    """does the answer hold a word of greeting?"""
    return F.lower(answer).rlike("|".join(GREETING_TERMS))


def slot_evidence(slot: Column, answer: Column, categories: Column) -> Column:
    """Of a slot: `slot:lexical` if the answer holds it or an alias, `slot:category(c)` for the first category of its
    definition that the answer names (categories: whether they count), else `slot:miss`."""

    def by_category(named: Column) -> Column:
        hit = F.concat(slot, F.lit(":category("), F.get(named, F.lit(0)), F.lit(")"))
        return F.when(categories & (F.size(named) > 0), hit).otherwise(F.concat(slot, F.lit(":miss")))

    known = F.coalesce(gates._looked_up(gates.CATEGORIES, F.lower(slot)), gates._strings(()))
    key = similarity_key(answer)
    named = F.filter(known, lambda c: key.contains(similarity_key(c)))
    return F.when(gates.slot_present(slot, answer), F.concat(slot, F.lit(":lexical"))).otherwise(let(named, by_category))


def decided(question: Column, answer: Column) -> Column:
    """What question and answer alone say: struct (intent, slots, ok, reason, coverage, final). final: nothing that follows
    can change it; ok is then the verdict. Else the reason stands unless the history speaks against it."""

    def judge(row: Column) -> Column:
        q, missing = row["q"], row["missing"]
        name, slots = q["intent"], q["slots"]
        slot = F.get(slots, F.lit(0))

        def said(ok, reason, coverage, final) -> Column:
            parts = {"ok": ok, "reason": reason, "coverage": coverage, "final": final}
            return F.struct(name.alias("intent"), slots.alias("slots"), *[(c if isinstance(c, Column) else F.lit(c)).alias(n) for n, c in parts.items()])

        def by_slots(evidence: Column) -> Column:
            lexical = F.size(F.filter(evidence, lambda e: F.endswith(e, F.lit(":lexical"))))
            held = F.size(F.filter(evidence, lambda e: ~F.endswith(e, F.lit(":miss"))))
            total = F.size(slots)
            listed = F.array_join(evidence, ", ")
            defines, compares = name == "definition", name == "comparison"
            return (
                F.when(defines & echoes(gates.synonyms(slot), answer), said(False, "definition answer is only an echo", lexical / total, True))
                .when(defines & gates.uninformative(slot, answer), said(False, "definition answer is uninformative", lexical / total, True))
                .when(defines & (lexical == total), said(True, "definition slot covered", 1.0, False))
                .when(compares & (lexical == total) & answer.rlike(COMPARISON_CUES), said(True, "comparison slots covered", 1.0, False))
                .when(held == total, said(True, F.concat(F.lit("concept-aware slots: "), listed), 1.0, False))
                .otherwise(said(False, F.concat(F.lit("concept slot missing: "), listed), held / total, True))
            )

        evidence = F.transform(slots, lambda s: slot_evidence(s, answer, name == "definition"))
        greets = greeting_consistent(answer)
        return (
            F.when(F.size(missing) > 0, said(False, F.concat(F.lit("unknown entity missing: "), F.array_join(missing, ", ")), 0.0, True))
            .when(name == "greeting", F.when(greets, said(True, "greeting matched", 1.0, True)).otherwise(said(False, "greeting intent mismatch", 0.0, True)))
            .when(F.size(slots) == 0, said(True, "no required slots", 1.0, False))
            .otherwise(let(evidence, by_slots))
        )

    missing = F.filter(gates.suspicious_entities(question), lambda e: ~F.lower(answer).contains(F.lower(e)))
    return let(F.struct(grammar.intent(question).alias("q"), missing.alias("missing")), judge)


def consistency_gate(
    turns: DataFrame,
    margin: float = 0.05,
    alike: float = 0.82,
    history: int = 3,
    similarity: Callable[[Column, Column], Column] = metrics.jaccard,
    conv: str = "conv_id",
    turn: str = "turn",
) -> DataFrame:
    """Conv, turn, ok, reason, intent, slots, coverage, current_sim, previous_best of every turn (conv, turn, question,
    answer; turns of a conversation are distinct). Null questions and answers count as empty.

    Checks in order: identifiers of the question that the answer lacks; a greeting; a definition that only echoes or says
    nothing; slots by word or category; then whether an earlier question of the `history` last ones, itself less than
    `alike` to this one, is nearer to the answer by more than `margin`. Similarity (a vector model's in the original, given
    as a function of two columns here) is computed only where a check gets there: the history is fetched for the turns that
    are still open, by equality of conversation and position, so that no conversation need fit a task and no pair of turns
    further apart is made. current_sim is 0 where an identifier is missing, previous_best -1 where no history was asked.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = positions(turns.select(conv, turn, text("question"), text("answer")), [conv], [turn], "at")
    rows = rows.withColumn("v", decided(F.col("question"), F.col("answer")))
    no_entity = ~F.startswith("v.reason", F.lit("unknown entity missing"))
    rows = rows.withColumn("current_sim", F.when(no_entity, similarity(F.col("question"), F.col("answer"))).otherwise(0.0))
    back = F.explode(F.sequence(F.lit(1), F.lit(history))).alias("back")
    open_ = rows.where("not v.final").select(conv, "at", "question", "answer", back).where("at > back")
    old = rows.select(conv, F.col("at").alias("old_at"), F.col("question").alias("old"))
    seen = open_.withColumn("old_at", F.col("at") - F.col("back")).join(old, [conv, "old_at"])
    seen = seen.withColumn("to_answer", similarity(F.col("old"), F.col("answer")))
    other = similarity(F.col("old"), F.col("question")) < alike
    best = seen.groupBy(conv, "at").agg(F.max("to_answer").alias("previous"), F.max(F.when(other, F.col("to_answer"))).alias("suspect"))
    rows = rows.join(best, [conv, "at"], "left")
    stained = F.coalesce(F.col("suspect") > F.col("current_sim") + margin, F.lit(False))
    return rows.select(
        conv,
        turn,
        (F.col("v.ok") & ~stained).alias("ok"),
        F.when(stained, "history contamination").otherwise(F.col("v.reason")).alias("reason"),
        "v.intent",
        "v.slots",
        "v.coverage",
        "current_sim",
        F.coalesce("previous", F.lit(-1.0)).alias("previous_best"),
    )
