"""Runs of gates over tables of generated answers, and the two-pass resolution of functions. What a model generates comes in
as rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammar, propositions, text
from . import metrics
from .stores import grouped_values

#: Least semantic similarity, lexical coverage and required coverage.
LIMITS = (0.8, 0.35, 0.5)


def probe_verdicts(probes: DataFrame, limits: tuple[float, float, float] = LIMITS) -> DataFrame:
    """Probes (concept, teacher, generated, semantic and others) with lexical, required, contradiction, passed, reason.

    Every failure of fidelity (M7, R17) is named; an answer without one fails only if it is malformed. semantic is the
    similarity of the two texts' vectors, computed before."""
    fidelity = metrics.composite_fidelity(F.col("semantic"), F.col("generated"), F.col("teacher"), F.col("concept"))
    rows = probes.withColumn("_f", fidelity).withColumn("_bad", grammar.malformed(F.col("generated")))
    said = metrics.fidelity_failures(F.col("_f.semantic"), F.col("_f.lexical"), F.col("_f.required"), F.col("_f.contradiction"), limits)
    rows = rows.withColumn("_said", said).withColumn("_fits", F.endswith("_said", F.lit("fidelity passed")))
    reason = F.when(F.col("_fits") & F.col("_bad"), "malformed/repetitive output").otherwise(F.col("_said"))
    return rows.select(*probes.columns, "_f.lexical", "_f.required", "_f.contradiction", (F.col("_fits") & ~F.col("_bad")).alias("passed"), reason.alias("reason"))


def gate_summary(verdicts: DataFrame, *keys: str, needs_probes: bool = True) -> DataFrame:
    """Targets, passed, failed and ok of a run (by keys: of each run). A run of the repair gate needs probes to be ok,
    one of the preservation gate does not."""
    rows = verdicts.groupBy(*keys).agg(F.count("*").alias("targets"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    return rows.withColumn("ok", (F.col("failed") == 0) & ((F.col("targets") > 0) | F.lit(not needs_probes)))


def agreement_threshold(intent: Column, semantic_ok: Column, coverage: Column, base: float, relaxed: float = 0.30) -> Column:
    """Agreement that an answer needs; less where its structure is verified already."""
    verified = semantic_ok & (coverage >= 1.0) & intent.isin("definition", "comparison")
    return F.when(verified, min(base, relaxed)).otherwise(base)


def two_pass_functions(subjects: DataFrame, memory: DataFrame, generations: DataFrame, composed: DataFrame) -> DataFrame:
    """Subject, evidence, items, memory_hit, answer, used_fallback of every subject (distinct).

    memory: subject, evidence; generations: subject, ord, generated (first pass); composed: subject, generated (second
    pass). Evidence is what the memory has, then distinct usable generations in order, joined ` / `. The composed answer
    counts if it is usable, else the slots that the evidence gives are rendered. Without evidence all of it is null.
    """
    clean = lambda c: text.collapse(F.coalesce(F.col(c), F.lit("")))
    known = memory.select("subject", clean("evidence").alias("value")).where("value <> ''").select("subject", "value", F.lit(-1).cast("long").alias("ord"))
    usable = generations.select("subject", clean("generated").alias("value"), F.col("ord").cast("long").alias("ord")).where("value <> ''")
    usable = usable.where(~grammar.malformed(F.col("value")))
    items = grouped_values(known.unionByName(usable), "subject", "value")
    said = composed.select("subject", clean("generated").alias("said")).where("said <> ''").where(~grammar.malformed(F.col("said")))
    rows = subjects.select("subject").join(items, "subject", "left").join(known.select("subject", F.lit(True).alias("hit")), "subject", "left").join(said, "subject", "left")
    rows = rows.withColumn("evidence", F.array_join("values", " / "))
    fallback = propositions.rendered_function(F.col("subject"), F.col("evidence"))
    has = F.col("evidence").isNotNull()
    return rows.select(
        "subject",
        "evidence",
        F.size("values").alias("items"),
        F.coalesce("hit", F.lit(False)).alias("memory_hit"),
        F.when(has, F.coalesce("said", fallback)).alias("answer"),
        F.when(has, F.col("said").isNull()).alias("used_fallback"),
    ).withColumn("items", F.when(has, F.col("items")).otherwise(0))
