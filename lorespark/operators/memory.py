"""Semantic memory: registries, evidence, queues and snapshots over keyed stores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import grammar, text
from .stores import first_per_key, grouped_values, last_per_key

# Which sources count as trusted, by who asks (the lists differ; see trust_policies).
TRUST = {
    "internalized": ("manual", "approved", "chat-recovery", "semantic-sleep"),
    "baseline": ("manual", "approved"),
    "log": ("manual", "approved", "chat-recovery"),
    "trainer": ("manual", "approved", "chat-recovery", "semantic-sleep"),
}


def trusted(df: DataFrame, policy: str, source: str = "source") -> DataFrame:
    """rows whose source the policy trusts."""
    return df.where(F.col(source).isin(*TRUST[policy]))


def typed_map(df: DataFrame, subject: str = "subject", value: str = "value", order: str = "ord") -> DataFrame:
    """A2: subject and a map from predicate type to its distinct values in order."""
    rows = df.withColumn("_type", grammar.predicate_type_of(F.col(value)))
    once = rows.groupBy(subject, "_type", value).agg(F.min(order).alias(order))
    lists = once.groupBy(subject, "_type").agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_l"))
    lists = lists.withColumn("_v", F.transform("_l", lambda r: r[value]))
    return lists.groupBy(subject).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("_type", "_v")))).alias("by_type"))


def registry(records: DataFrame, concept: str = "concept", order: str = "ord") -> DataFrame:
    """A5: a row for each concept: the latest question and source, its fingerprints and sources in order, the count."""
    prints = grouped_values(records, concept, "fingerprint", order).withColumnRenamed("values", "fingerprints")
    sources = grouped_values(records, concept, "source", order).withColumnRenamed("values", "sources")
    latest = last_per_key(records.select(concept, order, F.col("question").alias("latest_question"), F.col("source").alias("latest_source")), concept, order=order)
    counted = records.groupBy(concept).agg(F.count("*").alias("trained_pairs"))
    return latest.drop(order).join(prints, concept).join(sources, concept).join(counted, concept)


def corpus_memory(records: DataFrame, subject: str = "subject", order: str = "ord") -> DataFrame:
    """Of each subject the distinct statements joined ` / `, its relations and sources, the first relation."""
    part = lambda c, name: grouped_values(records, subject, c, order).withColumnRenamed("values", name)
    rows = part("statement", "statements").join(part("relation", "relations"), subject).join(part("source", "sources"), subject)
    return rows.select(
        F.col(subject).alias("concept"),
        F.array_join("statements", " / ").alias("evidence"),
        "relations",
        "sources",
        F.get("relations", F.lit(0)).alias("dominant_relation"),
        text.pair_fingerprint(F.concat(F.col(subject), F.lit("とは")), F.array_join("statements", " / ")).alias("fingerprint"),
    )


def canonical_rows(df: DataFrame, priorities: dict[str, int], overrides: dict[str, str] | None = None) -> DataFrame:
    """Of each prompt key the row of the highest (source priority, line); overrides, by raw prompt, replace the
    answer. Columns user, assistant, source, ord; adds key and variants, the distinct answers of the key."""
    rank = F.create_map(*[F.lit(x) for kv in priorities.items() for x in kv])
    rows = df.withColumns({"key": text.prompt_key(F.col("user")), "_p": F.coalesce(rank[F.col("source")], F.lit(0))})
    best = rows.groupBy("key").agg(
        F.max_by(F.struct("user", "assistant", "source", "ord"), F.struct("_p", "ord")).alias("b"), F.countDistinct("assistant").alias("variants")
    )
    best = best.select("key", "b.*", "variants")
    if overrides:
        fixed = F.create_map(*[F.lit(x) for kv in overrides.items() for x in kv])
        best = best.withColumn("assistant", F.coalesce(fixed[F.col("user")], F.col("assistant")))
    return best


def repair_plan(tasks: DataFrame) -> DataFrame:
    """Active tasks (pending, retrain) with all fields, once for each fingerprint, in order."""
    full = (F.col("concept") != "") & (F.col("question") != "") & (F.col("teacher_answer") != "") & (F.col("fingerprint") != "")
    return first_per_key(tasks.where(F.col("status").isin("pending", "retrain") & full), "fingerprint")


def route_once(queue: DataFrame, new: DataFrame) -> DataFrame:
    """New route rows whose fingerprint (of resolution, reason and question) the queue lacks, whatever its status."""
    sign = text.pair_fingerprint(F.concat("resolution", F.lit("|"), "reason"), F.col("user"))
    fresh = first_per_key(new.withColumn("fingerprint", sign), "fingerprint")
    return fresh.join(queue.select("fingerprint"), "fingerprint", "left_anti").withColumn("status", F.lit("pending"))


def resolve_routes(queue: DataFrame, answered: DataFrame) -> DataFrame:
    """Rows with an answered (resolution, question) become resolved; questions are compared as queue keys."""
    done = answered.select("resolution", text.queue_key(F.col("user")).alias("_k")).distinct().withColumn("_done", F.lit(True))
    rows = queue.withColumn("_k", text.queue_key(F.col("user"))).join(done, ["resolution", "_k"], "left")
    return rows.withColumn("status", F.when(F.col("_done") & (F.col("status") != "resolved"), "resolved").otherwise(F.col("status"))).drop("_k", "_done")


def snapshot(concepts: DataFrame, propositions: DataFrame, unified: DataFrame, internalized: DataFrame, truth: DataFrame) -> DataFrame:
    """What every layer knows of a concept, side by side."""
    typed = typed_map(propositions).withColumnRenamed("subject", "concept")
    memory = first_per_key(unified, "concept").select("concept", F.col("assistant").alias("unified"))
    state = truth.select(F.lower("concept").alias("_low"), "truth")
    trained = internalized.select(F.lower("concept").alias("_low"), F.lit(True).alias("internalized")).distinct()
    rows = concepts.join(typed, "concept", "left").join(memory, "concept", "left").withColumn("_low", F.lower("concept"))
    rows = rows.join(trained, "_low", "left").join(state, "_low", "left").drop("_low")
    return rows.withColumns({"internalized": F.coalesce("internalized", F.lit(False)), "truth": F.coalesce("truth", F.lit("UNVERIFIED"))})


def retrieval_first(questions: DataFrame, memory: DataFrame, truth: DataFrame) -> DataFrame:
    """Qid, answer, relation and, for functions, the slots of a subject that the memory has; subjects known as false,
    outdated or contested are passed over."""
    asked = questions.withColumn("concept", grammar.query_focus(F.col("question")))
    barred = truth.where(F.col("truth").isin("FALSE", "OUTDATED", "CONTESTED")).select(F.lower("concept").alias("_low"))
    asked = asked.join(barred, F.lower("concept") == F.col("_low"), "left_anti")
    found = asked.join(memory.select("concept", "evidence", "dominant_relation"), "concept")
    slots = F.when(F.col("dominant_relation") == "function", grammar.function_slots(F.col("evidence")))
    return found.select("qid", F.col("evidence").alias("answer"), F.col("dominant_relation").alias("relation"), slots.alias("slots"))


def subset_missing(production: DataFrame, candidate: DataFrame, key: str = "fingerprint") -> DataFrame:
    """U4: keys of the production side that a candidate lacks; must be empty."""
    return production.select(key).distinct().join(candidate.select(key), key, "left_anti")


def rescored(loss: Column) -> Column:
    """Perplexity of a mean loss, bounded."""
    return F.exp(F.least(loss, F.lit(20.0)))


def token_scores(tokens: DataFrame, *keys: str) -> DataFrame:
    """A13, A14, M9 over rows (loss, rank, p, p2): mean loss, perplexity, accuracy, mean and least confidence, margin."""
    return tokens.groupBy(*keys).agg(
        F.avg("loss").alias("mean_loss"),
        rescored(F.avg("loss")).alias("perplexity"),
        F.avg((F.col("rank") == 1).cast("double")).alias("accuracy"),
        F.avg("p").alias("mean_confidence"),
        F.min("p").alias("min_confidence"),
        F.avg(F.col("p") - F.col("p2")).alias("mean_margin"),
    )
