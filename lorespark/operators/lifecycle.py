"""Lifecycles: logs of events, folded to states in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import folded


def fold_states(events: DataFrame, key: str, action: str, moves: dict[tuple[str, str], str], start: str, order: str = "ord") -> DataFrame:
    """Key, status, n_changes. moves maps (state, action) to the next state; other actions change nothing. A long
    log is folded in many tasks (see ranges.folded)."""
    return folded(events, key, action, moves, start, order)


#: L4: a queued concept is promoted, then verified; verification can be revoked.
QUEUE_MOVES = {("pending", "promote"): "promoted", ("promoted", "verify"): "verified", ("verified", "revoke"): "promoted"}
#: A verification task; a new failure reopens it.
VERIFICATION_MOVES = {
    ("pending", "retrain"): "retrain",
    ("retrain", "fail"): "failed",
    ("failed", "retrain"): "retrain",
    ("pending", "verify"): "verified",
    ("retrain", "verify"): "verified",
    ("failed", "verify"): "verified",
    ("verified", "fail"): "pending",
}


def verification_tasks(events: DataFrame, key: str = "concept", action: str = "action", order: str = "ord") -> DataFrame:
    """Status of each task, and its attempts (how often it failed)."""
    folded = fold_states(events, key, action, VERIFICATION_MOVES, "pending", order)
    attempts = events.groupBy(key).agg(F.count_if(F.col(action) == "fail").alias("attempts"))
    return folded.join(attempts, key).select(key, "status", "attempts")


def queue_candidates(new: DataFrame, stored: DataFrame, pending: DataFrame, keys: list[str], is_question: Column) -> DataFrame:
    """Candidates that are no questions, not stored, not pending, once each (the first)."""
    from .stores import first_per_key

    fresh = new.where(~is_question).join(stored.select(*keys), keys, "left_anti").join(pending.select(*keys), keys, "left_anti")
    return first_per_key(fresh, *keys)


def strongest_status(df: DataFrame, key: str, status: str, ranks: dict[str, int]) -> DataFrame:
    """Legacy `resolved` rows take the strongest status of their key, `pending` without one."""
    rank = F.create_map(*[F.lit(x) for kv in ranks.items() for x in kv])
    best = df.where(F.col(status) != "resolved").groupBy(key).agg(F.max_by(status, rank[F.col(status)]).alias("_best"))
    moved = F.when(F.col(status) == "resolved", F.coalesce("_best", F.lit("pending"))).otherwise(F.col(status))
    return df.join(best, key, "left").withColumn(status, moved).drop("_best")


def approve(candidates: DataFrame, order: str, status: str, index: int | None = None) -> DataFrame:
    """All pending candidates, or the index-th (from 1) in order, become approved; beyond the last nothing changes."""
    pending = F.col(status) == "pending"
    if index is None:
        return candidates.withColumn(status, F.when(pending, "approved").otherwise(F.col(status)))
    if index < 1:
        return candidates
    chosen = candidates.where(pending).orderBy(order).offset(index - 1).limit(1).select(F.col(order).alias("_chosen"))
    held = candidates.join(F.broadcast(chosen), F.col(order) == F.col("_chosen"), "left")  # one row at most
    return held.withColumn(status, F.when(F.col("_chosen").isNotNull(), "approved").otherwise(F.col(status))).drop("_chosen")
