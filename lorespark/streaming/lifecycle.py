"""The lifecycle fold over a stream: the same moves as the batch fold, in the order of arrival or of event time."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_states(events: DataFrame, key: str, action: str, moves: dict[tuple[str, str], str], start: str, order: str = "ord") -> DataFrame:
    """A row (key, status, n_changes) for each key that a micro-batch touches. Rows of a batch are taken in `order`."""

    def fold(names: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, changes = state.get if state.exists else (start, 0)
        rows = pd.concat(list(batches)).sort_values(order)
        for step in rows[action]:
            to = moves.get((status, step), status)
            changes += to != status
            status = to
        state.update((status, changes))
        yield pd.DataFrame({key: [names[0]], "status": [status], "n_changes": [changes]})

    kind = events.schema[key].dataType.simpleString()
    return events.groupBy(key).applyInPandasWithState(
        fold, f"{key} {kind}, status string, n_changes long", "status string, n_changes long", "update", GroupStateTimeout.NoTimeout
    )


def stream_states_in_order(
    events: DataFrame,
    key: str,
    action: str,
    moves: dict[tuple[str, str], str],
    start: str,
    time: str,
    order: str,
    late: str = "1 hour",
    idle: int | None = None,
) -> DataFrame:
    """A row (key, status, n_changes, until) whenever events of a key have been folded, in the order of (time, order).

    Rows may come in any order, up to `late` behind the newest: a key's state keeps those that the watermark has not passed,
    as times and numbered actions, and folds them once it has; later rows are dropped by Spark. So the last row of a key is
    what the batch fold gives for all its rows up to `until`, however the stream was cut into batches. Actions without a
    move are not kept. idle: seconds after its last event at which a key is forgotten; it then starts anew.
    """
    names = sorted({a for _, a in moves})
    number = {a: i for i, a in enumerate(names)}
    kind = events.schema[key].dataType.simpleString()

    def fold(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, changes, until, times, places, steps = state.get if state.exists else (start, 0, 0, [], [], [])
        waiting = list(zip(times, places, steps))
        if not state.hasTimedOut:
            for rows in batches:
                known = rows[rows["_step"].isin(number)]
                at = known["_time"].astype("int64")
                waiting += zip(at.tolist(), known["_order"].tolist(), known["_step"].map(number).tolist())
        passed = state.getCurrentWatermarkMs() * 1000
        waiting.sort()
        folded = 0
        for at, _, step in waiting:
            if at > passed:
                break
            to = moves.get((status, names[step]), status)
            changes, status, until, folded = changes + (to != status), to, at, folded + 1
        waiting = waiting[folded:]
        done = idle is not None and not waiting and until + idle * 1_000_000 <= passed
        if done:
            state.remove()
        else:
            state.update((status, changes, until, [w[0] for w in waiting], [w[1] for w in waiting], [w[2] for w in waiting]))
            wake = waiting[0][0] if waiting else until + idle * 1_000_000 if idle is not None else None
            if wake is not None:
                state.setTimeoutTimestamp(max(wake // 1000, state.getCurrentWatermarkMs()) + 1)
        if folded:
            yield pd.DataFrame({key: [group[0]], "status": [status], "n_changes": [changes], "until": [pd.Timestamp(until, unit="us")]})

    rows = events.select(F.col(key), F.col(time).alias("_at"), F.unix_micros(F.col(time)).alias("_time"), F.col(order).cast("long").alias("_order"), F.col(action).alias("_step"))
    return (
        rows.withWatermark("_at", late)
        .groupBy(key)
        .applyInPandasWithState(
            fold,
            f"{key} {kind}, status string, n_changes long, until timestamp",
            "status string, n_changes long, until long, times array<long>, places array<long>, steps array<int>",
            "update",
            GroupStateTimeout.EventTimeTimeout,
        )
    )
