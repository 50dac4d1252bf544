"""Keyed stores: every table carries `ord`, the source order that first-wins and last-wins rules refer to."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranges import positions


def first_per_key(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Of each key the row that comes first. An aggregation, so each partition keeps one row a key before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def last_per_key(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """Of each key the row that comes last."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, "_row.*").select(*df.columns)


def last_value_first_place(df: DataFrame, *keys: str, order: str = "ord") -> DataFrame:
    """W2 as a rewrite in place: the last row's values at the first row's place."""
    places = df.groupBy(*keys).agg(F.min(order).alias("_first"))
    return last_per_key(df, *keys, order=order).join(places, list(keys)).withColumn(order, F.col("_first")).select(*df.columns)


def best_per_key(df: DataFrame, key: str, priority: str, order: str = "ord") -> DataFrame:
    """The highest priority wins; of equal ones the first."""
    rest = [c for c in df.columns if c != key]
    picked = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(priority), -F.col(order))).alias("_row"))
    return picked.select(key, "_row.*").select(*df.columns)


def grouped_values(df: DataFrame, key: str, value: str, order: str = "ord") -> DataFrame:
    """A1: key and its distinct values in order."""
    once = df.groupBy(key, value).agg(F.min(order).alias(order))
    lists = once.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, value))).alias("_rows"))
    return lists.select(key, F.transform("_rows", lambda r: r[value]).alias("values"))


def insert_absent(store: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """New rows whose key the store lacks are added; the store's rows stay."""
    return store.unionByName(new.join(store.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(store: DataFrame, new: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """L1, L2: a new row takes the place of the first row with its key, later ones go; unknown keys are appended."""
    latest = last_per_key(new, key, order=order)
    places = store.groupBy(key).agg(F.min(order).alias("_place"))
    end = store.agg(F.coalesce(F.max(order), F.lit(-1)).alias("_end"))  # one row
    put = (
        latest.join(places, key, "left")
        .join(F.broadcast(end))
        .withColumn(order, F.coalesce("_place", F.col("_end") + 1 + F.col(order)))
        .select(*store.columns)
    )
    return store.join(latest.select(key), key, "left_anti").unionByName(put)


def upsert_truth(store: DataFrame, new: DataFrame, key: str = "concept", order: str = "ord") -> DataFrame:
    """L2: upsert by the key in lower case; the record that takes the place brings its own spelling."""
    low = F.lower(F.trim(F.col(key)))
    return upsert(store.withColumn("_low", low), new.withColumn("_low", low), "_low", order).drop("_low")


def status_counts(df: DataFrame, status: str, known: list[str], *keys: str) -> DataFrame:
    """A column for each known status, and `other` and `total`."""
    counts = [F.count_if(F.col(status) == s).alias(s) for s in known]
    other = F.count_if(~F.coalesce(F.col(status), F.lit("")).isin(*known)).alias("other")
    return df.groupBy(*keys).agg(*counts, other, F.count("*").alias("total"))


def pending_pairs(pairs: DataFrame, trained: DataFrame, logged: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Pairs that are neither trained nor logged."""
    return pairs.join(trained.select(key), key, "left_anti").join(logged.select(key), key, "left_anti")


def membership(pairs: DataFrame, trained: DataFrame, state: DataFrame, key: str = "fingerprint") -> DataFrame:
    """Each pair as `historical` (in both sets) or `pending`."""
    a = trained.select(key).distinct().withColumn("_a", F.lit(True))
    b = state.select(key).distinct().withColumn("_b", F.lit(True))
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    return pairs.join(a, key, "left").join(b, key, "left").withColumn("membership", F.when(both, "historical").otherwise("pending")).drop("_a", "_b")


def numbered(df: DataFrame, order: list, prefix: str, width: int = 3) -> DataFrame:
    """Ids prefix-001 and so on in order; wider where a number has more digits. Exact ranks of two levels."""
    number = F.col("_number").cast("string")
    rows = positions(df, [], order, "_number")
    return rows.withColumn("row_id", F.concat(F.lit(prefix + "-"), F.lpad(number, F.greatest(F.lit(width), F.length(number)), F.lit("0")))).drop("_number")
