"""Deterministic samples and group-aware splits, by hashes of keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.sources.scratch import dense_index

#: Groups whose first rank is broadcast; more are joined.
BROADCAST_GROUPS = 100_000


def spread(key: Column, seed: int = 42) -> Column:
    """An arithmetic hash in [0, 1000003) that any SQL engine can compute."""
    return (key * 7919 + seed) % 1000003


def group_split(groups: DataFrame, key: str, order: Column, ratios: tuple[float, float, float]) -> DataFrame:
    """Each group (one row) as train, val or test: rounded shares, one group of train at least."""
    if abs(sum(ratios) - 1) > 1e-6:
        raise ValueError("the ratios must sum to 1")
    n = F.lit(groups.count())
    train = F.greatest(F.lit(1), F.round(n * ratios[0]).cast("int"))
    val = F.least(F.round(n * ratios[1]).cast("int"), n - train)
    ranked = dense_index(groups, order, key, name="_k")
    return ranked.withColumn("part", F.when(F.col("_k") < train, "train").when(F.col("_k") < train + val, "val").otherwise("test")).drop("_k")


def sample_per_group(df: DataFrame, group: str, order: list[Column], ratio: float) -> DataFrame:
    """int(n * ratio) rows of each group, without replacement; ranks are global, so a hot group is no hot task."""
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must be between 0 and 1")
    at = dense_index(df, group, *order, name="_index")
    groups = at.groupBy(group).agg(F.min("_index").alias("_first"), F.count("*").alias("_n"))
    groups = groups.withColumnRenamed(group, "_group")
    if groups.count() <= BROADCAST_GROUPS:
        groups = F.broadcast(groups)
    inside = F.col(group).eqNullSafe(F.col("_group")) & (F.col("_index") >= F.col("_first"))
    return at.join(groups, inside).where(F.col("_index") - F.col("_first") < F.floor(F.col("_n") * ratio)).select(*df.columns)


def bernoulli(df: DataFrame, key: str, ratio: float, seed: int = 42) -> DataFrame:
    return df.where(spread(F.col(key), seed) < 1000003 * ratio)


def select_shards(manifest: DataFrame, key: str, rows: str, ratio: float, seed: int = 42) -> tuple[DataFrame, dict[str, int]]:
    """Shards that a hash keeps with this probability, and the totals (shards, rows) of them; none is an error."""
    kept = bernoulli(manifest, key, ratio, seed)
    found = kept.agg(F.count("*").alias("shards"), F.coalesce(F.sum(rows), F.lit(0)).alias("rows")).first().asDict()
    if not found["shards"]:
        raise ValueError(f"a ratio of {ratio} keeps no shard")
    return kept, found


def fixed_sample(df: DataFrame, key: str, ratio: float, least: int = 0) -> DataFrame:
    """int(n * ratio) rows of the whole table, so many at least, in order of a hash of the key."""
    if not 0 <= ratio <= 1:
        raise ValueError("the ratio must be between 0 and 1")
    n = max(least, int(df.count() * ratio))
    at = dense_index(df.withColumn("_hash", spread(F.col(key))), "_hash", key, name="_rank")
    return at.where(F.col("_rank") < n).drop("_hash", "_rank")
