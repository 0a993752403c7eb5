"""Joins by position and by range."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wavecrest.sources.scratch import dense_index


#: A manifest of so many shards is broadcast; beyond, indices and shards meet in blocks of indices.
BROADCAST_SHARDS, BLOCK = 100_000, 1 << 20


def locate(wanted: DataFrame, index: str, manifest: DataFrame) -> DataFrame:
    """The wanted rows whose index lies in a shard, with the shard's columns; a shard holds the indices from lo up to hi."""
    inside = (F.col("lo") <= F.col(index)) & (F.col(index) < F.col("hi"))
    if manifest.limit(BROADCAST_SHARDS + 1).count() <= BROADCAST_SHARDS:
        return wanted.join(F.broadcast(manifest), inside)
    # an equality on blocks of indices, each shard in all blocks that it reaches
    spread = manifest.where("lo < hi").withColumn("_block", F.explode(F.sequence(F.floor(F.col("lo") / BLOCK), F.floor((F.col("hi") - 1) / BLOCK))))
    return wanted.withColumn("_block", F.floor(F.col(index) / BLOCK)).join(spread, "_block").where(inside).drop("_block")


def positions(df: DataFrame, key: str, order: list[str], name: str = "pos") -> DataFrame:
    """Adds each row's place from 0 in its group; ranks are global, so a hot group is no hot task."""
    at = dense_index(df, key, *order, name="_rank")
    firsts = at.groupBy(key).agg(F.min("_rank").alias("_first")).withColumnRenamed(key, "_key")
    return at.join(firsts, F.col(key).eqNullSafe(F.col("_key"))).withColumn(name, F.col("_rank") - F.col("_first")).drop("_rank", "_first", "_key")


def zip_rows(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables paired by their place in their group: the key, pos, and the columns of both.

    A row without a partner, so groups of unequal lengths, is an error.  Columns of the right side that
    the left one has too are dropped; null is a key like others.
    """
    a = positions(left, key, left_order).withColumn("_left", F.lit(True))
    b = positions(right, key, right_order).withColumnRenamed(key, "_right_key").withColumnRenamed("pos", "_right_pos").withColumn("_right", F.lit(True))
    b = b.drop(*[c for c in right.columns if c in left.columns and c != key])
    both = a.join(b, a[key].eqNullSafe(b["_right_key"]) & (a["pos"] == b["_right_pos"]), "full")
    pos = F.when(F.col("_left") & F.col("_right"), F.col("pos")).otherwise(F.raise_error(F.lit("lengths differ")).cast("long"))
    return both.withColumn("pos", pos).drop("_left", "_right", "_right_key", "_right_pos")
