"""Readers of the input tables, as they are and as signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long form: read, pos, value."""
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("read"), F.col("event_id").alias("pos"), "value")


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per read with its samples in order."""
    return samples(spark, sf_dir).groupBy("read").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x.value).alias("signal"))
