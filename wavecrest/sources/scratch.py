"""Folders for intermediate files, where all executors see them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def base(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; a temporary one only where none is set and Spark runs on this machine alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="wavecrest-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(found)
    return found


def folder(spark: SparkSession, name: str) -> str:
    return f"{base(spark)}/{name}-{uuid.uuid4().hex}"


def _in_parts(df: DataFrame, *order: Column | str) -> DataFrame:
    """Rows in range partitions, sorted in each, with _part and _at (the row in its part), fixed by a checkpoint."""
    spark = df.sparkSession
    base(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()).checkpoint()
    return rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND((1 << 33) - 1)).drop("_id")


def _starts(rows: DataFrame, total: Column) -> DataFrame:
    """Per part the total of all former parts: the driver sees one row a part."""
    out, so_far = [], 0
    for r in rows.groupBy("_part").agg(total.alias("n")).orderBy("_part").collect():
        out.append((r["_part"], so_far))
        so_far += r.n
    return F.broadcast(rows.sparkSession.createDataFrame(out, "_part long, _start long"))


def dense_index(df: DataFrame, *order: Column | str, name: str = "index") -> DataFrame:
    """Adds the global rank from 0 in this order, without a window over all rows.  The order must be total for a fixed result."""
    rows = _in_parts(df, *order)
    return rows.join(_starts(rows, F.count("*")), "_part").withColumn(name, F.col("_start") + F.col("_at")).drop("_part", "_start", "_at")


def total_before(df: DataFrame, value: str, *order: Column | str, name: str = "before") -> DataFrame:
    """Adds the sum of an integer column over all former rows in this order."""
    rows = _in_parts(df, *order)
    own = F.coalesce(F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return rows.withColumn("_own", own).join(_starts(rows, F.sum(value)), "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_start", "_at", "_own")
