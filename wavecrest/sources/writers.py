"""Writers: JSON lines, FASTQ, part files, batches and numbers of shards; dense.py writes arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wavecrest.functions.sequence import phred
from wavecrest.sources.scratch import dense_index


def write_jsonl(df: DataFrame, path: str) -> None:
    """One object a line, gzip."""
    df.write.option("compression", "gzip").option("ignoreNullFields", False).json(path)


def write_parts(df: DataFrame, path: str, rows: int) -> None:
    """Part files of at most so many rows; the schema stays when there are none."""
    df.write.option("maxRecordsPerFile", rows).parquet(path)


def fastq(read_id: Column, bases: Column, quality: Column) -> Column:
    """Four lines: the name, the bases, a plus, and a constant quality for each base."""
    return F.concat_ws("\n", F.concat(F.lit("@"), read_id), bases, F.lit("+"), F.repeat(phred(quality), F.length(bases)))


def write_fastq(df: DataFrame, path: str, read_id: str, bases: str, quality: int) -> None:
    df.select(fastq(F.col(read_id).cast("string"), F.col(bases), F.lit(quality)).alias("value")).write.text(path)


def rebatch(df: DataFrame, rows: int, *order: Column | str) -> DataFrame:
    """Adds batch (a name with a number of six digits) of so many rows each, in order."""
    if rows <= 0:
        raise ValueError("a batch has one row at least")
    number = F.floor(F.col("_index") / rows)
    return dense_index(df, *order, name="_index").withColumn("batch", F.format_string("chunk_batch_%06d", number)).drop("_index")


def feature_shards(df: DataFrame, size: int, *order: Column | str) -> DataFrame:
    """Adds shard, and the index of the shard's first vector, of shards of at most so many vectors."""
    at = dense_index(df, *order, name="index").withColumn("shard", F.floor(F.col("index") / size))
    return at.withColumn("start_index", F.col("shard") * size)
