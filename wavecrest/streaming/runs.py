"""Streams run over what has arrived: each run takes the new files, and state and watermark live in the checkpoint between runs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from wavecrest.sources import scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (dots written as __) that are put back at the end."""
    names = {k.replace("__", "."): str(v) for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_available(stream: DataFrame, sink: str, checkpoint: str) -> None:
    """Process all that has arrived since the last run and append what is final to the sink."""
    spark = stream.sparkSession
    # a state store for each partition, as many as there are cores; the checkpoint keeps the number of the first run
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    with settings(spark, spark__sql__streaming__stateStore__providerClass=ROCKSDB, spark__sql__shuffle__partitions=parts):
        stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def in_runs(arrivals: list[DataFrame], transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream has given after the frames arrived one by one, with a run after each."""
    spark = arrivals[0].sparkSession
    root, out = scratch.folder(spark, "stream"), None
    for rows in arrivals:
        rows.write.mode("append").parquet(f"{root}/in")
        out = transform(spark.readStream.schema(T.StructType(rows.schema.fields)).parquet(f"{root}/in"))
        run_available(out, f"{root}/out", f"{root}/checkpoint")
    return spark.read.schema(out.schema).parquet(f"{root}/out")
