"""Event-time windows that work on batch and streaming frames alike, and stateful signal repair."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def tumbling(events: DataFrame, length: str, late: str | None = None) -> DataFrame:
    df = events.withWatermark("ts", late) if late and events.isStreaming else events
    return df.groupBy(F.window("ts", length).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


def sliding(events: DataFrame, length: str, step: str, late: str | None = None) -> DataFrame:
    df = events.withWatermark("ts", late) if late and events.isStreaming else events
    return df.groupBy(F.window("ts", length, step).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean")).select(F.col("w.start").alias("start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str, late: str | None = None) -> DataFrame:
    df = events.withWatermark("ts", late) if late and events.isStreaming else events
    return df.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def repair_stream(events: DataFrame, low: float, high: float) -> DataFrame:
    """read, pos, value with invalid values replaced by the read's last valid one, carried across batches."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for part in parts:
            part = part.sort_values("pos")
            out = []
            for v in part["value"]:
                last = v if low <= v <= high else (min(max(v, low), high) if last is None else last)
                out.append(last)
            yield pd.DataFrame({"read": key[0], "pos": part["pos"], "value": out})
        if last is not None:
            state.update((float(last),))

    return events.groupBy("read").applyInPandasWithState(run, "read long, pos long, value double", "last double", "append", GroupStateTimeout.NoTimeout)
