"""Stateful operators for streams: state by key, with a time to live and timers.

A key's state is bounded (a codebook's counts, a queue, one open session).  With ``ttl_ms``, for queries that
run on, it goes after so long if the key stays away.  Where the order of rows counts, two numbers of each of a key's rows
in a batch are held to put them in order, so the source's limit for a batch bounds them.
"""

from __future__ import annotations

from collections import Counter, deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Fixed value: added to both shares before their quotient.
EPSILON = 1e-10


def _in_order(parts: Iterator[pd.DataFrame], *columns: str) -> Iterator[tuple]:
    """The rows of a key in a batch, sorted by these columns."""
    held = [part[list(columns)].to_numpy(copy=True).T for part in parts]
    own = [np.concatenate([h[k] for h in held]) for k in range(len(columns))]
    order = np.lexsort(own[::-1])
    return zip(*(x[order].tolist() for x in own), strict=True)


class CodeDrift(StatefulProcessor):
    """One row for each key and batch: n and the divergence of its code counts from the key's last batch (null at first)."""

    SCHEMA = "key string, batch long, n long, kl double"

    def __init__(self, ttl_ms: int | None = None) -> None:
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getMapState("last", "code long", "n long", self.ttl_ms)
        self.batches = handle.getValueState("batches", "n long", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = Counter()
        for part in rows:
            now.update(part["code"].tolist())
        before = {k[0]: v[0] for k, v in self.last.iterator()} if self.last.exists() else {}
        batch = self.batches.get()[0] + 1 if self.batches.exists() else 0
        kl = None
        if before:
            codes = sorted({*before, *now})
            p, q = (np.array([c.get(k, 0) for k in codes], float) for c in (now, before))
            p, q = p / p.sum() + EPSILON, q / q.sum() + EPSILON
            kl = float((p * np.log(p / q)).sum())
            self.last.clear()
        for code, n in now.items():
            self.last.updateValue((code,), (n,))
        self.batches.update((batch,))
        yield pd.DataFrame({"key": [key[0]], "batch": [batch], "n": [now.total()], "kl": pd.Series([kl], dtype="float64")})

    def close(self) -> None:
        pass


class RecentMean(StatefulProcessor):
    """Each row with the mean of its key's last values, its own included, from a queue that lives between batches."""

    SCHEMA = "key string, id long, mean double"

    def __init__(self, size: int, ttl_ms: int | None = None) -> None:
        self.size, self.ttl_ms = size, ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.queue = handle.getListState("queue", "value double", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        queue = deque((v[0] for v in self.queue.get()), maxlen=self.size)
        ids, means = [], []
        for i, v in _in_order(rows, "id", "value"):
            queue.append(v)
            ids.append(i)
            means.append(sum(queue) / len(queue))
        yield pd.DataFrame({"key": key[0], "id": np.array(ids, np.int64), "mean": means})
        self.queue.put([(v,) for v in queue])

    def close(self) -> None:
        pass


class IdleSessions(StatefulProcessor):
    """A key's session once it is idle: rows not further apart than the gap, given out by a later row or by a timer."""

    SCHEMA = "key long, n long, first_ms long, last_ms long, timed boolean"

    def __init__(self, gap_ms: int) -> None:
        self.gap_ms = gap_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "n long, first long, last long")

    def _rows(self, key, n, first, last, timed: bool) -> pd.DataFrame:
        return pd.DataFrame({"key": key[0], "n": n, "first_ms": first, "last_ms": last, "timed": timed})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        ms = np.sort(np.concatenate([part["ms"].to_numpy(np.int64) for part in rows]))
        now = self.open.get()
        # the open session is one row more, in front: its first time counts as it is, its last one as far as it reaches
        n = np.ones(len(ms), np.int64)
        first = last = ms
        if now is not None:
            n, first, last = np.concatenate([now[:1], n]), np.concatenate([now[1:2], ms]), np.maximum.accumulate(np.concatenate([now[2:3], ms]))
        at = np.flatnonzero(np.concatenate([[True], first[1:] - last[:-1] > self.gap_ms]))
        n, first, last = np.add.reduceat(n, at), first[at], last[np.append(at[1:], len(last)) - 1]
        # all that a batch ends of a key goes out as one table
        if len(at) > 1:
            yield self._rows(key, n[:-1], first[:-1], last[:-1], False)
        self.open.update((int(n[-1]), int(first[-1]), int(last[-1])))
        if now is None or now[2] != last[-1]:
            if now is not None:
                self.handle.deleteTimer(now[2] + self.gap_ms)
            self.handle.registerTimer(int(last[-1]) + self.gap_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._rows(key, *([v] for v in self.open.get()), True)
        self.open.clear()

    def close(self) -> None:
        pass


def _mode(ttl_ms: int | None) -> str:
    """A time to live needs processing time, in which a query never comes to an end by itself."""
    return "None" if ttl_ms is None else "ProcessingTime"


def code_drift(codes: DataFrame, key: str, code: str, ttl_ms: int | None = None) -> DataFrame:
    rows = codes.selectExpr(f"cast({key} as string) as key", f"cast({code} as long) as code")
    return rows.groupBy("key").transformWithStateInPandas(CodeDrift(ttl_ms), CodeDrift.SCHEMA, "append", _mode(ttl_ms))


def recent_mean(losses: DataFrame, key: str, order: str, value: str, size: int, ttl_ms: int | None = None) -> DataFrame:
    rows = losses.selectExpr(f"cast({key} as string) as key", f"cast({order} as long) as id", f"cast({value} as double) as value")
    return rows.groupBy("key").transformWithStateInPandas(RecentMean(size, ttl_ms), RecentMean.SCHEMA, "append", _mode(ttl_ms))


def idle_sessions(events: DataFrame, key: str, time: str, gap_ms: int, late: str) -> DataFrame:
    rows = events.withWatermark(time, late).selectExpr(f"cast({key} as long) as key", time, f"unix_millis({time}) as ms")
    return rows.groupBy("key").transformWithStateInPandas(IdleSessions(gap_ms), IdleSessions.SCHEMA, "append", "EventTime")
