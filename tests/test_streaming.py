"""Streams in runs: late rows, state between runs, timers, and runs without news."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wavecrest.sources import scratch
from wavecrest.streaming import runs, stateful, windows

BEGIN = datetime(2024, 1, 1)


def events(spark, rows):
    """(hour, user, type)"""
    return spark.createDataFrame([(k, BEGIN + timedelta(hours=h), u, t, float(k)) for k, (h, u, t) in enumerate(rows)], "event_id long, ts timestamp, user_id long, event_type string, value double")


def test_late_rows_go(spark):
    first = events(spark, [(0.5, 1, "a"), (1.5, 1, "a"), (10.5, 1, "a")])
    # the first run sets the mark to 8.5: the window of 8 to 9 is open, that of 7 to 8 and older ones aren't
    second = events(spark, [(8.2, 1, "a"), (7.9, 1, "a"), (1.6, 1, "a"), (20.5, 1, "a")])
    third = events(spark, [(10.6, 1, "a"), (19.0, 1, "a"), (30.0, 1, "a")])
    out = runs.in_runs([first, second, third], lambda s: windows.tumbling(s, "1 hour", "2 hours"))
    got = sorted(((r.start - BEGIN).seconds // 3600, r.n) for r in out.collect())
    assert got == [(0, 1), (1, 1), (8, 1), (10, 1), (19, 1), (20, 1)]


def test_sessions_across_runs(spark):
    arrivals = [events(spark, [(0, 1, "a"), (1, 1, "a"), (1, 2, "a")]), events(spark, [(2, 1, "a"), (9, 2, "a")]), events(spark, [(40, 3, "a")])]
    out = runs.in_runs(arrivals, lambda s: windows.sessions(s, "3 hours", "10 hours"))
    assert sorted((r.user_id, (r.start - BEGIN).seconds // 3600, r.n) for r in out.collect()) == [(1, 0, 3), (2, 1, 1), (2, 9, 1)]
    out = runs.in_runs(arrivals, lambda s: stateful.idle_sessions(s, "user_id", "ts", 3 * 3_600_000, "10 hours"))
    assert sorted((r.key, r.n, r.timed) for r in out.collect()) == [(1, 3, True), (2, 1, False), (2, 1, True)]


def test_idle_sessions_of_a_batch_go_out_together():
    """One table for all sessions that a batch ends of a key, as by a loop over its rows, late rows included."""

    class Open:
        value, timers = None, set()

        def getValueState(self, *_):
            return self

        def get(self):
            return self.value

        def exists(self):
            return self.value is not None

        def update(self, value):
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            assert at not in self.timers
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    rng = np.random.default_rng(2)
    for _ in range(200):
        Open.timers = set()
        state, own = Open(), stateful.IdleSessions(10)
        own.init(state)
        now, want, got = None, [], []
        for _ in range(4):
            ms = rng.integers(0, 300, int(rng.integers(1, 20)))
            for v in sorted(ms.tolist()):
                if now is not None and v - now[2] > 10:
                    want.append((7, *now, False))
                    now = None
                now = (1, v, v) if now is None else (now[0] + 1, now[1], max(now[2], v))
            tables = list(own.handleInputRows((7,), iter([pd.DataFrame({"ms": ms[:3]}), pd.DataFrame({"ms": ms[3:]})]), None))
            assert len(tables) <= 1
            got += [tuple(r) for t in tables for r in t.itertuples(index=False)]
            assert tuple(state.value) == now and state.timers == {now[2] + 10}
        assert got == want
        assert [tuple(r) for t in own.handleExpiredTimer((7,), None, None) for r in t.itertuples(index=False)] == [(7, *now, True)] and state.value is None


def test_state_lives_between_runs(spark):
    arrivals = [events(spark, [(0, 1, t) for t in "aab"]), events(spark, [(1, 1, t) for t in "a"]), events(spark, [(2, 1, t) for t in "abb"])]
    out = runs.in_runs(arrivals, lambda s: stateful.recent_mean(s, "event_type", "event_id", "value", 2))
    assert sorted((r.key, r["mean"]) for r in out.collect()) == [("a", 0.0), ("a", 0.0), ("a", 0.5), ("a", 0.5), ("b", 1.5), ("b", 1.5), ("b", 2.0)]
    out = runs.in_runs(arrivals, lambda s: stateful.code_drift(s.withColumn("code", F.lit(1)), "event_type", "code"))
    assert sorted((r.key, r.batch, r.n, r.kl) for r in out.collect() if r.key == "a") == [("a", 0, 2, None), ("a", 1, 1, 0.0), ("a", 2, 1, 0.0)]
    assert sorted((r.batch, r.n) for r in out.collect() if r.key == "b") == [(0, 1), (1, 2)]


def test_a_run_without_news_adds_nothing(spark):
    root = scratch.folder(spark, "stream")
    rows = events(spark, [(0, 1, "a"), (5, 1, "a"), (50, 1, "a")])
    rows.write.parquet(f"{root}/in")
    stream = windows.tumbling(spark.readStream.schema(rows.schema).parquet(f"{root}/in"), "1 hour", "1 hour")
    for _ in range(2):
        runs.run_available(stream, f"{root}/out", f"{root}/checkpoint")
        assert spark.read.parquet(f"{root}/out").count() == 2


def test_settings_are_put_back(spark):
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    with pytest.raises(ZeroDivisionError), runs.settings(spark, spark__sql__shuffle__partitions=3):
        assert spark.conf.get("spark.sql.shuffle.partitions") == "3"
        1 / 0
    assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
