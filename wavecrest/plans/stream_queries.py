"""Streams over the events: they arrive in three parts, with a run after each, and each part's late rows in the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.sources.tables import table
from wavecrest.streaming import runs, stateful, windows

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _arrivals(spark, sf_dir, late: bool = False) -> list[DataFrame]:
    """Thirds of the events by their number; late: every tenth row comes with the next third."""
    e = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    part = F.floor(F.col("event_id") * 3 / F.lit(e.count()))
    if late:
        part = F.least(F.lit(2), part + F.when(F.col("event_id") % 10 == 0, 1).otherwise(0))
    return [e.where(part == k) for k in range(3)]


def _arrived(late: bool = False) -> str:
    part = "event_id * 3 // (select count(*) from events)"
    return f"w as (select *, {f'least(2, {part} + case when event_id % 10 = 0 then 1 else 0 end)' if late else part} as run from events)"


_MARKS = _arrived(True) + ", m as (select run, max(max(ts)) over (order by run rows between unbounded preceding and 1 preceding) - interval 2 day as mark from w group by run), f as (select max(ts) - interval 2 day as last from events)"
#: A row counts unless its window had ended by the mark that the former runs set; a window is final once it has ended by the last mark.
_KEPT = "(mark is null or start + interval 1 hour > mark) and start + interval 1 hour <= last"


@query("stream_tumbling", f"with {_MARKS}, k as (select *, time_bucket(interval 1 hour, ts) as start from w join m using (run), f) select start, event_type, count(*) as n from k where {_KEPT} group by start, event_type")
def stream_tumbling(spark, sf_dir):
    """Hourly counts in append mode; rows more than two days behind come too late."""
    out = runs.in_runs(_arrivals(spark, sf_dir, True), lambda s: windows.tumbling(s, "1 hour", "2 days"))
    return out.withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("stream_sliding", f"with {_MARKS}, k as (select *, time_bucket(interval 30 minute, ts) - o * interval 30 minute as start from w join m using (run), f, (values (0), (1)) t(o)) select start, event_type, count(*) as n from k where {_KEPT} group by start, event_type")
def stream_sliding(spark, sf_dir):
    out = runs.in_runs(_arrivals(spark, sf_dir, True), lambda s: windows.sliding(s, "1 hour", "30 minutes", "2 days"))
    return out.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query(
    "stream_code_drift",
    f"""with {_arrived()}, c as (select event_type as key, run, floor(value / 10)::bigint as code, count(*) as n from w group by 1, 2, 3),
b as (select *, dense_rank() over (partition by key order by run) - 1 as batch from c), t as (select key, batch, sum(n)::bigint as n from b group by key, batch),
x as (select coalesce(a.key, z.key) as key, coalesce(a.batch, z.batch + 1) as batch, coalesce(a.n, 0) as a, coalesce(z.n, 0) as z from b a full join b z on a.key = z.key and a.code = z.code and a.batch = z.batch + 1),
p as (select x.key, x.batch, x.a / t.n::double + 1e-10 as p, x.z / u.n::double + 1e-10 as q from x join t on t.key = x.key and t.batch = x.batch join t u on u.key = x.key and u.batch = x.batch - 1)
select t.key, t.batch, t.n, round(sum(p * ln(p / q)), 6) as kl from t left join p on p.key = t.key and p.batch = t.batch group by t.key, t.batch, t.n""",
)
def stream_code_drift(spark, sf_dir):
    """Divergence of each event type's distribution of codes from its last one, held as map state."""
    out = runs.in_runs(_arrivals(spark, sf_dir), lambda s: stateful.code_drift(s.withColumn("code", F.floor(F.col("value") / 10)), "event_type", "code"))
    return out.withColumn("kl", F.round("kl", 6))


@query("stream_recent_mean", "select event_type as key, event_id as id, round(avg(value) over (partition by event_type order by event_id rows between 4 preceding and current row), 6) as mean from events")
def stream_recent_mean(spark, sf_dir):
    """The mean of the last five values of each event type, from a queue that lives between the runs."""
    out = runs.in_runs(_arrivals(spark, sf_dir), lambda s: stateful.recent_mean(s, "event_type", "event_id", "value", 5))
    return out.withColumn("mean", F.round("mean", 6))


@query(
    "stream_idle_sessions",
    """with g as (select user_id as key, epoch_us(ts) // 1000 as ms, case when epoch_us(ts) // 1000 - lag(epoch_us(ts) // 1000) over (partition by user_id order by ts) <= 10800000 then 0 else 1 end as new from events),
s as (select key, ms, sum(new) over (partition by key order by ms rows unbounded preceding) as s from g), t as (select key, s, count(*) as n, min(ms) as first_ms, max(ms) as last_ms from s group by key, s)
select key, n, first_ms, last_ms from (select *, max(s) over (partition by key) as newest from t) where s < newest or last_ms + 10800000 <= (select max(epoch_us(ts) // 1000) - 86400000 from events)""",
)
def stream_idle_sessions(spark, sf_dir):
    """Sessions that a later row or, three hours after their last row, a timer ends; the watermark is a day behind."""
    out = runs.in_runs(_arrivals(spark, sf_dir), lambda s: stateful.idle_sessions(s, "user_id", "ts", 3 * 3_600_000, "1 day"))
    return out.drop("timed")
