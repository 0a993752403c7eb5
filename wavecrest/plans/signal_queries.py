"""Signal queries over the events table: user_id is the read, event_id the order, value the sample."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wavecrest.functions import signal as S
from wavecrest.operators import windows as W
from wavecrest.sources.scratch import total_before
from wavecrest.sources.tables import samples, signals, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _y(df: DataFrame) -> DataFrame:
    return df.select("read", "pos", (F.round("y", 6) + 0.0).alias("y"))


BASE = "with e as (select user_id as read, event_id as pos, value from events)"
#: e -> r (residual), s (scale)
MAD = ", m as (select *, value - median(value) over (partition by read) as r from {0}), s as (select *, greatest(1.4826 * median(abs(r)) over (partition by read), 1.0) as sc from m)"
REPAIR = ", {1} as (select read, pos, last_value(case when value between 1 and 220 then value when rn = 1 then least(greatest(value, 1.0), 220.0) end ignore nulls) over (partition by read order by pos rows between unbounded preceding and current row) as value from (select *, row_number() over (partition by read order by pos) as rn from {0}))"


def _reflect(source: str, size: int, out: str) -> str:
    """Running median by padded rows."""
    h = size // 2
    return f""", {out}_n as (select *, row_number() over (partition by read order by pos) - 1 as i, count(*) over (partition by read) as n from {source}),
{out}_k as (select a.read, a.pos, a.value, a.i, a.n, k.k, (((a.i + k.k) % (2 * a.n)) + 2 * a.n) % (2 * a.n) as j from {out}_n a, (select unnest(generate_series({-h}, {size - 1 - h})) as k) k),
{out} as (select k.read, k.pos, any_value(k.value) as value, any_value(k.i) as i, list_sort(list(b.value))[{h + 1}] as base from {out}_k k join {out}_n b on b.read = k.read and b.i = case when k.j < k.n then k.j else 2 * k.n - 1 - k.j end group by k.read, k.pos)"""


def _spikes(source: str, size: int, out: str) -> str:
    return _reflect(source, size, f"{out}_b") + f""", {out}_s as (select *, greatest(1.4826 * median(abs(value - base)) over (partition by read), 1.0) as sc from {out}_b),
{out} as (select read, pos, last_value(case when abs(value - base) <= 5.0 * sc then value when i = 0 then base end ignore nulls) over (partition by read order by pos rows between unbounded preceding and current row) as value from {out}_s)"""


def _trim(source: str, out: str) -> str:
    return f""", {out}_m as (select *, value - median(value) over (partition by read) as r from {source}),
{out}_q as (select read, quantile_cont(r, 0.01) as lo, quantile_cont(r, 0.99) as hi from {out}_m group by read),
{out} as (select m.read, m.pos, m.r / greatest(1.4826 * median(case when m.r between q.lo and q.hi then abs(m.r) end) over (partition by m.read), 1.0) as value from {out}_m m join {out}_q q using (read))"""


def _medfilt(source: str, out: str) -> str:
    w = "over (partition by read order by pos)"
    return f", {out} as (select read, pos, list_sort([lag(value, 2, 0.0) {w}, lag(value, 1, 0.0) {w}, value, lead(value, 1, 0.0) {w}, lead(value, 2, 0.0) {w}])[3] as value from {source})"


def _end(source: str, y: str = "value") -> str:
    return f" select read, pos, round({y}, 6) + 0.0 as y from {source}"


@query("sig_mad_normalize", BASE + MAD.format("e") + _end("s", "r / sc"))
def sig_mad_normalize(spark, sf_dir):
    return _y(S.normalize(samples(spark, sf_dir)))


@query("sig_trimmed_mad_normalize", BASE + _trim("e", "t") + _end("t"))
def sig_trimmed_mad_normalize(spark, sf_dir):
    return _y(S.normalize_trimmed(samples(spark, sf_dir)))


@query("sig_repair_range", BASE + REPAIR.format("e", "r") + _end("r"))
def sig_repair_range(spark, sf_dir):
    return _y(S.repair(samples(spark, sf_dir), 1.0, 220.0))


@query("sig_clip", BASE + _end("e", "greatest(least(value, 50.0), -50.0)"))
def sig_clip(spark, sf_dir):
    return _y(S.clip(samples(spark, sf_dir), 50.0))


@query("sig_soft_clip", BASE + _end("e", "50.0 * tanh(value / 50.0)"))
def sig_soft_clip(spark, sf_dir):
    return _y(S.soft_clip(samples(spark, sf_dir), 50.0))


@query("sig_medfilt5", BASE + _medfilt("e", "f") + _end("f"))
def sig_medfilt5(spark, sf_dir):
    return _y(S.median_zero_padded(samples(spark, sf_dir), 5))


for _n in (6, 7):

    @query(f"sig_running_median_reflect_{_n}", BASE + _reflect("e", _n, "f") + _end("f", "base"))
    def _running(spark, sf_dir, n=_n):
        return _y(S.median_reflected(samples(spark, sf_dir), n))


@query("sig_repair_final", BASE + _reflect("e", 7, "f") + _end("f", "case when abs(value) > 100.0 then base else value end"))
def sig_repair_final(spark, sf_dir):
    return _y(S.repair_final(samples(spark, sf_dir), 100.0, 6))


@query("sig_remove_spikes", BASE + _spikes("e", 5, "k") + _end("k"))
def sig_remove_spikes(spark, sf_dir):
    return _y(S.remove_spikes(samples(spark, sf_dir), 5))


_CHAIN = BASE + REPAIR.format("e", "r") + _spikes("r", 6, "k") + _trim("k", "t")
_PIPELINES = {
    "stone": BASE + MAD.format("e") + _end("s", "r / sc"),
    "apple": _CHAIN + _medfilt("t", "f") + _end("f"),
    "lemon": _CHAIN + _medfilt("t", "f") + _end("f", "greatest(least(value, 5.0), -5.0)"),
    "tango": _CHAIN + _end("t", "5.0 * tanh(value / 5.0)"),
    "mongo": _CHAIN + _end("t"),
}
for _s, _sql in _PIPELINES.items():

    @query(f"sig_pipeline_{_s}", _sql)
    def _pipeline(spark, sf_dir, s=_s):
        return _y(S.process(samples(spark, sf_dir), s, spike_window=6))


@query("sig_pipeline_apple_6000")
def sig_pipeline_apple_6000(spark, sf_dir):
    """The long production window, on arrays in Arrow batches."""
    from wavecrest.functions.arrays import map_signals, process

    out = map_signals(signals(spark, sf_dir), "signal", lambda x: process(x, "apple"))
    return out.select("read", F.posexplode("signal").alias("i", "y")).select("read", "i", F.round("y", 6).alias("y"))


@query("sig_low_pass")
def sig_low_pass(spark, sf_dir):
    from wavecrest.functions.arrays import low_pass, map_signals

    out = map_signals(signals(spark, sf_dir), "signal", lambda x: low_pass(x, 1000.0, 5000.0))
    return out.select("read", F.posexplode("signal").alias("i", "y")).select("read", "i", F.round("y", 4).alias("y"))


@query("win_threshold_flag", BASE + " select read, pos, case when max(value) over w > 150 then 1 when min(value) over w < -150 then -1 else 0 end as y from e window w as (partition by read order by pos rows between 4 preceding and 3 following)")
def win_threshold_flag(spark, sf_dir):
    return S.window_flag(samples(spark, sf_dir), 8, 150.0).select("read", "pos", "y")


@query("win_mean", BASE + " select read, pos, round(sum(value) over (partition by read order by pos rows between 4 preceding and 3 following) / 8, 6) + 0.0 as y from e")
def win_mean(spark, sf_dir):
    return _y(S.window_mean(samples(spark, sf_dir), 8))


_READS = BASE + ", a as (select read, list(value order by pos) as d, count(*)::int as n from e group by read)"
_CHUNK = "round(list_sum(d[s + 1:s + {0}]), 4) + 0.0 as total"


def _total():
    return F.round(F.aggregate("chunk", F.lit(0.0), lambda a, x: a + x), 4) + 0.0


def _chunks(df: DataFrame) -> DataFrame:
    return df.select("read", "head_cut", "chunk_start", "chunk_end", _total().alias("total"))


@query("chunk_strict", _READS + f" select read, 0 as head_cut, s as chunk_start, s + 16 as chunk_end, {_CHUNK.format(16)} from (select read, d, unnest(generate_series(0, n - 16, 8))::int as s from a where n >= 16)")
def chunk_strict(spark, sf_dir):
    return _chunks(W.chunk(signals(spark, sf_dir), "signal", 16, 8))


_TAIL = f""" select read, h as head_cut, (s + h)::int as chunk_start, (e + h)::int as chunk_end, round(list_sum(d[b + h + 1:b + h + 16]), 4) + 0.0 as total from (
select read, d, h, s, s + 16 as e, s as b from (select read, d, h, unnest(generate_series(0, n - h - 16, 12)) as s from x where n - h >= 16)
union all select read, d, h, l + 12, n - h, n - h - 16 from (select *, ((n - h - 16) // 12) * 12 as l from x where n - h >= 16) where n - h - (l + 16) >= {{0}} and n - h > l + 16)"""


@query("chunk_tail", _READS + ", x as (select *, 0 as h from a)" + _TAIL.format(6))
def chunk_tail(spark, sf_dir):
    return _chunks(W.chunk(signals(spark, sf_dir), "signal", 16, 12, tail=6))


@query("chunk_headcut", _READS + ", x as (select *, unnest([0, 2, 4])::int as h from a)" + _TAIL.format(6))
def chunk_headcut(spark, sf_dir):
    return _chunks(W.chunk(signals(spark, sf_dir), "signal", 16, 12, tail=6, head_cut=5, cut_step=2))


@query(
    "chunk_logic",
    _READS
    + """, p as (select read, s as chunk_start, row_number() over (order by read, s) - 1 as chunk from (select read, unnest(generate_series(0, n - 40, 40))::int as s from a where n >= 40)),
l as (select *, unnest(generate_series(0, 3)) as sub from p) select read, chunk_start, sub::bigint as sub, chunk_start + sub::int * 8 as logic_start, (chunk * 4 + sub)::bigint as logic_id from l""",
)
def chunk_logic(spark, sf_dir):
    """Sub-windows of 16 with overlap 8 in physical chunks of 40, by a global index: reads in order, each after
    the chunks of all former ones."""
    per = W.logic_chunks(40, 16, 8)
    reads = signals(spark, sf_dir).select("read", F.floor(F.size("signal") / 40).cast("int").alias("k"))
    rows = total_before(reads, "k", "read", name="base").where("k > 0").select("read", "base", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("c"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0).cast("long"), per - 1)).alias("sub"))
    return rows.select("read", (F.col("c") * 40).alias("chunk_start"), "sub", (F.col("c") * 40 + F.col("sub").cast("int") * 8).alias("logic_start"), ((F.col("base") + F.col("c")) * 4 + F.col("sub")).alias("logic_id"))


@query(
    "chunk_clip_filter",
    _READS + ", c as (select read, s, d[s + 1:s + 16] as c from (select read, d, unnest(generate_series(0, n - 16, 16))::int as s from a where n >= 16)) select read, s as chunk_start, row_number() over (partition by read order by s) - 1 as chunk_idx from c where list_max(list_transform(c, lambda x: abs(x))) <= 150",
)
def chunk_clip_filter(spark, sf_dir):
    from pyspark.sql import Window

    rows = W.chunk(signals(spark, sf_dir), "signal", 16, 16).where(~F.exists("chunk", lambda x: F.abs(x) > 150) & (F.size("chunk") == 16))
    return rows.select("read", "chunk_start", (F.row_number().over(Window.partitionBy("read").orderBy("chunk_start")).cast("long") - 1).alias("chunk_idx"))


_STATS = "select count(*) as n_chunks, round(min(mn), 6) + 0.0 as min_min, round(max(mx), 6) + 0.0 as max_max, round(avg(mean), 6) + 0.0 as mean_mean, round(min(sd), 6) + 0.0 as min_std, round(max(sd), 6) + 0.0 as max_std, round(avg(sd), 6) + 0.0 as mean_std from ({0})"


def _chunk_profile(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Least, greatest, mean and population deviation of each chunk, without exploding it."""
    mean = F.aggregate("chunk", F.lit(0.0), lambda a, x: a + x) / F.size("chunk")
    rows = rows.withColumn("mean", mean)
    sd = F.sqrt(F.aggregate("chunk", F.lit(0.0), lambda a, x: a + (x - F.col("mean")) * (x - F.col("mean"))) / F.size("chunk"))
    return rows.select(*keys, F.array_min("chunk").alias("mn"), F.array_max("chunk").alias("mx"), "mean", sd.alias("sd"))


@query("chunk_stats", _READS + " " + _STATS.format("select list_min(c) as mn, list_max(c) as mx, list_avg(c) as mean, list_stddev_pop(c) as sd from (select d[s + 1:s + 16] as c from (select d, unnest(generate_series(0, n - 16, 8))::int as s from a where n >= 16))"))
def chunk_stats(spark, sf_dir):
    p = _chunk_profile(W.chunk(signals(spark, sf_dir), "signal", 16, 8), [])
    cols = {"min_min": F.min("mn"), "max_max": F.max("mx"), "mean_mean": F.avg("mean"), "min_std": F.min("sd"), "max_std": F.max("sd"), "mean_std": F.avg("sd")}
    return p.agg(F.count("*").alias("n_chunks"), *((F.round(c, 6) + 0.0).alias(k) for k, c in cols.items()))


@query(
    "entry_chunk_profile",
    BASE + REPAIR.format("e", "f") + MAD.format("f") + ", a as (select read, list(r / sc order by pos) as d, count(*)::int as n from s group by read) select read, s as chunk_start, round(list_min(c), 6) + 0.0 as mn, round(list_max(c), 6) + 0.0 as mx, round(list_avg(c), 6) + 0.0 as mean, round(list_stddev_pop(c), 6) + 0.0 as sd from (select read, s, d[s + 1:s + 16] as c from (select read, d, unnest(generate_series(0, n - 16, 8))::int as s from a where n >= 16))",
)
def entry_chunk_profile(spark, sf_dir):
    """Repair, normalise, cut, summarise: one shuffle by read."""
    y = S.normalize(S._then(samples(spark, sf_dir), S.repair, 1.0, 220.0))
    reads = y.groupBy("read").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda x: x.y).alias("signal"))
    p = _chunk_profile(W.chunk(reads, "signal", 16, 8), ["read", "chunk_start"])
    return p.select("read", "chunk_start", *((F.round(c, 6) + 0.0).alias(c) for c in ("mn", "mx", "mean", "sd")))


_QC = (
    "with e as (select user_id as read, event_id as pos, case when event_id % 997 = 0 then 'nan'::double else value end as value from events)"
    + MAD.format("e")
    + ", a as (select read, count(*) as n, bool_or(isnan(value)) as nan, max(value) as mx, min(value) as mn, max(abs(r / sc)) as far from s group by read), r as (select read, n, case when n = 0 then 'empty' when nan then 'nan' when mx > 500 or mn < 0 then 'raw_range' when far > 9 then 'norm_range' when n < 100 then 'too_short' else 'ok' end as reason from a)"
)


@query("qc_skip_reasons", _QC + " select reason, count(*) as n_reads, sum(n)::bigint as n_samples from r group by reason")
def qc_skip_reasons(spark, sf_dir):
    return _qc(spark, sf_dir).groupBy("reason").agg(F.count("*").alias("n_reads"), F.sum("n").alias("n_samples"))


@query("qc_file_counts", _QC + " select read % 5 as file, count(*) as n_reads, count(*) filter (where reason = 'ok') as n_valid, sum(case when reason = 'ok' then n // 16 else 0 end)::bigint as chunks from r group by 1")
def qc_file_counts(spark, sf_dir):
    """Reads, valid reads and whole chunks of each file (five of them)."""
    ok = F.col("reason") == "ok"
    return _qc(spark, sf_dir).groupBy((F.col("read") % 5).alias("file")).agg(F.count("*").alias("n_reads"), F.count_if(ok).alias("n_valid"), F.sum(F.when(ok, F.floor(F.col("n") / 16)).otherwise(0)).alias("chunks"))


def _qc(spark, sf_dir) -> DataFrame:
    """read, n and the first reason that holds: no samples, NaN, raw range, range after normalisation, length."""
    x = samples(spark, sf_dir).withColumn("value", F.when(F.col("pos") % 997 == 0, F.lit(float("nan"))).otherwise(F.col("value")))
    per = S.normalize(x).groupBy("read").agg(F.count("*").alias("n"), F.max(F.isnan("value")).alias("nan"), F.max("value").alias("mx"), F.min("value").alias("mn"), F.max(F.abs("y")).alias("far"))
    reason = F.when(F.col("n") == 0, "empty").when(F.col("nan"), "nan").when((F.col("mx") > 500) | (F.col("mn") < 0), "raw_range").when(F.col("far") > 9, "norm_range").when(F.col("n") < 100, "too_short").otherwise("ok")
    return per.select("read", "n", reason.alias("reason"))


_OVER = "over (partition by read order by pos rows between"


@query("sig_normalize_strict", BASE + ", m as (select *, value - median(value) over (partition by read) as r from e), s as (select *, 1.4826 * median(abs(r)) over (partition by read) as sc from m) select read, pos, round(r / sc, 6) + 0.0 as y from s where sc <> 0")
def sig_normalize_strict(spark, sf_dir):
    return _y(S.normalize_strict(samples(spark, sf_dir)))


@query("sig_normalize_hybrid", BASE + _reflect("e", 7, "b") + " select read, pos, round((value - base) / greatest(1.4826 * median(abs(value - base)) over (partition by read), 1.0), 6) + 0.0 as y from b")
def sig_normalize_hybrid(spark, sf_dir):
    return _y(S.normalize_hybrid(samples(spark, sf_dir), 6))


@query("sig_normalize_local", BASE + _reflect("e", 7, "b") + ", d as (select read, pos, abs(value - base) as value from b)" + _reflect("d", 7, "g") + " select b.read, b.pos, round((b.value - b.base) / greatest(1.4826 * g.base, 1.0), 6) + 0.0 as y from b join g using (read, pos)")
def sig_normalize_local(spark, sf_dir):
    return _y(S.normalize_local(samples(spark, sf_dir), 6))


@query("sig_repair_neighbours", BASE + f", h as (select *, case when value between 20 and 80 then value end as ok from e), k as (select *, last_value(ok ignore nulls) {_OVER} 3 preceding and 1 preceding) as a, first_value(ok ignore nulls) {_OVER} 1 following and 3 following) as b from h) select read, pos, round(coalesce(ok, (a + b) / 2, a, b, case when value > 80 then 80.0 else 20.0 end), 6) + 0.0 as y from k")
def sig_repair_neighbours(spark, sf_dir):
    return _y(S.repair_neighbours(samples(spark, sf_dir), 20.0, 80.0, 3))


@query(
    "sig_repair_window",
    BASE
    + f", k as (select *, list_sort([coalesce(lag(value, 2) over w, first_value(value) {_OVER} unbounded preceding and current row)), coalesce(lag(value, 1) over w, value), value, coalesce(lead(value, 1) over w, value), coalesce(lead(value, 2) over w, last_value(value) {_OVER} current row and unbounded following))])[3] as m from e window w as (partition by read order by pos)) select read, pos, round(case when value between 20 and 80 then value else m end, 6) + 0.0 as y from k",
)
def sig_repair_window(spark, sf_dir):
    return _y(S.repair_by_window(samples(spark, sf_dir), 20.0, 80.0, 5))


def fixed_histogram(df: DataFrame, value: str, low: float, high: float, bins: int, keys: tuple[str, ...] = ()) -> DataFrame:
    """Counts per bin, the last one closed; bins without values are there with 0."""
    b = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1))
    inside = df.where(F.col(value).between(low, high) & ~F.isnan(value))
    counts = inside.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"))
    grid = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    if keys:
        grid = df.select(*keys).distinct().crossJoin(F.broadcast(grid))
    return grid.join(counts, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


@query("hist_fixed_bins", "with t as (select count(*) as t from events), h as (select least(floor(value / 5.0), 39)::bigint as bin, count(*) as n from events where value between 0 and 200 group by 1) select b.bin, b.bin * 5.0::double + 2.5 as center, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / t::double, 9) as ratio from (select unnest(generate_series(0, 39)) as bin) b left join h using (bin), t")
def hist_fixed_bins(spark, sf_dir):
    """The ratio's denominator has the values out of range too."""
    e = table(spark, sf_dir, "events")
    total = F.broadcast(e.agg(F.count("*").alias("t")))
    return fixed_histogram(e, "value", 0.0, 200.0, 40).join(total).select("bin", (F.col("bin") * 5.0 + 2.5).alias("center"), "n", F.round(F.col("n") / F.col("t"), 9).alias("ratio"))


@query("hist_merge", "with h as (select least(floor((l_discount * 100 + l_quantity) / 3.0), 19)::bigint as bin, count(*) as n from lineitem where l_discount * 100 + l_quantity between 0 and 60 group by 1) select b.bin, coalesce(n, 0)::bigint as n, round(coalesce(n, 0) / (sum(n) over ())::double, 9) as ratio from (select unnest(generate_series(0, 19)) as bin) b left join h using (bin)")
def hist_merge(spark, sf_dir):
    """Histograms of parts added up; the ratio's denominator is the sum of counts."""
    v = table(spark, sf_dir, "lineitem").select((F.col("l_discount") * 100 + F.col("l_quantity")).alias("v"), "l_returnflag")
    parts = fixed_histogram(v, "v", 0.0, 60.0, 20, ("l_returnflag",))
    merged = parts.groupBy("bin").agg(F.sum("n").alias("n"))
    total = F.broadcast(merged.agg(F.sum("n").alias("t")))
    return merged.join(total).select("bin", "n", F.round(F.col("n") / F.col("t"), 9).alias("ratio"))


def merge_histograms(parts: DataFrame, key: str, centers: list[float]) -> tuple[DataFrame, DataFrame]:
    """Histograms (key, center, n) added up by bin, and the keys that are left out: other numbers of rows, or centres
    that differ by more than a hundred-thousandth."""
    grid = parts.sparkSession.createDataFrame(list(enumerate(centers)), "bin int, _center double")
    ranked = parts.withColumn("bin", F.row_number().over(Window.partitionBy(key).orderBy("center")) - 1).join(F.broadcast(grid), "bin", "left")
    off = F.col("_center").isNull() | (F.abs(F.col("center") - F.col("_center")) > 1e-8 + 1e-5 * F.abs(F.col("_center")))
    bad = ranked.groupBy(key).agg(F.count("*").alias("rows"), F.max(off).alias("off")).where((F.col("rows") != len(centers)) | F.col("off")).select(key)
    return ranked.join(bad, key, "left_anti").groupBy("bin").agg(F.sum("n").alias("n")), bad


@query(
    "hist_merge_checked",
    "with h as (select l_suppkey % 50 as part, least(floor(l_quantity / 5.0), 9)::int as bin, count(*) as n from lineitem where l_quantity between 0 and 50 group by 1, 2), g as (select p.part, b.bin, coalesce(h.n, 0) as n from (select unnest(range(0, 50)) as part) p cross join (select unnest(range(0, 10))::int as bin) b left join h on h.part = p.part and h.bin = b.bin) select bin, sum(n)::bigint as n, round(sum(n) / (sum(sum(n)) over ())::double, 9) as ratio, 20::bigint as skipped from g where part % 10 not in (1, 3, 5, 7) group by bin",
)
def hist_merge_checked(spark, sf_dir):
    """Histograms of 50 parts; those whose centres are moved or that lack or repeat a bin are left out."""
    v = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 50).alias("part"), F.col("l_quantity").alias("v"))
    h = fixed_histogram(v, "v", 0.0, 50.0, 10, ("part",)).select("part", (F.col("bin") * 5.0 + 2.5).alias("center"), "n")
    kind = F.col("part") % 10
    h = h.withColumn("center", F.when(kind == 1, F.col("center") * 1.001).otherwise(F.col("center"))).where((kind != 3) | (F.col("center") != 12.5))
    h = h.union(h.where((kind == 5) & (F.col("center") == 2.5))).union(h.where((kind == 7) & (F.col("center") == 47.5)).withColumn("center", F.lit(52.5)))
    merged, bad = merge_histograms(h, "part", [5.0 * k + 2.5 for k in range(10)])
    total = F.broadcast(merged.agg(F.sum("n").alias("t")))
    skipped = F.broadcast(bad.agg(F.count("*").alias("skipped")))
    return merged.join(total).join(skipped).select("bin", "n", F.round(F.col("n") / F.col("t"), 9).alias("ratio"), "skipped")


@query("extreme_reads", "select user_id as read, min(value) + 0.0 as mn, max(value) as mx from events group by 1 having max(value) > 200 or min(value) < -200")
def extreme_reads(spark, sf_dir):
    return samples(spark, sf_dir).groupBy("read").agg((F.min("value") + 0.0).alias("mn"), F.max("value").alias("mx")).where("mx > 200 or mn < -200")


_LOSSES = ("value + 1", "201 - least(value, 200)", "abs(value - 50) + 1")
_FAST = ", ".join(f"avg({x}) {_OVER} 4 preceding and current row) / (avg({x}) {_OVER} 19 preceding and current row) + 1e-8) as r{k}" for k, x in enumerate(_LOSSES))


@query("dwa_weights", BASE + f", a as (select read, pos, row_number() over (partition by read order by pos) as step, {_FAST} from e) select read, pos, " + ", ".join(f"round(case when step <= 10 then 1 / 3.0 else exp(-r{k}) / (t + case when t + 1e-8 <= 1 then 0 else 1e-8 end) end::double, 6) as w{k}" for k in range(3)) + " from (select *, exp(-r0) + exp(-r1) + exp(-r2) as t from a)")
def dwa_weights(spark, sf_dir):
    """Three losses of each step: softmax of minus the ratio of trailing means over 5 and 20 steps, then the
    projection on the bounds (none here but 0 and 1); the first ten steps have equal weights."""
    from wavecrest.functions.weights import box_projection

    rows = samples(spark, sf_dir)
    loss = [F.expr(x) for x in _LOSSES]
    ratio = [F.avg(x).over(S.in_order().rowsBetween(-4, 0)) / (F.avg(x).over(S.in_order().rowsBetween(-19, 0)) + 1e-8) for x in loss]
    e = rows.select("read", "pos", F.row_number().over(S.in_order()).alias("step"), *(F.exp(-r).alias(f"e{k}") for k, r in enumerate(ratio)))
    total = F.col("e0") + F.col("e1") + F.col("e2") + 1e-8
    w = e.withColumn("w", F.when(F.col("step") <= 10, F.array(*[F.lit(1 / 3)] * 3)).otherwise(F.array(*(F.col(f"e{k}") / total for k in range(3)))))
    w = box_projection(w.select("read", "pos", "w"), "w", [0.0] * 3, [1.0] * 3)
    return w.select("read", "pos", *(F.round(F.col("w")[k], 6).alias(f"w{k}") for k in range(3)))


@query("tumbling_events", "select date_trunc('hour', ts) as start, event_type, count(*) as n from events group by 1, 2")
def tumbling_events(spark, sf_dir):
    from wavecrest.streaming.windows import tumbling

    return tumbling(table(spark, sf_dir, "events"), "1 hour").select("start", "event_type", "n")


@query("session_events", "with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 30 minute then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g) select user_id, min(ts) as start, count(*) as n from s group by user_id, k")
def session_events(spark, sf_dir):
    from wavecrest.streaming.windows import sessions

    return sessions(table(spark, sf_dir, "events"), "30 minutes").select("user_id", "start", "n")


@query("ctc_collapse", "with r as (select user_id as read, event_id as pos, (abs(value)::bigint % 5)::int as label from (select user_id, event_id, floor(value) as value from events)), c as (select *, lag(label) over (partition by read order by pos) as before from r) select read, count(*) as n, string_agg(substr('NACGT', label + 1, 1), '' order by pos) as bases from c where label > 0 and (before is null or before <> label) group by read")
def ctc_collapse(spark, sf_dir):
    from wavecrest.functions.sequence import collapse, ids_to_bases

    label = F.floor(F.abs(F.col("value"))).cast("long") % 5
    reads = samples(spark, sf_dir).withColumn("label", label.cast("int")).groupBy("read").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "label"))), lambda x: x.label).alias("ids"))
    out = reads.select("read", collapse(F.col("ids")).alias("c")).where(F.size("c") > 0)
    return out.select("read", F.size("c").cast("long").alias("n"), ids_to_bases(F.col("c")).alias("bases"))
