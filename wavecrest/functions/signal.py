"""Signal functions over long-form samples: one row per (read, pos, value).

All take a DataFrame with the columns read, pos, value and return the same rows with y.  Statistics of
a read and its running values use the same partitioning, so a chain of them shuffles once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def by_read():
    return Window.partitionBy("read")


def in_order():
    return Window.partitionBy("read").orderBy("pos")


def robust_scale(residual: Column) -> Column:
    """1.4826 times the median absolute value, one at least."""
    return F.greatest(F.lit(1.4826) * F.median(F.abs(residual)).over(by_read()), F.lit(1.0))


def normalize(df: DataFrame) -> DataFrame:
    """Less the median, over the robust scale."""
    r = df.withColumn("r", F.col("value") - F.median("value").over(by_read()))
    return r.withColumn("y", F.col("r") / robust_scale(F.col("r"))).drop("r")


def normalize_trimmed(df: DataFrame) -> DataFrame:
    """As normalize, with the scale from residuals between their 1st and 99th percentiles."""
    r = df.withColumn("r", F.col("value") - F.median("value").over(by_read()))
    r = r.withColumn("lo", F.percentile("r", F.lit(0.01)).over(by_read())).withColumn("hi", F.percentile("r", F.lit(0.99)).over(by_read()))
    inner = F.when(F.col("r").between(F.col("lo"), F.col("hi")), F.col("r"))
    return r.withColumn("y", F.col("r") / robust_scale(inner)).drop("r", "lo", "hi")


def repair(df: DataFrame, low: float, high: float) -> DataFrame:
    """A value outside [low, high] takes the last valid one; a first one takes the bound it is beyond.

    NaN counts as outside only in a read that has another value outside; a first NaN takes the lower bound.
    """
    v = F.col("value")
    nan, first = F.isnan(v), F.row_number().over(in_order()) == 1
    wanted = F.max(~nan & ((v < low) | (v > high))).over(by_read())
    held = F.when(~nan & v.between(low, high), v).when(first, F.when(~nan & (v > high), F.lit(high)).otherwise(F.lit(low)))
    return df.withColumn("y", F.when(wanted, F.last(held, True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))).otherwise(v))


def repair_neighbours(df: DataFrame, low: float, high: float, reach: int = 10) -> DataFrame:
    """A value outside [low, high] takes the mean of the nearest valid ones within reach on both sides, the one of
    the only side that has one, or the bound it is beyond."""
    v = F.col("value")
    ok = ~F.isnan(v) & v.between(low, high)
    held = F.when(ok, v)
    left, right = F.last(held, True).over(in_order().rowsBetween(-reach, -1)), F.first(held, True).over(in_order().rowsBetween(1, reach))
    bound = F.when(~F.isnan(v) & (v > high), F.lit(high)).otherwise(F.lit(low))
    return df.withColumn("y", F.when(ok, v).otherwise(F.coalesce((left + right) / 2, left, right, bound)))


def repair_by_window(df: DataFrame, low: float, high: float, size: int) -> DataFrame:
    """Values outside [low, high] take the median of an odd window around, the edge sample standing beyond the ends."""
    if size % 2 == 0:
        raise ValueError("the window must be odd")
    m = _running_median(df, size, nearest=True)
    return m.withColumn("y", F.when(F.col("value").between(low, high), F.col("value")).otherwise(F.col("y")))


def normalize_strict(df: DataFrame) -> DataFrame:
    """Less the median, over 1.4826 times the median deviation; a read whose deviation is 0 has no rows."""
    r = df.withColumn("_r", F.col("value") - F.median("value").over(by_read()))
    r = r.withColumn("_m", 1.4826 * F.median(F.abs("_r")).over(by_read())).where("_m <> 0")
    return r.withColumn("y", F.col("_r") / F.col("_m")).drop("_r", "_m")


def normalize_local(df: DataFrame, size: int) -> DataFrame:
    """Less the running median, over the running median of the deviations (1.4826 times, one at least)."""
    size += 1 - size % 2
    base = median_reflected(df, size).select("read", "pos", F.col("value").alias("_v"), F.abs(F.col("value") - F.col("y")).alias("value"), (F.col("value") - F.col("y")).alias("_r"))
    scale = median_reflected(base.select("read", "pos", "value"), size).select("read", "pos", F.greatest(1.4826 * F.col("y"), F.lit(1.0)).alias("_m"))
    return base.join(scale, ["read", "pos"]).select("read", "pos", F.col("_v").alias("value"), (F.col("_r") / F.col("_m")).alias("y"))


def normalize_hybrid(df: DataFrame, size: int) -> DataFrame:
    """Less the running median, over the robust scale of the whole read's residuals."""
    base = median_reflected(df, size + 1 - size % 2)
    r = F.col("value") - F.col("y")
    return base.withColumn("y", r / robust_scale(r))


def clip(df: DataFrame, limit: float) -> DataFrame:
    return df.withColumn("y", F.greatest(F.least(F.col("value"), F.lit(limit)), F.lit(-limit)))


def soft_clip(df: DataFrame, limit: float) -> DataFrame:
    return df.withColumn("y", F.lit(limit) * F.tanh(F.col("value") / limit))


def median_zero_padded(df: DataFrame, size: int = 5) -> DataFrame:
    """Running median of an odd window with zeros beyond the ends."""
    half = size // 2
    around = [F.lag("value", k, 0.0).over(in_order()) for k in range(half, 0, -1)] + [F.col("value")] + [F.lead("value", k, 0.0).over(in_order()) for k in range(1, half + 1)]
    return df.withColumn("y", F.array_sort(F.array(*around))[half])


def median_reflected(df: DataFrame, size: int) -> DataFrame:
    """Running median with edges reflected (the edge sample repeats); of an even window the upper one.

    For small windows; a read's samples are gathered once and padded by an index map of period 2n.
    """
    return _running_median(df, size, nearest=False)


def _running_median(df: DataFrame, size: int, nearest: bool) -> DataFrame:
    half = size // 2
    reads = df.groupBy("read").agg(F.array_sort(F.collect_list(F.struct("pos", "value"))).alias("s"))
    at = "greatest(0, least(j, size(s) - 1))" if nearest else "if(pmod(j, 2 * size(s)) < size(s), pmod(j, 2 * size(s)), 2 * size(s) - 1 - pmod(j, 2 * size(s)))"
    one = F.expr(f"transform(sequence(0, size(s) - 1), i -> array_sort(transform(sequence(i - {half}, i - {half} + {size - 1}), j -> s[{at}].value))[{half}])")
    return reads.select("read", F.posexplode(F.arrays_zip(F.col("s"), one.alias("y"))).alias("k", "x")).select("read", F.col("x.s.pos").alias("pos"), F.col("x.s.value").alias("value"), F.col("x.y").alias("y"))


def remove_spikes(df: DataFrame, size: int, factor: float = 5.0) -> DataFrame:
    """Samples further than factor scales from the running median take the last good one."""
    base = median_reflected(df, size).withColumnRenamed("y", "base")
    r = base.withColumn("scale", robust_scale(F.col("value") - F.col("base")))
    spike = F.abs(F.col("value") - F.col("base")) > factor * F.col("scale")
    good = F.when(~spike, F.col("value")).when(F.row_number().over(in_order()) == 1, F.col("base"))
    return r.withColumn("y", F.last(good, True).over(in_order().rowsBetween(Window.unboundedPreceding, 0))).drop("base", "scale")


def repair_final(df: DataFrame, limit: float = 3.0, size: int = 100) -> DataFrame:
    """Values beyond the limit take the local median; an even window becomes odd."""
    m = median_reflected(df, size + 1 - size % 2)
    return m.withColumn("y", F.when(F.abs("value") > limit, F.col("y")).otherwise(F.col("value")))


def window_flag(df: DataFrame, size: int, limit: float = 2.99) -> DataFrame:
    """1 if any value around is above the limit, else -1 if any is below its negative, else 0."""
    around = in_order().rowsBetween(-(size // 2), size - 1 - size // 2)
    high, low = F.max("value").over(around) > limit, F.min("value").over(around) < -limit
    return df.withColumn("y", F.when(high, 1).when(low, -1).otherwise(0))


def window_mean(df: DataFrame, size: int) -> DataFrame:
    """Mean around each sample, zeros beyond the ends."""
    around = in_order().rowsBetween(-(size // 2), size - 1 - size // 2)
    return df.withColumn("y", F.sum("value").over(around) / size)


def _then(df: DataFrame, step, *args) -> DataFrame:
    return step(df, *args).select("read", "pos", F.col("y").alias("value"))


def process(df: DataFrame, strategy: str, spike_window: int = 6000) -> DataFrame:
    """A named chain; an unknown name is an error."""
    if strategy == "stone":
        return normalize(df)
    if strategy not in ("apple", "lemon", "tango", "mongo"):
        raise ValueError(f"unknown strategy {strategy!r}")
    s = _then(df, repair, 1.0, 220.0)
    s = _then(s, remove_spikes, spike_window)
    s = _then(s, normalize_trimmed)
    if strategy in ("apple", "lemon"):
        s = _then(s, median_zero_padded, 5)
    if strategy == "lemon":
        s = _then(s, clip, 5.0)
    if strategy == "tango":
        s = _then(s, soft_clip, 5.0)
    return s.withColumnRenamed("value", "y")
