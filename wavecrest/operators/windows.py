"""Chunks and windows over array columns, and over counts of items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strict_starts(n: Column, size: int, stride: int) -> Column:
    """Starts of full windows; none for short input."""
    return F.when(n >= size, F.sequence(F.lit(0), n - size, F.lit(stride))).otherwise(F.array().cast("array<int>"))


def token_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts up to the first window that reaches the end; a short one may be last."""
    step = size - overlap
    return F.when(n <= size, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), (F.ceil((n - size) / step) * step).cast("int"), F.lit(step)))


def inference_starts(n: Column, size: int, overlap: int) -> Column:
    """All multiples of the step before the end, even if a former window reached it."""
    if size <= 0:
        return F.array(F.lit(0))
    if overlap >= size:
        raise ValueError("the overlap must be smaller than the window")
    return F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(size - overlap))).otherwise(F.array().cast("array<int>"))


def chunk(df: DataFrame, data: str, size: int, stride: int, tail: int | None = None, head_cut: int = 0, cut_step: int = 1) -> DataFrame:
    """One row per chunk: head_cut, chunk_start, chunk_end, chunk.

    tail: also the last size items if at least so many are left after the last full window; its
    start is reported as the next stride start.  head_cut: the same again for each cut of the head.
    """
    if stride <= 0 or size <= 0:
        raise ValueError("size and stride must be positive")
    n = F.size(data)
    cuts = F.sequence(F.lit(0), F.least(F.lit(head_cut), F.greatest(n - 1, F.lit(0))), F.lit(cut_step))
    rows = df.withColumn("head_cut", F.explode(cuts)).withColumn("_n", n - F.col("head_cut"))
    full = strict_starts(F.col("_n"), size, stride)
    spans = F.transform(full, lambda s: F.struct(s.alias("s"), (s + size).alias("e"), s.alias("at")))
    if tail is not None:
        last = F.element_at(full, -1)
        more = F.when((F.size(full) > 0) & (F.col("_n") - (last + size) >= tail) & (F.col("_n") > last + size), F.array(F.struct((last + stride).alias("s"), F.col("_n").alias("e"), (F.col("_n") - size).alias("at")))).otherwise(F.array().cast("array<struct<s:int,e:int,at:int>>"))
        spans = F.concat(spans, more)
    rows = rows.withColumn("_w", F.explode(spans))
    return rows.select(*df.columns, "head_cut", (F.col("_w.s") + F.col("head_cut")).alias("chunk_start"), (F.col("_w.e") + F.col("head_cut")).alias("chunk_end"), F.slice(data, F.col("_w.at") + F.col("head_cut") + 1, F.lit(size)).alias("chunk"))


def logic_chunks(size: Column | int, logic: int, overlap: int) -> Column:
    """How many sub-windows a physical chunk has."""
    if logic <= 0 or not 0 <= overlap < logic:
        raise ValueError("0 <= overlap < logic chunk size is needed")
    n = F.lit(size) if isinstance(size, int) else size
    return F.when(n < logic, F.lit(0)).otherwise(F.floor((n - logic) / (logic - overlap)) + 1)


def overlap_plan(chunk_size: int, window: int, target: int) -> dict[str, int]:
    """The window-aligned overlap nearest to the target."""
    overlap = max(0, round(target / window)) * window
    if overlap >= chunk_size:
        raise ValueError("the overlap must be smaller than the chunk")
    return {"chunk_size": chunk_size, "window": window, "overlap": overlap, "stride": chunk_size - overlap, "tokens": chunk_size // window}


def overlap_plans(chunk_size: Column, window: int, target: Column) -> tuple[Column, Column, Column]:
    """overlap_plan() of columns: overlap, stride and tokens."""
    overlap = F.greatest(F.lit(0.0), F.bround(target / window)).cast("long") * window
    overlap = F.when(overlap >= chunk_size, F.raise_error(F.lit("the overlap must be smaller than the chunk")).cast("long")).otherwise(overlap)
    return overlap, chunk_size - overlap, F.floor(chunk_size / window)


def micro_batches(chunk_index: Column, most: int) -> Column:
    """Number of the batch of at most so many chunks that a chunk of a read goes with."""
    if most <= 0:
        raise ValueError("a batch has one chunk at least")
    return F.floor(chunk_index / most)


def logic_chunks_whole(size: int, logic: int) -> int:
    """How many sub-windows without overlap a chunk has, which they must fill."""
    if logic <= 0 or size % logic:
        raise ValueError(f"{size} isn't a multiple of {logic}")
    return size // logic


def margin_windows(df: DataFrame, data: str, tokens: int, stride: int, margin: int = 2, receptive: int = 1) -> DataFrame:
    """Windows of tokens * stride samples that overlap by a margin of tokens on both sides, zeros after the end.

    Adds window, n_windows, n_tokens (of the whole: ceil(samples / stride)) and chunk.  Shorter input
    than the receptive field has no window.
    """
    size, step = tokens * stride, (tokens - 2 * margin) * stride
    if step <= 0:
        raise ValueError("the margins leave nothing of a window")
    n = F.size(data)
    count = F.when(n < receptive, 0).otherwise(F.greatest(F.lit(1), F.ceil((n - size) / step) + 1)).cast("int")
    rows = df.withColumn("n_windows", count).where("n_windows > 0").withColumn("n_tokens", F.ceil(n / stride)).withColumn("window", F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)))
    own = F.slice(data, F.col("window") * step + 1, F.lit(size))
    pad = F.array_repeat(F.lit(0.0), size - F.size(own))
    return rows.withColumn("chunk", F.concat(own, pad))


def stitch_windows(df: DataFrame, keys: list[str], codes: str, margin: int = 2) -> DataFrame:
    """The windows' codes as one array: the first keeps all but its last margin, the last all but its first,
    others neither margin; cut, or filled with zeros, to n_tokens."""
    t, k = F.size(codes), F.col("window")
    first, last = k == 0, k == F.col("n_windows") - 1
    start = F.when(first, 1).otherwise(margin + 1)
    length = t - F.when(first, 0).otherwise(margin) - F.when(last, 0).otherwise(margin)
    part = df.withColumn("_part", F.slice(codes, start, F.greatest(length, F.lit(0))))
    whole = part.groupBy(*keys).agg(F.max("n_tokens").cast("int").alias("n_tokens"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("window", "_part"))), lambda x: x["_part"])).alias("codes"))
    zeros = F.transform(F.array_repeat(F.lit(0), F.greatest(F.col("n_tokens") - F.size("codes"), F.lit(0))), lambda x: x.cast("bigint"))
    return whole.withColumn("codes", F.concat(F.slice("codes", F.lit(1), F.col("n_tokens")), zeros))


def residual_windows(df: DataFrame, data: str, tokens: int, stride: int, margin: int = 2) -> DataFrame:
    """Windows as for residual codes: one begins at every step up to the last sample, and tells how many tokens are real.

    Adds window, n_windows, n_tokens (of the whole), valid and chunk (filled with zeros).  Input of one window
    at most has one; empty input has none.
    """
    size, step = tokens * stride, (tokens - 2 * margin) * stride
    if step <= 0:
        raise ValueError("the margins leave nothing of a window")
    n = F.size(data)
    rows = df.where(n > 0).withColumn("n_windows", F.when(n <= size, 1).otherwise(F.ceil(n / step)).cast("int")).withColumn("n_tokens", F.ceil(n / stride).cast("int"))
    rows = rows.withColumn("window", F.explode(F.sequence(F.lit(0), F.col("n_windows") - 1)))
    own = F.slice(data, F.col("window") * step + 1, F.lit(size))
    return rows.withColumn("valid", F.ceil(F.size(own) / stride).cast("int")).withColumn("chunk", F.concat(own, F.array_repeat(F.lit(0.0), size - F.size(own))))


def stitch_levels(df: DataFrame, keys: list[str], codes: str, levels: int, margin: int = 2) -> DataFrame:
    """Codes of residual windows (for each token an array of its levels) as one array, token by token.

    The first window ends before its last margin or with its real tokens, the last one begins after a margin,
    and inner ones give their real tokens less both margins.  Cut, or filled with zeros, to n_tokens.
    """
    t, k, valid = F.size(codes), F.col("window"), F.col("valid")
    only, first, last = F.col("n_windows") == 1, k == 0, k == F.col("n_windows") - 1
    start = F.when(first, 0).otherwise(margin)
    length = F.when(only, valid).when(first, F.least(t - margin, valid)).when(last, valid - margin).otherwise(F.when(t > 2 * margin, valid - 2 * margin).otherwise(0))
    part = df.withColumn("_part", F.slice(codes, start + 1, F.greatest(length, F.lit(0))))
    whole = part.groupBy(*keys).agg(F.max("n_tokens").alias("n_tokens"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("window", "_part"))), lambda x: x["_part"])).alias("codes"))
    whole = whole.withColumn("codes", F.flatten(F.slice("codes", F.lit(1), F.greatest(F.col("n_tokens"), F.lit(0)))))
    zeros = F.transform(F.array_repeat(F.lit(0), F.greatest(F.col("n_tokens") * levels - F.size("codes"), F.lit(0))), lambda x: x.cast("bigint"))
    return whole.withColumn("codes", F.concat("codes", zeros))


def token_cut(tokens: Column, total_tokens: Column, bases: Column) -> Column:
    """The base at which so many tokens of a piece end, halves to even; 0 without tokens."""
    return F.coalesce(F.bround(F.try_divide(tokens * bases, total_tokens)), F.lit(0.0)).cast("int")


def stitch_by_tokens(df: DataFrame, keys: list[str], order: str, bases: str, tokens: str, size: int, overlap: int) -> DataFrame:
    """Called bases of overlapping token windows joined; half of the overlap goes at each inner edge.

    Cuts are at a piece's own bases for a token.  As the last window is moved back to end with the whole,
    the first piece ends after stub = (total - overlap) mod (size - overlap) tokens and half of the overlap
    where the stub isn't 0.  A single piece stays whole, and so do all without an overlap.
    """
    if overlap >= size > 0:
        raise ValueError("the overlap must be smaller than the window")
    w, half = Window.partitionBy(*keys), overlap // 2
    rows = df.withColumn("_k", F.row_number().over(w.orderBy(order))).withColumn("_n", F.count("*").over(w)).withColumn("_total", F.max(F.col(order) + F.col(tokens)).over(w))
    n, first = F.length(bases), F.col("_k") == 1
    if overlap <= 0 or size <= 0:
        stub, left, right = F.lit(0).cast("long"), F.lit(0), n
    else:
        stub = F.pmod(F.col("_total") - overlap, F.lit(size - overlap)).cast("long")
        end = F.when(first & (stub > 0), stub + half).otherwise(size - half)
        left = F.when(first, 0).otherwise(token_cut(F.lit(half), F.col(tokens), n))
        right = F.when(F.col("_k") == F.col("_n"), n).otherwise(token_cut(end, F.col(tokens), n))
    part = rows.withColumn("_part", F.substring(bases, left + 1, F.greatest(right - left, F.lit(0)))).withColumn("_stub", stub)
    return part.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_part"))), lambda x: x["_part"]), "").alias("bases"), F.max("_stub").alias("stub"))
