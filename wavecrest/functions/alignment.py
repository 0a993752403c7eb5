"""Measures of alignments, from CIGAR strings and from aligned strings, with built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Operations that use up a reference base.
ON_REFERENCE = ("=", "X", "D")
BASES = "ATGC"


def cigar_operations(cigar: Column) -> Column:
    """An array of (n, op); a missing count is one."""
    n = F.regexp_extract_all(cigar, F.lit(r"(\d*)([=XIDMSHN])"), F.lit(1))
    op = F.regexp_extract_all(cigar, F.lit(r"(\d*)([=XIDMSHN])"), F.lit(2))
    return F.zip_with(n, op, lambda a, b: F.struct(F.when(a == "", 1).otherwise(a.try_cast("long")).cast("long").alias("n"), b.alias("op")))


def error_counts(df: DataFrame, cigar: str) -> DataFrame:
    """Adds n_match, n_mismatch, n_ins, n_del, from one pass over the operations."""
    names = {"n_match": "=", "n_mismatch": "X", "n_ins": "I", "n_del": "D"}
    zero = F.struct(*(F.lit(0).cast("long").alias(c) for c in names))
    step = lambda a, x: F.struct(*((a[c] + F.when(x.op == op, x.n).otherwise(0)).alias(c) for c, op in names.items()))
    return df.withColumn("_counts", F.aggregate(cigar_operations(F.col(cigar)), zero, step)).select(*df.columns, "_counts.*")


def accuracies() -> tuple[Column, Column]:
    """Percent of matches over all operations; balanced: (= - I) / (= + X + D).  0 without operations."""
    m, x, i, d = (F.col(c) for c in ("n_match", "n_mismatch", "n_ins", "n_del"))
    plain, balanced = F.try_divide(100.0 * m, m + x + i + d), F.try_divide(100.0 * (m - i), m + x + d)
    return F.coalesce(plain, F.lit(0.0)), F.coalesce(balanced, F.lit(0.0))


def match_vector(cigar: Column) -> Column:
    """For each reference base 1 where it matches; insertions and clips have none."""
    on = F.filter(cigar_operations(cigar), lambda x: x.op.isin(*ON_REFERENCE))
    return F.flatten(F.transform(on, lambda x: F.array_repeat(F.when(x.op == "=", 1).otherwise(0), x.n.cast("int"))))


def aligned_columns(df: DataFrame, key: str, query: str, ref: str) -> DataFrame:
    """key, i, q, r, ref_pos (reference bases up to here), ref_len: one row for each column of an alignment."""
    cut = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    rows = df.select(key, F.posexplode(F.arrays_zip(cut(F.col(query)).alias("q"), cut(F.col(ref)).alias("r"))).alias("i", "x")).select(key, "i", "x.q", "x.r")
    base = (F.col("r") != "-").cast("long")
    return rows.withColumn("ref_pos", F.sum(base).over(Window.partitionBy(key).orderBy("i"))).withColumn("ref_len", F.sum(base).over(Window.partitionBy(key)))


def confusion(columns: DataFrame) -> DataFrame:
    """kind, ref, query, n: mismatches of bases, deletions by reference base, insertions by query base.

    Lower-case letters count as upper-case ones, all other than A, T, G and C as N.
    """
    gap = lambda c: F.col(c) == "-"
    base = lambda c: F.when(gap(c), "-").when(F.upper(c).isin(*BASES), F.upper(c)).otherwise("N")
    kind = F.when(gap("q"), "deletion").when(gap("r"), "insertion").otherwise("mismatch")
    pairs = columns.select(kind.alias("kind"), base("r").alias("ref"), base("q").alias("query"))
    return pairs.where(F.col("ref") != F.col("query")).groupBy("kind", "ref", "query").agg(F.count("*").alias("n"))


def deletion_positions(columns: DataFrame, key: str) -> DataFrame:
    """Relative position (ref_pos - 1) / ref_len of each deleted base."""
    return columns.where((F.col("q") == "-") & (F.col("r") != "-")).select(key, ((F.col("ref_pos") - 1) / F.col("ref_len")).alias("position"))


def guarded(accuracy: Column, covered: Column, least: float) -> Column:
    """0 where the aligned share of the reference is below the least one."""
    return F.when(covered >= least, accuracy).otherwise(0.0)
