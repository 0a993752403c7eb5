"""Readers of file formats, and discovery of files.  All go through Spark's readers, so any store works."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_jsonl(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines, compressed or not; blank lines are skipped.

    strict: a line that isn't an object of the schema is an error.  Otherwise read_id falls back to id,
    and rows without an id or a text are dropped.
    """
    rows = spark.read.schema(schema).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    if strict:
        return rows
    name = F.coalesce(F.when(F.col("read_id") != "", F.col("read_id")), F.col("id"))
    return rows.withColumn("read_id", name).where(F.col("read_id").isNotNull() & (F.col("text") != ""))


def _objects(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    decoder = json.JSONDecoder()
    for batch in batches:
        for text in batch.column(0).to_pylist():
            out, at = [], 0
            while True:
                while at < len(text) and text[at].isspace():
                    at += 1
                if at >= len(text):
                    break
                _, end = decoder.raw_decode(text, at)
                out.append(text[at:end])
                at = end
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(out)], ["json"])
                    out = []
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out)], ["json"])


def read_concatenated_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Objects one after the other, with or without line breaks; a file is read by one task."""
    texts = spark.read.option("wholetext", True).text(path)
    return texts.mapInArrow(_objects, "json string").select(F.from_json("json", schema).alias("x")).select("x.*")


def read_csv_checked(spark: SparkSession, path: str, schema: str, column: str, only: str) -> DataFrame:
    """A CSV whose column must hold one value (the name of its signal file) in all rows."""
    rows = spark.read.schema(schema).option("header", True).csv(path)
    other = rows.where(~F.col(column).eqNullSafe(F.lit(only))).limit(1).collect()
    if other:
        raise ValueError(f"{column} holds {other[0][column]!r}, not only {only!r}")
    return rows


def discover(spark: SparkSession, paths: str, suffix: str, group_by: str = "file", recursive: bool = True) -> DataFrame:
    """path and group of the files in a comma list of files and folders, each once, in order.

    A file of another suffix or no file at all is a ValueError, a missing path a FileNotFoundError.
    """
    if group_by not in ("file", "folder"):
        raise ValueError(f"group_by is file or folder, not {group_by!r}")
    jvm, hadoop = spark._jvm, spark._jsc.hadoopConfiguration()
    found = None
    for name in (p.strip() for p in paths.split(",") if p.strip()):
        path = jvm.org.apache.hadoop.fs.Path(name)
        fs = path.getFileSystem(hadoop)
        if not fs.exists(path):
            raise FileNotFoundError(name)
        if fs.getFileStatus(path).isFile() and not name.endswith(suffix):
            raise ValueError(f"{name} doesn't end in {suffix}")
        reader = spark.read.format("binaryFile").option("pathGlobFilter", f"*{suffix}").option("recursiveFileLookup", recursive)
        own = reader.load(name).select("path")
        found = own if found is None else found.union(own)
    if found is None or not found.limit(1).count():
        raise ValueError(f"no file with {suffix} in {paths!r}")
    folder = F.regexp_extract("path", r"([^/]+)/[^/]*$", 1)
    group = folder if group_by == "folder" else F.regexp_extract("path", r"([^/]+)$", 1)
    return found.distinct().select("path", group.alias("group")).orderBy("path")


def pair_files(listing: DataFrame, left: str = "tokens_", right: str = "reference_") -> DataFrame:
    """key, left, right: files that differ in a prefix; a file without its partner is an error."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    sides = [listing.where(name.startswith(p)).select(F.expr(f"substring(regexp_extract(path, '([^/]+)$', 1), {len(p) + 1})").alias("key"), F.col("path").alias(side)) for p, side in ((left, "left"), (right, "right"))]
    both = sides[0].join(sides[1], "key", "full")
    alone = both.where("left is null or right is null").limit(1).collect()
    if alone:
        raise ValueError(f"no partner for {alone[0].left or alone[0].right}")
    return both


def to_picoampere(raw, offset, value_range, digitisation, whole_offset: bool = True):
    """range / digitisation * (raw + offset) as float; the offset cut to an integer, or as it is."""
    return (value_range / digitisation * (raw + (offset.cast("int") if whole_offset else offset))).cast("float")
