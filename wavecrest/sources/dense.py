"""Dense arrays in shards: a data source that reads byte ranges of array files and writes shards behind a manifest.

``spark.read.format("dense")`` plans one task for each range of at most ``rangeBytes`` from the arrays' headers
(or from the manifest, which costs no read for each file), so a file of any size is shared by many tasks and
none reads a whole one.  ``df.write.format("dense")`` writes shards of at most ``shardRows`` rows into a hidden
folder; they get their names, and the manifest, only when the driver commits, and an aborted job leaves
nothing.  ``rows_at`` reads single rows by their global index.

Files are reached through pyarrow, so the stores it knows (local, hdfs, s3, gs) can hold them.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wavecrest.operators.joins import locate

#: Names of the manifest and in it.
MANIFEST = "shards.json"
TOTAL, WIDTH, LARGEST, SHARDS = "total_tokens", "feature_dim", "shard_size_max_tokens", "shards"
SHARD_FILE, START, ROWS, SHAPE = "shard_file", "start_token_index", "num_tokens", "shape"

RANGE_BYTES, SHARD_ROWS, BATCH_BYTES = 64 << 20, 65_536, 4 << 20
#: Open files that a task keeps, and rows between two wanted ones that are read along.
OPEN_FILES, GAP_ROWS = 256, 64
SCHEMA = "path string, row long, index long, data array<float>"


@dataclass(frozen=True)
class Array:
    """Where the rows of an array file lie.  A one-dimensional array is one row."""

    path: str
    rows: int
    width: int
    kind: str
    offset: int
    by_column: bool = False

    @property
    def row_bytes(self) -> int:
        return max(1, self.width * np.dtype(self.kind).itemsize)


@dataclass
class Range(InputPartition):
    """Rows [first, last) of a file; start is the global index of the file's first row."""

    array: Array
    first: int
    last: int
    start: int


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    try:
        return fs.FileSystem.from_uri(path)
    except pa.ArrowInvalid as e:
        raise ValueError(f"no way to read ranges of {path!r}: {e}") from e


def header_of(store: fs.FileSystem, path: str, raw_width: int = 0) -> Array | None:
    """The layout of a file; None for arrays of more than two dimensions.  Nothing is unpickled.

    raw_width: the file has no header, only rows of so many little-endian 32-bit numbers.
    """
    if raw_width:
        size = store.get_file_info(path).size
        if size % (4 * raw_width):
            raise ValueError(f"{path} doesn't hold whole rows of {raw_width} numbers")
        return Array(path, size // (4 * raw_width), raw_width, "<f4", 0)
    with store.open_input_file(path) as f:
        try:
            version = np.lib.format.read_magic(f)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, by_column, kind = read(f)
        except (ValueError, EOFError) as e:
            raise ValueError(f"{path} is no array file: {e}") from e
        if kind.hasobject or kind.kind not in "biuf":
            raise ValueError(f"{path} holds {kind}, not numbers")
        size, at = f.size(), f.tell()
    if len(shape) not in (1, 2):
        return None
    rows, width = shape if len(shape) == 2 else (1, shape[0])
    found = Array(path, rows if width else 0, width, kind.str, at, bool(by_column and len(shape) == 2))
    if at + found.rows * found.row_bytes > size:
        raise ValueError(f"{path} ends before its {rows} rows")
    return found


def read_rows(f: pa.NativeFile, array: Array, first: int, last: int) -> np.ndarray:
    """Rows [first, last) as 32-bit floats; nothing else of the file is read."""
    n, kind = last - first, np.dtype(array.kind)
    if not array.by_column:
        f.seek(array.offset + first * array.row_bytes)
        return np.frombuffer(f.read(n * array.row_bytes), kind).reshape(n, array.width).astype(np.float32)
    out = np.empty((n, array.width), np.float32)
    for k in range(array.width):
        f.seek(array.offset + (k * array.rows + first) * kind.itemsize)
        out[:, k] = np.frombuffer(f.read(n * kind.itemsize), kind)
    return out


def lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]), pa.array(np.ascontiguousarray(x).ravel()))


class DenseReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.range_bytes = int(options.get("rangeBytes", RANGE_BYTES))
        self.exact = int(options["exact"]) if "exact" in options else None
        self.raw = int(options.get("rawWidth", 0))
        self.suffix = options.get("suffix", ".npy")

    def paths(self) -> list[str]:
        """Files of the folder and those below it, without hidden ones."""
        store, root = open_store(self.path)
        if store.get_file_info(root).type == fs.FileType.File:
            return [root]
        found = store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted(x.path for x in found if x.is_file and x.path.endswith(self.suffix) and not any(n[:1] in "._" for n in x.path[len(root) :].strip("/").split("/")))

    def arrays(self) -> list[tuple[Array, int]]:
        """Files in the order of their global index, and the index of the first row of each."""
        store, root = open_store(self.path)
        manifest = f"{root}/{MANIFEST}"
        if not self.raw and store.get_file_info(manifest).type == fs.FileType.File:
            with store.open_input_file(manifest) as f:
                shards = json.loads(f.read())[SHARDS]
            # all of one writer, so of one layout
            first = header_of(store, f"{root}/{shards[0][SHARD_FILE]}") if shards else None
            return [(Array(f"{root}/{s[SHARD_FILE]}", *s[SHAPE], first.kind, first.offset, first.by_column), s[START]) for s in shards]
        with ThreadPoolExecutor(16) as pool:
            arrays = [a for a in pool.map(lambda p: header_of(store, p, self.raw), self.paths()) if a is not None and a.width]
        out, start = [], 0
        for a in arrays:
            if self.exact is None or a.width == self.exact:
                out.append((a, start))
                start += a.rows
        return out

    def partitions(self) -> list[Range]:
        out = []
        for a, start in self.arrays():
            step = max(1, self.range_bytes // a.row_bytes)
            out += [Range(a, at, min(at + step, a.rows), start) for at in range(0, a.rows, step)]
        return out

    def read(self, partition: Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:
            # no array has a row
            return
        a = partition.array
        store, _ = open_store(self.path)
        step = max(1, BATCH_BYTES // a.row_bytes)
        with store.open_input_file(a.path) as f:
            for at in range(partition.first, partition.last, step):
                x = read_rows(f, a, at, min(at + step, partition.last))
                row = np.arange(at, at + len(x))
                yield pa.RecordBatch.from_arrays([pa.array([a.path] * len(x)), pa.array(row), pa.array(row + partition.start), lists(x)], ["path", "row", "index", "data"])


@dataclass
class Written(WriterCommitMessage):
    """What a task wrote: its number, and the hidden files with their rows."""

    task: int
    files: list[tuple[str, int]]


class DenseWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool) -> None:
        self.path, self.width, self.overwrite = options["path"], int(options["width"]), overwrite
        self.shard_rows = int(options.get("shardRows", SHARD_ROWS))
        self.hidden = f"_temporary-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        store, root = open_store(self.path)
        store.create_dir(f"{root}/{self.hidden}", recursive=True)
        task, files, held, n = TaskContext.get().partitionId(), [], [], 0

        def close(x: np.ndarray) -> None:
            # a repeated task has names of its own
            name = f"{self.hidden}/{task}-{len(files)}-{uuid.uuid4().hex}.npy"
            with store.open_output_stream(f"{root}/{name}") as out:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": x.shape})
                out.write(x.tobytes())
            files.append((name, len(x)))

        for batch in iterator:
            held.append(self.rows_of(batch.column(0)))
            n += len(held[-1])
            while n >= self.shard_rows:
                x = np.concatenate(held)
                close(x[: self.shard_rows])
                held, n = [x[self.shard_rows :]], n - self.shard_rows
        if n:
            close(np.concatenate(held))
        return Written(task, files)

    def rows_of(self, column: pa.Array) -> np.ndarray:
        """Null elements are NaN; a null row or one of another length is an error."""
        sizes = column.value_lengths()
        if column.null_count or any(k != self.width for k in sizes.unique().to_pylist()):
            raise ValueError(f"a row doesn't have {self.width} numbers")
        return column.flatten().cast(pa.float32()).to_numpy(zero_copy_only=False).astype("<f4").reshape(-1, self.width)

    def commit(self, messages: list) -> None:
        store, root = open_store(self.path)
        store.create_dir(f"{root}/{self.hidden}", recursive=True)
        before = [x.path for x in store.get_file_info(fs.FileSelector(root)) if x.is_file and x.path.endswith((".npy", f"/{MANIFEST}"))]
        if before and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.path} holds arrays already")
        for p in sorted(before, key=lambda p: not p.endswith(MANIFEST)):
            store.delete_file(p)
        files = [x for m in sorted((m for m in messages if m), key=lambda m: m.task) for x in m.files]
        if not files:
            # without rows the shape still tells the width
            name = f"{self.hidden}/0.npy"
            with store.open_output_stream(f"{root}/{name}") as out:
                np.lib.format.write_array_header_1_0(out, {"descr": "<f4", "fortran_order": False, "shape": (0, self.width)})
            files = [(name, 0)]
        shards, start = [], 0
        for k, (name, n) in enumerate(files):
            store.move(f"{root}/{name}", f"{root}/shard_{k:05d}.npy")
            shards.append({SHARD_FILE: f"shard_{k:05d}.npy", START: start, ROWS: n, SHAPE: [n, self.width]})
            start += n
        manifest = {TOTAL: start, WIDTH: self.width, LARGEST: max(n for _, n in files), SHARDS: shards}
        with store.open_output_stream(f"{root}/{self.hidden}/{MANIFEST}") as out:
            out.write(json.dumps(manifest, indent=2).encode())
        store.move(f"{root}/{self.hidden}/{MANIFEST}", f"{root}/{MANIFEST}")
        store.delete_dir(f"{root}/{self.hidden}")

    def abort(self, messages: list) -> None:
        store, root = open_store(self.path)
        if store.get_file_info(f"{root}/{self.hidden}").type == fs.FileType.Directory:
            store.delete_dir(f"{root}/{self.hidden}")


class DenseSource(DataSource):
    """Options: path; rangeBytes, exact, rawWidth, suffix for reading; width, shardRows for writing."""

    @classmethod
    def name(cls) -> str:
        return "dense"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DenseReader:
        return DenseReader(self.options)

    def writer(self, schema, overwrite: bool) -> DenseWriter:
        return DenseWriter(self.options, overwrite)


def read_dense(spark: SparkSession, path: str, **options) -> DataFrame:
    """path, row, index, data of a folder's arrays, in the order of its manifest, or else of the files' names.

    Two dimensions are rows, one is a row, others are skipped.  exact: only files of rows of that length.
    """
    spark.dataSource.register(DenseSource)
    return spark.read.format("dense").options(**options).load(path)


def write_dense(df: DataFrame, path: str, column: str, width: int, shard_rows: int = SHARD_ROWS, overwrite: bool = False) -> None:
    """The column's vectors, in the order of the frame's partitions, as shards with a manifest.

    A shard holds rows of one task, so at most shard_rows, which also bound a task's memory.
    """
    df.sparkSession.dataSource.register(DenseSource)
    df.select(column).write.format("dense").mode("overwrite" if overwrite else "append").options(width=width, shardRows=shard_rows).save(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """shard, start, rows, width: one row for each shard of a folder, by Spark's reader."""
    shard = f"struct<{SHARD_FILE}: string, {START}: long, {ROWS}: long, {SHAPE}: array<long>>"
    whole = spark.read.schema(f"{SHARDS} array<{shard}>").option("multiLine", True).json(f"{path}/{MANIFEST}")
    return whole.select(F.explode(SHARDS).alias("s")).select(F.col(f"s.{SHARD_FILE}").alias("shard"), F.col(f"s.{START}").alias("start"), F.col(f"s.{ROWS}").alias("rows"), F.col(f"s.{SHAPE}")[1].alias("width"))


def rows_at(wanted: DataFrame, index: str, path: str) -> DataFrame:
    """The wanted rows with ``data``, the vector at their global index; null where there is none.

    Each index is read once, however many rows want it; tasks read runs of a shard in order, and only those.
    """
    spark = wanted.sparkSession
    manifest = read_manifest(spark, path).select("shard", F.col("start").alias("lo"), (F.col("start") + F.col("rows")).alias("hi"))
    places = locate(wanted.select(F.col(index).cast("long").alias("_index")).where("_index is not null").distinct(), "_index", manifest)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = places.select("shard", (F.col("_index") - F.col("lo")).alias("row"), "_index").repartitionByRange(parts, "_index").sortWithinPartitions("_index")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = open_store(path)

        @lru_cache(maxsize=OPEN_FILES)
        def opened(shard: str) -> tuple[pa.NativeFile, Array]:
            return store.open_input_file(f"{root}/{shard}"), header_of(store, f"{root}/{shard}")

        for batch in batches:
            shards, row = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            new = np.flatnonzero(np.array([a != b for a, b in zip(shards, shards[1:], strict=False)], bool) | (np.diff(row) > GAP_ROWS)) + 1
            for a, b in zip([0, *new.tolist()], [*new.tolist(), len(row)], strict=True):
                if a == b:
                    continue
                f, array = opened(shards[a])
                at = a
                while at < b:
                    # runs of a bounded size
                    to = int(np.searchsorted(row[at:b], row[at] + max(1, BATCH_BYTES // array.row_bytes))) + at
                    x = read_rows(f, array, int(row[at]), int(row[to - 1]) + 1)[row[at:to] - row[at]]
                    yield pa.RecordBatch.from_arrays([batch.column(2).slice(at, to - at), lists(x)], ["_index", "data"])
                    at = to

    found = ordered.mapInArrow(run, "_index long, data array<float>")
    return wanted.join(found, wanted[index] == found["_index"], "left").drop("_index")


def file_histograms(spark: SparkSession, path: str, low: float, high: float, bins: int, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """One row for each file: path, status, error, total (finite values) and counts (of each bin, the last one closed).

    A file that can't be read has status error and counts of 0, and no other file is touched by it.  Headers
    are read by tasks, then ranges, so a large file is shared by many.
    """
    names = spark.createDataFrame([(p,) for p in DenseReader({"path": path}).paths()], "path string")
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    edges = np.linspace(low, high, bins + 1)

    def plan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(path)
        for batch in batches:
            out = []
            for p in batch.column(0).to_pylist():
                try:
                    a = header_of(store, p)
                    step = max(1, range_bytes // a.row_bytes) if a else 1
                    out += [(p, at, min(at + step, a.rows), None) for at in range(0, a.rows, step)] if a and a.rows else [(p, 0, 0, None)]
                except Exception as e:  # whatever is wrong with one file
                    out.append((p, 0, 0, str(e)))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], ["path", "first", "last", "error"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = open_store(path)
        for batch in batches:
            for p, first, last, error in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                total, counts = 0, np.zeros(bins, np.int64)
                try:
                    if error is None and last > first:
                        a = header_of(store, p)
                        step = max(1, BATCH_BYTES // a.row_bytes)
                        with store.open_input_file(p) as f:
                            for at in range(first, last, step):
                                x = read_rows(f, a, at, min(at + step, last)).ravel()
                                x = x[np.isfinite(x)]
                                total, counts = total + len(x), counts + np.histogram(x, edges)[0]
                except Exception as e:
                    error = str(e)
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([error], pa.string()), pa.array([total]), pa.array([counts.tolist()], pa.list_(pa.int64()))], ["path", "error", "total", "counts"])

    ranges = names.repartition(min(parts, max(1, names.count()))).mapInArrow(plan, "path string, first long, last long, error string")
    found = ranges.repartition(parts).mapInArrow(count, "path string, error string, total long, counts array<long>")
    sums = found.groupBy("path").agg(F.max("error").alias("error"), F.sum("total").alias("total"), F.array(*(F.sum(F.col("counts")[k]) for k in range(bins))).alias("counts"))
    bad = F.col("error").isNotNull()
    return sums.select("path", F.when(bad, "error").otherwise("success").alias("status"), "error", F.when(bad, 0).otherwise(F.col("total")).alias("total"), F.when(bad, F.array_repeat(F.lit(0).cast("long"), bins)).otherwise(F.col("counts")).alias("counts"))
