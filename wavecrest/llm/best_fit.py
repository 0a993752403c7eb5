"""Packing of whole documents by the sum of squares.

Documents are encoded once into a table of pieces: only a document longer than a window is cut, into whole
windows and a rest that comes first.  Whole windows are sequences of their own.  The rests are dealt evenly
to shards of bounded size and packed there, longest first: each goes where the squared counts of open
sequences per gap become smallest, so that no gap is left in numbers that nothing fills.  A new sequence is
opened only if no open one has room (with the longest first, opening them early as the online rule allows
costs about 1 % more sequences and gains nothing).  Ties: the smallest gap.

A shard wastes less than a window where short documents are among its rests; more shards cost at most
their number of sequences, one in some thousands.

Null text: empty, only the end id.  Repeated rows are packed each by itself.  Other columns are ignored,
whatever their names.  An empty table gives no pieces.  A text of any length is encoded whole.  Rows that
are alike in all columns can stand for each other, so a repeated task gives the same rows.
"""

from __future__ import annotations

import gc
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm.bpe import load
from wavecrest.llm.common import materialize, slices, table

#: Pieces of a shard, a few MB in its task.
SHARD_PIECES = 20_000
PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]
PIECE_DDL = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, window: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: whole windows, and what is over before them."""
    first = n % window or window
    return [(0, min(first, n)), *((at, window) for at in range(first, n, window))]


def piece_table(docs: DataFrame, tokenizer: str, end_id: int, window: int, with_ids: bool = False) -> DataFrame:
    """One row for each piece of a document; one pass over the texts, written to the shared folder."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        gc.disable()  # the caches are large and hold no cycles
        for batch in batches:
            for part in slices(batch, 2048):
                ids, ends = bpe.encode_flat(part.column(1))
                # each document's end id after its own
                ids = np.insert(ids.astype("<u4"), ends, end_id)
                ends = ends + 1 + np.arange(len(ends))
                rows = []
                for doc_id, to, n in zip(part.column(0).to_pylist(), ends.tolist(), np.diff(ends, prepend=0).tolist(), strict=True):
                    for k, (at, size) in enumerate(cuts(n, window)):
                        own = ids[to - n + at : to - n + at + size]
                        rows.append((doc_id, k, at, size, zlib.crc32(own), *([own.tolist()] if with_ids else [])))
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], [*PIECE, "ids"][: len(rows[0])])
        gc.enable()

    return materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECE_DDL + (", ids array<long>" if with_ids else "")))


class SumOfSquares:
    """Open sequences by their gap, each a stack; puts an item where the squared counts become smallest."""

    def __init__(self, window: int) -> None:
        self.window = window
        self.count = np.zeros(window + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]
        self.n = 0

    def put(self, size: int) -> tuple[int, int]:
        """(sequence, offset) of the next item."""
        gaps = self.count[size:]
        # the sum changes by 2 (1 + N[g - size] - N[g]) as one sequence goes from gap g to g - size; by 1 - 2 N[g] as it is closed
        change = 2 * (1 + self.count[: len(gaps)] - gaps)
        change[0] = 1 - 2 * gaps[0]
        has = np.flatnonzero(gaps)
        if len(has):
            gap = size + int(has[change[has].argmin()])
            self.count[gap] -= 1
            sequence = self.open[gap].pop()
        else:
            gap, sequence, self.n = self.window, self.n, self.n + 1
        rest = gap - size
        if rest:
            self.count[rest] += 1
            self.open[rest].append(sequence)
        return sequence, self.window - gap


def pack_best(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, window: int = 2048, shard_pieces: int = SHARD_PIECES, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset; with_ids adds ids."""
    pieces = piece_table(docs, tokenizer, end_id, window, with_ids)
    names = [*PIECE, *(["ids"] if with_ids else [])]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(number + 2 * np.arange(n)), pa.array(np.zeros(n, np.int64))], [*names, "sequence_id", "offset"])
            number += 2 * n

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held)
        # an order of the rows' own, whatever order they came in
        rows = rows.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        state, number = SumOfSquares(window), (TaskContext.get().partitionId() << 33) + 1
        places = [state.put(n) for n in rows.column("length").to_pylist()]
        rows = rows.append_column("sequence_id", pa.array([number + 2 * s for s, _ in places], pa.int64())).append_column("offset", pa.array([o for _, o in places], pa.int64()))
        yield from rows.to_batches(max_chunksize=4096)

    ddl = PIECE_DDL + (", ids array<long>" if with_ids else "") + ", sequence_id long, offset long"
    full, rests = pieces.where(F.col("length") == window), pieces.where(F.col("length") < window)
    shards = max(1, -(-rests.count() // shard_pieces))
    # even sequence numbers: whole windows; odd ones: packed
    return full.select(names).mapInArrow(whole, ddl).unionByName(rests.select(names).repartition(shards).mapInArrow(packed, ddl))


def op13_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_best(table(spark, sf_dir, "documents"))
