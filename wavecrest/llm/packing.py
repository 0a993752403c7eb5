"""Packing by lexical retrieval: BM25 neighbours of a seed document fill its window.

Documents are encoded once into a table of ids.  Document frequencies of all terms (token ids, so at
most one number for each vocabulary entry) come from the whole table.  The table is cut into shards
of bounded size, each with its own inverted index, and no row is shuffled.  In a shard, the full
windows of a long document are sequences of their own.  Then the largest rest is a seed: its unused
BM25 neighbours, scored by all its distinct terms, fill the window in order of score, whole ones first;
the best one left is cut to fill it exactly.  Neighbours in other shards aren't seen.  What is left of a
shard, less than a window, goes on with the task's next shard; the last one's is cut into powers of two,
so nothing is padded.

Null text: empty, only the end id.  Repeated rows are packed each by itself.  Other columns are
ignored.  An empty table gives no pieces.  Ties in score: the row that came first in the shard.
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

from wavecrest.llm.bpe import load, release
from wavecrest.llm.common import materialize, slices, table

#: A shard ends at so many tokens.
SHARD_TOKENS = 3_000_000
TERM = np.dtype([("term", "<u2"), ("n", "<i8")])
K1, B = 1.2, 0.75
#: Terms that one document in so many has are summed as rows of a matrix, not from lists.
DENSE = 16
#: So many best neighbours are sorted before the others.
FIRST = 256
COLUMNS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_table(docs: DataFrame, tokenizer: str, end_id: int) -> tuple[DataFrame, DataFrame]:
    """Rows (doc_id, ids, n) with the end id, 16 bits an id, and each task's document frequencies (term, n_docs).

    One pass over the texts, written to the shared folder.
    """
    schema = "doc_id long, ids binary, n int, terms binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        gc.disable()  # the caches are large and hold no cycles
        end = end_id.to_bytes(2, "little")
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for part in slices(batch):
                ids = [x + end for x in bpe.encode_many(part.column(1).to_pylist())]
                terms, _, _ = distinct_terms([np.frombuffer(x, "<u2") for x in ids])
                total += np.bincount(terms, minlength=1 << 16)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(ids, pa.binary()), pa.array([len(x) // 2 for x in ids], pa.int32()), pa.nulls(len(ids), pa.binary())], ["doc_id", "ids", "n", "terms"])
        gc.enable()
        terms = np.flatnonzero(total)
        packed = np.rec.fromarrays([terms, total[terms]], dtype=TERM).tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int32()), pa.array([packed], pa.binary())], ["doc_id", "ids", "n", "terms"])

    rows = materialize(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema))
    return rows.where("terms is null").select("doc_id", "ids", "n"), rows.where("terms is not null").select("terms")


def term_counts(parts: DataFrame) -> DataFrame:
    """term, n_docs over all rows; a task has at most one row for each vocabulary entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for batch in batches:
            for x in batch.column(0):
                own = np.frombuffer(x.as_buffer(), TERM)
                total[own["term"]] += own["n"]
        terms = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(terms.astype(np.int32)), pa.array(total[terms])], ["term", "n"])

    return parts.mapInArrow(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n_docs"))


def distinct_terms(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document by document the distinct terms, the documents' numbers, and the terms' counts there."""
    owner = np.repeat(np.arange(len(docs), dtype=np.uint32), [len(d) for d in docs])
    both = np.sort(owner << np.uint32(16) | np.concatenate(docs)) if len(docs) <= 1 << 16 else np.sort(owner.astype(np.uint64) << np.uint64(16) | np.concatenate(docs))
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]]))
    found = both[first]
    return (found & 0xFFFF).astype(np.uint16), (found >> 16).astype(np.int32), np.diff(np.concatenate([first, [len(both)]]))


class Shard:
    """An inverted index over the documents of one shard; terms of one document in DENSE and more are rows of a matrix."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        terms, owner, tf = distinct_terms(docs)
        tf = tf.astype(np.float32)
        sizes = np.bincount(owner, minlength=len(docs))
        length = np.repeat(np.array([len(d) for d in docs], np.float32), sizes)
        weight = idf[terms] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))
        order = np.argsort(terms, kind="stable")
        # as bincount() takes them
        self.owner, self.weight = owner[order].astype(np.intp), weight[order].astype(np.float64)
        self.bounds = np.searchsorted(terms[order], np.arange((1 << 16) + 1))
        self.ends = np.cumsum(sizes)
        self.terms, self.n = terms, len(docs)
        common = np.flatnonzero(np.diff(self.bounds) * DENSE >= self.n)
        self.row = np.full(1 << 16, -1, np.int32)
        self.row[common] = np.arange(len(common))
        self.dense = np.zeros((len(common), self.n), np.float32)
        for k, t in enumerate(common.tolist()):
            at = slice(self.bounds[t], self.bounds[t + 1])
            self.dense[k, self.owner[at]] = self.weight[at]

    def scores(self, k: int) -> np.ndarray:
        """BM25 of each document for all distinct terms of document k; 0: no term in common."""
        own = self.terms[self.ends[k - 1] if k else 0 : self.ends[k]]
        rows = self.row[own]
        out = np.zeros(self.n, np.float32)
        for r in rows[rows >= 0].tolist():
            out += self.dense[r]
        lists = [slice(self.bounds[t], self.bounds[t + 1]) for t in own[rows < 0].tolist()]
        if lists:
            out = out + np.bincount(np.concatenate([self.owner[s] for s in lists]), np.concatenate([self.weight[s] for s in lists]), self.n)
        return out


def by_score(near: np.ndarray, score: np.ndarray) -> np.ndarray:
    """Neighbours by falling score, then position."""
    return near[np.argsort(-score, kind="stable")]


def pack_shard(docs: list[np.ndarray], idf: np.ndarray, mean: float, window: int, begin: list[int] | None = None, last: bool = True) -> Iterator[list[tuple[int, int, int]]]:
    """Sequences, each a list of (document in the shard, start, length).

    begin: where each document's tokens that are still to be packed start.  Unless this is the last shard,
    less than a window is left; its documents and starts are returned.
    """
    size = np.array([len(d) for d in docs])
    from_ = np.zeros(len(docs), np.int64) if begin is None else np.array(begin, np.int64)
    start = from_ + (size - from_) // window * window
    for k in np.flatnonzero(start > from_):
        for at in range(int(from_[k]), int(start[k]), window):
            yield [(int(k), at, window)]
    rest = size - start
    order = np.argsort(-rest, kind="stable")
    index = Shard(docs, idf, mean)
    at, left = 0, int(rest.sum())

    def take(seq: list, k: int, n: int) -> None:
        seq.append((k, int(start[k]), n))
        start[k] += n
        rest[k] -= n

    def fill(near: np.ndarray, room: int, cut: int) -> tuple[int, int]:
        """Take whole neighbours in this order while they fit; cut: the first one that didn't."""
        size, j = rest[near], 0
        while room:
            fits = size[j:] <= room
            step = int(fits.argmax()) if len(fits) else 0
            if cut < 0 and len(fits) and not fits[0]:
                cut = int(near[j])
            if not len(fits) or not fits[step]:
                break
            n = int(size[j + step])
            take(seq, int(near[j + step]), n)
            room -= n
            j += step + 1
        return room, cut

    while left >= window:
        while not rest[order[at]]:
            at += 1
        seed = int(order[at])
        seq: list[tuple[int, int, int]] = []
        room = window - int(rest[seed])
        take(seq, seed, int(rest[seed]))
        if room:
            score = index.scores(seed)
            near = np.flatnonzero((score > 0) & (rest > 0))
            score, cut = score[near], -1
            # the first ones are sorted alone, as most windows are full or nearly full by them
            top = score >= (np.partition(score, len(score) - FIRST)[len(score) - FIRST] if len(near) > 2 * FIRST else 0)
            room, cut = fill(by_score(near[top], score[top]), room, cut)
            if room and not top.all():
                # once it is known which one may be cut, the others count only if they fit
                more = ~top & (rest[near] <= room) if cut >= 0 else ~top
                room, cut = fill(by_score(near[more], score[more]), room, cut)
            if room and cut >= 0:
                take(seq, cut, room)
                room = 0
            j = at
            while room:
                k = int(order[j])
                if rest[k]:
                    n = min(room, int(rest[k]))
                    take(seq, k, n)
                    room -= n
                j += 1
        left -= window
        yield seq
    if not last:
        return [(int(k), int(start[k])) for k in np.flatnonzero(rest)]
    power = 1 << max(0, left.bit_length() - 1)
    j, seq, room = at, [], power
    while left:
        while not rest[order[j]]:
            j += 1
        k = int(order[j])
        n = min(room, int(rest[k]))
        take(seq, k, n)
        room -= n
        left -= n
        if not room:
            yield seq
            power = 1 << max(0, left.bit_length() - 1)
            seq, room = [], power
    return []


def pack_documents(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1, window: int = 2048, shard_tokens: int = SHARD_TOKENS, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset; with_ids adds ids."""
    tokens, parts = encode_table(docs, tokenizer, end_id)
    spark = docs.sparkSession
    # one number for each entry of the vocabulary: at most 65,536 rows
    frequency = np.zeros(1 << 16)
    for r in term_counts(parts).collect():
        frequency[r.term] = r.n_docs
    n_docs, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    idf = np.log1p((n_docs - frequency + 0.5) / (frequency + 0.5)).astype(np.float32)
    shared = spark.sparkContext.broadcast((idf, max(1.0, total / max(1, n_docs))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, mean = shared.value
        release(tokenizer)  # the encoding tasks of this worker are over
        part, number = TaskContext.get().partitionId(), 0

        names: list = []
        held: list[np.ndarray] = []
        begin: list[int] = []

        def finish(last: bool) -> Iterator[pa.RecordBatch]:
            """Pack what is held; what is left of it stays held."""
            nonlocal number, names, held, begin
            rows, packing = [], pack_shard(held, idf, mean, window, begin, last)
            while True:
                try:
                    seq = next(packing)
                except StopIteration as end:
                    rest = end.value
                    break
                offset = 0
                for k, a, n in seq:
                    ids = held[k][a : a + n].astype("<u4")
                    rows.append((names[k], a, n, zlib.crc32(ids.tobytes()), len(held[k]), part << 40 | number, offset, *([ids.tolist()] if with_ids else [])))
                    offset += n
                number += 1
                if len(rows) >= 4096:
                    yield batch_of(rows)
                    rows = []
            if rows:
                yield batch_of(rows)
            names, held, begin = [names[k] for k, _ in rest], [held[k] for k, _ in rest], [a for _, a in rest]

        size = 0
        for batch in batches:
            for name, ids in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                held.append(np.frombuffer(ids.as_py(), "<u2"))
                begin.append(0)
                size += len(held[-1])
                if size >= shard_tokens:
                    yield from finish(False)
                    size = 0
        if held:
            yield from finish(True)

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in cols[:7]] + [pa.array(c, pa.list_(pa.int64())) for c in cols[7:]]
        return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"][: len(cols)])

    return tokens.select("doc_id", "ids").mapInArrow(run, COLUMNS + (", ids array<long>" if with_ids else ""))


def op4_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
