"""Token counts without ids: pieces are counted once per distinct pre-token.

Each task cuts its texts into pre-tokens and gathers, for a block of texts, one row per distinct
pre-token with its postings (document in the block, frequency; as gaps, a byte or two each).  The rows meet by pre-token, so a
word in a third of all texts has one row per block, not one per text; sorted partitions let a task
merge each distinct pre-token once and attach the count to all its postings.  The rows then return
to their block, where counts times frequencies are summed.

Null text: no tokens, no bytes.  Repeated rows give repeated results.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm.bpe import load
from wavecrest.llm.common import table

#: A block ends at so many bytes of text, or so many texts (an index in it has 16 bits).
BLOCK_BYTES, BLOCK_DOCS = 48 << 20, 60_000
HEADER = np.dtype([("doc_id", "<i8"), ("bytes", "<i8"), ("null", "u1")])


def packed(piece: np.ndarray, doc: np.ndarray, n: np.ndarray, pieces: int) -> tuple[bytes, np.ndarray]:
    """Postings in order of piece and document as numbers of 7 bits a byte; the offset of each piece.

    A posting is twice the gap to the document before; a frequency over one adds 2 * (n - 2) + 1.
    """
    first = np.concatenate([[True], piece[1:] != piece[:-1]])
    gap = np.where(first, doc, np.diff(doc, prepend=0))
    more = n > 1
    at = np.arange(len(gap)) + np.cumsum(more) - more
    values = np.empty(len(gap) + int(more.sum()), np.int64)
    values[at] = gap << 1
    values[at[more] + 1] = (n[more] - 2) << 1 | 1
    size = np.ones(len(values), np.int64)
    k = 7
    while (longer := values >> k > 0).any():
        size += longer
        k += 7
    start = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(int(start[-1]), np.uint8)
    for k in range(int(size.max(initial=0))):
        has = np.flatnonzero(size > k)
        out[start[has] + k] = values[has] >> 7 * k & 127 | np.where(size[has] > k + 1, 128, 0)
    last = np.searchsorted(piece, np.arange(pieces), "right")
    ends = start[np.concatenate([at, [len(values)]])[last]]
    return out.tobytes(), np.concatenate([[0], ends]).astype(np.int32)


def unpacked(data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of packed postings that end at the bounds (0 first): documents, frequencies, postings in each row."""
    ends = np.flatnonzero(data < 128)
    start = np.concatenate([[0], ends[:-1] + 1])
    head = data[start]
    values = (head & 127).astype(np.int64)
    open_ = np.flatnonzero(head > 127)
    k = 1
    while len(open_):
        now = data[start[open_] + k]
        values[open_] |= (now & 127).astype(np.int64) << 7 * k
        open_ = open_[now > 127]
        k += 1
    post = values & 1 == 0
    upto = np.concatenate([[0], np.cumsum(post)])
    sizes = np.diff(upto[np.searchsorted(ends, bounds)])
    doc = np.cumsum(values[post] >> 1)
    before = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    doc -= np.repeat(np.concatenate([[0], doc])[before], sizes)
    n = np.ones(len(doc), np.int64)
    n[upto[:-1][~post] - 1] += (values[~post] >> 1) + 1
    return doc, n, sizes


class _Block:
    def __init__(self) -> None:
        self.docs: list[tuple[int | None, int]] = []
        self.ids: dict[str, int] = {}
        self.codes: list[np.ndarray] = []
        self.bytes = 0

    def add(self, doc_id: int | None, text: str, cut) -> None:
        size = len(text.encode())
        ids, put = self.ids, self.ids.setdefault
        own = np.fromiter((put(p, len(ids)) for p in cut(text)), np.int64)
        self.codes.append(own << 16 | len(self.docs))
        self.docs.append((doc_id, size))
        self.bytes += size

    def rows(self, block: int) -> pa.RecordBatch:
        codes, counts = np.unique(np.concatenate(self.codes), return_counts=True)
        blob, ends = packed(codes >> 16, codes & 0xFFFF, counts, len(self.ids))
        head = np.array([(d or 0, s, d is None) for d, s in self.docs], HEADER).tobytes()
        body = pa.Array.from_buffers(pa.binary(), len(self.ids), [None, pa.py_buffer(ends), pa.py_buffer(blob)])
        keys = pa.array([f"\x00{block}", *self.ids], pa.string())
        return pa.RecordBatch.from_arrays([keys, pa.array(np.full(len(keys), block)), pa.concat_arrays([pa.array([head], pa.binary()), body])], ["pre_token", "block", "postings"])


def _gather(tokenizer: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)

        def cut(text: str) -> Iterator[str]:
            for special, part in bpe.segments(text):
                if special is None:
                    yield from bpe.pattern.findall(bpe.normal(part))
                else:
                    yield f"\x01{part}"

        part, done, block = TaskContext.get().partitionId(), 0, _Block()
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                block.add(doc_id.as_py(), text.as_py() or "", cut)
                if block.bytes >= BLOCK_BYTES or len(block.docs) >= BLOCK_DOCS:
                    yield block.rows(part << 24 | done)
                    block, done = _Block(), done + 1
        if block.docs:
            yield block.rows(part << 24 | done)

    return run


def _count(tokenizer: str):
    """Rows sorted by pre-token: each distinct one is merged once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        last, n = None, 0
        for batch in batches:
            out = np.empty(batch.num_rows, np.int32)
            for k, p in enumerate(batch.column(0).to_pylist()):
                if p != last:
                    last = p
                    n = -1 if p[0] == "\x00" and p[1:].isdigit() and len(p) > 1 else 1 if p[0] == "\x01" and p[1:] in bpe.special else len(bpe.piece(p))
                out[k] = n
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(out), batch.column(2)], ["block", "n", "postings"])

    return run


def _sum(limit: int):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])

    def finish(head: bytes, total: np.ndarray) -> pa.RecordBatch:
        docs = np.frombuffer(head, HEADER)
        n = total[: len(docs)]
        return pa.RecordBatch.from_arrays([pa.array(docs["doc_id"], mask=docs["null"].astype(bool)), pa.array(docs["bytes"]), pa.array(n), pa.array(n > limit)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, head, total = None, b"", np.zeros(1 << 16, np.int64)
        for batch in batches:
            blocks = batch.column(0).to_numpy()
            counts = batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(blocks)) + 1), len(blocks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                if blocks[a] != now:
                    if now is not None:
                        yield finish(head, total)
                    now, head, total = blocks[a], b"", np.zeros(1 << 16, np.int64)
                part, n = batch.column(2).slice(a, b - a), counts[a:b]
                for k in np.flatnonzero(n < 0):
                    head = part[int(k)].as_py()
                body = part.filter(pa.array(n >= 0))
                if len(body):
                    n = n[n >= 0]
                    ends = np.frombuffer(body.buffers()[1], np.int32)[body.offset : body.offset + len(body) + 1]
                    doc, times, sizes = unpacked(np.frombuffer(body.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends - ends[0])
                    total += np.bincount(doc, times * np.repeat(n, sizes).astype(np.float64), 1 << 16).astype(np.int64)
        if now is not None:
            yield finish(head, total)

    return run


def token_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for each row.

    In a text a pre-token is never empty and holds no character \\x00 or \\x01 before a number or a
    special string only: such a one has its own row kinds, which are told apart by their whole form.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_gather(tokenizer), "pre_token string, block long, postings binary")
    counted = rows.repartition(n, "pre_token").sortWithinPartitions("pre_token").mapInArrow(_count(tokenizer), "block long, n int, postings binary")
    return counted.repartition(n, "block").sortWithinPartitions("block").mapInArrow(_sum(limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
