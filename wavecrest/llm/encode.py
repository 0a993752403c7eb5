"""BPE encoding and decoding of whole texts.

Null text: encoded as the empty text.  Empty text: no tokens; the digests are those of the empty
string.  Repeated rows give repeated results; other columns are ignored; an empty table gives an
empty result.  A text of any length is read in blocks, with a state of bounded size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wavecrest.llm.bpe import Bpe, Transducer, Utf8Machine, load
from wavecrest.llm.common import slices, table


def encode_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key and ``ids``, the token ids of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part in slices(batch):
                ids = [bpe.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["key", "ids"])

    return docs.select(F.col(key).cast("long"), text).mapInArrow(run, "key long, ids array<int>").withColumnRenamed("key", key)


def decode_documents(tokens: DataFrame, tokenizer: str = "byte_bpe_50k.json", key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Per row: the key and ``text``, from the ids by the incremental byte-to-text machine; null ids: empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        for batch in batches:
            for part in slices(batch):
                texts = [bpe.decode(x or []) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(texts, pa.string())], ["key", "text"])

    return tokens.select(F.col(key).cast("long"), ids).mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


class _Trip:
    """One text on its way: encoder and decoder state, and the digests so far."""

    def __init__(self, bpe: Bpe) -> None:
        self.encoder, self.decoder = Transducer(bpe), Utf8Machine()
        self.n, self.by_id, self.by_text = 0, hashlib.sha256(), hashlib.sha256()

    def add(self, ids: list[int], names: dict[int, str], data: dict[int, bytes]) -> None:
        if ids:
            self.by_id.update(("," * (self.n > 0) + ",".join(map(names.__getitem__, ids))).encode())
            self.by_text.update(self.decoder.feed(b"".join(map(data.__getitem__, ids))).encode())
            self.n += len(ids)


def round_trip_digests(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", block: int = 4096) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: each text goes block by block through the encoding
    transducer, whose stable ids go through the decoding machine at once; neither ids nor decoded text are held.

    The texts of a batch are read in step, so that words new to the model's cache are merged together.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = load(tokenizer)
        names = {i: str(i) for i in bpe.bytes_of}
        for batch in batches:
            for part in slices(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                trips = [_Trip(bpe) for _ in texts]
                now, at = list(range(len(texts))), 0
                while now:
                    stable = [(k, x) for k in now for x in trips[k].encoder.feed(texts[k][at : at + block], at + block >= len(texts[k]))]
                    packed = iter(bpe.encode_many([x for _, x in stable if isinstance(x, str)], inner=True))
                    for k, x in stable:
                        trips[k].add(np.frombuffer(next(packed), bpe.kind).tolist() if isinstance(x, str) else x, names, bpe.bytes_of)
                    at += block
                    now = [k for k in now if at < len(texts[k])]
                for t in trips:
                    t.by_text.update(t.decoder.close().encode())
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array([t.n for t in trips], pa.int64()), pa.array([t.by_id.hexdigest() for t in trips]), pa.array([t.by_text.hexdigest() for t in trips])], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op2_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
