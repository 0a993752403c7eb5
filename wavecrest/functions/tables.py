"""Table functions for SQL: signals to chunks, token texts to windows, signals to tokens by a named strategy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from wavecrest.functions.arrays import scale

#: Quantisers by name: a signal to one integer for each sample.
STRATEGIES: dict[str, Callable[[np.ndarray], np.ndarray]] = {}


def strategy(name: str) -> Callable:
    """Register a quantiser under a name that SQL can use."""

    def add(f: Callable[[np.ndarray], np.ndarray]) -> Callable[[np.ndarray], np.ndarray]:
        STRATEGIES[name] = f
        return f

    return add


@strategy("round")
def _round(x: np.ndarray) -> np.ndarray:
    return np.floor(x)


@strategy("tens")
def _tens(x: np.ndarray) -> np.ndarray:
    return np.floor(x / 10)


@strategy("mad")
def _mad(x: np.ndarray) -> np.ndarray:
    """Whole steps of the scale around the median."""
    middle = np.median(x)
    return np.floor((x - middle) / scale(x - middle))


class ChunkSignal:
    """chunk_signal(signal, size, overlap): start, stop and samples of the whole windows of a signal."""

    def eval(self, signal: list, size: int, overlap: int) -> Iterator[tuple]:
        if not 0 <= overlap < size:
            raise ValueError("the overlap is less than the size")
        for at in range(0, len(signal or []) - size + 1, size - overlap):
            yield at, at + size, signal[at : at + size]


class TokenWindows:
    """token_windows(text, window, overlap): number, start and text of windows of <|...|> tokens; the last may be shorter."""

    def eval(self, text: str, window: int, overlap: int) -> Iterator[tuple]:
        tokens = [t + "|>" for t in (text or "").split("|>")[:-1]]
        step = window - overlap
        if step <= 0:
            raise ValueError("the overlap is less than the window")
        for k, at in enumerate(range(0, max(1, len(tokens) - overlap) if tokens else 0, step)):
            yield k, at, "".join(tokens[at : at + window])


class TokenizeSignal:
    """tokenize_signal(signal, strategy): the place and token of each sample."""

    def eval(self, signal: list, name: str) -> Iterator[tuple]:
        if name not in STRATEGIES:
            raise ValueError(f"no strategy {name!r}, only {', '.join(sorted(STRATEGIES))}")
        if signal:
            yield from enumerate(STRATEGIES[name](np.array(signal, float)).astype(np.int64).tolist())


TABLE_FUNCTIONS = {
    "chunk_signal": (ChunkSignal, "start: int, stop: int, chunk: array<double>"),
    "token_windows": (TokenWindows, "number: int, start: int, text: string"),
    "tokenize_signal": (TokenizeSignal, "pos: int, token: bigint"),
}


def register(spark: SparkSession) -> None:
    """Make the table functions known to the session's SQL."""
    for name, (cls, kind) in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, udtf(cls, returnType=kind))
