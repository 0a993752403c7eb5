"""Decoding of a conditional random field over k-mer states.

A state is the last k bases, the newest one in the lowest place; state s has n_base predecessors besides
itself, the j-th of which is ``j * n_base**(k - 1) + s // n_base``.  A step has n_base + 1 scores for each
state: of staying there, and of the move from each predecessor, which emits the state's newest base.  Paths
may begin and end in any state.  Models without a score for staying get a constant one.

All functions work on a batch (reads, steps, states, moves) at once; the sums over moves are the only
ones, so a step costs n_base + 1 operations for each state and not the square of the states.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavecrest.functions.sequence import ALPHABET, collapse_path, crf_states

#: Numbers that a block of reads holds at once.
BLOCK = 1 << 22


def state_length(classes: int, n_base: int = 4) -> tuple[int, bool]:
    """k, and whether a step has scores for staying: classes is (n_base + 1) * n_base**k or n_base**(k + 1)."""
    k = crf_states(classes, n_base)
    if not k:
        raise ValueError("a state is one base at least")
    return k, classes == (n_base + 1) * n_base**k


def predecessors(k: int, n_base: int = 4) -> np.ndarray:
    """(states, 1 + n_base): the state itself, then those that move into it."""
    s = np.arange(n_base**k)[:, None]
    return np.concatenate([s, np.arange(n_base) * n_base ** (k - 1) + s // n_base], 1)


def successors(k: int, n_base: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The states reached from each one, itself first, and the number of the move there."""
    s = np.arange(n_base**k)[:, None]
    low = n_base ** (k - 1)
    to = np.concatenate([s, s % low * n_base + np.arange(n_base)], 1)
    return to, np.concatenate([np.zeros_like(s), np.repeat(1 + s // low, n_base, 1)], 1)


def moves(scores: np.ndarray, n_base: int = 4, stay: float = 2.0) -> np.ndarray:
    """(reads, steps, classes) as (reads, steps, states, 1 + n_base)."""
    n, steps, classes = scores.shape
    k, whole = state_length(classes, n_base)
    out = scores.reshape(n, steps, n_base**k, classes // n_base**k)
    return out if whole else np.concatenate([np.full((*out.shape[:3], 1), stay), out], 3)


def _total(x: np.ndarray, log: bool) -> np.ndarray:
    if not log:
        return x.max(-1)
    top = x.max(-1)
    return top + np.log(np.exp(x - top[..., None]).sum(-1))


def forward(m: np.ndarray, k: int, n_base: int = 4, log: bool = True) -> np.ndarray:
    """(reads, steps + 1, states): total of all paths up to a step that end in a state; log false: the best one."""
    before = predecessors(k, n_base)
    out = np.zeros((m.shape[0], m.shape[1] + 1, m.shape[2]))
    for t in range(m.shape[1]):
        out[:, t + 1] = _total(out[:, t][:, before] + m[:, t], log)
    return out


def backward(m: np.ndarray, k: int, n_base: int = 4, log: bool = True) -> np.ndarray:
    """(reads, steps + 1, states): total of all paths from a state on."""
    to, move = successors(k, n_base)
    out = np.zeros((m.shape[0], m.shape[1] + 1, m.shape[2]))
    for t in range(m.shape[1] - 1, -1, -1):
        out[:, t] = _total(m[:, t][:, to, move] + out[:, t + 1][:, to], log)
    return out


def log_partition(m: np.ndarray, k: int, n_base: int = 4) -> np.ndarray:
    return _total(forward(m, k, n_base)[:, -1], True)


def posteriors(m: np.ndarray, k: int, n_base: int = 4) -> np.ndarray:
    """The probability of each move at each step, in the shape of m."""
    a, b = forward(m, k, n_base), backward(m, k, n_base)
    total = a[:, :-1][:, :, predecessors(k, n_base)] + m + b[:, 1:, :, None]
    return np.exp(total - _total(a[:, -1], True)[:, None, None, None])


def viterbi(m: np.ndarray, k: int, n_base: int = 4) -> np.ndarray:
    """(reads, steps) labels of the best path: 0 where it stays, else 1 + the base; of equals the first."""
    before, reads = predecessors(k, n_base), np.arange(m.shape[0])
    best, back = np.zeros((m.shape[0], m.shape[2])), np.empty(m.shape[:3], np.uint8)
    for t in range(m.shape[1]):
        step = best[:, before] + m[:, t]
        back[:, t] = step.argmax(-1)
        best = step.max(-1)
    state, out = best.argmax(1), np.zeros(m.shape[:2], np.int64)
    for t in range(m.shape[1] - 1, -1, -1):
        move = back[reads, t, state]
        out[:, t] = np.where(move > 0, 1 + state % n_base, 0)
        state = before[state, move]
    return out


def posterior_path(m: np.ndarray, k: int, n_base: int = 4) -> np.ndarray:
    """(reads, steps) labels of the most probable move of each step by itself."""
    p = posteriors(m, k, n_base).reshape(*m.shape[:2], -1)
    best = p.argmax(-1)
    return np.where(best % (n_base + 1) > 0, 1 + best // (n_base + 1) % n_base, 0)


def decode_crf(df: DataFrame, scores: str, classes: int, stay: float = 2.0, posterior: bool = False) -> DataFrame:
    """The rows' other columns, ``labels`` of the path (a stay is 0) and ``bases``, from a column of steps * classes numbers.

    A label again is a base again only after a stay.  Reads of equal length are decoded together, in blocks
    of bounded size.  Null or empty scores: no labels.  A length that isn't whole steps is an error.
    """
    at = df.columns.index(scores)
    keep = [k for k in range(len(df.columns)) if k != at]
    schema = ", ".join(f"`{df.columns[k]}` {df.dtypes[k][1]}" for k in keep) + ", labels array<int>, bases string"
    names = [*(df.columns[k] for k in keep), "labels", "bases"]
    k, _ = state_length(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            sizes = np.array([n or 0 for n in column.value_lengths().to_pylist()], np.int64)
            if (sizes % classes).any():
                raise ValueError(f"a row doesn't hold whole steps of {classes} scores")
            labels: list = [[]] * len(sizes)
            for size in np.unique(sizes[sizes > 0]).tolist():
                rows = np.flatnonzero(sizes == size)
                step = max(1, BLOCK // size)
                for a in range(0, len(rows), step):
                    own = rows[a : a + step]
                    x = column.take(pa.array(own)).flatten().to_numpy(zero_copy_only=False).astype(float)
                    m = moves(x.reshape(len(own), -1, classes), stay=stay)
                    for r, path in zip(own.tolist(), (posterior_path if posterior else viterbi)(m, k).tolist(), strict=True):
                        labels[r] = path
            bases = ["".join(ALPHABET[b] for b in collapse_path(x)) for x in labels]
            yield pa.RecordBatch.from_arrays([*(batch.column(j) for j in keep), pa.array(labels, pa.list_(pa.int32())), pa.array(bases)], names)

    return df.mapInArrow(run, schema)
