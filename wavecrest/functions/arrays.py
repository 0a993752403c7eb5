"""Signal functions over whole arrays in numpy, for long windows; used through Arrow batches."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def running_median(x: np.ndarray, size: int) -> np.ndarray:
    """Reflected edges, the upper median of an even window.

    A sorted window that loses and gains one sample at a time; its moves are block copies, so a step costs
    far less than the window.  With NaN, windows are partitioned one by one, as NaN has no place in an order.
    """
    n = len(x)
    if not n:
        return x
    at = np.mod(np.arange(-(size // 2), n + size - 1 - size // 2), 2 * n)
    padded = x[np.where(at < n, at, 2 * n - 1 - at)]
    if size > 64 and not np.isnan(x).any():
        values = padded.tolist()
        window = sorted(values[:size])
        out = np.empty(n)
        out[0] = window[size // 2]
        for k in range(1, n):
            del window[bisect_left(window, values[k - 1])]
            insort(window, values[k + size - 1])
            out[k] = window[size // 2]
        return out
    view = np.lib.stride_tricks.sliding_window_view(padded, size)
    step = max(1, 4_000_000 // size)
    return np.concatenate([np.partition(view[a : a + step], size // 2, axis=1)[:, size // 2] for a in range(0, n, step)])


def scale(r: np.ndarray) -> float:
    return max(1.4826 * float(np.median(np.abs(r))), 1.0)


def forward_fill(x: np.ndarray, bad: np.ndarray, first: float) -> np.ndarray:
    if not bad.any():
        return x
    at = np.maximum.accumulate(np.where(bad, -1, np.arange(len(x))))
    return np.where(at >= 0, x[np.maximum(at, 0)], first)


def repair(x: np.ndarray, low: float, high: float) -> np.ndarray:
    out = (x < low) | (x > high)
    if not out.any():
        return x
    bad = ~((x >= low) & (x <= high))
    return forward_fill(x, bad, high if x[0] > high else low)


def remove_spikes(x: np.ndarray, size: int, factor: float = 5.0) -> np.ndarray:
    base = running_median(x, size)
    r = x - base
    return forward_fill(x, np.abs(r) > factor * scale(r), float(base[0]))


def normalize(x: np.ndarray) -> np.ndarray:
    r = x - np.median(x)
    return r / scale(r)


def normalize_trimmed(x: np.ndarray) -> np.ndarray:
    r = x - np.median(x)
    lo, hi = np.quantile(r, [0.01, 0.99])
    return r / scale(r[(r >= lo) & (r <= hi)])


def median_zero_padded(x: np.ndarray, size: int = 5) -> np.ndarray:
    return np.median(np.lib.stride_tricks.sliding_window_view(np.pad(x, size // 2), size), axis=1)


def butterworth(cutoff: float, rate: float, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Numerator and denominator of a digital low pass, by the bilinear transform."""
    k = 4.0 * np.tan(np.pi * cutoff / rate)
    poles = k * np.exp(1j * np.pi * (2 * np.arange(order) + order + 1) / (2 * order))
    digital = (4 + poles) / (4 - poles)
    b = np.poly(-np.ones(order))
    a = np.poly(digital).real
    return b * a.sum() / b.sum(), a


def recursive_filter(b: np.ndarray, a: np.ndarray, x: np.ndarray, state: np.ndarray) -> np.ndarray:
    """Transposed direct form, from the given state."""
    state, out = state.astype(float).tolist(), []
    b, a, last = b.tolist(), a.tolist(), len(b) - 2
    for v in x.tolist():
        y = b[0] * v + state[0]
        for k in range(last):
            state[k] = b[k + 1] * v + state[k + 1] - a[k + 1] * y
        state[last] = b[last + 1] * v - a[last + 1] * y
        out.append(y)
    return np.array(out)


def low_pass(x: np.ndarray, cutoff: float, rate: float, order: int = 6) -> np.ndarray:
    """Zero-phase Butterworth low pass: forward and backward, edges extended oddly, from the steady state."""
    b, a = butterworth(cutoff, rate, order)
    n = min(3 * (order + 1), len(x) - 1)
    if n < 1:
        return x
    pad = np.concatenate([2 * x[0] - x[n:0:-1], x, 2 * x[-1] - x[-2 : -n - 2 : -1]])
    companion = np.eye(order, k=1)
    companion[:, 0] -= a[1:]
    steady = np.linalg.solve(np.eye(order) - companion, b[1:] - a[1:] * b[0])
    for _ in range(2):
        pad = recursive_filter(b, a, pad, steady * pad[0])[::-1]
    return pad[n : n + len(x)]


def process(x: np.ndarray, strategy: str, spike_window: int = 6000) -> np.ndarray:
    if strategy not in ("stone", "apple", "lemon", "tango", "mongo"):
        raise ValueError(f"unknown strategy {strategy!r}")
    x = np.asarray(x, float)
    if not len(x):
        return x
    if strategy == "stone":
        return normalize(x)
    x = normalize_trimmed(remove_spikes(repair(x, 1.0, 220.0), spike_window))
    if strategy in ("apple", "lemon"):
        x = median_zero_padded(x)
    return np.clip(x, -5, 5) if strategy == "lemon" else 5 * np.tanh(x / 5) if strategy == "tango" else x


def map_signals(df: DataFrame, column: str, function) -> DataFrame:
    """Apply an array function to an array<double> column, row by row in Arrow batches."""
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column(at)
            out = pa.array([None if x is None else function(np.array(x, float)) for x in col.to_pylist()], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([out if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(run, df.schema)
