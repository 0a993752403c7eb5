"""Weights of several losses within bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def project(raw: np.ndarray, low: np.ndarray, high: np.ndarray, rounds: int = 10, eps: float = 1e-8) -> np.ndarray:
    """Rows of weights within [low, high] that sum to 1: what is missing goes to weights below their upper
    bound in proportion to the raw ones, again until nothing is missing; at last the rows are scaled."""
    w = np.clip(raw, low, high)
    for _ in range(rounds):
        missing = 1 - w.sum(1, keepdims=True)
        open_ = w < high - eps
        active = (np.abs(missing) >= eps) & open_.any(1, keepdims=True)
        if not active.any():
            break
        share = np.where(open_, raw, 0.0)
        total = share.sum(1, keepdims=True)
        share = np.where(total < eps, open_ / np.maximum(open_.sum(1, keepdims=True), 1), share / np.maximum(total, eps))
        w = np.where(active, np.clip(w + missing * share, low, high), w)
    total = w.sum(1, keepdims=True)
    return np.where(np.abs(total - 1) > 1e-5, w / total, w)


def box_projection(df: DataFrame, weights: str, low: list[float], high: list[float]) -> DataFrame:
    """The rows with their array of weights projected, in Arrow batches."""
    at, schema = df.columns.index(weights), df.schema
    bounds = np.array(low), np.array(high)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            w = project(np.array(b.column(at).to_pylist(), float).reshape(b.num_rows, -1), *bounds)
            out = pa.array(w.tolist(), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([out if k == at else c for k, c in enumerate(b.columns)], b.schema.names)

    return df.mapInArrow(run, schema)
