"""A convolutional encoder of signals as a slot: layers by name, weights from a tensor file, codes from its codebook."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from wavecrest.operators.quantize import CodeIndex
from wavecrest.sources.tensors import TensorFile

#: Numbers that a block of windows holds.
BLOCK = 1 << 22
#: Fixed value: added to a variance.
EPSILON = 1e-5


def convolve(x: np.ndarray, weight: np.ndarray, bias: np.ndarray | None, stride: int, padding: int) -> np.ndarray:
    """(channels, time) to (out, time / stride): a strided cross-correlation with zeros at the edges, block by block."""
    out, channels, size = weight.shape
    x = np.pad(x, ((0, 0), (padding, padding)))
    n = (x.shape[1] - size) // stride + 1
    if n <= 0:
        return np.empty((out, 0))
    windows = np.lib.stride_tricks.sliding_window_view(x, size, axis=1)[:, ::stride]
    step = max(1, BLOCK // (channels * size))
    flat = weight.reshape(out, -1).T
    y = np.concatenate([windows[:, a : a + step].transpose(1, 0, 2).reshape(-1, channels * size) @ flat for a in range(0, n, step)]).T
    return y if bias is None else y + bias[:, None]


ACTIVATIONS: dict[str, Callable[[np.ndarray], np.ndarray]] = {
    "silu": lambda x: x / (1 + np.exp(-x)),
    "relu": lambda x: np.maximum(x, 0),
    "tanh": np.tanh,
}


class Encoder:
    """Layers in order: ("conv", name, stride, padding), ("norm", name), or the name of an activation.

    Their weights are ``name.weight`` and so on in the file.  Without layers, the file's metadata gives them.
    """

    def __init__(self, path: str, layers: list | None = None) -> None:
        file = TensorFile(path)
        self.steps: list[Callable[[np.ndarray], np.ndarray]] = []
        self.stride = 1
        get = lambda name: file[name].astype(float) if name in file else None
        for layer in layers or json.loads(file.metadata["layers"]):
            kind = layer if isinstance(layer, str) else layer[0]
            if kind == "conv":
                _, name, stride, padding = layer
                w, b = get(f"{name}.weight"), get(f"{name}.bias")
                self.steps.append(lambda x, w=w, b=b, s=stride, p=padding: convolve(x, w, b, s, p))
                self.stride *= stride
            elif kind == "norm":
                w, b, m, v = (get(f"{layer[1]}.{k}") for k in ("weight", "bias", "running_mean", "running_var"))
                scale = w / np.sqrt(v + EPSILON)
                self.steps.append(lambda x, s=scale, t=b - m * scale: x * s[:, None] + t[:, None])
            else:
                self.steps.append(ACTIVATIONS[kind])
        # of (1, codes, width) or (codes, width)
        book = get("codebook")
        self.codes = None if book is None else CodeIndex(book.reshape(-1, book.shape[-1]))

    def latent(self, signal: np.ndarray) -> np.ndarray:
        """(time, channels)"""
        x = signal[None]
        for step in self.steps:
            x = step(x)
        return x.T


@lru_cache(maxsize=2)
def load(path: str, layers: str) -> Encoder:
    """Weights are read once in a worker."""
    return Encoder(path, json.loads(layers) or None)


def encode_signals(df: DataFrame, signal: str, path: str, layers: list | None = None) -> DataFrame:
    """The rows with ``codes``: the nearest code of each latent vector of a signal.  Null or empty: no codes."""
    at = df.columns.index(signal)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema) + ", codes array<bigint>"
    spec = json.dumps(layers or [])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(path, spec)
        if model.codes is None:
            raise ValueError(f"{path} holds no codebook")
        for batch in batches:
            rows = [model.codes.nearest(model.latent(np.array(x, float))).tolist() if x else [] for x in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(rows, pa.list_(pa.int64()))], [*batch.schema.names, "codes"])

    return df.mapInArrow(run, schema)
