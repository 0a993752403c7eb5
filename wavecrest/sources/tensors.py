"""Named tensors in one file: a length, a JSON header with type, shape and place of each, and their bytes."""

from __future__ import annotations

import json

import numpy as np
from pyarrow import fs

from wavecrest.sources.dense import open_store

#: Names of number types in the header; a header larger than this is refused.
KINDS = {"F64": "<f8", "F32": "<f4", "F16": "<f2", "I64": "<i8", "I32": "<i4", "I16": "<i2", "I8": "|i1", "U8": "|u1", "BOOL": "|b1"}
MOST_HEADER = 100_000_000


class TensorFile:
    """The tensors of a file by name; each is read when it is asked for, and nothing else of the file."""

    def __init__(self, path: str) -> None:
        self.store, self.path = open_store(path)
        with self.store.open_input_file(self.path) as f:
            size = f.size()
            length = int.from_bytes(f.read(8), "little")
            if size < 8 or length > min(MOST_HEADER, size - 8):
                raise ValueError(f"{path} is no tensor file")
            header = json.loads(f.read(length))
        self.begin, self.metadata = 8 + length, header.pop("__metadata__", {})
        self.entries = header
        for name, x in header.items():
            a, b = x["data_offsets"]
            kind = np.dtype(KINDS[x["dtype"]]) if x["dtype"] in KINDS else None
            if kind is None:
                raise ValueError(f"{name} has numbers of type {x['dtype']}")
            if not 0 <= a <= b <= size - self.begin or b - a != kind.itemsize * int(np.prod(x["shape"], dtype=np.int64)):
                raise ValueError(f"{name} doesn't fit its place")

    def __contains__(self, name: str) -> bool:
        return name in self.entries

    def __getitem__(self, name: str) -> np.ndarray:
        x = self.entries[name]
        a, b = x["data_offsets"]
        with self.store.open_input_file(self.path) as f:
            f.seek(self.begin + a)
            return np.frombuffer(f.read(b - a), KINDS[x["dtype"]]).reshape(x["shape"])


def write_tensors(path: str, tensors: dict[str, np.ndarray], metadata: dict[str, str] | None = None) -> None:
    """One file; it gets its name when it is whole."""
    names, header, at = {np.dtype(v): k for k, v in KINDS.items()}, {}, 0
    if metadata:
        header["__metadata__"] = metadata
    for name, x in tensors.items():
        header[name] = {"dtype": names[x.dtype.newbyteorder("<")], "shape": list(x.shape), "data_offsets": [at, at + x.nbytes]}
        at += x.nbytes
    text = json.dumps(header).encode()
    text += b" " * (-len(text) % 8)
    store, root = open_store(path)
    store.create_dir(root.rpartition("/")[0], recursive=True)
    with store.open_output_stream(f"{root}.part") as out:
        out.write(len(text).to_bytes(8, "little") + text)
        for x in tensors.values():
            out.write(np.ascontiguousarray(x.astype(x.dtype.newbyteorder("<"))).tobytes())
    store.move(f"{root}.part", root)


def find_weights(folder: str) -> str:
    """The tensor file of a checkpoint folder: model.safetensors, or else the only one there."""
    store, root = open_store(folder)
    found = sorted(x.path for x in store.get_file_info(fs.FileSelector(root)) if x.is_file and x.path.endswith(".safetensors"))
    best = [p for p in found if p.endswith("/model.safetensors")] or found
    if len(best) != 1:
        raise FileNotFoundError(f"{len(best)} tensor files in {folder}")
    return f"{folder}/{best[0].rpartition('/')[2]}"
