"""Named arrays in files of the shared folder: one file for each part of a model, mapped by the workers that look something up.

A file holds its arrays one after the other, each from a multiple of 8 bytes on; then an index (JSON: name -> place, type, shape), and the index's length
in the last 8 bytes. A file gets its name when it is complete, so a task that is repeated replaces what it wrote.
"""

from __future__ import annotations

import json

import numpy as np
from pyspark import TaskContext

from .common import U64
from .token_files import _filesystem

#: Entries of a sorted array that share the bits their place tells, about.
BUCKET = 16
_U32, _32 = np.uint32, U64(32)


def narrow(numbers: np.ndarray) -> np.ndarray:
    """Counts as 32 bits where these hold them all, else as 64."""
    return numbers.astype(_U32 if not numbers.size or int(numbers.max()) < 1 << 32 else U64)


def keys_of(name: str, keys: np.ndarray) -> dict[str, np.ndarray]:
    """Arrays of sorted 64-bit keys: the first bits tell the bucket, the next 32 are kept."""
    bits = max(1, (len(keys) // BUCKET).bit_length())
    starts = np.searchsorted(keys, np.arange(1 << bits, dtype=U64) << U64(64 - bits))
    return {f"{name}-starts": np.append(starts, len(keys)).astype(_U32), f"{name}-keys": (keys << U64(bits) >> _32).astype(_U32)}


def find(arrays: dict[str, np.ndarray], name: str, wanted: np.ndarray) -> np.ndarray:
    """Place of each wanted key among those of `keys_of`, or -1."""
    starts, keys = arrays[f"{name}-starts"], arrays[f"{name}-keys"]
    bits = (len(starts) - 1).bit_length() - 1
    if not len(keys):
        return np.full(len(wanted), -1, dtype=np.int64)
    bucket, value = (wanted >> U64(64 - bits)).astype(np.int64), (wanted << U64(bits) >> _32).astype(_U32)
    low, high = starts[bucket].astype(np.int64), starts[bucket + 1].astype(np.int64)
    end, last = high.copy(), len(keys) - 1
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        middle = (low + high) >> 1
        less = (low < high) & (keys[np.minimum(middle, last)] < value)
        low, high = np.where(less, middle + 1, low), np.where(less, high, middle)
    return np.where((low < end) & (keys[np.minimum(low, last)] == value), low, -1)


class Files:
    """The files as a worker sees them. No more than MAPPED are mapped at a time, or READ where a store has no files that can be mapped; the one
    that has not been asked for longest goes first."""

    MAPPED, READ = 64, 4

    def __init__(self, out: str):
        self.filesystem, self.root = _filesystem(out)
        self.open: dict[str, dict[str, np.ndarray]] = {}

    def arrays(self, name: str) -> dict[str, np.ndarray]:
        local = self.filesystem.type_name == "local"
        held = self.open.pop(name, None)
        if held is None:
            while len(self.open) >= (self.MAPPED if local else self.READ):
                del self.open[next(iter(self.open))]
            path = f"{self.root}/{name}.arrays"
            if local:
                data = np.memmap(path, dtype=np.uint8, mode="r")
            else:
                with self.filesystem.open_input_file(path) as f:
                    data = np.frombuffer(f.read(), dtype=np.uint8)
            size = int(data[-8:].view("<u8")[0])
            index = json.loads(data[-8 - size : -8].tobytes())
            held = {k: data[a : a + np.dtype(kind).itemsize * int(np.prod(shape))].view(kind).reshape(shape) for k, (a, kind, shape) in index.items()}
        self.open[name] = held  # the latest is last
        return held

    def save(self, name: str, **arrays: np.ndarray) -> None:
        own = f"{self.root}/.{name}-{TaskContext.get().taskAttemptId()}"
        index, at = {}, 0
        with self.filesystem.open_output_stream(own) as f:
            for k, array in arrays.items():
                array = np.ascontiguousarray(array)
                index[k] = (at, array.dtype.str, array.shape)
                f.write(memoryview(array.reshape(-1).view(np.uint8)))
                f.write(b"\0" * (-array.nbytes % 8))
                at += array.nbytes + -array.nbytes % 8
            head = json.dumps(index).encode()
            f.write(head)
            f.write(len(head).to_bytes(8, "little"))
        self.filesystem.move(own, f"{self.root}/{name}.arrays")
