"""Large lookup tables as sorted hash arrays in the shared folder, memory-mapped by workers.

Keys are evenly spread 64-bit hashes; their leading bits name the shard, so
shards are equal in size without sampling and a lookup knows its file. Workers
map the files and touch the pages they need: nothing passes through the driver
and no worker holds a table in its own memory. A shared folder that is not
mounted as a file system is read through Arrow's file systems into an unnamed
local file first.

Files are put in place by an atomic rename under a fixed name, so a task that
runs twice leaves the same result.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD_ROWS = 1 << 18


def local_path(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def put(uri: str, name: str, values: np.ndarray) -> None:
    folder, values = local_path(uri), np.ascontiguousarray(values)
    if folder is not None:
        os.makedirs(folder, exist_ok=True)
        part = f"{folder}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, values)
        os.replace(part, f"{folder}/{name}")
        return
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as f:
        np.save(f, values)
    system.move(part, f"{path}/{name}")


def get(uri: str, name: str) -> np.ndarray:
    folder = local_path(uri)
    if folder is not None:
        return np.load(f"{folder}/{name}", mmap_mode="r")
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(uri)
    with tempfile.NamedTemporaryFile() as copy, system.open_input_stream(f"{path}/{name}") as f:
        while block := f.read(1 << 24):
            copy.write(block)
        copy.flush()
        return np.load(copy.name, mmap_mode="r")  # stays mapped after the name is gone


def shard_bits(rows: int, per_shard: int = SHARD_ROWS) -> int:
    return max(0, (max(rows, 1) - 1) // per_shard).bit_length()


@dataclass
class HashArrays:
    """Sorted keys with their place in the whole table as number, and columns in the same order."""

    uri: str
    bits: int
    base: np.ndarray
    mapped: dict = field(default_factory=dict, repr=False)

    def __getstate__(self):
        return {"uri": self.uri, "bits": self.bits, "base": self.base, "mapped": {}}

    def __len__(self) -> int:
        return int(self.base[-1])

    def part(self, column: str, shard: int) -> np.ndarray:
        name = f"{column}-{shard}.npy"
        if name not in self.mapped:
            self.mapped[name] = get(self.uri, name)
        return self.mapped[name]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each of the ascending ``keys``, -1 where unknown."""
        out = np.full(len(keys), -1, np.int64)
        for shard, a, b in self._runs(shard_of(keys, self.bits)):
            if self.base[shard] == self.base[shard + 1]:
                continue
            held = self.part("key", shard)
            place = np.minimum(np.searchsorted(held, keys[a:b]), len(held) - 1)
            out[a:b] = np.where(held[place] == keys[a:b], place + self.base[shard], -1)
        return out

    def values(self, column: str, numbers: np.ndarray) -> np.ndarray:
        """The column at ascending ``numbers`` of known keys."""
        parts = [self.part(column, s)[numbers[a:b] - self.base[s]]
                 for s, a, b in self._runs(np.searchsorted(self.base, numbers, "right") - 1)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    def lists(self, column: str, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat values and offsets of a column of lists at ascending ``numbers``."""
        flat, sizes = [], []
        for s, a, b in self._runs(np.searchsorted(self.base, numbers, "right") - 1):
            at, ends = numbers[a:b] - self.base[s], self.part(f"{column}-ends", s)
            to = ends[at].astype(np.int64)
            start = np.where(at > 0, ends[np.maximum(at - 1, 0)], 0).astype(np.int64)
            sizes.append(to - start)
            flat.append(self.part(column, s)[ranges(start, to - start)])
        none = np.zeros(0, np.int64)
        return (np.concatenate(flat) if flat else none,
                np.concatenate([[0], np.cumsum(np.concatenate(sizes) if sizes else none)]))

    @staticmethod
    def _runs(shards: np.ndarray):
        if not len(shards):
            return []
        edge = np.flatnonzero(np.diff(shards)) + 1
        return [(int(shards[a]), a, b) for a, b in zip([0, *edge.tolist()], [*edge.tolist(), len(shards)])]


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All of ``start[i] .. start[i] + size[i] - 1``, one after the other."""
    total = int(size.sum())
    return np.repeat(start - np.cumsum(size) + size, size) + np.arange(total)


def shard_of(keys: np.ndarray, bits: int) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)


def write(df: DataFrame, key: str, rows: int, uri: str,
          columns: Callable[[pa.Table], dict[str, np.ndarray]]) -> HashArrays:
    """Write ``df`` (distinct keys) as sorted arrays; ``columns`` makes the other arrays of rows in key order."""
    bits = shard_bits(rows)
    shard = F.shiftrightunsigned(F.col(key), 64 - bits).cast("int") if bits else F.lit(0)

    def save(table: pa.Table) -> pa.Table:
        number = table.column("shard")[0].as_py()
        keys = table.column(key).to_numpy().astype(np.uint64)
        order = np.argsort(keys)
        put(uri, f"key-{number}.npy", keys[order])
        for name, values in columns(table.take(pa.array(order))).items():
            put(uri, f"{name}-{number}.npy", values)
        return pa.table({"shard": pa.array([number], pa.int32()), "n": pa.array([len(keys)], pa.int64())})

    found = df.withColumn("shard", shard).groupBy("shard").applyInArrow(save, "shard int, n long").collect()
    sizes = np.zeros(1 << bits, np.int64)
    for r in found:
        sizes[r["shard"]] = r["n"]
    return HashArrays(uri, bits, np.concatenate([[0], np.cumsum(sizes)]))
