"""Words, lines and their hashes over whole Arrow batches, without a Python loop per word.

A chunk is the UTF-8 bytes of some whole texts one after another plus the
offset of each text. Separators are single ASCII bytes in every scheme used
here, so working on bytes never splits a code point.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 20
_BASE = np.uint64(0x9E3779B97F4A7C15)
_SEED = 0x5EED

U64 = np.uint64


def _table(is_word) -> np.ndarray:
    return np.array([is_word(b) for b in range(256)], dtype=bool)


#: bytes of ``[^\x20\x09-\x0D]+``
SPACED = _table(lambda b: b != 0x20 and not 0x09 <= b <= 0x0D)
#: bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are lower-cased
ALNUM = _table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly (finaliser of the splitmix generator)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def odd_numbers(n: int, seed: int = _SEED) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * U64(2) + U64(1)


_STEP = odd_numbers(64)


class Chunk:
    """Bytes of whole texts and where each begins; ``rows`` is their place in the batch."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, rows: slice):
        self.data, self.offsets, self.rows = data, offsets, rows

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Chunk:
        return Chunk(LOWER[self.data], self.offsets, self.rows)

    def text(self, i: int) -> str:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes().decode("utf-8", "replace")


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, where, data = column.buffers()
    offsets = np.frombuffer(where, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0]:offsets[-1]], offsets - offsets[0]


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Cut a batch between texts so that a chunk holds ``limit`` bytes or one text."""
    data, offsets = text_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Chunk(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], slice(at, to))
        at = to


def spans(chunk: Chunk, table: np.ndarray = SPACED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and where each text's words begin (one more than texts)."""
    data, offsets = chunk.data, chunk.offsets
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    inside = table[data]
    before = np.empty_like(inside)
    before[0], before[1:] = False, inside[:-1]
    edges = offsets[:-1][offsets[:-1] < len(data)]
    before[edges] = False
    after = np.empty_like(inside)
    after[-1], after[:-1] = False, inside[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    n = len(data)
    # running sums of byte * base^place, shifted back to the span's start by the inverse power
    powers = np.empty(n + 1, np.uint64)
    powers[0], powers[1:] = 1, _BASE
    np.multiply.accumulate(powers, out=powers)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + U64(1)) * powers[:n], out=sums[1:])
    inverse = np.empty(n + 1, np.uint64)
    inverse[0], inverse[1:] = 1, U64(pow(int(_BASE), -1, 1 << 64))
    np.multiply.accumulate(inverse, out=inverse)
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def ngrams(hashes: np.ndarray, n: int) -> np.ndarray:
    """Hash of every ``n`` consecutive values; crossing text borders is the caller's concern."""
    if len(hashes) < n:
        return np.zeros(0, np.uint64)
    total = hashes[:len(hashes) - n + 1] * _STEP[0]
    for k in range(1, n):
        total = total + hashes[k:len(hashes) - n + 1 + k] * _STEP[k]
    return mix(total)


def owners(bounds: np.ndarray) -> np.ndarray:
    """The text of every word, from where each text's words begin."""
    return np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
