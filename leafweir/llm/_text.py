"""Vectorised text kernels over Arrow buffers.

Everything here works on the UTF-8 bytes of an Arrow string column, so no Python string is made
per row. A batch is cut into chunks of whole texts with a bounded number of bytes (a text longer
than the bound is a chunk of its own); memory follows the chunk, not the partition.

Words are maximal runs of ``0-9``, ``a-z`` and code points from U+0080 on, after lower-casing A-Z.
They are known by a 64-bit hash of their bytes.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa

U64 = np.uint64
CHUNK_BYTES = 1 << 20
BASE_A = 0x9E3779B97F4A7C15
BASE_B = 0xD1342543DE82EF95

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


_BYTE = mix64(np.arange(1, 257, dtype=U64) * U64(BASE_B))


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown when longer chunks arrive."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 2**64)
        self.up = self.down = np.ones(1, dtype=U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 2**64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, k, 2**64))])
        return self.up[:n], self.down[:n]


_POWERS = {base: _Powers(base) for base in (BASE_A, BASE_B)}


def prefix_hash(data: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """Running polynomial hash; ``span_hash`` reads the hash of any span off it."""
    up, _ = _POWERS[base].upto(len(data))
    out = np.zeros(len(data) + 1, dtype=U64)
    np.cumsum(_BYTE[data] * up, out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray, base: int = BASE_A) -> np.ndarray:
    """Hash of the bytes from start to end (exclusive), alike wherever they stand."""
    _, down = _POWERS[base].upto(len(prefix) + 1)
    return mix64((prefix[end] - prefix[start]) * down[start] + (end - start).astype(U64) * U64(BASE_B))


def all_spans(prefix: np.ndarray, length: int, base: int = BASE_A) -> np.ndarray:
    """``span_hash`` of every span of this length."""
    n = len(prefix) - length
    if n <= 0:
        return np.zeros(0, dtype=U64)
    _, down = _POWERS[base].upto(len(prefix) + 1)
    return mix64((prefix[length:] - prefix[:n]) * down[:n] + U64(length * BASE_B % 2**64))


def sliding(x: np.ndarray, width: int, pick) -> np.ndarray:
    """np.minimum or np.maximum over each window of this width, by doubling."""
    if len(x) < width:
        return x[:0]
    done = 1
    while done * 2 <= width:
        x = pick(x[:-done], x[done:])
        done *= 2
    return pick(x[: len(x) - (width - done)], x[width - done :]) if width > done else x


class Chunk(NamedTuple):
    """Rows ``lo`` to ``hi`` of the batch: their bytes and where each text begins (and the last ends)."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    _, off, data = column.buffers()
    off = np.frombuffer(off, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if off else np.zeros(1, dtype=np.int64)
    return np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8), off


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    data, off = buffers(column)
    lo, n = 0, len(off) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + limit, side="right")) - 1)
        yield Chunk(lo, hi, data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
        lo = hi


class Words(NamedTuple):
    """Words of a chunk: byte starts and ends, hashes, and the first word of each text (and the end)."""

    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    off: np.ndarray


def words(chunk: Chunk) -> Words:
    low = _LOWER[chunk.data]
    is_word = _WORD[low]
    edge = np.zeros(len(low) + 1, dtype=bool)
    edge[0] = edge[-1] = True
    if len(low):
        edge[1:-1] = ~is_word[:-1]
        edge[chunk.off] = True
        start = np.flatnonzero(is_word & edge[:-1])
        edge[1:-1] = ~is_word[1:]
        edge[chunk.off] = True
        end = np.flatnonzero(is_word & edge[1:]) + 1
    else:
        start = end = np.zeros(0, dtype=np.int64)
    return Words(start, end, span_hash(prefix_hash(low), start, end), np.searchsorted(start, chunk.off))


_MULTIPLIER = [U64(int(mix64(np.array([k + 77], dtype=U64))[0]) | 1) for k in range(64)]


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (over text borders too: the caller masks those)."""
    size = len(h) - n + 1
    if size <= 0:
        return np.zeros(0, dtype=U64)
    out = np.zeros(size, dtype=U64)
    for j in range(n):
        out += (h[j : j + size] ^ (h[j : j + size] >> U64(29))) * _MULTIPLIER[j]
    return mix64(out + U64(n))


def ranges(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[i], first[i]+1, ... of count[i] items each, one after the other."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(total)
