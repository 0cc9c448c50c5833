"""Vectorised text kernels over Arrow string arrays: words, rolling hashes, windows. All hashes are unsigned 64-bit."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
#: Texts go through the kernels in slices of about so many bytes; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Words of more bytes are hashed by digest: sums of powers modulo 2**64 agree for some long strings, whatever the base.
LONG_WORD = 256
#: Bases of the two polynomial hashes (odd).
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words with avalanche."""
    x = x ^ (x >> U(32))
    x = x * U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    x *= U(0xD6E8FEB86659FD93)
    x ^= x >> U(32)
    return x


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base**i and base**-i modulo 2**64 for i below n at least."""
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        m = max(n, SLICE_BYTES + 1)
        p = np.full(m, base, U)
        q = np.full(m, pow(base, -1, 2**64), U)
        p[0] = q[0] = 1
        have = np.cumprod(p, dtype=U), np.cumprod(q, dtype=U)
        if m <= 16 * SLICE_BYTES:
            _POWERS[base] = have
    return have


def prefix(values: np.ndarray, base: int) -> np.ndarray:
    """Running sums of values[i] * base**i, from 0."""
    out = np.zeros(len(values) + 1, U)
    np.cumsum(values.astype(U) * powers(base, len(values) + 1)[0][: len(values)], dtype=U, out=out[1:])
    return out


def spans(pre: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hashes of values[starts:ends] from prefix()."""
    return mix((pre[ends] - pre[starts]) * powers(base, len(pre))[1][starts] + (ends - starts).astype(U))


def digests(parts: Iterator[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit digests as two vectors of 64-bit words."""
    d = b"".join([hashlib.blake2b(x, digest_size=16).digest() for x in parts])
    both = np.frombuffer(d, U).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def window_hashes(data: np.ndarray, length: int, seed: int) -> np.ndarray:
    """A hash of each `length` consecutive values, built as a tree: halves are mixed before they are joined."""
    h = mix(data.astype(U) + U(seed * 0x1F123BB5 + 0x51ED270B))
    size = 1
    while size < length:
        step = min(size, length - size)
        h = mix(h[: len(h) - step] ^ (mix(h[step:] + U(size)) * U(0x9E3779B97F4A7C15)))
        size += step
    return h


def pieces(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in slices of about SLICE_BYTES of text."""
    for b in batches:
        if not b.num_rows:
            continue
        _, off = raw(b.column(b.schema.get_field_index(column)))
        start = 0
        while start < b.num_rows:
            end = int(np.searchsorted(off, off[start] + SLICE_BYTES, "right")) - 1
            end = min(b.num_rows, max(start + 1, end))
            yield b.slice(start, end - start)
            start = end


def raw(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a string array, and where each text starts (and the end). Null is empty."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    if arr.null_count:
        arr = arr.fill_null("" if not pa.types.is_binary(arr.type) else b"")
    big = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    kind = np.int64 if big else np.int32
    _, offs, data = arr.buffers()
    off = np.frombuffer(offs, kind, len(arr) + 1, arr.offset * np.dtype(kind).itemsize).astype(np.int64) if len(arr) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8, off[-1] - off[0], off[0]), off - off[0]


class Words:
    """The words [^\\x20\\x09-\\x0D]+ of the texts of one slice.

    start, end: byte ranges; first: index of each text's first word, and the number of words at the end; h: a hash of
    each word.
    """

    def __init__(self, arr: pa.Array, lower: bool = False):
        data, off = raw(arr)
        self.data, self.off = (_LOWER[data] if lower else data), off
        n = len(data)
        if n:
            word = ~_SPACE[data]
            gap = np.empty(n + 1, bool)
            gap[0] = gap[n] = True
            np.logical_not(word[:-1], out=gap[1:n])
            edge = off[(off > 0) & (off < n)]
            gap_before = gap[:n].copy()
            gap_before[edge] = True
            after = np.empty(n, bool)
            after[:-1] = ~word[1:]
            after[-1] = True
            after[edge - 1] = True
            self.start = np.flatnonzero(word & gap_before)
            self.end = np.flatnonzero(word & after) + 1
        else:
            self.start = self.end = np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, off)
        self.n = np.diff(self.first)
        self.h = spans(prefix(self.data, BASES[0]), self.start, self.end, BASES[0]) if n else np.zeros(0, U)
        long = np.flatnonzero(self.end - self.start > LONG_WORD)
        if len(long):
            self.h[long], _ = digests([self.data[self.start[i] : self.end[i]].tobytes() for i in long.tolist()])

    def texts(self) -> Iterator[tuple[int, int]]:
        return zip(self.first[:-1].tolist(), self.first[1:].tolist(), strict=True)

    def fingerprints(self) -> tuple[np.ndarray, np.ndarray]:
        """A digest of each text's word sequence, as two vectors."""
        return digests([self.h[a:z].tobytes() for a, z in self.texts()])

    def grams(self, k: int, which: int = 0) -> np.ndarray:
        """A hash of each k consecutive words of the slice; those that run over a text's end mean nothing."""
        m = len(self.h) - k + 1
        if m <= 0:
            return np.zeros(0, U)
        base = BASES[1 - which]
        p = prefix(self.h if which == 0 else mix(self.h + U(which)), base)
        at = np.arange(m)
        return spans(p, at, at + k, base)


def longs(lists: list[np.ndarray]) -> pa.Array:
    """A list<int64> array of unsigned or signed 64-bit vectors."""
    off = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=off[1:])
    flat = np.concatenate(lists) if lists else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(off), pa.array(np.ascontiguousarray(flat).view(np.int64)))


def ints(a: np.ndarray) -> pa.Array:
    a = np.ascontiguousarray(a)
    return pa.array(a.view(np.int64) if a.dtype == U else a.astype(np.int64, copy=False))


def ids(b: pa.RecordBatch, name: str = "doc_id") -> np.ndarray:
    return b.column(b.schema.get_field_index(name)).to_numpy(zero_copy_only=False).astype(np.int64)


def col(b: pa.RecordBatch, name: str) -> pa.Array:
    return b.column(b.schema.get_field_index(name))


def list_at(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Values and offsets of a list<int64> column; a null list is empty."""
    if arr.null_count:
        lens = np.array([0 if x is None else x for x in arr.value_lengths().to_pylist()])
        off = np.zeros(len(arr) + 1, np.int64)
        np.cumsum(lens, out=off[1:])
        return arr.flatten().to_numpy(zero_copy_only=False), off
    off = arr.offsets.to_numpy().astype(np.int64)
    return arr.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]], off - off[0]
