"""Whole-batch text primitives in numpy: slicing, word boundaries, word and n-gram fingerprints.

A *slice* is a run of consecutive rows of one Arrow batch holding a bounded number
of text bytes, so memory per task does not depend on the size of the corpus.
Words are found on UTF-8 bytes; every separator used here is ASCII, so cutting
bytes and cutting characters give the same words.
"""

from __future__ import annotations

import ctypes
import inspect
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import wraps

import numpy as np
import pyarrow as pa

SLICE_BYTES = 8 << 20
#: Arrays of a slice that take several times its bytes are made for pieces of this size, one after the other.
PIECE_BYTES = 1 << 20
_CHUNK = 1 << 19

_bytes = np.arange(256)
#: Bytes of words [^\x20\x09-\x0D]+ and of words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+.
NOT_SPACE = ~((_bytes == 0x20) | ((_bytes >= 0x09) & (_bytes <= 0x0D)))
ALNUM = ((_bytes >= 0x30) & (_bytes <= 0x39)) | ((_bytes >= 0x61) & (_bytes <= 0x7A)) | (_bytes >= 0x80)
LOWER = np.where((_bytes >= 0x41) & (_bytes <= 0x5A), _bytes + 32, _bytes).astype(np.uint8)

_P = 0xD6E8FEB86659FD93
_Q = pow(_P, -1, 1 << 64)
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S30, _S27, _S31 = np.uint64(30), np.uint64(27), np.uint64(31)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        seed = np.full(max(n, _CHUNK + 4096), base, np.uint64)
        seed[0] = 1
        have = _powers[base] = np.multiply.accumulate(seed)
    return have[:n]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only


def free() -> None:
    """Give back to the system what arrays that are gone have left in this process."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def freed(task: Callable) -> Callable:
    """task (a function of a table or of batches) that gives back the memory of its arrays when it is done.

    A worker process serves one task after the other, and would hold what the largest slice took. Where Spark counts a function's
    arguments, it gets a lambda around it.
    """

    @wraps(task)
    def batches(*args, **more):
        yield from task(*args, **more)
        free()

    @wraps(task)
    def table(*args, **more):
        out = task(*args, **more)
        if sum(x.nbytes for x in args if isinstance(x, pa.Table)) > PIECE_BYTES:
            free()
        return out

    return batches if inspect.isgeneratorfunction(task) else table


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """An ordered combination of two fingerprints."""
    x = a * _A + b * _B + _C
    return (x ^ (x >> _S31)) * _M1 ^ (x >> _S27)


def text_arrays(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; nulls count as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds at most *limit* text bytes, or one row."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, off = text_arrays(batch.column(batch.schema.get_field_index(text)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(off, off[at] + limit, side="right")) - 1)
            yield batch.slice(at, to - at)
            at = to


@dataclass
class Words:
    """Words of a slice: fingerprints, byte extents, and the range of words of each row."""

    h: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray  # first[i]:first[i + 1] are the words of row i

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def inside(self, length: int) -> np.ndarray:
        """Starts of the runs of *length* words that stay within one row."""
        n = len(self.h) - length + 1
        if n <= 0:
            return np.zeros(0, np.int64)
        stop = np.repeat(self.first[1:], self.counts)[:n]
        return np.flatnonzero(np.arange(n) + length <= stop)


def words(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray = NOT_SPACE, hashes: bool = True) -> Words:
    """Find the words of the rows buf[offsets[i]:offsets[i + 1]]; *kind* marks the bytes of words."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64))
    w = kind[buf]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = w[:-1]
    start = np.flatnonzero(w & (~before | edge[:n]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = w[1:]
    end = np.flatnonzero(w & (~after | edge[1:])) + 1
    first = np.searchsorted(start, offsets)
    return Words(hash_extents(buf, start, end) if hashes else np.zeros(0, np.uint64), start, end, first)


def hash_extents(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit fingerprints of buf[start[i]:end[i]], in bounded chunks."""
    p, q = (_P, _Q) if not seed else (_P ^ 0x5DEECE66D0, pow(_P ^ 0x5DEECE66D0, -1, 1 << 64))
    out = np.empty(len(start), np.uint64)
    at = 0
    while at < len(start):
        base = int(start[at])
        to = max(at + 1, int(np.searchsorted(end, base + _CHUNK, side="right")))
        top = int(end[to - 1])
        part = (buf[base:top].astype(np.uint64) + np.uint64(1)) * _power(p, top - base)
        total = np.empty(top - base + 1, np.uint64)
        total[0] = 0
        np.cumsum(part, out=total[1:])
        s, e = start[at:to] - base, end[at:to] - base
        out[at:to] = (total[e] - total[s]) * _power(q, top - base)[s] + (e - s).astype(np.uint64) * _C
        at = to
    return mix(out)


def rolling(h: np.ndarray, length: int) -> np.ndarray:
    """Fingerprints of all runs of *length* consecutive values of h (across rows too)."""
    n = len(h) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    power, size, out, done = h, 1, None, 0
    while True:
        if length & size:
            out = power[:n] if out is None else pair(out, power[done : done + n])
            done += size
        size <<= 1
        if size > length:
            return mix(out) if length & (length - 1) == 0 else out
        power = pair(power[: -(size >> 1)], power[size >> 1 :])
