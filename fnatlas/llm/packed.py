"""Numbers as bytes: variable-length integers of seven bits a byte, coded and read back by whole arrays.

Defined cases: no numbers are no bytes; numbers are unsigned and of 64 bits; signed ones that rise are coded by their
steps (`steps`), which wrap around, so any first number will do.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64


def coded(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all numbers, one after the other, and where each begins (one place more: the end)."""
    x = np.asarray(x).astype(np.uint64, copy=False)
    n = np.ones(len(x), np.int64)
    top = int(x.max()) if len(x) else 0
    for k in range(1, 10):
        if top < 1 << 7 * k:
            break
        n += x >= _U(1 << 7 * k)
    at = np.r_[0, np.cumsum(n)]
    out = np.empty(int(at[-1]), np.uint8)
    for k in range(int(n.max()) if len(x) else 0):
        here = n > k
        out[at[:-1][here] + k] = ((x[here] >> _U(7 * k)) & _U(127)).astype(np.uint8) | np.where(n[here] > k + 1, 128, 0).astype(np.uint8)
    return out, at


def read(data: bytes) -> np.ndarray:
    """The numbers that were coded to these bytes."""
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b < 128)
    begins = np.r_[0, ends[:-1] + 1] if len(ends) else ends
    n = ends - begins + 1
    out = np.zeros(len(ends), np.uint64)
    for k in range(int(n.max()) if len(n) else 0):
        here = n > k
        out[here] |= (b[begins[here] + k] & 127).astype(np.uint64) << _U(7 * k)
    return out


def steps(x: np.ndarray) -> np.ndarray:
    """Each signed number less the one before it, without a sign; the first is kept."""
    x = np.asarray(x).astype(np.int64, copy=False).view(np.uint64)
    return np.r_[x[:1], x[1:] - x[:-1]]


def from_steps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64).view(np.int64)


def binaries(data: np.ndarray, at: np.ndarray) -> pa.Array:
    """An Arrow array of the slices of data between the places at."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])
