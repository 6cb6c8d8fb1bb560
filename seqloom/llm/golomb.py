"""Golomb codes (with a power of two as divisor) of sorted distinct hashes.

Quotients, in unary, and remainders lie in two streams, so that both are coded
and decoded by whole arrays.
"""

from __future__ import annotations

import struct

import numpy as np

_HEAD = struct.Struct("<QQB")


def encode(values: np.ndarray) -> bytes:
    """Code of sorted distinct uint64 values."""
    n = len(values)
    if not n:
        return b""
    first = int(values[0])
    gaps = np.diff(values) - np.uint64(1) if n > 1 else np.zeros(0, np.uint64)
    mean = int((int(values[-1]) - first) / n * 0.69) if n > 1 else 0
    r = max(0, mean.bit_length() - 1)
    q = (gaps >> np.uint64(r)).astype(np.int64)
    ends = np.cumsum(q + 1) - 1
    unary = np.zeros(int(ends[-1]) + 1 if len(ends) else 0, np.uint8)
    unary[ends] = 1
    rest = _pack(gaps & np.uint64((1 << r) - 1), r)
    top = np.packbits(unary).tobytes()
    return _HEAD.pack(n, first, r) + struct.pack("<Q", len(top)) + top + rest


def decode(code: bytes) -> np.ndarray:
    """The values of a code."""
    if not code:
        return np.zeros(0, np.uint64)
    n, first, r = _HEAD.unpack_from(code)
    (size,) = struct.unpack_from("<Q", code, _HEAD.size)
    at = _HEAD.size + 8
    ends = np.flatnonzero(np.unpackbits(np.frombuffer(code, np.uint8, size, at)))[: n - 1]
    q = np.diff(ends, prepend=-1) - 1
    rest = _unpack(code, at + size, n - 1, r)
    out = np.empty(n, np.uint64)
    out[0] = first
    out[1:] = (q.astype(np.uint64) << np.uint64(r)) + rest + np.uint64(1)
    return np.cumsum(out, dtype=np.uint64)


def _pack(x: np.ndarray, r: int) -> bytes:
    """Low r bits of each value: whole bytes as they are, the other bits packed."""
    out = []
    raw = np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)
    out.append(np.ascontiguousarray(raw[:, : r // 8]).tobytes())
    if r % 8:
        bits = np.unpackbits(np.ascontiguousarray(raw[:, r // 8]).reshape(-1, 1), axis=1, bitorder="little")[:, : r % 8]
        out.append(np.packbits(bits).tobytes())
    return b"".join(out)


def _unpack(code: bytes, at: int, n: int, r: int) -> np.ndarray:
    raw = np.zeros((n, 8), np.uint8)
    k = r // 8
    if k:
        raw[:, :k] = np.frombuffer(code, np.uint8, n * k, at).reshape(n, k)
    if r % 8:
        bits = np.unpackbits(np.frombuffer(code, np.uint8, -1, at + n * k), count=n * (r % 8)).reshape(n, r % 8)
        raw[:, k] = np.packbits(bits, axis=1, bitorder="little")[:, 0] if n else 0
    return raw.view("<u8")[:, 0].astype(np.uint64)
