"""Words and n-grams of whole texts, over Arrow buffers, a few array passes each.

A word is a run of ASCII letters or digits and of bytes from 0x80 up (letters
beyond ASCII); in SQL, after lower(), the pieces between runs of ``SEPARATOR``.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: One or more bytes that belong to no word, as a regular expression.
SEPARATOR = r"[\x00-/:-@\[-`{-\x7f]+"

_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = [np.ones(0, np.uint64), np.ones(0, np.uint64)]
#: Bytes handled at once; longer texts go alone.
SLICE = 1 << 19


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that all bits of a hash depend on all of its input."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _pow(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE)
        for i, base in enumerate((_BASE, _INVERSE)):
            p = np.full(size, base, np.uint64)
            p[0] = 1
            _powers[i] = np.cumprod(p, dtype=np.uint64)
    return _powers[0][:n], _powers[1][:n]


def buffers(texts: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets between them; a null text has no bytes."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
        if isinstance(texts, pa.ChunkedArray):
            texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.string())
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each span of bytes."""
    n = len(data)
    power, inverse = _pow(n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power, out=total[1:])
    h = (total[end] - total[start]) * inverse[np.minimum(start, max(n - 1, 0))] if n else np.zeros(len(start), np.uint64)
    return mix(h + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


@dataclass
class Words:
    """All words of some texts in order: hash, and for each text the range of its words."""

    hash: np.ndarray
    bounds: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def words(texts: pa.Array | pa.ChunkedArray) -> Words:
    """Hashed words of each text, in slices of bounded size."""
    data, off = buffers(texts)
    hashes, counts = [], []
    a = 0
    while a < len(off) - 1:
        b = max(a + 1, int(np.searchsorted(off, off[a] + SLICE, "right")) - 1)
        part, o = data[off[a] : off[b]], off[a : b + 1] - off[a]
        inside = np.zeros(len(part) + 2, bool)
        inside[1:-1] = _WORD[part]
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cut = o[1:-1][(o[1:-1] > 0) & (o[1:-1] < len(part))]  # a text's end ends a word
        begins[cut] |= inside[1:-1][cut]
        ends[cut - 1] |= inside[1:-1][cut - 1]
        start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        hashes.append(span_hashes(part, start, end))
        counts.append(np.diff(np.searchsorted(start, o)))
        a = b
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    n = np.concatenate(counts) if counts else np.zeros(0, np.int64)
    return Words(h, np.concatenate([[0], np.cumsum(n)]).astype(np.int64))


def ngrams(h: np.ndarray, n: int, salt: int = 0) -> np.ndarray:
    """Hash of the n words from each place; the last n-1 places have none."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, salt, np.uint64)
    for i in range(n):
        out *= np.uint64(0xFF51AFD7ED558CCD)
        out += h[i : i + m]
        out ^= out >> np.uint64(29)
    return mix(out)


def long_ngrams(h: np.ndarray, n: int) -> np.ndarray:
    """As ngrams, for large n: by differences of a prefix polynomial."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    power, inverse = _pow(len(h))
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * power, out=total[1:])
    return mix((total[n:] - total[:-n]) * inverse[:m])


def inside_docs(bounds: np.ndarray, n: int) -> np.ndarray:
    """Which of the places of ngrams() have all n words in one text."""
    m = int(bounds[-1]) - n + 1
    if m <= 0:
        return np.zeros(0, bool)
    ok = np.ones(m, bool)
    size = np.diff(bounds)
    for k in range(1, n):  # places within n-1 of the end of a text
        at = bounds[1:][size >= k] - k
        ok[at[at < m]] = False
    return ok
