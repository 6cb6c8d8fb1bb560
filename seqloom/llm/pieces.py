"""SentencePiece encoding with seeded merge-dropout, and decoding.

The pieces of a BPE model, whose file is a parameter, are merged by agenda: the
candidate of best score first, the leftmost of equals. Each candidate that
comes up is skipped if its keyed hash (of the seed, the row, the places of its
two halves and the merged piece) falls below the dropout rate; a skipped pair
stays apart until a merge beside it makes it another pair. So the segmentation
varies from place to place and from seed to seed, yet is the same wherever and
however often it is computed, and all of them decode to the same text.

All words of a batch go through their agendas side by side, in arrays, one
candidate a word and round; words of over ``LONG`` characters have a heap each.

Defined results: a null text has null ids, an empty one none; characters
outside the vocabulary become byte pieces, also U+2581, which the model would
confuse with a space; any text decodes to itself.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exact_dedup import packed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 7
LONG = 64
#: Characters that go through the arrays at once.
SLICE = 1 << 20

_LAST = np.int32(1 << 30)
_WIDTHS = (1, 4, 6, 8, 10, 12, 16, 24, 40, 64)
_A, _B, _C = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9
_M = (1 << 64) - 1
_A32 = 0x9E3779B1
_FREE = np.uint32(0xFFFFFFFF)
SPACE = 0x2581


class Model:
    """Tables of a SentencePiece BPE model."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        pieces = [(p.piece, p.score, p.type) for p in proto.pieces]
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or spec.name != "identity" or spec.remove_extra_whitespaces:
            raise ValueError("needs a BPE model with byte fallback that leaves texts as they are")
        self.prefix = spec.add_dummy_prefix
        normal = {p: i for i, (p, _, t) in enumerate(pieces) if t == 1}
        self.size = len(pieces)
        self.byte = np.zeros(256, np.int32)
        for i, (p, _, t) in enumerate(pieces):
            if t == 6:
                self.byte[int(p[1:-1], 16)] = i
        self.char = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.space = int(self.char[SPACE])
        self.char[SPACE] = -1
        self.char[ord(" ")] = self.space
        scores = sorted({s for _, s, t in pieces if t == 1}, reverse=True)
        place = {s: k for k, s in enumerate(scores)}
        self.rank = np.array([place.get(s, 0) for _, s, _ in pieces], np.int64)
        if len(scores) << 6 >= 1 << 30 or self.size >= 1 << 16:
            raise ValueError("the vocabulary is too large")
        self.order = np.append((self.rank << 6).astype(np.int32), _LAST)  # of piece -1: the last
        pairs: dict[int, int] = {}
        for p, i in normal.items():
            for k in range(1, len(p)):
                a, b = normal.get(p[:k]), normal.get(p[k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.pairs = pairs
        bits = max(4, (len(pairs) * 3).bit_length())
        self.shift = np.uint32(32 - bits)
        self.mask = np.uint32((1 << bits) - 1)
        self.keys, self.values = np.full(1 << bits, _FREE, np.uint32), np.full(1 << bits, -1, np.int32)
        self.reach = 1
        for k, v in pairs.items():
            h, n = ((k * _A32) & 0xFFFFFFFF) >> (32 - bits), 1
            while self.keys[h] != _FREE:
                h, n = (h + 1) & int(self.mask), n + 1
            self.keys[h], self.values[h] = k, v
            self.reach = max(self.reach, n)
        out = [b""] * self.size
        for i, (p, _, t) in enumerate(pieces):
            out[i] = p.replace("▁", " ").encode() if t == 1 else bytes([int(p[1:-1], 16)]) if t == 6 else b""
        self.length = np.array([len(x) for x in out], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]])
        self.blob = np.frombuffer(b"".join(out), np.uint8)

    def merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that two make, -1 if none."""
        key = a.astype(np.uint32) * np.uint32(self.size) + b.astype(np.uint32)
        key[(a < 0) | (b < 0)] = _FREE
        h = (key * np.uint32(_A32)) >> self.shift
        got = self.keys[h]
        out = np.where(got == key, self.values[h], np.int32(-1))
        left = np.flatnonzero((got != key) & (got != _FREE) & (key != _FREE))
        for step in range(1, self.reach):
            if not len(left):
                break
            h = (((key[left] * np.uint32(_A32)) >> self.shift) + np.uint32(step)) & self.mask
            got = self.keys[h]
            hit = got == key[left]
            out[left[hit]] = self.values[h[hit]]
            left = left[~hit & (got != _FREE)]
        return out


@lru_cache(maxsize=4)
def model(path: str) -> Model:
    return Model(path)


def _draw(key: np.ndarray, left: np.ndarray, right: np.ndarray, piece: np.ndarray) -> np.ndarray:
    """64 bits keyed by row, places and piece."""
    h = key ^ (left.astype(np.uint64) * np.uint64(_A) + right.astype(np.uint64) * np.uint64(_B) + piece.astype(np.uint64) * np.uint64(_C))
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(32)
    return h


def _draw_one(key: int, left: int, right: int, piece: int) -> int:
    h = key ^ ((left * _A + right * _B + piece * _C) & _M)
    h ^= h >> 31
    h = (h * 0xBF58476D1CE4E5B9) & _M
    h ^= h >> 29
    h = (h * 0x94D049BB133111EB) & _M
    return h ^ (h >> 32)


def agenda(m: Model, syms: list[int], at: int, key: int, limit: int) -> list[tuple[int, int]]:
    """(place, piece) of one word whose first character is at ``at``: the plain form of the method."""
    n = len(syms)
    sym, nxt, prv = list(syms), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple[int, int, int, int, int]] = []

    def add(i: int, j: int) -> None:
        if i >= 0 and j < n and sym[i] >= 0 and sym[j] >= 0:
            p = m.pairs.get(sym[i] * m.size + sym[j])
            if p is not None:
                heapq.heappush(heap, (int(m.rank[p]), i, j, sym[i], sym[j]))

    for i in range(n - 1):
        add(i, i + 1)
    while heap:
        _, i, j, a, b = heapq.heappop(heap)
        if sym[i] != a or sym[j] != b or nxt[i] != j:
            continue
        p = m.pairs[a * m.size + b]
        if limit and _draw_one(key, at + i, at + j, p) < limit:
            continue
        sym[i], sym[j] = p, -3
        nxt[i] = nxt[j]
        if nxt[j] < n:
            prv[nxt[j]] = i
        add(prv[i], i)
        add(i, nxt[i])
    return [(i, s) for i, s in enumerate(sym) if s != -3]


def _segment(m: Model, sym: np.ndarray, word: np.ndarray, place: np.ndarray, key: np.ndarray, limit: int) -> np.ndarray:
    """Pieces at the characters where they start, -3 elsewhere. word: number of each character's word; place: in its text; key: of its text."""
    n = len(sym)
    out = np.full(n, -3, np.int32)
    if not n:
        return out
    begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    size = np.diff(np.concatenate([begin, [n]]))
    for w in np.flatnonzero(size > LONG).tolist():
        s = int(begin[w])
        for i, p in agenda(m, sym[s : s + size[w]].tolist(), int(place[s]), int(key[s]), limit):
            out[s + i] = p
    pair = np.full(n, -1, np.int32)
    pair[:-1] = m.merged(sym[:-1], sym[1:])
    alone = begin[size == 1]
    out[alone] = sym[alone]
    for low, high in zip(_WIDTHS, _WIDTHS[1:]):
        of = np.flatnonzero((size > low) & (size <= min(high, LONG)))
        if len(of):
            _side_by_side(m, sym, pair, place, key, limit, begin[of], size[of], high, out)
    return out


def _side_by_side(m: Model, sym: np.ndarray, pair: np.ndarray, place: np.ndarray, key: np.ndarray, limit: int, begin: np.ndarray, size: np.ndarray, rows: int, out: np.ndarray) -> None:
    """Words of up to ``rows`` characters, each a column: a round takes the first candidate of each column."""
    step = np.arange(rows, dtype=np.int32)[:, None]
    real = step < size
    at = np.minimum(begin + step, len(sym) - 1)
    s = np.where(real, sym[at], np.int32(-3))
    cand = np.where(step < size - 1, pair[at], np.int32(-1))
    v = m.order[cand] + step  # order and row in one number; the order of -1 is _LAST
    nxt = np.broadcast_to(step + 1, s.shape).astype(np.int8)
    prv = np.broadcast_to(step - 1, s.shape).astype(np.int8)
    while True:
        best = np.minimum.reduce(v, axis=0)
        c = np.flatnonzero(best < _LAST)
        width = s.shape[1]
        if len(c) * 2 < width:  # columns with an empty agenda leave
            done = best >= _LAST
            _put(out, s[:, done], begin[done])
            if not len(c):
                return
            s, cand, v, nxt, prv = (np.take(x, c, axis=1) for x in (s, cand, v, nxt, prv))
            begin, size, best = begin[c], size[c], best[c]
            c = np.arange(len(c))
            width = len(c)
        fs, fc, fv, fn, fp = s.reshape(-1), cand.reshape(-1), v.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        i = best[c] & 63
        k = i * width + c
        j = fn[k].astype(np.int64)
        piece = fc[k]
        if limit:
            at = begin[c]
            first = place[at]
            skip = _draw(key[at], first + i, first + j, piece) < np.uint64(limit)
            fv[k[skip]] = _LAST
            go = ~skip
            c, i, k, j, piece = c[go], i[go], k[go], j[go], piece[go]
        kj = j * width + c
        fs[k] = piece
        fs[kj] = -3
        fv[kj] = _LAST
        after = fn[kj]
        fn[k] = after
        fv[k] = _LAST
        r = np.flatnonzero(after < size[c])
        kr = after[r] * np.int64(width) + c[r]
        fp[kr] = i[r]
        p = m.merged(piece[r], fs[kr])
        fc[k[r]] = p
        fv[k[r]] = m.order[p] + i[r]
        before = fp[k]
        r = np.flatnonzero(before >= 0)
        kl = before[r] * np.int64(width) + c[r]
        p = m.merged(fs[kl], piece[r])
        fc[kl] = p
        fv[kl] = m.order[p] + before[r]


def _put(out: np.ndarray, s: np.ndarray, begin: np.ndarray) -> None:
    i, c = np.nonzero(s != -3)
    out[begin[c] + i] = s[i, c]


def encode(m: Model, texts: list[str], keys: np.ndarray, dropout: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all texts, and the bounds between texts. keys: 64 bits for each text."""
    limit = min(_M, int(dropout * 2.0**64))
    ids, counts = [], []
    a = 0
    while a < len(texts):
        b, held = a, 0
        while b < len(texts) and (b == a or held + len(texts[b]) <= SLICE):
            held += len(texts[b])
            b += 1
        part = [" " + t if t and m.prefix else t for t in texts[a:b]]
        size = np.array([len(t) for t in part], np.int64)
        cps = np.frombuffer("".join(part).encode("utf-32-le"), np.uint32)
        sym = m.char[cps]
        off = np.concatenate([[0], np.cumsum(size)])
        doc = np.repeat(np.arange(b - a), size)
        blank = sym == m.space
        new = blank & ~np.concatenate([[False], blank[:-1]])
        new[off[:-1][size > 0]] = True
        word = np.cumsum(new)
        place = np.arange(len(sym)) - np.repeat(off[:-1], size)
        out = _segment(m, sym, word, place, np.asarray(keys[a:b], np.uint64)[doc], limit)
        at = np.flatnonzero(out != -3)
        got, of = out[at], doc[at]
        odd = np.flatnonzero(got == -1)
        if len(odd):
            raw = [chr(c).encode() for c in cps[at[odd]].tolist()]
            lens = np.ones(len(got), np.int64)
            lens[odd] = [len(x) for x in raw]
            begin = np.cumsum(lens) - lens
            wide = np.repeat(got, lens)
            data = np.frombuffer(b"".join(raw), np.uint8)
            n = lens[odd]
            inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            wide[np.repeat(begin[odd], n) + inner] = m.byte[data]
            got, of = wide, np.repeat(of, lens)
        ids.append(got.astype(np.int32))
        counts.append(np.bincount(of, minlength=b - a))
        a = b
    return (np.concatenate(ids) if ids else np.zeros(0, np.int32)), np.concatenate([[0], *([np.cumsum(np.concatenate(counts))] if counts else [])]).astype(np.int64)


def decode(m: Model, ids: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Texts of ids, cut at bounds."""
    n = m.length[ids]
    ends = np.concatenate([[0], np.cumsum(n)])
    src = np.repeat(m.start[ids] - ends[:-1], n) + np.arange(int(ends[-1]))
    data = m.blob[src]
    off = ends[bounds]
    if m.prefix:
        some = np.diff(bounds) > 0
        keep = np.ones(len(data), bool)
        keep[off[:-1][some]] = False
        data = data[keep]
        off = off - np.concatenate([[0], np.cumsum(some)])
    return pa.LargeStringArray.from_buffers(len(bounds) - 1, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data)))


def _valid(texts: pa.Array) -> np.ndarray:
    return np.asarray(texts.is_valid().to_numpy(zero_copy_only=False), bool)


def _lists(ids: np.ndarray, bounds: np.ndarray, valid: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids), mask=pa.array(~valid))


def with_ids(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """row, doc_id, ids (of every text, whole) and whether they decode to the very text."""

    @F.arrow_udf("ids array<int>, lossless boolean")
    def encoded(it: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        m = model(path)
        for texts, keys in it:
            parts = []
            for a in range(0, max(1, len(texts)), 512):
                t = texts[a : a + 512]
                got = ["" if x is None else x for x in t.to_pylist()]
                ids, bounds = encode(m, got, keys[a : a + 512].to_numpy().view(np.uint64), dropout)
                back = decode(m, ids, bounds).to_pylist()
                valid = _valid(t)
                same = np.array([x == y for x, y in zip(got, back)], bool)
                parts.append(pa.StructArray.from_arrays([_lists(ids, bounds, valid), pa.array(same, mask=~valid)], ["ids", "lossless"]))
            yield pa.concat_arrays(parts)

    rows = docs.select(*[c.alias(n) for n, c in packed(docs).items()])
    key = F.xxhash64(F.lit(seed), "doc_id", F.xxhash64("text"))
    return rows.select("row", "doc_id", encoded("text", key).alias("e")).select("row", "doc_id", "e.ids", "e.lossless")


def tokenized(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED) -> DataFrame:
    """(doc_id, n_ids, ids, lossless) of every row."""
    got = with_ids(docs, path, dropout, seed)
    return got.select("doc_id", F.when(F.col("ids").isNotNull(), F.size("ids")).alias("n_ids"), "ids", "lossless")


def detokenized(tokens: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    @F.arrow_udf("string")
    def decoded(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = model(path)
        for lists in it:
            valid = _valid(lists)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            n = np.array([0 if x is None else x for x in lists.value_lengths().to_pylist()], np.int64)
            texts = decode(m, flat, np.concatenate([[0], np.cumsum(n)]))
            yield pa.array([x if v else None for x, v in zip(texts.to_pylist(), valid)], pa.string())

    return tokens.select("doc_id", decoded("ids").alias("text"))
