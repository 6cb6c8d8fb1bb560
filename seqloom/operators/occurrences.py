"""Where patterns end, as bits: sequences in blocks, a word of 64 bits for each 64 places.

A block has the words of its sequences one after another, and an entry (item,
word, bits) for each word that an item occurs in. Ends of a pattern are a bit a
place; what can follow them is found by shifts, for all items at once. Blocks
are as large as their rows are many, so long sequences and many items cost no
more than they have occurrences.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

#: Occurrences of items in a block, about: its arrays stay in the processor's caches.
ROWS = 150_000
#: Counts that a task gathers before it adds equal ones up.
COUNTS = 1 << 20


@dataclass
class Level:
    """Patterns of as many items: each is one of the level before with an item more, at a new place or (inner) at the last one; in the order of parents. size: itemsets."""

    parent: np.ndarray
    inner: np.ndarray
    item: np.ndarray
    size: np.ndarray
    support: np.ndarray


@dataclass
class Block:
    """item, word, bits: entries in the order of (item, word); seq: the sequence of each word."""

    seq: np.ndarray
    item: np.ndarray
    word: np.ndarray
    bits: np.ndarray
    single: bool = field(init=False)

    def __post_init__(self) -> None:
        self.single = len(self.seq) == 0 or self.seq[-1] + 1 == len(self.seq)

    def shifted(self, o: np.ndarray, k: int) -> np.ndarray:
        """Bits k places later in their sequences."""
        q, r = divmod(k, 64)
        out = self._moved(o, q) << np.uint64(r)
        return out | self._moved(o, q + 1) >> np.uint64(64 - r) if r and not self.single else out

    def _moved(self, o: np.ndarray, q: int) -> np.ndarray:
        if not q:
            return o
        out = np.zeros_like(o)
        if not self.single and q < len(o):
            out[q:] = np.where(self.seq[q:] == self.seq[:-q], o[:-q], np.uint64(0))
        return out

    def after(self, o: np.ndarray) -> np.ndarray:
        """All places behind the first in each sequence."""
        low = o & (~o + np.uint64(1))
        out = np.where(o != 0, ~(low | (low - np.uint64(1))), np.uint64(0))
        if not self.single:
            last = np.maximum.accumulate(np.where(o != 0, np.arange(len(o)), -1))
            held = np.concatenate([[False], (last[:-1] >= 0) & (self.seq[np.maximum(last[:-1], 0)] == self.seq[1:])])
            out[held] = ~np.uint64(0)
        return out

    def ahead(self, o: np.ndarray, gap_min: int, gap_max: int | None) -> np.ndarray:
        """Places that may follow."""
        if gap_max is None:
            return self.shifted(self.after(o), gap_min)
        out, has, need = self.shifted(o, 1 + gap_min), 1, gap_max - gap_min + 1
        while has < need:
            step = min(has, need - has)
            out, has = out | self.shifted(out, step), has + step
        return out

    def holders(self, item: np.ndarray, word: np.ndarray, n_items: int) -> np.ndarray:
        """Sequences with each item, of entries in order."""
        if not self.single and len(item):
            s = self.seq[word]
            item = item[np.concatenate([[True], (item[1:] != item[:-1]) | (s[1:] != s[:-1])])]
        return np.bincount(item, minlength=n_items)


def packed(rows: DataFrame, items: np.ndarray, gap_min: int, gap_max: int | None) -> DataFrame:
    """Blocks (seq, item, word, bits) of rows (seq_id, pos, item_id); items: all item ids in order, by whose place an item is known.

    Distances that no gap spans are shortened, so sparse places need few bits.
    """
    far = gap_min + 1 if gap_max is None else gap_max + 2

    def block(t: pa.RecordBatch) -> pa.RecordBatch:
        new = np.concatenate([[True], _changes(t.column(0))])
        sid = np.cumsum(new) - 1
        start = np.flatnonzero(new)
        step = np.diff(t.column(1).to_numpy(), prepend=0)
        step = np.where((step < 0) | (step > far), far, step)  # below 0: beyond 64 bits
        step[start] = 0
        place = np.cumsum(step)
        place -= place[start][sid]
        words = np.maximum.reduceat(place, start) // 64 + 1
        base = np.cumsum(words) - words
        key = np.searchsorted(items, t.column(2).to_numpy()) * words.sum() + base[sid] + place // 64
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        bits = np.bitwise_or.reduceat((np.uint64(1) << (place % 64).astype(np.uint64))[order], first)
        key = key[first]
        columns = np.repeat(np.arange(len(words)), words).astype(np.int32), (key // words.sum()).astype(np.int32), (key % words.sum()).astype(np.int32), bits
        return pa.RecordBatch.from_arrays([pa.array([c.tobytes()], pa.binary()) for c in columns], ["seq", "item", "word", "bits"])

    def blocks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n, most = 0, ROWS
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < most:
                continue
            whole = pa.concat_batches(held)
            cut = np.flatnonzero(_changes(whole.column(0)))
            at = int(cut[-1]) + 1 if len(cut) else 0
            if at:
                for lo, hi in _pieces(cut + 1, at):
                    yield block(whole.slice(lo, hi - lo))
            held, n = [whole.slice(at)], whole.num_rows - at
            most = max(ROWS, 2 * n)  # a long sequence isn't put together again at each batch
        if n:
            whole = pa.concat_batches(held)
            for lo, hi in _pieces(np.flatnonzero(_changes(whole.column(0))) + 1, whole.num_rows):
                yield block(whole.slice(lo, hi - lo))

    near = rows.select("seq_id", "pos", "item_id").repartition("seq_id").sortWithinPartitions("seq_id", "pos")
    return near.mapInArrow(blocks, "seq binary, item binary, word binary, bits binary")


def _changes(x: pa.Array) -> np.ndarray:
    """Whether each value differs from the one before, without the first."""
    return pc.not_equal(x.slice(1), x.slice(0, max(0, len(x) - 1))).to_numpy(zero_copy_only=False).astype(bool)


def _pieces(ends: np.ndarray, n: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole sequences of about ROWS rows each; ends: where sequences end."""
    lo = 0
    while lo < n:
        i = np.searchsorted(ends, lo + ROWS)
        hi = min(n, int(ends[i])) if i < len(ends) else n
        yield lo, hi
        lo = hi


def counts(blocks: DataFrame, levels: list[Level], n_items: int, gap_min: int, gap_max: int | None, max_itemsets: int | None = None, grow: bool = True) -> DataFrame:
    """(key, n): sequences with each pattern of the last level that one item more extends; a key holds (pattern, inner, item). Without grow: with each pattern, numbered through the levels."""
    top = len(levels) - 1 + (not grow)
    before = np.cumsum([0, *(len(x.item) for x in levels)])
    first = [np.searchsorted(b.parent, np.arange(len(a.item) + 1)) for a, b in zip(levels, levels[1:])]
    first.append(np.zeros(len(levels[-1].item) + 1, np.int64))

    def count(block: Block) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        def grown(part: np.ndarray, ent: tuple[np.ndarray, ...], item: int) -> np.ndarray:
            lo, hi = np.searchsorted(ent[0], [item, item + 1])
            out = np.zeros(len(block.seq), np.uint64)
            out[ent[1][lo:hi]] = part[lo:hi]
            return out

        every = block.item, block.word, block.bits
        todo = [(0, i, None, every, len(block.seq)) for i in range(len(levels[0].item))]  # their ends are found when their turn comes
        while todo:
            at, node, ends, ent, n_live = todo.pop()
            if ends is None:
                ends = grown(block.bits, every, int(levels[0].item[node]))
            last = at < top and first[at][node] == first[at][node + 1]
            if grow and last:
                continue
            live = ends != 0
            if not grow and (n := np.count_nonzero(live if block.single else np.bincount(block.seq[live]))):
                yield before[at : at + 1] + node, np.array([n])
            if last:
                continue
            if not block.single:
                live = np.bincount(block.seq[live], minlength=block.seq[-1] + 1)[block.seq] > 0
            n = np.count_nonzero(live)
            if not n:
                continue
            if 2 * n < n_live:  # those that can't extend it any more are left behind
                keep = live[ent[1]]
                ent, n_live = tuple(x[keep] for x in ent), n
            item, word, bits = ent
            lo = np.searchsorted(item, int(levels[at].item[node]) + 1)
            inner = ends[word[lo:]] & bits[lo:]
            wide = max_itemsets is None or levels[at].size[node] < max_itemsets
            outer = block.ahead(ends, gap_min, gap_max)[word] & bits if wide else np.zeros(len(bits), np.uint64)
            if at < top:
                within = np.concatenate([np.zeros(lo, np.uint64), inner])
                for c in range(first[at][node], first[at][node + 1]):
                    todo.append((at + 1, c, grown(within if levels[at + 1].inner[c] else outer, ent, int(levels[at + 1].item[c])), ent, n_live))
                continue
            for kind, hit, shift in ((0, outer != 0, 0), (1, inner != 0, lo)):
                got = block.holders(item[shift:][hit], word[shift:][hit], n_items)
                some = np.flatnonzero(got)
                yield (2 * node + kind) * n_items + some, got[some]

    def counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, sums, n = [], [], 0
        for b in batches:
            for row in range(b.num_rows):
                seq, item, word = (np.frombuffer(b.column(i)[row].as_py(), np.int32) for i in range(3))
                for k, c in count(Block(seq, item, word, np.frombuffer(b.column(3)[row].as_py(), np.uint64))):
                    keys.append(k)
                    sums.append(c)
                    n += len(k)
                    if n >= COUNTS:
                        keys, sums = map(list, zip(_added(keys, sums)))
                        n = 0 if 2 * len(keys[0]) < COUNTS else len(keys[0])
                        if n:  # hardly any are equal
                            yield _batch(keys[0], sums[0])
                            keys, sums, n = [], [], 0
        if keys:
            yield _batch(*_added(keys, sums))

    return blocks.mapInArrow(counted, "key long, n long")


def _added(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, at = np.unique(np.concatenate(keys), return_inverse=True)
    return key.astype(np.int64), np.bincount(at, np.concatenate(sums), len(key)).astype(np.int64)


def _batch(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key, pa.int64()), pa.array(n, pa.int64())], ["key", "n"])


def tree(patterns: list[tuple[tuple[int, ...], ...]]) -> tuple[list[Level], np.ndarray, list[int]]:
    """Levels of patterns and of all their beginnings, the items, and the number of each pattern through the levels."""
    items = np.unique([i for p in patterns for s in p for i in s]).astype(np.int32)
    steps = [[(k == 0, int(np.searchsorted(items, i))) for s in p for k, i in enumerate(s)] for p in patterns]
    levels, near = [], {(): 0}
    number = [0] * len(patterns)
    before = 0
    for n in range(max(map(len, steps), default=0)):
        known = sorted({(near[tuple(x[:n])], not x[n][0], x[n][1], tuple(x[: n + 1])) for x in steps if len(x) > n})
        near = {x[3]: i for i, x in enumerate(known)}
        parent, inner, item = (np.array([x[j] for x in known]) for j in range(3))
        size = np.array([sum(new for new, _ in x[3]) for x in known])
        levels.append(Level(parent, inner.astype(bool), item, size, np.zeros(len(known), np.int64)))
        for j, x in enumerate(steps):
            if len(x) == n + 1:
                number[j] = before + near[tuple(x)]
        before += len(known)
    return levels, items, number


def written_out(levels: list[Level], items: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(pattern, support) of each level: flat items and where itemsets end, copied from the level before."""
    flat, new = np.zeros((1, 0), np.int32), np.zeros((1, 0), bool)
    for level in levels:
        flat = np.column_stack([flat[level.parent], items[level.item]]).astype(np.int32)
        new = np.column_stack([new[level.parent], ~level.inner])
        starts = np.flatnonzero(new)
        inner = pa.ListArray.from_arrays(pa.array(np.append(starts, flat.size), pa.int32()), pa.array(flat.ravel(), pa.int32()))
        outer = np.concatenate([[0], np.cumsum(new.sum(axis=1))])
        yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(outer, pa.int32()), inner), pa.array(level.support, pa.int64())], ["pattern", "support"])
