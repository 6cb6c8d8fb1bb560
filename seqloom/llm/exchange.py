"""Exchange of coded hashes between chunks of a table and owners of hash ranges.

Each chunk (sender) counts its distinct hashes and sends every owner the sorted
Golomb-coded ones of the owner's range, with their counts. An owner adds up the
counts and answers each sender about those of its hashes that occur at least
twice overall; a hash that no answer names occurs once. Only codes are
shuffled, never texts or rows. Answers are a table in the shared folder, from
which the next scan of the same chunks reads its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import golomb, store

#: Hashes that one owner is to hold, on average.
PER_OWNER = 1 << 22

MESSAGE = "sender long, owner int, code binary, counts binary, least binary"
_MESSAGE = pa.schema([("sender", pa.int64()), ("owner", pa.int32()), ("code", pa.binary()), ("counts", pa.binary()), ("least", pa.binary())])
ANSWER = "shard int, sender long, owner int, code binary, totals binary, least binary"
_ANSWER = pa.schema([("shard", pa.int32()), ("sender", pa.int64()), ("owner", pa.int32()), ("code", pa.binary()), ("totals", pa.binary()), ("least", pa.binary())])


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(x).tobytes(), 1)


def loosen(x: bytes | None, dtype: type) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(x), dtype) if x else np.zeros(0, dtype)


def _totals(x: np.ndarray) -> bytes:
    """Totals in 32 bits each, or in 64 if one needs them; which, is seen by their length."""
    return squeeze(x.astype(np.uint32 if x.max(initial=0) < 2**32 else np.uint64))


def _loosened(x: bytes, n: int) -> np.ndarray:
    raw = zstandard.decompress(x)
    return np.frombuffer(raw, np.uint64 if len(raw) == 8 * n else np.uint32).astype(np.int64)


def owners_for(df: DataFrame, hashes: int) -> int:
    """Owners for so many hashes in all: enough that each holds a bounded number, at least one a shuffle partition."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-hashes // PER_OWNER))


def messages(sender: int, hashes: np.ndarray, owners: int, bits: int, counts: np.ndarray | None = None, least: np.ndarray | None = None) -> pa.RecordBatch:
    """A sender's messages about sorted distinct hashes below 2**bits; owners have equal ranges."""
    width = ((1 << bits) + owners - 1) // owners
    cuts = np.searchsorted(hashes, np.array([min(i * width, (1 << 64) - 1) for i in range(owners + 1)], dtype=np.uint64))
    cuts[-1] = len(hashes)
    rows: dict[str, list] = {n: [] for n in _MESSAGE.names}
    for o in np.flatnonzero(np.diff(cuts)).tolist():
        s = slice(int(cuts[o]), int(cuts[o + 1]))
        rows["sender"].append(sender)
        rows["owner"].append(o)
        rows["code"].append(golomb.encode(hashes[s]))
        rows["counts"].append(None if counts is None or (counts[s] == 1).all() else squeeze(counts[s].astype(np.uint32)))
        rows["least"].append(None if least is None else squeeze(least[s].astype(np.int64)))
    return pa.RecordBatch.from_pydict(rows, schema=_MESSAGE)


def _answer(shards: int) -> Callable[[pa.Table], pa.Table]:
    def answer(got: pa.Table) -> pa.Table:
        senders, owner = got["sender"].to_pylist(), got["owner"][0].as_py()
        lists = [golomb.decode(x) for x in got["code"].to_pylist()]
        counts = [np.ones(len(v), np.uint32) if c is None else loosen(c, np.uint32) for v, c in zip(lists, got["counts"].to_pylist())]
        least = [loosen(x, np.int64) for x in got["least"].to_pylist()]
        sizes = np.array([len(v) for v in lists])
        values = np.concatenate(lists)
        _, group = np.unique(values, return_inverse=True)
        total = np.bincount(group, weights=np.concatenate(counts)).astype(np.int64)
        keep = total[group] > 1
        low = None
        if sum(map(len, least)) == len(values):
            low = np.full(len(total), np.iinfo(np.int64).max)
            np.minimum.at(low, group[keep], np.concatenate(least)[keep])
        rows: dict[str, list] = {n: [] for n in _ANSWER.names}
        at = np.concatenate([[0], np.cumsum(sizes)])
        for i, sender in enumerate(senders):
            s = slice(int(at[i]), int(at[i + 1]))
            k = keep[s]
            if k.any():
                rows["shard"].append(sender % shards)
                rows["sender"].append(sender)
                rows["owner"].append(owner)
                rows["code"].append(golomb.encode(values[s][k]))
                rows["totals"].append(_totals(total[group[s][k]]))
                rows["least"].append(None if low is None else squeeze(low[group[s][k]]))
        return pa.Table.from_pydict(rows, schema=_ANSWER)

    return answer


def exchange(sent: DataFrame, owners: int, name: str) -> tuple[str, int]:
    """Run the exchange of a DataFrame of messages: the answers' path, and its number of shards."""
    spark = sent.sparkSession
    shards = max(1, owners)
    path = store.written(sent.repartition(owners, "owner").groupBy("owner").applyInArrow(_answer(shards), ANSWER).repartition(shards, "shard").sortWithinPartitions("shard", "sender"), name, "shard")
    return path, shards


class Answers:
    """A sender's answers: sorted hashes that occur twice or more, and their totals."""

    def __init__(self, path: str, shards: int, sender: int):
        got = store.read_shard(path, sender, sender % shards)
        rows = sorted(got.select(["owner", "code", "totals", "least"]).to_pylist(), key=lambda r: (r["owner"], r["code"])) if got is not None else []
        hashes = [golomb.decode(r["code"]) for r in rows]
        self.hash = np.concatenate([np.zeros(0, np.uint64), *hashes])
        self.total = np.concatenate([np.zeros(0, np.int64), *(_loosened(r["totals"], len(h)) for r, h in zip(rows, hashes))])
        self.least = np.concatenate([np.zeros(0, np.int64), *(loosen(r["least"], np.int64) for r in rows)])
        if len(self.hash) > 1 and not (self.hash[1:] > self.hash[:-1]).all():  # a chunk that two tasks shared sent twice
            self.hash, first = np.unique(self.hash, return_index=True)
            self.total = self.total[first]
            self.least = self.least[first] if len(self.least) else self.least

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each hash, whether it is named, and where (0 if not)."""
        if not len(self.hash):
            return np.zeros(len(hashes), bool), np.zeros(len(hashes), np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        hit = self.hash[at] == hashes
        return hit, np.where(hit, at, 0)

    def totals(self, hashes: np.ndarray) -> np.ndarray:
        """How often each hash occurs overall: 1 where no answer names it."""
        hit, at = self.find(hashes)
        return np.where(hit, self.total[at], 1).astype(np.int64) if len(self.total) else np.ones(len(hashes), np.int64)


def bits_for(hashes: int) -> int:
    """Hash bits that keep chance equality rare among so many hashes."""
    return min(62, max(36, max(1, hashes).bit_length() + 14))


def sender_batches(batches: Iterator[pa.RecordBatch], f: Callable[[int, pa.Table], pa.RecordBatch | None]) -> Iterator[pa.RecordBatch]:
    for sender, table in store.by_sender(batches):
        out = f(sender, table)
        if out is not None and out.num_rows:
            yield out


def volume(df: DataFrame, column: str = "text") -> tuple[int, int]:
    """Rows and characters of a table of texts."""
    r = df.agg(F.count(F.lit(1)), F.sum(F.length(column))).first()
    return int(r[0]), int(r[1] or 0)
