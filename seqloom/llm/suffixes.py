"""Suffix-array dedup, as far as it is built: blocks of windows, sieved by a difference cover.

The suffixes are those at every word of every text. {0, 1, 3} covers all
differences modulo 7, so for any two suffixes there is a step below 7 after
which both are at sample places (those whose number is 0, 1 or 3 modulo 7).

1. Sample: windows of ``LENGTH - 6`` words at sample places are told apart by an
   exchange of coded hashes; a sample suffix whose window occurs once has no
   tie. Two suffixes that agree in LENGTH words agree, after the common step,
   in such a window, so a suffix with no tied sample place in its first seven
   words is alone and leaves the construction.
2. Blocks: the others go to buckets by their first word, as many as keep a
   bucket of common size small; a bucket is sorted by first word and by the hash
   of the first LENGTH words; neighbours that agree in both are repeats.
3. Buckets answer, to each chunk, the places that repeat; texts don't move.

This is less than a suffix array: sample windows have hashes and not ranks, the
order within a bucket is that of hashed blocks, suffixes that agree beyond
LENGTH words are not told apart, and the suffixes of one very frequent first
word, as far as they can repeat, are one bucket of one task. No passage is lost
by it. A text may have up to 2**32 words.

Results are defined as in countmin: passages of repeated windows of LENGTH
words with the same rules for nulls, empty and short texts, ties, repeated rows
and doc_ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import golomb, store
from . import textops as T
from .countmin import _LAST, _SPAN, WINDOW

LENGTH = WINDOW
PERIOD = 7
COVER = (0, 1, 3)
#: Steps from a place, by its number modulo PERIOD, to the next sample place.
NEXT = np.array([next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER) for r in range(PERIOD)])
#: Suffixes in a bucket, on average.
PER_BUCKET = 1 << 20
_PLACE = 32  # bits of a word's number in its text; its row's number in the file has the 31 above

_MESSAGE = pa.schema([("bucket", pa.int32()), ("sender", pa.int64()), *[(c, pa.binary()) for c in ("first", "window", "rank", "place", "ids")]])
_ANSWER = pa.schema([("shard", pa.int32()), ("sender", pa.int64()), ("places", pa.binary()), ("redundant", pa.binary())])


def _parts(texts: pa.ChunkedArray, length: int) -> tuple[T.Words, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words, each word's number in its text, its text, whether a sample window starts there, and the window's hash."""
    w = T.words(texts)
    doc = w.doc
    number = np.arange(len(doc)) - w.bounds[doc]
    k = length - PERIOD + 1
    sample = np.zeros(len(doc), bool)
    inside = T.inside_docs(w.bounds, k)
    sample[: len(inside)] = inside
    sample &= np.isin(number % PERIOD, COVER)
    hashes = np.zeros(len(doc), np.uint64)
    g = T.long_ngrams(w.hash, k)
    hashes[: len(g)] = g >> np.uint64(2)
    return w, number, doc, sample, hashes


def passages(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, start_word, end_word, redundant), as countmin.passages."""
    if length < PERIOD + 1:
        raise ValueError("the length must exceed the period of the cover")
    spark = docs.sparkSession
    _, chars = X.volume(docs)
    many = max(1, chars // 5)
    owners = X.owners_for(docs, many)
    buckets = max(owners, -(-many // (4 * PER_BUCKET)))
    rows = store.chunked(docs, {"doc_id": docs["doc_id"], "text": F.lower(docs["text"]), "row": F.lit(0)}, numbered="row").where("text is not null")

    def sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch:
            _, _, _, sample, h = _parts(table["text"], length)
            kinds, n = np.unique(h[sample], return_counts=True)
            return X.messages(sender, kinds, owners, 62, n)

        return X.sender_batches(batches, one)

    ranks = X.exchange(rows.mapInArrow(sampled, X.MESSAGE), owners, "sample")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch | None:
            w, number, doc, sample, h = _parts(table["text"], length)
            full = T.inside_docs(w.bounds, length)
            if not full.any():
                return None
            tied = np.zeros(len(h), bool)
            at = np.flatnonzero(sample)
            tied[at] = X.Answers(*ranks, sender).find(h[at])[0]
            before = np.concatenate([[0], np.cumsum(tied)])
            i = np.flatnonzero(full)
            i = i[before[i + PERIOD] > before[i]]
            first = (T.mix(w.hash[i]) >> np.uint64(32)).astype(np.uint32)
            window = T.long_ngrams(w.hash, length)[i] >> np.uint64(2)
            rank = h[i + NEXT[number[i] % PERIOD]]
            place = (table["row"].to_numpy()[doc[i]].astype(np.int64) << _PLACE) + number[i]
            ids = table["doc_id"].fill_null(_LAST).to_numpy()[doc[i]]
            bucket = (first.astype(np.uint64) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            order = np.lexsort((place, bucket))
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            out: dict[str, list] = {c: [] for c in _MESSAGE.names}
            for b in np.flatnonzero(np.diff(cuts)).tolist():
                o = order[cuts[b] : cuts[b + 1]]
                for c, v in (("bucket", b), ("sender", sender), ("first", X.squeeze(first[o])), ("window", X.squeeze(window[o])), ("rank", X.squeeze(rank[o])), ("place", golomb.encode(place[o].astype(np.uint64))), ("ids", X.squeeze(ids[o]))):
                    out[c].append(v)
            return pa.RecordBatch.from_pydict(out, schema=_MESSAGE)

        return X.sender_batches(batches, one)

    def sorted_bucket(got: pa.Table) -> pa.Table:
        cols = {c: got[c].to_pylist() for c in _MESSAGE.names}
        place = [golomb.decode(x).astype(np.int64) for x in cols["place"]]
        size = np.array([len(x) for x in place])
        of = np.repeat(np.arange(len(size)), size)
        p = np.concatenate(place)
        first = np.concatenate([X.loosen(x, np.uint32) for x in cols["first"]])
        window, rank = (np.concatenate([X.loosen(x, np.uint64) for x in cols[c]]) for c in ("window", "rank"))
        ids = np.concatenate([X.loosen(x, np.int64) for x in cols["ids"]])
        order = np.lexsort((p, of, rank, window, first))  # the bucket's part of the suffix array
        f, w = first[order], window[order]
        new = np.ones(len(order), bool)
        new[1:] = (f[1:] != f[:-1]) | (w[1:] != w[:-1])
        start = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        repeated = np.diff(np.append(start, len(order)))[group] > 1
        least = np.minimum.reduceat(ids[order], start)[group]
        # the first place of a window in each row
        text = p[order] >> _PLACE
        inner = np.lexsort((p[order], text, of[order], group))
        head = np.ones(len(order), bool)
        g, s, t = group[inner], of[order][inner], text[inner]
        head[1:] = (g[1:] != g[:-1]) | (s[1:] != s[:-1]) | (t[1:] != t[:-1])
        low = np.zeros(len(order), bool)
        low[inner[head]] = True
        redundant = ~((ids[order] == least) & low)
        rep, red = np.zeros(len(order), bool), np.zeros(len(order), bool)
        rep[order], red[order] = repeated, redundant
        out: dict[str, list] = {c: [] for c in _ANSWER.names}
        at = np.concatenate([[0], np.cumsum(size)])
        for i, sender in enumerate(cols["sender"]):
            r = slice(int(at[i]), int(at[i + 1]))
            if rep[r].any():
                out["shard"].append(sender % owners)
                out["sender"].append(sender)
                out["places"].append(golomb.encode(p[r][rep[r]].astype(np.uint64)))
                out["redundant"].append(X.squeeze(np.packbits(red[r][rep[r]])))
        return pa.Table.from_pydict(out, schema=_ANSWER)

    messages = "bucket int, sender long, " + ", ".join(f"{c} binary" for c in _MESSAGE.names[2:])
    found = store.written(
        rows.mapInArrow(sent, messages).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(sorted_bucket, "shard int, sender long, places binary, redundant binary").repartition(owners, "shard").sortWithinPartitions("shard", "sender"),
        "suffixes",
        "shard",
    )
    store.drop(spark, ranks[0])

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch | None:
            got = store.read_shard(found, sender, sender % owners)
            if got is None or not got.num_rows:
                return None
            p = [golomb.decode(x).astype(np.int64) for x in got["places"].to_pylist()]
            red = np.concatenate([np.unpackbits(X.loosen(x, np.uint8))[: len(q)] for x, q in zip(got["redundant"].to_pylist(), p)]).astype(bool)
            place, first = np.unique(np.concatenate(p), return_index=True)
            red = red[first]
            mine = {int(r): k for k, r in enumerate(table["row"].to_pylist())}
            row = place >> _PLACE
            k = np.array([mine.get(int(r), -1) for r in row[np.concatenate([[True], row[1:] != row[:-1]])]])[np.cumsum(np.concatenate([[True], row[1:] != row[:-1]])) - 1]
            use = k >= 0
            place, red, k = place[use], red[use], k[use]
            if not len(place):
                return None
            cut = np.ones(len(place), bool)
            cut[1:] = (place[1:] != place[:-1] + 1) | (red[1:] != red[:-1])
            s = np.flatnonzero(cut)
            e = np.append(s[1:], len(place)) - 1
            number = place & ((1 << _PLACE) - 1)
            return pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().take(pa.array(k[s])), pa.array(number[s]), pa.array(number[e] + length), pa.array(red[s])], schema=_SPAN)

        return X.sender_batches(batches, one)

    return rows.select("doc_id", "row", "_sender").mapInArrow(joined, "doc_id long, start_word long, end_word long, redundant boolean")
