"""Substring dedup with a count-min prefilter.

Windows of ``WINDOW`` words are counted in two passes over whole texts. First
each chunk sketches its windows: ``DEPTH`` rows of counters, of which only the
counters that aren't zero are sent, sorted and Golomb-coded; owners of counter
ranges merge the sketches and answer which counters reach two. A window's
estimate, the least of its counters, is never below its count, so every window
that repeats is estimated repeated. The second pass groups exactly, by 62-bit
hash over all chunks, only the windows so estimated. The rows have a few
counters a window, whatever the size of the corpus.

A repeated window is redundant unless it is the first of its kind: in the
document of least doc_id, at its least place there. Neighbouring repeated
windows of one verdict make a passage.

Defined results: words are compared in lower case, punctuation and spacing
don't count; null and empty texts, and those shorter than a window, have no
passage; rows that share a doc_id count as one document; a null doc_id comes
after all others and is reported as null; equal texts are passages throughout.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import store
from . import textops as T

WINDOW = 40
DEPTH = 2
_LAST = np.iinfo(np.int64).max - 1
_SPAN = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("redundant", pa.bool_())])


def windows(texts: pa.Array | pa.ChunkedArray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """62-bit hash, text and place of every window."""
    w = T.words(texts)
    ok = np.flatnonzero(T.inside_docs(w.bounds, size))
    doc = np.searchsorted(w.bounds, ok, "right") - 1
    return T.long_ngrams(w.hash, size)[ok] >> np.uint64(2), doc, ok - w.bounds[doc]


def cells(h: np.ndarray, bits: int) -> list[np.ndarray]:
    """The counter of each window in each row; a row's counters follow those of the row before it."""
    return [(T.mix(h ^ np.uint64(0xA5A5A5A5 * (r + 1))) >> np.uint64(64 - bits)) + np.uint64(r << bits) for r in range(DEPTH)]


def passages(docs: DataFrame, size: int = WINDOW) -> DataFrame:
    """(doc_id, start_word, end_word, redundant) of passages of repeated windows; the end is exclusive."""
    _, chars = X.volume(docs)
    words = max(1, chars // 5)
    bits, owners = min(58, words.bit_length() + 3), X.owners_for(docs, DEPTH * words)
    rows = store.chunked(docs, {"doc_id": docs["doc_id"], "text": F.lower(docs["text"])}).where("text is not null")

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch:
            kinds, n = np.unique(windows(table["text"], size)[0], return_counts=True)
            parts = []
            for cell in cells(kinds, bits):
                order = np.argsort(cell)
                c, k = cell[order], n[order]
                first = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]])) if len(c) else np.zeros(0, np.int64)
                parts.append((c[first], np.add.reduceat(k, first) if len(first) else k))
            return X.messages(sender, np.concatenate([p[0] for p in parts]), owners, bits + (DEPTH - 1).bit_length(), np.concatenate([p[1] for p in parts]))

        return X.sender_batches(batches, one)

    sketch = X.exchange(rows.mapInArrow(sketched, X.MESSAGE), owners, "sketch")

    def estimated(sender: int, h: np.ndarray) -> np.ndarray:
        """Which of the window kinds are estimated to occur twice or more."""
        merged = X.Answers(*sketch, sender)
        out = np.ones(len(h), bool)
        for cell in cells(h, bits):
            out &= merged.find(cell)[0]
        return out

    def suspected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch:
            h, doc, _ = windows(table["text"], size)
            ids = table["doc_id"].fill_null(_LAST).to_numpy()[doc]
            order = np.lexsort((ids, h))
            h, ids = h[order], ids[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            kinds, n = h[first], np.diff(np.append(first, len(h)))
            use = estimated(sender, kinds)
            return X.messages(sender, kinds[use], owners, 62, n[use], ids[first[use]])

        return X.sender_batches(batches, one)

    exact = X.exchange(rows.mapInArrow(suspected, X.MESSAGE), owners, "windows")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch | None:
            known = X.Answers(*exact, sender)
            if not len(known.hash):
                return None
            h, doc, place = windows(table["text"], size)
            hit, at = known.find(h)
            h, doc, place, at = h[hit], doc[hit], place[hit], at[hit]
            if not len(h):
                return None
            ids = table["doc_id"].fill_null(_LAST).to_numpy()
            order = np.lexsort((place, doc, at))
            new = np.ones(len(h), bool)
            a, d = at[order], doc[order]
            new[1:] = (a[1:] != a[:-1]) | (d[1:] != d[:-1])
            first = np.zeros(len(h), bool)
            first[order[new]] = True
            redundant = ~(first & (ids[doc] == known.least[at]))
            cut = np.ones(len(h), bool)
            cut[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (redundant[1:] != redundant[:-1])
            s = np.flatnonzero(cut)
            e = np.append(s[1:], len(h)) - 1
            return pa.RecordBatch.from_arrays([table["doc_id"].combine_chunks().take(pa.array(doc[s])), pa.array(place[s]), pa.array(place[e] + size), pa.array(redundant[s])], schema=_SPAN)

        return X.sender_batches(batches, one)

    return rows.mapInArrow(joined, "doc_id long, start_word long, end_word long, redundant boolean")


def sql(size: int = WINDOW) -> str:
    return f"""
WITH w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(lower(text), '{T.SEPARATOR}'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
x AS (SELECT r, doc_id, i - 1 AS p, md5(array_to_string(ws[i:i + {size - 1}], ' ')) AS g FROM w, range(1, len(ws) - {size - 2}) t(i)),
y AS (SELECT *, count(*) OVER (PARTITION BY g) AS n, min(coalesce(doc_id, {_LAST})) OVER (PARTITION BY g) AS least, min(p) OVER (PARTITION BY g, r) AS low FROM x),
z AS (SELECT *, NOT (coalesce(doc_id, {_LAST}) = least AND p = low) AS redundant FROM y WHERE n > 1),
q AS (SELECT *, p - row_number() OVER (PARTITION BY r, redundant ORDER BY p) AS island FROM z)
SELECT any_value(doc_id) AS doc_id, min(p)::BIGINT AS start_word, (max(p) + {size})::BIGINT AS end_word, redundant FROM q GROUP BY r, redundant, island
"""
