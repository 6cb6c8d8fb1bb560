"""Language-model scores by deleted interpolation of word n-grams.

Counts of one, two and three words are taken over all documents, by an exchange
of coded hashes in which each chunk learns the total counts of its own n-grams:
first of one and two words, then of those of three whose pairs both occur twice
or more, as no other can.
A word's probability mixes the maximum-likelihood estimates of the three orders
and a uniform floor; the mixture depends on how often the two words before it
occur, by powers of two. The weights of each such bucket are learned by
expectation-maximisation on held-out documents. Whether in learning or in
scoring, a document's own occurrences are deleted from the counts first, so
every document is scored by the others.

The held-out part is a keyed tenth of the documents and grows with them; its
words reach EM as counts by bucket and by the three estimates in steps of
2**(1/4), a table whose size is bounded by the steps, not by the corpus.

Each weight is at least ``LEAST_WEIGHT``, so no text, also one of unseen words
only, has a probability of zero.

N-grams are told apart by hashes of 36 bits or more, 14 beyond the number of
words: about one in 2**14 shares its counter with another, in every corpus; the
counts are upper bounds in that measure. They are not compared as words.

Defined results: words are in lower case, each text begins with two marks; a
null text has null scores, a text without words zero words and null scores;
equal texts get equal scores as rows (each is the other's evidence), whether
they share a doc_id or not; a null doc_id is carried along as null; other
columns, whatever their names, are ignored; doc_id is an integer; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as X
from . import store
from . import textops as T

BUCKETS = 16
HELD_OUT = 10
ROUNDS = 60
#: What each weight is at least, so that a text of unseen words has a probability too.
LEAST_WEIGHT = 1e-4
#: Steps by which estimates are told apart in learning: 2**(-k/4), the last for zero.
STEPS = 160
_BEGIN = np.uint64(0x5851F42D4C957F2D)


@dataclass
class Grams:
    """The n-grams of some texts. For each word: its text, and the places of its four n-grams in values."""

    doc: np.ndarray
    values: np.ndarray
    counts: np.ndarray
    place: list[np.ndarray]
    own: list[np.ndarray]
    n_words: np.ndarray
    #: Where the values of order 3 begin.
    third: int


def _own(doc: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """How often each n-gram occurs in the text it is in."""
    _, inverse, count = np.unique(doc * np.int64(n + 1) + at, return_inverse=True, return_counts=True)
    return count[inverse]


def grams(texts: pa.Array | pa.ChunkedArray, bits: int) -> Grams:
    """Orders 1, 2, 3 in ranges of their own below 2**(bits+2); value 0 stands for all words."""
    w = T.words(texts)
    n = np.diff(w.bounds)
    some = np.flatnonzero(n > 0)
    # each text with two marks before it
    size = n[some] + 2
    at = np.cumsum(size) - size
    seq = np.full(int(size.sum()), _BEGIN, np.uint64)
    seq_doc = np.repeat(some, size)
    is_word = np.ones(len(seq), bool)
    is_word[at] = is_word[at + 1] = False
    seq[is_word] = w.hash
    word = np.flatnonzero(is_word)
    cut = np.uint64(64 - bits)
    h1 = T.mix(seq) >> cut
    h2 = (T.ngrams(seq, 2) >> cut) + np.uint64(1 << bits)
    h3 = (T.ngrams(seq, 3) >> cut) + np.uint64(2 << bits)
    h1[h1 == 0] = 1
    inner2 = np.flatnonzero(seq_doc[1:] == seq_doc[:-1]) if len(seq) else np.zeros(0, np.int64)
    v1, i1, c1 = np.unique(h1, return_inverse=True, return_counts=True)
    v2, i2, c2 = np.unique(h2[inner2], return_inverse=True, return_counts=True)
    v3, i3, c3 = np.unique(h3[word - 2] if len(word) else h3, return_inverse=True, return_counts=True)
    pair = np.zeros(len(seq), np.int64)  # by the place of its first word
    pair[inner2] = i2
    own1, own2 = _own(seq_doc, i1, len(v1)), np.zeros(len(seq), np.int64)
    own2[inner2] = _own(seq_doc[inner2], i2, len(v2))
    a, b = len(v1), len(v1) + len(v2)
    return Grams(
        seq_doc[word],
        np.concatenate([[np.uint64(0)], v1, v2, v3]),
        np.concatenate([[len(word)], c1, c2, c3]).astype(np.int64),
        [1 + i1[word], 1 + i1[word - 1], 1 + a + pair[word - 1], 1 + a + pair[word - 2], 1 + b + i3] if len(word) else [np.zeros(0, np.int64)] * 5,
        [own1[word], own1[word - 1], own2[word - 1], own2[word - 2], _own(seq_doc[word], i3, len(v3))] if len(word) else [np.zeros(0, np.int64)] * 5,
        n,
        1 + b,
    )


def estimates(g: Grams, totals: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(4, words) estimates of order 3, 2, 1 and the floor, with each text's own occurrences deleted; buckets; words there are."""
    c = [np.maximum(totals[p] - o, 0) for p, o in zip(g.place, g.own)]  # word, word before, pair, pair before, triple
    words = int(totals[0])
    rest = np.maximum(words - g.n_words[g.doc], 0)
    ml = np.zeros((4, len(g.doc)))
    np.divide(c[4], c[3], out=ml[0], where=c[3] > 0)
    np.divide(c[2], c[1], out=ml[1], where=c[1] > 0)
    np.divide(c[0], rest, out=ml[2], where=rest > 0)
    ml[3] = 1 / (words + 1)
    bucket = np.minimum(np.frexp(c[3].astype(np.float64))[1] * (c[3] > 0), BUCKETS - 1)
    return ml, bucket, np.array([words])


def em(bucket: np.ndarray, ml: np.ndarray, count: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
    """(BUCKETS, 4) weights that make counted words likeliest, by expectation-maximisation; those of an empty bucket stay equal."""
    lam = np.full((BUCKETS, 4), 0.25)
    for _ in range(rounds):
        part = lam[bucket].T * ml
        part *= count / np.maximum(part.sum(axis=0), 1e-300)
        new = np.stack([np.bincount(bucket, p, BUCKETS) for p in part], axis=1)
        total = new.sum(axis=1, keepdims=True)
        lam = np.where(total > 0, new / np.maximum(total, 1e-300), lam)
    return lam


def floored(lam: np.ndarray, least: float = LEAST_WEIGHT) -> np.ndarray:
    """Weights, each of which is at least ``least``, that still add up to 1."""
    return least + (1 - least * lam.shape[1]) * lam


def _steps(ml: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.where(ml > 0, np.clip(np.rint(-4 * np.log2(ml)), 0, STEPS - 1), STEPS).astype(np.int64)


def _unstep(k: np.ndarray) -> np.ndarray:
    return np.where(k < STEPS, 2.0 ** (-k / 4), 0.0)


def scores(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, log_prob, perplexity) of every row; log_prob is the natural logarithm, the mean over the words."""
    _, chars = X.volume(docs)
    words = max(1, chars // 5)
    bits, owners = min(58, X.bits_for(words)), X.owners_for(docs, 2 * words)
    held = F.pmod(F.xxhash64(F.lit("held out"), docs["doc_id"], docs["text"]), F.lit(HELD_OUT)) == 0
    rows = store.chunked(docs, {"doc_id": docs["doc_id"], "text": F.lower(docs["text"]), "held": held})

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch:
            g = grams(table["text"], bits)
            return X.messages(sender, g.values[: g.third], owners, bits + 2, g.counts[: g.third])

        return X.sender_batches(batches, one)

    short = X.exchange(rows.where("text is not null").mapInArrow(sent, X.MESSAGE), owners, "ngrams")

    def sent_triples(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch:
            g = grams(table["text"], bits)
            total = X.Answers(*short, sender).totals(g.values[: g.third])
            live = np.unique(g.place[4][(total[g.place[2]] > 1) & (total[g.place[3]] > 1)])
            return X.messages(sender, g.values[live] - np.uint64(2 << bits), owners, bits, g.counts[live])

        return X.sender_batches(batches, one)

    long = X.exchange(rows.where("text is not null").mapInArrow(sent_triples, X.MESSAGE), owners, "triples")

    def totals(sender: int, g: Grams) -> np.ndarray:
        return np.concatenate([X.Answers(*short, sender).totals(g.values[: g.third]), X.Answers(*long, sender).totals(g.values[g.third :] - np.uint64(2 << bits))])

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch:
            g = grams(table["text"], bits)
            ml, bucket, n = estimates(g, totals(sender, g))
            k = _steps(ml[:3])
            key = ((bucket * (STEPS + 1) + k[0]) * (STEPS + 1) + k[1]) * (STEPS + 1) + k[2]
            kinds, count = np.unique(key, return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(kinds.astype(np.int64)), pa.array(count.astype(np.int64)), pa.array(np.repeat(n, len(kinds)))], names=["kind", "n", "words"])

        return X.sender_batches(batches, one)

    table = rows.where("held and text is not null").mapInArrow(counted, "kind long, n long, words long").groupBy("kind").agg(F.sum("n").alias("n"), F.max("words").alias("words"))
    got = table.toPandas()
    kind, n = got["kind"].to_numpy(np.int64), got["n"].to_numpy(np.float64)
    s = STEPS + 1
    floor = np.full(len(kind), 1 / (float(got["words"].max()) + 1) if len(got) else 1.0)
    lam = floored(em(kind // s**3, np.stack([_unstep(kind // s**2 % s), _unstep(kind // s % s), _unstep(kind % s), floor]), n))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch:
            g = grams(table["text"], bits)
            ml, bucket, _ = estimates(g, totals(sender, g))
            p = (lam[bucket].T * ml).sum(axis=0)
            log = np.bincount(g.doc, np.log(np.maximum(p, 1e-300)), table.num_rows)
            null = table["text"].is_null().to_numpy()
            none = null | (g.n_words == 0)
            log = log / np.maximum(g.n_words, 1)
            per = np.exp(-log)
            return pa.RecordBatch.from_arrays(
                [table["doc_id"].combine_chunks(), pa.array(g.n_words, mask=null), pa.array(np.round(log, 6), mask=none), pa.array(np.round(per, 6), mask=none)],
                names=["doc_id", "n_words", "log_prob", "perplexity"],
            )

        return X.sender_batches(batches, one)

    return rows.select("doc_id", "text", "_sender").mapInArrow(scored, "doc_id long, n_words long, log_prob double, perplexity double")
