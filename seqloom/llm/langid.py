"""Language ID by a bidirectional gated recurrent network over bytes.

Trained here, in numpy, by backpropagation through time, on a bounded sample of
labelled rows, of whose whole texts windows are drawn. A text is read whole: one
of up to ``SPAN`` bytes in one run of each direction, a longer one in spans that
run side by side. Each direction enters a span with the state that it has after
the ``CONTEXT`` bytes before (behind) it, so no state starts anew at a border.
Every byte gets probabilities of its own from both directions' states, and so a
label; the document's probabilities are the means over its bytes.

Defined results: a null text, or one without bytes, has no language: language
null, probability 0, rejected; so has every text if no row of the table has a
language to learn from. A tie goes to the language of first name. A row is
accepted if its pooled probability reaches ``least``, one half: no other
language, nor all others together, is as likely. accepted() carries the columns
along, whatever their names, and fills in the language found where lang is null.
Null doc_ids are kept, equal rows get equal results, an empty table gives an
empty one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store, textops
from .exact_dedup import packed

HIDDEN = 8
#: Bytes that backpropagation goes through at a time.
WINDOW = 96
#: Rows of the sample that the network is trained on: the bound on what training reads.
TRAIN_ROWS = 480
STEPS = 260
LEAST = 0.5
#: Bytes of a text in one run, and of what goes before.
SPAN = 1024
CONTEXT = 64
LANES = 256


#: The labels of a network that had nothing to learn from.
UNTAUGHT = ("?",)


@dataclass(frozen=True)
class Net:
    """Weights by direction: x (2, 3H, 256) of bytes, with biases; u (2, 3H, H) of states; v (C, 2H), c (C,) of labels."""

    x: np.ndarray
    u: np.ndarray
    v: np.ndarray
    c: np.ndarray
    labels: tuple[str, ...]


def _sigmoid(a: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * a) + 0.5


def start(labels: list[str], seed: int = 0, hidden: int = HIDDEN) -> Net:
    r = np.random.default_rng(seed)
    f = np.float32
    return Net(
        r.normal(0, 0.4, (2, 3 * hidden, 256)).astype(f),
        r.normal(0, 0.4, (2, 3 * hidden, hidden)).astype(f),
        r.normal(0, 0.4, (len(labels), 2 * hidden)).astype(f),
        np.zeros(len(labels), f),
        tuple(labels),
    )


def _states(net: Net, w: np.ndarray, keep: list | None = None, length: np.ndarray | None = None) -> np.ndarray:
    """States (2, T, H, B) of windows w (T, B); [1] runs from the end, that of each lane if lengths are given. keep gets what training needs."""
    steps, lanes = w.shape
    hid = net.u.shape[2]
    out = np.empty((2, steps, hid, lanes), np.float32)
    a = np.empty((3 * hid, lanes), np.float32)
    q = np.empty((3 * hid, lanes), np.float32)
    shortest = steps if length is None else int(length.min())
    for d in (0, 1):
        h = np.zeros((hid, lanes), np.float32)
        for t in range(steps) if d == 0 else range(steps - 1, -1, -1):
            np.take(net.x[d], w[t], axis=1, out=a, mode="clip")
            np.matmul(net.u[d], h, out=q)
            g = a[: 2 * hid]
            g += q[: 2 * hid]
            g *= 0.5
            np.tanh(g, out=g)
            g *= 0.5
            g += 0.5
            z, r, n = a[:hid], a[hid : 2 * hid], a[2 * hid :]
            if keep is not None:
                keep.append((d, t, h, z.copy(), r.copy(), q[2 * hid :].copy()))
            r *= q[2 * hid :]
            n += r
            np.tanh(n, out=n)
            if keep is not None:
                keep[-1] = (*keep[-1], n.copy())
            new = out[d, t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            if d and length is not None and t >= shortest:
                new *= t < length
            h = new
    return out


def probabilities(net: Net, w: np.ndarray, length: np.ndarray | None = None) -> np.ndarray:
    """(T, C, B) of windows (T, B), or of so much of each as lengths tell."""
    s = _states(net, w, None, length)
    hid = s.shape[2]
    o = np.matmul(net.v[:, :hid], s[0])
    o += np.matmul(net.v[:, hid:], s[1])
    o += net.c[:, None]
    o -= o.max(axis=1, keepdims=True)
    np.exp(o, out=o)
    o /= o.sum(axis=1, keepdims=True)
    return o


def _gradients(net: Net, w: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """Loss over all bytes and its gradients by x, u, v, c, through time."""
    steps, lanes = w.shape
    keep: list = []
    s = _states(net, w, keep)
    hid = s.shape[2]
    both = np.concatenate([s[0], s[1]], axis=1)  # T, 2H, B
    o = np.matmul(net.v, both) + net.c[:, None]
    o -= o.max(axis=1, keepdims=True)
    p = np.exp(o)
    p /= p.sum(axis=1, keepdims=True)
    count = mask.sum()
    loss = -float((np.log(p[:, y, np.arange(lanes)] + 1e-9) * mask).sum() / count)
    p[:, y, np.arange(lanes)] -= 1
    p *= mask[:, None, :] / count
    gv, gc = np.einsum("tcb,thb->ch", p, both, optimize=True), p.sum(axis=(0, 2))
    back = np.matmul(net.v.T, p)  # T, 2H, B
    gx, gu = np.zeros_like(net.x), np.zeros_like(net.u)
    carried = [np.zeros((hid, lanes), np.float32), np.zeros((hid, lanes), np.float32)]
    for d, t, h, z, r, qn, n in reversed(keep):
        g = carried[d] + back[t, d * hid : (d + 1) * hid]
        dn = g * (1 - z) * (1 - n * n)
        dz = g * (h - n) * z * (1 - z)
        dr = dn * qn * r * (1 - r)
        inner = np.concatenate([dz, dr, dn])
        outer = np.concatenate([dz, dr, dn * r])
        carried[d] = g * z + net.u[d].T @ outer
        gu[d] += outer @ h.T
        np.add.at(gx[d].T, w[t], inner.T)
    return loss, [gx, gu, gv, gc]


def train(texts: list[bytes], labels: list[str], seed: int = 0, steps: int = STEPS) -> Net:
    """A network for these texts: Adam over mini-batches of windows, the languages in equal parts."""
    names = sorted(set(labels))
    net = start(names or list(UNTAUGHT), seed)
    r = np.random.default_rng(seed)
    rows, ys = [], []
    for text, label in zip(texts, labels):
        b = np.frombuffer(text, np.uint8)
        for at in range(0, len(b), WINDOW):
            part = b[at : at + WINDOW]
            if len(part) == WINDOW or not at:
                rows.append(np.pad(part.astype(np.int64), (0, WINDOW - len(part)), constant_values=-1))
                ys.append(names.index(label))
    if not rows:
        return net
    windows, y = np.array(rows), np.array(ys)
    by = [np.flatnonzero(y == k) for k in range(len(names))]
    par = [net.x.copy(), net.u.copy(), net.v.copy(), net.c.copy()]
    m, v = [np.zeros_like(p) for p in par], [np.zeros_like(p) for p in par]
    for step in range(1, steps + 1):
        pick = np.concatenate([r.choice(k, 32) for k in by])
        w = windows[pick].T
        _, grads = _gradients(Net(*par, net.labels), np.maximum(w, 0), (w >= 0).astype(np.float32), y[pick])
        rate = 0.02 * min(1, 2 * (1 - step / (steps + 1)))
        for i, g in enumerate(grads):
            g = np.clip(g, -1, 1).astype(np.float32)
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.99 * v[i] + 0.01 * g * g
            par[i] -= np.float32(rate) * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-7)
            par[i] = par[i].astype(np.float32)
    return Net(*par, net.labels)


def label_texts(net: Net, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text the pooled probabilities and the share of bytes with each label; rows of zeros where there are no bytes."""
    data, off = textops.buffers(texts)
    n, c = len(off) - 1, len(net.labels)
    size = np.diff(off)
    pooled, shares = np.zeros((n, c)), np.zeros((n, c))
    count = -(-size // SPAN)
    doc = np.repeat(np.arange(n), count)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
    begin = off[doc] + within * SPAN
    end = np.minimum(begin + SPAN, off[doc + 1])
    # a lane is a span with its context on both sides
    low, high = np.maximum(begin - CONTEXT, off[doc]), np.minimum(end + CONTEXT, off[doc + 1])
    order = np.argsort(low - high, kind="stable")  # lanes of one length run together
    step = np.arange(SPAN + 2 * CONTEXT)[:, None]
    for a in range(0, len(order), LANES):
        o = order[a : a + LANES]
        long = int((high[o] - low[o]).max())
        at = low[o] + step[:long]
        # bytes past the end repeat the last one: they and the context count for nothing
        p = probabilities(net, data[np.minimum(at, high[o] - 1)], high[o] - low[o])
        real = (at >= begin[o]) & (at < end[o])
        best = p.argmax(axis=1)
        p *= real[:, None, :]
        sums = p.sum(axis=0)
        for k in range(c):
            np.add.at(pooled[:, k], doc[o], sums[k])
            np.add.at(shares[:, k], doc[o], ((best == k) & real).sum(axis=0))
    some = np.maximum(size, 1)[:, None]
    return pooled / some, shares / some


def fit(docs: DataFrame, seed: int = 0) -> Net:
    """Train on TRAIN_ROWS rows that have a language and some text, chosen by keyed hash."""
    rows = docs.select(docs["text"].alias("text"), docs["lang"].alias("lang"), docs["doc_id"].alias("doc_id"))
    rows = rows.where("lang is not null and length(text) > 0")
    rows = rows.withColumn("h", F.xxhash64(F.lit(seed), "doc_id", "text"))
    # first the hash that ends the sample, then its rows: only they go to the driver
    last = rows.select("h").orderBy("h").limit(TRAIN_ROWS).agg(F.max("h")).first()[0]
    got = rows.where(F.col("h") <= F.lit(last)).orderBy("h", "doc_id").select("text", "lang").limit(TRAIN_ROWS).collect()
    return train([r["text"].encode() for r in got], [r["lang"] for r in got], seed)


def _labelled(docs: DataFrame, net: Net) -> DataFrame:
    labels, untaught = net.labels, net.labels == UNTAUGHT

    @F.arrow_udf("lang string, prob double, share double")
    def label(it: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in it:
            parts = []
            for a in range(0, len(texts), 1024):
                pooled, shares = label_texts(net, texts[a : a + 1024])
                best = pooled.argmax(axis=1)
                at = np.arange(len(best))
                none = (pooled.sum(axis=1) == 0) | untaught
                pooled[none] = shares[none] = 0
                parts.append(
                    pa.StructArray.from_arrays(
                        [
                            pa.array([None if x else labels[b] for b, x in zip(best, none)], pa.string()),
                            pa.array(np.round(pooled[at, best], 6)),
                            pa.array(np.round(shares[at, best], 6)),
                        ],
                        ["lang", "prob", "share"],
                    )
                )
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.struct([("lang", pa.string()), ("prob", pa.float64()), ("share", pa.float64())]))
        store.trim()

    rows = docs.select(*[c.alias(n) for n, c in packed(docs).items()])
    # said to be nondeterministic, so that a filter on the result isn't moved before it, which would read every text twice
    return rows.select("row", "doc_id", label.asNondeterministic()("text").alias("found"))


def identify(docs: DataFrame, net: Net | None = None, least: float = LEAST) -> DataFrame:
    """(doc_id, language, probability, byte_share, accepted) of every row; trains on the rows' own labels unless a network is given."""
    found = _labelled(docs, net or fit(docs))
    return found.select("doc_id", F.col("found.lang").alias("language"), F.col("found.prob").alias("probability"), F.col("found.share").alias("byte_share"), (F.col("found.prob") >= least).alias("accepted"))


def accepted(docs: DataFrame, net: Net | None = None, least: float = LEAST) -> DataFrame:
    """The accepted rows with their columns; a null lang becomes the language found."""
    found = _labelled(docs, net or fit(docs)).where(F.col("found.prob") >= least)
    column = lambda c: F.col(f"row.`{c.replace('`', '``')}`")
    return found.select(*[(F.coalesce(column(c), F.col("found.lang")) if c == "lang" else column(c)).alias(c) for c in docs.columns])
