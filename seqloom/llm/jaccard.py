"""Exact Jaccard self-join of word n-gram sets, skipping by relations of sets.

Every set orders its n-grams by how many sets hold them, rarest first; sets of
Jaccard similarity t have a common n-gram in their prefixes. How many sets hold
an n-gram comes from an exchange of coded hashes (of fewer bits: a chance
equality there can only make a count too great, which is the same for all sets
and so changes the order, never the answer), and n-grams of one set only, the
bulk, are never indexed. Sets themselves are of 62-bit hashes.

* Index: the list of an n-gram is cut into blocks of entries with one set size,
  in order of position. Size and least position bound the overlap that any pair
  of two blocks can reach, so a pair of blocks that falls short is skipped
  whole, and what lies beyond the position that still reaches it as well.
* Homes: what is left of a list goes to the home of its least set, its leader;
  a set goes to a home once, whatever the lists. So what is shuffled grows with
  the lists' lengths, never with their pairs.
* Answers: the overlaps with the leader are computed first; two other sets'
  overlap follows from how they overlap with the leader and from the few
  n-grams in which they differ from it, for all pairs of a home by products of
  0/1 matrices. A pair that meets at several homes counts at the least only.
  A home of more than ``BLOCK`` sets is spread over pairs of blocks of sets.
  Equal texts are one set, and take its answers as they are.

Defined results: a text of fewer than n words has one n-gram, all its words; a
null text or one without words has none, and no partner. Words are compared in
lower case. links() has a row for each row of the table that has a partner, be
it an equal text or a similar one; rows whose doc_id is null take part and are
reported with a null id, rows that share a doc_id are reported each; class_id is
the least doc_id of the connected group (null if none has one), n_links counts
the other rows of similarity t or more; extra columns are ignored. In dedup() of
each connected group the row of least doc_id stays (null ids last), with all its
columns; rows without partner all stay. doc_id is an integer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import exact_dedup, store
from . import exchange as X
from . import textops as T
from .components import components, roots

N = 3
THRESHOLD = 0.5
#: Sets of a home that one task compares with each other, or with as many others.
BLOCK = 1024
#: Pairs (home, set) that a task holds, to drop repeated ones before they are shuffled.
SEEN = 1 << 20
#: Cells of a 0/1 matrix at a time.
CELLS = 1 << 20

_ENTRY = pa.schema([("gram", pa.int64()), ("node", pa.int64()), ("size", pa.int32()), ("pos", pa.int32())])
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def sets(texts: pa.Array | pa.ChunkedArray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct n-gram hashes of each text, and the bounds between texts."""
    w = T.words(texts)
    size = np.diff(w.bounds)
    ok = T.inside_docs(w.bounds, n)
    h = T.ngrams(w.hash, n)[ok]
    doc = w.doc[: len(ok)][ok]
    short = np.flatnonzero((size > 0) & (size < n))
    if len(short):
        extra = np.array([T.ngrams(w.hash[w.bounds[i] : w.bounds[i + 1]], int(size[i]), int(size[i]))[0] for i in short], np.uint64)
        h, doc = np.concatenate([h, extra]), np.concatenate([doc, short])
    h = h >> np.uint64(2)
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[new], doc[new]
    return h, np.searchsorted(doc, np.arange(len(size) + 1))


def prefix(size: np.ndarray, t: float) -> np.ndarray:
    return size - np.ceil(t * size - 1e-9).astype(np.int64) + 1


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text, rest (the other columns), shared (whether an equal text may exist) and, if so, two hashes of the text."""
    marked = exact_dedup._marked(docs)
    others = [c for c in docs.columns if c != "text"]
    rest = F.struct(*[F.col(f"row.`{c.replace('`', '``')}`").alias(c) for c in others]).alias("rest")
    shared = F.col("twice") & F.col("text").rlike(r"[0-9A-Za-z[^\x00-\x7f]]")
    hashes = [F.when(shared, F.xxhash64(F.lit(k), "text")).alias(f"h{k}") for k in (1, 2)]
    return marked.select("doc_id", "text", rest, shared.alias("shared"), *hashes)


def _nodes(rows: DataFrame) -> DataFrame:
    """A row for each distinct text: node (a number), doc_id, n (rows that have it), h1 and h2 (if it is shared), text, rest (of the row that may stay); written."""
    single = rows.where("not shared").select("doc_id", F.lit(1).cast("long").alias("n"), "h1", "h2", "text", "rest")
    first = F.struct(F.col("doc_id").isNull(), F.col("doc_id"))
    grouped = rows.where("shared").groupBy("text").agg(F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n"), F.first("h1").alias("h1"), F.first("h2").alias("h2"), F.min_by("rest", first).alias("rest"))
    return store.numbered(single.unionByName(grouped.select("doc_id", "n", "h1", "h2", "text", "rest")), "nodes", "node")


def _entries(nodes: DataFrame, n: int, t: float) -> tuple[DataFrame, str]:
    """Prefix entries (gram, node, size, pos) of n-grams that two sets or more hold, and the table they are read with."""
    _, chars = X.volume(nodes)
    # a chance equality only keeps an n-gram in the index that could be left out: 8 bits to spare are enough for counting
    bits, owners = min(62, max(32, (chars // 5).bit_length() + 8)), X.owners_for(nodes, chars // 5)
    cut = np.uint64(62 - bits)
    rows = store.chunked(nodes, {"node": nodes["node"], "text": F.lower(nodes["text"])}).where("text is not null")

    def sent(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch:
            values, counts = np.unique(sets(table["text"], n)[0] >> cut, return_counts=True)
            return X.messages(sender, values, owners, bits, counts)

        return X.sender_batches(batches, one)

    path, shards = X.exchange(rows.mapInArrow(sent, X.MESSAGE), owners, "grams")

    def indexed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one(sender: int, table: pa.Table) -> pa.RecordBatch:
            h, bounds = sets(table["text"], n)
            size = np.diff(bounds)
            doc = np.repeat(np.arange(len(size)), size)
            held = X.Answers(path, shards, sender).totals(h >> cut)
            order = np.lexsort((h, held, doc))
            pos = np.arange(len(h)) - bounds[doc]
            use = (pos < prefix(size, t)[doc]) & (held[order] > 1)
            o = order[use]
            node = table["node"].to_numpy()
            return pa.RecordBatch.from_arrays([pa.array(h[o].astype(np.int64)), pa.array(node[doc[use]]), pa.array(size[doc[use]].astype(np.int32)), pa.array(pos[use].astype(np.int32))], schema=_ENTRY)

        return X.sender_batches(batches, one)

    return rows.mapInArrow(indexed, "gram long, node long, size int, pos int"), path


def reachable(gram: np.ndarray, size: np.ndarray, pos: np.ndarray, t: float) -> np.ndarray:
    """Which entries of lists sorted by (gram, size, pos) can reach the threshold with another of their list."""
    m = len(gram)
    if m < 2:
        return np.zeros(m, bool)
    new = np.ones(m, bool)
    new[1:] = (gram[1:] != gram[:-1]) | (size[1:] != size[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, m))
    g, s, p = gram[start], size[start].astype(np.int64), pos[start].astype(np.int64)  # the least position of a block
    upto = np.full(len(start), -1, np.int64)

    def meet(i: np.ndarray, j: np.ndarray) -> None:
        need = np.ceil(t / (1 + t) * (s[i] + s[j]) - 1e-9).astype(np.int64)
        ok = (s[i] - p[i] >= need) & (s[j] - p[j] >= need)  # else the pair of blocks is skipped
        i, j, need = i[ok], j[ok], need[ok]
        np.maximum.at(upto, i, s[i] - need)
        np.maximum.at(upto, j, s[j] - need)

    many = np.flatnonzero(count > 1)
    meet(many, many)
    live, d = np.arange(len(start)), 1
    while len(live):  # blocks at distance d in their list; a block whose sizes no longer fit is done
        live = live[live + d < len(start)]
        j = live + d
        fits = (g[live] == g[j]) & (s[live] >= t * s[j] - 1e-9)
        live = live[fits]
        meet(live, live + d)
        d += 1
    return pos <= np.repeat(upto, count)


def _homes(entries: DataFrame, t: float) -> DataFrame:
    """(home, node): sets that meet in a list, at the least of them; distinct."""

    def met(gram: np.ndarray, node: np.ndarray, size: np.ndarray, pos: np.ndarray) -> pd.DataFrame:
        use = reachable(gram, size, pos, t)
        gram, node = gram[use], node[use]
        start = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
        least = np.minimum.reduceat(node, start) if len(start) else node
        n = np.diff(np.append(start, len(gram)))
        return pd.DataFrame({"home": np.repeat(least, n), "node": node})[np.repeat(n > 1, n)].drop_duplicates()

    def led(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        emit = lambda parts: pa.RecordBatch.from_pandas(pd.concat(parts).drop_duplicates(), preserve_index=False)
        held, seen, n = None, [], 0
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(4)]
            cols = cols if held is None else [np.concatenate(x) for x in zip(held, cols)]
            cut = int(np.searchsorted(cols[0], cols[0][-1])) if len(cols[0]) else 0
            held = [c[cut:] for c in cols]
            if cut:
                seen.append(met(*(c[:cut] for c in cols)))
                n += len(seen[-1])
            if n > SEEN:  # what many lists hold goes on once
                seen = [pd.concat(seen).drop_duplicates()]
                n = len(seen[0])
                if n > SEEN // 2:
                    yield emit(seen)
                    seen, n = [], 0
        if held is not None and len(held[0]):
            seen.append(met(*held))
        if seen:
            yield emit(seen)
        held, seen = None, []
        store.trim()

    lists = entries.repartition("gram").sortWithinPartitions("gram", "size", "pos")
    return lists.mapInArrow(led, "home long, node long").distinct()


def overlaps(h: np.ndarray, bounds: np.ndarray, leader: int) -> np.ndarray:
    """(m, m) sizes of the common parts of m sets, by their relations to the set ``leader``."""
    m = len(bounds) - 1
    lead = h[bounds[leader] : bounds[leader + 1]]
    row = np.repeat(np.arange(m), np.diff(bounds))
    at = np.minimum(np.searchsorted(lead, h), max(len(lead) - 1, 0))
    own = lead[at] == h if len(lead) else np.zeros(len(h), bool)
    kinds, col, count = np.unique(h[~own], return_inverse=True, return_counts=True)
    more = count > 1  # beyond the leader's, only what two sets hold matters
    number = np.cumsum(more) - 1 + len(lead)
    width = len(lead) + int(more.sum())
    rows = np.concatenate([row[own], row[~own][more[col]]])
    cols = np.concatenate([at[own], number[col[more[col]]]])
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    out = np.zeros((m, m), np.float32)
    step = max(64, CELLS // max(m, 1))
    for a in range(0, width, step):
        lo, hi = np.searchsorted(cols, [a, a + step])
        x = np.zeros((m, min(step, width - a)), np.float32)
        x[rows[lo:hi], cols[lo:hi] - a] = 1
        out += x @ x.T
    return out


def _found(homes: DataFrame, nodes: DataFrame, n: int, t: float) -> DataFrame:
    """Of similar sets: (a, b, null) edges that connect them, and (a, null, n) parts of the number of rows that a is similar to; written."""
    size = homes.groupBy("home").agg(F.count(F.lit(1)).alias("m"))
    blocks = F.ceil(F.col("m") / BLOCK).cast("int")
    b = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("b"), k).alias("i"), F.greatest(F.col("b"), k).alias("j")))
    member = homes.join(size, "home").withColumn("blocks", blocks).withColumn("b", b).select("home", "node", "b", F.explode(cells).alias("cell")).select("node", F.struct("home", "cell.i", "cell.j", "b").alias("at"))
    ids = store.stored(member.groupBy("node").agg(F.collect_list("at").alias("ats")).withColumn("homes", F.array_sort(F.array_distinct(F.col("ats.home")))), "members")
    some = store.picked(nodes, "node", ids.select("node"))
    texts = some.select("node", F.lower("text").alias("text"), F.col("n").alias("rows"))
    rows = texts.join(ids, "node").select(F.explode("ats").alias("at"), "node", "homes", "rows", "text").select("at.home", "at.i", "at.j", "at.b", "node", "homes", "rows", "text")

    def compared(node: np.ndarray, b: np.ndarray, rows: np.ndarray, homes: pa.Array, texts: pa.Array, home: int, i: int, j: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
        h, bounds = sets(texts, n)
        both = overlaps(h, bounds, int(np.argmin(node)))
        s = np.diff(bounds).astype(np.float32)
        ok = both >= t * (s[:, None] + s[None] - both) - 1e-3
        np.fill_diagonal(ok, False)
        x, y = np.nonzero(np.triu(ok))
        o = both[x, y].astype(np.float64)
        use = o / (s[x].astype(np.float64) + s[y] - o) >= t - 1e-12
        if i != j:
            use &= b[x] != b[y]
        x, y = x[use], y[use]
        off, flat = homes.value_lengths().to_numpy(), homes.flatten().to_numpy()
        of = np.repeat(np.arange(len(node)), off)
        less = flat < home
        if less.any():  # pairs that meet at a lesser home count there
            _, c = np.unique(flat[less], return_inverse=True)
            z = np.zeros((len(node), c.max() + 1), np.float32)
            z[of[less], c] = 1
            here = np.array([not (z[p] * z[q]).any() for p, q in zip(x, y)], bool) if len(x) < 512 else (z @ z.T)[x, y] == 0
            x, y = x[here], y[here]
        root = roots(len(node), x, y)
        tied = np.flatnonzero(root != np.arange(len(node)))
        links = np.bincount(x, rows[y], len(node)) + np.bincount(y, rows[x], len(node))
        some = np.flatnonzero(links)
        return [node[root[tied]], node[tied]], [node[some], links[some].astype(np.int64)]

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> pa.RecordBatch:
            home, i, j = (table[c].to_numpy() for c in ("home", "i", "j"))
            cuts = np.append(np.flatnonzero(np.concatenate([[True], (home[1:] != home[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])])), len(home)).tolist()
            a, b, c, d = [], [], [], []
            for x, y in zip(cuts, cuts[1:]):
                if y - x > 1:
                    part = table.slice(x, y - x).combine_chunks()
                    (p, q), (u, v) = compared(part["node"].to_numpy(), part["b"].to_numpy(), part["rows"].to_numpy(), part["homes"].combine_chunks(), part["text"], int(home[x]), int(i[x]), int(j[x]))
                    a.append(p), b.append(q), c.append(u), d.append(v)
            cat = lambda z: np.concatenate([np.zeros(0, np.int64), *z])
            edges, sums = len(cat(a)), len(cat(c))
            void = lambda k: pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([cat(a), cat(c)])), pa.concat_arrays([pa.array(cat(b)), void(sums)]), pa.concat_arrays([void(edges), pa.array(cat(d))])], schema=_FOUND)

        held: list[pa.Table] = []
        for batch in batches:  # whole cells of a home at a time
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            key = [table[c].to_numpy() for c in ("home", "i", "j")]
            same = np.logical_and.reduce([k == k[-1] for k in key])
            cut = int(np.argmax(same))
            if cut or (held and any(held[-1][c][-1].as_py() != k[0] for c, k in zip(("home", "i", "j"), key))):
                yield emit(pa.concat_tables([*held, table.slice(0, cut)]))
                held = []
            held.append(table.slice(cut))
        if held:
            yield emit(pa.concat_tables(held))
        held.clear()
        store.trim()

    ready = rows.repartition("home", "i", "j").sortWithinPartitions("home", "i", "j")
    return store.stored(ready.mapInArrow(verify, "a long, b long, n long"), "similar")


def _similar(nodes: DataFrame, n: int, t: float) -> DataFrame:
    entries, used = _entries(nodes, n, t)
    homes = store.stored(_homes(entries, t), "homes")
    store.drop(nodes.sparkSession, used)
    return _found(homes, nodes, n, t)


def links(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """(doc_id, class_id, n_links) of each row that has a partner; a row that isn't listed is a class of its own."""
    every = _rows(docs)
    nodes = _nodes(every)
    found = _similar(nodes, n, t)
    root = components(found.where("b is not null").select("a", "b"))
    count = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    equal = nodes.where("n > 1").select("node").join(root.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("more"))
    tied = store.stored(root.join(count, "node", "left").unionByName(equal), "tied")
    named = store.picked(nodes, "node", tied.select("node")).select("node", "doc_id", "n", "h1", "h2").join(tied, "node")
    named = named.join(named.groupBy("root").agg(F.min("doc_id").alias("class_id")), "root").select("doc_id", "class_id", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), "n", "h1", "h2")
    named = store.stored(named, "classes")
    # the rows of a shared text find it by its hashes; however many they are, they stay rows
    many = every.where("shared").select(F.col("doc_id").alias("id"), "h1", "h2").join(named.where("n > 1"), ["h1", "h2"])
    return named.where("n = 1").select("doc_id", "class_id", "n_links").unionByName(many.select(F.col("id").alias("doc_id"), "class_id", "n_links"))


def dedup(docs: DataFrame, n: int = N, t: float = THRESHOLD) -> DataFrame:
    """One document of each group of near duplicates, with its columns; a group is what pairs connect."""
    nodes = _nodes(_rows(docs))
    root = components(_similar(nodes, n, t).where("b is not null").select("a", "b"))
    ids = store.picked(nodes, "node", root.select("node")).select("node", "doc_id").join(root, "node")
    stays = ids.groupBy("root").agg(F.min_by("node", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("node"))).alias("node"))
    gone = root.select("node").join(stays.select("node"), "node", "left_anti")
    kept = store.picked(nodes, "node", gone, without=True)
    return kept.select(*[F.col("text") if c == "text" else F.col(f"rest.`{c.replace('`', '``')}`").alias(c) for c in docs.columns])


def sql(n: int = N, t: float = THRESHOLD) -> str:
    separator = T.SEPARATOR
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, row_number() OVER () AS r, list_filter(string_split_regex(lower(text), '{separator}'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
g AS (SELECT DISTINCT r, array_to_string(ws[i:i + {n - 1}], ' ') AS g FROM w, range(1, greatest(len(ws) - {n - 1}, least(len(ws), 1)) + 1) t(i)),
s AS (SELECT r, count(*) AS n FROM g GROUP BY r),
k AS (SELECT a.r AS ra, b.r AS rb, count(*) AS k FROM g a JOIN g b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
p AS MATERIALIZED (SELECT ra, rb FROM k JOIN s x ON x.r = ra JOIN s y ON y.r = rb WHERE k >= {t} * (x.n + y.n - k)),
c AS (SELECT DISTINCT ra AS r, ra AS root FROM p UNION SELECT p.rb, c.root FROM c JOIN p ON p.ra = c.r),
m AS (SELECT c.r, min(w.doc_id) AS class_id FROM c JOIN w ON w.r = c.root GROUP BY c.r),
l AS (SELECT ra AS r, count(*) AS n_links FROM p GROUP BY ra)
SELECT w.doc_id, class_id, n_links FROM m JOIN l USING (r) JOIN w USING (r)
"""
