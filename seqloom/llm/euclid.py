"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised; for unit vectors a cosine of c is a distance of
sqrt(2 - 2c). In each of several tables a vector's bucket is made of some
random projections, shifted and quantised in steps of ``WIDTH`` distances, the
2-stable family of Datar et al. Vectors that share a bucket in any table are
compared by exact cosine, in blocks of a matrix product. How many projections
follows from the number of vectors, so that unrelated (orthogonal) vectors in
one bucket stay few at any size; how many tables, from the chance of missing a
pair at the very threshold, ``MISS``. A bucket of more than ``BLOCK`` vectors is
spread over pairs of blocks of them, so no task holds more than two blocks. A
pair that shares buckets of several tables counts in the first of them only, as
each vector brings its buckets of the tables before. What leaves a bucket are
edges that connect its similar vectors and numbers of links, never all pairs.

Vectors equal once normalised share all buckets, so one of them stands for all.

Defined results: links() has a row for each row of the table that has a partner;
null, empty and zero vectors, and those with a component that is null or not
finite, have none; vectors of different lengths are compared only with their own
length's; class_id is the least vec_id of the connected group (null if none has
one), n_links the number of other rows found similar; a null vec_id is reported
as null, rows that share a vec_id are reported each. vec_id is an integer; other
columns, whatever their names, are ignored. Components count as floats of 32
bits if the column has such, else of 64.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from .components import components, roots

THRESHOLD = 0.9
WIDTH = 4.0
#: Chance of missing a pair at the threshold.
MISS = 0.01
#: Unrelated vectors that a bucket may hold, on average.
CROWD = 256
SEED = 3
#: Vectors of a bucket that one task compares with each other, or with as many others.
BLOCK = 1024
_FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64())])


def collision(ratio: float) -> float:
    """Chance that one projection, quantised in steps of ``ratio`` distances, puts two vectors together."""
    tail = 0.5 * math.erfc(ratio / math.sqrt(2))
    return 1 - 2 * tail - 2 / (math.sqrt(2 * math.pi) * ratio) * (1 - math.exp(-(ratio**2) / 2))


def plan(n: int, threshold: float = THRESHOLD, width: float = WIDTH, miss: float = MISS) -> tuple[int, int]:
    """(tables, keys) for n vectors."""
    near, far = collision(width), collision(width * math.sqrt(2 - 2 * threshold) / math.sqrt(2))
    keys = max(4, math.ceil(math.log(max(n, CROWD) / CROWD) / -math.log(far))) if threshold < 1 else 4
    return math.ceil(math.log(miss) / math.log(1 - near**keys)), keys


def buckets(x: np.ndarray, tables: int, keys: int, step: float, seed: int) -> np.ndarray:
    """(n, tables) bucket names of unit vectors."""
    r = np.random.default_rng([seed, x.shape[1]])
    a = r.standard_normal((x.shape[1], tables * keys))
    shift = r.uniform(0, step, tables * keys)
    q = np.floor((x @ a + shift) / step).astype(np.int64).astype(np.uint64).reshape(len(x), tables, keys)
    h = np.full((len(x), tables), x.shape[1], np.uint64)
    for k in range(keys):
        h = (h ^ q[:, :, k]) * np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(32)
    h = (h + np.arange(tables, dtype=np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    return (h ^ (h >> np.uint64(29))).view(np.int64)


def _unit(x: pa.Array, d: int) -> np.ndarray:
    m = x.flatten().to_numpy().astype(np.float64).reshape(len(x), d)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def compared(node: np.ndarray, block: np.ndarray, n: np.ndarray, before: np.ndarray, m: np.ndarray, cross: bool, threshold: float) -> tuple[np.ndarray, ...]:
    """Edges (a, b) and numbers of links (node, n) of similar vectors that share no bucket of a table before; cross: only those of different blocks."""
    ok = m @ m.T >= threshold - 1e-12
    x, y = np.nonzero(np.triu(ok, 1))
    if cross:
        x, y = (z[block[x] != block[y]] for z in (x, y))
    if before.shape[1] and len(x):
        new = np.ones(len(x), bool)
        for s in range(0, len(x), 1 << 16):
            new[s : s + (1 << 16)] = (before[x[s : s + (1 << 16)]] != before[y[s : s + (1 << 16)]]).all(axis=1)
        x, y = x[new], y[new]
    root = roots(len(node), x, y)
    tied = np.flatnonzero(root != np.arange(len(node)))
    links = np.bincount(x, n[y], len(node)) + np.bincount(y, n[x], len(node))
    some = np.flatnonzero(links)
    return node[root[tied]], node[tied], node[some], links[some].astype(np.int64)


def links(vectors: DataFrame, threshold: float = THRESHOLD, width: float = WIDTH, miss: float = MISS, seed: int = SEED) -> DataFrame:
    """(vec_id, class_id, n_links) of each row that has a partner; a row that isn't listed is a class of its own."""
    step = width * math.sqrt(2 - 2 * threshold) if threshold < 1 else width * 1e-3
    kind = "float" if dict(vectors.dtypes)["embedding"] == "array<float>" else "double"
    raw = vectors.select(vectors["vec_id"].alias("vec_id"), vectors["embedding"].cast(f"array<{kind}>").alias("v"))
    whole = F.forall("v", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    x = raw.where("v is not null and size(v) > 0").where(whole)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, v: s + v.cast("double") * v))
    x = x.withColumn("norm", norm).where((F.col("norm") > 0) & (F.col("norm") < float("inf")))
    unit = F.transform("v", lambda v: F.round(v / F.col("norm"), 12) + F.lit(0.0))
    rows = x.select("vec_id", "v", *[F.xxhash64(F.lit(k), unit).alias(f"h{k}") for k in (1, 2)])
    # equal vectors: one node that counts for all of them
    same = rows.groupBy("h1", "h2").agg(F.min("vec_id").alias("vec_id"), F.count(F.lit(1)).alias("n"), F.first("v").alias("v"))
    nodes = store.numbered(same, "vectors", "node")
    tables, keys = plan(nodes.count(), threshold, width, miss)

    def hashed(vectors_too: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                lists = batch.column(2)
                size = lists.value_lengths().to_numpy()
                for d in np.unique(size).tolist():
                    at = np.flatnonzero(size == d)
                    part = lists.take(pa.array(at))
                    b = buckets(_unit(part, d), tables, keys, step, seed)
                    if not vectors_too:
                        yield pa.RecordBatch.from_arrays([pa.array(b.ravel())], names=["bucket"])
                        continue
                    node, n = (batch.column(k).to_numpy()[at] for k in (0, 1))
                    low = b.astype(np.int32)
                    for t in range(tables):
                        before = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * t), pa.array(low[:, :t].ravel()))
                        yield pa.RecordBatch.from_arrays([pa.array(b[:, t]), pa.array(node), pa.array(n), before, part], names=["bucket", "node", "n", "before", "v"])

        return f

    source = nodes.select("node", "n", "v")
    crowded = source.mapInArrow(hashed(False), "bucket long").groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    crowded = store.stored(crowded.select("bucket", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")), "crowded")
    keyed = source.mapInArrow(hashed(True), f"bucket long, node long, n long, before array<int>, v array<{kind}>")
    if crowded.isEmpty():
        cells = keyed.select("bucket", F.lit(0).alias("i"), F.lit(0).alias("j"), F.lit(0).alias("b"), "node", "n", "before", "v")
    else:
        pair = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(F.col("b"), k).alias("i"), F.greatest(F.col("b"), k).alias("j")))
        placed = keyed.join(crowded, "bucket", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("b", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        cells = placed.withColumn("cell", F.explode(pair)).select("bucket", "cell.i", "cell.j", "b", "node", "n", "before", "v")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(table: pa.Table) -> pa.RecordBatch:
            key = [table[c].to_numpy() for c in ("bucket", "i", "j")]
            new = np.logical_or.reduce([k[1:] != k[:-1] for k in key])
            cuts = np.concatenate([[0], np.flatnonzero(new) + 1, [len(new) + 1]])
            b, node, n = (table[c].to_numpy() for c in ("b", "node", "n"))
            before, v = (table[c].combine_chunks() for c in ("before", "v"))
            size = v.value_lengths().to_numpy()
            parts: list[list[np.ndarray]] = [[np.zeros(0, np.int64)] for _ in range(4)]
            for s in np.flatnonzero(np.diff(cuts) > 1).tolist():
                x, y = int(cuts[s]), int(cuts[s + 1])
                for d in np.unique(size[x:y]).tolist():
                    at = x + np.flatnonzero(size[x:y] == d)
                    if len(at) > 1:
                        e = before.take(pa.array(at))
                        e = e.flatten().to_numpy().reshape(len(at), -1) if len(e[0]) else np.zeros((len(at), 0), np.int32)
                        got = compared(node[at], b[at], n[at], e, _unit(v.take(pa.array(at)), d), key[1][x] != key[2][x], threshold)
                        for p, z in zip(parts, got):
                            p.append(z)
            a, c, d, e = (np.concatenate(p) for p in parts)
            void = lambda k: pa.nulls(k, pa.int64())
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate([a, d])), pa.concat_arrays([pa.array(c), void(len(d))]), pa.concat_arrays([void(len(a)), pa.array(e)])], schema=_FOUND)

        held: list[pa.Table] = []
        for batch in batches:  # whole cells of a bucket at a time
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            key = [table[c].to_numpy() for c in ("bucket", "i", "j")]
            cut = int(np.argmax(np.logical_and.reduce([k == k[-1] for k in key])))
            if cut or (held and any(held[-1][c][-1].as_py() != k[0] for c, k in zip(("bucket", "i", "j"), key))):
                yield emit(pa.concat_tables([*held, table.slice(0, cut)]))
                held = []
            held.append(table.slice(cut))
        if held:
            yield emit(pa.concat_tables(held))

    ready = cells.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = store.stored(ready.mapInArrow(verify, "a long, b long, n long"), "similar")
    root = components(found.where("b is not null").select("a", "b"))
    count = found.where("n is not null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("more"))
    equal = nodes.where("n > 1").select("node").join(root.select("node"), "node", "left_anti").select("node", F.col("node").alias("root"), F.lit(0).cast("long").alias("more"))
    tied = root.join(count, "node", "left").unionByName(equal)
    named = nodes.select("node", "vec_id", "n", "h1", "h2").join(tied, "node")
    named = named.join(named.groupBy("root").agg(F.min("vec_id").alias("class_id")), "root").select("vec_id", "class_id", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), "n", "h1", "h2")
    named = store.stored(named, "classes")
    many = rows.select(F.col("vec_id").alias("id"), "h1", "h2").join(named.where("n > 1"), ["h1", "h2"])
    return named.where("n = 1").select("vec_id", "class_id", "n_links").unionByName(many.select(F.col("id").alias("vec_id"), "class_id", "n_links"))


def sql(threshold: float = THRESHOLD) -> str:
    return f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, embedding::DOUBLE[] AS x FROM embeddings WHERE len(embedding) > 0),
u AS MATERIALIZED (SELECT r, vec_id, x, sqrt(list_dot_product(x, x)) AS n FROM v WHERE sqrt(list_dot_product(x, x)) > 0),
p AS MATERIALIZED (SELECT a.r AS ra, b.r AS rb FROM u a JOIN u b ON a.r <> b.r AND len(a.x) = len(b.x) AND list_dot_product(a.x, b.x) >= ({threshold} - 1e-12) * a.n * b.n),
c AS (SELECT DISTINCT ra AS r, ra AS root FROM p UNION SELECT p.rb, c.root FROM c JOIN p ON p.ra = c.r),
m AS (SELECT c.r, min(u.vec_id) AS class_id FROM c JOIN u ON u.r = c.root GROUP BY c.r),
l AS (SELECT ra AS r, count(*) AS n_links FROM p GROUP BY ra)
SELECT u.vec_id, class_id, n_links FROM m JOIN l USING (r) JOIN u USING (r)
"""
