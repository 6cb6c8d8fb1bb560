"""Contingency tables in long form (feature, part, k), and scores of over-representation."""

from __future__ import annotations

from collections.abc import Iterator
from math import lgamma

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def rollup(freq: DataFrame, metadata: DataFrame, key: str, by: str) -> DataFrame:
    """(feature, part, k) by a column of the metadata; texts that it lacks are left out."""
    meta = metadata.select(F.col(key).alias("part"), F.col(by).cast("string").alias("_by"))
    return freq.join(meta, "part").where("_by is not null").groupBy("feature", F.col("_by").alias("part")).agg(F.sum("k").alias("k"))


def totals(freq: DataFrame) -> DataFrame:
    return freq.groupBy("feature").agg(F.sum("k").alias("total")).where("total <> 0")


def wide(freq: DataFrame, parts: list[str]) -> DataFrame:
    """A column a part, 0 where there is none; rows of zeros are left out."""
    out = freq.groupBy("feature").pivot("part", parts).agg(F.sum("k")).na.fill(0)
    return out.where(" + ".join(f"`{p}`" for p in parts) + " <> 0")


#: The feature that stands for whole parts.
OTHERS = "others"


def kftt(freq: DataFrame, sizes: DataFrame | None = None, others: bool = False) -> DataFrame:
    """(feature, part, k, f, t, n) of every feature and part, also where k is 0; sizes (part, t) of the whole parts, if they aren't those of the table itself; others: with a feature that is all of each part."""
    t = sizes if sizes is not None else freq.groupBy("part").agg(F.sum("k").alias("t"))
    t = t.crossJoin(t.agg(F.sum("t").alias("n")))
    f = freq.groupBy("feature").agg(F.sum("k").alias("f"))
    cells = f.crossJoin(F.broadcast(t)).join(freq.groupBy("feature", "part").agg(F.sum("k").alias("k")), ["feature", "part"], "left")
    cells = cells.select("feature", "part", F.coalesce("k", F.lit(0)).cast("long").alias("k"), F.col("f").cast("long").alias("f"), F.col("t").cast("long").alias("t"), F.col("n").cast("long").alias("n"))
    if others:
        long = lambda c: F.col(c).cast("long")
        cells = cells.unionByName(t.select(F.lit(OTHERS).alias("feature"), "part", long("t").alias("k"), long("n").alias("f"), long("t").alias("t"), long("n").alias("n")))
    return cells


_lg = np.vectorize(lgamma, otypes=[float])


def log_pmf(k: np.ndarray, f: np.ndarray, t: np.ndarray, T: np.ndarray) -> np.ndarray:
    c = lambda n, r: _lg(n + 1.0) - _lg(r + 1.0) - _lg(n - r + 1.0)
    return c(f, k) + c(T - f, t - k) - c(T, t)


def specificity(k: np.ndarray, f: np.ndarray, t: np.ndarray, T: np.ndarray) -> np.ndarray:
    """+|log10 P(X >= k)| from the mode up, else log10 P(X <= k), of the hypergeometric law; tails are summed from k outwards."""
    k, f, t, T = (np.asarray(x, np.float64) for x in (k, f, t, T))
    if not len(k):
        return np.zeros(0)
    up = k >= np.floor((f + 1) * (t + 1) / (T + 2))
    base = log_pmf(k, f, t, T)
    total, term, x = np.ones(len(k)), np.ones(len(k)), k.copy()
    live = np.ones(len(k), bool)
    while live.any():
        i = np.flatnonzero(live)
        y, g, s, n = x[i], f[i], t[i], T[i]
        rise = (g - y) * (s - y) / ((y + 1) * np.maximum(n - g - s + y + 1, 1e-300))
        fall = y * (n - g - s + y) / np.maximum((g - y + 1) * (s - y + 1), 1e-300)
        term[i] *= np.where(up[i], rise, fall)
        total[i] += term[i]
        x[i] += np.where(up[i], 1, -1)
        live[i] = (term[i] > total[i] * 1e-17) & (x[i] >= 0) & (x[i] <= np.minimum(g, s))
    log10 = np.minimum((base + np.log(total)) / np.log(10), 0)
    return np.round(np.where(up, -log10, log10), 4) + 0.0


def specificities(cells: DataFrame) -> DataFrame:
    """cells of kftt() with ``score``."""

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(score=specificity(*(b[c].to_numpy() for c in ("k", "f", "t", "n"))))

    return cells.mapInPandas(scored, StructType([*cells.schema.fields, StructField("score", DoubleType())]))


def salient(scores: DataFrame, threshold: float) -> DataFrame:
    """(feature, top) of features that exceed the threshold in any part."""
    return scores.groupBy("feature").agg(F.max("score").alias("top")).where(F.col("top") > threshold)
