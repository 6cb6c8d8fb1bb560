"""Correspondence analysis of a contingency table, and hierarchical clusters of its points.

Parts are few, features may be many: the parts' cross-products are aggregated
in the cluster, only that square matrix is decomposed on the driver, and
features get their coordinates by a join. Axes are turned so that the part of
greatest coordinate, by size, lies on the positive side.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.plans.lineage import cut

from .contingency import log_pmf

#: Parts, whose square is decomposed on the driver.
MOST_PARTS = 4000
#: Terms of a tail that are summed at a time.
TERMS = 4096


def analysis(freq: DataFrame, axes: int = 2) -> dict[str, DataFrame]:
    """eig (axis, eigenvalue, percent), rows and cols (label, axis, coord, contrib) of (feature, part, k)."""
    spark = freq.sparkSession
    cell = cut(freq.groupBy("feature", "part").agg(F.sum("k").cast("double").alias("k")).where("k <> 0"))
    c = cell.groupBy("part").agg(F.sum("k").alias("c")).orderBy("part").limit(MOST_PARTS + 1).toPandas()
    if len(c) > MOST_PARTS:
        raise ValueError(f"more than {MOST_PARTS} parts: group them first")
    names, mass = c["part"].tolist(), c["c"].to_numpy(float)
    n = mass.sum()
    r = cell.groupBy("feature").agg(F.sum("k").alias("r"))
    x = cell.join(r, "feature")
    # S'S of S = D_r^-1/2 (P - rc') D_c^-1/2, whose trivial axis is taken off after
    y = x.select("feature", F.col("part").alias("p"), (F.col("k") / F.sqrt("r")).alias("v"))
    gram = y.join(y.select("feature", F.col("p").alias("q"), F.col("v").alias("u")), "feature").groupBy("p", "q").agg(F.sum(F.col("v") * F.col("u")).alias("g")).toPandas()
    at = {p: i for i, p in enumerate(names)}
    g = np.zeros((len(names), len(names)))
    g[[at[p] for p in gram["p"]], [at[q] for q in gram["q"]]] = gram["g"]
    root = np.sqrt(mass)
    g = g / np.outer(root, root) - np.outer(root, root) / n
    value, vector = np.linalg.eigh((g + g.T) / 2)
    order = np.argsort(-value)[: max(0, len(names) - 1)]
    value, vector = np.maximum(value[order], 0), vector[:, order]
    keep = value > 1e-12
    value, vector = value[keep], vector[:, keep]
    coord = vector * np.sqrt(value) / (root / np.sqrt(n))[:, None]
    sign = np.sign(coord[np.abs(coord).argmax(axis=0), np.arange(coord.shape[1])]) if coord.size else np.ones(0)
    coord, vector = coord * sign, vector * sign
    total = value.sum() or 1.0
    eig = pd.DataFrame({"axis": np.arange(1, len(value) + 1), "eigenvalue": value.round(6), "percent": (100 * value / total).round(4)})
    k = min(axes, len(value))
    cols = pd.DataFrame([(names[i], a + 1, round(float(coord[i, a]), 6), round(float(100 * vector[i, a] ** 2), 6)) for i in range(len(names)) for a in range(k)], columns=["label", "axis", "coord", "contrib"])
    unit = pd.DataFrame([(names[i], a + 1, float(coord[i, a] / np.sqrt(value[a])), float(value[a])) for i in range(len(names)) for a in range(k)], columns=["part", "axis", "u", "lam"])
    point = x.join(F.broadcast(spark.createDataFrame(unit, "part string, axis int, u double, lam double")), "part")
    point = point.groupBy("feature", "axis", "lam", "r").agg((F.sum(F.col("k") * F.col("u")) / F.first("r")).alias("coord"))
    rows = point.select(F.col("feature").alias("label"), "axis", F.round("coord", 6).alias("coord"), F.round(100 * F.col("r") / n * F.col("coord") ** 2 / F.col("lam"), 6).alias("contrib"))
    return {"eig": spark.createDataFrame(eig, "axis int, eigenvalue double, percent double"), "rows": rows, "cols": spark.createDataFrame(cols, "label string, axis int, coord double, contrib double")}


def top_contributions(points: DataFrame, n: int) -> DataFrame:
    """(label, contrib) of the n points of greatest contribution over their axes."""
    return points.groupBy("label").agg(F.round(F.sum("contrib"), 6).alias("contrib")).orderBy(F.desc("contrib"), "label").limit(n)


def merged(points: DataFrame) -> DataFrame:
    """A row a label: coord_1, coord_2 and the contributions, side by side."""
    return points.groupBy("label").agg(*[F.max(F.when(F.col("axis") == a, F.col(c))).alias(f"{c}_{a}") for a in (1, 2) for c in ("coord", "contrib")], F.round(F.sum("contrib"), 6).alias("contrib"))


def ward(x: np.ndarray, weight: np.ndarray) -> list[tuple[int, int, float]]:
    """Merges (a, b, inertia lost) of Ward's tree; merged ones are numbered on."""
    live = {i: (w, p) for i, (w, p) in enumerate(zip(weight, x))}
    out = []
    while len(live) > 1:
        ids = list(live)
        w, p = np.array([live[i][0] for i in ids]), np.array([live[i][1] for i in ids])
        cost = (w[:, None] * w[None] / (w[:, None] + w[None])) * ((p[:, None] - p[None]) ** 2).sum(-1)
        cost[np.tril_indices(len(ids))] = np.inf
        i, j = np.unravel_index(cost.argmin(), cost.shape)
        a, b = ids[i], ids[j]
        out.append((a, b, float(cost[i, j])))
        (wa, pa), (wb, pb) = live.pop(a), live.pop(b)
        live[len(x) + len(out) - 1] = (wa + wb, (wa * pa + wb * pb) / (wa + wb))
    return out


def hierarchical(x: np.ndarray, weight: np.ndarray, k: int | None = None, most: int = 10) -> np.ndarray:
    """Clusters from 1 of weighted points: Ward's tree, cut where the relative loss of inertia is greatest, then consolidated."""
    n = len(x)
    if n < 3:
        return np.ones(n, int)
    tree = ward(x, weight)
    lost = np.array([m[2] for m in tree])
    if k is None:
        within = np.cumsum(lost)
        choices = range(3, min(most, n - 1) + 1)
        k = min(choices, key=lambda q: within[n - 1 - q] / max(within[n - q], 1e-300), default=min(3, n))
    group = {i: [i] for i in range(n)}
    for t, (a, b, _) in enumerate(tree[: n - k]):
        group[n + t] = group.pop(a) + group.pop(b)
    label = np.zeros(n, int)
    for c, members in enumerate(sorted(group.values(), key=min)):
        label[members] = c
    for _ in range(10):
        center = np.array([np.average(x[label == c], axis=0, weights=weight[label == c]) if (label == c).any() else np.full(x.shape[1], np.inf) for c in range(k)])
        new = ((x[:, None] - center[None]) ** 2).sum(-1).argmin(axis=1)
        if (new == label).all():
            break
        label = new
    return label + 1


def clusters_of(points: DataFrame, masses: DataFrame, k: int | None = None) -> DataFrame:
    """(label, cluster) of points (label, axis, coord) with (label, mass); beyond 1000 points, k-means makes centres first."""
    spark = points.sparkSession
    p = points.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("axis", "coord"))).alias("c")).select("label", F.transform("c", lambda s: s["coord"]).alias("c")).join(masses, "label")
    if p.count() <= 1000:
        got = p.orderBy("label").toPandas()
        got["cluster"] = hierarchical(np.array(got["c"].tolist(), float), got["mass"].to_numpy(float), k) if len(got) else []
        return spark.createDataFrame(got[["label", "cluster"]].astype({"cluster": "int64"}), "label string, cluster long")
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    v = p.withColumn("v", array_to_vector("c")).withColumn("w", F.col("mass").cast("double"))
    fit = KMeans(k=300, seed=1, featuresCol="v", weightCol="w", predictionCol="near").fit(v)
    near = fit.transform(v).select("label", "near", "w")
    mass = {r["near"]: r["w"] for r in near.groupBy("near").agg(F.sum("w").alias("w")).collect()}
    centers = np.array(fit.clusterCenters())
    used = sorted(mass)
    label = hierarchical(centers[used], np.array([mass[i] for i in used]), k)
    to = spark.createDataFrame([(int(i), int(c)) for i, c in zip(used, label)], "near int, cluster long")
    return near.join(F.broadcast(to), "near").select("label", "cluster")


def v_test(k: int, f: int, t: int, T: int) -> float:
    """Normal quantile of twice the lesser hypergeometric tail (with half the mass at k), positive above expectation.

    The tail that leads away from the mode is summed from k outwards till terms
    don't count, some standard deviations, however large f and t are; the other
    is what is left of 1.
    """
    mass = float(np.exp(log_pmf(*(np.array([x], float) for x in (k, f, t, T)))[0]))
    up = k >= (f + 1) * (t + 1) // (T + 2)
    far, term, x = mass / 2, mass, k
    end = min(f, t) if up else max(0, f + t - T)
    while x != end and term > far * 1e-17:
        y = np.arange(x, min(end, x + TERMS), dtype=float) if up else np.arange(x, max(end, x - TERMS), -1, dtype=float)
        ratio = (f - y) * (t - y) / ((y + 1) * (T - f - t + y + 1)) if up else y * (T - f - t + y) / ((f - y + 1) * (t - y + 1))
        terms = term * np.cumprod(ratio)
        far, term, x = far + float(terms.sum()), float(terms[-1]), x + len(y) * (1 if up else -1)
    far = min(far, 1.0)
    low, high = (1 - far, far) if up else (far, 1 - far)
    tail = min(max(min(low, high), 1e-300), 0.5)
    return round(float(-NormalDist().inv_cdf(tail) * (1 if high < low else -1)), 6)


def v_tests(freq: DataFrame, clusters: DataFrame, n: int = 5) -> DataFrame:
    """(cluster, variable, v_test): for each cluster of features, the parts most over-represented in it."""
    from pyspark.sql import Window

    own = freq.join(clusters.select(F.col("label").alias("feature"), "cluster"), "feature")
    k = own.groupBy("cluster", "part").agg(F.sum("k").alias("k"))
    t, f = k.groupBy("cluster").agg(F.sum("k").alias("t")), k.groupBy("part").agg(F.sum("k").alias("f"))
    cells = k.join(t, "cluster").join(f, "part").crossJoin(k.agg(F.sum("k").alias("n")))

    @F.pandas_udf("double")
    def score(k: pd.Series, f: pd.Series, t: pd.Series, T: pd.Series) -> pd.Series:
        return pd.Series([v_test(int(a), int(b), int(c), int(d)) for a, b, c, d in zip(k, f, t, T)], dtype=float)

    w = Window.partitionBy("cluster").orderBy(F.desc("v_test"), "variable")
    out = cells.select("cluster", F.col("part").alias("variable"), score("k", "f", "t", "n").alias("v_test")).where("v_test > 0")
    return out.withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")


def typical(points: DataFrame, clusters: DataFrame, n: int = 5) -> DataFrame:
    """(cluster, kind, label, distance): the n points nearest their own centre (para) and those farthest from the others' (dist)."""
    from pyspark.sql import Window

    p = points.join(clusters, "label")
    center = p.groupBy("cluster", "axis").agg(F.avg("coord").alias("m"))
    to = p.join(F.broadcast(center.withColumnRenamed("cluster", "other")), "axis").groupBy("label", "cluster", "other").agg(F.sqrt(F.sum((F.col("coord") - F.col("m")) ** 2)).alias("d"))
    para = to.where("cluster = other").select("cluster", F.lit("para").alias("kind"), "label", F.round("d", 6).alias("distance"))
    dist = to.where("cluster <> other").groupBy("cluster", "label").agg(F.round(F.min("d"), 6).alias("distance")).select("cluster", F.lit("dist").alias("kind"), "label", "distance")
    w = Window.partitionBy("cluster", "kind").orderBy(F.when(F.col("kind") == "para", F.col("distance")).otherwise(-F.col("distance")), "label")
    return para.unionByName(dist).withColumn("rn", F.row_number().over(w)).where(F.col("rn") <= n).drop("rn")
