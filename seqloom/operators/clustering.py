"""Clusters of patterns around medoids, and representatives of clusters.

patterns: (pattern_id, pattern, ord), with ord the rank by (support descending,
pattern), the order that decides all ties.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.functions.similarity import similarity_udf
from seqloom.plans.lineage import cut

LEADER = 0.5


def ordered(patterns: DataFrame) -> DataFrame:
    """(pattern_id, pattern, support, ord) of (pattern, support)."""
    p = patterns.withColumn("key", F.col("pattern").cast("string"))
    p = p.withColumn("ord", F.row_number().over(Window.orderBy(F.desc("support"), "key")).cast("long"))  # mined patterns: few next to the data
    return cut(p.select(F.col("ord").alias("pattern_id"), "pattern", "support", "ord"))


def similarities(patterns: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(p, q, sim) of ordered pairs that have an item in common; all others have 0."""
    other = patterns if others is None else others
    a = patterns.select(F.col("pattern_id").alias("p"), F.col("pattern").alias("pp"), F.explode(F.array_distinct(F.flatten("pattern"))).alias("i"))
    b = other.select(F.col("pattern_id").alias("q"), F.col("pattern").alias("qq"), F.explode(F.array_distinct(F.flatten("pattern"))).alias("i"))
    pairs = a.select("p", "i").join(b.select("q", "i"), "i").select("p", "q").distinct()
    full = pairs.join(a.select("p", "pp").distinct(), "p").join(b.select("q", "qq").distinct(), "q")
    return full.select("p", "q", similarity_udf("pp", "qq").alias("sim"))


def leaders(patterns: DataFrame, sims: DataFrame, threshold: float = LEADER) -> DataFrame:
    """(pattern_id, leader): each leader, the first one free, takes all free ones it is similar to.

    A free pattern that no free earlier one could take leads; all such lead in
    one round, so rounds follow the longest chain of dependence, not the number
    of patterns.
    """
    free = cut(patterns.select("pattern_id"))
    edges = cut(sims.where((F.col("sim") > threshold) & (F.col("p") < F.col("q"))).select("p", "q"))
    done = None
    while not free.isEmpty():
        live = edges.join(free.select(F.col("pattern_id").alias("p")), "p", "left_semi").join(free.select(F.col("pattern_id").alias("q")), "q", "left_semi")
        lead = free.join(live.select(F.col("q").alias("pattern_id")), "pattern_id", "left_anti")
        taken = live.join(lead.select(F.col("pattern_id").alias("p")), "p", "left_semi").groupBy("q").agg(F.min("p").alias("leader"))
        new = cut(lead.select("pattern_id", F.col("pattern_id").alias("leader")).unionByName(taken.select(F.col("q").alias("pattern_id"), "leader")))
        done = new if done is None else done.unionByName(new)
        free = cut(free.join(new.select("pattern_id"), "pattern_id", "left_anti"))
    return done if done is not None else patterns.select("pattern_id", F.col("pattern_id").alias("leader"))


def medoids(clusters: DataFrame, sims: DataFrame) -> DataFrame:
    """(cluster, pattern_id, score) of (cluster, pattern_id): the first member of least mean distance to all members, itself included, however many they are; pairs that sims lacks are at distance 1, and aren't made."""
    a, b = clusters.select("cluster", F.col("pattern_id").alias("p")), clusters.select("cluster", F.col("pattern_id").alias("q"))
    near = sims.where("p <> q").join(a, "p").join(b, ["cluster", "q"]).groupBy("cluster", "p").agg(F.sum("sim").alias("near"))
    size = clusters.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    score = a.join(near, ["cluster", "p"], "left").join(size, "cluster").select("cluster", "p", F.round((F.col("n") - 1 - F.coalesce("near", F.lit(0.0))) / F.col("n"), 10).alias("score"))
    best = score.groupBy("cluster").agg(F.min(F.struct("score", "p")).alias("m"))
    return best.select("cluster", F.col("m.p").alias("pattern_id"), F.col("m.score").alias("score"))


def reassigned(patterns: DataFrame, medoid: DataFrame, sims: DataFrame) -> DataFrame:
    """(cluster, pattern_id): each pattern goes to the most similar medoid, the first of equals; the cluster is named by it."""
    to = F.broadcast(medoid.select(F.col("pattern_id").alias("q")).distinct()) if medoid.count() <= 100_000 else medoid.select(F.col("pattern_id").alias("q")).distinct()
    first = medoid.agg(F.min("pattern_id").alias("q0"))
    best = sims.join(to, "q").groupBy("p").agg(F.max(F.struct("sim", (-F.col("q")).alias("nq"))).alias("m"))
    found = patterns.select(F.col("pattern_id").alias("p")).join(best, "p", "left").crossJoin(F.broadcast(first))
    # no medoid shares an item: all are equally far, at 0, also if those found are below
    own = F.when(F.col("m.sim") > 0, -F.col("m.nq")).otherwise(F.col("q0"))
    return found.select(own.alias("cluster"), F.col("p").alias("pattern_id"))


def clustered(patterns: DataFrame, rounds: int = 2, threshold: float = LEADER) -> tuple[DataFrame, DataFrame]:
    """Clusters (cluster, pattern_id) and medoids after leaders and rounds of reassignment."""
    sims = cut(similarities(patterns))
    now = leaders(patterns, sims, threshold).select(F.col("leader").alias("cluster"), "pattern_id")
    center = cut(medoids(now, sims))
    for _ in range(rounds):
        now = cut(reassigned(patterns, center, sims))
        center = cut(medoids(now, sims))
    return now, center


def fused(freq: DataFrame, clusters: DataFrame, center: DataFrame) -> DataFrame:
    """(feature, part, k) with the rows of a cluster's members added to its medoid's; feature is a pattern_id."""
    to = clusters.join(center.select("cluster", F.col("pattern_id").alias("medoid")), "cluster").select(F.col("pattern_id").alias("feature"), "medoid")
    return freq.join(to, "feature", "left").groupBy(F.coalesce("medoid", "feature").alias("feature"), "part").agg(F.sum("k").alias("k"))


def representatives(patterns: DataFrame, clusters: DataFrame, unit: str = "item", weight: DataFrame | None = None) -> DataFrame:
    """(cluster, pattern_id, score): members whose items (or itemsets) are most common in the cluster, by pattern length; times (pattern_id, weight) if given."""
    m = patterns.join(clusters, "pattern_id")
    parts = F.flatten("pattern") if unit == "item" else F.transform("pattern", lambda s: F.array_join(F.transform(s, lambda x: x.cast("string")), ","))
    rows = m.select("cluster", "pattern_id", "ord", F.size("pattern").alias("len"), F.explode(parts).alias("u"))
    size = m.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))
    held = rows.select("cluster", "pattern_id", "u").distinct().groupBy("cluster", "u").agg(F.count(F.lit(1)).alias("c")).join(size, "cluster").select("cluster", "u", (F.col("c") / F.col("n")).alias("freq"))
    score = rows.join(held, ["cluster", "u"]).groupBy("cluster", "pattern_id", "ord", "len").agg((F.sum("freq") / F.first("len")).alias("score"))
    if weight is not None:
        score = score.join(weight, "pattern_id", "left").withColumn("score", F.col("score") * F.coalesce("weight", F.lit(0.0)))
    score = score.withColumn("score", F.round("score", 10))
    w = Window.partitionBy("cluster").orderBy(F.desc("score"), "ord")
    return score.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("cluster", "pattern_id", "score")


def all_representatives(patterns: DataFrame, clusters: DataFrame, center: DataFrame, growth: DataFrame, coverage: DataFrame) -> DataFrame:
    """(kind, cluster, pattern_id, score) of the seven kinds."""
    out = center.select(F.lit("medoid").alias("kind"), "cluster", "pattern_id", "score")
    for unit in ("itemset", "item"):
        for name, weight in (("", None), ("_growth", growth), ("_coverage", coverage)):
            out = out.unionByName(representatives(patterns, clusters, unit, weight).select(F.lit(unit + name).alias("kind"), "cluster", "pattern_id", "score"))
    return out


def spread(growth: DataFrame, n: int = 19) -> DataFrame:
    """About n rows at even steps of growth, the greatest first."""
    w = Window.orderBy(F.desc("growth"), "pattern_id")
    ranked = growth.withColumn("rn", F.row_number().over(w) - 1).crossJoin(growth.agg(F.greatest(F.lit(1), F.floor(F.count(F.lit(1)) / n)).alias("step")))
    return ranked.where("rn % step = 0").drop("rn", "step")
