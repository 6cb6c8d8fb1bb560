"""Connected components by alternating large and small stars."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import store


def roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The least place of each place's component, of n places with edges (x, y), in one process."""
    root = np.arange(n)
    while len(x):
        low = np.minimum(root[x], root[y])
        before = root.copy()
        np.minimum.at(root, before[x], low)
        np.minimum.at(root, before[y], low)
        root = root[root]
        if (root == before).all():
            break
    return root


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the least node of the component.

    Rounds grow with the logarithm of a component's size; each is written to
    the shared folder, so lineage doesn't grow. Loops and repeated edges are
    allowed, an empty table gives an empty one.
    """
    spark = edges.sparkSession
    now = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    path = store.written(now, "edges")
    by = Window.partitionBy("u")
    before = None
    while True:
        e = spark.read.schema("u long, v long").parquet(path)
        size = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if size == before or not size[0]:
            break
        before = size
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("m", F.least("u", F.min("v").over(by))).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        m = F.min("v").over(by)
        small = large.withColumn("m", m).select("u", "v", "m")
        after = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).distinct()
        old, path = path, store.written(after, "edges")
        store.drop(spark, old)
    done = spark.read.schema("u long, v long").parquet(path)
    return done.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(done.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
