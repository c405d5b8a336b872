"""Connected components, of a batch in memory and of a distributed table of links."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, saved


def local_components(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """The smallest node that each of the nodes 0 .. n - 1 reaches by the links (u, v)."""
    root = np.arange(n)
    while len(u):
        a, b = root[u], root[v]
        differ = a != b
        if not differ.any():
            break
        u, v, a, b = u[differ], v[differ], a[differ], b[differ]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root = up
    return root


def components(links: DataFrame, most: int = 60) -> DataFrame:
    """(node, root): the smallest node reachable by the links (a, b), for every node of a link between two nodes.

    Large-star and small-star rounds: neighbours are pointed at the smallest neighbour until links are stars. Each
    round is a partial aggregate and a join on its unique result (a hub's links are split by AQE's skew join) and is
    written to the shared folder. Links of a node to itself give no row."""
    now = saved(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "links", "none")

    def mark(df):
        return df.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()

    before = mark(now)
    for _ in range(most):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = saved(large.where("a <> b").distinct(), "links", "none")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        small = saved(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links", "none")
        forget(now, large)
        now, after = small, mark(small)
        if after == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        before = after
    raise RuntimeError(f"components did not settle in {most} rounds")
