"""Connected components of a link table, by alternating star contraction.

Every round hangs the neighbours of a node on the least node among them
(large star: the greater neighbours; small star: the smaller ones), until
the links are stars around the least node of each component.  Only counts
come back to the driver; each round is a table in the shared folder.  A
node with very many links is split by Spark's skewed-join handling, as the
minima are a table of their own.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


class Union:
    """Union-find over the numbers 0 to n - 1, the least number as root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.up))], np.int64)


def _mark(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(node, root)`` of every node that stands in a link with another: ``root`` is the least node of its
    component.  Links with a null end or with equal ends say nothing."""
    links = materialize(links.where(F.col(a) != F.col(b))
                        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    mark = _mark(links)
    while mark[0]:
        both = links.union(links.select("v", "u")).toDF("u", "v")
        least = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u")), "least")
        large = materialize(both.where(F.col("v") > F.col("u")).join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
                            .where(F.col("u") != F.col("v")).distinct(), "large-star")
        least = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where(F.col("u") != F.col("v"))
        links = materialize(small.union(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _mark(links)
        if now == mark:
            break
        mark = now
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
