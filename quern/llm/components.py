"""Connected components by alternating large and small stars over DataFrames.

No neighbourhood is ever gathered: each star is a minimum by node (partly aggregated before the
shuffle) joined back to the edges, so a node of very many edges costs no single task's memory, and
adaptive execution may split its join. Each round is stored in the shared folder.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import cut_lineage


class Joined:
    """Groups of 0 … size - 1 within one task, by union-find."""

    def __init__(self, size: int) -> None:
        self.parent = np.arange(size)

    def find(self, at: np.ndarray) -> np.ndarray:
        """The roots of the places ``at``, whose paths are shortened."""
        root = self.parent[at]
        while True:
            up = self.parent[root]
            if (up == root).all():
                self.parent[at] = root
                return root
            root = up

    def join(self, at: np.ndarray) -> None:
        """All places ``at`` become one group."""
        met = np.unique(self.find(at))
        self.parent[met] = met[0]

    def pairs(self, x: np.ndarray, y: np.ndarray) -> None:
        """Each place of x becomes one group with that of y: roots take the least root that they meet."""
        while True:
            u, v = self.find(x), self.find(y)
            apart = u != v
            if not apart.any():
                return
            x, y, u, v = x[apart], y[apart], u[apart], v[apart]
            np.minimum.at(self.parent, np.maximum(u, v), np.minimum(u, v))

    def roots(self) -> np.ndarray:
        return self.find(np.arange(len(self.parent)))


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component): for edges (u, v) of longs, each node that has an edge to another one, with
    the smallest node that it reaches. No edges: no rows."""
    now = cut_lineage(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = _state(now)
    while before[0]:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v"))
        now = cut_lineage(small.where("u <> v").distinct())
        after = _state(now)
        if after == before:
            break
        before = after
    return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
