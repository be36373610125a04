"""Connected components of an edge table by alternating large and small stars.

Every round is two joins on node columns and minima that are combined before the shuffle; a hub's
partition is split by adaptive execution. Rounds are written to the shared folder, so a lost
executor costs one round at most. Edges whose stars are already right end after the first test.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import written


def _sum(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def _is_stars(edges: DataFrame) -> bool:
    """Each a has one b, and no b is an a itself."""
    twice = edges.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1").limit(1)
    chained = edges.select("a").join(edges.select(F.col("b").alias("a")), "a", "left_semi").limit(1)
    return twice.isEmpty() and chained.isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (a, b); root is the smallest node of the component.

    Edges with a = b and repeated edges do no harm; an empty table gives no rows.
    """
    now = written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while not _is_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # The minima are written, so that the join sees two shuffles and a hub's partition can be split.
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        large = written(large)
        least = written(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*").where("a <> b").distinct()
        now = written(small)
        after = _sum(now)
        if after == before:
            break
        before = after
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


class UnionFind:
    """Disjoint sets over 0 .. n-1 inside a task; links come as index arrays."""

    def __init__(self, n: int):
        import numpy as np

        self.np, self.parent = np, np.arange(n)

    def roots(self):
        np, p = self.np, self.parent
        while not np.array_equal(q := p[p], p):
            p = q
        self.parent = p
        return p

    def link(self, i, j) -> None:
        np = self.np
        r = self.roots()
        a, b = r[i], r[j]
        apart = a != b
        if not apart.any():
            return
        parent = self.parent = self.parent.copy()
        for x, y in np.unique(np.stack([a[apart], b[apart]], 1), axis=0).tolist():
            while parent[x] != x:
                x = int(parent[x])
            while parent[y] != y:
                y = int(parent[y])
            if x != y:
                parent[max(x, y)] = min(x, y)
