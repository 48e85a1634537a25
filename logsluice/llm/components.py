"""Connected components of a graph that is too large for one machine, by alternating large and small stars.

Each round replaces links by links to a smaller neighbour until all nodes of a component link to its smallest. Before the
first round every task shrinks its links to a spanning forest. All steps are minima per node and joins on nodes, so a node with very many links is
pre-aggregated, and its join is one that adaptive execution can split. Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsluice.llm.common import written


class Forest:
    """Union-find over the whole numbers below n; a set is named by its smallest member."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True

    def roots(self) -> np.ndarray:
        """The names of all sets, by repeated halving of all paths at once."""
        up = np.array(self.up, dtype=np.int64)
        while len(up) and (up[up] != up).any():
            up = up[up]
        return up


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links (child, smallest of its component) of the components of the links a - b."""
    nodes, index = np.unique(np.concatenate([a, b]), return_inverse=True)
    forest = Forest(len(nodes))
    for x, y in zip(index[: len(a)].tolist(), index[len(a) :].tolist(), strict=True):
        forest.join(x, y)
    root = forest.roots()
    child = np.flatnonzero(root != np.arange(len(nodes)))
    return nodes[child], nodes[root[child]]


def _shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        child, root = spanning(pdf["u"].to_numpy(), pdf["v"].to_numpy())
        yield pd.DataFrame({"u": child, "v": root})


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (its smallest node) for each node that has a link to another. Links with a null end are none."""
    ends = links.select(F.col(a).cast("long").alias("a"), F.col(b).cast("long").alias("b")).where("a <> b")
    edges = written(ends.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).mapInPandas(_shrink, "u long, v long").distinct())
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()
        edges = written(small)
        # A star forest maps to itself: every node once, no centre that is also a leaf.
        now = tuple(edges.agg(F.count("*"), F.coalesce(F.expr("bit_xor(xxhash64(u, v))"), F.lit(0))).first())
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        before = now
