"""Connected components by alternating star contractions, on DataFrames."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtext.session import pinned

EDGES = "a long, b long"


class Forest:
    """Union-find over integers; roots are the smallest members."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.get(x, x)) != x:
            up[x] = x = up.get(y, y)
        return x

    def link(self, pairs: Iterable[tuple[int, int]]) -> None:
        for a, b in pairs:
            a, b = self.root(a), self.root(b)
            if a != b:
                self.up[max(a, b)] = min(a, b)

    def frame(self) -> pd.DataFrame:
        pairs = [(x, self.root(x)) for x in list(self.up)]
        return pd.DataFrame(np.array([p for p in pairs if p[0] != p[1]], np.int64).reshape(-1, 2), columns=["a", "b"])


def _contract(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Each Arrow batch's edges as stars: fewer edges, same components."""
    for batch in batches:
        forest = Forest()
        forest.link(zip(batch["a"].tolist(), batch["b"].tolist()))
        yield forest.frame()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b); the root is the component's smallest node.

    A round joins every node's larger neighbours to its smallest one, then its smaller ones; rounds grow as the
    logarithm of the largest component. Each is written to the shared folder. Minima are aggregated before the
    shuffle, and a node of many edges is one side of a join that adaptive execution splits.
    """
    now = pinned(edges.select("a", "b").mapInPandas(_contract, EDGES).distinct(), "edges")
    while not _are_stars(now):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = larger.groupBy("a").agg(F.min("b").alias("m"))
        smaller = larger.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
        now = pinned(smaller.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "edges")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _are_stars(edges: DataFrame) -> bool:
    """Whether every node has one edge down, to a node that has none: then that node is its root."""
    down = edges.groupBy("a").count()
    return down.where("count > 1").isEmpty() and edges.select("b").join(down.select(F.col("a").alias("b")), "b", "left_semi").isEmpty()
