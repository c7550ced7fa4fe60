"""Connected components: within one block by numpy, over a table by star contraction."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def block_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and undirected links, each node's smallest reachable node."""
    root = np.arange(n)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        np.minimum.at(root, root[left], low)
        np.minimum.at(root, root[right], low)
        root = root[root]
        while (again := root[root]).tolist() != root.tolist():
            root = again
        if (root == before).all():
            break
    return root


def _mark(edges: DataFrame) -> tuple:
    """A count and a digest that change when the links do."""
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges(u, v)``; root is the smallest node reachable.

    Alternates the two star steps until the links stop changing, which takes a
    number of rounds logarithmic in practice; each step ends in the checkpoint
    folder, and no link reaches the driver. Minima are taken before the shuffle,
    and the links of hubs aren't shuffled to meet them. Links with a null end or to
    oneself are ignored.
    """
    def least_of(links: DataFrame, count: int) -> tuple[DataFrame, DataFrame]:
        """Each u's least neighbour: of hubs, a thousand at most since each has a thousandth of the links, and of all others."""
        least = links.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"), F.count("*").alias("n"))
        hub = F.col("n") * 1_000 > count
        return least.where(hub).select("u", "m"), least.where(~hub).select("u", "m")

    def with_least(links: DataFrame, count: int) -> DataFrame:
        """``links`` with m; a hub's links stay where they are, its least neighbour is sent to them."""
        hubs, others = least_of(links, count)
        marked = links.join(F.broadcast(hubs.withColumnRenamed("m", "hub")), "u", "left")
        near = marked.where("hub is not null").withColumnRenamed("hub", "m")
        return near.unionByName(marked.where("hub is null").drop("hub").join(others, "u"))

    edges = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"), (F.col("u") != F.col("v")).alias("ok"))
    edges = cut(edges.where("ok").select("u", "v").distinct())
    mark = _mark(edges)
    while mark[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_least(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = cut(large.unionByName(edges.groupBy("u").agg(F.min("v").alias("v"))).where("u != v").distinct())
        small = with_least(large, large.count()).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = cut(small.where("u != v").distinct())
        new = _mark(edges)
        if new == mark:
            break
        mark = new
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    return roots.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
