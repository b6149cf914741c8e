"""Connected components of a graph of any size, by alternating star contractions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meadowlark.session import durable


class Forest:
    """Union-find over numbers; the smallest member stands for a set."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def find(self, x: int) -> int:
        root = x
        while (above := self.up.get(root, root)) != root:
            root = above
        while (above := self.up.get(x, x)) != root:
            self.up[x], x = root, above
        return root

    def join(self, a: int, b: int) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)


def _contract(batches):
    """A partition's edges as stars: at most one edge for each of its nodes."""
    forest = Forest()
    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            forest.join(a, b)
    nodes = np.array(sorted(forest.up), np.int64)
    roots = np.array([forest.find(x) for x in nodes.tolist()], np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], ["hi", "lo"])


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b); root is the component's smallest node.

    Each round links a node's larger neighbours, then its smaller ones, to its smallest
    neighbour, until every component is a star. Degrees are reduced before they are
    shuffled; the joins back are equi-joins that adaptive execution splits at hot nodes.
    """
    stars = edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).mapInArrow(_contract, "hi long, lo long")
    now = durable(stars.distinct())
    while True:
        both = now.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionAll(now.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        lowest = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(lowest, "hi").where("lo <> m").select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
        new = durable(small.unionAll(lowest.select("hi", F.col("m").alias("lo"))).distinct())
        # a star has a lower end that is nobody's upper end, and one edge per upper end
        open_ends = new.join(new.select(F.col("hi").alias("lo")), "lo", "left_semi").limit(1).count()
        now = new
        if not open_ends and new.count() == new.select("hi").distinct().count():
            break
    return now.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionAll(
        now.select(F.col("lo").alias("node"), F.col("lo").alias("root")).distinct())
