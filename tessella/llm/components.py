"""Connected components of a large edge list, by contraction in rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import written


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges(a, b), both bigint and not null; equal root means the same component.

    root is one of the component's nodes, not the smallest. Nodes are ordered by a bijective 64-bit hash, so that long
    chains whose numbers follow each other still shrink by a constant factor each round. In a round every node takes
    its smallest neighbour as parent, two pointer jumps shorten the trees, and edges are renamed to the parents. A
    neighbour list is never gathered: minima are aggregated before the shuffle, and the renaming joins have one row
    per node on one side, so that adaptive execution can split the other side's hot nodes.
    Self-loops and repeated edges do no harm; no edges give no rows.
    """
    h = lambda c: F.xxhash64(F.col(c))
    work = written(edges.select(h("a").alias("a"), h("b").alias("b")).union(edges.select(h("b"), h("a"))).distinct(), "edges")
    names = written(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().withColumn("h", h("node")), "nodes")
    steps: list[DataFrame] = []
    for _ in range(most_rounds):
        if not work.head(1):
            break
        parent = written(work.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("x"), F.least("a", "m").alias("p")), "parents")
        for _ in range(2):
            up = parent.select(F.col("x").alias("y"), F.col("p").alias("pp"))
            parent = written(parent.join(up, parent.p == up.y).select("x", F.col("pp").alias("p")), "parents")
        steps.append(parent)
        left, right = parent.toDF("xa", "pa"), parent.toDF("xb", "pb")
        half = written(work.join(left, work.a == left.xa).select("pa", "b"), "half")
        work = written(
            half.join(right, half.b == right.xb).where("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(), "edges"
        )
    else:
        raise RuntimeError(f"components did not close in {most_rounds} rounds")
    at = names.select("node", F.col("h").alias("at"))
    for parent in steps:
        at = written(at.join(parent, at["at"] == parent.x, "left").select("node", F.coalesce("p", "at").alias("at")), "roots")
    return at.select("node", F.col("at").alias("root"))


class Forest:
    """Union-find over 0..n-1 in one task, whose memory is 8 bytes a node."""

    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def find(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def union(self, x: int, y: int) -> bool:
        x, y = self.find(x), self.find(y)
        if x == y:
            return False
        self.up[max(x, y)] = min(x, y)
        return True
