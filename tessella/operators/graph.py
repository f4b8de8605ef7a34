"""Links between notes: reverse references, chains, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessella.storage import checkpointed


def used_by(edges: DataFrame, notes: DataFrame) -> DataFrame:
    """(id, user, kind): who refers to a note; a source counts before a link."""
    known = edges.join(notes.select(F.col("id").alias("src")), "src", "left_semi").join(notes.select(F.col("id").alias("dst")), "dst", "left_semi")
    first = Window.partitionBy("dst", "src").orderBy(F.when(F.col("kind") == "source", 0).otherwise(1))
    return known.withColumn("n", F.row_number().over(first)).where("n = 1").select(F.col("dst").alias("id"), F.col("src").alias("user"), "kind")


def components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(node, root) of edges(a, b): root is the smallest node; labels jump along themselves, so long chains close fast."""
    both = edges.select("a", "b").union(edges.select("b", "a")).where("a <> b").distinct()
    label = checkpointed(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("node"), "root"))
    for _ in range(rounds):
        near = both.join(label.toDF("b", "r"), "b").groupBy("a").agg(F.min("r").alias("near"))
        step = label.join(near, F.col("node") == F.col("a"), "left").select("node", F.least("root", F.coalesce("near", "root")).alias("root"))
        new = checkpointed(step.join(step.toDF("x", "up"), F.col("root") == F.col("x"), "left").select("node", F.coalesce("up", "root").alias("root")))
        changed = new.join(label.toDF("node", "was"), "node").where("root <> was").head(1)
        label = new
        if not changed:
            return label
    raise RuntimeError("components did not close")


def chains(notes: DataFrame) -> DataFrame:
    """(root, size) of chains of notes that supersede each other."""
    edges = notes.where("superseded_by is not null").select(F.col("id").alias("a"), F.col("superseded_by").alias("b"))
    return components(edges).groupBy("root").agg(F.count("*").alias("size"))
