"""Connected components of a table of links, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def components(links: DataFrame, s: common.Scratch) -> DataFrame:
    """(node, comp) for every node of links (a, b): comp is the smallest node that can be reached.

    A round links every node's larger neighbours, then its smaller ones and itself, to the least node around it. Both keep what is
    connected, and the rounds go on until each component is a star around its least node, however many that takes: some 12 for a
    path of 3,000 nodes and 16 for one of 20,000. A round's tables are deleted once the next but one begins, the labels
    belong to ``s``; nothing but a count reaches the driver.
    """
    rounds = [common.Scratch(links.sparkSession, "links") for _ in range(2)]
    edges = rounds[1].written(links.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    turn = 0
    while _open(edges):
        here = rounds[turn % 2]
        here.free()
        both = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        least = both.groupBy("node").agg(F.least("node", F.min("other")).alias("least"))
        large = here.written(edges.join(least.withColumnRenamed("node", "a"), "a").select(F.col("least").alias("a"), "b").distinct())
        low = large.groupBy("b").agg(F.min("a").alias("least"))
        small = large.join(low, "b").select("least", F.explode(F.array("a", "b")).alias("b")).where("least <> b")
        edges = here.written(small.select(F.col("least").alias("a"), "b").distinct())
        turn += 1
    labels = edges.select(F.col("b").alias("node"), F.col("a").alias("comp")).union(edges.select("a", "a"))
    alone = links.where("a = b").select("a", "b")
    out = s.written(labels.union(alone).groupBy("node").agg(F.min("comp").alias("comp")))
    for scratch in rounds:
        scratch.free()
    return out


def _open(edges: DataFrame) -> bool:
    """Whether some node has two smaller neighbours, or a smaller one and a larger one: then the links (a < b) aren't stars yet."""
    ends = edges.select(F.col("b").alias("node"), F.lit(1).alias("below"), F.lit(0).alias("above")).union(edges.select("a", F.lit(0), F.lit(1)))
    return bool(ends.groupBy("node").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below + above > 1 and below > 0").limit(1).count())
