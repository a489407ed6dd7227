"""Connected components of an edge table, in rounds of joins and groupings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import join_hubs, written


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node reachable) for every node of ``edges(a, b)``.

    Large-star and small-star rounds.  A star is a grouped minimum that is joined back, so
    no node's neighbours are ever gathered in one place, and hubs are joined where their
    edges are; edges only move to smaller nodes, and the rounds end when none has moved.
    Every round is a table in the checkpoint folder.
    """
    both = edges.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct()
    current = written(both)
    while not _stars(current):
        # Large star: a node's larger neighbours move to its smallest neighbour.
        twice = written(current.select(F.col("lo").alias("v"), F.col("hi").alias("u")).unionByName(current.select(F.col("hi").alias("v"), F.col("lo").alias("u"))))
        least = written(twice.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("m"), F.count("*").alias("many")))
        large = written(join_hubs(twice.where("u > v"), least, "v", "many").select(F.col("m").alias("lo"), F.col("u").alias("hi")).where("lo < hi"))
        # Small star: a node and its smaller neighbours move to the smallest of them.
        first = written(large.groupBy("hi").agg(F.min("lo").alias("m"), F.count("*").alias("many")))
        small = join_hubs(large, first, "hi", "many").select(F.explode(F.array(F.struct(F.col("m").alias("lo"), F.col("hi").alias("hi")), F.struct(F.col("m").alias("lo"), F.col("lo").alias("hi")))).alias("e"))
        current = written(small.select("e.*").where("lo < hi").distinct())
    return written(current.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(current.select("lo").distinct().select(F.col("lo").alias("node"), F.col("lo").alias("root"))))


def _stars(edges: DataFrame) -> bool:
    """Whether every node is either a root or has one edge, to a root."""
    ends = edges.select(F.col("hi").alias("v"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("lo").alias("v"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    counts = ends.groupBy("v").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return not counts.where("up > 1 OR (up = 1 AND down = 1)").take(1)
