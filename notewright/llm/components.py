"""Connected components of a table of links, without collecting it: alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm._shared import Scratch


def _lowest(neighbours: DataFrame) -> DataFrame:
    """(u, m) of rows (u, v): the smallest of u and its neighbours."""
    return neighbours.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))


def _unfinished(edges: DataFrame) -> bool:
    """Whether any node points to two others, or points to one and is pointed to: all else are stars about their smallest node."""
    ends = edges.select(F.col("u").alias("id"), F.lit(1).alias("points"), F.lit(0).alias("pointed")).union(edges.select("v", F.lit(0), F.lit(1)))
    node = ends.groupBy("id").agg(F.sum("points").alias("points"), F.max("pointed").alias("pointed"))
    return not node.where("points > 1 or (points > 0 and pointed > 0)").isEmpty()


def components(links: DataFrame, scratch: Scratch | None = None) -> DataFrame:
    """(id, comp) of every id in links (a, b: long): comp is the smallest id that it reaches.

    Each round points every node at the smallest of its neighbourhood, first for its larger neighbours, then for its
    smaller ones.  It ends when only stars are left, which is looked up on the edges themselves; that takes about log(n)
    rounds.  A round's edges are written and the ones before deleted.  The edges of a large star's root meet its smallest
    neighbour in a join of two written tables, so that Spark can broadcast the smaller or split the edges over tasks.
    Null ends are ignored, repetitions and loops do no harm; an id with loops only is its own component; no links give
    no rows.
    """
    scratch = scratch or Scratch(links.sparkSession, "components")
    edges = scratch.write(links.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    alone = edges.where("u = v").select(F.col("u").alias("id"))
    edges = edges.where("u != v")
    written = None
    while (n := edges.count()) and _unfinished(edges):
        both = edges.select("u", "v").union(edges.select("v", "u").toDF("u", "v"))
        low = scratch.write(_lowest(both), "low", 2 * n)
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = _lowest(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = scratch.write(small.where("u != v").distinct(), "edges", 2 * n)
        scratch.drop(low, *([written] if written else []))
        written = edges
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("comp")).union(edges.select("v", "v").distinct())
    if alone.isEmpty():
        return ends
    return ends.union(alone.select("id", F.col("id").alias("comp")).join(ends.select("id"), "id", "left_anti"))
