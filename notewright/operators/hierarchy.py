"""Statistics over dotted cluster ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.functions.numbers import cluster_id_order, dotted_prefix, percent

DEPTH = 7


def base_stats(notes: DataFrame) -> DataFrame:
    """Chunks and share of each base cluster, by number, outliers last."""
    n = notes.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n_chunks"), F.min_by("cluster_label", "doc_id").alias("label"))
    total = notes.agg(F.count(F.lit(1)).alias("total"))
    return n.crossJoin(F.broadcast(total)).select("cluster_id", "label", "n_chunks", percent(F.col("n_chunks"), F.col("total")).alias("percent")).orderBy(*cluster_id_order(F.col("cluster_id")))


def nested_counts(ids: DataFrame, column: str = "display_topic_id") -> DataFrame:
    """(id, n, inferred, depth): rows of each id of two or more parts, and the missing ids between them.

    An inferred id counts the sum of its direct children, the deepest first; an actual id keeps its own rows.
    """
    parts = F.size(F.split("id", r"\.")).cast("long")
    actual = ids.select(F.col(column).alias("id")).where(F.col("id").contains(".")).groupBy("id").agg(F.count(F.lit(1)).alias("n")).withColumn("depth", parts)
    prefix = F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.col("depth").cast("int") - 1))).alias("k")
    between = actual.where("depth > 2").select("id", prefix).select(dotted_prefix(F.col("id"), F.col("k")).alias("id")).distinct().join(actual.select("id"), "id", "left_anti").withColumn("depth", parts)
    known = actual.withColumn("inferred", F.lit(False))
    for depth in range(DEPTH - 1, 1, -1):
        level = between.where(F.col("depth") == depth).select("id")
        children = known.where(F.col("depth") == depth + 1).groupBy(dotted_prefix(F.col("id"), depth).alias("id")).agg(F.sum("n").alias("n"))
        known = known.unionByName(level.join(children, "id").select("id", "n", F.lit(depth).cast("long").alias("depth"), F.lit(True).alias("inferred")))
    return known.select("id", "n", "inferred", "depth")


def tree(notes: DataFrame) -> DataFrame:
    """(id, parent_id, n, percent of all chunks, percent of the parent) over base and nested ids."""
    base = notes.groupBy(F.col("cluster_id").alias("id")).agg(F.count(F.lit(1)).alias("n"))
    nested = nested_counts(notes).select("id", "n")
    every = base.unionByName(nested.join(base.select("id"), "id", "left_anti"))
    every = every.withColumn("parent_id", F.when(F.col("id").contains("."), dotted_prefix(F.col("id"), F.size(F.split("id", r"\.")) - 1)))
    total = notes.agg(F.count(F.lit(1)).alias("total"))
    up = every.select(F.col("id").alias("parent_id"), F.col("n").alias("up"))
    out = every.join(up, "parent_id", "left").crossJoin(F.broadcast(total))
    return out.select("id", "parent_id", "n", percent(F.col("n"), F.col("total")).alias("percent"), F.when(F.col("up").isNotNull(), percent(F.col("n"), F.col("up"))).alias("percent_of_parent"))
