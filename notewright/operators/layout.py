"""Orders and scores that a viewer of clusters and results needs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.numbers import any_timestamp, dotted_key, dotted_parts, natural_key

METRICS = ("az", "size", "search", "history", "similarity", "recency", "momentum")


def recency(notes: DataFrame) -> DataFrame:
    """Latest and mean modification of each cluster in seconds; null without a readable one."""
    t = F.unix_seconds(any_timestamp(F.col("modification_date")))
    return notes.groupBy(F.col("display_topic_id").alias("cluster_id")).agg(F.max(t).alias("spike"), F.round(F.avg(t), 3).alias("momentum"))


def default_cluster(notes: DataFrame) -> DataFrame:
    """The cluster with the latest modification; of equals, the first id."""
    return recency(notes).where("spike is not null").orderBy(F.desc("spike"), *(x for x in (dotted_key(F.col("cluster_id")), F.col("cluster_id")))).limit(1)


def relevance_by_cluster(hits: DataFrame) -> DataFrame:
    """hits: (cluster_id, distance).  1 at the least mean distance possible, 0 at the greatest."""
    ends = hits.agg(F.min("distance").alias("low"), F.max("distance").alias("high"))
    mean = hits.groupBy("cluster_id").agg(F.avg("distance").alias("d"), F.count(F.lit(1)).alias("n_hits"))
    value = 1 - (F.col("d") - F.col("low")) / F.greatest(F.lit(1e-6), F.col("high") - F.col("low"))
    return mean.crossJoin(F.broadcast(ends)).select("cluster_id", "n_hits", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), value)), 4).alias("relevance"))


def positions(notes: DataFrame) -> DataFrame:
    """Mean place of each cluster in the first three dimensions."""
    return notes.where("vector is not null").groupBy(F.col("display_topic_id").alias("cluster_id")).agg(*(F.avg(F.get("vector", F.lit(i)).cast("double")).alias(c) for i, c in enumerate("xyz")))


def nearest_anchor(places: DataFrame, anchors: DataFrame) -> DataFrame:
    """Euclidean distance of each cluster to the nearest of the anchor clusters, which are few: those with hits."""
    a = places.join(anchors.select("cluster_id").distinct(), "cluster_id", "left_semi").select(F.col("cluster_id").alias("anchor"), *(F.col(c).alias(f"a{c}") for c in "xyz"))
    far = F.sqrt(sum((F.col(c) - F.col(f"a{c}")) * (F.col(c) - F.col(f"a{c}")) for c in "xyz"))
    return places.crossJoin(a).groupBy("cluster_id").agg(F.round(F.min(far), 4).alias("distance"))


def legend(notes: DataFrame, hits: DataFrame, selected: list[str]) -> DataFrame:
    """Clusters in the legend's order: the selected first, then by least hit distance, distance to the nearest hit cluster, id."""
    every = notes.select(F.col("display_topic_id").alias("cluster_id")).distinct()
    least = hits.groupBy("cluster_id").agg(F.round(F.min("distance"), 4).alias("hit"))
    near = nearest_anchor(positions(notes), hits)
    out = every.join(least, "cluster_id", "left").join(near, "cluster_id", "left").withColumn("pinned", F.col("cluster_id").isin(selected))
    w = Window.orderBy(F.desc("pinned"), F.asc_nulls_last("hit"), F.asc_nulls_last("distance"), dotted_key(F.col("cluster_id")), "cluster_id")
    return out.withColumn("place", F.row_number().over(w).cast("long")).select("place", "cluster_id", "pinned", "hit", F.col("distance").alias("nearest_hit_cluster"))


def cluster_order(metric: str, ascending: bool = True) -> list[Column]:
    """Sort columns of a cluster list; see sort_clusters."""
    if metric not in METRICS:
        raise ValueError(metric)
    column = {"size": "chunk_count", "search": "first_rank", "history": "history_rank", "similarity": "similarity", "recency": "spike", "momentum": "momentum"}.get(metric)
    keys: list[Column] = [natural_key(F.col("label"))] if column is None else []
    # what was looked at last comes first in ascending history; clusters without a rank are last in either direction
    up = ascending if metric != "history" else not ascending
    if column is not None:
        if metric in ("search", "history"):
            keys.append(F.asc_nulls_last(column) if up else F.desc_nulls_last(column))
        else:
            keys.append(F.asc_nulls_first(column) if up else F.desc_nulls_last(column))
    if metric == "search":
        keys.append(F.asc_nulls_last("nearest") if up else F.desc_nulls_last("nearest"))
    return [*keys, dotted_parts(F.col("cluster_id")), F.col("cluster_id")]


def sort_clusters(clusters: DataFrame, metric: str, ascending: bool = True) -> DataFrame:
    """clusters: cluster_id, and by metric label, chunk_count, first_rank with nearest (distance to the nearest hit cluster), history_rank, similarity, spike or momentum; ties by id."""
    return clusters.orderBy(*cluster_order(metric, ascending))


def places(rows: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Rows with their place in an order, from 1: of lists that a viewer shows, as clusters or results, in one task."""
    return rows.withColumn(name, F.row_number().over(Window.orderBy(*order)).cast("long"))


def sort_results(results: DataFrame, metric: str, ascending: bool = True) -> DataFrame:
    """Results with points (see results_with_points) by place of search, size of the note or modification; ties by title, then place.  Descending turns the ties too."""
    column = {"search": F.col("place"), "size": F.coalesce("note_size", "total_chunks", F.lit(0)), "modified": F.unix_seconds(any_timestamp(F.col("point_modified")))}[metric]
    keys = [column, natural_key(F.col("title"))]
    return results.orderBy(*(k.asc_nulls_first() if ascending else k.desc_nulls_last() for k in keys), "place")


def tree_order(metric: str) -> list[Column]:
    """Sort columns of the clusters below a meta cluster: by size the largest first, else by id."""
    ids = [dotted_parts(F.col("cluster_id")), F.col("cluster_id")]
    return [F.desc("chunk_count"), *ids] if metric == "size" else ids


def sort_tree(meta: DataFrame, metric: str = "size", distances: DataFrame | None = None) -> DataFrame:
    """Rows of the meta hierarchy with meta_place and child_place: meta clusters by distance (meta_cluster_id, avg_distance) where given, then label; their clusters by tree_order."""
    label = natural_key(F.col("meta_cluster_label"))
    tops = meta.select("meta_cluster_id", "meta_cluster_label").distinct()
    tops = tops.withColumn("avg_distance", F.lit(None).cast("double")) if distances is None else tops.join(distances.select("meta_cluster_id", "avg_distance"), "meta_cluster_id", "left")
    tops = places(tops, [F.asc_nulls_last("avg_distance"), label, F.col("meta_cluster_id")], "meta_place")
    child = F.row_number().over(Window.partitionBy("meta_cluster_id").orderBy(*tree_order(metric))).cast("long")
    return meta.withColumn("child_place", child).join(F.broadcast(tops.select("meta_cluster_id", "meta_place")), "meta_cluster_id")


def first_ranks(ranked: DataFrame, by: str) -> DataFrame:
    """First place of each value in ranked results (place)."""
    return ranked.groupBy(by).agg(F.min("place").alias("first_rank"))


def similarity_rings(similar: DataFrame, least: float = 0.15, most: int = 30, ring: int = 12) -> DataFrame:
    """Nodes of a radial view: the most similar, twelve to a ring, with their angle in degrees."""
    w = Window.orderBy(F.desc("similarity"), "cluster_id")
    top = similar.where(F.col("similarity") >= least).orderBy(F.desc("similarity"), "cluster_id").limit(most).withColumn("n", F.row_number().over(w) - 1)
    return top.select("cluster_id", "similarity", F.floor(F.col("n") / ring).alias("ring"), (F.pmod("n", F.lit(ring)) * (360.0 / ring)).alias("angle"))


#: The viewer's sizes in pixels, which place the nodes.
CENTRE, LARGEST, ORBIT = 56, 36, 200


def search_rings(clusters: DataFrame) -> DataFrame:
    """(cluster_id, x, y, angle) of clusters with hits (cluster_id, avg_distance): nearer ones further in, twelve to a ring, each ring a little turned."""
    w = Window.orderBy("avg_distance", "cluster_id")
    ends = clusters.agg(F.min("avg_distance").alias("_low"), F.max("avg_distance").alias("_high"), F.count(F.lit(1)).alias("_n"))
    out = clusters.withColumn("_i", F.row_number().over(w) - 1).crossJoin(F.broadcast(ends))
    inner = CENTRE + LARGEST * 0.8 + 4
    width = F.col("_high") - F.col("_low")
    radius = inner + (ORBIT - inner) * (F.col("avg_distance") - F.col("_low")) / F.when(width == 0, 1e-6).otherwise(width)
    step = 2 * F.pi() / F.least(F.col("_n") - F.col("_i"), F.lit(12))
    angle = -F.pi() / 2 + F.floor(F.col("_i") / 12) * 0.15 + F.pmod("_i", F.lit(12)) * step
    return out.select("cluster_id", (radius * F.cos(angle)).alias("x"), (radius * F.sin(angle)).alias("y"), angle.alias("angle"))


def results_with_points(results: DataFrame, points: DataFrame) -> DataFrame:
    """Search results with their chunk's modification and the size of its note; of points with one key the first counts."""
    first = points.groupBy("unique_key").agg(F.min_by("modification_date", "doc_id").alias("point_modified"), F.min_by("total_chunks", "doc_id").alias("note_size"))
    return results.join(first, "unique_key", "left")


def with_last_interaction(notes: DataFrame, interactions: DataFrame) -> DataFrame:
    """Notes with the latest interaction of their title, in the order of that or else of their modification."""
    last = interactions.groupBy("title").agg(F.max("last_opened").alias("last_opened"))
    each = notes.groupBy("title", "creation_date", "modification_date").agg(F.count(F.lit(1)).alias("n_chunks"))
    out = each.join(last, "title", "left").withColumn("order_date", F.coalesce(F.substring("last_opened", 1, 10), "modification_date"))
    return out.orderBy(F.desc("order_date"), "title", "creation_date")


def selection_centre(places: DataFrame, clusters: list[str]) -> DataFrame:
    """Unweighted mean place of the selected clusters."""
    return places.where(F.col("cluster_id").isin(clusters)).agg(*(F.round(F.avg(c), 4).alias(c) for c in "xyz"), F.count(F.lit(1)).alias("n"))


def display_groups(notes: DataFrame) -> DataFrame:
    """One row for each cluster with its chunks in order: what a plot draws."""
    point = F.struct("doc_id", "unique_key", "title")
    return notes.groupBy(F.col("display_topic_id").alias("cluster_id")).agg(F.array_sort(F.collect_list(point)).alias("points"))


def tree_totals(meta: DataFrame) -> DataFrame:
    """Clusters and chunks over the flat meta hierarchy."""
    return meta.agg(F.count_distinct("meta_cluster_id").alias("metas"), F.count(F.lit(1)).alias("clusters"), F.sum("chunk_count").alias("chunks"))


def tree_filter(meta: DataFrame, text: str) -> DataFrame:
    """Clusters whose id or label has the text, in any case; meta clusters without one vanish with their rows."""
    t = text.lower()
    return meta.where(F.lower("cluster_id").contains(t) | F.lower("label").contains(t))


def notes_across(notes: DataFrame, clusters: list[str]) -> DataFrame:
    """Titles with chunks in any of the clusters, each once: in the first of the clusters, as listed, that has it."""
    place = F.array_position(F.array(*(F.lit(c) for c in clusters)), F.col("display_topic_id"))
    found = notes.where(F.col("display_topic_id").isin(clusters)).groupBy("title").agg(F.min_by(F.struct("display_topic_id", "doc_id"), F.struct(place.alias("p"), "doc_id")).alias("f"))
    return found.select("title", F.col("f.display_topic_id").alias("cluster_id"), F.col("f.doc_id").alias("doc_id"))
