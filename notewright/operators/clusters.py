"""Clusters: centroids, similarities, colours, the meta hierarchy, sidebars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.numbers import clip01, cluster_color, cosine
from notewright.operators.notes import NOTE, with_note_key


def centroid_values(notes: DataFrame, by: str = "display_topic_id", vector: str = "vector") -> DataFrame:
    """(cluster_id, dim, value): element-wise means; each task sums before the shuffle."""
    each = notes.where(F.col(vector).isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("cluster_id"), F.posexplode(vector).alias("dim", "v"))
    return each.groupBy("cluster_id", "dim").agg(F.avg(F.col("v").cast("double")).alias("value")).select("cluster_id", F.col("dim").cast("long").alias("dim"), "value")


def centroids(notes: DataFrame, by: str = "display_topic_id") -> DataFrame:
    """(cluster_id, centroid)."""
    pair = F.array_sort(F.collect_list(F.struct("dim", "value")))
    return centroid_values(notes, by).groupBy("cluster_id").agg(F.transform(pair, lambda x: x["value"]).alias("centroid"))


def cluster_facts(notes: DataFrame, by: str = "display_topic_id") -> DataFrame:
    """Chunk count, and label and meta cluster of the first chunk."""
    return notes.groupBy(F.col(by).alias("cluster_id")).agg(
        F.count(F.lit(1)).alias("chunk_count"), F.min_by("cluster_label", "doc_id").alias("label"), F.min_by("meta_cluster_id", "doc_id").alias("meta_cluster_id"),
        F.min_by("meta_cluster_label", "doc_id").alias("meta_label"), F.max(F.nullif(F.substring(F.trim("modification_date"), 1, 10), F.lit(""))).alias("last_modified"), F.min("doc_id").alias("first_doc_id"),
    )


def first_labels(notes: DataFrame, by: str = "display_topic_id") -> DataFrame:
    """The first label that is not empty of each cluster; null without one."""
    some = F.when(F.col("cluster_label") != "", F.col("doc_id"))
    return notes.groupBy(F.col(by).alias("cluster_id")).agg(F.min_by("cluster_label", some).alias("label"))


def colors(notes: DataFrame, by: str = "display_topic_id") -> DataFrame:
    """(cluster_id, color) of every cluster, from the direction of its centroid off the mean of the centroids."""
    mean = notes.where("vector is not null").groupBy(F.col(by).alias("cluster_id")).agg(*(F.avg(F.get("vector", F.lit(i)).cast("double")).alias(f"c{i}") for i in (0, 1)))
    return placed_colors(mean, notes.select(F.col(by).alias("cluster_id")).where("cluster_id is not null").distinct())


def placed_colors(mean: DataFrame, every: DataFrame) -> DataFrame:
    """(cluster_id, color) of every cluster, of mean (cluster_id, c0, c1): the first two components of centroids."""
    middle = mean.agg(F.avg("c0").alias("g0"), F.avg("c1").alias("g1"))
    placed = mean.crossJoin(F.broadcast(middle)).select("cluster_id", (F.col("c0") - F.col("g0")).alias("dx"), (F.col("c1") - F.col("g1")).alias("dy"))
    return every.join(placed, "cluster_id", "left").select("cluster_id", cluster_color(F.col("dx"), F.col("dy")).alias("color"))


def pairwise_cosine(notes: DataFrame, by: str = "display_topic_id") -> DataFrame:
    """Cosine of every two centroids (a < b), by an equal-dimension join and a sum."""
    v = centroid_values(notes, by)
    length = v.groupBy("cluster_id").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    v = v.join(length, "cluster_id")
    a, b = v.toDF("a", "dim", "va", "na"), v.toDF("b", "dim", "vb", "nb")
    out = a.join(b, "dim").where("a < b").groupBy("a", "b").agg(F.sum(F.col("va") * F.col("vb")).alias("d"), F.first("na").alias("na"), F.first("nb").alias("nb"))
    return out.select("a", "b", F.round(F.when(F.col("na") * F.col("nb") > 0, F.col("d") / (F.col("na") * F.col("nb"))).otherwise(0.0), 4).alias("similarity"))


def similar_clusters(notes: DataFrame, cluster_id: str, limit: int = 25, least: float = 0.3) -> DataFrame:
    """Clusters of the same meta cluster by cosine to the given one's centroid; an unknown id is tried again before its first dot."""
    every = centroids(notes).join(cluster_facts(notes), "cluster_id")
    wanted = F.when(F.col("cluster_id") == cluster_id, 0).when(F.col("cluster_id") == cluster_id.split(".")[0], 1)
    target = every.where(wanted.isNotNull()).orderBy(wanted).limit(1).select(F.col("centroid").alias("t"), F.col("meta_cluster_id").alias("tm"))
    others = every.where(F.col("cluster_id") != cluster_id).join(F.broadcast(target), F.col("meta_cluster_id") == F.col("tm"))
    scored = others.withColumn("s", clip01(cosine(F.col("centroid"), F.col("t")))).where(F.col("s") >= least)
    return scored.select("cluster_id", "label", "chunk_count", F.round("s", 4).alias("similarity")).orderBy(F.desc("similarity"), "cluster_id").limit(limit)


def meta_clusters(notes: DataFrame) -> DataFrame:
    """Flat hierarchy: a row for each cluster with its meta cluster's facts; newest meta clusters first, then largest clusters."""
    return hierarchy_of(cluster_facts(notes), colors(notes))


def hierarchy_of(facts: DataFrame, shades: DataFrame) -> DataFrame:
    """meta_clusters of clusters' facts and colours."""
    facts = facts.join(shades, "cluster_id", "left")
    meta = facts.groupBy("meta_cluster_id").agg(F.max("last_modified").alias("meta_last_modified"), F.sum("chunk_count").alias("meta_chunks"), F.min_by("meta_label", "first_doc_id").alias("meta_cluster_label"))
    out = facts.join(meta, "meta_cluster_id").select("meta_cluster_id", "meta_cluster_label", "meta_last_modified", "meta_chunks", "cluster_id", "label", "chunk_count", "color")
    return out.orderBy(F.desc_nulls_last("meta_last_modified"), "meta_cluster_id", F.desc("chunk_count"), "cluster_id")


def meta_clusters_nested(notes: DataFrame) -> DataFrame:
    """One row for each meta cluster with its clusters in an array."""
    child = F.struct((-F.col("chunk_count")).alias("order"), "cluster_id", "label", "chunk_count", "color")
    return meta_clusters(notes).groupBy("meta_cluster_id", "meta_cluster_label", "meta_last_modified", "meta_chunks").agg(F.array_sort(F.collect_list(child)).alias("children"))


def of_clusters(notes: DataFrame, csv: str) -> DataFrame:
    ids = [x.strip() for x in csv.split(",") if x.strip()]
    return notes.where(F.col("display_topic_id").isin(ids))


def meta_search_sort(notes: DataFrame, distances: DataFrame) -> DataFrame:
    """Meta clusters by mean over their clusters of the mean distance; distances: (cluster_id, distance), clusters without one don't count, and a meta cluster without any comes last."""
    mean = distances.groupBy("cluster_id").agg(F.avg("distance").alias("d"))
    facts = cluster_facts(notes).join(mean, "cluster_id", "left")
    out = facts.groupBy("meta_cluster_id").agg(F.min_by("meta_label", "first_doc_id").alias("label"), F.round(F.avg("d"), 6).alias("avg_distance"), F.count(F.lit(1)).alias("n_clusters"), F.max("last_modified").alias("last_modified"))
    return out.orderBy(F.asc_nulls_last("avg_distance"), "label")


def tree_search_sort(hits: DataFrame) -> DataFrame:
    """Meta clusters by search hits (cluster_id, meta_cluster_id, distance); hits outside clusters don't count."""
    mean = hits.where("cluster_id is not null and cluster_id not in ('', '-1')").groupBy("meta_cluster_id", "cluster_id").agg(F.avg("distance").alias("d"), F.count(F.lit(1)).alias("n"))
    return mean.groupBy("meta_cluster_id").agg(F.round(F.avg("d"), 6).alias("avg_distance"), F.sum("n").alias("n_hits"), F.count(F.lit(1)).alias("n_clusters")).orderBy("avg_distance", "meta_cluster_id")


def _one_of_each_chunk(notes: DataFrame) -> DataFrame:
    w = Window.partitionBy("note_key", "chunk_index").orderBy("doc_id")
    return notes.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def sidebar(notes: DataFrame, cluster_id: str, titles: DataFrame | None = None) -> DataFrame:
    """Chunks of all notes with a chunk in the cluster, text only of those in it.  With titles: only their chunks in the cluster."""
    keyed = with_note_key(notes)
    inside = F.col("display_topic_id") == cluster_id
    if titles is None:
        keyed = keyed.join(keyed.where(inside).select("note_key").distinct(), "note_key", "left_semi")
    else:
        keyed = keyed.where(inside).join(titles.select("title").distinct(), "title", "left_semi")
    out = _one_of_each_chunk(keyed).withColumn("in_cluster", inside)
    text = F.when(inside, F.coalesce("chunk_content", F.lit(""))).otherwise("")
    return out.select("note_key", "title", F.col("chunk_index").cast("long").alias("chunk_index"), "display_topic_id", "in_cluster", F.length(text).cast("long").alias("text_length")).orderBy("note_key", "chunk_index")


def filtered_notes_all(notes: DataFrame, titles: DataFrame) -> DataFrame:
    """For each cluster of the titles' chunks, all chunks of the notes in it; notes are known by title, the first key of each."""
    keyed = with_note_key(notes).join(titles.select("title").distinct(), "title", "left_semi")
    keys = keyed.groupBy("title").agg(F.min_by("note_key", "doc_id").alias("first_key"))
    member = keyed.select(F.col("display_topic_id").alias("cluster_id"), "title").distinct().join(keys, "title")
    chunks = _one_of_each_chunk(keyed).select(F.col("note_key").alias("first_key"), F.col("chunk_index").cast("long").alias("chunk_index"), "display_topic_id")
    return member.join(chunks, "first_key").select("cluster_id", F.col("first_key").alias("note_key"), "chunk_index", (F.col("display_topic_id") == F.col("cluster_id")).alias("in_cluster"))


def primary_cluster(notes: DataFrame) -> DataFrame:
    """The cluster of most of a note's chunks, of equals the one seen first."""
    keyed = with_note_key(notes)
    each = keyed.groupBy("note_key", "display_topic_id").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("chunk_index", "doc_id")).alias("first"))
    best = each.groupBy("note_key").agg(F.min_by("display_topic_id", F.struct((-F.col("n")).alias("n"), F.col("first"))).alias("primary_cluster"))
    return best


def first_meta(notes: DataFrame) -> DataFrame:
    """The first meta cluster that is not null along a note's chunks."""
    return with_note_key(notes).where("meta_cluster_id is not null").groupBy(*NOTE).agg(F.min_by("meta_cluster_id", F.struct("chunk_index", "doc_id")).alias("meta_cluster_id"))


def selected_summaries(notes: DataFrame, clusters: list[str]) -> DataFrame:
    return cluster_facts(notes.where(F.col("display_topic_id").isin(clusters))).select("cluster_id", "label", "chunk_count")
