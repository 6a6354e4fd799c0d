"""Lookups, counts and per-note operations over note chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.numbers import iso_date
from notewright.functions.text import note_key

NOTE = ["title", "creation_date", "modification_date"]


def points(notes: DataFrame) -> DataFrame:
    """What the map view needs of each chunk; the cluster shown is the display topic."""
    return notes.select(
        "unique_key", "title", "creation_date", "modification_date", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"),
        F.col("display_topic_id").alias("cluster_id"), "base_topic_id", "display_topic_id", "cluster_label", "meta_cluster_id", "meta_cluster_label",
    )


def note_content(notes: DataFrame, title: str, chunk_index: int, creation_date: str | None = None, modification_date: str | None = None) -> DataFrame:
    """The text of one chunk: the first row (by the smallest id) that has all the given values."""
    found = notes.where((F.col("title") == title) & (F.col("chunk_index") == chunk_index))
    for name, value in (("creation_date", creation_date), ("modification_date", modification_date)):
        if value is not None:
            found = found.where(F.col(name) == value)
    return found.orderBy("creation_date", "doc_id").limit(1).select("title", "creation_date", "modification_date", F.col("chunk_index").cast("long").alias("chunk_index"), F.coalesce(F.col("total_chunks"), F.lit(1)).cast("long").alias("total_chunks"), F.coalesce("chunk_content", F.lit("")).alias("content"))


def point_fetch(notes: DataFrame, title: str, creation_date: str) -> DataFrame:
    """One note of that title: the one of that date, else the first."""
    order = Window.orderBy(F.desc(F.col("creation_date") == creation_date), "creation_date")
    found = notes.where(F.col("title") == title).groupBy(*NOTE).agg(F.count(F.lit(1)).alias("n_chunks"))
    return found.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def title_lookup(notes: DataFrame, titles: list[str]) -> DataFrame:
    """none, one or many notes of each title, with their creation dates."""
    found = notes.where(F.col("title").isin(titles)).select("title", "creation_date").distinct().groupBy("title").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list("creation_date")), ",").alias("dates"))
    asked = notes.sparkSession.createDataFrame([(t,) for t in titles], "title string")
    out = asked.join(found, "title", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("title", "n", F.coalesce("dates", F.lit("")).alias("dates"), F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "one").otherwise("many").alias("outcome"))


def of_titles(notes: DataFrame, titles: DataFrame) -> DataFrame:
    return notes.join(titles.select("title").distinct(), "title", "left_semi")


def counts(notes: DataFrame) -> DataFrame:
    """Titles, notes and chunks, and chunks per note."""
    out = notes.agg(F.count_distinct("title").alias("titles"), F.count_distinct(F.struct("title", "creation_date")).alias("notes"), F.count(F.lit(1)).alias("chunks"))
    return out.withColumn("chunks_per_note", F.when(F.col("notes") > 0, F.round(F.col("chunks") / F.col("notes"), 4)))


def chunks_per_note(notes: DataFrame, limit: int = 20) -> DataFrame:
    return notes.groupBy("title", "creation_date").agg(F.count(F.lit(1)).alias("n_chunks")).orderBy(F.desc("n_chunks"), "title", "creation_date").limit(limit)


def list_clusters(notes: DataFrame) -> DataFrame:
    """Distinct notes of each cluster, largest first; the label is that of its first chunk."""
    return notes.groupBy("cluster_id").agg(F.count_distinct(F.struct("title", "creation_date")).alias("n_notes"), F.min_by("cluster_label", "doc_id").alias("cluster_label")).orderBy(F.desc("n_notes"), "cluster_id")


def notes_in_cluster(notes: DataFrame, cluster_id: str) -> DataFrame:
    """Its notes, each with the first of its chunks there."""
    return notes.where(F.col("cluster_id") == cluster_id).groupBy("title", "creation_date").agg(F.min("doc_id").alias("first_doc_id"), F.min_by("modification_date", "doc_id").alias("modification_date"))


def in_dates(low: str | None, high: str | None, field: str = "both") -> Column:
    """Whether a note's creation or modification date (or the one named) lies within; an open end is no condition."""
    def within(name: str) -> Column:
        day = iso_date(F.col(name))
        ok = day.isNotNull()
        if low is not None:
            ok = ok & (day >= F.lit(low).cast("date"))
        return ok & (day <= F.lit(high).cast("date")) if high is not None else ok

    return within("creation_date") | within("modification_date") if field == "both" else within(f"{field}_date")


def search_dates(has_query: bool, low: str | None, high: str | None, today: str) -> tuple[str | None, str | None]:
    """The range that is searched: with a query, ends may be open; without, from the last week or day to today."""
    if has_query:
        return low, high
    if low is None and high is None:
        return today, today
    if high is None:
        return low, today
    if low is None:
        import datetime

        return (datetime.date.fromisoformat(high) - datetime.timedelta(days=7)).isoformat(), high
    return low, high


def hierarchical_rows(notes: DataFrame) -> DataFrame:
    """Chunks of split topics, and whether the label is that of the base topic."""
    out = notes.where(F.col("display_topic_id").contains("."))
    return out.select("doc_id", "base_topic_id", "display_topic_id", (F.col("cluster_label") == F.concat(F.lit("Topic "), "base_topic_id")).alias("has_base_label"))


def display_id_distribution(notes: DataFrame, limit: int = 20) -> DataFrame:
    return notes.groupBy("display_topic_id").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "display_topic_id").limit(limit)


def last_per_title(notes: DataFrame) -> DataFrame:
    """The last row of each title (by id), as a map filled in order would have it."""
    return notes.groupBy("title").agg(F.max_by("creation_date", "doc_id").alias("creation_date"), F.max("doc_id").alias("doc_id"))


def chunk_rail(notes: DataFrame, title: str, creation_date: str) -> DataFrame:
    """A note's chunks in order, one of each index, with the chunk before and after (around the ends)."""
    own = notes.where((F.col("title") == title) & (F.col("creation_date") == creation_date)).groupBy("chunk_index").agg(F.min("doc_id").alias("doc_id"), F.min_by("display_topic_id", "doc_id").alias("display_topic_id"))
    w = Window.orderBy("chunk_index")
    ends = own.agg(F.min("chunk_index").alias("first"), F.max("chunk_index").alias("last"))
    return own.crossJoin(F.broadcast(ends)).select(
        F.col("chunk_index").cast("long").alias("chunk_index"), "doc_id", "display_topic_id",
        F.coalesce(F.lead("chunk_index").over(w), "first").cast("long").alias("next_index"), F.coalesce(F.lag("chunk_index").over(w), "last").cast("long").alias("previous_index"),
    )


def next_previous(notes: DataFrame) -> DataFrame:
    """For every chunk, the next and previous chunk index of its note, around the ends."""
    w = Window.partitionBy(*NOTE).orderBy("chunk_index", "doc_id")
    every = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return notes.select(
        "doc_id", F.coalesce(F.lead("chunk_index").over(w), F.first("chunk_index").over(every)).cast("long").alias("next_index"),
        F.coalesce(F.lag("chunk_index").over(w), F.last("chunk_index").over(every)).cast("long").alias("previous_index"),
    )


def with_note_key(notes: DataFrame) -> DataFrame:
    return notes.withColumn("note_key", note_key(*NOTE))
