"""Interaction history: logs of opened and modified notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.functions.numbers import date_prefix, iso_date
from notewright.operators.clusters import _one_of_each_chunk, primary_cluster
from notewright.operators.notes import in_dates, with_note_key
from notewright.sources.tables import EVENT

TYPES = ("opened", "modified")


def parse_log(log: Column, strict: bool = False) -> Column:
    """Events of a JSON log: null or garbage has none, a lone object is one; strict leaves out those without dt or type."""
    out = F.coalesce(F.from_json(log, EVENT), F.array().cast(EVENT))
    return F.filter(out, lambda e: e["dt"].isNotNull() & e["type"].isNotNull()) if strict else F.filter(out, lambda e: e.isNotNull())


def events(interactions: DataFrame, strict: bool = False) -> DataFrame:
    return interactions.select("title", F.explode(parse_log(F.col("interaction_log"), strict)).alias("e")).select("title", "e.dt", "e.type", date_prefix(F.col("e.dt")).alias("day"))


def of_title(interactions: DataFrame, title: str) -> DataFrame:
    """last_opened and number of events of one title."""
    return interactions.where(F.col("title") == title).limit(1).select("title", "last_opened", F.size(parse_log(F.col("interaction_log"))).cast("long").alias("n_events"))


def recent(interactions: DataFrame, limit: int | None = 50) -> DataFrame:
    out = interactions.select("title", "last_opened").orderBy(F.desc_nulls_last("last_opened"), "title")
    return out if limit is None else out.limit(limit)


def history_dates(interactions: DataFrame) -> DataFrame:
    return events(interactions).where("day is not null").select("day").distinct().orderBy("day")


def history_by_title(interactions: DataFrame, day: str) -> DataFrame:
    """First and last event and their number, by title, on a day."""
    return events(interactions).where(F.col("day") == day).groupBy("title").agg(F.min("dt").alias("opened_at"), F.max("dt").alias("last_opened_at"), F.count(F.lit(1)).alias("opened_count"))


def history_day(notes: DataFrame, interactions: DataFrame, day: str) -> DataFrame:
    """Chunks of the day's notes, with the note's primary cluster and events; newest first."""
    opened = history_by_title(interactions, day)
    keyed = _one_of_each_chunk(with_note_key(notes.join(opened.select("title"), "title", "left_semi")))
    out = keyed.join(primary_cluster(keyed), "note_key").join(opened, "title")
    return out.select(
        "note_key", F.col("chunk_index").cast("long").alias("chunk_index"), "display_topic_id", "primary_cluster", (F.col("display_topic_id") == F.col("primary_cluster")).alias("in_cluster"), "opened_at", "last_opened_at", "opened_count"
    ).orderBy(F.desc_nulls_last("opened_at"), "note_key", "chunk_index")


def titles_in_range(notes: DataFrame, interactions: DataFrame, low: str | None, high: str | None) -> DataFrame:
    """Titles with an event, or a note created or modified, within the dates."""
    day = iso_date(F.col("day"))
    ok = day.isNotNull()
    if low is not None:
        ok = ok & (day >= F.lit(low).cast("date"))
    if high is not None:
        ok = ok & (day <= F.lit(high).cast("date"))
    return events(interactions).where(ok).select("title").union(notes.where(in_dates(low, high)).select("title")).distinct()


def by_date(notes: DataFrame, interactions: DataFrame, low: str | None, high: str | None) -> DataFrame:
    """Titles in the range that are notes."""
    return titles_in_range(notes, interactions, low, high).join(notes.select("title").distinct(), "title", "left_semi").orderBy("title")


def by_titles(interactions: DataFrame, titles: list[str], low: str | None, high: str | None) -> DataFrame:
    """The latest event day within the dates of each asked title, in the order asked; null if it has none."""
    asked = interactions.sparkSession.createDataFrame([*enumerate(titles)], "place long, title string")
    day = iso_date(F.col("day"))
    ok = day.isNotNull()
    if low is not None:
        ok = ok & (day >= F.lit(low).cast("date"))
    if high is not None:
        ok = ok & (day <= F.lit(high).cast("date"))
    last = events(interactions).where(ok).groupBy("title").agg(F.max("day").alias("last_day"))
    return asked.join(last, "title", "left").select("place", "title", "last_day").orderBy("place")


def log_interactions(interactions: DataFrame, new: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """The table after appending events (title, dt, type); only known types, and with notes only their titles."""
    new = new.where(F.col("type").isin(*TYPES))
    if notes is not None:
        new = new.join(notes.select("title").distinct(), "title", "left_semi")
    return _collect(events(interactions).select("title", "dt", "type").unionByName(new.select("title", "dt", "type")), interactions, new)


def merge_open(interactions: DataFrame, titles: DataFrame, now: str) -> DataFrame:
    """The table after opening titles at now: rows of one title become one, events without dt or type go."""
    new = titles.select("title").distinct().select("title", F.lit(now).alias("dt"), F.lit("opened").alias("type"))
    return _collect(events(interactions, strict=True).select("title", "dt", "type").unionByName(new), interactions, new)


def _collect(all_events: DataFrame, interactions: DataFrame, new: DataFrame) -> DataFrame:
    logs = all_events.groupBy("title").agg(F.array_sort(F.collect_list(F.struct("dt", "type"))).alias("log"))
    opened = interactions.select("title", "last_opened").unionByName(new.select("title", F.col("dt").alias("last_opened"))).groupBy("title").agg(F.max("last_opened").alias("last_opened"))
    return opened.join(logs, "title", "left").select("title", "last_opened", F.to_json(F.coalesce("log", F.array().cast(EVENT))).alias("interaction_log"), F.size(F.coalesce("log", F.array().cast(EVENT))).cast("long").alias("n_events"))
