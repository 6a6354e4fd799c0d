"""Incremental indexing: what changed, what to delete, the cache of note metadata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.numbers import any_timestamp

KEY = ["title", "creation_date"]


def changes(current: DataFrame, cached: DataFrame) -> DataFrame:
    """new, modified or unchanged for each current note; notes only in the cache don't count.  Of cached rows with one key the last (by modification) counts."""
    old = cached.groupBy(*KEY).agg(F.max("modification_date").alias("_old"), F.lit(True).alias("_known"))
    status = F.when(F.col("_known").isNull(), "new").when(~F.col("_old").eqNullSafe(F.col("modification_date")), "modified").otherwise("unchanged")
    return current.join(old, KEY, "left").select(*KEY, "modification_date", status.alias("status"))


def without_modified(chunks: DataFrame, changed: DataFrame) -> DataFrame:
    """Chunks that stay: those of modified notes go."""
    return chunks.join(changed.where("status = 'modified'").select(*KEY).distinct(), KEY, "left_anti")


def to_index(changed: DataFrame) -> DataFrame:
    """New notes, then modified ones, in the order of their ids."""
    return changed.where("status <> 'unchanged'").orderBy(F.desc(F.col("status") == "new"), *KEY)


def index_report(changed: DataFrame, chunks: DataFrame) -> DataFrame:
    """What an incremental run did: notes processed and skipped, chunks made of the former, and chunks a note to one place."""
    done = changed.where("status <> 'unchanged'")
    made = chunks.join(done.select(*KEY).distinct(), KEY, "left_semi").agg(F.count(F.lit(1)).alias("chunks"))
    notes = changed.agg(F.count(F.when(F.col("status") != "unchanged", 1)).alias("processed"), F.count(F.when(F.col("status") == "unchanged", 1)).alias("skipped"))
    return notes.crossJoin(F.broadcast(made)).withColumn("chunks_per_note", F.when(F.col("processed") > 0, F.round(F.col("chunks") / F.col("processed"), 1)).otherwise(0.0))


def merge_cache(new: DataFrame, old: DataFrame) -> DataFrame:
    """Union by key, new rows win, latest modification first."""
    both = new.select(*KEY, "modification_date", F.lit(0).alias("_p")).unionByName(old.select(*KEY, "modification_date", F.lit(1).alias("_p")))
    w = Window.partitionBy(*KEY).orderBy("_p", F.desc("modification_date"))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").select(*KEY, "modification_date").orderBy(F.desc("modification_date"), *KEY)


def threshold(chunks: DataFrame) -> DataFrame:
    """The latest modification that can be read as a time."""
    return chunks.agg(F.max(any_timestamp(F.col("modification_date"))).alias("since"))


def since(notes: DataFrame, date: str, limit: int | None = None) -> DataFrame:
    """Notes created or modified after a date; the comparison is on the source's columns, so it reaches the scan."""
    out = notes.where((F.col("creation_date") > date) | (F.col("modification_date") > date))
    return out if limit is None else out.limit(limit)


def verify_count(before: int, added: int, after: int) -> None:
    if before + added != after:
        raise ValueError(f"{after} rows after adding {added} to {before}")
