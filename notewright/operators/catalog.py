"""Sinks: append, overwrite, backup and restore of note tables, exports, and checks of what was written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators.incremental import verify_count

#: Columns of a clustered table, in order.
CLUSTERED = (
    "title content creation_date modification_date chunk_index total_chunks chunk_content vector base_topic_id display_topic_id is_split_child "
    "cluster_id cluster_label base_cluster_label cluster_confidence cluster_summary last_clustered clean_chunk_content meta_cluster_id meta_cluster_label"
).split()


def create(df: DataFrame, name: str, fresh: bool = False) -> None:
    """Creates a table; fresh drops it first, else an existing one stays as it is."""
    spark = df.sparkSession
    if fresh:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    if not spark.catalog.tableExists(name):
        df.write.saveAsTable(name)


def append(df: DataFrame, name: str) -> int:
    """Appends rows and checks their number."""
    spark = df.sparkSession
    before, added = spark.table(name).count(), df.count()
    df.write.mode("append").saveAsTable(name)
    after = spark.table(name).count()
    verify_count(before, added, after)
    return after


def append_embedded(df: DataFrame, name: str, embedder=None) -> int:  # noqa: ANN001
    """Appends chunks with the vectors of their texts, made on the way in Arrow batches."""
    from notewright.operators.models import embed

    return append(embed(df.drop("vector"), embedder=embedder).select(*df.sparkSession.table(name).columns), name)


def overwrite(df: DataFrame, name: str) -> None:
    """Replaces a table by a frame that may read it: written beside it, then swapped by two renames.

    Between these the name is gone, while the rows stand under name_old_copy and name_new_copy.  KeyedTable.replace has no
    such moment.
    """
    spark = df.sparkSession
    beside, old = f"{name}_new_copy", f"{name}_old_copy"
    spark.sql(f"DROP TABLE IF EXISTS {beside}")
    df.write.saveAsTable(beside)
    if spark.catalog.tableExists(name):
        spark.sql(f"DROP TABLE IF EXISTS {old}")
        spark.sql(f"ALTER TABLE {name} RENAME TO {old}")
    spark.sql(f"ALTER TABLE {beside} RENAME TO {name}")
    spark.sql(f"DROP TABLE IF EXISTS {old}")


def store_clustered(df: DataFrame, name: str) -> None:
    """Overwrites with the columns of a clustered table; missing ones are null."""
    overwrite(df.select(*(F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in CLUSTERED)), name)


def backup(spark: SparkSession, name: str, timestamp: int) -> str:
    copy = f"{name}_backup_{timestamp}"
    spark.table(name).write.saveAsTable(copy)
    return copy


def restore(spark: SparkSession, name: str, copy: str, timestamp: int) -> str | None:
    """Replaces a table by a backup with the same columns in the same order, after a safety copy; returns that copy's name."""
    saved = None
    if spark.catalog.tableExists(name):
        if spark.table(name).columns != spark.table(copy).columns:
            raise ValueError(f"the columns of {copy} are not those of {name}")
        saved = backup(spark, name, timestamp)
    overwrite(spark.table(copy), name)
    return saved


def delete(spark: SparkSession, name: str, keys: DataFrame, on: list[str]) -> None:
    stay = spark.table(name).join(keys.select(*on).distinct(), on, "left_anti")
    overwrite(stay.select(*spark.table(name).columns), name)  # the join puts its keys first


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def describe(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame([(i, f.name, f.dataType.simpleString()) for i, f in enumerate(df.schema)], "place int, name string, type string")
