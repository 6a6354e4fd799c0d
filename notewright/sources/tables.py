"""Sources: note chunks, interaction logs and caches as DataFrames, and the views that bind test tables to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewright.sources.shared import Scratch

#: Columns of a stored note chunk and what a missing one is filled with.
NOTE_DEFAULTS = {
    "cluster_label": "Unclustered",
    "cluster_id": "-1",
    "meta_cluster_id": "-1",
    "meta_cluster_label": "Uncategorized",
}
EVENT = "array<struct<dt:string,type:string>>"
#: Ids of a range, of which a task numbers the rows.
RANGE = 1 << 20


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scan(df: DataFrame, columns: list[str] | None = None, limit: int | None = None) -> DataFrame:
    """Projected scan with an optional row cap; the projection reaches the files."""
    out = df.select(*columns) if columns else df
    return out if limit is None else out.limit(limit)


def normalize_notes(df: DataFrame) -> DataFrame:
    """Adds missing columns, fills nulls and repairs ids and labels that were stored as texts of missing values."""
    have = set(df.columns)
    out = df.withColumn("chunk_index", F.coalesce(F.expr("try_cast(chunk_index AS INT)") if "chunk_index" in have else F.lit(None), F.lit(0)))
    if "total_chunks" in have:
        out = out.withColumn("total_chunks", F.coalesce(F.expr("try_cast(total_chunks AS INT)"), F.lit(1)))
    else:
        out = out.withColumn("total_chunks", F.count(F.lit(1)).over(Window.partitionBy("title")).cast("int"))
    for name, default in NOTE_DEFAULTS.items():
        out = out.withColumn(name, F.coalesce(F.col(name) if name in have else F.lit(None).cast("string"), F.lit(default)))
    out = out.withColumn("base_topic_id", F.coalesce(F.col("base_topic_id"), F.col("cluster_id")) if "base_topic_id" in have else F.col("cluster_id"))
    out = out.withColumn("display_topic_id", F.coalesce(F.col("display_topic_id"), F.col("base_topic_id")) if "display_topic_id" in have else F.col("base_topic_id"))
    for name in ("cluster_id", "base_topic_id", "display_topic_id", "meta_cluster_id"):
        out = out.withColumn(name, F.when(F.col(name).isin("nan", "None", "-1.0"), "-1").otherwise(F.col(name)))
    label = F.col("meta_cluster_label")
    out = out.withColumn("meta_cluster_label", F.when(label.isin("nan", "None"), "Uncategorized").otherwise(label))
    return out.withColumn("unique_key", unique_key())


def unique_key() -> Column:
    """Title and chunk index; notes that share a title share keys."""
    return F.concat_ws("_", "title", "chunk_index")


def notes_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and embeddings as note chunks: a note is a source in a language, its chunks are the documents.

    A note may have very many chunks: they are counted by ranges of ids, so that a task numbers one range of a note.
    Numbers and vectors are put together without the texts, each by its row's place in the files; so a text is moved once,
    unsorted, whatever the size, and not at all where nothing asks for it.
    """
    d, e = read(spark, sf_dir, "documents"), read(spark, sf_dir, "embeddings")
    note, part = ["source", "lang"], F.floor(F.col("doc_id") / RANGE).alias("_range")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row")]
    ranges = d.groupBy(*note, part).agg(F.count(F.lit(1)).alias("_n"))
    up_to = Window.partitionBy(*note).orderBy(F.asc_nulls_last("_range")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranges = ranges.select(*(F.col(c).alias(f"_{c}") for c in note), F.col("_range").alias("_of"), (F.sum("_n").over(up_to) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy(*note)).alias("_all"))
    few = d.select("doc_id", *note, part, *place)
    few = few.withColumn("_place", F.row_number().over(Window.partitionBy(*note, "_range").orderBy("doc_id", "_file", "_row")))
    few = few.join(ranges, F.col("source").eqNullSafe(F.col("_source")) & F.col("lang").eqNullSafe(F.col("_lang")) & F.col("_range").eqNullSafe(F.col("_of")))
    few = few.join(e, e["vec_id"] == few["doc_id"], "left").select("_file", "_row", "_before", "_place", "_all", "embedding", "label")
    # a shuffle of both sides by hashes at any size: no sort of texts
    d = d.select("*", *place).join(few.hint("shuffle_hash"), ["_file", "_row"])
    day = (F.substring("source", 4, 9).cast("int") + F.when(F.col("lang") == "en", 0).when(F.col("lang") == "fr", 7).when(F.col("lang") == "de", 14).otherwise(21)) % 28
    date = lambda plus: F.concat(F.lit("2024-01-"), F.lpad((day + plus).cast("string"), 2, "0"))
    label = F.col("label")
    base = F.when(label.isNull(), "-1").otherwise((label % 5).cast("string"))
    display = F.when(label.isNull(), "-1").when(label >= 5, F.concat_ws(".", (label % 5).cast("string"), label.cast("string"))).otherwise(label.cast("string"))
    meta = F.when(label.isNull(), "-1").otherwise((label % 3).cast("string"))
    out = d.withColumn("chunk_index", (F.col("_before") + F.col("_place") - 1).cast("int")).withColumn("total_chunks", F.col("_all").cast("int"))
    out = out.select(
        "doc_id", F.col("source").alias("title"), "lang", F.col("text").alias("chunk_content"), "chunk_index", "total_chunks",
        date(1).alias("creation_date"), date(3).alias("modification_date"), F.col("embedding").alias("vector"),
        base.alias("base_topic_id"), display.alias("display_topic_id"), meta.alias("meta_cluster_id"),
    )
    return (
        out.withColumn("cluster_id", F.col("base_topic_id"))
        .withColumn("cluster_label", F.concat(F.lit("Topic "), "display_topic_id"))
        .withColumn("meta_cluster_label", F.concat(F.lit("Group "), "meta_cluster_id"))
        .withColumn("unique_key", unique_key())
    )


def chunk_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, title, lang and chunk_content of notes_view: what an index of texts needs, straight from the files."""
    return read(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("title"), "lang", F.col("text").alias("chunk_content"))


def events_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(title, dt, type): views, clicks and purchases as interactions with notes."""
    e = read(spark, sf_dir, "events").where(F.col("event_type").isin("view", "click", "purchase"))
    return e.select(
        F.concat(F.lit("src"), (F.col("user_id") % 25).cast("string")).alias("title"),
        F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("dt"),
        F.when(F.col("event_type") == "purchase", "modified").otherwise("opened").alias("type"),
    )


def interactions_table(events: DataFrame) -> DataFrame:
    """Stored form, one row per title: last_opened and the log as JSON text."""
    return events.groupBy("title").agg(F.max("dt").alias("last_opened"), F.to_json(F.array_sort(F.collect_list(F.struct("dt", "type")))).alias("interaction_log"))


def source_batches(listing: DataFrame, order: list[str], size: int = 50, most: int | None = None) -> DataFrame:
    """A listing in windows of `size`, as a source is asked for them: its rows in order with place (from 0) and batch; at most `most` of them.

    Rows are dealt by ranges and written; a range is numbered by itself, from where the ones before it end.
    """
    spark = listing.sparkSession
    scratch = Scratch(spark, "batches")
    dealt = scratch.write(listing.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "dealt")
    each = dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row a partition
    each = each.select("_part", (F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")).alias("_before"))
    place = F.col("_before") + F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    out = dealt.join(F.broadcast(each), "_part").withColumn("place", place).drop("_part", "_before")
    out = out if most is None else out.where(F.col("place") < most)
    return out.withColumn("batch", F.floor(F.col("place") / size))


def save_cache(notes: DataFrame, path: str, last_sync: str) -> None:
    """The cache of note metadata, a line for each note."""
    note = F.struct("title", "creation_date", "modification_date")
    notes.select(F.lit(last_sync).alias("last_sync"), F.array(note).alias("notes")).write.mode("overwrite").json(path)


def read_cache(spark: SparkSession, path: str, lines: bool = False) -> DataFrame | None:
    """The JSON cache of note metadata, one object or (lines) one a line: one row per note; None if it is missing or unreadable."""
    try:
        raw = spark.read.option("multiLine", not lines).schema("last_sync string, notes array<struct<title:string,creation_date:string,modification_date:string>>").json(path)
        out = raw.select("last_sync", F.explode("notes").alias("n")).select("n.title", "n.creation_date", "n.modification_date", "last_sync")
        out.isEmpty()
        return out
    except Exception:  # noqa: BLE001  any failure means: no cache
        return None


def open_window_titles(windows: DataFrame, column: str = "title") -> DataFrame:
    """Distinct non-blank window titles but that of the main window."""
    t = F.trim(F.col(column))
    return windows.where((t != "") & (F.col(column) != "Notes")).select(F.col(column).alias("title")).distinct()


def list_tables(spark: SparkSession, database: str | None = None) -> DataFrame:
    """Tables with row counts: notes first, then dated backups from the newest, others, test tables last."""
    names = [t.name for t in (spark.catalog.listTables(database) if database else spark.catalog.listTables())]
    rows = [(n, spark.table(f"{database}.{n}" if database else n).count()) for n in names]
    return order_tables(spark.createDataFrame(rows, "name string, n_rows long"))


def order_tables(tables: DataFrame) -> DataFrame:
    stamp = F.expr("try_cast(nullif(regexp_extract(name, '[0-9]{10,}', 0), '') AS BIGINT)")
    tier = F.when(F.col("name") == "notes", 3).when(F.col("name").contains("test"), 0).when(stamp.isNotNull(), 2).otherwise(1)
    out = tables.withColumn("tier", tier).withColumn("stamp", F.coalesce(stamp, F.lit(0)))
    return out.orderBy(F.desc("tier"), F.desc("stamp"), "name")
