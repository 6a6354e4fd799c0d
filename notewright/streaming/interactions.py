"""Interaction events as a stream, merged into the stored table batch by batch (an addition to the batch operators)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from notewright.operators.catalog import overwrite
from notewright.operators.interactions import log_interactions
from notewright.operators.keyed import KeyedTable


def read_events(spark: SparkSession, path: str, files_at_once: int = 100) -> DataFrame:
    """JSON files of events (title, dt, type) as they arrive."""
    return spark.readStream.schema("title string, dt string, type string").option("maxFilesPerTrigger", files_at_once).json(path)


def daily_counts(events: DataFrame, late: str = "1 day") -> DataFrame:
    """Events by title and day; days close once the watermark has passed them."""
    timed = events.withColumn("ts", F.try_to_timestamp("dt")).where("ts is not null").withWatermark("ts", late)
    return timed.groupBy(F.window("ts", "1 day").alias("w"), "title").agg(F.count(F.lit(1)).alias("n")).select(F.to_date("w.start").alias("day"), "title", "n")


def merge_into(events: DataFrame, table: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Appends each batch to the logs in a catalog table, which must exist.

    A batch that is repeated is left out once its number is stored; that happens behind the table's own write, so a
    failure just between the two appends the batch twice.  merge_keyed has no such gap.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        done = spark.catalog.tableExists(f"{table}_batches") and not spark.table(f"{table}_batches").where(F.col("n") == number).isEmpty()
        if done:
            return
        overwrite(log_interactions(spark.table(table), batch).select("title", "last_opened", "interaction_log"), table)
        spark.createDataFrame([(number,)], "n long").write.mode("append").saveAsTable(f"{table}_batches")

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def merge_keyed(events: DataFrame, table: KeyedTable, checkpoint: str, name: str = "events", once: bool = True) -> StreamingQuery:
    """Appends each batch to the logs in a table keyed by title, exactly once.

    A batch's number is published in one step with its rows, so whenever it fails, a repeated batch either has not
    counted or does nothing.  Only the buckets of the batch's titles are read and written.  Streams into one table
    need names of their own.
    """

    def merge(batch: DataFrame, number: int) -> None:
        stored = table.mark(name)
        if stored is not None and stored >= number:
            return
        titles = batch.select("title").distinct()
        table.upsert(log_interactions(table.lookup(titles), batch).select("title", "last_opened", "interaction_log"), (name, number))

    writer = events.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
