"""Aggregates by cluster that are kept up to date by changes: what is added counts, what is removed is taken back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators.clusters import hierarchy_of, placed_colors
from notewright.operators.keyed import KeyedTable

#: Components are added as numbers of so many digits behind the point, so that taking one back leaves nothing of it.
DECIMAL = "decimal(38,18)"
_FIRST = ("cluster_label", "meta_cluster_id", "meta_cluster_label")


def _day() -> Column:
    return F.nullif(F.substring(F.trim("modification_date"), 1, 10), F.lit(""))


def _sums(rows: DataFrame, by: str) -> DataFrame:
    """(cluster_id, dim, value): exact sums of vectors."""
    each = rows.where(F.col("vector").isNotNull() & F.col(by).isNotNull()).select(F.col(by).alias("cluster_id"), F.col("_sign"), F.posexplode("vector").alias("dim", "v"))
    value = F.col("v").cast("double").cast(DECIMAL)
    value = F.when(F.col("_sign") > 0, value).otherwise(-value)  # a product would lose digits
    return each.groupBy("cluster_id", "dim").agg(F.sum(value).cast(DECIMAL).alias("value"))


def _delta(added: DataFrame, removed: DataFrame, by: str) -> tuple[DataFrame, DataFrame]:
    """By cluster: changes of counts, first row and last date of what came, and the same of what went; and the change of sums."""
    columns = ["doc_id", by, *_FIRST, "modification_date", "vector"]
    rows = added.select(*columns, F.lit(1).alias("_sign")).unionByName(removed.select(*columns, F.lit(-1).alias("_sign")))
    came, went = F.col("_sign") > 0, F.col("_sign") < 0
    first = F.struct("doc_id", *_FIRST)
    facts = rows.where(F.col(by).isNotNull()).groupBy(F.col(by).alias("cluster_id")).agg(
        F.sum("_sign").alias("dn"), F.sum(F.when(F.col("vector").isNotNull(), F.col("_sign")).otherwise(0)).alias("dv"),
        F.min_by(first, F.when(came, F.col("doc_id"))).alias("came_first"), F.max(F.when(came, _day())).alias("came_last"),
        F.min(F.when(went, F.col("doc_id"))).alias("went_first"), F.max(F.when(went, _day())).alias("went_last"),
    )
    return facts, _sums(rows, by)


class ClusterAggregates:
    """Chunk counts, vector sums, first rows and last dates of clusters, in a keyed table; from them centroids, colours and the hierarchy.

    A change is a frame of chunks that went (as they were) and one of chunks that came (as they are): a modified chunk is in
    both.  Counts and sums are added to and taken from; a first row or last date is looked up anew in the chunks of
    those clusters only that have lost theirs.  Chunks need a doc_id that is not null; those of null cluster don't count.
    """

    def __init__(self, spark: SparkSession, root: str, by: str = "display_topic_id") -> None:
        self.spark, self.by = spark, by
        self.facts, self.sums = KeyedTable(spark, f"{root.rstrip('/')}/facts"), KeyedTable(spark, f"{root.rstrip('/')}/sums")

    @classmethod
    def build(cls, notes: DataFrame, root: str, by: str = "display_topic_id", buckets: int = 16) -> ClusterAggregates:
        out = cls(notes.sparkSession, root, by)
        facts, sums = _delta(notes, notes.limit(0), by)
        first = facts.select("cluster_id", F.col("dn").alias("chunk_count"), F.col("dv").alias("vectors"), F.col("came_first").alias("first"), F.col("came_last").alias("last_modified"))
        KeyedTable.create(first, f"{root.rstrip('/')}/facts", ["cluster_id"], buckets)
        KeyedTable.create(sums, f"{root.rstrip('/')}/sums", ["cluster_id"], buckets)
        return out

    def change(self, added: DataFrame, removed: DataFrame, notes: DataFrame, number: int) -> None:
        """notes: all chunks after the change.  number: of the change, larger than those before; a repeated one counts once."""
        facts, sums = _delta(added, removed, self.by)
        keys = facts.select("cluster_id")
        self._change_facts(facts, self.facts.lookup(keys), notes, number)
        old = self.sums.lookup(keys).unionByName(sums)
        # sums of a cluster without vectors left are all zero and go with its facts
        self.sums.upsert_keys(keys, old.groupBy("cluster_id", "dim").agg(F.sum("value").cast(DECIMAL).alias("value")), ("change", number))

    def _change_facts(self, delta: DataFrame, old: DataFrame, notes: DataFrame, number: int) -> None:
        both = delta.join(old, "cluster_id", "left")
        n, v = (F.coalesce(c, F.lit(0)) + d for c, d in (("chunk_count", F.col("dn")), ("vectors", F.col("dv"))))
        lost = (F.col("went_first") <= F.col("first.doc_id")) | (F.col("went_last") >= F.col("last_modified"))
        earlier = F.col("first").isNull() | (F.col("came_first.doc_id") < F.col("first.doc_id"))
        first = F.when(F.col("came_first").isNotNull() & earlier, F.col("came_first")).otherwise(F.col("first"))
        new = both.select("cluster_id", n.alias("chunk_count"), v.alias("vectors"), first.alias("first"), F.greatest("came_last", "last_modified").alias("last_modified"), F.coalesce(lost, F.lit(False)).alias("lost"))
        new = new.where("chunk_count > 0")
        again = notes.join(new.where("lost").select(F.col("cluster_id").alias(self.by)), self.by, "left_semi")
        again = again.groupBy(F.col(self.by).alias("cluster_id")).agg(F.min_by(F.struct("doc_id", *_FIRST), "doc_id").alias("f"), F.max(_day()).alias("d"))
        out = new.join(again, "cluster_id", "left").select("cluster_id", "chunk_count", "vectors", F.when(F.col("lost"), F.col("f")).otherwise(F.col("first")).alias("first"), F.when(F.col("lost"), F.col("d")).otherwise(F.col("last_modified")).alias("last_modified"))
        self.facts.upsert_keys(delta.select("cluster_id"), out, ("change", number))

    # what is kept, in the form that the operators over chunks have

    def centroid_values(self) -> DataFrame:
        """(cluster_id, dim, value)."""
        n = self.facts.read().where("vectors > 0").select("cluster_id", "vectors")
        return self.sums.read().join(n, "cluster_id").select("cluster_id", F.col("dim").cast("long").alias("dim"), (F.col("value").cast("double") / F.col("vectors")).alias("value"))

    def cluster_facts(self) -> DataFrame:
        return self.facts.read().select("cluster_id", "chunk_count", F.col("first.cluster_label").alias("label"), "first.meta_cluster_id", F.col("first.meta_cluster_label").alias("meta_label"), "last_modified", F.col("first.doc_id").alias("first_doc_id"))

    def colors(self) -> DataFrame:
        two = self.centroid_values().where("dim < 2").groupBy("cluster_id").agg(*(F.max(F.when(F.col("dim") == i, F.col("value"))).alias(f"c{i}") for i in (0, 1)))
        return placed_colors(two, self.facts.read().select("cluster_id"))

    def meta_clusters(self) -> DataFrame:
        return hierarchy_of(self.cluster_facts(), self.colors())
