"""The corpus pipeline: five filtering, deduplicating and mixing stages, each written and read again."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm._shared import Scratch, delete, exists, shared_dir
from notewright.llm.decontaminate import contamination
from notewright.llm.jaccard_join import near_duplicates
from notewright.llm.language_model import classify
from notewright.llm.mixing import mix_sources
from notewright.llm.queries import cycle_weights, table
from notewright.llm.substring_dedup import remove_repeated


def _row(docs: DataFrame) -> DataFrame:
    """With all columns once more as one, so that no name of theirs can clash with an operator's."""
    return docs.withColumn("_nw_row", F.struct(*(docs[c] for c in docs.columns)))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier keeps.  Without text there is nothing against a document; an empty table stays empty."""
    return classify(_row(docs), table(spark, sf_dir, "labels"), keep=("_nw_row",)).where("kept").select("_nw_row.*")


def _identity(docs: DataFrame) -> Column:
    """Orders documents by doc_id, null ones last, and tells texts with one id apart."""
    return F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.xxhash64("text").alias("c"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies one document: that with the smallest doc_id, of rows with one doc_id the one whose text has the smallest hash.

    Of exact repetitions, one doc_id with one text, a single row stays.  Documents without words are in no group and stay.
    """
    scratch = Scratch(spark, "near")
    keyed = docs.select("*", _identity(docs).alias("_nw_key"))
    found = near_duplicates(keyed.select("_nw_key", "text"), doc_id="_nw_key")
    gone = found.where("doc_id != component_id").select(F.col("doc_id").alias("_nw_key")).distinct()
    stay = keyed.join(gone, "_nw_key", "left_anti")
    again = scratch.write(found.where("doc_id = component_id and n_shingles > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("doc_id").alias("_nw_key")), "repeated")
    if again.isEmpty():
        return stay.select(*docs.columns)
    once = stay.join(again, "_nw_key", "left_semi").dropDuplicates(["_nw_key"])
    return stay.join(again, "_nw_key", "left_anti").unionByName(once).select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without sentences that an earlier document has, n_chars anew; documents of which nothing is left go.  Null and empty texts stay as they are."""
    cut = remove_repeated(docs).where("_nw_removed = 0 or length(text) > 0")
    n = F.when(F.col("_nw_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cut.withColumn("n_chars", n).select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of the benchmark.  Those without words have none; with an empty benchmark all stay."""
    found = contamination(_row(docs), table(spark, sf_dir, "benchmark"), keep=("_nw_row",))
    return found.where("n_hit = 0").select("_nw_row.*")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents in the mix, with all their columns, and mix_size and mix_taken: how many words they have and how many the mix takes.

    Documents without words are not in it.  Rows that are equal in all columns come out once, with what is taken of all
    of them.
    """
    key = F.struct("doc_id", F.xxhash64(*docs.columns).alias("h"))
    mixed = mix_sources(docs.select("doc_id", "source", "text", key.alias("_nw_key")), cycle_weights, keep=("_nw_key",)).where("taken > 0")
    # null-safe by its parts: a struct with a null part isn't null itself
    taken = mixed.groupBy("_nw_key").agg(F.max("size").alias("_nw_size"), F.sum("taken").alias("_nw_taken"))
    rows = docs.select("*", key.alias("_nw_key")).join(taken, "_nw_key").dropDuplicates(["_nw_key"])
    names = [c for c in docs.columns if c not in ("mix_size", "mix_taken")]
    return rows.select(*names, F.col("_nw_size").alias("mix_size"), F.col("_nw_taken").alias("mix_taken"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near),
    ("substring dedup", substrings),
    ("benchmark decontamination", benchmark),
    ("mixing sources", mix),
]

ORACLE_SQL = None


def _inputs(spark: SparkSession, sf_dir: str) -> str:
    """A name for the tables that a run reads: their files with lengths and times, and the stages in their order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    seen = [title for title, _ in STAGES]
    for name in ("documents", "labels", "benchmark"):
        place = jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        files = place.getFileSystem(conf).listStatus(place)
        seen += sorted(f"{f.getPath()} {f.getLen()} {f.getModificationTime()}" for f in files)
    return hashlib.sha256("\n".join(seen).encode()).hexdigest()[:16]


def run(spark: SparkSession, sf_dir: str, name: str | None = None) -> DataFrame:
    """The last stage's rows.  Each stage's table stands in the shared folder, and is deleted once the next one is wholly written.

    A run with a name goes on behind the last stage that an earlier run of that name wrote from the same files; from
    others, or with other stages, it starts anew.
    """
    docs = table(spark, sf_dir, "documents")
    root = f"{shared_dir(spark)}/notewright/pipeline-{f'{name}-{_inputs(spark, sf_dir)}' if name else uuid.uuid4().hex}"
    paths = [f"{root}/{k}-{title.replace(' ', '-')}" for k, (title, _) in enumerate(STAGES)]
    done = max((k for k, path in enumerate(paths) if name and exists(spark, f"{path}/_SUCCESS")), default=-1)
    if done >= 0:
        docs = spark.read.parquet(paths[done])
    for k, (_, stage) in enumerate(STAGES):
        if k > done:
            stage(spark, docs, sf_dir).write.mode("overwrite").parquet(paths[k])
            docs = spark.read.parquet(paths[k])
            if k:
                delete(spark, paths[k - 1])
    return docs
