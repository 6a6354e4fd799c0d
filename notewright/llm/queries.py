"""One thin query per operator, with production parameters, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.llm import centroids, chat, decontaminate, languages, license_scan, periodic_runs, substring_dedup, token_counts
from notewright.llm.jaccard_join import near_duplicates
from notewright.llm.language_model import classify
from notewright.llm.mixing import mix_sources
from notewright.llm.oracles import ORACLE_SQL
from notewright.llm.quality_rules import quality_rules
from notewright.llm.simhash import near_fingerprints


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cycle_weights(sources: list[str | None]) -> list[float]:
    """5, 2, 1 and again, in code-point order."""
    return [(5.0, 2.0, 1.0)[i % 3] for i in range(len(sources))]


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed to the weights 5, 2, 1: what is taken of each."""
    return mix_sources(table(spark, sf_dir, "documents"), cycle_weights)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Perplexity, worst window and verdict of every document."""
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learnt from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    model = languages.train(docs.where(~languages.held_out(F.col("doc_id"))))
    return languages.identify(docs, model, keep=(languages.held_out(F.col("doc_id")).alias("held_out"),))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document and of its sentences; the vocabulary is that of the setting spark.notewright.vocabulary, or the default."""
    path = spark.conf.get("spark.notewright.vocabulary", token_counts.VOCABULARY)
    return token_counts.digest(token_counts.count_tokens(table(spark, sf_dir, "documents"), path, by="sentences"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses that every document quotes."""
    return license_scan.digest(license_scan.scan_licenses(table(spark, sf_dir, "documents")))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and a planted one, formatted and read back."""
    log = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    planted = r"\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", planted), (-7, 1, "assistant", planted)], "conv_id long, turn long, role string, text string")
    events = log.unionByName(more).withColumn("seq", F.lit(0)).withColumn("event", F.lit("message"))
    return chat.digest(chat.read_back(chat.render(chat.fold(events))))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    return decontaminate.digest(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the sentences that an earlier one has."""
    return substring_dedup.digest(substring_dedup.remove_repeated(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of near copies among all documents."""
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, distances to six places, and the verdict of every document."""
    found = quality_rules(table(spark, sf_dir, "documents"))
    return found.withColumns({c: F.round(c, 6) for c in ("class_distance", "word_distance")})


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's cluster of 40, after five rounds."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of every document, a tenth of them with a planted end, and what is left without them."""
    docs = table(spark, sf_dir, "documents")
    return periodic_runs.digest(periodic_runs.periodic_runs(docs.select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"))))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and groups of those within 4 bits."""
    return near_fingerprints(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_mix_sources, op2_quality_classifier, op3_language_id, op4_token_counts, op5_license_scan,
        op6_chat_format, op7_decontaminate, op8_substring_dedup, op9_jaccard_join, op10_quality_rules, op11_centroids, op12_periodic_runs, op13_simhash,
    )
}

__all__ = ["ORACLE_SQL", "QUERIES"]
