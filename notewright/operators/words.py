"""Word statistics and stop words."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.text import bar, word_tokens


def word_counts(notes: DataFrame, text: str = "chunk_content", shortest: int = 2) -> DataFrame:
    return notes.select(F.explode(word_tokens(F.col(text), shortest)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def common_words(notes: DataFrame, limit: int = 50, shortest: int = 2, text: str = "chunk_content") -> DataFrame:
    """The most frequent words (of equals the first in the alphabet), their share, and a bar."""
    counts = word_counts(notes, text, shortest)
    total = counts.agg(F.sum("n").alias("total"), F.max("n").alias("most"))
    top = counts.orderBy(F.desc("n"), "word").limit(limit)
    return top.crossJoin(F.broadcast(total)).select("word", "n", F.round(100.0 * F.col("n") / F.col("total"), 4).alias("percent"), F.length(bar(F.col("n"), F.col("most"))).cast("long").alias("bar_length"))


def cumulative_words(notes: DataFrame, limit: int = 50, text: str = "chunk_content") -> DataFrame:
    """The same with rank and cumulative share; only the top words meet in one task."""
    counts = word_counts(notes, text)
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), "word").limit(limit)
    w = Window.orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "word")).cast("long")).withColumn("running", F.sum("n").over(w))
    return out.crossJoin(F.broadcast(total)).select("rank", "word", "n", F.round(100.0 * F.col("running") / F.col("total"), 4).alias("cumulative_percent"))


def frequent_words(notes: DataFrame, share: float = 0.001, text: str = "chunk_content") -> DataFrame:
    """Words with more than that share of all: at most 1 / share of them."""
    counts = word_counts(notes, text)
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") / F.col("total") > share).select("word", "n")


def without_words(notes: DataFrame, words: DataFrame, text: str = "chunk_content") -> DataFrame:
    """Text without white-space separated tokens whose lower form is one of the words, which are few (see frequent_words)."""
    stop = words.agg(F.collect_set("word").alias("_stop"))
    kept = F.filter(F.split(F.trim(F.regexp_replace(F.coalesce(F.col(text), F.lit("")), r"\s+", " ")), " "), lambda w: ~F.array_contains("_stop", F.lower(w)))
    return notes.crossJoin(F.broadcast(stop)).withColumn("clean", F.array_join(kept, " ")).drop("_stop")
