"""Embedders and labellers as parameters, the stored topic model, the full-text index on disk, gathered topics."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewright.functions.numbers import dotted_prefix
from notewright.functions.text import embed_clean, search_tokens, tidy_label
from notewright.operators import topics
from notewright.operators.chunking import chunk_notes
from notewright.operators.search import document_stats, postings
from notewright.sources.shared import Scratch, lean


class Embedder(Protocol):
    """Makes unit vectors of texts; dim is their length."""

    dim: int

    def __call__(self, texts: list[str]) -> np.ndarray: ...


class HashingEmbedder:
    """Signed counts of hashed words, scaled to length 1: deterministic, needs no model."""

    def __init__(self, dim: int = 384) -> None:
        self.dim = dim

    def __call__(self, texts: list[str]) -> np.ndarray:
        import zlib

        out = np.zeros((len(texts), self.dim))
        for i, t in enumerate(texts):
            for w in t.split():
                h = zlib.crc32(w.encode())
                out[i, h % self.dim] += 1 if h >> 31 else -1
        length = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(length == 0, 1, length)


def embed(df: DataFrame, text: str = "chunk_content", embedder: Embedder | None = None, to: str = "vector", batch: int = 32) -> DataFrame:
    """A column of vectors of the cleaned texts, in Arrow batches; the same cleaning is for queries."""
    make = embedder or HashingEmbedder()
    lean(df.sparkSession)

    @F.pandas_udf("array<float>")
    def vectors(texts: pd.Series) -> pd.Series:
        clean = texts.fillna("").tolist()
        return pd.Series([v.astype(np.float32) for i in range(0, len(clean), batch) for v in make(clean[i : i + batch])])

    return df.withColumn(to, vectors(embed_clean(F.coalesce(F.col(text), F.lit("")))))


def embed_query(spark: SparkSession, query: str, embedder: Embedder | None = None) -> list[float]:
    return [float(x) for x in embed(spark.createDataFrame([(query,)], "q string"), "q", embedder, "v").first()["v"]]


def index_notes(notes: DataFrame, html: str, title: str, embedder: Embedder | None = None) -> DataFrame:
    """Note rows with HTML to chunk rows with vectors: plain text under its title, chunked, embedded."""
    from notewright.functions.text import html_to_text, index_text

    plain = notes.withColumn("_text", index_text(F.col(title), html_to_text(F.col(html))))
    return embed(chunk_notes(plain, "_text").drop("_text"), "chunk_content", embedder)


def write_index(notes: DataFrame, path: str) -> None:
    """Postings by term, clustered so that a term's stand together, and document statistics."""
    postings(notes).repartitionByRange("term").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{path}/postings")
    document_stats(notes).write.mode("overwrite").parquet(f"{path}/stats")


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The postings; a lookup of terms reads only the files and row groups that can have them."""
    return spark.read.parquet(f"{path}/postings")


Labeler = Callable[[list[str], list[str]], str]


class ChatLabeler:
    """Asks a chat service for a label: one request for each topic, temperature 0, the reply is JSON with a label.  post sends (url, body) and returns the reply's text."""

    def __init__(self, url: str, model: str, timeout: float = 120.0, documents: int = 5, post: Callable[[str, dict], str] | None = None) -> None:
        self.url, self.model, self.timeout, self.documents, self.post = url, model, timeout, documents, post

    def request(self, keywords: list[str], documents: list[str]) -> dict:
        said = "Keywords: " + ", ".join(keywords) + "\nDocuments:\n" + "\n".join(f"- {d[:300]}" for d in documents[: self.documents])
        schema = {"type": "object", "properties": {"label": {"type": "string"}}, "required": ["label"]}
        return {"model": self.model, "stream": False, "format": schema, "options": {"temperature": 0}, "messages": [{"role": "user", "content": f"Give a label of two to five words for this topic, as JSON.\n{said}"}]}

    def __call__(self, keywords: list[str], documents: list[str]) -> str:
        import json
        import re

        body = self.request(keywords, documents)
        if self.post is not None:
            reply = self.post(self.url, body)
        else:
            from urllib.request import Request, urlopen

            with urlopen(Request(self.url, json.dumps(body).encode(), {"Content-Type": "application/json"}), timeout=self.timeout) as r:  # noqa: S310
                reply = json.loads(r.read())["message"]["content"]
        return str(json.loads(re.sub(r"^```(?:json)?\s*|\s*```$", "", reply.strip()))["label"])


def label_topics(found: DataFrame, labeler: Labeler | None = None, workers: int = 4) -> DataFrame:
    """found: (topic, keywords, documents).  Labels by a callable, several at once, tidied; without one, or where it fails or says nothing, the keywords."""
    plain = F.array_join(F.slice("keywords", 1, 5), " & ")
    if labeler is None:
        return found.withColumn("label", F.coalesce(F.nullif(plain, F.lit("")), F.concat(F.lit("Topic "), "topic")))

    def one(keywords: list[str], documents: list[str]) -> str | None:
        try:
            return labeler(list(keywords), list(documents))
        except Exception:  # noqa: BLE001  a label that can't be made falls back to the keywords
            return None

    @F.pandas_udf("string")
    def ask(keywords: pd.Series, documents: pd.Series) -> pd.Series:
        from concurrent.futures import ThreadPoolExecutor

        with ThreadPoolExecutor(workers) as pool:
            return pd.Series(list(pool.map(one, keywords, documents)), dtype=object)

    said = F.nullif(tidy_label(ask("keywords", "documents")), F.lit(""))
    return found.withColumn("label", F.coalesce(said, F.nullif(plain, F.lit("")), F.concat(F.lit("Topic "), "topic")))


def _levels(topic: str) -> list[Column]:
    """The id's first part, and the parts behind it ('' for a base topic): folders of a stored model."""
    own = F.col(topic)
    return [F.substring_index(own, ".", 1).alias("model"), F.when(own.contains("."), F.substring(own, F.locate(".", own) + 1, F.length(own))).otherwise("").alias("sub")]


def save_model(notes: DataFrame, path: str) -> None:
    """topic_terms in a folder for each base topic and each sub-model below it, topic_hierarchy (parent, child, chunks), and a manifest: what a fitted model is known by."""
    terms = topics.class_tfidf(notes, "display_topic_id").select("topic", "term", "n", "weight", *_levels("topic"))
    terms.drop("topic").write.mode("overwrite").partitionBy("model", "sub").parquet(f"{path}/topic_terms")
    parent = F.when(F.col("display_topic_id").contains("."), dotted_prefix(F.col("display_topic_id"), F.size(F.split("display_topic_id", r"\.")) - 1))
    tree = notes.groupBy(parent.alias("parent_id"), F.col("display_topic_id").alias("child_id")).agg(F.count(F.lit(1)).alias("n_chunks"))
    tree.write.mode("overwrite").parquet(f"{path}/topic_hierarchy")
    base, depth = F.substring_index("child_id", ".", 1), F.size(F.split("child_id", r"\."))
    manifest = notes.sparkSession.read.parquet(f"{path}/topic_hierarchy").groupBy(base.alias("model")).agg(F.count(F.lit(1)).alias("n_topics"), F.max(depth).alias("depth"), F.sum("n_chunks").alias("n_chunks"))
    manifest.write.mode("overwrite").json(f"{path}/manifest")


def load_model(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Terms of all models and sub-models, their ids put together from the folders, and the hierarchy."""
    terms = spark.read.schema("term string, n long, weight double, model string, sub string").parquet(f"{path}/topic_terms")
    return terms.select(F.concat_ws(".", "model", F.nullif("sub", F.lit(""))).alias("topic"), "term", "n", "weight"), spark.read.parquet(f"{path}/topic_hierarchy")


def load_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("model string, n_topics long, depth int, n_chunks long").json(f"{path}/manifest")


def gather_topics(notes: DataFrame, terms: DataFrame, n_words: int = 10, n_docs: int = 3) -> DataFrame:
    """Each topic with its label, keywords and best chunks; outliers left out.  notes need a confidence.

    Keywords are those of the deepest model that has the topic: its own, else its parent's, and so on up to its base.
    """
    w = Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 8)), "term")
    top = terms.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n_words).groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "term"))), lambda x: x["term"]).alias("keywords"))
    # written, as rows of known size are broadcast and no texts are sorted for them
    best = Scratch(notes.sparkSession, "gathered").write(topics.representatives(notes, n_docs), "best")
    best = best.join(notes.select("doc_id", "chunk_content"), "doc_id")
    best = best.groupBy(F.col("display_topic_id").alias("topic")).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "doc_id", "chunk_content"))), lambda x: x["chunk_content"]).alias("documents"))
    facts = notes.where("display_topic_id <> '-1'").groupBy(F.col("display_topic_id").alias("topic")).agg(F.min_by("cluster_label", "doc_id").alias("stored_label"), F.count(F.lit(1)).alias("n_chunks"))
    depth = F.explode(F.sequence(F.lit(1), F.size(F.split("topic", r"\."))))
    above = facts.select("topic", depth.alias("_d")).withColumn("_model", dotted_prefix(F.col("topic"), F.col("_d")))
    words = above.join(top.select(F.col("topic").alias("_model"), "keywords"), "_model").groupBy("topic").agg(F.max_by("keywords", "_d").alias("keywords"))
    none = F.array().cast("array<string>")
    out = facts.join(words, "topic", "left").join(best, "topic", "left")
    return out.select("topic", "stored_label", "n_chunks", F.coalesce("keywords", none).alias("keywords"), F.coalesce("documents", none).alias("documents"))


def ranked_documents(assigned: DataFrame, n: int = 5) -> DataFrame:
    """assigned: doc_id, topic, probability, title, creation_date, chunk_index.  The likeliest chunks of each topic, each (title, date, chunk) once."""
    once = Window.partitionBy("topic", "title", "creation_date", "chunk_index").orderBy(F.desc("probability"), "doc_id")
    best = Window.partitionBy("topic").orderBy(F.desc("probability"), "doc_id")
    out = assigned.withColumn("_o", F.row_number().over(once)).where("_o = 1").withColumn("rank", F.row_number().over(best).cast("long"))
    return out.where(F.col("rank") <= n).select("topic", "rank", "doc_id")


def find_texts(texts: DataFrame, notes: DataFrame) -> DataFrame:
    """texts: (text_id, text).  The chunk with that very text (smallest id), else one that contains it literally.

    Exact matches join by key.  Of the rest, a chunk that contains a text has all words from its second to its last but
    one; it is joined on the one of these that fewest chunks have, and then compared.  Only texts without such words
    are looked for in every chunk.
    """
    exact = texts.join(notes.select(F.col("chunk_content").alias("text"), "doc_id"), "text").groupBy("text_id").agg(F.min("doc_id").alias("doc_id"))
    rest = texts.join(exact.select("text_id"), "text_id", "left_anti").where("length(text) > 0")
    words = search_tokens(F.col("text"))
    rest = rest.withColumn("_w", F.when(F.size(words) > 2, F.array_distinct(F.slice(words, 2, F.size(words) - 2))).otherwise(F.array().cast("array<string>")))
    asked = rest.select("text_id", F.explode("_w").alias("term"))
    held = notes.select("doc_id", F.explode(F.array_distinct(search_tokens(F.col("chunk_content")))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    many = held.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    rarest = asked.join(many, "term", "left").groupBy("text_id").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "term")).alias("r"))
    rarest = rarest.where("r.n > 0").select("text_id", F.col("r.term").alias("term"))
    met = rarest.join(held, "term").join(rest.select("text_id", "text"), "text_id").join(notes.select("doc_id", "chunk_content"), "doc_id")
    inside = met.where(F.col("chunk_content").contains(F.col("text"))).select("text_id", "doc_id")
    bare = notes.select("doc_id", "chunk_content").join(rest.where(F.size("_w") == 0), F.col("chunk_content").contains(F.col("text"))).select("text_id", "doc_id")
    found = inside.unionByName(bare).groupBy("text_id").agg(F.min("doc_id").alias("doc_id"))
    return exact.withColumn("how", F.lit("exact")).unionByName(found.withColumn("how", F.lit("inside")))


def outlier_report(before: DataFrame, after: DataFrame, topic: str = "base_topic_id") -> DataFrame:
    """Outliers before and after, and the share that found a topic; 0 where there were none."""
    count = lambda df, name: df.agg(F.count(F.when(F.col(topic) == "-1", 1)).alias(name))
    both = count(before, "n_before").crossJoin(count(after, "n_after"))
    return both.withColumn("reduced_percent", F.when(F.col("n_before") > 0, F.round(100.0 * (F.col("n_before") - F.col("n_after")) / F.col("n_before"), 2)).otherwise(0.0))


