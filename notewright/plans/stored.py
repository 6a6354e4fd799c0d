"""Queries over stored structures: the full-text index with its updates, and keyed tables."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import catalog, clusters, models, topics
from notewright.operators.fulltext import FullText
from notewright.operators.graph import graph_reducer
from notewright.operators.keyed import KeyedTable
from notewright.operators.labelling import Replies, label_by_service, topic_request
from notewright.operators.maintained import ClusterAggregates
from notewright.operators.pairs import similar_pairs
from notewright.operators.trigrams import Trigrams
from notewright.operators.vectors import VectorLists
from notewright.plans.registry import ALL_NOTES, CENT, COLORS, CTD, CV, FACTS, KNN, META, NOTES, TEXT, current, full_text_of, query_vector, register
from notewright.sources.listing import ListedFiles, read_listing
from notewright.sources.shared import Scratch, files_mark
from notewright.sources.tables import chunk_texts, notes_view, order_tables

_TERMS = ", ".join(f"'{t}'" for t in TEXT.split())
_TOKENS = "regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9]+')"


def _ranked(rows: str) -> str:
    """BM25 of the chunks of rows (doc_id, c), by its formula."""
    return f"""words AS (SELECT doc_id, {_TOKENS.format('c')} AS w FROM ({rows})),
 size AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM words),
 tf AS (SELECT doc_id, len(w) AS l, term, count(*) AS f FROM (SELECT doc_id, w, unnest(w) AS term FROM words) WHERE term IN ({_TERMS}) GROUP BY ALL),
 df AS (SELECT term, count(*) AS d FROM tf GROUP BY 1),
 bm AS (SELECT doc_id, round(sum(ln(1 + (n - d + 0.5) / (d + 0.5)) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * l / mean))), 6) AS score, count(*) AS n_terms FROM tf JOIN df USING (term), size GROUP BY 1)"""


@register("SELECT doc_id, score, n_terms FROM bm", NOTES, _ranked("SELECT doc_id, chunk_content AS c FROM notes"))
def fts_bm25(spark, d):
    return full_text_of(spark, d).ranked(TEXT).withColumn("score", F.round("score", 6))


@register("SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM bm WHERE n_terms = 3 ORDER BY score DESC, doc_id LIMIT 20", NOTES, _ranked("SELECT doc_id, chunk_content AS c FROM notes"))
def fts_bm25_top(spark, d):
    best = full_text_of(spark, d).ranked(TEXT, every=True).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "doc_id").limit(20)
    return best.select("doc_id", "score", F.expr("row_number() OVER (ORDER BY score DESC, doc_id)").cast("long").alias("place"))


_PLACES = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {_TOKENS.format(c)} AS w FROM notes" for f, c in (("chunk", "chunk_content"), ("title", "title")))


@register(f"SELECT doc_id, field, count(*) AS n, min(i) - 1 AS first FROM ({_PLACES}), unnest(range(1, len(w) - 1)) AS u(i) WHERE w[i:i + 2] = [{_TERMS}] GROUP BY ALL", NOTES)
def fts_phrase_positions(spark, d):
    found = full_text_of(spark, d).phrase(TEXT)
    return found.select("doc_id", "field", F.size("starts").cast("long").alias("n"), F.get("starts", F.lit(0)).cast("long").alias("first"))


def _later(n: DataFrame) -> DataFrame:
    """Chunks of one note as they are after a change."""
    return n.where("title = 'src3'").withColumn("chunk_content", F.concat(F.lit("License! "), "chunk_content"))


@register("SELECT doc_id, score, n_terms FROM bm", NOTES, _ranked("SELECT doc_id, CASE WHEN title = 'src3' THEN concat('License! ', chunk_content) ELSE chunk_content END AS c FROM notes WHERE coalesce(lang, '') <> 'fr'"))
def fts_updated(spark, d):
    """Ranking after the index got the notes in two halves, then changes of a note, and lost those of a language."""
    n, index = chunk_texts(spark, d), FullText(spark, Scratch(spark, "updated-index").root, fanout=3)
    index.add(n.where("coalesce(lang, '') = 'en'"))
    index.add(n.where("coalesce(lang, '') <> 'en'"))
    index.add(_later(n))
    index.remove(n.where("lang = 'fr'").select("doc_id"))
    return index.ranked(TEXT).withColumn("score", F.round("score", 6))


@register("""SELECT title, creation_date, CASE WHEN title = 'src3' THEN '2024-02-01' ELSE modification_date END AS modification_date, doc_id, CASE WHEN title = 'src3' THEN 'License! ' || chunk_content ELSE chunk_content END AS chunk_content FROM notes WHERE coalesce(lang, '') <> 'fr'
 UNION ALL SELECT title, creation_date, modification_date, doc_id, 'again' FROM notes WHERE title = 'src4' AND coalesce(lang, '') <> 'fr'""", NOTES)
def keyed_updates(spark, d):
    """A table by note after an upsert, a delete and an append, each of which rewrites the buckets of its notes only."""
    n = notes_view(spark, d)
    columns = ["title", "creation_date", "modification_date", "doc_id", "chunk_content"]
    table = KeyedTable.create(n.select(*columns), Scratch(spark, "keyed").root, ["title", "creation_date"], 32)
    table.upsert(_later(n).withColumn("modification_date", F.lit("2024-02-01")).select(*columns))
    own = n.where("title = 'src4' AND coalesce(lang, '') <> 'fr'")
    table.append(own.withColumn("chunk_content", F.lit("again")).select(*columns))
    gone = n.where("lang = 'fr'").select("doc_id")
    table.replace(table.read().join(gone, "doc_id", "left_anti").select(*columns))
    return table.read()


# ---- vectors

_LISTS: dict[tuple[str, str, str], VectorLists] = {}


def lists_of(spark: SparkSession, d: str) -> VectorLists:
    """The stored lists of the notes' vectors, written by the first query of a session that needs them, and anew when their files change."""
    key = spark.sparkContext.applicationId, d, files_mark(spark, f"{d}/documents.parquet", f"{d}/embeddings.parquet")
    if key not in _LISTS:
        _LISTS[key] = VectorLists.build(notes_view(spark, d), Scratch(spark, "vectors").root)
    return _LISTS[key]


@register("SELECT doc_id, round(d, 4) AS distance FROM near ORDER BY d, doc_id LIMIT 20", NOTES, KNN)
def knn_lists(spark, d):
    """The nearest chunks, from the lists that can hold them."""
    return lists_of(spark, d).knn(query_vector(spark, d), 20).withColumn("distance", F.round("distance", 4))


@register("""SELECT query_id, doc_id, round(d, 4) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY d, doc_id) AS place FROM (
 SELECT a.doc_id AS query_id, b.doc_id, list_sum(list_transform(range(1, 65), lambda i: (CAST(a.vector[i] AS DOUBLE) - CAST(b.vector[i] AS DOUBLE)) * (CAST(a.vector[i] AS DOUBLE) - CAST(b.vector[i] AS DOUBLE)))) AS d
 FROM notes a, notes b WHERE a.doc_id % 50 = 0 AND a.vector IS NOT NULL AND b.vector IS NOT NULL) QUALIFY place <= 10""", NOTES)
def knn_lists_many(spark, d):
    """The ten nearest of every row whose id is divisible by 50, against all rows."""
    queries = notes_view(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector")
    return lists_of(spark, d).neighbours(queries, 10, probes=4, exact=True).withColumn("distance", F.round("distance", 4))


@register()
def knn_lists_probed(spark, d):
    """The same from the nearest six tenths of the lists alone, and so without a second pass; a test holds its recall against all distances.

    The test tables' vectors have no structure: they need that many lists for a recall of 0.9.
    """
    queries, lists = notes_view(spark, d).where("doc_id % 50 = 0").select(F.col("doc_id").alias("query_id"), "vector"), lists_of(spark, d)
    return lists.neighbours(queries, 10, probes=max(1, round(0.6 * len(lists.lists()[0]))))


@register()
def graph_projection(spark, d):
    """Five numbers of every chunk with a vector from the graph of its thirty nearest; tests hold its weights against plain loops and its neighbourhoods against PCA's."""
    reduced = graph_reducer(5)(notes_view(spark, d))
    return reduced.select("doc_id", *(F.round(F.get("reduced", F.lit(i)), 6).alias(f"g{i}") for i in range(5)))


# ---- substrings

_GRAMS: dict[tuple[str, str, str], Trigrams] = {}


def trigrams_of(spark: SparkSession, d: str) -> Trigrams:
    """The stored trigrams of the notes' chunks, kept like lists_of."""
    key = spark.sparkContext.applicationId, d, files_mark(spark, f"{d}/documents.parquet", f"{d}/embeddings.parquet")
    if key not in _GRAMS:
        _GRAMS[key] = Trigrams.build(chunk_texts(spark, d), Scratch(spark, "trigrams").root)
    return _GRAMS[key]


@register("SELECT doc_id FROM notes WHERE contains(lower(chunk_content), 'released') AND contains(lower(chunk_content), 'license')", NOTES)
def like_trigrams(spark, d):
    return trigrams_of(spark, d).like_all("Released of License").select("doc_id")


@register("SELECT doc_id, length(chunk_content) AS size FROM notes WHERE contains(lower(chunk_content), 'ral public lic')", NOTES)
def substring_trigrams(spark, d):
    """A piece that begins and ends within words."""
    return trigrams_of(spark, d).having(["ral Public lic"]).select("doc_id", F.length("text").alias("size"))


# ---- maintained aggregates

_FINAL = "notes AS (SELECT * REPLACE (CASE WHEN title = 'src3' THEN '2024-02-01' ELSE modification_date END AS modification_date, CASE WHEN title = 'src3' THEN '0' ELSE display_topic_id END AS display_topic_id, CASE WHEN title = 'src3' THEN 'Topic 0' ELSE cluster_label END AS cluster_label) FROM every_note WHERE coalesce(lang, '') <> 'fr')"


_KEPT: dict[tuple[str, str, str], ClusterAggregates] = {}


def maintained(spark: SparkSession, d: str) -> ClusterAggregates:
    """Kept like lists_of."""
    key = spark.sparkContext.applicationId, d, files_mark(spark, f"{d}/documents.parquet", f"{d}/embeddings.parquet")
    if key not in _KEPT:
        _KEPT[key] = changed_aggregates(spark, d)
    return _KEPT[key]


def changed_aggregates(spark: SparkSession, d: str) -> ClusterAggregates:
    """Built of all notes but one; then that one comes, another moves to cluster 0 with a later date, and those of a language go."""
    n = notes_view(spark, d)
    moved = n.where("title = 'src3'").withColumn("modification_date", F.lit("2024-02-01")).withColumn("display_topic_id", F.lit("0")).withColumn("cluster_label", F.lit("Topic 0"))
    after = n.where("title <> 'src3'").unionByName(moved)
    kept = ClusterAggregates.build(n.where("title <> 'src5'"), Scratch(spark, "aggregates").root)
    kept.change(n.where("title = 'src5'"), n.limit(0), n, 1)
    kept.change(moved, n.where("title = 'src3'"), after, 2)
    kept.change(n.limit(0), after.where("lang = 'fr'"), after.where("coalesce(lang, '') <> 'fr'"), 3)
    return kept


@register("SELECT cluster_id, CAST(dim AS BIGINT) AS dim, round(value, 4) AS value FROM cv", ALL_NOTES, _FINAL, CV)
def maintained_centroids(spark, d):
    return maintained(spark, d).centroid_values().withColumn("value", F.round("value", 4))


@register(META, ALL_NOTES, _FINAL, FACTS, COLORS)
def maintained_meta_clusters(spark, d):
    return maintained(spark, d).meta_clusters()


# ---- listings


@register("SELECT title, creation_date, modification_date, row_number() OVER (ORDER BY title, creation_date, modification_date) - 1 AS place FROM (SELECT DISTINCT title, creation_date, modification_date FROM notes WHERE greatest(creation_date, modification_date) > '2024-01-12') ORDER BY place LIMIT 60", NOTES)
def recent_listing(spark, d):
    """The first 60 notes after a date, from a source that is asked for windows of 50."""
    listed = Scratch(spark, "listing").write(current(spark, d), "notes")
    found = read_listing(spark, ListedFiles(listed._notewright_path), most=60)
    return found.where("last_date > '2024-01-12'").select("title", "creation_date", "modification_date", "place")


# ---- others


@register("SELECT doc_id, length(chunk_content) AS size, 64 AS dim FROM notes", NOTES)
def embedded_on_write(spark, d):
    """All chunks appended to a table of the catalog, their vectors made on the way."""
    own = Scratch(spark, "embedded")
    base = "notewright_" + own.root[-32:]
    spark.sql(f"CREATE DATABASE {base} LOCATION '{own.root}'")
    try:
        n = notes_view(spark, d).select("doc_id", "chunk_content", F.lit(None).cast("array<float>").alias("vector"))
        catalog.create(n.limit(0), f"{base}.notes", fresh=True)
        catalog.append_embedded(n, f"{base}.notes", models.HashingEmbedder(64))
        written = spark.table(f"{base}.notes").select("doc_id", F.length("chunk_content").alias("size"), F.size("vector").alias("dim"))
        return Scratch(spark, "embedded-copy").write(written, "copy")
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {base}.notes")
        spark.sql(f"DROP DATABASE {base}")


@register("SELECT f.cluster_id AS topic, array_to_string(list(ct.term ORDER BY round(ct.weight, 8) DESC, ct.term)[:10], ' ') AS keywords FROM facts f LEFT JOIN ct ON ct.topic = f.cluster_id WHERE f.cluster_id <> '-1' GROUP BY 1", NOTES, FACTS, "picked AS (SELECT * FROM notes)", CTD)
def topic_keywords(spark, d):
    """Keywords of every topic, of the deepest model that has it."""
    n = notes_view(spark, d).withColumn("confidence", F.col("chunk_index") % 7 / 7.0)
    return models.gather_topics(n, topics.class_tfidf(n, "display_topic_id")).select("topic", F.array_join("keywords", " ").alias("keywords"))


@register()
def diverse_topic_keywords(spark, d):
    """Ten keywords of every topic by marginal relevance; a test holds them against plain loops."""
    return topics.diverse_keywords(notes_view(spark, d))


@register("""SELECT name, count(*) AS n_rows, CASE WHEN name = 'notes' THEN 3 WHEN contains(name, 'test') THEN 0 WHEN regexp_matches(name, '[0-9]{10,}') THEN 2 ELSE 1 END AS tier FROM (
 SELECT CASE WHEN title = 'src0' THEN 'notes' WHEN title = 'src1' THEN 'notes_test' WHEN lang = 'fr' THEN 'notes_backup_17638464' || lpad(substr(title, 4), 2, '0') ELSE 'notes_' || title END AS name FROM notes) GROUP BY 1""", NOTES)
def tables_ordered(spark, d):
    """Tables as the notes' titles name them, in the order of a listing."""
    title = F.col("title")
    name = (
        F.when(title == "src0", "notes").when(title == "src1", "notes_test")
        .when(F.col("lang") == "fr", F.concat(F.lit("notes_backup_17638464"), F.lpad(F.substring(title, 4, 9), 2, "0"))).otherwise(F.concat(F.lit("notes_"), title))
    )
    return order_tables(notes_view(spark, d).groupBy(name.alias("name")).agg(F.count(F.lit(1)).alias("n_rows"))).select("name", "n_rows", "tier")


# ---- pairs


@register("""SELECT x.doc_id AS a, y.doc_id AS b, round(list_cosine_similarity(CAST(x.vector AS DOUBLE[]), CAST(y.vector AS DOUBLE[])), 4) AS similarity FROM notes x, notes y
 WHERE x.doc_id < y.doc_id AND x.vector IS NOT NULL AND y.vector IS NOT NULL AND list_cosine_similarity(CAST(x.vector AS DOUBLE[]), CAST(y.vector AS DOUBLE[])) >= 0.4""", NOTES)
def similar_chunks(spark, d):
    """All pairs of chunks with a cosine of 0.4 or more."""
    return similar_pairs(notes_view(spark, d), 0.4).withColumn("similarity", F.round("similarity", 4))


@register("SELECT a.cluster_id AS a, b.cluster_id AS b, round(list_cosine_similarity(a.centroid, b.centroid), 4) AS similarity FROM cent a, cent b WHERE a.cluster_id < b.cluster_id AND list_cosine_similarity(a.centroid, b.centroid) >= 0.3", NOTES, CENT)
def similar_centroids(spark, d):
    """All pairs of clusters whose centroids have a cosine of 0.3 or more."""
    c = clusters.centroids(notes_view(spark, d)).withColumn("n", F.expr("row_number() OVER (ORDER BY cluster_id)").cast("long"))  # a row a cluster
    names = c.select("n", "cluster_id")
    found = similar_pairs(c, 0.3, "n", "centroid")
    a, b = names.toDF("a", "name_a"), names.toDF("b", "name_b")
    return found.join(a, "a").join(b, "b").select(F.col("name_a").alias("a"), F.col("name_b").alias("b"), F.round("similarity", 4).alias("similarity"))


# ---- labels


def answer(body: dict, seconds: float) -> str:
    """Stands for a labelling service: slow for some first keywords, out of order for others."""
    first, *more = body["messages"][0]["content"].split("Keywords: ")[1].split("\n")[0].split(", ")
    if len(first) % 3 == 0:
        raise ConnectionError("out of order")
    if len(first) % 2 and seconds < 60:
        raise TimeoutError(f"no reply in {seconds} s")
    return "```json\n" + json.dumps({"label": f'"{" and ".join([first, *more[:1]])}."'}) + "\n```"


def topics_found(spark: SparkSession, d: str) -> DataFrame:
    n = notes_view(spark, d).withColumn("confidence", F.col("chunk_index") % 7 / 7.0)
    return models.gather_topics(n, topics.class_tfidf(n, "display_topic_id"))


def asked_topics(found: DataFrame, replies: Replies) -> DataFrame:
    plain = F.coalesce(F.nullif(F.array_join(F.slice("keywords", 1, 5), " & "), F.lit("")), F.concat(F.lit("Topic "), "topic"))
    return label_by_service(found, replies, answer, topic_request(F.col("keywords"), F.col("documents"), "labels"), plain)


_TOP = "top AS (SELECT f.cluster_id AS topic, coalesce(list(ct.term ORDER BY round(ct.weight, 8) DESC, ct.term) FILTER (ct.term IS NOT NULL), []) AS w FROM facts f LEFT JOIN ct ON ct.topic = f.cluster_id WHERE f.cluster_id <> '-1' GROUP BY 1)"
_OUT_OF_ORDER = "coalesce(length(w[1]), 0) % 3 = 0"


@register(f"SELECT topic, CASE WHEN len(w) = 0 THEN 'Topic ' || topic WHEN {_OUT_OF_ORDER} THEN array_to_string(w[:5], ' & ') ELSE array_to_string(w[:2], ' and ') END AS label, CASE WHEN {_OUT_OF_ORDER} THEN 'fallback' ELSE 'service' END AS label_source FROM top", NOTES, FACTS, "picked AS (SELECT * FROM notes)", CTD, _TOP)
def labels_by_service(spark, d):
    """A label for every topic from a service that fails, and the keywords where it never replies."""
    return asked_topics(topics_found(spark, d), Replies(spark, Scratch(spark, "replies").root)).select("topic", "label", "label_source")


@register(f"SELECT topic, CASE WHEN {_OUT_OF_ORDER} THEN 6 WHEN length(w[1]) % 2 = 1 THEN 1 ELSE 0 END AS failures FROM top", NOTES, FACTS, "picked AS (SELECT * FROM notes)", CTD, _TOP)
def labels_resumed(spark, d):
    """How often each topic's request has failed after all topics were labelled twice: what has a reply isn't asked again."""
    replies = Replies(spark, Scratch(spark, "replies").root)
    topics_known = Scratch(spark, "topics").write(topics_found(spark, d), "found")  # both times the same, gathered once
    asked_topics(topics_known, replies)
    found = asked_topics(topics_known, replies).select("topic", topic_request(F.col("keywords"), F.col("documents"), "labels").alias("request"))
    return found.join(replies.read(), "request").select("topic", F.col("failures").cast("long").alias("failures"))
