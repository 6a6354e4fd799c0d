"""All registered queries of the note analytics with fixed parameters, and their SQL on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions import numbers as num
from notewright.functions import text as tx
from notewright.operators import chunking, clusters, density, hierarchy, incremental, interactions, layout, models, notes, search, topics, words
from notewright.operators.fulltext import FullText
from notewright.operators.memberships import Memberships
from notewright.sources.shared import Scratch, files_mark
from notewright.sources.tables import chunk_texts, events_view, interactions_table, list_tables, normalize_notes, notes_view, open_window_titles, order_tables, read, scan

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOW, HIGH, DAY = "2024-01-10", "2024-01-15", "2024-01-12"
TEXT = "general public license"

NOTES = """notes AS (SELECT *, base_topic_id AS cluster_id, concat('Topic ', display_topic_id) AS cluster_label, concat('Group ', meta_cluster_id) AS meta_cluster_label,
 concat_ws('_', title, chunk_index) AS unique_key, concat_ws('|||', title, creation_date, modification_date) AS note_key FROM (
 SELECT d.doc_id, d.source AS title, d.lang, d.text AS chunk_content,
  CAST(row_number() OVER (PARTITION BY d.source, d.lang ORDER BY d.doc_id) - 1 AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY d.source, d.lang) AS INT) AS total_chunks,
  concat('2024-01-', lpad(CAST(k + 1 AS VARCHAR), 2, '0')) AS creation_date, concat('2024-01-', lpad(CAST(k + 3 AS VARCHAR), 2, '0')) AS modification_date, e.embedding AS vector,
  CASE WHEN e.label IS NULL THEN '-1' ELSE CAST(e.label % 5 AS VARCHAR) END AS base_topic_id,
  CASE WHEN e.label IS NULL THEN '-1' WHEN e.label >= 5 THEN concat(CAST(e.label % 5 AS VARCHAR), '.', CAST(e.label AS VARCHAR)) ELSE CAST(e.label AS VARCHAR) END AS display_topic_id,
  CASE WHEN e.label IS NULL THEN '-1' ELSE CAST(e.label % 3 AS VARCHAR) END AS meta_cluster_id
 FROM (SELECT *, (CAST(substr(source, 4) AS INT) + CASE lang WHEN 'en' THEN 0 WHEN 'fr' THEN 7 WHEN 'de' THEN 14 ELSE 21 END) % 28 AS k FROM documents) d LEFT JOIN embeddings e ON e.vec_id = d.doc_id))"""
EV = """ev AS (SELECT *, substr(dt, 1, 10) AS day FROM (SELECT concat('src', CAST(user_id % 25 AS VARCHAR)) AS title, strftime(ts, '%Y-%m-%dT%H:%M:%S.%fZ') AS dt,
 CASE WHEN event_type = 'purchase' THEN 'modified' ELSE 'opened' END AS type FROM events WHERE event_type IN ('view', 'click', 'purchase')))"""
CV = "cv AS (SELECT display_topic_id AS cluster_id, i AS dim, avg(CAST(vector[i + 1] AS DOUBLE)) AS value FROM notes, (SELECT unnest(range(64)) AS i) WHERE vector IS NOT NULL GROUP BY ALL)"
CENT = f"{CV}, cent AS (SELECT cluster_id, list(value ORDER BY dim) AS centroid FROM cv GROUP BY ALL)"
FACTS = """facts AS (SELECT display_topic_id AS cluster_id, count(*) AS chunk_count, min_by(cluster_label, doc_id) AS label, min_by(meta_cluster_id, doc_id) AS meta_cluster_id,
 min_by(meta_cluster_label, doc_id) AS meta_label, max(substr(modification_date, 1, 10)) AS last_modified, min(doc_id) AS first_doc_id FROM notes GROUP BY 1)"""
COLORS = """cc AS (SELECT display_topic_id AS cluster_id, avg(CAST(vector[1] AS DOUBLE)) AS c0, avg(CAST(vector[2] AS DOUBLE)) AS c1 FROM notes WHERE vector IS NOT NULL GROUP BY 1),
 colors AS (SELECT n.cluster_id, CASE WHEN dx IS NULL THEN '#6b7280' WHEN abs(dx) < 1e-12 AND abs(dy) < 1e-12 THEN 'hsl(210, 75%, 45%)'
  ELSE concat('hsl(', CAST(round_even((degrees(atan2(dy, dx)) + 360) % 360, 0) AS INT), ', 75%, 45%)') END AS color
  FROM (SELECT DISTINCT display_topic_id AS cluster_id FROM notes) n LEFT JOIN (SELECT cluster_id, c0 - avg(c0) OVER () AS dx, c1 - avg(c1) OVER () AS dy FROM cc) p USING (cluster_id))"""
WORD = r"list_filter(regexp_extract_all(lower(chunk_content), '[\p{L}\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z]{2,}'))"
QV = "qv AS (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0)"
KNN = f"""{QV}, near AS (SELECT doc_id, unique_key, d FROM (SELECT doc_id, unique_key, list_sum(list_transform(range(1, 65), lambda i: (CAST(vector[i] AS DOUBLE) - q[i]) * (CAST(vector[i] AS DOUBLE) - q[i]))) AS d
 FROM notes, qv WHERE vector IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY d, doc_id) = 1)"""
STOP = ", ".join(f"'{w}'" for w in tx.SEARCH_STOP_WORDS)
PATCHED = "cached AS (SELECT DISTINCT title, creation_date, CASE WHEN lang = 'fr' THEN '2023-12-31' ELSE modification_date END AS modification_date FROM notes WHERE title <> 'src3'), cur AS (SELECT DISTINCT title, creation_date, modification_date FROM notes)"


def sql(text: str, *ctes: str) -> str:
    return (f"WITH {', '.join(ctes)} " if ctes else "") + text


def register(oracle: str | None = None, *ctes: str):  # noqa: ANN201
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if oracle:
            ORACLE_SQL[f.__name__] = sql(oracle, *ctes)
        return f

    return add


def stored(spark: SparkSession, d: str) -> DataFrame:
    return interactions_table(events_view(spark, d))


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return [float(x) for x in read(spark, d, "embeddings").where("vec_id = 0").first()["embedding"]]


_INDEXES: dict[tuple[str, str, str], FullText] = {}


def full_text_of(spark: SparkSession, d: str) -> FullText:
    """The stored full-text index of the notes: written to the shared folder by the first query of a session that needs it, and anew when their files change."""
    key = spark.sparkContext.applicationId, d, files_mark(spark, f"{d}/documents.parquet", f"{d}/embeddings.parquet")
    have = _INDEXES.get(key)
    if have is None or not have.pointer.version():
        have = _INDEXES[key] = FullText(spark, Scratch(spark, "index").root)
        have.add(chunk_texts(spark, d))
    return have


def index_of(spark: SparkSession, d: str) -> DataFrame:
    return full_text_of(spark, d).postings()


# ---- scans, projections, lookups

COLUMNS = ["unique_key", "title", "creation_date", "modification_date", "chunk_index", "total_chunks"]


@register("SELECT unique_key, title, creation_date, modification_date, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(total_chunks AS BIGINT) AS total_chunks, display_topic_id AS cluster_id, base_topic_id, display_topic_id, cluster_label, meta_cluster_id, meta_cluster_label FROM notes", NOTES)
def points_projection(spark, d):
    return notes.points(notes_view(spark, d))


@register("SELECT doc_id, CAST(chunk_index AS INT) AS chunk_index, CAST(count(*) OVER (PARTITION BY title) AS INT) AS total_chunks, CASE WHEN lang = 'fr' THEN 'Unclustered' ELSE cluster_label END AS cluster_label, CASE WHEN lang = 'de' THEN '-1' ELSE cluster_id END AS cluster_id, 'Uncategorized' AS meta_cluster_label FROM notes", NOTES)
def normalized_notes(spark, d):
    raw = notes_view(spark, d).drop("total_chunks", "meta_cluster_label", "unique_key")
    raw = raw.withColumn("chunk_index", F.col("chunk_index").cast("string")).withColumn("cluster_label", F.when(F.col("lang") != "fr", F.col("cluster_label")))
    raw = raw.withColumn("cluster_id", F.when(F.col("lang") == "de", "nan").otherwise(F.col("cluster_id")))
    return normalize_notes(raw).select("doc_id", "chunk_index", "total_chunks", "cluster_label", "cluster_id", "meta_cluster_label")


@register("SELECT count(*) AS n FROM documents")
def scan_counts(spark, d):
    return scan(read(spark, d, "documents"), ["doc_id"], 100_000_000).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT title, creation_date, modification_date, CAST(chunk_index AS BIGINT) AS chunk_index, CAST(total_chunks AS BIGINT) AS total_chunks, chunk_content AS content FROM notes WHERE title = 'src2' AND chunk_index = 0 ORDER BY creation_date, doc_id LIMIT 1", NOTES)
def note_content_lookup(spark, d):
    return notes.note_content(notes_view(spark, d), "src2", 0)


@register("SELECT title, creation_date, modification_date, count(*) AS n_chunks FROM notes WHERE title = 'src1' GROUP BY 1, 2, 3 ORDER BY (CASE WHEN notes.creation_date = '2024-01-09' THEN 0 ELSE 1 END), notes.creation_date LIMIT 1", NOTES)
def point_fetch(spark, d):
    return notes.point_fetch(notes_view(spark, d), "src1", "2024-01-09")


@register("SELECT title, coalesce(n, 0) AS n, coalesce(dates, '') AS dates, CASE WHEN n IS NULL THEN 'none' WHEN n = 1 THEN 'one' ELSE 'many' END AS outcome FROM (SELECT unnest(['src1', 'src2', 'missing']) AS title) LEFT JOIN (SELECT title, count(*) AS n, string_agg(creation_date, ',' ORDER BY creation_date) AS dates FROM (SELECT DISTINCT title, creation_date FROM notes) GROUP BY 1) USING (title)", NOTES)
def title_lookup(spark, d):
    return notes.title_lookup(notes_view(spark, d), ["src1", "src2", "missing"])


@register("SELECT DISTINCT title FROM (SELECT CASE WHEN lang = 'fr' THEN 'Notes' WHEN lang = 'de' THEN ' ' ELSE source END AS title FROM documents) WHERE title NOT IN ('Notes', ' ')")
def open_windows(spark, d):
    t = F.when(F.col("lang") == "fr", "Notes").when(F.col("lang") == "de", " ").otherwise(F.col("source"))
    return open_window_titles(read(spark, d, "documents").select(t.alias("title")))


@register("SELECT count(DISTINCT title) AS titles, count(DISTINCT (title, creation_date)) AS notes, count(*) AS chunks, round(count(*) / count(DISTINCT (title, creation_date)), 4) AS chunks_per_note FROM notes", NOTES)
def list_notes_counts(spark, d):
    return notes.counts(notes_view(spark, d))


@register("SELECT title, creation_date, count(*) AS n_chunks FROM notes GROUP BY ALL ORDER BY n_chunks DESC, title, creation_date LIMIT 20", NOTES)
def chunks_per_note_top20(spark, d):
    return notes.chunks_per_note(notes_view(spark, d))


@register("SELECT cluster_id, count(DISTINCT (title, creation_date)) AS n_notes, min_by(cluster_label, doc_id) AS cluster_label FROM notes GROUP BY 1", NOTES)
def list_clusters(spark, d):
    return notes.list_clusters(notes_view(spark, d))


@register("SELECT title, creation_date, min(doc_id) AS first_doc_id, min_by(modification_date, doc_id) AS modification_date FROM notes WHERE cluster_id = '1' GROUP BY 1, 2", NOTES)
def notes_in_cluster(spark, d):
    return notes.notes_in_cluster(notes_view(spark, d), "1")


@register("SELECT doc_id, base_topic_id, display_topic_id, cluster_label = concat('Topic ', base_topic_id) AS has_base_label FROM notes WHERE contains(display_topic_id, '.')", NOTES)
def hierarchical_rows(spark, d):
    return notes.hierarchical_rows(notes_view(spark, d))


@register("SELECT display_topic_id, count(*) AS n FROM notes GROUP BY 1 ORDER BY n DESC, 1 LIMIT 20", NOTES)
def display_id_distribution(spark, d):
    return notes.display_id_distribution(notes_view(spark, d))


@register("SELECT title, max_by(creation_date, doc_id) AS creation_date, max(doc_id) AS doc_id FROM notes GROUP BY 1", NOTES)
def last_row_per_title(spark, d):
    return notes.last_per_title(notes_view(spark, d))


# ---- clusters


@register("SELECT cluster_id, CAST(dim AS BIGINT) AS dim, round(value, 4) AS value FROM cv", NOTES, CV)
def cluster_centroids(spark, d):
    return clusters.centroid_values(notes_view(spark, d)).withColumn("value", F.round("value", 4))


@register("SELECT dim, round(avg(value), 4) AS value FROM cv GROUP BY 1", NOTES, CV)
def global_centroid(spark, d):
    return clusters.centroid_values(notes_view(spark, d)).groupBy("dim").agg(F.round(F.avg("value"), 4).alias("value"))


@register("SELECT a.cluster_id AS a, b.cluster_id AS b, round(list_cosine_similarity(a.centroid, b.centroid), 4) AS similarity FROM cent a, cent b WHERE a.cluster_id < b.cluster_id", NOTES, CENT)
def centroid_pairwise_cosine(spark, d):
    return clusters.pairwise_cosine(notes_view(spark, d))


@register("SELECT * FROM colors", NOTES, COLORS)
def cluster_colors(spark, d):
    return clusters.colors(notes_view(spark, d))


@register("SELECT b.cluster_id, f.label, f.chunk_count, round(greatest(0.0, least(1.0, list_cosine_similarity(a.centroid, b.centroid))), 4) AS similarity FROM cent a JOIN facts fa ON fa.cluster_id = a.cluster_id, cent b JOIN facts f ON f.cluster_id = b.cluster_id WHERE a.cluster_id = '1' AND b.cluster_id <> '1' AND f.meta_cluster_id = fa.meta_cluster_id AND list_cosine_similarity(a.centroid, b.centroid) >= -1.0", NOTES, CENT, FACTS)
def similar_clusters(spark, d):
    return clusters.similar_clusters(notes_view(spark, d), "1", least=0.0)


META = "SELECT meta_cluster_id, meta_cluster_label, meta_last_modified, meta_chunks, cluster_id, label, chunk_count, color FROM facts JOIN colors USING (cluster_id) JOIN (SELECT meta_cluster_id, min_by(meta_label, first_doc_id) AS meta_cluster_label, max(last_modified) AS meta_last_modified, CAST(sum(chunk_count) AS BIGINT) AS meta_chunks FROM facts GROUP BY 1) m USING (meta_cluster_id)"
RANGE = f"allowed AS (SELECT title FROM ev WHERE day BETWEEN '{LOW}' AND '{HIGH}' UNION SELECT title FROM every_note WHERE creation_date BETWEEN '{LOW}' AND '{HIGH}' OR modification_date BETWEEN '{LOW}' AND '{HIGH}')"
ALL_NOTES = NOTES.replace("notes AS (", "every_note AS (", 1)


@register(META, NOTES, FACTS, COLORS)
def meta_clusters(spark, d):
    return clusters.meta_clusters(notes_view(spark, d))


@register(META, ALL_NOTES, "notes AS (SELECT * FROM every_note WHERE creation_date BETWEEN '2024-01-10' AND '2024-01-15' OR modification_date BETWEEN '2024-01-10' AND '2024-01-15')", FACTS, COLORS)
def meta_clusters_filtered(spark, d):
    return clusters.meta_clusters(notes_view(spark, d).where(notes.in_dates(LOW, HIGH)))


@register(META, ALL_NOTES, "notes AS (SELECT * FROM every_note WHERE display_topic_id IN ('1', '2', '1.6'))", FACTS, COLORS)
def meta_clusters_by_ids(spark, d):
    return clusters.meta_clusters(clusters.of_clusters(notes_view(spark, d), "1, 2,1.6,"))


HITS = """hits AS (SELECT display_topic_id AS cluster_id, meta_cluster_id, round(list_sum(list_transform(range(1, 65), lambda i: (CAST(vector[i] AS DOUBLE) - q[i]) * (CAST(vector[i] AS DOUBLE) - q[i]))), 6) AS distance
 FROM notes, (SELECT CAST(embedding AS DOUBLE[]) AS q FROM embeddings WHERE vec_id = 0) WHERE vector IS NOT NULL AND display_topic_id <> '2')"""


def hits(spark: SparkSession, d: str) -> DataFrame:
    """Every chunk with a vector as a hit, by its distance from the query's; cluster 2 has none."""
    far = F.round(num.squared_distance(F.col("vector"), num.literal_vector(query_vector(spark, d))), 6)
    return notes_view(spark, d).where("vector is not null and display_topic_id <> '2'").select(F.col("display_topic_id").alias("cluster_id"), "meta_cluster_id", far.alias("distance"))


@register("SELECT meta_cluster_id, min_by(meta_label, first_doc_id) AS label, round(avg(dd), 6) AS avg_distance, count(*) AS n_clusters, max(last_modified) AS last_modified FROM facts LEFT JOIN (SELECT cluster_id, avg(CAST(distance AS DOUBLE)) AS dd FROM hits GROUP BY 1) USING (cluster_id) GROUP BY 1", NOTES, FACTS, HITS)
def meta_search_sort(spark, d):
    return clusters.meta_search_sort(notes_view(spark, d), hits(spark, d).select("cluster_id", "distance"))


@register("SELECT meta_cluster_id, round(avg(dd), 6) AS avg_distance, CAST(sum(n) AS BIGINT) AS n_hits, count(*) AS n_clusters FROM (SELECT meta_cluster_id, cluster_id, avg(CAST(distance AS DOUBLE)) AS dd, count(*) AS n FROM hits WHERE cluster_id NOT IN ('', '-1') GROUP BY 1, 2) GROUP BY 1", NOTES, HITS)
def tree_search_sort(spark, d):
    return clusters.tree_search_sort(hits(spark, d))


SIDE = "SELECT note_key, title, CAST(chunk_index AS BIGINT) AS chunk_index, display_topic_id, display_topic_id = '1' AS in_cluster, CASE WHEN display_topic_id = '1' THEN length(chunk_content) ELSE 0 END AS text_length FROM (SELECT *, row_number() OVER (PARTITION BY note_key, chunk_index ORDER BY doc_id) AS r FROM picked) WHERE r = 1"


@register(SIDE, NOTES, "picked AS (SELECT * FROM notes WHERE note_key IN (SELECT note_key FROM notes WHERE display_topic_id = '1'))")
def cluster_sidebar(spark, d):
    return clusters.sidebar(notes_view(spark, d), "1")


@register(SIDE, NOTES, EV, RANGE.replace("every_note", "notes"), "picked AS (SELECT * FROM notes WHERE display_topic_id = '1' AND title IN (SELECT title FROM allowed))")
def cluster_sidebar_filtered(spark, d):
    n = notes_view(spark, d)
    return clusters.sidebar(n, "1", interactions.titles_in_range(n, stored(spark, d), LOW, HIGH))


@register("SELECT m.cluster_id, k.first_key AS note_key, CAST(c.chunk_index AS BIGINT) AS chunk_index, c.display_topic_id = m.cluster_id AS in_cluster FROM (SELECT DISTINCT display_topic_id AS cluster_id, title FROM picked) m JOIN (SELECT title, min_by(note_key, doc_id) AS first_key FROM picked GROUP BY 1) k USING (title) JOIN (SELECT * FROM picked QUALIFY row_number() OVER (PARTITION BY note_key, chunk_index ORDER BY doc_id) = 1) c ON c.note_key = k.first_key", NOTES, EV, RANGE.replace("every_note", "notes"), "picked AS (SELECT * FROM notes WHERE title IN (SELECT title FROM allowed))")
def filtered_notes_all(spark, d):
    n = notes_view(spark, d)
    return clusters.filtered_notes_all(n, interactions.titles_in_range(n, stored(spark, d), LOW, HIGH))


PRIMARY = "prim AS (SELECT note_key, display_topic_id AS primary_cluster FROM (SELECT note_key, display_topic_id, count(*) AS n, min(chunk_index) AS f FROM notes GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY note_key ORDER BY n DESC, f) = 1)"


@register("SELECT * FROM prim", NOTES, PRIMARY)
def history_primary_cluster(spark, d):
    return clusters.primary_cluster(notes_view(spark, d))


@register("SELECT title, creation_date, modification_date, min_by(meta_cluster_id, chunk_index) AS meta_cluster_id FROM notes GROUP BY 1, 2, 3", NOTES)
def first_meta_per_note(spark, d):
    return clusters.first_meta(notes_view(spark, d))


@register("SELECT cluster_id, label, chunk_count FROM facts WHERE cluster_id IN ('1', '2', '3.8')", NOTES, FACTS)
def selected_cluster_summaries(spark, d):
    return clusters.selected_summaries(notes_view(spark, d), ["1", "2", "3.8"])


# ---- interactions


@register("SELECT DISTINCT day FROM ev", EV)
def history_dates(spark, d):
    return interactions.history_dates(stored(spark, d))


@register(f"SELECT title, min(dt) AS opened_at, max(dt) AS last_opened_at, count(*) AS opened_count FROM ev WHERE day = '{DAY}' GROUP BY 1", EV)
def history_titles(spark, d):
    return interactions.history_by_title(stored(spark, d), DAY)


@register(f"SELECT note_key, CAST(chunk_index AS BIGINT) AS chunk_index, display_topic_id, primary_cluster, display_topic_id = primary_cluster AS in_cluster, opened_at, last_opened_at, opened_count FROM notes JOIN prim USING (note_key) JOIN (SELECT title, min(dt) AS opened_at, max(dt) AS last_opened_at, count(*) AS opened_count FROM ev WHERE day = '{DAY}' GROUP BY 1) USING (title)", NOTES, EV, PRIMARY)
def history_day(spark, d):
    return interactions.history_day(notes_view(spark, d), stored(spark, d), DAY)


@register("SELECT title, max(dt) AS last_opened FROM ev GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50", EV)
def interactions_list(spark, d):
    return interactions.recent(stored(spark, d))


@register("SELECT title, max(dt) AS last_opened, count(*) AS n_events FROM ev WHERE title = 'src4' GROUP BY 1", EV)
def interaction_lookup(spark, d):
    return interactions.of_title(stored(spark, d), "src4")


@register("SELECT title FROM allowed WHERE title IN (SELECT title FROM notes)", NOTES, EV, RANGE.replace("every_note", "notes"))
def interactions_by_date(spark, d):
    return interactions.by_date(notes_view(spark, d), stored(spark, d), LOW, HIGH)


@register(f"SELECT place, title, last_day FROM (SELECT unnest([0, 1, 2, 3]) AS place, unnest(['src3', 'missing', 'src1', 'src3']) AS title) LEFT JOIN (SELECT title, max(day) AS last_day FROM ev WHERE day BETWEEN '{LOW}' AND '{HIGH}' GROUP BY 1) USING (title)".replace("unnest([0, 1, 2, 3])", "CAST(unnest([0, 1, 2, 3]) AS BIGINT)"), EV)
def interactions_by_titles(spark, d):
    return interactions.by_titles(stored(spark, d), ["src3", "missing", "src1", "src3"], LOW, HIGH)


@register("SELECT title, max(dt) AS last_opened, count(*) AS n_events FROM ev WHERE day < '2024-01-20' OR title IN (SELECT title FROM notes) GROUP BY 1", NOTES, EV)
def interaction_upsert(spark, d):
    e = events_view(spark, d)
    old, new = e.where("dt < '2024-01-20'"), e.where("dt >= '2024-01-20'")
    return interactions.log_interactions(interactions_table(old), new, notes_view(spark, d)).select("title", "last_opened", "n_events")


@register("SELECT title, max(dt) AS last_opened, count(*) AS n_events FROM (SELECT title, dt FROM ev UNION ALL SELECT unnest(['src1', 'src99']), '2024-02-01T00:00:00.000000Z') GROUP BY 1", EV)
def interaction_bucket_merge(spark, d):
    e = events_view(spark, d)
    buckets = interactions_table(e.where("dt < '2024-01-15'")).unionByName(interactions_table(e.where("dt >= '2024-01-15'")))
    titles = spark.createDataFrame([("src1",), ("src99",), ("src1",)], "title string")
    return interactions.merge_open(buckets, titles, "2024-02-01T00:00:00.000000Z").select("title", "last_opened", "n_events")


# ---- words


WC = f"wc AS (SELECT word, count(*) AS n FROM (SELECT unnest({WORD}) AS word FROM notes) GROUP BY 1)"


@register("SELECT word, n, round(100.0 * n / (SELECT sum(n) FROM wc), 4) AS percent, CAST(floor(30 * n / (SELECT max(n) FROM wc)) AS BIGINT) AS bar_length FROM wc ORDER BY n DESC, word LIMIT 50", NOTES, WC)
def common_words(spark, d):
    return words.common_words(notes_view(spark, d))


@register("SELECT row_number() OVER (ORDER BY n DESC, word) AS rank, word, n, round(100.0 * CAST(sum(n) OVER (ORDER BY n DESC, word ROWS UNBOUNDED PRECEDING) AS DOUBLE) / (SELECT sum(n) FROM wc), 4) AS cumulative_percent FROM (SELECT * FROM wc ORDER BY n DESC, word LIMIT 50)", NOTES, WC)
def word_cumulative(spark, d):
    return words.cumulative_words(notes_view(spark, d))


@register("SELECT word, n FROM wc WHERE n / (SELECT sum(n) FROM wc) > 0.001", NOTES, WC)
def high_freq_stopwords(spark, d):
    return words.frequent_words(notes_view(spark, d))


@register(r"SELECT doc_id, md5(coalesce(list_aggregate(list_filter(string_split(trim(regexp_replace(chunk_content, '\s+', ' ', 'g')), ' '), lambda w: NOT list_contains(ws, lower(w))), 'string_agg', ' '), '')) AS clean_md5 FROM notes, (SELECT list(word) AS ws FROM wc WHERE n / (SELECT sum(n) FROM wc) > 0.001)", NOTES, WC)
def stopword_removed_text(spark, d):
    n = notes_view(spark, d)
    return words.without_words(n, words.frequent_words(n)).select("doc_id", F.md5("clean").alias("clean_md5"))


# ---- text


@register(r"""SELECT page_id, md5(regexp_replace(x, '^[\s\x{00A0}\x{FEFF}]+|[\s\x{00A0}\x{FEFF}]+$', '', 'g')) AS plain_md5 FROM (SELECT page_id, """ + "regexp_replace(" * 27 + r"""html,
 '(?is)<script[^>]*>.*?</script>', '', 'g'), '(?is)<style[^>]*>.*?</style>', '', 'g'), '(?i)<br\s*/?>', chr(10), 'g'), '(?i)</p>', chr(10) || chr(10), 'g'), '(?i)</div>', chr(10), 'g'), '(?i)</h[1-6]>', chr(10) || chr(10), 'g'), '(?i)</li>', chr(10), 'g'), '(?i)</tr>', chr(10), 'g'), '(?i)</td>', ' | ', 'g'),
 '(?i)</?ul[^>]*>', chr(10), 'g'), '(?i)</?ol[^>]*>', chr(10), 'g'), '(?i)<li[^>]*>', '• ', 'g'), '(?i)<strong[^>]*>(.*?)</strong>', '**\1**', 'g'), '(?i)<b[^>]*>(.*?)</b>', '**\1**', 'g'), '(?i)<em[^>]*>(.*?)</em>', '*\1*', 'g'), '(?i)<i[^>]*>(.*?)</i>', '*\1*', 'g'),
 '(?i)<a[^>]*href=["'']([^"'']+)["''][^>]*>(.*?)</a>', '\2 (\1)', 'g'), '<[^>]*>', '', 'g'), '&nbsp;', ' ', 'g'), '&amp;', '&', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&quot;', '"', 'g'), '&#39;', '''', 'g'), '&[a-zA-Z]+;', '', 'g'), '\n\s*\n\s*\n', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g') AS x FROM pages)""")
def html_to_text(spark, d):
    return read(spark, d, "pages").select("page_id", F.md5(tx.html_to_text(F.col("html"))).alias("plain_md5"))


@register(r"""SELECT doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '[^\w\s\-.,!?;:()\[\]{}''"]', ' ', 'g'), '\s+', ' ', 'g'))) AS clean_md5 FROM documents""")
def embed_clean_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.embed_clean(F.col("text"))).alias("clean_md5"))


@register(r"""SELECT doc_id, md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(replace(replace(replace(text, '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', chr(160)), '&amp;', '&'), 'http\S+', '', 'g'), 'data:image/[a-zA-Z]+;base64,[^\s"'')]+', '', 'g'), '!\[.*?\]\([^)]{100,}\)', '', 'g'), '\S{100,}', '', 'g')) AS clean_md5 FROM documents""")
def clean_note_content(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.clean_note(F.col("text"))).alias("clean_md5"))


@register(r"""SELECT doc_id, md5(array_to_string(list_slice(w, greatest(1, len(w) - 24), len(w)), ' ')) AS tail_md5, CAST(ceil(length(text) / 4) AS BIGINT) AS estimate FROM (SELECT doc_id, text, regexp_split_to_array(text, '\s+') AS w FROM documents)""")
def overlap_text(spark, d):
    return read(spark, d, "documents").select("doc_id", F.md5(tx.overlap_text(F.col("text"))).alias("tail_md5"), tx.estimate_tokens(F.col("text")).alias("estimate"))


#: Windows of 1600 characters, 200 of them shared, of each (doc_id, i, text): begin of each and its text.
_CUT = "greatest(CASE WHEN strpos(reverse(part), ' ') > 0 THEN length(part) - strpos(reverse(part), ' ') ELSE -1 END, CASE WHEN strpos(reverse(part), chr(10)) > 0 THEN length(part) - strpos(reverse(part), chr(10)) ELSE -1 END)"
_STRIP = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
WINDOWS = f"""win AS (SELECT doc_id, i, text, length(text) AS len, 0 AS start, 0 AS k FROM whole WHERE length(text) > 1600
  UNION ALL SELECT doc_id, i, text, len, CAST(greatest(e - 200, 0) AS INT), k + 1 FROM (SELECT *, CASE WHEN start + 1600 < len AND {_CUT} > start + 1120 THEN start + {_CUT} + 1 ELSE least(start + 1600, len) END AS e FROM (SELECT *, substr(text, start + 1, 1600) AS part FROM win)) WHERE e < len),
 cutw AS (SELECT doc_id, i, k, {_STRIP.format(f"CASE WHEN start + 1600 < len AND {_CUT} > start + 1120 THEN substr(part, 1, {_CUT}) ELSE part END")} AS chunk FROM (SELECT *, substr(text, start + 1, 1600) AS part FROM win))"""
#: Paragraphs, or else sentences, of each long document, packed one after another; a chunk ends where the next segment would pass 400 tokens.
PACK = f"""segs AS (SELECT doc_id, CASE WHEN len(p) = 1 THEN s ELSE p END AS g FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n\\s*\\n'), lambda x: regexp_matches(x, '\\S')) AS p,
   list_filter(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: regexp_matches(x, '\\S')) AS s FROM documents WHERE regexp_matches(text, '\\S') AND length(text) > 1600)),
 fold AS (SELECT doc_id, g, 0 AS i, '' AS held, CAST(0 AS BIGINT) AS size, CAST(NULL AS VARCHAR) AS done, CAST(NULL AS VARCHAR) AS wide FROM segs
  UNION ALL SELECT doc_id, g, i + 1, CASE WHEN own > 400 THEN '' ELSE now END, CASE WHEN own > 400 THEN 0 WHEN full_ THEN CAST(ceil(length(now) / 4) AS BIGINT) ELSE size + own END, CASE WHEN full_ THEN {_STRIP.format("held")} END, CASE WHEN own > 400 THEN x END FROM (
   SELECT *, CASE WHEN full_ THEN CASE WHEN tail <> '' THEN tail || chr(10) || chr(10) || x ELSE x END WHEN held <> '' THEN held || chr(10) || chr(10) || x ELSE x END AS now FROM (
    SELECT *, held <> '' AND size + own > 400 AS full_, array_to_string(regexp_split_to_array(held, '\\s+')[-25:], ' ') AS tail FROM (SELECT *, g[i + 1] AS x, CAST(ceil(length(g[i + 1]) / 4) AS BIGINT) AS own FROM fold WHERE i < len(g))))),
 whole AS (SELECT doc_id, i, wide AS text FROM fold WHERE wide IS NOT NULL)"""
CHUNKED = f"""made AS (SELECT doc_id, i, 0 AS part, 0 AS k, done AS chunk FROM fold WHERE done IS NOT NULL UNION ALL SELECT doc_id, i, 1, k, chunk FROM cutw WHERE chunk <> '' UNION ALL SELECT doc_id, i, 1, 0, text FROM whole WHERE length(text) <= 1600
  UNION ALL SELECT doc_id, i, 2, 0, {_STRIP.format("held")} FROM fold WHERE i = len(g) AND regexp_matches(held, '\\S')
  UNION ALL SELECT doc_id, 0, 0, 0, CASE WHEN regexp_matches(text, '\\S') THEN text ELSE '' END FROM documents WHERE NOT regexp_matches(text, '\\S') OR length(text) <= 1600)"""


def recursive(text: str) -> str:
    return text.replace("WITH ", "WITH RECURSIVE ", 1)


@register("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY i, part, k) - 1 AS chunk_index, count(*) OVER (PARTITION BY doc_id) AS total_chunks, length(chunk) AS n_chars, md5(chunk) AS chunk_md5 FROM made", PACK, WINDOWS, CHUNKED)
def chunk_notes(spark, d):
    cut = chunking.chunk_notes(read(spark, d, "documents").select("doc_id", "text"))
    return cut.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.col("total_chunks").cast("long").alias("total_chunks"), F.length("chunk_content").cast("long").alias("n_chars"), F.md5("chunk_content").alias("chunk_md5"))


@register("SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS place, length(chunk) AS n_chars FROM cutw WHERE chunk <> '' UNION ALL SELECT doc_id, 0, length(text) FROM documents WHERE length(text) <= 1600", "whole AS (SELECT doc_id, 0 AS i, text FROM documents)", WINDOWS)
def fallback_chunks(spark, d):
    one = chunking.window_rows(read(spark, d, "documents"))
    return one.select("doc_id", F.col("place").cast("long").alias("place"), F.length("chunk").cast("long").alias("n_chars"))


for _name in ("chunk_notes", "fallback_chunks"):
    ORACLE_SQL[_name] = recursive(ORACLE_SQL[_name])


# ---- search


@register(f"SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]+'), lambda t: length(t) > 1 AND t NOT IN ({STOP})))), ' ') AS terms FROM benchmark_docs", "benchmark_docs AS (SELECT item_id AS doc_id, text FROM benchmark)")
def search_terms(spark, d):
    return read(spark, d, "benchmark").select(F.col("item_id").alias("doc_id"), F.array_join(F.array_sort(tx.meaningful_terms(F.col("text"))), " ").alias("terms"))


TOK = "tok AS (SELECT doc_id, list_concat(regexp_extract_all(lower(chunk_content), '[a-z0-9]+'), regexp_extract_all(lower(title), '[a-z0-9]+')) AS t FROM notes)"


@register("SELECT doc_id, 3 AS n_terms, CAST(len(list_filter(t, lambda x: x IN ('general', 'public', 'license'))) AS BIGINT) AS tf FROM tok WHERE list_has_all(t, ['general', 'public', 'license'])".replace("3 AS", "CAST(3 AS BIGINT) AS"), NOTES, TOK)
def fts_match_and(spark, d):
    return search.match_terms(index_of(spark, d), search.analyse(TEXT).terms, True)


@register("SELECT doc_id, CAST(len(list_distinct(list_filter(t, lambda x: x IN ('general', 'public', 'license')))) AS BIGINT) AS n_terms, CAST(len(list_filter(t, lambda x: x IN ('general', 'public', 'license'))) AS BIGINT) AS tf FROM tok WHERE list_has_any(t, ['general', 'public', 'license'])", NOTES, TOK)
def fts_match_or(spark, d):
    return search.match_terms(index_of(spark, d), search.analyse(TEXT).terms, False)


@register("SELECT doc_id FROM notes WHERE contains(lower(chunk_content), 'general public license') OR contains(lower(title), 'general public license')", NOTES)
def fts_phrase(spark, d):
    return notes_view(spark, d).where(search.has(TEXT, "chunk_content", "title")).select("doc_id")


_C = "(CAST(contains(c, 'general') AS INT) + CAST(contains(c, 'public') AS INT) + CAST(contains(c, 'license') AS INT))"
SCORED = f"""scored AS (SELECT *, round(CASE WHEN ph THEN 30.0 ELSE 0.0 END + 2.0 * nc + 5.0 * nt + CASE WHEN nb = 3 THEN 15.0 WHEN nc / 3.0 >= 0.75 THEN 8.0 ELSE 0.0 END
 + CASE WHEN vector IS NOT NULL THEN 50.0 * greatest(0.0, list_cosine_similarity(CAST(vector AS DOUBLE[]), q)) ELSE 0.0 END, 2) AS fts,
 concat(CASE WHEN nb = 3 THEN 'all_terms' WHEN nc / 3.0 >= 0.75 THEN 'most_terms' WHEN ph THEN 'exact_phrase' ELSE 'fts' END, CASE WHEN vector IS NOT NULL THEN '_boosted' ELSE '' END) AS said FROM (
 SELECT *, {_C} AS nc, {_C.replace('(c,', '(t,')} AS nt, {_C.replace('(c,', "(c || ' ' || t,")} AS nb, contains(c, 'general public license') OR contains(t, 'general public license') AS ph
 FROM (SELECT *, lower(chunk_content) AS c, lower(title) AS t FROM notes), qv))"""


@register("SELECT doc_id, fts AS score, said AS description FROM scored WHERE doc_id IN (SELECT doc_id FROM tok WHERE list_has_any(t, ['general', 'public', 'license']))", NOTES, TOK, QV, SCORED)
def fts_scored(spark, d):
    n = notes_view(spark, d)
    q = search.analyse(TEXT)
    score, said = search.full_text_score(q, query_vector(spark, d))
    return n.join(search.match_terms(index_of(spark, d), q.terms, False), "doc_id", "left_semi").select("doc_id", score.alias("score"), said.alias("description"))


@register("SELECT doc_id FROM notes WHERE contains(lower(chunk_content), 'released') AND contains(lower(chunk_content), 'license')", NOTES)
def like_search(spark, d):
    return notes_view(spark, d).where(search.like_all("Released of License")).select("doc_id")


@register(r"SELECT doc_id FROM notes WHERE regexp_matches(chunk_content, '(?i)(^|[^\p{L}\p{N}_])version($|[^\p{L}\p{N}_])') OR lower(title) = 'version'", NOTES)
def regex_word_search(spark, d):
    return notes_view(spark, d).where(search.whole_word("version", "title", "chunk_content")).select("doc_id")


@register("SELECT doc_id, round(d, 4) AS distance FROM near ORDER BY d, doc_id LIMIT 20", NOTES, KNN)
def knn_topk(spark, d):
    return search.knn(notes_view(spark, d), query_vector(spark, d), 20).withColumn("distance", F.round("distance", 4))


@register("SELECT threshold, count(doc_id) AS n_hits, round(min(d), 4) AS nearest FROM (SELECT unnest([0.3, 0.5, 0.8, 1.0, 1.5]::DOUBLE[]) AS threshold) LEFT JOIN (SELECT * FROM near ORDER BY d, doc_id LIMIT 20) ON d <= threshold GROUP BY 1", NOTES, KNN)
def knn_threshold_sweep(spark, d):
    return search.threshold_sweep(notes_view(spark, d), query_vector(spark, d), [0.3, 0.5, 0.8, 1.0, 1.5])


LEGS = """legs AS (SELECT * FROM (SELECT doc_id, unique_key, round(greatest(0.0, CASE WHEN d < 1 THEN (1 - d) * 100 ELSE 100 / (1 + d) END), 2) AS score, 'vector' AS source, 1 AS leg FROM near WHERE d <= 2.0 ORDER BY d, doc_id LIMIT 40)
 UNION ALL (SELECT doc_id, unique_key, fts, said, 3 FROM scored WHERE ph ORDER BY fts DESC, doc_id LIMIT 200)
 UNION ALL (SELECT doc_id, unique_key, fts, said, 4 FROM scored SEMI JOIN (SELECT doc_id FROM tok WHERE list_has_all(t, ['general', 'public', 'license'])) USING (doc_id) ORDER BY fts DESC, doc_id LIMIT 500)
 UNION ALL (SELECT doc_id, unique_key, fts, said, 5 FROM scored SEMI JOIN (SELECT doc_id FROM tok WHERE list_has_any(t, ['general', 'public', 'license'])) USING (doc_id) ORDER BY fts DESC, doc_id LIMIT 500)
 UNION ALL (SELECT doc_id, unique_key, CASE WHEN contains(c, 'general public license') THEN 50.0 ELSE 20.0 END AS s, CASE WHEN contains(c, 'general public license') THEN 'like_exact' ELSE 'like_partial' END, 6 FROM scored WHERE nc = 3 ORDER BY s DESC, doc_id LIMIT 100)),
 once AS (SELECT * FROM legs QUALIFY row_number() OVER (PARTITION BY unique_key ORDER BY leg, score DESC, doc_id) = 1)"""
RESULT = "SELECT doc_id, unique_key, title, creation_date, modification_date, CAST(chunk_index AS INT) AS chunk_index, total_chunks, chunk_content, score, source, row_number() OVER (ORDER BY score {0}, leg, doc_id) AS place FROM (SELECT doc_id, score, source, leg FROM once ORDER BY score {0}, leg, doc_id LIMIT 20) JOIN notes USING (doc_id)"


@register(RESULT.format("ASC"), NOTES, TOK, KNN, SCORED, LEGS)
def hybrid_search_asc(spark, d):
    return search.search(notes_view(spark, d), TEXT, query_vector(spark, d), 20, 2.0, "reference", index_of(spark, d))


@register(RESULT.format("DESC"), NOTES, TOK, KNN, SCORED, LEGS)
def hybrid_search_best(spark, d):
    return search.search(notes_view(spark, d), TEXT, query_vector(spark, d), 20, 2.0, index=index_of(spark, d))


@register(f"SELECT r.* FROM ({RESULT.format('DESC')}) r WHERE title IN (SELECT title FROM allowed)", NOTES, EV, RANGE.replace("every_note", "notes"), TOK, KNN, SCORED, LEGS)
def search_with_dates(spark, d):
    n = notes_view(spark, d)
    return search.search_api(n, interactions.titles_in_range(n, stored(spark, d), LOW, HIGH), TEXT, query_vector(spark, d), "2024-01-30", LOW, HIGH, 20, 2.0, index=index_of(spark, d))


@register("SELECT source, count(*) AS n FROM (" + RESULT.format("DESC") + ") GROUP BY 1", NOTES, TOK, KNN, SCORED, LEGS)
def search_sources(spark, d):
    return search.source_breakdown(search.search(notes_view(spark, d), TEXT, query_vector(spark, d), 20, 2.0, index=index_of(spark, d)))


@register("SELECT count(*) AS total_chunks, count(DISTINCT title) AS unique_titles FROM (" + RESULT.format("DESC") + ")", NOTES, TOK, KNN, SCORED, LEGS)
def search_statistics(spark, d):
    return search.search_stats(search.search(notes_view(spark, d), TEXT, query_vector(spark, d), 20, 2.0, index=index_of(spark, d)))


@register("SELECT doc_id, unique_key, title, creation_date, modification_date, chunk_index, total_chunks, chunk_content, CAST(0.0 AS DOUBLE) AS score, 'date' AS source, row_number() OVER (ORDER BY doc_id) AS place FROM notes WHERE title IN (SELECT title FROM allowed) ORDER BY doc_id LIMIT 1000", NOTES, EV, RANGE.replace("every_note", "notes"))
def search_date_only(spark, d):
    n = notes_view(spark, d)
    return search.search_api(n, interactions.titles_in_range(n, stored(spark, d), LOW, HIGH), None, None, "2024-01-30", LOW, HIGH)


@register("""SELECT title, doc_id, score, source FROM (
 SELECT title, doc_id, round(100 * greatest(0.0, 1 - d / 2), 2) AS score, 'vector' AS source, 1 AS leg FROM (SELECT * FROM near ORDER BY d, doc_id LIMIT 100) JOIN notes USING (doc_id) WHERE greatest(0.0, 1 - d / 2) >= 0.05
 UNION ALL SELECT title, doc_id, CASE WHEN vector IS NOT NULL THEN round(100 * greatest(0.0, list_cosine_similarity(CAST(vector AS DOUBLE[]), q)), 2) ELSE 70.0 END, 'fts', 2 FROM scored SEMI JOIN (SELECT doc_id FROM tok WHERE list_has_any(t, ['general', 'public', 'license'])) USING (doc_id)
 UNION ALL SELECT title, doc_id, CASE WHEN ph THEN 100.0 ELSE 85.0 END, 'like', 3 FROM scored WHERE nc = 3
 UNION ALL SELECT title, doc_id, 90.0, 'word', 4 FROM scored WHERE regexp_matches(chunk_content, '(?i)(^|[^\\p{L}\\p{N}_])general public license($|[^\\p{L}\\p{N}_])'))
 QUALIFY row_number() OVER (PARTITION BY title ORDER BY leg, score DESC, doc_id) = 1""", NOTES, TOK, KNN, SCORED)
def note_level_search(spark, d):
    return search.search_notes(notes_view(spark, d), TEXT, query_vector(spark, d), index=index_of(spark, d))


# ---- incremental indexing


def cached(spark: SparkSession, d: str) -> DataFrame:
    m = F.when(F.col("lang") == "fr", "2023-12-31").otherwise(F.col("modification_date"))
    return notes_view(spark, d).where("title <> 'src3'").select("title", "creation_date", m.alias("modification_date")).distinct()


def current(spark: SparkSession, d: str) -> DataFrame:
    return notes_view(spark, d).select("title", "creation_date", "modification_date").distinct()


CHANGED = PATCHED + ", ch AS (SELECT cur.*, CASE WHEN c.title IS NULL THEN 'new' WHEN c.modification_date <> cur.modification_date THEN 'modified' ELSE 'unchanged' END AS status FROM cur LEFT JOIN cached c USING (title, creation_date))"


@register("SELECT title, creation_date, modification_date, status FROM ch", NOTES, CHANGED)
def changed_notes(spark, d):
    return incremental.changes(current(spark, d), cached(spark, d))


@register("SELECT doc_id FROM notes ANTI JOIN (SELECT * FROM ch WHERE status = 'modified') USING (title, creation_date)", NOTES, CHANGED)
def delete_modified(spark, d):
    return incremental.without_modified(notes_view(spark, d), incremental.changes(current(spark, d), cached(spark, d))).select("doc_id")


@register("SELECT title, creation_date, coalesce(n.modification_date, c.modification_date) AS modification_date FROM (SELECT * FROM cur WHERE title IN ('src1', 'src3')) n FULL JOIN cached c USING (title, creation_date)", NOTES, PATCHED)
def cache_merge(spark, d):
    return incremental.merge_cache(current(spark, d).where(F.col("title").isin("src1", "src3")), cached(spark, d))


@register("SELECT doc_id FROM notes WHERE creation_date > '2024-01-20' OR modification_date > '2024-01-20'", NOTES)
def incremental_since(spark, d):
    return incremental.since(notes_view(spark, d), "2024-01-20").select("doc_id")


@register("SELECT CAST(max(modification_date) AS TIMESTAMP) AS since FROM notes", NOTES)
def sync_threshold(spark, d):
    return incremental.threshold(notes_view(spark, d))


# ---- hierarchy


@register("SELECT cluster_id, min_by(cluster_label, doc_id) AS label, count(*) AS n_chunks, round(100.0 * count(*) / (SELECT count(*) FROM notes), 2) AS percent FROM notes GROUP BY 1", NOTES)
def cluster_stats(spark, d):
    return hierarchy.base_stats(notes_view(spark, d))


@register("SELECT t.id, t.parent_id, t.n, round(100.0 * t.n / (SELECT count(*) FROM notes), 2) AS percent, CASE WHEN p.n IS NOT NULL THEN round(100.0 * t.n / p.n, 2) END AS percent_of_parent FROM tree t LEFT JOIN tree p ON p.id = t.parent_id", NOTES, "tree AS (SELECT cluster_id AS id, CAST(NULL AS VARCHAR) AS parent_id, count(*) AS n FROM notes GROUP BY 1 UNION ALL SELECT display_topic_id, split_part(display_topic_id, '.', 1), count(*) FROM notes WHERE contains(display_topic_id, '.') GROUP BY 1, 2)")
def nested_cluster_stats(spark, d):
    return hierarchy.tree(notes_view(spark, d))


@register("SELECT id, count(*) AS n, false AS inferred, CAST(3 AS BIGINT) AS depth FROM ids GROUP BY 1 UNION ALL SELECT regexp_replace(id, '[.][01]$', ''), count(*), true, CAST(2 AS BIGINT) FROM ids GROUP BY 1", NOTES, "ids AS (SELECT concat(base_topic_id, '.', display_topic_id[-1:], '.', doc_id % 2) AS id FROM notes)")
def inferred_intermediates(spark, d):
    n = notes_view(spark, d)
    ids = n.select(F.concat_ws(".", "base_topic_id", F.substring("display_topic_id", -1, 1), (F.col("doc_id") % 2).cast("string")).alias("display_topic_id"))
    return hierarchy.nested_counts(ids)


# ---- topics


CONF = "conf AS (SELECT *, chunk_index % 7 / 7.0 AS confidence FROM notes)"


@register("SELECT display_topic_id, rank, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY display_topic_id ORDER BY confidence DESC, doc_id) AS rank FROM conf WHERE display_topic_id <> '-1') WHERE rank <= 3", NOTES, CONF)
def topic_representatives(spark, d):
    return topics.representatives(notes_view(spark, d).withColumn("confidence", F.col("chunk_index") % 7 / 7.0))


LABELS = [("1", "One"), ("1.6", "One and six"), ("2", " "), ("-1", "Never"), ("3", "Three")]


@register("SELECT doc_id, CASE WHEN display_topic_id = '1.6' THEN 'One and six' WHEN base_topic_id = '1' THEN 'One' WHEN base_topic_id = '3' THEN 'Three' ELSE cluster_label END AS cluster_label FROM notes", NOTES)
def label_update(spark, d):
    return topics.update_labels(notes_view(spark, d), spark.createDataFrame(LABELS, "topic string, label string")).select("doc_id", "cluster_label")


@register("SELECT doc_id, CASE base_topic_id WHEN '1' THEN 'One' WHEN '3' THEN 'Three' ELSE 'Unknown' END AS base_cluster_label, CASE WHEN display_topic_id = '1.6' THEN 'One and six' WHEN base_topic_id = '1' THEN 'One' WHEN base_topic_id = '3' THEN 'Three' ELSE 'Unknown' END AS cluster_label FROM notes", NOTES)
def display_label_fill(spark, d):
    base = spark.createDataFrame([("1", "One"), ("3", "Three")], "topic string, label string")
    return topics.fill_labels(notes_view(spark, d), base, spark.createDataFrame([("1.6", "One and six")], "topic string, label string")).select("doc_id", "base_cluster_label", "cluster_label")


CTF = f"""tf AS (SELECT base_topic_id AS topic, term, count(*) AS n FROM (SELECT base_topic_id, unnest({WORD}) AS term FROM picked) GROUP BY 1, 2), sz AS (SELECT topic, sum(n) AS size FROM tf GROUP BY 1),
 ct AS (SELECT topic, term, n, sqrt(CAST(n AS DOUBLE) / size) * greatest(0.0, coalesce(CASE WHEN 1 + (m - f + 0.5) / (f + 0.5) > 0 THEN ln(1 + (m - f + 0.5) / (f + 0.5)) END, 0.0)) AS weight FROM tf JOIN sz USING (topic) JOIN (SELECT term, CAST(sum(n) AS DOUBLE) AS f FROM tf GROUP BY 1) USING (term), (SELECT avg(CAST(size AS DOUBLE)) AS m FROM sz))"""


@register("SELECT topic, rank, term, round(weight, 6) AS weight FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 8) DESC, term) AS rank FROM ct) WHERE rank <= 10", NOTES, "picked AS (SELECT * FROM notes)", CTF)
def ctfidf_keywords(spark, d):
    return topics.keywords(notes_view(spark, d))


def outliers(spark: SparkSession, d: str) -> DataFrame:
    """All chunks with a vector, those of topic 4 as outliers."""
    return notes_view(spark, d).where("vector is not null").withColumn("base_topic_id", F.when(F.col("base_topic_id") == "4", "-1").otherwise(F.col("base_topic_id")))


OUT = "outl AS (SELECT * REPLACE (CASE WHEN base_topic_id = '4' THEN '-1' ELSE base_topic_id END AS base_topic_id) FROM notes WHERE vector IS NOT NULL)"
BC = "bv AS (SELECT base_topic_id AS topic, i, avg(CAST(vector[i + 1] AS DOUBLE)) AS v FROM outl, (SELECT unnest(range(64)) AS i) WHERE base_topic_id <> '-1' GROUP BY ALL), bc AS (SELECT topic, list(v ORDER BY i) AS c FROM bv GROUP BY 1)"


@register("SELECT doc_id, topic AS new_topic, round(s, 4) AS similarity FROM (SELECT doc_id, topic, list_cosine_similarity(CAST(vector AS DOUBLE[]), c) AS s FROM outl, bc WHERE base_topic_id = '-1' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, topic DESC) = 1) WHERE s >= 0.1", NOTES, OUT, BC)
def outlier_reassign_embedding(spark, d):
    return topics.reassign_by_vector(outliers(spark, d), 0.1)


@register(f"SELECT doc_id, topic AS new_topic, round(s, 4) AS similarity FROM (SELECT doc_id, topic, dot / tn / dn AS s FROM (SELECT doc_id, topic, sum(b.n * weight) AS dot FROM bag b JOIN ct USING (term) GROUP BY 1, 2) JOIN (SELECT topic, sqrt(sum(weight * weight)) AS tn FROM ct GROUP BY 1) USING (topic) JOIN (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS dn FROM bag GROUP BY 1) USING (doc_id) WHERE tn > 0 AND dn > 0 QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(dot / tn / dn, 9) DESC, topic DESC) = 1) WHERE s >= 0.05", NOTES, OUT, "picked AS (SELECT * FROM outl WHERE base_topic_id <> '-1')", CTF, f"bag AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest({WORD}) AS term FROM outl WHERE base_topic_id = '-1') GROUP BY 1, 2)")
def outlier_reassign_ctfidf(spark, d):
    return topics.reassign_by_terms(outliers(spark, d))


@register("SELECT doc_id, max_by(cluster_id, (round(s, 9), cluster_id)) AS child, round(max(s), 4) AS similarity FROM (SELECT n.doc_id, c.cluster_id, list_cosine_similarity(CAST(n.vector AS DOUBLE[]), c.centroid) AS s FROM notes n JOIN cent c ON contains(c.cluster_id, '.') AND split_part(c.cluster_id, '.', 1) = n.base_topic_id WHERE n.vector IS NOT NULL AND NOT contains(n.display_topic_id, '.')) GROUP BY 1", NOTES, CENT)
def child_outlier_reassign(spark, d):
    return topics.reassign_children(notes_view(spark, d))


@register(f"SELECT g AS meta_cluster_id, string_agg(term, ' & ' ORDER BY r) AS label FROM (SELECT g, term, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, term) AS r FROM (SELECT g, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM (SELECT meta_cluster_id AS g, list_filter({WORD}, lambda w: w NOT IN ({STOP})) AS w FROM notes)) GROUP BY 1, 2) WHERE r <= 5 GROUP BY 1", NOTES)
def meta_label_terms(spark, d):
    return topics.meta_label_terms(notes_view(spark, d))


GROUPED = "grp AS (SELECT cluster_id, centroid, CASE WHEN cluster_id IN ('0', '1', '2') THEN 0 WHEN cluster_id IN ('3', '4') THEN 2 ELSE 5 + CAST(cluster_id[-1:] AS INT) END AS meta FROM cent), mv AS (SELECT meta, i, avg(centroid[i + 1]) AS v FROM grp, (SELECT unnest(range(64)) AS i) GROUP BY ALL), mm AS (SELECT meta, list(v ORDER BY i) AS mean FROM mv GROUP BY 1), mn AS (SELECT meta, count(*) AS n FROM grp GROUP BY 1), moved AS (SELECT cluster_id, coalesce(target, meta) AS meta FROM grp LEFT JOIN (SELECT s.meta, l.meta AS target FROM mm s JOIN mn sn USING (meta), mm l JOIN mn ln ON ln.meta = l.meta WHERE sn.n < 2 AND ln.n >= 2 QUALIFY row_number() OVER (PARTITION BY s.meta ORDER BY round(1 - list_cosine_similarity(s.mean, l.mean), 9), l.meta) = 1) USING (meta))"


@register("SELECT cluster_id, dense_rank() OVER (ORDER BY meta) - 1 AS meta FROM moved", NOTES, CENT, GROUPED)
def small_meta_merge(spark, d):
    meta = F.when(F.col("cluster_id").isin("0", "1", "2"), 0).when(F.col("cluster_id").isin("3", "4"), 2).otherwise(5 + F.substring("cluster_id", -1, 1).cast("int"))
    return topics.merge_small(clusters.centroids(notes_view(spark, d)).withColumn("meta", meta.cast("long")))


# ---- clustering (iterative or sampled: checked by their own tests)


@register()
def pca_projection(spark, d):
    p = density.pca(notes_view(spark, d))
    return p.select("doc_id", *(F.round(F.get("reduced", F.lit(i)), 6).alias(f"p{i}") for i in range(5)))


@register()
def density_clusters(spark, d):
    return density.density_clusters(density.pca(notes_view(spark, d)))


def clustered(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, the density cluster as display id, and the reduced vector."""
    reduced = Scratch(spark, "reduced").write(density.pca(notes_view(spark, d)), "reduced")
    found = density.density_clusters(reduced).select("doc_id", F.col("cluster").cast("string").alias("display_topic_id"))
    return found.join(reduced, "doc_id")


def fitted(spark: SparkSession, d: str) -> Memberships:
    """The density clustering of all chunks with what its soft memberships need."""
    return Memberships.fit(Scratch(spark, "reduced").write(density.pca(notes_view(spark, d)), "reduced"), Scratch(spark, "soft").root)


@register()
def soft_memberships(spark, d):
    """A row for each chunk and cluster; without any cluster all of a chunk is noise (-1)."""
    m = fitted(spark, d).probabilities()
    each = m.select("doc_id", F.posexplode_outer("probabilities").alias("topic", "p"))
    return each.select("doc_id", F.coalesce(F.col("topic"), F.lit(-1)).cast("string").alias("topic"), F.round(F.coalesce("p", F.lit(1.0)), 6).alias("probability"))


@register()
def outlier_reassign_soft(spark, d):
    m = fitted(spark, d).probabilities().withColumn("topic", F.col("topic").cast("int"))
    moved = topics.reassign_by_probability(m, 0.05, 0.03)
    return moved.select("doc_id", "topic", topics.confidence(F.col("probabilities")).alias("cluster_confidence"))


@register()
def mega_split(spark, d):
    return density.mega_split(clustered(spark, d))


@register()
def recursive_split(spark, d):
    reduced = Scratch(spark, "reduced").write(density.pca(notes_view(spark, d)), "reduced")
    split = density.mega_split(reduced.withColumn("display_topic_id", F.lit("0")))
    return density.recursive_split(split.join(reduced, "doc_id"), large=100)


@register()
def meta_clusters_linkage(spark, d):
    return density.meta_linkage(clusters.centroids(notes_view(spark, d))).select("cluster_id", "meta")


# ---- view orders


@register("SELECT display_topic_id AS cluster_id, max(epoch(CAST(modification_date AS TIMESTAMP)))::BIGINT AS spike, round(avg(epoch(CAST(modification_date AS TIMESTAMP))), 3) AS momentum FROM notes GROUP BY 1", NOTES)
def cluster_recency_scores(spark, d):
    return layout.recency(notes_view(spark, d))


@register("SELECT cluster_id, count(*) AS n_hits, round(greatest(0.0, least(1.0, 1 - (avg(CAST(distance AS DOUBLE)) - (SELECT min(distance) FROM hits)::DOUBLE) / greatest(1e-6, (SELECT max(distance) - min(distance) FROM hits)::DOUBLE))), 4) AS relevance FROM hits GROUP BY 1", NOTES, HITS)
def cluster_relevance(spark, d):
    return layout.relevance_by_cluster(hits(spark, d))


PLACES = "places AS (SELECT display_topic_id AS cluster_id, avg(CAST(vector[1] AS DOUBLE)) AS x, avg(CAST(vector[2] AS DOUBLE)) AS y, avg(CAST(vector[3] AS DOUBLE)) AS z FROM notes WHERE vector IS NOT NULL GROUP BY 1), nearest AS (SELECT p.cluster_id, round(min(sqrt((p.x - a.x) * (p.x - a.x) + (p.y - a.y) * (p.y - a.y) + (p.z - a.z) * (p.z - a.z))), 4) AS distance FROM places p, places a WHERE a.cluster_id IN (SELECT cluster_id FROM few) GROUP BY 1)"
FEW = "few AS (SELECT * FROM hits WHERE cluster_id IN ('1', '3', '4.9'))"


def few_hits(spark: SparkSession, d: str) -> DataFrame:
    return hits(spark, d).where(F.col("cluster_id").isin("1", "3", "4.9"))


@register("SELECT cluster_id, distance FROM nearest", NOTES, HITS, FEW, PLACES)
def nearest_hit_cluster(spark, d):
    return layout.nearest_anchor(layout.positions(notes_view(spark, d)), few_hits(spark, d))


@register("SELECT row_number() OVER (ORDER BY pinned DESC, hit NULLS LAST, nearest_hit_cluster NULLS LAST, CAST(split_part(cluster_id, '.', 1) AS INT), contains(cluster_id, '.'), cluster_id) AS place, * FROM (SELECT e.cluster_id, e.cluster_id IN ('2', '0') AS pinned, h.hit, n.distance AS nearest_hit_cluster FROM (SELECT DISTINCT display_topic_id AS cluster_id FROM notes) e LEFT JOIN (SELECT cluster_id, CAST(round(min(distance), 4) AS DOUBLE) AS hit FROM few GROUP BY 1) h USING (cluster_id) LEFT JOIN nearest n USING (cluster_id))", NOTES, HITS, FEW, PLACES)
def legend_order(spark, d):
    return layout.legend(notes_view(spark, d), few_hits(spark, d), ["2", "0"])


@register("SELECT CAST(chunk_index AS BIGINT) AS chunk_index, doc_id, display_topic_id, CAST(coalesce(lead(chunk_index) OVER w, (SELECT min(chunk_index) FROM rail)) AS BIGINT) AS next_index, CAST(coalesce(lag(chunk_index) OVER w, (SELECT max(chunk_index) FROM rail)) AS BIGINT) AS previous_index FROM rail WINDOW w AS (ORDER BY chunk_index)", NOTES, "rail AS (SELECT * FROM notes WHERE title = 'src1' AND creation_date = (SELECT min(creation_date) FROM notes WHERE title = 'src1' AND lang = 'en'))")
def chunk_rail(spark, d):
    return notes.chunk_rail(notes_view(spark, d), "src1", "2024-01-02")


@register("SELECT doc_id, CAST(coalesce(lead(chunk_index) OVER w, first_value(chunk_index) OVER w) AS BIGINT) AS next_index, CAST(coalesce(lag(chunk_index) OVER w, total_chunks - 1) AS BIGINT) AS previous_index FROM notes WINDOW w AS (PARTITION BY note_key, lang ORDER BY chunk_index)", NOTES)
def next_prev_chunk(spark, d):
    return notes.next_previous(notes_view(spark, d))


@register("SELECT name, CAST(n_rows AS BIGINT) AS n_rows, tier FROM (VALUES ('notes', 1, 3), ('notes_backup_1763846409', 2, 2), ('notes_new_copy', 3, 1), ('notes_test', 4, 0)) t(name, n_rows, tier)")
def table_list_order(spark, d):
    rows = [("notes_test", 4), ("notes_backup_1763846409", 2), ("notes_new_copy", 3), ("notes", 1)]
    return order_tables(spark.createDataFrame(rows, "name string, n_rows long")).select("name", "n_rows", "tier")


@register("SELECT title, creation_date, modification_date, count(*) AS n_chunks, max(last_opened) AS last_opened, coalesce(substr(max(last_opened), 1, 10), modification_date) AS order_date FROM notes LEFT JOIN (SELECT title, max(dt) AS last_opened FROM ev GROUP BY 1) USING (title) GROUP BY 1, 2, 3", NOTES, EV)
def notes_by_last_interaction(spark, d):
    return layout.with_last_interaction(notes_view(spark, d), stored(spark, d))


@register("SELECT round(avg(x), 4) AS x, round(avg(y), 4) AS y, round(avg(z), 4) AS z, count(*) AS n FROM places WHERE cluster_id IN ('1', '2')", NOTES, HITS, FEW, PLACES)
def selection_centre(spark, d):
    return layout.selection_centre(layout.positions(notes_view(spark, d)), ["1", "2"])


@register("SELECT cluster_id, doc_id FROM (SELECT display_topic_id AS cluster_id, doc_id FROM notes)", NOTES)
def display_groups(spark, d):
    return layout.display_groups(notes_view(spark, d)).select("cluster_id", F.explode("points").alias("p")).select("cluster_id", "p.doc_id")


@register("SELECT count(DISTINCT meta_cluster_id) AS metas, count(*) AS clusters, CAST(sum(chunk_count) AS BIGINT) AS chunks FROM facts", NOTES, FACTS)
def tree_totals(spark, d):
    return layout.tree_totals(clusters.meta_clusters(notes_view(spark, d)))


@register(META + " WHERE contains(cluster_id, '1') OR contains(lower(label), '1')", NOTES, FACTS, COLORS)
def tree_filter(spark, d):
    return layout.tree_filter(clusters.meta_clusters(notes_view(spark, d)), "1")


@register("SELECT title, display_topic_id AS cluster_id, doc_id FROM notes WHERE display_topic_id IN ('2', '1', '1.6') QUALIFY row_number() OVER (PARTITION BY title ORDER BY list_position(['2', '1', '1.6'], display_topic_id), doc_id) = 1", NOTES)
def notes_across_clusters(spark, d):
    return layout.notes_across(notes_view(spark, d), ["2", "1", "1.6"])


@register("SELECT topic, rank, doc_id FROM (SELECT base_topic_id AS topic, doc_id, row_number() OVER (PARTITION BY base_topic_id ORDER BY confidence DESC, doc_id) AS rank FROM (SELECT * FROM conf QUALIFY row_number() OVER (PARTITION BY base_topic_id, title, creation_date, chunk_index ORDER BY confidence DESC, doc_id) = 1)) WHERE rank <= 5", NOTES, CONF)
def ranked_documents(spark, d):
    n = notes_view(spark, d).withColumn("probability", F.col("chunk_index") % 7 / 7.0).withColumn("topic", F.col("base_topic_id"))
    return models.ranked_documents(n)


@register("SELECT text_id, coalesce(e, i) AS doc_id, CASE WHEN e IS NOT NULL THEN 'exact' ELSE 'inside' END AS how FROM (SELECT t.text_id, min(n.doc_id) FILTER (n.chunk_content = t.text) AS e, min(n.doc_id) AS i FROM (SELECT item_id AS text_id, text FROM benchmark UNION ALL SELECT -1 - doc_id, text FROM documents) t JOIN notes n ON contains(n.chunk_content, t.text) AND (t.text_id >= 0 OR n.chunk_content = t.text) WHERE length(t.text) > 0 GROUP BY 1)", NOTES)
def find_texts(spark, d):
    items, docs = read(spark, d, "benchmark"), read(spark, d, "documents")
    texts = items.select(F.col("item_id").alias("text_id"), "text").unionByName(docs.select((-1 - F.col("doc_id")).alias("text_id"), "text"))
    return models.find_texts(texts, chunk_texts(spark, d))


OUT_NEAR = "reas AS (SELECT doc_id, s FROM (SELECT doc_id, topic, list_cosine_similarity(CAST(vector AS DOUBLE[]), c) AS s FROM outl, bc WHERE base_topic_id = '-1' QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round(s, 9) DESC, topic DESC) = 1) WHERE s >= 0.1)"


@register("SELECT b AS n_before, a AS n_after, CASE WHEN b > 0 THEN round(100.0 * (b - a) / b, 2) ELSE 0.0 END::DOUBLE AS reduced_percent FROM (SELECT count(*) FILTER (base_topic_id = '-1') AS b, count(*) FILTER (base_topic_id = '-1' AND doc_id NOT IN (SELECT doc_id FROM reas)) AS a FROM outl)", NOTES, OUT, BC, OUT_NEAR)
def outlier_report(spark, d):
    before = outliers(spark, d)
    return models.outlier_report(before, before.join(topics.reassign_by_vector(before, 0.1), "doc_id", "left").withColumn("base_topic_id", F.coalesce("new_topic", "base_topic_id")))


CTD = CTF.replace("base_topic_id", "display_topic_id")
GATHER = """words AS (SELECT topic, string_agg(term, ' & ' ORDER BY r) FILTER (r <= 5) AS label FROM (SELECT topic, term, row_number() OVER (PARTITION BY topic ORDER BY round(weight, 8) DESC, term) AS r FROM ct) GROUP BY 1),
 once AS (SELECT display_topic_id AS topic, count(*) AS n FROM (SELECT DISTINCT display_topic_id, title, creation_date, modification_date, chunk_index FROM notes) GROUP BY 1)"""


@register("SELECT f.cluster_id AS topic, f.label AS stored_label, f.chunk_count AS n_chunks, coalesce(w.label, concat('Topic ', f.cluster_id)) AS label, least(3, o.n) AS n_documents FROM facts f LEFT JOIN words w ON w.topic = f.cluster_id JOIN once o ON o.topic = f.cluster_id WHERE f.cluster_id <> '-1'", NOTES, FACTS, "picked AS (SELECT * FROM notes)", CTD, GATHER)
def gathered_topics(spark, d):
    n = notes_view(spark, d).withColumn("confidence", F.col("chunk_index") % 7 / 7.0)
    found = models.label_topics(models.gather_topics(n, topics.class_tfidf(n, "display_topic_id")))
    return found.select("topic", "stored_label", "n_chunks", "label", F.size("documents").cast("long").alias("n_documents"))


@register()
def embedded_chunks(spark, d):
    out = models.index_notes(read(spark, d, "pages").select("page_id", F.col("url").alias("title"), "html"), "html", "title")
    return out.select("page_id", F.col("chunk_index").cast("long").alias("chunk_index"), F.size("vector").cast("long").alias("dim"))


__all__ = ["ORACLE_SQL", "QUERIES", "list_tables", "num"]
