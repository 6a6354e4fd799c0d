"""More registered queries: orders and layouts of a viewer, tools over search results, text and date functions, stored indexes and models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions import numbers as num
from notewright.functions import text as tx
from notewright.operators import catalog, clusters, hierarchy, incremental, interactions, layout, models, search, topics
from notewright.plans.registry import (
    CENT, CHANGED, COLORS, CTD, DAY, EV, FACTS, FEW, HIGH, HITS, KNN, LEGS, LOW, META, NOTES, OUT, PLACES, QV, RANGE, RESULT, SCORED, STOP, TEXT, TOK,
    cached, current, few_hits, hits, index_of, outliers, query_vector, register, stored,
)
from notewright.sources.shared import Scratch
from notewright.sources.tables import list_tables, notes_view, read, read_cache, save_cache, source_batches

# ---- orders

PARTS = "list_transform(string_split({0}, '.'), lambda p: struct_pack(kind := CASE WHEN regexp_full_match(p, '-*[0-9]+') THEN 0 ELSE 1 END, number := CASE WHEN regexp_full_match(p, '-*[0-9]+') THEN coalesce(TRY_CAST(p AS BIGINT), 0) ELSE 0 END, txt := CASE WHEN regexp_full_match(p, '-*[0-9]+') THEN '' ELSE p END))"
NATURAL = r"list_transform(regexp_extract_all(lower({0}), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_full_match(x, '[0-9]+') THEN lpad(x, 12, '0') ELSE x END)"
ID = PARTS.format("cluster_id") + ", cluster_id"


@register(f"SELECT row_number() OVER (ORDER BY {PARTS.format('id')}, id) AS place, id FROM (SELECT DISTINCT display_topic_id || CASE doc_id % 5 WHEN 0 THEN '' WHEN 1 THEN '.10' WHEN 2 THEN '.9' WHEN 3 THEN '.x' ELSE '.x.2' END AS id FROM notes)", NOTES)
def dotted_order(spark, d):
    kind = F.col("doc_id") % 5
    more = F.when(kind == 0, "").when(kind == 1, ".10").when(kind == 2, ".9").when(kind == 3, ".x").otherwise(".x.2")
    ids = notes_view(spark, d).select(F.concat("display_topic_id", more).alias("id")).distinct()
    return layout.places(ids, [num.dotted_parts(F.col("id")), F.col("id")]).select("place", "id")


LIST = """first_hit AS (SELECT cluster_id, min(r) AS first_rank FROM (SELECT cluster_id, row_number() OVER (ORDER BY distance, cluster_id) AS r FROM few) GROUP BY 1),
 opened AS (SELECT title, row_number() OVER (ORDER BY min(dt) DESC, title) - 1 AS r FROM ev WHERE day = '2024-01-12' GROUP BY 1),
 seen AS (SELECT display_topic_id AS cluster_id, min(r) AS history_rank FROM notes JOIN opened USING (title) GROUP BY 1),
 rec AS (SELECT display_topic_id AS cluster_id, max(epoch(CAST(modification_date AS TIMESTAMP)))::BIGINT AS spike, round(avg(epoch(CAST(modification_date AS TIMESTAMP))), 3) AS momentum FROM notes GROUP BY 1),
 sim AS (SELECT cluster_id, round((x * sx + y * sy + z * sz) / (CASE WHEN x * x + y * y + z * z = 0 THEN 1 ELSE sqrt(x * x + y * y + z * z) END * sqrt(sx * sx + sy * sy + sz * sz)), 6) AS similarity FROM places, (SELECT avg(x) AS sx, avg(y) AS sy, avg(z) AS sz FROM places WHERE cluster_id IN ('1', '2'))),
 lst AS (SELECT f.cluster_id, f.label, f.chunk_count, first_rank, nearest.distance AS nearest, history_rank, similarity, spike, momentum FROM facts f LEFT JOIN first_hit USING (cluster_id) LEFT JOIN nearest USING (cluster_id) LEFT JOIN seen USING (cluster_id) LEFT JOIN sim USING (cluster_id) LEFT JOIN rec USING (cluster_id))"""
_SORTS = {
    "az": NATURAL.format("label"), "size": "chunk_count", "search": "first_rank NULLS LAST, nearest NULLS LAST", "history": "history_rank DESC NULLS LAST",
    "similarity": "similarity NULLS FIRST", "recency": "spike NULLS FIRST", "momentum": "momentum NULLS FIRST",
}


def history_ranks(spark: SparkSession, d: str) -> DataFrame:
    """(cluster_id, history_rank): the first place of a cluster along the day's notes, the last opened first."""
    day = interactions.history_by_title(stored(spark, d), DAY)
    ranked = layout.places(day, [F.desc("opened_at"), F.col("title")]).withColumn("place", F.col("place") - 1)
    return layout.first_ranks(notes_view(spark, d).join(ranked, "title").select(F.col("display_topic_id").alias("cluster_id"), "place"), "cluster_id").withColumnRenamed("first_rank", "history_rank")


def cluster_list(spark: SparkSession, d: str) -> DataFrame:
    """Clusters with all that a list of them can be sorted by."""
    n = notes_view(spark, d)
    found = layout.places(few_hits(spark, d), [F.col("distance"), F.col("cluster_id")])
    at = layout.positions(n)
    near = layout.nearest_anchor(at, few_hits(spark, d)).withColumnRenamed("distance", "nearest")
    chosen = at.where(F.col("cluster_id").isin("1", "2")).agg(*(F.avg(c).alias(f"s{c}") for c in "xyz"))
    dot, own, other = (sum((F.col(a) * F.col(b) for a, b in pairs), F.lit(0.0)) for pairs in ([("x", "sx"), ("y", "sy"), ("z", "sz")], [(c, c) for c in "xyz"], [(f"s{c}", f"s{c}") for c in "xyz"]))
    similar = at.crossJoin(F.broadcast(chosen)).select("cluster_id", F.round(dot / (F.when(own == 0, 1.0).otherwise(F.sqrt(own)) * F.sqrt(other)), 6).alias("similarity"))
    out = clusters.cluster_facts(n).select("cluster_id", "label", "chunk_count")
    for part in (layout.first_ranks(found, "cluster_id"), near, history_ranks(spark, d), similar, layout.recency(n)):
        out = out.join(part, "cluster_id", "left")
    return out


@register(" UNION ALL ".join(f"SELECT '{m}' AS metric, cluster_id, row_number() OVER (ORDER BY {k}, {ID}) AS place FROM lst" for m, k in _SORTS.items()), NOTES, EV, HITS, FEW, PLACES, FACTS, LIST)
def clusters_sorted(spark, d):
    every = Scratch(spark, "clusters").write(cluster_list(spark, d), "list")
    out = [layout.places(every, layout.cluster_order(m)).select(F.lit(m).alias("metric"), "cluster_id", "place") for m in layout.METRICS]
    for part in out[1:]:
        out[0] = out[0].unionByName(part)
    return out[0]


@register("SELECT cluster_id, history_rank FROM seen", NOTES, EV, HITS, FEW, PLACES, FACTS, LIST)
def history_first_ranks(spark, d):
    return history_ranks(spark, d)


@register(f"SELECT * FROM (SELECT cluster_id, spike, momentum FROM rec ORDER BY spike DESC, {ID}) LIMIT 1", NOTES, EV, HITS, FEW, PLACES, FACTS, LIST)
def default_cluster(spark, d):
    return layout.default_cluster(notes_view(spark, d))


@register(f"SELECT row_number() OVER (ORDER BY meta_cluster_label, chunk_count DESC, cluster_id) AS place, cluster_id FROM ({META})", NOTES, FACTS, COLORS)
def clusters_by_meta_label(spark, d):
    meta = clusters.meta_clusters(notes_view(spark, d))
    return layout.places(meta, [F.col("meta_cluster_label"), F.desc("chunk_count"), F.col("cluster_id")]).select("place", "cluster_id")


@register(f"SELECT meta_cluster_id, cluster_id, dense_rank() OVER (ORDER BY {NATURAL.format('meta_cluster_label')}, meta_cluster_id) AS meta_place, row_number() OVER (PARTITION BY meta_cluster_id ORDER BY chunk_count DESC, {ID}) AS size_place, row_number() OVER (PARTITION BY meta_cluster_id ORDER BY {ID}) AS id_place FROM ({META})", NOTES, FACTS, COLORS)
def tree_sorted(spark, d):
    meta = clusters.meta_clusters(notes_view(spark, d))
    by_id = layout.sort_tree(meta, "az").select("cluster_id", F.col("child_place").alias("id_place"))
    return layout.sort_tree(meta, "size").join(by_id, "cluster_id").select("meta_cluster_id", "cluster_id", "meta_place", F.col("child_place").alias("size_place"), "id_place")


SIMILAR = "alike AS (SELECT b.cluster_id, round(greatest(0.0, least(1.0, list_cosine_similarity(a.centroid, b.centroid))), 4) AS similarity FROM cent a JOIN facts fa ON fa.cluster_id = a.cluster_id, cent b JOIN facts f ON f.cluster_id = b.cluster_id WHERE a.cluster_id = '1' AND b.cluster_id <> '1' AND f.meta_cluster_id = fa.meta_cluster_id)"


@register("SELECT cluster_id, similarity, i // 12 AS ring, (i % 12) * 30.0::DOUBLE AS angle FROM (SELECT *, row_number() OVER (ORDER BY similarity DESC, cluster_id) - 1 AS i FROM alike) WHERE i < 30", NOTES, CENT, FACTS, SIMILAR)
def similarity_rings(spark, d):
    return layout.similarity_rings(clusters.similar_clusters(notes_view(spark, d), "1", least=0.0), least=0.0)


@register("""SELECT cluster_id, round(r * cos(a), 4) AS x, round(r * sin(a), 4) AS y, round(a, 6) AS angle FROM (SELECT cluster_id, 88.8 + (200 - 88.8) * (m - min(m) OVER ()) / CASE WHEN max(m) OVER () = min(m) OVER () THEN 1e-6 ELSE max(m) OVER () - min(m) OVER () END AS r,
 -pi() / 2 + (i // 12) * 0.15 + (i % 12) * 2 * pi() / least(count(*) OVER () - i, 12) AS a FROM (SELECT cluster_id, m, row_number() OVER (ORDER BY round(m, 6), cluster_id) - 1 AS i FROM (SELECT cluster_id, avg(CAST(distance AS DOUBLE)) AS m FROM hits GROUP BY 1)))""", NOTES, HITS)
def search_rings(spark, d):
    mean = hits(spark, d).groupBy("cluster_id").agg(F.avg(F.col("distance").cast("double")).alias("avg_distance"))
    return layout.search_rings(mean).select("cluster_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("angle", 6).alias("angle"))


# ---- tools over search results

BEST = f"best AS ({RESULT.format('DESC')})"
POINT = "pt AS (SELECT unique_key, max_by(cluster_id, doc_id) AS c, max_by(base_topic_id, doc_id) AS b, max_by(display_topic_id, doc_id) AS z, max_by(cluster_label, doc_id) AS l FROM notes WHERE title <> 'src2' GROUP BY 1)"
ATTRS = "att AS (SELECT best.*, coalesce(z, c, '-1') AS cluster_id, coalesce(b, c, '-1') AS base_topic_id, coalesce(l, 'Unknown') AS cluster_label, substr(chunk_content, 1, 200) AS preview FROM best LEFT JOIN pt USING (unique_key))"


def best(spark: SparkSession, d: str) -> DataFrame:
    return search.search(notes_view(spark, d), TEXT, query_vector(spark, d), 20, 2.0, index=index_of(spark, d))


def attributed(spark: SparkSession, d: str) -> DataFrame:
    """Search results with the attributes of points, of which a title has none."""
    return search.hit_attributes(best(spark, d), notes_view(spark, d).where("title <> 'src2'"))


@register("SELECT doc_id, unique_key, cluster_id, base_topic_id, cluster_id AS display_topic_id, cluster_label, md5(preview) AS preview_md5 FROM att", NOTES, TOK, KNN, SCORED, LEGS, BEST, POINT, ATTRS)
def search_hit_attributes(spark, d):
    return attributed(spark, d).select("doc_id", "unique_key", "cluster_id", "base_topic_id", "display_topic_id", "cluster_label", F.md5("preview").alias("preview_md5"))


@register("SELECT cluster_id, max(cluster_label) AS cluster_label, count(*) AS n FROM att GROUP BY 1", NOTES, TOK, KNN, SCORED, LEGS, BEST, POINT, ATTRS)
def search_result_clusters(spark, d):
    return search.result_clusters(attributed(spark, d))


@register("SELECT place, md5('• ' || title || ' [chunk ' || chunk_index || '/' || total_chunks || '] (cluster: ' || cluster_label || ', score: ' || printf('%.3f', score) || ')' || chr(10) || '    ' || preview) AS line_md5 FROM att WHERE place <= 20 AND title IN (SELECT title FROM allowed)", NOTES, EV, RANGE.replace("every_note", "notes"), TOK, KNN, SCORED, LEGS, BEST, POINT, ATTRS)
def date_search_lines(spark, d):
    n = notes_view(spark, d)
    titles = interactions.titles_in_range(n, stored(spark, d), LOW, HIGH)
    found = search.search_api(n, titles, TEXT, query_vector(spark, d), "2024-01-30", LOW, HIGH, 20, 2.0, index=index_of(spark, d))
    return search.result_lines(search.hit_attributes(found, n.where("title <> 'src2'"))).select("place", F.md5("line").alias("line_md5"))


FIRST = "fp AS (SELECT unique_key, min_by(modification_date, doc_id) AS point_modified, min_by(total_chunks, doc_id) AS note_size FROM notes WHERE title <> 'src2' GROUP BY 1), rp AS (SELECT best.*, point_modified, CAST(note_size AS BIGINT) AS note_size FROM best LEFT JOIN fp USING (unique_key))"


def with_points(spark: SparkSession, d: str) -> DataFrame:
    return layout.results_with_points(best(spark, d), notes_view(spark, d).where("title <> 'src2'"))


@register("SELECT doc_id, point_modified, coalesce(note_size, -1) AS note_size FROM rp", NOTES, TOK, KNN, SCORED, LEGS, BEST, FIRST)
def results_with_points(spark, d):
    return with_points(spark, d).select("doc_id", "point_modified", F.coalesce(F.col("note_size").cast("long"), F.lit(-1)).alias("note_size"))


@register(f"SELECT 'search' AS metric, doc_id, place AS at FROM rp UNION ALL SELECT 'size', doc_id, row_number() OVER (ORDER BY coalesce(note_size, total_chunks, 0), {NATURAL.format('title')}, place) FROM rp UNION ALL SELECT 'modified', doc_id, row_number() OVER (ORDER BY point_modified DESC NULLS LAST, {NATURAL.format('title')} DESC, place) FROM rp", NOTES, TOK, KNN, SCORED, LEGS, BEST, FIRST)
def results_sorted(spark, d):
    r = Scratch(spark, "results").write(with_points(spark, d), "results")
    parts = []
    for metric, up in (("search", True), ("size", True), ("modified", False)):
        kept = layout.sort_results(r, metric, up).select(F.lit(metric).alias("metric"), "doc_id").coalesce(1)  # a search's few results
        parts.append(kept.withColumn("at", F.monotonically_increasing_id() + 1))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@register("SELECT title, min(place) AS first_rank FROM best GROUP BY 1", NOTES, TOK, KNN, SCORED, LEGS, BEST)
def search_first_ranks(spark, d):
    return layout.first_ranks(best(spark, d), "title")


# ---- sources and incremental indexing


@register("SELECT title, creation_date, place, place // 50 AS batch FROM (SELECT *, row_number() OVER (ORDER BY title, creation_date, modification_date) - 1 AS place FROM (SELECT DISTINCT title, creation_date, modification_date FROM notes)) WHERE place < 70", NOTES)
def listing_batches(spark, d):
    return source_batches(current(spark, d), ["title", "creation_date", "modification_date"], 50, 70).select("title", "creation_date", "place", "batch")


@register("SELECT title, creation_date, modification_date, 'then' AS last_sync FROM (SELECT DISTINCT title, creation_date, modification_date FROM notes)", NOTES)
def cache_round_trip(spark, d):
    path = Scratch(spark, "cache").root
    save_cache(current(spark, d), path, "then")
    return read_cache(spark, path, lines=True)


@register("SELECT title, creation_date, status FROM ch WHERE status <> 'unchanged'", NOTES, CHANGED)
def notes_to_index(spark, d):
    return incremental.to_index(incremental.changes(current(spark, d), cached(spark, d))).select("title", "creation_date", "status")


@register("SELECT p AS processed, s AS skipped, c AS chunks, CASE WHEN p > 0 THEN round(c / p, 1) ELSE 0.0 END AS chunks_per_note FROM (SELECT count(*) FILTER (status <> 'unchanged') AS p, count(*) FILTER (status = 'unchanged') AS s FROM ch), (SELECT count(*) AS c FROM notes SEMI JOIN (SELECT * FROM ch WHERE status <> 'unchanged') USING (title, creation_date))", NOTES, CHANGED)
def index_report(spark, d):
    return incremental.index_report(incremental.changes(current(spark, d), cached(spark, d)), notes_view(spark, d))


@register("SELECT title, row_number() OVER (ORDER BY f) AS place FROM (SELECT title, min(doc_id) AS f FROM notes GROUP BY 1 ORDER BY f LIMIT 3)", NOTES)
def sampled_titles(spark, d):
    first = notes_view(spark, d).groupBy("title").agg(F.min("doc_id").alias("f")).orderBy("f").limit(3)
    return layout.places(first, [F.col("f")]).select("title", "place")


@register("SELECT 0 AS place, 'doc_id' AS name, 'bigint' AS type UNION ALL SELECT 1, 'text', 'string' UNION ALL SELECT 2, 'lang', 'string' UNION ALL SELECT 3, 'source', 'string' UNION ALL SELECT 4, 'n_chars', 'bigint'")
def table_schema(spark, d):
    return catalog.describe(read(spark, d, "documents"))


@register("SELECT step, n::BIGINT AS n FROM (SELECT 2 * count(*) AS a, 2 * count(*) FILTER (source <> 'src1') AS b FROM documents), unnest([{'step': 'appended', 'n': a}, {'step': 'deleted', 'n': b}, {'step': 'restored', 'n': a}, {'step': 'saved before', 'n': b}, {'step': 'listed first', 'n': a}, {'step': 'tables', 'n': 3}]) AS u(x), LATERAL (SELECT x.step AS step, x.n AS n)")
def table_round_trip(spark, d):
    """Tables of a database of their own: created, appended to, backed up, rows deleted, restored, listed; the counts after each step."""
    own = Scratch(spark, "tables")
    base = "notewright_" + own.root[-32:]
    spark.sql(f"CREATE DATABASE {base} LOCATION '{own.root}'")
    try:
        rows, name = read(spark, d, "documents").select("doc_id", F.col("source").alias("title")), f"{base}.notes"
        catalog.create(rows, name, fresh=True)
        steps = {"appended": catalog.append(rows, name)}
        copy = catalog.backup(spark, name, 1763846409)
        catalog.delete(spark, name, rows.where("title = 'src1'"), ["title"])
        steps["deleted"] = spark.table(name).count()
        saved = catalog.restore(spark, name, copy, 1763846500)
        steps |= {"restored": spark.table(name).count(), "saved before": spark.table(saved).count()}
        listed = list_tables(spark, base).collect()
        steps |= {"listed first": listed[0]["n_rows"], "tables": len(listed)}
    finally:
        spark.sql(f"DROP DATABASE {base} CASCADE")
    return spark.createDataFrame([*steps.items()], "step string, n long")


@register("SELECT term, count(DISTINCT doc_id) AS n_chunks FROM (SELECT unnest(['the', 'license', 'zebrawort']) AS term) LEFT JOIN (SELECT doc_id, unnest(t) AS term FROM tok) USING (term) GROUP BY 1", NOTES, TOK)
def index_self_test(spark, d):
    return search.index_test(index_of(spark, d), ["the", "license", "zebrawort"])


@register("SELECT cluster_id, min_by(cluster_label, doc_id) AS label, count(*) AS n_chunks, round(100.0 * count(*) / (SELECT count(*) FROM notes), 2) AS percent FROM notes GROUP BY 1", NOTES)
def json_report(spark, d):
    stats = hierarchy.base_stats(notes_view(spark, d))
    path = Scratch(spark, "report").root
    catalog.export_json(stats, path)
    return spark.read.schema(stats.schema).json(path)


# ---- text, dates, numbers


@register(f"SELECT doc_id, array_to_string(t, ' ') AS terms, CASE WHEN contains(regexp_extract(text, '\"[^\"]+\"'), '\"') OR len(t) <= 2 THEN trim(text) END AS phrase, CASE WHEN len(t) >= 4 THEN array_to_string(t[-4:], ' ') END AS last_four, CASE WHEN len(t) >= 3 THEN array_to_string(t[-3:], ' ') END AS last_three FROM (SELECT item_id AS doc_id, any_value(text) AS text, list(w ORDER BY p) FILTER (w IS NOT NULL) AS t FROM (SELECT item_id, text, w, min(p) AS p FROM (SELECT item_id, text, unnest(x) AS w, unnest(range(len(x))) AS p FROM (SELECT *, regexp_extract_all(lower(text), '[a-z0-9]+') AS x FROM benchmark)) WHERE length(w) > 1 AND w NOT IN ({STOP}) GROUP BY ALL) GROUP BY 1)")
def keyword_queries(spark, d):
    q = read(spark, d, "benchmark").where(F.size(tx.meaningful_terms(F.col("text"))) > 0).select(F.col("item_id").alias("doc_id"), tx.keyword_queries(F.col("text")).alias("q"))
    return q.select("doc_id", F.array_join("q.terms", " ").alias("terms"), "q.phrase", "q.last_four", "q.last_three")


@register("SELECT doc_id, md5(concat(title, chr(10), chr(10), chunk_content)) AS index_md5, md5(substr(chunk_content, 1, 200)) AS preview_md5, CASE WHEN length(chunk_content) > 40 THEN md5(substr(chunk_content, 1, 37) || '...') ELSE md5(chunk_content) END AS short_md5 FROM notes", NOTES)
def text_heads(spark, d):
    c = F.col("chunk_content")
    return notes_view(spark, d).select("doc_id", F.md5(tx.index_text(F.col("title"), c)).alias("index_md5"), F.md5(tx.preview(c)).alias("preview_md5"), F.md5(tx.shorten(c)).alias("short_md5"))


@register(r"""SELECT doc_id, regexp_replace(label, '^[0-9]+_', '') AS plain, regexp_replace(regexp_replace(split_part(trim(label), chr(10), 1), '^["'']+|["'']+$', '', 'g'), '[.,;:]+$', '') AS tidy FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN doc_id || '_' || title WHEN 1 THEN '"A ' || title || '"' || chr(10) || 'more' ELSE title || ' and more.,;' END AS label FROM notes)""", NOTES)
def label_cleanup(spark, d):
    kind, title = F.col("doc_id") % 3, F.col("title")
    label = F.when(kind == 0, F.concat_ws("_", "doc_id", "title")).when(kind == 1, F.concat(F.lit('"A '), title, F.lit('"\nmore'))).otherwise(F.concat(title, F.lit(" and more.,;")))
    return notes_view(spark, d).select("doc_id", tx.strip_topic_number(label).alias("plain"), tx.tidy_label(label).alias("tidy"))


@register("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN title WHEN 1 THEN 'L ' || doc_id ELSE 'other' END AS label FROM notes", NOTES)
def json_labels(spark, d):
    kind = F.col("doc_id") % 4
    fenced = F.concat(F.lit('```json\n{"label": "'), "title", F.lit('"}\n```'))
    reply = F.when(kind == 0, fenced).when(kind == 1, F.concat(F.lit('{"label": "L '), "doc_id", F.lit('"}'))).when(kind == 2, '{"label": " "}').otherwise("no JSON")
    return notes_view(spark, d).select("doc_id", tx.label_from_json(reply, F.lit("other")).alias("label"))


@register("SELECT doc_id, doc_id % 5 IN (0, 1) AS number, CASE doc_id % 5 WHEN 4 THEN 0 WHEN 3 THEN 2 ELSE 1 END::BIGINT AS n_values, CASE doc_id % 5 WHEN 0 THEN doc_id || '.5' WHEN 1 THEN '-' || doc_id WHEN 2 THEN title WHEN 3 THEN title END AS first_value FROM notes", NOTES)
def stored_values(spark, d):
    kind = F.col("doc_id") % 5
    value = F.when(kind == 0, F.concat("doc_id", F.lit(".5"))).when(kind == 1, F.concat(F.lit("-"), "doc_id")).when(kind == 2, F.col("title")).when(kind == 3, F.concat(F.lit("['"), "title", F.lit("', 'b']")))
    return notes_view(spark, d).select("doc_id", tx.is_number(value).alias("number"), F.size(tx.as_list(value)).cast("long").alias("n_values"), F.get(tx.as_list(value), F.lit(0)).alias("first_value"))


@register("SELECT title, dt, strftime(CAST(substr(dt, 1, 19) AS TIMESTAMP), '%m/%d/%Y') AS day, strftime(CAST(substr(dt, 1, 19) AS TIMESTAMP), '%H:%M') AS clock FROM (SELECT DISTINCT title, dt FROM ev)", EV)
def event_times(spark, d):
    e = interactions.events(stored(spark, d)).select("title", "dt").distinct()
    return e.select("title", "dt", num.us_date(F.col("dt")).alias("day"), num.clock(F.col("dt")).alias("clock"))


@register("SELECT vec_id, list_position(embedding, list_max(embedding))::BIGINT - 1 AS at FROM embeddings")
def vector_argmax(spark, d):
    return read(spark, d, "embeddings").select("vec_id", num.argmax(F.col("embedding")).alias("at"))


@register("SELECT display_topic_id AS cluster_id, min_by(cluster_label, doc_id) FILTER (doc_id % 3 <> 0) AS label FROM notes GROUP BY 1", NOTES)
def first_labels(spark, d):
    n = notes_view(spark, d).withColumn("cluster_label", F.when(F.col("doc_id") % 3 != 0, F.col("cluster_label")).otherwise(""))
    return clusters.first_labels(n)


# ---- topics

MEMBER = "bm AS (SELECT base_topic_id AS topic, i, avg(CAST(vector[i + 1] AS DOUBLE)) AS v FROM outl, (SELECT unnest(range(64)) AS i) WHERE base_topic_id <> '-1' GROUP BY ALL), near_ AS (SELECT doc_id, base_topic_id, bm.topic, 1 / (0.01 + sum((CAST(vector[i + 1] AS DOUBLE) - v) * (CAST(vector[i + 1] AS DOUBLE) - v))) AS w FROM outl, bm GROUP BY 1, 2, 3), prob AS (SELECT *, w / sum(w) OVER (PARTITION BY doc_id) AS p FROM near_)"


@register("SELECT doc_id, topic, round(p, 6) AS probability FROM prob", NOTES, OUT, MEMBER)
def membership_probabilities(spark, d):
    m = topics.membership(outliers(spark, d))
    return m.select("doc_id", F.explode(F.arrays_zip("topics", "probabilities")).alias("x")).select("doc_id", F.col("x.topics").alias("topic"), F.round("x.probabilities", 6).alias("probability"))


@register("SELECT doc_id, CASE WHEN base_topic_id <> '-1' THEN CAST(base_topic_id AS INT) WHEN max(round(p, 9)) >= 0.26 THEN CAST(max_by(topic, (round(p, 9), -CAST(topic AS INT))) AS INT) WHEN max(round(p, 9)) FILTER (topic <> '0') > 0.2505 THEN CAST(max_by(topic, (round(p, 9), -CAST(topic AS INT))) FILTER (topic <> '0') AS INT) ELSE -1 END AS topic FROM prob GROUP BY doc_id, base_topic_id", NOTES, OUT, MEMBER)
def outlier_reassign_probability(spark, d):
    m = topics.membership(outliers(spark, d)).withColumn("topic", F.col("topic").cast("int")).withColumn("probabilities", F.transform("probabilities", lambda x: F.round(x, 9)))
    return topics.reassign_by_probability(m, 0.26, 0.2505).select("doc_id", "topic")


@register("SELECT doc_id, CAST(round(max(p), 3) AS VARCHAR) AS cluster_confidence FROM prob GROUP BY 1 UNION ALL SELECT doc_id, '0.0' FROM notes WHERE vector IS NULL", NOTES, OUT, MEMBER)
def cluster_confidence(spark, d):
    m = topics.membership(outliers(spark, d)).select("doc_id", "probabilities")
    return notes_view(spark, d).select("doc_id").join(m, "doc_id", "left").select("doc_id", topics.confidence(F.col("probabilities")).alias("cluster_confidence"))


@register("SELECT topic, rank, doc_id FROM (SELECT topic, doc_id, row_number() OVER (PARTITION BY topic ORDER BY p DESC, doc_id) AS rank FROM (SELECT n.base_topic_id AS topic, doc_id, round(p, 6) AS p, n.title, n.creation_date, n.chunk_index FROM outl n JOIN prob USING (doc_id) WHERE prob.topic = n.base_topic_id QUALIFY row_number() OVER (PARTITION BY n.base_topic_id, n.title, n.creation_date, n.chunk_index ORDER BY round(p, 6) DESC, doc_id) = 1)) WHERE rank <= 5", NOTES, OUT, MEMBER)
def likeliest_documents(spark, d):
    m = topics.membership(outliers(spark, d)).where("topic <> '-1'")
    own = F.round(F.element_at("probabilities", F.array_position("topics", F.col("topic")).cast("int")), 6)
    return models.ranked_documents(m.select("doc_id", "topic", own.alias("probability")).join(notes_view(spark, d).select("doc_id", "title", "creation_date", "chunk_index"), "doc_id"))


@register("SELECT doc_id, CASE WHEN child IS NOT NULL AND split_part(child, '.', 1) = base_topic_id THEN child ELSE coalesce(usual, base_topic_id) END AS display_topic_id FROM (SELECT doc_id, base_topic_id, CASE WHEN contains(display_topic_id, '.') AND doc_id % 2 = 0 THEN display_topic_id WHEN doc_id % 11 = 0 THEN '9.9' END AS child FROM notes) LEFT JOIN (SELECT base_topic_id, child AS usual FROM (SELECT base_topic_id, display_topic_id AS child, count(*) AS n FROM notes WHERE contains(display_topic_id, '.') AND doc_id % 2 = 0 GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY base_topic_id ORDER BY n DESC, child) = 1) USING (base_topic_id)", NOTES)
def assembled_display_ids(spark, d):
    n = notes_view(spark, d)
    child = F.when(F.col("display_topic_id").contains(".") & (F.col("doc_id") % 2 == 0), F.col("display_topic_id")).when(F.col("doc_id") % 11 == 0, "9.9")
    return topics.assemble_display_ids(n.drop("display_topic_id"), n.select("doc_id", child.alias("child")).where("child is not null")).select("doc_id", "display_topic_id")


@register("SELECT cluster_id AS topic, CASE WHEN cluster_id = '1.6' THEN '10' WHEN split_part(cluster_id, '.', 1) IN ('1', '2') THEN '2' || split_part(cluster_id, '.', 1) ELSE cluster_id END AS meta, CASE WHEN cluster_id = '1.6' THEN 'Ten' WHEN split_part(cluster_id, '.', 1) IN ('1', '2') THEN 'Base' ELSE 'Topic ' || cluster_id END AS meta_label FROM facts", NOTES, FACTS)
def resolved_meta(spark, d):
    known = spark.createDataFrame([("1.6", "10", "Ten"), ("1", "21", "Base"), ("2", "22", "Base")], "topic string, meta string, meta_label string")
    return topics.resolve(notes_view(spark, d).select(F.col("display_topic_id").alias("topic")).distinct(), known)


@register("SELECT topic, term, n FROM ct", NOTES, "picked AS (SELECT * FROM notes)", CTD)
def stored_model_terms(spark, d):
    path = Scratch(spark, "model").root
    models.save_model(notes_view(spark, d), path)
    return models.load_model(spark, path)[0].select("topic", "term", "n")


@register("SELECT split_part(cluster_id, '.', 1) AS model, count(*) AS n_topics, max(len(string_split(cluster_id, '.')))::INT AS depth, sum(chunk_count)::BIGINT AS n_chunks FROM facts GROUP BY 1", NOTES, FACTS)
def stored_model_manifest(spark, d):
    path = Scratch(spark, "model").root
    models.save_model(notes_view(spark, d), path)
    return models.load_manifest(spark, path)

