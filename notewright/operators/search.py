"""Hybrid retrieval: vector, full-text, phrase, substring and whole-word legs, scored, merged and limited."""

from __future__ import annotations

import re
from functools import reduce
from typing import TYPE_CHECKING, NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.numbers import cosine, distance_to_cosine, literal_vector, relevance, squared_distance
from notewright.functions.text import SEARCH_STOP_WORDS, preview, search_tokens
from notewright.operators.notes import in_dates, search_dates

if TYPE_CHECKING:
    from notewright.operators.vectors import VectorLists

RESULT = ["doc_id", "unique_key", "title", "creation_date", "modification_date", "chunk_index", "total_chunks", "chunk_content", "score", "source", "place"]


class Query(NamedTuple):
    text: str
    terms: list[str]
    phrase: str | None
    quoted: list[str]
    sub_phrases: list[str]


def analyse(text: str) -> Query:
    """A query's terms; itself as a phrase if it is quoted or has at most two; its last four and three terms as sub-phrases."""
    terms = list(dict.fromkeys(t for t in re.findall("[a-z0-9]+", (text or "").lower()) if len(t) > 1 and t not in SEARCH_STOP_WORDS))
    quoted = re.findall(r'"([^"]+)"', text or "")
    phrase = (text or "").strip() if quoted or len(terms) <= 2 else None
    subs = [" ".join(terms[-k:]) for k in (4, 3) if len(terms) >= k]
    return Query((text or "").strip(), terms, phrase, quoted, subs)


def postings(notes: DataFrame) -> DataFrame:
    """Inverted index (term, field, doc_id, tf) over chunk text and title; write it partitioned or bucketed by term."""
    each = [notes.select("doc_id", F.lit(f).alias("field"), F.explode(search_tokens(F.col(c))).alias("term")) for f, c in (("chunk", "chunk_content"), ("title", "title"))]
    return each[0].unionByName(each[1]).groupBy("term", "field", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def document_stats(notes: DataFrame) -> DataFrame:
    return notes.agg(F.count(F.lit(1)).alias("n"), F.avg(F.size(search_tokens(F.col("chunk_content")))).alias("mean_length"))


def match_terms(index: DataFrame, terms: list[str], every: bool) -> DataFrame:
    """Chunks with all or any of the terms, and how many; only the terms' postings are read."""
    found = index.where(F.col("term").isin(terms)).groupBy("doc_id").agg(F.count_distinct("term").alias("n_terms"), F.sum("tf").alias("tf"))
    return found.where(F.col("n_terms") == len(set(terms))) if every else found


def has(text: str, *columns: str) -> Column:
    return reduce(lambda a, b: a | b, (F.lower(F.col(c)).contains(text.lower().strip()) for c in columns))


def like_all(text: str) -> Column:
    """Every white-space separated token of more than two characters is in the chunk, literally."""
    tokens = [w for w in text.lower().split() if len(w) > 2]
    return reduce(lambda a, b: a & b, (F.lower(F.col("chunk_content")).contains(w) for w in tokens), F.lit(True))


def whole_word(text: str, *columns: str) -> Column:
    pattern = r"(?i)(?<![\p{L}\p{N}_])\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E(?![\p{L}\p{N}_])"
    return reduce(lambda a, b: a | b, (F.coalesce(F.col(c).rlike(pattern), F.lit(False)) for c in columns))


def knn(notes: DataFrame, query: list[float], k: int, most: float | None = None) -> DataFrame:
    """(doc_id, distance) of the exact nearest chunks by squared distance, one of each key.

    Each partition sends its own few nearest chunks; if these have under k keys, four times as many are asked for.  So
    a few times k rows move, whatever the number of chunks, and they are looked at here.
    """
    scored = notes.where("vector is not null").select("doc_id", "unique_key", squared_distance(F.col("vector"), literal_vector(query)).alias("distance"))
    if most is not None:
        scored = scored.where(F.col("distance") <= most)
    ask = 2 * k
    while True:
        rows = scored.orderBy("distance", "doc_id").limit(ask).collect()
        first = list({r["unique_key"]: r for r in reversed(rows)}.values())
        if len(first) >= k or len(rows) < ask:
            break
        ask *= 4
    first = sorted(first, key=lambda r: (r["distance"], r["doc_id"]))[:k]
    return notes.sparkSession.createDataFrame([(r["doc_id"], r["distance"]) for r in first], f"doc_id {dict(notes.dtypes)['doc_id']}, distance double")


def threshold_sweep(notes: DataFrame, query: list[float], thresholds: list[float], k: int = 20) -> DataFrame:
    """How many of the k nearest chunks lie within each threshold."""
    near = knn(notes, query, k)
    steps = notes.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    return steps.join(near, F.col("distance") <= F.col("threshold"), "left").groupBy("threshold").agg(F.count("doc_id").alias("n_hits"), F.round(F.min("distance"), 4).alias("nearest"))


def full_text_score(query: Query, vector: list[float] | None) -> tuple[Column, Column]:
    """Score and description: phrase 30, each term 2, in the title 5, all terms 15 or three quarters 8, and half the cosine in percent."""
    content, title = F.lower(F.coalesce("chunk_content", F.lit(""))), F.lower(F.coalesce("title", F.lit("")))
    both = F.concat(content, F.lit(" "), title)
    count = lambda where: reduce(lambda a, b: a + b, (where.contains(t).cast("int") for t in query.terms), F.lit(0))
    phrase = content.contains(query.text.lower()) | title.contains(query.text.lower())
    score = F.when(phrase, 30.0).otherwise(0.0) + 2.0 * count(content) + 5.0 * count(title)
    text = F.when(phrase, "exact_phrase").otherwise("fts")
    if len(query.terms) >= 2:
        every, most = count(both) == len(query.terms), count(content) / len(query.terms) >= 0.75
        score = score + F.when(every, 15.0).when(most, 8.0).otherwise(0.0)
        text = F.when(every, "all_terms").when(most, "most_terms").otherwise(text)
    if vector:
        has_vector = F.col("vector").isNotNull()
        score = score + F.when(has_vector, 50.0 * F.greatest(F.lit(0.0), cosine(F.col("vector"), literal_vector(vector)))).otherwise(0.0)
        text = F.when(has_vector, F.concat(text, F.lit("_boosted"))).otherwise(text)
    return F.round(score, 2), text


def search(
    notes: DataFrame,
    text: str,
    vector: list[float] | None = None,
    limit: int = 5,
    most: float = 2.0,
    order: str = "best_first",
    index: DataFrame | None = None,
    unfiltered_fallback: bool = False,
    lists: VectorLists | None = None,
) -> DataFrame:
    """All legs in one pass over the chunks; a chunk counts in the first leg that finds it; scores by leg; the best (or, as the original has it, the worst) come first.

    order: best_first, or reference (ascending).  unfiltered_fallback: without any substring match, the first 100 chunks
    count as partial ones, as in the original.  lists: the stored lists of the vectors, of which only some are read; the
    result is the same.
    """
    if order not in ("best_first", "reference"):
        raise ValueError(order)
    q = analyse(text)
    index = postings(notes) if index is None else index
    fts, described = full_text_score(q, vector)
    exact = has(q.text, "chunk_content")
    part_score, part_source = F.when(exact, 50.0).otherwise(20.0), F.when(exact, "like_exact").otherwise("like_partial")
    base = notes
    # each leg: its number, its priority, whether a chunk is in it, score, source, and how many of its best count
    legs: list[tuple[int, Column, Column, Column, int]] = []
    if vector:
        near = lists.knn(vector, limit * 2, most) if lists else knn(notes, vector, limit * 2, most)
        base = base.join(F.broadcast(near.withColumnRenamed("distance", "_d")), "doc_id", "left")
        legs.append((1, F.col("_d").isNotNull(), relevance(F.col("_d")), F.lit("vector"), limit * 2))
    if q.terms:
        base = base.join(match_terms(index, q.terms, False).select("doc_id", F.col("n_terms").alias("_terms")), "doc_id", "left")
        if q.phrase and len(q.terms) <= 4:
            legs.append((2, has(q.phrase.strip('"'), "chunk_content", "title"), fts, described, 100))
        legs += [(3, has(sub, "chunk_content", "title"), fts, described, 200) for sub in q.sub_phrases]
        legs.append((4, F.col("_terms") == len(set(q.terms)), fts, described, 500))
        legs.append((5, F.col("_terms").isNotNull(), fts, described, 500))
    legs.append((6, like_all(q.text), part_score, part_source, 100))
    if unfiltered_fallback:
        none = notes.where(like_all(q.text)).limit(1).agg((F.count(F.lit(1)) == 0).alias("_none"))
        base = base.crossJoin(F.broadcast(none))
        legs.append((7, F.col("_none"), part_score, part_source, 100))
    found = [F.when(inside, F.struct(F.lit(k).alias("n"), F.lit(leg).alias("leg"), score.cast("double").alias("score"), source.alias("source"), F.lit(cap).alias("cap"))) for k, (leg, inside, score, source, cap) in enumerate(legs)]
    hits = base.select("doc_id", "unique_key", F.explode(F.array_compact(F.array(*found))).alias("h")).select("doc_id", "unique_key", "h.*")
    # a task keeps only the best of a leg that it has
    best = F.row_number().over(Window.partitionBy("n").orderBy(F.desc("score"), "doc_id"))
    union = hits.withColumn("_r", best).where(F.col("_r") <= max(cap for *_, cap in legs)).where(F.col("_r") <= F.col("cap"))
    w = Window.partitionBy("unique_key").orderBy("leg", F.desc("score"), "doc_id")
    once = union.withColumn("_r", F.row_number().over(w)).where("_r = 1")
    sign = F.desc("score") if order == "best_first" else F.asc("score")
    top = once.orderBy(sign, "leg", "doc_id").limit(limit)
    place = F.row_number().over(Window.orderBy(sign, "leg", "doc_id")).cast("long")
    out = F.broadcast(top.select("doc_id", "score", "source", place.alias("place"))).join(notes, "doc_id")  # `limit` rows
    return out.select(*RESULT)


def source_breakdown(results: DataFrame) -> DataFrame:
    return results.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


def search_stats(results: DataFrame) -> DataFrame:
    return results.agg(F.count(F.lit(1)).alias("total_chunks"), F.count_distinct("title").alias("unique_titles"))


def search_api(notes: DataFrame, titles: DataFrame | None, text: str | None, vector: list[float] | None, today: str, low: str | None = None, high: str | None = None, limit: int = 1000, most: float = 0.8, field: str = "both", order: str = "best_first", index: DataFrame | None = None, lists: VectorLists | None = None) -> DataFrame:
    """Three ways to search: by query; by query within dates, applied after the limit; by dates alone, in the order of rows with score 0.

    titles: those with interactions in the dates, which count besides the notes' own dates.
    """
    low, high = search_dates(bool(text), low, high, today)
    if low is None and high is None:
        return search(notes, text or "", vector, limit, most, order, index, lists=lists)
    allowed = notes.where(in_dates(low, high, field)).select("title")
    allowed = (allowed if titles is None else allowed.union(titles.select("title"))).distinct()
    if text:
        return search(notes, text, vector, limit, most, order, index, lists=lists).join(allowed, "title", "left_semi").select(*RESULT)
    found = notes.join(allowed, "title", "left_semi").withColumn("score", F.lit(0.0)).withColumn("source", F.lit("date")).orderBy("doc_id").limit(limit)
    return found.withColumn("place", F.row_number().over(Window.orderBy("doc_id")).cast("long")).select(*RESULT)


def search_notes(notes: DataFrame, text: str, vector: list[float] | None = None, least: float = 0.05, near: int = 100, index: DataFrame | None = None, lists: VectorLists | None = None) -> DataFrame:
    """One row for each note title: its nearest chunk, else a full-text, substring or whole-word hit; best first."""
    q = analyse(text)
    index = postings(notes) if index is None else index
    legs = []
    if vector:
        close = notes.join(F.broadcast(lists.knn(vector, near) if lists else knn(notes, vector, near)), "doc_id").withColumn("cos", distance_to_cosine(F.sqrt("distance"))).where(F.col("cos") >= least)
        legs.append(close.select("title", "doc_id", F.round(100 * F.col("cos"), 2).alias("score"), F.lit("vector").alias("source"), F.lit(1).alias("leg")))
    score = F.when(F.col("vector").isNotNull(), F.round(100 * F.greatest(F.lit(0.0), cosine(F.col("vector"), literal_vector(vector))), 2)).otherwise(70.0) if vector else F.lit(70.0)
    if q.terms:
        legs.append(notes.join(match_terms(index, q.terms, False), "doc_id", "left_semi").select("title", "doc_id", score.alias("score"), F.lit("fts").alias("source"), F.lit(2).alias("leg")))
    exact = has(q.text, "chunk_content", "title")
    legs.append(notes.where(like_all(q.text)).select("title", "doc_id", F.when(exact, 100.0).otherwise(85.0).alias("score"), F.lit("like").alias("source"), F.lit(3).alias("leg")))
    legs.append(notes.where(whole_word(q.text, "title", "chunk_content")).select("title", "doc_id", F.lit(90.0).alias("score"), F.lit("word").alias("source"), F.lit(4).alias("leg")))
    union = reduce(lambda a, b: a.unionByName(b), legs)
    best = union.groupBy("title").agg(F.min_by(F.struct("doc_id", "score", "source"), F.struct("leg", (-F.col("score")).alias("s"), "doc_id")).alias("b"))
    return best.select("title", "b.doc_id", "b.score", "b.source").orderBy(F.desc("score"), "title")


def hit_attributes(results: DataFrame, points: DataFrame) -> DataFrame:
    """Results with the clusters of the point of their key, of points with one key the last; -1 and Unknown without one."""
    last = points.groupBy("unique_key").agg(F.max_by(F.struct("cluster_id", "base_topic_id", "display_topic_id", "cluster_label"), "doc_id").alias("_p"))
    joined = results.join(last, "unique_key", "left")
    shown = F.coalesce("_p.display_topic_id", "_p.cluster_id", F.lit("-1"))
    return joined.select(
        *(results[c] for c in results.columns), shown.alias("cluster_id"), F.coalesce("_p.base_topic_id", "_p.cluster_id", F.lit("-1")).alias("base_topic_id"),
        shown.alias("display_topic_id"), F.coalesce("_p.cluster_label", F.lit("Unknown")).alias("cluster_label"), preview(F.col("chunk_content")).alias("preview"),
    )


def result_clusters(attributed: DataFrame) -> DataFrame:
    """How many results each cluster has, most first."""
    return attributed.groupBy("cluster_id").agg(F.max("cluster_label").alias("cluster_label"), F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "cluster_id")


def result_lines(attributed: DataFrame, limit: int = 20) -> DataFrame:
    """The first results as a tool prints them: place and text."""
    head = F.format_string("• %s [chunk %d/%d] (cluster: %s, score: %.3f)\n    %s", "title", "chunk_index", "total_chunks", "cluster_label", "score", F.coalesce("preview", F.lit("")))
    return attributed.where(F.col("place") <= limit).select("place", head.alias("line"))


def index_test(index: DataFrame, words: list[str]) -> DataFrame:
    """Whether a stored index answers: how many chunks it finds for each word."""
    asked = index.sparkSession.createDataFrame([(w,) for w in words], "term string")
    found = index.where(F.col("term").isin(words)).groupBy("term").agg(F.count_distinct("doc_id").alias("n_chunks"))
    return asked.join(found, "term", "left").select("term", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"))
