"""Topic models after the clustering: keywords, outliers, labels, representatives, meta groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.functions.numbers import cosine, squared_distance
from notewright.functions.text import word_tokens
from notewright.operators.clusters import centroids
from notewright.sources.shared import Scratch

#: Centroids that are broadcast as one array (64 numbers each make 50 MB).
MOST_CENTROIDS = 100_000


def terms(notes: DataFrame, text: str = "chunk_content") -> DataFrame:
    """Bag of words: (doc_id, term, n)."""
    return notes.select("doc_id", F.explode(word_tokens(F.col(text))).alias("term")).groupBy("doc_id", "term").agg(F.count(F.lit(1)).alias("n"))


def class_tfidf(notes: DataFrame, topic: str = "base_topic_id") -> DataFrame:
    """(topic, term, n, weight): square root of the share of a topic's words, times BM25 inverse frequency over topics.

    The counts are written, so that the texts are cut into words once and not for each of the sums that need them.
    """
    tf = notes.select(F.col(topic).alias("topic"), F.explode(word_tokens(F.col("chunk_content"))).alias("term")).groupBy("topic", "term").agg(F.count(F.lit(1)).alias("n"))
    tf = Scratch(notes.sparkSession, "tfidf").write(tf, "counts")
    size = tf.groupBy("topic").agg(F.sum("n").alias("size"))
    mean = size.agg(F.avg("size").alias("mean"))
    frequency = tf.groupBy("term").agg(F.sum("n").alias("f"))
    joined = tf.join(frequency, "term").join(size, "topic").crossJoin(F.broadcast(mean))
    idf = F.log(1 + (F.col("mean") - F.col("f") + 0.5) / (F.col("f") + 0.5))
    return joined.select("topic", "term", "n", (F.sqrt(F.col("n") / F.col("size")) * F.greatest(F.lit(0.0), F.coalesce(idf, F.lit(0.0)))).alias("weight"))


def keywords(notes: DataFrame, n: int = 10, topic: str = "base_topic_id") -> DataFrame:
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    ranked = class_tfidf(notes, topic).withColumn("weight", F.round("weight", 8)).withColumn("rank", F.row_number().over(w).cast("long"))
    return ranked.where(F.col("rank") <= n).select("topic", "rank", "term", F.round("weight", 6).alias("weight"))


def diverse_keywords(notes: DataFrame, n: int = 10, diversity: float = 0.3, pool: int = 30, topic: str = "base_topic_id") -> DataFrame:
    """Maximal marginal relevance: of the heaviest words, greedily those that stand in other topics than the chosen ones; pool words of each topic meet in one group."""
    import numpy as np
    import pandas as pd

    weights = class_tfidf(notes, topic)
    w = Window.partitionBy("topic").orderBy(F.desc("weight"), "term")
    top = weights.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= pool).select("topic", "term", "weight")
    spread = weights.select("term", F.col("topic").alias("t"), F.col("weight").alias("w")).join(top.select("term").distinct(), "term", "left_semi")
    profile = spread.groupBy("term").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "w")))).alias("profile"))

    def choose(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["weight", "term"], ascending=[False, True]).reset_index(drop=True)
        keys = sorted({k for p in part.profile for k in dict(p)})
        m = np.array([[dict(p).get(k, 0.0) for k in keys] for p in part.profile])
        m = m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        near, gain = m @ m.T, part.weight.to_numpy() / max(part.weight.max(), 1e-12)
        chosen: list[int] = []
        while len(chosen) < min(n, len(part)):
            score = (1 - diversity) * gain - (diversity * near[:, chosen].max(1) if chosen else 0)
            score[chosen] = -np.inf
            chosen.append(int(score.argmax()))
        return part.loc[chosen, ["topic", "term"]].assign(rank=range(1, len(chosen) + 1))

    return top.join(profile, "term").groupBy("topic").applyInPandas(choose, "topic string, term string, rank long")


def _matrix(known: DataFrame) -> DataFrame | None:
    """(cluster_id, centroid) rows as one row with an array, for a broadcast; None if there are more than MOST_CENTROIDS."""
    if known.count() > MOST_CENTROIDS:
        return None
    return known.agg(F.array_sort(F.collect_list(F.struct("cluster_id", "centroid"))).alias("_known"))


def _nearest(rows: DataFrame, known: DataFrame) -> DataFrame:
    """(doc_id, b.cluster_id, b.s) of the centroid with the largest cosine, of equals the last id.  A row looks through a broadcast array; only with too many centroids for that, rows meet them one by one."""
    matrix = _matrix(known)
    if matrix is not None:
        pairs = F.transform("_known", lambda c: F.struct(F.round(cosine(F.col("vector"), c["centroid"]), 9).alias("r"), c["cluster_id"].alias("cluster_id"), cosine(F.col("vector"), c["centroid"]).alias("s")))
        return rows.crossJoin(F.broadcast(matrix)).where(F.size("_known") > 0).select("doc_id", F.array_max(pairs).alias("b"))
    scored = rows.crossJoin(known).select("doc_id", "cluster_id", cosine(F.col("vector"), F.col("centroid")).alias("s"))
    return scored.groupBy("doc_id").agg(F.max_by(F.struct("cluster_id", "s"), F.struct(F.round("s", 9).alias("s"), "cluster_id")).alias("b"))


def reassign_by_vector(notes: DataFrame, least: float = 0.5, topic: str = "base_topic_id") -> DataFrame:
    """Outliers with a vector to the topic with the nearest centroid, if its cosine is at least that."""
    known = Scratch(notes.sparkSession, "centroids").write(centroids(notes.where(F.col(topic) != "-1"), topic), "known")
    best = _nearest(notes.where((F.col(topic) == "-1") & F.col("vector").isNotNull()).select("doc_id", "vector"), known)
    return best.where(F.col("b.s") >= least).select("doc_id", F.col("b.cluster_id").alias("new_topic"), F.round("b.s", 4).alias("similarity"))


def membership(notes: DataFrame, topic: str = "base_topic_id") -> DataFrame:
    """(doc_id, topic, topics, probabilities) of rows with a vector: their share of closeness to each topic but -1.

    Closeness is 1 / (0.01 + squared distance to the topic's centroid); topics are in the order of their ids.  The
    centroids are broadcast after a check of their number.
    """
    known = Scratch(notes.sparkSession, "centroids").write(centroids(notes.where(F.col(topic) != "-1"), topic), "known")
    matrix = _matrix(known)
    if matrix is None:
        raise ValueError(f"over {MOST_CENTROIDS} topics: a row's probabilities are one array")
    rows = notes.where("vector is not null").select("doc_id", F.col(topic).alias("topic"), "vector").crossJoin(F.broadcast(matrix))
    rows = rows.withColumn("_near", F.transform("_known", lambda c: 1 / (0.01 + squared_distance(F.col("vector"), c["centroid"]))))
    total = F.aggregate("_near", F.lit(0.0), lambda a, x: a + x)
    return rows.select("doc_id", "topic", F.transform("_known", lambda c: c["cluster_id"]).alias("topics"), F.transform("_near", lambda x: x / total).alias("probabilities"))


def reassign_by_terms(notes: DataFrame, least: float = 0.05, topic: str = "base_topic_id") -> DataFrame:
    """Outliers to the topic with the most similar keyword weights: sparse cosine by a join on terms."""
    weights = class_tfidf(notes.where(F.col(topic) != "-1"), topic)
    length = weights.groupBy("topic").agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("tn"))
    bag = terms(notes.where(F.col(topic) == "-1"))
    size = bag.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("dn"))
    both = bag.join(weights.select("topic", "term", "weight"), "term").groupBy("doc_id", "topic").agg(F.sum(F.col("n") * F.col("weight")).alias("dot"))
    scored = both.join(length, "topic").join(size, "doc_id").where("tn > 0 and dn > 0").select("doc_id", "topic", (F.col("dot") / F.col("tn") / F.col("dn")).alias("s"))
    best = scored.groupBy("doc_id").agg(F.max_by(F.struct("topic", "s"), F.struct(F.round("s", 9).alias("s"), "topic")).alias("b"))
    return best.where(F.col("b.s") >= least).select("doc_id", F.col("b.topic").alias("new_topic"), F.round("b.s", 4).alias("similarity"))


def reassign_by_probability(assigned: DataFrame, first: float = 0.05, second: float = 0.03) -> DataFrame:
    """Outliers (topic -1) to the likeliest topic of their probabilities, if it has at least `first`; else, above `second`, to the likeliest but topic 0."""
    p = F.col("probabilities")
    best = F.array_max(p)
    tail = F.slice(p, 2, F.greatest(F.lit(0), F.size(p) - 1))
    new = F.when(best >= first, F.array_position(p, best) - 1).when(F.array_max(tail) > second, F.array_position(tail, F.array_max(tail)))
    return assigned.withColumn("topic", F.when(F.col("topic") == -1, F.coalesce(new.cast("int"), F.col("topic"))).otherwise(F.col("topic")))


def reassign_children(notes: DataFrame) -> DataFrame:
    """Chunks that a split left at their base topic, to the nearest child centroid of that base."""
    child = F.col("display_topic_id").contains(".")
    known = centroids(notes.where(child & F.col("vector").isNotNull())).withColumn("base", F.substring_index("cluster_id", ".", 1))
    rest = notes.where(~child & F.col("vector").isNotNull()).select("doc_id", F.col("base_topic_id").alias("base"), "vector")
    scored = rest.join(known, "base").select("doc_id", "cluster_id", cosine(F.col("vector"), F.col("centroid")).alias("s"))
    return scored.groupBy("doc_id").agg(F.max_by("cluster_id", F.struct(F.round("s", 9).alias("s"), "cluster_id")).alias("child"), F.round(F.max("s"), 4).alias("similarity"))


def confidence(probabilities: Column) -> Column:
    """The largest probability as text, to three places; 0.0 without any."""
    return F.coalesce(F.round(F.array_max(probabilities), 3).cast("string"), F.lit("0.0"))


def representatives(notes: DataFrame, n: int = 3) -> DataFrame:
    """The n chunks of each topic with the highest confidence, each (title, dates, chunk) once, outliers left out."""
    once = Window.partitionBy("display_topic_id", "title", "creation_date", "modification_date", "chunk_index").orderBy(F.desc("confidence"), "doc_id")
    best = Window.partitionBy("display_topic_id").orderBy(F.desc("confidence"), "doc_id")
    scored = notes.where("display_topic_id <> '-1'")
    scored = scored.withColumn("_o", F.row_number().over(once)).where("_o = 1").withColumn("rank", F.row_number().over(best).cast("long"))
    return scored.where(F.col("rank") <= n).select("display_topic_id", "rank", "doc_id")


def update_labels(notes: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels (topic, label) into the chunks: first those of base topics, then those of dotted display topics; -1 and blank ones don't count."""
    known = labels.where("topic <> '-1' and trim(label) <> ''")
    base = known.where(~F.col("topic").contains(".")).select(F.col("topic").alias("base_topic_id"), F.col("label").alias("_b"))
    display = known.where(F.col("topic").contains(".")).select(F.col("topic").alias("display_topic_id"), F.col("label").alias("_d"))
    return notes.join(base, "base_topic_id", "left").join(display, "display_topic_id", "left").withColumn("cluster_label", F.coalesce("_d", "_b", "cluster_label")).drop("_b", "_d")


def fill_labels(notes: DataFrame, base: DataFrame, display: DataFrame) -> DataFrame:
    """Base label, overridden by a split child's; Unknown where there is none."""
    b = base.select(F.col("topic").alias("base_topic_id"), F.col("label").alias("base_cluster_label"))
    d = display.select(F.col("topic").alias("display_topic_id"), F.col("label").alias("_d"))
    out = notes.drop("cluster_label").join(b, "base_topic_id", "left").join(d, "display_topic_id", "left")
    return out.withColumn("base_cluster_label", F.coalesce("base_cluster_label", F.lit("Unknown"))).withColumn("cluster_label", F.coalesce("_d", "base_cluster_label")).drop("_d")


def resolve(rows: DataFrame, known: DataFrame, topic: str = "topic") -> DataFrame:
    """Rows with the (meta, meta_label) of their topic: as known (topic, meta, meta_label) has it, else that of its base id, else its own id."""
    exact, base = (known.select(F.col("topic").alias(f"_{k}"), F.col("meta").alias(f"_{k}m"), F.col("meta_label").alias(f"_{k}l")) for k in ("e", "b"))
    own = F.col(topic)
    out = rows.join(exact, own == F.col("_e"), "left").join(base, F.substring_index(own, ".", 1) == F.col("_b"), "left")
    return out.select(*rows.columns, F.coalesce("_em", "_bm", own).alias("meta"), F.coalesce("_el", "_bl", F.concat(F.lit("Topic "), own)).alias("meta_label"))


def assemble_display_ids(notes: DataFrame, children: DataFrame) -> DataFrame:
    """display id: the mapped child if it belongs to the chunk's base, else the base's most common child (smallest id of equals), else the base."""
    base_of = F.substring_index("child", ".", 1)
    usual = children.join(notes.select("doc_id", "base_topic_id"), "doc_id").where(base_of == F.col("base_topic_id")).groupBy("base_topic_id", "child").agg(F.count(F.lit(1)).alias("n"))
    usual = usual.groupBy("base_topic_id").agg(F.min_by("child", F.struct((-F.col("n")).alias("n"), "child")).alias("_usual"))
    out = notes.join(children, "doc_id", "left").join(usual, "base_topic_id", "left")
    mine = F.when(base_of == F.col("base_topic_id"), F.col("child"))
    return out.withColumn("display_topic_id", F.coalesce(mine, "_usual", "base_topic_id")).drop("child", "_usual")


def meta_label_terms(notes: DataFrame, n: int = 5, group: str = "meta_cluster_id") -> DataFrame:
    """A group's most frequent words and pairs of words (without stop words), joined: with one text, TF-IDF is frequency."""
    from notewright.functions.text import SEARCH_STOP_WORDS

    words = F.filter(word_tokens(F.col("chunk_content")), lambda w: ~w.isin(*SEARCH_STOP_WORDS))
    bag = notes.select(F.col(group).alias("g"), words.alias("w"))
    pairs = F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))).otherwise(F.array().cast("array<string>"))
    each = bag.select("g", F.explode(F.concat("w", pairs)).alias("term")).groupBy("g", "term").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("g").orderBy(F.desc("n"), "term")
    top = each.withColumn("r", F.row_number().over(w)).where(F.col("r") <= n).groupBy("g").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r", "term"))), lambda x: x["term"]), " & ").alias("label"))
    every = notes.select(F.col(group).alias("g")).distinct()
    return every.join(top, "g", "left").select(F.col("g").alias("meta_cluster_id"), F.coalesce("label", F.concat(F.lit("Topic Group "), "g")).alias("label"))


def merge_small(groups: DataFrame, least: int = 2) -> DataFrame:
    """groups: (cluster_id, meta, centroid).  A meta group of fewer clusters joins the one of least or more with the nearest mean centroid; then groups are numbered from 0."""
    value = groups.select("meta", F.posexplode("centroid").alias("dim", "v")).groupBy("meta", "dim").agg(F.avg("v").alias("v"))
    mean = value.groupBy("meta").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "v"))), lambda x: x["v"]).alias("mean"))
    size = groups.groupBy("meta").agg(F.count(F.lit(1)).alias("n")).join(mean, "meta")
    small = size.where(F.col("n") < least).select("meta", "mean")
    large = size.where(F.col("n") >= least).select(F.col("meta").alias("target"), F.col("mean").alias("tmean"))
    near = small.crossJoin(large).groupBy("meta").agg(F.min_by("target", F.struct(F.round(1 - cosine(F.col("mean"), F.col("tmean")), 9).alias("d"), "target")).alias("target"))
    moved = groups.select("cluster_id", "meta").join(near, "meta", "left").withColumn("meta", F.coalesce("target", "meta")).drop("target")
    number = moved.select("meta").distinct().withColumn("new", (F.row_number().over(Window.orderBy("meta")) - 1).cast("long"))
    return moved.join(number, "meta").select("cluster_id", F.col("new").alias("meta"))
