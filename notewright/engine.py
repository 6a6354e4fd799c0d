"""The engine as one object: a table of note chunks, a table of interactions, and every request over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.operators import clusters, incremental, interactions, layout, models, notes, search
from notewright.operators.fulltext import FullText
from notewright.operators.vectors import VectorLists
from notewright.sources.shared import Scratch
from notewright.sources.tables import normalize_notes

NO_INTERACTIONS = "title string, last_opened string, interaction_log string"


class NoteEngine:
    """Requests return DataFrames, computed when read.

    notes: chunks with at least title, chunk_content and dates, and a doc_id in stored order; missing columns are
    filled.  today and now are given by the caller, so that a request gives the same answer whenever it is run.
    """

    def __init__(self, spark: SparkSession, note_chunks: DataFrame, logs: DataFrame | None = None, embedder: models.Embedder | None = None) -> None:
        self.spark, self.embedder = spark, embedder
        self.interactions = spark.createDataFrame([], NO_INTERACTIONS) if logs is None else logs
        self.refresh(note_chunks)

    # state

    def refresh(self, note_chunks: DataFrame) -> None:
        """Takes a new table of chunks; its full-text index is made anew by the first search."""
        self.notes = normalize_notes(note_chunks)
        self._index: FullText | None = None
        self._lists: VectorLists | None = None

    def vector_lists(self) -> VectorLists:
        """The stored lists of the chunks' vectors, in the shared folder; made anew after a change."""
        if self._lists is None:
            self._lists = VectorLists.build(self.notes, Scratch(self.spark, "engine-vectors").root)
        return self._lists

    def full_text(self) -> FullText:
        """The stored full-text index of the chunks, in the shared folder; changes by reindex() go on in it."""
        if self._index is None:
            self._index = FullText(self.spark, Scratch(self.spark, "engine-index").root)
            self._index.add(self.notes)
        return self._index

    def stats(self) -> DataFrame:
        return notes.counts(self.notes)

    def schema(self) -> DataFrame:
        from notewright.operators.catalog import describe

        return describe(self.notes)

    # clusters

    def points(self) -> DataFrame:
        return notes.points(self.notes)

    def meta_clusters(self) -> DataFrame:
        return clusters.meta_clusters(self.notes)

    def meta_clusters_filtered(self, low: str | None = None, high: str | None = None, today: str | None = None) -> DataFrame:
        """Of the notes whose title has an event, or a date, in the range; without a range, of today."""
        if low is None and high is None:
            low = high = today
        titles = interactions.titles_in_range(self.notes, self.interactions, low, high)
        return clusters.meta_clusters(notes.of_titles(self.notes, titles))

    def meta_clusters_by_ids(self, csv: str) -> DataFrame:
        """Of some clusters, by label."""
        return clusters.meta_clusters(clusters.of_clusters(self.notes, csv)).orderBy("meta_cluster_label", F.desc("chunk_count"), "cluster_id")

    def meta_clusters_by_distance(self, distances: dict[str, list[float]]) -> DataFrame:
        rows = [(k, float(v)) for k, each in distances.items() for v in each]
        return clusters.meta_search_sort(self.notes, self.spark.createDataFrame(rows, "cluster_id string, distance double"))

    def similar_clusters(self, cluster_id: str, limit: int = 25, least: float = 0.3) -> DataFrame:
        return clusters.similar_clusters(self.notes, cluster_id, limit, least)

    def cluster_colors(self) -> DataFrame:
        return clusters.colors(self.notes)

    def cluster_sidebar(self, cluster_id: str, low: str | None = None, high: str | None = None) -> DataFrame:
        """With dates, only the chunks in the cluster of titles in the range."""
        if low is None and high is None:
            return clusters.sidebar(self.notes, cluster_id)
        return clusters.sidebar(self.notes, cluster_id, interactions.titles_in_range(self.notes, self.interactions, low, high))

    def filtered_notes(self, low: str | None, high: str | None) -> DataFrame:
        return clusters.filtered_notes_all(self.notes, interactions.titles_in_range(self.notes, self.interactions, low, high))

    def default_cluster(self) -> DataFrame:
        return layout.default_cluster(self.notes)

    # notes

    def note_content(self, title: str, chunk_index: int, creation_date: str | None = None, modification_date: str | None = None) -> DataFrame:
        return notes.note_content(self.notes, title, chunk_index, creation_date, modification_date)

    def get_note(self, title: str, creation_date: str) -> DataFrame:
        return notes.point_fetch(self.notes, title, creation_date)

    def list_notes(self) -> DataFrame:
        return notes.counts(self.notes)

    # search

    def search(self, text: str | None = None, limit: int = 1000, most: float = 0.8, low: str | None = None, high: str | None = None, field: str = "both", today: str = "", order: str = "best_first", vector: list[float] | None = None) -> DataFrame:
        """By a query, by dates, or both; the query's vector is embedded here unless given."""
        if text and vector is None and self.embedder is not None:
            vector = models.embed_query(self.spark, text, self.embedder)
        a, b = notes.search_dates(bool(text), low, high, today)
        titles = None if a is None and b is None else interactions.titles_in_range(self.notes, self.interactions, a, b)
        return search.search_api(self.notes, titles, text, vector, today, low, high, limit, most, field, order, self.full_text().postings() if text else None, self.vector_lists() if text and vector else None)

    def search_notes(self, text: str, vector: list[float] | None = None, least: float = 0.05) -> DataFrame:
        return search.search_notes(self.notes, text, vector, least, index=self.full_text().postings(), lists=self.vector_lists() if vector else None)

    def ranked(self, text: str, limit: int = 10, field: str = "chunk", every: bool = False) -> DataFrame:
        """The best chunks for a query by BM25, found in the stored index alone."""
        return self.full_text().ranked(text, field, every).orderBy(F.desc("score"), "doc_id").limit(limit)

    def phrase(self, text: str) -> DataFrame:
        """Chunks in which the words of text stand one after another, found in the stored index alone."""
        return self.full_text().phrase(text)

    # interactions

    def log_interaction(self, title: str, kind: str, now: str) -> bool:
        """Whether the event was logged: its kind is known and its title is a note."""
        if kind not in interactions.TYPES or self.notes.where(F.col("title") == title).isEmpty():
            return False
        new = self.spark.createDataFrame([(title, now, kind)], "title string, dt string, type string")
        self.interactions = interactions.log_interactions(self.interactions, new).select("title", "last_opened", "interaction_log")
        return True

    def open_notes(self, titles: DataFrame, now: str) -> None:
        self.interactions = interactions.merge_open(self.interactions, titles, now).select("title", "last_opened", "interaction_log")

    def interaction(self, title: str) -> DataFrame:
        return interactions.of_title(self.interactions, title)

    def recent_interactions(self, limit: int | None = 50) -> DataFrame:
        return interactions.recent(self.interactions, limit)

    def interactions_by_date(self, low: str | None, high: str | None) -> DataFrame:
        return interactions.by_date(self.notes, self.interactions, low, high)

    def interactions_by_titles(self, titles: list[str], low: str | None = None, high: str | None = None) -> DataFrame:
        return interactions.by_titles(self.interactions, titles, low, high)

    def history_dates(self) -> DataFrame:
        return interactions.history_dates(self.interactions)

    def history_day(self, day: str) -> DataFrame:
        return interactions.history_day(self.notes, self.interactions, day)

    # indexing

    def changes(self, current: DataFrame) -> DataFrame:
        """What a listing of note metadata has that is new or modified against the stored chunks."""
        return incremental.changes(current, self.notes.select("title", "creation_date", "modification_date").distinct())

    def reindex(self, changed: DataFrame, fetched: DataFrame) -> None:
        """Drops the chunks of modified notes and adds the fetched ones, which have the columns of the stored ones."""
        stay = incremental.without_modified(self.notes, changed)
        added = normalize_notes(fetched)
        if self._index is not None:
            self._index.remove(self.notes.join(stay.select("doc_id"), "doc_id", "left_anti"))
            self._index.add(added)
        self._lists = None
        self.notes = normalize_notes(stay.unionByName(added, allowMissingColumns=True))
