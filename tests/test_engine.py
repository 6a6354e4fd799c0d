"""Each request of the engine answers on the test tables."""

import pytest

from notewright.engine import NoteEngine
from notewright.operators.models import HashingEmbedder
from notewright.sources.tables import events_view, interactions_table, notes_view

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def engine(spark):
    return NoteEngine(spark, notes_view(spark, DIR).cache(), interactions_table(events_view(spark, DIR)).cache(), HashingEmbedder(64))


def test_requests(engine):
    first = engine.notes.orderBy("doc_id").first()
    low, high = "2024-01-10", "2024-01-15"
    answers = {
        "stats": engine.stats(), "schema": engine.schema(), "points": engine.points(), "meta": engine.meta_clusters(), "filtered": engine.meta_clusters_filtered(low, high),
        "ids": engine.meta_clusters_by_ids("1,2"), "distance": engine.meta_clusters_by_distance({"1": [0.2, 0.4], "2": []}), "similar": engine.similar_clusters("1", least=0.0),
        "colors": engine.cluster_colors(), "sidebar": engine.cluster_sidebar("1"), "sidebar in dates": engine.cluster_sidebar("1", low, high), "notes in dates": engine.filtered_notes(low, high),
        "default": engine.default_cluster(), "content": engine.note_content(first.title, 0), "note": engine.get_note(first.title, first.creation_date), "list": engine.list_notes(),
        "search": engine.search("general public license", limit=10, today=high), "search in dates": engine.search("general public license", low=low, high=high, today=high), "dates": engine.search(low=low, high=high, today=high),
        "by note": engine.search_notes("general public license"), "recent": engine.recent_interactions(), "by date": engine.interactions_by_date(low, high), "by titles": engine.interactions_by_titles(["src1", "none"]),
        "history": engine.history_dates(), "day": engine.history_day("2024-01-12"), "one": engine.interaction("src1"),
    }
    assert {k: v.count() > 0 for k, v in answers.items()} == dict.fromkeys(answers, True)


def test_requests_are_the_queries(spark, engine):
    from notewright.plans import QUERIES

    rows = lambda df: sorted(map(str, df.collect()))
    same = {
        "meta_clusters": engine.meta_clusters(), "cluster_colors": engine.cluster_colors(), "points_projection": engine.points(), "history_dates": engine.history_dates(), "history_day": engine.history_day("2024-01-12"),
        "cluster_sidebar": engine.cluster_sidebar("1"), "similar_clusters": engine.similar_clusters("1", least=0.0), "interactions_by_date": engine.interactions_by_date("2024-01-10", "2024-01-15"), "default_cluster": engine.default_cluster(),
        "interactions_list": engine.recent_interactions(), "filtered_notes_all": engine.filtered_notes("2024-01-10", "2024-01-15"), "list_notes_counts": engine.list_notes(),
    }
    assert {k: rows(v) == rows(QUERIES[k](spark, DIR)) for k, v in same.items()} == dict.fromkeys(same, True)


def test_updates(spark, engine):
    own = NoteEngine(spark, engine.notes)
    assert not own.log_interaction("src1", "deleted", "2024-03-01T00:00:00Z") and not own.log_interaction("none", "opened", "2024-03-01T00:00:00Z")
    assert own.log_interaction("src1", "opened", "2024-03-01T00:00:00Z") and own.log_interaction("src1", "modified", "2024-03-02T00:00:00Z")
    own.open_notes(spark.createDataFrame([("src2",), ("src2",)], "title string"), "2024-03-03T00:00:00Z")
    assert {r.title: r.last_opened[:10] for r in own.recent_interactions().collect()} == {"src1": "2024-03-02", "src2": "2024-03-03"}
    assert own.interaction("src1").first()["n_events"] == 2
    listing = own.notes.select("title", "creation_date", "modification_date").distinct()
    changed = own.changes(listing.limit(3).selectExpr("title", "creation_date", "'2030-01-01' as modification_date"))
    assert {r.status for r in changed.collect()} == {"modified"}
    before = own.notes.count()
    own.reindex(changed, own.notes.limit(0))
    assert own.notes.count() < before
