"""Gathered topics: texts are cut into words once, and topics that are labelled twice are gathered once."""

from notewright.operators import models, topics
from notewright.plans import stored
from notewright.sources.tables import notes_view

DIR = "/root/testdata/sf0.001"


def test_words_are_cut_once(spark):
    n = notes_view(spark, DIR)
    plan = topics.class_tfidf(n, "display_topic_id")._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "/tfidf-" in topics.class_tfidf(n).inputFiles()[0]


def test_topics_labelled_twice_are_gathered_once(spark, monkeypatch):
    calls, own = [], models.gather_topics
    monkeypatch.setattr(stored.models, "gather_topics", lambda *x: calls.append(1) or own(*x))
    assert stored.labels_resumed(spark, DIR).count() > 0 and len(calls) == 1
