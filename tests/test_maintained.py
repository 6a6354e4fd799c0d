"""Aggregates under random changes, listings from a slow source, and keywords by marginal relevance."""

import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_notes import note_rows

from notewright.operators import clusters, density, topics
from notewright.operators.keyed import KeyedTable
from notewright.operators.maintained import ClusterAggregates
from notewright.sources import listing
from notewright.sources.listing import ListedFiles, TooLong, patiently, read_listing

SCHEMA = "doc_id long, display_topic_id string, cluster_label string, meta_cluster_id string, meta_cluster_label string, modification_date string, vector array<float>"


def chunk(rng, i):
    topic = rng.choice(["0", "1", "1.2", "-1", None])
    vector = rng.choice([None, [rng.uniform(-3, 3), 1e-7 * rng.random(), 1e6 * rng.random()]])
    return (i, topic, f"label {rng.randrange(3)}", rng.choice(["0", "1"]), f"group {rng.randrange(2)}", rng.choice([None, "", " 2024-01-02", f"2024-01-{rng.randint(10, 28)}T10:00"]), vector)


def same(kept, notes):
    def rows(df):
        return sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.collect()), key=repr)

    notes = notes.where("display_topic_id is not null")
    assert rows(kept.cluster_facts()) == rows(clusters.cluster_facts(notes).select(kept.cluster_facts().columns))
    assert rows(kept.centroid_values()) == rows(clusters.centroid_values(notes))
    assert rows(kept.colors()) == rows(clusters.colors(notes)) and rows(kept.meta_clusters()) == rows(clusters.meta_clusters(notes))


def test_aggregates_after_random_changes_are_recomputed_ones(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    have = {i: chunk(rng, i) for i in range(60)}
    frame = lambda rows: spark.createDataFrame(list(rows), SCHEMA)
    kept = ClusterAggregates.build(frame(have.values()), f"{tmp_path}/a", buckets=3)
    same(kept, frame(have.values()))
    for number in range(1, 5):
        gone = rng.sample(sorted(have), 12)
        if number == 3:  # a whole cluster goes, and comes back with the next change
            gone = [i for i, r in have.items() if r[1] == "1.2"]
        removed = [have.pop(i) for i in gone]
        added = [chunk(rng, i) for i in ([*gone[:6], *range(100 * number, 100 * number + 4)] if number != 3 else [])]
        have |= {r[0]: r for r in added}
        change = frame(added), frame(removed), frame(have.values())
        if number == 2:  # it dies between its two tables, and is repeated

            def dies(self, *a, real=KeyedTable.upsert_keys):
                if self is kept.sums:
                    raise InterruptedError
                return real(self, *a)

            with monkeypatch.context() as m:
                m.setattr(KeyedTable, "upsert_keys", dies)
                with pytest.raises(InterruptedError):
                    kept.change(*change, number)
        kept.change(*change, number)
        kept.change(*change, number)  # a repeated change counts once
        same(kept, change[2])
    kept.change(frame([]), frame(have.values()), frame([]), 9)
    assert kept.cluster_facts().count() == 0 and kept.centroid_values().count() == 0


# ---- listings


def Slow(folder, n, delays):  # noqa: N802
    """A source whose class is local, so that it is sent whole to other processes."""

    class Source:
        """Items of which some windows answer only when they are asked again; attempts are counted in a folder, as they come from other processes."""

        def __init__(self, folder, n, delays):
            self.folder, self.n, self.delays = folder, n, delays

        def _items(self, since):
            items = [(f"t{i:03}", f"2024-01-{i % 28 + 1:02}", f"2024-01-{i % 14 + 1:02}" if i % 5 else None) for i in range(self.n)]
            return [x for x in items if since is None or max(x[1], x[2] or "") > since]

        def count(self, since):
            return len(self._items(since))

        def window(self, start, stop, since):
            import uuid

            (self.folder / f"{start}-{since}-{uuid.uuid4().hex}").touch()
            tries = len(list(self.folder.glob(f"{start}-*")))
            if start in self.delays and tries <= self.delays[start]:
                time.sleep(30)
            return self._items(since)[start:stop]

    return Source(folder, n, delays)


def test_listing_in_windows_with_repeats(spark, tmp_path):
    source = Slow(tmp_path, 130, {50: 1, 100: 2})
    found = read_listing(spark, source, limits=(4.0, 5.0, 6.0))
    rows = sorted(found.collect(), key=lambda r: r.place)
    assert [(r.title, r.creation_date, r.modification_date) for r in rows] == source._items(None) and [r.place for r in rows] == list(range(130))
    assert found.rdd.getNumPartitions() == 3
    tries = [len(list(tmp_path.glob(f"{start}-*"))) for start in (0, 50, 100)]
    assert tries == [1, 2, 3]


def test_listing_pushes_dates_and_stops_at_most(spark, tmp_path):
    source = Slow(tmp_path, 130, {})
    found = read_listing(spark, source, most=60).where("last_date > '2024-01-20' and title <> 't022'")
    want = [x for x in source._items("2024-01-20")[:60] if x[0] != "t022"]
    assert sorted((r.title, r.creation_date, r.modification_date) for r in found.collect()) == want
    asked = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir()}
    assert asked == {"0-2024-01-20"}  # one window of what the source left, not three of all
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isnotnull(last_date" in plan and not re.search(r"last_date#\d+ >", plan)  # the source has the comparison
    assert read_listing(spark, Slow(tmp_path, 0, {})).count() == 0
    assert read_listing(spark, Slow(tmp_path, 70, {})).where("last_date <= '2024-01-03'").count() == len([x for x in Slow(tmp_path, 70, {})._items(None) if max(x[1], x[2] or "") <= "2024-01-03"])


def test_a_request_that_takes_too_long(tmp_path):
    calls = []

    def slow():
        calls.append(1)
        time.sleep(3)

    with pytest.raises(TooLong, match="0.05, 0.1"):
        patiently((0.05, 0.1), slow)
    assert len(calls) == 2

    def fails():
        raise KeyError("x")

    with pytest.raises(KeyError):
        patiently((5.0, 5.0), fails)
    assert patiently((5.0,), lambda: 7) == 7 and listing.LIMITS == (300.0, 450.0, 600.0)


def test_listed_files(spark, tmp_path):
    rows = [("b", "2024-01-01", None), ("a", "2024-01-05", "2024-01-02"), (None, "2024-01-09", "2024-01-09")]
    spark.createDataFrame(rows, "title string, creation_date string, modification_date string").write.parquet(f"{tmp_path}/l")
    got = read_listing(spark, ListedFiles(f"file://{tmp_path}/l")).orderBy("place").collect()
    assert [(r.title, r.last_date) for r in got] == [("a", "2024-01-05"), ("b", "2024-01-01"), (None, "2024-01-09")]


# ---- keywords by marginal relevance, and one cluster's group


def test_diverse_keywords_are_those_of_plain_loops(spark):
    rng = random.Random(6)
    words = [f"{a}{b}" for a in "abcdefg" for b in ("xx", "yy", "zz")]
    df = note_rows(spark, [(i, "t", i, str(i % 4)) for i in range(60)])
    texts = {i: " ".join(rng.choice(words[(i % 4) * 3 : (i % 4) * 3 + 9]) for _ in range(15)) for i in range(60)}
    df = df.drop("chunk_content").join(spark.createDataFrame(list(texts.items()), "doc_id long, chunk_content string"), "doc_id")
    weight = {(r.topic, r.term): r.weight for r in topics.class_tfidf(df).collect()}
    all_topics = sorted({t for t, _ in weight})
    n, diversity, pool = 5, 0.3, 8
    want = {}
    for t in all_topics:
        top = sorted((-w, term) for (x, term), w in weight.items() if x == t)[:pool]
        most = max(-w for w, _ in top)
        profile = {term: np.array([weight.get((x, term), 0.0) for x in all_topics]) for _, term in top}
        unit = {k: v / max(np.linalg.norm(v), 1e-12) for k, v in profile.items()}
        chosen = []
        while len(chosen) < min(n, len(top)):
            score = {term: (1 - diversity) * -w / max(most, 1e-12) - (diversity * max(float(unit[term] @ unit[c]) for c in chosen) if chosen else 0) for w, term in top if term not in chosen}
            best = max(score.values())
            chosen.append(next(term for _, term in top if term in score and score[term] >= best - 1e-12))
        want[t] = chosen
    got = {}
    for r in sorted(topics.diverse_keywords(df, n, diversity, pool).collect(), key=lambda r: r["rank"]):
        got.setdefault(r.topic, []).append(r.term)
    assert got == want


def test_one_cluster_is_meta_0(spark):
    one = spark.createDataFrame([("7", [1.0, 2.0])], "cluster_id string, centroid array<double>")
    assert [tuple(r) for r in density.meta_linkage(one).select("cluster_id", "meta").collect()] == [("7", 0)]
    assert density.meta_linkage(one.where(F.lit(False))).count() == 0
