"""Stored structures: the full-text index with its updates, keyed tables, and what a write that dies leaves."""

import json
import math
import os
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notewright.engine import NoteEngine
from notewright.operators import fulltext
from notewright.operators.fulltext import FullText
from notewright.operators.keyed import KeyedTable
from notewright.sources.pointer import Conflict, Pointer
from notewright.sources.tables import notes_view
from notewright.streaming import interactions as stream

DIR = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def notes(spark, texts):
    return spark.createDataFrame([(i, t, "note x") for i, t in texts.items()], "doc_id long, chunk_content string, title string")


def slow_ranked(texts, query, every=False):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts.items()}
    terms, n = query.split(), len(texts)
    mean = sum(map(len, words.values())) / n
    df = {t: sum(t in w for w in words.values()) for t in terms}
    out = {}
    for i, w in words.items():
        c = Counter(w)
        have = [t for t in terms if c[t]]
        if have and (not every or len(have) == len(terms)):
            out[i] = sum(math.log(1 + (n - df[t] + 0.5) / (df[t] + 0.5)) * c[t] * 2.2 / (c[t] + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t in have)
    return out


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.endswith(".parquet"))


# ---- pointer


def test_pointer(spark, tmp_path):
    p = Pointer(spark, f"{tmp_path}/p")
    assert p.read() == (0, {}) and p.names("data") == []
    assert p.publish({"a": 1}, 0) == 1 and p.publish({"a": 2}, 1) == 2 and p.read() == (2, {"a": 2})
    with pytest.raises(Conflict):
        p.publish({"a": 3}, 1)
    assert Pointer(spark, f"{tmp_path}/p").read() == (2, {"a": 2})
    (tmp_path / "p/_states/_half").write_text("{")  # of a writer that died
    assert p.read() == (2, {"a": 2})
    for n in range(2, 12):
        p.publish({"a": n}, n)
    assert p.read() == (12, {"a": 11})


# ---- full text


def test_index_after_random_updates_is_a_rebuilt_one(spark, tmp_path):
    rng = random.Random(2)
    vocabulary = ["alpha", "beta", "gamma", "delta", "the", "Beta,", "x1", "é"]
    say = lambda: " ".join(rng.choice(vocabulary) for _ in range(rng.choice([0, 1, 5, 30])))
    texts = {i: say() for i in range(40)} | {40: None, 41: "", 42: "alpha beta"}
    index = FullText(spark, f"{tmp_path}/index", fanout=3)
    assert index.ranked("alpha").count() == 0 and index.statistics()[0] == 0
    index.add(notes(spark, texts).unionByName(notes(spark, {0: "dropped"}).withColumn("doc_id", F.lit(None).cast("long"))))
    for _ in range(5):
        new = {i: say() for i in rng.sample(range(60), 6)}
        index.add(notes(spark, new))
        texts |= new
        gone = rng.sample(range(70), 4)
        index.remove(spark.createDataFrame([(i,) for i in gone], "doc_id long"))
        texts = {i: t for i, t in texts.items() if i not in gone}
    whole = FullText(spark, f"{tmp_path}/whole")
    whole.add(notes(spark, texts))
    columns = ["term", "field", "doc_id", "tf", "positions", "length"]
    assert rows(index.postings().select(*columns)) == rows(whole.postings().select(*columns))
    assert index.statistics() == whole.statistics() and index.statistics()[0] == len(texts)
    for query in ("alpha", "beta gamma", "nothing", "alpha nothing"):
        for every in (False, True):
            got = {r.doc_id: r.score for r in index.ranked(query, every=every).collect()}
            assert got == pytest.approx(slow_ranked(texts, query, every))
    assert len(index._state()[1]["segments"]) < 6
    index.merge_all()
    assert len(index._state()[1]["segments"]) == 1 and not index._state()[1]["tombstones"]
    assert rows(index.postings().select(*columns)) == rows(whole.postings().select(*columns))
    assert index.vacuum() > 0 and index.vacuum() == 0
    assert rows(index.postings().select(*columns)) == rows(whole.postings().select(*columns))


def test_phrases_are_runs_of_words(spark, tmp_path):
    texts = {0: "a b a b c", 1: "A, b! C", 2: "a c b", 3: "b c a b", 4: None, 5: "a b", 6: "a a a a"}
    index = FullText(spark, f"{tmp_path}/index")
    index.add(notes(spark, texts))
    for phrase in ("a b", "a b c", "a a", "a a a", "b", "a b a b", "c a", "", "zebra a"):
        w, want = fulltext.tokens(phrase), set()
        for i, t in texts.items():
            words = fulltext.tokens(t)
            starts = [k for k in range(len(words) - len(w) + 1) if words[k : k + len(w)] == w]
            if w and starts:
                want.add((i, tuple(starts)))
        assert {(r.doc_id, tuple(r.starts)) for r in index.phrase(phrase).where("field = 'chunk'").collect()} == want
    assert index.phrase("note x").where("field = 'title'").count() == len(texts)


def test_index_is_read_instead_of_the_texts(spark, tmp_path):
    index = FullText(spark, f"{tmp_path}/index")
    index.add(notes_view(spark, DIR))
    for found in (index.ranked("general public license"), index.phrase("general public license")):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "chunk_content" not in plan and "documents.parquet" not in plan
        assert re.search(r"PushedFilters: \[[^\]]*In\(term", plan), plan


def test_an_update_writes_in_proportion_to_itself(spark, tmp_path):
    index = FullText(spark, f"{tmp_path}/index")
    n = notes_view(spark, DIR)
    index.add(n)
    whole = size_of(tmp_path)
    index.add(n.where("doc_id < 4"))
    index.remove(n.where("doc_id = 9").select("doc_id"))
    assert size_of(tmp_path) - whole < whole / 5


def test_an_index_update_that_dies_leaves_the_index(spark, tmp_path, monkeypatch):
    index = FullText(spark, f"{tmp_path}/index")
    index.add(notes(spark, {1: "alpha", 2: "beta"}))
    monkeypatch.setattr(Pointer, "publish", lambda *a: 1 / 0)
    for change in (lambda: index.add(notes(spark, {1: "beta", 3: "alpha"})), lambda: index.remove(notes(spark, {2: ""}))):
        with pytest.raises(ZeroDivisionError):
            change()
        assert {r.doc_id for r in index.ranked("alpha").collect()} == {1} and index.statistics()[0] == 2


def test_the_engine_searches_and_updates_its_index(spark):
    e = NoteEngine(spark, notes_view(spark, DIR).where("doc_id < 60").select("doc_id", "title", "creation_date", "modification_date", "chunk_index", "chunk_content", "vector"))
    first = e.notes.orderBy("doc_id").first()
    word = fulltext.tokens(first.chunk_content)[0]
    assert first.doc_id in {r.doc_id for r in e.phrase(word).collect()}
    index = e.full_text()
    listing = e.notes.select("title", "creation_date", "modification_date").distinct()
    changed = e.changes(listing.where(F.col("title") == first.title).withColumn("modification_date", F.lit("2030-01-01")))
    fetched = e.notes.where(F.col("doc_id") == first.doc_id).withColumn("chunk_content", F.lit("zebrawort grows here")).withColumn("modification_date", F.lit("2030-01-01"))
    e.reindex(changed, fetched)
    assert e.full_text() is index and [r.doc_id for r in e.ranked("zebrawort").collect()] == [first.doc_id]
    rebuilt = NoteEngine(spark, e.notes).full_text()
    assert rows(index.postings().select("term", "field", "doc_id", "tf")) == rows(rebuilt.postings().select("term", "field", "doc_id", "tf"))
    assert index.statistics() == rebuilt.statistics()


# ---- keyed tables


def test_keyed_table_after_random_updates(spark, tmp_path):
    rng = random.Random(3)
    schema = "title string, day string, n long"
    make = lambda: [(rng.choice(["a", "b", "c", "d", None]), rng.choice(["1", "2", None]), rng.randint(0, 9)) for _ in range(rng.randint(0, 5))]
    have = make() + make()
    t = KeyedTable.create(spark.createDataFrame(have, schema), f"{tmp_path}/t", ["title", "day"], 7)
    with pytest.raises(Conflict):
        KeyedTable.create(spark.createDataFrame([], schema), f"{tmp_path}/t", ["title", "day"], 7)
    for _ in range(6):
        new = make()
        keys = {r[:2] for r in new}
        kind = rng.choice(["upsert", "delete", "append"])
        getattr(t, kind)(spark.createDataFrame(new, schema))
        if kind != "append":
            have = [r for r in have if r[:2] not in keys]
        have += new if kind != "delete" else []
        assert rows(t.read()) == sorted(have, key=repr)
        asked = make()
        assert rows(t.lookup(spark.createDataFrame(asked, schema))) == sorted((r for r in have if r[:2] in {x[:2] for x in asked}), key=repr)
    t.replace(t.read().where("n > 3").withColumn("more", F.lit(1)))
    want = sorted(((*r, 1) for r in have if r[2] > 3), key=repr)
    assert rows(t.read()) == want and t.vacuum() > 0 and rows(t.read()) == want
    t.delete(t.read())
    assert t.read().count() == 0 and t.read().columns == ["title", "day", "n", "more"]


def test_an_update_rewrites_only_the_buckets_of_its_keys(spark, tmp_path):
    df = spark.range(1000).selectExpr("id % 200 as k", "id as v")
    t = KeyedTable.create(df, f"{tmp_path}/t", ["k"], 50)
    before = t._state()[1]["folders"]
    t.upsert(spark.createDataFrame([(7, -1), (7, -2), (11, -3)], "k long, v long"))
    after = t._state()[1]["folders"]
    changed = [b for b in after if after[b] != before.get(b)]
    assert 1 <= len(changed) <= 2 and len(after) == len(before)
    assert t.read().count() == 1000 - 10 + 3
    read = t.lookup(spark.createDataFrame([(7,)], "k int"))
    assert {r.v for r in read.collect()} == {-1, -2} and len(read.inputFiles()) <= 4
    written = [f for f in os.listdir(tmp_path / "t/data") if f not in set(before.values())]
    assert len(written) == 1 and len([n for n in os.listdir(tmp_path / "t/data" / written[0]) if "=" in n]) == len(changed)


def test_a_write_that_dies_leaves_the_old_rows(spark, tmp_path, monkeypatch):
    """It dies at each call to the file system or the writer in turn; readers see the old or the new rows."""
    old, new = [("a", 1), ("b", 2)], [("a", 9), ("b", 2)]
    t = KeyedTable.create(spark.createDataFrame(old, "k string, v long"), f"{tmp_path}/t", ["k"], 4)
    steps = [(Pointer, "read"), (Pointer, "names"), (Pointer, "publish"), (Pointer, "version"), (KeyedTable, "_write"), (KeyedTable, "_buckets")]
    for kind, name in steps:
        for after in (False, True):
            real = getattr(kind, name)

            def dies(*a, **b):
                if after:
                    real(*a, **b)
                raise InterruptedError

            with monkeypatch.context() as m:
                m.setattr(kind, name, dies)
                with pytest.raises(InterruptedError):
                    t.upsert(spark.createDataFrame([("a", 9)], "k string, v long"))
            got = rows(t.read())
            assert got in (old, new)
            if got == new:
                t.upsert(spark.createDataFrame([("a", 1)], "k string, v long"))
    assert t.vacuum() > 0 and rows(t.read()) == old


def test_two_writers_do_not_mix(spark, tmp_path, monkeypatch):
    t = KeyedTable.create(spark.createDataFrame([("a", 1)], "k string, v long"), f"{tmp_path}/t", ["k"], 4)
    real, other = KeyedTable._buckets, KeyedTable(spark, f"{tmp_path}/t")

    def meanwhile(self, *a):
        if self is t:
            other.upsert(spark.createDataFrame([("b", 2)], "k string, v long"))
        return real(self, *a)

    monkeypatch.setattr(KeyedTable, "_buckets", meanwhile)
    with pytest.raises(Conflict):
        t.upsert(spark.createDataFrame([("a", 3)], "k string, v long"))
    assert rows(t.read()) == [("a", 1), ("b", 2)]


def test_a_stream_merges_each_batch_exactly_once(spark, tmp_path, monkeypatch):
    source, log = tmp_path / "events", [("a", "2024-01-01T00:00:00Z", '[{"dt":"2024-01-01T00:00:00Z","type":"opened"}]')]
    source.mkdir()
    t = KeyedTable.create(spark.createDataFrame(log, "title string, last_opened string, interaction_log string"), f"{tmp_path}/t", ["title"], 4)
    (source / "1.json").write_text('{"title": "a", "dt": "2024-01-02T00:00:00Z", "type": "opened"}\n{"title": "b", "dt": "2024-01-03T00:00:00Z", "type": "opened"}\n')
    real = Pointer.publish

    def dies(self, *a):
        real(self, *a)
        raise InterruptedError("behind the publication, before the stream's own checkpoint")

    with monkeypatch.context() as m:
        m.setattr(Pointer, "publish", dies)
        with pytest.raises(Exception, match="publication"):
            stream.merge_keyed(stream.read_events(spark, str(source)), t, str(tmp_path / "check")).awaitTermination()
    for _ in range(2):
        stream.merge_keyed(stream.read_events(spark, str(source)), t, str(tmp_path / "check")).awaitTermination()
    (source / "2.json").write_text('{"title": "a", "dt": "2024-01-04T00:00:00Z", "type": "opened"}\n')
    stream.merge_keyed(stream.read_events(spark, str(source)), t, str(tmp_path / "check")).awaitTermination()
    assert {r.title: (r.last_opened[:10], len(json.loads(r.interaction_log))) for r in t.read().collect()} == {"a": ("2024-01-04", 3), "b": ("2024-01-03", 1)}
