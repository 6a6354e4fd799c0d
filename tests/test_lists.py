"""Vector lists and trigrams against all distances and all texts, and what they read."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.engine import NoteEngine
from notewright.operators import search, vectors
from notewright.operators.trigrams import Trigrams, grams_of
from notewright.operators.vectors import VectorLists
from notewright.sources.pointer import Pointer
from notewright.sources.tables import notes_view

DIR = "/root/testdata/sf0.001"


def notes(spark, rows):
    return spark.createDataFrame([(i, f"k{k}", None if v is None else [None if x is None else float(x) for x in v]) for i, k, v in rows], "doc_id long, unique_key string, vector array<float>")


@pytest.fixture(scope="module")
def clustered():
    """Eight groups of vectors, some equal, and some that can't be indexed."""
    rng = np.random.default_rng(1)
    centre = rng.normal(size=(8, 6)) * 4
    x = np.concatenate([centre[rng.integers(0, 8, 300)] + rng.normal(size=(300, 6)), np.repeat(centre[:1], 40, axis=0)]).astype(np.float32)
    rows = [(i, i % 170, v) for i, v in enumerate(x)]
    return rows, [(900, 900, None), (901, 901, []), (902, 902, [1.0] * 5), (903, 903, [1.0, None, 1, 1, 1, 1]), (904, 904, [float("nan")] * 6), (905, 905, [float("inf")] * 6)]


def test_exact_search_is_the_plain_one(spark, clustered, tmp_path):
    good, bad = clustered
    df = notes(spark, good + bad)
    lists = VectorLists.build(df, f"{tmp_path}/v", 12)
    c, n, radius = lists.lists()
    assert n.sum() == len(good) and len(c) == 12
    plain = notes(spark, good)
    for q in ([0.0] * 6, [float(x) for x in good[7][2]], [50.0] * 6):
        for k, most in ((1, None), (5, None), (40, None), (400, None), (10, 3.0), (10, 0.0)):
            want = [tuple(r) for r in search.knn(plain, q, k, most).collect()]
            assert [tuple(r) for r in lists.knn(q, k, most).collect()] == want
            assert [tuple(r) for r in lists.knn(q, k, most, probes=12).collect()] == want
    files = len(lists.members().inputFiles())
    read = lists.members(lists._order(good[7][2])[0][:2].tolist())
    assert re.search(r"PartitionFilters: \[[^\]]*list", read._jdf.queryExecution().executedPlan().toString()) and len({r.list for r in read.select("list").distinct().collect()}) <= 2
    assert files >= np.count_nonzero(n) > 6
    far = lists.knn([float(x) for x in good[7][2]], 3)
    assert far.count() == 3 and (lists._order(good[7][2])[1] > 2).sum() > 3  # lists that the bound leaves out


def test_many_queries(spark, clustered, tmp_path, monkeypatch):
    good, bad = clustered
    lists = VectorLists.build(notes(spark, good[:200] + bad), f"{tmp_path}/v", 10)
    lists.add(notes(spark, good[200:]))
    queries = notes(spark, good[::3] + bad).select(F.col("doc_id").alias("query_id"), "vector")
    x = np.array([v for *_, v in good], np.float64)
    want = set()
    for i, _, v in good[::3]:
        d = ((x - np.float64(v)) ** 2).sum(axis=1)
        want |= {(i, int(j), p + 1) for p, j in enumerate(sorted(range(len(d)), key=lambda j: (round(d[j], 9), j))[:7])}
    for size in (vectors.MEMBERS, 11):
        monkeypatch.setattr(vectors, "MEMBERS", size)
        monkeypatch.setattr(vectors, "QUERIES", size)
        got = {(r.query_id, r.doc_id, r.place) for r in lists.neighbours(queries, 7, probes=1, exact=True).collect()}
        assert got == want
    some = {(r.query_id, r.doc_id) for r in lists.neighbours(queries, 7, probes=2).collect()}
    assert len(some & {w[:2] for w in want}) >= 0.8 * len(want)
    none = VectorLists.build(notes(spark, bad[:1]), f"{tmp_path}/none")
    assert none.knn([1.0], 3).count() == 0 and none.neighbours(queries.limit(0), 3).count() == 0


def test_recall_of_probed_lists(spark):
    from notewright.plans import QUERIES
    from notewright.plans.stored import lists_of

    d = "/root/testdata/sf0.1"
    got, want = ({(r.query_id, r.doc_id) for r in QUERIES[name](spark, d).collect()} for name in ("knn_lists_probed", "knn_lists_many"))
    recall = len(got & want) / len(want)
    print(f"recall {recall:.3f}, {len(lists_of(spark, d).lists()[0])} lists")
    assert recall >= 0.9


def test_the_engine_searches_by_its_lists(spark):
    e = NoteEngine(spark, notes_view(spark, DIR))
    q = [float(x) for x in e.notes.where("vector is not null").orderBy("doc_id").first()["vector"]]
    assert [tuple(r) for r in e.search("license", 5, 2.0, vector=q, today="2024-01-10").collect()] == [tuple(r) for r in search.search(e.notes, "license", q, 5, 2.0).collect()]
    assert [tuple(r) for r in e.search_notes("license", q).collect()] == [tuple(r) for r in search.search_notes(e.notes, "license", q).collect()]
    lists = e.vector_lists()
    e.reindex(e.changes(e.notes.select("title", "creation_date", "modification_date").distinct()), e.notes.limit(0))
    assert e.vector_lists() is not lists


# ---- trigrams


def test_substrings_are_those_of_a_scan(spark, tmp_path):
    rng = random.Random(5)
    letters = ["a", "b", "c", "É", "😀", " ", "%", "_", "\n", "'"]
    texts = {i: "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 2, 3, 20, 60]))) for i in range(150)} | {200: None, 201: "Abc " * 500, 202: "İstanbul ABC"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, chunk_content string")
    index = Trigrams.build(df.where("doc_id < 100"), f"{tmp_path}/g")
    index.add(df.where("doc_id >= 100").unionByName(df.limit(1).withColumn("doc_id", F.lit(None).cast("long"))))
    for query in ("abc", "ABC", "a%_", "é😀", "b\n", "abca bcab", "zzz", "abc zzz", "a b", "", "'b'", "abcabcabc", "aé% a"):
        pieces = query.split(" ")
        scan = df.where(F.col("chunk_content").isNotNull())
        for p in pieces:
            scan = scan.where(F.lower("chunk_content").contains(p.lower()))
        assert {r.doc_id for r in index.having(pieces).collect()} == {r.doc_id for r in scan.collect()}, query
        assert {r.doc_id for r in index.like_all(query).collect()} == {r.doc_id for r in df.where(search.like_all(query) & F.col("chunk_content").isNotNull()).collect()}, query
    assert grams_of("ab") == [] and grams_of("abcab") == ["abc", "bca", "cab"]


def test_few_texts_are_read(spark, tmp_path, monkeypatch):
    from notewright.operators import trigrams

    monkeypatch.setattr(trigrams, "BUCKET", 3)
    df = notes_view(spark, DIR)
    rare = df.withColumn("chunk_content", F.when(F.col("doc_id") == 17, F.concat("chunk_content", F.lit(" zebrawort"))).otherwise(F.col("chunk_content")))
    index = Trigrams.build(rare, f"{tmp_path}/g")
    _, state = index.pointer.read()
    found = index.like_all("Zebrawort")
    assert state["buckets"] > 50 and [r.doc_id for r in found.collect()] == [17]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ (IN \(\d+\)|= \d+)", plan) and re.search(r"PushedFilters: \[[^\]]*gram", plan)
    assert index.candidates(["zebrawort"]).count() == 1 and index.candidates(["qqqqq"]) is None


def test_an_index_that_dies_is_not_there(spark, tmp_path, monkeypatch):
    df = spark.createDataFrame([(1, "abcd")], "doc_id long, chunk_content string")
    index = Trigrams.build(df, f"{tmp_path}/g")
    monkeypatch.setattr(Pointer, "publish", lambda *a: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        index.add(df.withColumn("doc_id", F.lit(2)))
    assert [r.doc_id for r in index.having(["abc"]).collect()] == [1]


def test_lists_of_trigrams_hold_each_text_once(spark, monkeypatch):
    from notewright.operators import trigrams

    monkeypatch.setattr(trigrams, "HELD", 40)
    monkeypatch.setattr(trigrams, "PIECE", 7)
    texts = ["The License was released, the license", "ab", None, "", "\U0001f600\U0001f600x\U0001f600\U0001f600x", "ÀÉÎÀÉÎ été\n\n\nx", "nul\0nul\0nul", *(f"text number {i}" for i in range(30))]
    got = trigrams.lists(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).collect()
    have = sorted((r["gram"], i) for r in got for i in r["ids"])
    assert have == sorted((g, i) for i, t in enumerate(texts) for g in grams_of((t or "").lower()))
    assert all(r["n"] == len(r["ids"]) for r in got) and len(got) < len(have)
