"""Unit cases of sources, sinks, orders and plans that have another way for large inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_notes import column, note_rows

from notewright.functions import numbers as num
from notewright.functions import text as tx
from notewright.operators import catalog, density, layout, models, search, topics
from notewright.sources import shared, tables


def test_scratch_deletes_what_its_result_does_not_need(spark):
    scratch = shared.Scratch(spark, "test")
    a, b = scratch.write(spark.range(5), "a"), scratch.write(spark.range(7), "b", 7)
    assert len(b.inputFiles()) == 1 and a.count() == 5
    out = scratch.last(a.union(b), "out")
    assert out.count() == 12 and list(scratch.paths) == [out._notewright_path]
    assert not shared.exists(spark, a._notewright_path) and shared.exists(spark, f"{out._notewright_path}/_SUCCESS")


def test_shared_folder_is_that_of_the_session(spark):
    assert shared.shared_dir(spark) == spark.sparkContext.getConf().get("spark.checkpoint.dir")

    class Cluster:
        class conf:
            get = staticmethod(lambda *a: None)

        class sparkContext:
            master = "yarn"
            getConf = staticmethod(lambda: {})

            class _jsc:
                class sc:
                    def getCheckpointDir(self):
                        return type("none", (), {"isDefined": lambda self: False})()

    with pytest.raises(ValueError, match="checkpoint"):
        shared.shared_dir(Cluster())


def test_batches_and_chunk_numbers(spark, tmp_path, monkeypatch):
    listing = spark.createDataFrame([(f"t{i:03}", i) for i in range(130)], "title string, n int").repartition(5)
    got = tables.source_batches(listing, ["title"], 50, 120).orderBy("place").collect()
    assert [r.place for r in got] == list(range(120)) and [r.title for r in got] == [f"t{i:03}" for i in range(120)]
    assert {r.batch for r in got} == {0, 1, 2} and got[49].batch == 0 and got[50].batch == 1
    assert tables.source_batches(listing.limit(0), ["title"]).count() == 0
    rows = [(i, "x", "en" if i % 3 else None, "src1", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, [1.0], 1)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    monkeypatch.setattr(tables, "RANGE", 7)
    for lang in ("en", None):
        own = tables.notes_view(spark, str(tmp_path)).where(F.col("lang").eqNullSafe(F.lit(lang))).orderBy("doc_id").collect()
        assert [r.chunk_index for r in own] == list(range(len(own))) and {r.total_chunks for r in own} == {len(own)}


def test_overwrite_and_embedding_on_write(spark):
    df = note_rows(spark, [(i, "a", i, "1") for i in range(3)]).select("doc_id", "title", "chunk_content", "vector")
    catalog.create(df, "notes_more", fresh=True)
    assert catalog.append_embedded(df.drop("vector"), "notes_more", models.HashingEmbedder(8)) == 6
    assert spark.table("notes_more").where(F.size("vector") == 8).count() == 3
    catalog.overwrite(spark.table("notes_more").where("doc_id = 1"), "notes_more")  # reads the table that it replaces
    assert spark.table("notes_more").count() == 2 and not spark.catalog.tableExists("notes_more_old_copy")
    spark.sql("DROP TABLE notes_more")


def test_text_forms(spark):
    assert column(spark, tx.unescape, "a &lt;b&gt; &amp;lt; &nbsp;", "&eacute;t&eacute; &#233; &ltx", None) == ["a <b> &lt;  ", "été é <x", None]
    assert column(spark, tx.as_list, "['a', 'b']", '["x"]', "plain", "[broken", None) == [["a", "b"], ["x"], ["plain"], ["[broken"], []]
    q = column(spark, tx.keyword_queries, "When will we discuss moving garden fences?", "alpha beta", 'say "alpha beta" gamma')
    assert q[0].terms == ["discuss", "moving", "garden", "fences"] and q[0].phrase is None and q[0].last_three == "moving garden fences"
    assert q[1].phrase == "alpha beta" and q[1].last_three is None and q[2].phrase == 'say "alpha beta" gamma'
    df = spark.createDataFrame([(x,) for x in ("10", "2", "2.10", "2.9", "-1", "x", "2.x", "2.x.1")], "id string")
    assert [r[0] for r in df.orderBy(num.dotted_parts(F.col("id"))).collect()] == ["-1", "2", "2.9", "2.10", "2.x", "2.x.1", "10", "x"]
    assert [r[0] for r in spark.createDataFrame([("b 10",), ("B 9",), ("a",)], "id string").orderBy(num.natural_key(F.col("id"))).collect()] == ["a", "B 9", "b 10"]


def test_nearest_chunks_when_keys_repeat(spark):
    df = note_rows(spark, [(i, "same", 0, "1") for i in range(60)] + [(60 + i, f"t{i}", 0, "1") for i in range(4)])
    got = search.knn(df, [0.0, 1.0], 3).orderBy("distance").collect()
    assert [r.doc_id for r in got] == [0, 60, 61]  # sixty chunks of one key count once
    assert search.knn(df, [0.0, 1.0], 99).count() == 5 and search.knn(df, [0.0, 1.0], 3, 0.5).count() == 1
    assert search.knn(df.limit(0), [0.0, 1.0], 3).count() == 0


def test_texts_are_found_by_a_rare_inner_word(spark):
    notes = note_rows(spark, [(i, "t", i, "1") for i in range(6)])
    notes = notes.withColumn("chunk_content", F.element_at(F.array(*map(F.lit, ("partly common words of old", "common words", "some common rare words here", "x common rare words y", "", "ab"))), (F.col("doc_id") + 1).cast("int")))
    texts = spark.createDataFrame([(1, "tly common words"), (2, "common rare words"), (3, "common words"), (4, "b"), (5, "never seen at all"), (6, ""), (7, "common RARE words")], "text_id long, text string")
    got = {r.text_id: (r.doc_id, r.how) for r in models.find_texts(texts, notes).collect()}
    assert got == {1: (0, "inside"), 2: (2, "inside"), 3: (1, "exact"), 4: (5, "inside"), 6: (4, "exact")}


def test_centroids_too_many_to_broadcast(spark, monkeypatch):
    rng = np.random.default_rng(4)
    df = note_rows(spark, [(i, "t", i, str(i % 4 - 1)) for i in range(40)])
    vectors = spark.createDataFrame([(i, rng.normal(size=3).tolist()) for i in range(40)], "doc_id long, vector array<float>")
    df = df.drop("vector").join(vectors, "doc_id")
    want = sorted(map(tuple, topics.reassign_by_vector(df, -1.0).collect()))
    assert len(want) == 10
    m = topics.membership(df).collect()
    assert all(sum(r.probabilities) == pytest.approx(1) and r.topics == ["0", "1", "2"] for r in m)
    monkeypatch.setattr(topics, "MOST_CENTROIDS", 1)
    assert sorted(map(tuple, topics.reassign_by_vector(df, -1.0).collect())) == want
    with pytest.raises(ValueError):
        topics.membership(df)


def test_splits(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "0", [float(v) for v in rng.normal((i % 2) * 9, 0.2, 2)]) for i in range(120)] + [(200 + i, "1.2.3.4", [float((i % 2) * 9), 0.0]) for i in range(120)] + [(400 + i, "-1", [0.0, 0.0]) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, display_topic_id string, reduced array<double>")
    got = {r.doc_id: r.display_topic_id for r in density.mega_split(df, 100).collect()}
    assert len(got) == 360 and {got[i] for i in range(120)} == {"0.0", "0.1"}
    assert {got[200 + i] for i in range(120)} == {"1.2.3.4"} and {got[400 + i] for i in range(120)} == {"-1"}  # too deep, and outliers
    assert density.mega_size(40) == 5 and density.mega_size(1000) == 20 and density.split_size(1000) == 10
    assert density.recursive_split(df, 1000).count() == 360 and density.recursive_split(df.limit(0)).count() == 0


def test_labeler_asks_a_service(spark):
    sent = []
    ask = models.ChatLabeler("http://none", "m", documents=2, post=lambda url, body: sent.append((url, body)) or '```json\n{"label": "Short label."}\n```')
    assert ask(["a", "b"], ["one", "two", "three"]) == "Short label." and "three" not in sent[0][1]["messages"][0]["content"] and sent[0][1]["options"] == {"temperature": 0}
    found = spark.createDataFrame([("1", ["k"], ["d"]), ("2", ["broken", "x"], ["d"])], "topic string, keywords array<string>, documents array<string>")
    got = {r.topic: r.label for r in models.label_topics(found, lambda k, d: "Fine one." if k == ["k"] else 1 / 0).collect()}
    assert got == {"1": "Fine one", "2": "broken & x"}


def test_stored_model(spark, tmp_path):
    df = note_rows(spark, [(i, "t", i, z) for i, z in enumerate(("1", "1.0", "1.0.2", "2"))]).withColumn("chunk_content", F.concat(F.lit("word topic "), F.element_at(F.array(F.lit("aa"), F.lit("bb"), F.lit("cc"), F.lit("dd")), (F.col("doc_id") + 1).cast("int"))))
    models.save_model(df, str(tmp_path / "m"))
    terms, _ = models.load_model(spark, str(tmp_path / "m"))
    assert {r.topic for r in terms.collect()} == {"1", "1.0", "1.0.2", "2"}
    assert {(r.model, r.n_topics, r.depth, r.n_chunks) for r in models.load_manifest(spark, str(tmp_path / "m")).collect()} == {("1", 3, 3, 3), ("2", 1, 1, 1)}
    only = terms.where("topic in ('1', '2')")  # a sub-model without terms of its own takes those above it
    got = {r.topic: sorted(r.keywords) for r in models.gather_topics(df.withColumn("confidence", F.lit(1.0)), only).collect()}
    assert got["1.0.2"] == got["1.0"] == got["1"] and "aa" in got["1"] and "dd" in got["2"]


def test_result_attributes_and_orders(spark):
    df = note_rows(spark, [(0, "a", 0, "1"), (1, "a", 0, "2"), (2, "b", 1, "1.3")])
    results = df.where("doc_id <> 1").select("doc_id", "unique_key", "title", "creation_date", "modification_date", "chunk_index", "total_chunks", "chunk_content", F.lit(1.5).alias("score"), F.lit("fts").alias("source"), (F.col("doc_id") + 1).alias("place"))
    got = {r.doc_id: (r.cluster_id, r.cluster_label) for r in search.hit_attributes(results, df.where("title = 'a'")).collect()}
    assert got == {0: ("2", "L"), 2: ("-1", "Unknown")}  # of points with one key the last
    lines = [r.line for r in search.result_lines(search.hit_attributes(results, df)).orderBy("place").collect()]
    assert lines[0] == "• a [chunk 0/1] (cluster: L, score: 1.500)\n    text 0"
    pointed = layout.results_with_points(results, df)
    assert [r.doc_id for r in layout.sort_results(pointed, "size").collect()] == [0, 2] and [r.doc_id for r in layout.sort_results(pointed, "modified", False).collect()] == [2, 0]
    clusters = spark.createDataFrame([("1", "B", 5, 2), ("2", "a", 9, 1), ("10", "c", 5, None)], "cluster_id string, label string, chunk_count int, history_rank int")
    order = lambda *a: [r.cluster_id for r in layout.sort_clusters(clusters, *a).collect()]
    assert order("az") == ["2", "1", "10"] and order("size") == ["1", "10", "2"] and order("history") == ["1", "2", "10"] and order("history", False) == ["2", "1", "10"]
