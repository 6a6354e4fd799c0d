"""What is held and moved at once stays in proportion, and results stay whole, where tables are large or odd."""

import numpy as np
import pytest

from notewright.operators import chunking, density, fulltext, memberships, models
from notewright.sources.tables import notes_view

BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


@pytest.mark.parametrize("cut", [chunking.window_rows, chunking.chunk_notes, lambda n: models.embed(n, "text")])
def test_few_texts_go_to_python_at_once(spark, cut):
    spark.conf.set(BATCH, "10000")
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "x" * 4000)], "doc_id long, text string")
    assert {r.doc_id for r in cut(rows).collect()} >= {1, 3}
    assert int(spark.conf.get(BATCH)) <= 512


def test_windows_of_null_texts(spark):
    rows = spark.createDataFrame([(1, "a b"), (2, None), (3, "x" * 4000)], "doc_id long, text string")
    assert sorted((r.doc_id, r.place, len(r.chunk)) for r in chunking.window_rows(rows).collect()) == [(1, 0, 3), (3, 0, 1600), (3, 1, 1600), (3, 2, 1200)]


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_postings_are_made_where_texts_are(spark):
    rows = spark.createDataFrame([(1, "a b A", "t"), (2, None, "t u"), (3, "", None)], "doc_id long, chunk_content string, title string")
    got = fulltext.positional(rows)
    assert "Exchange" not in plan(got)
    assert sorted(tuple(r) for r in got.collect()) == [("a", "chunk", 1, 2, [0, 2], 3), ("b", "chunk", 1, 1, [1], 3), ("t", "title", 1, 1, [0], 1), ("t", "title", 2, 1, [0], 2), ("u", "title", 2, 1, [1], 2)]


def test_notes_view_moves_a_text_once_and_keeps_every_row(spark, tmp_path):
    docs = [(5, "a", "en", "src1"), (1, "b", "en", "src1"), (5, "c", "en", "src1"), (None, "d", "en", "src1"), (7, "e", None, "src1"), (2, None, "fr", "src2")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, [0.5], 6), (7, [1.0], 2)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = notes_view(spark, str(tmp_path))
    rows = {r.chunk_content: (r.doc_id, r.chunk_index, r.total_chunks, r.base_topic_id, r.vector) for r in got.collect()}
    assert rows["b"] == (1, 0, 4, "1", [0.5]) and rows["d"] == (None, 3, 4, "-1", None) and rows["e"] == (7, 0, 1, "2", [1.0]) and rows[None] == (2, 0, 1, "-1", None)
    assert sorted(rows[t][1] for t in "ac") == [1, 2] and rows["a"][2] == rows["c"][2] == 4
    moved = [line for line in got._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Window" in line or "Aggregate" in line]
    assert moved and not any("text#" in line for line in moved)
    assert "Sort [text" not in plan(got) and "ShuffledHashJoin" in plan(got)


def test_large_clusters_are_split_by_all_executors(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.05, (150, 2)) for m in ((0, 1), (3, 1), (0, 4), (9, 9))])
    df = spark.createDataFrame([(i, "7" if i < 450 else "8", v.tolist()) for i, v in enumerate(x)], "doc_id long, display_topic_id string, reduced array<double>")
    want = {r.doc_id: r.display_topic_id for r in density.recursive_split(df, 300).collect()}
    asked, spread = [], density._spread
    monkeypatch.setattr(density, "LOCAL_ROWS", 300)
    monkeypatch.setattr(density, "_spread", lambda spark, n: asked.append(n) or spread(spark, n))
    got = {r.doc_id: r.display_topic_id for r in density.recursive_split(df, 300).collect()}
    assert asked == [450] and len(set(zip(got.values(), (want[i] for i in got)))) == len(set(want.values())) == len(set(got.values())) == 4


def test_the_driver_gets_no_lists_of_a_split_and_sends_no_rows(spark, monkeypatch):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(m, 0.05, (150, 2)) for m in ((0, 1), (3, 1), (0, 4))] * 3)
    df = spark.createDataFrame([(f"d{i}", "7", v.tolist()) for i, v in enumerate(x)], "doc_id string, display_topic_id string, reduced array<double>")
    want = {r.doc_id: r.display_topic_id for r in density.recursive_split(df, 300).collect()}
    monkeypatch.setattr(density, "LOCAL_ROWS", 300)
    monkeypatch.setattr(density, "LEAF", 32)
    got, sent, kind, session = [], [], type(df), type(spark)
    for name in ("toArrow", "toPandas"):
        collect = getattr(kind, name)
        monkeypatch.setattr(kind, name, lambda d, f=collect: got.append(f(d)) or got[-1])
    create = session.createDataFrame
    monkeypatch.setattr(session, "createDataFrame", lambda s, data, *a, **k: sent.append(len(data)) or create(s, data, *a, **k))
    out = density.recursive_split(df, 300)
    assert got and max(len(t) for t in got) <= len(x) and not [n for n in sent if n >= len(x)]
    monkeypatch.undo()
    have = {r.doc_id: r.display_topic_id for r in out.collect()}
    assert len(have) == len(x) and len(set(zip(have.values(), (want[i] for i in have)))) == len(set(want.values())) == len(set(have.values()))


def test_noise_joins_children_by_blocks_of_rows(monkeypatch):
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.normal(m, 0.05, (40, 2)) for m in ((1, 9), (9, 1), (6, 6))] + [rng.uniform(2, 20, (30, 2))])
    want = density.split_children(x, 10, 2)
    monkeypatch.setattr(density, "TILE", 7)
    made, closest = [], density._closest
    monkeypatch.setattr(density, "_closest", lambda *a: made.append(a[2]) or closest(*a))
    assert (density.split_children(x, 10, 2) == want).all() and made == [7 // (want.max() + 1)] and want.max() >= 2


def test_equal_rows_are_asked_once_and_hang_together():
    rng = np.random.default_rng(6)
    x = np.repeat(rng.normal(size=(40, 3)), 30, axis=0)[rng.permutation(1200)]
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    core = np.sort(d, axis=1)[:, 3]
    _, _, want = density._dense_tree(x, 3)
    old, density.LOCAL_ROWS = density.LOCAL_ROWS, 0
    try:
        a, b, w = density._tree(x, 3)
    finally:
        density.LOCAL_ROWS = old
    assert w == pytest.approx(want, abs=1e-6) and w == pytest.approx(np.maximum(d[a, b], np.maximum(core[a], core[b]))) and (w == 0).sum() == 1160
    assert len(np.unique(density._equal_rows(x))) == 40


def test_pruned_distances_are_all_that_count():
    rng = np.random.default_rng(5)
    x = rng.normal(0, 1, (900, 4))
    _, leaves = density._leaves(x)
    d = np.sqrt(((leaves.x[:, None] - leaves.x[None]) ** 2).sum(2))
    for leaf in range(len(leaves.starts) - 1):
        got = leaves.nearest(12, leaf)
        rows = got["row"].to_numpy().reshape(-1, 12)[:, 0]
        assert np.allclose(got["distance"].to_numpy().reshape(-1, 12), np.sort(d[rows], axis=1)[:, :12])
    core = np.sort(d, axis=1)[:, 3]
    reach, part = np.maximum(d, np.maximum(core[:, None], core[None])), rng.integers(0, 3, 900)
    want = np.where(part[:, None] != part[None], reach, np.inf).min(1)
    for leaf in range(len(leaves.starts) - 1):
        got = leaves.outside(core, part, np.ones(900, bool), np.full(900, np.inf), leaf)
        assert np.allclose(got["distance"], want[got["row"]]) and len(got) == leaves.starts[leaf + 1] - leaves.starts[leaf]


def test_nearest_exemplars_by_tiles(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(m, 0.05, (40, 2)) for m in ((0, 1), (3, 1), (0, 4))])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "doc_id long, reduced array<double>")
    m = memberships.Memberships.fit(df, f"file://{tmp_path}/m")
    monkeypatch.setattr(memberships, "TILE", 5)
    got = {r.doc_id: r._d for r in m._nearest(m.rows()).collect()}
    known = [(r.cluster, np.array(r.point)) for r in m.known().collect()]
    for i, v in enumerate(x):
        want = [min(np.sqrt(((v - p) ** 2).sum()) for c, p in known if c == k) for k in range(3)]
        assert got[i] == pytest.approx(want)
