"""Reduction by a neighbour graph: weights against plain loops, places against the whole matrix and against PCA."""

import math

import numpy as np
import pytest

from notewright.operators import graph


def frame(spark, x, parts=4):
    return spark.createDataFrame([(i, None if v is None else [None if a is None else float(a) for a in v]) for i, v in enumerate(x)], "doc_id long, vector array<float>").repartition(parts)


def places(df):
    return {r.doc_id: np.array(r.reduced) for r in df.collect()}


def nearest(y, k):
    d = ((y[:, None] - y[None]) ** 2).sum(-1)
    np.fill_diagonal(d, np.inf)
    return [set(r) for r in np.argsort(d, 1, kind="stable")[:, :k]]


@pytest.fixture(scope="module")
def ring():
    """A closed curve that turns through twelve dimensions: any two of them fold it."""
    rng = np.random.default_rng(3)
    t = np.sort(rng.random(240)) * 2 * np.pi
    x = np.stack([f(h * t) for h in (1, 2, 3, 5, 7, 9) for f in (np.sin, np.cos)], 1)
    return x @ np.linalg.qr(rng.normal(size=(12, 12)))[0]


def plain_weights(x, near):
    n = len(x)
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = np.sqrt(((u[:, None] - u[None]) ** 2).sum(-1))
    p = np.zeros((n, n))
    for i in range(n):
        js = sorted((j for j in range(n) if j != i), key=lambda j: (d[i, j], j))[:near]
        first, low, high = d[i, js[0]], 0.0, 1000.0
        for _ in range(100):
            width = (low + high) / 2
            if sum(math.exp(-(d[i, j] - first) / width) for j in js) > math.log2(near + 1):
                high = width
            else:
                low = width
        for j in js:
            p[i, j] = math.exp(-(d[i, j] - first) / width)
    return p + p.T - p * p.T


def test_weights_and_places_are_those_of_the_whole_matrix(spark, ring, tmp_path):
    x = ring[::4].astype(np.float32).astype(float)
    _, nodes = graph.different(frame(spark, x))
    index = graph.VectorLists.build(nodes, f"{tmp_path}/lists", 4)
    found = index.neighbours(nodes.selectExpr("doc_id AS query_id", "vector"), 7, 4).where("query_id <> doc_id")
    got = np.zeros((len(x), len(x)))
    for r in graph.weights(found, 7).collect():
        got[r.i, r.j] = r.w
    want = plain_weights(x, 6)
    assert np.abs(got - want).max() < 1e-4 and (got > 0).sum() > 6 * len(x)
    y = places(graph.spectral(frame(spark, x), k=2, near=6, probes=99, rounds=12, lists=8))
    d = want.sum(1)
    value, vector = np.linalg.eigh(want / np.sqrt(d)[:, None] / np.sqrt(d)[None])
    slow = (vector[:, ::-1][:, 1:3]) / np.sqrt(d)[:, None]
    y = np.array([y[i] for i in range(len(x))])
    # the two waves of a ring are nearly equal: the plane that they span counts
    basis, plane = (np.linalg.qr(z * np.sqrt(d)[:, None])[0] for z in (slow, y))
    assert np.linalg.svd(basis.T @ plane)[1].min() > 0.99


def test_neighbours_stay_together_and_reruns_agree(spark, ring):
    a = places(graph.graph_reducer(2, near=8, rounds=4)(frame(spark, ring)))
    y = np.array([a[i] for i in range(len(ring))])
    b = places(graph.pca_reducer(2)(frame(spark, ring)))
    z = np.array([b[i] for i in range(len(ring))])
    unit = ring / np.linalg.norm(ring, axis=1, keepdims=True)
    kept = [np.mean([len(p & q) / 8 for p, q in zip(nearest(unit, 8), nearest(w, 8), strict=True)]) for w in (y, z)]
    assert kept[0] > 0.7 > kept[1] + 0.1, kept
    again = places(graph.graph_reducer(2, near=8, rounds=4)(frame(spark, ring, 3)))
    assert all((a[i] == again[i]).all() for i in a)


def test_defined_cases(spark, ring):
    x = [*ring[:30], *[ring[0]] * 60, *(2 * ring[1:3]), None, [], [1.0, None] * 6, [float("nan")] * 12, [0.0] * 12]
    got = places(graph.spectral(frame(spark, x).selectExpr("*", "1L AS node", "'c' AS unique_key", "2 AS a"), k=3, near=5, rounds=3))
    assert set(got) == {*range(92), 96} and all(len(v) == 3 and np.isfinite(v).all() for v in got.values())
    assert all((got[i] == got[0]).all() for i in range(30, 90))  # equal vectors are one node
    assert (got[90] == got[1]).all() and (got[91] == got[2]).all()  # by cosine
    assert graph.spectral(frame(spark, [None])).count() == 0
    few = places(graph.spectral(frame(spark, [*ring[:2], ring[0]]), k=2))
    assert {tuple(v) for v in few.values()} == {(0.0, 0.0)} and len(few) == 3
    three = places(graph.spectral(frame(spark, ring[:3]), k=5, rounds=2))
    assert len(three) == 3 and all(len(v) == 5 for v in three.values())


def test_sums_and_bundles(spark, monkeypatch):
    """A node's edges are a few rows of bounded arrays, none is lost; sums round like round() without its decimals."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(graph, "ENDS", 8, raising=False)
    edges = [(i, j, (i + 1) / (j + 3)) for i in range(300) for j in {0, i % 7, i % 50}]
    rows = graph._bundled(spark.createDataFrame(edges, "i long, j long, w double")).collect()
    assert sorted((e.i, r.j, e.w) for r in rows for e in r.to) == sorted(edges)
    assert max(len(r.to) for r in rows) < 40 and len(rows) < len(edges) / 3
    x = spark.createDataFrame([(v,) for k in range(-40, 41) for v in (k / 2, k / 3, k * 1e-9, k + 0.25)], "x double")
    got = x.agg(graph._total(F.col("x"), 1.0).alias("a"), (F.sum(F.round("x").cast("long"))).alias("b"), graph._total(F.col("x"), graph.STEP).alias("c"), (F.sum(F.round(F.col("x") * graph.STEP).cast("long")) / graph.STEP).alias("d"))
    one = got.first()
    assert one.a == one.b and one.c == one.d
    assert "Decimal" not in str(got.select("a")._jdf.queryExecution().optimizedPlan()) and "round(" not in str(x.agg(graph._total(F.col("x"), 1.0))._jdf.queryExecution().optimizedPlan())
