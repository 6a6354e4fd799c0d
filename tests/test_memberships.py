"""Soft memberships against plain loops over the condensed tree, and the outlier passes on them."""

import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from notewright.operators import density, memberships, topics
from notewright.operators.memberships import Memberships


def frame(spark, x):
    return spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "doc_id long, reduced array<double>").repartition(3)


@pytest.fixture(scope="module")
def rows():
    """Three groups, one of them of two halves, rows between them, far ones, and equal ones."""
    rng = np.random.default_rng(5)
    groups = [rng.normal(c, s, (n, 2)) for c, s, n in (((0, 0), 0.1, 40), ((1.2, 0), 0.1, 30), ((6, 6), 0.3, 50), ((-5, 4), 0.2, 25))]
    return np.concatenate([*groups, rng.uniform(-7, 8, (25, 2)), np.repeat([[6.0, 6.0]], 5, 0)])


def ancestors(tree, c):
    out = [c]
    while tree.up[c] >= 0:
        c = int(tree.up[c])
        out.append(c)
    return out


def plain(tree, x, at, node, level, deepest, best):
    """By the definition: where two clusters of the tree part is the birth of the last cluster on the way to their meeting."""
    k = len(tree.chosen)
    joined = []
    for c in tree.chosen:
        mine, its = ancestors(tree, node), ancestors(tree, c)
        if c in mine:
            joined.append(level)
            continue
        meet = next(a for a in its if a in mine)
        joined.append(min(level, tree.birth[its[its.index(meet) - 1]]))
    first = max(range(k), key=lambda c: (joined[c], -c))
    inside = joined[first] / max(level, deepest[first])
    share = [math.sqrt(1 / max(1e-9, min(math.dist(at, e) for e in best[c]))) * (joined[c] / deepest[c]) ** 2 for c in range(k)]
    return [inside * s / sum(share) for s in share]


def parts_of(tree, x):
    """Levels without infinite ones, the deepest of each chosen cluster, and the exemplars by loops."""
    top = max(v for v in tree.level if np.isfinite(v))
    level = [min(v, top) for v in tree.level]
    under = lambda c: [i for i in range(len(x)) if c in ancestors(tree, int(tree.node[i]))]
    deepest = [max(level[i] for i in under(c)) for c in tree.chosen]
    best = []
    for c in tree.chosen:
        leaves = [v for v in range(len(tree.up)) if v not in tree.up[1:] and c in ancestors(tree, v)]
        best.append([x[i] for v in leaves for i in range(len(x)) if tree.node[i] == v and tree.level[i] == max(tree.level[tree.node == v])])
    return level, deepest, best


@pytest.mark.parametrize("numbers", [4_000_000, 4])
def test_memberships_are_those_of_the_definition(spark, rows, tmp_path, monkeypatch, numbers):
    monkeypatch.setattr(memberships, "BLOCK_NUMBERS", numbers)
    model = Memberships.fit(frame(spark, rows), f"{tmp_path}/soft", 8, 3, 0.2)
    got = {r.doc_id: r for r in model.probabilities().collect()}
    ids, x = density.gathered(frame(spark, rows))
    tree = density.condense(x, 8, 3, 0.2)
    level, deepest, best = parts_of(tree, x)
    labels = density.density_labels(x, 8, 3, 0.2)
    assert len(tree.chosen) >= 3 and (labels == -1).any() and len(got) == len(rows)
    for i, doc in enumerate(ids.to_pylist()):
        want = plain(tree, x, x[i], int(tree.node[i]), level[i], deepest, best)
        assert got[doc].topic == labels[i]
        assert got[doc].probabilities == pytest.approx(want, rel=1e-9)
        assert sum(got[doc].probabilities) <= 1 + 1e-9
    inner = [r for r in got.values() if r.topic >= 0]
    assert sum(int(np.argmax(r.probabilities)) == r.topic for r in inner) > 0.95 * len(inner)


def test_rows_that_were_not_fitted(spark, rows, tmp_path):
    model = Memberships.fit(frame(spark, rows), f"{tmp_path}/soft", 8, 3, 0.2)
    new = np.array([[0.02, 0.01], [5.9, 6.1], [50.0, 50.0], [0.6, 0.0], rows[3]])
    got = {r.doc_id: r for r in model.probabilities(model.locate(frame(spark, new))).collect()}
    ids, x = density.gathered(frame(spark, rows))
    tree = density.condense(x, 8, 3, 0.2)
    level, deepest, best = parts_of(tree, x)
    for i, at in enumerate(new):
        j = min(range(len(x)), key=lambda j: (math.dist(at, x[j]), ids[j].as_py()))
        here = min(level[j], 1 / max(1e-9, math.dist(at, x[j])))
        node = next(c for c in ancestors(tree, int(tree.node[j])) if tree.birth[c] <= here)
        assert got[i].probabilities == pytest.approx(plain(tree, x, at, node, here, deepest, best), rel=1e-5)
    assert got[2].topic == -1 and sum(got[2].probabilities) < 0.05 and got[0].topic >= 0


def test_passes_at_the_usual_thresholds(spark, tmp_path):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(c, 0.3, (60, 2)) for c in ((0, 0), (3, 0), (0, 3))] + [rng.uniform(-2, 5, (40, 2))])
    model = Memberships.fit(frame(spark, x), f"{tmp_path}/soft", 8, 3, 0.0)
    found = model.probabilities()
    p = {r.doc_id: r for r in found.collect()}
    out = {r.doc_id: r.topic for r in topics.reassign_by_probability(found.withColumn("topic", F.col("topic").cast("int"))).collect()}
    moved, left = Counter(), 0
    for i, r in p.items():
        q = r.probabilities
        want = r.topic
        if r.topic == -1 and max(q) >= 0.05:
            want = q.index(max(q))
            moved["first"] += 1
        elif r.topic == -1 and max(q[1:]) > 0.03:
            want = 1 + q[1:].index(max(q[1:]))
            moved["last"] += 1
        left += want == -1
        assert out[i] == want
    assert moved["first"] and moved["last"] and left


def test_without_clusters_and_without_rows(spark, tmp_path):
    few = spark.createDataFrame([(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None)], "doc_id long, reduced array<double>")
    got = Memberships.fit(few, f"{tmp_path}/few").probabilities().select("*", topics.confidence(F.col("probabilities")).alias("c")).collect()
    assert sorted((r.doc_id, r.topic, r.probabilities, r.c) for r in got) == [(1, -1, [], "0.0"), (2, -1, [], "0.0")]
    assert Memberships.fit(few.limit(0), f"{tmp_path}/none").probabilities().collect() == []
    same = spark.createDataFrame([(i, [float(i // 30), 0.0]) for i in range(60)], "doc_id long, reduced array<double>")
    total = [sum(r.probabilities) for r in Memberships.fit(same, f"{tmp_path}/same", epsilon=0.0).probabilities().collect()]
    assert len(total) == 60 and all(0 <= t <= 1 + 1e-9 for t in total)
