"""Pairs of vectors over a similarity against the plain product."""

import numpy as np
import pytest

from notewright.operators import pairs


def slow(rows, least):
    out = {}
    usable = [(i, np.array(v, float)) for i, v in rows if v is not None and len(v) == 5 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    for n, (i, x) in enumerate(usable):
        for j, y in usable[:n]:
            s = float(x @ y / (np.linalg.norm(x) * np.linalg.norm(y)))
            if s >= least:
                out[min(i, j), max(i, j)] = s
    return out


@pytest.mark.parametrize("block", [4, 25, 2048])
def test_pairs_are_those_of_the_product(spark, monkeypatch, block):
    monkeypatch.setattr(pairs, "BLOCK", block)
    rng = np.random.default_rng(block)
    middles = rng.normal(size=(6, 5))
    x = np.concatenate([middles[rng.integers(0, 6, 90)] + 0.2 * rng.normal(size=(90, 5)), np.repeat(middles[:1], 6, axis=0), -middles[:2], 1e-6 * middles[:2]])
    rows = [(int(i), [float(a) for a in v]) for i, v in zip(rng.permutation(len(x)), x)]
    rows += [(900, None), (901, []), (902, [1.0] * 4), (903, [0.0] * 5), (904, [1.0, None, 1.0, 1.0, 1.0]), (905, [float("nan")] * 5), (906, [float("inf")] * 5), (None, [1.0] * 5)]
    df = spark.createDataFrame(rows, "doc_id long, vector array<double>")
    for least in (0.05, 0.8, 0.999):
        got = pairs.similar_pairs(df, least).collect()
        want = slow([r for r in rows if r[0] is not None], least)
        assert len({(r.a, r.b) for r in got}) == len(got)
        assert {(r.a, r.b): r.similarity for r in got} == pytest.approx(want)
    assert pairs.similar_pairs(df.where("doc_id >= 900"), 0.5).count() == 0 and pairs.similar_pairs(df.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        pairs.similar_pairs(df, 0.0)


def test_bounds_leave_out_what_cannot_reach():
    rng = np.random.default_rng(3)
    a, b = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (rng.normal(size=(200, 64)), rng.normal(size=(150, 64))))
    b[:5] = a[:5]
    row, col, s = pairs.over(a, b, 0.5)
    full = a @ b.T
    assert sorted(zip(row, col)) == sorted(zip(*np.nonzero(full >= 0.5))) and s == pytest.approx(full[row, col])


def test_groups_share_blocks(spark, monkeypatch):
    """24 groups without structure make 3 blocks and so 6 cells; each vector is sent for the cells of its block, and those of one cell come in bounded batches."""
    monkeypatch.setattr(pairs, "GROUP", 50)
    monkeypatch.setattr(pairs, "BLOCK", 450)
    monkeypatch.setattr(pairs, "LEAST_BLOCKS", 1)
    monkeypatch.setattr(pairs, "PRODUCTS", 1000)
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1200, 8))
    x[1100:] = x[0]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, [float(a) for a in v]) for i, v in enumerate(x)], "doc_id long, vector array<double>")
    found = pairs.similar_pairs(df, 0.6)
    assert found.rdd.getNumPartitions() <= 2 * 10
    want = np.argwhere(np.triu(x @ x.T >= 0.6, 1))
    assert sorted((r.a, r.b) for r in found.collect()) == sorted(map(tuple, want.tolist()))


def test_packed_cuts_large_groups_only():
    parts, pieces, many = pairs._packed(np.eye(4), np.array([10, 250, 30, 40]), 100)
    assert parts.tolist() == [1, 3, 1, 1] and many <= 5
    assert sorted((g, p) for g, p, _ in pieces) == [(0, 0), (1, 0), (1, 1), (1, 2), (2, 0), (3, 0)]
