"""Centroids, periodic runs and SimHash groups against brute force, with nulls, ties, repeated rows and long texts."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from slow import lower, split

from notewright.llm import centroids, periodic_runs, queries, simhash

# ---- centroids


def slow_clusters(rows, k, rounds, dims, scale, seed):
    kept = [(i, [int(np.floor(scale * float(x))) for x in v], list(v)) for i, v in rows if v is not None and len(v) == dims and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[2]))
    c = [v for _, v, _ in order[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    nearest = lambda v: min((far(v, x), j) for j, x in enumerate(c))
    for _ in range(rounds):
        mine = {}
        for _, v, _ in kept:
            mine.setdefault(nearest(v)[1], []).append(v)
        c = [[sum(x) // len(mine[j]) for x in zip(*mine[j])] if j in mine else x for j, x in enumerate(c)]
    out = [(i, *nearest(v)[::-1]) for i, v, _ in kept]
    total = sum(d for *_, d in out)
    return [(i, j, d, sum(e for _, m, e in out if m == j), total, hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out]


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, "a", 1) for i, v in rows], "vec_id long, embedding array<float>, cluster string, distance int")


def key(rows):
    return sorted(map(tuple, rows), key=repr)


@pytest.mark.parametrize("k", [1, 3, 12, 100])
def test_clusters_are_the_slow_ones(spark, k):
    rng = random.Random(k)
    rows = [(i, [rng.choice([-1.5, -0.25, 0.0, 0.125, 0.3, 2.0]) for _ in range(4)]) for i in range(80)]  # many ties
    rows += [rows[3]] * 20 + [(3, [0.5, 0.5, 0.5, 0.5]), (None, [1.0, 2.0, 3.0, 4.0]), (None, [0.0, 2.0, 3.0, 4.0])]
    rows += [(200, None), (201, []), (202, [1.0] * 5), (203, [1.0, None, 1.0, 1.0]), (204, [1.0, float("nan"), 1.0, 1.0]), (205, [1.0, float("inf"), 1.0, 1.0])]
    rng.shuffle(rows)
    got = centroids.cluster(vectors(spark, rows).repartition(5), k=k, rounds=3, dims=4, scale=16.0).collect()
    want = slow_clusters([(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows], k, 3, 4, 16.0, "2")
    assert key(got) == key(want)


def test_clusters_without_vectors(spark):
    none = centroids.cluster(vectors(spark, [(1, None), (2, [1.0])]))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert centroids.cluster(vectors(spark, [(1, None)]).limit(0)).count() == 0


@pytest.mark.parametrize("size", [3, 300, 1 << 15, 1 << 26])
def test_nearest_is_exact_for_close_calls(size):
    """Centroids that differ by one in a component: float32 alone can't tell them apart."""
    rng = np.random.default_rng(size)
    c = np.repeat(rng.integers(-size, size + 1, (6, 64)), 3, axis=0)
    c[np.arange(len(c)), rng.integers(0, 64, len(c))] += rng.integers(-1, 2, len(c))
    c = np.clip(c, -centroids.LIMIT, centroids.LIMIT)
    x = np.concatenate([rng.integers(-size, size + 1, (400, 64)), np.repeat(c, 4, axis=0) + rng.integers(-1, 2, (72, 64)), np.zeros((3, 64), int), c])
    x = np.clip(x, -centroids.LIMIT, centroids.LIMIT)
    d = [[sum((int(a) - int(b)) ** 2 for a, b in zip(v, w)) for w in c] for v in x]
    assert centroids.nearest(x, c).tolist() == [row.index(min(row)) for row in d]
    near = centroids.shortlist(x, c)
    assert all(near[i, j] for i, row in enumerate(d) for j, v in enumerate(row) if v == min(row))
    if size <= 1 << 15:
        assert near.sum(axis=1).mean() < 6  # the intervals do shortlist


# ---- periodic runs


def slow_runs(w, least, periods):
    best = {}
    for q in range(1, len(w) // periods + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, periods * q):
                best.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in best.items())


def slow_periodic(text, least=24, periods=3):
    w = split(text)
    found = slow_runs(w, least, periods)
    gone = {i for start, length, q in found for i in range(start + q, start + length)}
    return found, " ".join(x for i, x in enumerate(w) if i not in gone)


def slow_digest(doc_id, text):
    w = split(text)
    if doc_id is not None and w and (h := zlib.crc32(str(doc_id).encode())) % 10 == 0:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    found, left = slow_periodic(" ".join(w))
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    hashed = lambda t: hashlib.sha256(t.encode()).hexdigest()
    lines = hashed("".join(f"{a},{b},{c}\n" for a, b, c in found))
    return (doc_id, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2], lines, hashed(left))


def periodic_words(rng, n, letters):
    w = [rng.randrange(letters) for _ in range(n)]
    for _ in range(rng.randint(0, 3)):
        if n > 4:
            i, p = rng.randrange(n - 2), rng.randint(1, 9)
            for t in range(i + p, min(n, i + p * rng.randint(2, 7))):
                w[t] = w[t - p]
    return w


def test_runs_are_the_slow_ones():
    rng = random.Random(1)
    for _ in range(1500):
        w = periodic_words(rng, rng.randint(0, 70), rng.randint(1, 4))
        for least, periods in ((2, 2), (6, 2), (6, 3), (24, 3)):
            assert periodic_runs.runs(w, least, periods) == slow_runs(w, least, periods)
    fib = [0, 1]
    while len(fib) < 400:
        a = fib if len(fib) == 2 else fib
        fib = a + a[: len(a) * 55 // 89]
    for w in ([0] * 5000, [0, 1] * 2000, fib[:400], list(range(300)) * 4):
        assert periodic_runs.runs(w) == slow_runs(w, 24, 3)
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(None, periods=1)


def test_colliding_hashes_are_noticed(monkeypatch):
    """With a tiny modulus hashes collide all the time; a result comes only from a base under which none did, or is right by its words."""
    rng = random.Random(7)
    monkeypatch.setattr(periodic_runs, "DIRECT", 1)
    e = periodic_runs.Extensions([rng.randrange(3) for _ in range(200)], 12345)
    for _ in range(500):
        i, j = sorted(rng.sample(range(200), 2))
        n = next((k for k in range(200 - j) if e.w[i + k] != e.w[j + k]), 200 - j)
        m = next((k for k in range(i) if e.w[i - 1 - k] != e.w[j - 1 - k]), i)
        assert (e.right(i, j), e.left(i, j)) == (n, m)
    monkeypatch.setattr(periodic_runs, "_MODULUS", 1)
    with pytest.raises(periodic_runs.Collision):
        e = periodic_runs.Extensions([0, 0, 0, 1, 0, 0, 2, 0, 0, 0], 1)
        for j in range(1, 10):
            w = periodic_runs._runs([0, 1, 2, 0, 1, 3, 0, 1, 2, 0, 1, 4] * 2, 2, 2, 1)
            assert w == set(slow_runs([0, 1, 2, 0, 1, 3, 0, 1, 2, 0, 1, 4] * 2, 2, 2))


def test_periodic_documents(spark):
    rng = random.Random(3)
    letters = ["é", "b", "c,", "D", "d"]
    texts = [" \n".join(letters[x] for x in periodic_words(rng, rng.choice([5, 30, 80, 300]), rng.randint(1, 5))) for _ in range(120)]
    texts += [None, "", " \t\n", "x", "ab " * 30000, ("one two three four five six seven eight nine ten " * 3)[:-1], "u v w " * 8 + "x " + "u v w " * 8]
    rows = [(i, t, "s", 5) for i, t in enumerate(texts)] + [(None, texts[0], "s", 5), (7, texts[7], "t", 5), (7, texts[7], "t", 5), (10**15, texts[8], None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words string, _nw_text int")
    got = periodic_runs.periodic_runs(docs).collect()
    assert key((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in got) == key((i, len(split(t)), *slow_periodic(t)) for i, t, *_ in rows)
    changed = docs.select("doc_id", periodic_runs.planted(F.col("doc_id"), F.col("text")).alias("text"))
    assert key(periodic_runs.digest(periodic_runs.periodic_runs(changed)).collect()) == key(slow_digest(i, t) for i, t, *_ in rows)
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, *_ in rows) > 5
    assert periodic_runs.digest(periodic_runs.periodic_runs(docs.limit(0))).count() == 0


# ---- SimHash


def slow_fingerprint(text, k=4):
    w = split(lower(text))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + k]).encode(), 42) for i in range(max(1, len(w) - k + 1))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_groups(x, bits):
    linked = np.bitwise_count(x[:, None] ^ x[None, :]) <= bits
    label = np.arange(len(x))
    while (new := np.where(linked, label[None, :], len(x)).min(axis=1)).tolist() != label.tolist():
        label = new
    return label


def flipped(rng, x, n, most):
    return [int(x) ^ int(np.bitwise_xor.reduce(np.left_shift(np.uint64(1), rng.integers(0, 64, rng.integers(0, most + 1), dtype=np.uint64)), initial=np.uint64(0))) for _ in range(n)]


def test_fingerprints_are_the_slow_ones(monkeypatch):
    texts = ["a b", "", None, "A  b\tc é D e f", "x " * 100, " lead the é\n\nword", "one", "Ü u Ü u Ü u Ü"]
    for piece in (3, 1 << 16):
        monkeypatch.setattr(simhash, "PIECE", piece)
        assert np.concatenate(list(simhash.fingerprints(pa.array(texts)))).tolist() == [slow_fingerprint(t) for t in texts]


def test_fingerprint_hash_is_the_one_of_sql(spark):
    assert spark.range(1).select(F.xxhash64(F.lit("a b c é"))).first()[0] % 2**64 == xxhash.xxh64_intdigest("a b c é".encode(), 42)


@pytest.mark.parametrize("levels", [0, 1, 3, 5, 9])
def test_tree_meets_every_pair_once(levels):
    rng = np.random.default_rng(levels)
    base = rng.integers(0, 2**63, 60, dtype=np.uint64)
    x = np.unique(np.array([*map(int, base), *(y for b in base for y in flipped(rng, b, 6, 6))], np.uint64))
    tree = simhash.Tree(x[:50], levels)
    row, leaf, own = tree.visits(x, 4)
    assert np.bincount(row[own], minlength=len(x)).tolist() == [1] * len(x) and len(set(zip(row, leaf))) == len(row)
    home = dict(zip(row[own].tolist(), leaf[own].tolist()))
    at = {(r, p) for r, p in zip(row.tolist(), leaf.tolist())}
    a, b = np.nonzero(np.triu(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4, 1))
    assert len(a) > 100
    for i, j in zip(a.tolist(), b.tolist()):
        assert (i, home[j]) in at if home[i] <= home[j] else (j, home[i]) in at
    if levels == 5:
        assert len(row) < 0.4 * len(x) * 32  # branches are pruned


def test_leaves_connect_what_is_linked():
    rng = np.random.default_rng(2)
    for turn in range(8):
        base = rng.integers(0, 2**63, 60, dtype=np.uint64)
        x = np.unique(np.array([*map(int, base), *flipped(rng, base[0], 300, 9), *flipped(rng, base[1], 50, 4)], np.uint64))
        rng.shuffle(x)
        at = {int(v): i for i, v in enumerate(x)}
        row, leaf, own = simhash.Tree(x[:100], turn % 4).visits(x, 4)
        groups = simhash._Groups(len(x))
        for p in np.unique(leaf):
            blocks = rng.integers(0, 1 + turn % 3, (leaf == p).sum())
            for i in range(blocks.max() + 1):
                for j in range(i, blocks.max() + 1):
                    s = (blocks == i) | (blocks == j)
                    a, b = simhash.near(x[row[leaf == p]][s], own[leaf == p][s], blocks[s], 4)
                    groups.join(np.array([at[int(v)] for v in a], int), np.array([at[int(v)] for v in b], int))
        assert groups.find(np.arange(len(x))).tolist() == slow_groups(x, 4).tolist()


@pytest.mark.parametrize("leaf,cell", [(1 << 14, 1 << 19), (12, 1 << 19), (20, 30)])
def test_simhash_groups(spark, monkeypatch, leaf, cell):
    monkeypatch.setattr(simhash, "LEAF", leaf)
    monkeypatch.setattr(simhash, "CELL", cell)
    rng = random.Random(4)
    words = [f"w{i}" for i in range(400)] + ["É", "The", "the,"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 3, 4, 30, 200, 900]))) for _ in range(60)]
    for t in texts[:40]:
        for _ in range(3):
            w = t.split(" ")
            w[rng.randrange(len(w))] = rng.choice(words)
            texts.append(" ".join(w))
    texts += [texts[5]] * 9 + [texts[6].upper().replace("É", "É"), None, "", "\n", "q " * 20000]
    rows = [(i + 3, t, "x", 1) for i, t in enumerate(texts)] + [(1, texts[5], "x", 1), (4, texts[1], "x", 1), (None, texts[2], "x", 1), (None, "nothing like it", "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string, least int").repartition(6)
    prints = [slow_fingerprint(t) for _, t, *_ in rows]
    label = slow_groups(np.array(prints, np.uint64), 4)
    least = {g: min((i for (i, *_), m in zip(rows, label) if m == g and i is not None), default=None) for g in label.tolist()}
    got = simhash.near_fingerprints(docs).collect()
    assert key(got) == key((i, f"{p:016x}", least[g]) for (i, *_), p, g in zip(rows, prints, label.tolist()))
    assert len(set(label.tolist())) < len(set(prints))
    assert simhash.near_fingerprints(docs.limit(0)).count() == 0


def test_new_queries_read_whole_tables(spark):
    d = "/root/testdata/sf0.001"
    n = {t: spark.read.parquet(f"{d}/{t}.parquet").count() for t in ("documents", "embeddings")}
    assert queries.op11_centroids(spark, d).count() == n["embeddings"]
    assert queries.op12_periodic_runs(spark, d).count() == n["documents"]
    assert queries.op13_simhash(spark, d).count() == n["documents"]


def _prints(seed):
    rng = np.random.default_rng(seed)
    few = rng.integers(0, 1 << 63, 12).astype(np.uint64)
    x = np.concatenate([rng.integers(0, 1 << 63, 150).astype(np.uint64), few])
    for _ in range(3):
        x = np.concatenate([x, x[-60:] ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 60).astype(np.uint64))])
    return np.unique(x)


def test_a_fingerprint_has_a_bucket_for_each_field():
    """As many rows as bits + 1, whatever the fingerprints are, and any two within bits share one."""
    x = _prints(1)
    at = simhash.dealt(x, 4)
    assert at.shape == (len(x), 5) and all(len(set(r)) == 5 for r in at.tolist())
    a, b = np.nonzero(np.bitwise_count(x[:, None] ^ x[None, :]) <= 4)
    assert len(a) > len(x) and (at[a] == at[b]).any(1).all()


@pytest.mark.parametrize("few, some, cell, rows, bits", [(64, 1 << 12, 1 << 19, 1 << 16, 4), (2, 5, 7, 200, 4), (2, 2, 1 << 19, 60, 2), (64, 1 << 12, 1 << 19, 1 << 16, 9)])
def test_links_of_fields_and_trees_are_all(spark, monkeypatch, few, some, cell, rows, bits):
    for name, value in (("FEW", few), ("SOME", some), ("CELL", cell), ("ROWS", rows), ("FOLD", 4 if few == 2 else 13)):
        monkeypatch.setattr(simhash, name, value)
    x = _prints(2)
    df = spark.createDataFrame([(int(v),) for v in x.view(np.int64)], "fp long")
    links = np.array([(r.a, r.b) for r in simhash._links(df, len(x), bits).collect()], np.int64).view(np.uint64).reshape(-1, 2)
    groups = simhash._Groups(len(x))
    groups.join(np.searchsorted(x, links[:, 0]), np.searchsorted(x, links[:, 1]))
    assert groups.find(np.arange(len(x))).tolist() == slow_groups(x, bits).tolist()
