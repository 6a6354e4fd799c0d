"""Centroid clustering in whole numbers: float32 products shortlist the centroids, exact arithmetic decides.

A vector's components are scaled and floored to integers.  Each round is one pass over the vectors: a task multiplies
a batch with the centroids in float32, bounds the rounding error of every product, keeps the centroids whose interval of
possible distances reaches the least upper end, and compares those that are left by exact integers.  Only sums by
cluster leave a task, so that neither a hot cluster nor a repeated vector gathers rows anywhere.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm._kernel import release
from notewright.llm._shared import Scratch

#: Components are held to this range, so that squared distances of up to 1024 components fit 64 bits.
LIMIT = 1 << 26
#: Pairs of a vector and a shortlisted centroid that are compared at once.
PAIRS = 1 << 15
#: Unit roundoff of float32 and (with room to spare) of float64.
U32, U64 = 2.0**-24, 2.0**-52


def whole(vector: Column, dims: int) -> Column:
    """Whether a vector has exactly dims components, none of them null, NaN or infinite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce((F.size(vector) == dims) & finite, F.lit(False))


def quantize(column: pa.Array, dims: int, scale: float) -> np.ndarray:
    """floor(scale * x) of every component, as int64."""
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    return np.clip(np.floor(scale * flat), -LIMIT, LIMIT).astype(np.int64)


def shortlist(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Which centroids may be the nearest of each vector (rows x centroids).

    |c|^2 - 2xc orders the centroids of a vector.  A float32 product of d components, summed in any order, differs from
    xc by at most g|x||c|, g = mu / (1 - mu), where u is the unit roundoff and m = d + 4 counts the sum, the rounding of
    both factors, and two to spare.  What is done in float64 after that adds a few units of its own roundoff.
    """
    product = (x.astype(np.float32) @ c.astype(np.float32).T).astype(np.float64)
    xf, cf = x.astype(np.float64), c.astype(np.float64)
    square = np.einsum("ij,ij->i", cf, cf)
    mu = (x.shape[1] + 4) * U32
    norms = np.sqrt(np.einsum("ij,ij->i", xf, xf))[:, None] * np.sqrt(square)[None, :] * (1 + 2.0**-40)
    score = square - 2 * product
    error = 2 * mu / (1 - mu) * norms + (x.shape[1] + 8) * U64 * (square + 2 * np.abs(product) + norms)
    return score - error <= (score + error).min(axis=1, keepdims=True)


def nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The number of each vector's nearest centroid by exact squared distance; of equally near ones the smallest."""
    near = shortlist(x, c)
    out = near.argmax(axis=1)
    row, k = np.nonzero(near[open_ := np.flatnonzero(near.sum(axis=1) > 1)])
    if len(row):
        d = np.concatenate([((x[open_[row[i : i + PAIRS]]] - c[k[i : i + PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(row), PAIRS)])
        order = np.lexsort((k, d, row))
        first = order[np.concatenate([[True], row[order][1:] != row[order][:-1]])]
        out[open_[row[first]]] = k[first]
    return out


def sums_by_cluster(x: np.ndarray, k: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors, and exact sums of their components, of each of n clusters."""
    count, total = np.bincount(k, minlength=n), np.zeros((n, x.shape[1]), np.int64)
    order = np.argsort(k, kind="stable")
    have = np.flatnonzero(count)
    if len(have):
        total[have] = np.add.reduceat(x[order], (np.cumsum(count) - count)[have], axis=0)
    return count, total


def _moved(vectors: DataFrame, c: np.ndarray, dims: int, scale: float) -> np.ndarray:
    """The centroids after one round: floors of exact means; those without vectors stay."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, total = np.zeros(len(c), np.int64), np.zeros(c.shape, np.int64)
        for batch in batches:
            x = quantize(batch.column("_v"), dims, scale)
            n, s = sums_by_cluster(x, nearest(x, c), len(c))
            count, total = count + n, total + s
        have = np.flatnonzero(count)
        part = pa.ListArray.from_arrays(pa.array(np.arange(len(have) + 1) * dims, pa.int32()), pa.array(total[have].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(have, pa.int32()), pa.array(count[have]), part], names=["k", "n", "s"])
        release()

    parts = vectors.select("_v").mapInArrow(partial, "k int, n long, s array<long>")
    sums = parts.select("k", "n", F.posexplode("s").alias("i", "s")).groupBy("k", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    out = c.copy()
    for r in sums.collect():  # a number for each component of each centroid
        out[r.k, r.i] = int(r.s) // r.n
    return out


def cluster(
    vectors: DataFrame,
    k: int = 40,
    rounds: int = 5,
    dims: int = 64,
    scale: float = 256.0,
    seed: str = "2",
    vec_id: str = "vec_id",
    vector: str = "embedding",
) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector.

    Kept are vectors of exactly dims components, none null, NaN or infinite; a component x is floor(scale * x).  The
    k kept vectors with the smallest sha256 of `seed:vec_id` are the first centroids, in that order; a null vec_id comes
    last, and of rows with one vec_id the smaller vector first.  With fewer kept vectors each is a centroid, without any
    there are no rows.  A vector goes to the nearest centroid, of equally near ones to that with the smallest number, so
    of equal centroids to the first.  After each of `rounds` rounds a centroid is the floor of its vectors' mean; one
    without vectors stays.  Repeated rows and ids count each.  Components beyond 2**26 in size after scaling count as
    2**26: squared distances would not fit 64 bits otherwise.  Other columns don't matter.  k and dims bound what the
    driver and every task hold of the centroids; vectors never leave their tasks.
    """
    scratch = Scratch(vectors.sparkSession, "centroids")
    kept = vectors.select(F.col(vec_id).alias("vec_id"), F.col(vector).alias("_v")).where(whole(F.col("_v"), dims))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    first = kept.select(hashed.alias("_h"), "_v").orderBy(F.asc_nulls_last("_h"), "_v").limit(k).collect()
    kind = dict(kept.dtypes)["vec_id"]
    shape = f"vec_id {kind}, cluster int, distance long"
    if not first:
        return vectors.sparkSession.createDataFrame([], f"{shape}, cluster_inertia long, inertia long, centroid_sha256 string")
    c = np.concatenate([quantize(pa.array([list(r["_v"])], pa.list_(pa.float64())), dims, scale) for r in sorted(first, key=lambda r: (r["_h"] is None, r["_h"] or "", r["_v"]))])
    for _ in range(rounds):
        c = _moved(kept, c, dims, scale)

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = quantize(batch.column("_v"), dims, scale)
            near = nearest(x, c)
            distance = np.concatenate([np.zeros(0, np.int64), *(((x[i : i + PAIRS] - c[near[i : i + PAIRS]]) ** 2).sum(axis=1) for i in range(0, len(x), PAIRS))])
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(near, pa.int32()), pa.array(distance)], names=["vec_id", "cluster", "distance"])
        release()

    placed = scratch.write(kept.mapInArrow(last, shape), "placed")
    inertia = {r.cluster: r.s for r in placed.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}
    total = sum(inertia.values())
    about = [(i, s, total, hashlib.sha256(",".join(map(str, c[i].tolist())).encode()).hexdigest()) for i, s in sorted(inertia.items())]
    return placed.join(F.broadcast(vectors.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select(
        "vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"
    )
