"""Inverted lists of vectors: coarse centroids, a folder a list, and searches that read only the lists they need."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notewright.operators.search import knn
from notewright.sources.pointer import Pointer
from notewright.sources.shared import Scratch

#: Sampled vectors that train a list's centroid, about; and numbers that the sample has at most, whatever its vectors' length.
TRAIN, SAMPLE_VALUES = 64, 1 << 24
#: Lists at most: their centroids are held by the driver and by tasks.
MOST_LISTS = 4096
#: Members and queries that meet at once when many queries are asked.
MEMBERS, QUERIES = 8192, 1024


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dim)


def _far(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows x centroids), but for rounding errors."""
    return np.maximum(0.0, np.einsum("ij,ij->i", x, x)[:, None] + np.einsum("ij,ij->i", c, c)[None, :] - 2 * x @ c.T)


def train(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Means of `rounds` rounds of nearest assignment from the first `lists` different rows of the sample."""
    _, first = np.unique(sample, axis=0, return_index=True)
    c = sample[np.sort(first)[:lists]]
    for _ in range(rounds):
        near = np.concatenate([_far(sample[i : i + 4096], c).argmin(axis=1) for i in range(0, len(sample), 4096)])
        total, count = np.zeros_like(c), np.bincount(near, minlength=len(c))
        np.add.at(total, near, sample)
        c = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], c)
    return c


class VectorLists:
    """Vectors of notes dealt to the list of their nearest centroid; a list is a partition of Parquet files.

    Rows have doc_id, unique_key and vector; null vectors, those of another length than most, and those with
    null, NaN or infinite components aren't indexed.  Of each list its centroid, its members' number and the farthest
    member's distance are kept, which bound what a list can hold: a search without `probes` is exact, and still leaves
    out the lists that can't have anything near enough.  The centroids are trained on a bounded sample (TRAIN rows a list);
    every row is indexed.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.pointer = spark, root.rstrip("/"), Pointer(spark, root)
        self._known: tuple[int, np.ndarray, np.ndarray, np.ndarray] | None = None

    # building

    @classmethod
    def build(cls, notes: DataFrame, root: str, lists: int | None = None) -> VectorLists:
        """lists: the square root of the number of vectors unless given, MOST_LISTS at most."""
        out = cls(notes.sparkSession, root)
        dims = notes.where("vector is not null").groupBy(F.size("vector").alias("d")).count().orderBy(F.desc("count"), "d").first()
        dim, n = (dims["d"], dims["count"]) if dims else (0, 0)
        lists = max(1, min(MOST_LISTS, round(n**0.5) if lists is None else lists))
        rows = out._whole(notes, dim)
        sample = rows.orderBy(F.xxhash64("doc_id"), "doc_id").select("vector").limit(min(TRAIN * lists, max(lists, SAMPLE_VALUES // max(1, dim)))).toArrow()
        centroids = train(_matrix(sample.column("vector"), dim), lists) if sample.num_rows else np.zeros((0, dim))
        state = {"dim": dim, "folders": [], "centroids": centroids.tolist(), "n": [0] * len(centroids), "radius": [0.0] * len(centroids)}
        out._write(rows, state, 0)
        return out

    def add(self, notes: DataFrame) -> None:
        """More vectors, into the lists that there are; their doc_ids must be new."""
        after, state = self.pointer.read()
        self._write(self._whole(notes, state["dim"]), state, after)

    def _whole(self, notes: DataFrame, dim: int) -> DataFrame:
        finite = F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
        return notes.where((F.size("vector") == dim) & finite).select("doc_id", "unique_key", "vector")

    def _write(self, rows: DataFrame, state: dict[str, Any], after: int) -> None:
        c, dim = np.array(state["centroids"]).reshape(-1, max(1, state["dim"])), state["dim"]
        if not len(c):
            self.pointer.publish(state, after)
            return

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = _matrix(batch.column("vector"), dim)
                near = np.concatenate([np.zeros(0, np.int64), *(_far(x[i : i + 2048], c).argmin(axis=1) for i in range(0, len(x), 2048))])
                far = np.sqrt(((x - c[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(far), pa.array(near, pa.int32())], names=[*batch.schema.names, "far", "list"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        folder = f"{self.root}/lists/{uuid.uuid4().hex}"
        placed = rows.mapInArrow(place, f"{kinds}, far double, list int")
        placed.hint("rebalance", F.col("list")).write.partitionBy("list").parquet(folder)
        n, radius = list(state["n"]), list(state["radius"])
        if self.pointer.names(folder.removeprefix(f"{self.root}/")) != ["_SUCCESS"]:
            for r in self.spark.read.parquet(folder).groupBy("list").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():  # a row a list
                n[r["list"]] += r["n"]
                radius[r["list"]] = max(radius[r["list"]], r["far"])
            state = state | {"folders": [*state["folders"], folder.rpartition("/")[2]]}
        self.pointer.publish(state | {"n": n, "radius": radius}, after)

    # searching

    def lists(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Centroids, members and radii."""
        version = self.pointer.version()
        if self._known is None or self._known[0] != version:
            _, s = self.pointer.read()
            self._known = version, np.array(s["centroids"]).reshape(-1, max(1, s["dim"])), np.array(s["n"]), np.array(s["radius"])
        return self._known[1:]

    def members(self, chosen: list[int] | None = None) -> DataFrame:
        """(doc_id, unique_key, vector, far, list) of some lists: only their files are read."""
        _, state = self.pointer.read()
        if not state.get("folders"):
            return self.spark.createDataFrame([], "doc_id long, unique_key string, vector array<float>, far double, list int")
        out = None
        for folder in state["folders"]:
            part = self.spark.read.parquet(f"{self.root}/lists/{folder}")
            part = part if chosen is None else part.where(F.col("list").isin([int(i) for i in chosen]))
            out = part if out is None else out.unionByName(part)
        return out

    def _order(self, query: list[float]) -> tuple[np.ndarray, np.ndarray]:
        """The lists that have members from the nearest centroid on, and how near a member of each can be at least."""
        c, n, radius = self.lists()
        have = np.flatnonzero(n)
        far = np.sqrt(((c[have] - np.asarray(query, np.float64)) ** 2).sum(axis=1))
        order = np.argsort(far, kind="stable")
        return have[order], np.maximum(0.0, far - radius[have])[order]

    def knn(self, query: list[float], k: int, most: float | None = None, probes: int | None = None) -> DataFrame:
        """(doc_id, distance) of the nearest vectors by squared distance, one of each key.

        probes: so many of the nearest lists are searched, which may miss some.  Without it the result is exact: the
        k-th distance found in the first lists leaves out all lists whose bound is larger.
        """
        order, least = self._order(query)
        if probes is not None:
            return knn(self.members(order[:probes].tolist()), query, k, most)
        _, n, _ = self.lists()
        first = int(np.searchsorted(np.cumsum(n[order]), 4 * k)) + 1
        found = knn(self.members(order[:first].tolist()), query, k, most).collect()  # k rows
        if len(found) == k:
            reach = max(r["distance"] for r in found)
            reach = reach if most is None else min(reach, most)
            need = order[least**2 <= reach * (1 + 1e-9) + 1e-9]
        else:
            need = order if most is None else order[least**2 <= most * (1 + 1e-9) + 1e-9]
        return knn(self.members(sorted({*need.tolist(), *order[:first].tolist()})), query, k, most)

    def _asked(self, queries: DataFrame, probes: int, rest: bool) -> DataFrame:
        """(query_id, vector, list) of each query's nearest lists; or (rest) of the others that its k-th distance so far, in reach, doesn't leave out."""
        c, n, radius = self.lists()
        have = np.flatnonzero(n)
        dim, c, radius = c.shape[1], c[have], radius[have]

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for i in range(0, batch.num_rows, 512):
                    part = batch.slice(i, 512)
                    far = np.sqrt(_far(_matrix(part.column("vector"), dim), c))
                    rank = far.argsort(axis=1, kind="stable").argsort(axis=1)
                    want = rank < probes
                    if rest:
                        reach = part.column("reach").to_numpy(zero_copy_only=False).astype(np.float64)
                        near = np.maximum(0.0, far - radius[None, :]) ** 2 <= (np.where(np.isnan(reach), np.inf, reach) * (1 + 1e-6) + 1e-6)[:, None]
                        want = near & ~want
                    row, place = np.nonzero(want)
                    yield pa.RecordBatch.from_arrays([*(part.column(x).take(pa.array(row)) for x in ("query_id", "vector")), pa.array(have[place], pa.int32())], names=["query_id", "vector", "list"])

        return queries.select("query_id", "vector", *(["reach"] if rest else [])).mapInArrow(ask, f"query_id {dict(queries.dtypes)['query_id']}, vector array<float>, list int")

    def _meet(self, asked: DataFrame, k: int) -> DataFrame:
        """(query_id, doc_id, distance): what each query has nearest in each cell of its lists.

        A list's members and its queries are dealt to cells of bounded size, so neither a long list nor one that many
        queries ask meets in one task.
        """
        _, n, _ = self.lists()
        dim = self.lists()[0].shape[1]
        many = asked.groupBy("list").count().collect()  # a row a list
        cells = self.spark.createDataFrame([(r["list"], int(-(-n[r["list"]] // MEMBERS)), -(-r["count"] // QUERIES)) for r in many], "list int, parts int, turns int")
        upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
        left = asked.join(F.broadcast(cells), "list").withColumn("turn", F.pmod(F.xxhash64("query_id"), "turns").cast("int")).withColumn("part", upto("parts")).select("list", "part", "turn", "query_id", "vector")
        right = self.members([r["list"] for r in many]).join(F.broadcast(cells), "list").withColumn("part", F.pmod(F.xxhash64("doc_id"), "parts").cast("int")).withColumn("turn", upto("turns")).select("list", "part", "turn", "doc_id", "vector")

        def nearest(q: pa.Table, m: pa.Table) -> pa.Table:
            a, b = _matrix(q.column("vector"), dim) if q.num_rows else np.zeros((0, dim)), _matrix(m.column("vector"), dim) if m.num_rows else np.zeros((0, dim))
            if not len(a) or not len(b):
                return pa.table({"query_id": q.column("query_id").slice(0, 0), "doc_id": m.column("doc_id").slice(0, 0), "distance": pa.array([], pa.float64())})
            far = _far(a, b)
            kth = np.partition(far, min(k, len(b)) - 1, axis=1)[:, min(k, len(b)) - 1 : min(k, len(b))]
            slack = 1e-9 * (1 + (a * a).sum(axis=1).max() + (b * b).sum(axis=1).max())
            row, col = np.nonzero(far <= kth + slack)  # by rounded products, ties and all; what counts is computed anew
            d = np.concatenate([((a[row[i : i + 65536]] - b[col[i : i + 65536]]) ** 2).sum(axis=1) for i in range(0, len(row), 65536)])
            ids = m.column("doc_id").to_numpy()[col]
            order = np.lexsort((ids, d, row))
            begin = np.searchsorted(row, np.arange(len(a)))  # rows come in order
            keep = order[np.arange(len(order)) - begin[row[order]] < k]
            return pa.table({"query_id": q.column("query_id").take(pa.array(row[keep])), "doc_id": pa.array(ids[keep]), "distance": pa.array(d[keep])})

        shape = f"query_id {dict(asked.dtypes)['query_id']}, doc_id long, distance double"
        cell = ["list", "part", "turn"]
        return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(nearest, shape)

    def neighbours(self, queries: DataFrame, k: int, probes: int = 8, exact: bool = False) -> DataFrame:
        """(query_id, doc_id, distance, place) of the k nearest vectors of each query (query_id, vector), by distance, then doc_id.

        The `probes` nearest lists of each are searched; exact goes on with the lists that may hold anything nearer than
        the k-th found there.  Queries may be as many as the vectors; of those without a usable vector there are no rows.
        """
        dim = self.lists()[0].shape[1]
        queries = self._whole(queries.select(F.col("query_id").alias("doc_id"), F.lit("").alias("unique_key"), "vector"), dim).select(F.col("doc_id").alias("query_id"), "vector")
        queries = queries.withColumn("vector", F.col("vector").cast("array<float>"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "doc_id")).cast("long")
        best = lambda df: df.withColumn("place", place).where(F.col("place") <= k)
        found = best(self._meet(self._asked(queries, probes, False), k))
        if exact:
            found = Scratch(self.spark, "neighbours").write(found, "first")
            reach = found.where(F.col("place") == k).select("query_id", F.col("distance").alias("reach"))
            more = self._meet(self._asked(queries.join(reach, "query_id", "left"), probes, True), k)
            found = best(found.drop("place").unionByName(more))
        return found
