"""Reduction by a neighbour graph: approximate nearest rows, fuzzy weights, and a spectral layout by power iteration."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial, reduce
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.operators import density
from notewright.operators.vectors import VectorLists
from notewright.sources.shared import Scratch

#: Lists of the coarse graph at most: its matrix is the driver's, whatever the rows.
MOST_COARSE = 512
#: Vectors that are iterated beside those asked for, so that these settle sooner.
SPARE = 3
#: Ends of a node's edges that are one row.
ENDS = 1024
#: Sums are taken of whole numbers of these steps, so that they don't depend on the order of rows.
STEP, WIDE = float(1 << 32), float(1 << 24)


class Reducer(Protocol):
    """Makes (doc_id, reduced) of notes with a vector."""

    def __call__(self, notes: DataFrame) -> DataFrame: ...


def pca_reducer(k: int = 5) -> Reducer:
    return partial(density.pca, k=k)


def graph_reducer(k: int = 5, near: int = 30, probes: int = 8, rounds: int = 10) -> Reducer:
    return partial(spectral, k=k, near=near, probes=probes, rounds=rounds)


def _total(x: Column, step: float) -> Column:
    """A sum of doubles that is the same in any order."""
    up = lambda y: F.floor(y + 0.5)  # noqa: E731  half away from zero, as round() does by way of decimals, which takes longer than the sum
    return F.sum(F.when(x < 0, -up(-x * step)).otherwise(up(x * step))) / step


def different(notes: DataFrame, vector: str = "vector") -> tuple[DataFrame, DataFrame]:
    """(a, b, doc_id): two hashes of each row's vector, scaled to length 1; and (a, b, doc_id, unique_key, vector), one row of equal vectors, that of the smallest id.

    Rows of equal vectors would all point at the same few neighbours; as one node they share a place.  Null and empty
    vectors, and those with components that are null or not finite, are left out; a vector of zeros stays as it is.
    """
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = notes.where((F.size(vector) > 0) & finite).select("doc_id", F.col(vector).cast("array<double>").alias("_v"))
    length = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
    rows = rows.withColumn("_l", length).select("doc_id", F.transform("_v", lambda x: F.when(F.col("_l") > 0, x / F.col("_l")).otherwise(0.0).cast("float")).alias("vector"))
    keyed = rows.select(F.xxhash64("vector").alias("a"), F.xxhash64(F.lit(1), "vector").alias("b"), "doc_id", "vector")
    nodes = keyed.groupBy("a", "b").agg(F.min("doc_id").alias("doc_id"), F.first("vector").alias("vector"))
    return keyed.drop("vector"), nodes.select("a", "b", "doc_id", F.lit("").alias("unique_key"), "vector")


def weights(found: DataFrame, near: int) -> DataFrame:
    """found: (query_id, distance squared, doc_id), not of a row to itself.  (i, j, w) both ways: how sure it is that one of two rows belongs to the other's surroundings.

    A row's nearest neighbour has weight 1; others fall off by a width for which a row's weights add up to log2(near).
    Weights p and q of the two directions make p + q - p q.
    """

    def widths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            d = batch.column("d")
            many = np.diff(d.offsets.to_numpy())
            m = np.full((len(many), near), np.inf)
            m[np.arange(near)[None, :] < many[:, None]] = d.flatten().to_numpy()
            beyond = np.maximum(0.0, m - m[:, :1])
            low, high = np.zeros(len(m)), np.full(len(m), np.inf)
            width = np.ones(len(m))
            for _ in range(64):
                more = np.exp(-beyond / width[:, None]).sum(1) > np.log2(near)
                high, low = np.where(more, width, high), np.where(more, low, width)
                width = np.maximum(1e-9, np.where(np.isinf(high), 2 * width, (low + high) / 2))
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(m[:, 0]), pa.array(np.where(np.isfinite(width), np.minimum(width, 1e9), 1e9))], names=["i", "first", "width"])

    d = found.select(F.col("query_id").alias("i"), F.col("doc_id").alias("j"), F.sqrt("distance").alias("d"))
    own = d.groupBy("i").agg(F.array_sort(F.collect_list("d")).alias("d"))  # near numbers a row
    own = own.mapInArrow(widths, "i long, first double, width double")
    one = d.join(own, "i").select("i", "j", F.exp(-F.greatest(F.lit(0.0), F.col("d") - F.col("first")) / F.col("width")).alias("w"))
    both = one.unionByName(one.select(F.col("j").alias("i"), F.col("i").alias("j"), "w"))
    p, q = F.max("w"), F.when(F.count(F.lit(1)) > 1, F.min("w")).otherwise(0.0)
    return both.groupBy("i", "j").agg((p + q - p * q).alias("w"))


def _coarse(edges: DataFrame, lists: DataFrame, p: int) -> tuple[list[int], np.ndarray]:
    """Lists that have rows, and for each its values in the p slowest waves of the graph of lists, the constant one left out."""
    a, b = lists.toDF("i", "a"), lists.toDF("j", "b")
    sums = edges.join(a, "i").join(b, "j").groupBy("a", "b").agg(_total(F.col("w"), WIDE).alias("w")).collect()  # MOST_COARSE squared at most
    names = sorted({r["a"] for r in sums} | {r["b"] for r in sums})
    place = {name: n for n, name in enumerate(names)}
    m = np.zeros((len(names), len(names)))
    for r in sums:
        m[place[r["a"]], place[r["b"]]] = r["w"]
    m = (m + m.T) / 2
    root = np.sqrt(np.maximum(m.sum(1), 1e-12))
    _, v = np.linalg.eigh(m / root[:, None] / root[None, :])
    return names, v[:, ::-1][:, 1 : p + 1] / root[:, None] * np.sqrt((root * root).sum())  # of mean square 1 by weight


def _bundled(step: DataFrame) -> DataFrame:
    """(j, to): steps (i, j, w) from each j as arrays of about ENDS of (i, w) at most, so that a round sorts and sends a few rows a node."""
    many = step.groupBy("j").agg(F.ceil(F.count(F.lit(1)) / ENDS).cast("int").alias("parts"))
    dealt = step.join(many, "j").withColumn("part", F.pmod(F.xxhash64("i"), "parts"))
    return dealt.groupBy("j", "part").agg(F.collect_list(F.struct("i", "w")).alias("to")).select("j", "to")


def spectral(notes: DataFrame, k: int = 5, near: int = 30, probes: int = 8, rounds: int = 10, lists: int | None = None) -> DataFrame:
    """(doc_id, reduced): each row's place among its neighbours by cosine, k numbers of mean square about 1.

    Neighbours are searched in the `probes` nearest of inverted lists, so a few may be missed.  The places are the
    slowest waves of the graph's random walk, by power iteration over tables of edges and places: the graph of lists,
    which the driver solves, gives the first guess, and each round is one join and one sum.  The driver holds sums of
    pairs of lists and of pairs of waves, nothing that grows with the rows.  Nothing is random: reruns agree.

    Rows of equal vectors share a place; rows without a usable vector have none.  Where there are fewer different
    rows than waves, the numbers that are left are 0.
    """
    scratch = Scratch(notes.sparkSession, "graph")
    members, nodes = different(notes)
    nodes = scratch.write(nodes, "nodes")
    n = nodes.count()
    zeros = F.array_repeat(F.lit(0.0), k)
    if n < 3:
        return scratch.last(members.select("doc_id", zeros.alias("reduced")), "result")
    lists = lists or min(MOST_COARSE, max(min(n, 32), round(n**0.5)))
    index = VectorLists.build(nodes, f"{scratch.root}/lists", lists)
    asked = index.neighbours(nodes.select(F.col("doc_id").alias("query_id"), "vector"), near + 1, probes).where("query_id <> doc_id")
    found = scratch.write(asked.where(F.col("place") <= near + 1), "found")
    edges = scratch.write(weights(found, near + 1), "weights")
    degree = scratch.write(edges.groupBy("i").agg(_total(F.col("w"), STEP).alias("d")), "degree")
    where = index.members().select("doc_id", "list")
    names, first = _coarse(edges, where, k + SPARE)
    p = first.shape[1]
    if not p:
        return scratch.last(members.select("doc_id", zeros.alias("reduced")), "result")
    x = [f"x{c}" for c in range(p)]
    # a step of the walk goes from i to its neighbours j by w / d, half of the time it stays
    step = scratch.write(_bundled(edges.join(degree, "i").select("i", "j", (F.col("w") / F.col("d")).alias("w"))), "step")
    guess = notes.sparkSession.createDataFrame([(int(a), *map(float, v)) for a, v in zip(names, first, strict=True)], f"list int, {', '.join(f'{c} double' for c in x)}")
    places = where.join(F.broadcast(guess), "list").join(degree.withColumnRenamed("i", "doc_id"), "doc_id").select(F.col("doc_id").alias("j"), "d", *x)
    places = scratch.write(places, "places")
    total = places.agg(_total(F.col("d"), WIDE)).first()[0]
    for turn in range(rounds):
        places = _apart(places, x, total)
        sent = step.join(places.select("j", *x), "j").select(*x, F.inline("to"))
        moved = sent.groupBy("i").agg(*(_total(F.col("w") * F.col(c), STEP).alias(f"_{c}") for c in x))
        after = places.join(moved.withColumnRenamed("i", "j"), "j").select("j", "d", *((F.col(c) / 2 + F.col(f"_{c}") / 2).alias(c) for c in x), *(F.col(c).alias(f"b{c}") for c in x))
        written = scratch.write(after, f"round-{turn}")
        scratch.drop_all_but(nodes, step, written)
        if turn == rounds - 1:
            places = _turned(written, x, total)
        else:
            places = written.drop(*(f"b{c}" for c in x))
    best = [F.col(c) for c in x[:k]] + [F.lit(0.0)] * max(0, k - p)
    reduced = places.select(F.col("j").alias("node"), F.array(*best).alias("reduced"))
    at = nodes.select("a", "b", F.col("doc_id").alias("node")).join(reduced, "node").select("a", "b", "reduced")
    return scratch.last(members.join(at, ["a", "b"]).select("doc_id", "reduced"), "result")


def _products(rows: DataFrame, left: list[str], right: list[str], total: float) -> np.ndarray:
    """Mean products of columns over all rows, weighted by degree."""
    got = rows.agg(*(_total(F.col("d") / total * F.col(a) * F.col(b), STEP * 64).alias(f"{a}_{b}") for a in left for b in right)).first()
    return np.array([v or 0.0 for v in got], float).reshape(len(left), len(right))


def _mixed(rows: DataFrame, x: list[str], turn: np.ndarray, shift: np.ndarray) -> DataFrame:
    """Columns x less a shift, times a matrix."""
    return rows.select("j", "d", *(reduce(Column.__add__, ((F.col(a) - float(shift[i])) * float(turn[i, c]) for i, a in enumerate(x))).alias(name) for c, name in enumerate(x)))


def _apart(rows: DataFrame, x: list[str], total: float) -> DataFrame:
    """Columns without their constant part, at right angles to each other, of mean square 1; those that have died out are 0."""
    one = rows.withColumn("one", F.lit(1.0))
    both = _products(one, ["one", *x], ["one", *x], total)
    shift = both[0, 1:] / both[0, 0]
    square = both[1:, 1:] - np.outer(shift, shift) * both[0, 0]
    value, vector = np.linalg.eigh((square + square.T) / 2)
    turn = np.where(value > 1e-7 * max(value.max(), 1e-300), vector / np.sqrt(np.maximum(value, 1e-300)), 0.0)[:, ::-1]
    return _mixed(one, x, turn, shift)


def _turned(rows: DataFrame, x: list[str], total: float) -> DataFrame:
    """Rotates the last step so that the columns are the waves themselves, the slowest first; rows have the columns before the step as b."""
    before = [f"b{c}" for c in x]
    inner = _products(rows, before, x, total)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    turn = vector[:, ::-1]
    turn = turn * np.where(turn[np.abs(turn).argmax(0), np.arange(len(x))] < 0, -1.0, 1.0)
    turn = turn / np.maximum(np.abs(value[::-1]), 1e-3)
    return _mixed(rows, x, turn, np.zeros(len(x)))
