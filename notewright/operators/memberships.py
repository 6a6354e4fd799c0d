"""Soft memberships of a density clustering: from its condensed tree and the densest rows of its clusters, kept as tables."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.functions.numbers import squared_distance
from notewright.operators.density import Condensed, _spread, condense, gathered
from notewright.operators.vectors import VectorLists
from notewright.sources.shared import Scratch, lean

#: Numbers of all exemplars that are broadcast as one array (8 bytes each); more are met in blocks of so many.
BLOCK_NUMBERS = 4_000_000
#: Distances that a task takes at once.
TILE = 1 << 21
#: A distance below this counts as this.
LEAST_DISTANCE = 1e-9


def exemplars(tree: Condensed) -> list[np.ndarray]:
    """Of each chosen cluster the rows that are its exemplars: those that stay longest in each leaf of the tree below it."""
    leaf = np.ones(len(tree.up), bool)
    leaf[tree.up[1:]] = False
    deepest = np.zeros(len(tree.up))
    np.maximum.at(deepest, tree.node, tree.level)
    last = leaf[tree.node] & (tree.level == deepest[tree.node])
    label = tree.labels()
    return [np.flatnonzero(last & (label == k)) for k in range(len(tree.chosen))]


def finite_levels(tree: Condensed) -> np.ndarray:
    """Levels of the rows; those of equal rows, which never part, count as the largest finite one (1, if there is none)."""
    finite = tree.level[np.isfinite(tree.level)]
    return np.minimum(tree.level, finite.max() if len(finite) and finite.max() > 0 else 1.0)


def parting_levels(tree: Condensed) -> np.ndarray:
    """For each cluster of the tree and each chosen one the level up to which they are one; infinite within the chosen one."""
    dies = np.full(len(tree.up), np.inf)
    dies[tree.up[1:]] = tree.birth[1:]
    out = np.full((len(tree.up), len(tree.chosen)), np.inf)
    below: dict[int, list[int]] = {}
    for k, c in enumerate(tree.chosen):
        above = tree.up[c]
        while above >= 0:
            below.setdefault(int(above), []).append(k)
            above = tree.up[above]
    for c in range(len(tree.up)):
        if c:
            out[c] = out[tree.up[c]]
        out[c, below.get(c, [])] = dies[c]
        if c in tree.chosen:
            out[c, tree.chosen.index(c)] = np.inf
    return out


@dataclass
class Memberships:
    """A fitted clustering as tables under a folder.

    rows: doc_id, reduced, cluster (-1: noise), node, level; nodes: node, cluster, parts (parting levels by cluster), above
    (birth and number of itself and what is above it); known: cluster, deepest (the largest level of its rows), point (an
    exemplar, equal ones once), block (which broadcast it is in).
    """

    spark: SparkSession
    path: str

    @classmethod
    def fit(cls, reduced: DataFrame, path: str, min_size: int = 10, min_samples: int = 3, epsilon: float = 0.2) -> Memberships:
        """Fitted to all rows of (doc_id, reduced) whose vector is not null.  The driver holds what density_clusters does: rows and tree."""
        spark = reduced.sparkSession
        ids, x = gathered(reduced.where("reduced is not null"))
        tree = condense(x, min_size, min_samples, epsilon, _spread(spark, len(x)))
        level, label, nodes = finite_levels(tree), tree.labels(), parting_levels(tree)
        deepest = [float(level[label == k].max()) for k in range(len(tree.chosen))]
        kind = dict(reduced.dtypes)["doc_id"]

        def listed(m: np.ndarray) -> pa.Array:
            return pa.array(list(m), pa.list_(pa.float64()))

        def write(name: str, table: pa.Table, schema: str) -> None:
            rows = spark.createDataFrame(table, schema) if table.num_rows else spark.createDataFrame([], schema)
            rows.write.mode("overwrite").parquet(f"{path}/{name}")

        write("rows", pa.table({"doc_id": ids, "reduced": listed(x), "cluster": label, "node": tree.node, "level": level}), f"doc_id {kind}, reduced array<double>, cluster long, node long, level double")
        above: list[list[dict]] = []
        for c in range(len(nodes)):
            above.append([{"birth": float(tree.birth[c]), "node": c}] + (above[tree.up[c]] if c else []))
        own = Condensed(tree.birth, tree.up, np.arange(len(nodes)), tree.birth, tree.chosen).labels()
        kinds = pa.list_(pa.struct([("birth", pa.float64()), ("node", pa.int64())]))
        write("nodes", pa.table({"node": np.arange(len(nodes)), "cluster": own, "parts": listed(nodes), "above": pa.array(above, kinds)}), "node long, cluster long, parts array<double>, above array<struct<birth: double, node: long>>")
        points = [np.unique(x[rows], axis=0) for rows in exemplars(tree)]
        owner = np.repeat(np.arange(len(points)), [len(p) for p in points])
        known = pa.table({"cluster": owner, "deepest": np.array(deepest)[owner] if len(owner) else np.zeros(0), "point": listed(np.concatenate(points)) if points else listed(x[:0]), "block": np.arange(len(owner)) // max(1, BLOCK_NUMBERS // max(1, x.shape[1]))})
        write("known", known, "cluster long, deepest double, point array<double>, block long")
        return cls(spark, path)

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    def known(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/known")

    def _nearest(self, rows: DataFrame) -> DataFrame:
        """rows with _d: the distance to the nearest exemplar of each cluster, by cluster.

        Exemplars are broadcast in blocks of a bounded size, one after the other; each block adds its least distances,
        which a task takes for a few rows and all exemplars at once.
        """
        known = self.known()
        clusters, blocks = known.agg(F.coalesce(F.max("cluster"), F.lit(-1)) + 1, F.coalesce(F.max("block"), F.lit(-1)) + 1).first()
        lean(self.spark)
        rows = rows.withColumn("_d", F.array_repeat(F.lit(float("inf")), clusters))
        for b in range(blocks):
            part = known.where(F.col("block") == b).select("cluster", "point").orderBy("cluster").toArrow()  # BLOCK_NUMBERS at most
            owner = part.column("cluster").to_numpy()
            points = part.column("point").combine_chunks().flatten().to_numpy().reshape(len(owner), -1)
            shared = self.spark.sparkContext.broadcast((owner, points))

            def near(batches: Iterator[pa.RecordBatch], shared: Broadcast = shared) -> Iterator[pa.RecordBatch]:
                owner, points = shared.value
                own = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
                for batch in batches:
                    x = batch.column("reduced").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                    d = batch.column("_d").flatten().to_numpy().reshape(batch.num_rows, -1).copy()
                    step = max(1, TILE // len(points))
                    for i in range(0, len(x), step):
                        square = np.zeros((len(x[i : i + step]), len(points)))
                        for k in range(points.shape[1]):
                            square += (x[i : i + step, k, None] - points[None, :, k]) ** 2
                        d[i : i + step, owner[own]] = np.minimum(d[i : i + step, owner[own]], np.sqrt(np.minimum.reduceat(square, own, axis=1)))
                    edges = pa.array(np.arange(batch.num_rows + 1) * d.shape[1], pa.int32())
                    yield batch.set_column(batch.schema.get_field_index("_d"), "_d", pa.ListArray.from_arrays(edges, pa.array(d.ravel())))

            rows = rows.mapInArrow(near, rows.schema)
        return rows

    def locate(self, new: DataFrame) -> DataFrame:
        """Rows (doc_id, reduced) that were not fitted, with cluster, node and level as if they hung on their nearest fitted row (of equals the one of the smallest doc_id).

        The level is 1 / distance to that row, at most that row's own; the node is what that row is in at this level.
        Doc_ids of fitted rows have to differ.  Null vectors have no row.
        """
        fitted = self.rows()
        index = VectorLists.build(fitted.select("doc_id", F.lit("").alias("unique_key"), F.col("reduced").alias("vector")), f"{Scratch(self.spark, 'locate').root}/lists")
        near = index.neighbours(new.select(F.col("doc_id").alias("query_id"), F.col("reduced").alias("vector")), 1, exact=True)
        near = near.select(F.col("query_id").alias("doc_id"), F.col("doc_id").alias("_to"))
        to = fitted.select(F.col("doc_id").alias("_to"), F.col("reduced").alias("_there"), "node", F.col("level").alias("_most"))
        out = new.select("doc_id", F.col("reduced").cast("array<double>").alias("reduced")).join(near, "doc_id").join(to, "_to")
        out = out.withColumn("level", F.least("_most", 1 / F.greatest(F.lit(LEAST_DISTANCE), F.sqrt(squared_distance(F.col("reduced"), F.col("_there"))))))
        out = out.join(self.nodes().select("node", "above"), "node").withColumn("node", F.get(F.filter("above", lambda a: a["birth"] <= F.col("level")), F.lit(0))["node"])
        return out.join(self.nodes().select("node", "cluster"), "node").select("doc_id", "reduced", "cluster", "node", "level")

    def probabilities(self, rows: DataFrame | None = None) -> DataFrame:
        """(doc_id, topic, probabilities) of all fitted rows, or of located ones: how much of each is in every cluster, and the rest in none.

        With level the level at which a row leaves the tree and joined[c] = least(level, where its place in the tree and c
        part), a row is in some cluster by joined[n] / greatest(level, deepest[n]), n being the cluster of the largest
        joined (of equals the first).  This is shared by sqrt(1 / distance to c's nearest exemplar) times (joined[c] /
        deepest[c]) squared.  A row that stays longest in its cluster has 1 in total; one that leaves early, less.  No
        cluster: no probabilities.  One array of all clusters is a row's value, and the tree's clusters by the chosen
        ones are the node table.
        """
        deepest = self.known().groupBy("cluster").agg(F.max("deepest").alias("deepest"))
        deepest = deepest.agg(F.transform(F.array_sort(F.collect_list(F.struct("cluster", "deepest"))), lambda x: x["deepest"]).alias("_deepest"))
        rows = self._nearest((self.rows() if rows is None else rows).join(self.nodes().select("node", "parts"), "node"))
        rows = rows.crossJoin(F.broadcast(deepest)).withColumn("_joined", F.transform("parts", lambda v: F.least(v, F.col("level"))))
        first = F.array_max("_joined")
        of_first = F.get("_deepest", F.array_position("_joined", first).cast("int") - 1)
        rows = rows.withColumn("_inside", first / F.greatest(F.col("level"), of_first))
        near = lambda k: F.sqrt(1 / F.greatest(F.lit(LEAST_DISTANCE), F.get("_d", k)))
        rows = rows.withColumn("_share", F.transform("_joined", lambda h, k: near(k) * F.pow(h / F.get("_deepest", k), 2)))
        total = F.aggregate("_share", F.lit(0.0), lambda a, v: a + v)
        rows = rows.withColumn("_total", total)
        return rows.select("doc_id", F.col("cluster").alias("topic"), F.transform("_share", lambda v: F.col("_inside") * v / F.col("_total")).alias("probabilities"))
