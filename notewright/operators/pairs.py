"""All pairs of vectors over a similarity, block by block; bounds leave out blocks and pairs before they are multiplied."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.operators.vectors import train
from notewright.sources.shared import Scratch

#: Vectors of a block at most, and numbers of its vectors; vectors of a group, about, and groups at most; sampled vectors that place their middles.
BLOCK, VALUES, GROUP, MOST_GROUPS, SAMPLE = 1 << 15, 1 << 21, 2048, 1024, 1 << 15
#: Products that are held at once.
PRODUCTS = 1 << 22
#: Blocks that the vectors make at least, where there are enough of them, so that tasks are many.
LEAST_BLOCKS = 8


def _matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def over(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of unit vectors a and b with a product of `least` or more, and the products.

    Products of short floats choose the pairs that can reach `least`, with room for their rounding; only these are
    multiplied anew.
    """
    return _over(a, a.astype(np.float32), b, least)


def _over(a: np.ndarray, short: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    rough = short @ b.astype(np.float32).T
    row, col = np.divmod(np.flatnonzero(rough.ravel() >= np.float32(least - (a.shape[1] + 8) * 2.0**-22)), max(1, len(b)))
    found = np.concatenate([np.zeros(0), *(np.einsum("ij,ij->i", a[row[i : i + 65536]], b[col[i : i + 65536]]) for i in range(0, len(row), 65536))])
    ok = found >= least
    return row[ok], col[ok], found[ok]


def _packed(middles: np.ndarray, size: np.ndarray, block: int) -> tuple[np.ndarray, list[tuple[int, int, int]], int]:
    """Parts of each group, (group, part, block) and how many blocks there are: groups near each other share blocks, one that is larger than a block is cut."""
    parts = -(-size // block)
    near = train(middles, max(1, -(-int(size.sum()) // block)), 4)
    home = (((middles[:, None, :] - near[None, :, :]) ** 2).sum(axis=2)).argmin(axis=1) if len(middles) * near.size < 1 << 24 else np.array([((near - m) ** 2).sum(axis=1).argmin() for m in middles])
    out, now, held = [], 0, 0
    for g in np.argsort(home, kind="stable").tolist():
        each = -(-int(size[g]) // int(parts[g]))
        for part in range(int(parts[g])):
            if held and held + each > block:
                now, held = now + 1, 0
            out.append((g, part, now))
            held += each
    return parts, out, now + 1


def similar_pairs(rows: DataFrame, least: float, key: str = "doc_id", vector: str = "vector") -> DataFrame:
    """(a, b, similarity) of any two rows with a cosine of `least` (over 0) or more, a < b.

    key is a unique whole number.  Null vectors, those of another length than most, and those of length 0 or with null, NaN
    or infinite components are in no pair.  Vectors are grouped by the nearest of a few middles; two groups whose cones are
    farther apart than `least` allows never meet.  Groups near each other make blocks, so that a vector is sent once for
    each block that it has to meet and not for each group.  A task holds one block, and the other streams by.  The
    middles are trained on a bounded sample; they decide what is left out, not what is found.
    """
    if not 0 < least <= 1:
        raise ValueError("least has to be over 0 and at most 1")
    spark = rows.sparkSession
    scratch = Scratch(spark, "pairs")
    finite = F.forall("v", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    given = rows.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    given = scratch.write(given, "given")
    dims = given.where("v is not null").groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    nothing = spark.createDataFrame([], "a long, b long, similarity double")
    if dims is None or not dims["d"]:
        return nothing
    dim = dims["d"]
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    usable = given.where((F.size("v") == dim) & finite & F.col("id").isNotNull()).withColumn("l", length).where("l > 0 and l < double('infinity')")
    unit = scratch.write(usable.select("id", F.transform("v", lambda x: x / F.col("l")).alias("v")), "unit")
    n = unit.count()
    if not n:
        return nothing
    sample = unit.orderBy(F.xxhash64("id"), "id").select("v").limit(min(SAMPLE, (1 << 24) // dim)).toArrow()
    middles = train(_matrix(sample.column("v"), dim), max(1, min(MOST_GROUPS, round(n / min(BLOCK, GROUP)))))
    lengths = np.linalg.norm(middles, axis=1, keepdims=True)
    middles = middles / np.where(lengths == 0, 1, lengths)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column("v"), dim)
            product = np.clip(x @ middles.T, -1, 1)
            group = product.argmax(axis=1)
            angle = np.arccos(product[np.arange(len(x)), group])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(group, pa.int32()), pa.array(angle)], names=["id", "v", "group", "angle"])

    placed = scratch.write(unit.mapInArrow(place, "id long, v array<double>, group int, angle double"), "placed")
    facts = sorted(placed.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.max("angle").alias("r")).collect())  # a row a group
    group, size, radius = (np.array([f[i] for f in facts]) for i in range(3))
    apart = np.arccos(np.clip(middles[group] @ middles[group].T, -1, 1))
    # rounding moves an angle near 0 by the root of what it moves the product
    meet = apart - radius[:, None] - radius[None, :] <= np.arccos(min(1.0, least)) + 1e-6
    block = max(1, min(BLOCK, VALUES // dim, max(GROUP, -(-n // LEAST_BLOCKS))))
    parts, pieces, many = _packed(middles[group], size, block)
    inside = np.zeros((many, len(group)), bool)
    for g, _, at in pieces:
        inside[at, g] = True
    cells = np.argwhere(np.triu((inside.astype(np.float32) @ meet.astype(np.float32) @ inside.T.astype(np.float32)) > 0) | np.eye(many, dtype=bool)).tolist()
    homes = spark.createDataFrame([(int(group[g]), int(parts[g]), part, at) for g, part, at in pieces], "group int, parts int, part int, block int")
    sides = [(p, k, 0) for k, (p, _) in enumerate(cells)] + [(q, k, 1) for k, (p, q) in enumerate(cells) if p < q]
    sides = spark.createDataFrame(sides, "block int, cell int, side int")
    of_group = spark.createDataFrame([(int(g), i, int(k)) for i, (g, k) in enumerate(zip(group, parts, strict=True))], "group int, g int, parts int")
    dealt = placed.join(F.broadcast(of_group), "group").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int"))
    dealt = dealt.join(F.broadcast(homes.drop("parts")), ["group", "part"]).join(F.broadcast(sides), "block").select("cell", "side", "g", "id", "v")

    def pairs(held: list[pa.RecordBatch], x: np.ndarray, g: np.ndarray, ids: np.ndarray, same: bool) -> Iterator[pa.RecordBatch]:
        """Pairs of a held block with rows that stream by; same: these are of the block itself."""
        a, short, of, names, edges = held
        for here in np.unique(g):
            near = np.flatnonzero(meet[here, of[edges[:-1]]])  # held rows come by group
            if not len(near):
                continue
            rows = np.flatnonzero(g == here)
            whole = len(near) == len(edges) - 1
            take = slice(None) if whole else np.concatenate([np.arange(edges[k], edges[k + 1]) for k in near])
            some, some_short, some_names = a[take], short[take], names[take]
            step = max(1, PRODUCTS // len(some))
            for i in range(0, len(rows), step):
                r = rows[i : i + step]
                row, col, s = _over(some, some_short, x[r], least)
                one, two = some_names[row], ids[r][col]
                if same:
                    keep = one < two
                    one, two, s = one[keep], two[keep], s[keep]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(one, two), pa.int64()), pa.array(np.maximum(one, two), pa.int64()), pa.array(s, pa.float64())], names=["a", "b", "similarity"])

    def close(parts_: list[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
        t = pa.Table.from_batches(parts_)
        a, g = _matrix(t.column("v"), dim), t.column("g").to_numpy()
        return a, a.astype(np.float32), g, t.column("id").to_numpy(), np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by cell, side and group: the first side is held, then the second one streams by."""
        now, first, held = -1, [], None
        own = lambda: cells[now][0] == cells[now][1]
        for batch in batches:
            place = 2 * batch.column("cell").to_numpy().astype(np.int64) + batch.column("side").to_numpy()
            edges = [0, *(np.flatnonzero(place[1:] != place[:-1]) + 1).tolist(), len(place)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                part, (cell, side) = batch.slice(i, j - i), divmod(int(place[i]), 2)
                if cell != now:
                    if first and own():
                        held = close(first)
                        yield from pairs(held, held[0], held[2], held[3], True)
                    now, first, held = cell, [], None
                if not side:
                    first.append(part)
                    continue
                if held is None:
                    if not first:
                        continue
                    held = close(first)
                yield from pairs(held, _matrix(part.column("v"), dim), part.column("g").to_numpy(), part.column("id").to_numpy(), False)
        if first and own():
            held = close(first)
            yield from pairs(held, held[0], held[2], held[3], True)

    # twice as many tasks as cells, so that few of them get several
    return dealt.repartition(2 * len(cells), "cell").sortWithinPartitions("cell", "side", "g").mapInArrow(multiply, "a long, b long, similarity double")
