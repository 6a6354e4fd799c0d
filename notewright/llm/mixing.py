"""Mixing sources to target weights.

Every source's tokens are cut into blocks of equal size, Sainte-Lague apportionment gives each source, then each group
of its shards, then each shard a whole number of blocks by highest quotients, and a seeded hash picks the blocks within
a shard.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm._kernel import U64, mix
from notewright.llm._shared import BROADCAST_KEYS, Scratch, join_keys

#: Sources beyond so many are joined by a shuffle, not a broadcast (about 100 bytes each).
BROADCAST_SOURCES = 50_000
#: Shards of a group: a task apportions the shards of one group, or the groups of one source.
GROUP = 1024
#: A shard with so many times the usual number of documents holds equal rows, which are then dealt one by one.
CROWDED = 4
#: Equal rows that are numbered together.
PIECE = 1 << 17


def size_in_words(text: Column) -> Column:
    """Runs of anything but ASCII white space; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: Sequence[int], weights: Sequence[float], most: float = 3.0) -> list[float]:
    """Shares of the total in proportion to the weights; what exceeds most * size is shared again among the others."""
    total, out, open_ = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while open_:
        weight = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / weight > most * sizes[i]} if weight > 0 else set()
        if not over:
            for i in open_:
                out[i] = left * weights[i] / weight if weight > 0 else 0.0
            break
        for i in over:
            out[i] = most * sizes[i]
            left -= out[i]
        open_ -= over
    return out


def sainte_lague(weights: np.ndarray, seats: int, most: np.ndarray) -> np.ndarray:
    """Gives out the seats one by one to the highest quotient weight / (2 * had + 1); none gets more than its most.

    Equal to that loop, but found by bisection on the last quotient; ties go to the earlier entry.
    """
    weights, most = np.asarray(weights, float), np.asarray(most, np.int64)
    most = np.where(weights > 0, most, 0)
    seats = int(min(seats, most.sum()))
    if seats <= 0:
        return np.zeros(len(weights), np.int64)
    had = lambda q: np.minimum(most, np.floor((weights / q + 1) / 2).astype(np.int64))  # noqa: E731  quotients >= q
    low, high = weights[weights > 0].min() / (2 * float(most.max()) + 3), weights.max() * 1.01
    for _ in range(200):
        middle = (low * high) ** 0.5
        if had(middle).sum() > seats:
            low = middle
        else:
            high = middle
        if high / low < 1 + 1e-15:
            break
    out = had(high)
    while (left := seats - int(out.sum())) > 0:
        quotient = np.where(out < most, weights / (2 * out + 1), -1.0)
        highest = np.flatnonzero(quotient == quotient.max())
        out[highest[:left]] += 1
    return out


def _select(keys: tuple, docs: pd.DataFrame, quota: pd.DataFrame, seed: int) -> pd.DataFrame:
    """Within a shard: documents in hash order lie end to end on a line of tokens, cut into blocks of equal size."""
    source, shard = keys
    docs = docs.sort_values(["_nw_order", "_nw_id", "size"], kind="stable")
    size = docs["size"].to_numpy(np.int64)
    end = np.cumsum(size)
    total = int(end[-1]) if len(end) else 0
    n, q = (int(quota["blocks"].iloc[0]), int(quota["quota"].iloc[0])) if len(quota) else (0, 0)
    taken = np.zeros(len(docs), np.int64)
    if total and n:
        edges = (np.arange(n + 1, dtype=object) * total // n).astype(np.int64)
        times = np.full(n, q // n, np.int64)
        salt = U64(zlib.crc32(f"{seed}/{source}/{shard}".encode()))
        order = mix((np.arange(n, dtype=U64) << U64(32)) ^ salt)
        times[np.argsort(order, kind="stable")[: q % n]] += 1
        before = np.concatenate([[0], np.cumsum(times * np.diff(edges))])

        def until(at: np.ndarray) -> np.ndarray:
            k = np.minimum(np.searchsorted(edges, at, "right") - 1, n - 1)
            return before[k] + times[k] * (at - edges[k])

        taken = until(end) - until(end - size)
    return docs.drop(columns=["_nw_order", "_nw_id", "_nw_source", "_nw_shard"]).assign(taken=taken)


def _apportion(part: pd.DataFrame, by: str) -> pd.DataFrame:
    """quota of the first row is shared among the rows, in the order of by, as their blocks."""
    part = part.sort_values(by)
    return part.assign(quota=sainte_lague(part["blocks"].to_numpy(float), int(part["quota"].iloc[0]), part["most"].to_numpy(np.int64)))


def _dealt(sharded: DataFrame, crowded: DataFrame, shard_docs: int, seed: int, scratch: Scratch) -> DataFrame:
    """sharded with the rows of equal id, text and source spread over the source's shards, where over shard_docs of them crowd one.

    They are numbered in pieces of PIECE rows, so that neither counting nor numbering gets all of them in one task; which
    of equal rows has which number doesn't matter.
    """
    sharded = sharded.withColumn("_nw_key", F.xxhash64("_nw_source", "_nw_order"))
    inside = sharded.join(F.broadcast(crowded) if crowded.count() <= BROADCAST_KEYS else crowded, ["_nw_source", "_nw_shard"], "left_semi")
    keys = inside.groupBy("_nw_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard_docs).select("_nw_key", F.lit(True).alias("_nw_hot"))
    keys = scratch.write(keys, "hot-keys")
    marked = join_keys(sharded, keys, "_nw_key", F.spark_partition_id(), "left")
    hot = scratch.write(marked.where("_nw_hot").withColumn("_nw_row", F.monotonically_increasing_id()), "hot")
    hot = hot.withColumn("_nw_piece", F.floor(F.col("_nw_row") / PIECE))
    pieces = hot.groupBy("_nw_key", "_nw_piece").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("_nw_key").orderBy("_nw_piece")) - F.col("n")
    pieces = scratch.write(pieces.select("_nw_key", "_nw_piece", before.alias("_nw_before")), "pieces")
    inner = F.row_number().over(Window.partitionBy("_nw_key", "_nw_piece").orderBy("_nw_row"))
    hot = hot.withColumn("_nw_number", inner.cast("long")).join(pieces, ["_nw_key", "_nw_piece"]).withColumn("_nw_number", F.col("_nw_number") + F.col("_nw_before"))
    hot = hot.withColumn("_nw_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_nw_order", "_nw_number"), "_nw_shards"))
    hot = scratch.write(hot.select(*sharded.columns), "dealt")
    return marked.where("_nw_hot is null").select(*sharded.columns).unionByName(hot).drop("_nw_key")


def mix_sources(
    docs: DataFrame,
    weigh: Callable[[list[str | None]], list[float]],
    size: Column | None = None,
    source: str = "source",
    doc_id: str = "doc_id",
    seed: int = 7,
    most: float = 3.0,
    shard_docs: int = 512,
    max_block: int = 1024,
    blocks_per_source: int = 2048,
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """Rows of docs with size, source_size, target, taken (tokens the mix takes of it, repeats counted) and the columns keep.

    weigh gets all source names in code-point order (null last) and returns their weights.  Only ids, sources and
    sizes are shuffled, never texts.  Shards hold about shard_docs documents picked by hash, so that a hot source is
    many shards; a source's quota goes to groups of GROUP shards and from there to the shards, so that no task holds
    all shards of a source.  A block has about min(max_block, total / (sources * blocks_per_source)) tokens.  Of each
    document as many tokens are taken as its place in the picked blocks says, so reruns agree.

    Null text: size 0, takes 0.  Null source: a source of its own, last.  Null or repeated doc_id: each row counts by
    itself, and is dealt to a shard by its text too; where rows of equal id and text crowd a shard, by their number.  Empty table, or no source with a weight above 0: nothing is taken.
    Other columns are left out unless kept, whose names must not be those of results.  One row per source reaches the driver, as
    each needs a weight.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).cast("string").alias("source"),
        (size_in_words(F.col("text")) if size is None else size).alias("size"),
        F.xxhash64(F.lit(seed), F.col(doc_id), F.col("text")).alias("_nw_order"),
        *keep,
    )
    sized = scratch.write(sized.withColumn("_nw_source", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))), "sizes")
    per = sized.groupBy("_nw_source").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs")).collect()
    per.sort(key=lambda r: (r["_nw_source"] == "n", r["_nw_source"]))
    size_of = [int(r["tokens"]) for r in per]
    weights = weigh([None if r["_nw_source"] == "n" else r["_nw_source"][1:] for r in per]) if per else []
    goal = targets(size_of, weights, most)
    block = max(1, min(max_block, sum(size_of) // max(1, len(per) * blocks_per_source)))
    stats = spark.createDataFrame(
        [(r["_nw_source"], -(-int(r["docs"]) // shard_docs), s, g) for r, s, g in zip(per, size_of, goal, strict=True)],
        "_nw_source string, _nw_shards long, source_size long, target double",
    )
    stats = F.broadcast(stats) if len(per) <= BROADCAST_SOURCES else stats
    sharded = sized.join(stats, "_nw_source").withColumn("_nw_number", F.lit(0).cast("long"))
    # the order itself places a row within its shard, so take another hash for the shard
    sharded = sharded.withColumn("_nw_shard", F.pmod(F.xxhash64(F.lit(seed + 1), "_nw_order"), "_nw_shards"))
    sums = lambda rows: rows.groupBy("_nw_source", "_nw_shard").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("docs"))
    shards = scratch.write(sums(sharded), "sums")
    crowded = shards.where(F.col("docs") > CROWDED * shard_docs)
    if not crowded.isEmpty():
        sharded = _dealt(sharded, scratch.write(crowded.select("_nw_source", "_nw_shard"), "crowded"), shard_docs, seed, scratch)
        shards = sums(sharded)
    shards = shards.withColumn("blocks", F.when(F.col("tokens") > 0, F.greatest(F.lit(1), F.round(F.col("tokens") / block))).otherwise(0).cast("long"))
    shards = scratch.write(shards.withColumn("most", F.floor(most * F.col("blocks") + 1e-9)).withColumn("_nw_group", F.floor(F.col("_nw_shard") / GROUP)), "shards")
    groups = scratch.write(shards.groupBy("_nw_source", "_nw_group").agg(F.sum("blocks").alias("blocks"), F.sum("most").alias("most")), "groups")
    of = {r["_nw_source"]: (int(r["n"]), int(r["m"])) for r in groups.groupBy("_nw_source").agg(F.sum("blocks").alias("n"), F.sum("most").alias("m")).collect()}
    n, cap = (np.array([of.get(r["_nw_source"], (0, 0))[k] for r in per], np.int64) for k in (0, 1))
    wanted = np.array([g / s if s else 0.0 for g, s in zip(goal, size_of, strict=True)]) * n
    seats = sainte_lague(wanted, round(float(wanted.sum())), cap)
    quotas = spark.createDataFrame([(r["_nw_source"], int(q)) for r, q in zip(per, seats, strict=True)], "_nw_source string, quota long")
    by_group = groups.join(F.broadcast(quotas) if len(per) <= BROADCAST_SOURCES else quotas, "_nw_source")
    by_group = by_group.groupBy("_nw_source").applyInPandas(lambda part: _apportion(part, "_nw_group"), "_nw_source string, _nw_group long, blocks long, most long, quota long").select("_nw_source", "_nw_group", "quota")
    quotas = shards.select("_nw_source", "_nw_group", "_nw_shard", "blocks", "most").join(by_group, ["_nw_source", "_nw_group"]).groupBy("_nw_source", "_nw_group")
    quotas = quotas.applyInPandas(lambda part: _apportion(part, "_nw_shard"), "_nw_source string, _nw_group long, _nw_shard long, blocks long, most long, quota long")
    out = sharded.select("doc_id", "source", "size", "source_size", "target", *keep, "_nw_order", F.col("doc_id").alias("_nw_id"), "_nw_source", "_nw_shard")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.select("doc_id", "source", "size", "source_size", "target", *keep).schema)
    return (
        out.groupBy("_nw_source", "_nw_shard")
        .cogroup(quotas.select("_nw_source", "_nw_shard", "blocks", "quota").groupBy("_nw_source", "_nw_shard"))
        .applyInPandas(lambda keys, a, b: _select(keys, a, b, seed), f"{kinds}, taken long")
    )
