"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text, and its perplexities.

Symbols are the bytes of UTF-8, so an n-gram is exactly one integer: its oldest byte on top, the predicted byte last.
Counts, continuation counts, contexts and probabilities are tables sharded by n-gram and joined by key.

Scores are whole numbers, in steps of 1 / STEPS bit, so that sums don't depend on their order: a model that is joined
in shards and one that is small enough to broadcast give the same scores to the bit.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm._kernel import Texts, release, texts
from notewright.llm._shared import Scratch, join_keys, lean

ORDER = 5
STEPS = 1 << 16
#: Of a symbol that no order has seen: one of 256.
UNSEEN = -8 * STEPS
#: n-grams counted within a task before they are summed; what is left of more than half of it is sent on.
HELD = 1_000_000
#: A model of at most so many entries (12 bytes each) is broadcast; a larger one is joined in shards.
BROADCAST_ENTRIES = 6_000_000
#: Bytes of the window whose worst place is judged: about a word, as a few vile words hardly move the mean of a long text.
WINDOW = 8
#: As many trusted ids (8 bytes each) are broadcast; more are joined.
BROADCAST_IDS = 4_000_000


def ngrams(t: Texts, order: int = ORDER) -> np.ndarray:
    """One for each byte; a text begins after zeros."""
    n, rows = len(t.data), len(t.offsets) - 1
    at = np.arange(n) + (order - 1) * (np.repeat(np.arange(rows), np.diff(t.offsets)) + 1)
    wide = np.zeros(n + (order - 1) * (rows + 1), np.int64)
    wide[at] = t.data
    g = np.zeros(n, np.int64)
    for k in range(order):
        g |= wide[at - k] << np.int64(8 * k)
    return g


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    keys, counts, held = [], [], 0

    def summed() -> tuple[np.ndarray, np.ndarray]:
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        return key, np.bincount(back, weights=np.concatenate(counts), minlength=len(key)).astype(np.int64)

    for batch in batches:
        for t in texts(batch.column("text")):
            key, n = np.unique(ngrams(t, order), return_counts=True)
            keys.append(key)
            counts.append(n)
            held += len(key)
            if held > HELD:
                key, n = summed()
                keys, counts, held = [key], [n], len(key)
                if held > HELD // 2:
                    yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["g", "c"])
                    keys, counts, held = [], [], 0
    if keys:
        key, n = summed()
        yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["g", "c"])
        del key, n
    keys, counts = [], []
    release()


def discounts(of: dict[int, int]) -> tuple[float, float, float]:
    """D1, D2, D3+ from how many n-grams have the counts 1 to 4; where one of these is missing, 0.5, 1 and 1.5."""
    n1, n2, n3, n4 = (of.get(k, 0) for k in (1, 2, 3, 4))
    if not n1 or not n2 or not n3 or not n4:
        return 0.5, 1.0, 1.5
    y = n1 / (n1 + 2 * n2)
    each = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3)
    return tuple(min(max(d, 0.05), k + 0.95) for k, d in enumerate(each))  # type: ignore[return-value]


def _steps(bits: Column) -> Column:
    return F.round(bits * STEPS).cast("int")


def train(trusted: DataFrame, order: int = ORDER, scratch: Scratch | None = None) -> dict[int, tuple[DataFrame, DataFrame]]:
    """By order n: seen n-grams (g) with their log2 probability (q), and contexts (h) with the log2 weight of the lower order (qw), in steps.

    trusted: a frame with text.  Every lower-order count is of the n-grams that continue it.
    """
    scratch = scratch or Scratch(trusted.sparkSession, "lm")
    counts: dict[int, DataFrame] = {}
    top = trusted.select("text").mapInArrow(lambda b: _count(b, order), "g long, c long").groupBy("g").agg(F.sum("c").alias("c"))
    counts[order] = scratch.write(top, f"counts-{order}")
    for n in range(order - 1, 0, -1):
        mask = F.lit((1 << 8 * n) - 1)
        counts[n] = scratch.write(counts[n + 1].groupBy(F.col("g").bitwiseAND(mask).alias("g")).agg(F.count(F.lit(1)).alias("c")), f"counts-{n}")
    model: dict[int, tuple[DataFrame, DataFrame]] = {}
    lower: DataFrame | None = None
    for n in range(1, order + 1):
        of = {r["c"]: r["n"] for r in counts[n].where("c <= 4").groupBy("c").agg(F.count(F.lit(1)).alias("n")).collect()}
        d1, d2, d3 = discounts(of)
        cut = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        seen = counts[n].withColumn("h", F.shiftrightunsigned("g", 8)).withColumn("d", cut)
        context = seen.groupBy("h").agg(F.sum("c").alias("total"), F.sum(F.when(F.col("c") == 1, 1)).alias("n1"), F.sum(F.when(F.col("c") == 2, 1)).alias("n2"), F.sum(F.when(F.col("c") > 2, 1)).alias("n3"))
        mass = sum((F.coalesce(k, F.lit(0)) * d for k, d in (("n1", d1), ("n2", d2), ("n3", d3))), F.lit(0.0))
        context = context.select("h", "total", (mass / F.col("total")).alias("w"))
        table = seen.join(context, "h")
        if lower is None:
            table = table.withColumn("below", F.lit(1 / 256))
        else:
            table = table.withColumn("s", F.col("g").bitwiseAND(F.lit((1 << 8 * (n - 1)) - 1))).join(lower.select(F.col("g").alias("s"), F.col("p").alias("below")), "s")
        table = table.withColumn("p", (F.col("c") - F.col("d")) / F.col("total") + F.col("w") * F.col("below"))
        table = scratch.write(table.select("g", "p", _steps(F.log2("p")).alias("q")), f"grams-{n}")
        model[n] = (table, scratch.write(context.select("h", _steps(F.log2("w")).alias("qw")), f"contexts-{n}"))
        lower = table
    return model


@dataclass
class Packed:
    """By order: sorted n-grams with their scores, sorted contexts with their weights."""

    tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def steps(self, g: np.ndarray) -> np.ndarray:
        """Of n-grams of the highest order; an unseen one takes its context's weight and the lower order."""
        out, left, plus = np.zeros(len(g), np.int64), np.arange(len(g)), np.zeros(len(g), np.int64)
        for n in range(max(self.tables, default=0), 0, -1):
            keys, q, contexts, qw = self.tables[n]
            mine = g[left] & ((1 << 8 * n) - 1)
            k = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
            hit = keys[k] == mine if len(keys) else np.zeros(len(mine), bool)
            out[left[hit]] = q[k[hit]] + plus[left[hit]]
            left, mine = left[~hit], mine[~hit] >> 8
            if not len(left):
                return out
            k = np.minimum(np.searchsorted(contexts, mine), max(0, len(contexts) - 1))
            hit = contexts[k] == mine if len(contexts) else np.zeros(len(mine), bool)
            plus[left[hit]] += qw[k[hit]]
        out[left] = UNSEEN + plus[left]
        return out


def pack(model: dict[int, tuple[DataFrame, DataFrame]]) -> Packed | None:
    """For a broadcast; None if the model has more than BROADCAST_ENTRIES entries."""
    if sum(t.count() for pair in model.values() for t in pair) > BROADCAST_ENTRIES:
        return None
    out = {}
    for n, (table, context) in model.items():
        a, b = table.select("g", "q").toPandas().sort_values("g"), context.toPandas().sort_values("h")
        out[n] = (a.g.to_numpy(np.int64), a.q.to_numpy(np.int32), b.h.to_numpy(np.int64), b.qw.to_numpy(np.int32))
    return Packed(out)


def worst_windows(prefix: np.ndarray, offsets: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """By row, the mean bits a byte of its worst window; a shorter text is one window, an empty one has 0.

    prefix: sums of log2 probabilities before each byte and at the end; offsets: where each row begins, with one entry more.
    """
    n = np.diff(offsets)
    span = np.minimum(n, window)
    count = np.where(n > 0, n - span + 1, 0)
    first = np.cumsum(count) - count
    row = np.repeat(np.arange(len(n)), count)
    begin = np.arange(len(row)) - first[row] + offsets[:-1][row]
    bits = (prefix[begin] - prefix[begin + span[row]]) / span[row] if len(row) else np.zeros(0)
    out = np.zeros(len(n))
    out[count > 0] = np.maximum.reduceat(bits, first[count > 0]) if len(row) else 0
    return out


def score(docs: DataFrame, packed: Packed, columns: list[str], order: int = ORDER) -> DataFrame:
    """columns, n_symbols, log2_prob and worst_bits (see worst_windows) of each row's text."""
    shared = docs.sparkSession.sparkContext.broadcast(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for t in texts(batch.column("_text")):
                code, unique = pd.factorize(ngrams(t, order))
                prefix = np.concatenate([[0], np.cumsum(model.steps(unique)[code])]) / STEPS  # whole steps, so differences are exact
                part = batch.slice(t.lo, t.hi - t.lo)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(np.diff(t.offsets), pa.int64()), pa.array(np.diff(prefix[t.offsets]), pa.float64()), pa.array(worst_windows(prefix, t.offsets), pa.float64())],
                    names=[*columns, "n_symbols", "log2_prob", "worst_bits"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns, "_text").mapInArrow(run, f"{kinds}, n_symbols long, log2_prob double, worst_bits double")


def _resolved(grams: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]], order: int) -> DataFrame:
    """(g, q) of distinct n-grams g, by joins with the sharded tables: as Packed.steps()."""
    each = grams.withColumn("plus", F.lit(0)).withColumn("q", F.lit(None).cast("int"))
    for n in range(order, 0, -1):
        table, context = model[n]
        each = each.withColumn("_k", F.col("g").bitwiseAND(F.lit((1 << 8 * n) - 1))).withColumn("_h", F.shiftrightunsigned("_k", 8))
        each = each.join(table.select(F.col("g").alias("_k"), F.col("q").alias("_q")), "_k", "left").join(context.select(F.col("h").alias("_h"), "qw"), "_h", "left")
        each = each.withColumn("q", F.coalesce("q", F.col("_q") + F.col("plus"))).withColumn("plus", F.col("plus") + F.coalesce("qw", F.lit(0))).drop("_k", "_h", "_q", "qw")
    return each.select("g", F.coalesce("q", F.lit(UNSEEN) + F.col("plus")).alias("q"))


def score_sharded(docs: DataFrame, model: dict[int, tuple[DataFrame, DataFrame]], columns: list[str], order: int = ORDER, scratch: Scratch | None = None) -> DataFrame:
    """As score() to the bit, for a model too large to broadcast: every distinct n-gram of the corpus is joined with the tables once.

    A text is known by two hashes, and equal texts are scored once; the n-grams' places go along, as the worst window
    needs the bytes in their order again.  columns are shuffled once, at the end.
    """
    scratch = scratch or Scratch(docs.sparkSession, "lm-scores")
    keyed = docs.select(*columns, "_text", F.xxhash64("_text").alias("_ta"), F.xxhash64(F.lit(1), "_text").alias("_tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column("_text"), 1):
                g, n = np.unique(grams := ngrams(t, order), return_counts=True)
                places = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(np.argsort(grams, kind="stable"), pa.int32()))
                a, b = (pa.array(np.full(len(g), batch.column(c)[t.lo].as_py(), np.int64)) for c in ("_ta", "_tb"))
                for i in range(0, len(g), 10_000):
                    yield pa.RecordBatch.from_arrays([x.slice(i, 10_000) for x in (a, b, pa.array(g), places)], names=["_ta", "_tb", "g", "places"])

    def by_place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums, worst = [], []
            for grams in batch.column("grams"):
                q, places = grams.values.field("q").to_numpy(), grams.values.field("places")
                at = places.flatten().to_numpy()
                of = np.zeros(len(at), np.int64)
                of[at] = np.repeat(q, places.value_lengths().to_numpy())
                prefix = np.concatenate([[0], np.cumsum(of)]) / STEPS
                sums.append(prefix[-1])
                worst.append(worst_windows(prefix, np.array([0, len(at)]))[0])
            yield pa.RecordBatch.from_arrays([batch.column("_ta"), batch.column("_tb"), pa.array(sums, pa.float64()), pa.array(worst, pa.float64())], names=["_ta", "_tb", "log2_prob", "worst_bits"])

    each = keyed.where("_text != ''").dropDuplicates(["_ta", "_tb"]).select("_ta", "_tb", "_text").mapInArrow(run, "_ta long, _tb long, g long, places array<int>")
    each = scratch.write(each, "places")
    known = scratch.write(_resolved(each.select("g").distinct(), model, order), "resolved")
    found = join_keys(each, known, "g", F.col("_ta")).groupBy("_ta", "_tb").agg(F.collect_list(F.struct("q", "places")).alias("grams"))
    total = scratch.write(found.mapInArrow(by_place, "_ta long, _tb long, log2_prob double, worst_bits double"), "scores")
    rows = keyed.select(*columns, "_ta", "_tb", F.octet_length("_text").cast("long").alias("n_symbols"))
    none = F.lit(0.0)
    return rows.join(total, ["_ta", "_tb"], "left").select(*columns, "n_symbols", F.coalesce("log2_prob", none).alias("log2_prob"), F.coalesce("worst_bits", none).alias("worst_bits"))


def _trusted(docs: DataFrame, ids: DataFrame, where: Column) -> DataFrame:
    """lang and text of the documents whose id is in ids: by a broadcast of bounded size, or else a join.  docs: _nw_id, lang, text."""
    some = docs.where(where & F.col("text").isNotNull()).select("_nw_id", "lang", "text")
    if ids.count() > BROADCAST_IDS:
        return some.join(ids, "_nw_id", "left_semi").select("lang", "text")
    known = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toPandas()["_nw_id"].to_numpy(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            have, mine = known.value, batch.column("_nw_id").to_numpy(zero_copy_only=False).astype(np.int64)
            k = np.minimum(np.searchsorted(have, mine), max(0, len(have) - 1))
            yield batch.filter(pa.array(have[k] == mine if len(have) else np.zeros(len(mine), bool))).select(["lang", "text"])

    return some.mapInArrow(run, "lang string, text string")


def classify(
    docs: DataFrame,
    labels: DataFrame,
    quantile: float = 0.97,
    worst_quantile: float = 0.99,
    slack: float = 1.0,
    calibrate: int = 5,
    min_calibration: int = 100,
    order: int = ORDER,
    doc_id: str = "doc_id",
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """doc_id, lang, n_symbols, log2_prob, perplexity (per byte), threshold, worst_bits (of the worst window, a byte),
    worst_threshold and kept of each row, then its columns keep.

    Trusted: quality 1 and toxic 0.  Of the trusted documents, those whose id's hash is 0 modulo calibrate are not
    learnt from; quantile of their perplexities and worst_quantile of their worst windows' bits, by language, times
    slack are that language's thresholds: about so many trusted documents are lost to each, so the README gives what
    they catch.  A language with fewer than min_calibration of them, or null, takes the threshold of all languages.
    kept: neither perplexity nor worst window is above its threshold.  All trusted text is counted, all documents are
    scored.  Texts are not shuffled while the model fits a broadcast of checked size; a larger one is joined in shards,
    with the same result.

    Null or empty text: no symbols, perplexity 1, kept as there is nothing against it.  A doc_id that is null or no whole
    number is never trusted.  No trusted text at all: every symbol has probability 1/256, and without a threshold every
    row is kept.  Repeated rows are scored each.
    """
    spark = docs.sparkSession
    lean(spark)
    scratch = Scratch(spark, "lm")
    ids = labels.where("quality = 1 and toxic = 0").select(F.col("doc_id").try_cast("long").alias("_nw_id")).where("_nw_id is not null").distinct()
    ids = scratch.write(ids, "trusted")
    narrow = docs.select(F.col(doc_id).try_cast("long").alias("_nw_id"), F.col("lang").cast("string").alias("lang"), "text").where("_nw_id is not null")
    held = F.pmod(F.xxhash64("_nw_id"), F.lit(calibrate)) == 0
    model = train(_trusted(narrow, ids, ~held), order, scratch)
    packed = pack(model)

    def scored(df: DataFrame, columns: list[str]) -> DataFrame:
        out = score(df, packed, columns, order) if packed else score_sharded(df, model, columns, order, scratch)
        return out.withColumn("perplexity", F.when(F.col("n_symbols") > 0, F.pow(F.lit(2.0), -F.col("log2_prob") / F.col("n_symbols"))).otherwise(1.0))

    sample = scratch.write(scored(_trusted(narrow, ids, held).withColumnRenamed("text", "_text"), ["lang"]).where("n_symbols > 0").select("lang", "perplexity", "worst_bits"), "calibration")
    limit = F.percentile_approx("perplexity", quantile, 10000).alias("_nw_limit"), F.percentile_approx("worst_bits", worst_quantile, 10000).alias("_nw_worst")
    known = sample.where("lang is not null").groupBy("lang").agg(*limit, F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_calibration)
    limits = scratch.write(known.select(F.col("lang").alias("_nw_lang"), "_nw_limit", "_nw_worst"), "limits")
    pooled = sample.agg(*limit).first()
    if packed:
        scratch.drop_all_but(limits)
    more = [c for c in keep if c not in ("doc_id", "lang")]
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("_text"), *more)
    out = join_keys(scored(base, ["doc_id", "lang", *more]).withColumn("_nw_lang", F.col("lang")), limits, "_nw_lang", F.col("doc_id"), "left")
    out = out.withColumn("threshold", F.coalesce("_nw_limit", F.lit(pooled[0]).cast("double")) * slack)
    out = out.withColumn("worst_threshold", F.coalesce("_nw_worst", F.lit(pooled[1]).cast("double")) * slack)
    within = (F.col("perplexity") <= F.col("threshold")) & (F.col("worst_bits") <= F.col("worst_threshold"))
    kept = F.coalesce((F.col("n_symbols") == 0) | within, F.lit(True))
    return out.select("doc_id", "lang", "n_symbols", "log2_prob", "perplexity", "threshold", "worst_bits", "worst_threshold", kept.alias("kept"), *more)
