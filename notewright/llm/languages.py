"""Language identification by mixture inference.

Each language is a distribution over hashed n-grams.  A document is a mixture of languages: expectation-maximisation
over units of consecutive n-grams estimates the proportions, for nested sets of its likeliest languages, and a
penalised likelihood picks the set.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm._kernel import LOWER, Texts, texts
from notewright.llm._shared import lean

GRAM = 4  # bytes
#: n-grams in a unit, whose language is one.
UNIT = 16
BUCKETS = 1 << 16
#: The model has BUCKETS numbers of four bytes a language and is broadcast, so more languages than these are refused.
MOST_LANGUAGES = 2000
#: Overlapping n-grams repeat their evidence; their log likelihoods count by this.
TEMPER = 1.0 / GRAM
_FOLD = LOWER.copy()
_FOLD[[i for i in range(0x80) if not (0x61 <= LOWER[i] <= 0x7A)]] = 32  # all ASCII but letters is a gap


def grams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """A 32-bit n-gram beginning before each byte, and offsets by row; each text stands between blanks."""
    n, rows = len(t.data), len(t.offsets) - 1
    at = np.arange(n) + (GRAM - 1) * np.repeat(np.arange(rows), np.diff(t.offsets))
    wide = np.full(n + (GRAM - 1) * rows + GRAM, 32, np.uint32)
    wide[at + 1] = _FOLD[t.data]
    g = wide[: -(GRAM - 1)] | wide[1 : 2 - GRAM] << np.uint32(8) | wide[2 : 3 - GRAM] << np.uint32(16) | wide[3:] << np.uint32(24)
    return g[at], t.offsets


def bucket(g: np.ndarray, buckets: int) -> np.ndarray:
    return ((g * np.uint32(2654435761)) ^ (g >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(32 - (buckets.bit_length() - 1))


@dataclass
class Model:
    langs: list[str]
    log: np.ndarray  # buckets x languages
    share: np.ndarray  # of the n-grams, by language


def train(docs: DataFrame, buckets: int = BUCKETS, smooth: float = 0.5) -> Model:
    """From all rows with a lang.  Counts are summed within each task, then by key; a language's counts don't depend on the others.

    No row with a lang: a model without languages.  Null and empty texts teach nothing, but their lang is learnt.
    """
    lean(docs.sparkSession)
    labelled = docs.where("lang is not null")
    langs = sorted(r[0] for r in labelled.select("lang").distinct().limit(MOST_LANGUAGES + 1).collect())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} values of lang: a model has {buckets * 4} bytes for each of them and is broadcast")
    place = {k: i for i, k in enumerate(langs)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            code = np.array([place[k] for k in batch.column("lang").to_pylist()], np.int64)
            for t in texts(batch.column("text")):
                g, offs = grams(t)
                b = bucket(g, buckets)
                row = np.repeat(code[t.lo : t.hi], np.diff(offs))
                for k in np.unique(code[t.lo : t.hi]):
                    held.setdefault(int(k), np.zeros(buckets, np.int64))
                    held[int(k)] += np.bincount(b[row == k], minlength=buckets)
        for k, v in held.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k), pa.int32()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], names=["k", "b", "n"])

    count = np.zeros((buckets, len(langs)))
    if langs:
        found = labelled.select("lang", "text").mapInArrow(run, "k int, b int, n long").groupBy("k", "b").agg(F.sum("n").alias("n")).toPandas()
        count[found.b, found.k] = found.n
    total = count.sum(0)
    log = np.log((count + smooth) / (total + smooth * buckets)) * TEMPER
    return Model(langs, log.astype(np.float32), total / max(1.0, total.sum()))


def mixture(unit: np.ndarray, first: np.ndarray, sets: np.ndarray, rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """EM within the allowed languages (sets: rows x languages); proportions and log likelihood by row.

    unit: log likelihood of each unit in each language; first: each row's first unit, with one entry more; no row is empty.
    """
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    top = np.where(sets[row], unit, -np.inf).max(1)
    p = np.exp(unit - top[:, None]) * sets[row]
    theta = sets / sets.sum(1, keepdims=True)
    n = np.diff(first)[:, None]
    for _ in range(rounds):
        r = p * theta[row]
        r /= r.sum(1, keepdims=True)
        theta = np.add.reduceat(r, first[:-1], axis=0) / n
    like = np.log((p * theta[row]).sum(1)) + top
    return theta, np.add.reduceat(like, first[:-1])


def infer(t: Texts, model: Model, penalty: float) -> tuple[np.ndarray, np.ndarray]:
    """Proportions of each row's chosen languages (rows x languages, all 0 without n-grams), rows without gaps only."""
    rows, k = len(t.offsets) - 1, len(model.langs)
    out = np.zeros((rows, k), np.float32)
    g, offs = grams(t)
    n_units = -(-np.diff(offs) // UNIT)
    some = np.flatnonzero(n_units)
    if not len(some) or not k:
        return out, some
    per = n_units[some]
    first = np.concatenate([[0], np.cumsum(per)])
    begin = np.repeat(offs[:-1][some] - first[:-1] * UNIT, per) + np.arange(first[-1]) * UNIT
    unit = np.add.reduceat(model.log[bucket(g, model.log.shape[0])], begin, axis=0)
    alone = np.add.reduceat(unit, first[:-1], axis=0)
    best = alone.argmax(1)
    theta = np.zeros((len(some), k), np.float32)
    theta[np.arange(len(some)), best] = 1
    like = alone.max(1)
    # where one language is likeliest in every unit, no mixture is likelier than that language alone
    mixed = np.minimum.reduceat(unit[np.arange(len(unit)), np.repeat(best, per)] == unit.max(1), first[:-1]) == 0
    left = np.flatnonzero(mixed)
    if len(left):
        units = np.flatnonzero(mixed[np.repeat(np.arange(len(some)), per)])
        u, f = unit[units], np.concatenate([[0], np.cumsum(per[left])])
        full, _ = mixture(u, f, np.ones((len(left), k), bool))
        order = np.argsort(-full, axis=1, kind="stable")
        cost = penalty * np.log(per[left] + 1.0)
        score, chosen = like[left].astype(float), theta[left]
        rising = np.arange(len(left))  # rows whose penalised likelihood rose with the last language
        for size in range(2, k + 1):
            own = np.isin(np.repeat(np.arange(len(left)), per[left]), rising)
            sets = np.zeros((len(rising), k), bool)
            np.put_along_axis(sets, order[rising, :size], True, axis=1)
            th, ll = mixture(u[own], np.concatenate([[0], np.cumsum(per[left][rising])]), sets)
            now = ll - (size - 1) * cost[rising]
            better = now > score[rising]
            rising, th, now = rising[better], th[better], now[better]
            if not len(rising):
                break
            score[rising], chosen[rising] = now, th
        theta[left] = chosen
    out[some] = theta
    return out, some


def identify(docs: DataFrame, model: Model, penalty: float = 2.0, doc_id: str = "doc_id", text: str = "text", keep: tuple[Column, ...] = ()) -> DataFrame:
    """doc_id, lang_pred, score (the proportion of lang_pred, 0 to 1), langs (the chosen set with proportions), then keep.

    The set grows by the next likeliest language as long as the penalised likelihood rises, up to all of them.
    lang_pred: the language with the largest proportion, ties by code point.  Only text is looked at.  The model is of
    bounded size and broadcast; texts are not shuffled.  A text is held as a number for each 16 bytes and language.

    Null text or text without a letter: und, score 0, no langs.  A model without languages: und for all.  Repeated rows
    are answered each, other columns are left out unless kept.
    """
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    letter = F.coalesce(F.regexp_like(F.col(text), F.lit(r"\p{L}")), F.lit(False))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), letter.alias("_letter"), *keep)
    more = [c for c in base.columns if c not in ("text", "_letter")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            for t in texts(batch.column("text")):
                theta, _ = infer(t, m, penalty)
                part = batch.slice(t.lo, t.hi - t.lo)
                has = part.column("_letter").to_numpy(zero_copy_only=False).astype(bool) & (len(m.langs) > 0)
                best = theta.argmax(1) if len(m.langs) else np.zeros(len(has), np.int64)
                pred = np.where(has, np.array(m.langs or ["und"], object)[best], "und")
                score = np.where(has, theta[np.arange(len(best)), best] if len(m.langs) else 0.0, 0.0)
                r, k = np.nonzero((theta > 0.005) & has[:, None])
                frame = pd.Series([{"lang": m.langs[j], "share": float(theta[i, j])} for i, j in zip(r, k, strict=True)], index=r, dtype=object)
                langs: list[list[dict]] = [[] for _ in range(len(has))]
                for i, x in frame.items():
                    langs[i].append(x)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in more), pa.array(pred, pa.string()), pa.array(np.clip(score, 0, 1), pa.float64()), pa.array(langs, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                    names=[*more, "lang_pred", "score", "langs"],
                )

    kinds = ", ".join(f"`{c}` {t}" for c, t in base.dtypes if c in more)
    return base.mapInArrow(run, f"{kinds}, lang_pred string, score double, langs array<struct<lang: string, share: double>>")


def held_out(doc_id: Column) -> Column:
    """The third of documents that nothing is learnt from; a null id is not in it."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
