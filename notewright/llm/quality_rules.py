"""Quality rules: base counts, and the divergence of a document's histograms from its language's.

A language's reference is summed over all its documents that pass the base rules: a histogram of character classes
and one of its common words.  A document is measured against both by Jensen-Shannon distance (base 2, 0 to 1).
"""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm._kernel import LOWER, SPACED, U64, Texts, mix, release, run_hashes, span_hashes, sums, texts, windows, words
from notewright.llm._shared import Scratch, join_keys, lean

#: The most frequent words of a language, of equally frequent ones the first by code point; all others are one bin.
COMMON = 64
#: Character classes, the first that a character is in: ASCII white space, symbols that the base rules count, then by
#: Unicode's general category small letters, capitals, other letters, marks, numbers, punctuation, and all else.
CLASSES = 9
SYMBOLS = "#*$%&|<>"
#: Parts of a language's words that are ranked by themselves first.
PARTS = 16
#: Counts of so many words are held by a task before they are sent.
HELD = 400_000
#: References of so many languages (about 2 kB each) are broadcast; of more they are joined.  The result is the same.
BROADCAST_LANGUAGES = 4096


@functools.cache
def class_table() -> np.ndarray:
    """The class of each code point."""
    major = {"L": 4, "M": 5, "N": 6, "P": 7}
    kinds = [unicodedata.category(chr(i)) for i in range(sys.maxunicode + 1)]
    out = np.array([2 if k == "Ll" else 3 if k == "Lu" else major.get(k[0], 8) for k in kinds], np.int8)
    out[[9, 10, 11, 12, 13, 32]] = 0
    out[[ord(c) for c in SYMBOLS]] = 1
    return out


@dataclass
class Counts:
    base: pd.DataFrame
    classes: np.ndarray  # of each row
    begin: np.ndarray  # of each word in the lower-cased bytes
    end: np.ndarray
    row: np.ndarray
    hash: np.ndarray
    low: np.ndarray  # the bytes


def counts(t: Texts, min_words: int, repeat: int) -> Counts:
    rows = len(t.offsets) - 1
    w = words(t, SPACED)
    n = w.counts
    points = np.frombuffer(t.data.tobytes().decode().encode("utf-32-le"), np.uint32)
    first = np.concatenate([[0], np.cumsum((t.data & 0xC0) != 0x80)])[t.offsets]
    row_of = np.repeat(np.arange(rows), np.diff(first))
    classes = np.bincount(row_of * CLASSES + class_table()[points], minlength=rows * CLASSES).reshape(rows, CLASSES)
    salt = mix(np.arange(rows, dtype=U64))

    newline = np.flatnonzero(t.data == 10)
    begin = np.union1d(t.offsets[:-1], newline + 1)
    begin = begin[begin < len(t.data)]
    row = np.searchsorted(t.offsets, begin, "right") - 1
    end = np.minimum(np.append(newline, len(t.data))[np.searchsorted(newline, begin)], t.offsets[row + 1])
    filled = np.searchsorted(w.starts, end) > np.searchsorted(w.starts, begin)
    begin, end, row = begin[filled], end[filled], row[filled]
    again = pd.Series(span_hashes(t.data, begin, end) ^ salt[row]).duplicated().to_numpy()
    dup_lines = np.bincount(row[again], minlength=rows)

    wh = span_hashes(t.data, w.starts, w.ends)
    at, row = windows(w, 3)
    again = pd.Series(run_hashes(wh, at, at + 3) ^ salt[row]).duplicated(keep=False).to_numpy()
    cover = np.zeros(len(wh) + 1, np.int64)
    np.add.at(cover, at[again], 1)
    np.add.at(cover, at[again] + 3, -1)
    repeated = sums(np.cumsum(cover)[:-1] > 0, w.first)

    low = LOWER[t.data]
    base = pd.DataFrame({"n_words": n, "word_chars": classes[:, 1:].sum(1), "n_symbols": classes[:, 1], "n_dup_lines": dup_lines, "n_repeat_words": repeated})
    base["base_failed"] = (base.n_words < min_words) | (100 * base.n_repeat_words > repeat * base.n_words)
    return Counts(base, classes, w.starts, w.ends, w.doc, span_hashes(low, w.starts, w.ends), low)


def references(docs: DataFrame, scratch: Scratch, min_words: int = 50, repeat: int = 50) -> DataFrame:
    """(lang, classes, common, share): class histogram, common words with the most frequent first, and their histogram with all other words last.

    Counted over all documents that pass the base rules.  The row of null lang is the reference of all documents,
    those of null lang among them, which have none of their own.  A task sends a row for each word and language that
    it has, and Spark keeps only the heaviest words of a task before it ranks them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[str | None, bytes], int] = {}
        kinds: dict[str | None, np.ndarray] = {}

        def out() -> Iterator[pa.RecordBatch]:
            for part in [list(held.items())[i : i + 50_000] for i in range(0, len(held), 50_000)]:
                lang, word = zip(*(k for k, _ in part), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()).cast(pa.string()), pa.nulls(len(part), pa.int32()), pa.array([n for _, n in part], pa.int64())], names=["lang", "word", "class", "n"])
            held.clear()

        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for t in texts(batch.column("text")):
                c = counts(t, min_words, repeat)
                good = ~c.base.base_failed.to_numpy()
                code, names = pd.factorize(np.array(langs[t.lo : t.hi], object), use_na_sentinel=False)
                names = [None if isinstance(k, float) else k for k in names]
                for k, name in enumerate(names):
                    kinds[name] = kinds.get(name, 0) + c.classes[good & (code == k)].sum(0)
                mine = np.flatnonzero(good[c.row])
                own = code[c.row[mine]]
                _, at, n = np.unique(c.hash[mine] ^ mix(own.astype(U64)), return_index=True, return_counts=True)
                low = c.low.tobytes()
                for k, a, b, m in zip(own[at].tolist(), c.begin[mine[at]].tolist(), c.end[mine[at]].tolist(), n.tolist(), strict=True):
                    key = names[k], low[a:b]
                    held[key] = held.get(key, 0) + m
                if len(held) > HELD:
                    yield from out()
        yield from out()
        for name, v in kinds.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * CLASSES, pa.string()), pa.nulls(CLASSES, pa.string()), pa.array(range(CLASSES), pa.int32()), pa.array(v, pa.int64())], names=["lang", "word", "class", "n"])
        release()

    each = docs.select("lang", "text").mapInArrow(run, "lang string, word string, class int, n long").groupBy("lang", "word", "class").agg(F.sum("n").alias("n"))
    each = scratch.write(each, "counts")
    every = each.groupBy("word", "class").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "word", "class", "n")
    each = each.where("lang is not null").unionByName(every)
    # ranked within PARTS parts of a language's words first: a task sends the heaviest of each, and no task gets all of a language's
    top = each.where("word is not null").withColumn("part", F.pmod(F.xxhash64("word"), F.lit(PARTS)))
    for by in (["lang", "part"], ["lang"]):
        top = top.withColumn("r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "word"))).where(F.col("r") <= COMMON)
    top = top.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("r", "word", "n"))).alias("top"))
    total = each.groupBy("lang").agg(
        F.sum(F.when(F.col("word").isNotNull(), F.col("n"))).alias("words"),
        F.array(*(F.coalesce(F.sum(F.when(F.col("class") == k, F.col("n"))), F.lit(0)) for k in range(CLASSES))).alias("classes"),
    )
    both = total.join(top, total["lang"].eqNullSafe(top["lang"])).where("words > 0").select(total["lang"], "classes", "words", "top")
    share = F.transform("top", lambda x: x["n"] / F.col("words"))
    rest = F.col("words") - F.aggregate("top", F.lit(0).cast("long"), lambda a, x: a + x["n"])
    size = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    return scratch.write(both.select("lang", F.transform("classes", lambda x: x / size).alias("classes"), F.transform("top", lambda x: x["word"]).alias("common"), F.concat(share, F.array(rest / F.col("words"))).alias("share")), "references")


@dataclass
class Reference:
    classes: np.ndarray
    hashes: np.ndarray  # of the common words, sorted
    place: np.ndarray  # of each of them in share
    share: np.ndarray  # of COMMON words, the unused ones 0, and the rest

    @staticmethod
    def of(classes: list[float], common: list[str], share: list[float]) -> Reference:
        data = [x.encode() for x in common]
        ends = np.cumsum([len(x) for x in data])
        h = span_hashes(np.frombuffer(b"".join(data), np.uint8), ends - [len(x) for x in data], ends)
        order = np.argsort(h)
        return Reference(np.array(classes), h[order], order, np.array(share[:-1] + [0.0] * (COMMON - len(common)) + share[-1:]))

    def histogram(self, hashes: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
        """How often each row has each common word, and others."""
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        slot = np.where(self.hashes[k] == hashes, self.place[k], COMMON)
        return np.bincount(row * (COMMON + 1) + slot, minlength=rows * (COMMON + 1)).reshape(rows, COMMON + 1)


def jensen_shannon(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Distance between rows; an empty histogram is at distance 1 from any other."""
    p, q = (x / np.maximum(x.sum(1, keepdims=True), 1e-300) for x in (p, q))
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = sum(np.where(x > 0, x * np.log2(x / m), 0).sum(1) for x in (p, q)) / 2
    empty = (p.sum(1) < 0.5) != (q.sum(1) < 0.5)
    return np.where(empty, 1.0, np.sqrt(np.clip(d, 0, 1)))


def quality_rules(
    docs: DataFrame,
    min_words: int = 50,
    repeat: int = 50,
    class_limit: float = 0.2,
    word_limit: float = 0.5,
    min_word_guard: int = 50,
    doc_id: str = "doc_id",
    lang: str = "lang",
    text: str = "text",
) -> DataFrame:
    """Base counts, class_distance, word_distance, base_failed and kept of each row.

    base_failed: fewer than min_words words, or more than repeat % of the words stand in 3-word windows that the text
    has twice.  kept: not base_failed, class_distance <= class_limit, and word_distance <= word_limit where the text
    has min_word_guard words (in fewer, a histogram of words says too little).  Two passes over the texts, which are
    not shuffled while the references of all languages fit a broadcast of checked size.

    Null or empty text: all counts 0, distances 1, base_failed.  Null lang, or a lang without any document that passes
    the base rules: the reference of all documents.  Without any reference the distances are 1.  Repeated rows are
    counted and measured each.  Words are compared by 64-bit hashes, lines and windows too.
    """
    lean(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "rules")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    known = references(base, scratch, min_words, repeat)
    pooled = next((Reference.of(r["classes"], r["common"], r["share"]) for r in known.where("lang is null").collect()), None)
    few = known.count() <= BROADCAST_LANGUAGES
    given = {r["lang"]: Reference.of(r["classes"], r["common"], r["share"]) for r in known.where("lang is not null").collect()} if few else None
    shared = docs.sparkSession.sparkContext.broadcast((given, pooled))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have, other = shared.value
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            refs = have if have is not None else of_rows(batch, langs)
            for t in texts(batch.column("text")):
                c = counts(t, min_words, repeat)
                rows = t.hi - t.lo
                by_class, by_word = np.ones(rows), np.ones(rows)
                code, names = pd.factorize(np.array([k if k in refs else None for k in langs[t.lo : t.hi]], object), use_na_sentinel=False)
                for k, name in enumerate(names):
                    ref = refs.get(name, other)
                    if ref is None:
                        continue
                    mine = np.flatnonzero(code == k)
                    number = np.full(rows, -1)
                    number[mine] = np.arange(len(mine))
                    at = np.flatnonzero(number[c.row] >= 0)
                    hist = ref.histogram(c.hash[at], number[c.row[at]], len(mine))
                    by_class[mine] = jensen_shannon(c.classes[mine].astype(float), np.tile(ref.classes, (len(mine), 1)))
                    by_word[mine] = jensen_shannon(hist.astype(float), np.tile(ref.share, (len(mine), 1)))
                part = batch.slice(t.lo, rows)
                kept = ~c.base.base_failed.to_numpy() & (by_class <= class_limit) & ((c.base.n_words.to_numpy() < min_word_guard) | (by_word <= word_limit))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(c.base[k].to_numpy(), pa.int64()) for k in c.base.columns[:5]), pa.array(c.base.base_failed.to_numpy()), pa.array(kept), pa.array(by_class), pa.array(by_word)],
                    names=["doc_id", *c.base.columns, "kept", "class_distance", "word_distance"],
                )
        release()

    def of_rows(batch: pa.RecordBatch, langs: list[str | None]) -> dict[str, Reference]:
        first = {k: i for i, k in reversed(list(enumerate(langs))) if k is not None and batch.column("common")[i].is_valid}
        return {k: Reference.of(*(batch.column(c)[i].as_py() for c in ("classes", "common", "share"))) for k, i in first.items()}

    if not few:
        base = join_keys(base, known, "lang", F.col("doc_id"), "left")
    kind = dict(base.dtypes)["doc_id"]
    return base.mapInArrow(run, f"doc_id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, class_distance double, word_distance double")
