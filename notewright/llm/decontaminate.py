"""Benchmark decontamination: exact containment of item-sized windows of words, by a prefix-filtered set join.

A window is the set of its word shingles in one global order, rarest first, by how often they occur in all documents.
All of them must occur in a document that holds the window, so the necessary prefix is one shingle, the rarest; a
window with a shingle that no document has is in none.  Documents are joined with the windows on that shingle; its place
in the window bounds where the window can begin and end, and the words themselves are then compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm._kernel import ALNUM, LOWER, U64, Texts, Words, run_hashes, span_hashes, texts, words
from notewright.llm._shared import Scratch, bit_filter, in_filter, lean

#: Words in a shingle; a shorter window is one shingle.
SHINGLE = 3
#: The windows left by the prefix filter are broadcast up to so many (about 300 bytes each); more are joined by a shuffle.
BROADCAST_WINDOWS = 100_000
_BITS = 20
_ITEM_WINDOW = "item string, text string, size int, shingles array<long>"


def split_words(t: Texts) -> tuple[np.ndarray, Words]:
    """Lower-cased bytes with a blank for all that is no word, and the words."""
    low = LOWER[t.data]
    return np.where(ALNUM[t.data], low, np.uint8(32)), words(t, ALNUM)


def _joined(flat: np.ndarray, w: Words, begin: np.ndarray, size: np.ndarray) -> list[bytes]:
    """The words of each run, with single blanks between."""
    return [b" ".join(flat[a:b].tobytes().split()) for a, b in zip(w.starts[begin].tolist(), w.ends[begin + size - 1].tolist(), strict=True)]


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """(item, text, size, shingles) of each window of each item: its words, their number, and its shingles' hashes in their order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column("t")):
                flat, w = split_words(t)
                wh = span_hashes(flat, w.starts, w.ends)
                n = np.minimum(w.counts, window)
                for k in np.unique(n[n > 0]).tolist():
                    s = min(SHINGLE, k)
                    own = np.flatnonzero(n[w.doc] == k) if len(w.doc) else np.zeros(0, np.int64)
                    at = own[own + k <= w.first[1:][w.doc[own]]]
                    inner = at[:, None] + np.arange(k - s + 1)
                    sh = run_hashes(wh, inner.ravel(), inner.ravel() + s).view(np.int64)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * (k - s + 1), pa.int32()), pa.array(sh))
                    text = pa.array(_joined(flat, w, at, np.full(len(at), k)), pa.binary()).cast(pa.string())
                    item = batch.column("item").take(pa.array(t.lo + w.doc[at]))
                    for i in range(0, len(at), 10_000):
                        yield pa.RecordBatch.from_arrays([x.slice(i, 10_000) for x in (item, text, pa.array(np.full(len(at), k), pa.int32()), lists)], names=["item", "text", "size", "shingles"])

    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").alias("t")).where("t is not null")
    return items.mapInArrow(run, _ITEM_WINDOW)


def _occurrences(docs: DataFrame, have: np.ndarray | None, sizes: list[int]) -> DataFrame:
    """(h, n): how often shingles of these sizes that may be in the filter occur in the documents, added up in each task first."""
    shared = docs.sparkSession.sparkContext.broadcast(have)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            for t in texts(batch.column("_text")):
                flat, w = split_words(t)
                wh = span_hashes(flat, w.starts, w.ends)
                for s in sizes:
                    at = np.flatnonzero(np.arange(len(wh)) + s <= w.first[1:][w.doc]) if len(wh) else np.zeros(0, np.int64)
                    h = run_hashes(wh, at, at + s)
                    held.append(h[in_filter(shared.value, h)])
            if sum(map(len, held)) > 1_000_000:
                yield from counted(held)
                held = []
        yield from counted(held)

    def counted(held: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        if held:
            h, n = np.unique(np.concatenate(held), return_counts=True)
            for i in range(0, len(h), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(h[i : i + 100_000].view(np.int64)), pa.array(n[i : i + 100_000], pa.int64())], names=["h", "n"])

    return docs.select("_text").mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def prefixes(docs: DataFrame, benchmark: DataFrame, window: int, scratch: Scratch) -> DataFrame:
    """(text, size, items, h, place): the windows that can occur in the documents, with their rarest shingle, of equally rare ones that with the smallest hash."""
    each = item_windows(benchmark, window).groupBy("text").agg(F.first("size").alias("size"), F.first("shingles").alias("shingles"), F.array_sort(F.collect_set("item")).alias("items"))
    each = scratch.write(each, "windows")
    shingles = scratch.write(each.select(F.explode("shingles").alias("h")).distinct(), "shingles")
    sizes = sorted(r[0] for r in each.select(F.least(F.lit(SHINGLE), "size")).distinct().collect())
    count = scratch.write(_occurrences(docs, bit_filter(shingles, "h"), sizes).join(shingles, "h"), "rarity")
    seen = each.select("text", F.posexplode("shingles").alias("place", "h")).join(count, "h")
    first = seen.groupBy("text").agg(F.count(F.lit(1)).alias("seen"), F.min(F.struct("n", "h", "place")).alias("x"))
    out = each.join(first, "text").where(F.col("seen") == F.size("shingles")).select("text", "size", "items", "x.h", "x.place")
    return scratch.write(out, "prefixes")


@dataclass
class Index:
    """The windows of a broadcast: items, size, hash and words of each; by shingle size, where each prefix leads."""

    items: list[list[str]] = field(default_factory=list)
    size: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    hash: np.ndarray = field(default_factory=lambda: np.zeros(0, U64))
    text: list[bytes] = field(default_factory=list)
    anchors: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def build_index(prefixed: pa.Table) -> Index:
    out = Index([sorted(x) for x in prefixed.column("items").to_pylist()], prefixed.column("size").to_numpy().astype(np.int64), text=[x.encode() for x in prefixed.column("text").to_pylist()])
    if not out.items:
        return out
    for t in texts(prefixed.column("text"), 1 << 62):
        flat, w = split_words(t)
        out.hash = run_hashes(span_hashes(flat, w.starts, w.ends), w.first[:-1], w.first[1:])
    key, place = prefixed.column("h").to_numpy().view(U64), prefixed.column("place").to_numpy().astype(np.int64)
    shingle = np.minimum(out.size, SHINGLE)
    for s in np.unique(shingle).tolist():
        win = np.flatnonzero(shingle == s)
        win = win[np.argsort(key[win], kind="stable")]
        unique, ptr = np.unique(key[win], return_index=True)
        maybe = np.zeros(1 << _BITS, bool)
        maybe[(unique >> U64(64 - _BITS)).astype(np.int64)] = True
        out.anchors[s] = (maybe, unique, np.append(ptr, len(win)), win, place[win])
    return out


def find(t: Texts, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Counts of words by row; each row's first word; begins and windows of all occurrences, as word numbers within the chunk."""
    flat, w = split_words(t)
    starts, wins = [], []
    if len(w.starts) and index.anchors:
        wh = span_hashes(flat, w.starts, w.ends)
        for s, (maybe, unique, ptr, win, place) in index.anchors.items():
            at = np.arange(len(wh) - s + 1)
            if not len(at):
                continue
            sh = run_hashes(wh, at, at + s)
            at = np.flatnonzero(maybe[(sh >> U64(64 - _BITS)).astype(np.int64)])
            k = np.minimum(np.searchsorted(unique, sh[at]), len(unique) - 1)
            at, k = (x[unique[k] == sh[at]] for x in (at, k))
            n = ptr[k + 1] - ptr[k]
            each = np.repeat(ptr[k], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            doc, begin, which = w.doc[np.repeat(at, n)], np.repeat(at, n) - place[each], win[each]
            ok = (begin >= w.first[doc]) & (begin + index.size[which] <= w.first[doc + 1])
            begin, which = begin[ok], which[ok]
            ok = run_hashes(wh, begin, begin + index.size[which]) == index.hash[which]
            begin, which = begin[ok], which[ok]
            ok = np.fromiter((x == index.text[i] for x, i in zip(_joined(flat, w, begin, index.size[which]), which, strict=True)), bool, len(begin))
            starts.append(begin[ok])
            wins.append(which[ok])
    begin = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    which = np.concatenate(wins) if wins else np.zeros(0, np.int64)
    return w.counts, w.first, begin, which


_SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<start: long, end: long>>"
_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])


def _scan(docs: DataFrame, index: Index, columns: list[str]) -> DataFrame:
    """The join by a broadcast of the windows: one pass over the documents, no shuffle."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = shared.value
        for batch in batches:
            for t in texts(batch.column("_text")):
                counts, first, begin, which = find(t, found)
                cover = np.zeros(int(first[-1]) + 1, np.int64)
                np.add.at(cover, begin, 1)
                np.add.at(cover, begin + found.size[which], -1)
                hit = np.cumsum(cover)[:-1] > 0
                prefix = np.concatenate([[0], np.cumsum(hit)])
                n_hit = prefix[first[1:]] - prefix[first[:-1]]
                rows = len(counts)
                items: list[list[str]] = [[] for _ in range(rows)]
                spans: list[list[dict]] = [[] for _ in range(rows)]
                if len(begin):
                    doc = np.searchsorted(first, begin, "right") - 1
                    for d in np.unique(doc):
                        items[d] = sorted({i for k in np.unique(which[doc == d]) for i in found.items[k]})
                        own = np.concatenate([[False], hit[first[d] : first[d + 1]], [False]]).astype(np.int8)
                        step = np.diff(own)
                        spans[d] = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(step == 1), np.flatnonzero(step == -1), strict=True)]
                part = batch.slice(t.lo, rows)
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in columns), pa.array(counts, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, pa.list_(_SPAN))],
                    names=[*columns, "n_words", "n_hit", "items", "spans"],
                )

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*columns).schema)
    return docs.select(*columns, "_text").mapInArrow(run, f"{kinds}, {_SCHEMA}")


def _shuffled(docs: DataFrame, prefixed: DataFrame, columns: list[str], window: int, scratch: Scratch) -> DataFrame:
    """The join by a shuffle: places of prefix shingles, each with the words about it, meet the windows; what they hit goes back to the documents.

    Only places that may be in a filter of the prefixes are sent, never whole texts.  A document is known by its id and
    the hash of its text.
    """
    # a word is a run, and what is no word here is a blank there: count the runs
    n_words = F.coalesce(F.regexp_count("_text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    keyed = docs.withColumn("_key", F.struct("doc_id", F.xxhash64("_text").alias("h")))
    sizes = sorted(r[0] for r in prefixed.select(F.least(F.lit(SHINGLE), "size")).distinct().collect())
    shared = docs.sparkSession.sparkContext.broadcast(bit_filter(prefixed.select("h").distinct(), "h"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column("_text")):
                flat, w = split_words(t)
                wh = span_hashes(flat, w.starts, w.ends)
                for s in sizes:
                    at = np.flatnonzero(np.arange(len(wh)) + s <= w.first[1:][w.doc]) if len(wh) else np.zeros(0, np.int64)
                    h = run_hashes(wh, at, at + s)
                    ok = in_filter(shared.value, h)
                    at, h = at[ok], h[ok]
                    doc = w.doc[at]
                    low, high = np.maximum(at - (window - s), w.first[doc]), np.minimum(at + window, w.first[doc + 1])
                    around = pa.array(_joined(flat, w, low, high - low), pa.binary()).cast(pa.string())
                    columns = [batch.column("_key").take(pa.array(t.lo + doc)), pa.array(h.view(np.int64)), pa.array(at - w.first[doc]), pa.array((at - low).astype(np.int32)), around]
                    for i in range(0, len(at), 10_000):
                        yield pa.RecordBatch.from_arrays([x.slice(i, 10_000) for x in columns], names=["_key", "h", "at", "before", "around"])

    kind = keyed.select("_key").schema[0].dataType.simpleString()
    places = keyed.select("_key", "_text").mapInArrow(run, f"_key {kind}, h long, at long, before int, around string")
    met = places.join(prefixed, "h").where(F.col("place") <= F.col("before"))
    same = F.concat_ws(" ", F.slice(F.split("around", " "), F.col("before") - F.col("place") + 1, F.col("size"))) == F.col("text")
    begin = F.col("at") - F.col("place")
    hits = met.where(same).select("_key", "items", F.struct(begin.alias("start"), (begin + F.col("size")).alias("end")).alias("span")).distinct()
    # spans that touch or overlap become one
    merged = F.aggregate(
        F.array_sort(F.collect_set("span")), F.array().cast("array<struct<start: long, end: long>>"),
        lambda done, x: F.when((F.size(done) > 0) & (F.element_at(done, -1)["end"] >= x["start"]),
            F.concat(F.slice(done, 1, F.size(done) - 1), F.array(F.struct(F.element_at(done, -1)["start"].alias("start"), F.greatest(F.element_at(done, -1)["end"], x["end"]).alias("end")))),
        ).otherwise(F.concat(done, F.array(x))),
    )
    marks = hits.groupBy("_key").agg(merged.alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"))
    marks = scratch.write(marks, "marks")
    size = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    none = F.array().cast("array<string>"), F.array().cast("array<struct<start: long, end: long>>")
    return keyed.select(*columns, "_key", n_words.alias("n_words")).join(marks, "_key", "left").select(*columns, "n_words", F.coalesce(size, F.lit(0)).cast("long").alias("n_hit"), F.coalesce("items", none[0]).alias("items"), F.coalesce("spans", none[1]).alias("spans"))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, doc_id: str = "doc_id", text: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_words, n_hit, items (ids as sorted strings) and spans of hit words, and the columns keep.

    Rarity is counted over all documents in a first pass; the windows that are left by the prefix filter are joined in a
    second one: by a broadcast if they are few (their count is checked), else by a shuffle of the places where their
    prefixes occur.  The result is the same.

    Null or empty text: no words, no hits.  An item without words has no windows; an item with a null id counts as ''.
    Items of one id count once.  Rows with the same doc_id and text get the same result each.  Empty benchmark: no hits.
    """
    lean(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "benchmark")
    columns = ["doc_id", *(c for c in keep if c != "doc_id")]
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("_text"), *columns[1:])
    found = prefixes(base, benchmark, window, scratch)
    if found.count() > BROADCAST_WINDOWS:
        return _shuffled(base, found, columns, window, scratch)
    index = build_index(found.toArrow())
    scratch.drop_all_but()
    return _scan(base, index, columns)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, the number of items, a hash of their ids, and whether any word is hit."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )
