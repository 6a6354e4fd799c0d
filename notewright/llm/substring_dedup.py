"""Substring deduplication by sliding sentence spans.

Runs of several consecutive sentences are hashed; equal hashes meet in one join over the whole corpus; sentences
covered by a run that is not its first occurrence are removed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm import _blobs
from notewright.llm._kernel import LOWER, SPACED, U64, Texts, mix, release, run_hashes, span_hashes, table, texts, words
from notewright.llm._shared import lean

_STOP = table(".!?")
#: The full stop, exclamation and question mark of scripts without blanks between words, in UTF-8.
_WIDE_STOPS = ("。".encode(), "！".encode(), "？".encode())
#: Spans merged within a task before they are sent.
HELD = 800_000
#: Marks sent as one row.
MARKS = 4000


@dataclass
class Sentences:
    """begin: the byte where each begins (it ends where the next begins, white space included); first: each row's first sentence; word: its first word, with one entry more; length: of all sentences before it in words, with one entry more."""

    begin: np.ndarray
    first: np.ndarray
    word: np.ndarray
    length: np.ndarray
    word_hash: np.ndarray


def _wide_ends(data: np.ndarray) -> np.ndarray:
    """Where wide stops end."""
    if len(data) < 3 or not (data >= 0xE3).any():
        return np.zeros(0, np.int64)
    return np.sort(np.concatenate([np.flatnonzero((data[:-2] == s[0]) & (data[1:-1] == s[1]) & (data[2:] == s[2])) + 3 for s in _WIDE_STOPS]))


def sentences(t: Texts) -> Sentences:
    """A sentence ends after a word whose last character is one of .!?, behind a wide stop, or at a line break; case and the kind of white space don't count in its hash.

    A word that has more than two characters of three bytes or more (scripts without blanks between words) is as long
    as half of these, rounded down.
    """
    w = words(t, SPACED)
    starts, ends = w.starts, w.ends
    wide = _wide_ends(t.data)
    inner = wide[np.isin(wide, ends, invert=True)]
    if len(inner):  # words go on behind a wide stop: cut them there
        starts, ends = np.sort(np.concatenate([starts, inner])), np.sort(np.concatenate([ends, inner]))
    first = np.searchsorted(starts, t.offsets)
    n = len(starts)
    opens = np.ones(n, bool)
    if n > 1:
        lines = np.concatenate([[0], np.cumsum(t.data == 10)])
        row = np.repeat(np.arange(len(first) - 1), np.diff(first))
        opens[1:] = _STOP[t.data[ends[:-1] - 1]] | np.isin(ends[:-1], wide) | (lines[starts[1:]] > lines[ends[:-1]]) | (row[1:] != row[:-1])
    long = np.concatenate([[0], np.cumsum(t.data >= 0xE0)])
    before = np.concatenate([[0], np.cumsum(np.maximum(1, (long[ends] - long[starts]) // 2))])
    at = np.flatnonzero(opens)
    word = np.append(at, n)
    return Sentences(starts[at], np.searchsorted(at, first), word, before[word], span_hashes(LOWER[t.data], starts, ends))


def runs(s: Sentences, min_sentences: int, min_words: int, alone: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentences, last sentences and hashes of all runs.

    From each sentence forwards, and back from each, the shortest run of min_sentences or more with min_words words;
    a sentence of `alone` words or more is a run too.
    """
    n = len(s.begin)
    row = np.repeat(np.arange(len(s.first) - 1), np.diff(s.first))
    low, high = s.first[:-1][row], s.first[1:][row]  # sentences of the same row
    here = np.arange(n)
    begins, ends = s.length[:-1], s.length[1:]
    last = np.maximum(np.searchsorted(ends, begins + min_words), here + min_sentences - 1)
    ok = last < high
    a, b = here[ok], last[ok]
    begin = np.minimum(np.searchsorted(begins, ends - min_words, "right") - 1, here - min_sentences + 1)
    ok = begin >= low
    long = np.flatnonzero(ends - begins >= alone)
    a, b = np.concatenate([a, begin[ok], long]), np.concatenate([b, here[ok], long])
    pair = np.unique((a << 32) | b) if len(a) else np.zeros(0, np.int64)
    a, b = pair >> 32, pair & 0xFFFFFFFF
    return a, b, run_hashes(s.word_hash, s.word[a], s.word[b + 1])


def _later(h: np.ndarray, doc: np.ndarray, th: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of records in any order: an order by hash and occurrence, and what in it is neither first nor the first's repetition."""
    order = np.lexsort((b, a, th, doc, h))
    h, doc, th, a = h[order], doc[order], th[order], a[order]
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    at = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    return order, (doc != doc[at]) | (th != th[at]) | (a != a[at])


def repeated_spans(docs: DataFrame, min_sentences: int, min_words: int, alone: int) -> DataFrame:
    """(_nw_id, _nw_th, _nw_marks): the sentences of the row's text in non-first occurrences, as pairs of first and last.

    docs: _nw_id, _nw_th, _nw_text.  A task keeps the first occurrence it has of each hash and already marks its others, so that a bucket gets a
    hash at most once from a task, however often it occurs.
    """
    n = _blobs.buckets(docs.count(), 500)
    held_runs = max(HELD, 4 * n)  # so that a bucket gets some at once
    doc_buckets = n // 4
    shift = U64(64 - (n.bit_length() - 1))
    mark = -1  # the bucket number of marks, before they are dealt out

    def send(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        h, doc, th, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        order, later = _later(h, doc, th, a, b)
        out: list[tuple[int, bytes]] = []
        if later.any():
            at = order[later]
            for i in range(0, len(at), MARKS):
                k = at[i : i + MARKS]
                out.append((mark, _blobs.pack([doc[k], th[k], _blobs.small(a[k]), _blobs.small(b[k] - a[k])])))
        keep = order[~later]
        keep = keep[np.concatenate([[True], h[keep][1:] != h[keep][:-1]])] if len(keep) else keep
        p = (h[keep] >> shift).astype(np.int64)
        edges = np.searchsorted(p, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(edges)):
            k = keep[edges[i] : edges[i + 1]]
            key, back = np.unique(np.stack([doc[k], th[k]], 1), axis=0, return_inverse=True)
            out.append((int(i), _blobs.pack([h[k], key[:, 0].copy(), key[:, 1].copy(), _blobs.small(back.ravel()), _blobs.small(a[k]), _blobs.small(b[k] - a[k])])))
        anywhere = int(h[0] >> shift)  # marks need no bucket of their own: deal them out
        places = [(anywhere + 797 * i) % n if p == mark else p for i, (p, _) in enumerate(out)]
        yield from _blobs.rows(places, [x for _, x in out])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ids = batch.column("_nw_id").to_numpy(zero_copy_only=False).astype(np.int64)
            ths = batch.column("_nw_th").to_numpy(zero_copy_only=False).astype(np.int64)
            for t in texts(batch.column("_nw_text")):
                s = sentences(t)
                a, b, h = runs(s, min_sentences, min_words, alone)
                if not len(a):
                    continue
                row = np.searchsorted(s.first, a, "right") - 1
                held.append([h, ids[t.lo + row], ths[t.lo + row], a - s.first[row], b - s.first[row]])
                size += len(a)
                if size >= held_runs:
                    yield from send(held)
                    held, size = [], 0
        if held:
            yield from send(held)
        del held
        release()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What is not the first of its hash in a bucket, and the marks that came along, dealt by document."""
        held: list[list[np.ndarray]] = []
        size = 0
        for _, blobs in _blobs.by_bucket(batches):
            parts: list[list[np.ndarray]] = []
            for x in blobs:
                if len(x) == 4:
                    a = x[2].astype(np.int64)
                    held.append([x[0], x[1], a, a + x[3]])
                    size += len(a)
                else:
                    a = x[4].astype(np.int64)
                    parts.append([x[0], x[1][x[3]], x[2][x[3]], a, a + x[5]])
            if parts:
                h, doc, th, a, b = (np.concatenate(x) for x in zip(*parts, strict=True))
                order, later = _later(h, doc, th, a, b)
                at = order[later]
                held.append([doc[at], th[at], a[at], b[at]])
                size += len(at)
            if size >= held_runs:
                yield from by_document(held)
                held, size = [], 0
        if size:
            yield from by_document(held)
        del held
        release()

    def by_document(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        doc, th, a, b = (np.concatenate(x) for x in zip(*held, strict=True))
        p = (mix(doc.view(U64) ^ th.view(U64)) >> U64(64 - (doc_buckets.bit_length() - 1))).astype(np.int64)
        order = np.argsort(p, kind="stable")
        edges = np.searchsorted(p[order], np.arange(doc_buckets + 1))
        places = np.flatnonzero(np.diff(edges))
        own = [order[edges[i] : edges[i + 1]] for i in places]
        yield from _blobs.rows(places.tolist(), [_blobs.pack([doc[k], th[k], _blobs.small(a[k]), _blobs.small(b[k] - a[k])]) for k in own])

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All spans of a document meet; overlapping ones become one."""
        for _, parts in _blobs.by_bucket(batches):
            doc, th, a, b = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
            b = a + b
            order = np.lexsort((a, th, doc))
            doc, th, a, b = doc[order], th[order], a[order], b[order]
            rows = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1])]))
            row = np.repeat(np.arange(len(rows)), np.diff(np.append(rows, len(doc))))
            far = np.maximum.accumulate(b + (row << 32))  # the last sentence covered so far, later rows always beyond
            new = np.concatenate([[True], (a[1:] + (row[1:] << 32)) > far[:-1] + 1])
            first = np.flatnonzero(new)
            pair = np.stack([a[first], far[np.append(first[1:], len(a)) - 1] & 0xFFFFFFFF], 1).astype(np.int32)
            edges = np.append(np.searchsorted(first, rows), len(first))
            for i in range(0, len(rows), 10_000):
                at = rows[i : i + 10_000]
                marks = [pair[edges[j] : edges[j + 1]].tobytes() for j in range(i, i + len(at))]
                yield pa.RecordBatch.from_arrays([pa.array(doc[at]), pa.array(th[at]), pa.array(marks, pa.binary())], names=["_nw_id", "_nw_th", "_nw_marks"])
        release()

    sent = docs.select("_nw_id", "_nw_th", "_nw_text").mapInArrow(emit, _blobs.SCHEMA)
    merged = _blobs.dealt(sent, n).mapInArrow(merge, _blobs.SCHEMA)
    return _blobs.dealt(merged, doc_buckets).mapInArrow(cover, "_nw_id long, _nw_th long, _nw_marks binary")


def keyed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with _nw_id, _nw_th and _nw_text: the first two tell documents apart.

    _nw_th is a 64-bit hash of the text.  _nw_id is the id, and for a null one a second hash of the text, of 62
    bits and below all ids from -2**62 on.  So of 10**11 texts of null ids no two are taken for one, and of 10**10 different
    texts under one id some three pairs.
    """
    second = F.pmod(F.xxhash64(F.lit("second"), F.col(text)), F.lit(1 << 62)) - F.lit(1 << 62) - F.lit(1 << 62)
    return docs.withColumn("_nw_id", F.coalesce(F.col(doc_id).cast("long"), second)).withColumn("_nw_th", F.xxhash64(F.col(text))).withColumn("_nw_text", F.col(text))


def remove_repeated(
    docs: DataFrame,
    min_sentences: int = 2,
    min_words: int = 20,
    alone: int = 40,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """All rows and columns of docs; text without the repeated sentences; and _nw_sentences, _nw_removed.

    Occurrences are ordered by doc_id (a whole number), then place, so the copy in the smallest doc_id stays whole.
    Rows with the same doc_id and text are one document: what is removed in one is removed in all.  Null doc_ids
    come before all others, each text of them a document.  Null text stays null; text without words stays as it is.  A text whose sentences all go
    is empty.  Repeated runs of several sentences with under min_words words together stay, and single repeated
    sentences under `alone` words.  Scripts without blanks: see sentences().
    """
    lean(docs.sparkSession)
    key = keyed(docs, doc_id, text)
    spans = repeated_spans(key, min_sentences, min_words, alone)
    joined = key.drop("_nw_text").join(spans, ["_nw_id", "_nw_th"], "left").drop("_nw_id", "_nw_th")
    names = docs.columns
    place = names.index(text)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column(text)):
                part = batch.slice(t.lo, t.hi - t.lo)
                s = sentences(t)
                count = np.diff(s.first)
                removed = np.zeros(len(count), np.int64)
                values = part.column(text)
                marked = np.flatnonzero(~np.asarray(part.column("_nw_marks").is_null().to_numpy(zero_copy_only=False)))
                if len(marked):
                    new = values.to_pylist()
                    for r in marked:
                        cover = np.zeros(count[r] + 1, np.int64)
                        marks = np.frombuffer(part.column("_nw_marks")[r].as_py(), np.int32).reshape(-1, 2)
                        np.add.at(cover, marks[:, 0], 1)
                        np.add.at(cover, marks[:, 1] + 1, -1)
                        gone = np.cumsum(cover)[:-1] > 0
                        edges = np.append(s.begin[s.first[r] : s.first[r + 1]], t.offsets[r + 1])
                        head = t.data[t.offsets[r] : edges[0]].tobytes()
                        stay = [t.data[edges[i] : edges[i + 1]].tobytes() for i in np.flatnonzero(~gone)]
                        new[r] = (head + b"".join(stay)).decode() if stay else ""
                        removed[r] = gone.sum()
                    values = pa.array(new, pa.string())
                columns = [part.column(c) for c in names]
                columns[place] = values
                yield pa.RecordBatch.from_arrays([*columns, pa.array(count, pa.int64()), pa.array(removed)], names=[*names, "_nw_sentences", "_nw_removed"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return joined.select(*names, "_nw_marks").mapInArrow(cut, f"{kinds}, _nw_sentences long, _nw_removed long")


def digest(cut: DataFrame) -> DataFrame:
    """doc_id, the text that is left, how many sentences it had and how many went, and whether any did."""
    return cut.select("doc_id", "text", F.col("_nw_sentences").alias("n_sentences"), F.col("_nw_removed").alias("n_removed"), (F.col("_nw_removed") > 0).alias("cut"))
