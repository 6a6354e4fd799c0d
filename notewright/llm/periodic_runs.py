"""Periodic runs: stretches of words that repeat with some period, found from the Lyndon words of both orders.

By the runs theorem every run contains a Lyndon word of its period that is, under one of the two orders of the
alphabet, the longest Lyndon word at its start.  A stack scanned from right to left finds these words by comparing
suffixes; each is then extended to both sides as far as its period holds.  Both need the longest common extension of two
places, by binary search over prefix hashes.  Runs are verified word by word; a failure means that hashes have
collided, and the stretch is scanned again with another base.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.llm._kernel import SPACED, U64, Texts, Words, mix, release, run_hashes, span_hashes, texts, windows, words
from notewright.llm._shared import lean

Run = tuple[int, int, int]
_MODULUS = (1 << 61) - 1
#: Words that are compared directly before hashes are.
DIRECT = 8


class Collision(Exception):
    """Two different stretches have one hash."""


class Extensions:
    """Longest common extensions of places in a sequence of small integers."""

    def __init__(self, w: list[int], base: int) -> None:
        self.w = w
        self.prefix, self.power = [0], [1]
        h, p = 0, 1
        for x in w:
            h = (h * base + x + 1) % _MODULUS
            p = p * base % _MODULUS
            self.prefix.append(h)
            self.power.append(p)

    def right(self, i: int, j: int) -> int:
        """How many words from i on equal those from j on; i < j."""
        w, most, n = self.w, len(self.w) - j, 0
        while n < most and n < DIRECT:
            if w[i + n] != w[j + n]:
                return n
            n += 1
        step, h, p = DIRECT, self.prefix, self.power
        while n + step <= most and not (h[i + n + step] - h[j + n + step] - (h[i + n] - h[j + n]) * p[step]) % _MODULUS:
            n += step
            step *= 2
        while step:
            if n + step <= most and not (h[i + n + step] - h[j + n + step] - (h[i + n] - h[j + n]) * p[step]) % _MODULUS:
                n += step
            step //= 2
        if n < most and w[i + n] == w[j + n]:
            raise Collision
        return n

    def left(self, i: int, j: int) -> int:
        """How many words before i equal those before j; i < j."""
        w, n = self.w, 0
        while n < i and n < DIRECT:
            if w[i - 1 - n] != w[j - 1 - n]:
                return n
            n += 1
        step, h, p = DIRECT, self.prefix, self.power
        while n + step <= i and not (h[i - n] - h[j - n] - (h[i - n - step] - h[j - n - step]) * p[step]) % _MODULUS:
            n += step
            step *= 2
        while step:
            if n + step <= i and not (h[i - n] - h[j - n] - (h[i - n - step] - h[j - n - step]) * p[step]) % _MODULUS:
                n += step
            step //= 2
        if n < i and w[i - 1 - n] == w[j - 1 - n]:
            raise Collision
        return n


def lyndon_ends(e: Extensions, reverse: bool) -> list[int]:
    """Where the longest Lyndon word at each place ends, under the order of the integers or its reverse.

    That is the next place whose suffix is smaller; the ends of the words to the right are the stack that is popped
    until one is.  A suffix is larger than its own prefixes under both orders.
    """
    w, n = e.w, len(e.w)
    end = [0] * n
    for i in range(n - 1, -1, -1):
        j, a = i + 1, w[i]
        while j < n:
            b = w[j]
            if a == b:
                same = e.right(i, j)
                if j + same == n or (w[i + same] < w[j + same]) == reverse:
                    break
            elif (a < b) == reverse:
                break
            j = end[j]
        end[i] = j
    return end


def _runs(w: list[int], least: int, periods: int, base: int) -> set[Run]:
    e, n, found = Extensions(w, base), len(w), set()
    for reverse in (False, True):
        end = lyndon_ends(e, reverse)
        last: dict[int, tuple[int, int]] = {}  # by period, the stretch extended last
        for i in range(n - 1, -1, -1):
            p = end[i] - i
            if p * periods > n or not (i + p < n and w[i] == w[i + p] or i and w[i - 1] == w[i + p - 1]):
                continue
            begin, stop = last.get(p, (n, 0))
            if i >= begin and i + p <= stop:
                continue
            stop = i + p + (e.right(i, i + p) if i + p < n else 0)
            begin = i - e.left(i, i + p)
            last[p] = begin, stop
            if stop - begin >= max(least, periods * p):
                if w[begin : stop - p] != w[begin + p : stop]:
                    raise Collision
                found.add((begin, stop - begin, p))
    return found


def runs(w: list[int], least: int = 24, periods: int = 3) -> list[Run]:
    """(start, length, period) of the runs of at least `least` words and `periods` periods (2 or more), by start, then period."""
    base = 0x1F0E1D2C3B4A5968
    while True:
        try:
            return sorted(_runs(w, least, periods, base % _MODULUS))
        except Collision:
            base = base * 3 + 1


def _repeating(t: Texts, w: Words, least: int, periods: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of words outside of which no run is: begins and ends.

    A run's words, but for its last period, equal those a period later, which are `same` words at least.  So its
    windows of `same` words come twice in the text and cover it wholly, and it lies in one maximal covered stretch; being
    longer, it ends there just where it ends in the text.  Equal hashes of different windows only add to the cover.
    """
    same = min(max(least, periods * q) - q for q in range(1, max(least, 2) + 1))
    at, doc = windows(w, same)
    key = mix(run_hashes(span_hashes(t.data, w.starts, w.ends), at, at + same) + doc.astype(U64) * U64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    equal = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][equal]] = twice[order[:-1][equal]] = True
    change = np.zeros(len(w.starts) + 1, np.int64)
    np.add.at(change, at[twice], 1)
    np.add.at(change, at[twice] + same, -1)
    covered = np.cumsum(change)[:-1] > 0
    new = np.zeros(len(covered) + 1, bool)
    new[w.first] = True
    inside = np.concatenate([[False], covered, [False]])
    begin = np.flatnonzero(covered & (~inside[:-2] | new[:-1]))
    end = np.flatnonzero(covered & (~inside[2:] | new[1:])) + 1
    long = end - begin >= least
    return begin[long], end[long]


def periodic_runs(docs: DataFrame, least: int = 24, periods: int = 3, text: str = "text", keep: tuple[Column | str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_words, runs (start, length, period; by start, then period) and collapsed of every row.

    Words are runs of anything but ASCII white space, numbered from 0, and equal where their bytes are.  A run is a
    stretch with smallest period q of at least `least` words and `periods` times q (2 or more) that no neighbouring word
    extends.  collapsed is the text's words joined by one blank, without those that stand behind the first q of any run.
    Null text, and text without words: no words, no runs, and an empty collapsed.  Repeated rows come out each; other
    columns don't matter, but keep must not name n_words, runs or collapsed.  A text is handled in one task, whatever its
    length; only stretches in which windows of words come twice are held as Python numbers.
    """
    if periods < 2:
        raise ValueError("a run has two periods at least")
    lean(docs.sparkSession)
    rows = docs.select(*keep, F.col(text).alias("_nw_text"))
    names = rows.columns[:-1]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column("_nw_text")):
                w = words(t, SPACED)
                raw, starts, ends = t.data.tobytes(), w.starts.tolist(), w.ends.tolist()
                found: list[list[dict[str, int]]] = [[] for _ in range(t.hi - t.lo)]
                change: dict[int, np.ndarray] = {}
                for a, b in zip(*_repeating(t, w, least, periods), strict=True):
                    row, number = int(w.doc[a]), {}
                    ids = [number.setdefault(raw[i:j], len(number)) for i, j in zip(starts[a:b], ends[a:b], strict=True)]
                    here = int(a - w.first[row])
                    for start, length, q in runs(ids, least, periods):
                        found[row].append({"start": here + start, "length": length, "period": q})
                        gone = change.setdefault(row, np.zeros(int(w.counts[row]) + 1, np.int64))
                        gone[here + start + q] += 1
                        gone[here + start + length] -= 1
                left = []
                for row in range(t.hi - t.lo):
                    spans = list(zip(starts[w.first[row] : w.first[row + 1]], ends[w.first[row] : w.first[row + 1]], strict=True))
                    if row in change:
                        spans = [spans[i] for i in np.flatnonzero(np.cumsum(change[row])[:-1] == 0)]
                    left.append(b" ".join([raw[i:j] for i, j in spans]))
                part = batch.slice(t.lo, t.hi - t.lo)
                columns = [*(part.column(c) for c in names), pa.array(w.counts), pa.array(found, pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))), pa.array(left, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "runs", "collapsed"])
        release()

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(scan, f"{kinds}n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")


def planted(doc_id: Column, text: Column, one_in: int = 10) -> Column:
    """The text with a periodic end where crc32 of the decimal id says so, its words joined by one blank; else as it is.

    h = crc32, g = h // one_in, n words: if h % one_in = 0, each word i from a = g % n on becomes word a + (i - a) % p,
    p = 1 + (n - a) // (3 + g % 8).  A null id leaves the text as it is, and so does a text without words.
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    w = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))
    g = F.floor(h / one_in)
    shape = F.struct(w.alias("w"), (g % F.size(w)).cast("int").alias("a"), (3 + g % 8).alias("d"))

    def end(s: Column) -> Column:
        p = (1 + F.floor((F.size(s["w"]) - s["a"]) / s["d"])).cast("int")
        repeated = F.transform(s["w"], lambda x, i: F.when(i < s["a"], x).otherwise(F.get(s["w"], s["a"] + (i - s["a"]) % p)))
        return F.array_join(repeated, " ")

    # a one-element array binds the words to a name, so that they are split once
    changed = F.element_at(F.transform(F.array(shape), end), 1)
    return F.when((h % one_in == 0) & F.regexp_like(text, F.lit(r"[^\x20\x09-\x0D]")), changed).otherwise(text)


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the most periods (of equal ones the first, then the shortest period), and the hashes of all runs and of what is left."""

    def order(x: Column, y: Column) -> Column:
        a, b = x["length"] * y["period"], y["length"] * x["period"]
        return (
            F.when(a > b, -1).when(a < b, 1).when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
            .when(x["period"] < y["period"], -1).when(x["period"] > y["period"], 1).otherwise(0)
        )

    best = F.get(F.array_sort("runs", order), F.lit(0))
    line = lambda r: F.concat(F.concat_ws(",", *(r[c].cast("string") for c in ("start", "length", "period"))), F.lit("\n"))
    lines = F.array_join(F.transform("runs", line), "")
    return found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256")).select(
        "doc_id", "n_runs", "b.start", "b.length", "b.period", F.expr("1000 * b.length div b.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256"
    )
