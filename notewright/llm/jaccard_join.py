"""Exact Jaccard self-join of shingle sets by universe partition and pigeonhole.

For each band of sizes, tokens are hashed into m segments.  Two linked sets differ in at most H tokens.  A band
either matches each segment exactly, and of m = H + 1 + e segments at least e + 1 are equal; or it matches them within
one deletion, and of m = H / 2 + 1 + e at least e + 1 differ in at most one token.  A segment's key is a hash of its
tokens; its one-deletion neighbourhood is the keys without one of them, so that is a key for each token, of segments
that are longer and so rarer.  Which of the two a band allocates is decided by cost: the number of keys, of pairs that
meet by chance and of members of frequent keys that either would make, counted over all sets for a hashed share of keys.

Sets meet on equal keys.  A key that many sets have is dear, and so is an empty one.  Every set may skip up to e
segments with dear keys, as a pair that matches in e + 1 segments still does in one that neither skips.  Only sets with
more such segments than that meet on the rest of them.  Candidates are pruned by a bound from parity bitmaps, then
compared token by token.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notewright.llm import _blobs
from notewright.llm._kernel import LOWER, SPACED, U64, Texts, mix, release, run_hashes, span_hashes, texts, words
from notewright.llm._shared import BROADCAST_KEYS, Scratch, bit_filter, in_filter, join_keys, lean, tidy
from notewright.llm.components import components

#: A key of more sets than this is dear.
CHEAP = 12
#: What a pair that meets, and a member of a dear key, cost beside a key that is sent: they only choose between
#: allocations, which find the same links.
PAIR_COST, DEAR_COST = 20, 20
#: One key in so many is counted to measure an allocation's cost; the share is of the hashed keys of all sets.
PROBE = 64
#: Keys merged within a task before they are sent.
HELD = 2_000_000
#: Documents of a bucket, about: the more keys a task sends to one at once, the fewer bytes each takes, as a set is named once for all of its keys there.
BUCKET = 8000
#: Keys of a bucket that meet at once, about.
MEET = 300_000
#: Members of a dear key compared by one task at a time.
BLOCK = 2048
#: Rounds of stars.
STARS = 1
#: Words of bitmaps compared at once.
TILE = 1 << 21


@dataclass(frozen=True)
class Bands:
    low: np.ndarray
    high: np.ndarray
    spare: np.ndarray  # e
    parts: np.ndarray  # m
    deletions: np.ndarray  # whether segments are matched within one deletion

    @staticmethod
    def make(num: int, den: int, within: np.ndarray | bool = False, most: int = 1 << 40) -> Bands:
        """For similarities of num / den or more.  Any two sizes that can be linked are both within some band.

        within: whether a band matches segments within one deletion, of each or of all.
        """
        low, high = [1], []
        while True:
            high.append(max(low[-1], low[-1] * 7 * den // (5 * num)))
            if high[-1] > most:
                break
            low.append(max(low[-1] + 1, -(-num * (high[-1] + 1) // den)))
        lo, hi = np.array(low, np.int64), np.array(high, np.int64)
        differ = 2 * hi * (den - num) // (den + num)  # the symmetric difference of linked sets of these sizes
        deletions = np.broadcast_to(np.asarray(within), differ.shape) & (differ > 0)
        apart = np.where(deletions, differ // 2, differ)  # segments that can fail to match
        spare = np.where(deletions, 1 + apart // 3, np.maximum(2, differ // 6))
        return Bands(lo, hi, spare, apart + 1 + spare, deletions)


@dataclass
class Sets:
    """tokens of each row's set (distinct), first: each row's first token with one entry more, cls: a hash of the set."""

    tokens: np.ndarray
    first: np.ndarray
    cls: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.diff(self.first)


def shingle_sets(t: Texts, k: int) -> Sets:
    rows = len(t.offsets) - 1
    low = LOWER[t.data]
    w = words(t, SPACED)
    wh = span_hashes(low, w.starts, w.ends)
    n = w.counts
    per = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(rows), per)
    at = np.repeat(w.first[:-1] - np.cumsum(per) + per, per) + np.arange(per.sum())
    tokens = run_hashes(wh, at, at + np.minimum(n, k)[row])
    new = ~pd.Series(tokens ^ mix(np.arange(rows, dtype=U64))[row]).duplicated().to_numpy()
    tokens, row = tokens[new], row[new]
    first = np.searchsorted(row, np.arange(rows + 1))
    prefix = np.zeros(len(tokens) + 1, U64)
    np.cumsum(mix(tokens ^ U64(0x5851F42D4C957F2D)), out=prefix[1:])
    cls = mix((prefix[first[1:]] - prefix[first[:-1]]) ^ mix(np.diff(first).astype(U64)))
    return Sets(tokens, first, cls.view(np.int64))


@dataclass
class Keys:
    """key, entry, segment: of each key; then of each entry its set's cls, its band, how many segments with dear keys it may skip, and its set's row."""

    key: np.ndarray
    entry: np.ndarray
    segment: np.ndarray
    cls: np.ndarray
    band: np.ndarray
    left: np.ndarray
    row: np.ndarray


def keys(s: Sets, bands: Bands) -> Keys:
    n = s.sizes
    a = np.searchsorted(bands.high, n)
    count = np.where(n > 0, np.searchsorted(bands.low, n, "right") - a, 0)
    row = np.repeat(np.arange(len(n)), count)
    band = np.repeat(a - np.cumsum(count) + count, count) + np.arange(count.sum())
    useful = bands.parts[band] - bands.spare[band] > 1 - bands.deletions[band]  # else only equal sets are linked
    row, band = row[useful], band[useful]
    size, parts = n[row], bands.parts[band]
    base = np.concatenate([[0], np.cumsum(parts)])
    entry = np.repeat(np.arange(len(row)), size)
    at = np.repeat(s.first[:-1][row] - np.cumsum(size) + size, size) + np.arange(size.sum())
    tokens = s.tokens[at]
    place = mix(tokens + mix(band.astype(U64) + U64(77))[entry]) >> U64(32)
    slot = base[entry] + ((place * parts[entry].astype(U64)) >> U64(32)).astype(np.int64)
    value = mix(tokens ^ U64(0x2545F4914F6CDD1D))
    total = np.zeros(base[-1], U64)
    np.add.at(total, slot, value)
    held = np.bincount(slot, minlength=base[-1])
    owner = np.repeat(np.arange(len(row)), parts)
    number = np.arange(base[-1]) - base[owner]
    # an empty key is dear from the start: that of an empty segment, or of one token under deletions
    bare = held <= bands.deletions[band][owner]
    running = np.concatenate([[0], np.cumsum(bare)])
    rank = running[1:] - running[base[:-1]][owner]  # of a bare segment among its entry's, from 1
    segment = mix((band[owner].astype(U64) << U64(32)) + number.astype(U64) + U64(1))
    empty = bare & (rank > bands.spare[band][owner])
    less = bands.deletions[band][entry] & (held[slot] > 1)
    key = np.concatenate([mix(total[held > 0] + segment[held > 0]), mix(segment[empty]), mix(total[slot[less]] - value[less] + segment[slot[less]])])
    where = np.concatenate([np.flatnonzero(held > 0), np.flatnonzero(empty), slot[less]])
    left = np.maximum(0, bands.spare[band] - (running[base[1:]] - running[base[:-1]]))
    return Keys(key, owner[where].astype(np.int32), number[where].astype(np.int32), s.cls[row], band, left, row)


def probes(s: Sets, both: tuple[Bands, Bands]) -> tuple[np.ndarray, np.ndarray]:
    """The counted share of the keys that each set would have under either allocation, as hashes whose lowest byte tells band
    and allocation; first: each set's first one, with one entry more."""
    code, row = [], []
    for k, bands in enumerate(both):
        got = keys(s, bands)
        some = np.flatnonzero((got.key & U64(PROBE - 1)) == 0)
        entry = got.entry[some]
        code.append((got.key[some] & ~U64(0xFF)) | (U64(2) * got.band[entry].astype(U64) + U64(k)))
        row.append(got.row[entry])
    code, row = np.concatenate(code), np.concatenate(row)
    order = np.argsort(row, kind="stable")
    return code[order].view(np.int64), np.searchsorted(row[order], np.arange(len(s.sizes) + 1))


def allocate(narrow: DataFrame, n_bands: int) -> np.ndarray:
    """Whether a band matches within one deletion: by the cost of the keys of all sets.  narrow: cls, probe.  Two rows a band reach the driver."""
    key = narrow.select("cls", F.explode("probe").alias("key")).distinct().groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    pairs = F.when(F.col("c") <= CHEAP, F.col("c") * (F.col("c") - 1) / 2 * PAIR_COST).otherwise(F.col("c") * DEAR_COST)
    cost = key.groupBy(F.col("key").bitwiseAND(F.lit(0xFF)).alias("code")).agg(F.sum(F.col("c") + pairs).alias("cost"))
    out = np.zeros((n_bands, 2))
    for r in cost.collect():
        out[r["code"] >> 1, r["code"] & 1] = r["cost"]
    return out[:, 1] < out[:, 0]


def _group(key: np.ndarray, cls: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order without repetitions of (key, cls), then where each key begins in it and how often it occurs."""
    order = np.lexsort((cls, key))
    k, c = key[order], cls[order]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (c[1:] != c[:-1])
    order = order[keep]
    k = k[keep]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]])) if len(k) else np.zeros(0, np.int64)
    return order, begin, np.diff(np.append(begin, len(k)))


_MEETING = "a long, b long, key long, band int, segment int, spare int"


def _meetings(docs: DataFrame, k: int, bands: Bands) -> DataFrame:
    """Pairs (a, b) that share a cheap key; and for dear keys, rows (a, null, key, band, segment, spare).  docs: _text.

    A task sends at most CHEAP + 1 sets of a key to its bucket; if it has more, the key is dear, and the sets go on
    as rows at once.  What is sent of a key is cut to 32 bits below those of its bucket; band and segment tell the
    rest.  A bucket is held as it is sent, and its keys meet by ranges.
    """
    n = _blobs.buckets(docs.count(), BUCKET, 64)
    held_keys = max(HELD, 8 * n)  # so that a bucket gets some keys at once
    shift = U64(64 - (n.bit_length() - 1))

    def named(cut: np.ndarray, band: np.ndarray, segment: np.ndarray) -> np.ndarray:
        return mix(cut ^ mix((band.astype(U64) << U64(32)) + segment.astype(U64))).view(np.int64)

    def send(held: list[Keys], turn: int) -> Iterator[pa.RecordBatch]:
        base = np.cumsum([0] + [len(h.cls) for h in held])
        key = np.concatenate([h.key for h in held])
        entry = np.concatenate([h.entry + np.int32(b) for h, b in zip(held, base, strict=False)])
        segment = np.concatenate([h.segment for h in held])
        cls, band, left = (np.concatenate([getattr(h, c) for h in held]) for c in ("cls", "band", "left"))
        order, begin, count = _group(key, cls[entry])
        key, entry, segment = key[order], entry[order], segment[order]
        rank = np.arange(len(key)) - np.repeat(begin, count)
        out: list[tuple[int, bytes]] = []
        at = np.flatnonzero(np.repeat(count > CHEAP, count))
        for i in range(0, len(at), 50_000):
            x = at[i : i + 50_000]
            e = entry[x]
            out.append(((turn + 7919 * i) % n, _blobs.pack([key[x], cls[e], *(_blobs.small(v) for v in (band[e], segment[x], left[e]))])))
        keep = np.flatnonzero(rank <= CHEAP)
        p = (key[keep] >> shift).astype(np.int64)
        edges = np.searchsorted(p, np.arange(n + 1))
        for i in np.flatnonzero(np.diff(edges)):
            x = keep[edges[i] : edges[i + 1]]
            used, back = np.unique(entry[x], return_inverse=True)
            low = ((key[x] << U64(64) - shift) >> U64(32)).astype(np.uint32)
            out.append((int(i), _blobs.pack([_blobs.steps(low), *(_blobs.small(v) for v in (segment[x], back)), cls[used], _blobs.small(band[used]), _blobs.small(left[used])])))
        yield from _blobs.rows([i for i, _ in out], [x for _, x in out])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, turn = [], 0, 0
        for batch in batches:
            for t in texts(batch.column("_text")):
                got = keys(shingle_sets(t, k), bands)
                held.append(got)
                size += len(got.key)
                turn += len(t.data)
                if size >= held_keys:
                    yield from send(held, turn)
                    held, size = [], 0
        if held:
            yield from send(held, turn)
        del held
        release()

    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32())

    def as_rows(*columns: np.ndarray | None) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(columns[0]), 100_000):
            part = [x[i : i + 100_000] if x is not None else None for x in columns]
            yield pa.RecordBatch.from_arrays([pa.nulls(len(part[0]), kind) if x is None else pa.array(x).cast(kind) for x, kind in zip(part, kinds, strict=True)], names=["a", "b", "key", "band", "segment", "spare"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for p, blobs in _blobs.by_bucket(batches):
            parts: list[list[np.ndarray]] = []
            sets = 0
            while blobs:
                x = blobs.pop()
                if len(x) == 5:
                    cut = ((x[0] >> shift) << U64(32)) | ((x[0] << U64(64) - shift) >> U64(32))
                    yield from as_rows(x[1], None, named(cut, x[2], x[3]), *x[2:])
                else:
                    parts.append([_blobs.summed(x[0]), x[1].astype(np.int32), x[2].astype(np.int32) + np.int32(sets), *x[3:]])
                    sets += len(x[3])
            if parts:
                low, segment, entry, cls, band, left = (np.concatenate(x) for x in zip(*parts, strict=True))
                del parts
                band, left = band.astype(np.int32), left.astype(np.int32)
                ranges = max(0, (len(low) // MEET).bit_length())
                where = (low.astype(U64) >> U64(32 - ranges)).astype(np.int64)
                for i in range(1 << ranges):
                    x = np.flatnonzero(where == i)
                    e = entry[x]
                    key = named(low[x].astype(U64) | (U64(p) << U64(32)), band[e], segment[x])
                    yield from meet(key, cls[e], band[e], segment[x], left[e])
        release()

    def meet(key: np.ndarray, cls: np.ndarray, band: np.ndarray, segment: np.ndarray, left: np.ndarray) -> Iterator[pa.RecordBatch]:
        order, begin, count = _group(key, cls)
        dear = order[np.repeat(count > CHEAP, count)]
        yield from as_rows(cls[dear], None, key[dear], band[dear], segment[dear], left[dear])
        pairs = []
        for c in range(2, CHEAP + 1):
            first = begin[count == c]
            if len(first):
                i, j = np.triu_indices(c, 1)
                member = cls[order[first[:, None] + np.arange(c)]]
                pairs.append(np.stack([member[:, i].ravel(), member[:, j].ravel()], 1))
        if pairs:
            both = np.concatenate(pairs)
            both = both[np.lexsort((both[:, 1], both[:, 0]))]
            both = both[np.concatenate([[True], (both[1:] != both[:-1]).any(1)])]
            yield from as_rows(both[:, 0].copy(), both[:, 1].copy(), None, None, None, None)

    return _blobs.dealt(docs.select("_text").mapInArrow(emit, _blobs.SCHEMA), n, 2).mapInArrow(merge, _MEETING)


def _bitmap(tokens: np.ndarray) -> bytes:
    """Parities of the tokens in four to eight times as many cells, a power of two; folds to half by XOR."""
    bits = max(64, 4 << max(0, len(tokens) - 1).bit_length())
    odd = np.bincount((mix(tokens) & U64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _fold(bitmaps: np.ndarray, size: int) -> np.ndarray:
    """Rows of bitmaps, folded to so many bytes each."""
    while bitmaps.shape[1] > size:
        half = bitmaps.shape[1] // 2
        bitmaps = bitmaps[:, :half] ^ bitmaps[:, half:]
    return bitmaps


def _rows(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A binary column's bytes, where each row begins in them, and its length."""
    _, offs, data = column.cast(pa.binary()).buffers()
    offs = np.frombuffer(offs, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offs[:-1].astype(np.int64), np.diff(offs)


def bitmap_difference(x: pa.Array, y: pa.Array) -> np.ndarray:
    """In how many bits each pair of bitmaps differs, the larger folded to the size of the smaller."""
    (dx, ox, lx), (dy, oy, ly) = _rows(x), _rows(y)
    out = np.zeros(len(lx), np.int64)
    for a, b in np.unique(np.stack([lx, ly], 1), axis=0):
        at = np.flatnonzero((lx == a) & (ly == b))
        size = min(a, b)
        left, right = (_fold(d[o[at][:, None] + np.arange(n)], size) for d, o, n in ((dx, ox, a), (dy, oy, b)))
        out[at] = np.bitwise_count((left ^ right).view(U64)).sum(1)
    return out


def _may_link(na: np.ndarray, nb: np.ndarray, differ: np.ndarray, num: int, den: int) -> np.ndarray:
    """Whether sets of these sizes that differ in at least so many tokens can be linked."""
    # |a & b| = (na + nb - d) / 2, |a | b| = (na + nb + d) / 2
    return den * (na + nb - differ) >= num * (na + nb + differ)


def _pruned(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs that their sizes and bitmaps allow, and the least difference that these show."""
    small = classes.select("cls", "n", "bitmap")
    joined = pairs.join(small.toDF("a", "na", "xa"), "a").join(small.toDF("b", "nb", "xb"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy().astype(np.int64) for c in ("na", "nb"))
            differ = np.maximum(np.abs(na - nb), bitmap_difference(batch.column("xa"), batch.column("xb")))
            ok = _may_link(na, nb, differ, num, den)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(differ)], names=["a", "b", "differ"]).filter(pa.array(ok))

    return joined.select("a", "b", "na", "nb", "xa", "xb").mapInArrow(run, "a long, b long, differ long")


def _links(pairs: DataFrame, sets: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a written table) that are linked, by comparing their sets.  Sets of no pair are left out before any is sent, unless too many have one for a broadcast."""

    def of(end: str) -> DataFrame:
        have = pairs.select(F.col(end).alias("cls")).distinct()
        some = sets.select("cls", "tokens")
        return (some.join(F.broadcast(have), "cls", "left_semi") if have.count() <= BROADCAST_KEYS else some).toDF(end, f"x{end}")

    joined = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for i, (x, y) in enumerate(zip(batch.column("xa"), batch.column("xb"), strict=True)):
                x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
                both = np.concatenate([x, y])
                both.sort()
                same = int((both[1:] == both[:-1]).sum())
                ok[i] = den * same >= num * (len(both) - same)
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok))

    return joined.select("a", "b", "xa", "xb").mapInArrow(run, "a long, b long")


def _candidate_sets(docs: DataFrame, chosen: DataFrame, k: int, scratch: Scratch) -> DataFrame:
    """(cls, tokens) of the chosen classes, each from its row h.  docs: _h, _text.  Rows that can't be chosen are left out by their bits, or by a join where there are too many chosen ones for that."""
    bits = bit_filter(chosen, "h")
    shared = docs.sparkSession.sparkContext.broadcast(bits)
    some = docs.select("_h", "_text") if bits is not None else docs.select("_h", "_text").join(chosen.select(F.col("h").alias("_h")), "_h", "left_semi")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have = shared.value
        for batch in batches:
            if have is not None:
                batch = batch.filter(pa.array(in_filter(have, batch.column("_h").to_numpy())))
            for t in texts(batch.column("_text")):
                s = shingle_sets(t, k)
                own = [s.tokens[i:j].tobytes() for i, j in zip(s.first[:-1], s.first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([batch.slice(t.lo, t.hi - t.lo).column("_h"), pa.array(s.cls), pa.array(own, pa.binary())], names=["_h", "cls", "tokens"])

    found = some.mapInArrow(run, "_h long, cls long, tokens binary")
    # joined and made distinct by the class: one shuffle of the tokens
    return scratch.write(found.join(chosen.select("cls", "h"), "cls").where("_h = h").select("cls", "tokens").dropDuplicates(["cls"]), "sets")


class _Labels:
    """Components of the classes linked so far."""

    def __init__(self, scratch: Scratch) -> None:
        self.scratch = scratch
        self.table: DataFrame | None = None

    def of(self, df: DataFrame, column: str, to: str) -> DataFrame:
        if self.table is None:
            return df.withColumn(to, F.col(column))
        return df.join(self.table.select(F.col("id").alias(column), F.col("comp").alias(to)), column, "left").withColumn(to, F.coalesce(to, column))

    def add(self, links: DataFrame) -> None:
        links = self.scratch.write(links, "links")
        if links.isEmpty():
            return
        # the components so far count as links
        every = links if self.table is None else links.unionByName(self.table.select(F.col("id").alias("a"), F.col("comp").alias("b")))
        self.table = self.scratch.write(components(every, self.scratch), "components")
        tidy(self.table.sparkSession)


def _within_dear(members: DataFrame, classes: DataFrame, labels: _Labels, num: int, den: int, scratch: Scratch, top: int | None = None) -> DataFrame:
    """Pairs of members of a dear key in different components that their bitmaps allow: block against block of a key.

    top: only so many likeliest partners of each member in a block, for a first round.
    """
    joined = labels.of(members, "cls", "comp")
    several = joined.groupBy("key").agg(F.count_distinct("comp").alias("c"), F.count(F.lit(1)).alias("size")).where("c > 1")
    several = scratch.write(several.select("key", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks")), "several")
    joined = join_keys(joined, several, "key", F.col("cls")).withColumn("own", F.pmod(F.xxhash64("cls"), F.col("blocks")).cast("int"))
    dealt = joined.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.withColumn("x", F.least("own", "other")).withColumn("y", F.greatest("own", "other"))
    dealt = dealt.join(classes.select("cls", "n", "bitmap"), "cls")  # bitmaps last: they are wide

    def compare(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        x, block, cls, comp, n = (rows.column(c).to_numpy() for c in ("x", "own", "cls", "comp", "n"))
        data, at, length = _rows(rows.column("bitmap").combine_chunks())
        bits = np.zeros((len(cls), length.min()), np.uint8)
        for size in np.unique(length):
            own = np.flatnonzero(length == size)
            bits[own] = _fold(data[at[own][:, None] + np.arange(size)], length.min())
        bits = bits.view(U64)
        same_block = (block == x[0]).all()
        left = np.flatnonzero(block == x[0])
        right = np.arange(len(cls)) if same_block else np.flatnonzero(block != x[0])
        if same_block:  # a pair within the largest component needs no comparison
            values, count = np.unique(comp, return_counts=True)
            left = left[comp[left] != values[count.argmax()]]
        tile = max(1, TILE // max(1, len(right) * bits.shape[1]))
        for i in range(0, len(left), tile):
            l = left[i : i + tile]
            differ = np.bitwise_count(bits[l][:, None, :] ^ bits[right][None, :, :]).sum(2, dtype=np.int64)
            differ = np.maximum(differ, np.abs(n[l][:, None] - n[right][None, :]))
            ok = (comp[l][:, None] != comp[right][None, :]) & _may_link(n[l][:, None], n[right][None, :], differ, num, den)
            if top is not None and ok.shape[1] > top:
                far = np.where(ok, differ, np.iinfo(np.int64).max)
                ok &= differ <= np.partition(far, top - 1, axis=1)[:, top - 1 : top]
                ok &= np.cumsum(ok, axis=1) <= top
            r, c = np.nonzero(ok)
            a, b = cls[l[r]], cls[right[c]]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(differ[r, c])], names=["a", "b", "differ"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted; those of one key and two blocks are compared at once."""
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy().astype(np.int64) for c in ("key", "x", "y")], 1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1), len(place)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if held and tuple(place[i]) != now:
                    yield from compare(pa.Table.from_batches(held))
                    held = []
                now = tuple(place[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from compare(pa.Table.from_batches(held))

    columns = ["key", "x", "y", "own", "cls", "comp", "n", "bitmap"]
    return dealt.select(*columns).repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(run, "a long, b long, differ long").groupBy("a", "b").agg(F.min("differ").alias("differ"))


def near_duplicates(docs: DataFrame, num: int = 4, den: int = 5, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links of similarity num / den) of each row.

    Words are runs of anything but ASCII white space, ASCII letters in lower case; a set is the distinct runs of
    `shingle` words, as 64-bit hashes; a text of fewer words is one shingle.  Equal sets are one class, so exact
    copies are never compared.  Nothing is capped or sampled: dear keys are handled as the module says.

    Null text or text without words: no shingles, alone in its component.  A null doc_id stays null, its
    component_id too where it is alone.  Rows with one doc_id count each as documents; their component is one where
    their texts are linked.  Empty table: no rows.
    """
    lean(docs.sparkSession)
    scratch = Scratch(docs.sparkSession, "jaccard")
    either = Bands.make(num, den), Bands.make(num, den, True)
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text")).withColumn("_h", F.xxhash64("doc_id", "_text"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in texts(batch.column("_text")):
                s = shingle_sets(t, shingle)
                part = batch.slice(t.lo, t.hi - t.lo)
                maps = [_bitmap(s.tokens[i:j]) for i, j in zip(s.first[:-1], s.first[1:], strict=True)]
                code, first = probes(s, either)
                probe = pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(code, pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("_h"), pa.array(s.sizes), pa.array(s.cls), pa.array(maps, pa.binary()), probe], names=["doc_id", "_h", "n_shingles", "cls", "bitmap", "probe"])
        release()

    kind = dict(base.dtypes)["doc_id"]
    narrow = scratch.write(base.mapInArrow(sized, f"doc_id {kind}, _h long, n_shingles long, cls long, bitmap binary, probe array<long>"), "narrow")
    bands = Bands.make(num, den, allocate(narrow, len(either[0].low)))
    meetings = scratch.write(_meetings(base, shingle, bands), "meetings")
    tidy(docs.sparkSession)  # the keys that were sent are the most that this run has on disk
    order = Window.partitionBy("a", "band").orderBy("segment")
    dear = meetings.where("b is null").select("a", "key", "band", "segment", "spare").distinct()
    dear = dear.withColumn("_r", F.dense_rank().over(order)).where("_r > spare").select("key", F.col("a").alias("cls"))
    dear = scratch.write(dear, "dear")
    met = meetings.select(F.col("a").alias("cls")).union(meetings.where("b is not null").select("b")).distinct()
    # copies of a class are merged in their tasks first, so that a hot class is a row a task
    classes = narrow.where("n_shingles > 0").groupBy("cls").agg(F.min(F.struct(F.col("_h").alias("h"), F.col("n_shingles").alias("n"), "bitmap")).alias("x"))
    classes = scratch.write(classes.join(met, "cls", "left_semi").select("cls", "x.h", "x.n", "x.bitmap"), "classes")
    pairs = scratch.write(_pruned(meetings.where("b is not null").select("a", "b").distinct(), classes, num, den), "candidates")
    scratch.drop(meetings)
    wanted = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(dear.select("cls")).distinct()
    tidy(docs.sparkSession)
    sets = _candidate_sets(base, scratch.write(classes.join(wanted, "cls", "left_semi").select("cls", "h"), "chosen"), shingle, scratch)
    labels = _Labels(scratch)
    labels.add(_links(pairs, sets, num, den))
    if not dear.isEmpty():
        for turn in range(STARS):  # stars first: they connect a group of near copies with few comparisons
            members = labels.of(dear, "cls", "comp")
            pivot = members.groupBy("key").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "cls").alias("h"), F.col("cls").alias("p"), F.col("comp").alias("pc"))).alias("_p"))
            star = join_keys(members, scratch.write(pivot, "pivots"), "key", F.col("cls")).where(F.col("_p.pc") != F.col("comp")).groupBy("cls").agg(F.min("_p").alias("_p"))
            star = _pruned(star.select(F.col("cls").alias("a"), F.col("_p.p").alias("b")), classes, num, den)
            labels.add(_links(scratch.write(star, "stars"), sets, num, den))
        for top in (1, None):  # the likeliest partners connect most of a group; the last round leaves none out
            labels.add(_links(scratch.write(_within_dear(dear, classes, labels, num, den, scratch, top), "within"), sets, num, den))
    least = narrow.where("n_shingles > 0").groupBy("cls").agg(F.min("doc_id").alias("_least"))
    least = scratch.write(labels.of(least, "cls", "comp"), "least")
    top = scratch.write(least.groupBy("comp").agg(F.min("_least").alias("component_id")), "tops")
    # both joins are of written tables: Spark splits the rows of a large component or class over tasks
    place = scratch.write(least.join(top, "comp").select("cls", "component_id"), "places")
    out = narrow.select("doc_id", "n_shingles", "cls").join(place, "cls", "left")
    return scratch.last(out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id")), "result")
