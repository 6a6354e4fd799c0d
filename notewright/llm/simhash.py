"""SimHash near copies: fingerprints within a few bits of each other, found exactly.

Fingerprints that differ by `bits` at most agree wholly on one of bits + 1 separate fields.  So each different fingerprint
goes to a bucket for each field, by what it has there: bits + 1 rows, however many fingerprints there are.  Fields of
so many bits that they would be short (over MOST_FIELDS of them) choose little; there a tree is used instead.

Fingerprints are dealt to the leaves of a vantage-point tree.  A node looks at a field of the bits, each
level at another one; a fingerprint goes inside or outside by its Hamming distance to the node's vantage point on that
field.  By the triangle inequality, fingerprints on both sides of a boundary differ on the field by what the farther one
has to move to cross it at least, and what they differ by on separate fields adds up.  So a fingerprint visits, besides
its own leaf, those leaves that it reaches by crossings of `bits` in all, and of these only the ones behind its own, as a
pair has to meet once.  In a leaf, shells of distances to four more vantage points prune what is compared in the
same way; links within the leaf are reduced to a star about each group before they leave it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm._kernel import LOWER, SPACED, U64, mix, release, texts, words
from notewright.llm._shared import Scratch, join_keys, lean, tidy
from notewright.llm.components import components

#: Fingerprints that choose vantage points and radii; they don't decide what is found.
SAMPLE = 1 << 14
#: Fingerprints that have one leaf as their own, about; and rows of a leaf that meet in one task.
LEAF, CELL = 1 << 14, 1 << 19
#: Fields that fingerprints are dealt by, at most; bits of a bucket's number; rows of buckets that a task gets, about.
MOST_FIELDS, FOLD, ROWS = 8, 13, 1 << 16
#: Rows of a bucket that are compared with all others of it by shifts, together with other buckets; and by blocks.
FEW, SOME = 64, 1 << 12
#: Levels of the tree at most.
LEVELS = 16
#: Distances that are computed at once.
BLOCK = 1 << 20
#: Shingles whose bits are added at once.
PIECE = 1 << 16


def fingerprints(texts_: pa.Array, shingle: int = 4, seed: int = 42) -> Iterator[np.ndarray]:
    """The 64-bit fingerprints of chunks of texts, in order.  A text without words has 0."""
    for t in texts(texts_):
        w = words(t, SPACED)
        size = w.ends - w.starts
        begin = np.cumsum(size + 1) - size - 1
        joined = np.full(int(size.sum()) + len(size), 0x20, np.uint8)
        gaps = np.zeros(len(joined), bool)
        gaps[begin + size] = True
        joined[~gaps] = LOWER[t.data[SPACED[t.data]]]
        buffer, n = joined.tobytes(), w.counts
        of = np.maximum(n - shingle + 1, np.minimum(n, 1))  # shingles of each text
        row = np.repeat(np.arange(len(n)), of)
        first = w.first[:-1][row] + np.arange(len(row)) - (np.cumsum(of) - of)[row]
        last = first + np.minimum(n, shingle)[row] - 1
        ends = begin + size
        ones = np.zeros((len(n), 64), np.int64)
        for i in range(0, len(row), PIECE):
            at = slice(i, i + PIECE)
            h = np.array([xxhash.xxh64_intdigest(buffer[a:b], seed) for a, b in zip(begin[first[at]].tolist(), ends[last[at]].tolist(), strict=True)], U64)
            bit = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            here = row[at]
            edges = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1]]))
            ones[here[edges]] += np.add.reduceat(bit, edges, axis=0, dtype=np.int32)
        yield np.packbits(2 * ones > of[:, None], axis=1, bitorder="little").view("<u8").ravel()


def _spread(w: int) -> list[int]:
    """Masks of w separate fields that cover the 64 bits."""
    edges = [64 * i // w for i in range(w + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges[:-1], edges[1:], strict=True)]


class Tree:
    """A complete binary tree: node i has the children 2i + 1 (inside) and 2i + 2, its field is that of its level."""

    def __init__(self, sample: np.ndarray, levels: int) -> None:
        self.levels, self.masks = levels, np.array(_spread(max(1, levels)), U64)
        self.vantage, self.radius = np.zeros((1 << levels) - 1, U64), np.zeros((1 << levels) - 1, np.int64)
        node = np.zeros(len(sample), np.int64)
        for level in range(levels):
            order = np.argsort(node, kind="stable")
            edges = np.searchsorted(node[order], np.arange((1 << level) - 1, (2 << level)))
            for k, i in enumerate(range((1 << level) - 1, (2 << level) - 1)):
                self._choose(i, sample[order[edges[k] : edges[k + 1]]], self.masks[level])
            node = 2 * node + 1 + (self.distance(sample, node, level) > self.radius[node])

    def _choose(self, i: int, own: np.ndarray, mask: np.uint64) -> None:
        """Of a few fingerprints the one whose distances vary most, and the radius that halves them best."""
        if not len(own):
            return
        tries = own[:: max(1, len(own) // 8)][:8]
        d = np.bitwise_count((own[None, :] ^ tries[:, None]) & mask)
        best = int(d.var(axis=1).argmax())
        inside = np.cumsum(np.bincount(d[best], minlength=2))
        self.vantage[i], self.radius[i] = tries[best], int(np.abs(2 * inside[:-1] - len(own)).argmin())

    def distance(self, x: np.ndarray, node: np.ndarray, level: int) -> np.ndarray:
        return np.bitwise_count((x ^ self.vantage[node]) & self.masks[level]).astype(np.int64)

    def visits(self, x: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, leaf, own): each row's own leaf, and the leaves behind it that may hold what differs by `bits` at most."""
        row, node, left = np.arange(len(x)), np.zeros(len(x), np.int64), np.full(len(x), bits)
        own = np.ones(len(x), bool)
        for level in range(self.levels):
            d, r = self.distance(x[row], node, level), self.radius[node]
            outside = d > r
            cost = np.where(outside, d - r, r + 1 - d)
            over = np.flatnonzero((cost <= left) & ~(own & outside))  # the first crossing is outwards, to the leaves behind
            node = np.concatenate([2 * node + 1 + outside, 2 * node[over] + 2 - outside[over]])
            row, left = np.concatenate([row, row[over]]), np.concatenate([left, (left - cost)[over]])
            own = np.concatenate([own, np.zeros(len(over), bool)])
        return row, node - ((1 << self.levels) - 1), own


class _Groups:
    """Union-find over numbered rows; the smallest number is a group's root."""

    def __init__(self, n: int) -> None:
        self.parent = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.parent[x]
        while (self.parent[root] != root).any():
            root = self.parent[root]
        self.parent[x] = root
        return root

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        while True:
            x, y = self.find(a), self.find(b)
            differ = x != y
            if not differ.any():
                return
            a, b, x, y = a[differ], b[differ], x[differ], y[differ]
            np.minimum.at(self.parent, np.maximum(x, y), np.minimum(x, y))


def _compare(x: np.ndarray, rows: np.ndarray, others: np.ndarray, bits: int, groups: _Groups) -> None:
    """Joins every one of rows with those of others that differ from it by `bits` at most."""
    for i in range(0, len(others), BLOCK):
        part = others[i : i + BLOCK]
        step = max(1, BLOCK // len(part))
        for j in range(0, len(rows), step):
            a, b = np.nonzero(np.bitwise_count(x[rows[j : j + step], None] ^ x[part][None, :]) <= bits)
            if len(a):
                groups.join(rows[j + a], part[b])


def near(x: np.ndarray, own: np.ndarray, block: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars (member, centre) of the groups that pairs within `bits` make of different fingerprints.

    Only pairs count that have a leaf's own fingerprint on one side, and where there are two blocks one of each.
    Shells of the distances to vantage points on four fields prune: summed over the fields, the distances of a pair
    differ by no more than the pair does.
    """
    if not own.any():
        return x[:0], x[:0]
    masks = [U64(m) for m in _spread(4)]
    vantage = x[mix(x).argmin()]
    shell = np.stack([np.bitwise_count((x ^ vantage) & m) for m in masks], 1).astype(np.int64)
    code = shell @ np.array([17**3, 17**2, 17, 1])
    order = np.lexsort((x, code))
    x, own, block, code, groups = x[order], own[order], block[order], code[order], _Groups(len(x))
    starts = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    size = np.diff(np.append(starts, len(x)))
    shells = shell[order[starts]]
    two = block.min() != block.max()
    for g in np.unique(np.searchsorted(starts, np.flatnonzero(own), "right") - 1):
        rows = starts[g] + np.flatnonzero(own[starts[g] : starts[g] + size[g]])
        close = np.flatnonzero(np.abs(shells - shells[g]).sum(axis=1) <= bits)
        n = size[close]
        others = np.repeat(starts[close] - np.cumsum(n) + n, n) + np.arange(n.sum())
        # of two own fingerprints the one in the earlier shell has the pair; within a shell both do
        others = others[(others >= starts[g]) | ~own[others]]
        for b in np.unique(block[rows]) if two else (block[0],):
            mine, rest = (rows[block[rows] == b], others[block[others] != b]) if two else (rows, others)
            for _ in range(16):  # a member whose surroundings hold many joins these at once, and no pairs of theirs are left
                if len(mine) < 64:
                    break
                centre = mine[:1]
                hit = rest[np.bitwise_count(x[rest] ^ x[centre]) <= bits]
                groups.join(np.repeat(centre, len(hit)), hit)
                root = groups.find(centre)
                inside = groups.find(mine) == root
                _compare(x, mine[inside], rest[groups.find(rest) != root], bits, groups)
                mine = mine[~inside]
                if 2 * len(hit) < len(inside):
                    break
            if len(mine):
                _compare(x, mine, rest, bits, groups)
    root = groups.find(np.arange(len(x)))
    member = np.flatnonzero(root != np.arange(len(x)))
    return x[member], x[root[member]]


def dealt(x: np.ndarray, bits: int) -> np.ndarray:
    """The bucket of each fingerprint (row) in each of bits + 1 fields (column)."""
    masks = _spread(bits + 1)
    return np.stack([(U64(k) << U64(FOLD)) | (mix((x & U64(m)) + U64(1)) >> U64(64 - FOLD)) for k, m in enumerate(masks)], 1).astype(np.int64)


def stars_within(x: np.ndarray, starts: np.ndarray, block: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Stars of the groups that pairs within `bits` make in each cell; the rows of a cell are different, stand together and begin at starts."""
    groups, size = _Groups(len(x)), np.diff(np.append(starts, len(x)))
    left = np.repeat(starts + size, size) - np.arange(len(x))  # rows of the cell from this one on
    at = np.flatnonzero(np.repeat(size <= FEW, size))
    for d in range(1, FEW):
        at = at[left[at] > d]
        if not len(at):
            break
        hit = at[np.bitwise_count(x[at] ^ x[at + d]) <= bits]
        if len(hit):
            groups.join(hit, hit + d)
    a, b = [], []
    for i, n in zip(starts[size > FEW].tolist(), size[size > FEW].tolist(), strict=True):
        if n <= SOME:
            _compare(x, np.arange(i, i + n), np.arange(i, i + n), bits, groups)
        else:
            more = near(x[i : i + n], np.ones(n, bool), block[i : i + n], bits)
            a.append(more[0])
            b.append(more[1])
    root = groups.find(np.arange(len(x)))
    member = np.flatnonzero(root != np.arange(len(x)))
    return np.concatenate([x[member], *a]), np.concatenate([x[root[member]], *b])


def _links_by_fields(distinct: DataFrame, n: int, bits: int) -> DataFrame:
    """(a, b) as _links, by buckets of fields."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(x, bits + 1)), pa.array(dealt(x.view(U64), bits).ravel(), pa.int32())], names=["fp", "leaf"])

    visits = distinct.select("fp").mapInArrow(deal, "fp long, leaf int")
    # of a bucket with more rows than a task should hold, pairs of blocks meet
    large = visits.groupBy("leaf").count().where(F.col("count") > CELL).collect()  # there are (bits + 1) << FOLD buckets at most
    large = distinct.sparkSession.createDataFrame([(r["leaf"], -(-r["count"] // CELL)) for r in large], "leaf int, blocks int")
    placed = visits.join(F.broadcast(large), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    cells = placed.withColumn("cell", F.explode(meets)).select("leaf", "cell.i", "cell.j", "fp", "block")

    def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        place = np.stack([t.column(c).to_numpy() for c in ("leaf", "i", "j")], 1)
        starts = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]).any(1)]))
        a, b = stars_within(t.column("fp").to_numpy().view(U64), starts, t.column("block").to_numpy(), bits)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted; whole cells are compared, several at once."""
        held, size = [], 0
        for batch in batches:
            if size >= ROWS:
                # held rows end with the last cell that began before this batch's first change of cell
                place = np.stack([pa.concat_arrays([held[-1].column(c).slice(held[-1].num_rows - 1), batch.column(c)]).to_numpy() for c in ("leaf", "i", "j")], 1)
                change = np.flatnonzero((place[1:] != place[:-1]).any(1))
                if len(change):
                    yield found([*held, batch.slice(0, int(change[0]))])
                    batch, held, size = batch.slice(int(change[0])), [], 0
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
        if held:
            yield found(held)
        release()

    return cells.repartition(max(1, -(-(bits + 1) * n // ROWS)), "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(meet, "a long, b long")


def _links(distinct: DataFrame, n: int, bits: int) -> DataFrame:
    """(a, b) of fingerprints as long: what connects those that are within `bits` of each other."""
    spark = distinct.sparkSession
    if bits < MOST_FIELDS:
        return _links_by_fields(distinct, n, bits)
    sample = distinct.select("fp").orderBy(F.xxhash64("fp"), "fp").limit(SAMPLE).toArrow().column("fp").to_numpy().view(U64)
    tree = Tree(sample, min(LEVELS, max(0, int(np.ceil(np.log2(max(1, n / LEAF)))))))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column("fp").to_numpy().view(U64)
            for i in range(0, len(x), 4096):
                row, leaf, own = tree.visits(x[i : i + 4096], bits)
                yield pa.RecordBatch.from_arrays([pa.array(x[i + row].view(np.int64)), pa.array(leaf, pa.int32()), pa.array(own)], names=["fp", "leaf", "own"])

    visits = distinct.select("fp").mapInArrow(deal, "fp long, leaf int, own boolean")
    sizes = visits.groupBy("leaf").count().collect()  # a row a leaf
    # of a leaf with more rows than a task should hold, pairs of blocks meet
    blocks = spark.createDataFrame([(r["leaf"], -(-r["count"] // CELL)) for r in sizes], "leaf int, blocks int")
    placed = visits.join(F.broadcast(blocks), "leaf").withColumn("block", F.pmod(F.xxhash64("fp"), "blocks").cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    cells = placed.withColumn("cell", F.explode(meets)).select("leaf", "cell.i", "cell.j", "fp", "own", "block")

    def stars(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(held)
        a, b = near(t.column("fp").to_numpy().view(U64), t.column("own").to_numpy(), t.column("block").to_numpy(), bits)
        yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows come sorted; those of one cell are compared at once."""
        held: list[pa.RecordBatch] = []
        now = None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("leaf", "i", "j")], 1)
            edges = [0, *(np.flatnonzero((place[1:] != place[:-1]).any(1)) + 1), len(place)]
            for i, j in zip(edges[:-1], edges[1:], strict=True):
                if i == j:
                    continue
                if held and tuple(place[i]) != now:
                    yield from stars(held)
                    held = []
                now = tuple(place[i])
                held.append(batch.slice(i, j - i))
        if held:
            yield from stars(held)
        release()

    tasks = max(1, sum(b * (b + 1) // 2 for b in (-(-r["count"] // CELL) for r in sizes)))
    return cells.repartition(tasks, "leaf", "i", "j").sortWithinPartitions("leaf", "i", "j").mapInArrow(meet, "a long, b long")


def near_fingerprints(docs: DataFrame, bits: int = 4, shingle: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hexadecimal digits) and component_id of every row.

    Words are runs of anything but ASCII white space, ASCII letters in lower case; h are the XXH64 (seed 42) of all
    runs of `shingle` words joined by a blank, repeated ones each; a text of fewer words is one run.  A bit of
    the fingerprint is 1 where over half of h have it.  Fingerprints link where they differ by `bits` at most;
    component_id is the smallest doc_id that links reach.

    Null text, and text without words, has fingerprint 0 and links like any other.  A null doc_id stays null; a
    component of null ids only has a null one.  Rows with one doc_id count each.  Equal fingerprints are one before anything
    is compared.  Other columns don't matter.  Nothing is capped: the sample of SAMPLE fingerprints places the tree's
    boundaries only.  Empty table: no rows.
    """
    spark = docs.sparkSession
    lean(spark)
    scratch = Scratch(spark, "simhash")
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("_text"))

    def printed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for fp in fingerprints(batch.column("_text"), shingle):
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(fp)), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
                at += len(fp)
        release()

    kind = dict(base.dtypes)["doc_id"]
    rows = scratch.write(base.mapInArrow(printed, f"doc_id {kind}, fp long"), "rows")
    distinct = scratch.write(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    n = distinct.count()
    links = scratch.write(_links(distinct, n, bits), "links")  # a task for each cell
    groups = components(links, scratch).toDF("fp", "comp")
    # joins of written tables: Spark splits the rows of a large component over tasks
    named = scratch.write(distinct.join(groups, "fp", "left").select("fp", "least", F.coalesce("comp", "fp").alias("comp")), "named", n)
    tops = scratch.write(named.groupBy("comp").agg(F.min("least").alias("component_id")), "tops", n)
    place = scratch.write(named.join(tops, "comp").select("fp", "component_id"), "places", n)
    out = join_keys(rows, place, "fp", F.struct("doc_id", "fp"))
    result = scratch.last(out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"), "result")
    tidy(spark)
    return result
