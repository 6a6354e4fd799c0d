"""Substring search over stored trigrams: rare ones choose candidates, and only their buckets of texts are read and verified."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.sources.pointer import Pointer
from notewright.sources.shared import lean

#: Texts of a bucket, about.
BUCKET = 2000
#: Trigrams of a piece of a query that are looked up: its rarest.
RAREST = 3


#: Trigrams of texts that a task holds before it makes lists of them; characters of a text that are cut at once.
HELD, PIECE = 1 << 20, 1 << 20


def _cut(text: str) -> np.ndarray:
    """The different runs of three characters of a text, each as a number, in order."""
    found = [np.zeros(0, np.int64)]
    for i in range(0, len(text) - 2, PIECE):
        x = np.frombuffer(text[i : i + PIECE + 2].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        found.append(np.unique((x[:-2] << 42) | (x[1:-1] << 21) | x[2:]))
    return found[-1] if len(found) < 3 else np.unique(np.concatenate(found))


def lists(rows: DataFrame, text: str = "text") -> DataFrame:
    """(gram, n, ids): for the runs of three characters of texts in lower case the doc_ids of a stretch of rows that have them, each once."""
    lean(rows.sparkSession)
    low = rows.select("doc_id", F.lower(text).cast("binary").alias("low"))
    kind = dict(rows.dtypes)["doc_id"]

    def make(ids: pa.Array, held: list[np.ndarray]) -> pa.RecordBatch:
        key, row = np.concatenate(held), np.repeat(np.arange(len(held)), [len(h) for h in held])
        order = np.argsort(key, kind="stable")
        key = key[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        gram = key[begin]
        every = np.stack([gram >> 42, (gram >> 21) & 0x1FFFFF, gram & 0x1FFFFF], 1).astype("<u4").tobytes().decode("utf-32-le", "replace")
        edges = np.append(begin, len(key))
        names = pa.array([every[i : i + 3] for i in range(0, len(every), 3)], pa.string())
        return pa.RecordBatch.from_arrays([names, pa.array(np.diff(edges), pa.int64()), pa.ListArray.from_arrays(pa.array(edges, pa.int32()), ids.take(pa.array(row[order])))], names=["gram", "n", "ids"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, size = [], [], 0
        for batch in batches:
            at = 0
            for i, x in enumerate(batch.column("low")):
                held.append(_cut((x.as_py() or b"").decode("utf-8", "replace")))
                size += len(held[-1])
                if size >= HELD:
                    yield make(pa.concat_arrays([*ids, batch.column("doc_id").slice(at, i + 1 - at)]), held)
                    ids, held, size, at = [], [], 0, i + 1
            ids.append(batch.column("doc_id").slice(at))
        if size:
            yield make(pa.concat_arrays(ids), held)

    return low.mapInArrow(run, f"gram string, n long, ids array<{kind}>")


def grams_of(piece: str) -> list[str]:
    return sorted({piece[i : i + 3] for i in range(len(piece) - 2)})


class Trigrams:
    """The trigrams of a column of texts with lists of the texts that have them, sorted by trigram, how many texts each is in, and the texts by buckets of their ids.

    doc_id is unique and not null; rows of null doc_id are left out.  Folders never change; add() makes more of them, and a
    pointer names those that count.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.pointer = spark, root.rstrip("/"), Pointer(spark, root)

    @classmethod
    def build(cls, notes: DataFrame, root: str, text: str = "chunk_content") -> Trigrams:
        out = cls(notes.sparkSession, root)
        buckets = max(1, notes.count() // BUCKET)
        out._write(notes, {"text": text, "buckets": buckets, "folders": [], "n": 0, "kind": dict(notes.dtypes)["doc_id"]}, 0)
        return out

    def add(self, notes: DataFrame) -> None:
        """More texts; their doc_ids must be new."""
        after, state = self.pointer.read()
        self._write(notes, state, after)

    def _write(self, notes: DataFrame, state: dict[str, Any], after: int) -> None:
        folder = f"{self.root}/parts/{uuid.uuid4().hex}"
        rows = notes.where("doc_id is not null").select("doc_id", F.col(state["text"]).alias("text"))
        dealt = rows.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(state["buckets"])).cast("int"))
        dealt.hint("rebalance", F.col("bucket")).write.partitionBy("bucket").parquet(f"{folder}/texts")
        # by hashes: ranges would be drawn from a pass over all texts of its own
        lists(rows).hint("rebalance", F.col("gram")).sortWithinPartitions("gram").write.parquet(f"{folder}/grams")
        written = self.spark.read.parquet(f"{folder}/grams")
        written.groupBy("gram").agg(F.sum("n").alias("n")).sortWithinPartitions("gram").write.parquet(f"{folder}/counts")
        self.pointer.publish(state | {"folders": [*state["folders"], folder.rpartition("/")[2]]}, after)

    def _all(self, kind: str) -> DataFrame:
        _, state = self.pointer.read()
        return reduce(DataFrame.unionByName, (self.spark.read.parquet(f"{self.root}/parts/{f}/{kind}") for f in state["folders"]))

    def _rarest(self, pieces: list[str]) -> list[str] | None:
        """For each piece its rarest trigrams; None if one of them is in no text."""
        own = {p: grams_of(p) for p in pieces}
        asked = sorted({g for each in own.values() for g in each})
        counts = {r["gram"]: r["n"] for r in self._all("counts").where(F.col("gram").isin(asked)).groupBy("gram").agg(F.sum("n").alias("n")).collect()}  # those of the query
        if any(g not in counts for g in asked):
            return None
        return sorted({g for each in own.values() for g in sorted(each, key=lambda g: (counts[g], g))[:RAREST]})

    def candidates(self, pieces: list[str]) -> DataFrame | None:
        """(doc_id) of texts that have the rarest trigrams of every piece; None if there can't be any."""
        chosen = self._rarest(pieces)
        if chosen is None:
            return None
        has = self._all("grams").where(F.col("gram").isin(chosen)).select(F.explode("ids").alias("doc_id"))
        return has.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") == len(chosen)).select("doc_id")

    def having(self, pieces: list[str]) -> DataFrame:
        """(doc_id, text) of the texts that have every piece, literally, in any case.

        Pieces of under three characters have no trigrams: they are verified among what the others leave, and without
        others every text is read.
        """
        _, state = self.pointer.read()
        pieces = sorted({p.lower() for p in pieces if p})
        long = [p for p in pieces if len(p) > 2]
        verified = reduce(lambda a, b: a & b, (F.lower("text").contains(p) for p in pieces), F.lit(True))
        texts = self._all("texts").select("doc_id", "text", "bucket")
        if not long:
            return texts.where(verified & F.col("text").isNotNull()).select("doc_id", "text")
        found = self.candidates(long)
        if found is None:
            return texts.where(F.lit(False)).select("doc_id", "text")
        buckets = [r[0] for r in found.select(F.pmod(F.xxhash64("doc_id"), F.lit(state["buckets"])).cast("int")).distinct().collect()]  # at most the number of buckets
        return texts.where(F.col("bucket").isin(buckets)).join(found, "doc_id", "left_semi").where(verified).select("doc_id", "text")

    def like_all(self, query: str) -> DataFrame:
        """Texts with every white-space separated token of more than two characters; without such a token all that have text."""
        return self.having([w for w in query.split() if len(w) > 2])
