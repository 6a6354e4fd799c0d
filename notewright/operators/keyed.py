"""Tables whose updates rewrite only the buckets of changed keys, and count wholly or not at all."""

from __future__ import annotations

import json
import uuid
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from notewright.sources.pointer import Pointer

_BUCKET = "_nw_bucket"


def _same(a: DataFrame, b: DataFrame, key: list[str]) -> Column:
    return reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in key))


class KeyedTable:
    """Rows dealt to buckets by a hash of their key; a bucket is a folder of Parquet files, and a pointer says which folders count.

    A key may have many rows: they change together.  Null parts of a key are values like others.  Each write reads and
    writes the buckets that its keys fall into, in new folders, and then publishes them in one step; a write that dies
    before that step leaves the rows as they were.  A bucket of many rows is cut into several files.  Two writers that
    start from one state don't mix: the second gets Conflict and may try again.  What no state names any more
    stands until vacuum().
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root, self.pointer = spark, root.rstrip("/"), Pointer(spark, root)

    @classmethod
    def create(cls, df: DataFrame, root: str, key: list[str], buckets: int = 64) -> KeyedTable:
        """A new table of the rows of df; there must be none at root."""
        out = cls(df.sparkSession, root)
        state = {"key": key, "buckets": buckets, "schema": df.schema.json(), "folders": {}, "marks": {}}
        out._write(df, state, 0, range(buckets))
        return out

    # reading

    def _frame(self, state: dict[str, Any], buckets: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(state["schema"]))
        chosen = [f"{self.root}/data/{folder}/{_BUCKET}={b}" for b, folder in sorted(state["folders"].items()) if buckets is None or int(b) in buckets]
        if not chosen:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*chosen)

    def _state(self) -> tuple[int, dict[str, Any]]:
        n, state = self.pointer.read()
        if not n:
            raise ValueError(f"there is no table at {self.root}")
        return n, state

    def read(self) -> DataFrame:
        """The rows of the latest state; later writes don't change what this frame reads, until a vacuum."""
        return self._frame(self._state()[1])

    def lookup(self, keys: DataFrame) -> DataFrame:
        """The rows of some keys; only the buckets that can have them are read."""
        _, state = self._state()
        rows = self._frame(state, self._buckets(keys, state))
        return rows.join(keys.select(*state["key"]).distinct().alias("k"), _same(rows, keys, state["key"]), "left_semi")

    def mark(self, name: str) -> int | None:
        """The number that was published last under a name, in one step with the rows of its write."""
        return self._state()[1]["marks"].get(name)

    # writing

    def _numbered(self, df: DataFrame, state: dict[str, Any]) -> DataFrame:
        # the text of a key, so that its hash doesn't depend on the kind of number it has here
        parts = [F.coalesce(F.concat(F.lit("v"), df[c].cast("string")), F.lit("n")) for c in state["key"]]
        return df.withColumn(_BUCKET, F.pmod(F.xxhash64(*parts), F.lit(state["buckets"])).cast("int"))

    def _buckets(self, keys: DataFrame, state: dict[str, Any]) -> list[int]:
        return [r[0] for r in self._numbered(keys, state).select(_BUCKET).distinct().collect()]  # at most the number of buckets

    def _write(self, df: DataFrame, state: dict[str, Any], after: int, touched: Any, mark: tuple[str, int] | None = None) -> int:
        """Writes the rows of the touched buckets and publishes them."""
        names = StructType.fromJson(json.loads(state["schema"])).names
        folder, touched = uuid.uuid4().hex, {int(b) for b in touched}
        dealt = self._numbered(df.select(*names), state)
        dealt.hint("rebalance", F.col(_BUCKET)).write.partitionBy(_BUCKET).parquet(f"{self.root}/data/{folder}")
        have = {int(n.split("=")[1]) for n in self.pointer.names(f"data/{folder}") if n.startswith(_BUCKET)}
        folders = {b: f for b, f in state["folders"].items() if int(b) not in touched} | {str(b): folder for b in have}
        marks = state["marks"] | ({mark[0]: mark[1]} if mark else {})
        return self.pointer.publish(state | {"folders": folders, "marks": marks}, after)

    def _change(self, keys: DataFrame, rows: DataFrame | None, mark: tuple[str, int] | None) -> int:
        after, state = self._state()
        if mark and state["marks"].get(mark[0], -1) >= mark[1]:
            return after
        touched = self._buckets(keys, state)
        old = self._frame(state, touched)
        stay = old.join(keys.select(*state["key"]).distinct(), _same(old, keys, state["key"]), "left_anti")
        return self._write(stay if rows is None else stay.unionByName(rows.select(*stay.columns)), state, after, touched, mark)

    def upsert(self, rows: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """Puts rows in the place of all rows with their keys; returns the state's number.

        mark: a name and a number that are published with the rows; a write whose number isn't above the published one
        does nothing, so that a repeated batch counts once.
        """
        return self._change(rows, rows, mark)

    def upsert_keys(self, keys: DataFrame, rows: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """Puts rows in the place of all rows with these keys, which the keys of rows are among; a key without a row loses what it had."""
        return self._change(keys, rows, mark)

    def delete(self, keys: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """Removes all rows with these keys."""
        return self._change(keys, None, mark)

    def append(self, rows: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """Adds rows to what their keys have."""
        after, state = self._state()
        if mark and state["marks"].get(mark[0], -1) >= mark[1]:
            return after
        touched = self._buckets(rows, state)
        old = self._frame(state, touched)
        return self._write(old.unionByName(rows.select(*old.columns)), state, after, touched, mark)

    def replace(self, df: DataFrame, mark: tuple[str, int] | None = None) -> int:
        """Puts df, which may read this table and may have other columns, in the place of all rows."""
        after, state = self._state()
        return self._write(df, state | {"schema": df.schema.json()}, after, range(state["buckets"]), mark)

    def vacuum(self) -> int:
        """Deletes folders that the latest state doesn't name, those of died writes among them; returns how many.  Not while others write."""
        return self.pointer.keep_only("data", set(self._state()[1]["folders"].values()))
