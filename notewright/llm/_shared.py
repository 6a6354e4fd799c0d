"""Session settings that the operators need, and their tables in the shared folder."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notewright.sources.shared import Scratch, delete, exists, lean, shared_dir

#: Tables of one row for each key are broadcast up to so many rows (of a few numbers); larger ones are joined by salted keys.
BROADCAST_KEYS = 200_000
#: Places that a key's rows are dealt to where its table is too large to broadcast.
SALTS = 16


def tidy(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that nothing refers to any more, which otherwise waits for the driver's next garbage collection."""
    spark.sparkContext._jvm.System.gc()


def join_keys(rows: DataFrame, keys: DataFrame, key: str, spread: Column, how: str = "inner") -> DataFrame:
    """rows joined with a written table that has one row for each key, so that no task gets all rows of a hot key.

    By a broadcast of the table if its count allows it; else each key goes to SALTS places, and spread deals its rows
    to them.  The result is the same.
    """
    if keys.count() <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keys), key, how)
    each = keys.withColumn("_nw_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_nw_salt", F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).join(each, [key, "_nw_salt"], how).drop("_nw_salt")


def bit_filter(ids: DataFrame, column: str, most_bits: int = 26) -> np.ndarray | None:
    """Bits set at the lowest bits of 64-bit hashes, at most 2**most_bits of them; None for so many that most bits would be set."""
    count = ids.count()
    bits = 1 << min(most_bits, max(16, (16 * count).bit_length()))
    if 4 * count > bits:
        return None
    place = F.col(column).bitwiseAND(F.lit(bits - 1))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63)).cast("int"))
    words = ids.groupBy(F.shiftrightunsigned(place, 6).alias("w")).agg(F.bit_or(bit).alias("x")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[words.column("w").to_numpy()] = words.column("x").to_numpy()
    return np.unpackbits(out.view(np.uint8), bitorder="little").astype(bool)


def in_filter(have: np.ndarray | None, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash may be among those of the filter."""
    if have is None:
        return np.ones(len(hashes), bool)
    return have[(hashes.view(np.uint64) & np.uint64(len(have) - 1)).astype(np.int64)]


__all__ = ["Scratch", "bit_filter", "delete", "exists", "in_filter", "join_keys", "lean", "shared_dir", "tidy"]
