"""Shuffling many small records as few rows: columns of numbers packed by bucket, compressed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

SCHEMA = "p int, blob binary"
_ARROW = ["p", "blob"]


#: With more buckets the blobs of a task would hold a few records each.
MOST_BUCKETS = 1 << 20


def buckets(n_rows: int, each: int, least: int = 128) -> int:
    """A power of two that grows with the number of documents: a bucket is merged at once, one after another in a task."""
    out = least
    while out < n_rows // each and out < MOST_BUCKETS:
        out *= 2
    return out


def dealt(sent: DataFrame, n: int, few: int = 4) -> DataFrame:
    """(p, blob) rows of n buckets: a few buckets for a task, one after another, so that it holds one at a time, and tasks are as large whatever the number of rows."""
    return sent.repartition(max(1, n // few), "p").sortWithinPartitions("p")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[list[np.ndarray]]]]:
    """Each bucket with its unpacked blobs, of rows in the order of dealt()."""
    now, held = None, []
    for batch in batches:
        for p, blob in zip(batch.column("p").to_pylist(), batch.column("blob"), strict=True):
            if p != now and held:
                yield now, held
                held = []
            now = p
            held.append(unpack(blob.as_py()))
    if held:
        yield now, held


def pack(columns: list[np.ndarray]) -> bytes:
    head = np.array([len(columns), *(len(c) for c in columns)], np.int64).tobytes()
    kinds = "".join(c.dtype.str.ljust(4) for c in columns).encode()
    return zstandard.ZstdCompressor(level=1).compress(head + kinds + b"".join(np.ascontiguousarray(c).tobytes() for c in columns))


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n = int(np.frombuffer(raw, np.int64, 1)[0])
    sizes = np.frombuffer(raw, np.int64, n, 8)
    at = 8 * (n + 1) + 4 * n
    out = []
    for i, size in enumerate(sizes):
        kind = np.dtype(raw[8 * (n + 1) + 4 * i : 8 * (n + 1) + 4 * i + 4].decode().strip())
        out.append(np.frombuffer(raw, kind, int(size), at))
        at += int(size) * kind.itemsize
    return out


def small(x: np.ndarray) -> np.ndarray:
    """In the smallest unsigned type that holds it."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending 32-bit numbers as the bytes of their differences, all highest ones last: these are nearly all zero, and pack well."""
    return np.ascontiguousarray(np.diff(x, prepend=x[:1] * 0).astype("<u4").view(np.uint8).reshape(-1, 4).T).ravel()


def summed(x: np.ndarray) -> np.ndarray:
    """The numbers that steps() was given."""
    return np.cumsum(np.ascontiguousarray(x.reshape(4, -1).T).view("<u4").ravel(), dtype=np.uint32)


def rows(p: list[int], blobs: list[bytes], at_once: int = 256) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(p), at_once):
        yield pa.RecordBatch.from_arrays([pa.array(p[i : i + at_once], pa.int32()), pa.array(blobs[i : i + at_once], pa.binary())], names=_ARROW)
