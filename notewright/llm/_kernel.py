"""Vectorised text kernels over the UTF-8 bytes of Arrow string columns.

Every delimiter class used by the operators is ASCII, and all bytes of a multi-byte character are >= 0x80, so
splitting bytes is splitting characters.  Hashes are 64-bit; every decision that must be exact is verified by its
operator on the words themselves or rests on sets of 64-bit hashes, as its docstring says.
"""

from __future__ import annotations

import contextlib
import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes of text handled at once; a longer document is a chunk of its own.
CHUNK = 1 << 19

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=U64) * U64(2) + U64(1)
_P = U64(0x9E3779B97F4A7C15)
_P_INV = U64(pow(int(_P), -1, 2**64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        size = max(n, 1 << 16, 2 * len(have) if have is not None else 0)
        have = np.full(size, base, U64)
        have[0] = 1
        have = np.cumprod(have, dtype=U64)
        _powers[int(base)] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def release() -> None:
    """Gives freed memory back to the system, as Python workers are kept for other tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def table(chars: str) -> np.ndarray:
    """A lookup table that is true at these single-byte characters."""
    out = np.zeros(256, bool)
    out[[ord(c) for c in chars]] = True
    return out


#: Words are runs of anything but ASCII white space.
SPACED = ~table(" \t\n\x0b\x0c\r")
#: Words are runs of digits, ASCII letters and everything beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


@dataclass
class Texts:
    """Rows lo..hi of a batch: their bytes one after another, and where each begins; offsets has one entry more."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray


def texts(column: pa.Array, budget: int = CHUNK) -> Iterator[Texts]:
    """Chunks of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + budget, "right")) - 1)
        yield Texts(lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


@dataclass
class Words:
    """starts, ends: of each word in the bytes; doc: its row in the chunk; first: each row's first word, with one entry more."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def words(t: Texts, inside: np.ndarray) -> Words:
    n, rows = len(t.data), len(t.offsets) - 1
    flag = np.empty(n + 1, bool)
    flag[:n] = inside[t.data]
    flag[n] = False
    before = np.empty(n, bool)
    before[1:] = flag[: n - 1] if n else False
    if n:
        before[0] = False
        before[t.offsets[:-1][t.offsets[:-1] < n]] = False
    starts = np.flatnonzero(flag[:n] & ~before)
    after = flag[1:].copy()
    edges = t.offsets[1:][t.offsets[1:] > 0] - 1
    after[edges] = False
    ends = np.flatnonzero(flag[:n] & ~after) + 1
    first = np.searchsorted(starts, t.offsets)
    return Words(starts, ends, np.repeat(np.arange(rows), np.diff(first)), first)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, by prefix sums of a polynomial with odd base modulo 2**64."""
    n = len(data)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(_BYTE[data] * _power(_P, n), out=prefix[1:])
    h = (prefix[ends] - prefix[starts]) * _power(_P_INV, n + 1)[starts]
    return mix(h + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def run_hashes(h: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run h[start:end] of hashes; the order counts."""
    n = len(h)
    prefix = np.zeros(n + 1, U64)
    np.cumsum(mix(h) * _power(_P, n), out=prefix[1:])
    out = (prefix[ends] - prefix[starts]) * _power(_P_INV, n + 1)[starts]
    return mix(out ^ (ends - starts).astype(U64))


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The first words of all windows of k words within a row, and their rows."""
    ok = np.arange(len(w.starts)) + k <= w.first[1:][w.doc]
    at = np.flatnonzero(ok)
    return at, w.doc[at]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Of values between successive offsets."""
    prefix = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=prefix[1:])
    return np.diff(prefix[offsets])
