"""Chunking of note texts: paragraphs or sentences packed to a token limit, with overlap; a sequential fold, so an Arrow UDF."""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notewright.sources.shared import lean

CHUNK, OVERLAP = 400, 50

Count = Callable[[str], int]


def estimate(text: str) -> int:
    return math.ceil(len(text) / 4)


def tail_words(chunk: str, overlap: int) -> str:
    """The last words of a chunk, half as many as overlap tokens."""
    if not chunk or overlap <= 0:
        return ""
    return " ".join(re.split(r"\s+", chunk)[-max(1, overlap // 2) :])


def windows(text: str, limit: int = CHUNK, overlap: int = OVERLAP) -> list[str]:
    """Windows of characters with overlap, for a segment without natural breaks.

    A window ends at its last blank or line break only if that lies more than 70 % of a window behind the place where
    the window begins in the text, as in the original; past the first windows it is cut at full size.
    """
    size, back = 4 * limit, 4 * overlap
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while start < len(text):
        end = min(start + size, len(text))
        part = text[start:end]
        if end < len(text) and (cut := max(part.rfind(" "), part.rfind("\n"))) > start + size * 0.7:
            part, end = part[:cut], start + cut + 1
        if part.strip():
            out.append(part.strip())
        if end >= len(text):
            break
        start = max(end - back, 0)
    return out or [text[:size]]


def pack(segments: list[str], limit: int, overlap: int, count: Count) -> list[str]:
    """Segments joined up to the limit; the next chunk begins with the tail of the last; a segment beyond the limit is cut in windows."""
    out: list[str] = []
    held, size = "", 0
    for segment in segments:
        own = count(segment)
        if held and size + own > limit:
            out.append(held.strip())
            tail = tail_words(held, overlap)
            held = f"{tail}\n\n{segment}" if tail else segment
            size = count(held)
        else:
            held = f"{held}\n\n{segment}" if held else segment
            size += own
        if own > limit:
            out += windows(segment, limit, overlap)
            held, size = "", 0
    if held.strip():
        out.append(held.strip())
    return out or ["\n\n".join(segments)]


def chunks(text: str | None, limit: int = CHUNK, overlap: int = OVERLAP, count: Count = estimate) -> list[str]:
    """A blank text is one empty chunk, a short one is itself; else paragraphs, or sentences if there is but one paragraph."""
    if not text or not text.strip():
        return [""]
    if len(text) / 4 <= limit and count(text) <= limit:
        return [text]
    segments = [p for p in re.split(r"\n\s*\n", text) if p.strip()]
    if len(segments) == 1:
        segments = [s for s in re.split(r"(?<=[.!?])\s+", text) if s.strip()]
    return pack(segments, limit, overlap, count)


def chunk_column(text: Column, limit: int = CHUNK, overlap: int = OVERLAP, count: Count = estimate) -> Column:
    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: chunks(t, limit, overlap, count))

    return cut(text)


def chunk_notes(notes: DataFrame, text: str = "text", **options) -> DataFrame:  # noqa: ANN003
    """A row for each chunk, with chunk_index and total_chunks."""
    lean(notes.sparkSession)
    cut = notes.withColumn("_chunks", chunk_column(F.col(text), **options))
    return cut.select(*notes.columns, F.size("_chunks").alias("total_chunks"), F.posexplode("_chunks").alias("chunk_index", "chunk_content"))


def window_rows(notes: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, place, chunk) of the windows of texts without natural breaks; a null text has none."""
    lean(notes.sparkSession)

    @F.pandas_udf("array<string>")
    def cut(x: pd.Series) -> pd.Series:
        return x.map(windows, na_action="ignore")

    return notes.select("doc_id", F.posexplode(cut(text)).alias("place", "chunk"))
