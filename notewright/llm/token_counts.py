"""Token counts by section: each document is encoded once, as a whole, and tokens are attributed by their spans."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notewright.llm._kernel import Texts, texts
from notewright.llm._shared import lean
from notewright.llm.substring_dedup import sentences

#: Fixed value: the pattern that goes with the byte-level vocabulary.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Larger vocabularies are refused: they are broadcast.
MOST_RANKS = 1_000_000
#: A longer text is encoded in pieces of about so many characters, with the same tokens: see pieces().
PIECE = 1 << 16
RULES = ("start", "largest", "share")

_encoders: dict[int, tuple] = {}


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    if len(ranks) > MOST_RANKS:
        raise ValueError(f"{len(ranks)} ranks: a vocabulary is broadcast and may have {MOST_RANKS}")
    return ranks


def encoder(ranks: dict[bytes, int], pattern: str = PATTERN):  # noqa: ANN201
    """The encoder, and the length in bytes of each token."""
    import tiktoken

    key = id(ranks)
    if key not in _encoders:
        lengths = np.zeros(max(ranks.values(), default=0) + 1, np.int64)
        for token, rank in ranks.items():
            lengths[rank] = len(token)
        _encoders[key] = (tiktoken.Encoding("notewright", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), lengths, ranks)
    return _encoders[key][:2]


def pieces(text: str) -> Iterator[str]:
    """The text in parts, cut only before the first or the last white space of a run of it that something else follows.

    The pattern always begins a new word there, so the parts' tokens are those of the whole.  A part ends at the last
    such place within PIECE characters; a stretch that has none goes on to the next one, or to the end of the text.
    As a long run of white space ends a part, the pattern need not go back over it, which exhausts its stack.
    """
    at = 0
    while len(text) - at > PIECE:
        cut = at + PIECE
        while cut > at and not _safe(text, cut):
            cut -= 1
        if cut == at:
            cut = at + PIECE + 1
            while cut < len(text) and not _safe(text, cut):
                cut += 1
        yield text[at:cut]
        at = cut
    if at < len(text) or not text:
        yield text[at:]


def _safe(text: str, cut: int) -> bool:
    return _space(text[cut]) and (not _space(text[cut - 1]) or (cut + 1 < len(text) and not _space(text[cut + 1])))


def _space(c: str) -> bool:
    r"""As the pattern's \s, which unlike isspace() leaves out four separators of ASCII."""
    return c.isspace() and c not in "\x1c\x1d\x1e\x1f"


def token_ends(t: Texts, encode, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:  # noqa: ANN001
    """The byte where each token of the chunk ends; each row's first token, with one entry more."""
    ids, first = [], [0]
    data = t.data.tobytes()
    for a, b in zip(t.offsets[:-1], t.offsets[1:], strict=True):
        n = 0
        for piece in pieces(data[a:b].decode()):
            got = encode(piece)
            ids.append(np.array(got, np.int64))
            n += len(got)
        first.append(first[-1] + n)
    return np.cumsum(lengths[np.concatenate(ids)]) if ids else np.zeros(0, np.int64), np.array(first)


def line_sections(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines, each with its line break: begin, end (bytes), and each row's first, with one entry more."""
    newline = np.flatnonzero(t.data == 10) + 1
    edges = np.union1d(t.offsets, newline)
    begin, end = edges[:-1], edges[1:]
    return begin, end, np.searchsorted(begin, t.offsets)


def sentence_sections(t: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentences, each with the white space behind it: begin, end (bytes), and each row's first, with one entry more."""
    s = sentences(t)
    last = np.zeros(len(s.begin), bool)
    last[s.first[1:][np.diff(s.first) > 0] - 1] = True
    row = np.repeat(np.arange(len(s.first) - 1), np.diff(s.first))
    return s.begin, np.where(last, t.offsets[1:][row], np.append(s.begin[1:], 0)), s.first


SPLITTERS = {"lines": line_sections, "sentences": sentence_sections}


def given_sections(t: Texts, rows: list[list[dict] | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sections given by start and end in code points, in order; what overlaps an earlier one or ends before it begins is cut off."""
    chars = np.flatnonzero((t.data & 0xC0) != 0x80)
    first_char = np.searchsorted(chars, t.offsets)
    begin, end, first = [], [], [0]
    for r, sections in enumerate(rows):
        here = np.append(chars[first_char[r] : first_char[r + 1]], t.offsets[r + 1])
        last = t.offsets[r]
        for s in sections or []:
            a, b = (int(here[min(max(0, s[k] or 0), len(here) - 1)]) for k in ("start", "end"))
            a = max(a, last)
            b = max(a, b)
            begin.append(a)
            end.append(b)
            last = b
        first.append(len(begin))
    return np.array(begin, np.int64), np.array(end, np.int64), np.array(first)


def attribute(ends: np.ndarray, begin: np.ndarray, end: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of each section; whether each token lies in more than one section or partly in none; whether in none.

    start: a token counts for the section with its first byte, in a gap for none.  largest: for the one with most of
    its bytes, of equals the first.  share: for each by its share of the token's bytes.
    """
    if rule not in RULES:
        raise ValueError(rule)
    starts = np.concatenate([[0], ends[:-1]])
    n = len(begin)
    real = np.flatnonzero(end > begin)  # an empty section gets nothing
    b, e = begin[real], end[real]
    low = np.searchsorted(e, starts, "right")
    high = np.searchsorted(b, ends, "left") - 1
    some = (low <= high) & (ends > starts)
    total = np.zeros(n)
    lone = np.zeros(len(ends), bool)
    k = np.where(some, low, 0)
    if len(real):
        lone = some & (low == high) & (b[k] <= starts) & (ends <= e[k])
        total[real] += np.bincount(low[lone], minlength=len(real))
    two = np.flatnonzero(some & ~lone & (high == low + 1))
    if len(two):
        j = low[two]
        parts = np.stack([e[j] - np.maximum(b[j], starts[two]), np.minimum(e[j + 1], ends[two]) - b[j + 1]])
        if rule == "share":
            for x in (0, 1):
                total[real] += np.bincount(j + x, weights=parts[x] / (ends[two] - starts[two]), minlength=len(real))
        elif rule == "largest":
            total[real] += np.bincount(j + (parts[1] > parts[0]), minlength=len(real))
        else:
            total[real] += np.bincount(j[b[j] <= starts[two]], minlength=len(real))
    for i in np.flatnonzero(some & ~lone & (high != low + 1)):
        j = np.arange(low[i], high[i] + 1)
        part = np.minimum(e[j], ends[i]) - np.maximum(b[j], starts[i])
        if rule == "share":
            total[real[j]] += part / (ends[i] - starts[i])
        elif rule == "largest":
            total[real[j[part.argmax()]]] += 1
        elif b[j[0]] <= starts[i]:
            total[real[j[0]]] += 1
    return total, some & ~lone, ~some


def count_tokens(
    docs: DataFrame, path: str = VOCABULARY, pattern: str = PATTERN, rule: str = "largest", sections: str | None = None, by: str = "lines", doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """doc_id, n_tokens, n_crossing, n_outside and section_tokens (an array in the sections' order) of each row.

    sections: a column of array<struct<start, end>> in code points; without it, a document's lines or sentences (by).  rule: see
    attribute().  The vocabulary is read on the driver and broadcast; texts are not shuffled.

    Null or empty text: no tokens, and no sections of its own making; given ones get 0.  Null sections: none.
    Repeated rows are counted each.
    """
    lean(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((read_ranks(path), pattern))
    base = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), *([F.col(sections).alias("sections")] if sections else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, lengths = encoder(*shared.value)
        for batch in batches:
            for t in texts(batch.column("text")):
                part = batch.slice(t.lo, t.hi - t.lo)
                ends, first = token_ends(t, encoding.encode_ordinary, lengths)
                begin, end, own = given_sections(t, part.column("sections").to_pylist()) if sections else SPLITTERS[by](t)
                total, crossing, outside = attribute(ends, begin, end, rule)
                per = [np.diff(np.concatenate([[0], np.cumsum(x)])[first]) for x in (crossing, outside)]
                lists = pa.ListArray.from_arrays(pa.array(own, pa.int32()), pa.array(total, pa.float64()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(first), pa.int64()), *(pa.array(x, pa.int64()) for x in per), lists], names=["doc_id", "n_tokens", "n_crossing", "n_outside", "section_tokens"])

    return base.mapInArrow(run, f"doc_id {dict(base.dtypes)['doc_id']}, n_tokens long, n_crossing long, n_outside long, section_tokens array<double>")


def digest(counted: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_crossing, the number of sections and their tokens as whole numbers."""
    return counted.select("doc_id", "n_tokens", "n_crossing", F.size("section_tokens").cast("long").alias("n_sections"), F.transform("section_tokens", lambda x: x.cast("long")).alias("section_tokens"))
