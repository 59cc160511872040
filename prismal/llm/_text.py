"""Vectorised helpers that run inside Spark tasks: word spans and word hashes over UTF-8 bytes.

All functions work on one block of documents at a time; a block holds a bounded number of
bytes (a longer single document is a block of its own), so memory does not follow the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: dict[str, np.ndarray] = {}


def _power(kind: str, n: int) -> np.ndarray:
    """Powers of the base (or of its inverse modulo 2**64), grown on demand."""
    have = _powers.get(kind)
    if have is None or len(have) < n:
        size = max(n, 1 << 16)
        step = np.full(size, _BASE if kind == "up" else _INVERSE, dtype=np.uint64)
        step[0] = 1
        have = _powers[kind] = np.multiply.accumulate(step)
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit depends on every input bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_table(separator) -> np.ndarray:
    """A 256-entry boolean table: True where the byte belongs to a word."""
    return np.array([not separator(b) for b in range(256)], dtype=bool)


#: Word bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z (UTF-8 bytes over 0x7F are letters).
ALNUM = byte_table(lambda b: not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128))
#: Word bytes of `[^\x20\x09-\x0D]+`.
NONSPACE = byte_table(lambda b: b == 32 or 9 <= b <= 13)
LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], dtype=np.uint8)


def column_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets; null counts as empty."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.fill_null("") if column.null_count else column
    column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    raw = column.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of a batch with at most `limit` bytes of text (or one row), with their bytes and offsets."""
    data, offsets = column_bytes(batch.column(column))
    at, n = 0, len(batch)
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1
        to = min(n, max(at + 1, to))
        yield batch.slice(at, to - at), data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


class Words:
    """Spans and hashes of the words in a block of documents.

    start, end: byte spans; hash: 64-bit hash of the lower-cased word; bound: n + 1 word offsets
    by document; doc: the document of each word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, inside: np.ndarray, lower: bool = True):
        n = len(data)
        mask = inside[data]
        before = np.empty(n, dtype=bool)
        after = np.empty(n, dtype=bool)
        if n:
            before[0], before[1:] = False, mask[:-1]
            after[-1], after[:-1] = False, mask[1:]
            cuts = offsets[1:-1]
            before[cuts[cuts < n]] = False
            after[cuts[cuts > 0] - 1] = False
        self.start = np.flatnonzero(mask & ~before)
        self.end = np.flatnonzero(mask & ~after) + 1
        value = (LOWER[data] if lower else data).astype(np.uint64)
        value += np.uint64(1)
        value *= _power("up", n)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        h = (total[self.end] - total[self.start]) * _power("down", n)[self.start] if n else np.zeros(0, np.uint64)
        self.hash = mix(h + (self.end - self.start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        self.bound = np.searchsorted(self.start, offsets)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bound) - 1), np.diff(self.bound))


def window_hashes(words: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words, by its first word; documents' borders are the caller's."""
    n = len(words)
    if n < width:
        return np.zeros(0, np.uint64)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _power("up", n), dtype=np.uint64)])
    h = (total[width:] - total[:-width]) * _power("down", n)[: n - width + 1]
    return mix(h + np.uint64(width * 0xA0761D6478BD642F % (1 << 64)))


def hashable(df) -> list[str]:
    """The columns of a DataFrame that Spark's hashes take: those without a map or a variant in them."""
    return [f.name for f in df.schema.fields if not any(kind in f.dataType.simpleString() for kind in ("map<", "variant"))]
