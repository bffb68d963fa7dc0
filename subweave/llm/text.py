"""Vectorised text primitives over Arrow string columns.

Words are runs of bytes other than space and \\x09-\\x0D, so UTF-8 never has to be decoded. Hashes of words are 64 bits:
eight bytes at a time, each step followed by a full avalanche.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

SPACES = b" \t\n\x0b\x0c\r"
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[list(SPACES)] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: Masks of the lowest 0 to 8 bytes of an integer.
LOW_BYTES = np.array([(1 << (8 * i)) - 1 for i in range(9)], dtype=np.uint64)
_MUL_A, _MUL_B = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_32 = np.uint64(32)
#: Words longer than this are hashed one by one.
_LONG_WORD = 512
#: Bytes of text that are worked on at once.
SLICE_BYTES = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _32)) * _MUL_A
    h = (h ^ (h >> _32)) * _MUL_B
    return h ^ (h >> _32)


class Texts:
    """Some rows of a string column as one byte array with offsets; a null text is empty."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets = data, offsets

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lower(self) -> Texts:
        """With A-Z in lower case."""
        return Texts(_LOWER[self.data], self.offsets)

    def row(self, i: int) -> bytes:
        return self.data[self.offsets[i] : self.offsets[i + 1]].tobytes()

    def count(self, flags: np.ndarray) -> np.ndarray:
        """For each row, how many of its bytes have the flag."""
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def words(self, spaces: np.ndarray = _IS_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and for each row the index of its first word (one entry more than rows).

        spaces flags the bytes that are not of words.
        """
        n = len(self.data)
        if not n:
            none = np.zeros(0, np.int64)
            return none, none, np.zeros(len(self) + 1, np.int64)
        space, edge = spaces[self.data], np.zeros(n + 1, bool)
        edge[self.offsets] = True
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        starts = np.flatnonzero(~space & (before | edge[:n]))
        ends = np.flatnonzero(~space & (after | edge[1:])) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of each byte range."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.data) + 1,), "<u8", padded, 0, (1,))
        length = ends - starts
        out = mix((eight[starts] & LOW_BYTES[np.minimum(length, 8)]) ^ (length.astype(np.uint64) * _STEP))
        at, more = 8, np.flatnonzero((length > 8) & (length <= _LONG_WORD))
        while len(more):
            block = eight[starts[more] + at] & LOW_BYTES[np.minimum(length[more] - at, 8)]
            out[more] = mix(out[more] * _STEP + block)
            at += 8
            more = more[length[more] > at]
        for i in np.flatnonzero(length > _LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.data[starts[i] : ends[i]].tobytes())
        return out


def chained(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each window of size consecutive word hashes."""
    if len(words) < size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    out = words[:n].copy()
    for k in range(1, size):
        out = out * _STEP + words[k : n + k]
    return mix(out)


def texts(column: pa.Array) -> Texts:
    column = column.cast(pa.large_binary()) if pa.types.is_binary(column.type) else column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_large_binary(column.type) else "")
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    blob = column.buffers()[2]
    data = np.frombuffer(blob, np.uint8) if blob is not None else np.zeros(0, np.uint8)
    return Texts(data[offsets[0] : offsets[-1]], offsets - offsets[0])


def sliced(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[tuple[pa.RecordBatch, Texts]]:
    """The batch in runs of rows of about limit bytes of text; a longer text is a run of its own."""
    whole = texts(batch.column(column))
    at = 0
    while at < len(whole):
        to = max(at + 1, int(np.searchsorted(whole.offsets, whole.offsets[at] + limit, "right")) - 1)
        lo, hi = whole.offsets[at], whole.offsets[to]
        yield batch.slice(at, to - at), Texts(whole.data[lo:hi], whole.offsets[at : to + 1] - lo)
        at = to
