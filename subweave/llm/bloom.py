"""Bloom filters of a fixed largest size, merged from sorted bit positions one stretch at a time.

No task and no worker holds more than one stretch while filters are merged; the driver and the tasks that ask hold one filter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bits of a filter at most (32 MB), and bits of one stretch of it.
MOST_BITS, STRETCH = 1 << 28, 1 << 20


def size_for(items: int, per_item: int, most: int = MOST_BITS) -> int:
    """A power of two: per_item bits for each item, as far as most allows."""
    return min(most, max(STRETCH, 1 << (max(1, items * per_item) - 1).bit_length()))


def positions(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Two bits for each 64-bit hash: first all first ones, then all second ones."""
    mask = np.uint64(bits - 1)
    low, high = hashes & np.uint64(0xFFFF), hashes >> np.uint64(32)
    return np.concatenate([hashes & mask, (high * np.uint64(0x9E3779B1) + low) & mask])


def stretches(at: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Sorted positions by stretch, as 32-bit positions within it."""
    ends = np.append(np.flatnonzero(np.diff(at // STRETCH)) + 1, len(at)) if len(at) else []
    for lo, hi in zip([0, *ends], ends, strict=False):
        yield int(at[lo] // STRETCH), (at[lo:hi] % STRETCH).astype("<u4").tobytes()


def passes(packed: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes may be in the filter."""
    at = positions(hashes, len(packed) * 8)
    set_ = (packed[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & 1 > 0
    return set_[: len(hashes)] & set_[len(hashes) :]


def gathered(parts: DataFrame, bits: int) -> np.ndarray:
    """The packed filter of rows (stretch, bits), at most bits of them."""
    out = np.zeros(bits // 8, np.uint8)
    for r in parts.collect():
        part = np.frombuffer(r["bits"], np.uint8)
        out[r["stretch"] * (STRETCH // 8) :][: len(part)] = part
    return out


def _set(key: tuple, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = np.zeros(STRETCH, bool)
    for batch in parts:
        for x in batch.column("at").to_pylist():
            found[np.frombuffer(x, "<u4")] = True
    yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(found).tobytes()], pa.binary())], names=["stretch", "bits"])


def key_filter(keys: DataFrame, bits: int) -> np.ndarray:
    """The filter of keys, whose one column has binary values of 8 bytes or more that begin with a hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = list(stretches(np.unique(positions(hashes_of(batch.column(0).to_pylist()), bits))))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["stretch", "at"])

    return gathered(keys.mapInArrow(run, "stretch int, at binary").groupBy("stretch").applyInArrow(_set, "stretch int, bits binary"), bits)


def hashes_of(keys: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join([k[:8] for k in keys]), "<u8")
