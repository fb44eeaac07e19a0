"""Helpers for Arrow-batched text operators."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one Python step holds at a time; a single longer text is a slice of its own.
SLICE_BYTES = 1 << 20


#: Tables of encoders that worker processes keep from task to task.
_kept: list[dict] = []


def kept() -> dict:
    """A table that outlives a task; the first task of the worker that reads texts for another operator empties it."""
    _kept.append({})
    return _kept[-1]


def text_slices(batches: Iterable[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, keeps: dict | None = None) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the texts of each slice hold about ``limit`` bytes at most.

    From here on this process frees Arrow memory to the system: a worker shares its executor's limit. So it
    empties what other operators kept, too: all ``kept`` tables but ``keeps``.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    for table in _kept:
        if table is not keeps:
            table.clear()
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = np.cumsum(sizes, dtype=np.int64) // limit
        cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b > a:
                yield batch.slice(a, b - a)


def mix64(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """Avalanche 64-bit integers (the public splitmix64 finaliser); never in place."""
    x = x.astype(np.uint64, copy=False) + np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) & 0xFFFFFFFFFFFFFFFF)
    high = x >> np.uint64(30)
    x ^= high
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= np.right_shift(x, np.uint64(27), out=high)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= np.right_shift(x, np.uint64(31), out=high)
    return x


def unit(x: np.ndarray) -> np.ndarray:
    """64-bit hashes to doubles in (0, 1)."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
