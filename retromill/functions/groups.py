"""Rows of sorted partitions in whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def numbers(batch, column: str) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def begins(*columns: np.ndarray) -> np.ndarray:
    """Where a new group of equal values in ``columns`` begins."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(columns[0]) - 1, bool)
    for c in columns:
        new |= c[1:] != c[:-1]
    return np.flatnonzero(np.append(True, new))


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.RecordBatch]:
    """The rows of a partition that is sorted by ``keys`` (numbers without nulls), cut only where a new group
    begins; the group that a batch ends with is held until it is whole."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cut = int(begins(*(numbers(batch, k) for k in keys))[-1])
        new = not held or any(held[-1].column(k)[-1].as_py() != batch.column(k)[0].as_py() for k in keys)
        if cut or new:
            ready = [*held, batch.slice(0, cut)] if cut else held
            if ready:
                yield pa.Table.from_batches(ready).combine_chunks().to_batches()[0] if len(ready) > 1 else ready[0]
            held = [batch.slice(cut)]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
