"""Rows of Arrow batches, dealt by a key and sorted by it, as NumPy blocks of whole groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroup the batches of a partition sorted by ``key`` so that no group is split.

    Only the group that a batch ends in is held back for the next one.
    """
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(keys, keys[-1], side="left"))
        if last == 0 and held and held[0].column(key)[0].as_py() == keys[-1]:
            held.append(batch)
            continue
        if last == 0:
            if held:
                yield pa.Table.from_batches(held)
            held = [batch]
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, last)])
        held = [batch.slice(last)]
    if held:
        yield pa.Table.from_batches(held)


def group_bounds(keys: np.ndarray) -> np.ndarray:
    """Start of each run of equal keys, and the end of the last."""
    return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)])).astype(np.int64) if len(keys) else np.zeros(1, np.int64)
