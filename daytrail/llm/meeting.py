"""Rows that share a key, compared side by side within a task instead of being joined."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of neighbouring groups that are compared at once; a larger group is alone.
GROUPS = 1 << 23


def whole_groups(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.Table]:
    """Batches in the order of a column, put together anew so that equal values stay together."""
    kept: list[pa.RecordBatch] = []
    size, enough = 0, GROUPS
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        size += batch.nbytes
        if size < enough:
            continue
        table = pa.Table.from_batches(kept)
        values = table[column].to_numpy()
        cut = int(np.argmax(values == values[-1]))
        enough = 2 * size  # of one value more is needed
        if cut:
            yield table.slice(0, cut)
            kept = table.slice(cut).to_batches()
            size = sum(b.nbytes for b in kept)
            enough = max(GROUPS, 2 * size)
    if kept:
        yield pa.Table.from_batches(kept)


def group_ends(keys: np.ndarray) -> np.ndarray:
    """For each of sorted keys, where the rows with this key end."""
    cuts = np.flatnonzero(np.append(keys[1:] != keys[:-1], np.ones(min(1, len(keys)), bool))) + 1
    return np.repeat(cuts, np.diff(np.append(0, cuts)))


def meetings(
    ends: np.ndarray, at: np.ndarray, fits: Callable[[np.ndarray, np.ndarray], np.ndarray]
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of a row of ``at`` and a later one of its group, as index arrays; an array names a row once.

    Rows of a group are in order of size: where one doesn't fit, no later one does.
    """
    for step in itertools.count(1):
        at = at[at + step < ends[at]]
        at = at[fits(at, at + step)]
        if not len(at):
            return
        yield at, at + step


def bits_between(bits: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """In how many bits rows of words differ."""
    return np.bitwise_count(bits[i] ^ bits[j]).sum(axis=1, dtype=np.int64)
