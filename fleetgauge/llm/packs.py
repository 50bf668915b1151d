"""Arrays packed into binary columns, so that a shuffled row holds many values."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def pack(values: np.ndarray) -> bytes:
    return np.ascontiguousarray(values).tobytes()


def unpacked(column, dtype) -> np.ndarray:
    """All values of a binary column, one row after another."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=dtype)


def binaries(values: np.ndarray, edges) -> pa.Array:
    """A binary column of the stretches between consecutive edges."""
    return pa.array([pack(values[a:b]) for a, b in zip(edges[:-1], edges[1:])], pa.binary())


def heads(values: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


def dealt(part: np.ndarray, parts: int, *values: np.ndarray):
    """The parts in use, and for each array a binary column with its values by part, in
    the order they came."""
    order = np.argsort(part.astype(np.uint16) if parts <= 1 << 16 else part, kind="stable")
    edges = np.searchsorted(part[order], np.arange(parts + 1))
    used = np.flatnonzero(np.diff(edges))
    columns = []
    for v in values:
        v = v[order]
        columns.append(pa.array([pack(v[edges[p]:edges[p + 1]]) for p in used], pa.binary()))
    return pa.array(used.astype(np.int32)), columns


def spans_of(covered: np.ndarray, group: np.ndarray):
    """Maximal runs of True that stay in one group: (first, behind the last)."""
    on = covered.astype(bool)
    same = np.zeros(len(on), bool)
    same[1:] = group[1:] == group[:-1]
    before = np.zeros(len(on), bool)
    before[1:] = on[:-1]
    first = np.flatnonzero(on & ~(before & same))
    after, follows = np.zeros(len(on), bool), np.zeros(len(on), bool)
    after[:-1], follows[:-1] = on[1:], same[1:]
    return first, np.flatnonzero(on & ~(after & follows)) + 1
