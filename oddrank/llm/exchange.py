"""Facts about 64-bit keys passed between groups of documents, many to a row.

Groups of documents ("chunks") send what they know of each key to the key's
bucket; buckets put together what all chunks know and answer the chunks that
asked. A chunk says each key once, however often it has it, so a key that all
documents share brings one entry for each chunk and nothing more; entries are
packed into binary rows, one for each chunk and bucket that meet.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def bucket_slices(keys: np.ndarray, buckets: int) -> Iterator[tuple[int, slice]]:
    """Slices of ascending keys that belong to each bucket met."""
    if not len(keys):
        return
    where = ((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
    cuts = np.flatnonzero(np.diff(where)) + 1
    begins = [0, *cuts.tolist()]
    ends = [*cuts.tolist(), len(keys)]
    for lo, hi in zip(begins, ends, strict=True):
        yield int(where[lo]), slice(lo, hi)


def packed(rows: list[tuple], names: list[str]) -> pa.Table:
    """Rows of integers and arrays (as bytes) as a table; integers are int32."""
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    made = []
    for name, col in zip(names, cols, strict=True):
        if name in ("bucket", "chunk"):
            made.append(pa.array(col, pa.int32()))
        else:
            made.append(pa.array([c.tobytes() if isinstance(c, np.ndarray) else c for c in col], pa.binary()))
    return pa.Table.from_arrays(made, names=names)


def joined(table: pa.Table, name: str, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All arrays of a binary column in one, and the size of each."""
    parts = [np.frombuffer(b, dtype) for b in table.column(name).to_pylist()]
    sizes = np.array([len(p) for p in parts], np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, dtype)), sizes


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order that brings equal keys together, and where each group begins in it."""
    order = np.argsort(keys, kind="stable")
    there = keys[order]
    return order, np.flatnonzero(np.concatenate([[True], there[1:] != there[:-1]])) if len(keys) else np.empty(0, np.int64)


def spread(values: np.ndarray, begins: np.ndarray, order: np.ndarray) -> np.ndarray:
    """A value for each group, given to every member in the members' own order."""
    sizes = np.diff(np.append(begins, len(order)))
    out = np.empty(len(order), values.dtype)
    out[order] = np.repeat(values, sizes)
    return out


def member(keys: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Position of each key in the ascending array ``among``, or -1."""
    if not len(among):
        return np.full(len(keys), -1, np.int64)
    at = np.searchsorted(among, keys)
    at[at == len(among)] = 0
    return np.where(among[at] == keys, at, -1)
