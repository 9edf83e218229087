"""SuperMinHash signatures of many sets at once.

For an element d of a set, a generator seeded by d gives a random permutation of
the m positions and uniform numbers r_0, r_1, ...; position ``perm[j]`` is
offered the value ``j + r_j``, and the signature keeps the least offer at each
position. Positions of one element never coincide, so the estimate of the
Jaccard similarity varies less than with independent hashes, and a set can stop
at step j as soon as every position holds a value below j: later offers cannot
win. Sets of hundreds of elements stop after two or three steps.

Here all elements of all sets in a batch take step j together. The permutations
are drawn by Fisher-Yates swaps, kept only for elements still taking part.
"""

from __future__ import annotations

import numpy as np

from oddrank.llm import common

NEVER = np.uint64(0xFFFFFFFFFFFFFFFF)
#: Elements whose permutations are kept at once.
BATCH = 1 << 17


def signatures(elements: np.ndarray, owner: np.ndarray, n_sets: int, m: int) -> np.ndarray:
    """(n_sets, m) signature of the sets given as parallel arrays of elements and
    their sets (ascending). A value is step << 32 | 32 random bits; positions of
    an empty set hold ``NEVER``.
    """
    out = np.full((n_sets, m), NEVER, np.uint64)
    if not len(elements):
        return out
    sizes = np.bincount(owner, minlength=n_sets)
    ends = np.cumsum(sizes)
    first = 0
    while first < n_sets:
        begin = ends[first] - sizes[first]
        last = max(first + 1, int(np.searchsorted(ends, begin + BATCH, "right")))
        lo, hi = int(begin), int(ends[last - 1])
        for part in range(lo, hi, BATCH):  # one, but for a set beyond the batch: its parts' offers meet in one signature
            end = min(hi, part + BATCH)
            _batch(elements[part:end], owner[part:end] - first, out[first:last])
        first = last
    return out


def _batch(elements: np.ndarray, owner: np.ndarray, out: np.ndarray) -> None:
    m = out.shape[1]
    flat = out.reshape(-1)
    perm = np.empty((len(elements), m), np.uint8 if m <= 256 else np.uint16)
    perm[:] = np.arange(m)
    for j in range(m):
        step = np.uint64(j)
        drawn = common.mix64(elements + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & common.MASK64))
        rows = np.arange(len(elements))
        k = j + ((drawn >> np.uint64(40)) % np.uint64(m - j)).astype(np.int64)
        at = perm[rows, k].astype(np.int64)
        perm[rows, k] = perm[rows, j]
        value = (step << np.uint64(32)) | (drawn & np.uint64(0xFFFFFFFF))
        np.minimum.at(flat, owner * m + at, value)
        # a set whose largest value is of step j or below takes nothing from step j + 1
        open_sets = (out >> np.uint64(32)).max(axis=1) > step
        if not open_sets.any():
            return
        going = open_sets[owner]
        if not going.all():
            elements, owner, perm = elements[going], owner[going], perm[going]


def band_keys(signature: np.ndarray, rows: int) -> np.ndarray:
    """(n_sets, bands) 64-bit keys of consecutive groups of ``rows`` positions."""
    n, m = signature.shape
    bands = m // rows
    keys = np.zeros((n, bands), np.uint64)
    for r in range(rows):
        keys = common.mix64((keys * np.uint64(0xD1342543DE82EF95)) ^ signature[:, r : bands * rows : rows])
    return common.mix64(keys + np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
