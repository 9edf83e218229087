"""Words of whole texts as 64-bit hashes, and hashes of runs of them.

A word is a maximal run of bytes other than space and the control characters
0x09-0x0D. The texts of a portion are split and told apart in Arrow's memory:
each distinct word is hashed once, and nothing is kept from portion to portion.

Runs of words are compared by 64-bit hashes made by doubling: a run's hash mixes
those of its two halves. The mixing is not linear, so no regular pattern of
words makes hashes meet; two different runs share one with a chance of about
2**-64 a pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from oddrank.llm import common

BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
#: Powers that a worker keeps; longer tables are made where they are needed.
KEPT_POWERS = 1 << 21

_powers: dict[int, np.ndarray] = {}


class Words:
    """The words of several texts: each distinct one once, and which stands where.

    ``sizes`` has the number of words of each text, ``codes`` the number of each
    word among the distinct ones, text after text. ``lower`` maps A-Z only.
    """

    def __init__(self, texts: pa.Array, lower: bool = False) -> None:
        texts = pc.fill_null(texts, "")
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
        coded = lists.flatten().dictionary_encode()
        self.distinct = coded.dictionary.cast(pa.binary())
        codes, offsets = coded.indices.to_numpy(), lists.offsets.to_numpy().astype(np.int64)
        sizes = np.diff(offsets)
        blank = pc.index(self.distinct, pa.scalar(b"", pa.binary())).as_py()  # at the ends of a text
        if blank >= 0:
            full = codes != blank
            sizes = np.diff(np.concatenate([[0], np.cumsum(full)])[offsets])
            codes = codes[full]
        self.codes, self.sizes = codes, sizes
        self.begins = np.concatenate([[0], np.cumsum(sizes)])

    def values(self) -> np.ndarray:
        """64-bit hash of every word."""
        names = self.distinct.to_pylist()
        return np.fromiter(map(xxhash.xxh3_64_intdigest, names), np.uint64, len(names))[self.codes]

    def owner(self) -> np.ndarray:
        """Which text each word is in."""
        return np.repeat(np.arange(len(self.sizes)), self.sizes)


def of_texts(texts: list[str | None], lower: bool = False) -> Words:
    return Words(pa.array(texts, pa.string()), lower)


def run_hashes(values: np.ndarray, size: int) -> np.ndarray:
    """Hash of the run of ``size`` values at every start; a run of one is its value."""
    if len(values) < size:
        return np.empty(0, np.uint64)
    out, done = values, 1
    while done < size:
        step = min(done, size - done)
        out = common.mix64(out[: len(out) - step] * np.uint64(BASE) + out[step:])
        done += step
    return out


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.full(1 << max(16, (n - 1).bit_length()), base, np.uint64)
        have[0] = 1
        have = np.multiply.accumulate(have)
        _powers[base] = have[:KEPT_POWERS].copy() if len(have) > KEPT_POWERS else have
    return have[:n]


class Rolling:
    """Rolling hashes of runs of bytes, to deal them out and to look for candidates.

    They are polynomials modulo 2**64, so some regular patterns can share one:
    equal hashes suggest equal runs and do not prove them.
    """

    def __init__(self, values: np.ndarray) -> None:
        self.n = len(values)
        self.prefix = np.zeros(self.n + 1, np.uint64)
        np.cumsum(values * powers(BASE, self.n), out=self.prefix[1:])

    def of(self, length: int, at: np.ndarray | None = None) -> np.ndarray:
        """Hash of the run of ``length`` at every start (or those in ``at``)."""
        inverse = powers(INVERSE, max(1, self.n))
        if at is None:
            count = max(0, self.n - length + 1)
            return common.mix64((self.prefix[length : length + count] - self.prefix[:count]) * inverse[:count])
        return common.mix64((self.prefix[at + length] - self.prefix[at]) * inverse[at])
