"""Enhanced suffix array of several texts and its common-prefix interval tree."""

from __future__ import annotations

import numpy as np


def suffix_array(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Positions in the order of their next ``depth`` symbols at least.

    Prefix doubling: seven symbols (9 bits each, 0 for an end of text) are one
    first key; then two ranks make the key for twice the length.
    """
    n = len(symbols)
    padded = np.zeros(n + 7, np.uint64)
    padded[:n] = symbols
    key = np.zeros(n, np.uint64)
    for i in range(7):
        key <<= np.uint64(9)
        key |= padded[i : i + n]
    del padded
    length = 7
    while True:
        order = np.argsort(key, kind="stable")
        there = key[order]
        names = np.cumsum(np.concatenate([[1], there[1:] != there[:-1]]), dtype=np.uint32) if n else np.empty(0, np.uint32)
        if length >= depth or not n or names[-1] == n:
            return order
        rank = np.empty(n, np.uint32)
        rank[order] = names
        del there, names, order
        key = rank.astype(np.uint64) << np.uint64(32)
        if length < n:
            key[: n - length] |= rank[length:]
        length *= 2


def common_prefixes(symbols: np.ndarray, order: np.ndarray, room: np.ndarray, part: int = 1 << 15) -> np.ndarray:
    """Length of the common prefix of each suffix and the one before it in order.

    ``room`` is how far each suffix counts; ``part`` bounds how many pairs are
    compared at once.
    """
    n = len(order)
    out = np.zeros(n, np.int64)
    if n < 2:
        return out
    most = np.minimum(room[order[:-1]], room[order[1:]])
    width = 64
    padded = np.concatenate([symbols, np.zeros(width, symbols.dtype)])
    windows = np.lib.stride_tricks.sliding_window_view(padded, width)
    got = np.zeros(n - 1, np.int64)
    for lo in range(0, n - 1, part):
        going = np.arange(lo, min(lo + part, n - 1))
        while len(going):
            at = got[going]
            same = windows[order[going] + at] == windows[order[going + 1] + at]
            full = same.all(axis=1)
            step = np.where(full, width, same.argmin(axis=1))
            got[going] = np.minimum(at + step, most[going])
            going = going[full & (got[going] < most[going])]
    out[1:] = got
    return out


def intervals(prefixes: list[int], left: list[int], least: int, most: int | None = None):
    """Scan the suffixes in order with a stack; yield the maximal repeats.

    A repeat is (length, first, last): suffixes ``first``..``last`` in order all
    begin with the same ``length`` >= ``least`` symbols, no more of them do, they
    do not all go on alike, and they do not all come after the same symbol.
    ``prefixes[i]`` is what suffix i shares with the one before it, ``left[i]`` the
    symbol before it (-1: none, unlike any other). Children come before parents.
    """
    stack: list[tuple[int, int, int]] = []  # length, first suffix, left symbol of all (-1: several)
    n = len(prefixes)
    for i in range(1, n + 1):
        shared = prefixes[i] if i < n else 0
        if shared < least:
            shared = 0
        first, symbol = i - 1, left[i - 1]
        while stack and shared < stack[-1][0]:
            length, begun, seen = stack.pop()
            symbol = symbol if symbol == seen else -1
            first = begun
            if symbol < 0 or length == most:
                yield length, first, i - 1
        if stack and stack[-1][0] == shared:
            length, begun, seen = stack[-1]
            if seen != symbol:
                stack[-1] = (length, begun, -1)
        elif shared:
            stack.append((shared, first, symbol))


#: Bytes to which suffixes are compared at least.
DEPTH = 448


def cover(repeats, lengths: np.ndarray) -> np.ndarray:
    """For each suffix the length of the longest repeat it is in; ``lengths`` is a start.

    Repeats come children first, so the first one to reach a suffix is its
    longest; a pointer past suffixes already reached keeps the work linear.
    """
    done = lengths > 0
    skip = list(range(len(lengths) + 1))

    def free(i: int) -> int:
        root = i
        while skip[root] != root:
            root = skip[root]
        while skip[i] != root:
            skip[i], i = root, skip[i]
        return root

    for i in np.flatnonzero(done).tolist():
        skip[i] = i + 1
    out = lengths.copy()
    for length, first, last in repeats:
        i = free(first)
        while i <= last:
            out[i] = length
            skip[i] = i + 1
            i = free(i)
    return out


def repeated_spans(
    texts: list[bytes], weights: list[int], least: int, spell: bool = True
) -> tuple[list[tuple], list[np.ndarray]]:
    """Maximal repeats of ``least`` bytes or more over several texts.

    A text with weight above 1 stands for that many equal texts. Returns the
    repeats as (length, [(text, offset), ...]), if they are to be spelled out,
    and for each text its covered spans as rows (begin, end).
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    symbols = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8).astype(np.uint16) + 1
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])[:-1]
    symbols[begins + sizes] = 0
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    room = begins[text] + sizes[text] - np.arange(len(symbols))
    most = max(DEPTH, 2 * least)  # a longer repeat is a chain of these, which cover the same bytes
    np.minimum(room, most, out=room)
    order = suffix_array(symbols, most)
    order = order[room[order] >= least]  # the others begin no such repeat, and lie in no such group
    prefixes = common_prefixes(symbols, order, room)
    # whole texts that stand for several are repeats of their own
    heavy = np.array(weights)[text[order]] > 1
    alone = heavy & (order == begins[text[order]])
    near = prefixes >= least
    busy = near | np.append(near[1:], False) | alone
    order, prefixes, alone = order[busy], np.where(near, prefixes, 0)[busy], alone[busy]
    left = np.where(order == begins[text[order]], -1, symbols[order - 1].astype(np.int64))
    found = list(intervals(prefixes.tolist(), left.tolist(), least, most))
    length = cover(found, np.where(alone, sizes[text[order]], 0))
    edge = np.zeros(len(symbols) + 1, np.int64)
    np.add.at(edge, order[length > 0], 1)
    np.add.at(edge, (order + length)[length > 0], -1)
    covered = np.cumsum(edge[:-1]) > 0
    turns = np.flatnonzero(np.diff(np.concatenate([[False], covered, [False]]).astype(np.int8))).reshape(-1, 2)
    owner = text[turns[:, 0]]
    spans = _by_text(turns, owner, begins)
    repeats = [
        (n, [(int(text[p]), int(p - begins[text[p]])) for p in order[a : b + 1]]) for n, a, b in found if spell
    ]
    return repeats, spans


def _by_text(turns: np.ndarray, owner: np.ndarray, begins: np.ndarray) -> list[np.ndarray]:
    cuts = np.searchsorted(owner, np.arange(len(begins) + 1))
    return [turns[a:b] - begins[i] for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
