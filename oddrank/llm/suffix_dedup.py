"""Removal of repeated byte strings by an enhanced suffix array.

A suffix array of the whole corpus fits no machine, but its groups can be dealt
out: two equal strings of 200 bytes have the same least hash among their short
grams. Every start of a 200-byte string belongs to the group of that least
hash, consecutive starts of one group form a run, and a run is sent to its
group with the bytes its strings span. In a group the equal runs are one text
with a weight; over the others an enhanced suffix array is scanned with a
stack, which yields the nodes of the common-prefix interval tree that are
different to their left: the maximal repeats, each with all its occurrences.
What they cover is told to the chunks that sent the runs.

A gram that is least in one place only is in no repeat; a first exchange of
counts leaves such runs out. Chunks send equal runs once, so a passage that
all documents share costs each chunk one entry. Its edges are another matter:
there the strings reach into surroundings that differ from document to
document, and all of them have a gram of the passage. Where a gram has very
many places, a second exchange, of hashes of the strings, comes before the
bytes: only strings whose hash recurs anywhere are sent. Hashes leave out, and
never decide that anything is repeated.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrank.llm import common, exchange, suffix_tree, words

LENGTH = 200
GRAM = 32
CHUNK_BYTES = 2 << 20
#: Bytes of different runs that one suffix array covers at most, unless a single
#: group has more.
ARRAY_BYTES = 1 << 20
#: Places of a gram from which its strings are looked for by hash before they are sent.
HOT_PLACES = 8192


class Chunk:
    """The bytes of a chunk's documents and the runs of starts with one least gram."""

    def __init__(self, table: pa.Table, length: int) -> None:
        self.ids = table.column("doc_id").to_pylist()
        self.bodies = [b or b"" for b in table.column("body").to_pylist()]
        self.sizes = np.array([len(b) for b in self.bodies], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])
        self.bytes = np.frombuffer(b"".join(self.bodies), np.uint8)
        n = len(self.bytes)
        self.hashes = words.Rolling(self.bytes.astype(np.uint64) + np.uint64(1))
        grams = self.hashes.of(GRAM)
        doc = np.repeat(np.arange(len(self.ids)), self.sizes)
        within = self.begins[doc + 1] - np.arange(n) >= length
        self.length = length
        self.first = self.last = np.empty(0, np.int64)
        self.key = self.least = np.empty(0, np.uint64)
        self.grams = grams
        if within.any():
            least = _sliding_least(grams, length - GRAM + 1)
            starts = np.flatnonzero(within)
            value = least[starts]
            cut = np.ones(len(starts), bool)
            cut[1:] = (value[1:] != value[:-1]) | (starts[1:] != starts[:-1] + 1) | (doc[starts[1:]] != doc[starts[:-1]])
            at = np.flatnonzero(cut)
            self.first = starts[at]
            self.last = starts[np.append(at[1:], len(starts)) - 1]
            self.least = value[at]
            # least hashes are small numbers: mixed again, they spread over the buckets
            self.key = common.mix64(self.least)
        self.end = self.last + length

    def counts(self) -> tuple[np.ndarray, np.ndarray]:
        """The runs' keys, ascending, and how many positions have each as their gram."""
        unique = np.unique(self.least)
        if not len(unique):
            return unique, np.empty(0, np.uint32)
        seen = np.zeros(1 << 20, bool)
        mask = np.uint64((1 << 20) - 1)
        seen[unique & mask] = True
        close = self.grams[seen[self.grams & mask]]
        at = exchange.member(close, unique)
        n = np.bincount(at[at >= 0], minlength=len(unique))
        keys = common.mix64(unique)
        order = np.argsort(keys)
        return keys[order], n[order].astype(np.uint32)

    def starts(self, runs: np.ndarray) -> np.ndarray:
        """All starts of strings in some runs, run after run."""
        n = self.last[runs] - self.first[runs] + 1
        return np.repeat(self.first[runs] - (np.cumsum(n) - n), n) + np.arange(n.sum())

    def narrow(self, hot: np.ndarray, recurring: np.ndarray) -> None:
        """Cut the runs of hot keys down to stretches of starts whose string's hash recurs."""
        if not len(hot):
            return
        is_hot = exchange.member(self.key, hot) >= 0
        runs = np.flatnonzero(is_hot)
        starts = self.starts(runs)
        keep = exchange.member(self.hashes.of(self.length, starts), recurring) >= 0
        run = np.repeat(runs, self.last[runs] - self.first[runs] + 1)[keep]
        starts = starts[keep]
        new = np.ones(len(starts), bool)
        new[1:] = (starts[1:] != starts[:-1] + 1) | (run[1:] != run[:-1])
        at = np.flatnonzero(new)
        first, last = starts[at], starts[np.append(at[1:], len(starts)) - 1] if len(at) else starts
        self.first = np.concatenate([self.first[~is_hot], first])
        self.last = np.concatenate([self.last[~is_hot], last])
        self.key = np.concatenate([self.key[~is_hot], self.key[run[at]]])
        self.end = self.last + self.length

    def contents(self, runs: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each run."""
        data = memoryview(self.bytes)
        spans = zip(self.first[runs].tolist(), self.end[runs].tolist(), strict=True)
        return np.fromiter((xxhash.xxh3_64_intdigest(data[a:b]) for a, b in spans), np.uint64, len(runs))


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of ``width`` values from each position on, by doubling."""
    out, done = values, 1
    while 2 * done <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    rest = width - done
    return np.minimum(out[: len(out) - rest], out[rest:]) if rest else out


def _tell_counts(chunk_id: int, table: pa.Table, length: int, buckets: int) -> pa.Table:
    keys, counts = Chunk(table, length).counts()
    rows = [(b, chunk_id, keys[s], counts[s]) for b, s in exchange.bucket_slices(keys, buckets)]
    return exchange.packed(rows, ["bucket", "chunk", "keys", "counts"])


#: What chunks are told: keys that recur (kind 0), keys of hot grams (1), hashes of strings that recur (2), and of
#: repeats (3) the run's content and the spans in it.
ANSWER = "chunk int, kind int, keys binary, begins binary, ends binary"


def _answers(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [()] * 5
    made = [pa.array(c, t) for c, t in zip(cols, [pa.int32(), pa.int32(), *[pa.binary()] * 3], strict=True)]
    return pa.Table.from_arrays(made, names=["chunk", "kind", "keys", "begins", "ends"])


def _told(answers: pa.Table, kind: int, column: str = "keys", dtype: str = "<u8") -> np.ndarray:
    own = answers.filter(pa.compute.equal(answers.column("kind"), kind))
    return exchange.joined(own, column, dtype)[0]


def _answer_counts(table: pa.Table, kind: int, hot: int | None) -> pa.Table:
    """To each chunk: those of its keys that more than one position has, and those that ``hot`` positions have."""
    keys, sizes = exchange.joined(table, "keys", "<u8")
    counts = exchange.joined(table, "counts", "<u4")[0].astype(np.int64)
    order, begins = exchange.grouped(keys)
    rows = []
    if len(keys):
        total = exchange.spread(np.add.reduceat(counts[order], begins), begins, order)
        ends = np.cumsum(sizes)
        for chunk, lo, hi in zip(table.column("chunk").to_pylist(), ends - sizes, ends, strict=True):
            own, n = keys[lo:hi], total[lo:hi]
            if (n > 1).any():
                rows.append((chunk, kind, own[n > 1].tobytes(), b"", b""))
            if hot is not None and (n >= hot).any():
                rows.append((chunk, 1, own[n >= hot].tobytes(), b"", b""))
    return _answers(rows)


def _tell_strings(chunk_id: int, table: pa.Table, answers: pa.Table, length: int, buckets: int) -> pa.Table:
    """Hashes of the strings with a hot gram, each once with how often it occurs."""
    chunk = Chunk(table, length)
    runs = np.flatnonzero(exchange.member(chunk.key, np.sort(_told(answers, 1))) >= 0)
    keys, n = np.unique(chunk.hashes.of(length, chunk.starts(runs)), return_counts=True)
    n = n.astype(np.uint32)
    rows = [(b, chunk_id, keys[s], n[s]) for b, s in exchange.bucket_slices(keys, buckets)]
    return exchange.packed(rows, ["bucket", "chunk", "keys", "counts"])


def _tell_runs(chunk_id: int, table: pa.Table, answers: pa.Table, length: int, buckets: int) -> pa.Table:
    """Each different run of the wanted keys once, with its bytes and how often it occurs."""
    wanted = np.sort(_told(answers, 0))
    chunk = Chunk(table, length)
    chunk.narrow(np.sort(_told(answers, 1)), np.sort(_told(answers, 2)))
    runs = np.flatnonzero(exchange.member(chunk.key, wanted) >= 0)
    content = chunk.contents(runs)
    order = np.lexsort((content, chunk.key[runs]))
    runs, content = runs[order], content[order]
    key = chunk.key[runs]
    rows = []
    if len(runs):
        new = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (content[1:] != content[:-1])]))
        times = np.minimum(np.diff(np.append(new, len(runs))), 2).astype(np.uint8)
        runs, content, key = runs[new], content[new], key[new]
        sizes = (chunk.end[runs] - chunk.first[runs]).astype(np.uint32)
        whole = chunk.bytes
        for b, s in exchange.bucket_slices(key, buckets):
            body = np.concatenate([whole[x:y] for x, y in zip(chunk.first[runs[s]], chunk.end[runs[s]], strict=True)])
            rows.append((b, chunk_id, key[s], content[s], times[s], sizes[s], body))
    return exchange.packed(rows, ["bucket", "chunk", "keys", "contents", "times", "sizes", "bodies"])


def _find_repeats(table: pa.Table, length: int) -> pa.Table:
    """To each chunk: (content, begin, end) of what is repeated in its runs."""
    keys, per_chunk = exchange.joined(table, "keys", "<u8")
    content = exchange.joined(table, "contents", "<u8")[0]
    times = exchange.joined(table, "times", "u1")[0].astype(np.int64)
    sizes = exchange.joined(table, "sizes", "<u4")[0].astype(np.int64)
    bodies = exchange.joined(table, "bodies", "u1")[0]
    at = np.concatenate([[0], np.cumsum(sizes)])
    if not len(keys):
        return _answers([])
    order = np.lexsort((content, keys))
    k, c = keys[order], content[order]
    begins = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])]))
    weight = np.add.reduceat(times[order], begins)
    sample = order[begins]  # one run for each different content
    text_of = np.empty(len(order), np.int64)
    text_of[order] = np.repeat(np.arange(len(begins)), np.diff(np.append(begins, len(order))))
    spans: list[np.ndarray] = [np.empty((0, 2), np.int64)] * len(begins)
    group = np.flatnonzero(np.concatenate([[True], k[begins][1:] != k[begins][:-1], [True]]))
    shared = np.zeros(len(sample), bool)
    begun, filled = 0, np.concatenate([[0], np.cumsum(sizes[sample])])
    for end in group[1:].tolist():  # whole groups, about ARRAY_BYTES at once
        if filled[end] - filled[begun] >= ARRAY_BYTES or end == len(sample):
            shared[begun:end] = _candidates(bodies, at, sizes, sample[begun:end], length)
            begun = end
    for i in np.flatnonzero(~shared & (weight > 1)):
        spans[i] = np.array([[0, sizes[sample[i]]]])  # a leaf of the tree that stands for several texts
    batch: list[int] = []
    held = 0

    def scan() -> None:
        nonlocal held
        texts = [bodies[at[sample[i]] : at[sample[i] + 1]].tobytes() for i in batch]
        _, found = suffix_tree.repeated_spans(texts, weight[batch].tolist(), length, spell=False)
        for i, s in zip(batch, found, strict=True):
            spans[i] = s
        batch.clear()
        held = 0

    for lo, hi in zip(group[:-1].tolist(), group[1:].tolist(), strict=True):
        own = [i for i in range(lo, hi) if shared[i]]
        batch.extend(own)
        held += int(sizes[sample[own]].sum())
        if held >= ARRAY_BYTES:
            scan()
    if batch:
        scan()
    rows, end = [], np.cumsum(per_chunk)
    for chunk, lo, hi in zip(table.column("chunk").to_pylist(), end - per_chunk, end, strict=True):
        own = [spans[t] for t in text_of[lo:hi]]
        n = np.array([len(s) for s in own])
        if n.any():
            flat = np.concatenate(own).astype(np.uint32)
            rows.append((chunk, 3, np.repeat(content[lo:hi], n).tobytes(), flat[:, 0].tobytes(), flat[:, 1].tobytes()))
    return _answers(rows)


def _candidates(bodies: np.ndarray, at: np.ndarray, sizes: np.ndarray, sample: np.ndarray, length: int) -> np.ndarray:
    """Which of the different runs have a string whose hash recurs; the others need no suffix array."""
    own = sizes[sample]
    ends = np.cumsum(own)
    where = np.arange(ends[-1]) - np.repeat(ends - own, own)
    flat = bodies[np.repeat(at[sample], own) + where]
    starts = np.flatnonzero(where + length <= np.repeat(own, own))
    hashes = words.Rolling(flat.astype(np.uint64) + np.uint64(1)).of(length, starts)
    order = np.argsort(hashes)
    same = hashes[order][1:] == hashes[order][:-1]
    again = starts[order[np.append(same, False) | np.insert(same, 0, False)]]
    found = np.zeros(len(sample), bool)
    found[np.searchsorted(ends, again, "right")] = True
    return found


def _cut(table: pa.Table, answers: pa.Table, length: int, with_text: bool) -> pa.Table:
    content = _told(answers, 3)
    begin, end = (_told(answers, 3, c, "<u4").astype(np.int64) for c in ("begins", "ends"))
    order = np.argsort(content, kind="stable")
    content, begin, end = content[order], begin[order], end[order]
    chunk = Chunk(table, length)
    chunk.narrow(np.sort(_told(answers, 1)), np.sort(_told(answers, 2)))
    edge = np.zeros(len(chunk.bytes) + 1, np.int64)
    if len(content):
        runs = np.arange(len(chunk.first))
        own = chunk.contents(runs)
        lo, hi = np.searchsorted(content, own, "left"), np.searchsorted(content, own, "right")
        n = hi - lo
        which = np.repeat(runs, n)
        span = np.arange(n.sum()) + np.repeat(lo - (np.cumsum(n) - n), n)
        np.add.at(edge, chunk.first[which] + begin[span], 1)
        np.add.at(edge, chunk.first[which] + end[span], -1)
    gone = np.cumsum(edge[:-1]) > 0
    rows = []
    for i, doc_id in enumerate(chunk.ids):
        a, b = chunk.begins[i], chunk.begins[i + 1]
        lost = gone[a:b]
        kept = chunk.bytes[a:b][~lost].tobytes() if lost.any() else chunk.bodies[i]
        turns = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]]))).reshape(-1, 2)
        spans = [{"begin": int(x), "end": int(y)} for x, y in turns]
        rows.append((doc_id, b - a, int(lost.sum()), len(turns), hashlib.sha256(kept).hexdigest(), spans, kept if with_text else None))
    span_type = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64())]))
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span_type, pa.binary()]
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"]
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(types)
    return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)


def removed_bytes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_text: bool = True
) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans and (``with_text``) the kept bytes.

    A byte goes if a string of ``length`` bytes of its document covers it that also
    starts anywhere else, in the same document or another; occurrences may
    overlap. Matches never cross documents. ``spans`` are the removed runs.

    Defined cases: a null text is empty; texts shorter than ``length`` bytes lose
    none; rows that repeat a text lose it wherever they are long enough, the
    first of them too; identifiers are only passed on, null ones too; an empty
    table gives no rows; extra columns are ignored.
    """
    if length < GRAM:
        raise ValueError(f"repeats have at least {GRAM} bytes")
    src = docs.select(
        docs[id_col].cast("long").alias("doc_id"),
        F.coalesce(docs[text_col].cast("string"), F.lit("")).cast("binary").alias("body"),
    )
    chunks = common.chunk_count(src, "body", CHUNK_BYTES)
    spread = F.struct("doc_id", "body")
    by_chunk = src.select(common.chunk_of(spread, chunks).alias("chunk"), "doc_id", "body").groupBy("chunk")

    def tell_counts(key: tuple, table: pa.Table) -> pa.Table:
        return _tell_counts(key[0].as_py(), table, length, chunks)

    def answer_counts(key: tuple, table: pa.Table) -> pa.Table:
        return _answer_counts(table, 0, HOT_PLACES)

    def tell_strings(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return _tell_strings(key[0].as_py(), table, answers, length, chunks)

    def answer_strings(key: tuple, table: pa.Table) -> pa.Table:
        return _answer_counts(table, 2, None)

    def tell_runs(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return _tell_runs(key[0].as_py(), table, answers, length, chunks)

    def find_repeats(key: tuple, table: pa.Table) -> pa.Table:
        return _find_repeats(table, length)

    def cut(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        return _cut(table, answers, length, with_text)

    told = "bucket int, chunk int, keys binary, counts binary"
    again = common.written(
        by_chunk.applyInArrow(tell_counts, told).groupBy("bucket").applyInArrow(answer_counts, ANSWER), "recurring-grams"
    )
    narrowed = again.where("kind = 1")
    if narrowed.limit(1).count():
        strings = by_chunk.cogroup(narrowed.groupBy("chunk")).applyInArrow(tell_strings, told)
        found = common.written(strings.groupBy("bucket").applyInArrow(answer_strings, ANSWER), "recurring-strings")
        again, narrowed = again.unionByName(found), narrowed.unionByName(found)
    runs = by_chunk.cogroup(again.groupBy("chunk")).applyInArrow(
        tell_runs,
        "bucket int, chunk int, keys binary, contents binary, times binary, sizes binary, bodies binary",
    )
    repeats = runs.groupBy("bucket").applyInArrow(find_repeats, ANSWER).unionByName(narrowed)
    return by_chunk.cogroup(repeats.groupBy("chunk")).applyInArrow(
        cut,
        "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
        "spans array<struct<begin:long,end:long>>, kept binary",
    )
