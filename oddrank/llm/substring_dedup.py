"""Substring deduplication with difference-cover anchors.

Two equal windows of 50 words start at unrelated offsets. If runs are hashed
only where the offset modulo a period lies in a difference cover, any two such
windows still share one aligned anchor: for every difference of offsets the
cover has two members with that difference. Anchors that occur in two
documents are extended to the windows around them, and those windows alone are
compared across documents.

Documents are dealt into chunks of a few megabytes by the hash of their
identifier and text. A chunk tells each anchor (later each window) once, with the
smallest and largest identifier that has it, to the bucket of its hash, and the
bucket answers; see ``exchange``. No group of equal passages ever meets in one
task, and no pairs are made.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrank.llm import common, exchange, words

WINDOW = 50
# A perfect difference set modulo 21.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)
CHUNK_BYTES = 4 << 20
LAST = np.iinfo(np.int64).max


class Chunk:
    """The words of a chunk's documents, one after another."""

    def __init__(self, table: pa.Table) -> None:
        self.ids = table.column("doc_id").to_pylist()
        self.words = words.Words(pa.concat_arrays([pa.array([], pa.string()), *table.column("text").cast(pa.string()).chunks]))
        self.sizes, self.begins = self.words.sizes, self.words.begins
        #: rank of a document: its identifier; no identifier comes last
        self.rank = np.array([LAST if i is None else i for i in self.ids], np.int64)
        self.values = self.words.values()
        self.doc = self.words.owner()
        self.offset = np.arange(len(self.doc)) - self.begins[self.doc]

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the anchors and their hashes."""
        length = window - PERIOD + 1
        covered = np.zeros(PERIOD, bool)
        covered[list(COVER)] = True
        long_enough = self.sizes[self.doc] >= window
        fits = self.offset + length <= self.sizes[self.doc]
        at = np.flatnonzero(covered[self.offset % PERIOD] & fits & long_enough)
        return at, words.run_hashes(self.values, length)[at]

    def windows(self, window: int, near: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Starts of whole windows (those around the anchors ``near``) and their hashes."""
        starts = self.offset + window <= self.sizes[self.doc]
        if near is not None:
            length = window - PERIOD + 1
            edge = np.zeros(len(self.doc) + 1, np.int64)
            np.add.at(edge, np.maximum(near + length - window, self.begins[self.doc[near]]), 1)
            np.add.at(edge, near + 1, -1)
            starts &= np.cumsum(edge[:-1]) > 0
        at = np.flatnonzero(starts)
        return at, words.run_hashes(self.values, window)[at]

    def kept(self, gone: np.ndarray) -> list[bytes]:
        """The words of each document that aren't gone, joined by one space."""
        left = ~gone
        spaced = pc.binary_join_element_wise(self.words.distinct, pa.scalar(b"", pa.binary()), pa.scalar(b" ", pa.binary()))
        taken = spaced.cast(pa.large_binary()).take(pa.array(self.words.codes[left]))
        ends = np.frombuffer(taken.buffers()[1], np.int64, len(taken) + 1)[np.concatenate([[0], np.cumsum(left)])[self.begins]]
        data = memoryview(taken.buffers()[2] or b"")
        return [bytes(data[a : b - 1]) if b > a else b"" for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


def _tell(chunk: int, keys: np.ndarray, rank: np.ndarray, buckets: int) -> pa.Table:
    """Each key once with the smallest and largest rank that has it."""
    order, begins = exchange.grouped(keys)
    rows = []
    if len(keys):
        ranks = rank[order]
        unique = keys[order][begins]
        least, most = np.minimum.reduceat(ranks, begins), np.maximum.reduceat(ranks, begins)
        rows = [(b, chunk, unique[s], least[s], most[s]) for b, s in exchange.bucket_slices(unique, buckets)]
    return exchange.packed(rows, ["bucket", "chunk", "keys", "least", "most"])


TOLD = "bucket int, chunk int, keys binary, least binary, most binary"
ANSWER = "chunk int, keys binary, least binary"


def _answer(table: pa.Table) -> pa.Table:
    """To each chunk: those of its keys that two documents share, and the smallest rank."""
    keys, sizes = exchange.joined(table, "keys", "<u8")
    order, begins = exchange.grouped(keys)
    rows = []
    if len(keys):
        least = np.minimum.reduceat(exchange.joined(table, "least", "<i8")[0][order], begins)
        most = np.maximum.reduceat(exchange.joined(table, "most", "<i8")[0][order], begins)
        first = exchange.spread(least, begins, order)
        shared = exchange.spread(least < most, begins, order)
        ends = np.cumsum(sizes)
        for chunk, lo, hi in zip(table.column("chunk").to_pylist(), ends - sizes, ends, strict=True):
            found = shared[lo:hi]
            if found.any():
                rows.append((chunk, keys[lo:hi][found], first[lo:hi][found]))
    return exchange.packed(rows, ["chunk", "keys", "least"])


def _told(answers: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    keys, _ = exchange.joined(answers, "keys", "<u8")
    least, _ = exchange.joined(answers, "least", "<i8")
    order = np.argsort(keys)
    return keys[order], least[order]


def removed_words(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, with_text: bool = True
) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256, spans and (``with_text``) the kept text.

    A word goes if a window of ``window`` words of its document covers it whose
    words also start in a document with a smaller identifier. ``spans`` are the
    removed runs as (first word, end word).

    Defined cases: a null text has no words; texts with fewer words than the
    window lose none; repeats inside one document, and between rows that repeat
    an identifier, are kept; a null identifier ranks after all others (such rows
    lose what any other row has, and keep what they share only among
    themselves); an empty table gives no rows; extra columns are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"a window has at least {PERIOD} words")
    src = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text")
    )
    chunks = common.chunk_count(src, "text", CHUNK_BYTES)
    dealt = src.select(common.chunk_of(F.struct("doc_id", "text"), chunks).alias("chunk"), "doc_id", "text")
    by_chunk = dealt.groupBy("chunk")

    def tell_anchors(key: tuple, table: pa.Table) -> pa.Table:
        chunk = Chunk(table)
        at, keys = chunk.anchors(window)
        return _tell(key[0].as_py(), keys, chunk.rank[chunk.doc[at]], chunks)

    def tell_windows(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        shared, _ = _told(answers)
        chunk = Chunk(table)
        at, keys = chunk.anchors(window)
        near = at[exchange.member(keys, shared) >= 0]
        at, keys = chunk.windows(window, near)
        return _tell(key[0].as_py(), keys, chunk.rank[chunk.doc[at]], chunks)

    def cut(table: pa.Table, answers: pa.Table) -> pa.Table:
        shared, least = _told(answers)
        chunk = Chunk(table)
        gone = np.zeros(len(chunk.doc), bool)
        if len(shared):
            at, keys = chunk.windows(window)
            found = exchange.member(keys, shared)
            hit = (found >= 0) & (least[found] < chunk.rank[chunk.doc[at]])
            edge = np.zeros(len(chunk.doc) + 1, np.int64)
            edge[at[hit]] += 1
            edge[at[hit] + window] -= 1
            gone = np.cumsum(edge[:-1]) > 0
        rows = []
        for i, kept in enumerate(chunk.kept(gone)):
            lost = gone[chunk.begins[i] : chunk.begins[i + 1]]
            turns = np.flatnonzero(np.diff(np.concatenate([[0], lost.view(np.int8), [0]])))
            spans = [{"first": int(a), "end": int(b)} for a, b in turns.reshape(-1, 2)]
            rows.append((chunk.ids[i], len(lost), int(lost.sum()), hashlib.sha256(kept).hexdigest(), spans,
                         kept.decode("utf-8", "replace") if with_text else None))
        span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), span, pa.string()]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "text"]
        cols = list(zip(*rows, strict=True)) if rows else [()] * 6
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    def answer(key: tuple, table: pa.Table) -> pa.Table:
        return _answer(table)

    anchors = by_chunk.applyInArrow(tell_anchors, TOLD).groupBy("bucket").applyInArrow(answer, ANSWER)
    told = by_chunk.cogroup(anchors.groupBy("chunk")).applyInArrow(tell_windows, TOLD)
    windows = told.groupBy("bucket").applyInArrow(answer, ANSWER)
    return by_chunk.cogroup(windows.groupBy("chunk")).applyInArrow(
        cut,
        "doc_id long, n_words long, n_removed long, kept_sha256 string, "
        "spans array<struct<first:long,end:long>>, text string",
    )
