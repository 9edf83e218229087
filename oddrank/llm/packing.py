"""Lexical retrieval packing: BM25 neighbours fill each training window.

Every document is encoded and ends with ``end_id``. Whole windows are cut off a
document from its start; what is left, its tail, goes to a pool. The pool is
put in the order of a min-hash of token pairs, so that texts that share wording
come together, and that order is cut by sampled range splitters into partitions
and within them into blocks of ``block_docs`` tails, the shards of the index.
Each shard has an inverted index with BM25 weights, whose document frequencies
and mean length count the tails of all documents. The first unused tail is a
seed; its unused neighbours, best score first, fill its window, the last of
them is cut, and what is left of it seeds the next window.

No window but the last of a partition stays open; that one is dealt out to
windows of falling powers of two. So there is no padding to 1024 at all.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrank.llm import common, tokens

WINDOW = 1024
#: Tails in one shard of the index: bounds its memory and one query's time.
BLOCK_DOCS = 2048
#: The usual constants of BM25.
K1, B = 1.2, 0.75

PIECE = "doc_id long, start long, ids binary, doc_tokens long"
PACKED = f"{PIECE}, sequence_id long, offset long"
PIECE_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.int64())
#: Windows that one document fills alone are numbered from here.
ALONE = 1 << 61
#: Bytes of texts that are encoded at once.
PORTION = 6 << 20


def encode_pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, window: int, end_id: int) -> DataFrame:
    """One row for each whole window of a document and one for its tail, which has a route.

    The ids of whole windows are little-endian uint32, those of tails have the
    tokenizer's narrow type.
    """

    @common.released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer)
        for batch in batches:
            for part in common.portions(batch, PORTION):
                yield _pieces(part.column(0), *coder.batch(part.column(1), end_id), window)

    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return src.mapInArrow(encode, f"{PIECE}, route long")


def _pieces(names: pa.Array, ids: np.ndarray, sizes: np.ndarray, window: int) -> pa.RecordBatch:
    """Windows and tails of documents whose ids lie one after another: all windows first, then the tails."""
    begins = np.cumsum(sizes) - sizes
    full, rest = sizes // window, sizes % window
    doc = np.repeat(np.arange(len(sizes)), full)
    start = (np.arange(len(doc)) - np.repeat(np.cumsum(full) - full, full)) * window
    ended = np.flatnonzero(rest)
    tail = begins[ended] + sizes[ended] - rest[ended]
    whole = [ids[a : a + window].astype("<u4").tobytes() for a in (begins[doc] + start).tolist()]
    ends = [ids[a:b].tobytes() for a, b in zip(tail.tolist(), (begins + sizes)[ended].tolist(), strict=True)]
    owner = np.concatenate([doc, ended])
    routes = pa.array(np.concatenate([np.zeros(len(doc), np.int64), _routes(ids, tail, rest[ended])]), mask=np.arange(len(owner)) < len(doc))
    return pa.RecordBatch.from_arrays(
        [
            names.take(pa.array(owner)),
            pa.array(np.concatenate([start, full[ended] * window])),
            pa.array([*whole, *ends], pa.binary()),
            pa.array(sizes[owner]),
            routes,
        ],
        names=["doc_id", "start", "ids", "doc_tokens", "route"],
    )


def _routes(ids: np.ndarray, begins: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """:func:`route` of many runs of ids."""
    if not len(begins):
        return np.empty(0, np.int64)
    wide = ids.astype(np.uint64)
    # a pair of neighbours at each place; the last place of a run pairs nothing, or stands for a run of one
    pairs = common.mix64((wide[:-1] << np.uint64(32)) | wide[1:]) if len(wide) > 1 else np.empty(0, np.uint64)
    pairs = np.append(pairs, np.uint64(common.MASK64))
    last = begins + sizes - 1
    pairs[last] = np.where(sizes > 1, np.uint64(common.MASK64), common.mix64(wide[last]))
    edges = np.column_stack([begins, begins + sizes]).ravel()
    least = np.minimum.reduceat(np.append(pairs, np.uint64(common.MASK64)), edges)[::2]
    return (least >> np.uint64(1)).astype(np.int64)


def _bytes(ids: np.ndarray) -> bytes:
    return ids.astype("<u4").tobytes()


def _batch(rows: list[tuple], types: tuple) -> pa.RecordBatch:
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(cols, names=[str(i) for i in range(len(cols))])


def route(ids: np.ndarray) -> int:
    """Min-hash of the pairs of neighbouring ids: texts alike tend to share it."""
    return int(_routes(ids, np.array([0]), np.array([len(ids)]))[0])


def term_statistics(tails: DataFrame, vocabulary: int, dtype: np.dtype) -> tuple[np.ndarray, int, float]:
    """Document frequency of each id, number and mean length of all tails.

    Tasks send one row for each id that they met, so what reaches the driver is
    bounded by the vocabulary.
    """

    @common.released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n, length = np.zeros(vocabulary, np.int64), 0, 0
        last = np.zeros(vocabulary, np.int64)
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids = np.frombuffer(raw, dtype)
                place = np.arange(len(ids))
                last[ids] = place  # of equal ids one place is left
                found[ids[last[ids] == place]] += 1
                n, length = n + 1, length + len(ids)
        met = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays(
            [pa.array([-1, -2, *met], pa.int64()), pa.array([n, length, *found[met]], pa.int64())], names=["id", "n"]
        )

    rows = tails.select("ids").mapInArrow(count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    total = dict(rows.collect())
    frequency = np.zeros(vocabulary, np.int64)
    for i, n in total.items():
        if i >= 0:
            frequency[i] = n
    n = total.get(-1, 0)
    return frequency, n, total.get(-2, 0) / max(n, 1)


def inverse_frequency(frequency: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - frequency + 0.5) / (frequency + 0.5))


class Shard:
    """An inverted index over the tails of one block.

    Terms in at least one of eight tails are kept as dense rows, the others as
    lists of (tail, weight); a query adds up the rows and lists of its terms.
    """

    def __init__(self, arrays: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        n = self.n = len(arrays)
        sizes = np.array([len(a) for a in arrays])
        flat = np.concatenate(arrays).astype(np.int64)
        keys, tf = np.unique(flat * n + np.repeat(np.arange(n), sizes), return_counts=True)
        term, doc = keys // n, (keys % n).astype(np.int32)
        terms, first, count = np.unique(term, return_index=True, return_counts=True)
        weight = tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / max(mean, 1e-9))) * idf[term]
        often = count * 8 >= n
        place = np.where(often, np.cumsum(often) - 1, np.cumsum(~often) - 1)
        row = np.repeat(np.arange(len(terms)), count)
        dense = often[row]
        self.rows = np.zeros((int(often.sum()), n), np.float32)
        self.rows[place[row[dense]], doc[dense]] = weight[dense]
        ends = (first + count)[~often].tolist()
        self.lists = [(doc[a:b], weight[a:b]) for a, b in zip(first[~often].tolist(), ends, strict=True)]
        by_doc = np.argsort(doc, kind="stable")
        self.term_row, self.term_often = place[row[by_doc]], often[row[by_doc]]
        self.begin = np.concatenate([[0], np.cumsum(np.bincount(doc, minlength=n))])

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every tail for all distinct terms of the seed."""
        own = slice(self.begin[seed], self.begin[seed + 1])
        rows, often = self.term_row[own], self.term_often[own]
        out = self.rows[rows[often]].sum(axis=0).astype(np.float64)
        lists = [self.lists[i] for i in rows[~often].tolist()]
        if lists:
            docs, weights = zip(*lists, strict=True)
            out += np.bincount(np.concatenate(docs), np.concatenate(weights), self.n)
        return out


def fill_windows(arrays: list[np.ndarray], idf: np.ndarray, mean: float, window: int, opened: list) -> Iterator[list]:
    """Windows of (tail, from, to) over a block; ``opened`` holds what is left over.

    ``opened`` is a list of (ids, block's own piece) left by the block before,
    shorter than a window; it is filled first and refilled with the rest at the end.
    """
    shard = Shard(arrays, idf, mean)
    unused = np.ones(len(arrays), bool)
    cursor, rest = 0, None  # rest: a cut tail and where its rest begins
    current: list = list(opened)
    room = window - sum(p[2] - p[1] for p in current)
    opened.clear()

    def put(tail: int, begin: int) -> tuple[int, int] | None:
        nonlocal room
        end = min(len(arrays[tail]), begin + room)
        current.append((tail, begin, end))
        unused[tail] = False
        room -= end - begin
        return (tail, end) if end < len(arrays[tail]) else None

    while True:
        if rest is None:
            while cursor < len(arrays) and not unused[cursor]:
                cursor += 1
            if cursor == len(arrays):
                break
            rest = (cursor, 0)
        seed = rest[0]
        rest = put(*rest)
        if room and unused.any():
            scores = np.where(unused, shard.scores(seed), -1.0)
            for tail in _best_first(scores):
                if not unused[tail]:
                    break
                rest = put(int(tail), 0)
                if not room:
                    break
        if not room:
            yield current
            current, room = [], window
    opened.extend(current)


def _best_first(scores: np.ndarray, at_once: int = 32) -> Iterator[int]:
    """Positions by falling score, ties by position; sorts no more than is asked for."""
    if len(scores) > 4 * at_once:
        top = np.argpartition(-scores, at_once)[:at_once]
        edge = scores[top].min()
        top = np.flatnonzero(scores > edge)
        yield from top[np.argsort(-scores[top], kind="stable")]
        rest = np.flatnonzero(scores <= edge)
    else:
        rest = np.arange(len(scores))
    yield from rest[np.argsort(-scores[rest], kind="stable")]


def powers(n: int) -> list[int]:
    """Falling powers of two that sum to n."""
    return [1 << i for i in range(n.bit_length() - 1, -1, -1) if n >> i & 1]


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    window: int = WINDOW,
    end_id: int = 0,
    block_docs: int = BLOCK_DOCS,
) -> DataFrame:
    """Pieces of all documents: doc_id, start, ids (little-endian uint32),
    doc_tokens, sequence_id, offset.

    Every id of every document is in exactly one piece; a sequence's pieces lie
    gapless from offset 0 and sum to ``window`` or to a power of two below it.

    Defined cases: a null or empty text gives the end id alone; rows that repeat
    an identifier are documents of their own, a null identifier is passed on;
    an empty table gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_tokenizer()
    pieces = common.written(encode_pieces(docs, id_col, text_col, tokenizer, window, end_id), "pieces")
    whole, tails = pieces.where("route IS NULL"), pieces.where("route IS NOT NULL")
    coder = tokens.encoder(tokenizer)
    dtype = coder.dtype
    frequency, n, mean = term_statistics(tails, max(coder.size, end_id + 1), dtype)
    idf = spark.sparkContext.broadcast(inverse_frequency(frequency, n))

    @common.released
    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number = TaskContext.get().partitionId(), 0
        opened: list = []
        left: list[tuple] = []  # the rows of the pieces in ``opened``

        def sequence(placed: list[tuple]) -> list[tuple]:
            nonlocal number
            out, offset = [], 0
            for (doc_id, start, ids, doc_tokens), lo, hi in placed:
                out.append((doc_id, start + lo, _bytes(ids[lo:hi]), doc_tokens, (part << 32) + number, offset))
                offset += hi - lo
            number += 1
            return out

        types = (*PIECE_TYPES, pa.int64(), pa.int64())
        for block in _blocks(batches, block_docs, dtype):
            arrays = [b[2] for b in block]
            rows: list[tuple] = []
            opened = [(-1 - i, lo, hi) for i, (_, lo, hi) in enumerate(left)]
            for placed in fill_windows(arrays, idf.value, mean, window, opened):
                rows += sequence([(block[t] if t >= 0 else left[-1 - t][0], lo, hi) for t, lo, hi in placed])
                if len(rows) > 2000:
                    yield _batch(rows, types)
                    rows = []
            left = [(block[t] if t >= 0 else left[-1 - t][0], lo, hi) for t, lo, hi in opened]
            if rows:
                yield _batch(rows, types)
        total = sum(hi - lo for _, lo, hi in left)
        rows = []
        for size in powers(total):
            placed = []
            while size:
                row, lo, hi = left.pop(0)
                cut = min(hi, lo + size)
                placed.append((row, lo, cut))
                size -= cut - lo
                if cut < hi:
                    left.insert(0, (row, cut, hi))
            rows += sequence(placed)
        if rows:
            yield _batch(rows, types)

    order = ["route", "doc_id", "start"]
    ranged = tails.repartitionByRange(common.partitions(spark), "route", "doc_id").sortWithinPartitions(*order)
    filled = ranged.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(fill, PACKED)
    alone = whole.select(
        "doc_id", "start", "ids", "doc_tokens",
        (F.lit(ALONE) + F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return filled.unionByName(alone)


def _blocks(batches: Iterator[pa.RecordBatch], size: int, dtype: np.dtype) -> Iterator[list[tuple]]:
    block: list[tuple] = []
    for batch in batches:
        for doc_id, start, raw, doc_tokens in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            block.append((doc_id, start, np.frombuffer(raw, dtype), doc_tokens))
            if len(block) == size:
                yield block
                block = []
    if block:
        yield block


def piece_digest(packed: DataFrame) -> DataFrame:
    return packed.select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("length"),
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )
