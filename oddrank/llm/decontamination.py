"""Benchmark decontamination with spaced seeds.

A seed is a mask over a run of words: the words at its set positions are
hashed, the others may be anything. Seeds of the benchmark's items and of the
training texts are joined on that hash; around each hit the item is laid over
the text and the words that agree are counted, so replaced words cost a match
and no more.

All seeds of all texts would be many times the texts. So the benchmark's seeds
leave their marks in a Bloom filter of bounded size first, which goes to all
tasks: only seeds that it lets pass are joined, with the words around them.
Whatever the size of the benchmark, the texts are read once, nothing of it but
the filter is broadcast, and a fuller filter only lets more seeds pass to the
join. Stretches of text around hits are named by their words, so a passage that
very many documents share is joined and compared once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrank.llm import common, words

# Masks of five words, one without a gap and six with gaps, for
# items of seven words and more; any 20 words with four of them replaced, and any
# fewer with a fifth replaced, leave room for one of them.
MASKS = ("11111", "110111", "111011", "1101011", "11001011", "1010111", "11100011")
# For shorter items, every way to leave out one word of five or six.
SHORT_MASKS = {
    1: ("1",),
    2: ("11",),
    3: ("111",),
    4: ("1111",),
    5: ("1111", "11011", "10111", "11101"),
    6: ("11111", "110111", "111011", "101111", "111101"),
}
#: Words of an item that must be laid over a text, and the share that must agree.
OVERLAP, PERCENT = 20, 80
#: Bits of the filter for each seed, and its least and most bits as powers of two (16 MB).
FILTER_RATIO, FILTER_LEAST, FILTER_MOST = 24, 20, 27
#: Bits of the filter that are put together in one group.
FILTER_BLOCK = 1 << 16
#: Bytes of texts that are searched at once.
PORTION = 4 << 20

# Odd factors of a seed's words, and of the filter's three cells.
FACTORS = [(0x9E3779B97F4A7C15 * (2 * k + 1)) & common.MASK64 | 1 for k in range(5)]
CELLS = (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)


def masks_for(n_words: int) -> tuple[str, ...]:
    """The masks whose seeds find an item of so many words."""
    return SHORT_MASKS.get(n_words, MASKS if n_words else ())


def seed_hashes(values: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the mask's words at every start."""
    n = len(values) - len(mask) + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.full(n, int(mask, 2) * 0xD1342543DE82EF95 & common.MASK64, np.uint64)
    for factor, i in zip(FACTORS, (i for i, bit in enumerate(mask) if bit == "1"), strict=False):
        out += values[i : i + n] * np.uint64(factor)
    return out ^ (out >> np.uint64(32))


def cells(seeds: np.ndarray, bits: int) -> list[np.ndarray]:
    """The three cells of a filter of 2**bits that each seed marks."""
    return [((seeds * np.uint64(c)) >> np.uint64(64 - bits)).astype(np.int64) for c in CELLS]


class Filter:
    """A packed bitmap of 2**bits cells."""

    def __init__(self, bits: int, marks: np.ndarray, masks: tuple[str, ...]) -> None:
        self.bits, self.marks, self.masks = bits, marks, masks

    def passes(self, seeds: np.ndarray) -> np.ndarray:
        """Positions of the seeds that may be the benchmark's."""
        left = np.arange(len(seeds))
        for c in CELLS:
            cell = (seeds[left] * np.uint64(c)) >> np.uint64(64 - self.bits)
            held = self.marks[(cell >> np.uint64(3)).astype(np.int64)] >> (cell & np.uint64(7)).astype(np.uint8)
            left = left[(held & 1).astype(bool)]
        return left


def best_overlap(item: np.ndarray, text: np.ndarray, start: int, overlap: int) -> tuple[int, int, int]:
    """(words that agree, first word of the item, words) of the best stretch of
    ``overlap`` words (or the whole item, if shorter) when ``item`` lies at ``start``.
    """
    need = min(overlap, len(item))
    lo, hi = max(0, -start), min(len(item), len(text) - start)
    if hi - lo < need:
        return 0, lo, need
    equal = np.concatenate([[0], np.cumsum(item[lo:hi] == text[start + lo : start + hi])])
    sums = equal[need:] - equal[:-need]
    best = int(sums.argmax())
    return int(sums[best]), lo + best, need


def _name(values: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(np.ascontiguousarray(values))


def _items(benchmark: DataFrame) -> DataFrame:
    """item_id, item (name of its words), words (their hashes) of every item with words."""

    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = words.Words(batch.column(1), lower=True)
            own = np.split(found.values(), found.begins[1:-1])
            some = np.flatnonzero(found.sizes)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(some)),
                    pa.array([_name(own[i]) for i in some], pa.binary()),
                    pa.array([own[i].tobytes() for i in some], pa.binary()),
                ],
                names=["item_id", "item", "words"],
            )

    rows = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "item_id long, item binary, words binary")


def _seeds(items: DataFrame) -> DataFrame:
    """seed, item, at, mask: every seed of every different item."""

    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                values = np.frombuffer(raw, np.uint64)
                for mask in masks_for(len(values)):
                    seeds = seed_hashes(values, mask)
                    n = len(seeds)
                    cols = [pa.array(seeds.view(np.int64)), pa.array([item] * n, pa.binary()), pa.array(range(n), pa.int32()), pa.array([mask] * n, pa.string())]
                    yield pa.RecordBatch.from_arrays(cols, names=["seed", "item", "at", "mask"])

    return items.select("item", "words").mapInArrow(run, "seed long, item binary, at int, mask string")


def _filter(seeds: DataFrame) -> Filter:
    """The filter of the seeds: its size is bounded, and so is what reaches the driver."""
    per_mask = seeds.groupBy("mask").count().collect()  # a row for each of at most 14 masks
    total = sum(r["count"] for r in per_mask)
    bits = min(FILTER_MOST, max(FILTER_LEAST, (FILTER_RATIO * total).bit_length()))

    def marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.unique(np.concatenate(cells(batch.column(0).to_numpy().view(np.uint64), bits)))
            yield pa.RecordBatch.from_arrays([pa.array(own // FILTER_BLOCK, pa.int32()), pa.array(own % FILTER_BLOCK, pa.int32())], names=["block", "cell"])

    def bitmap(key: tuple, table: pa.Table) -> pa.Table:
        block = np.zeros(FILTER_BLOCK, np.uint8)
        block[table.column("cell").to_numpy()] = 1
        return pa.table({"block": pa.array([key[0].as_py()], pa.int32()), "marks": pa.array([np.packbits(block, bitorder="little").tobytes()], pa.binary())})

    blocks = seeds.select("seed").mapInArrow(marks, "block int, cell int").distinct().groupBy("block").applyInArrow(bitmap, "block int, marks binary")
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks.collect():  # 8 KB for each block, 16 MB at most
        out[row.block * FILTER_BLOCK // 8 :][: FILTER_BLOCK // 8] = np.frombuffer(row.marks, np.uint8)
    return Filter(bits, out, tuple(sorted(r["mask"] for r in per_mask)))


STRETCH = "doc_id long, mark long, doc_start long, stretch binary, words binary, seeds array<long>, ats array<int>"


def _stretches(src: DataFrame, shared, overlap: int) -> DataFrame:
    """The stretches of every text around the seeds that the filter lets pass."""

    def search(part: pa.RecordBatch) -> pa.RecordBatch | None:
        found = words.Words(part.column(2), lower=True)
        values, sizes, begins = found.values(), found.sizes, found.begins
        doc = found.owner()
        hits, seeds, lengths = [], [], []
        for mask in shared.value.masks:
            own = seed_hashes(values, mask)
            at = shared.value.passes(own)
            at = at[at + len(mask) <= begins[doc[at] + 1]]
            hits.append(at)
            seeds.append(own[at])
            lengths.append(np.full(len(at), len(mask)))
        if not sum(map(len, hits)):
            return None
        at, seed, length = np.concatenate(hits), np.concatenate(seeds), np.concatenate(lengths)
        order = np.argsort(at, kind="stable")
        at, seed, length = at[order], seed[order], length[order]
        own = doc[at]
        lo = np.maximum(at + np.minimum(length - overlap, 0), begins[own])
        hi = np.minimum(at + np.maximum(overlap, length), begins[own + 1])
        lo = np.minimum.accumulate(lo[::-1])[::-1]  # of later hits too: a short mask reaches back further
        lo = np.maximum(lo, begins[own])
        far = np.maximum.accumulate(hi)
        new = np.ones(len(at), bool)
        new[1:] = (lo[1:] > far[:-1]) | (own[1:] != own[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at))
        spans = [(lo[a], far[b - 1], a, b) for a, b in zip(first.tolist(), last.tolist(), strict=True)]
        rows = []
        for x, y, a, b in spans:
            stretch = values[x:y]
            rows.append((begins[own[a]], x, _name(stretch), stretch.tobytes(), seed[a:b].view(np.int64), (at[a:b] - x).astype(np.int32)))
        base, start, name, raw, seeds_of, ats = zip(*rows, strict=True)
        owner = pa.array(own[first])
        return pa.RecordBatch.from_arrays(
            [
                part.column(0).take(owner),
                part.column(1).take(owner),
                pa.array(np.array(start) - np.array(base)),
                pa.array(name, pa.binary()),
                pa.array(raw, pa.binary()),
                pa.array(seeds_of, pa.list_(pa.int64())),
                pa.array(ats, pa.list_(pa.int32())),
            ],
            names=[c.split()[0] for c in STRETCH.split(", ")],
        )

    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.portions(batch, PORTION):
                found = search(part)
                if found is not None:
                    yield found

    return src.mapInArrow(run, STRETCH)


def _verify(overlap: int, percent: int):
    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for stretch, item, shift, raw, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                equal, at, n = best_overlap(np.frombuffer(told, np.uint64), np.frombuffer(raw, np.uint64), shift, overlap)
                if 100 * equal >= percent * n:
                    rows.append((stretch, item, n, equal, shift + at, at))
            if rows:
                types = [pa.binary(), pa.binary(), *[pa.int64()] * 4]
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["stretch", "item", "n_words", "n_equal", "start", "item_start"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, mark (of the text) and text: rows with the same two are the same to this operator."""
    text = docs[text_col].cast("string")
    return docs.select(docs[id_col].cast("long").alias("doc_id"), F.xxhash64(text).alias("mark"), text.alias("text"))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    overlap: int = OVERLAP,
    percent: int = PERCENT,
) -> DataFrame:
    """doc_id, mark, item_id, n_words, n_equal, doc_start, item_start of every item found in a text.

    An item is found where at least ``percent`` of the words in some stretch of
    ``overlap`` of its words (of all of them, if it has fewer) agree with a text
    in place; words are compared in lower case (A-Z). The best place is returned.
    With the defaults no such place is missed, whatever the item's length; with
    a lower ``percent`` those without five agreeing words under a mask can be.

    Defined cases: null and empty texts and items match nothing; items of one to
    four words match where all of their words do; texts are read whole; rows
    that repeat an identifier are read each (``mark`` is the XXH64 of the text);
    null identifiers are passed on; with an empty table on either side there are
    no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    items = common.written(_items(benchmark), "items")
    different = items.groupBy("item").agg(F.first("words").alias("told"))
    seeds = common.written(_seeds(different.withColumnRenamed("told", "words")), "seeds")
    shared = spark.sparkContext.broadcast(_filter(seeds))
    found = common.written(_stretches(_rows(docs, id_col, text_col), shared, overlap), "stretches")
    hits = found.select("stretch", F.explode(F.arrays_zip("seeds", "ats")).alias("hit")).select(
        "stretch", F.col("hit.seeds").alias("seed"), F.col("hit.ats").alias("place")
    )
    laid = (
        hits.distinct()
        .join(seeds.select("seed", "item", "at"), "seed")
        .select("stretch", "item", (F.col("place") - F.col("at")).cast("long").alias("shift"))
        .distinct()
    )
    bodies = found.groupBy("stretch").agg(F.first("words").alias("words"))
    pairs = laid.join(bodies, "stretch").join(different, "item").select("stretch", "item", "shift", "words", "told")
    verified = pairs.mapInArrow(
        _verify(overlap, percent), "stretch binary, item binary, n_words long, n_equal long, start long, item_start long"
    )
    best = verified.groupBy("stretch", "item").agg(
        F.max_by(F.struct("n_words", "n_equal", "start", "item_start"), F.struct("n_equal", -F.col("start"))).alias("best")
    )
    placed = found.select("doc_id", "mark", "doc_start", "stretch").join(best, "stretch").join(items.select("item", "item_id"), "item")
    place = F.struct("best.n_words", "best.n_equal", (F.col("doc_start") + F.col("best.start")).alias("doc_start"), "best.item_start")
    return (
        placed.groupBy("doc_id", "mark", "item_id")
        .agg(F.max_by(place, F.struct("best.n_equal", -F.col("doc_start"))).alias("at"))
        .select("doc_id", "mark", "item_id", "at.*")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """doc_id, contaminated, n_items, item_ids (ascending) of every row.

    Items without an identifier are counted, not listed.
    """
    none = F.lit(-(1 << 63)).cast("long")
    found = matches(docs, benchmark, id_col, text_col, **options)
    items = found.groupBy(F.coalesce("doc_id", none).alias("key"), "mark").agg(
        F.sort_array(F.collect_set("item_id")).alias("item_ids"), F.count(F.lit(1)).alias("n")
    )
    rows = _rows(docs, id_col, text_col).select("doc_id", F.coalesce("doc_id", none).alias("key"), "mark")
    return rows.join(items, ["key", "mark"], "left").select(
        F.col("doc_id").alias(id_col),
        F.col("n").isNotNull().alias("contaminated"),
        F.coalesce("n", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("item_ids", F.array().cast("array<long>")).alias("item_ids"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without any benchmark item, with all their columns."""
    none = F.lit(-(1 << 63)).cast("long")
    found = matches(docs, benchmark, id_col, text_col, **options)
    key, mark = common.free_name(docs, "row_key"), common.free_name(docs, "row_mark")
    gone = found.select(F.coalesce("doc_id", none).alias(key), F.col("mark").alias(mark)).distinct()
    own = docs.withColumn(key, F.coalesce(docs[id_col].cast("long"), none)).withColumn(mark, F.xxhash64(docs[text_col].cast("string")))
    return own.join(gone, [key, mark], "left_anti").drop(key, mark)
