"""Near-duplicate groups by SuperMinHash, banding, verification and union-find.

1. Every document becomes the set of its word shingles and that set's
   SuperMinHash signature. Documents with equal sets are one node from here on,
   however many they are.
2. Bands of the signature are hashed; nodes that share a band's key are joined
   in a star around the key's least node, and the stars' connected components
   are the candidate clusters. No pairs are made.
3. Each node's full set goes to its cluster. A cluster beyond a block's bounds is
   split into blocks that meet two by two. Inside a task all set intersections
   come from products of incidence matrices, so every pair of the cluster is
   confirmed on full sets, and union-find leaves one row for each node.
4. Where clusters were split, the blocks' results are joined by components again.

Bands are chosen so that a pair at the threshold misses all of them with a
chance of less than 1e-8.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from oddrank.llm import common, components, superminhash, words

SHINGLE, PERCENT = 5, 80
POSITIONS = 240
MISS = 1e-8
#: Bounds of a block: set elements and nodes.
BLOCK_ELEMENTS, BLOCK_NODES = 2_000_000, 1024
#: Columns of an incidence matrix multiplied at once.
SLICE = 4096

#: Bytes of texts whose sets are made at once.
PORTION = 2 << 20


def band_rows(percent: int, positions: int = POSITIONS) -> int:
    """Most rows a band can have so that a pair at the threshold is not missed."""
    s = percent / 100
    fitting = [r for r in range(1, positions + 1) if (1 - s**r) ** (positions // r) <= MISS]
    return max(fitting, default=1)


def shingle_sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct hashes of each text's shingles, text after text, and how many each has.

    A text with fewer words than ``size`` has its whole sequence as its only
    shingle; one without words has none.
    """
    found = words.Words(texts, lower=True)
    values, sizes, begins = found.values(), found.sizes, found.begins[:-1]
    n = np.where(sizes > 0, np.maximum(sizes - size + 1, 1), 0)
    ends = np.cumsum(n)
    flat = np.empty(int(ends[-1]) if len(n) else 0, np.uint64)
    long = sizes >= size
    if long.any():
        fits = np.arange(len(values)) - np.repeat(begins, sizes) + size <= np.repeat(sizes, sizes)
        own = np.repeat(long, n)
        flat[own] = words.run_hashes(values, size)[fits[: len(values) - size + 1]]
    for short in range(1, size):
        some = np.flatnonzero(sizes == short)
        if len(some):
            flat[ends[some] - 1] = words.run_hashes(values, short)[begins[some]]
    new = np.ones(len(flat), bool)
    for a, b in zip((ends - n).tolist(), ends.tolist(), strict=True):
        flat[a:b].sort()
    new[1:] = flat[1:] != flat[:-1]
    new[(ends - n)[n > 0]] = True
    return flat[new], np.diff(np.concatenate([[0], np.cumsum(new)])[np.concatenate([[0], ends])])


def fingerprint(elements: np.ndarray) -> bytes:
    """128 bits that name a set; empty for the empty set."""
    if not len(elements):
        return b""
    a = common.mix64(elements).sum(dtype=np.uint64)
    b = common.mix64(elements ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64)
    return int(a).to_bytes(8, "big") + int(b).to_bytes(8, "big")


def sketches(docs: DataFrame, shingle: int, percent: int, positions: int) -> DataFrame:
    """doc_id, n_shingles, node (fingerprint of the set), keys (one for each band)."""
    rows = band_rows(percent, positions)

    @common.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.portions(batch, PORTION):
                flat, sizes = shingle_sets(part.column(1), shingle)
                owner = np.repeat(np.arange(len(sizes)), sizes)
                keys = superminhash.band_keys(superminhash.signatures(flat, owner, len(sizes), positions), rows)
                listed = np.arange(0, keys.size + 1, max(1, keys.shape[1]), dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0),
                        pa.array(sizes, pa.int64()),
                        pa.array(map(fingerprint, np.split(flat, np.cumsum(sizes)[:-1])), pa.binary()),
                        pa.ListArray.from_arrays(listed, pa.array(keys.view(np.int64).ravel())),
                    ],
                    names=["doc_id", "n_shingles", "node", "keys"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_shingles long, node binary, keys array<long>"
    )


def block_labels(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Least position reachable over links between the sets, for each set."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate([[True], flat[1:] != flat[:-1]])
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    common_n = np.zeros((n, n), np.float32)
    if len(column):
        column = np.cumsum(np.concatenate([[0], np.diff(column) != 0]))
        for lo in range(0, int(column[-1]) + 1, SLICE):
            a, b = np.searchsorted(column, [lo, lo + SLICE])
            incidence = np.zeros((n, SLICE), np.float32)
            incidence[owner[a:b], column[a:b] - lo] = 1
            common_n += incidence @ incidence.T
    both = np.rint(common_n).astype(np.int64)
    linked = 100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(linked, True)
    labels = np.arange(n)
    while True:
        least = np.where(linked, labels[None, :], n).min(axis=1)
        least = least[least]
        if (least == labels).all():
            return labels
        labels = least


def _confirm(percent: int):
    """Streams rows sorted by their group and yields (node, label, whole) for each."""

    def finish(group: list[tuple]) -> list[tuple]:
        nodes = dict(reversed([(node, raw) for node, raw, _ in group]))  # rows that repeat a node are one
        names = sorted(nodes)
        labels = block_labels([np.frombuffer(nodes[x], np.uint64) for x in names], percent)
        return [(x, names[label], group[0][2]) for x, label in zip(names, labels, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, group = None, []
        for batch in batches:
            out: list[tuple] = []
            for node, raw, whole, *at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != key and group:
                    out += finish(group)
                    group = []
                key = at
                group.append((node, raw, whole))
            if out:
                yield _rows(out)
        if group:
            yield _rows(finish(group))

    return run


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    a, b, c = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.binary()), pa.array(b, pa.binary()), pa.array(c, pa.bool_())], names=["node", "label", "whole"]
    )


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    positions: int = POSITIONS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row.

    Two documents are linked if 100 x shared shingles >= ``percent`` x shingles
    of either. ``component_id`` is the smallest identifier reachable over links;
    the row that has it is kept.

    Defined cases: a text that is null, empty or without words has no shingles,
    is linked with nothing and kept; one with fewer words than a shingle has
    them all as its one shingle; rows that repeat an identifier each get their
    text's result (all copies of the kept row are marked kept); a null
    identifier is kept only where its component has no other; an empty table
    gives no rows; extra columns are ignored.
    """
    spark = docs.sparkSession
    src = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sketch = common.written(sketches(src, shingle, percent, positions), "sketches")
    classes = (
        sketch.where("n_shingles > 0")
        .groupBy("node")
        .agg(F.min("doc_id").alias("first_id"), F.max("n_shingles").alias("n"), F.first("keys").alias("keys"))
    )
    classes = common.written(classes, "classes")
    spread = classes.select("node", F.posexplode("keys").alias("band", "key")).select("node", "key")
    star = Window.partitionBy("key").orderBy("node")  # the frame up to the row: streamed, not buffered
    stars = spread.select("node", F.min("node").over(star).alias("hub")).where("node > hub").distinct()
    clusters = components.components(stars, "hub", "node")
    members = common.written(
        clusters.withColumnRenamed("label", "cluster").join(classes.select("node", "first_id", "n"), "node"), "members"
    )
    blocks = members.groupBy("cluster").agg(
        F.greatest(
            F.ceil(F.sum("n") / F.lit(BLOCK_ELEMENTS)), F.ceil(F.count(F.lit(1)) / F.lit(BLOCK_NODES))
        ).cast("int").alias("blocks")
    )
    none = F.lit(-(1 << 63)).cast("long")
    wanted = members.join(blocks, "cluster").select(
        F.col("node").alias("wanted"), "cluster", "blocks", F.coalesce("first_id", none).alias("first_id")
    )
    texts = wanted.join(
        src.select(F.coalesce("doc_id", none).alias("first_id"), "text"), "first_id"
    ).select("wanted", "cluster", "blocks", "text")

    @common.released
    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.portions(batch, PORTION):
                flat, sizes = shingle_sets(part.column(3), shingle)
                sets = np.split(flat, np.cumsum(sizes)[:-1])
                found = part.set_column(3, "elements", pa.array([s.tobytes() for s in sets], pa.binary()))
                # another text may have the identifier of the wanted one
                yield found.filter(
                    pa.array([fingerprint(s) == w for s, w in zip(sets, part.column(0).to_pylist(), strict=True)])
                )

    sets = texts.mapInArrow(full_sets, "wanted binary, cluster binary, blocks int, elements binary")
    own = F.pmod(F.xxhash64("wanted"), F.col("blocks")).cast("int")
    met = sets.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = met.select(
        F.col("wanted").alias("node"),
        "elements",
        (F.col("blocks") == 1).alias("whole"),
        "cluster",
        F.least("own", "other").alias("low"),
        F.greatest("own", "other").alias("high"),
    )
    at = ["cluster", "low", "high"]
    sorted_rows = dealt.repartition(common.partitions(spark), *at).sortWithinPartitions(*at, "node")
    confirmed = common.written(
        sorted_rows.mapInArrow(_confirm(percent), "node binary, label binary, whole boolean"), "confirmed"
    )
    labels = confirmed.where("whole").select("node", "label")
    split = confirmed.where("NOT whole")
    if split.limit(1).count():
        labels = labels.unionByName(
            components.components(split.select("node", "label"), "node", "label")
        )
    named = classes.select("node", "first_id").join(labels, "node", "left").withColumn(
        "label", F.coalesce("label", "node")
    )
    least = named.groupBy("label").agg(F.min("first_id").alias("component_id"))
    known = named.join(least, "label").select("node", "component_id")
    return sketch.select("doc_id", "n_shingles", "node").join(known, "node", "left").select(
        F.col("doc_id").alias(id_col),
        "n_shingles",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        (
            (F.col("n_shingles") == 0) | F.col("doc_id").eqNullSafe(F.col("component_id"))
        ).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that share an identifier stay or go together: they stay if one of them
    is kept.
    """
    kept = near_duplicates(docs, id_col, text_col, **options).where("kept")
    key = common.free_name(docs, "row_key")
    named = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return docs.withColumn(key, named).join(kept.select(named.alias(key)).distinct(), key, "left_semi").drop(key)
