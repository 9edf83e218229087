"""Token ids as binary shards with a shared zstandard dictionary.

Documents are put in order of their identifier by sampled range splitters. Each
partition is cut into shards of about ``SHARD_BYTES``; a shard is one binary
value, so documents are found by an offset and decoded one at a time:

    magic  4 bytes  ``OTK1``
    width  u8       bytes of an id, 2 or 4
    hash   8 bytes  first bytes of the SHA-256 of the dictionary (zeros: none)
    count  u32      documents
    index  count x (u32 end of the frame, u32 ids)
    frames          one zstandard frame for each document

All numbers are little-endian. The shards are rows of a Parquet table in the
folder that all executors share, next to the identifiers they hold; the
dictionary is a one-row table beside it. Any store that Spark can write serves.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddrank.llm import common, tokens

MAGIC = b"OTK1"
HEAD = struct.Struct("<4sB8sI")
#: Compressed bytes after which a shard is closed.
SHARD_BYTES = 4 << 20
#: Bytes of texts that are encoded at once, and documents that are read at once.
PORTION, READ_DOCS = 6 << 20, 1024
#: Documents on whose serialized ids the dictionary is trained, its size, and the
#: most bytes of one of them that it sees. The dictionary only affects size.
DICTIONARY_DOCS = 1_000
DICTIONARY_BYTES = 64 << 10
DICTIONARY_SAMPLE_BYTES = 16 << 10
LEVEL = 3

SHARD_SCHEMA = (
    "part int, shard int, n_docs long, n_ids long, dictionary string, least_id long, most_id long, "
    "doc_ids array<long>, payload binary"
)


def serialise(ids: np.ndarray, width: int) -> bytes:
    return ids.astype("<u2" if width == 2 else "<u4").tobytes()


def deserialise(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<u2" if width == 2 else "<u4").astype(np.uint32)


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary for such arrays; empty where there is too little to train on."""
    import zstandard

    if sum(map(len, samples)) < 8 * size or len(samples) < 16:
        return b""
    return zstandard.train_dictionary(size, samples).as_bytes()


class Codec:
    """Compresses and decompresses single documents with one dictionary."""

    def __init__(self, dictionary: bytes, width: int, level: int = LEVEL) -> None:
        import zstandard

        shared = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.width = width
        self.hash = hashlib.sha256(dictionary).digest()[:8] if dictionary else bytes(8)
        self.compress = zstandard.ZstdCompressor(level=level, write_checksum=True, **shared).compress
        self.decompress = zstandard.ZstdDecompressor(**shared).decompress

    def pack(self, arrays: list[tuple[bytes, int]]) -> bytes:
        """A shard of (frame, number of ids) pairs."""
        index = np.empty((len(arrays), 2), "<u4")
        index[:, 0] = np.cumsum([len(f) for f, _ in arrays])
        index[:, 1] = [n for _, n in arrays]
        head = HEAD.pack(MAGIC, self.width, self.hash, len(arrays))
        return b"".join([head, index.tobytes(), *(f for f, _ in arrays)])

    def index(self, shard: bytes) -> tuple[np.ndarray, int]:
        """(frame end, ids) of each document, and where the frames begin."""
        magic, width, used, count = HEAD.unpack_from(shard)
        if magic != MAGIC or width != self.width:
            raise ValueError("not a shard of this format and width")
        if used != self.hash:
            raise ValueError(f"the shard needs dictionary {used.hex()}, given is {self.hash.hex()}")
        return np.frombuffer(shard, "<u4", 2 * count, HEAD.size).reshape(-1, 2), HEAD.size + 8 * count

    def document(self, shard: bytes, at: int) -> np.ndarray:
        """Ids of one document; no other frame is read."""
        index, base = self.index(shard)
        begin = base + (int(index[at - 1, 0]) if at else 0)
        return deserialise(self.decompress(shard[begin : base + int(index[at, 0])]), self.width)

    def documents(self, shard: bytes, first: int, end: int) -> pa.Array:
        """Ids of some documents in a row, each as little-endian uint32 in one binary value."""
        index, base = self.index(shard)
        ends = [base, *(base + index[:, 0].astype(np.int64)).tolist()]
        data = memoryview(shard)
        raws = [self.decompress(data[ends[i] : ends[i + 1]]) for i in range(first, end)]
        ids = deserialise(b"".join(raws), self.width).astype("<u4")
        offsets = np.concatenate([[0], np.cumsum([len(r) for r in raws])]) * 4 // self.width
        if offsets[-1] >= 1 << 31:
            raise ValueError("these documents are more than one Arrow array can hold")
        return pa.Array.from_buffers(pa.binary(), end - first, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(ids)])


def write_store(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: str | None = None,
    end_id: int = 0,
    shard_bytes: int = SHARD_BYTES,
) -> None:
    """Encode every whole text, append ``end_id`` and write ``path``/shards.

    Defined cases: a null or empty text gives the end id alone; documents are in
    ascending order of identifier, a null identifier first, rows that repeat an
    identifier in the order of their texts' hash and then text; none is dropped;
    an empty table gives a store without shards; extra columns are ignored.
    """
    spark = docs.sparkSession
    tokenizer = tokenizer or tokens.default_tokenizer()
    src = docs.select(
        docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text")
    )
    width = 2 if tokens.encoder(tokenizer).size <= 1 << 16 else 4
    trained = train_dictionary(
        [tokens.encoder(tokenizer).ids(t).tobytes()[:DICTIONARY_SAMPLE_BYTES] for t in _sample(src)]
    )
    name = hashlib.sha256(trained).hexdigest() if trained else ""
    spark.createDataFrame([(name, bytearray(trained), width)], "hash string, dictionary binary, width int").coalesce(
        1
    ).write.parquet(f"{path}/dictionary")

    @common.released
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, codec = tokens.encoder(tokenizer), Codec(trained, width)
        part, shard, size = TaskContext.get().partitionId(), 0, 0
        ids: list[int | None] = []
        frames: list[tuple[bytes, int]] = []

        def close() -> pa.RecordBatch:
            met = [i for i in ids if i is not None]
            row = [part, shard, len(frames), sum(n for _, n in frames), name, min(met, default=None), max(met, default=None),
                   list(ids), codec.pack(frames)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row, types, strict=True)], names=names
            )

        for batch in batches:
            for portion in common.portions(batch, PORTION):
                flat, sizes = coder.batch(portion.column(1), end_id)
                raw, ends = memoryview(flat.tobytes()), (np.cumsum(sizes) * width).tolist()
                for doc_id, begin, end in zip(portion.column(0).to_pylist(), [0, *ends[:-1]], ends, strict=True):
                    frame = codec.compress(raw[begin:end])
                    ids.append(doc_id)
                    frames.append((frame, (end - begin) // width))
                    size += len(frame) + 16
                    if size >= shard_bytes:
                        yield close()
                        ids, frames, size, shard = [], [], 0, shard + 1
        if frames:
            yield close()

    names = [c.split()[0] for c in SHARD_SCHEMA.split(", ")]
    types = [pa.int32(), pa.int32(), *[pa.int64()] * 2, pa.string(), *[pa.int64()] * 2, pa.list_(pa.int64()), pa.binary()]
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = src.repartitionByRange(common.partitions(spark), *order)
    ranged.sortWithinPartitions(*order, "text").mapInArrow(encode, SHARD_SCHEMA).write.parquet(f"{path}/shards")


def _sample(src: DataFrame) -> list[str]:
    """About ``DICTIONARY_DOCS`` texts, evenly drawn by hash: no task sends more than its share."""
    share = min(1.0, DICTIONARY_DOCS / max(1, src.count()))
    drawn = F.xxhash64("doc_id", "text") <= F.lit(min(int(share * 2**64) - 2**63, 2**63 - 1))
    texts = src.where(drawn & (F.col("text") != "")).select(F.substring("text", 1, DICTIONARY_SAMPLE_BYTES).alias("t"))
    return [r.t for r in texts.limit(2 * DICTIONARY_DOCS).collect()]


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids) of a store: ``start`` counts the ids before a document.

    ``start`` needs a prefix sum over the shards: within a partition by a window,
    over the partitions, of which the driver knows the number, by another.
    """
    shards, codec = _open(spark, path)
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    within = shards.select("part", "shard", F.coalesce(F.sum("n_ids").over(own), F.lit(0)).alias("within"))
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))  # a row for each partition that was written
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    earlier = totals.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    bases = within.join(earlier, "part").select("part", "shard", (F.col("within") + F.col("earlier")).alias("base"))

    @common.released
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec()
        for batch in batches:
            cols = [batch.column(i).to_pylist() for i in range(3)]
            for base, doc_ids, shard in zip(*cols, strict=True):
                index, _ = own.index(shard)
                starts = base + np.concatenate([[0], np.cumsum(index[:, 1], dtype=np.int64)[:-1]])
                for lo in range(0, len(doc_ids), READ_DOCS):
                    some = slice(lo, lo + READ_DOCS)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(doc_ids[some], pa.int64()),
                            pa.array(starts[some]),
                            own.documents(shard, lo, min(lo + READ_DOCS, len(doc_ids))),
                        ],
                        names=["doc_id", "start", "ids"],
                    )

    joined = shards.join(bases, ["part", "shard"]).select("base", "doc_ids", "payload")
    return joined.mapInArrow(decode, "doc_id long, start long, ids binary")


def read_documents(spark: SparkSession, path: str, wanted: list[int]) -> dict[int, np.ndarray]:
    """Ids of a few documents: only shards whose range of identifiers holds one are opened, only their frames decoded."""
    shards, codec = _open(spark, path)
    near = F.lit(False)
    for i in wanted:
        near |= (F.col("least_id") <= i) & (F.col("most_id") >= i)
    own, found = codec(), {}
    for row in shards.where(near).where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, wanted)))).toLocalIterator():
        for at, doc_id in enumerate(row.doc_ids):
            if doc_id in wanted:
                found[doc_id] = own.document(bytes(row.payload), at)
    return found


def _open(spark: SparkSession, path: str):
    row = spark.read.parquet(f"{path}/dictionary").first()
    dictionary, width = bytes(row.dictionary), row.width
    return spark.read.schema(SHARD_SCHEMA).parquet(f"{path}/shards"), lambda: Codec(dictionary, width)


def store_digest(store: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and CRC-32 of the ids read from a store."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raws = batch.column(2).to_pylist()
            sizes = pa.array([len(r) // 4 for r in raws], pa.int64())
            crcs = pa.array([zlib.crc32(r) for r in raws], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), sizes, crcs], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return store.mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")
