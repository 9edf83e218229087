"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from oddrank.sources.shared import new_path, shared_root, written  # noqa: F401  the operators' shared folder

#: Target bytes of text in one group handed to Python, and the most that it grows to.
CHUNK_BYTES, MOST_CHUNK_BYTES = 8 << 20, 16 << 20
#: Groups beyond which they grow: what groups tell each other is cut up by their number.
MANY_CHUNKS = 1 << 16

MASK64 = (1 << 64) - 1


def remove(*tables: DataFrame) -> None:
    """Delete tables that :func:`written` made and that nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        for file in df.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
            fs.delete(path, True)


def free_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores put before it until no column has it."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def chunk_count(docs: DataFrame, text: str, target: int = CHUNK_BYTES) -> int:
    """How many groups of about ``target`` bytes of text the table makes.

    One narrow aggregate over the text column; at least the number of shuffle
    partitions so that all cores have work. Beyond ``MANY_CHUNKS`` of them the
    target doubles, up to ``MOST_CHUNK_BYTES``.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    while size > MANY_CHUNKS * target and 2 * target <= MOST_CHUNK_BYTES:
        target *= 2
    return max(partitions(docs.sparkSession), -(-int(size) // target))


def chunk_of(key: Column, chunks: int) -> Column:
    """Group of a document: by the hash of its identifier."""
    return F.pmod(F.xxhash64(key), F.lit(chunks)).cast("int")


def portions(batch: pa.RecordBatch, size: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``size`` bytes each."""
    step = max(1, int(size * batch.num_rows // max(batch.nbytes, 1)))
    for at in range(0, batch.num_rows, step):
        yield batch.slice(at, step)


def released(work):
    """A function for ``mapInArrow`` that gives its worker's free memory back when a task ends.

    Workers are reused from stage to stage; without this each keeps the most that
    any stage before took.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from work(batches)
        finally:
            release()

    return run


def release() -> None:
    """Hand memory that Python and Arrow hold but don't use back to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 (fixed published constants), element by element."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
