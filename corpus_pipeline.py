"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; all but
the last return the columns of ``documents``.

Defined cases, in every stage: an empty table gives an empty one; a null text
counts as empty; rows with a null identifier are read like all others; texts of
any length are read whole; columns beside doc_id and text are carried along,
whatever their names, and are never looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from oddrank.llm import common, decontamination, exact_dedup, minhash_dedup, packing, quality


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the operator's threshold.

    Repeated rows share their score and stay or go together; an empty text has
    the score of the model's bias. Without labels of both kinds there is nothing
    to tell good from poor by, and every document stays.
    """
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs, model) if model.learned else docs


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest identifier, a null one only where there is no other.

    Rows that repeat text and identifier are reduced to one; all empty texts are one text.
    """
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shares 0.8 of its five-word shingles: the smallest identifier.

    Texts without words stay. Rows that share an identifier stay or go together.
    """
    return minhash_dedup.drop_near_copies(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item; empty items and texts match nothing, with no benchmark all stay."""
    return decontamination.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of training sequences with their token ids; an empty text is its end id alone, repeated rows are packed each."""
    return packing.pack(docs)


STAGES = [
    ("quality", keep_quality),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("packing", pack_sequences),
]

#: A learned score and token ids have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = common.written(stage(spark, docs, sf_dir), name)
    return docs
