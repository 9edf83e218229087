"""Exact deduplication by a content sort, in DataFrame operations only.

Sampled splitters range-partition the normalised texts
(``repartitionByRange``), each partition is sorted externally, and the window
over equal neighbours compares full texts. A text that a large share of all
rows has would fill one range, so the sort key has a second part, a salt drawn
from the identifier: a hot text is spread over ``salts`` sub-ranges, each of
them leaves one summary row, and the summaries of one text (named by the
SHA-256 of the whole text) are merged afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddrank.llm import common

#: Sub-ranges over which the copies of one text are spread at least; more on a
#: cluster with more shuffle partitions.
SALTS = 64

#: Characters of a text in the range key. Splitters are sampled to the driver, so
#: the key is short; the hash behind it parts texts that begin alike.
LEAD = 16


def exact_groups(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=None,
    keep: str = "max",
    salts: int | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    ``normalise`` maps the text column to the compared column (default: as it
    is). ``keep`` is ``"max"`` or ``"min"``: which identifier of a group stays.

    Defined cases: a null text counts as the empty text; texts of any length are
    compared whole; a null identifier is a member of its group but stays only if
    the group has no other; rows that repeat both text and identifier are all
    returned and exactly one of them is marked kept; an empty table gives no
    rows; extra columns of the input are ignored, whatever their names.
    """
    salts = salts or max(SALTS, common.partitions(docs.sparkSession))
    raw = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    src = docs.select(
        docs[id_col].alias("id"),
        (normalise(raw) if normalise else raw).alias("body"),
    ).select(
        "id",
        "body",
        F.substring("body", 1, LEAD).alias("lead"),
        F.xxhash64("body").alias("mark"),
        F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int").alias("salt"),
    )
    ranged = src.repartitionByRange(common.partitions(docs.sparkSession), "lead", "mark", "salt")
    group = Window.partitionBy("lead", "mark", "salt", "body")
    best: Column = F.max("id") if keep == "max" else F.min("id")
    local = ranged.select(
        "id",
        "salt",
        F.row_number().over(group.orderBy("id")).alias("nth"),
        F.lag("id").over(group.orderBy("id")).eqNullSafe(F.col("id")).alias("again"),
        best.over(group).alias("best"),
        F.count(F.lit(1)).over(group).alias("size"),
        F.sha2("body", 256).alias("sha"),
    )
    local = common.written(local, "content-sort")
    heads = local.where("nth = 1").select("sha", "salt", "best", "size")
    merged = heads.groupBy("sha").agg(
        (F.max("best") if keep == "max" else F.min("best")).alias("keep_id"),
        F.sum("size").alias("group_size"),
    )
    spread = heads.select("sha", "salt").join(merged, "sha")
    out = local.join(spread, ["sha", "salt"])
    first = ~F.coalesce(F.col("again") & (F.col("nth") > 1), F.lit(False))
    return out.select(
        F.col("id").alias(id_col),
        "keep_id",
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("id").eqNullSafe(F.col("keep_id")) & first).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Rows that repeat both text and identifier are reduced to one; a null
    identifier cannot be told from another and stays only if its text has no
    other row.
    """
    groups = exact_groups(docs, id_col, text_col, **options).where("kept")
    normalise = options.get("normalise")
    raw = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    sha = F.sha2(normalise(raw) if normalise else raw, 256)
    key = common.free_name(docs, "row_key")
    own = docs.withColumn(key, _row_key(docs[id_col], sha))
    stay = groups.select(_row_key(F.col(id_col), F.col("text_sha256")).alias(key))
    return own.join(stay, key, "left_semi").dropDuplicates([key]).drop(key)


def _row_key(identifier: Column, sha: Column) -> Column:
    return F.concat_ws(":", sha, F.coalesce(identifier.cast("string"), F.lit("null")))
