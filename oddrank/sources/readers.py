"""Readers of the supported file formats, all through Spark's own sources."""

from __future__ import annotations

import hashlib
import re
from pathlib import PurePosixPath
from urllib.parse import urlsplit, urlunsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FORMATS = {
    ".parquet": "parquet", ".csv": "csv", ".tsv": "tsv", ".json": "json", ".jsonl": "jsonl", ".ndjson": "jsonl", ".tsf": "tsf",
    ".orc": "orc",
}
DELIMITERS = (",", ";", "\t", "|")
ROW_ID = "__row_id"


class SourceError(ValueError):
    """A source that can't be read as asked."""


def detect_format(path: str, override: str | None = None) -> str:
    if override:
        return override
    suffixes = [s for s in PurePosixPath(urlsplit(path).path).suffixes if s not in (".gz", ".bz2", ".zst")]
    found = FORMATS.get(suffixes[-1].lower()) if suffixes else None
    if not found:
        raise SourceError(f"no reader for {path}; give a format")
    return found


def read(spark: SparkSession, path: str, fmt: str | None = None) -> DataFrame:
    """The table at ``path``; compression goes by suffix."""
    kind = detect_format(path, fmt)
    if kind in ("parquet", "orc"):
        return spark.read.format(kind).load(path)
    if kind in ("csv", "tsv"):
        sep = "\t" if kind == "tsv" else ","
        guard_delimiter(spark, path, sep)
        guard_encoding(spark, path)
        return spark.read.options(header=True, inferSchema=True, sep=sep, encoding="UTF-8").csv(path)
    if kind == "json":
        return spark.read.option("multiLine", True).json(path)
    if kind == "jsonl":
        return spark.read.json(path)
    if kind == "tsf":
        return read_tsf(spark, path)
    raise SourceError(f"unknown format {kind}")


def guard_delimiter(spark: SparkSession, path: str, sep: str) -> None:
    """Refuse a file whose header and nine of ten first rows agree on another delimiter."""
    lines = [r.value for r in spark.read.text(path).limit(51).collect()]
    if len(lines) < 2 or sep in lines[0]:
        return
    for other in DELIMITERS:
        n = lines[0].count(other)
        if other != sep and n and sum(x.count(other) == n for x in lines[1:]) >= 0.9 * (len(lines) - 1):
            raise SourceError(f"{path} looks separated by {other!r}, not {sep!r}")


def guard_encoding(spark: SparkSession, path: str) -> None:
    """Refuse a file with a line that is no valid UTF-8.

    The lines come as the bytes they are, so the replacement sign is not mistaken
    for a fault where a text has it.
    """
    if spark.read.text(path).where(~F.is_valid_utf8("value")).limit(1).count():
        raise SourceError(f"{path} is not UTF-8")


def read_tsf(spark: SparkSession, path: str) -> DataFrame:
    """Series files: attributes become columns, values ``value_0`` .. padded to the longest."""
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT value LIKE '#%'")
    attributes = [
        r.value.split()[1] for r in lines.where("lower(value) LIKE '@attribute %'").collect()
    ]  # the header is a few lines
    rows = lines.where("NOT value LIKE '@%'").select(F.split("value", ":").alias("p"))
    values = F.split(F.element_at("p", -1), ",")
    parsed = rows.select(
        *[F.element_at("p", i + 1).alias(a) for i, a in enumerate(attributes)],
        F.transform(values, lambda v: F.when(F.trim(v) != "?", F.trim(v)).try_cast("double")).alias("v"),
    )
    longest = parsed.agg(F.max(F.size("v")).alias("n")).first()["n"] or 0
    return parsed.select(*attributes, *[F.get("v", F.lit(i)).alias(f"value_{i}") for i in range(longest)])


def with_row_id(df: DataFrame, order: list[str] | None = None, id_column: str | None = None) -> DataFrame:
    """A dense 0-based identity: the declared key, or the place in a declared order.

    The rows are dealt into ranges of the order and written once, each with its
    place in its range; range sizes are counted on what was written. (Splitters
    of ranges are sampled anew whenever a plan runs, so counting the sizes on
    another branch of the same plan would not fit the places.) Equal rows of the
    order are told apart by a hash of the whole row, so one value that many rows
    share fills no range, and no task sees all rows.
    """
    if ROW_ID in df.columns:
        raise SourceError(f"{ROW_ID} is reserved")
    if id_column:
        return df.withColumn(ROW_ID, F.col(f"`{id_column}`"))
    hashed = [F.to_json(F.struct(f"`{n}`")) if "map<" in t else F.col(f"`{n}`") for n, t in df.dtypes if t != "variant"]
    from oddrank.operators import ranks

    keys = [*[F.col(f"`{c}`") for c in order or []], F.xxhash64(*hashed)]
    return ranks.numbered(df, [], keys, ROW_ID, "row-id").withColumn(ROW_ID, F.col(ROW_ID) - 1)


def head_rows(df: DataFrame, row_id: str, limit: int) -> DataFrame:
    """The ``limit`` rows with the least identity."""
    return df.orderBy(row_id).limit(limit)


def schema_fingerprint(df: DataFrame) -> str:
    text = "|".join(f"{n}:{t}" for n, t in df.dtypes if n != ROW_ID)
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def canonical_uri(uri: str) -> str:
    """Lower-case scheme and host, no default port, no fragment, no credentials."""
    p = urlsplit(uri)
    host = (p.hostname or "").lower()
    port = f":{p.port}" if p.port and (p.scheme.lower(), p.port) not in (("http", 80), ("https", 443)) else ""
    return urlunsplit((p.scheme.lower(), host + port, p.path or "/", p.query, "")) if p.scheme else uri


def redacted_uri(uri: str) -> str:
    return re.sub(r"([?&][^=&]*(?:key|token|secret|sig|password)[^=&]*=)[^&#]*", r"\1***", canonical_uri(uri), flags=re.IGNORECASE)
