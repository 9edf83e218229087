"""Writers of results."""

from __future__ import annotations

import html
import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddrank.functions.columns import neutralised
from oddrank.sources import shared


def write_result(df: DataFrame, root: str, name: str, run_id: str, unique: list[str]) -> None:
    """One result of a run, partitioned by run and group; refuses null or repeated keys."""
    bad = df.groupBy(*unique).count().where("count > 1").limit(1).count() or df.where(
        " OR ".join(f"{c} IS NULL" for c in unique)
    ).limit(1).count()
    if bad:
        raise ValueError(f"{name}: {unique} must be unique and not null")
    by = ["run_id", *(["group_key"] if "group_key" in df.columns else [])]
    df.withColumn("run_id", F.lit(run_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        *by
    ).parquet(f"{root}/{name}")


def export_csv(df: DataFrame, path: str, bom: bool = False) -> None:
    """CSV whose texts no spreadsheet runs as formulas; nested values as JSON; ``bom`` marks the files as UTF-8 for spreadsheets."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        c = F.to_json(c) if kind.startswith(("array", "struct", "map")) else c
        out.append((neutralised(c) if kind == "string" or "<" in kind else c).alias(name))
    if bom and out:
        first = df.columns[0]
        out[0] = out[0].alias(f"\ufeff{first}")
    df.select(*out).write.mode("overwrite").option("header", True).csv(path)


def digest(df: DataFrame) -> str:
    """The same for the same rows in any order: sum of row hashes, which needs no sort."""
    row = df.agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).alias("s"),
        F.bit_xor(F.xxhash64(F.lit(1), *df.columns)).alias("x"),
    ).first()
    return f"{row['n']}-{row['s'] or 0}-{row['x'] or 0}"


def html_report(title: str, preview: DataFrame, facts: dict, reasons: DataFrame | None = None) -> str:
    """A page with the run's facts, a small preview and the reasons of the first flagged rows (both already limited)."""

    def table(df: DataFrame) -> str:
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape(str(v))}</td>" for v in r) + "</tr>" for r in df.collect())
        return f"<table><tr>{head}</tr>{body}</table>"

    items = "".join(f"<dt>{html.escape(k)}</dt><dd>{html.escape(str(v))}</dd>" for k, v in facts.items())
    told = f"<h2>Reasons</h2>{table(reasons)}" if reasons is not None else ""
    return f"<!DOCTYPE html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><dl>{items}</dl>{table(preview)}{told}"


def json_report(facts: dict, preview: DataFrame) -> str:
    return json.dumps({"facts": facts, "preview": [r.asDict(True) for r in preview.collect()]}, default=str, sort_keys=True)


class NotFound(LookupError):
    """A result or text that isn't there."""


def read_result(spark: SparkSession, root: str, name: str, run_id: str) -> DataFrame:
    """One result of a run."""
    try:
        df = shared.read_keyed(spark, f"{root.rstrip('/')}/results/{name}")
    except AnalysisException as e:
        raise NotFound(f"no {name} under {root}") from e
    return df.where(F.col("run_id") == run_id)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A text as one file in a folder at ``path``, wherever Spark can write."""
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_text(spark: SparkSession, path: str) -> str:
    try:
        row = spark.read.text(path, wholetext=True).first()
    except AnalysisException as e:
        raise NotFound(path) from e
    if row is None:
        raise NotFound(path)
    return row.value.removesuffix("\n")
