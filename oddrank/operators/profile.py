"""Column profiles and the classification that follows from them."""

from __future__ import annotations

import fnmatch
import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from oddrank.functions import columns as fx

NUMERIC = ("tinyint", "smallint", "int", "bigint", "float", "double")
TEMPORAL = ("date", "timestamp", "timestamp_ntz")
DROP = {"ignored", "empty", "constant", "near_constant", "identifier_like", "free_text", "unsupported"}
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.IGNORECASE)
_HEX = re.compile(r"[0-9a-f]{16,}", re.IGNORECASE)


@dataclass
class ProfilingConfig:
    null_ratio_drop: float = 0.70
    null_ratio_flag: float = 0.0
    near_constant_distinct: int = 2
    identifier_cardinality_ratio: float = 0.90
    free_text_mean_length: float = 20.0
    identifier_detection: str = "conservative"
    one_hot_max_cardinality: int = 20
    ignore: tuple[str, ...] = ()
    include_only: tuple[str, ...] = ()
    protected: tuple[str, ...] = ()
    examples: int = 50


@dataclass
class ColumnProfile:
    name: str
    data_type: str
    rows: int
    nulls: int
    n_unique: int
    minimum: object = None
    maximum: object = None
    mean: float | None = None
    std: float | None = None
    mean_length: float | None = None
    examples: list[str] = field(default_factory=list)

    @property
    def null_ratio(self) -> float:
        return self.nulls / self.rows if self.rows else 0.0

    @property
    def cardinality_ratio(self) -> float:
        return self.n_unique / self.rows if self.rows else 0.0


def flattened(df: DataFrame, depth: int = 5) -> DataFrame:
    """Struct columns become ``parent_child`` columns, level by level; clashing names are an error."""
    for _ in range(depth):
        structs = {f.name for f in df.schema.fields if isinstance(f.dataType, T.StructType)}
        if not structs:
            break
        cols = []
        for f in df.schema.fields:
            if f.name in structs:
                cols += [F.col(f"`{f.name}`.`{g.name}`").alias(f"{f.name}_{g.name}") for g in f.dataType.fields]
            else:
                cols.append(F.col(f"`{f.name}`"))
        df = df.select(*cols)
        if len({c.lower() for c in df.columns}) < len(df.columns):
            raise ValueError("flattening makes two columns of one name")
    return df


def cleaned(df: DataFrame) -> DataFrame:
    """NaN becomes null; day-time intervals become whole seconds."""
    out = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind.startswith("interval day"):
            c = (F.unix_micros(F.timestamp_seconds(F.lit(0)) + c) / 1_000_000).cast("long")
        out.append(fx.missing_to_null(c, kind).alias(name))
    return df.select(*out)


def profile_frame(df: DataFrame) -> DataFrame:
    """One row for each column: column_name, n_rows, null_count, n_unique, mean, std.

    Plain aggregates take one pass. Distinct counts take another over the
    unpivoted values, so that many columns don't multiply the rows of one
    aggregation.
    """
    df = cleaned(df)
    kinds = dict(df.dtypes)
    numbers = [c for c in df.columns if kinds[c] in NUMERIC]
    stats = df.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(F.col(c).isNull().cast("long")).alias(f"{c}|nulls") for c in df.columns],
        *[F.avg(c).alias(f"{c}|mean") for c in numbers],
        *[F.stddev_samp(c).alias(f"{c}|std") for c in numbers],
    )
    entries = [
        F.struct(
            F.lit(c).alias("column_name"),
            F.col("n").alias("n_rows"),
            F.coalesce(f"{c}|nulls", F.lit(0)).alias("null_count"),
            (F.col(f"{c}|mean") if c in numbers else F.lit(None).cast("double")).alias("mean"),
            (F.col(f"{c}|std") if c in numbers else F.lit(None).cast("double")).alias("std"),
        )
        for c in df.columns
    ]
    wide = stats.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return wide.join(distinct_counts(df), "column_name", "left").withColumn(
        "n_unique", F.coalesce("n_unique", F.lit(0))
    )


def distinct_counts(df: DataFrame) -> DataFrame:
    values = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in df.columns])
    long = df.select(F.explode(values).alias("e")).select("e.*").where("v IS NOT NULL")
    return long.groupBy("column_name", "v").agg(F.lit(1).alias("one")).groupBy("column_name").agg(
        F.sum("one").cast("long").alias("n_unique")
    )


def profile(df: DataFrame, cfg: ProfilingConfig | None = None) -> list[ColumnProfile]:
    """Profiles of all columns on the driver: a row for each column, and a few examples of texts."""
    cfg = cfg or ProfilingConfig()
    df = cleaned(df)
    kinds = dict(df.dtypes)
    found = {r.column_name: r for r in profile_frame(df).collect()}
    ordered = [c for c in df.columns if kinds[c] in (*NUMERIC, *TEMPORAL)]
    texts = [c for c in df.columns if kinds[c] == "string"]
    exprs = [F.struct(F.min(c), F.max(c)).alias(f"{c}|r") for c in ordered]
    exprs += [F.avg(F.char_length(c)).alias(f"{c}|l") for c in texts]
    more = df.agg(*exprs).first() if exprs else {}
    out = []
    for c in df.columns:
        r = found[c]
        p = ColumnProfile(c, kinds[c], r.n_rows, r.null_count, r.n_unique, mean=r["mean"], std=r["std"])
        if c in ordered:
            p.minimum, p.maximum = more[f"{c}|r"]
        if c in texts:
            p.mean_length = more[f"{c}|l"]
            if p.cardinality_ratio > cfg.identifier_cardinality_ratio:
                p.examples = [x[0] for x in df.where(F.col(c).isNotNull()).select(c).limit(cfg.examples).collect()]
        out.append(p)
    return out


def selected(name: str, kind: str, patterns: tuple[str, ...]) -> bool:
    """Whether a glob, or ``type:<type> <glob>``, names the column."""
    for p in patterns:
        if p.startswith("type:"):
            wanted, _, glob = p[5:].partition(" ")
            if kind == wanted and fnmatch.fnmatchcase(name, glob or "*"):
                return True
        elif fnmatch.fnmatchcase(name, p):
            return True
    return False


def classify(p: ColumnProfile, cfg: ProfilingConfig) -> tuple[str, str]:
    """(class, reason): the first rule that holds."""
    if p.name in cfg.protected[:1] and p.name.startswith("__"):
        return "ignored", "row identity"
    if p.name not in cfg.protected:
        if selected(p.name, p.data_type, cfg.ignore):
            return "ignored", "named by ignore"
        if cfg.include_only and not selected(p.name, p.data_type, cfg.include_only):
            return "ignored", "not named by include_only"
    if p.nulls == p.rows:
        return "empty", "no value"
    if p.n_unique == 1:
        return "constant", "one value"
    if p.data_type == "boolean":
        return "boolean", "boolean type"
    if p.data_type in TEMPORAL:
        return "temporal", "temporal type"
    if 2 < p.n_unique <= cfg.near_constant_distinct:
        return "near_constant", "few values"
    if p.null_ratio > cfg.null_ratio_drop:
        return "high_null", "mostly missing"
    if p.data_type in NUMERIC:
        return ("identifier_like", "numbers its rows") if _numbers_rows(p, cfg) else ("numeric", "numeric type")
    if p.data_type.startswith("array"):
        return "array_derived", "array type"
    if p.data_type != "string":
        return "unsupported", f"type {p.data_type}"
    if p.cardinality_ratio > cfg.identifier_cardinality_ratio and p.examples:
        for pattern, name in ((_UUID, "UUIDs"), (_HEX, "hexadecimal digests")):
            if all(pattern.fullmatch(x) for x in p.examples):
                return "identifier_like", name
    if (p.mean_length or 0) > cfg.free_text_mean_length:
        return "free_text", "long texts"
    return "categorical", "short texts"


def _numbers_rows(p: ColumnProfile, cfg: ProfilingConfig) -> bool:
    if cfg.identifier_detection == "off":
        return False
    if cfg.identifier_detection == "aggressive":
        return p.cardinality_ratio > cfg.identifier_cardinality_ratio
    if p.nulls or p.rows < 20 or p.n_unique != p.rows:
        return False
    lo, hi = float(p.minimum), float(p.maximum)
    return lo.is_integer() and hi.is_integer() and hi - lo + 1 == p.n_unique


def treatment(kind: str, p: ColumnProfile, cfg: ProfilingConfig) -> str:
    if kind in DROP:
        return "drop"
    if kind == "categorical":
        return "one_hot" if p.n_unique <= cfg.one_hot_max_cardinality else "frequency"
    return {
        "boolean": "cast_int",
        "temporal": "derive_time",
        "high_null": "indicator_only",
        "numeric": "impute_median",
        "array_derived": "derive_array",
    }[kind]


def duplicate_ids(df: DataFrame, by: list[str]) -> DataFrame:
    """Keys that occur more than once, with their number."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
