"""Feature encoding, scaling and width control, as one projection each.

Everything that is learned (medians, categories, frequencies, centres and
spreads) is fitted by a handful of aggregates and then written into the
projection as literals, or joined where it is too long for that.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrank.functions import columns as fx
from oddrank.operators import ranks

TIME_PARTS = {
    "hour": F.hour,
    "dayofweek": fx.iso_weekday,
    "day": F.dayofmonth,
    "month": F.month,
    "year": F.year,
    "quarter": F.quarter,
}
#: Values of a frequency encoding that are written into the projection, where a map
#: is searched one by one; more are joined.
MAP_VALUES = 200
TINY_SPREAD = 1e-12
#: Pairs of columns that are correlated by expressions.
FEW_PAIRS = 30


@dataclass
class Encoding:
    """How one column becomes features; ``params`` hold what was fitted."""

    column: str
    treatment: str
    params: dict = field(default_factory=dict)
    indicator: bool = False

    def features(self) -> list[tuple[str, Column]]:
        c, name, out = F.col(f"`{self.column}`"), self.column, []
        kind, p = self.treatment, self.params
        if kind == "impute_median":
            out.append((name, F.coalesce(c.cast("double"), F.lit(float(p["median"])))))
        elif kind == "cast_int":
            out.append((name, F.coalesce(c.cast("int"), F.lit(0)).cast("double")))
        elif kind == "one_hot":
            cats = p["categories"]
            taken = Counter()
            for v in cats:
                out.append((unused(f"{name}_{v}", taken), F.coalesce((c == F.lit(v)).cast("double"), F.lit(0.0))))
            other = F.coalesce((c.isNotNull() & ~c.isin(cats)).cast("double"), F.lit(0.0))
            out.append((unused(f"{name}__other", taken), other))
        elif kind == "frequency" and len(p["frequencies"]) > MAP_VALUES:
            out.append((f"{name}__freq", F.coalesce(F.col(f"`{self.share}`"), F.lit(0.0))))
        elif kind == "frequency":
            freq = p["frequencies"]
            pairs = [x for kv in freq.items() for x in (F.lit(kv[0]), F.lit(float(kv[1])))]
            found = F.try_element_at(F.create_map(*pairs), c) if pairs else F.lit(None).cast("double")
            out.append((f"{name}__freq", F.coalesce(found, F.lit(0.0))))
        elif kind == "derive_time":
            for part in p["parts"]:
                out.append((f"{name}_{part}", TIME_PARTS[part](c).cast("double")))
        elif kind == "derive_array":
            out += array_features(name, c, p.get("numeric", True))
        if self.indicator or kind == "indicator_only":
            out.append((f"{name}__is_missing", c.isNull().cast("double")))
        return out

    @property
    def share(self) -> str:
        """Column that :func:`with_stored_frequency` joins."""
        return f"__share_{self.column}"


def unused(name: str, taken: Counter) -> str:
    """A name that is not taken yet: ``name``, ``name__1``, ``name__2`` ..."""
    taken[name] += 1
    return name if taken[name] == 1 else f"{name}__{taken[name] - 1}"


def array_features(name: str, c: Column, numeric: bool = True) -> list[tuple[str, Column]]:
    size = F.when(c.isNull(), 0).otherwise(F.size(c))
    out = [
        (f"{name}__len", size.cast("double")),
        (f"{name}__is_null", c.isNull().cast("double")),
        (f"{name}__is_empty", F.coalesce((F.size(c) == 0) & c.isNotNull(), F.lit(False)).cast("double")),
    ]
    if numeric:
        values = F.transform(F.array_compact(c), lambda x: x.cast("double"))
        total = F.aggregate(values, F.lit(0.0), lambda a, x: a + x)
        out += [
            (f"{name}__mean", total / F.nullif(F.size(values), F.lit(0))),
            (f"{name}__min", F.array_min(values)),
            (f"{name}__max", F.array_max(values)),
        ]
    return out


def medians(df: DataFrame, cols: list[str]) -> dict[str, float]:
    """Exact medians of all columns in one plan; None for a column without values."""
    found = _quantiles(df, cols, [0.5])
    return {c: found[c][0] if c in found else None for c in cols}


def _quantiles(df: DataFrame, cols: list[str], shares: list[float], nearest: bool = False) -> dict[str, list[float]]:
    """Quantiles of each column: the columns are unpivoted, so one row a column reaches the driver."""
    if not cols:
        return {}
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"`{c}`").cast("double").alias("x")) for c in cols])
    long = df.select(F.explode(pairs).alias("p")).select("p.*")
    return {r.feature: list(r.q) for r in ranks.quantiles(long, "x", ["feature"], shares, nearest).collect()}


def categories(df: DataFrame, column: str) -> list:
    return df.where(F.col(column).isNotNull()).agg(F.sort_array(F.collect_set(column)).alias("v")).first()["v"]


def frequencies(df: DataFrame, column: str) -> DataFrame:
    """Share of each value; the denominator counts missing values too."""
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    return counts.crossJoin(F.broadcast(total)).select(column, (F.col("n") / F.col("rows")).alias("frequency"))


def with_frequency(df: DataFrame, column: str, alias: str) -> DataFrame:
    """Frequency encoding by a join: for columns of any cardinality; unseen and null give 0."""
    shares = frequencies(df, column).withColumnRenamed("frequency", alias)
    return df.join(shares, column, "left").withColumn(alias, F.coalesce(alias, F.lit(0.0)))


def with_stored_frequency(df: DataFrame, e: Encoding) -> DataFrame:
    """The column's shares joined from the plan's map, if that is too long for a projection."""
    freq = e.params.get("frequencies", {}) if e.treatment == "frequency" else {}
    if len(freq) <= MAP_VALUES:
        return df
    key = f"__value_{e.column}"
    held = pa.table({key: pa.array(freq.keys(), pa.string()), e.share: pa.array(map(float, freq.values()), pa.float64())})
    shares = df.sparkSession.createDataFrame(held)
    return df.join(shares, F.col(f"`{e.column}`") == F.col(f"`{key}`"), "left").drop(key)


def demoted(widths: dict[str, int], limit: int) -> list[str]:
    """One-hot columns to encode by frequency instead: widest first, ties by order, until it fits."""
    order = sorted(widths, key=lambda c: -widths[c])
    total, out = sum(widths.values()), []
    for c in order:
        if total <= limit:
            break
        total -= widths[c] - 1
        out.append(c)
    return out


# --- scaling -----------------------------------------------------------------


def robust_parameters(df: DataFrame, cols: list[str], nearest: bool = False) -> dict[str, tuple[float, float]]:
    """Median and interquartile range of each column; a spread of about zero counts as 1."""
    found = _quantiles(df, cols, [0.25, 0.5, 0.75], nearest)
    out = {}
    for c in cols:
        q = found.get(c, [0.0, 0.0, 0.0])
        spread = q[2] - q[0]
        out[c] = (q[1], spread if spread > TINY_SPREAD else 1.0)
    return out


def standard_parameters(df: DataFrame, cols: list[str]) -> dict[str, tuple[float, float]]:
    """Mean and sample deviation of values clipped to the 1st and 99th percentile."""
    if not cols:
        return {}
    edges = _quantiles(df, cols, [0.01, 0.99])
    clipped = {c: F.least(F.greatest(F.col(f"`{c}`"), F.lit(edges[c][0])), F.lit(edges[c][1])) for c in cols if c in edges}
    if not clipped:
        return dict.fromkeys(cols, (0.0, 1.0))
    row = df.agg(*[F.struct(F.avg(e), F.stddev_samp(e)).alias(c) for c, e in clipped.items()]).first()
    out = {}
    for c in cols:
        mean, std = row[c] if c in clipped else (0.0, 1.0)
        out[c] = (mean or 0.0, std if std and std > TINY_SPREAD else 1.0)
    return out


def scaled(c: Column, centre: float, spread: float) -> Column:
    """Missing values sit at the centre."""
    return (F.coalesce(c, F.lit(float(centre))) - F.lit(float(centre))) / F.lit(float(spread))


def dummy_scale(distance: float) -> tuple[float, float]:
    """Two different categories lie ``distance`` apart."""
    return 0.0, math.sqrt(2) / distance


# --- correlation -------------------------------------------------------------


def moments(df: DataFrame, cols: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows that have both, covariance, variance of the first over these rows) of all pairs of columns.

    Every task sums products of its rows, shifted by the columns' means, so that
    what is summed in the end is one number for each pair and task.
    """
    means = df.agg(*[F.coalesce(F.avg(F.col(f"`{c}`").cast("double")), F.lit(0.0)).alias(str(i)) for i, c in enumerate(cols)]).first()
    centre, k = np.array([means[str(i)] for i in range(len(cols))]), len(cols)

    def run(batches):
        import pandas as pd

        total = np.zeros((5, k, k))
        for pdf in batches:
            x = pdf.to_numpy(float) - centre
            there = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x)
            total += np.stack([there.T @ there, x.T @ there, there.T @ x, (x * x).T @ there, x.T @ x])
        yield pd.DataFrame({"at": np.arange(total.size), "v": total.ravel()})

    src = df.select(*[F.col(f"`{c}`").cast("double").alias(str(i)) for i, c in enumerate(cols)])
    sums = np.zeros(5 * k * k)
    for r in src.mapInPandas(run, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).collect():
        sums[r["at"]] = r.v
    n, x, y, xx, xy = sums.reshape(5, k, k)
    safe = np.maximum(n, 1)
    return n, xy / safe - x / safe * (y / safe), xx / safe - (x / safe) ** 2


def correlations(df: DataFrame, cols: list[str]) -> DataFrame:
    """All pairs of columns with their Pearson correlation; null where one side is constant.

    A few pairs are one aggregate; many would make an expression too large to compile.
    """
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1 :]]
    if len(pairs) <= FEW_PAIRS:
        row = df.agg(*[fx.correlation(F.col(f"`{a}`"), F.col(f"`{b}`")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
        entries = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{i}").alias("r")) for i, (a, b) in enumerate(pairs)]
        return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    n, both, own = moments(df, cols)
    rows = []
    for i, a in enumerate(cols):
        for j in range(i + 1, len(cols)):
            spread = math.sqrt(max(own[i, j], 0) * max(own[j, i], 0))
            rows.append((a, cols[j], float(both[i, j] / spread) if spread > 1e-300 and n[i, j] else None))
    return df.sparkSession.createDataFrame(rows, "a string, b string, r double")


def correlation_survivors(pairs: list[tuple[str, str, float]], cols: list[str], threshold: float = 0.95) -> list[str]:
    """First column of each component of pairs with |r| >= threshold, in column order."""
    parent = {c: c for c in cols}

    def find(c: str) -> str:
        while parent[c] != c:
            parent[c] = parent[parent[c]]
            c = parent[c]
        return c

    place = {c: i for i, c in enumerate(cols)}
    for a, b, r in pairs:
        if r is not None and not math.isnan(r) and abs(r) >= threshold:
            x, y = sorted((find(a), find(b)), key=place.__getitem__)
            parent[y] = x
    return [c for c in cols if find(c) == c]
