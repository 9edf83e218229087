"""Calibration, ensembles, flags and rankings."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddrank.functions import columns as fx
from oddrank.operators import ranks
from oddrank.sources import shared

#: Fit flag rates above this say nothing about a boundary.
UNINFORMATIVE = 0.5
#: Points of a stored calibrator, if its column has more than so many distinct scores; else all are kept.
#: A thinned one is off by one part in ``STORED_POINTS`` at most; it is for new rows only, see :func:`with_own_ranks`.
STORED_POINTS, EXACT_POINTS = 2000, 10_000


def calibrated(df: DataFrame, score: str, alias: str, by: list[str] | None = None) -> DataFrame:
    """Mid-rank percentile of an oddity score in its own column, 0.5 where it is constant."""
    return ranks.with_ranks(df, score, by, {"midrank": alias})


def score_ranks(df: DataFrame, scores: dict[str, str]) -> DataFrame:
    """member, x, below, midrank of each distinct score of each named column.

    One plan for all columns: they are unpivoted and ranked by name.
    """
    pairs = F.array(*[F.struct(F.lit(n).alias("member"), F.col(c).cast("double").alias("x")) for n, c in scores.items()])
    long = df.select(F.explode(pairs).alias("p")).select("p.member", "p.x")
    return ranks.value_ranks(long, "x", ["member"]).select("member", "x", "below", "midrank")


def with_own_ranks(df: DataFrame, scores: dict[str, str], ranked: DataFrame) -> DataFrame:
    """``df`` with the exact mid-ranks ``cal_<name>`` of the columns whose stored points are thinned; ``ranked`` is written :func:`score_ranks`."""
    sizes = ranked.groupBy("member").count().where(F.col("count") > EXACT_POINTS).collect()
    many = {r.member for r in sizes}
    for n, c in scores.items():
        if n in many:
            own = ranked.where(F.col("member") == n).select(F.col("x").alias(c), F.col("midrank").alias(f"cal_{n}"))
            df = df.join(own, c, "left")
    return df


def calibrators(
    df: DataFrame, scores: dict[str, str], points: int = STORED_POINTS, ranked: DataFrame | None = None
) -> dict[str, list[tuple[float, float]]]:
    """(score, mid-rank) points of each named score column; over ``EXACT_POINTS`` of them are thinned to about ``points`` by rank.

    ``ranked`` has :func:`score_ranks` that are known already.
    """
    ranked = score_ranks(df, scores) if ranked is None else ranked
    sizes = ranked.groupBy("member").agg((F.count(F.lit(1)) > EXACT_POINTS).alias("thin"))
    cell = F.when(F.col("thin"), F.floor(F.col("midrank") * points)).otherwise(F.col("below"))
    thinned = (
        ranked.join(F.broadcast(sizes), "member").withColumn("cell", cell)
        .groupBy("member", "cell")
        .agg(F.max_by(F.struct("x", "midrank"), "x").alias("p"))
        .select("member", "p.*")
    )
    out: dict[str, list[tuple[float, float]]] = {n: [] for n in scores}
    for r in thinned.collect():
        out[r.member].append((r.x, r.midrank))
    return {n: sorted(p) for n, p in out.items()}


def check_members(names: list[str], how: str, weights: dict[str, float] | None = None) -> None:
    """Refuse an ensemble that can't be combined: no member, an unknown way, negative or only zero weights."""
    if not names or len(set(names)) < len(names):
        raise ValueError("an ensemble needs members of different names")
    if how not in ("intersection", "union", "composite"):
        raise ValueError(f"no combination {how!r}")
    if weights is not None:
        own = [weights.get(n, 0.0) for n in names]
        if any(w < 0 or w != w for w in own) or not sum(own):
            raise ValueError("manual weights are 0 or more, and one of them is above 0")


def calibrate_against(score: Column, points: list[tuple[float, float]]) -> Column:
    """Mid-rank of new scores among stored points: the highest point that isn't above."""
    if not points:
        return F.lit(0.5)
    if len(points) == 1:
        return F.when(score == points[0][0], 0.5).when(score > points[0][0], 1.0).otherwise(0.0)
    xs, ys = np.array([x for x, _ in points], float), np.array([0.0, *[y for _, y in points]], float)

    @F.pandas_udf("double")
    def at(s: pd.Series) -> pd.Series:
        below = np.where(s.isna(), 0, np.searchsorted(xs, s.to_numpy(float), "right"))
        return pd.Series(ys[below])

    return at(score)


def combined(cols: list[str], how: str, weights: list[float] | None = None) -> Column:
    """intersection: row median; union: row maximum; composite: weighted mean."""
    cs = [F.col(c) for c in cols]
    if how == "intersection":
        return fx.row_median(cs)
    if how == "union":
        return fx.row_max(cs)
    return fx.row_mean(cs, weights)


def vote(flags: list[Column], how: str, rates: list[float] | None = None) -> Column:
    """Natural flags: all (intersection) or any (union) of the detectors that don't abstain."""
    voting = [f for f, r in zip(flags, rates or [0.0] * len(flags), strict=True) if r <= UNINFORMATIVE]
    if not voting:
        return F.lit(False)
    return fx.every(voting) if how == "intersection" else fx.some(voting)


def spearman_matrix(df: DataFrame, cols: list[str], row_id: str) -> tuple[DataFrame, list[str]]:
    """``df`` with average-tie rank columns, and their names."""
    names = []
    for c in cols:
        df = ranks.with_ranks(df, c, None, {"average_rank": f"{c}__rank"})
        names.append(f"{c}__rank")
    return df, names


def agreement_weights(df: DataFrame, cols: list[str], row_id: str) -> list[float]:
    """Weight of each detector: its rank correlation with the mean rank of the others, floored at 0."""
    k = len(cols)
    if k == 1:
        return [1.0]
    ranked, names = spearman_matrix(df, cols, row_id)
    exprs = []
    for i, n in enumerate(names):
        rest = [F.col(m) for j, m in enumerate(names) if j != i]
        exprs.append(fx.correlation(F.col(n), fx.row_mean(rest)).alias(f"w{i}"))
    row = ranked.agg(*exprs).first()
    w = [max(row[f"w{i}"] or 0.0, 0.0) if row[f"w{i}"] == row[f"w{i}"] else 0.0 for i in range(k)]
    return [x / sum(w) for x in w] if sum(w) else [1 / k] * k


def bad_members(df: DataFrame, cols: list[str], row_id: str, floor: float = -0.15) -> list[str]:
    """Detectors that rank against the median rank of the others; never more than all but two."""
    if len(cols) < 3:
        return []
    ranked, names = spearman_matrix(df, cols, row_id)
    exprs = [
        fx.correlation(F.col(n), fx.row_median([F.col(m) for m in names if m != n])).alias(c)
        for c, n in zip(cols, names, strict=True)
    ]
    row = ranked.agg(*exprs).first()
    bad = [c for c in cols if row[c] is not None and row[c] < floor]
    return bad if len(bad) <= len(cols) - 2 else []


def exact_k(
    df: DataFrame, score: str, row_id: str, rate: float, by: list[str] | None = None, alias: str = "flagged", fresh: bool = True
) -> DataFrame:
    """Exactly round-half-even(rows x rate) flags in each group: highest score first, then lowest id.

    Without groups the lowest flagged score is found from counts of values, and
    among the rows tied with it the highest flagged id; both are two numbers in
    the plan, so no row is joined or numbered. The rows are written first: what
    is compared with those numbers must be what they were taken from
    (``fresh=False``: ``df`` is read from a table already).
    """
    by = by or []
    if by:
        sizes = df.groupBy(*by).agg(F.bround(F.count(F.lit(1)) * F.lit(rate)).alias("__k"))
        placed = ranks.numbered(df, by, [F.desc(score), F.col(row_id)], "__r")
        return ranks.with_group(placed, sizes, by).withColumn(alias, F.col("__r") <= F.col("__k")).select(*df.columns, alias)
    df = shared.written(df, "scored") if fresh else df
    row = df.agg(F.count(score).alias("n"), F.bround(F.count(F.lit(1)) * F.lit(rate)).alias("k")).first()
    n, k = row["n"], int(row["k"])
    if not k or not n:
        return df.withColumn(alias, F.lit(False))
    lowest, below = ranks.value_at(df, score, max(n - k, 0))
    tied = df.where(F.col(score) == F.lit(lowest))
    same = tied.count()
    left = k - (n - below - same)  # flags for the tied rows
    flag = F.col(score) >= F.lit(lowest)
    if left < same:
        last, _ = ranks.value_at(tied, row_id, left - 1)
        flag = (F.col(score) > F.lit(lowest)) | ((F.col(score) == F.lit(lowest)) & (F.col(row_id) <= F.lit(last)))
    return df.withColumn(alias, F.coalesce(flag, F.lit(False)))


def flag_ranks(df: DataFrame, score: str, row_id: str, by: list[str], flag: str = "flagged", alias: str = "flag_rank") -> DataFrame:
    """1..m in the flagged rows of each group, 0 for the others."""
    ranked = ranks.numbered(df.where(F.col(flag)), by, [F.desc(score), F.col(row_id)], alias)
    rest = df.where(~F.coalesce(F.col(flag), F.lit(False))).withColumn(alias, F.lit(0).cast("long"))
    return ranked.unionByName(rest)


def preview(df: DataFrame, score: str, row_id: str, by: list[str], top: int = 20) -> DataFrame:
    """The ``top`` rows of each group, flagged or not."""
    w = Window.partitionBy(*by).orderBy(F.desc(score), row_id)
    return df.withColumn("position", F.row_number().over(w)).where(F.col("position") <= top)


def auto_cut(df: DataFrame, score: str, flags: list[str]) -> float:
    """Composite threshold: the quantile at the median natural flag rate, kept in 0.001..0.5."""
    row = df.agg(*[F.avg(F.col(f).cast("double")).alias(f) for f in flags]).first()
    rates = sorted(row[f] or 0.0 for f in flags)
    k = len(rates)
    rate = min(0.5, max(0.001, (rates[(k - 1) // 2] + rates[k // 2]) / 2))
    return ranks.quantile(df, score, 1 - rate)
