"""Metrics of a ranking and of a flag against labels, and tests on their differences."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oddrank.functions import columns as fx
from oddrank.operators import ranks


def ranking_metrics(df: DataFrame, score: str, label: str) -> DataFrame:
    """One row: roc_auc (rank sum, ties half) and average_precision (over distinct scores)."""
    counts = df.groupBy(score).agg(
        F.sum(F.col(label).cast("long")).alias("pos"), F.count(F.lit(1)).alias("n")
    )
    low = ranks.cumulative(counts.select(score, "n"), score, []).select(score, "below", "total")
    pos = ranks.cumulative(counts.select(score, F.col("pos").alias("n")), score, []).select(
        score, F.col("below").alias("pos_below"), F.col("total").alias("pos_total")
    )
    joined = counts.join(low, score).join(pos, score)
    negatives_below = F.col("below") - F.col("pos_below")
    auc_part = F.col("pos") * (negatives_below + (F.col("n") - F.col("pos")) / 2)
    found = F.col("pos_total") - F.col("pos_below")
    shown = F.col("total") - F.col("below")
    return joined.agg(
        (F.sum(auc_part) / F.nullif(F.max("pos_total") * (F.max("total") - F.max("pos_total")), F.lit(0))).alias("roc_auc"),
        (F.sum(F.col("pos") * found / shown) / F.nullif(F.max("pos_total"), F.lit(0))).alias("average_precision"),
    )


def at_k(df: DataFrame, score: str, label: str, row_id: str, share: float) -> DataFrame:
    """Precision, recall and F1 of the k = max(1, round(n x share)) top rows; ties by row id."""
    n = df.count()
    k = max(1, round(n * share))
    top = df.orderBy(F.desc(score), row_id).limit(k).agg(F.sum(F.col(label).cast("long")).alias("hit"))
    both = top.crossJoin(df.agg(F.sum(F.col(label).cast("long")).alias("positives")))
    p, r = F.col("hit") / F.lit(k), F.col("hit") / F.nullif(F.col("positives"), F.lit(0))
    return both.select(p.alias("precision_at_k"), r.alias("recall_at_k"),
                       F.coalesce(2 * p * r / F.nullif(p + r, F.lit(0.0)), F.lit(0.0)).alias("f1_at_k"))


def flag_metrics(df: DataFrame, flag: str, label: str) -> DataFrame:
    f, y = F.col(flag).cast("long"), F.col(label).cast("long")
    s = df.agg(
        F.sum(f * y).alias("tp"), F.sum(f * (1 - y)).alias("fp"), F.sum((1 - f) * y).alias("fn"), F.sum((1 - f) * (1 - y)).alias("tn")
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))

    def ratio(a, b):
        return F.coalesce(a / F.nullif(b, F.lit(0)), F.lit(0.0))

    return s.select(
        ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), ratio(fp, fp + tn).alias("false_positive_rate"),
    )


def flag_jaccard(df: DataFrame, a: str, b: str) -> DataFrame:
    """Overlap of two flag sets; 1 where both are empty."""
    both, some = F.sum((F.col(a) & F.col(b)).cast("long")), F.sum((F.col(a) | F.col(b)).cast("long"))
    return df.agg(F.coalesce(both / F.nullif(some, F.lit(0)), F.lit(1.0)).alias("jaccard"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Correlation of average-tie ranks; 0 where one of them is constant."""
    df = ranks.with_ranks(df, a, None, {"average_rank": "__ra"})
    df = ranks.with_ranks(df, b, None, {"average_rank": "__rb"})
    r = fx.correlation(F.col("__ra"), F.col("__rb"))
    return df.agg(F.when(r.isNull() | F.isnan(r), 0.0).otherwise(r).alias("spearman"))


def paired_bootstrap(differences: list[float], resamples: int = 2000, seed: int = 0) -> tuple[float, float, float]:
    """(p value with the +1 correction, low, high) of the mean difference being above 0."""
    d = np.asarray(differences, float)
    rng = np.random.default_rng(seed)
    means = rng.choice(d, (resamples, len(d))).mean(axis=1)
    low, high = np.percentile(means, [2.5, 97.5])
    return float((1 + (means <= 0).sum()) / (resamples + 1)), float(low), float(high)


def holm(p_values: dict[str, float]) -> dict[str, float]:
    """Adjusted p values by step-down: each at least as large as the one before it."""
    out, running, m = {}, 0.0, len(p_values)
    for i, (name, p) in enumerate(sorted(p_values.items(), key=lambda x: (x[1], x[0]))):
        running = max(running, min(1.0, p * (m - i)))
        out[name] = running
    return out


def holm_frame(df: DataFrame, name: str, p: str) -> DataFrame:
    """The same for a table of tests."""
    w = Window.orderBy(p, name)
    n = df.agg(F.count(F.lit(1)).alias("m"))
    step = df.crossJoin(n).withColumn("i", F.row_number().over(w) - 1)
    raw = F.least(F.lit(1.0), F.col(p) * (F.col("m") - F.col("i")))
    return step.select(name, p, F.max(raw).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("adjusted"))


def decision(p: float, low: float, budget: float, alpha: float = 0.05) -> str:
    """adopt: better beyond doubt; reject: worse than the budget allows; keep: neither."""
    if math.isnan(p):
        return "undecided"
    if p < alpha and low > 0:
        return "adopt"
    return "reject" if low < -budget else "keep"


def candidate(rule: str, classes: list[str]) -> dict:
    """What a candidate rule chooses for a plan whose kept columns have these classes.

    ``discrete-composite@1`` averages on tables of categories only;
    ``discrete-budget@1`` keeps the default's ranking there and flags exactly the
    budget's top rows, ``@2`` averages that ranking over five subsamples first.
    """
    discrete = bool(classes) and all(c in ("categorical", "boolean") for c in classes)
    chosen = {"combination": "intersection", "weighting": "equal", "flags": "own", "bags": 1, "data": "discrete" if discrete else "mixed"}
    if rule not in ("discrete-composite@1", "discrete-budget@1", "discrete-budget@2"):
        raise ValueError(f"no candidate rule {rule}")
    if discrete and rule == "discrete-composite@1":
        chosen["combination"] = "composite"
    elif discrete:
        chosen |= {"flags": "top_budget", "bags": 5 if rule.endswith("@2") else 1}
    return chosen


def decide_across(found: dict[str, tuple[list[float], list[float]]], require: str = "any", alpha: float = 0.05, regressions: dict[str, list[str]] | None = None) -> dict:
    """Whether a candidate does better than the baseline over several datasets.

    ``found``: dataset -> paired metrics of candidate and baseline. The tests are
    corrected for their number; ``require`` all or any of them to show it, and
    no dataset may have got worse beyond its bounds (``regressions``).
    """
    tests = {d: paired_bootstrap([a - b for a, b in zip(c, base, strict=True)]) for d, (c, base) in found.items()}
    adjusted = holm({d: t[0] for d, t in tests.items()})
    better = {d: adjusted[d] <= alpha and float(np.mean(found[d][0])) > float(np.mean(found[d][1])) for d in found}
    reasons = [f"{d}: {r}" for d, rs in (regressions or {}).items() for r in rs]
    n = sum(better.values())
    if not (n == len(better) if require == "all" else n > 0):
        reasons.insert(0, f"better on {n} of {len(better)} datasets, {require} required")
    return {"outperforms": not reasons, "improved": better, "adjusted_p": adjusted, "reasons": reasons}


def scenario(kind: str, rows: int = 800, odd: int = 40, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Small planted matrices: point, local, clustered, masking, varying_density."""
    rng = np.random.default_rng(seed)
    normal = rng.normal(0, 1, (rows, 4))
    if kind == "point":
        bad = rng.uniform(-8, -6, (odd, 4))
    elif kind == "clustered":
        bad = rng.normal(-7, 0.1, (odd, 4))
    elif kind == "masking":
        bad = rng.normal(-6, 0.5, (odd * 3, 4))
    elif kind == "local":
        normal = np.concatenate([rng.normal(-4, 0.5, (rows // 2, 4)), rng.normal(4, 0.5, (rows - rows // 2, 4))])
        bad = rng.normal(0, 0.5, (odd, 4))
    elif kind == "varying_density":
        normal = np.concatenate([rng.normal(-4, 0.2, (rows // 2, 4)), rng.normal(4, 2, (rows - rows // 2, 4))])
        bad = rng.normal(-4, 1.0, (odd, 4))
    else:
        raise ValueError(f"no scenario {kind}")
    return np.concatenate([normal, bad]), np.repeat([0, 1], [len(normal), len(bad)])
