"""Periods, totals, rolling windows, drift and the decomposition of a change."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddrank.functions import columns as fx
from oddrank.operators import ranks

#: Population that stands for "unknown".
UNKNOWN = -1
PSI_FLOOR = 1e-4


def totals(df: DataFrame, ts: str, group: list[str], flag: str, granularity: str = "day", roll_weekend: bool = False) -> DataFrame:
    """Count, population and rate of each group and period."""
    label = fx.period_label(F.col(ts), granularity, roll_weekend).alias("period_label")
    return (
        df.groupBy(*group, label)
        .agg(F.sum(F.col(flag).cast("long")).alias("anomaly_count"), F.count(F.lit(1)).alias("population"))
        .withColumn("rate", F.col("anomaly_count") / F.col("population"))
    )


def expected_days(first: str, last: str, roll_weekend: bool = False):
    """Labels of an inclusive range of days as an array column; weekends left out where they roll back."""
    days = F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))
    if roll_weekend:
        days = F.filter(days, lambda d: F.weekday(d) < 5)
    return F.transform(days, lambda d: F.date_format(d, "yyyy-MM-dd"))


def rolling_windows(
    tot: DataFrame, reference: str, windows: list[int], group: list[str], low_volume: int = 100, min_prior: int = 10,
    basis: str = "self_referenced", granularity: str = "day",
) -> DataFrame:
    """Each window of periods that ends at ``reference`` against the one before it, over the groups that both have.

    All windows come from one pass: a row goes to every window it lies in, and
    groups are matched by an aggregate, not by a join.
    """
    known = tot.where(F.col("population") != UNKNOWN)
    age = periods_between(F.col("period_label"), reference, granularity)
    sizes = F.array(*[F.lit(w) for w in sorted(windows)])
    dealt = known.withColumn("age", age).where("age >= 0").withColumn("window_size", F.explode(sizes)).where("age < 2 * window_size")
    side = F.col("age") < F.col("window_size")
    per_group = dealt.groupBy("window_size", *group).agg(
        F.sum(F.when(side, F.col("anomaly_count")).otherwise(0)).alias("cc"),
        F.sum(F.when(side, F.col("population")).otherwise(0)).alias("cp"),
        F.sum(F.when(~side, F.col("anomaly_count")).otherwise(0)).alias("pc"),
        F.sum(F.when(~side, F.col("population")).otherwise(0)).alias("pp"),
        F.max(side.cast("int")).alias("has_c"),
        F.max((~side).cast("int")).alias("has_p"),
    )
    both = (F.col("has_c") == 1) & (F.col("has_p") == 1)
    w = Window.partitionBy("window_size")
    flagged = per_group.withColumn("any_c", F.max("has_c").over(w)).withColumn("any_p", F.max("has_p").over(w))
    use = both | (F.col("any_c") == 0) | (F.col("any_p") == 0)
    summed = flagged.groupBy("window_size").agg(
        *[F.sum(F.when(use, F.col(c)).otherwise(0)).alias(n) for c, n in (
            ("cc", "current_count"), ("cp", "current_population"), ("pc", "prior_count"), ("pp", "prior_population"))],
        F.sum(both.cast("long")).alias("groups_matched"),
        F.sum((F.col("has_p") == 0).cast("long")).alias("groups_current_only"),
        F.sum((F.col("has_c") == 0).cast("long")).alias("groups_prior_only"),
    )
    cc, cp, pc, pp = (F.col(c) for c in ("current_count", "current_population", "prior_count", "prior_population"))
    c_rate, p_rate = cc / F.nullif(cp, F.lit(0)), pc / F.nullif(pp, F.lit(0))
    (cl, cu), (pl, pu), (dl, du) = fx.wilson(cc, cp), fx.wilson(pc, pp), fx.newcombe(cc, cp, pc, pp)
    change = (c_rate - p_rate) if basis == "self_referenced" else F.lit(None).cast("double")
    return summed.select(
        "*",
        c_rate.alias("current_rate"), p_rate.alias("prior_rate"),
        cl.alias("current_low"), cu.alias("current_high"), pl.alias("prior_low"), pu.alias("prior_high"),
        change.alias("absolute_change"),
        F.when((p_rate > 0) & (pc >= min_prior), change / p_rate).alias("pct_change"),
        F.when(change.isNotNull(), dl).alias("change_low"), F.when(change.isNotNull(), du).alias("change_high"),
        F.when(change.isNotNull(), (dl > 0) | (du < 0)).alias("change_significant"),
        ((cp < low_volume) | ((pp < low_volume) & (F.col("groups_prior_only") + F.col("groups_matched") > 0))).alias("low_volume"),
    )


def periods_between(label: Column, reference: str, granularity: str) -> Column:
    """How many periods a label lies before the reference label."""
    if granularity == "hour":
        at = [F.unix_timestamp(x, "yyyy-MM-dd'T'HH") for x in (F.lit(reference), label)]
        return ((at[0] - at[1]) / 3600).cast("int")
    if granularity == "month":
        year, month = F.substring(label, 1, 4).cast("int"), F.substring(label, 6, 2).cast("int")
        return F.lit(int(reference[:4]) * 12 + int(reference[5:7])) - (year * 12 + month)
    days = F.datediff(F.lit(reference), F.to_date(label))
    return F.floor(days / 7).cast("int") if granularity == "week" else days


def comparability(
    windows: DataFrame, other_configs: bool = False, versions: int = 1, policies: int = 1, incomplete: tuple[bool, bool] = (False, False)
) -> DataFrame:
    """Codes of what stands against comparing a window with the one before it.

    What only the ledger knows is given: whether the span has totals of other
    configurations, how many library versions and policies its runs had, and
    whether periods of the current or the prior window are not complete.
    """
    known = {
        "other_config_in_span": other_configs, "mixed_library_versions": versions > 1, "mixed_ensemble_policies": policies > 1,
        "incomplete_current": incomplete[0], "incomplete_prior": incomplete[1],
    }
    codes = F.array_compact(
        F.array(
            *[F.lit(code) for code, so in known.items() if so],
            F.when(F.col("groups_current_only") + F.col("groups_prior_only") > 0, "group_mix_changed"),
            F.when(F.col("low_volume"), "low_volume"),
            F.when(F.col("prior_population") == 0, "no_prior"),
        )
    )
    return windows.withColumn("comparability", codes)


def pending_periods(expected: DataFrame, complete: DataFrame, forced: list[str]) -> DataFrame:
    """Labels of the range that aren't complete, and the forced ones of it."""
    todo = expected.join(complete.select("period_label").distinct(), "period_label", "left_anti")
    return todo.union(expected.where(F.col("period_label").isin(forced))).distinct() if forced else todo.distinct()


def categorical_psi(base: DataFrame, current: DataFrame, column: str, top: int = 20) -> DataFrame:
    """Stability index of a text column: union of top values, the rest and missing ones; one row."""
    a, b = _shares(base, column, "a", top), _shares(current, column, "b", top)
    names = a.select("v").union(b.select("v")).where("v <> '__missing'").distinct()
    ca, cb = _counts(base, column, names, "a"), _counts(current, column, names, "b")
    joined = ca.join(cb, "v", "full_outer")
    sums = joined.agg(
        F.collect_list(F.struct(F.coalesce("a", F.lit(0)).alias("a"), F.coalesce("b", F.lit(0)).alias("b"))).alias("r"),
        F.sum("a").alias("na"), F.sum("b").alias("nb"),
    )
    p = sums.select(F.explode("r").alias("r"), "na", "nb").select(
        F.greatest(F.col("r.a") / F.col("na"), F.lit(PSI_FLOOR)).alias("p"),
        F.greatest(F.col("r.b") / F.col("nb"), F.lit(PSI_FLOOR)).alias("q"),
    )
    psi = p.agg(F.sum((F.col("q") - F.col("p")) * F.ln(F.col("q") / F.col("p"))).alias("psi"))
    return psi.withColumn("band", psi_band(F.col("psi")))


def _shares(df: DataFrame, column: str, alias: str, top: int) -> DataFrame:
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias(alias))
    return counts.orderBy(F.desc(alias), "v").limit(top)


def _counts(df: DataFrame, column: str, names: DataFrame, alias: str) -> DataFrame:
    known = names.withColumn("named", F.lit(True))
    own = df.select(F.col(column).alias("v")).join(F.broadcast(known), "v", "left")
    cell = F.when(F.col("v").isNull(), "__missing").when(F.col("named"), F.col("v")).otherwise("__other")
    return own.groupBy(cell.alias("v")).agg(F.count(F.lit(1)).alias(alias))


def psi_band(psi):
    return F.when(psi < 0.1, "stable").when(psi < 0.25, "moderate").otherwise("major")


def numeric_summary(df: DataFrame, column: str, by: list[str]) -> DataFrame:
    """n, missing, 101 percentiles, mean and population deviation of a field."""
    plain = df.groupBy(*by).agg(
        F.count(column).alias("n"), F.sum(F.col(column).isNull().cast("long")).alias("missing"), F.avg(column).alias("mean"), F.stddev_pop(column).alias("std")
    )
    q = ranks.quantiles(df.select(*by, F.col(column).cast("double").alias(column)), column, by, [i / 100 for i in range(101)])
    q = q.withColumnRenamed("q", "percentiles")
    joined = ranks.with_group(plain, q, by) if by else plain.crossJoin(F.broadcast(q))
    return joined.select(*by, "n", "missing", "percentiles", "mean", "std")


def share_under(percentiles: list[float], x: float) -> float:
    """Share of values at or under x, by linear interpolation between stored percentiles."""
    p = np.asarray(percentiles)
    lo, hi = np.searchsorted(p, x, "left"), np.searchsorted(p, x, "right")
    if hi > lo:
        return hi / len(p) if hi < len(p) else 1.0
    if lo == 0:
        return 0.0
    if lo == len(p):
        return 1.0
    return float((lo - 1 + (x - p[lo - 1]) / (p[lo] - p[lo - 1])) / (len(p) - 1))


def stability(base: list[float], current: list[float]) -> float:
    """Stability index of two lists of shares; shares under a floor count as the floor."""
    p, q = np.maximum(base, PSI_FLOOR), np.maximum(current, PSI_FLOOR)
    return float(((q - p) * np.log(q / p)).sum())


def numeric_psi(base: list[float], current: list[float], base_n: int, cur_n: int, base_missing: int = 0, cur_missing: int = 0) -> float:
    """Stability index of two fields from their 101 percentiles: baseline deciles and a bin for missing values."""
    edges = sorted({base[i] for i in range(10, 100, 10)})
    shares = []
    for percentiles, n, missing in ((base, base_n, base_missing), (current, cur_n, cur_missing)):
        cdf = [0.0, *[share_under(percentiles, e) for e in edges], 1.0]
        present = n / max(n + missing, 1)
        shares.append([*(present * (b - a) for a, b in zip(cdf, cdf[1:], strict=False)), 1 - present])
    return stability(*shares)


def decomposition(rows: DataFrame, group: list[str]) -> DataFrame:
    """volume + score drift + threshold drift = change of the count, summed over groups on both sides.

    ``rows``: group columns, side ("current"/"prior"), n, own (flags), anchor (flags of the fixed rule).
    """
    side = F.col("side") == "current"
    g = rows.groupBy(*group).agg(
        *[
            F.sum(F.when(side if s == "1" else ~side, F.col(c)).otherwise(0)).cast("double").alias(f"{c}{s}")
            for c in ("n", "own", "anchor")
            for s in ("1", "0")
        ]
    ).where("n1 > 0 AND n0 > 0")
    r1, r0 = F.col("own1") / F.col("n1"), F.col("own0") / F.col("n0")
    s1, s0 = F.col("anchor1") / F.col("n1"), F.col("anchor0") / F.col("n0")
    return g.agg(
        F.sum((F.col("n1") - F.col("n0")) * r0).alias("volume"),
        F.sum(F.col("n1") * (s1 - s0)).alias("score_drift"),
        F.sum(F.col("n1") * ((r1 - s1) - (r0 - s0))).alias("threshold_drift"),
        F.sum(F.col("own1") - F.col("own0")).alias("count_change"),
        F.count(F.lit(1)).alias("groups_used"),
    )


def contrast_ks(df: DataFrame, flag: str, cols: list[str]) -> DataFrame:
    """Kolmogorov-Smirnov distance of flagged and other rows for each numeric column.

    Counts per distinct value, then one window for each column.
    """
    from oddrank.operators.detectors import unpivot

    long = unpivot(df, [flag], cols).where("x IS NOT NULL")
    counts = long.groupBy("feature", "x").agg(
        F.sum(F.col(flag).cast("long")).alias("a"), F.sum((~F.col(flag)).cast("long")).alias("b")
    )
    up_to = {}
    for c in ("a", "b"):
        one = counts.select("feature", "x", F.col(c).alias("n"))
        up_to[c] = ranks.cumulative(one, "x", ["feature"]).select(
            "feature", "x", ((F.col("below") + F.col("n")) / F.nullif(F.col("total"), F.lit(0))).alias(f"F{c}")
        )
    return up_to["a"].join(up_to["b"], ["feature", "x"]).groupBy("feature").agg(
        F.max(F.abs(F.col("Fa") - F.col("Fb"))).alias("contrast_score")
    )


def contrast_tvd(df: DataFrame, flag: str, cols: list[str]) -> DataFrame:
    """Total variation distance of flagged and other rows for each text column."""
    pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("string").alias("v")) for c in cols])
    long = df.select(flag, F.explode(pairs).alias("p")).select(flag, "p.*").where("v IS NOT NULL")
    counts = long.groupBy("feature", "v").agg(
        F.sum(F.col(flag).cast("long")).alias("a"), F.sum((~F.col(flag)).cast("long")).alias("b")
    )
    sums = counts.groupBy("feature").agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    return counts.join(sums, "feature").groupBy("feature").agg(
        (F.sum(F.abs(F.col("a") / F.col("na") - F.col("b") / F.col("nb"))) / 2).alias("contrast_score")
    )
