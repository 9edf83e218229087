"""Ranks and cumulative counts that don't gather a column into one task.

A window over a whole column without partitions runs in one task. Here equal
values are counted first, the distinct values are dealt into slices by sampled
quantiles, each slice is summed by itself, and the slices' few totals are
summed on top. The same path serves one column or many (unpivoted), one group
or many.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from oddrank.sources import shared

#: Bits of ``monotonically_increasing_id`` that number the rows of a partition.
PLACE_BITS = 33
#: Slices of one ordered column.
SLICES = 64


def counted(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Distinct values with their number ``n``."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))


def cumulative(counts: DataFrame, value: str, by: list[str], slices: int = SLICES) -> DataFrame:
    """``below`` (how many are less), ``n`` and ``total`` for each distinct value of each group."""
    shares = [i / slices for i in range(1, slices)]
    cuts = counts.groupBy(*by).agg(
        F.percentile_approx(value, shares, 1000).alias("cuts"), F.sum("n").alias("total")
    )
    # written, since two branches read it: cuts that are sketched twice need not be the same
    dealt = shared.written(
        (counts.join(cuts, by) if by else counts.crossJoin(F.broadcast(cuts))).withColumn(
            "slice", F.size(F.filter("cuts", lambda c: c < F.col(value)))
        ).drop("cuts"),
        "slices",
    )
    before = Window.partitionBy(*by, "slice").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    inside = dealt.withColumn("inside", F.coalesce(F.sum("n").over(before), F.lit(0)))
    sums = dealt.groupBy(*by, "slice").agg(F.sum("n").alias("held"))
    earlier = Window.partitionBy(*by).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*by, "slice", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("offset"))
    joined = inside.join(offsets, [*by, "slice"])
    return joined.select(*by, value, "n", "total", (F.col("inside") + F.col("offset")).alias("below"))


def numbered(df: DataFrame, by: list[str], order: list[Column], alias: str, name: str = "numbered") -> DataFrame:
    """``df`` with each row's place, from 1, in the order of its group; no group gathers in one task.

    All rows are dealt into ranges of (group, order), written with their place in
    their range, and counted range by range; a group's first row gives where it begins.
    """
    keys = [*[F.col(f"`{c}`") for c in by], *order]
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = (df.repartitionByRange(n, *keys) if keys else df).sortWithinPartitions(*keys)
    dealt = shared.written(ranged.withColumn("__place", F.monotonically_increasing_id()), name)
    part = F.shiftright("__place", PLACE_BITS)
    sizes = dealt.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))  # a row for each range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__offset"))
    place = (F.col("__offset") + F.col("__place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1)) + 1).cast("long")
    placed = dealt.withColumn("__part", part).join(F.broadcast(offsets), "__part").withColumn(alias, place).drop("__part", "__place", "__offset")
    if not by:
        return placed
    begins = placed.groupBy(*by).agg((F.min(alias) - 1).alias("__begin"))
    return with_group(placed, begins, by).withColumn(alias, F.col(alias) - F.col("__begin")).select(*df.columns, alias)


def with_group(df: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """``df`` with what is known of each row's group; null is a group like others."""
    own = facts.select(*[F.col(f"`{c}`").alias(f"__by{i}") for i, c in enumerate(by)], *[c for c in facts.columns if c not in by])
    same = [F.col(f"`{c}`").eqNullSafe(F.col(f"__by{i}")) for i, c in enumerate(by)]
    return df.join(own, same, "left").drop(*[f"__by{i}" for i in range(len(by))])


def value_at(df: DataFrame, value: str, place: int) -> tuple[object, int]:
    """The ``place``-th smallest non-null value (from 0) and how many rows are less; one row reaches the driver."""
    ranked = cumulative(counted(df, value, []), value, [])
    row = ranked.where((F.col("below") <= place) & (F.col("below") + F.col("n") > place)).first()
    return (row[value], row["below"]) if row else (None, 0)


def quantiles(df: DataFrame, value: str, by: list[str], shares: list[float], nearest: bool = False) -> DataFrame:
    """``q``: the exact quantiles of each group, interpolated between neighbours as by ``percentile``, or the nearest value.

    From cumulative counts, so no task holds a column's distinct values.
    """
    c = cumulative(counted(df, value, by), value, by)
    last = F.col("total") - 1
    if len(shares) > 8:  # one row for each share that a value answers, instead of an expression for each share
        place = lambda i: (F.bround if nearest else lambda p: p)(last * F.element_at(F.array(*[F.lit(float(s)) for s in shares]), i + 1))
        holds = lambda p: (F.col("below") <= p) & (F.col("below") + F.col("n") > p)
        every = F.sequence(F.lit(0), F.lit(len(shares) - 1))
        met = c.withColumn("i", F.explode(F.filter(every, lambda i: holds(F.floor(place(i))) | holds(F.ceil(place(i))))))
        p = place(F.col("i"))
        ends = met.groupBy(*by, "i").agg(
            F.max(F.when(holds(F.floor(p)), F.col(value))).alias("lo"), F.max(F.when(holds(F.ceil(p)), F.col(value))).alias("hi"), F.max(p - F.floor(p)).alias("part")
        )
        each = F.struct("i", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("part")).alias("q"))
        return ends.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(each)), lambda x: x["q"]).alias("q"))
    at = []
    for s in shares:
        place = last * F.lit(float(s))
        place = F.bround(place) if nearest else place
        lower, upper = ((F.col("below") <= p) & (F.col("below") + F.col("n") > p) for p in (F.floor(place), F.ceil(place)))
        at.append((F.max(F.when(lower, F.col(value))), F.max(F.when(upper, F.col(value))), F.max(place - F.floor(place))))
    return c.groupBy(*by).agg(F.array(*[lo + (hi - lo) * part for lo, hi, part in at]).alias("q"))


def quantile(df: DataFrame, value: str, share: float) -> float | None:
    """An exact quantile of one column; a few numbers reach the driver."""
    row = quantiles(df, value, [], [share]).first()
    return row["q"][0] if row and row["q"] else None


def value_ranks(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """Each distinct value with below, n, total, average-tie rank and mid-rank."""
    by = by or []
    ranked = cumulative(counted(df, value, by), value, by)
    return ranked.select(
        *by,
        value,
        "below",
        "n",
        "total",
        (F.col("below") + (F.col("n") + 1) / 2).alias("average_rank"),
        ((F.col("below") + F.col("n") / 2) / F.col("total")).alias("midrank"),
    )


def with_ranks(df: DataFrame, value: str, by: list[str] | None = None, keep: dict[str, str] | None = None) -> DataFrame:
    """``df`` with columns of :func:`value_ranks` joined on the value (``keep``: column -> new name)."""
    by = by or []
    keep = keep or {"midrank": "midrank"}
    ranked = value_ranks(df, value, by).select(*by, value, *[F.col(a).alias(b) for a, b in keep.items()])
    return df.join(ranked, [*by, value], "left")
