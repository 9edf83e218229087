"""Scalar building blocks as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Standard normal quantile for two-sided 95 % intervals.
Z95 = 1.959963984540054


def missing_to_null(c: Column, data_type: str) -> Column:
    """NaN counts as missing in floating columns; other types are left alone."""
    return F.when(F.isnan(c), F.lit(None)).otherwise(c) if data_type in ("double", "float") else c


def neutralised(c: Column) -> Column:
    """Text that a spreadsheet would run as a formula gets a leading apostrophe."""
    return F.when(c.rlike(r"^[=+\-@\t\r\n]"), F.concat(F.lit("'"), c)).otherwise(c)


def iso_weekday(c: Column) -> Column:
    """Monday 1 to Sunday 7."""
    return F.weekday(c) + 1


def wilson(count: Column, n: Column) -> tuple[Column, Column]:
    """95 % score interval of a rate; exact at 0 and n; null for n = 0."""
    z2 = Z95 * Z95
    total = F.nullif(n.cast("double"), F.lit(0.0))
    p = count / total
    centre = (p + z2 / (2 * total)) / (1 + z2 / total)
    half = Z95 * F.sqrt(p * (1 - p) / total + z2 / (4 * total * total)) / (1 + z2 / total)
    low = F.when(count == 0, F.lit(0.0) * total).otherwise(F.greatest(centre - half, F.lit(0.0)))
    high = F.when(count == n, F.lit(1.0) + 0 * total).otherwise(F.least(centre + half, F.lit(1.0)))
    return low, high


def newcombe(c1: Column, n1: Column, c0: Column, n0: Column) -> tuple[Column, Column]:
    """95 % interval of the difference of two rates, from their score intervals."""
    (l1, u1), (l0, u0) = wilson(c1, n1), wilson(c0, n0)
    p1, p0 = c1 / F.nullif(n1.cast("double"), F.lit(0.0)), c0 / F.nullif(n0.cast("double"), F.lit(0.0))
    d = p1 - p0
    return (
        d - F.sqrt((p1 - l1) * (p1 - l1) + (u0 - p0) * (u0 - p0)),
        d + F.sqrt((u1 - p1) * (u1 - p1) + (p0 - l0) * (p0 - l0)),
    )


def row_median(columns: list[Column]) -> Column:
    """Median of several columns of one row, all non-null."""
    ordered = F.array_sort(F.array(*columns))
    k = len(columns)
    return (F.element_at(ordered, (k + 1) // 2) + F.element_at(ordered, k // 2 + 1)) / 2


def row_mean(columns: list[Column], weights: list[float] | None = None) -> Column:
    weights = weights or [1 / len(columns)] * len(columns)
    return reduce(lambda a, b: a + b, [c * F.lit(float(w)) for c, w in zip(columns, weights, strict=True)])


def row_max(columns: list[Column]) -> Column:
    return F.greatest(*columns) if len(columns) > 1 else columns[0]


def every(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, flags)


def some(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def correlation(a: Column, b: Column) -> Column:
    """Pearson correlation as an aggregate; null where one side is constant."""
    return F.covar_pop(a, b) / F.nullif(F.stddev_pop(a) * F.stddev_pop(b), F.lit(0.0))


def period_label(ts: Column, granularity: str = "day", roll_weekend: bool = False) -> Column:
    """Start label of the period of a timestamp; a weekend day rolls back to Friday."""
    if granularity == "hour":
        return F.date_format(F.date_trunc("hour", ts), "yyyy-MM-dd'T'HH")
    if granularity in ("week", "month"):
        return F.date_format(F.date_trunc(granularity, ts), "yyyy-MM-dd" if granularity == "week" else "yyyy-MM")
    day = F.to_date(ts)
    if roll_weekend:
        day = F.date_sub(day, F.greatest(F.weekday(day) - 4, F.lit(0)))
    return F.date_format(day, "yyyy-MM-dd")


def group_key(columns: list[str], types: dict[str, str]) -> Column:
    """32 hex digits that name a group: typed, sorted, null-safe.

    Null, the empty text and the text "None" are three groups, and 1 and "1" two.
    """
    parts = [
        F.concat(
            F.lit(f"{c}:{types[c]}="),
            F.when(F.col(c).isNull(), F.lit("~")).otherwise(
                F.concat(F.lit("="), F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("||")))
            ),
        )
        for c in sorted(columns)
    ]
    return F.substring(F.sha2(F.concat_ws("|,", *parts), 256), 1, 32)
