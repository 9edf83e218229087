"""Tables with planted odd rows: one large one made by Spark, and small ones of one difficulty each."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Share of planted rows of the large table, and its merchants.
ODD_SHARE, MERCHANTS = 0.005, 400
NOTES = ("paid in full", "second reminder sent", "picked up in person", "left with a neighbour", "paid by card", "gift, no invoice")


def _uniform(seed: int, name: str) -> Column:
    """A number in (0, 1) that hangs on the row's id, the seed and the name alone, not on partitions."""
    return (F.shiftrightunsigned(F.xxhash64(F.col("id"), F.lit(seed), F.lit(name)), 11).cast("double") + 0.5) / float(1 << 53)


def _normal(seed: int, name: str) -> Column:
    return F.sqrt(-2 * F.ln(_uniform(seed, name))) * F.cos(2 * math.pi * _uniform(seed, f"{name}'"))


def _choice(u: Column, shares: dict[str, float]) -> Column:
    out, upto = None, 0.0
    for name, p in shares.items():
        upto += p
        out = F.when(u < upto, name) if out is None else out.when(u < upto, name)
    return out.otherwise(name)


def scale_frame(spark: SparkSession, rows: int, seed: int = 0) -> DataFrame:
    """A table of ``rows`` transactions of fourteen columns and ``label`` (1: planted), as wide as the cluster makes it.

    Planted rows have an enormous amount, an amount that doesn't fit quantity
    and price, an unknown merchant at three in the morning, or two readings
    that are odd together.
    """
    u = lambda name: _uniform(seed, name)
    z = lambda name: _normal(seed, name)
    odd = u("odd") < ODD_SHARE
    kind = F.when(odd, F.floor(u("kind") * 4).cast("int")).otherwise(-1)
    hour = F.greatest(F.least(13 + 3 * z("hour"), F.lit(23.99)), F.lit(0.0))
    seconds = F.floor(u("day") * 365) * 86400 + F.when(kind == 2, F.lit(3 * 3600) + F.pmod(hour * 3600, F.lit(3600))).otherwise(hour * 3600)
    count = F.lit(1)
    upto = 0.0
    for k in range(15):  # a Poisson number of mean 3
        upto += math.exp(-3) * 3**k / math.factorial(k)
        count = count + (u("quantity") > upto).cast("int")
    price = F.exp(3 + 0.6 * z("price"))
    fair = F.col("quantity") * F.col("unit_price")
    amount = (
        F.when(F.col("kind") == 0, fair * (1 + 0.03 * z("amount")) * (40 + 40 * u("much")))
        .when(F.col("kind") == 1, fair * (5 + 4 * u("much")))
        .otherwise(fair * (1 + 0.03 * z("amount")))
    )
    # ranks whose frequency falls as a power of 1.1, by inverting a truncated Pareto law
    rank = F.floor(F.pow(1 - u("merchant") * (1 - (MERCHANTS + 1) ** -0.1), F.lit(-10.0)))
    base = z("base")
    note = F.element_at(F.array(*map(F.lit, NOTES)), (F.floor(u("note") * len(NOTES)) + 1).cast("int"))
    made = spark.range(rows).select("id", kind.alias("kind"), count.alias("quantity"), price.alias("unit_price"), seconds.alias("seconds"))
    return made.select(
        "id",
        F.timestamp_seconds(F.lit(1735689600) + F.col("seconds")).alias("event_time"),
        amount.alias("amount"),
        "quantity",
        "unit_price",
        F.when(u("discounted") < 0.85, 0.0).otherwise(1 + 29 * u("discount")).alias("discount"),
        (20 + 2 * base + 0.5 * z("temp") + F.when(F.col("kind") == 3, 9).otherwise(0)).alias("temp"),
        (1013 + 5 * base + z("pressure") - F.when(F.col("kind") == 3, 25).otherwise(0)).alias("pressure"),
        (-40 * (F.ln(u("latency")) + F.ln(u("latency'")))).alias("latency_ms"),
        F.when(F.col("kind") == 2, "m_unseen").otherwise(F.format_string("m%03d", F.least(rank, F.lit(MERCHANTS)).cast("int"))).alias("merchant"),
        _choice(u("region"), {"north": 0.25, "south": 0.25, "east": 0.2, "west": 0.2, "central": 0.08, "overseas": 0.02}).alias("region"),
        _choice(u("channel"), {"web": 0.5, "app": 0.35, "store": 0.15}).alias("channel"),
        (u("member") < 0.4).alias("is_member"),
        note.alias("note"),
        (F.col("kind") >= 0).cast("int").alias("label"),
    )


KINDS = (
    "point", "local", "contextual", "clustered", "masking", "varying_density", "categorical_rare", "text_timestamp",
    "irrelevant_columns", "all_categorical",
)


def small(kind: str, seed: int = 0, rows: int = 800, odd: int = 40) -> tuple[dict[str, list], list[int]]:
    """(columns, labels) of a small table whose odd rows are of one ``kind``."""
    rng = np.random.default_rng(seed)
    labels = [0] * rows + [1] * odd
    table: dict[str, list] = {}
    x = rng.normal(size=(rows + odd, 4))
    if kind == "point":
        x[rows:] = rng.uniform(-8, -6, (odd, 4))
    elif kind == "clustered":
        x[rows:] = rng.normal(-7, 0.5, (odd, 4))
    elif kind == "masking":  # so many that they look like a group of their own
        odd = 150
        x = np.concatenate([x[:rows], rng.normal(-6, 0.7, (odd, 4))])
        labels = [0] * rows + [1] * odd
    elif kind == "local":  # in the gap between two groups
        x[: rows // 2] += 10
        x[rows:] = rng.normal(5, 0.6, (odd, 4))
    elif kind == "varying_density":  # far for the tight group's spread, near for the loose one's
        x[: rows // 2] *= 0.5
        x[rows // 2 : rows] = 12 + 1.7 * x[rows // 2 : rows]
        x[rows:] = rng.normal(2.5, 0.2, (odd, 4))
    elif kind == "contextual":  # a value that is usual under another label
        context = rng.integers(0, 3, rows + odd)
        shown = np.where(np.array(labels) == 1, (context + rng.integers(1, 3, rows + odd)) % 3, context)
        x[:, 0] += 10.0 * context - 10
        table["context"] = [f"c{i}" for i in shown]
    elif kind == "categorical_rare":
        table["channel"] = [*rng.choice(["web", "store"], rows, p=[0.6, 0.4]).tolist(), *["fax"] * odd]
    elif kind == "text_timestamp":  # nights among working hours, in a column of text
        hours = np.concatenate([rng.integers(9, 18, rows), rng.integers(1, 4, odd)])
        days = rng.integers(0, 20, rows + odd)
        table["event_time"] = [f"2026-01-{5 + d + 2 * (d // 5):02d}T{h:02d}:{m:02d}:00" for d, h, m in zip(days.tolist(), hours.tolist(), rng.integers(0, 60, rows + odd).tolist(), strict=True)]
    elif kind == "irrelevant_columns":
        x = rng.normal(size=(rows + odd, 22))
        x[rows:, :2] = rng.uniform(4, 5, (odd, 2)) * rng.choice([-1, 1], (odd, 1))
    elif kind == "all_categorical":  # every level is common, only the combination is not
        home = rng.integers(0, 3, rows + odd)[:, None].repeat(5, 1)
        strange = rng.integers(0, 3, (odd, 5))
        strange[:, 1] = (strange[:, 0] + 1) % 3
        home[rows:] = strange
        stray = rng.random((rows, 5)) > 0.85
        home[:rows][stray] = rng.integers(3, 5, int(stray.sum()))
        return {f"level_{j}": [f"l{j}{v}" for v in home[:, j]] for j in range(5)}, labels
    else:
        raise ValueError(f"no scenario {kind}; there are {KINDS} and the swamping pair")
    return {f"num_{j}": x[:, j].tolist() for j in range(x.shape[1])} | table, labels


def swamping(seed: int = 0, rows: int = 800, stained: int = 80, at_risk: int = 150) -> dict[str, dict[str, list]]:
    """Two tables to fit on, alike but for unlabelled odd rows in ``stained``, and ordinary rows nearest to those to score."""
    rng = np.random.default_rng(seed)
    clean = rng.normal(size=(rows, 5))
    bad = rng.uniform(-8, -6, (stained, 5))
    draws = rng.normal(size=(20_000, 5))
    near = draws[np.argsort(draws.sum(1))[:at_risk]]
    named = lambda m: {f"num_{j}": m[:, j].tolist() for j in range(5)}
    return {"clean": named(clean), "stained": named(np.concatenate([clean, bad])), "at_risk": named(near)}


def frame(spark: SparkSession, table: dict[str, list], labels: list[int] | None = None) -> DataFrame:
    """A small table as a DataFrame with ``id`` and, if given, ``label``."""
    names = list(table)
    rows = [(i, *r) for i, r in enumerate(zip(*table.values(), strict=True))]
    kinds = ["double" if isinstance(table[n][0], float) else "string" for n in names]
    df = spark.createDataFrame(rows, "id long, " + ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))
    if labels is None:
        return df
    return df.join(spark.createDataFrame(list(enumerate(labels)), "id long, label int"), "id")


# --- bounds that results on such tables must keep ----------------------------------------

# Least and most a policy may have on a scenario, by default and by kind.
BOUNDS = {
    "min_average_precision": 0.15, "min_flag_precision": 0.25, "min_flag_recall": 0.25, "max_false_positive_budget_ratio": 1.0,
    "max_over_flag_ratio": 1.5, "min_flag_jaccard_stability": 0.5, "min_rank_stability": 0.8,
}
KIND_BOUNDS = {"point": {"min_average_precision": 0.8}, "clustered": {"min_average_precision": 0.8}}
ONLY = {"swamping": ("max_false_positive_budget_ratio",)}


def check_bounds(kind: str, metrics: dict[str, float]) -> list[tuple[str, float, float, bool]]:
    """(bound, limit, value, kept) of every bound of a kind that the metrics have a value for."""
    own = {k: v for k, v in (BOUNDS | KIND_BOUNDS.get(kind, {})).items() if kind not in ONLY or k in ONLY[kind]}
    out = []
    for bound, limit in own.items():
        value = metrics.get(bound[4:])
        if value is not None and not math.isnan(value):
            out.append((bound, limit, value, value >= limit if bound.startswith("min_") else value <= limit))
    return out
