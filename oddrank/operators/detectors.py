"""Detectors: each has ``fit(df, features, seed) -> model``; a model scores by
Column expressions or one Arrow batch at a time, higher = odder.

Models train on at most ``CAPS`` rows drawn by hash (the configuration may set
other caps) and score every row. They are plain data and go to JSON. ECOD and
HBOS have distributed forms and are fitted on all rows, however many.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator
from dataclasses import asdict, dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from oddrank.operators import ranks
from oddrank.sources import shared

FLOOR = 1e-10
#: Rows that silhouettes are taken of, as in the reference.
SILHOUETTE_ROWS = 20_000
#: Numbers of kernel columns that are kept while a one-class SVM is fitted.
KERNEL_NUMBERS = 25_000_000


def training_matrix(df: DataFrame, row_id: str, features: list[str], cap: int, seed: int) -> np.ndarray:
    """At most ``cap`` rows (all if it is 0) in the order of their hash: the same ones whatever the partitioning.

    Rows over the wanted share of the hash's range stay where they are, so that
    no task sorts the whole table; the rest is ordered and cut on the driver.
    """
    place = F.xxhash64(F.lit(seed), F.col(row_id))
    src = df.select(
        place.alias("place"), F.col(row_id).alias("id"), *[F.col(f"`{f}`").cast("double").alias(str(i)) for i, f in enumerate(features)]
    )
    rows = df.count() if cap else 0
    share = (cap + 6 * math.sqrt(cap)) / rows if rows > cap else 1.0
    found = None
    while found is None or found.num_rows < min(cap, rows) and share < 1:  # six deviations short: hardly ever
        share = share if found is None else 2 * share
        found = (src.where(F.col("place") <= F.lit(int(share * 2**64) - 2**63)) if share < 1 else src).toArrow()
    order = pa.compute.sort_indices(found, [("place", "ascending"), ("id", "ascending")])
    if cap:
        order = order[:cap]
    return np.column_stack([found.column(str(i)).take(order).to_numpy() for i in range(len(features))]).astype(float)


def unpivot(df: DataFrame, keys: list[str], features: list[str]) -> DataFrame:
    pairs = [F.struct(F.lit(f).alias("feature"), F.col(f"`{f}`").cast("double").alias("x")) for f in features]
    return df.select(*keys, F.explode(F.array(*pairs)).alias("p")).select(*keys, "p.feature", "p.x")


# --- ECOD --------------------------------------------------------------------


def ecod_terms(df: DataFrame, keys: list[str], features: list[str], by: list[str] | None = None) -> DataFrame:
    """keys, feature, x, term: -ln of the smaller tail share of each value in its column (and group)."""
    by = by or []
    long = unpivot(df, [*keys, *by], features)
    c = ranks.cumulative(ranks.counted(long, "x", [*by, "feature"]), "x", [*by, "feature"])
    left = (F.col("below") + F.col("n")) / F.col("total")
    right = (F.col("total") - F.col("below")) / F.col("total")
    tail = F.greatest(F.least(left, right, F.lit(1.0)), F.lit(FLOOR))
    return long.join(c.select(*by, "feature", "x", (-F.ln(tail)).alias("term")), [*by, "feature", "x"])


def ecod_scores(df: DataFrame, keys: list[str], features: list[str], by: list[str] | None = None) -> DataFrame:
    by = by or []
    terms = ecod_terms(df, keys, features, by)
    return terms.groupBy(*keys, *by).agg((F.sum("term") / len(features)).alias("score"))


def ecod_tails(df: DataFrame, features: list[str]) -> DataFrame:
    """feature, x, upto, total, term of each distinct value of each column, over all rows; written."""
    c = ranks.cumulative(ranks.counted(unpivot(df, [], features), "x", ["feature"]), "x", ["feature"])
    upto = F.col("below") + F.col("n")
    share = F.least(upto, F.col("total") - F.col("below")) / F.col("total")
    term = -F.ln(F.greatest(share, F.lit(FLOOR))) / F.lit(len(features))
    return shared.written(c.select("feature", "x", upto.alias("upto"), "total", term.alias("term")), "tails")


def with_tail_terms(df: DataFrame, key: str, features: list[str], tails: DataFrame) -> DataFrame:
    """key and ``terms`` of each row in the columns' order; a value that isn't in ``tails`` has none."""
    joined = unpivot(df, [key], features).join(tails.select("feature", "x", "term"), ["feature", "x"], "left")
    return joined.groupBy(key).agg(F.array(*[F.max(F.when(F.col("feature") == f, F.col("term"))) for f in features]).alias("terms"))


# --- HBOS --------------------------------------------------------------------


@dataclass
class Histogram:
    low: float
    high: float
    counts: list[int]
    rows: int

    def edges(self) -> np.ndarray:
        return np.linspace(self.low, self.high, len(self.counts) + 1)

    def terms(self) -> list[float]:
        width = max((self.high - self.low) / len(self.counts), FLOOR)
        return [-math.log(max(c / (self.rows * width), FLOOR)) for c in self.counts]

    def term(self, x: Column) -> Column:
        """A value equal to an inner edge is looked up in the lower bin; outside the range the floor holds."""
        k, span = len(self.counts), self.high - self.low
        at = F.ceil((x - F.lit(self.low)) / F.lit(span / k)).cast("int")
        inside = F.element_at(F.array(*map(F.lit, self.terms())), F.least(F.greatest(at, F.lit(1)), F.lit(k)))
        return F.when((x < self.low) | (x > self.high), F.lit(-math.log(FLOOR))).otherwise(inside)


def auto_bins(rows: int, q25: float, q75: float, low: float, high: float) -> int:
    """Freedman-Diaconis, from 10 to 256 bins; without a spread the root of the rows."""
    if rows < 4:
        return 10
    if q75 == q25 or high == low:
        return max(10, min(256, math.ceil(math.sqrt(rows))))
    return max(10, min(256, math.ceil((high - low) / (2 * (q75 - q25) * rows ** (-1 / 3)))))


def fit_hbos(df: DataFrame, features: list[str]) -> dict[str, Histogram]:
    """Two aggregates: ranges and quartiles, then the counts of all bins of all columns."""
    spread = {r.feature: list(r.q) for r in ranks.quantiles(unpivot(df, [], features), "x", ["feature"], [0.25, 0.75]).collect()}
    stats = df.agg(
        *[F.struct(F.min(f"`{f}`"), F.max(f"`{f}`"), F.count(f"`{f}`")).alias(str(i)) for i, f in enumerate(features)]
    ).first()
    bins, spec = [], {}
    for i, f in enumerate(features):
        (low, high, n), q = stats[str(i)], spread[f]
        if low == high:
            low, high = low - 0.5, high + 0.5
        k = auto_bins(n, q[0], q[1], *stats[str(i)][:2])
        spec[f] = (float(low), float(high), k, n)
        at = F.least(F.floor((F.col(f"`{f}`") - F.lit(float(low))) / F.lit((high - low) / k)), F.lit(k - 1))
        bins.append(F.struct(F.lit(f).alias("feature"), at.cast("int").alias("bin")))
    counts = df.select(F.explode(F.array(*bins)).alias("b")).select("b.*").groupBy("feature", "bin").count().collect()
    out = {f: Histogram(lo, hi, [0] * k, n) for f, (lo, hi, k, n) in spec.items()}
    for r in counts:
        out[r.feature].counts[r.bin] = r["count"]
    return out


def hbos_score(model: dict[str, Histogram]) -> Column:
    terms = [h.term(F.col(f"`{f}`").cast("double")) for f, h in model.items()]
    total = terms[0]
    for t in terms[1:]:
        total = total + t
    return total / len(terms)


# --- models that score Arrow batches --------------------------------------------


class BatchModel:
    """Scores a numpy matrix; ``score_frame`` runs it over all rows in Arrow batches."""

    name = "model"
    features: list[str]
    threshold: float

    def score(self, x: np.ndarray) -> np.ndarray:
        raise NotImplementedError

    def score_frame(self, df: DataFrame, keep: list[str], alias: str) -> DataFrame:
        shared = df.sparkSession.sparkContext.broadcast(self)
        n = len(self.features)
        src = df.select(*keep, *[F.col(f"`{f}`").cast("double").alias(f"__f{i}") for i, f in enumerate(self.features)])
        schema = src.select(*keep).schema.add(alias, "double")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            model = shared.value
            for pdf in batches:
                out = pdf[keep].copy()
                out[alias] = checked(model.score(pdf[[f"__f{i}" for i in range(n)]].to_numpy(float)), len(pdf))
                yield out

        return src.mapInPandas(run, schema)

    def to_dict(self) -> dict:
        return {"detector": self.name, **asdict(self)}  # type: ignore[call-overload]


def checked(scores: np.ndarray, rows: int) -> np.ndarray:
    """The contract of every detector: one finite number for each row."""
    scores = np.asarray(scores, float)
    if scores.shape != (rows,) or not np.isfinite(scores).all():
        raise ValueError("a detector must give one finite score for each row")
    return scores


@dataclass
class IsolationForest(BatchModel):
    """Trees as flat arrays: feature (-1: leaf), cut, left child; the right one follows it."""

    features: list[str]
    trees: list[dict]
    sample_size: int
    threshold: float = 0.5
    name = "isolation_forest"

    @staticmethod
    def average_path(n: float) -> float:
        if n <= 1:
            return 0.0
        return 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    @classmethod
    def fit(cls, x: np.ndarray, features: list[str], seed: int, trees: int = 200, size: int = 256) -> IsolationForest:
        rng = np.random.default_rng(seed)
        size = min(size, len(x))
        limit = math.ceil(math.log2(max(size, 2)))
        made = [cls._grow(x[rng.choice(len(x), size, replace=False)], rng, limit) for _ in range(trees)]
        return cls(features, made, size)

    @classmethod
    def _grow(cls, x: np.ndarray, rng: np.random.Generator, limit: int) -> dict:
        feature, cut, left, path = [-1], [0.0], [-1], [0.0]
        queue = [(0, x, 0)]
        while queue:
            at, rows, depth = queue.pop()
            spread = np.flatnonzero(rows.max(axis=0) > rows.min(axis=0)) if len(rows) > 1 else []
            if depth >= limit or len(spread) == 0:
                path[at] = depth + cls.average_path(len(rows))
                continue
            f = int(rng.choice(spread))
            lo, hi = rows[:, f].min(), rows[:, f].max()
            c = float(rng.uniform(lo, hi))
            goes = rows[:, f] <= c
            feature[at], cut[at], left[at] = f, c, len(feature)
            for part in (rows[goes], rows[~goes]):
                queue.append((len(feature), part, depth + 1))
                feature.append(-1)
                cut.append(0.0)
                left.append(-1)
                path.append(0.0)
        return {"feature": feature, "cut": cut, "left": left, "path": path}

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for t in self.trees:
            f, c, left, path = (np.array(t[k]) for k in ("feature", "cut", "left", "path"))
            at = np.zeros(len(x), int)
            while True:
                going = np.flatnonzero(f[at] >= 0)
                if not len(going):
                    break
                node = at[going]
                at[going] = left[node] + (x[going, f[node]] > c[node])
            total += path[at]
        mean = total / len(self.trees)
        return 2.0 ** (-mean / max(self.average_path(self.sample_size), 1e-12))


@dataclass
class KMeansDistance(BatchModel):
    """Distance to the nearest centre of a large cluster."""

    features: list[str]
    centres: list[list[float]]
    threshold: float
    name = "kmeans_distance"

    @staticmethod
    def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum((x * x).sum(1)[:, None] - 2 * x @ c.T + (c * c).sum(1)[None, :], 0))

    @classmethod
    def _cluster(cls, x: np.ndarray, k: int, rng: np.random.Generator, tries: int = 3) -> tuple[np.ndarray, np.ndarray, float]:
        best = None
        still = 1e-4 * float(x.var(0).mean())  # the reference's tolerance of the centres' shift
        for _ in range(tries):
            c = [x[rng.integers(len(x))]]
            d = np.full(len(x), np.inf)
            while len(c) < k:  # k-means++ seeding
                d = np.minimum(d, cls._distances(x, c[-1][None, :])[:, 0] ** 2)
                c.append(x[rng.choice(len(x), p=d / d.sum())] if d.sum() > 0 else x[rng.integers(len(x))])
            c = np.array(c)
            for _ in range(300):
                own = ((c * c).sum(1)[None, :] - 2 * x @ c.T).argmin(1)
                sizes = np.bincount(own, minlength=k)
                sums = np.stack([np.bincount(own, x[:, f], k) for f in range(x.shape[1])], 1)
                new = np.where(sizes[:, None] > 0, sums / np.maximum(sizes, 1)[:, None], c)
                shift = float(((new - c) ** 2).sum())
                c = new
                if shift <= still:
                    break
            d = cls._distances(x, c)
            own, cost = d.argmin(1), float((d.min(1) ** 2).sum())
            if best is None or cost < best[2]:
                best = (c, own, cost)
        return best  # type: ignore[return-value]

    @staticmethod
    def candidates(x: np.ndarray, most: int = 8) -> list[int]:
        """Numbers of clusters to choose from; discrete data have one for each distinct row."""
        distinct = len(np.unique(x, axis=0))
        if distinct <= 50 and distinct <= len(x) / 2:
            return [max(1, distinct)]
        return list(range(2, min(most, len(x) - 1) + 1)) or [1]

    @classmethod
    def tried(cls, x: np.ndarray, k: int, seed: int) -> tuple[float, float]:
        """(cost, mean silhouette) of one number of clusters."""
        rng = np.random.default_rng([seed, k])
        part = rng.choice(len(x), SILHOUETTE_ROWS, replace=False) if len(x) > SILHOUETTE_ROWS else np.arange(len(x))
        _, own, cost = cls._cluster(x, k, rng, 1)
        return cost, cls._silhouettes(x[part], [own[part]])[0]

    @staticmethod
    def chosen(ks: list[int], tried: list[tuple[float, float]]) -> int:
        """The mean of the elbow of the costs and the best silhouette."""
        if len(ks) < 2:
            return ks[0]
        costs = np.array([c for c, _ in tried])
        line = np.interp(ks, [ks[0], ks[-1]], [costs[0], costs[-1]])
        elbow, best = ks[int((line - costs).argmax())], ks[int(np.argmax([q for _, q in tried]))]
        return round((elbow + best) / 2)

    @classmethod
    def choose_k(cls, x: np.ndarray, seed: int, most: int = 8) -> int:
        ks = cls.candidates(x, most)
        return cls.chosen(ks, [cls.tried(x, k, seed) for k in ks] if len(ks) > 1 else [])

    @classmethod
    def _silhouettes(cls, x: np.ndarray, owns: list[np.ndarray]) -> list[float]:
        """Mean silhouette of each labelling, all from one pass over blocks of distances."""
        labels = [np.unique(own, return_inverse=True)[1] for own in owns]
        sizes = [np.bincount(own) for own in labels]
        ones = [np.eye(len(n))[own] for own, n in zip(labels, sizes, strict=True)]
        totals = [0.0] * len(owns)
        for begin in range(0, len(x), 500):
            rows = np.arange(begin, min(begin + 500, len(x)))
            d = cls._distances(x[rows], x)
            d[rows - begin, rows] = 0
            for i, (own, n) in enumerate(zip(labels, sizes, strict=True)):
                mine_is = np.arange(len(n))[None, :] == own[rows][:, None]
                means = d @ ones[i] / np.maximum(n[None, :] - mine_is, 1)
                mine, others = means[mine_is], np.where(mine_is, np.inf, means).min(1)
                if len(n) > 1:
                    # a row that is alone in its cluster counts as 0
                    s = (others - mine) / np.maximum(np.maximum(mine, others), 1e-12)
                    totals[i] += float(np.where(n[own[rows]] > 1, s, 0.0).sum())
        return [t / len(x) if len(n) > 1 else -1.0 for t, n in zip(totals, sizes, strict=True)]

    @classmethod
    def fit(cls, x: np.ndarray, features: list[str], seed: int, coverage: float = 0.9, k: int | None = None) -> KMeansDistance:
        rng = np.random.default_rng(seed)
        c, own, _ = cls._cluster(x, min(k or cls.choose_k(x, seed), len(x)), rng)
        sizes = np.bincount(own, minlength=len(c))
        order = np.argsort(-sizes, kind="stable")
        enough = int(np.searchsorted(np.cumsum(sizes[order]), coverage * len(x))) + 1
        large = c[order[:enough]]
        d = cls._distances(x, large).min(1)
        q1, q3 = np.percentile(d, [25, 75])
        return cls(features, large.tolist(), float(q3 + 1.5 * (q3 - q1)))

    def score(self, x: np.ndarray) -> np.ndarray:
        return self._distances(x, np.array(self.centres)).min(1)


@dataclass
class OneClassSVM(BatchModel):
    """RBF kernel; the dual is solved by pairwise steps, kernel columns are made as they are needed."""

    features: list[str]
    vectors: list[list[float]]
    weights: list[float]
    gamma: float
    rho: float
    threshold: float = 0.0
    name = "one_class_svm"

    @classmethod
    def fit(cls, x: np.ndarray, features: list[str], seed: int, nu: float = 0.1) -> OneClassSVM:
        variance = x.var()
        gamma = 1.0 / (x.shape[1] * variance) if variance > 0 else 1.0
        n, top = len(x), 1.0 / max(nu * len(x), 1.0)
        a = np.zeros(n)
        a[: int(1 / top)] = top
        if a.sum() < 1:
            a[min(int(1 / top), n - 1)] += 1 - a.sum()
        first = np.flatnonzero(a)
        g = np.zeros(n)
        for begin in range(0, len(first), 256):
            at = first[begin : begin + 256]
            g += cls._kernel(x, x[at], gamma) @ a[at]
        columns: OrderedDict[int, np.ndarray] = OrderedDict()

        def column(i: int) -> np.ndarray:
            if i in columns:
                columns.move_to_end(i)
            else:
                columns[i] = cls._kernel(x, x[i : i + 1], gamma)[:, 0]
                if len(columns) > max(2, KERNEL_NUMBERS // n):
                    columns.popitem(last=False)
            return columns[i]

        tolerance = min(1e-6, 1e-3 * top)  # a thousandth of a vector's full weight
        for _ in range(50 * n):
            # the most violating row gains, the row that lowers the objective most gives
            i = int(np.where(a < top - 1e-15, g, np.inf).argmin())
            k_i = column(i)
            gap = np.where(a > 1e-15, g - g[i], -np.inf)
            if gap.max() < tolerance:
                break
            j = int(np.where(gap > 0, gap * gap / np.maximum(2 - 2 * k_i, 1e-12), -1.0).argmax())
            step = min(gap[j] / max(2 - 2 * k_i[j], 1e-12), top - a[i], a[j])
            a[i] += step
            a[j] -= step
            g += step * (k_i - column(j))
        free = (a > 1e-12) & (a < top - 1e-12)
        rho = float(g[free].mean()) if free.any() else float((g[a > 1e-12].max() + g[a <= 1e-12].min()) / 2 if (a <= 1e-12).any() else g.max())
        held = a > 1e-12
        return cls(features, x[held].tolist(), a[held].tolist(), float(gamma), rho)

    @staticmethod
    def _kernel(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
        return np.exp(-gamma * np.maximum((x * x).sum(1)[:, None] - 2 * x @ y.T + (y * y).sum(1)[None, :], 0))

    def score(self, x: np.ndarray) -> np.ndarray:
        v, w = np.array(self.vectors), np.array(self.weights)
        return np.concatenate([self.rho - self._kernel(p, v, self.gamma) @ w for p in np.array_split(x, max(1, len(x) // 2000))])


@dataclass
class LocalOutlierFactor(BatchModel):
    """Novelty mode: density of a row against its neighbours in the sample."""

    features: list[str]
    points: list[list[float]]
    k: int
    k_distance: list[float]
    density: list[float]
    threshold: float = 1.5
    name = "lof"

    @classmethod
    def fit(cls, x: np.ndarray, features: list[str], seed: int, k: int = 20) -> LocalOutlierFactor:
        k = max(1, min(k, len(x) - 1))
        d, at = cls._near(x, x, k, skip_self=True)
        reach = np.maximum(d, d[:, -1][at])
        density = 1.0 / np.maximum(reach.mean(1), 1e-10)
        return cls(features, x.tolist(), k, d[:, -1].tolist(), density.tolist())

    @staticmethod
    def _near(x: np.ndarray, points: np.ndarray, k: int, skip_self: bool = False) -> tuple[np.ndarray, np.ndarray]:
        ds, ats = [], []
        for begin in range(0, len(x), 200):
            d = KMeansDistance._distances(x[begin : begin + 200], points)
            if skip_self:
                d[np.arange(len(d)), begin + np.arange(len(d))] = np.inf
            at = np.sort(np.argpartition(d, k - 1, axis=1)[:, :k], axis=1)
            at = np.take_along_axis(at, np.argsort(np.take_along_axis(d, at, 1), axis=1, kind="stable"), 1)
            ds.append(np.take_along_axis(d, at, 1))
            ats.append(at)
        return np.concatenate(ds), np.concatenate(ats)

    def score(self, x: np.ndarray) -> np.ndarray:
        points, kd, density = np.array(self.points), np.array(self.k_distance), np.array(self.density)
        d, at = self._near(x, points, min(self.k, len(points)))
        own = 1.0 / np.maximum(np.maximum(d, kd[at]).mean(1), 1e-10)
        return density[at].mean(1) / own


@dataclass
class Ecod(BatchModel):
    """Tail shares of the training table: each column's distinct values and how many rows lie at or under them."""

    features: list[str]
    values: list[list[float]]
    upto: list[list[int]]
    rows: int
    threshold: float = 0.0
    name = "ecod"

    @classmethod
    def fit(cls, x: np.ndarray, features: list[str], seed: int) -> Ecod:
        found = [np.unique(x[:, f], return_counts=True) for f in range(x.shape[1])]
        model = cls(features, [v.tolist() for v, _ in found], [np.cumsum(n).tolist() for _, n in found], len(x))
        model.threshold = float(np.percentile(model.score(x), 95))
        return model

    @classmethod
    def of_tails(cls, tails: DataFrame, features: list[str], most: int) -> Ecod | None:
        """The model of all rows that ``tails`` counts; None if a column has over ``most`` distinct values."""
        sizes = tails.groupBy("feature").agg(F.count(F.lit(1)).alias("n"), F.max("total").alias("total")).collect()
        if max(r.n for r in sizes) > most:
            return None
        found = tails.select("feature", "x", "upto").toArrow().to_pandas().sort_values("x").groupby("feature")
        own = [found.get_group(f) for f in features]
        return cls(features, [t["x"].tolist() for t in own], [t["upto"].tolist() for t in own], sizes[0].total)

    def terms(self, x: np.ndarray) -> np.ndarray:
        """What each column adds to the score."""
        out = np.empty(x.shape)
        for f, (values, upto) in enumerate(zip(self.values, self.upto, strict=True)):
            held, below = np.array(values), np.concatenate([[0], upto])
            left = below[np.searchsorted(held, x[:, f], "right")] / self.rows
            right = (self.rows - below[np.searchsorted(held, x[:, f], "left")]) / self.rows
            out[:, f] = -np.log(np.clip(np.minimum(left, right), FLOOR, 1.0))
        return out / len(self.values)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.terms(x).sum(1)


@dataclass
class Hbos(BatchModel):
    """The columns' histograms, as :func:`fit_hbos` makes them."""

    features: list[str]
    ranges: list[list[float]]
    counts: list[list[int]]
    rows: int
    threshold: float = 0.0
    name = "hbos"

    @classmethod
    def fit(cls, x: np.ndarray, features: list[str], seed: int) -> Hbos:
        ranges, counts = [], []
        for v in x.T:
            low, high = float(v.min()), float(v.max())
            k = auto_bins(len(v), *np.percentile(v, [25, 75]), low, high)
            if low == high:
                low, high = low - 0.5, high + 0.5
            at = np.minimum(np.floor((v - low) / ((high - low) / k)), k - 1).astype(int)  # as in fit_hbos, and as rows are looked up
            counts.append(np.bincount(at, minlength=k).tolist())
            ranges.append([low, high])
        model = cls(features, ranges, counts, len(x))
        model.threshold = float(np.percentile(model.score(x), 95))
        return model

    @classmethod
    def of_rows(cls, df: DataFrame, features: list[str]) -> Hbos:
        """The model of all rows, from aggregates; its threshold is left to the caller."""
        made = [h for _, h in sorted(fit_hbos(df, features).items(), key=lambda p: features.index(p[0]))]
        return cls(features, [[h.low, h.high] for h in made], [h.counts for h in made], made[0].rows)

    def terms(self, x: np.ndarray) -> np.ndarray:
        """What each column adds to the score."""
        out = np.empty(x.shape)
        for f, (v, (low, high), counts) in enumerate(zip(x.T, self.ranges, self.counts, strict=True)):
            k = len(counts)
            at = np.clip(np.ceil((np.clip(v, low, high) - low) / ((high - low) / k)), 1, k).astype(int) - 1
            held = np.array(Histogram(low, high, counts, self.rows).terms())
            out[:, f] = np.where((v < low) | (v > high), -math.log(FLOOR), held[at])
        return out / len(self.counts)

    def score(self, x: np.ndarray) -> np.ndarray:
        return self.terms(x).sum(1)


REGISTRY: dict[str, type] = {}
#: Rows that each detector trains on at most, as in the reference; ``scoring.train_row_caps`` sets others.
#: Of those in ``WHOLE`` it is the rows from which a run fits them on all rows by aggregates, and the distinct
#: values of a column up to which a stored ECOD model holds them all.
CAPS = {"isolation_forest": 250_000, "kmeans_distance": 200_000, "one_class_svm": 25_000, "lof": 50_000, "ecod": 500_000, "hbos": 500_000}
#: Detectors that have a distributed form.
WHOLE = ("ecod", "hbos")
#: Cap of a registered detector that has none of its own.
OTHER_CAP = 200_000


def register(kind: type) -> type:
    """Add a detector class with a ``name``, ``fit`` and ``score``; usable as a decorator."""
    for needed in ("name", "fit", "score"):
        if not hasattr(kind, needed):
            raise TypeError(f"a detector needs {needed}")
    REGISTRY[kind.name] = kind
    return kind


for _kind in (IsolationForest, KMeansDistance, OneClassSVM, LocalOutlierFactor, Ecod, Hbos):
    register(_kind)


#: Numbers in the training matrix from which detectors are fitted as tasks of the cluster, one each.
SPREAD_NUMBERS = 100_000


def fit_detectors(spark, x: np.ndarray, features: list[str], caps: dict[str, int], params: dict[str, dict], seed: int) -> dict[str, BatchModel]:
    """Fit each detector on the first ``caps[name]`` rows of ``x`` (0: all), side by side if there is much to do.

    A task holds one detector's training rows, which the caps bound; the numbers
    of clusters that k-means chooses from are tasks of their own.
    """
    kinds = {n: REGISTRY[n] for n in caps}
    cut = lambda n: x[: caps[n]] if caps[n] else x
    if x.size < SPREAD_NUMBERS:
        return {n: kind.fit(cut(n), features, seed, **params.get(n, {})) for n, kind in kinds.items()}
    chooses = [n for n, kind in kinds.items() if kind is KMeansDistance and "k" not in params.get(n, {})]
    ks = {n: KMeansDistance.candidates(cut(n)) for n in chooses}
    jobs = [(n, None) for n in kinds if n not in chooses] + [(n, k) for n in chooses for k in ks[n] if len(ks[n]) > 1]
    shared = spark.sparkContext.broadcast((x, kinds, caps, params))

    def work(job: tuple[str, int | None, int | None]):
        held, kind_of, cap, own = shared.value
        name, k, best = (*job, None)[:3]
        rows = held[: cap[name]] if cap[name] else held
        if k is not None:
            return KMeansDistance.tried(rows, k, seed)
        more = own.get(name, {}) | ({"k": best} if best else {})
        return kind_of[name].fit(rows, features, seed, **more)

    made = dict(zip(jobs, _as_tasks(spark, work, jobs), strict=True))
    models = {n: made[n, None] for n, k in jobs if k is None}
    last = [(n, None, KMeansDistance.chosen(ks[n], [made[n, k] for k in ks[n]] if len(ks[n]) > 1 else [])) for n in chooses]
    models |= {n: m for (n, *_), m in zip(last, _as_tasks(spark, work, last), strict=True)}
    shared.unpersist()
    return {n: models[n] for n in caps}


def _as_tasks(spark, work, jobs: list) -> list:
    """``work(job)`` of each job, each in a task; what a task makes goes through Arrow as bytes."""
    from pyspark import cloudpickle

    if not jobs:
        return []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for i in pdf["id"]:
                yield pd.DataFrame({"id": [i], "made": [cloudpickle.dumps(work(jobs[i]))]})

    rows = spark.range(0, len(jobs), 1, len(jobs)).mapInPandas(run, "id long, made binary").collect()
    return [cloudpickle.loads(bytes(r.made)) for r in sorted(rows, key=lambda r: r.id)]


def fit_detector(
    name: str, df: DataFrame, row_id: str, features: list[str], seed: int = 42, cap: int | None = None, **params
) -> BatchModel:
    """Fit on at most ``cap`` rows (0: all of them; None: the detector's own cap)."""
    cap = CAPS.get(name, OTHER_CAP) if cap is None else cap
    return REGISTRY[name].fit(training_matrix(df, row_id, features, cap, seed), features, seed, **params)
