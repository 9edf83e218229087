"""Registered queries of the anomaly-ranking engine and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddrank.functions import columns as fx
from oddrank.operators import detectors as det
from oddrank.operators import encode, evaluate, explain, history, ledger, profile, ranks, scoring, temporal
from oddrank.plans import detection, feature_plan
from oddrank.config import Config
from oddrank.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


def _as_sql(name: str):
    """A column to six digits as DuckDB rounds: half up of the product. Shares of 900,000 rows have thousands of such halves."""
    return F.round(F.col(name) * F.lit(1e6)) / F.lit(1e6)


# --- profiles ------------------------------------------------------------------


@query(
    """
WITH long AS (
  SELECT 'o_orderkey' c, CAST(o_orderkey AS VARCHAR) v, CAST(o_orderkey AS DOUBLE) x FROM orders
  UNION ALL SELECT 'o_custkey', CAST(o_custkey AS VARCHAR), CAST(o_custkey AS DOUBLE) FROM orders
  UNION ALL SELECT 'o_orderstatus', o_orderstatus, NULL FROM orders
  UNION ALL SELECT 'o_totalprice', CAST(o_totalprice AS VARCHAR), nullif(o_totalprice, 0) FROM orders
  UNION ALL SELECT 'o_orderpriority', nullif(o_orderpriority, '5-LOW'), NULL FROM orders)
SELECT c AS column_name, count(*) AS n_rows, count(*) - count(v) AS null_count, count(DISTINCT v) AS n_unique,
  round(avg(x), 4) AS mean, round(stddev_samp(x), 4) AS std FROM long GROUP BY c"""
)
def profile_columns(spark, d):
    o = _t(spark, d, "orders").select(
        "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice",
        F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("o_orderpriority"),
    )
    p = profile.profile_frame(o)
    return p.select("column_name", "n_rows", "null_count", "n_unique", _r("mean", 4).alias("mean"), _r("std", 4).alias("std"))


@query(
    """
WITH s AS (SELECT count(*) n, count(DISTINCT o_orderkey) k1, max(o_orderkey) - min(o_orderkey) + 1 span,
  count(DISTINCT o_orderstatus) k2, count(DISTINCT o_orderpriority) k3, count(DISTINCT o_totalprice) k4 FROM orders)
SELECT 'o_orderkey' AS column_name, CASE WHEN n >= 20 AND k1 = n AND span = n THEN 'identifier_like' ELSE 'numeric' END AS class FROM s
UNION ALL SELECT 'o_orderstatus', CASE WHEN k2 = 1 THEN 'constant' ELSE 'categorical' END FROM s
UNION ALL SELECT 'o_orderpriority', CASE WHEN k3 = 1 THEN 'constant' ELSE 'categorical' END FROM s
UNION ALL SELECT 'o_totalprice', CASE WHEN k4 = 1 THEN 'constant' ELSE 'numeric' END FROM s
UNION ALL SELECT 'o_orderdate', 'temporal' FROM s"""
)
def classify_columns(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderdate")
    cfg = profile.ProfilingConfig()
    rows = [(p.name, profile.classify(p, cfg)[0]) for p in profile.profile(o, cfg)]
    return spark.createDataFrame(rows, "column_name string, class string")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL")
def group_counts(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT o_orderstatus, o_shippriority, substr(sha256(concat_ws('|,', 'o_orderstatus:string=' || CASE WHEN o_orderstatus IS NULL THEN '~'
  ELSE '=' || replace(o_orderstatus, '|', '||') END, 'o_shippriority:int=' || CASE WHEN o_shippriority IS NULL THEN '~' ELSE '=' || o_shippriority END)), 1, 32) AS group_key
FROM (SELECT DISTINCT nullif(o_orderstatus, 'P') AS o_orderstatus, CAST(o_custkey % 3 AS INT) AS o_shippriority FROM orders)"""
)
def group_key_digest(spark, d):
    o = _t(spark, d, "orders").select(
        F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"), (F.col("o_custkey") % 3).cast("int").alias("o_shippriority")
    ).distinct()
    return o.withColumn("group_key", fx.group_key(["o_orderstatus", "o_shippriority"], dict(o.dtypes)))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def id_uniqueness_violations(spark, d):
    return profile.duplicate_ids(_t(spark, d, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT p_partkey, row_number() OVER (ORDER BY p_retailprice, p_partkey) - 1 AS __row_id FROM part")
def row_id_stamp(spark, d):
    p = _t(spark, d, "part").select("p_partkey", "p_retailprice")
    return readers.with_row_id(p, ["p_retailprice", "p_partkey"]).select("p_partkey", readers.ROW_ID)


@query("SELECT o_orderkey AS a, o_orderstatus AS s_status, o_totalprice AS s_money_total FROM orders")
def struct_flatten(spark, d):
    o = _t(spark, d, "orders").select(
        F.col("o_orderkey").alias("a"),
        F.struct(F.col("o_orderstatus").alias("status"), F.struct(F.col("o_totalprice").alias("total")).alias("money")).alias("s"),
    )
    return profile.flattened(o)


@query("SELECT o_orderkey, CAST(epoch(o_orderdate - TIMESTAMP '1995-01-01') AS BIGINT) AS age, nullif(o_totalprice, 0) AS x FROM orders")
def duration_and_nan(spark, d):
    o = _t(spark, d, "orders").select(
        "o_orderkey", (F.col("o_orderdate") - F.to_timestamp_ntz(F.lit("1995-01-01 00:00:00"))).alias("age"),
        F.when(F.col("o_totalprice") == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).alias("x"),
    )
    return profile.cleaned(o)


# --- time ------------------------------------------------------------------------


@query(
    """SELECT o_orderkey, CAST(hour(o_orderdate) * 3600 + minute(o_orderdate) * 60 + second(o_orderdate) AS INT) AS time_of_day,
  strftime(o_orderdate, '%Y-%m-%d') AS iso_day, CAST(day(o_orderdate) AS INT) AS day_first FROM orders"""
)
def temporal_parse(spark, d):
    o = _t(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "HH:mm:ss").alias("time_of_day"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("iso_day"), F.date_format("o_orderdate", "dd/MM/yyyy").alias("day_first"),
    )
    for c in ("time_of_day", "iso_day", "day_first"):
        o = temporal.parsed(o, c, temporal.resolve(temporal.detection(o, c)))
    return o.select("o_orderkey", "time_of_day", F.date_format("iso_day", "yyyy-MM-dd").alias("iso_day"), F.dayofmonth("day_first").alias("day_first"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day FROM events WHERE ts >= '2024-01-10' AND ts < '2024-01-12'")
def period_filter(spark, d):
    e = _t(spark, d, "events")
    lo, hi = (F.to_timestamp_ntz(F.lit(f"{x} 00:00:00")) for x in ("2024-01-10", "2024-01-12"))
    return e.where((F.col("ts") >= lo) & (F.col("ts") < hi)).select("event_id", fx.period_label(F.col("ts")).alias("day"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(hour(l_shipdate) AS INT) AS h, CAST(isodow(l_shipdate) AS INT) AS dow,
  CAST(day(l_shipdate) AS INT) AS d, CAST(month(l_shipdate) AS INT) AS m, CAST(year(l_shipdate) AS INT) AS y, CAST(quarter(l_shipdate) AS INT) AS q FROM lineitem"""
)
def time_derivatives(spark, d):
    c, t = F.col("l_shipdate"), encode.TIME_PARTS
    names = {"h": "hour", "dow": "dayofweek", "d": "day", "m": "month", "y": "year", "q": "quarter"}
    return _t(spark, d, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[t[p](c).cast("int").alias(a) for a, p in names.items()]
    )


# --- encoding ---------------------------------------------------------------------


@query(
    """WITH e AS (SELECT event_id, CASE WHEN event_type <> 'error' THEN value END AS v FROM events)
SELECT event_id, coalesce(v, (SELECT quantile_cont(v, 0.5) FROM e)) AS value, CAST(v IS NULL AS DOUBLE) AS value__is_missing FROM e"""
)
def impute_median(spark, d):
    e = _t(spark, d, "events").select("event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("value"))
    enc = encode.Encoding("value", "impute_median", {"median": encode.medians(e, ["value"])["value"]}, indicator=True)
    return e.select("event_id", *[c.alias(n) for n, c in enc.features()])


@query(
    """SELECT o_orderkey, CAST(coalesce(s = 'F', false) AS DOUBLE) AS s_F, CAST(coalesce(s = 'O', false) AS DOUBLE) AS s_O,
  CAST(coalesce(s NOT IN ('F', 'O'), false) AS DOUBLE) AS s__other FROM (SELECT o_orderkey, nullif(o_orderstatus, 'O') s FROM orders)"""
)
def one_hot(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.nullif(F.col("o_orderstatus"), F.lit("O")).alias("s"))
    enc = encode.Encoding("s", "one_hot", {"categories": ["F", "O"]})
    return o.select("o_orderkey", *[c.alias(n) for n, c in enc.features()])


@query(
    """WITH p AS (SELECT p_partkey, nullif(p_brand, 'Brand#11') b FROM part), f AS (SELECT b, count(*) * 1.0 / (SELECT count(*) FROM p) f FROM p WHERE b IS NOT NULL GROUP BY b)
SELECT p_partkey, CAST(round(coalesce(f, 0), 9) AS DOUBLE) AS freq FROM p LEFT JOIN f USING (b)"""
)
def frequency_encode(spark, d):
    p = _t(spark, d, "part").select("p_partkey", F.nullif(F.col("p_brand"), F.lit("Brand#11")).alias("b"))
    return encode.with_frequency(p, "b", "freq").select("p_partkey", _r("freq", 9).alias("freq"))


@query(
    """SELECT vec_id, CAST(len(embedding) AS DOUBLE) AS e__len, 0.0::DOUBLE AS e__is_null, 0.0::DOUBLE AS e__is_empty,
  round(list_avg(embedding::DOUBLE[]), 9) AS e__mean, list_min(embedding)::DOUBLE AS e__min, list_max(embedding)::DOUBLE AS e__max FROM embeddings"""
)
def array_features(spark, d):
    cols = dict(encode.array_features("e", F.col("embedding")))
    cols["e__mean"] = _r(cols["e__mean"], 9)
    return _t(spark, d, "embeddings").select("vec_id", *[c.alias(n) for n, c in cols.items()])


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


@query(
    "WITH q AS (SELECT "
    + ", ".join(f"quantile_cont({c}, [0.25, 0.5, 0.75]) AS {c}" for c in NUMBERS)
    + " FROM lineitem) SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, "
    + ", ".join(f"round((l.{c} - q.{c}[2]) / (q.{c}[3] - q.{c}[1]), 6) AS {c}" for c in NUMBERS)
    + " FROM lineitem l, q"
)
def robust_scale(spark, d):
    li = _t(spark, d, "lineitem")
    p = encode.robust_parameters(li, NUMBERS)
    return li.select(*LINE, *[_r(encode.scaled(F.col(c), *p[c])).alias(c) for c in NUMBERS])


@query(
    "WITH e AS (SELECT "
    + ", ".join(f"quantile_cont({c}, [0.01, 0.99]) AS {c}" for c in NUMBERS)
    + " FROM lineitem), k AS (SELECT "
    + ", ".join(f"least(greatest(l.{c}, e.{c}[1]), e.{c}[2]) AS {c}" for c in NUMBERS)
    + " FROM lineitem l, e), p AS (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in NUMBERS)
    + " FROM k) SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, "
    + ", ".join(f"round((l.{c} - m_{c}) / s_{c}, 5) AS {c}" for c in NUMBERS)
    + " FROM lineitem l, p"
)
def standard_scale(spark, d):
    li = _t(spark, d, "lineitem")
    p = encode.standard_parameters(li, NUMBERS)
    return li.select(*LINE, *[_r(encode.scaled(F.col(c), *p[c]), 5).alias(c) for c in NUMBERS])


@query(
    " UNION ALL ".join(
        f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS r FROM lineitem"
        for i, a in enumerate(NUMBERS)
        for b in NUMBERS[i + 1 :]
    )
)
def correlated_pairs(spark, d):
    return encode.correlations(_t(spark, d, "lineitem"), NUMBERS).select("a", "b", _r("r").alias("r"))


@query(
    """WITH f AS (SELECT l_quantity q, l_extendedprice p FROM lineitem), r AS (SELECT corr(q, q * 2 + 0.001 * p / 1000) r FROM f)
SELECT 'l_quantity' AS feature FROM r UNION ALL SELECT 'double_quantity' FROM r WHERE abs(r) < 0.95 UNION ALL SELECT 'l_tax' FROM r"""
)
def correlation_prune(spark, d):
    li = _t(spark, d, "lineitem").select(
        "l_quantity", (F.col("l_quantity") * 2 + 0.001 * F.col("l_extendedprice") / 1000).alias("double_quantity"), "l_tax"
    )
    pairs = [(r.a, r.b, r.r) for r in encode.correlations(li, li.columns).collect()]
    return spark.createDataFrame([(c,) for c in encode.correlation_survivors(pairs, li.columns)], "feature string")


# --- detectors ----------------------------------------------------------------------

_ECOD_SQL = """
t AS (SELECT {id}, f, x, -ln(greatest(least(cume_dist() OVER (PARTITION BY f ORDER BY x), cume_dist() OVER (PARTITION BY f ORDER BY x DESC), 1.0), 1e-10)) AS term FROM long)
"""
_PART_LONG = "WITH long AS (SELECT p_partkey, 'p_size' f, CAST(p_size AS DOUBLE) x FROM part UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice FROM part), "
_PART_ECOD = _PART_LONG + _ECOD_SQL.format(id="p_partkey")
PART = ["p_size", "p_retailprice"]


@query(_PART_ECOD + "SELECT p_partkey, round(sum(term) / 2, 6) AS score FROM t GROUP BY p_partkey")
def ecod_scores(spark, d):
    return det.ecod_scores(_t(spark, d, "part"), ["p_partkey"], PART).select("p_partkey", _r("score").alias("score"))


@query(_PART_ECOD + "SELECT p_partkey, f AS feature, round(term / 2, 6) AS contribution FROM t")
def ecod_contributions(spark, d):
    t = det.ecod_terms(_t(spark, d, "part"), ["p_partkey"], PART)
    return t.select("p_partkey", "feature", _r(F.col("term") / 2).alias("contribution"))


@query(
    """WITH long AS (SELECT o_orderkey, o_orderstatus g, o_totalprice x FROM orders)
SELECT o_orderkey, g AS o_orderstatus, round(-ln(greatest(least(cume_dist() OVER (PARTITION BY g ORDER BY x), cume_dist() OVER (PARTITION BY g ORDER BY x DESC)), 1e-10)), 6) AS score FROM long"""
)
def ecod_by_group(spark, d):
    s = det.ecod_scores(_t(spark, d, "orders"), ["o_orderkey"], ["o_totalprice"], ["o_orderstatus"])
    return s.select("o_orderkey", "o_orderstatus", _r("score").alias("score"))


_HBOS = """WITH s AS (SELECT min(o_totalprice) lo, max(o_totalprice) hi, count(*) n, quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) iqr FROM orders),
k AS (SELECT *, greatest(10, least(256, CAST(ceil((hi - lo) / (2 * iqr * pow(n, -1.0 / 3))) AS INT))) k FROM s),
b AS (SELECT least(CAST(floor((o_totalprice - lo) / ((hi - lo) / k)) AS INT), k - 1) bin, count(*) c FROM orders, k GROUP BY ALL)
"""


@query(
    _HBOS
    + """SELECT o_orderkey, round(-ln(greatest(coalesce(c, 0) / (n * ((hi - lo) / k)), 1e-10)), 6) AS score FROM orders CROSS JOIN k
LEFT JOIN b ON bin = greatest(1, least(k, CAST(ceil((o_totalprice - lo) / ((hi - lo) / k)) AS INT))) - 1"""
)
def hbos_scores(spark, d):
    o = _t(spark, d, "orders")
    model = det.fit_hbos(o, ["o_totalprice"])
    return o.select("o_orderkey", _r(det.hbos_score(model)).alias("score"))


def _model_query(name: str):
    def run(spark, d):
        p = _t(spark, d, "part").select("p_partkey", *[F.col(c).cast("double").alias(c) for c in PART])
        x = encode.robust_parameters(p, PART)
        scaled = p.select("p_partkey", *[encode.scaled(F.col(c), *x[c]).alias(c) for c in PART])
        model = det.fit_detector(name, scaled, "p_partkey", PART)
        scored = model.score_frame(scaled, ["p_partkey"], "score")
        return scored.withColumn("natural_flag", F.col("score") > F.lit(model.threshold))

    run.__name__ = f"{name}_scores"
    return run


for _name in ("isolation_forest", "kmeans_distance", "one_class_svm", "lof"):
    query()(_model_query(_name))


# --- calibration and ensembles --------------------------------------------------------

_EVENT_SCORES = """WITH s AS (SELECT event_id, event_type, value, abs(value - (SELECT quantile_cont(value, 0.5) FROM events)) AS s1,
  CAST(hour(ts) AS DOUBLE) AS s2, value AS s3 FROM events),
c AS (SELECT event_id, event_type, value,
  (rank() OVER (ORDER BY s1) - 1 + count(*) OVER (PARTITION BY s1) / 2.0) / count(*) OVER () AS c1,
  (rank() OVER (ORDER BY s2) - 1 + count(*) OVER (PARTITION BY s2) / 2.0) / count(*) OVER () AS c2,
  (rank() OVER (ORDER BY s3) - 1 + count(*) OVER (PARTITION BY s3) / 2.0) / count(*) OVER () AS c3 FROM s)
"""


def _event_scores(spark, d) -> DataFrame:
    e = _t(spark, d, "events")
    m = encode.medians(e, ["value"])["value"]
    s = e.select("event_id", "event_type", "value", F.abs(F.col("value") - F.lit(m)).alias("s1"),
                 F.hour("ts").cast("double").alias("s2"), F.col("value").alias("s3"))
    for i in (1, 2, 3):
        s = scoring.calibrated(s, f"s{i}", f"c{i}")
    return s.select("event_id", "event_type", "value", "c1", "c2", "c3")


@query(_EVENT_SCORES + "SELECT event_id, round(c1, 8) AS c1, round(c2, 8) AS c2, round(c3, 8) AS c3 FROM c")
def midrank_calibration(spark, d):
    return _event_scores(spark, d).select("event_id", *[_r(c, 8).alias(c) for c in ("c1", "c2", "c3")])


@query(
    _EVENT_SCORES
    + "SELECT event_id, round(list_sort([c1, c2, c3])[2], 8) AS intersection, round(greatest(c1, c2, c3), 8) AS union_max, round((c1 + c2 + c3) / 3, 8) AS composite FROM c"
)
def ensemble_scores(spark, d):
    s, cs = _event_scores(spark, d), ["c1", "c2", "c3"]
    how = {"intersection": "intersection", "union_max": "union", "composite": "composite"}
    return s.select("event_id", *[_r(scoring.combined(cs, h), 8).alias(a) for a, h in how.items()])


@query(
    _EVENT_SCORES
    + """, r AS (SELECT rank() OVER (ORDER BY c1) + (count(*) OVER (PARTITION BY c1) - 1) / 2.0 AS r1, rank() OVER (ORDER BY c2) + (count(*) OVER (PARTITION BY c2) - 1) / 2.0 AS r2,
  rank() OVER (ORDER BY c3) + (count(*) OVER (PARTITION BY c3) - 1) / 2.0 AS r3 FROM c),
w AS (SELECT greatest(corr(r1, (r2 + r3) / 2), 0) w1, greatest(corr(r2, (r1 + r3) / 2), 0) w2, greatest(corr(r3, (r1 + r2) / 2), 0) w3 FROM r)
SELECT 'c1' AS member, round(w1 / (w1 + w2 + w3), 6) AS weight FROM w UNION ALL SELECT 'c2', round(w2 / (w1 + w2 + w3), 6) FROM w UNION ALL SELECT 'c3', round(w3 / (w1 + w2 + w3), 6) FROM w"""
)
def agreement_weights(spark, d):
    s, cs = _event_scores(spark, d), ["c1", "c2", "c3"]
    w = scoring.agreement_weights(s, cs, "event_id")
    return spark.createDataFrame(list(zip(cs, [round(x, 6) for x in w], strict=True)), "member string, weight double")


@query(
    """SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) <= round_even((SELECT count(*) FROM orders) * 0.05, 0) AS flagged FROM orders"""
)
def exact_k_flags(spark, d):
    return scoring.exact_k(_t(spark, d, "orders"), "o_totalprice", "o_orderkey", 0.05).select("o_orderkey", "flagged")


_GROUP_FLAGS = """WITH f AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) r, count(*) OVER (PARTITION BY event_type) n FROM events)
"""


@query(_GROUP_FLAGS + "SELECT event_id, event_type, CASE WHEN r <= round_even(n * 0.03, 0) THEN r ELSE 0 END AS flag_rank FROM f")
def flag_rank(spark, d):
    e = scoring.exact_k(_t(spark, d, "events"), "value", "event_id", 0.03, ["event_type"])
    ranked = scoring.flag_ranks(e, "value", "event_id", ["event_type"])
    return ranked.select("event_id", "event_type", F.col("flag_rank").cast("long").alias("flag_rank"))


@query(
    """WITH e AS (SELECT event_id, event_type, value, hour(ts) h FROM events), n AS (SELECT *, count(*) OVER (PARTITION BY event_type) ft, count(*) OVER () nn FROM e),
x AS (SELECT event_id, event_type, value,
 -ln(least(cume_dist() OVER (ORDER BY value), cume_dist() OVER (ORDER BY value DESC))) t_value, -ln(least(cume_dist() OVER (ORDER BY h), cume_dist() OVER (ORDER BY h DESC))) t_hour,
 -ln(least(cume_dist() OVER (ORDER BY ft), cume_dist() OVER (ORDER BY ft DESC))) t_type FROM n),
s AS (SELECT *, round((t_value + t_hour + t_type) / 3, 6) AS score FROM x),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, event_id) AS position, count(*) OVER () n FROM s)
SELECT event_id, event_type, score, position, position <= round_even(n * 0.05, 0) AS flagged,
 CASE WHEN t_value >= t_hour AND t_value >= t_type THEN 'value' WHEN t_hour >= t_type THEN 'ts' ELSE 'event_type' END AS top_reason
FROM r WHERE position <= 20"""
)
def ranked_preview(spark, d):
    """The 20 oddest events with the column that makes each odd."""
    e = _t(spark, d, "events")
    feats = encode.with_frequency(
        e.select("event_id", "event_type", "value", F.hour("ts").cast("double").alias("ts_hour")), "event_type", "event_type__freq"
    )
    names = ["value", "ts_hour", "event_type__freq"]
    terms = det.ecod_terms(feats, ["event_id"], names)
    wide = terms.groupBy("event_id").agg(
        _r(F.sum("term") / 3).alias("score"), *[F.max(F.when(F.col("feature") == n, F.col("term"))).alias(n) for n in names]
    )
    flagged = scoring.exact_k(wide, "score", "event_id", 0.05)
    v, h, t = (F.col(n) for n in names)
    reason = F.when((v >= h) & (v >= t), "value").when(h >= t, "ts").otherwise("event_type")
    top = flagged.orderBy(F.desc("score"), "event_id").limit(20)
    named = top.withColumn("position", F.row_number().over(Window.orderBy(F.desc("score"), "event_id")).cast("long"))
    return named.join(e.select("event_id", "event_type"), "event_id").select(
        "event_id", "event_type", "score", "position", "flagged", reason.alias("top_reason")
    )


@query(_GROUP_FLAGS + "SELECT event_id, event_type, r AS position FROM f WHERE r <= 20")
def preview_by_group(spark, d):
    p = scoring.preview(_t(spark, d, "events"), "value", "event_id", ["event_type"])
    return p.select("event_id", "event_type", F.col("position").cast("long").alias("position"))


@query(
    """WITH c AS (SELECT quantile_cont(o_totalprice, 0.95) a, quantile_cont(o_custkey, 0.95) b FROM orders)
SELECT o_orderkey, o_totalprice > a AND o_custkey > b AS by_all, o_totalprice > a OR o_custkey > b AS by_any FROM orders, c"""
)
def natural_flag_vote(spark, d):
    o = _t(spark, d, "orders")
    cut = o.agg(F.percentile("o_totalprice", 0.95).alias("a"), F.percentile("o_custkey", 0.95).alias("b")).first()
    flags = [F.col("o_totalprice") > F.lit(cut["a"]), F.col("o_custkey") > F.lit(cut["b"])]
    return o.select("o_orderkey", scoring.vote(flags, "intersection").alias("by_all"), scoring.vote(flags, "union").alias("by_any"))


# --- contrast, drift and history ---------------------------------------------------


@query(
    """WITH l AS (SELECT l_extendedprice > 90000 fl, l_quantity x, 'l_quantity' f FROM lineitem UNION ALL SELECT l_extendedprice > 90000, l_discount, 'l_discount' FROM lineitem),
g AS (SELECT f, x, sum(CAST(fl AS INT)) a, sum(CAST(NOT fl AS INT)) b FROM l GROUP BY ALL),
c AS (SELECT f, sum(a) OVER w * 1.0 / sum(a) OVER (PARTITION BY f) fa, sum(b) OVER w * 1.0 / sum(b) OVER (PARTITION BY f) fb FROM g WINDOW w AS (PARTITION BY f ORDER BY x))
SELECT f AS feature, round(max(abs(fa - fb)), 8) AS contrast_score FROM c GROUP BY f"""
)
def contrast_ks(spark, d):
    li = _t(spark, d, "lineitem").withColumn("fl", F.col("l_extendedprice") > 90000)
    k = history.contrast_ks(li, "fl", ["l_quantity", "l_discount"])
    return k.select("feature", _r("contrast_score", 8).alias("contrast_score"))


@query(
    """WITH l AS (SELECT l_extendedprice > 90000 fl, l_returnflag v, 'l_returnflag' f FROM lineitem UNION ALL SELECT l_extendedprice > 90000, l_linestatus, 'l_linestatus' FROM lineitem),
g AS (SELECT f, v, sum(CAST(fl AS INT)) a, sum(CAST(NOT fl AS INT)) b FROM l GROUP BY ALL)
SELECT f AS feature, round(sum(abs(a / na - b / nb)) / 2, 8) AS contrast_score FROM (SELECT *, sum(a) OVER (PARTITION BY f) na, sum(b) OVER (PARTITION BY f) nb FROM g) GROUP BY f"""
)
def contrast_tvd(spark, d):
    li = _t(spark, d, "lineitem").withColumn("fl", F.col("l_extendedprice") > 90000)
    k = history.contrast_tvd(li, "fl", ["l_returnflag", "l_linestatus"])
    return k.select("feature", _r("contrast_score", 8).alias("contrast_score"))


_TOTALS = """WITH tot AS (SELECT event_type, strftime(ts, '%Y-%m-%d') AS period_label, count(*) FILTER (value > 80) AS anomaly_count, count(*) AS population FROM events GROUP BY ALL)
"""


def _totals(spark, d) -> DataFrame:
    e = _t(spark, d, "events").withColumn("flag", F.col("value") > 80)
    return history.totals(e, "ts", ["event_type"], "flag")


@query(_TOTALS + "SELECT *, round(anomaly_count / population, 8) AS rate FROM tot")
def period_totals(spark, d):
    return _totals(spark, d).withColumn("rate", _r("rate", 8))


@query(
    "SELECT event_id, strftime(ts::DATE - CAST(greatest(isodow(ts) - 5, 0) AS INT), '%Y-%m-%d') AS business_day, strftime(date_trunc('week', ts), '%Y-%m-%d') AS week, strftime(ts, '%Y-%m') AS month FROM events"
)
def business_day_roll(spark, d):
    ts = F.col("ts")
    return _t(spark, d, "events").select(
        "event_id", fx.period_label(ts, "day", True).alias("business_day"), fx.period_label(ts, "week").alias("week"), fx.period_label(ts, "month").alias("month")
    )


_WILSON = "({p} + 3.8414588206941254 / (2 * {n}) {s} 1.959963984540054 * sqrt({p} * (1 - {p}) / {n} + 3.8414588206941254 / (4 * {n} * {n}))) / (1 + 3.8414588206941254 / {n})"


@query(
    _TOTALS
    + f""", w AS (SELECT unnest([1, 7, 14]) AS window_size), z AS (SELECT window_size, event_type, date_diff('day', period_label::DATE, DATE '2024-01-28') age, anomaly_count c, population n FROM tot, w),
g AS (SELECT window_size, event_type, sum(c) FILTER (age < window_size) cc, sum(n) FILTER (age < window_size) cp, sum(c) FILTER (age >= window_size) pc, sum(n) FILTER (age >= window_size) pp FROM z WHERE age >= 0 AND age < 2 * window_size GROUP BY ALL),
s AS (SELECT window_size, sum(cc)::BIGINT cc, sum(cp)::BIGINT cp, sum(pc)::BIGINT pc, sum(pp)::BIGINT pp FROM g WHERE cp IS NOT NULL AND pp IS NOT NULL GROUP BY ALL)
SELECT window_size, cc AS current_count, cp AS current_population, pc AS prior_count, pp AS prior_population, round(cc / cp, 8) AS current_rate, round(pc / pp, 8) AS prior_rate,
 round({_WILSON.format(p='(cc / cp)', n='cp', s='-')}, 6) AS current_low, round({_WILSON.format(p='(cc / cp)', n='cp', s='+')}, 6) AS current_high,
 round(cc / cp - pc / pp, 8) AS absolute_change, CASE WHEN pc >= 10 THEN round((cc / cp - pc / pp) / (pc / pp), 6) END AS pct_change FROM s"""
)
def rolling_windows(spark, d):
    w = history.rolling_windows(_totals(spark, d), "2024-01-28", [1, 7, 14], ["event_type"])
    return w.select(
        "window_size", "current_count", "current_population", "prior_count", "prior_population", _r("current_rate", 8).alias("current_rate"),
        _r("prior_rate", 8).alias("prior_rate"), _r("current_low").alias("current_low"), _r("current_high").alias("current_high"),
        _r("absolute_change", 8).alias("absolute_change"), _r("pct_change").alias("pct_change"),
    )


@query(
    f"""WITH s AS (SELECT o_orderstatus, count(*) FILTER (o_totalprice > 200000) c, count(*) n FROM orders GROUP BY ALL)
SELECT o_orderstatus, c, n, round(greatest({_WILSON.format(p='(c / n)', n='n', s='-')}, 0), 6) AS low, round(least({_WILSON.format(p='(c / n)', n='n', s='+')}, 1), 6) AS high FROM s"""
)
def wilson_interval(spark, d):
    s = _t(spark, d, "orders").groupBy("o_orderstatus").agg(
        F.sum((F.col("o_totalprice") > 200000).cast("long")).alias("c"), F.count(F.lit(1)).alias("n")
    )
    low, high = fx.wilson(F.col("c"), F.col("n"))
    return s.select("o_orderstatus", "c", "n", _r(low).alias("low"), _r(high).alias("high"))


@query(
    """WITH a AS (SELECT event_type, count(*) * 1.0 / sum(count(*)) OVER () p FROM events WHERE ts < '2024-01-15' GROUP BY 1), b AS (SELECT event_type, count(*) * 1.0 / sum(count(*)) OVER () q FROM events WHERE ts >= '2024-01-15' GROUP BY 1),
j AS (SELECT greatest(coalesce(p, 0), 1e-4) p, greatest(coalesce(q, 0), 1e-4) q FROM a FULL JOIN b USING (event_type)), s AS (SELECT sum((q - p) * ln(q / p)) psi FROM j)
SELECT round(psi, 8) AS psi, CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS band FROM s"""
)
def categorical_psi(spark, d):
    e = _t(spark, d, "events")
    cut = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    p = history.categorical_psi(e.where(F.col("ts") < cut), e.where(F.col("ts") >= cut), "event_type")
    return p.select(_r("psi", 8).alias("psi"), "band")


@query(
    "SELECT event_type, count(value) AS n, count(*) - count(value) AS missing, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.99), 6) AS p99, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std FROM events GROUP BY ALL"
)
def numeric_summary(spark, d):
    s = history.numeric_summary(_t(spark, d, "events"), "value", ["event_type"])
    return s.select(
        "event_type", "n", "missing", _r(F.element_at("percentiles", 51)).alias("median"), _r(F.element_at("percentiles", 100)).alias("p99"),
        _r("mean").alias("mean"), _r("std").alias("std"),
    )


@query(
    """WITH r AS (SELECT event_type g, CASE WHEN ts >= '2024-01-15' THEN 1 ELSE 0 END s, count(*) n, sum(CAST(value > 60 AS INT)) own, sum(CAST(value > 70 AS INT)) anc FROM events GROUP BY ALL),
p AS (SELECT g, max(n) FILTER (s = 1) n1, max(n) FILTER (s = 0) n0, max(own) FILTER (s = 1) o1, max(own) FILTER (s = 0) o0, max(anc) FILTER (s = 1) a1, max(anc) FILTER (s = 0) a0 FROM r GROUP BY g)
SELECT round(sum((n1 - n0) * (o0 / n0)), 5) AS volume, round(sum(n1 * (a1 / n1 - a0 / n0)), 5) AS score_drift, round(sum(n1 * ((o1 / n1 - a1 / n1) - (o0 / n0 - a0 / n0))), 5) AS threshold_drift,
 CAST(sum(o1 - o0) AS DOUBLE) AS count_change, count(*) AS groups_used FROM p WHERE n1 > 0 AND n0 > 0"""
)
def count_decomposition(spark, d):
    cut = F.to_timestamp_ntz(F.lit("2024-01-15 00:00:00"))
    rows = _t(spark, d, "events").groupBy("event_type", F.when(F.col("ts") >= cut, "current").otherwise("prior").alias("side")).agg(
        F.count(F.lit(1)).alias("n"), F.sum((F.col("value") > 60).cast("long")).alias("own"), F.sum((F.col("value") > 70).cast("long")).alias("anchor")
    )
    out = history.decomposition(rows, ["event_type"])
    return out.select(*[_r(c, 5).alias(c) for c in ("volume", "score_drift", "threshold_drift")], "count_change", "groups_used")


@query(
    """WITH e AS (SELECT strftime(unnest(generate_series(DATE '2024-01-10', DATE '2024-02-10', INTERVAL 1 DAY)), '%Y-%m-%d') period_label), c AS (SELECT DISTINCT strftime(ts, '%Y-%m-%d') period_label FROM events)
SELECT period_label FROM e WHERE period_label NOT IN (SELECT period_label FROM c) OR period_label = '2024-01-12'"""
)
def pending_periods(spark, d):
    expected = spark.range(1).select(F.explode(history.expected_days("2024-01-10", "2024-02-10")).alias("period_label"))
    return history.pending_periods(expected, _totals(spark, d), ["2024-01-12"])


# --- evaluation ----------------------------------------------------------------------

_LABELLED = "WITH s AS (SELECT d.doc_id, n_chars AS score, quality AS y FROM documents d JOIN labels USING (doc_id)), "


def _labelled(spark, d) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score")).join(
        _t(spark, d, "labels").select("doc_id", F.col("quality").alias("y")), "doc_id"
    )


@query(
    _LABELLED
    + """r AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 rk FROM s), p AS (SELECT sum(y) np, count(*) - sum(y) nn FROM s),
g AS (SELECT score, sum(y) pos, count(*) n FROM s GROUP BY score), a AS (SELECT pos, sum(pos) OVER w cp, sum(n) OVER w cn FROM g WINDOW w AS (ORDER BY score DESC))
SELECT round((SELECT sum(rk) FILTER (y = 1) FROM r) / (np * nn) - (np + 1) / (2.0 * nn), 6) AS roc_auc, round((SELECT sum(pos * cp / cn) FROM a) / np, 6) AS average_precision FROM p"""
)
def roc_auc_ap(spark, d):
    m = evaluate.ranking_metrics(_labelled(spark, d), "score", "y")
    return m.select(_r("roc_auc").alias("roc_auc"), _r("average_precision").alias("average_precision"))


@query(
    _LABELLED
    + """f AS (SELECT CAST(score > 2000 AS INT) f, y FROM s), c AS (SELECT sum(f * y) tp, sum(f * (1 - y)) fp, sum((1 - f) * y) fn, sum((1 - f) * (1 - y)) tn FROM f)
SELECT round(tp / (tp + fp), 8) AS precision, round(tp / (tp + fn), 8) AS recall, round(2 * tp / (2 * tp + fp + fn), 8) AS f1, round(fp / (fp + tn), 8) AS false_positive_rate FROM c"""
)
def flag_metrics(spark, d):
    m = evaluate.flag_metrics(_labelled(spark, d).withColumn("f", F.col("score") > 2000), "f", "y")
    return m.select(*[_r(c, 8).alias(c) for c in m.columns])


@query(
    _LABELLED
    + """t AS (SELECT * FROM s ORDER BY score DESC, doc_id LIMIT (SELECT CAST(greatest(1, round_even(count(*) * 0.1, 0)) AS BIGINT) FROM s))
SELECT round(sum(y) / count(*), 8) AS precision_at_k, round(sum(y) / (SELECT sum(y) FROM s), 8) AS recall_at_k,
 round(2 * (sum(y) / count(*)) * (sum(y) / (SELECT sum(y) FROM s)) / (sum(y) / count(*) + sum(y) / (SELECT sum(y) FROM s)), 8) AS f1_at_k FROM t"""
)
def top_k_metrics(spark, d):
    m = evaluate.at_k(_labelled(spark, d), "score", "y", "doc_id", 0.1)
    return m.select(*[_r(c, 8).alias(c) for c in m.columns])


@query(
    """WITH f AS (SELECT o_totalprice > 150000 a, o_custkey % 2 = 0 b, rank() OVER (ORDER BY o_totalprice) + (count(*) OVER (PARTITION BY o_totalprice) - 1) / 2.0 ra, rank() OVER (ORDER BY o_custkey) + (count(*) OVER (PARTITION BY o_custkey) - 1) / 2.0 rb FROM orders)
SELECT round(sum(CAST(a AND b AS INT)) / sum(CAST(a OR b AS INT)), 8) AS jaccard, round(corr(ra, rb), 6) AS spearman FROM f"""
)
def agreement_metrics(spark, d):
    o = _t(spark, d, "orders").select("o_totalprice", "o_custkey", (F.col("o_totalprice") > 150000).alias("a"), (F.col("o_custkey") % 2 == 0).alias("b"))
    j, s = evaluate.flag_jaccard(o, "a", "b"), evaluate.spearman(o, "o_totalprice", "o_custkey")
    return j.crossJoin(s).select(_r("jaccard", 8).alias("jaccard"), _r("spearman").alias("spearman"))


# --- explanations, sinks, ledger --------------------------------------------------


@query(
    """WITH q AS (SELECT 'p_size' f, quantile_cont(p_size, [0.25, 0.5, 0.75]) q FROM part UNION ALL SELECT 'p_retailprice', quantile_cont(p_retailprice, [0.25, 0.5, 0.75]) FROM part)
SELECT f AS feature, round(q[2], 6) AS median, round((q[3] - q[1]) / 1.349, 6) AS scale FROM q"""
)
def reference_scales(spark, d):
    s = explain.reference_scales(_t(spark, d, "part"), PART)
    return s.select("feature", _r("median").alias("median"), _r("scale").alias("scale"))


@query(_PART_ECOD + """, r AS (SELECT p_partkey, f, round(term / 2, 6) m FROM t)
SELECT p_partkey, f AS original, m AS magnitude, row_number() OVER (PARTITION BY p_partkey ORDER BY m DESC, f) AS reason_rank FROM r QUALIFY reason_rank <= 1""")
def top_reasons(spark, d):
    t = det.ecod_terms(_t(spark, d, "part"), ["p_partkey"], PART).withColumn("term", _r(F.col("term") / 2))
    r = explain.top_reasons(explain.to_original(t, "p_partkey", {}), "p_partkey", 1)
    return r.select("p_partkey", "original", "magnitude", F.col("reason_rank").cast("long").alias("reason_rank"))


@query(
    """SELECT doc_id, CASE WHEN regexp_matches(t, '^[=+\\-@\\t\\r\\n]') THEN '''' || t ELSE t END AS text FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '=' || text ELSE text END AS t FROM documents)"""
)
def csv_neutralise(spark, d):
    t = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("="), F.col("text"))).otherwise(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", fx.neutralised(t).alias("text"))


@query(_TOTALS + "SELECT max(period_label) AS period_label FROM tot WHERE population > 0")
def last_complete_period(spark, d):
    p = _totals(spark, d).withColumn("config_hash", F.lit("c")).withColumn("status", F.when(F.col("population") > 0, "complete"))
    return ledger.last_complete(p, "c")


@query(
    """SELECT o_orderkey AS artifact_id FROM orders WHERE o_orderdate < '1996-01-01' UNION SELECT o_orderkey FROM orders JOIN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) ON o_custkey = c_custkey"""
)
def prune_eligible(spark, d):
    a = _t(spark, d, "orders").select(F.col("o_orderkey").alias("artifact_id"), F.col("o_custkey").alias("run_id"), F.col("o_orderdate").alias("created_at"))
    r = _t(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.when(F.col("c_acctbal") < 0, "failed").otherwise("ok").alias("status"))
    return ledger.prune_eligible(a, r, F.to_timestamp_ntz(F.lit("1996-01-01 00:00:00")))


@query("SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_evidence(spark, d):
    return ledger.latest_in_scope(_t(spark, d, "orders"), ["o_custkey"], "o_orderdate", "o_orderkey").select("o_custkey", "o_orderkey")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def explanation_join(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("row_id"))
    c = _t(spark, d, "customer").select(F.col("c_custkey").alias("row_id"), "c_name", "c_mktsegment")
    return ledger.with_explanations(o, c, "row_id").select("o_orderkey", "c_name", "c_mktsegment")


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 100")
def minimum_group_size(spark, d):
    return _t(spark, d, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n")).where("n >= 100")


# --- whole runs -------------------------------------------------------------------------


def _orders_with_id(spark, d) -> DataFrame:
    return readers.with_row_id(_t(spark, d, "orders"), id_column="o_orderkey")


@query()
def run_detection(spark, d):
    cfg = Config.from_dict({"columns": {"id_column": "o_orderkey"}, "scoring": {"contamination": 0.05}})
    return detection.run_detection(_orders_with_id(spark, d), cfg)[1]


@query()
def score_forward(spark, d):
    cfg = Config.from_dict({"columns": {"id_column": "o_orderkey"}, "scoring": {"detectors": ["isolation_forest"]}})
    o = _orders_with_id(spark, d)
    fitted = detection.Fitted.from_json(detection.fit(o, cfg).to_json())
    return detection.score_forward(o, fitted, cfg)


@query()
def detection_reasons(spark, d):
    cfg = Config.from_dict({"columns": {"id_column": "o_orderkey"}, "scoring": {"contamination": 0.01, "detectors": ["isolation_forest", "kmeans_distance"]}})
    o = _orders_with_id(spark, d)
    fitted, ranked = detection.run_detection(o, cfg)
    return detection.reasons(o, ranked, fitted, cfg)


_RUN = """WITH c AS (SELECT c_custkey AS id, c_mktsegment AS g, c_acctbal AS raw FROM customer),
m AS (SELECT quantile_cont(raw, 0.5) med, quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25) iqr FROM c),
x AS (SELECT id, {g} AS g, (raw - med) / iqr AS s FROM c, m),
e AS (SELECT *, -ln(greatest(least(cume_dist() OVER (PARTITION BY g ORDER BY s), cume_dist() OVER (PARTITION BY g ORDER BY s DESC)), 1e-10)) AS raw_ecod FROM x),
r AS (SELECT g, min(s) lo, max(s) hi, count(*) n, quantile_cont(s, 0.75) - quantile_cont(s, 0.25) q FROM x GROUP BY g),
k AS (SELECT *, greatest(10, least(256, CAST(ceil((hi - lo) / (2 * q * pow(n, -1.0 / 3))) AS INT))) k FROM r),
b AS (SELECT x.g, least(CAST(floor((s - lo) / ((hi - lo) / k)) AS INT), k - 1) bin, count(*) c FROM x JOIN k USING (g) GROUP BY ALL),
h AS (SELECT e.*, -ln(greatest(coalesce(c, 0) / (n * ((hi - lo) / k)), 1e-10)) AS raw_hbos FROM e JOIN k USING (g)
  LEFT JOIN b ON b.g = e.g AND bin = greatest(1, least(k, CAST(ceil((s - lo) / ((hi - lo) / k)) AS INT))) - 1),
y AS (SELECT *, (rank() OVER (PARTITION BY g ORDER BY raw_ecod) - 1 + count(*) OVER (PARTITION BY g, raw_ecod) / 2.0) / count(*) OVER (PARTITION BY g) AS cal_ecod,
  (rank() OVER (PARTITION BY g ORDER BY raw_hbos) - 1 + count(*) OVER (PARTITION BY g, raw_hbos) / 2.0) / count(*) OVER (PARTITION BY g) AS cal_hbos FROM h),
z AS (SELECT *, (cal_ecod + cal_hbos) / 2 AS score FROM y),
f AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY score DESC, id) AS r, count(*) OVER (PARTITION BY g) AS n FROM z)
SELECT id AS c_custkey, {out}round(score, 6) AS score, r <= round_even(n * 0.05, 0) AS flagged, CASE WHEN r <= round_even(n * 0.05, 0) THEN r ELSE 0 END AS flag_rank FROM f"""


def _customer_run(spark, d, **columns):
    cfg = Config.from_dict({
        "columns": {"id_column": "c_custkey", **columns}, "profiling": {"include_only": ["c_acctbal"]},
        "scoring": {"detectors": ["ecod", "hbos"], "contamination": 0.05, "min_records": 20},
    })
    df = readers.with_row_id(_t(spark, d, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), id_column="c_custkey")
    return cfg, df, *detection.run_detection(df, cfg)


@query(_RUN.format(g="0", out=""))
def run_detection_distributions(spark, d):
    """A whole run, from the plan to the ranking, with the two detectors that SQL can express."""
    ranked = _customer_run(spark, d)[3]
    return ranked.select(F.col(readers.ROW_ID).alias("c_custkey"), _as_sql("score").alias("score"), "flagged", F.col("flag_rank").cast("long").alias("flag_rank"))


@query(_RUN.format(g="g", out="g AS c_mktsegment, "))
def run_detection_by_group(spark, d):
    """The same for each group: one plan, but detectors, calibrators, cuts and ranks of the group's own rows."""
    _, df, _, ranked = _customer_run(spark, d, group_by=["c_mktsegment"])
    named = ranked.join(df.select(readers.ROW_ID, "c_mktsegment"), readers.ROW_ID)
    return named.select(
        F.col(readers.ROW_ID).alias("c_custkey"), "c_mktsegment", _as_sql("score").alias("score"), "flagged", F.col("flag_rank").cast("long").alias("flag_rank")
    )


@query(
    """WITH c AS (SELECT c_custkey AS id, c_acctbal AS a, CAST(c_nationkey AS DOUBLE) AS b FROM customer),
t AS (SELECT *, -ln(greatest(least(cume_dist() OVER (ORDER BY a), cume_dist() OVER (ORDER BY a DESC)), 1e-10)) / 2 AS ta,
  -ln(greatest(least(cume_dist() OVER (ORDER BY b), cume_dist() OVER (ORDER BY b DESC)), 1e-10)) / 2 AS tb FROM c),
s AS (SELECT *, ta + tb AS raw, count(*) OVER () AS n FROM t),
y AS (SELECT *, (rank() OVER (ORDER BY round(raw, 9)) - 1 + count(*) OVER (PARTITION BY round(raw, 9)) / 2.0) / n AS score FROM s),
f AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) <= round_even(n * 0.05, 0) AS flagged, raw > quantile_cont(raw, 0.95) OVER () AS natural_flag FROM y),
m AS (SELECT median(a) AS ma, median(b) AS mb FROM f WHERE NOT flagged AND NOT natural_flag),
l AS (SELECT id, 'c_acctbal' AS original_field, ta AS v, CASE WHEN a > ma THEN 'above' WHEN a < ma THEN 'below' ELSE 'same' END AS direction FROM f, m WHERE flagged
  UNION ALL SELECT id, 'c_nationkey', tb, CASE WHEN b > mb THEN 'above' WHEN b < mb THEN 'below' ELSE 'same' END FROM f, m WHERE flagged)
SELECT id AS c_custkey, original_field, round(v, 6) AS magnitude, direction, 'ok' AS explain_status, 'exact' AS attribution_kind, 'consensus_normal' AS reference_id FROM l"""
)
def explanation_records(spark, d):
    """Records and statuses of a run's flagged rows, of the detector whose terms are exact."""
    cfg = Config.from_dict({
        "columns": {"id_column": "c_custkey"}, "profiling": {"include_only": ["c_acctbal", "c_nationkey"]},
        "features": {"correlation_reduction": False}, "scoring": {"detectors": ["ecod"], "contamination": 0.05},
    })
    df = readers.with_row_id(_t(spark, d, "customer").select("c_custkey", "c_acctbal", "c_nationkey"), id_column="c_custkey")
    fitted, ranked = detection.run_detection(df, cfg)
    rows, records = detection.explain(df, ranked, fitted, cfg)
    return records.join(rows.select(readers.ROW_ID, "explain_status"), readers.ROW_ID).select(
        F.col(readers.ROW_ID).alias("c_custkey"), "original_field", _r("contribution_magnitude").alias("magnitude"), "direction",
        "explain_status", "attribution_kind", "reference_id",
    )


def _scored_batches(df, key, cols, of, names):
    """Columns ``names`` that ``of`` makes of the matrix of each Arrow batch."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], **dict(zip(names, of(pdf[cols].to_numpy(float)).T, strict=True))})

    return df.mapInPandas(run, f"{key} long, " + ", ".join(f"{n} double" for n in names))


@query(
    _HBOS
    + """SELECT o_orderkey, round(-ln(greatest(coalesce(c, 0) / (n * ((hi - lo) / k)), 1e-10)) / 2, 6) AS t_price,
 round(-ln(greatest(coalesce(c, 0) / (n * ((hi - lo) / k)), 1e-10)) / 2 + ln(2.0) / 2, 6) AS t_twice FROM orders CROSS JOIN k
LEFT JOIN b ON bin = greatest(1, least(k, CAST(ceil((o_totalprice - lo) / ((hi - lo) / k)) AS INT))) - 1"""
)
def hbos_contributions(spark, d):
    """What each of two columns adds to a fitted histogram model's score; one is twice the other, so its bins are twice as wide."""
    import numpy as np

    cols = ["o_totalprice", "twice"]
    o = _t(spark, d, "orders").select("o_orderkey", "o_totalprice", (F.col("o_totalprice") * 2).alias("twice"))
    x = np.column_stack([o.select(*cols).toArrow().column(c).to_numpy() for c in cols])
    model = det.Hbos.fit(x, cols, 0)
    t = _scored_batches(o, "o_orderkey", cols, model.terms, ["t_price", "t_twice"])
    return t.select("o_orderkey", _r("t_price").alias("t_price"), _r("t_twice").alias("t_twice"))


_CENTRES = """WITH p AS (SELECT p_partkey, p_retailprice AS a, CAST(p_size AS DOUBLE) AS b FROM part),
q AS (SELECT *, (a - 1000) * (a - 1000) + (b - 10) * (b - 10) AS d1, (a - 1500) * (a - 1500) + (b - 40) * (b - 40) AS d2 FROM p)
"""


@query(_CENTRES + "SELECT p_partkey, round(abs(a - CASE WHEN d1 <= d2 THEN 1000 ELSE 1500 END) / 100, 6) AS t_price, round(abs(b - CASE WHEN d1 <= d2 THEN 10 ELSE 40 END) / 5, 6) AS t_size FROM q")
def centroid_terms(spark, d):
    """Distance from the nearest of two centres, column by column, in robust units."""
    import numpy as np

    p = _t(spark, d, "part").select("p_partkey", "p_retailprice", F.col("p_size").cast("double").alias("p_size"))
    of = lambda x: explain.centroid_deviation(x, np.array([[1000.0, 10.0], [1500.0, 40.0]]), np.array([100.0, 5.0]))
    t = _scored_batches(p, "p_partkey", ["p_retailprice", "p_size"], of, ["t_price", "t_size"])
    return t.select("p_partkey", _r("t_price").alias("t_price"), _r("t_size").alias("t_size"))


@query("SELECT o_orderstatus AS g, [round(quantile_cont(o_totalprice, 0.1), 4), round(quantile_cont(o_totalprice, 0.5), 4), round(quantile_cont(o_totalprice, 0.93), 4)][i] AS q, CAST(i AS INT) AS i FROM orders, (SELECT unnest([1, 2, 3]) AS i) GROUP BY o_orderstatus, i")
def group_quantiles(spark, d):
    """Exact quantiles by group from cumulative counts."""
    q = ranks.quantiles(_t(spark, d, "orders"), "o_totalprice", ["o_orderstatus"], [0.1, 0.5, 0.93])
    return q.select(F.col("o_orderstatus").alias("g"), F.posexplode("q").alias("at", "v")).select("g", _r("v", 4).alias("q"), (F.col("at") + 1).alias("i"))


@query(
    """WITH p AS (SELECT o_orderstatus AS g, o_orderpriority AS v, count(*) AS c FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY c DESC, v) AS r FROM p)
SELECT g, CAST(sum(c) AS BIGINT) AS n, count(*) AS n_unique, max(CASE WHEN r = 1 THEN v END) AS commonest, CAST(max(CASE WHEN r = 1 THEN c END) AS BIGINT) AS commonest_n FROM r GROUP BY g"""
)
def field_statistics(spark, d):
    """The text side of a period's statistics: commonest values, distinct ones, by group."""
    from oddrank.plans import trend

    o = _t(spark, d, "orders").select(F.col("o_orderstatus").alias("g"), "o_orderpriority")
    s = trend.field_statistics(o, ["o_orderpriority"], ["g"])
    return s.select("g", "n", "n_unique", F.col("top")[0]["value"].alias("commonest"), F.col("top")[0]["n"].alias("commonest_n"))


@query(
    """WITH m AS (SELECT covar_pop(l_quantity, l_quantity) a, covar_pop(l_quantity, l_discount * 100) b, covar_pop(l_discount * 100, l_discount * 100) c FROM lineitem),
e AS (SELECT (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) l1, a + c AS t FROM m) SELECT 'pc_1' AS component, round(l1 / t, 6) AS explained FROM e"""
)
def principal_components(spark, d):
    from oddrank.operators import reduce

    li = _t(spark, d, "lineitem").select("l_quantity", (F.col("l_discount") * 100).alias("d"))
    c = reduce.fit_components(li, ["l_quantity", "d"])
    return spark.createDataFrame([(f"pc_{i + 1}", round(x, 6)) for i, x in enumerate(c.explained)], "component string, explained double")


from oddrank import more_queries  # noqa: E402, F401  registers its queries here
