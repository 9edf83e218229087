"""Further registered queries: sources and sinks round trip, filters, encodings, references, ledger, streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrank.config import Config
from oddrank.functions import columns as fx
from oddrank.operators import encode, evaluate, explain, history, ledger, profile, scoring, temporal
from oddrank.plans import detection
from oddrank.queries import _r, _t, query
from oddrank.sources import readers, shared, sinks
from oddrank.streaming import score as streaming

_NATION = "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation"


def _through(spark, d, fmt: str, suffix: str, **options) -> DataFrame:
    """The nations, written in a format and read back by the engine's reader."""
    path = shared.new_path(spark, "nation") + suffix
    n = _t(spark, d, "nation").select("n_nationkey", "n_name", "n_regionkey")
    n.coalesce(1).write.options(**options).format(fmt).save(path)
    kind = readers.detect_format(path)
    return readers.read(spark, path, kind).select(F.col("n_nationkey").cast("long"), "n_name", F.col("n_regionkey").cast("long"))


@query(_NATION)
def read_csv(spark, d):
    return _through(spark, d, "csv", ".csv", header=True)


@query(_NATION)
def read_tsv(spark, d):
    return _through(spark, d, "csv", ".tsv", header=True, sep="\t")


@query(_NATION)
def read_jsonl(spark, d):
    return _through(spark, d, "json", ".jsonl")


@query(_NATION)
def read_gzip(spark, d):
    return _through(spark, d, "csv", ".csv.gz", header=True, compression="gzip")


@query(_NATION)
def read_orc(spark, d):
    return _through(spark, d, "orc", ".orc")


@query(_NATION)
def read_json_document(spark, d):
    path = shared.new_path(spark, "nation") + ".json"
    rows = _t(spark, d, "nation").select(F.struct("n_nationkey", "n_name", "n_regionkey").alias("r"))
    sinks.write_text(spark, path, rows.agg(F.to_json(F.collect_list("r")).alias("t")).first()["t"])
    return readers.read(spark, path).select("n_nationkey", "n_name", "n_regionkey")


@query("SELECT 'r' || r_regionkey AS name, CAST(r_regionkey AS DOUBLE) AS value_0, CASE WHEN r_regionkey > 1 THEN CAST(r_regionkey AS DOUBLE) * 2.5 END AS value_1 FROM region")
def read_series(spark, d):
    path = shared.new_path(spark, "region") + ".tsf"
    r = _t(spark, d, "region").orderBy("r_regionkey").collect()
    lines = ["# a note", "@attribute name string", "@data"]
    lines += [f"r{x.r_regionkey}:{x.r_regionkey}" + (f",{x.r_regionkey * 2.5}" if x.r_regionkey > 1 else ",?" if x.r_regionkey else "") for x in r]
    sinks.write_text(spark, path, "\n".join(lines))
    return readers.read(spark, path)


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 100")
def head_of_rows(spark, d):
    """The first rows by identity, as ``run.max_rows`` takes them."""
    return readers.head_rows(readers.with_row_id(_t(spark, d, "orders"), id_column="o_orderkey"), readers.ROW_ID, 100).select("o_orderkey")


@query("SELECT o_orderkey, o_orderstatus AS group_key, o_totalprice FROM orders WHERE o_totalprice > 200000")
def written_anomalies(spark, d):
    """Rows written as a result of a run, by group, and read back."""
    root = shared.new_path(spark, "sink")
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("group_key"), "o_totalprice").where("o_totalprice > 200000")
    sinks.write_result(o, f"{root}/results", "anomalies", "0011", ["group_key", "o_orderkey"])
    return sinks.read_result(spark, root, "anomalies", "0011").select("o_orderkey", "group_key", "o_totalprice")


@query("SELECT doc_id, length(CASE WHEN regexp_matches(lang, '^[=+@-]') THEN '''' || lang ELSE lang END) AS n FROM documents")
def exported_csv(spark, d):
    """A table exported for spreadsheets and read back."""
    path = shared.new_path(spark, "export") + ".csv"
    sinks.export_csv(_t(spark, d, "documents").select("doc_id", "lang"), path)
    return readers.read(spark, path, "csv").select(F.col("doc_id").cast("long").alias("doc_id"), F.length("lang").cast("long").alias("n"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def forced_formats(spark, d):
    """Dates from texts of a declared pattern and from seconds and milliseconds."""
    o = _t(spark, d, "orders").select(
        "o_orderkey", F.col("o_orderkey") % 3, F.date_format("o_orderdate", "dd|MM|yyyy").alias("a"),
        F.unix_timestamp(F.col("o_orderdate").cast("timestamp")).cast("string").alias("s"),
        F.unix_millis(F.col("o_orderdate").cast("timestamp")).cast("string").alias("ms"),
    )
    pick = (
        F.when(F.col("o_orderkey") % 3 == 0, temporal.forced(F.col("a"), "dd|MM|yyyy"))
        .when(F.col("o_orderkey") % 3 == 1, temporal.forced(F.col("s"), "epoch_s"))
        .otherwise(temporal.forced(F.col("ms"), "epoch_ms"))
    )
    return o.select("o_orderkey", F.date_format(pick, "yyyy-MM-dd").alias("day"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, extract(hour FROM o_orderdate) * 3600 AS clock FROM orders")
def replayed_dates(spark, d):
    """Text columns that were found to hold dates and times, read as the recorded decisions say, twice."""
    o = _t(spark, d, "orders").select(
        "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"), F.date_format("o_orderdate", "HH:mm").alias("clock")
    )
    told, _ = temporal.detect(o, Config())
    again = temporal.replay(temporal.replay(o, told), told)
    return again.select("o_orderkey", F.date_format("day", "yyyy-MM-dd").alias("day"), F.col("clock").cast("long").alias("clock"))


@query("SELECT c_custkey, c_mktsegment AS label FROM customer WHERE c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_mktsegment LIKE '%U%' GROUP BY 1 ORDER BY 1 LIMIT 2)")
def selected_groups(spark, d):
    """Rows of the groups that the selectors name: by pattern, the first two by label."""
    cfg = Config.from_dict({"columns": {"group_by": ["c_mktsegment"]}, "groups": {"pattern": "U", "limit": 2}})
    c = _t(spark, d, "customer").select("c_custkey", "c_mktsegment")
    chosen = detection.select_groups(c, cfg)
    return c.where(detection.key_of(c, cfg).isin(list(chosen))).select("c_custkey", F.col("c_mktsegment").alias("label"))


@query("SELECT g, count(*) AS n FROM (SELECT CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END AS g FROM orders) GROUP BY g")
def null_safe_groups(spark, d):
    """Group slices by key: a missing value is a group of its own."""
    o = _t(spark, d, "orders").select(F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("g"))
    cfg = Config.from_dict({"columns": {"group_by": ["g"]}})
    keys = {r.key: r.g for r in o.select("g", detection.key_of(o, cfg).alias("key")).distinct().collect()}
    counted = o.groupBy(detection.key_of(o, cfg).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    named = spark.createDataFrame(list(keys.items()), "key string, g string")
    return counted.join(named, "key").select("g", "n")


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size END IS NULL AS missing, coalesce(CASE WHEN p_size % 2 = 0 THEN NULL ELSE p_size END, 0) > 25 AS big FROM part")
def indicators_and_booleans(spark, d):
    """The indicator of a missing value, and booleans as numbers in which a missing one is 0."""
    p = _t(spark, d, "part").select("p_partkey", F.when(F.col("p_size") % 2 != 0, F.col("p_size")).alias("x"))
    p = p.withColumn("b", F.col("x") > 25)
    feats = dict(encode.Encoding("x", "indicator_only").features()) | dict(encode.Encoding("b", "cast_int").features())
    return p.select("p_partkey", (feats["x__is_missing"] == 1).alias("missing"), (feats["b"] == 1).alias("big"))


@query("SELECT 'a' AS c, CAST(sum(CASE WHEN p_size = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM part")
def infinity_counts(spark, d):
    p = _t(spark, d, "part").select(F.when(F.col("p_size") == 1, float("inf")).otherwise(F.col("p_size").cast("double")).alias("a"))
    return p.agg(F.sum((F.abs("a") == float("inf")).cast("long")).alias("n")).select(F.lit("a").alias("c"), "n")


@query("SELECT o_orderkey, CAST(0.5 AS DOUBLE) AS flat, CAST(CASE WHEN o_totalprice < 100000 THEN 0 WHEN o_totalprice < 200000 THEN 0.25 WHEN o_totalprice < 300000 THEN 0.75 ELSE 1 END AS DOUBLE) AS at FROM orders")
def stored_calibration(spark, d):
    """New scores against stored points: the highest point that isn't above; a reference of one value only tells above from below."""
    points = [(100000.0, 0.25), (200000.0, 0.75), (300000.0, 1.0)]
    o = _t(spark, d, "orders")
    return o.select(
        "o_orderkey", scoring.calibrate_against(F.lit(7.0), [(7.0, 0.5)]).alias("flat"), _r(scoring.calibrate_against(F.col("o_totalprice"), points)).alias("at")
    )


@query(
    """WITH f AS (SELECT o_totalprice AS s, o_totalprice > 300000 AS a, o_custkey % 50 = 0 AS b FROM orders),
l AS (SELECT list_sort(list(s)) AS l, (count(*) - 1) * (1 - least(0.5, greatest(0.001, (avg(CAST(a AS INT)) + avg(CAST(b AS INT))) / 2))) AS p FROM f)
SELECT round(l[CAST(floor(p) AS INT) + 1] + (l[CAST(ceil(p) AS INT) + 1] - l[CAST(floor(p) AS INT) + 1]) * (p - floor(p)), 4) AS cut FROM l"""
)
def automatic_cut(spark, d):
    """The composite's threshold at the median natural flag rate."""
    o = _t(spark, d, "orders").select(F.col("o_totalprice").alias("s"), (F.col("o_totalprice") > 300000).alias("a"), (F.col("o_custkey") % 50 == 0).alias("b"))
    return spark.createDataFrame([(round(scoring.auto_cut(o, "s", ["a", "b"]), 4),)], "cut double")


@query("SELECT p_partkey FROM part WHERE NOT (p_retailprice > 1500) AND NOT (p_size > 45)")
def reference_population(spark, d):
    """Rows that neither the ensemble nor any detector flags."""
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_retailprice") > 1500).alias("flagged"), (F.col("p_size") > 45).alias("own"), F.col("p_retailprice").alias("s"))
    found, _ = explain.reference_ids(p, "p_partkey", "s", "flagged", ["own"])
    return found


@query("SELECT p_partkey FROM part WHERE p_retailprice <= 1500 AND p_retailprice <= (SELECT median(p_retailprice) FROM part)")
def reference_lower_half(spark, d):
    """Where some detector flags every row: the lower half of the unflagged ones."""
    p = _t(spark, d, "part").select("p_partkey", (F.col("p_retailprice") > 1500).alias("flagged"), F.lit(True).alias("own"), F.col("p_retailprice").alias("s"))
    found, _ = explain.reference_ids(p, "p_partkey", "s", "flagged", ["own"])
    return found


@query(
    """SELECT o_orderkey, CASE WHEN o_custkey % 7 = 0 THEN 'missing' WHEN o_totalprice > 150000 THEN 'above' WHEN o_totalprice < 150000 THEN 'below' ELSE 'same' END AS number,
CASE WHEN o_orderstatus = 'O' THEN 'same' ELSE 'different' END AS word FROM orders"""
)
def directions(spark, d):
    o = _t(spark, d, "orders")
    x = F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice"))
    own = F.struct(x.cast("string").alias("text"), x.alias("number"))
    usual = F.struct(F.lit("150000").alias("text"), F.lit("ordered").alias("kind"), F.lit(150000.0).alias("number"))
    word = F.struct(F.col("o_orderstatus").alias("text"), F.lit(None).cast("double").alias("number"))
    typical = F.struct(F.lit("O").alias("text"), F.lit("categorical").alias("kind"), F.lit(None).cast("double").alias("number"))
    named = o.select("o_orderkey", own.alias("own"), usual.alias("usual"), word.alias("word"), typical.alias("typical"))
    return named.select(
        "o_orderkey", explain.direction(F.col("own"), F.col("usual")).alias("number"), explain.direction(F.col("word"), F.col("typical")).alias("word")
    )


@query(
    """WITH t AS (SELECT c_custkey AS k, greatest(c_nationkey, 1) AS c1, 40 + c_nationkey AS n1, c_custkey % 9 AS c0, 50 AS n0 FROM customer),
w AS (SELECT *, c1 / n1 AS p1, c0 / n0 AS p0, 1.959963984540054 AS z FROM t),
i AS (SELECT *, (p1 + z * z / (2 * n1)) / (1 + z * z / n1) AS m1, z * sqrt(p1 * (1 - p1) / n1 + z * z / (4.0 * n1 * n1)) / (1 + z * z / n1) AS h1,
 (p0 + z * z / (2 * n0)) / (1 + z * z / n0) AS m0, z * sqrt(p0 * (1 - p0) / n0 + z * z / (4.0 * n0 * n0)) / (1 + z * z / n0) AS h0 FROM w),
b AS (SELECT *, greatest(m1 - h1, 0) AS l1, least(m1 + h1, 1) AS u1, CASE WHEN c0 = 0 THEN 0 ELSE greatest(m0 - h0, 0) END AS l0, least(m0 + h0, 1) AS u0 FROM i)
SELECT k AS c_custkey, round(p1 - p0 - sqrt((p1 - l1) * (p1 - l1) + (u0 - p0) * (u0 - p0)), 6) AS low, round(p1 - p0 + sqrt((u1 - p1) * (u1 - p1) + (p0 - l0) * (p0 - l0)), 6) AS high FROM b"""
)
def newcombe_interval(spark, d):
    c = _t(spark, d, "customer").select("c_custkey", F.greatest("c_nationkey", F.lit(1)).alias("c1"), (F.col("c_nationkey") + 40).alias("n1"), (F.col("c_custkey") % 9).alias("c0"), F.lit(50).alias("n0"))
    low, high = fx.newcombe(F.col("c1"), F.col("n1"), F.col("c0"), F.col("n0"))
    return c.select("c_custkey", _r(low).alias("low"), _r(high).alias("high"))


@query(
    """WITH t AS (SELECT n_name AS name, (n_nationkey + 1) / 400.0 AS p FROM nation),
s AS (SELECT *, least(1, p * (count(*) OVER () - row_number() OVER (ORDER BY p, name) + 1)) AS q FROM t)
SELECT name, round(max(q) OVER (ORDER BY p, name), 6) AS adjusted FROM s"""
)
def holm_adjusted(spark, d):
    n = _t(spark, d, "nation").select(F.col("n_name").alias("name"), ((F.col("n_nationkey") + 1) / 400.0).alias("p"))
    return evaluate.holm_frame(n, "name", "p").select("name", _r("adjusted").alias("adjusted"))


def _book(spark, d) -> DataFrame:
    """Totals of orders as a ledger has them: by status and month, under two configurations."""
    o = _t(spark, d, "orders").select(
        F.col("o_orderstatus").alias("group_key"), F.date_format("o_orderdate", "yyyy-MM").alias("period_label"),
        F.when(F.col("o_custkey") % 2 == 0, "even").otherwise("odd").alias("config_hash"),
    )
    book = ledger.Ledger(spark, shared.new_path(spark, "ledger"))
    counted = o.groupBy("group_key", "period_label", "config_hash").agg(F.count(F.lit(1)).alias("population"))
    book.replace("totals", counted, ["config_hash", "period_label"])
    book.replace("totals", counted.where("period_label < '1996'"), ["config_hash", "period_label"])
    return book.table("totals")


_BOOK = "WITH t AS (SELECT o_orderstatus AS group_key, strftime(o_orderdate, '%Y-%m') AS period_label, CASE WHEN o_custkey % 2 = 0 THEN 'even' ELSE 'odd' END AS config_hash, count(*) AS population FROM orders GROUP BY ALL) "


@query(_BOOK + "SELECT group_key, period_label, population FROM t WHERE config_hash = 'even' AND period_label IN ('1995-02', '1996-03')")
def ledger_totals(spark, d):
    """Totals of some labels under one configuration, from a ledger whose periods were written twice."""
    return ledger.totals_for(_book(spark, d), "even", ["1995-02", "1996-03"]).select("group_key", "period_label", "population")


@query(_BOOK + "SELECT DISTINCT period_label FROM t WHERE config_hash = 'odd'")
def ledger_labels(spark, d):
    return ledger.labels_with_totals(_book(spark, d), "odd")


@query(_BOOK + "SELECT DISTINCT config_hash FROM t WHERE config_hash <> 'odd' AND period_label BETWEEN '1995-01' AND '1995-12'")
def ledger_other_configs(spark, d):
    return ledger.other_configs(_book(spark, d), "odd", "1995-01", "1995-12")


@query("SELECT o_orderkey AS run_id FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 15")
def ledger_newest_runs(spark, d):
    runs = _t(spark, d, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_orderdate").alias("started_at"))
    return ledger.newest_runs(runs, 15).select("run_id")


@query("SELECT strftime(date_trunc('day', ts), '%Y-%m-%dT%H:%M') AS period_label, event_type, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS anomaly_count, count(*) AS population FROM events GROUP BY ALL")
def streamed_totals(spark, d):
    """Totals of a stream's tumbling windows, read from what its batches wrote."""
    source = f"{d}/events.parquet"
    schema = spark.read.parquet(source).schema
    path = shared.new_path(spark, "stream")
    spark.read.parquet(source).coalesce(1).write.parquet(f"{path}/in")  # a stream reads folders
    stream = spark.readStream.schema(schema).parquet(f"{path}/in").withColumn("flagged", F.col("value") > 50)
    stream = stream.withColumn("ts", F.col("ts").cast("timestamp"))
    totals = streaming.tumbling_totals(stream, "ts", "flagged", ["event_type"])
    streaming.write_totals(totals, f"{path}/out", f"{path}/state").awaitTermination()
    return shared.read_keyed(spark, f"{path}/out").select("period_label", "event_type", "anomaly_count", "population")


@query("SELECT CASE WHEN psi < 0.1 THEN 'stable' WHEN psi < 0.25 THEN 'moderate' ELSE 'major' END AS band, count(*) AS n FROM (SELECT n_nationkey / 60.0 AS psi FROM nation) GROUP BY 1")
def drift_bands(spark, d):
    n = _t(spark, d, "nation").select((F.col("n_nationkey") / 60.0).alias("psi"))
    return n.groupBy(history.psi_band(F.col("psi")).alias("band")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT c_custkey, round(abs(c_acctbal - 4000) / 500, 6) AS away FROM customer")
def marginal_deviations(spark, d):
    import numpy as np

    from oddrank.queries import _scored_batches

    c = _t(spark, d, "customer").select("c_custkey", "c_acctbal")
    of = lambda x: explain.marginal_deviation(x, np.array([4000.0]), np.array([500.0]))
    return _scored_batches(c, "c_custkey", ["c_acctbal"], of, ["away"]).select("c_custkey", _r("away").alias("away"))


@query(
    """WITH t AS (SELECT o_orderkey AS id, 100 * (o_orderkey % 3) AS c1, 100 AS n1, o_totalprice > 100000 AS f FROM orders)
SELECT count(*) FILTER (f) AS flagged, count(*) AS n FROM t"""
)
def result_digest_inputs(spark, d):
    """Counts behind a digest that is the same in any order of the rows (checked before they are returned)."""
    o = _t(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("f"))
    if sinks.digest(o) != sinks.digest(o.repartition(5)):
        raise ValueError("the digest hangs on the order of the rows")
    return o.agg(F.sum(F.col("f").cast("long")).alias("flagged"), F.count(F.lit(1)).alias("n"))


@query("SELECT 'o_orderkey' AS column_name UNION ALL SELECT 'o_totalprice'")
def selected_columns(spark, d):
    """Columns that ``include_only`` leaves, by glob and by type."""
    o = _t(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    cfg = profile.ProfilingConfig(include_only=("*_orderk*", "type:double *"))
    kept = [(p.name,) for p in profile.profile(o, cfg) if profile.classify(p, cfg)[0] != "ignored"]
    return spark.createDataFrame(kept, "column_name string")
