"""A whole run: read, prepare, detect, explain, and write every result under one folder.

    root/results/<name>/run_id=...    anomalies, ranked, explanations, attributions
    root/runs/<run_id>/               models.json, report.json, report.html, rules.json
    root/ledger/<table>/              run, run_group, totals, period, period_stats

A run is named by a digest of what it reads and of its configuration, so the
same run again replaces its own results. Warnings have a code; under
``run.strict`` the first one ends the run.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddrank.config import Config
from oddrank.functions import columns as fx
from oddrank.operators import ledger, periods, profile, scoring, temporal
from oddrank.plans import detection, feature_plan, trend
from oddrank.sources import readers, shared, sinks
from oddrank.sources.readers import ROW_ID

PREVIEW = 20
#: Key of the only group of an ungrouped run in the tables.
ALL = "all"


class RunError(ValueError):
    """A run that was refused, or that a warning ended under ``run.strict``."""


@dataclass
class Run:
    run_id: str
    status: str = "running"
    warnings: list[dict] = field(default_factory=list)
    groups: dict[str, dict] = field(default_factory=dict)
    rows: int = 0
    flagged: int = 0

    def warn(self, code: str, message: str, strict: bool) -> None:
        if strict:
            raise RunError(f"{code}: {message}")
        self.warnings.append({"code": code, "message": message})


def prepared(spark: SparkSession, cfg: Config, df: DataFrame | None = None) -> DataFrame:
    """The flattened table with its row identity; a declared key must be unique and present in each group."""
    df = profile.flattened(df if df is not None else readers.read(spark, cfg.source.path, cfg.source.format))
    key = cfg.columns.id_column
    if key:
        if key not in df.columns:
            raise RunError(f"the id column {key!r} isn't in the table")
        by = [*cfg.columns.group_by, key]
        bad = [tuple(r)[:-1] for r in profile.duplicate_ids(df, by).orderBy(*by).limit(5).collect()]
        if bad:
            raise RunError(f"{by} must name one row; these name more: {bad}")
        if df.where(F.col(f"`{key}`").isNull()).limit(1).count():
            raise RunError(f"the id column {key!r} has missing values")
        if dict(df.dtypes)[key] in ("tinyint", "smallint", "int", "bigint") and not cfg.columns.group_by:
            return readers.with_row_id(df, id_column=key)
    return readers.with_row_id(df, order=[key] if key else None)


def in_period(df: DataFrame, cfg: Config) -> DataFrame:
    """Rows of the half-open window ``period.start`` to ``period.end``; an error that names the range if there are none.

    The bounds are cast to the column's type, so the filter reaches the scan.
    """
    p = cfg.period
    if p.start is None and p.end is None:
        return df
    found = feature_plan.time_column(temporal.replay(df, temporal.detect(df, cfg)[0]), cfg)
    if found is None:
        raise RunError("a period needs a time column")
    kind = dict(df.dtypes)[found]
    c = F.col(f"`{found}`")
    if kind == "string":
        c, kind = temporal.iso_timestamp(c), "timestamp"
    keep = F.lit(True)
    if p.start is not None:
        keep &= c >= F.lit(p.start).cast(kind)
    if p.end is not None:
        keep &= c < F.lit(p.end).cast(kind)
    out = df.where(keep)
    if not out.limit(1).count():
        row = df.agg(F.count(F.lit(1)).alias("n"), F.min(c).alias("a"), F.max(c).alias("b")).first()
        if row["n"]:
            raise RunError(f"no row lies in [{p.start}, {p.end}); {found} runs from {row['a']} to {row['b']}")
    return out


def capped(df: DataFrame, cfg: Config, run: Run) -> DataFrame:
    """The first ``run.max_rows`` rows by identity, with a warning if there are more."""
    most = cfg.run.max_rows
    if most is None:
        return df
    n = df.count()
    if n <= most:
        return df
    run.warn("run.max_rows", f"{n} rows are cut to the first {most}", cfg.run.strict)
    return shared.written(readers.head_rows(df, ROW_ID, most), "head")


def run_id_of(df: DataFrame, cfg: Config, rows: str, mode: str = "fit") -> str:
    told = "|".join([readers.schema_fingerprint(df), rows, cfg.hash(), str(cfg.period.start), str(cfg.period.end), mode])
    return hashlib.sha256(told.encode()).hexdigest()[:16]


def execute(
    spark: SparkSession, cfg: Config, root: str, df: DataFrame | None = None, models: str | None = None,
    period_label: str | None = None, anchor: str | None = None,
) -> Run:
    """Fit (or, with the JSON of fitted ``models``, score), explain and write; the state of the run is returned.

    ``period_label`` names the period whose totals the run gives; without it
    each row counts for the period of its time column, if there is one.
    ``anchor`` is the run whose fixed rule every group is scored against.
    """
    cfg.check()
    root = root.rstrip("/")
    table = prepared(spark, cfg, df)
    run = Run("")
    table = capped(in_period(table, cfg), cfg, run)
    if not table.limit(1).count():
        raise RunError("the table has no rows")
    run.run_id = run_id_of(table, cfg, sinks.digest(table), "score" if models else "fit")
    started = datetime.now(timezone.utc).replace(tzinfo=None)
    if models:
        fitted = detection.Fitted.from_json(models)
        ranked = detection.score_forward(table, fitted, cfg)
    else:
        fitted, ranked = detection.run_detection(table, cfg)
    for text in fitted.plan.warnings:
        run.warn(text.split(":")[0], text.split(":", 1)[1].strip(), cfg.run.strict)
    for k, n in fitted.manifest.get("too_few_records", {}).items():
        run.groups[k] = {"status": "skipped", "reason": "too_few_records", "rows": n}
    for k, why in fitted.manifest.get("failed", {}).items():
        run.groups[k] = {"status": "failed", "reason": why}
    ranked = shared.written(ranked, "ranked")
    keyed = ranked if detection.GROUP in ranked.columns else ranked.withColumn(detection.GROUP, F.lit(ALL))
    for r in keyed.groupBy(detection.GROUP).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("flagged").cast("long")).alias("k")).collect():
        run.groups[r[0]] = {"status": "ok", "rows": r.n, "flagged": r.k}
        run.rows, run.flagged = run.rows + r.n, run.flagged + r.k
    _write_results(root, run, table, keyed, ranked, fitted, cfg)
    rules = _write_history(root, run, table, keyed, fitted, cfg, period_label, anchor)
    bad = [g for g in run.groups.values() if g["status"] == "failed"]
    run.status = "failed" if bad and not run.rows else "partial" if bad else "complete"
    at = f"{root}/runs/{run.run_id}"
    sinks.write_text(spark, f"{at}/models.json", fitted.to_json())
    if not models:
        sinks.write_text(spark, f"{at}/rules.json", json.dumps(rules))
    facts = {
        "run_id": run.run_id, "status": run.status, "rows": run.rows, "flagged": run.flagged, "policy": cfg.policy(),
        "config_hash": cfg.hash(), "warnings": run.warnings, "groups": run.groups,
    }
    shown = sinks.read_result(spark, root, "ranked", run.run_id).orderBy(detection.GROUP, "position").limit(10 * PREVIEW)
    sinks.write_text(spark, f"{at}/report.json", sinks.json_report(facts, shown))
    sinks.write_text(spark, f"{at}/report.html", sinks.html_report(f"Run {run.run_id}", shown, facts, reasons_of(spark, root, run.run_id)))
    book = ledger.Ledger(spark, f"{root}/ledger")
    row = (run.run_id, run.status, cfg.hash(), cfg.policy(), json.dumps(detection.versions()), started, datetime.now(timezone.utc).replace(tzinfo=None), "score" if models else "fit")
    book.replace("run", spark.createDataFrame([row], "run_id string, status string, config_hash string, ensemble_policy string, library_version string, started_at timestamp_ntz, finished_at timestamp_ntz, mode string"), ["run_id"])
    groups = [(run.run_id, k, g["status"], g.get("reason"), g.get("rows"), g.get("flagged")) for k, g in run.groups.items()]
    book.replace("run_group", spark.createDataFrame(groups, "run_id string, group_key string, status string, reason string, n_rows long, flagged long"), ["run_id"])
    return run


def reasons_of(spark: SparkSession, root: str, run_id: str, top: int = PREVIEW) -> DataFrame | None:
    """The reasons of the first flagged rows of a run, for its report."""
    try:
        found = sinks.read_result(spark, root, "explanations", run_id)
    except sinks.NotFound:
        return None
    return found.orderBy("flag_rank", ROW_ID).limit(top)


def _write_results(root: str, run: Run, table: DataFrame, keyed: DataFrame, ranked: DataFrame, fitted, cfg: Config) -> None:
    by = detection.GROUP
    source = table.select(*[F.col(f"`{c}`") for c in table.columns if c not in ranked.columns or c == ROW_ID])
    sinks.write_result(keyed.where("flagged"), f"{root}/results", "anomalies", run.run_id, [by, ROW_ID])
    top = scoring.preview(keyed, "score", ROW_ID, [by], PREVIEW)
    sinks.write_result(top.join(source, ROW_ID), f"{root}/results", "ranked", run.run_id, [by, ROW_ID])
    if not cfg.explain.enabled:
        return
    try:  # an explanation never fails a run
        rows, reasons = detection.explain(table, ranked, fitted, cfg)
        rows, reasons = (d if by in d.columns else d.withColumn(by, F.lit(ALL)) for d in (rows, reasons))
        rows = shared.written(rows, "explanations")
        lost = rows.where("explain_status <> 'ok'").groupBy("explain_status").count().collect()
        sinks.write_result(rows, f"{root}/results", "explanations", run.run_id, [by, ROW_ID])
        sinks.write_result(reasons, f"{root}/results", "attributions", run.run_id, [by, ROW_ID, "reason_rank"])
    except Exception as e:  # noqa: BLE001
        run.warn("explain.failed", f"{type(e).__name__}: {str(e)[:300]}", cfg.run.strict)
        return
    for r in lost:
        run.warn(f"explain.{r[0]}", f"{r[1]} flagged rows are explained in part or not at all", cfg.run.strict)


def _write_history(root: str, run: Run, table: DataFrame, keyed: DataFrame, fitted, cfg: Config, label: str | None, anchor: str | None) -> dict:
    """Totals, period statistics and completion in the ledger; the groups' fixed rules are returned."""
    spark, by = table.sparkSession, detection.GROUP
    of = fitted.groups or {ALL: fitted}
    members = {k: list(f.models) for k, f in of.items()}
    rules = {}
    for k, f in of.items():
        own = keyed.where(F.col(by) == k)
        rules[k] = trend.anchor_rule(own, members[k], f.weights, cfg.scoring.combination, cfg.scoring.contamination, f.cut, ROW_ID)
    when = fitted.plan.time_column
    if label is None and when is None:
        return rules
    parsed = temporal.replay(profile.cleaned(table), fitted.plan.temporal)
    g = cfg.period
    named = F.lit(label) if label else fx.period_label(F.col(f"`{when}`"), g.granularity, g.roll_weekend)
    fields = sorted({e.column for e in fitted.plan.encodings} & set(parsed.columns))
    labelled = parsed.select(ROW_ID, named.alias("period_label"), *[F.col(f"`{c}`") for c in fields])
    rows = shared.written(labelled.join(keyed.select(ROW_ID, by), ROW_ID).where("period_label IS NOT NULL"), "periods")
    book = ledger.Ledger(spark, f"{root}/ledger")
    counted = rows.select(ROW_ID, by, "period_label").join(keyed.select(ROW_ID, "flagged"), ROW_ID).groupBy(by, "period_label").agg(
        F.sum(F.col("flagged").cast("long")).alias("anomaly_count"), F.count(F.lit(1)).alias("population")
    )
    stamp = [F.lit(cfg.hash()).alias("config_hash"), F.lit(run.run_id).alias("run_id")]
    totals = shared.written(counted.select("*", *stamp), "totals")
    names = sorted(set().union(*members.values()))
    stats = trend.period_statistics(rows, keyed.drop(by), fields, ROW_ID, names, [by, "period_label"])
    if anchor:
        stats = _anchored(spark, root, anchor, table, fitted, cfg, rows, stats)
    bad = any(x["status"] == "failed" for x in run.groups.values())
    state = totals.select("config_hash", "period_label").distinct().select("*", F.lit("incomplete" if bad else "complete").alias("status"), F.lit(run.run_id).alias("run_id"))
    # the completion last: a period counts as done only once its totals and statistics are there
    book.replace("totals", totals, ["config_hash", "period_label"])
    book.replace("period_stats", stats.select("*", *stamp), ["config_hash", "period_label"])
    book.replace("period", state, ["config_hash", "period_label"])
    return rules


def _anchored(spark: SparkSession, root: str, anchor: str, table: DataFrame, fitted, cfg: Config, rows: DataFrame, stats: DataFrame) -> DataFrame:
    """The statistics with each cell's section against the anchor run."""
    by = detection.GROUP
    try:
        frozen = detection.Fitted.from_json(sinks.read_text(spark, f"{root}/runs/{anchor}/models.json"))
        rules = json.loads(sinks.read_text(spark, f"{root}/runs/{anchor}/rules.json"))
        why = None
    except sinks.NotFound as e:
        frozen, rules, why = None, {}, f"the anchor run can't be read: {e}"
    out = []
    scored = {}
    for r in trend.load(stats.collect()):  # a row for each group and period
        k = r["group_key"]
        of = (frozen.groups or {ALL: frozen}).get(k) if frozen else None
        section = {"anchor_run_id": anchor, "comparable": False, "reason": why or "the anchor run has no models for this group"}
        if of is not None:
            try:
                if k not in scored:
                    own = table.join(rows.where(F.col(by) == k).select(ROW_ID, "period_label"), ROW_ID)
                    raw = detection.scored_raw(own.drop("period_label"), of)
                    scored[k] = shared.written(detection.calibrated(raw, of).join(own.select(ROW_ID, "period_label"), ROW_ID), "anchored")
                section = trend.against_anchor(scored[k].where(F.col("period_label") == r["period_label"]), rules.get(k), anchor)
            except feature_plan.PlanError as e:
                section["reason"] = str(e)
        out.append((k, r["period_label"], json.dumps(r["stats"] | {"anchor": section})))
    return spark.createDataFrame(out, f"{by} string, period_label string, stats string")


def backfill(
    spark: SparkSession, cfg: Config, root: str, reference: str, df: DataFrame | None = None, bootstrap: int = 14, lookback: int = 14,
    most: int = 60, forced: list[str] | None = None, anchor: str | None = None,
) -> dict[str, str]:
    """Run every pending period before ``reference``: label -> status. Complete periods are left alone unless forced."""
    g = cfg.period
    book = ledger.Ledger(spark, f"{root.rstrip('/')}/ledger")
    done = book.rows("period", cfg.hash(), "status = 'complete'")
    last = max(done, default=None)
    labels = periods.backfill(last, reference, g.granularity, bootstrap, lookback, most, g.roll_weekend)
    out = {}
    for label in labels:
        if label in done and label not in (forced or []):
            continue
        first, end = periods.bounds(label, g.granularity)
        if g.granularity == "day" and g.roll_weekend and first.weekday() == 4:
            _, end = periods.bounds(periods.step(label, "day", 2), "day")
        own = replace(cfg, period=replace(g, start=str(first), end=str(end)))
        try:
            out[label] = execute(spark, own, root, df, period_label=label, anchor=anchor).status
        except (RunError, feature_plan.PlanError) as e:
            out[label] = f"failed: {e}"
    return out


def history(spark: SparkSession, cfg: Config, root: str, reference: str | None = None, sizes: tuple[int, ...] = (7, 28), anchor: str | None = None) -> dict:
    """The trend report of a configuration; by default up to its latest period that has ended."""
    book = ledger.Ledger(spark, f"{root.rstrip('/')}/ledger")
    labels = book.rows("totals", cfg.hash())
    now = periods.label_of(datetime.now(timezone.utc).replace(tzinfo=None), cfg.period.granularity, cfg.period.roll_weekend)
    ongoing = False
    if reference is None:
        reference, ongoing = periods.default_reference(labels, now)
    if reference is None:
        raise RunError("there are no totals under this configuration")
    totals = book.table("totals").where(F.col("config_hash") == cfg.hash())
    wide = max(sizes)
    near = sorted({x for w in periods.windows(reference, wide, cfg.period.granularity) for x in w})
    held = book.table("period_stats").where((F.col("config_hash") == cfg.hash()) & F.col("period_label").isin(near))
    out = trend.report(totals, trend.load(held.select("group_key", "period_label", "stats").collect()), reference, list(sizes), cfg, anchor)
    return out | {"reference_in_progress": ongoing}
