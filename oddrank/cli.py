"""Thin command line over the library.

Exit codes: 0 done, 1 failed while running, 2 refused before running, 3 not
found, 4 done for a part of the groups.
"""

from __future__ import annotations

import argparse
import json
import sys
from dataclasses import asdict
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from oddrank.config import Config
from oddrank.operators import detectors, ledger, profile
from oddrank.plans import backtest, feature_plan, run
from oddrank.sources import fetch, readers, sinks

#: command -> arguments beside --config
COMMANDS = {
    "init": ["file"], "inspect": ["source"], "explain-plan": ["source"], "run": ["source", "--out"], "score": ["source", "--out", "--run"],
    "backfill": ["source", "--out", "--reference", "--anchor"], "history": ["--out", "--reference", "--anchor"], "backtest": ["source", "--out", "--labels"],
    "evidence": ["--out"], "report": ["--out", "--run"], "runs": ["--out", "--limit"], "show": ["--out", "--run"],
    "anomalies": ["--out", "--run", "--top"], "detectors": [], "config": ["what", "file"], "workspace": ["what", "--out", "--before"],
}
OPTIONAL = {"--reference", "--anchor", "--limit", "--top", "--before"}


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="oddrank")
    sub = top.add_subparsers(dest="command", required=True)
    for name, arguments in COMMANDS.items():
        p = sub.add_parser(name)
        p.add_argument("--config", help="JSON file with the sections of a configuration")
        for a in arguments:
            if a.startswith("--"):
                p.add_argument(a, required=a not in OPTIONAL)
            else:
                p.add_argument(a, nargs="?" if (name, a) == ("config", "file") else None)
    return top


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "config" and args.what not in ("check", "show", "schema"):
        args.what, args.file = "check", args.what  # config FILE
    try:
        chosen = getattr(args, "file", None) if args.command == "config" else args.config
        cfg = Config.from_dict(json.loads(Path(chosen).read_text())) if chosen else Config()
        if args.command in ("detectors", "config", "init"):
            return _offline(args, cfg)
    except FileNotFoundError as e:
        return _said(e, 3)
    except (ValueError, TypeError) as e:
        return _said(e, 2)
    spark = SparkSession.builder.appName("oddrank").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        if getattr(args, "source", None):
            cfg.source.path = fetch.local(args.source)
        return _online(spark, args, cfg)
    except (sinks.NotFound, FileNotFoundError) as e:
        return _said(e, 3)
    except (run.RunError, feature_plan.PlanError, readers.SourceError) as e:
        return _said(e, 2)
    except Exception as e:  # noqa: BLE001  the command reports any failure by its code
        return _said(e, 1)


def _said(what: object, code: int) -> int:
    print(what, file=sys.stderr)
    return code


def _offline(args: argparse.Namespace, cfg: Config) -> int:
    if args.command == "detectors":
        print("\n".join(sorted(detectors.REGISTRY)))
    elif args.command == "init":
        if Path(args.file).exists():
            return _said(f"{args.file} is there already", 2)
        Path(args.file).write_text(json.dumps(asdict(Config()), indent=1))
    elif args.what == "check":
        print(cfg.hash(), cfg.policy())
    elif args.what == "show":
        print(json.dumps(asdict(cfg), indent=1))
    else:
        print(json.dumps({k: {n: type(v).__name__ for n, v in s.items()} for k, s in asdict(Config()).items()}, indent=1))
    return 0


def _online(spark: SparkSession, args: argparse.Namespace, cfg: Config) -> int:
    name, out = args.command, getattr(args, "out", None)
    if name in ("inspect", "explain-plan"):
        df = profile.flattened(readers.read(spark, cfg.source.path, cfg.source.format))
        if name == "inspect":
            for p in profile.profile(df, cfg.profiling):
                kind, why = profile.classify(p, cfg.profiling)
                print(f"{p.name}\t{p.data_type}\t{kind}\t{profile.treatment(kind, p, cfg.profiling)}\t{why}")
        else:
            print(json.dumps(json.loads(feature_plan.build(readers.with_row_id(df), cfg).to_json()), indent=1))
        return 0
    if name in ("run", "score"):
        models = sinks.read_text(spark, f"{out}/runs/{args.run}/models.json") if name == "score" else None
        done = run.execute(spark, cfg, out, models=models)
        print(done.run_id, done.status, done.rows, done.flagged)
        for w in done.warnings:
            print(f"{w['code']}: {w['message']}", file=sys.stderr)
        return {"complete": 0, "partial": 4}.get(done.status, 1)
    if name == "backfill":
        reference = args.reference or _today(cfg)
        states = run.backfill(spark, cfg, out, reference, anchor=args.anchor)
        print("\n".join(f"{k}\t{v}" for k, v in states.items()))
        return 0 if all(v == "complete" for v in states.values()) else 4
    if name == "history":
        print(json.dumps(run.history(spark, cfg, out, args.reference, anchor=args.anchor), indent=1, default=str))
        return 0
    if name == "backtest":
        df = run.prepared(spark, cfg)
        found = backtest.backtest(df, readers.read(spark, args.labels), cfg)
        book = ledger.Ledger(spark, f"{out}/ledger")
        row = [(cfg.scope_hash(), cfg.policy(), json.dumps(found), _now())]
        book.replace("policy_evidence", spark.createDataFrame(row, "scope string, policy string, verdict string, at string"), ["scope"])
        print(json.dumps(found, indent=1))
        return 0
    book = ledger.Ledger(spark, f"{out}/ledger")
    if name == "evidence":
        _table(ledger.latest_in_scope(_held(book, "policy_evidence"), ["scope"], "at", "policy"))
    elif name == "runs":
        _table(ledger.newest_runs(_held(book, "run"), int(args.limit or 20)))
    elif name == "show":
        _table(_held(book, "run").where(F.col("run_id") == args.run))
        _table(_held(book, "run_group").where(F.col("run_id") == args.run))
    elif name == "report":
        print(sinks.read_text(spark, f"{out}/runs/{args.run}/report.json"))
    elif name == "anomalies":
        found = sinks.read_result(spark, out, "anomalies", args.run)
        _table(found.orderBy("flag_rank", "group_key", readers.ROW_ID).limit(int(args.top or 20)))
    elif name == "workspace":
        return _workspace(spark, book, args)
    return 0


def _held(book: ledger.Ledger, name: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return book.table(name)
    except AnalysisException as e:
        raise sinks.NotFound(f"there is no table {name} yet") from e


def _table(df: DataFrame) -> None:
    print("\t".join(df.columns))
    for r in df.collect():
        print("\t".join(str(v) for v in r))


def _now() -> str:
    from datetime import datetime, timezone

    return datetime.now(timezone.utc).isoformat()


def _today(cfg: Config) -> str:
    from datetime import datetime, timezone

    from oddrank.operators import periods

    return periods.label_of(datetime.now(timezone.utc).replace(tzinfo=None), cfg.period.granularity, cfg.period.roll_weekend)


def _workspace(spark: SparkSession, book: ledger.Ledger, args: argparse.Namespace) -> int:
    """ls and du list runs and the bytes of their results; prune drops results of failed and of older runs; reset drops all."""
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(args.out)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if args.what == "reset":
        fs.delete(root, True)
        return 0
    runs = _held(book, "run")
    names = [s.getPath().getName() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(root, "results"))]
    at = {n: (lambda run_id, n=n: jvm.org.apache.hadoop.fs.Path(root, f"results/{n}/run_id={run_id}")) for n in names}
    rows = runs.select("run_id", "status", F.col("started_at").cast("string").alias("at")).orderBy("at").collect()
    if args.what in ("ls", "du"):
        for r in rows:
            size = sum(fs.getContentSummary(p(r.run_id)).getLength() for p in at.values() if fs.exists(p(r.run_id)))
            print(f"{r.run_id}\t{r.status}\t{r.at}" + (f"\t{size}" if args.what == "du" else ""))
        return 0
    if args.what == "prune":
        artifacts = runs.select(F.col("run_id").alias("artifact_id"), "run_id", F.col("started_at").alias("created_at"))
        gone = ledger.prune_eligible(artifacts, runs, F.to_timestamp_ntz(F.lit(args.before or "1970-01-01")))
        for r in gone.collect():
            for p in at.values():
                fs.delete(p(r.artifact_id), True)
            print(r.artifact_id)
        return 0
    return _said("workspace ls, du, prune or reset", 2)


if __name__ == "__main__":
    sys.exit(main())
