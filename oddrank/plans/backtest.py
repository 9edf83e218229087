"""Which policy ranks known odd rows best: replicates on subsamples, tested against the default."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrank.config import Config
from oddrank.functions import columns as fx
from oddrank.operators import evaluate, scoring
from oddrank.plans import detection, feature_plan
from oddrank.sources import shared
from oddrank.sources.readers import ROW_ID

POLICIES = {"intersection@1": "intersection", "union@1": "union", "composite-equal@1": "composite"}


def backtest(df: DataFrame, labels: DataFrame, cfg: Config, replicates: int = 5, share: float = 0.8) -> dict:
    """Average precision of each policy on ``replicates`` subsamples, all policies on the same fits.

    ``labels`` has the row id and y (0 or 1). A policy is adopted if it beats
    the configured one beyond doubt after correction for the number of tries.
    """
    cut = F.lit(int(share * 2**64) - 2**63)
    pairs = []
    for r in range(replicates):
        own = replace(cfg, run=replace(cfg.run, seed=cfg.run.seed + r))
        part = df.where(F.xxhash64(F.lit(own.run.seed), ROW_ID) <= cut)
        pairs.append((part, part, own))
    return _compared(pairs, labels, cfg)


def forward(df: DataFrame, labels: DataFrame, cfg: Config, time: str, folds: int = 3, granularity: str = "month") -> dict:
    """The same on ``folds`` periods, the latest ones: each is scored by what was fitted on all periods before it."""
    period = fx.period_label(F.col(f"`{time}`"), granularity)
    found = [r[0] for r in df.select(period.alias("p")).where("p IS NOT NULL").distinct().orderBy("p").collect()]
    if len(found) <= folds:
        raise feature_plan.PlanError(f"{folds} folds need {folds + 1} periods, there are {len(found)}")
    return _compared([(df.where(period < p), df.where(period == p), cfg) for p in found[-folds:]], labels, cfg)


def _compared(pairs: list[tuple[DataFrame, DataFrame, Config]], labels: DataFrame, cfg: Config) -> dict:
    """``pairs``: what to fit on, what to score, and the configuration."""
    found: dict[str, list[float]] = {p: [] for p in POLICIES}
    names = [f"cal_{n}" for n in cfg.scoring.detectors]
    for train, test, own in pairs:
        fitted = detection.fit(train, own)
        scored = [(k, detection.calibrated(detection.scored_raw(d, f), f)) for k, d, f in detection.parts(test, fitted, own)]
        cal = shared.written(detection.together(scored).join(labels, ROW_ID), "backtest")
        for policy, how in POLICIES.items():
            ranked = cal.select(scoring.combined(names, how).alias("s"), "y")
            found[policy].append(evaluate.ranking_metrics(ranked, "s", "y").first()["average_precision"] or 0.0)
    base = cfg.policy() if cfg.policy() in found else "intersection@1"
    tests = {}
    for policy, values in found.items():
        if policy != base:
            tests[policy] = evaluate.paired_bootstrap([a - b for a, b in zip(values, found[base], strict=True)])
    adjusted = evaluate.holm({k: t[0] for k, t in tests.items()})
    verdicts = {k: evaluate.decision(adjusted[k], tests[k][1], 0.05) for k in tests}
    return {"base": base, "average_precision": found, "adjusted_p": adjusted, "verdict": verdicts}
