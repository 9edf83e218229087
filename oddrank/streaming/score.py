"""Scoring and totals over streams: the batch plans, applied to an unbounded table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from oddrank.config import Config
from oddrank.plans import detection, feature_plan
from oddrank.plans.detection import Fitted


def scored_stream(stream: DataFrame, fitted: Fitted, cfg: Config) -> DataFrame:
    """Stateless: plan, frozen models, frozen calibrators; natural flags only."""
    if stream.isStreaming and cfg.scoring.contamination != "auto":
        raise ValueError("an exact number of flags needs a whole table")
    return detection.together([(k, _scored_part(d, f, cfg)) for k, d, f in detection.parts(stream, fitted, cfg)])


def _scored_part(stream: DataFrame, fitted: Fitted, cfg: Config) -> DataFrame:
    raw = detection.score_all(feature_plan.apply(stream, fitted.plan), fitted.models)
    cal = detection.calibrated(raw, fitted)
    names = list(fitted.models)
    score = detection.scoring.combined([f"cal_{n}" for n in names], cfg.scoring.combination, fitted.weights)
    flag = detection.scoring.vote([F.col(f"flag_{n}") for n in names], cfg.scoring.combination, [fitted.rates[n] for n in names])
    return cal.select("*", score.alias("score"), flag.alias("flagged"))


def tumbling_totals(stream: DataFrame, ts: str, flag: str, group: list[str], width: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Count and population of each group and window; rows later than ``late`` are left out by the watermark."""
    return (
        stream.withWatermark(ts, late)
        .groupBy(F.window(ts, width), *group)
        .agg(F.sum(F.col(flag).cast("long")).alias("anomaly_count"), F.count(F.lit(1)).alias("population"))
        .select(F.date_format("window.start", "yyyy-MM-dd'T'HH:mm").alias("period_label"), *group, "anomaly_count", "population")
    )


def write_totals(stream: DataFrame, root: str, checkpoint: str):
    """Each batch replaces its periods' partitions, so a repeated batch changes nothing."""

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("period_label").parquet(root)

    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()
