"""The ledger of runs, totals and periods: Parquet tables in one folder."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from oddrank.sources import shared


class Ledger:
    """Tables under ``root``; a period's rows are replaced as one partition."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return shared.read_keyed(self.spark, f"{self.root}/{name}")

    def rows(self, name: str, config: str, where: str = "true") -> list[str]:
        """Labels of a table's periods under one configuration, in order; none if there is no such table yet."""
        try:
            found = self.table(name)
        except AnalysisException:
            return []
        return [r[0] for r in found.where((F.col("config_hash") == config)).where(where).select("period_label").distinct().orderBy("period_label").collect()]

    def replace(self, name: str, df: DataFrame, by: list[str]) -> None:
        """Overwrite only the partitions that ``df`` has: running again gives the same table."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(f"{self.root}/{name}")


def totals_for(totals: DataFrame, config: str, labels: list[str]) -> DataFrame:
    return totals.where((F.col("config_hash") == config) & F.col("period_label").isin(labels))


def labels_with_totals(totals: DataFrame, config: str) -> DataFrame:
    return totals.where(F.col("config_hash") == config).select("period_label").distinct()


def last_complete(periods: DataFrame, config: str) -> DataFrame:
    return periods.where((F.col("config_hash") == config) & (F.col("status") == "complete")).agg(
        F.max("period_label").alias("period_label")
    )


def other_configs(totals: DataFrame, config: str, first: str, last: str) -> DataFrame:
    return (
        totals.where((F.col("config_hash") != config) & F.col("period_label").between(first, last))
        .select("config_hash")
        .distinct()
    )


def statistics_for(stats: DataFrame, config: str, labels: list[str]) -> DataFrame:
    """Period statistics of a set of labels, with their documents' row counts."""
    held = stats.where((F.col("config_hash") == config) & F.col("period_label").isin(labels))
    return held.withColumn("n_rows", F.get_json_object("stats", "$.n_rows").cast("long"))


def provenance(runs: DataFrame, run_ids: list[str]) -> DataFrame:
    """Library versions and policy of a set of runs."""
    return runs.where(F.col("run_id").isin(run_ids)).select("run_id", "library_version", "ensemble_policy")


def latest_in_scope(evidence: DataFrame, scope: list[str], when: str, tie: str) -> DataFrame:
    w = Window.partitionBy(*scope).orderBy(F.desc(when), F.desc(tie))
    return evidence.withColumn("nth", F.row_number().over(w)).where("nth = 1").drop("nth")


def prune_eligible(artifacts: DataFrame, runs: DataFrame, before) -> DataFrame:
    """Artifacts older than ``before``, and all of failed runs."""
    old = artifacts.where(F.col("created_at") < before).select("artifact_id")
    failed = artifacts.join(runs.where(F.col("status") == "failed").select("run_id"), "run_id").select("artifact_id")
    return old.union(failed).distinct()


def newest_runs(runs: DataFrame, limit: int) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id").limit(limit)


def with_explanations(detections: DataFrame, explanations: DataFrame, row_id: str) -> DataFrame:
    """Detection rows with the columns that only the explanations have."""
    extra = [c for c in explanations.columns if c not in detections.columns]
    return detections.join(explanations.select(row_id, *extra), row_id, "left")
