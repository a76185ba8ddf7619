"""Listings of run records of both formats, as DataFrames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What a summary shows of a run.
SUMMARY = ("id", "workflow_id", "finalized_at", "status", "baseline_id", "baseline_hash", "schema_version")
#: Statuses that a histogram has a column for.
STATUSES = ("reused", "succeeded", "failed", "skipped")


def summarise_current(runs: DataFrame) -> DataFrame:
    """Summaries of records as the history's run table has them."""
    return runs.select(
        "id", F.col("workflowId").alias("workflow_id"), F.col("finalizedAt").alias("finalized_at"), "status", F.col("baseline.runId").alias("baseline_id"), F.col("baseline.recordHash").alias("baseline_hash"), F.col("schemaVersion").alias("schema_version"),
    )


def summarise_earlier(runs: DataFrame) -> DataFrame:
    """Summaries of records of the earlier format; a baseline counts only where both its names are there."""
    both = F.col("baselineRunId").isNotNull() & F.col("baselineManifestHash").isNotNull()
    return runs.select(
        "id", F.col("workflowId").alias("workflow_id"), F.col("completedAt").alias("finalized_at"), F.col("executionStatus").alias("status"), F.when(both, F.col("baselineRunId")).alias("baseline_id"), F.when(both, F.col("baselineManifestHash")).alias("baseline_hash"), F.col("schemaVersion").alias("schema_version"),
    )


def summaries(current: DataFrame, earlier: DataFrame) -> DataFrame:
    """One listing of both formats."""
    return summarise_current(current).unionByName(summarise_earlier(earlier))


def newest(listing: DataFrame, limit: int) -> DataFrame:
    """The newest runs first, by time and then id, both descending; the limit is the feature."""
    return listing.orderBy(F.desc("finalized_at"), F.desc("id")).limit(limit)


def newest_earlier(runs: DataFrame, limit: int) -> DataFrame:
    """The earlier format's own order: by time of creation descending, then id ascending."""
    return runs.orderBy(F.desc("createdAt"), F.asc("id")).limit(limit)


def status_histogram(stages: DataFrame, run: str = "run_id", status: str = "status", names: tuple[str, ...] = STATUSES) -> DataFrame:
    """A row per run with the number of its stages of each status; one aggregation, no pivot pass for the names."""
    return stages.groupBy(run).agg(*[F.count_if(F.col(status) == n).alias(n) for n in names])
