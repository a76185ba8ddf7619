"""Row diffs, run diffs and graph reachability as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import WorkflowError
from ..sources.shared import checkpointed

#: Fields of a stage record that a run diff compares, in the order it reports them.
STAGE_FIELDS = (
    "dependencies", "policy", "preview", "decision", "reason", "status", "fingerprint", "components", "output_hash", "origin", "error_code",
)


def differing(fields: list[str], left: str = "l", right: str = "r") -> Column:
    """The fields that differ between two joined structs, null-safe, in the given order."""
    return F.array_compact(F.array(*[F.when(~F.col(f"{left}.{f}").eqNullSafe(F.col(f"{right}.{f}")), F.lit(f)) for f in fields]))


def diff_rows(before: DataFrame, after: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Keys with kind (added, removed, changed, unchanged) and changed_fields.

    One full outer join; keys are unique on either side and not null.
    """
    left = before.select(*keys, F.struct(*fields).alias("l"))
    right = after.select(*keys, F.struct(*fields).alias("r"))
    both = left.join(right, keys, "full").withColumn("changed_fields", F.when(F.col("l").isNotNull() & F.col("r").isNotNull(), differing(fields)))
    kind = F.when(F.col("l").isNull(), "added").when(F.col("r").isNull(), "removed").when(F.size("changed_fields") > 0, "changed").otherwise("unchanged")
    return both.select(*keys, kind.alias("kind"), F.coalesce("changed_fields", F.array().cast("array<string>")).alias("changed_fields"), "l", "r")


def diff_runs(stages_before: DataFrame, stages_after: DataFrame) -> DataFrame:
    """Stage-by-stage diff of two runs, in the order of the first and then the new stages of the second."""
    fields = [f for f in STAGE_FIELDS if f in stages_before.columns and f in stages_after.columns]
    d = diff_rows(stages_before, stages_after, ["stage_id"], [*fields, "position"])
    place = F.coalesce(F.col("l.position"), F.lit(1_000_000) + F.col("r.position"))
    changed = F.array_remove("changed_fields", "position")
    kind = F.when((F.col("kind") == "changed") & (F.size(changed) == 0), "unchanged").otherwise(F.col("kind"))
    return d.select("stage_id", kind.alias("kind"), changed.alias("changed_fields"), place.alias("place")).orderBy("place").drop("place")


def diff_summary(runs_diff: DataFrame) -> DataFrame:
    return runs_diff.agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("added", "removed", "changed", "unchanged")])


def reachable(spark: SparkSession, edges: DataFrame, root: str) -> DataFrame:
    """(node, depth) of everything downstream of a root in an acyclic edge list (src, dst); depth is the longest way.

    One join a level over distinct nodes, so many ways to a node cost one row a
    level.  More levels than edges mean a cycle, which is an error.
    """
    steps = checkpointed(edges.select("src", "dst").distinct())
    most, depth = steps.count(), 0
    front = spark.range(1).select(F.lit(root).alias("node"))
    found = front.withColumn("depth", F.lit(0).cast("long"))
    while True:
        front = checkpointed(steps.join(front.withColumnRenamed("node", "src"), "src").select(F.col("dst").alias("node")).distinct())
        if front.isEmpty():
            return found.groupBy("node").agg(F.max("depth").alias("depth"))
        depth += 1
        if depth > most:
            raise WorkflowError("cycle", "reachable", root=root)
        found = found.union(front.withColumn("depth", F.lit(depth).cast("long")))
