"""Whether a stage may reuse its baseline output, and every cause why not.

One table of causes serves twice: :func:`decide` for one stage in the engine and
:func:`decide_columns` for whole tables of observations.  Facts are Booleans:
enabled, refreshed, has_baseline, in_baseline, output_present, policy_ok,
influences_known, influences_equal, available.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The names of causes and reasons in this module.
#: cause, facts that must hold, facts that must not hold; in the order of report.
CAUSES: tuple[tuple[str, tuple[str, ...], tuple[str, ...]], ...] = (
    ("reuse_not_enabled", (), ("enabled",)),
    ("refresh", ("refreshed",), ()),
    ("fresh", (), ("has_baseline",)),
    ("baseline_stage_missing", ("has_baseline",), ("in_baseline",)),
    ("baseline_output_absent", ("has_baseline", "in_baseline"), ("output_present",)),
    ("baseline_policy_ineligible", ("has_baseline", "in_baseline"), ("policy_ok",)),
    ("influences_changed", ("has_baseline", "in_baseline", "influences_known"), ("influences_equal",)),
    ("reuse_unavailable", ("has_baseline", "in_baseline", "output_present"), ("available",)),
)
FACTS = ("enabled", "refreshed", "has_baseline", "in_baseline", "output_present", "policy_ok", "influences_known", "influences_equal", "available")


def causes(facts: dict[str, bool]) -> list[str]:
    return [name for name, yes, no in CAUSES if all(facts[f] for f in yes) and not any(facts[f] for f in no)]


def decide(facts: dict[str, bool]) -> tuple[str, str, list[str]]:
    """(decision, reason, causes): the first cause is the reason, none means reuse."""
    found = causes(facts)
    return ("execute", found[0], found) if found else ("reuse", "reused", [])


def decide_columns(facts: DataFrame) -> DataFrame:
    """``facts`` with decision, reason and causes."""

    def cause(name: str, yes: tuple[str, ...], no: tuple[str, ...]) -> Column:
        holds = [F.col(f) for f in yes] + [~F.col(f) for f in no]
        return F.when(reduce(lambda a, b: a & b, holds), F.lit(name))

    out = facts.withColumn("causes", F.array_compact(F.array(*[cause(*c) for c in CAUSES])))
    none = F.size("causes") == 0
    return out.withColumns({"decision": F.when(none, "reuse").otherwise("execute"), "reason": F.coalesce(F.get("causes", F.lit(0)), F.lit("reused"))})


#: The conservative planner's reasons: the first that applies decides.
CONSERVATIVE = (
    "no_baseline", "manual_invalidation", "volatile_stage", "cache_disabled", "dependency_executed", "stage_missing_from_baseline",
    "baseline_stage_not_reusable", "baseline_artifact_unavailable", "fingerprint_changed", "fingerprint_match",
)


def decide_conservative(facts: dict[str, bool]) -> str:
    """Reason under the rule that an executed dependency forces its dependents to run."""
    tests = (
        not facts["has_baseline"], facts["refreshed"], facts["volatile"], not facts["enabled"], facts["dependency_executed"],
        not facts["in_baseline"], not facts["output_present"], not facts["available"], not facts["influences_equal"], True,
    )
    return CONSERVATIVE[tests.index(True)]


def conservative_column() -> Column:
    """The same as :func:`decide_conservative`, over columns named as the facts."""
    c = F.col
    tests = (
        ~c("has_baseline"), c("refreshed"), c("volatile"), ~c("enabled"), c("dependency_executed"),
        ~c("in_baseline"), ~c("output_present"), ~c("available"), ~c("influences_equal"),
    )
    out = F.lit(CONSERVATIVE[-1])
    for holds, reason in reversed(list(zip(tests, CONSERVATIVE))):
        out = F.when(holds, F.lit(reason)).otherwise(out)
    return out


#: What each reason means, for people; also a dimension table.
EXPLANATIONS = {
    "reused": "Nothing the stage declares has changed, so its earlier output was taken over.",
    "reuse_not_enabled": "The stage names no revision, so it always runs.",
    "refresh": "The caller asked for this stage to run again.",
    "fresh": "There is no earlier run to take outputs from.",
    "baseline_stage_missing": "The earlier run has no stage of this name.",
    "baseline_output_absent": "The stage left no output in the earlier run.",
    "baseline_policy_ineligible": "The stage was not reusable in the earlier run.",
    "influences_changed": "Something the stage declares differs from the earlier run.",
    "reuse_unavailable": "The earlier output can no longer be read whole.",
    "unresolved_upstream": "A stage before this one will run, and its output decides.",
    "blocked": "A stage before this one failed.",
    "stopped": "An earlier failure ended the run.",
}


def explanations(spark) -> DataFrame:
    return spark.createDataFrame(list(EXPLANATIONS.items()), "reason string, explanation string")
