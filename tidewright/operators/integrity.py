"""Rules that every run record keeps, for one record and for tables of records."""

from __future__ import annotations

import datetime as dt
import re
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import WorkflowError
from ..functions.codec import encode_ordered
from ..functions.identity import digest
from ..plans.graph import NAME
from .verify import violations

RUN_FIELDS = ("schemaVersion", "id", "recordHash", "attemptId", "workflowId", "startedAt", "finalizedAt", "status", "baseline", "failureMode", "propagation", "refresh", "stages")
STAGE_FIELDS = ("stageId", "dependencies", "policy", "preview", "actual", "status", "fingerprint", "components", "output", "error")
TIME = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}\.[0-9]{3}Z\Z")
HASH = re.compile(r"sha256:[0-9a-f]{64}\Z")


def is_time(text: Any) -> bool:
    """Whether a text is a moment in the one form that is written, and stays the same when read and written again."""
    if not isinstance(text, str) or not TIME.match(text):
        return False
    try:
        moment = dt.datetime.fromisoformat(text[:-1])
    except ValueError:
        return False
    return moment.isoformat(timespec="milliseconds") + "Z" == text


def time_column(text: Column) -> Column:
    """The same as :func:`is_time`, over a column; null is no time."""
    form = "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"
    again = F.date_format(F.try_to_timestamp(text, F.lit(form)), form)
    return F.coalesce(text.rlike(TIME.pattern.replace(r"\Z", r"\z")) & (again == text), F.lit(False))


def validate_run(r: dict[str, Any]) -> list[str]:
    """Names of the broken rules; a sound record has none."""
    if tuple(r) != RUN_FIELDS or any(tuple(s) != STAGE_FIELDS for s in r["stages"]):
        return ["fields"]
    broken = []

    def rule(name: str, holds: bool) -> None:
        if not holds and name not in broken:
            broken.append(name)

    body = {k: v for k, v in r.items() if k not in ("id", "recordHash")}
    h = digest(r["schemaVersion"], encode_ordered(body).encode())
    rule("identity", r["recordHash"] == h and r["id"] == "run_" + h[7:])
    rule("times", all(is_time(r[k]) for k in ("startedAt", "finalizedAt")) and r["finalizedAt"] >= r["startedAt"])
    base = r["baseline"]
    rule("baseline", base is None or (HASH.match(base["recordHash"]) is not None and base["runId"] == "run_" + base["recordHash"][7:] and base["runId"] != r["id"]))
    ids = [s["stageId"] for s in r["stages"]]
    chosen = r["refresh"]["stageIds"]
    rule("refresh", len(set(chosen)) == len(chosen) and set(chosen) <= set(ids) and (r["refresh"]["scope"] in ("selected", "descendants")) == bool(chosen))
    rule("stage_ids", len(set(ids)) == len(ids) and all(NAME.match(i) for i in ids))
    seen: set[str] = set()
    halted: set[str] = set()
    failed = False
    for s in r["stages"]:
        names = [d["name"] for d in s["dependencies"]]
        rule("dependencies", len(set(names)) == len(names) and all(names) and all(d["stageId"] in seen for d in s["dependencies"]))
        decision, reason, status = s["actual"]["decision"], s["actual"]["reason"], s["status"]
        rule("decision", (decision == "reuse") == (status == "reused") == (reason in ("reused", "fingerprint_match")) and (decision == "skip") == (reason in ("blocked", "stopped")) == (status == "skipped"))
        if decision == "skip":
            behind = any(d["stageId"] in halted for d in s["dependencies"])
            rule("skip_reason", reason == "blocked" if behind else reason == "stopped" and failed and r["failureMode"] == "fail-fast")
        if s["policy"] == "always-execute":
            rule("policy", s["fingerprint"] is None and s["components"] is None)
        elif s["components"] is not None:
            again = digest("tidewright/fingerprint/v1", encode_ordered({"workflowId": r["workflowId"], "stageId": s["stageId"], "components": s["components"]}).encode())
            rule("fingerprint", s["fingerprint"] == again)
        if status in ("succeeded", "reused"):
            out = s["output"]
            rule("output", out is not None and s["error"] is None and out["origin"]["stageId"] == s["stageId"] and HASH.match(out["hash"]) is not None)
            if status == "succeeded" and out:
                rule("observed", r["startedAt"] <= out["observedAt"] <= r["finalizedAt"] and out["origin"]["attemptId"] == r["attemptId"])
        elif status == "failed":
            rule("error", s["output"] is None and isinstance(s["error"], dict) and tuple(s["error"]) == ("code", "callbackInvoked") and isinstance(s["error"]["callbackInvoked"], bool))
            failed = True
        if status in ("failed", "skipped"):
            halted.add(s["stageId"])
        seen.add(s["stageId"])
    rule("status", r["status"] == ("failed" if failed else "completed"))
    return broken


def require_valid(r: dict[str, Any], id: str) -> dict[str, Any]:
    broken = validate_run(r)
    if r.get("id") != id:
        broken = [*broken, "file_name"]
    if broken:
        raise WorkflowError("run_corrupt", "read", run=id, rules=broken)
    return r


def so_far(flag: Column, run: list[str], position: str) -> Column:
    """Whether the flag held in any earlier row of the run: a running maximum."""
    before = Window.partitionBy(*run).orderBy(position).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.bool_or(flag).over(before), F.lit(False))


def stage_violations(run_stages: DataFrame) -> DataFrame:
    """The ordering rules as columns: (run_id, position, stage_id, violations) of the stages that break one.

    ``run_stages`` has run_id, failure_mode, position, stage_id, decision,
    reason, status, has_output and error_code.  "Failed so far" is a running
    maximum over the earlier stages of a run.
    """
    same = Window.partitionBy("run_id", "stage_id")
    s = run_stages.withColumns({"failed_before": so_far(F.col("status") == "failed", ["run_id"], "position"), "same_id": F.count("*").over(same)})
    rules = {
        "stage_ids": F.col("same_id") > 1,
        "decision": (F.col("decision") == "reuse") != (F.col("status") == "reused"),
        "skip_reason": (F.col("decision") == "skip") & ~F.col("failed_before"),
        "stopped_mode": (F.col("reason") == "stopped") & (F.col("failure_mode") != "fail-fast"),
        "output": F.col("status").isin("succeeded", "reused") != F.col("has_output"),
        "error": (F.col("status") == "failed") != F.col("error_code").isNotNull(),
    }
    return violations(s, rules).where(F.size("violations") > 0).select("run_id", "position", "stage_id", "violations")
