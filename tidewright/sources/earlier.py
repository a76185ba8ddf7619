"""Run records and outputs of the earlier format, which can be read but not written.

Its JSON text has sorted keys, its outputs have no header, and a run stops at its
first failure.  The domains that its digests are taken under are parameters: a
history made elsewhere is read under the domains of its maker.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from typing import Any

from ..errors import WorkflowError
from ..functions.codec import decode, encode_sorted
from ..functions.identity import digest
from ..operators.integrity import HASH, is_time
from ..plans.graph import NAME
from .store import OUTPUT_BYTES, Store

# Names of the earlier format.
SCHEMA = "phase0-run-v1"
DERIVED = {"codec": "canonical-json-v1", "hashScheme": "sha256-domain-v1", "fingerprintContract": "phase0-v1"}
RUN_FIELDS = {
    "schemaVersion", "id", "manifestHash", "workflowId", "baselineRunId", "baselineManifestHash", "createdAt", "completedAt", "executionStatus", "evaluationStatus", "stages",
}
STAGE_FIELDS = {
    "stageId", "dependencyIds", "plannedDecision", "finalDecision", "decisionReason", "decisionDetails", "executionStatus", "evaluationStatus", "fingerprint", "componentHashes",
    "outputArtifactHash", "error",
}
COMPONENTS = {"cachePolicy", "codec", "dependencies", "environment", "implementation", "selectedInputs", "watchedFiles"}
REASONS = {
    "no_baseline", "manual_invalidation", "volatile_stage", "cache_disabled", "stage_missing_from_baseline", "baseline_stage_not_reusable", "dependency_executed",
    "fingerprint_changed", "fingerprint_match", "baseline_artifact_unavailable",
}
ENDED = ("succeeded", "reused", "failed")
SKIPPED = ("skipped_dependency_failed", "skipped_run_stopped")

EARLIER_DDL = """schemaVersion string, id string, manifestHash string, workflowId string, baselineRunId string, baselineManifestHash string, createdAt string, completedAt string,
 executionStatus string, evaluationStatus string, stages array<struct<stageId: string, dependencyIds: array<string>, plannedDecision: string, finalDecision: string,
 decisionReason: string, executionStatus: string, evaluationStatus: string, fingerprint: string, componentHashes: map<string, string>, outputArtifactHash: string,
 error: struct<name: string, message: string>>>"""


def _is_hash(x: Any) -> bool:
    return isinstance(x, str) and HASH.match(x) is not None


def _listed(found: Any, among: set[str] | list[str]) -> bool:
    """A list of different names, all of them known."""
    return isinstance(found, list) and all(isinstance(x, str) for x in found) and len(set(found)) == len(found) and set(found) <= set(among)


def _details_hold(details: Any, reason: str | None, needs: list[str]) -> bool:
    """What a decision says beside its reason: nothing, but for three reasons one list or status."""
    if not isinstance(details, dict):
        return False
    if reason == "fingerprint_changed":
        return set(details) == {"changedComponents"} and _listed(details["changedComponents"], COMPONENTS)
    if reason == "dependency_executed":
        return set(details) == {"dependencies"} and bool(details["dependencies"]) and _listed(details["dependencies"], needs)
    if reason == "baseline_stage_not_reusable":
        return set(details) == {"baselineExecutionStatus"} and details["baselineExecutionStatus"] in (*ENDED, *SKIPPED, "pending")
    return not details


def _broken_in(s: dict[str, Any], known: set[str], halted: set[str], failed: bool, has_baseline: bool) -> Iterator[str]:
    """Rules that one stage breaks, given the stages before it."""
    needs, status, reason = s["dependencyIds"], s["executionStatus"], s["decisionReason"]
    if not (isinstance(s["stageId"], str) and NAME.match(s["stageId"]) and s["stageId"] not in known):
        yield "stage_ids"
    if not _listed(needs, known):
        yield "dependencies"
        needs = []
    if not ({s["plannedDecision"], s["finalDecision"]} <= {"reuse", "execute"} and reason in REASONS):
        yield "decision"
    if s["plannedDecision"] == "reuse" and not has_baseline:
        yield "planned"
    if s["evaluationStatus"] != "not_run":
        yield "evaluation"
    expected = (SKIPPED[0] if halted & set(needs) else SKIPPED[1],) if failed else ENDED
    if status not in expected:
        yield "skip_reason" if failed else "status"
    if s["finalDecision"] != ("reuse" if status == "reused" else "execute") or (status == "reused" and (s["plannedDecision"], reason) != ("reuse", "fingerprint_match")):
        yield "decision"
    if not _details_hold(s["decisionDetails"], None if failed else reason, needs):
        yield "details"
    error = s["error"]
    if (status == "failed") != (error is not None) or (error is not None and not (isinstance(error, dict) and set(error) == {"name", "message"} and all(isinstance(x, str) for x in error.values()))):
        yield "error"
    made = (s["outputArtifactHash"], s["fingerprint"], s["componentHashes"])
    if status in ("succeeded", "reused"):
        if not (_is_hash(made[0]) and _is_hash(made[1]) and isinstance(made[2], dict) and set(made[2]) == COMPONENTS and all(map(_is_hash, made[2].values()))):
            yield "output"
    elif made != (None, None, None):
        yield "output"


@dataclass(frozen=True)
class Earlier:
    """How the earlier format is recognised and verified."""

    schema: str = SCHEMA
    run_domain: str = "tidewright/earlier-run/v1"
    artifact_domain: str = "tidewright/earlier-artifact/v1"
    #: Folder of outputs in the store; an output's file is named by the hex of its digest.
    outputs: str = "objects/sha256"

    def claims(self, data: bytes) -> bool:
        try:
            value = json.loads(data)
        except ValueError:
            return False
        return isinstance(value, dict) and value.get("schemaVersion") == self.schema

    def broken_rules(self, r: dict[str, Any], id: str) -> list[str]:
        """Names of the rules that a record breaks; a sound one has none."""
        if set(r) != RUN_FIELDS or not isinstance(r["stages"], list) or any(not isinstance(s, dict) or set(s) != STAGE_FIELDS for s in r["stages"]):
            return ["fields"]
        found = []
        body = {k: v for k, v in r.items() if k not in ("id", "manifestHash")}
        h = digest(self.run_domain, encode_sorted(body).encode())
        if (r["manifestHash"], r["id"], r["id"]) != (h, "run_" + h[7:], id):
            found.append("identity")
        if not (is_time(r["createdAt"]) and is_time(r["completedAt"]) and r["completedAt"] >= r["createdAt"]):
            found.append("times")
        base, base_hash = r["baselineRunId"], r["baselineManifestHash"]
        if (base is None) != (base_hash is None) or (base is not None and not (_is_hash(base_hash) and base == "run_" + base_hash[7:] and base != r["id"])):
            found.append("baseline")
        if not (isinstance(r["workflowId"], str) and NAME.match(r["workflowId"])) or r["evaluationStatus"] != "not_run":
            found.append("workflow")
        known: set[str] = set()
        halted: set[str] = set()
        failed = False
        for s in r["stages"]:
            found += _broken_in(s, known, halted, failed, base is not None)
            if s["executionStatus"] in ("failed", SKIPPED[0]):
                halted.add(s["stageId"])
            failed = failed or s["executionStatus"] == "failed"
            known.add(s["stageId"])
        if r["executionStatus"] != ("failed" if failed else "completed"):
            found.append("status")
        return list(dict.fromkeys(found))

    def load(self, data: bytes, id: str) -> dict[str, Any]:
        """A verified record with the three names that the format implies."""
        r = decode(data, "sorted")
        if broken := self.broken_rules(r, id):
            raise WorkflowError("run_corrupt", "read", run=id, rules=broken)
        return {**r, **DERIVED}

    def output(self, store: Store, hash: str) -> Any:
        """A verified output: JSON text with sorted keys under its digest."""
        path = store.root / self.outputs / hash[7:]
        if not path.exists():
            raise WorkflowError("output_missing", "read", path=str(path))
        data = store._read(path, OUTPUT_BYTES, "read")
        if data.startswith(b"tidewright/"):
            raise WorkflowError("unknown_format", "read", path=str(path))
        if digest(self.artifact_domain, data) != hash:
            raise WorkflowError("output_corrupt", "read", path=str(path))
        return decode(data, "sorted")
