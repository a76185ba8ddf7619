"""Reading, listing, comparing and evaluating recorded runs."""

from __future__ import annotations

import re
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .errors import WorkflowError
from .functions.codec import decode, encode_ordered
from .operators import checks, compare, diff, listing
from .operators.integrity import require_valid
from .plans.eligibility import EXPLANATIONS
from .sources.earlier import EARLIER_DDL, Earlier
from .sources.store import RECORD_BYTES, Store

RUN_ID = re.compile(r"run_[0-9a-f]{64}\Z")
# Limits.
SCAN_LIMIT, DEFAULT_LIMIT, MOST = 1000, 20, 1000
PREVIEW_BYTES, PREVIEW_ROWS = 256 << 10, 100
PREVIEW_CHECKS, PREVIEW_RECEIPT = 128, 16 << 20

_STAGES = """array<struct<stageId: string, dependencies: array<struct<name: string, stageId: string, hash: string>>, policy: string,
 preview: struct<decision: string, reason: string>, actual: struct<decision: string, reason: string>, status: string, fingerprint: string,
 components: map<string, string>, output: struct<kind: string, hash: string, byteLength: bigint, observedAt: string, origin: struct<attemptId: string, stageId: string>>,
 error: struct<code: string, callbackInvoked: boolean>>>"""
RUN_DDL = f"""schemaVersion string, id string, recordHash string, attemptId string, workflowId string, startedAt string, finalizedAt string, status string,
 baseline struct<runId: string, recordHash: string, schemaVersion: string, status: string>, failureMode string, propagation string,
 refresh struct<scope: string, stageIds: array<string>>, stages {_STAGES}"""


class History:
    """Runs of a store.  ``earlier`` tells how records of the earlier format are verified."""

    def __init__(self, store: Store | str | Path, earlier: Earlier | None = None):
        self.store = store if isinstance(store, Store) else Store(store)
        self.earlier = earlier or Earlier()

    def _verified(self, id: str) -> dict[str, Any]:
        """A record of either format, verified by the rules of its own."""
        data = self.store.record_bytes(id)
        return self.earlier.load(data, id) if self.earlier.claims(data) else require_valid(decode(data), id)

    def is_earlier(self, record: dict[str, Any]) -> bool:
        return record["schemaVersion"] == self.earlier.schema

    def _summary(self, r: dict[str, Any]) -> dict[str, Any]:
        if self.is_earlier(r):
            own = {"startedAt": r["createdAt"], "finalizedAt": r["completedAt"], "status": r["executionStatus"], "baselineRunId": r["baselineRunId"]}
        else:
            own = {"startedAt": r["startedAt"], "finalizedAt": r["finalizedAt"], "status": r["status"], "baselineRunId": (r["baseline"] or {}).get("runId")}
        return {"id": r["id"], "workflowId": r["workflowId"], **own, "stages": len(r["stages"]), "schemaVersion": r["schemaVersion"]}

    def _ids(self) -> list[str]:
        """Ids of all records; foreign names and too many records are errors, whatever is asked for."""
        folder = self.store.folder("runs")
        names = sorted(p.name for p in folder.iterdir()) if folder.exists() else []
        for n in names:
            if not (n.endswith(".json") and RUN_ID.match(n[:-5])):
                raise WorkflowError("unexpected_entry", "list", path=str(folder / n))
        if len(names) > SCAN_LIMIT:
            raise WorkflowError("scan_limit", "list", limit=SCAN_LIMIT)
        return [n[:-5] for n in names]

    def runs(self, workflow: str | None = None, limit: int = DEFAULT_LIMIT) -> dict[str, Any]:
        """Newest first by (finalizedAt, id), of both formats.  Every record is verified before the filter applies."""
        if not isinstance(limit, int) or isinstance(limit, bool) or not 1 <= limit <= MOST:
            raise WorkflowError("invalid_limit", "list", limit=limit)
        told = [self._summary(self._verified(i)) for i in self._ids()]
        found = [r for r in told if workflow is None or r["workflowId"] == workflow]
        found.sort(key=lambda r: (r["finalizedAt"], r["id"]), reverse=True)
        return {"runs": found[:limit], "totalMatched": len(found), "truncated": len(found) > limit}

    def earlier_runs(self, workflow: str | None = None) -> list[dict[str, Any]]:
        """Records of the earlier format as its own tools list them: foreign names are passed over, there is no limit.

        The newest by createdAt come first; equal ones are in ascending order of id.
        """
        folder = self.store.folder("runs")
        ids = sorted(p.name[:-5] for p in folder.iterdir() if p.name.endswith(".json") and RUN_ID.match(p.name[:-5])) if folder.exists() else []
        found = [self.earlier.load(data, i) for i in ids if self.earlier.claims(data := self.store.record_bytes(i))]
        return sorted((r for r in found if workflow is None or r["workflowId"] == workflow), key=lambda r: r["createdAt"], reverse=True)

    def inspect(self, run: str) -> dict[str, Any]:
        """One record, read by its path without a scan."""
        if not isinstance(run, str) or not RUN_ID.match(run):
            raise WorkflowError("invalid_run_id", "inspect", run=run)
        return self._verified(run)

    def _reference(self, run: str, stage: str) -> dict[str, Any]:
        found = [s for s in self.inspect(run)["stages"] if s["stageId"] == stage]
        if not found:
            raise WorkflowError("stage_not_found", "output", run=run, stage=stage)
        s = found[0]
        if "outputArtifactHash" in s:
            ref, status, reason = s["outputArtifactHash"] and {"kind": "earlier", "hash": s["outputArtifactHash"]}, s["executionStatus"], s["decisionReason"]
        else:
            ref, status, reason = s["output"], s["status"], s["actual"]["reason"]
        if ref is None:
            raise WorkflowError("output_absent", "output", run=run, stage=stage, status=status, reason=reason)
        return ref

    def output(self, run: str, stage: str, spark: SparkSession | None = None) -> Any:
        """A stage's verified output: a JSON value or a DataFrame."""
        ref = self._reference(run, stage)
        if ref["kind"] == "json":
            return self.store.get_value(ref)
        if ref["kind"] == "earlier":
            return self.earlier.output(self.store, ref["hash"])
        if spark is None:
            raise WorkflowError("session_required", "output", run=run, stage=stage)
        return self.store.get_table(spark, ref, verify=True)

    def preview(self, run: str, stage: str, spark: SparkSession | None = None) -> dict[str, Any]:
        """At most 256 KiB of an output as text, of a table its first rows; ``truncated`` when there is more of either."""
        got = self.output(run, stage, spark)
        if not isinstance(got, DataFrame):
            raw, more = encode_ordered(got).encode(), False
        else:
            rows = got.limit(PREVIEW_ROWS + 1).toJSON().collect()
            raw, more = "\n".join(rows[:PREVIEW_ROWS]).encode(), len(rows) > PREVIEW_ROWS
        return {"text": raw[:PREVIEW_BYTES].decode("utf-8", "ignore"), "truncated": more or len(raw) > PREVIEW_BYTES}

    def receipt_preview(self, id: str, spark: SparkSession | None = None) -> dict[str, Any]:
        """A verified receipt for showing; one of too many checks or bytes is refused."""
        got = self.receipt(id, spark)
        if len(got["checks"]) > PREVIEW_CHECKS or len(encode_ordered(got).encode()) > PREVIEW_RECEIPT:
            raise WorkflowError("size_limit", "preview", receipt=id)
        return got

    def compare(self, left: str, right: str, stage: str, spark: SparkSession | None = None) -> dict[str, Any]:
        """{equal, difference}; both sides are verified first, and errors name their side."""
        sides = []
        for name, run in (("left", left), ("right", right)):
            try:
                sides.append(self.output(run, stage, spark))
            except WorkflowError as e:
                raise WorkflowError(e.code, "compare", side=name, **e.context) from e
        tables = [isinstance(s, DataFrame) for s in sides]
        if all(tables):
            order = self._reference(left, stage).get("order") or None
            found = compare.first_table_difference(*sides, order)
        elif any(tables):
            found = {"path": "", "reason": "type"}
        else:
            found = compare.first_difference(*sides)
        return {"equal": found is None, "difference": found}

    def latest(self, workflow: str) -> dict[str, Any] | None:
        """The newest run that this engine recorded; runs of the earlier format are not taken up."""
        got = [r for r in self.runs(workflow, MOST)["runs"] if r["schemaVersion"] != self.earlier.schema]
        return self.inspect(got[0]["id"]) if got else None

    def lineage(self, run: str) -> list[str]:
        """The run and the baselines behind it."""
        out, at = [], run
        while at:
            out.append(at)
            at = self._summary(self.inspect(at))["baselineRunId"]
        return out

    def explain(self, run: str) -> list[dict[str, str]]:
        return [{"stageId": s["stageId"], "reason": s["actual"]["reason"], "explanation": EXPLANATIONS.get(s["actual"]["reason"], "")} for s in self.inspect(run)["stages"]]

    # as DataFrames

    def _texts(self, spark: SparkSession, earlier: bool) -> DataFrame:
        """Texts of the records of one format.  All are verified before any filter can hide one."""
        for i in self._ids():
            self._verified(i)
        raw = spark.read.format("binaryFile").option("pathGlobFilter", "run_*.json").load(str(self.store.folder("runs", True)))
        text = raw.where(F.col("length") <= RECORD_BYTES).select(F.decode("content", "UTF-8").alias("t"))
        own = F.get_json_object("t", "$.schemaVersion") == self.earlier.schema
        return text.where(own if earlier else ~own)

    def run_table(self, spark: SparkSession) -> DataFrame:
        """The records of the current format as rows."""
        return self._texts(spark, False).select(F.from_json("t", RUN_DDL, {"mode": "FAILFAST"}).alias("r")).select("r.*")

    def earlier_table(self, spark: SparkSession) -> DataFrame:
        """The records of the earlier format as rows."""
        return self._texts(spark, True).select(F.from_json("t", EARLIER_DDL, {"mode": "FAILFAST"}).alias("r")).select("r.*")

    def summary_table(self, spark: SparkSession) -> DataFrame:
        """Summaries of all records, both formats in one table."""
        return listing.summaries(self.run_table(spark), self.earlier_table(spark))

    def stage_table(self, spark: SparkSession) -> DataFrame:
        """A row per run and stage, with its position."""
        s = self.run_table(spark).select(F.col("id").alias("run_id"), "workflowId", "finalizedAt", "failureMode", F.posexplode("stages").alias("position", "s"))
        return s.select(
            "run_id", F.col("workflowId").alias("workflow_id"), F.col("finalizedAt").alias("finalized_at"), F.col("failureMode").alias("failure_mode"), "position", F.col("s.stageId").alias("stage_id"), F.col("s.policy").alias("policy"),
            F.col("s.preview.decision").alias("preview"), F.col("s.actual.decision").alias("decision"), F.col("s.actual.reason").alias("reason"), F.col("s.status").alias("status"), F.col("s.fingerprint").alias("fingerprint"),
            F.array_sort(F.map_values("s.components")).alias("components"), F.col("s.output.hash").alias("output_hash"), F.col("s.output").isNotNull().alias("has_output"), F.col("s.output.origin.attemptId").alias("origin"), F.col("s.error.code").alias("error_code"),
            F.transform("s.dependencies", lambda d: F.concat_ws("=", d["name"], d["stageId"])).alias("dependencies"),
        )

    def diff(self, spark: SparkSession, before: str, after: str) -> DataFrame:
        """Stage-by-stage difference of two runs."""
        left, right = self.inspect(before), self.inspect(after)
        if left["workflowId"] != right["workflowId"]:
            raise WorkflowError("workflow_mismatch", "diff", left=before, right=after)
        s = self.stage_table(spark)
        return diff.diff_runs(s.where(F.col("run_id") == before), s.where(F.col("run_id") == after))

    # evaluation

    def evaluate(self, suite: checks.Suite, candidate: str, baseline: str | None = None, spark: SparkSession | None = None) -> dict[str, Any]:
        """Runs a suite on a candidate and its baseline run and stores the receipt.  Targets may be values or tables."""
        new = self.inspect(candidate)
        base_id = baseline or (new["baseline"] or {}).get("runId")
        if base_id is None:
            raise WorkflowError("baseline_required", "evaluate", run=candidate)
        if base_id == candidate:
            raise WorkflowError("same_run", "evaluate", run=candidate)
        old = self.inspect(base_id)
        self._gates(old, new)
        if suite.history is None:
            suite.history = self.store.root
        wanted = {c.stage for c in suite.checks}
        refs = {side: {s["stageId"]: s["output"] for s in r["stages"] if s["stageId"] in wanted and s["output"]} for side, r in (("baseline", old), ("candidate", new))}
        if missing := sorted(wanted - (refs["baseline"].keys() & refs["candidate"].keys())):
            raise WorkflowError("target_unavailable", "evaluate", stages=missing)
        distinct = {ref["hash"]: ref for side in refs.values() for ref in side.values()}
        values = {h: self._target(ref, spark) for h, ref in distinct.items()}
        outputs = [{k: values[ref["hash"]] for k, ref in refs[side].items()} for side in ("baseline", "candidate")]
        result = checks.evaluate_pair(suite, *outputs, {side: {k: ref["hash"] for k, ref in refs[side].items()} for side in refs})
        body = {
            "workflowId": new["workflowId"], "baselineRunId": old["id"], "baselineRecordHash": old["recordHash"], "candidateRunId": new["id"], "candidateRecordHash": new["recordHash"], **result,
        }
        return self.store.put_receipt(body, lambda: suite.fingerprint() == result["suite"])

    def _gates(self, old: dict[str, Any], new: dict[str, Any]) -> None:
        """What must hold of two runs for an evaluation."""
        if old["workflowId"] != new["workflowId"]:
            raise WorkflowError("workflow_mismatch", "evaluate", run=new["id"])
        if "completed" != old["status"] or "completed" != new["status"]:
            raise WorkflowError("run_not_completed", "evaluate", run=new["id"])
        if not new["baseline"] or (new["baseline"]["runId"], new["baseline"]["recordHash"]) != (old["id"], old["recordHash"]):
            raise WorkflowError("lineage_mismatch", "evaluate", run=new["id"])

    def _target(self, ref: dict[str, Any], spark: SparkSession | None) -> Any:
        if ref["kind"] == "json":
            return self.store.get_value(ref)
        if spark is None:
            raise WorkflowError("session_required", "evaluate", hash=ref["hash"])
        return self.store.get_table(spark, ref, verify=True)

    def receipt_runs(self, id: str) -> list[dict[str, Any]]:
        """The records of the two runs that a receipt names."""
        got = self.store.get_receipt(id)
        return [self.inspect(got[f"{side}RunId"]) for side in ("baseline", "candidate")]

    def receipt(self, id: str, spark: SparkSession | None = None) -> dict[str, Any]:
        """A stored receipt, verified against itself and against the runs and outputs it names.

        The suite is restored from its description and hashed again, verdicts,
        counters and statuses are worked out again, and every selection is made
        again from its source.  Table sources are read again where a session is given.
        """
        got = self.store.get_receipt(id)

        def rule(holds: bool, part: str) -> None:
            if not holds:
                raise WorkflowError("receipt_corrupt", "read", receipt=id, part=part)

        suite = checks.restore_suite(got["suiteDescriptor"])
        rule(checks.suite_digest(got["suiteDescriptor"]) == got["suite"], "suite")
        rule([(c["check_id"], c["stage"]) for c in got["checks"]] == [(c.id, c.stage) for c in suite.checks], "checks")
        for c in got["checks"]:
            rule(c["comparison"] == checks.verdict(c["baseline"]["passed"], c["candidate"]["passed"]), "comparison")
        rule(checks.summary_of(got["checks"]) == (got["summary"], got["candidateStatus"], got["comparisonStatus"]), "summary")
        old, new = (self.inspect(got[f"{side}RunId"]) for side in ("baseline", "candidate"))
        rule((old["recordHash"], new["recordHash"]) == (got["baselineRecordHash"], got["candidateRecordHash"]) and new["workflowId"] == got["workflowId"], "runs")
        self._gates(old, new)
        values: dict[str, Any] = {}
        for check, row in zip(suite.checks, got["checks"]):
            for run, side in ((old, "baseline"), (new, "candidate")):
                ref = next((s["output"] for s in run["stages"] if s["stageId"] == check.stage), None)
                rule(ref is not None and ref["hash"] == row[side]["source"], "source")
                if ref["kind"] == "table" and spark is None:
                    continue
                if ref["hash"] not in values:
                    values[ref["hash"]] = self._target(ref, spark)
                selected, code = None, None
                try:
                    selected = check.pick(values[ref["hash"]])
                except WorkflowError as e:
                    code = e.code
                rule(row[side]["fingerprint"] == checks.check_fingerprint(got["suite"], check.id, check.stage, ref["hash"], selected), "fingerprint")
                rule(code is None or row[side]["error"] == code, "contract")
        return got
