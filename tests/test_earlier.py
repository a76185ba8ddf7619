"""Histories of the earlier format, assembled by hand."""

import hashlib
import json

import pytest

from tidewright import History, Workflow, WorkflowError, prepare, stage
from tidewright.operators import listing
from tidewright.sources.earlier import COMPONENTS, Earlier

H = "sha256:" + "0" * 64
DOMAINS = Earlier(run_domain="other/run/v1", artifact_domain="other/artifact/v1")


def sha(domain, data):
    return hashlib.sha256(domain.encode() + b"\0" + data).hexdigest()


def text(value):
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def made(stage_id, status="succeeded", output=H, **change):
    done = status in ("succeeded", "reused")
    return {
        "stageId": stage_id, "dependencyIds": [], "plannedDecision": "reuse" if status == "reused" else "execute", "finalDecision": "reuse" if status == "reused" else "execute",
        "decisionReason": "fingerprint_match" if status == "reused" else "no_baseline", "decisionDetails": {}, "executionStatus": status, "evaluationStatus": "not_run",
        "fingerprint": H if done else None, "componentHashes": dict.fromkeys(COMPONENTS, H) if done else None, "outputArtifactHash": output if done else None,
        "error": {"name": "Error", "message": "no"} if status == "failed" else None, **change,
    }


def write(root, stages, domain="other/run/v1", raw=None, **change):
    body = {
        "schemaVersion": "phase0-run-v1", "workflowId": "flow", "baselineRunId": "run_" + "0" * 64, "baselineManifestHash": H, "createdAt": "2024-01-01T00:00:00.000Z", "completedAt": "2024-01-02T00:00:00.000Z",
        "executionStatus": "failed" if any(s["executionStatus"] == "failed" for s in stages) else "completed", "evaluationStatus": "not_run", "stages": stages, **change,
    }
    h = sha(domain, text(body))
    (root / "runs").mkdir(parents=True, exist_ok=True)
    data = text({**body, "id": "run_" + h, "manifestHash": "sha256:" + h})
    (root / f"runs/run_{h}.json").write_bytes(raw(data) if raw else data)
    return "run_" + h


def put_output(root, data):
    h = sha("other/artifact/v1", data)
    (root / "objects/sha256").mkdir(parents=True, exist_ok=True)
    (root / "objects/sha256" / h).write_bytes(data)
    return "sha256:" + h


def code(f, *a, **k):
    with pytest.raises(WorkflowError) as e:
        f(*a, **k)
    return e.value.code


def test_records_and_outputs(tmp_path):
    out = put_output(tmp_path, b'{"a":null,"b":[2,1]}')
    run = write(tmp_path, [made("source", "reused", out), made("broken", "failed", dependencyIds=["source"]), made("blocked", "skipped_dependency_failed", dependencyIds=["broken"]), made("other", "skipped_run_stopped")])
    h = History(tmp_path, DOMAINS)
    got = h.inspect(run)
    assert got["executionStatus"] == "failed" and (got["codec"], got["hashScheme"], got["fingerprintContract"]) == ("canonical-json-v1", "sha256-domain-v1", "phase0-v1")
    assert h.output(run, "source") == {"a": None, "b": [2, 1]}
    assert code(h.output, run, "broken") == "output_absent" and code(h.output, run, "none") == "stage_not_found"
    assert h.runs()["runs"][0]["finalizedAt"] == "2024-01-02T00:00:00.000Z"
    assert code(History(tmp_path).inspect, run) == "run_corrupt"  # made under other domains
    path = tmp_path / "objects/sha256" / out[7:]
    path.write_bytes(b'{"a":null,"b":[2,2]}')
    assert code(h.output, run, "source") == "output_corrupt"
    path.write_bytes(b"tidewright/artifact/v1\n")
    assert code(h.output, run, "source") == "unknown_format"
    path.unlink()
    assert code(h.output, run, "source") == "output_missing"


@pytest.mark.parametrize("stages,change,rule", [
    ([made("a"), made("a")], {}, "stage_ids"), ([made("A")], {}, "stage_ids"), ([made("a", dependencyIds=["b"]), made("b")], {}, "dependencies"), ([made("a"), made("b", dependencyIds=["a", "a"])], {}, "dependencies"),
    ([made("a", decisionReason="why")], {}, "decision"), ([made("a", "reused", decisionReason="refresh")], {}, "decision"), ([made("a", finalDecision="reuse")], {}, "decision"),
    ([made("a", "reused")], {"baselineRunId": None, "baselineManifestHash": None}, "planned"), ([made("a", evaluationStatus="run")], {}, "evaluation"), ([made("a", decisionDetails={"x": 1})], {}, "details"),
    ([made("a", decisionReason="fingerprint_changed", decisionDetails={"changedComponents": ["codec", "codec"]})], {}, "details"), ([made("a", decisionReason="dependency_executed", decisionDetails={"dependencies": []})], {}, "details"),
    ([made("a", "failed"), made("b")], {}, "skip_reason"), ([made("a", "failed"), made("b", "skipped_run_stopped", dependencyIds=["a"])], {}, "skip_reason"), ([made("a", "skipped_run_stopped")], {}, "status"),
    ([made("a", error={"name": "E", "message": "m"})], {}, "error"), ([made("a", "failed", error={"name": "E"})], {}, "error"), ([made("a", outputArtifactHash=None)], {}, "output"), ([made("a", componentHashes={"codec": H})], {}, "output"),
    ([made("a", "failed", fingerprint=H)], {}, "output"), ([made("a")], {"executionStatus": "failed"}, "status"), ([made("a")], {"completedAt": "2023-01-01T00:00:00.000Z"}, "times"), ([made("a")], {"createdAt": "2024-02-30T00:00:00.000Z"}, "times"),
    ([made("a")], {"baselineManifestHash": None}, "baseline"), ([made("a")], {"workflowId": "Not"}, "workflow"), ([made("a")], {"more": 1}, "fields"),
])
def test_rules(tmp_path, stages, change, rule):
    run = write(tmp_path, stages, **change)
    with pytest.raises(WorkflowError) as e:
        History(tmp_path, DOMAINS).inspect(run)
    assert e.value.code == "run_corrupt" and rule in e.value.context["rules"]


def test_details_that_hold(tmp_path):
    stages = [made("a", decisionReason="fingerprint_changed", decisionDetails={"changedComponents": ["codec"]}), made("b", dependencyIds=["a"], decisionReason="dependency_executed", decisionDetails={"dependencies": ["a"]})]
    stages.append(made("c", decisionReason="baseline_stage_not_reusable", decisionDetails={"baselineExecutionStatus": "failed"}))
    assert len(History(tmp_path, DOMAINS).inspect(write(tmp_path, stages))["stages"]) == 3


def test_bytes_must_be_canonical(tmp_path):
    h = History(tmp_path, DOMAINS)
    run = write(tmp_path, [made("a")], raw=lambda b: b.replace(b'{"baseline', b'{ "baseline', 1))
    assert code(h.inspect, run) == "invalid_encoding"
    other = write(tmp_path / "x", [made("a")], raw=lambda b: b.replace(b"not_run", b"not-run", 1))
    assert code(History(tmp_path / "x", DOMAINS).inspect, other) == "run_corrupt"


def test_both_formats_in_one_listing(spark, tmp_path):
    old = [write(tmp_path, [made("a")], createdAt=f"2024-01-0{d}T00:00:00.000Z", completedAt="2024-03-01T00:00:00.000Z", workflowId=w) for d, w in ((1, "flow"), (2, "flow"), (2, "else"))]
    flow = Workflow("flow", [stage("a", lambda c: 1, revision="1")], tmp_path)
    assert code(prepare, flow, tmp_path, baseline={"runId": old[0]}) == "run_corrupt"  # under the default domains
    for f in (tmp_path / "runs").iterdir():
        f.rename(tmp_path / f.name)
    new = prepare(flow, tmp_path).execute()
    for i in old:
        (tmp_path / f"{i}.json").rename(tmp_path / f"runs/{i}.json")
    h = History(tmp_path, DOMAINS)
    told = h.runs()
    assert told["totalMatched"] == 4 and told["runs"][0]["id"] == new["id"] and {r["schemaVersion"] for r in told["runs"]} == {"phase0-run-v1", "tidewright/run/v1"}
    assert h.latest("flow")["id"] == new["id"] and h.latest("else") is None
    rows = {r.id: r for r in h.summary_table(spark).collect()}
    assert set(rows) == {*old, new["id"]} and rows[old[0]].baseline_id == "run_" + "0" * 64 and rows[new["id"]].baseline_id is None
    assert [r.id for r in listing.newest(h.summary_table(spark), 1).collect()] == [new["id"]]
    assert h.run_table(spark).count() == 1 and h.earlier_table(spark).count() == 3
    (tmp_path / "runs/foreign.txt").write_text("")
    assert code(h.runs) == "unexpected_entry"
    order = [r["id"] for r in h.earlier_runs()]
    assert order == [*sorted(old[1:]), old[0]] and [r["id"] for r in h.earlier_runs("else")] == [old[2]]
    assert [r.id for r in listing.newest_earlier(spark.createDataFrame([(r["createdAt"], r["id"]) for r in h.earlier_runs()], "createdAt string, id string"), 3).collect()] == order
