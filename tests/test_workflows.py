"""Graphs, reuse, failure, history and evaluation."""

import itertools
import json
import os
import shutil
import threading

import pytest

from tidewright import History, Workflow, WorkflowError, prepare, stage
from tidewright.cli import main
from tidewright.operators.checks import Check, Selector, Suite, TableCheck, evaluate_pair, exit_code, verdict
from tidewright.operators.integrity import validate_run
from tidewright.plans import eligibility
from tidewright.plans.graph import cycle_path
from tidewright.plans.influences import observe_files, table_snapshot
from tidewright.sources.store import Store


def ids(record, status):
    return [s["stageId"] for s in record["stages"] if s["status"] == status]


def code(f, *a, **k):
    with pytest.raises(WorkflowError) as e:
        f(*a, **k)
    return e.value.code


class Bench:
    """source -> middle -> leaf, and independent, with outputs that a test sets."""

    def __init__(self, root, values=None, **declared):
        self.root, self.calls, self.values = root, [], {"source": 1, "middle": 1, "leaf": 1, "independent": 1, **(values or {})}
        self.declared = declared

    def workflow(self):
        def made(name, **more):
            def run(ctx):
                self.calls.append(name)
                v = self.values[name]
                if isinstance(v, Exception):
                    raise v
                return v(ctx) if callable(v) else v

            return stage(name, run, **{"revision": "1", **more, **self.declared.get(name, {})})

        s = made("source", inputs={"n": self.values.get("n", 0)})
        m = made("middle", depends={"up": s})
        leaf = made("leaf", depends={"up": m})
        return Workflow("bench", [s, m, leaf, made("independent")], self.root)

    def run(self, baseline=None, **how):
        self.calls.clear()
        p = prepare(self.workflow(), self.root / "h", baseline=baseline, **how)
        return p, p.execute()


@pytest.fixture
def bench(tmp_path):
    return Bench(tmp_path)


def test_declaration_order_breaks_ties():
    z = stage("zed", lambda c: 1)
    child, alpha = stage("child", lambda c: 1, depends={"z": z}), stage("alpha", lambda c: 1)
    assert [s.id for s in Workflow("w", [child, z, alpha]).stages] == ["zed", "child", "alpha"]
    assert Workflow("w", [child, z, alpha]).layers() == {"zed": 0, "child": 1, "alpha": 0}


def test_validation_codes():
    a = stage("a", lambda c: 1)
    assert code(Workflow, "w", []) == "empty_workflow" and code(Workflow, "W", [a]) == "invalid_workflow_id"
    assert code(stage, "A", lambda c: 1) == "invalid_stage_id" and code(stage, "a", 3) == "invalid_callback"
    assert code(Workflow, "w", [a, stage("a", lambda c: 1)]) == "duplicate_stage"
    assert code(Workflow, "w", [stage("b", lambda c: 1, depends={"x": a})]) == "missing_dependency"
    assert code(Workflow, "w", [stage("b", lambda c: 1, env=["X", "X"])]) == "duplicate_env"
    assert code(Workflow, "w", [stage("b", lambda c: 1, watch=["x\0"])]) == "invalid_watch"
    assert code(Workflow, "w", [stage("b", lambda c: 1, inputs={"x": {1}})]) == "invalid_inputs"
    x, y = stage("x", lambda c: 1), stage("y", lambda c: 1)
    x.depends["y"], y.depends["x"] = y, x
    assert code(Workflow, "w", [x, y]) == "cycle" and cycle_path([x, y]) == ["x", "y", "x"]
    x.depends.clear()
    x.depends["me"] = x
    assert code(Workflow, "w", [x]) == "self_dependency"


# what the source gives before and after, what runs again
PROPAGATION = [
    (1, 1, None, ["source"]), (1, 2, None, ["source", "middle", "leaf"]), (1, 2, "stable", ["source", "middle"]),
    ({"a": 1, "b": 2}, {"b": 2, "a": 1}, None, ["source", "middle", "leaf"]), ([1, 2], [2, 1], None, ["source", "middle", "leaf"]),
]


@pytest.mark.parametrize("before,after,middle,runs", PROPAGATION)
def test_equal_outputs_stop_propagation(bench, before, after, middle, runs):
    bench.values |= {"source": before, "middle": middle or (lambda c: [c.outputs["up"]]), "leaf": lambda c: [c.outputs["up"]]}
    _, first = bench.run()
    assert ids(first, "succeeded") == ["source", "middle", "leaf", "independent"]
    bench.values |= {"source": after, "n": 1}
    p, second = bench.run({"runId": first["id"]})
    assert [s["decision"] for s in p.preview] == ["execute", "conditional", "conditional", "reuse"]
    assert ids(second, "succeeded") == bench.calls == runs
    assert second["stages"][0]["actual"]["reason"] == "influences_changed"
    assert second["stages"][3]["output"] == first["stages"][3]["output"]


def test_conservative_mode_runs_everything_behind(bench):
    _, first = bench.run(propagation="conservative")
    bench.values["n"] = 1
    _, second = bench.run({"runId": first["id"]}, propagation="conservative")
    assert bench.calls == ["source", "middle", "leaf"] and second["stages"][1]["actual"]["reason"] == "dependency_executed"
    assert second["stages"][3]["actual"]["reason"] == "fingerprint_match"


@pytest.mark.parametrize("scope,chosen,runs", [("selected", ["middle"], ["middle"]), ("descendants", ["middle"], ["middle", "leaf"]), ("all", [], ["source", "middle", "leaf", "independent"]), ("none", [], [])])
def test_refresh_scopes(bench, scope, chosen, runs):
    _, first = bench.run()
    _, second = bench.run("latest", refresh=scope, refresh_stages=chosen)
    assert bench.calls == runs and second["baseline"]["runId"] == first["id"]


def test_refresh_options(bench):
    bench.run()
    assert code(bench.run, None, refresh="selected") == "invalid_refresh"
    assert code(bench.run, None, refresh="selected", refresh_stages=["nope"]) == "unknown_stage"
    assert code(bench.run, {"runId": "run_" + "0" * 64}) == "run_not_found" and code(bench.run, 3) == "invalid_baseline"


@pytest.mark.parametrize("mode,independent", [("fail-fast", "stopped"), ("continue-independent", None)])
def test_failures(bench, mode, independent):
    bench.values["middle"] = ValueError("a secret")
    _, r = bench.run(failure_mode=mode)
    assert r["status"] == "failed" and ids(r, "failed") == ["middle"]
    assert r["stages"][1]["error"] == {"code": "callback_failed", "callbackInvoked": True} and "secret" not in json.dumps(r)
    assert r["stages"][2]["actual"]["reason"] == "blocked"
    last = r["stages"][3]
    assert (last["actual"]["reason"] == "stopped") if independent else last["status"] == "succeeded"
    bench.values["middle"] = 5
    _, again = bench.run("latest")  # a failed run's good stages are taken over
    assert ids(again, "reused")[:1] == ["source"] and again["status"] == "completed"


def test_invalid_and_large_outputs(bench):
    for value, want in (({1}, "invalid_output"), ("x" * (16 << 20), "output_too_large")):
        bench.values["source"] = value
        _, r = bench.run()
        assert r["stages"][0]["error"]["code"] == want


def test_always_execute_has_no_fingerprint(bench):
    bench.declared["leaf"] = {"revision": None}
    _, first = bench.run()
    assert first["stages"][2]["fingerprint"] is None
    bench.run({"runId": first["id"]})
    assert bench.calls == ["leaf"]


def test_influences(bench, monkeypatch):
    (bench.root / "w.txt").write_text("1")
    bench.declared["source"] = {"watch": ["w.txt"], "env": ["TW_X"], "revision": "1"}
    monkeypatch.delenv("TW_X", raising=False)
    _, first = bench.run()

    def changed():
        _, r = bench.run({"runId": first["id"]})
        return [c["component"] for c in r["stages"][0]["actual"]["details"].get("changedComponents", [])]

    assert changed() == []
    monkeypatch.setenv("TW_X", "")
    assert changed() == ["environment"]  # empty is not absent
    monkeypatch.delenv("TW_X")
    (bench.root / "w.txt").write_text("2")
    assert changed() == ["watchedFiles"]
    (bench.root / "w.txt").write_text("1")
    bench.declared["source"]["revision"] = "2"
    assert changed() == ["implementation"]


def test_watched_files_must_be_plain(bench):
    outside = bench.root.parent / "outside.txt"
    outside.write_text("x")
    (bench.root / "a.txt").write_text("x")
    os.link(bench.root / "a.txt", bench.root / "b.txt")
    for names, want in ((["no.txt"], "watched_file_unreadable"), (["../outside.txt"], "watched_file_outside_root"), (["."], "watched_file_not_regular"), (["a.txt", "b.txt"], "duplicate_watched_file")):
        bench.declared["source"] = {"watch": names}
        assert code(bench.run) == want


def test_file_changed_during_execution(bench):
    f = bench.root / "w.txt"
    f.write_text("1")
    bench.declared["source"] = {"watch": ["w.txt"]}
    bench.values["source"] = lambda c: f.write_text("2")
    _, r = bench.run()
    assert r["stages"][0]["error"]["code"] == "influence_changed_during_execution"


def test_callbacks_get_copies(bench):
    bench.values |= {"source": [1], "middle": lambda c: c.outputs["up"].append(2) or c.outputs["up"], "leaf": lambda c: c.outputs["up"]}
    _, r = bench.run()
    h = History(bench.root / "h")
    assert h.output(r["id"], "source") == [1] and h.output(r["id"], "leaf") == [1, 2]


def test_only_once(bench):
    p, _ = bench.run()
    assert code(p.execute) == "already_executed"


def test_selected_inputs_only(tmp_path):
    def w(inputs):
        return Workflow("w", [stage("a", lambda c: c.inputs.get("x"), inputs=inputs, selectors=["/x"], revision="1")], tmp_path)

    prepare(w({"x": 1, "y": 1}), tmp_path / "h").execute()
    assert prepare(w({"x": 1, "y": 2}), tmp_path / "h", baseline="latest").preview[0]["decision"] == "reuse"
    assert prepare(w({"x": 2}), tmp_path / "h", baseline="latest").preview[0]["decision"] == "execute"


def test_twins_of_the_cascade_agree(spark):
    rows = [dict(zip(eligibility.FACTS, v)) for v in itertools.product([False, True], repeat=len(eligibility.FACTS))]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ", ".join(f"{f} boolean" for f in eligibility.FACTS))
    for r in eligibility.decide_columns(df).collect():
        assert (r.decision, r.reason, r.causes) == eligibility.decide({f: r[f] for f in eligibility.FACTS})


# store and history


def test_history(bench, tmp_path):
    records = [bench.run("latest" if k else None)[1] for k in range(3)]
    h = History(bench.root / "h")
    listed = h.runs(limit=2)
    assert listed["totalMatched"] == 3 and listed["truncated"] and len(listed["runs"]) == 2
    order = sorted(((r["finalizedAt"], r["id"]) for r in records), reverse=True)
    assert [r["id"] for r in listed["runs"]] == [i for _, i in order[:2]]
    assert h.runs(workflow="other")["totalMatched"] == 0
    assert code(h.runs, limit=0) == "invalid_limit" and code(h.inspect, "x") == "invalid_run_id"
    assert code(h.output, records[0]["id"], "nope") == "stage_not_found"
    assert len(h.lineage(records[2]["id"])) == 3
    assert h.explain(records[1]["id"])[0]["reason"] == "reused"
    (bench.root / "h/runs/foreign").write_text("")
    assert code(h.runs, workflow="other") == "unexpected_entry"  # before the filter


def test_tampering_is_found(bench):
    _, r = bench.run()
    store = Store(bench.root / "h")
    path = store.folder("runs") / f"{r['id']}.json"
    body = json.loads(path.read_text())
    body["stages"][0]["status"] = "reused"
    path.write_text(json.dumps(body, separators=(",", ":")))
    assert code(History(store).runs) == "run_corrupt"
    assert {"identity", "decision"} <= set(validate_run(body))
    ref = r["stages"][0]["output"]
    object_ = store.folder("objects") / f"{ref['hash'][7:]}.json"
    object_.write_bytes(object_.read_bytes()[:-1] + b"7")
    assert code(store.get_value, ref) == "output_corrupt" and not store.available(ref)
    assert store.put_value(1)["hash"] == ref["hash"] and store.get_value(ref) == 1  # set aside and repaired
    assert len(list(store.folder("quarantine").iterdir())) == 1
    object_.unlink()
    assert code(store.get_value, ref) == "output_missing"


def test_lost_output_runs_again(bench):
    bench.values["independent"] = "of its own"
    _, first = bench.run()
    (bench.root / "h/objects" / f"{first['stages'][3]['output']['hash'][7:]}.json").unlink()
    _, second = bench.run("latest")
    assert "reuse_unavailable" in second["stages"][3]["actual"]["details"]["causes"]


def test_publishing_twice_and_collisions(tmp_path):
    store = Store(tmp_path)
    ref = store.put_value({"z": [2, 1], "a": None})
    target = store.folder("objects") / f"{ref['hash'][7:]}.json"
    inode = target.stat().st_ino
    store.put_value({"z": [2, 1], "a": None})
    assert target.stat().st_ino == inode and not list(store.folder("staging").iterdir())
    store.put_record({"id": "x", "v": 1})
    assert code(store.put_record, {"id": "x", "v": 2}) == "content_collision"
    assert code(store.put_record, {"id": "y", "v": "x" * (2 << 20)}) == "record_too_large"


def test_lock_and_faults(tmp_path, monkeypatch):
    monkeypatch.setattr("tidewright.sources.store.LOCK_SECONDS", 0.1)
    (tmp_path / "writer-lock").mkdir(parents=True)
    assert code(Store(tmp_path).put_value, 1) == "store_locked"
    (tmp_path / "writer-lock").rmdir()

    def fault():
        raise OSError("disk")

    with pytest.raises(WorkflowError) as e:
        Store(tmp_path, {"staged": fault}).put_value(1)
    assert e.value.context["status"] == "not_published"
    with pytest.raises(WorkflowError) as e:
        Store(tmp_path, {"linked": fault}).put_value(1)
    assert e.value.context["status"] == "uncertain" and not (tmp_path / "writer-lock").exists()


def test_many_writers(tmp_path):
    store, refs = Store(tmp_path), []
    jobs = [threading.Thread(target=lambda k=k: refs.append(store.put_value(k % 3))) for k in range(12)]
    [j.start() for j in jobs]
    [j.join() for j in jobs]
    assert len(refs) == 12 and len(list(store.folder("objects").iterdir())) == 3


def test_table_snapshot_sees_content(tmp_path):
    (tmp_path / "t").mkdir()
    (tmp_path / "t/a.parquet").write_bytes(b"1")
    (tmp_path / "t/_SUCCESS").write_bytes(b"")
    one = table_snapshot(tmp_path / "t")
    (tmp_path / "t/a.parquet").write_bytes(b"2")
    assert len(one) == 1 and table_snapshot(tmp_path / "t") != one


# DataFrames


def test_dataframe_stages(spark, tmp_path):
    from pyspark.sql import functions as F

    def w(keep):
        a = stage("a", lambda c: spark.range(100).where(F.col("id") < c.inputs["keep"]), inputs={"keep": keep}, revision="1")
        b = stage("b", lambda c: c.outputs["a"].groupBy((F.col("id") % 3).alias("k")).agg(F.lit(1).alias("one")), depends={"a": a}, revision="1")
        return Workflow("frames", [a, b, stage("c", lambda c: c.outputs["b"].count(), depends={"b": b}, revision="1")], tmp_path)

    h = History(tmp_path / "h")
    first = prepare(w(50), tmp_path / "h", spark).execute()
    second = prepare(w(60), tmp_path / "h", spark, baseline="latest").execute()
    assert [s["status"] for s in second["stages"]] == ["succeeded", "succeeded", "reused"]  # b comes out equal
    assert h.output(second["id"], "a", spark).count() == 60
    assert h.compare(first["id"], second["id"], "b", spark) == {"equal": True, "difference": None}
    assert h.compare(first["id"], second["id"], "a", spark)["difference"]["reason"] == "row"
    kinds = {r.stage_id: (r.kind, r.changed_fields) for r in h.diff(spark, first["id"], second["id"]).collect()}
    assert kinds["c"][0] == "changed" and "output_hash" not in kinds["c"][1] and "output_hash" in kinds["a"][1]
    assert h.stage_table(spark).count() == 6 and h.run_table(spark).count() == 2
    from tidewright.operators.integrity import stage_violations

    assert stage_violations(h.stage_table(spark)).count() == 0
    part = next((tmp_path / "h/objects" / second["stages"][0]["output"]["hash"][7:]).glob("*.parquet"))
    part.unlink()
    assert code(h.output, second["id"], "a", spark) == "output_corrupt"


def test_failing_dataframe_is_a_stage_failure(spark, tmp_path):
    bad = stage("a", lambda c: spark.sql("select 1 / raise_error('no') as x"))
    r = prepare(Workflow("w", [bad], tmp_path), tmp_path / "h", spark).execute()
    assert r["stages"][0]["error"] == {"code": "callback_failed", "callbackInvoked": True}


# evaluation


@pytest.mark.parametrize("b,c,want", [(True, True, "unchanged_pass"), (True, False, "regressed"), (False, True, "improved"), (False, False, "unchanged_fail"), (None, True, "incomparable"), (False, None, "incomparable"), (None, None, "incomparable")])
def test_verdicts(b, c, want):
    assert verdict(b, c) == want


def test_evaluation(bench):
    bench.values["leaf"] = {"items": [1, 2, 3]}
    _, first = bench.run()
    bench.values |= {"leaf": {"items": [1]}, "n": 1, "source": 2, "middle": 2}
    _, second = bench.run({"runId": first["id"]})
    enough = Check("enough", "leaf", {"items": Selector("/items")}, lambda s: {"passed": len(s["items"]) >= 2, "details": {}})
    typed = Check("typed", "leaf", {"items": Selector("/items", "required-string-array-v1")}, lambda s: {"passed": True, "details": {}})
    truthy = Check("truthy", "leaf", {}, lambda s: {"passed": 1, "details": {}})
    h = History(bench.root / "h")
    got = h.evaluate(Suite("s", [enough]), second["id"])
    assert got["comparisonStatus"] == "regressed" and got["candidateStatus"] == "failed" and exit_code(got) == 1
    assert h.receipt(got["id"]) == got
    both = h.evaluate(Suite("s", [typed, enough, truthy]), second["id"])
    assert [c["check_id"] for c in both["checks"]] == ["enough", "truthy", "typed"] and exit_code(both) == 3
    assert {c["check_id"]: c["candidate"]["error"] for c in both["checks"]} == {"enough": None, "truthy": "invalid_result", "typed": "input_type_mismatch"}
    assert code(h.evaluate, Suite("s", [enough]), first["id"]) == "baseline_required"
    assert code(Suite, "s", [enough, enough]) == "duplicate_check"
    path = bench.root / "h/receipts" / f"{got['id']}.json"
    path.write_text(path.read_text().replace('"regressed":1', '"regressed":0'))
    assert code(h.receipt, got["id"]) == "receipt_corrupt"
    assert evaluate_pair(Suite("s", [enough]), {}, {})["checks"][0]["baseline"]["error"] == "target_unavailable"


def test_command_line(bench, capsys):
    _, first = bench.run()
    bench.values |= {"source": 9, "n": 1}
    _, second = bench.run("latest")
    h = ["--history", str(bench.root / "h")]
    assert main([*h, "runs", "--limit", "1"]) == 0 and json.loads(capsys.readouterr().out)["totalMatched"] == 2
    assert main([*h, "output", second["id"], "source"]) == 0 and capsys.readouterr().out == "9\n"
    assert main([*h, "compare", first["id"], second["id"], "source"]) == 1
    assert main([*h, "compare", first["id"], second["id"], "leaf"]) == 0
    assert main([*h, "inspect", "run_" + "0" * 64]) == 2


def test_more_validation_codes(tmp_path):
    assert code(Workflow, "w", [stage("a", lambda c: 1, revision=" ")]) == "empty_implementation"
    assert code(Workflow, "w", [stage("a", lambda c: 1, revision="1", selectors=("/x", "/x"))]) == "duplicate_input"
    assert code(Workflow, "w", [stage("a", lambda c: 1, revision="1", selectors=("x",))]) == "invalid_input_pointer"
    for contracts in ({"/x": " "}, {"/x": "required-json-v1", "/y": "required-json-v1"}):
        assert code(Workflow, "w", [stage("a", lambda c: 1, revision="1", selectors=("/x",), contracts=contracts)]) == "invalid_input_contract"
    assert code(Workflow, "w", [stage("a", lambda c: 1, revision="1", volatile=True)]) == "invalid_cache_policy"
    assert code(lambda: Workflow("w", [stage("a", lambda c: 1, revision="1")], require_watch=True)) == "missing_watch"
    Workflow("w", [stage("a", lambda c: 1)], require_watch=True)
    made = Workflow("w", [stage("a", lambda c: 1)])
    assert code(made.add, stage("b", lambda c: 1)) == "sealed_workflow"
    x = stage("x", lambda c: 1)
    y = stage("y", lambda c: 1, depends={"x": x}, env=("A=", "A="))
    x.depends["y"] = y
    with pytest.raises(WorkflowError) as e:
        Workflow("w", [stage("ok", lambda c: 1), x, y])
    assert {c for c, _ in e.value.context["issues"]} == {"duplicate_env", "invalid_env", "cycle"}


def test_volatile_stages_and_contracts(tmp_path):
    w = lambda kind: Workflow("w", [stage("a", lambda c: c.inputs["x"], inputs={"x": 1}, selectors={"/x": kind}, revision="1"), stage("b", lambda c: 1, volatile=True)], tmp_path)
    prepare(w("required-json-v1"), tmp_path / "h").execute()
    again = prepare(w("required-json-v1"), tmp_path / "h", baseline="latest", propagation="conservative")
    assert [s["reason"] for s in again.preview] == ["fingerprint_match", "volatile_stage"]
    other = prepare(w("required-number-v1"), tmp_path / "h", baseline="latest")
    assert [s["reason"] for s in other.preview] == ["influences_changed", "reuse_not_enabled"]


def test_stages_are_not_kept_alive():
    import gc
    import weakref

    seen = weakref.ref(stage("gone", lambda c: 1))
    gc.collect()
    assert seen() is None


def damage(root, ref):
    """Other bytes of the same length and name, without the checksum file beside."""
    for part in (root / "objects" / ref["hash"][7:]).glob("part-*.parquet"):
        data = bytearray(part.read_bytes())
        data[4:24] = bytes(b ^ 0xFF for b in data[4:24])
        part.write_bytes(bytes(data))
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)


@pytest.mark.parametrize("small", [1 << 20, 0])
def test_damaged_table_is_not_taken_over(spark, tmp_path, monkeypatch, small):
    """A flipped byte of equal length runs the stage again, sets the damage aside and repairs the object."""
    monkeypatch.setattr("tidewright.sources.store.SMALL_TABLE", small)
    calls = []

    def w():
        def run(c):
            calls.append("a")
            return spark.range(1000).selectExpr("id", "id * 7 % 13 as k")

        a = stage("a", run, revision="1")
        return Workflow("frames", [a, stage("b", lambda c: c.outputs["a"].where("k = 1"), depends={"a": a}, revision="1")], tmp_path)

    first = prepare(w(), tmp_path / "h", spark).execute()
    again = prepare(w(), tmp_path / "h", spark, baseline="latest").execute()
    assert [s["status"] for s in again["stages"]] == ["reused", "reused"] and calls == ["a"]
    ref = first["stages"][0]["output"]
    damage(tmp_path / "h", ref)
    assert not Store(tmp_path / "h").available(ref, spark)
    plan = prepare(w(), tmp_path / "h", spark, baseline="latest")
    assert [(s["decision"], s["reason"]) for s in plan.preview][0] == ("execute", "reuse_unavailable")
    third = plan.execute()
    assert [(s["status"], s["actual"]["reason"]) for s in third["stages"]] == [("succeeded", "reuse_unavailable"), ("reused", "reused")]
    assert len(list((tmp_path / "h/quarantine").iterdir())) == 1
    assert History(tmp_path / "h").output(third["id"], "a", spark).count() == 1000
    # damage between the preview and the run is seen as well
    plan = prepare(w(), tmp_path / "h", spark, baseline="latest")
    assert plan.preview[0]["decision"] == "reuse"
    damage(tmp_path / "h", ref)
    assert plan.execute()["stages"][0]["actual"]["reason"] == "reuse_unavailable"
    # without a session only files can be verified
    assert prepare(w(), tmp_path / "h", baseline="latest").preview[0]["reason"] == ("reused" if small else "reuse_unavailable")


def test_table_outputs_are_bounded(spark, tmp_path):
    w = Workflow("w", [stage("a", lambda c: spark.range(100))], tmp_path)
    for limit in ({"table_rows": 99}, {"table_bytes": 10}):
        r = prepare(w, tmp_path / "h", spark, **limit).execute()
        assert r["stages"][0]["error"] == {"code": "output_too_large", "callbackInvoked": True}
    assert not list((tmp_path / "h/staging").iterdir()) and not (tmp_path / "h/objects").exists()
    assert prepare(w, tmp_path / "h", spark, table_rows=100).execute()["status"] == "completed"


def two_runs(spark, tmp_path):
    from pyspark.sql import functions as F

    def w(keep):
        a = stage("a", lambda c: spark.range(c.inputs["keep"]).withColumn("v", F.col("id") % 5), inputs={"keep": keep}, revision="1")
        return Workflow("frames", [a, stage("n", lambda c: {"rows": c.outputs["a"].count()}, depends={"a": a}, revision="1")], tmp_path)

    first = prepare(w(150), tmp_path / "h", spark).execute()
    return first, prepare(w(3), tmp_path / "h", spark, baseline="latest").execute()


def test_evaluation_of_tables(spark, tmp_path):
    from pyspark.sql import functions as F

    _, second = two_runs(spark, tmp_path)
    suite = Suite("s", [
        TableCheck("enough", "a", lambda: {"passed": F.count("*") >= 10, "rows": F.count("*"), "mean": F.avg("v")}),
        TableCheck("nothing", "a", lambda: {"rows": F.count("*")}),
        TableCheck("fails", "a", lambda: {"passed": F.col("no_such") > 1}),
        TableCheck("wrong-kind", "n", lambda: {"passed": F.lit(True)}),
        Check("whole", "a", {"t": Selector("", "required-table-v1")}, lambda s: {"passed": s["t"].columns == ["id", "v"], "details": {}}),
        Check("as-json", "a", {"t": Selector("")}, lambda s: {"passed": True, "details": {}}),
        Check("value", "n", {"rows": Selector("/rows", "required-number-v1")}, lambda s: {"passed": s["rows"] >= 3, "details": {}}),
    ])
    h = History(tmp_path / "h")
    assert code(h.evaluate, suite, second["id"]) == "session_required"
    got = h.evaluate(suite, second["id"], spark=spark)
    told = {c["check_id"]: c for c in got["checks"]}
    assert told["enough"]["comparison"] == "regressed" and told["enough"]["baseline"]["details"] == {"rows": 150, "mean": 2}
    assert {k: c["candidate"]["error"] for k, c in told.items()} == {"enough": None, "nothing": "invalid_result", "fails": "evaluator_threw", "wrong-kind": "input_type_mismatch", "whole": None, "as-json": "input_type_mismatch", "value": None}
    assert told["whole"]["comparison"] == told["value"]["comparison"] == "unchanged_pass"
    assert h.receipt(got["id"], spark) == h.receipt(got["id"]) == got
    assert h.receipt_preview(got["id"], spark) == got
    damage(tmp_path / "h", second["stages"][0]["output"])
    assert code(h.receipt, got["id"], spark) == "output_corrupt"


def test_watched_files_belong_to_the_suite(bench):
    _, _ = bench.run()
    bench.values |= {"leaf": 2, "source": 2, "middle": 2, "n": 1}
    _, second = bench.run("latest")
    rules = bench.root / "rules.txt"

    def suite(evaluate):
        return Suite("s", [Check("a", "leaf", {"v": Selector()}, evaluate, files=("rules.txt", "gone.txt")), Check("b", "leaf", {"v": Selector()}, evaluate)], root=bench.root)

    rules.write_text("1")
    plain = suite(lambda s: {"passed": True, "details": {}})
    before = plain.fingerprint()
    rules.write_text("2")
    assert plain.fingerprint() != before
    assert plain.describe()["checks"][0]["watchedFiles"][1] == {"path": "gone.txt", "state": "missing"}
    h = History(bench.root / "h")
    got = h.evaluate(plain, second["id"])
    assert h.receipt(got["id"]) == got

    def meddle(s):
        rules.write_text(rules.read_text() + "x")
        return {"passed": True, "details": {}}

    assert code(h.evaluate, suite(meddle), second["id"]) == "suite_changed"
    (bench.root / "h/inside.txt").write_text("")
    assert code(h.evaluate, Suite("s", [Check("a", "leaf", {}, meddle, files=("h/inside.txt",))], root=bench.root), second["id"]) == "watched_file_in_history"


def test_receipts_are_verified_against_their_sources(bench):
    from tidewright.functions.codec import encode_ordered
    from tidewright.operators.checks import restore_suite

    _, first = bench.run()
    bench.values |= {"leaf": 2, "source": 2, "middle": 2, "n": 1}
    _, second = bench.run("latest")
    h = History(bench.root / "h")
    suite = Suite("s", [Check("a", "leaf", {"v": Selector("", "required-number-v1")}, lambda s: {"passed": s["v"] > 1, "details": {}})])
    got = h.evaluate(suite, second["id"])
    restored = restore_suite(got["suiteDescriptor"])
    assert [c.id for c in restored.checks] == ["a"] and code(restored.checks[0].evaluate, {}) == "historical_evaluator"
    body = {k: v for k, v in got.items() if k != "id"}

    def tampered(change):
        made = json.loads(json.dumps(body))
        change(made)
        return h.store.put_receipt(made)["id"]

    def flip(b):
        b["checks"][0]["candidate"]["passed"] = False

    for change, part in (
        (lambda b: b["suiteDescriptor"].update(id="other"), "suite"), (lambda b: b["suiteDescriptor"]["checks"][0].update(kind="odd", select=None), "suite"), (flip, "comparison"), (lambda b: b["summary"].update(total=9), "summary"),
        (lambda b: b.update(candidateRecordHash=first["recordHash"]), "runs"), (lambda b: b["checks"][0]["baseline"].update(source="sha256:" + "0" * 64), "source"), (lambda b: b["checks"][0]["candidate"].update(fingerprint="sha256:0"), "fingerprint"),
    ):
        with pytest.raises(WorkflowError) as e:
            h.receipt(tampered(change))
        assert (e.value.code, e.value.context["part"]) == ("receipt_corrupt", part)
    assert encode_ordered(h.receipt(got["id"])) == encode_ordered(got)


def test_previews_and_output_tell_the_whole_table(spark, tmp_path, capsys):
    first, second = two_runs(spark, tmp_path)
    h = History(tmp_path / "h")
    cut, whole = h.preview(first["id"], "a", spark), h.preview(second["id"], "a", spark)
    assert cut["truncated"] and len(cut["text"].splitlines()) == 100
    assert not whole["truncated"] and len(whole["text"].splitlines()) == 3
    big = Workflow("w", [stage("a", lambda c: spark.range(2500))], tmp_path)
    run = prepare(big, tmp_path / "h", spark).execute()
    capsys.readouterr()
    assert main(["--history", str(tmp_path / "h"), "output", run["id"], "a"]) == 0
    assert sorted(json.loads(x)["id"] for x in capsys.readouterr().out.splitlines()) == list(range(2500))


def test_missing_watched_file_as_a_value(tmp_path):
    (tmp_path / "r/sub").mkdir(parents=True)
    (tmp_path / "r/a.txt").write_text("1")
    seen = observe_files(("a.txt", "sub/b.txt"), tmp_path / "r", None, missing_is_value=True)
    assert [f.get("state") for f in seen] == [None, "missing"]
    assert code(observe_files, ("sub/b.txt",), tmp_path / "r", None) == "watched_file_unreadable"
    assert code(observe_files, ("../b.txt",), tmp_path / "r", None, missing_is_value=True) == "watched_file_outside_root"


def test_tables_may_lie_in_any_spark_folder(spark, tmp_path):
    """Nothing is renamed where the rows lie; a note in the mounted folder publishes them."""
    from tidewright.sources.far import FarStore

    def w(keep):
        a = stage("a", lambda c: spark.range(c.inputs["keep"]), inputs={"keep": keep}, revision="1")
        return Workflow("frames", [a, stage("n", lambda c: c.outputs["a"].count(), depends={"a": a}, revision="1")], tmp_path)

    far = tmp_path / "far"
    made = lambda: FarStore(tmp_path / "h", f"file://{far}")
    first = prepare(w(50), made(), spark).execute()
    second = prepare(w(50), made(), spark, baseline="latest").execute()
    assert [s["status"] for s in second["stages"]] == ["reused", "reused"]
    assert History(made()).output(second["id"], "a", spark).count() == 50
    prepare(w(50), made(), spark).execute()  # the same rows again: the staged folder goes, the first stays
    assert len(list(far.iterdir())) == 1 and not (tmp_path / "h/objects" / first["stages"][0]["output"]["hash"][7:]).exists()
    assert History(made()).compare(first["id"], second["id"], "a", spark)["equal"]
    for part in far.rglob("part-*.parquet"):
        data = bytearray(part.read_bytes())
        data[4:20] = bytes(b ^ 0xFF for b in data[4:20])
        part.write_bytes(bytes(data))
    for crc in far.rglob(".*.crc"):
        crc.unlink()
    third = prepare(w(50), made(), spark, baseline="latest").execute()
    assert [(s["status"], s["actual"]["reason"]) for s in third["stages"]] == [("succeeded", "reuse_unavailable"), ("reused", "reused")]
    assert len(list((tmp_path / "h/quarantine").iterdir())) == 1 and History(made()).output(third["id"], "a", spark).count() == 50
    bounded = prepare(Workflow("w", [stage("a", lambda c: spark.range(100))], tmp_path), made(), spark, table_rows=9).execute()
    assert bounded["status"] == "failed" and len(list(far.iterdir())) == 2
    assert prepare(w(50), made(), baseline="latest").preview[0]["reason"] == "reuse_unavailable"
    (next(far.iterdir())).rename(tmp_path / "elsewhere")
    shutil.rmtree(far)
    assert code(History(made()).output, third["id"], "a", spark) == "output_corrupt"
