"""Checks over two outputs: verdicts, their summary, and statuses by precedence."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import WorkflowError
from ..functions.codec import encode_sorted
from ..functions.identity import digest
from ..functions.pointer import MISSING, resolve
from ..plans.influences import observe_files

# Counter, verdict and contract names.
COUNTERS = (
    "total", "baseline_passed", "baseline_failed", "baseline_errors", "candidate_passed", "candidate_failed", "candidate_errors",
    "improved", "regressed", "unchanged_pass", "unchanged_fail", "incomparable",
)
#: How a suite runs; a part of its identity.
RUNNER = {"order": "sequential-check-id", "sideOrder": "baseline-first", "results": "strict-boolean", "ordinaryErrors": "continue"}
#: Contract of a selected value, by name; "optional-" in front lets it be absent.
CONTRACTS: dict[str, Callable[[Any], bool]] = {
    "required-table-v1": lambda v: isinstance(v, DataFrame),
    "required-json-v1": lambda v: not isinstance(v, DataFrame),
    "required-boolean-v1": lambda v: isinstance(v, bool),
    "required-number-v1": lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    "required-string-v1": lambda v: isinstance(v, str),
    "required-string-array-v1": lambda v: isinstance(v, list) and all(isinstance(x, str) for x in v),
}


def verdict(baseline: bool | None, candidate: bool | None) -> str:
    """None stands for an error on that side."""
    if baseline is None or candidate is None:
        return "incomparable"
    if baseline == candidate:
        return "unchanged_pass" if baseline else "unchanged_fail"
    return "regressed" if baseline else "improved"


def verdict_column(baseline: Column, candidate: Column) -> Column:
    return (
        F.when(baseline.isNull() | candidate.isNull(), "incomparable")
        .when(baseline & candidate, "unchanged_pass")
        .when(baseline, "regressed")
        .when(candidate, "improved")
        .otherwise("unchanged_fail")
    )


def compare_verdicts(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("comparison", verdict_column(F.col("baseline"), F.col("candidate")))


def summarise(compared: DataFrame, keys: list[str]) -> DataFrame:
    """The counters of all pairs, in one aggregation."""
    sides = [(s, F.col(s)) for s in ("baseline", "candidate")]
    counts = [F.count("*").alias("total")]
    for name, c in sides:
        counts += [F.count_if(c).alias(f"{name}_passed"), F.count_if(~c).alias(f"{name}_failed"), F.count_if(c.isNull()).alias(f"{name}_errors")]
    counts += [F.count_if(F.col("comparison") == v).alias(v) for v in COUNTERS[7:]]
    return compared.groupBy(*keys).agg(*counts)


def statuses(summary: DataFrame, keys: list[str]) -> DataFrame:
    """Errors outrank failures, failures outrank passes; likewise for the comparison."""
    candidate = F.when(F.col("candidate_errors") > 0, "error").when(F.col("candidate_failed") > 0, "failed").otherwise("passed")
    comparison = F.when(F.col("incomparable") > 0, "error").when(F.col("regressed") > 0, "regressed").otherwise("no_regressions")
    return summary.select(*keys, candidate.alias("candidate_status"), comparison.alias("comparison_status"))


@dataclass(frozen=True)
class Selector:
    """A value of the target output: a JSON pointer under a contract."""

    pointer: str = ""
    contract: str = "required-json-v1"

    def pick(self, output: Any) -> Any:
        name, optional = self.contract, False
        while name.startswith("optional-"):
            name, optional = name[len("optional-") :], True
        if name not in CONTRACTS:
            raise WorkflowError("invalid_contract", "select", contract=self.contract)
        value = resolve(output, self.pointer)
        if value is MISSING:
            if optional:
                return None
            raise WorkflowError("input_missing", "select", pointer=self.pointer)
        if not CONTRACTS[name](value):
            raise WorkflowError("input_type_mismatch", "select", pointer=self.pointer, contract=self.contract)
        return value


@dataclass(frozen=True)
class Check:
    """A named test of a stage's output; evaluate(selected) gives {"passed": bool, "details": object}.

    ``files`` are watched with the suite: they belong to the check's identity.  A
    DataFrame output is selected by the empty pointer under required-table-v1.
    """

    id: str
    stage: str
    select: dict[str, Selector]
    evaluate: Callable[[dict[str, Any]], dict[str, Any]]
    revision: str = "1"
    files: tuple[str, ...] = ()

    def describe(self, watched: dict[str, Any]) -> dict[str, Any]:
        return {
            "id": self.id, "stage": self.stage, "kind": "value", "revision": self.revision, "watchedFiles": [watched[f] for f in self.files],
            "select": [{"alias": k, "pointer": s.pointer, "contract": s.contract} for k, s in self.select.items()],
        }

    def pick(self, output: Any) -> dict[str, Any]:
        return {name: s.pick(output) for name, s in self.select.items()}

    def judge(self, output: Any, selected: dict[str, Any]) -> Any:
        return self.evaluate(selected)


@dataclass(frozen=True)
class TableCheck:
    """A test of a stage's DataFrame output by one aggregation.

    test() gives aggregates by name: ``passed``, a Boolean, and any details.
    """

    id: str
    stage: str
    test: Callable[[], dict[str, Column]]
    revision: str = "1"
    files: tuple[str, ...] = ()

    def describe(self, watched: dict[str, Any]) -> dict[str, Any]:
        return {"id": self.id, "stage": self.stage, "kind": "table", "revision": self.revision, "watchedFiles": [watched[f] for f in self.files], "select": []}

    def pick(self, output: Any) -> dict[str, Any]:
        if not isinstance(output, DataFrame):
            raise WorkflowError("input_type_mismatch", "select", check=self.id)
        return {}

    def judge(self, output: Any, selected: dict[str, Any]) -> Any:
        told = output.agg(*[c.alias(name) for name, c in self.test().items()])
        row = json.loads(told.select(F.to_json(F.struct(*told.columns), {"ignoreNullFields": "false"}).alias("row")).first().row)
        return {"passed": row.pop("passed", None), "details": row}


@dataclass
class Suite:
    """Checks by id; ``root`` is the folder that their watched files lie in, ``history`` the store they may not lie in."""

    id: str
    checks: list[Check | TableCheck] = field(default_factory=list)
    root: str | Path = "."
    history: Path | None = None

    def __post_init__(self):
        ids = [c.id for c in self.checks]
        if len(set(ids)) != len(ids):
            raise WorkflowError("duplicate_check", "suite", suite=self.id)
        self.checks = sorted(self.checks, key=lambda c: c.id)

    def describe(self) -> dict[str, Any]:
        """Everything the suite's identity covers, with its watched files as they are now."""
        watched = {}
        for name in sorted({f for c in self.checks for f in c.files}):
            [watched[name]] = observe_files((name,), Path(self.root).resolve(), self.history, missing_is_value=True)
        return {"id": self.id, "checks": [c.describe(watched) for c in self.checks], "runner": dict(RUNNER)}

    def fingerprint(self) -> str:
        return suite_digest(self.describe())


def suite_digest(described: dict[str, Any]) -> str:
    return digest("tidewright/suite/v2", encode_sorted(described).encode())


def check_fingerprint(suite: str, check: str, stage: str, source: str | None, selected: Any) -> str:
    """Identity of one check on one output: the suite, the output and what was selected of it (null where selection failed)."""
    body = {"suite": suite, "check": check, "stage": stage, "source": source, "selected": None if selected is None else {k: "table" if isinstance(v, DataFrame) else v for k, v in selected.items()}}
    return digest("tidewright/check/v2", encode_sorted(body).encode())


def restore_suite(described: dict[str, Any]) -> Suite:
    """A suite as a receipt describes it: selections work, its evaluators do not run."""

    def never(*_: Any) -> Any:
        raise WorkflowError("historical_evaluator", "evaluate", suite=described["id"])

    try:
        made: list[Check | TableCheck] = []
        for c in described["checks"]:
            files = tuple(f["path"] for f in c["watchedFiles"])
            if any(f.get("state") != "missing" and not str(f.get("hash", "")).startswith("sha256:") for f in c["watchedFiles"]):
                raise ValueError("watched file")
            if c["kind"] == "table":
                made.append(TableCheck(c["id"], c["stage"], never, c["revision"], files))
            else:
                made.append(Check(c["id"], c["stage"], {x["alias"]: Selector(x["pointer"], x["contract"]) for x in c["select"]}, never, c["revision"], files))
        again = {"id": described["id"], "checks": [m.describe({f["path"]: f for f in c["watchedFiles"]}) for m, c in zip(made, described["checks"])], "runner": dict(RUNNER)}
        if again != described or [m.id for m in made] != sorted({m.id for m in made}):
            raise ValueError("declaration")
    except (KeyError, TypeError, ValueError) as e:
        raise WorkflowError("receipt_corrupt", "read", part="suite") from e
    return Suite(described["id"], made)


def run_side(check: Check | TableCheck, output: Any) -> dict[str, Any]:
    """Outcome of one check on one output; errors are recorded by code alone."""
    return _run_side(check, output)[0]


def _run_side(check: Check | TableCheck, output: Any) -> tuple[dict[str, Any], Any]:
    selected = None
    try:
        selected = check.pick(output)
        got = check.judge(output, selected)
    except WorkflowError as e:
        return {"passed": None, "error": e.code, "details": None}, selected
    except Exception:  # noqa: BLE001 - a check's own text is never stored
        return {"passed": None, "error": "evaluator_threw", "details": None}, selected
    if not (isinstance(got, dict) and set(got) == {"passed", "details"} and isinstance(got["passed"], bool) and isinstance(got["details"], dict)):
        return {"passed": None, "error": "invalid_result", "details": None}, selected
    return {"passed": got["passed"], "error": None, "details": got["details"]}, selected


def summary_of(rows: list[dict[str, Any]]) -> tuple[dict[str, int], str, str]:
    """Counters of per-check rows, and the two statuses by precedence."""
    counts = dict.fromkeys(COUNTERS, 0)
    counts["total"] = len(rows)
    for r in rows:
        for side in ("baseline", "candidate"):
            p = r[side]["passed"]
            counts[f"{side}_{'errors' if p is None else 'passed' if p else 'failed'}"] += 1
        counts[r["comparison"]] += 1
    candidate = "error" if counts["candidate_errors"] else "failed" if counts["candidate_failed"] else "passed"
    return counts, candidate, "error" if counts["incomparable"] else "regressed" if counts["regressed"] else "no_regressions"


def evaluate_pair(suite: Suite, baseline: dict[str, Any], candidate: dict[str, Any], sources: dict[str, dict[str, str]] | None = None) -> dict[str, Any]:
    """All checks in order of id on both sides, baseline first; outputs by stage, ``sources`` their digests by side and stage.

    The result holds per-check rows, counters and the two statuses.  It is never
    reused.  If the suite's identity changes meanwhile, its watched files
    included, the whole is refused: between any two checks too.
    """
    described = suite.describe()
    before = suite_digest(described)
    rows = []
    for c in suite.checks:
        row: dict[str, Any] = {"check_id": c.id, "stage": c.stage}
        for side, outputs in (("baseline", baseline), ("candidate", candidate)):
            source = (sources or {}).get(side, {}).get(c.stage)
            told, selected = _run_side(c, outputs[c.stage]) if c.stage in outputs else ({"passed": None, "error": "target_unavailable", "details": None}, None)
            row[side] = {**told, "source": source, "fingerprint": check_fingerprint(before, c.id, c.stage, source, selected)}
        rows.append({**row, "comparison": verdict(row["baseline"]["passed"], row["candidate"]["passed"])})
        if suite.fingerprint() != before:
            raise WorkflowError("suite_changed", "evaluate", suite=suite.id)
    counts, candidate_status, comparison_status = summary_of(rows)
    return {"suite": before, "suiteDescriptor": described, "checks": rows, "summary": counts, "candidateStatus": candidate_status, "comparisonStatus": comparison_status}


def sides(targets: DataFrame, keys: list[str], columns: dict[str, Column]) -> DataFrame:
    """A row per target and side, in the order given: (keys, side, passed).  The sides are an array to explode, not a join."""
    both = F.array(*[F.struct(F.lit(name).alias("side"), c.alias("passed")) for name, c in columns.items()])
    return targets.select(*keys, F.explode(both).alias("s")).select(*keys, "s.side", "s.passed")


def required_if(switch: bool, records: DataFrame, rule: Column) -> DataFrame:
    """Records that keep a rule where a switch of the environment asks for it; all of them where it does not."""
    return records.where(rule) if switch else records


def lineage(candidates: DataFrame, baselines: DataFrame) -> DataFrame:
    """Candidates with the baseline they name: both its id and its record's hash must be the named ones.

    ``candidates`` has run_id, baseline_id, baseline_hash; ``baselines`` id and record_hash.
    """
    named = baselines.withColumnsRenamed({"id": "baseline_id", "record_hash": "baseline_hash"})
    return candidates.join(named, ["baseline_id", "baseline_hash"])


def exit_code(result: dict[str, Any]) -> int:
    """0 without regressions or failures, 1 for a regression, 2 for a failed candidate, 3 for errors."""
    if "error" in (result["candidateStatus"], result["comparisonStatus"]):
        return 3
    if result["comparisonStatus"] == "regressed":
        return 1
    return 2 if result["candidateStatus"] == "failed" else 0
