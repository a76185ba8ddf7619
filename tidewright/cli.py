"""Command line: runs, inspect, output, compare, diff, plan, run, evaluate, receipt."""

from __future__ import annotations

import argparse
import importlib
import json
import sys
from typing import Any

from pyspark.sql import functions as F

from .engine import prepare
from .errors import WorkflowError
from .history import History
from .operators.checks import exit_code


def _load(name: str) -> Any:
    module, _, attribute = name.partition(":")
    try:
        return getattr(importlib.import_module(module), attribute)
    except (ImportError, AttributeError) as e:
        raise WorkflowError("not_loadable", "load", name=name) from e


def _spark():
    from pyspark.sql import SparkSession

    return SparkSession.builder.appName("tidewright").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def main(argv: list[str] | None = None, out=None) -> int:
    """compare exits 0 when equal, 1 when not; evaluate 0, 1, 2 or 3; errors exit 2."""
    p = argparse.ArgumentParser(prog="tidewright")
    p.add_argument("--history", required=True)
    sub = p.add_subparsers(dest="verb", required=True)
    runs = sub.add_parser("runs")
    runs.add_argument("--workflow")
    runs.add_argument("--limit", type=int, default=20)
    for verb, names in (("inspect", ["run"]), ("explain", ["run"]), ("output", ["run", "stage"]), ("compare", ["left", "right", "stage"]), ("diff", ["left", "right"]), ("receipt", ["id"]), ("evaluate", ["suite", "candidate"])):
        q = sub.add_parser(verb)
        for n in names:
            q.add_argument(n)
    for verb in ("plan", "run"):
        q = sub.add_parser(verb)
        q.add_argument("workflow", help="module:attribute")
        q.add_argument("--baseline", default=None, help="latest or a run id")
        q.add_argument("--refresh", default="none")
        q.add_argument("--stage", action="append", default=[])
        q.add_argument("--failure-mode", default="fail-fast")
        q.add_argument("--propagation", default="output")
    a = p.parse_args(argv)
    out = out or sys.stdout
    say = lambda v: print(json.dumps(v, indent=2, ensure_ascii=False), file=out)
    h = History(a.history)
    try:
        if a.verb == "runs":
            say(h.runs(a.workflow, a.limit))
        elif a.verb == "inspect":
            say(h.inspect(a.run))
        elif a.verb == "explain":
            say(h.explain(a.run))
        elif a.verb == "output":
            if h._reference(a.run, a.stage)["kind"] == "json":
                say(h.output(a.run, a.stage))
            else:  # all rows, a JSON object a line; the driver holds one partition at a time
                for row in h.output(a.run, a.stage, _spark()).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("row")).toLocalIterator():
                    print(row.row, file=out)
        elif a.verb == "compare":
            tables = any(h._reference(r, a.stage)["kind"] == "table" for r in (a.left, a.right))
            got = h.compare(a.left, a.right, a.stage, _spark() if tables else None)
            say(got)
            return 0 if got["equal"] else 1
        elif a.verb == "diff":
            say([r.asDict(True) for r in h.diff(_spark(), a.left, a.right).collect()])
        elif a.verb == "receipt":
            say(h.receipt(a.id, _spark() if any(s["output"] and s["output"]["kind"] == "table" for r in h.receipt_runs(a.id) for s in r["stages"]) else None))
        elif a.verb == "evaluate":
            tables = any(s["output"] and s["output"]["kind"] == "table" for s in h.inspect(a.candidate)["stages"])
            got = h.evaluate(_load(a.suite), a.candidate, spark=_spark() if tables else None)
            say(got)
            return exit_code(got)
        else:
            base = a.baseline if a.baseline in (None, "latest") else {"runId": a.baseline}
            made = prepare(_load(a.workflow), a.history, _spark(), baseline=base, refresh=a.refresh, refresh_stages=a.stage, failure_mode=a.failure_mode, propagation=a.propagation)
            if a.verb == "plan":
                counts = {d: sum(1 for s in made.preview if s["decision"] == d) for d in ("execute", "reuse", "conditional")}
                say({"stages": made.preview, "summary": counts})
            else:
                record = made.execute()
                say(record)
                return 0 if record["status"] == "completed" else 1
    except WorkflowError as e:
        print(json.dumps({"code": e.code, "operation": e.operation, "context": {k: str(v) for k, v in e.context.items()}}), file=sys.stderr)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
