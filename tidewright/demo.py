"""The flagship query: incremental execution over orders and customers, told as rows."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import prepare
from .history import History
from .operators import checks
from .plans.graph import Workflow, stage
from .sources.shared import shared_folder


def order_workflow(sf_dir: str, priority: str) -> Workflow:
    """Three stages; ``priority`` is an input of the last one alone."""
    load = stage("load", lambda c: c.spark.read.parquet(f"{c.inputs['dir']}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderpriority", F.col("o_totalprice").cast("decimal(18,2)").alias("price")), inputs={"dir": sf_dir}, revision="1")
    totals = stage("totals", lambda c: c.outputs["orders"].groupBy("o_custkey").agg(F.sum("price").alias("spent"), F.count("*").alias("orders")), depends={"orders": load}, revision="1")
    urgent = stage("urgent", lambda c: c.outputs["orders"].where(F.col("o_orderpriority").startswith(c.inputs["priority"])).join(c.outputs["totals"], "o_custkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.sum("spent").alias("spent")), depends={"orders": load, "totals": totals}, inputs={"priority": priority}, revision="1")
    return Workflow("order-report", [load, totals, urgent])


def history_folder(spark: SparkSession) -> str:
    """A new folder for a history below the shared folder, which must be a mounted path."""
    shared = shared_folder(spark)
    if "://" in shared and not shared.startswith("file://"):
        raise ValueError("a workflow history needs a shared folder that is a mounted path")
    base = shared.removeprefix("file://").removeprefix("file:")
    os.makedirs(base, exist_ok=True)
    return tempfile.mkdtemp(prefix="tidewright-history-", dir=base)


def run_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fresh, then with another priority: two stages are reused and one executes."""
    root = history_folder(spark)
    first = prepare(order_workflow(sf_dir, "1"), root, spark).execute()
    prepare(order_workflow(sf_dir, "2"), root, spark, baseline={"runId": first["id"]}).execute()
    s = History(root).stage_table(spark)
    return s.select(F.when(F.col("run_id") == first["id"], "fresh").otherwise("changed").alias("run"), "position", "stage_id", "decision", "reason", "status", "output_hash")


def repaired_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run, damage to one stored table, and a run after it: (stage_id, status, reason, rows).

    The damaged output is not taken over; its stage runs again, and since the
    output comes out equal, the stages behind it are reused.
    """
    root = history_folder(spark)
    first = prepare(order_workflow(sf_dir, "1"), root, spark).execute()
    damaged = next(s["output"]["hash"] for s in first["stages"] if s["stageId"] == "totals")
    for part in sorted((Path(root) / "objects" / damaged[7:]).rglob("part-*.parquet")):
        data = bytearray(part.read_bytes())
        middle = slice(8, max(9, len(data) // 2))
        data[middle] = bytes(b ^ 0x55 for b in data[middle])
        part.write_bytes(bytes(data))
        (part.parent / f".{part.name}.crc").unlink(missing_ok=True)
    second = prepare(order_workflow(sf_dir, "1"), root, spark, baseline={"runId": first["id"]}).execute()
    rows = [(s["stageId"], s["status"], s["actual"]["reason"], s["output"]["rows"]) for s in second["stages"]]
    return spark.createDataFrame(rows, "stage_id string, status string, reason string, rows long")


def evaluated_demo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A receipt over table outputs: (check_id, baseline, candidate, comparison, details) of a run with dearer orders only."""

    def workflow(least: int) -> Workflow:
        load = stage("load", lambda c: c.spark.read.parquet(f"{c.inputs['dir']}/orders.parquet").where(F.col("o_totalprice") >= c.inputs["least"]).select("o_orderkey", "o_custkey", "o_orderstatus"), inputs={"dir": sf_dir, "least": least}, revision="1")
        counts = stage("counts", lambda c: c.outputs["orders"].groupBy("o_custkey").agg(F.count("*").alias("orders"), F.count_if(F.col("o_orderstatus") == "F").alias("done")), depends={"orders": load}, revision="1")
        return Workflow("dear-orders", [load, counts])

    suite = checks.Suite("order-checks", [
        checks.TableCheck("customers", "counts", lambda: {"passed": F.count("*") >= 10, "rows": F.count("*")}),
        checks.TableCheck("few-orders", "counts", lambda: {"passed": F.max("orders") <= 20, "most": F.max("orders")}),
        checks.TableCheck("all-done", "counts", lambda: {"passed": F.bool_and(F.col("done") == F.col("orders")), "open": F.sum(F.col("orders") - F.col("done"))}),
        checks.TableCheck("unique-orders", "load", lambda: {"passed": F.count("*") == F.count_distinct("o_orderkey"), "rows": F.count("*")}),
        checks.Check("one-column", "load", {"t": checks.Selector("", "required-table-v1")}, lambda s: {"passed": s["t"].columns == ["o_orderkey"], "details": {"columns": len(s["t"].columns)}}),
    ])
    root = history_folder(spark)
    first = prepare(workflow(0), root, spark).execute()
    second = prepare(workflow(400_000), root, spark, baseline={"runId": first["id"]}).execute()
    told = History(root)
    made = told.evaluate(suite, second["id"], spark=spark)
    rows = []
    for c in told.receipt(made["id"], spark)["checks"]:
        numbers = [next(iter(c[side]["details"].values())) for side in ("baseline", "candidate")]
        rows.append((c["check_id"], c["baseline"]["passed"], c["candidate"]["passed"], c["comparison"], *numbers))
    return spark.createDataFrame(rows, "check_id string, baseline boolean, candidate boolean, comparison string, baseline_number long, candidate_number long")
