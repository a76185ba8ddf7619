"""JSON inputs: one strict object file, folders of records, capture journals, an in-memory store."""

from __future__ import annotations

import hashlib
import json
import re
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WorkflowError
from ..functions.codec import SAFE, encode_ordered
from ..functions.identity import digest

INPUT_BYTES = 16 << 20
#: Names of a package's events.
PACKAGE_EVENT = re.compile(r"events/[0-9]{6}\.json")


def read_input_object(path: str | Path) -> dict[str, Any]:
    """A JSON object from a UTF-8 file without a mark; duplicate keys are refused."""

    def pairs(items: list[tuple[str, Any]]) -> dict[str, Any]:
        if len(dict(items)) != len(items):
            raise WorkflowError("invalid_input", "input", "duplicate key", path=str(path))
        return dict(items)

    try:
        data = Path(path).read_bytes()
        if len(data) > INPUT_BYTES:
            raise WorkflowError("size_limit", "input", path=str(path), limit=INPUT_BYTES)
        got = json.loads(data.decode("utf-8"), object_pairs_hook=pairs)
    except (OSError, UnicodeDecodeError, json.JSONDecodeError) as e:
        raise WorkflowError("invalid_input", "input", path=str(path)) from e
    if not isinstance(got, dict):
        raise WorkflowError("invalid_input", "input", "not an object", path=str(path))
    encode_ordered(got)
    return got


def ingest_records(spark: SparkSession, folder: str, schema: str | T.StructType, rule: Column | None = None, skip: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One JSON record a file: (accepted, rejected), both with the file's name.

    A file is rejected if it is no JSON object of the schema or breaks ``rule``;
    names in ``skip`` are left out.  Nothing is collected, and order is by name
    where the caller sorts.
    """
    ddl = schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)
    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder)
    named = raw.select(F.element_at(F.split("path", "/"), -1).alias("filename"), F.decode("content", "UTF-8").alias("raw"))
    if skip:
        named = named.where(~F.col("filename").isin(*skip))
    wide = T.StructType([*ddl.fields, T.StructField("_corrupt", T.StringType())])
    parsed = named.withColumn("r", F.from_json("raw", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    parsed = parsed.select("filename", "raw", "r.*")
    holds = F.col("_corrupt").isNull() & F.trim("raw").startswith("{")
    if rule is not None:
        holds = holds & F.coalesce(rule, F.lit(False))
    judged = parsed.withColumn("_ok", F.coalesce(holds, F.lit(False)))
    return judged.where("_ok").drop("raw", "_corrupt", "_ok"), judged.where("not _ok").select("filename", "raw")


def over_limits(journal: DataFrame, limits: dict[str, int]) -> DataFrame:
    """Kinds of a capture journal with more attempts than allowed; kinds without a limit allow none."""
    allowed = F.create_map(*[F.lit(x) for kv in limits.items() for x in kv]) if limits else F.lit(None).cast("map<string,int>")
    counted = journal.groupBy("kind").agg(F.count("*").alias("attempts")).withColumn("allowed", F.coalesce(F.try_element_at(allowed, F.col("kind")), F.lit(0)).cast("long"))
    return counted.where("attempts > allowed")


def require_digests(expected: dict[str, str], root: str | Path) -> None:
    """Every named file still has the recorded sha256; a stale one is an error."""
    for name, want in expected.items():
        try:
            got = "sha256:" + hashlib.sha256((Path(root) / name).read_bytes()).hexdigest()
        except OSError as e:
            raise WorkflowError("stale_input", "input", path=name) from e
        if got != want:
            raise WorkflowError("stale_input", "input", path=name)


def journal_exposure(events: list[dict[str, Any]]) -> int:
    """What a journal's attempts cost at most: the charge where one is settled, else what it reserved.

    Every attempt is reserved once and settled at most once, after its reservation.
    """
    reserved: dict[Any, int] = {}
    charged: dict[Any, int] = {}

    def amount(e: dict[str, Any], name: str) -> int:
        x = e.get(name)
        if not isinstance(x, int) or isinstance(x, bool) or not 0 <= x <= SAFE:
            raise WorkflowError("package_corrupt", "input", part=name)
        return x

    for e in events:
        at = e.get("attemptId")
        if e.get("type") == "reserved":
            if at in reserved:
                raise WorkflowError("package_corrupt", "input", part="reservation")
            reserved[at] = amount(e, "reservationNanoUsd")
        elif e.get("type") == "settled":
            if at not in reserved or at in charged:
                raise WorkflowError("package_corrupt", "input", part="settlement")
            charged[at] = amount(e, "chargedNanoUsd")
    total = sum(charged.get(at, held) for at, held in reserved.items())
    if total > SAFE:
        raise WorkflowError("package_corrupt", "input", part="exposure")
    return total


def journal_exposures(events: DataFrame, keys: list[str]) -> DataFrame:
    """The same over a table of journals (keys, attemptId, type, amount): exposure, and how many attempts break the rules."""
    one = events.groupBy(*keys, "attemptId").agg(
        F.count_if(F.col("type") == "reserved").alias("r"), F.count_if(F.col("type") == "settled").alias("s"), F.max(F.when(F.col("type") == "reserved", F.col("amount"))).alias("held"), F.max(F.when(F.col("type") == "settled", F.col("amount"))).alias("charge")
    )
    return one.groupBy(*keys).agg(F.sum(F.coalesce("charge", "held")).alias("exposure"), F.count_if((F.col("r") != 1) | (F.col("s") > 1)).alias("broken"))


def read_package(folder: str | Path, modes: tuple[str, ...] = ("mock-only",)) -> dict[str, Any]:
    """A capture package, {manifest, result, seal}, once everything in it is verified.

    The manifest's bytes match the seal; its files are unique, safely named and
    have their digests; the journal holds just the events that it names, and their
    exposure is the total that it states; an exported result is among the files.
    """
    base = Path(folder)

    def require(holds: bool, part: str) -> None:
        if not holds:
            raise WorkflowError("package_corrupt", "input", part=part, path=str(base))

    try:
        raw, seal = (base / "manifest.json").read_bytes(), (base / "seal.sha256").read_text()
        require(hashlib.sha256(raw).hexdigest() == seal.strip().removeprefix("sha256:"), "seal")
        manifest = json.loads(raw)
        require(isinstance(manifest, dict) and manifest.get("version") == 1 and manifest.get("mode") in modes, "version")
        files = manifest.get("files")
        require(isinstance(files, list) and all(isinstance(f, list) and len(f) == 2 for f in files) and len({f[0] for f in files}) == len(files), "files")
        for name, want in files:
            require(isinstance(name, str) and (name == "result.json" or PACKAGE_EVENT.fullmatch(name) is not None), "file_name")
            require(hashlib.sha256((base / name).read_bytes()).hexdigest() == str(want).removeprefix("sha256:"), "file_digest")
        names = sorted(n for n, _ in files if n != "result.json")
        require(names == sorted(f"events/{p.name}" for p in (base / "events").iterdir()), "journal")
        require(journal_exposure([json.loads((base / n).read_bytes()) for n in names]) == manifest.get("exposureNanoUsd"), "accounting")
        held = any(n == "result.json" for n, _ in files)
        require(held or not manifest.get("exported"), "result")
        result = json.loads((base / "result.json").read_bytes()) if manifest.get("exported") and manifest.get("status") == "completed" else None
    except (OSError, ValueError) as e:
        raise WorkflowError("package_corrupt", "input", path=str(base)) from e
    return {"manifest": manifest, "result": result, "seal": seal.strip()}


def replace_by_key(records: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """Records with those whose key equals an update's, case aside, replaced by it; every update must meet exactly one record.

    Both tables have the same columns.  Null keys meet nothing.  One join, and
    one count of what the updates met.
    """
    fold = "folded_key"
    while fold in records.columns:
        fold += "_"
    have = records.withColumn(fold, F.lower(F.col(key)))
    want = updates.withColumn(fold, F.lower(F.col(key)))
    met = want.select(fold).join(have.groupBy(fold).agg(F.count("*").alias("n")), fold, "left").agg(F.count("*").alias("updates"), F.count_if(F.col("n") == 1).alias("once"), F.count_distinct(fold).alias("keys")).first()
    if not met.updates == met.once == met.keys:
        raise WorkflowError("replacement_not_unique", "input", updates=met.updates, once=met.once)
    return have.join(want.select(fold), fold, "left_anti").drop(fold).unionByName(want.drop(fold))


class MemoryStore:
    """Outputs by digest, in memory; for tests."""

    def __init__(self):
        self.held: dict[str, str] = {}

    def put(self, value: Any) -> str:
        text = encode_ordered(value)
        name = digest("tidewright/artifact/v1", text.encode())
        if self.held.setdefault(name, text) != text:
            raise WorkflowError("content_collision", "publish", hash=name)
        return name

    def get(self, name: str) -> Any:
        if name not in self.held:
            raise WorkflowError("output_missing", "read", hash=name)
        return json.loads(self.held[name])

    def delete(self, name: str) -> bool:
        return self.held.pop(name, None) is not None

    def __len__(self) -> int:
        return len(self.held)
