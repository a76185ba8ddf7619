"""A content-addressed store on a file system that driver and executors share.

    runs/<run id>.json        immutable run records
    objects/<hex>.json        JSON outputs: three header lines and the ordered text
    objects/<hex>/            DataFrame outputs: Parquet, named by the digest of the rows
    receipts/<id>.json        evaluation receipts
    staging/ quarantine/ writer-lock/

Publishing stages the content, verifies it, takes the lock, moves it into place
without replacing anything, and verifies again.  The same content published
again is accepted; other content under the same name is a collision.  A corrupt
object is set aside with a note and replaced.

An output is taken over only when its content still has its digest.  For a table
that is one distributed pass over the stored rows, or for one of up to
``SMALL_TABLE`` bytes a digest of its files.  What a store object has found sound
it reads again only once a file's length or times have changed.
"""

from __future__ import annotations

import contextlib
import hashlib
import json
import os
import shutil
import time
import uuid
from collections.abc import Callable, Iterator
from pathlib import Path
from typing import Any

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession

from ..errors import WorkflowError
from ..functions.codec import decode, encode_ordered
from ..functions.identity import bag_digest, digest, ordered_digest

# Limits.
RECORD_BYTES, OUTPUT_BYTES = 2 << 20, 16 << 20
LOCK_SECONDS, LOCK_POLL = 5.0, 0.025
#: Tables up to this many bytes are verified by the digests of their files, on the driver.
SMALL_TABLE = 64 << 20
HEADER = "tidewright/artifact/v1\nencoding: ordered-json\nhash: sha256\n"
ARTIFACT = "tidewright/artifact/v1"
RECEIPT = "tidewright/receipt/v1"


class Store:
    """hooks: test-only callbacks by point (staged, locked, linked, quarantined)."""

    def __init__(self, root: str | Path, hooks: dict[str, Callable[[], None]] | None = None):
        self.root = Path(root).resolve()
        self.hooks = hooks or {}
        self._sound: dict[str, list[list[Any]]] = {}

    def _at(self, point: str) -> None:
        if point in self.hooks:
            self.hooks[point]()

    def folder(self, name: str, make: bool = False) -> Path:
        p = self.root / name
        if make:
            p.mkdir(parents=True, exist_ok=True)
        return p

    @contextlib.contextmanager
    def lock(self) -> Iterator[None]:
        held = self.folder("writer-lock")
        self.root.mkdir(parents=True, exist_ok=True)
        end = time.monotonic() + LOCK_SECONDS
        while True:
            try:
                held.mkdir()
                break
            except FileExistsError:
                if time.monotonic() >= end:
                    raise WorkflowError("store_locked", "publish", path=str(held)) from None
                time.sleep(LOCK_POLL)
        try:
            (held / "owner.json").write_text(json.dumps({"pid": os.getpid()}))
            self._at("locked")
            yield
        finally:
            shutil.rmtree(held, ignore_errors=True)

    def _read(self, path: Path, most: int, operation: str) -> bytes:
        """At most ``most`` bytes of a regular file that does not change meanwhile."""
        try:
            with path.open("rb") as f:
                before = os.fstat(f.fileno())
                data = f.read(most + 1)
                after = os.fstat(f.fileno())
        except OSError as e:
            raise WorkflowError("not_readable", operation, path=str(path)) from e
        if len(data) > most:
            raise WorkflowError("size_limit", operation, path=str(path), limit=most)
        if (before.st_size, before.st_mtime_ns) != (after.st_size, after.st_mtime_ns):
            raise WorkflowError("changed_while_reading", operation, path=str(path))
        return data

    def _publish(self, target: Path, data: bytes, repair: Callable[[bytes], bool] | None = None) -> str:
        """"linked", "identical" or "repaired".  Errors say whether the content was published."""
        stage = self.folder("staging", True) / uuid.uuid4().hex
        target.parent.mkdir(parents=True, exist_ok=True)
        linked = False
        try:
            with stage.open("wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
            self._at("staged")
            with self.lock():
                if stage.read_bytes() != data:
                    raise WorkflowError("staging_changed", "publish", path=str(stage), status="not_published")
                how = "linked"
                if target.exists():
                    there = target.read_bytes()
                    if there == data:
                        return "identical"
                    if repair is None or not repair(there):
                        raise WorkflowError("content_collision", "publish", path=str(target), status="not_published")
                    self._quarantine(target)
                    how = "repaired"
                os.link(stage, target)
                linked = True
                self._at("linked")
                if target.read_bytes() != data:
                    raise WorkflowError("publish_uncertain", "publish", path=str(target), status="uncertain")
                return how
        except WorkflowError:
            raise
        except OSError as e:
            status = "uncertain" if linked else "not_published"
            raise WorkflowError("publish_failed", "publish", path=str(target), status=status) from e
        finally:
            stage.unlink(missing_ok=True)

    def _quarantine(self, path: Path) -> None:
        away = self.folder("quarantine", True) / uuid.uuid4().hex
        away.mkdir()
        (away / "descriptor.json").write_text(json.dumps({"name": path.name}))
        os.rename(path, away / path.name)
        self._at("quarantined")

    # JSON outputs

    def put_value(self, value: Any) -> dict[str, Any]:
        body = (HEADER + encode_ordered(value)).encode()
        if len(body) > OUTPUT_BYTES:
            raise WorkflowError("output_too_large", "publish", limit=OUTPUT_BYTES, actualBytes=len(body))
        name = digest(ARTIFACT, body)
        target = self.folder("objects") / f"{name[7:]}.json"
        corrupt = lambda there: not there or there.startswith(HEADER.encode()[: len(there)]) and digest(ARTIFACT, there) != name
        self._publish(target, body, corrupt)
        return {"kind": "json", "hash": name, "byteLength": len(body)}

    def get_value(self, ref: dict[str, Any]) -> Any:
        path = self.folder("objects") / f"{ref['hash'][7:]}.json"
        if not path.exists():
            raise WorkflowError("output_missing", "read", path=str(path))
        data = self._read(path, OUTPUT_BYTES, "read")
        if not data.startswith(HEADER.encode()):
            raise WorkflowError("unknown_format" if data.startswith(b"tidewright/") else "output_corrupt", "read", path=str(path))
        if len(data) != ref["byteLength"] or digest(ARTIFACT, data) != ref["hash"]:
            raise WorkflowError("output_corrupt", "read", path=str(path))
        return decode(data[len(HEADER) :])

    # DataFrame outputs

    def stage_table(self, df: DataFrame, order: tuple[str, ...] = ()) -> tuple[Path, dict[str, Any]]:
        """Writes the rows aside and digests what was written, in one pass over the computation."""
        stage = self.folder("staging", True) / uuid.uuid4().hex
        df.write.parquet(str(stage))
        back = df.sparkSession.read.schema(df.schema).parquet(str(stage))
        row = (ordered_digest(back, list(order)) if order else bag_digest(back)).first()
        size = sum(p.stat().st_size for p in stage.rglob("*.parquet"))
        ref = {"kind": "table", "hash": row.digest, "byteLength": size, "rows": row.rows, "order": list(order), "schema": json.loads(df.schema.json())}
        return stage, ref

    def put_table(self, stage: Path, ref: dict[str, Any], spark: SparkSession | None = None) -> dict[str, Any]:
        """Moves a staged table into place; a sound one that is there already stays, another is set aside.

        Its rows are read before the lock is taken; under the lock only the files' marks are compared.
        """
        target = self.folder("objects", True) / ref["hash"][7:]
        sound = target.exists() and self.sound_table(spark, ref)
        marks = self._marks(target) if sound else None
        hashes = self._hashes(stage) if ref["byteLength"] <= SMALL_TABLE else None
        with self.lock():
            if target.exists():
                if sound and self._marks(target) == marks:
                    shutil.rmtree(stage)
                    return {**ref, "byteLength": json.loads((target / "_identity.json").read_text())["byteLength"]}
                self._quarantine(target)
            (stage / "_identity.json").write_text(json.dumps({"hash": ref["hash"], "rows": ref["rows"], "byteLength": ref["byteLength"], "files": self._files(stage), "fileHashes": hashes}))
            os.rename(stage, target)
            self._at("linked")
        self._sound[ref["hash"]] = self._marks(target)
        return ref

    def discard(self, stage: Path) -> None:
        """Removes a staged table that will not be published."""
        shutil.rmtree(stage, ignore_errors=True)

    @staticmethod
    def _files(path: Path) -> list[list[Any]]:
        return sorted([p.name, p.stat().st_size] for p in path.rglob("*.parquet"))

    @staticmethod
    def _marks(path: Path) -> list[list[Any]]:
        return sorted([p.name, (st := p.stat()).st_size, st.st_mtime_ns, st.st_ctime_ns] for p in path.rglob("*.parquet"))

    @staticmethod
    def _hashes(path: Path) -> dict[str, str]:
        out = {}
        for p in sorted(path.rglob("*.parquet")):
            with p.open("rb") as f:
                out[p.name] = hashlib.file_digest(f, "sha256").hexdigest()
        return out

    def _holds(self, df: DataFrame | None, ref: dict[str, Any], path: Path, note: dict[str, Any]) -> bool:
        """Whether a folder's content is what was published: by its files where these were digested, else by its rows."""
        if note.get("fileHashes") is not None:
            return self._hashes(path) == note["fileHashes"]
        return df is not None and self._digests_to(df, ref)

    def get_table(self, spark: SparkSession, ref: dict[str, Any], verify: bool = False) -> DataFrame:
        """The stored rows.  Names and lengths of files are always checked; ``verify`` digests the rows again."""
        from pyspark.sql.types import StructType

        path = self.folder("objects") / ref["hash"][7:]
        if not (path / "_identity.json").exists():
            raise WorkflowError("output_missing", "read", path=str(path))
        note = json.loads((path / "_identity.json").read_text())
        if self._files(path) != note["files"]:
            raise WorkflowError("output_corrupt", "read", path=str(path))
        df = spark.read.schema(StructType.fromJson(ref["schema"])).parquet(str(path))
        if verify and not self._holds(df, ref, path, note):
            raise WorkflowError("output_corrupt", "read", path=str(path))
        return df

    @staticmethod
    def _digests_to(df: DataFrame, ref: dict[str, Any]) -> bool:
        try:
            return (ordered_digest(df, ref["order"]) if ref.get("order") else bag_digest(df)).first().digest == ref["hash"]
        except (PySparkException, Py4JError):  # pages that do not decode
            return False

    def sound_table(self, spark: SparkSession | None, ref: dict[str, Any]) -> bool:
        """Whether a stored table still is what was published; rows that only a session could read count as not."""
        path = self.folder("objects") / ref["hash"][7:]
        try:
            note = json.loads((path / "_identity.json").read_text())
            if self._files(path) != note["files"]:
                return False
            marks = self._marks(path)
            if self._sound.get(ref["hash"]) == marks:
                return True
            if not self._holds(None if spark is None else self.get_table(spark, ref), ref, path, note):
                return False
        except (WorkflowError, OSError, ValueError):
            return False
        self._sound[ref["hash"]] = marks
        return True

    def available(self, ref: dict[str, Any], spark: SparkSession | None = None) -> bool:
        """Whether an output can be taken over: its content is there and has its digest."""
        if ref["kind"] == "table":
            return self.sound_table(spark, ref)
        try:
            self.get_value(ref)
        except WorkflowError:
            return False
        return True

    # records and receipts

    def put_record(self, record: dict[str, Any], folder: str = "runs") -> Path:
        data = encode_ordered(record).encode()
        if len(data) > RECORD_BYTES:
            raise WorkflowError("record_too_large", "finalize", limit=RECORD_BYTES, actualBytes=len(data))
        target = self.folder(folder) / f"{record['id']}.json"
        self._publish(target, data)
        return target

    def record_bytes(self, id: str, folder: str = "runs") -> bytes:
        path = self.folder(folder) / f"{id}.json"
        if not path.exists():
            raise WorkflowError("run_not_found" if folder == "runs" else "receipt_not_found", "read", run=id)
        return self._read(path, RECORD_BYTES, "read")

    def get_record(self, id: str, folder: str = "runs") -> dict[str, Any]:
        return decode(self.record_bytes(id, folder))

    def put_receipt(self, body: dict[str, Any], guard: Callable[[], bool] = lambda: True) -> dict[str, Any]:
        """Stores an evaluation's result under the digest of its content, if the guard still holds."""
        if not guard():
            raise WorkflowError("evaluation_inputs_changed", "publish")
        made = {"id": "eval_" + digest(RECEIPT, encode_ordered(body).encode())[7:], **body}
        self.put_record(made, "receipts")
        return made

    def get_receipt(self, id: str) -> dict[str, Any]:
        got = self.get_record(id, "receipts")
        body = {k: v for k, v in got.items() if k != "id"}
        if got["id"] != id or id != "eval_" + digest(RECEIPT, encode_ordered(body).encode())[7:]:
            raise WorkflowError("receipt_corrupt", "read", receipt=id)
        return got
