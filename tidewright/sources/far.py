"""A store whose tables lie wherever Spark can write: HDFS, object stores, other mounts."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..errors import WorkflowError
from ..functions.codec import decode, encode_ordered
from ..functions.identity import bag_digest, ordered_digest
from .store import RECORD_BYTES, Store


class FarStore(Store):
    """Records, values and receipts stay in the mounted folder ``root``; tables go below ``tables``, any Spark path.

    A table is written once, into a folder of its own, and never moved.  What
    publishes it is a small note in the mounted folder, put there by the same
    steps as a value.  So nothing is renamed, linked or locked where the rows
    lie, and a writer that is lost leaves a folder that no note names.
    """

    def __init__(self, root: str | Path, tables: str, hooks: dict[str, Callable[[], None]] | None = None):
        super().__init__(root, hooks)
        self.tables = tables.rstrip("/")

    @staticmethod
    def _place(spark: SparkSession, folder: str) -> tuple[Any, Any]:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path

    def _listing(self, spark: SparkSession, folder: str) -> list[list[Any]]:
        """Name, length and time of each data file; none where there is no folder."""
        store, path = self._place(spark, folder)
        if not store.exists(path):
            return []
        out, found = [], store.listFiles(path, True)
        while found.hasNext():
            f = found.next()
            if f.getPath().getName().endswith(".parquet"):
                out.append([f.getPath().getName(), f.getLen(), f.getModificationTime()])
        return sorted(out)

    def _note_path(self, ref: dict[str, Any]) -> Path:
        return self.folder("objects") / f"{ref['hash'][7:]}.table.json"

    def _note(self, ref: dict[str, Any]) -> dict[str, Any]:
        path = self._note_path(ref)
        if not path.exists():
            raise WorkflowError("output_missing", "read", path=str(path))
        note = decode(self._read(path, RECORD_BYTES, "read"))
        if note.get("hash") != ref["hash"]:
            raise WorkflowError("output_corrupt", "read", path=str(path))
        return note

    def stage_table(self, df: DataFrame, order: tuple[str, ...] = ()) -> tuple[str, dict[str, Any]]:
        folder = f"{self.tables}/{uuid.uuid4().hex}"
        df.write.parquet(folder)
        back = df.sparkSession.read.schema(df.schema).parquet(folder)
        row = (ordered_digest(back, list(order)) if order else bag_digest(back)).first()
        size = sum(f[1] for f in self._listing(df.sparkSession, folder))
        return folder, {"kind": "table", "hash": row.digest, "byteLength": size, "rows": row.rows, "order": list(order), "schema": json.loads(df.schema.json())}

    def put_table(self, stage: str, ref: dict[str, Any], spark: SparkSession | None = None) -> dict[str, Any]:
        """Publishes the note of a staged table; where a sound table is named already, the staged one goes."""
        spark = spark or SparkSession.active()
        files = [f[:2] for f in self._listing(spark, stage)]
        data = encode_ordered({"hash": ref["hash"], "rows": ref["rows"], "byteLength": ref["byteLength"], "folder": stage.rpartition("/")[2], "files": files}).encode()
        for _ in range(2):
            if self._note_path(ref).exists():
                if self.sound_table(spark, ref):
                    self.discard(stage)
                    return {**ref, "byteLength": self._note(ref)["byteLength"]}
                with self.lock():
                    self._quarantine(self._note_path(ref))
            try:
                self._publish(self._note_path(ref), data)
                return ref
            except WorkflowError as e:  # another writer was first: its table is judged like any other
                if e.code != "content_collision":
                    raise
        raise WorkflowError("content_collision", "publish", path=str(self._note_path(ref)))

    def discard(self, stage: str) -> None:
        store, path = self._place(SparkSession.active(), stage)
        store.delete(path, True)

    def get_table(self, spark: SparkSession, ref: dict[str, Any], verify: bool = False) -> DataFrame:
        from pyspark.sql.types import StructType

        note = self._note(ref)
        folder = f"{self.tables}/{note['folder']}"
        if [f[:2] for f in self._listing(spark, folder)] != note["files"]:
            raise WorkflowError("output_corrupt", "read", path=folder)
        df = spark.read.schema(StructType.fromJson(ref["schema"])).parquet(folder)
        if verify and not self._digests_to(df, ref):
            raise WorkflowError("output_corrupt", "read", path=folder)
        return df

    def sound_table(self, spark: SparkSession | None, ref: dict[str, Any]) -> bool:
        if spark is None:
            return False
        try:
            marks = self._listing(spark, f"{self.tables}/{self._note(ref)['folder']}")
            if self._sound.get(ref["hash"]) != marks:
                self.get_table(spark, ref, verify=True)
        except (WorkflowError, OSError):
            return False
        self._sound[ref["hash"]] = marks
        return True
