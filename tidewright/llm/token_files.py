"""Token ids as flat binary files.

A folder holds, for every partition p, ``p.ids`` (unsigned little-endian
integers of 16 or 32 bits, one document after the other), ``p.offsets`` (unsigned
64-bit: where each document begins within the file, and the file's length at the
end), ``p.docs`` (signed 64-bit doc_ids, in the same order; a null doc_id is the
smallest long) and ``p.json``.  Partitions follow each other in ascending doc_id
order, and ``manifest.json`` holds the base of each partition: the ids before it
in the whole corpus, a prefix sum over the partitions' counts.

Files are written under a name of the task attempt and then renamed, so a task
that runs again leaves one whole copy.  On a mounted folder they are read by
memory mapping; stores without a mount are written and read through
``pyarrow.fs``.
"""

from __future__ import annotations

import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, partitions, read_table, with_row_id
from .tokens import encoder, encoding

NULL_ID = -(1 << 63)
#: Texts encoded at once.
BATCH = 64
#: Ids that a writer holds before they go to the file.
FLUSH_BYTES = 8 << 20
#: Characters of a text that order rows of equal doc_id.
HEAD = 256


def _place(path: str) -> tuple[fs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return fs.LocalFileSystem(), path
    if path.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(path).path
    return fs.FileSystem.from_uri(path)


def write_partition(path: str, part: int, docs: Iterator[tuple[int | None, bytes]], id_bytes: int) -> tuple[int, int]:
    """Writes the files of one partition; (documents, ids)."""
    store, root = _place(path)
    store.create_dir(root, recursive=True)
    tag = f"{root}/.{part:06d}-{uuid.uuid4().hex}"
    offsets, names = [0], []
    with store.open_output_stream(f"{tag}.ids") as out:
        held = []
        for doc_id, ids in docs:
            names.append(NULL_ID if doc_id is None else doc_id)
            offsets.append(offsets[-1] + len(ids) // 4)
            held.append(ids if id_bytes == 4 else np.frombuffer(ids, "<u4").astype("<u2").tobytes())
            if sum(map(len, held[-64:])) > FLUSH_BYTES or len(held) >= 256:
                out.write(b"".join(held))
                held = []
        out.write(b"".join(held))
    for kind, data in (("offsets", np.array(offsets, "<u8").tobytes()), ("docs", np.array(names, "<i8").tobytes()), ("json", json.dumps({"part": part, "docs": len(names), "ids": offsets[-1]}).encode())):
        with store.open_output_stream(f"{tag}.{kind}") as out:
            out.write(data)
    for kind in ("ids", "offsets", "docs", "json"):
        store.move(f"{tag}.{kind}", f"{root}/{part:06d}.{kind}")
    return len(names), offsets[-1]


def _writer(path: str, tokenizer: str, keep_space: bool, end_id: int, id_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, end = TaskContext.get().partitionId(), np.array([end_id], "<u4").tobytes()

        def docs(enc):
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    some = batch.slice(at, BATCH)
                    texts = [t or "" for t in some.column("text").to_pylist()]
                    for doc_id, ids in zip(some.column("doc_id").to_pylist(), enc.encode(texts)):
                        yield doc_id, ids + end

        with encoding(tokenizer, keep_space) as enc:
            n, ids = write_partition(path, part, docs(enc), id_bytes)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([n], pa.int64()), pa.array([ids], pa.int64())], ["part", "docs", "ids"])

    return run


def write_token_files(spark: SparkSession, docs: DataFrame, path: str, tokenizer: str, end_id: int, keep_space: bool = True, id_bytes: int | None = None) -> dict:
    """Encodes every text and writes the folder; returns the manifest.

    Ids take two bytes where the vocabulary and the end id fit, else four, unless given.

    Null texts are empty: their documents hold the end id alone.  Null doc_ids
    come first.  Rows with equal doc_id lie next to each other, ordered by the
    first ``HEAD`` characters of the text and then by their place in the input,
    so they may fill any number of partitions.  Texts of any length are encoded
    whole.  Other columns, whatever their names, are ignored.  An empty table
    gives files without documents.  The driver gets one row of counts a
    partition.
    """
    if id_bytes is None:
        largest = max(encoder(tokenizer, keep_space).library.get_vocab_size(with_added_tokens=True) - 1, end_id)
        id_bytes = 2 if largest < 1 << 16 else 4
    rows = with_row_id(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    order = ["doc_id", F.substring("text", 1, HEAD), "row_id"]
    dealt = rows.repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order).select("doc_id", "text")
    told = dealt.mapInArrow(_writer(path, tokenizer, keep_space, end_id, id_bytes), "part int, docs long, ids long").collect()
    base, parts = 0, []
    for r in sorted(told, key=lambda r: r.part):
        parts.append({"part": r.part, "base": base, "docs": r.docs, "ids": r.ids})
        base += r.ids
    manifest = {"id_bytes": id_bytes, "end_id": end_id, "ids": base, "parts": parts}
    store, root = _place(path)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest).encode())
    return manifest


class TokenFiles:
    """Random access to a written folder by memory mapping."""

    def __init__(self, path: str):
        self.store, self.root = _place(path)
        with self.store.open_input_stream(f"{self.root}/manifest.json") as f:
            self.manifest = json.loads(f.read())
        self.parts = {p["part"]: p for p in self.manifest["parts"]}

    def array(self, part: int, kind: str) -> np.ndarray:
        dtype = {"ids": f"<u{self.manifest['id_bytes']}", "offsets": "<u8", "docs": "<i8"}[kind]
        name = f"{self.root}/{part:06d}.{kind}"
        if isinstance(self.store, fs.LocalFileSystem):
            empty = self.store.get_file_info(name).size == 0
            return np.empty(0, dtype) if empty else np.memmap(name, dtype, "r")
        with self.store.open_input_file(name) as f:
            return np.frombuffer(f.read_buffer(), dtype)

    def documents(self, part: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, ids of the corpus before it, its ids) in file order."""
        ids, offsets, base = self.array(part, "ids"), self.array(part, "offsets"), self.parts[part]["base"]
        for k, doc_id in enumerate(self.array(part, "docs")):
            a, b = int(offsets[k]), int(offsets[k + 1])
            yield (None if doc_id == NULL_ID else int(doc_id)), base + a, ids[a:b]


def read_token_files(spark: SparkSession, path: str, schema: str, each) -> DataFrame:
    """``each(doc_id, start, ids)`` gives a row; one task a file."""
    found = TokenFiles(path)
    parts = spark.range(0, len(found.parts), 1, max(1, len(found.parts)))
    order = sorted(found.parts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = TokenFiles(path)
        for batch in batches:
            for k in batch.column("id").to_pylist():
                rows = []
                for doc in files.documents(order[k]):
                    rows.append(each(*doc))
                    if len(rows) >= 4096:
                        yield pa.RecordBatch.from_pylist(rows, want)
                        rows = []
                yield pa.RecordBatch.from_pylist(rows, want)

    want = _arrow(spark, schema)
    return parts.mapInArrow(run, schema)


def _arrow(spark: SparkSession, schema: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(schema))


def _digest(doc_id, start, ids) -> dict:
    raw = np.ascontiguousarray(ids, "<u4")
    return {"doc_id": doc_id, "start": start, "n_tokens": len(raw), "ids_crc32": zlib.crc32(raw.view(np.uint8))}


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = Scratch(spark, "token-files").path("files")
    write_token_files(spark, read_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=2)
    return read_token_files(spark, path, "doc_id long, start long, n_tokens long, ids_crc32 long", _digest)
