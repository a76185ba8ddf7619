"""Packing tokenised documents into sequences of balanced attention cost.

A task streams its documents and packs them window by window (``WINDOW`` ids, a
bound on memory).  A window of T ids gets ceil(T / length) sequences.  Its
documents are taken in descending length; each goes to the sequence of the
lowest estimated cost, linear plus quadratic in the pieces it holds, among those
with room.  A document that fits nowhere is cut: the roomiest sequence takes
what it can hold and the rest queues up again.  So all sequences of a window but
one's worth of padding are full, and the window is the only thing held.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .common import read_table
from .tokens import encoding

#: Ids that are packed together.
WINDOW = 1 << 20
#: Cost of a piece of n ids: LINEAR * n + n * n.  The linear part stands for the dense layers.
LINEAR = 4096
BATCH = 64


def pack(lengths: list[int], capacity: int, linear: int = LINEAR) -> list[tuple[int, int, int, int]]:
    """Pieces (item, start, length, sequence) of items of the given lengths, each id in one piece."""
    total = sum(lengths)
    n = -(-total // capacity)
    room, cost = np.full(n, capacity, np.int64), np.zeros(n)
    queue = [(-(size), k, 0) for k, size in enumerate(lengths) if size]
    heapq.heapify(queue)
    pieces = []
    while queue:
        size, item, start = heapq.heappop(queue)
        size = -size
        fits = np.flatnonzero(room >= size)
        if len(fits):
            at, take = int(fits[np.argmin(cost[fits])]), size
        else:
            at = int(np.argmax(room))
            take = int(room[at])
            heapq.heappush(queue, (take - size, item, start + take))
        room[at] -= take
        cost[at] += linear * take + float(take) * take
        pieces.append((item, start, take, at))
    return pieces


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _packer(tokenizer: str, keep_space: bool, end_id: int, capacity: int, window: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 36
        names: list = []
        ids: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal base, names, ids, held
            pieces = sorted(pack([len(x) // 4 for x in ids], capacity), key=lambda p: (p[3], p[0], p[1]))
            rows, offset, at = [], 0, None
            for item, start, take, seq in pieces:
                offset = 0 if seq != at else offset
                raw = ids[item][4 * start : 4 * (start + take)]
                row = (names[item], start, take, zlib.crc32(raw), len(ids[item]) // 4, base + seq, offset)
                rows.append((*row, raw) if with_ids else row)
                offset, at = offset + take, seq
            base += -(-held // capacity)
            names, ids, held = [], [], 0
            kinds = [pa.int64()] * 7 + [pa.binary()] * with_ids
            labels = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], labels)

        with encoding(tokenizer, keep_space) as enc:
            for batch in batches:
                for at in range(0, batch.num_rows, BATCH):
                    some = batch.slice(at, BATCH)
                    for doc_id, raw in zip(some.column("doc_id").to_pylist(), enc.encode([t or "" for t in some.column("text").to_pylist()])):
                        names.append(doc_id)
                        ids.append(raw + end)
                        held += len(ids[-1]) // 4
                        if held >= window:
                            yield flush()
            if held:
                yield flush()

    return run


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, keep_space: bool = False, capacity: int = 2048, window: int = WINDOW, with_ids: bool = False
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    No shuffle: each partition packs its own rows, and sequence_id is unique
    through the partition's number in its high bits.  A window pads less than
    one sequence.  Null texts are empty and still get their end id, so every row
    has a piece.  Rows with null or equal doc_ids are packed like others.  Equal
    lengths are taken in the order they came, equal costs by the lower sequence.
    Other columns, whatever their names, are ignored.  An empty table gives no
    sequences.  A single document longer than the window is packed whole, in as
    much memory as its ids take.
    """
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_packer(tokenizer, keep_space, end_id, capacity, window, with_ids), SCHEMA + ", ids binary" * with_ids)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
