"""Sharding by a keyed permutation of global row numbers.

Rows are numbered 0..N-1 in the order of (doc_id, size, crc).  A Feistel network
over the mixed-radix domain a*b >= N, walked along its cycle until it lands
below N, permutes these numbers.  Shard = place mod shards, slot = place div
shards: shards differ by one row at most, slots have no gaps, and both follow
from (row number, N, seed) alone, as does the way back (:func:`row_at`).
Everything runs as DataFrame expressions.
"""

from __future__ import annotations

from math import isqrt

import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, free_name, long_array, partitions, read_table, with_row_id

ROUNDS = 6
#: Cycle steps that one pass evaluates; a further pass runs while a row still lies outside.
WALK = 6


def domain(n: int) -> tuple[int, int]:
    """Radices (a, b), a*b the least such product over n: fewer than sqrt(n)+1 places lie outside."""
    a = isqrt(max(n, 1) - 1) + 1
    return a, -(-max(n, 1) // a)


def _once(x: Column, n: int, seed: int) -> Column:
    a, b = domain(n)
    start = F.struct((x % a).alias("l"), F.floor(x / a).cast("long").alias("r"))

    def step(s: Column, i: Column) -> Column:
        left = F.pmod(s["l"] + F.pmod(F.xxhash64(s["r"], i, F.lit(seed).cast("long")), F.lit(a)), F.lit(a))
        right = F.pmod(s["r"] + F.pmod(F.xxhash64(s["l"], i, F.lit(seed).cast("long")), F.lit(b)), F.lit(b))
        even = i % 2 == 0
        return F.struct(F.when(even, left).otherwise(s["l"]).alias("l"), F.when(even, s["r"]).otherwise(right).alias("r"))

    return F.aggregate(F.sequence(F.lit(0).cast("long"), F.lit(ROUNDS - 1).cast("long")), start, step, lambda s: s["r"] * a + s["l"])


def walked(x: Column, n: int, seed: int) -> Column:
    """Up to WALK steps along the cycle of x, ended by the first place below n."""
    return F.aggregate(F.sequence(F.lit(1), F.lit(WALK)), _once(x, n, seed), lambda at, _: F.when(at < n, at).otherwise(_once(at, n, seed)))


def _hash(values: list[int]) -> int:
    """What Spark's xxhash64 gives for these longs."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(int(v).to_bytes(8, "little", signed=True), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def place_of(row: int, n: int, seed: int) -> int:
    """The permuted place of one row number, on the driver."""
    a, b = domain(n)
    while True:
        r, left = divmod(row, a)
        for i in range(ROUNDS):
            if i % 2 == 0:
                left = (left + _hash([r, i, seed]) % a) % a
            else:
                r = (r + _hash([left, i, seed]) % b) % b
        row = r * a + left
        if row < n:
            return row


def row_at(shard: int, slot: int, shards: int, n: int, seed: int) -> int:
    """The global row number that lies at a slot of a shard: the permutation walked back."""
    a, b = domain(n)
    place = slot * shards + shard
    if not 0 <= place < n:
        raise IndexError("no such slot")
    while True:
        r, left = divmod(place, a)
        for i in reversed(range(ROUNDS)):
            if i % 2 == 0:
                left = (left - _hash([r, i, seed]) % a) % a
            else:
                r = (r - _hash([left, i, seed]) % b) % b
        place = r * a + left
        if place < n:
            return place


def row_numbers(scratch: Scratch, rows: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """``rows`` with ``row_number`` from 0 in the given order, and their count.

    A sort by range, the place within each partition, and prefix sums over one
    count a partition.  Rows equal in all of ``order`` may swap numbers, so the
    order should name every column that is returned.
    """
    sorted_rows = rows.repartitionByRange(partitions(scratch.spark), *order).sortWithinPartitions(*order)
    mark = free_name(rows, "place")
    stored = scratch.write(with_row_id(sorted_rows, mark), "numbered")
    part = F.shiftright(mark, 33).cast("int")
    counts = {r.part: r.n for r in stored.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()}
    bases, total = [], 0
    for p in range(max(counts, default=0) + 1):
        bases.append(total)
        total += counts.get(p, 0)
    number = F.element_at(long_array(bases), part + 1) + F.col(mark).bitwiseAND(F.lit((1 << 33) - 1))
    return stored.withColumn("row_number", number).drop(mark), total


def assign_shards(spark: SparkSession, rows: DataFrame, order: list[str], shards: int = 16, seed: int = 17) -> DataFrame:
    """Adds row_number, shard and slot to ``rows``.

    Null order keys sort first; repeated rows get numbers of their own; an empty
    table stays empty.  Other columns are passed on, whatever their names, except
    row_number, shard and slot, which are replaced.  ``rows`` should not carry
    texts: they are not needed to place a row, and can be joined or looked up by
    the order columns afterwards.
    """
    scratch = Scratch(spark, "shards")
    numbered, n = row_numbers(scratch, rows, order)
    mark = free_name(numbered, "at")
    at = F.col(mark)
    placed = numbered.withColumn(mark, walked(F.col("row_number"), n, seed))
    while n and not placed.where(at >= n).isEmpty():
        placed = placed.withColumn(mark, F.when(at < n, at).otherwise(walked(at, n, seed)))
    return placed.withColumns({"shard": (at % shards).cast("int"), "slot": F.floor(at / shards).cast("long")}).drop(mark)


def write_shards(placed: DataFrame, docs: DataFrame, keys: list[str], path: str) -> None:
    """Writes the documents as one folder a shard, each file sorted by slot.

    ``keys`` name a document in both tables and must be unique in ``docs``.
    """
    full = docs.join(placed.select(*keys, "shard", "slot"), keys)
    full.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents over 16 shards under the law ``rows``: counts differ by one at most.

    Null texts have size 1 and the checksum of an empty text, which they share
    with empty ones; texts of any length are measured whole.  Null doc_ids come
    first in the order of row numbers.  Only doc_id and text are read.
    """
    raw = F.encode("text", "UTF-8")
    docs = read_table(spark, sf_dir, "documents").select(
        "doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"), F.crc32(F.coalesce(raw, F.encode(F.lit(""), "UTF-8"))).alias("text_crc32")
    )
    placed = assign_shards(spark, docs, ["doc_id", "size", "text_crc32"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "row_number")
