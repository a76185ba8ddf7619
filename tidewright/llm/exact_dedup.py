"""Exact deduplication by deterministic block naming.

A text is cut into blocks of fixed size.  All blocks of the corpus are sorted
and get dense integer names, equal blocks the same one.  Adjacent names are then
paired and the sorted pairs named again, which halves every sequence, until a
document is one name.  Names stand for contents, not for hashes of them, so two
documents share (level, name) exactly when their texts are equal.

One sort by range per level carries the data: rows are ordered by (block, row),
so the copies of a hot block spread over as many partitions as they fill.  Each
partition numbers its own runs of equal keys, and the partitions are joined up
from one small record apiece: its number of runs and its first and last key.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, Scratch, free_name, long_array, numbered, partitions, read_table, with_row_id, without_rows

#: Characters a block.  Longer blocks mean fewer levels, and larger sort keys.
BLOCK_CHARS = 512


def _rank(keys: list[str], keep: list[str]):
    """A mapInArrow function that numbers the runs of equal keys of its sorted partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pid = TaskContext.get().partitionId()
        rank, last, held = -1, None, None

        def out(table: pa.RecordBatch, local: pa.Array, first, end) -> pa.RecordBatch:
            n = table.num_rows
            edge = lambda at, key: pa.array([None] * at + [key] + [None] * (n - at - 1), pa.string())
            none = pa.nulls(n, pa.string())
            columns = [table.column(c) for c in keep]
            columns += [local, pa.array([pid] * n, pa.int32()), none if first is None else edge(0, first), none if end is None else edge(n - 1, end)]
            return pa.RecordBatch.from_arrays(columns, [*keep, "local", "pid", "first_key", "last_key"])

        text = lambda batch, i: "\x1f".join(str(batch.column(k)[i].as_py()) for k in keys)
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            fresh = None
            for k in keys:
                col = batch.column(k)
                differs = pc.not_equal(col.slice(1), col.slice(0, n - 1))
                fresh = differs if fresh is None else pc.or_(fresh, differs)
            head = tuple(batch.column(k)[0].as_py() for k in keys)
            begins = last is None or head != last
            steps = pa.concat_arrays([pa.array([int(begins)], pa.int64()), pc.cast(fresh, pa.int64())])
            local = pc.add(pc.cumulative_sum(steps), rank)
            first = text(batch, 0) if last is None else None
            if held is not None:
                yield out(*held, None)
            held = (batch, local, first)
            rank, last = local[n - 1].as_py(), tuple(batch.column(k)[n - 1].as_py() for k in keys)
        if held is not None:
            yield out(*held, text(held[0], held[0].num_rows - 1))

    return run


def name_keys(scratch: Scratch, rows: DataFrame, keys: list[str], label: str) -> DataFrame:
    """Replaces the key columns of ``rows`` by ``name``: dense from 1 in the order of the keys.

    Key columns are never null.  The driver sees one record a partition.
    """
    keep = [c for c in rows.columns if c not in keys]
    dealt = rows.repartitionByRange(partitions(scratch.spark), *keys, "row_id").sortWithinPartitions(*keys)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name in keep)
    ranked = dealt.mapInArrow(_rank(keys, keep), f"{schema}, local long, pid int, first_key string, last_key string")
    stored = scratch.write(ranked, label)
    ends = stored.where("first_key is not null or last_key is not null").groupBy("pid").agg(
        F.max("first_key").alias("first_key"), F.max("last_key").alias("last_key"), (F.max("local") + 1).alias("runs")
    )
    starts, total, before = {}, 0, None
    for end in sorted(ends.collect(), key=lambda r: r.pid):
        starts[end.pid] = total - (before is not None and before == end.first_key)
        total, before = starts[end.pid] + end.runs, end.last_key
    base = long_array([starts.get(p, 0) for p in range(max(starts, default=0) + 1)])
    return stored.select(*keep, (F.element_at(base, F.col("pid") + 1) + F.col("local") + 1).alias("name"))


def block_names(scratch: Scratch, docs: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(facts, identities): facts is (row_id, doc_id, text_sha256), identities is (row_id, doc_id, level, name).

    ``docs`` is (row_id, doc_id, text); it is read by one job, which stores level 0.
    """
    flat = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACES, " ")
    cut = docs.select("row_id", "doc_id", flat.alias("flat"))
    pieces = F.regexp_extract_all("flat", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    cut = cut.select("row_id", "doc_id", F.sha2(F.encode("flat", "UTF-8"), 256).alias("sha"), F.when(F.col("flat") == "", F.array(F.lit(""))).otherwise(pieces).alias("pieces"))
    rows = cut.select("row_id", "doc_id", "sha", F.size("pieces").cast("long").alias("n"), F.posexplode_outer("pieces").alias("pos", "block"))
    rows = rows.withColumn("pos", F.col("pos").cast("long")).withColumn("sha", F.when(F.col("pos") == 0, F.unhex("sha")))
    named = name_keys(scratch, rows, ["block"], "level-0")
    facts = named.where("pos = 0").select("row_id", "doc_id", F.lower(F.hex("sha")).alias("text_sha256"))
    level, done = 0, []
    while True:
        done.append(named.where("n = 1").select("row_id", "doc_id", F.lit(level).alias("level"), "name"))
        rest = named.where("n > 1")
        if rest.isEmpty():
            break
        pairs = rest.groupBy("row_id", F.floor(F.col("pos") / 2).cast("long").alias("half")).agg(
            F.first("doc_id").alias("doc_id"),
            F.first(F.ceil(F.col("n") / 2).cast("long")).alias("n"),
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("left_name"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(0)).alias("right_name"),
        )
        level += 1
        named = name_keys(scratch, pairs.withColumnRenamed("half", "pos"), ["left_name", "right_name"], f"level-{level}")
    every = done[0]
    for more in done[1:]:
        every = every.union(more)
    return facts, every


def exact_duplicates(spark: SparkSession, docs: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space becomes
    one space.  Null text counts as empty, and empty texts equal each other.
    The row with the smallest doc_id stays; null doc_ids come last, and among
    rows with equal doc_id the first row of the input stays, so exactly one row
    of each group is kept.  Texts of any length are named whole, in blocks that
    spread over tasks.  Other columns of ``docs``, whatever their names, are
    ignored.  An empty table gives an empty result.
    """
    facts, decided = _decide(Scratch(spark, "exact-dedup"), with_row_id(docs.select("doc_id", "text")), block_chars)
    return facts.join(decided, "row_id").select("row_id", "doc_id", "keep_id", "group_size", "kept", "text_sha256")


def _decide(scratch: Scratch, rows: DataFrame, block_chars: int = BLOCK_CHARS) -> tuple[DataFrame, DataFrame]:
    """(row_id, doc_id, text_sha256) and (row_id, keep_id, group_size, kept)."""
    facts, names = block_names(scratch, rows, block_chars)
    order = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "row_id")
    groups = names.groupBy("level", "name").agg(F.min(order).alias("keeper"), F.count("*").alias("group_size")).where("group_size > 1")
    # stored, so that the join has a plain shuffle on both sides and a hot group's rows can be split
    groups = scratch.write(groups.select("level", "name", "group_size", F.col("keeper.doc_id").alias("first_id"), F.col("keeper.row_id").alias("first_row")), "groups")
    alone = F.col("group_size").isNull()
    decided = names.join(groups, ["level", "name"], "left").select(
        "row_id", F.when(alone, F.col("doc_id")).otherwise(F.col("first_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), (alone | (F.col("first_row") == F.col("row_id"))).alias("kept")
    )
    return facts, decided


def drop_exact_duplicates(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows that :func:`exact_duplicates` keeps, all columns as they were."""
    scratch, mark = Scratch(spark, "exact-dedup"), free_name(docs, "tidewright_row")
    rows = numbered(scratch, docs, mark)
    _, decided = _decide(scratch, rows.select(F.col(mark).alias("row_id"), "doc_id", "text"))
    return without_rows(scratch, rows, mark, decided.where("not kept").select("row_id"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark, read_table(spark, sf_dir, "documents")).drop("row_id")


OP10_SQL = r"""
with t as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as flat from documents
)
select doc_id, min(doc_id) over (partition by flat) as keep_id, count(*) over (partition by flat) as group_size,
       row_number() over (partition by flat order by doc_id nulls last) = 1 as kept, sha256(flat) as text_sha256
from t
"""
