"""Shared pieces: scratch tables in the shared folder, row ids, graph components."""

from __future__ import annotations

import atexit
import ctypes
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder as shared_dir

#: The C library's call that gives free heap pages back; not every system has it.
_TRIM = getattr(ctypes.CDLL(None), "malloc_trim", None)
#: ASCII white space as the text contracts define it.
SPACES = r"[\x20\x09-\x0D]+"
#: Row ids that are broadcast: a hashed long takes some 32 bytes, so 32 MB at most.
BROADCAST_IDS = 1_000_000
#: Files that the rows of a scan are named by; their paths are broadcast, some 300 bytes each.
FILES = 100_000
#: Rows that a scan decodes at once while tables are stored: whole texts and long arrays make wide rows.
SCAN_ROWS = 512
#: Rounds of contraction after which the components count as not found.
ROUNDS = 500


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder, which cut lineage and survive executors.

    Operators drop the larger tables that only fed later ones; the rest, and what
    a lazily evaluated result still reads, goes when the driver ends.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/tidewright/{label}-{uuid.uuid4().hex}"
        atexit.register(self._close)

    def _close(self) -> None:
        try:
            remove(self.spark, self.root)
        except Exception:  # noqa: BLE001 - the session has ended; the folder belongs to the cluster
            return

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str) -> DataFrame:
        with setting(self.spark, "spark.sql.parquet.columnarReaderBatchSize", SCAN_ROWS):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove(self.spark, self.path(name))


@contextmanager
def setting(spark: SparkSession, name: str, most: int) -> Iterator[None]:
    """Holds a number of the session at ``most`` or below while something runs."""
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(most, int(before)) if int(before) > 0 else most))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def small_batches(spark: SparkSession, rows: int = 1024):
    """Hands Python few rows at a time while tables with wide rows are written."""
    return setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def give_back() -> None:
    """Returns what a Python worker's Arrow pool and heap hold free, so that workers stay as small as what they do."""
    pa.default_memory_pool().release_unused()
    if _TRIM is not None:
        _TRIM(0)


def settle(spark: SparkSession) -> None:
    """Has every executor collect its garbage in full, once, and so give back what its heap and buffers hold free.

    A heap grows with what is thrown away and hardly shrinks by itself, and buffers outside
    it stay until their owners are collected; over many jobs that adds up beside Python workers.
    A task a core reaches all executors that have one free; it takes some tenths of a second.
    """
    n = max(1, spark.sparkContext.defaultParallelism)
    spark.range(0, n, 1, n).select(F.expr("reflect('java.lang.System', 'gc')")).write.format("noop").mode("overwrite").save()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that the table does not have yet, however it is spelled."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name += "_"
    return name


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Numbers rows by their place in the scan, so repeated rows stay apart.

    How a scan is split follows the cores at hand, so a second job may number
    the rows otherwise.  Only a plan that is run once and stored may use this;
    what has to meet its rows again takes :func:`numbered`.
    """
    return df.withColumn(name, F.monotonically_increasing_id())


def _files(df: DataFrame) -> list[str] | None:
    """The files of a table that is nothing but a Parquet scan of different folders, in order; None for any other plan."""
    plan = df._jdf.queryExecution().analyzed()
    if plan.getClass().getSimpleName() != "LogicalRelation" or "_metadata" in {c.lower() for c in df.columns}:
        return None
    relation = plan.relation()
    if relation.getClass().getSimpleName() != "HadoopFsRelation" or relation.fileFormat().getClass().getSimpleName() != "ParquetFileFormat":
        return None
    roots = relation.location().rootPaths()
    names = [roots.apply(i).toString() for i in range(roots.size())]
    if any(a == b or b.startswith(a.rstrip("/") + "/") for a in names for b in names if a is not b):
        return None
    if len(df.inputFiles()) > FILES:
        return None
    return sorted(r.file_path for r in df.select("_metadata.file_path").distinct().collect())


def numbered(scratch: Scratch, df: DataFrame, name: str = "row_id", label: str = "rows") -> DataFrame:
    """The rows with ids that every later read gives them again, whatever becomes of executors.

    Rows of a plain Parquet scan of up to ``FILES`` files are named by their file
    and their place in it, which no split changes.  Any other table is stored with its ids.
    """
    files = _files(df)
    if files is None:
        return scratch.write(with_row_id(df, name), label)
    path, place, number = free_name(df, "tidewright_path"), free_name(df, "tidewright_place"), free_name(df, "tidewright_file")
    known = df.sparkSession.createDataFrame(list(zip(files, range(len(files)))), f"{path} string, {number} long")
    told = df.select("*", F.col("_metadata.file_path").alias(path), F.col("_metadata.row_index").alias(place)).join(F.broadcast(known), path)
    return told.select(*[F.col(f"`{c}`") for c in df.columns], (F.shiftleft(F.col(number), 40) + F.col(place)).alias(name))


def small(df: DataFrame, most: int = BROADCAST_IDS) -> DataFrame:
    """A stored table of ids, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def without_rows(scratch: Scratch, rows: DataFrame, name: str, dropped: DataFrame) -> DataFrame:
    """``rows`` without those whose id ``name`` is in the only column of ``dropped``, and without the id."""
    gone = scratch.write(dropped.toDF(name).distinct(), "dropped")
    return rows.join(small(gone), name, "left_anti").drop(name)


def long_array(values: list[int]) -> Column:
    """A constant array; callers pass one entry per partition, never per row."""
    return F.expr(f"array({', '.join(f'{v}L' for v in values)})" if values else "array(0L)")


def components(scratch: Scratch, edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an edge list as (node, root), root the smallest node.

    Alternates the large-star and small-star contractions until the edge set no
    longer changes: O(log^2 n) rounds in theory, a handful in practice.  Each
    round aggregates with map-side combination, so a node with very many edges
    costs one partial result per task.  The minima are stored before they are
    joined, so that the join has a plain shuffle on both sides and adaptive
    execution can split such a node's rows.  Only a count and a checksum per
    round come to the driver.  Nodes without edges are not in the result.  If
    the edges have not settled after ``ROUNDS`` rounds, that is an error, never a
    labelling that is not finished.
    """
    tag = uuid.uuid4().hex[:8]
    pairs = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    now = scratch.write(pairs.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"cc-{tag}-0")
    seen = None
    for step in range(1, ROUNDS + 1):
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"cc-{tag}-{step}-low")
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        down = scratch.write(large.where("u <> v").distinct(), f"cc-{tag}-{step}-large")
        least = scratch.write(down.groupBy("u").agg(F.min("v").alias("m")), f"cc-{tag}-{step}-least")
        small = down.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        small = small.select("e.*").where("u <> v").distinct()
        after = scratch.write(small, f"cc-{tag}-{step}")
        state = tuple(after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
        scratch.drop(f"cc-{tag}-{step - 1}", *(f"cc-{tag}-{step}-{x}" for x in ("low", "large", "least")))
        now = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"components have not settled after {ROUNDS} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v"), F.col("v"))).distinct()
