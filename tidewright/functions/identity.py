"""Digests: sha256 over a domain, a zero byte and the content, in Python and as columns."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import WorkflowError


def digest(domain: str, content: bytes) -> str:
    return "sha256:" + hashlib.sha256(domain.encode() + b"\0" + content).hexdigest()


def digest_column(domain: str, content: Column) -> Column:
    """The same as :func:`digest`, over a binary column."""
    return F.concat(F.lit("sha256:"), F.sha2(F.concat(F.encode(F.lit(domain), "UTF-8"), F.unhex(F.lit("00")), content), 256))


def _number(d: Column) -> Column:
    """Text of a double, -0 and NaN folded."""
    d = d.cast("double")
    return F.when(F.isnan(d), "nan").when(d == 0, "0.0").otherwise(d.cast("string"))


def _canonical(c: Column, dtype: T.DataType) -> Column:
    """A nested value in one form: maps by their sorted entries, doubles folded, bytes as hex."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        return F.when(c.isNotNull(), _number(c))
    if isinstance(dtype, T.BinaryType):
        return F.hex(c)
    if isinstance(dtype, T.ArrayType):
        return F.transform(c, lambda x: _canonical(x, dtype.elementType))
    if isinstance(dtype, T.MapType):
        return F.array_sort(F.transform(F.map_entries(c), lambda e: F.struct(_canonical(e["key"], dtype.keyType).alias("key"), _canonical(e["value"], dtype.valueType).alias("value"))))
    if isinstance(dtype, T.StructType):
        return F.when(c.isNotNull(), F.struct(*[_canonical(c[f.name], f.dataType).alias(f.name) for f in dtype]))
    return c


def _cell(c: Column, dtype: T.DataType) -> Column:
    """Text of a value that tells null from any text."""
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        text = _number(c)
    elif isinstance(dtype, T.BinaryType):
        text = F.hex(c)
    elif isinstance(dtype, (T.ArrayType, T.MapType, T.StructType, T.VariantType)):
        text = F.to_json(F.struct(_canonical(c, dtype).alias("v")), {"ignoreNullFields": "false"})
    else:
        text = c.cast("string")
    return F.when(c.isNull(), "n").otherwise(F.concat(F.lit("v"), F.char_length(text).cast("string"), F.lit(":"), text))


def row_text(df: DataFrame) -> Column:
    """Canonical text of a row: its cells in the order of the columns."""
    return F.concat(*[_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema]) if df.columns else F.lit("")


def bag_digest(df: DataFrame) -> DataFrame:
    """One row (rows, digest): identity of the schema and the bag of rows.

    Every row's sha256 gives four longs, one a seed; the sums of their halves are
    order-free, so the table is read once and each task sends one row.  Sums are
    longs within a partition, exact up to 2^31 of its rows, and decimals across.
    """
    h = df.select(F.sha2(row_text(df), 256).alias("h")).select(*[F.xxhash64("h", F.lit(k)).alias(f"x{k}") for k in range(4)])
    halves = [(f"s{2 * k + i}", F.shiftrightunsigned(f"x{k}", 32) if i else F.col(f"x{k}").bitwiseAND(F.lit(0xFFFFFFFF))) for k in range(4) for i in (0, 1)]
    parts = h.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"), *[F.sum(c).alias(name) for name, c in halves])
    sums = parts.agg(F.coalesce(F.sum("n"), F.lit(0).cast("long")).alias("rows"), *[F.coalesce(F.sum(F.col(name).cast("decimal(38,0)")), F.lit(0)).cast("string").alias(name) for name, _ in halves])
    body = F.concat_ws("|", F.lit(df.schema.simpleString()), F.col("rows").cast("string"), *[name for name, _ in halves])
    return sums.select("rows", digest_column("tidewright/rows-bag/v2", F.encode(body, "UTF-8")).alias("digest"))


def ordered_digest(df: DataFrame, order: list[str]) -> DataFrame:
    """One row (rows, digest) that also depends on the order by a total key.

    Each row is bound to its key, which fixes its place; rows that tie on the key
    have no place, and are an error.
    """
    if df.groupBy(*order).count().where("count > 1").limit(1).count():
        raise WorkflowError("order_not_total", "digest", order=",".join(order))
    ranked = df.select(*order, *[c for c in df.columns if c not in order])
    inner = bag_digest(ranked)
    label = F.lit(",".join(order))
    return inner.select("rows", digest_column("tidewright/rows-ordered/v1", F.encode(F.concat(label, F.lit("|"), "digest"), "UTF-8")).alias("digest"))
